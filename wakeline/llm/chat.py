"""Conversations formatted as prefix trees.

Conversations that begin with the same turns share them: a pack is one stream of text in
which each turn of a tree stands once, parents before children, depth first. A turn's
position ids go on from its parent's in the conversation, not in the stream, and its
attention reaches the stream intervals of its ancestors and itself.

Packs are bounded, as training sequences are. A tree larger than a pack goes on in the
next one, which repeats only the turns still open; so one first turn that a third of all
conversations begin with is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import map_batches

MAX_CHARS = 1 << 16
MAX_MEMBERS = 1024
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\([\\<>])")
_PLAIN = r"([^\\<>]*(?:\\[\\<>][^\\<>]*)*)"
_TURN = re.compile(rf"<turn:{_PLAIN}>\n{_PLAIN}</turn>\n")

_SPAN = "struct<start:int, `end`:int>"
PACK_SCHEMA = (
    "pack_id long, text string, "
    f"segments array<struct<start:int, `end`:int, position:int, parent:int, attends:array<{_SPAN}>, loss:{_SPAN}>>, "
)


def escape(text: str) -> str:
    """Every ``<`` and ``>`` outside a marker, and every backslash, gets a backslash before it."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends."""
    head, body = f"<turn:{escape(role)}>\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class _Pack:
    """One stream being written; ``path`` is the branch that the last conversation took."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.segments: list[dict] = []
        self.members: list[tuple] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for (own, _), turn in zip(self.path, turns):
            if own != turn:
                break
            n += 1
        return n

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        n = self.shared(turns)
        del self.path[n:]
        for turn in turns[n:]:
            text, loss_start, loss_end = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            above = self.segments[parent] if self.path else None
            attends = [dict(x) for x in above["attends"]] if above else []
            if above and attends and attends[-1]["end"] == above["start"]:
                attends[-1]["end"] = above["end"]
            elif above:
                attends.append({"start": above["start"], "end": above["end"]})
            start = self.length
            self.segments.append({
                "start": start,
                "end": start + len(text),
                "position": above["position"] + above["end"] - above["start"] if above else 0,
                "parent": parent,
                "attends": attends,
                "loss": {"start": start + loss_start, "end": start + loss_end} if turn[0] == LOSS_ROLE else None,
            })
            self.path.append((turn, len(self.segments) - 1))
            self.parts.append(text)
            self.length += len(text)
        self.members.append((conv_id, self.path[-1][1]))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order of turn, then role and text; nulls first, null role or text as empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        conversations.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"))
    )


def format_conversations(
    conversations: DataFrame, max_chars: int = MAX_CHARS, max_members: int = MAX_MEMBERS
) -> DataFrame:
    """Packs: the stream, its segments (one per shared turn) and its members (conv_id, last segment).

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Null
    role or text is empty; rows with a null conv_id form one conversation; repeated rows and
    turns with the same number all stay, ordered by role and text; an empty table gives no
    packs. A conversation longer than ``max_chars`` has a pack of its own and is never cut.
    """
    turns = conversation_turns(conversations)
    path = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"]))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    # neighbours in this order share the longest prefixes; the id splits equal conversations
    ordered = (
        turns.withColumn("path", path)
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .select("conv_id", "turns")
    )
    packed = T.StructType.fromDDL(PACK_SCHEMA + f"members array<struct<conv_id:{id_type}, leaf:int>>")
    arrow = to_arrow_schema(packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, now = TaskContext.get().partitionId() << 33, 0, _Pack()

        def close(p: _Pack, n: int) -> pa.RecordBatch:
            members = [{"conv_id": c, "leaf": leaf} for c, leaf in p.members]
            row = {"pack_id": base + n, "text": "".join(p.parts), "segments": p.segments, "members": members}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for conv_id, rows in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist()):
                turns = [(x["role"], x["text"]) for x in rows]
                new = sum(len(format_turn(*x)[0]) for x in turns[now.shared(turns) :])
                if now.members and (now.length + new > max_chars or len(now.members) >= max_members):
                    yield close(now, number)
                    number, now = number + 1, _Pack()
                now.add(conv_id, turns)
        if now.members:
            yield close(now, number)

    return ordered.mapInArrow(pack, packed)


def read_conversations(packs: DataFrame) -> DataFrame:
    """What each conversation attends to, read back: conv_id, formatted, turns, loss_text (unescaped)."""
    id_type = packs.schema["members"].dataType.elementType["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"conv_id {id_type}, formatted string, turns array<struct<role:string, text:string>>, loss_text string"
    )

    arrow = to_arrow_schema(schema)

    def make():
        def work(batch):
            out = {name: [] for name in schema.names}
            for text, segments, members in zip(*(batch[c].to_pylist() for c in ("text", "segments", "members"))):
                for member in members:
                    leaf = segments[member["leaf"]]
                    reach = [*leaf["attends"], {"start": leaf["start"], "end": leaf["end"]}]
                    formatted = "".join(text[x["start"] : x["end"]] for x in reach)
                    loss, at = [], member["leaf"]
                    while at >= 0:
                        if span := segments[at]["loss"]:
                            loss.append(text[span["start"] : span["end"]])
                        at = segments[at]["parent"]
                    out["conv_id"].append(member["conv_id"])
                    out["formatted"].append(formatted)
                    out["turns"].append([{"role": r, "text": t} for r, t in parse_turns(formatted)])
                    out["loss_text"].append(unescape("".join(reversed(loss))))
            return pa.RecordBatch.from_pydict(out, schema=arrow)

        return work

    return map_batches(packs, schema, make)
