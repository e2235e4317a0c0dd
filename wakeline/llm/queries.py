"""The training-data operators as runnable queries over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import anomaly, bpe, brown, chat, merkle, mixing, neardup, perfect_hash, pii, quality, toxicity, trie, winnow
from wakeline.llm.common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_and_decode(table(spark, folder, "documents"), rank_file, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Both turns of the added conversation -7 say this.
ADVERSE = "\\### Assistant: </turn> ok"


@query(
    "op2_chat_prefix_tree",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{ADVERSE}'), (-7, 1, 'assistant', '{ADVERSE}')
    ), sized AS (
        SELECT *, length(regexp_replace(role || text, '[\\\\<>]', '##', 'g')) + length('<turn:>_</turn>_') AS n,
            CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        sum(length(loss))::BIGINT AS loss_chars,
        sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
        sum(n)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def chat_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", ADVERSE), (-7, 1, "assistant", ADVERSE)]
    turns = turns.unionByName(spark.createDataFrame(added, turns.schema))
    back = chat.read_conversations(chat.format_conversations(turns))
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_pu_quality")
def pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    held_out = id_remainder(quality.FOLDS) == quality.HELD_OUT
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_nearest_toxic")
def nearest_toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    held_out = id_remainder(toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


@query("op5_isolation_rules")
def isolation_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    forest = anomaly.fit(docs, table(spark, folder, "labels"))
    return anomaly.judge(docs, forest).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )


@query("op6_pii_boosting")
def pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    listed = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    )
    return found.select(
        "doc_id",
        *(
            F.size(of_kind(kind)).cast("long").alias(f"n_{kind}")
            for kind in ("email", "ip", "card", "phone")
        ),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op7_winnowing")
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.compare_neighbours(table(spark, folder, "documents"), with_positions=True)


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


@query(
    "op8_tensored_minhash",
    rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END) AS g FROM words
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= 85 * (x.n + y.n - c)
    ), reach AS (
        SELECT doc_id, doc_id AS r FROM documents
        UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
    )
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
    FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
)
def tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op1_brown_classes")
def brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score_corpus(table(spark, folder, "documents").select("doc_id", "text"))


@query("op9_pfair_mixing")
def pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc_id", "source", "block", "slot")


@query(
    "op11_perfect_hash",
    """
    SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
        doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
    """,
)
def perfect_hash_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents, by a hash of the id, are the history; the others come as a batch."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = perfect_hash.find_repeats(docs, id_remainder(2) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


@query(
    "op12_prefix_trie",
    f"""
    WITH ordered AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), sizes AS (
        SELECT conv_id, conv_id - conv_id % 5 AS hub, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM ordered GROUP BY conv_id
    ), rebuilt AS (
        SELECT s.conv_id, 0 AS part, o.pos, role, text FROM sizes s JOIN ordered o ON o.conv_id = s.hub AND o.pos < s.h
        UNION ALL
        SELECT s.conv_id, 1, o.pos, role, text FROM sizes s JOIN ordered o ON o.conv_id = s.conv_id AND o.pos >= s.h
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d,
            sha256(strlen(role) || ':' || role || text) AS told
        FROM rebuilt
    ), whole AS (
        SELECT conv_id, count(told) AS n, coalesce(string_agg(told, '' ORDER BY d), '') AS path
        FROM sizes LEFT JOIN placed USING (conv_id) GROUP BY conv_id
    ), visits AS (
        SELECT conv_id, n, unnest(range(0, n + 1)) AS d, path FROM whole
    ), steps AS (
        SELECT v.conv_id, v.n, v.d, v.path[1:64 * v.d] AS id, strlen(text) AS bytes
        FROM visits v LEFT JOIN placed p ON p.conv_id = v.conv_id AND p.d = v.d
    ), nodes AS (
        SELECT id, d, min(conv_id) AS least, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(bytes), 0) AS value,
            sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
        FROM steps GROUP BY id, d
    ), children AS (
        SELECT id[1:64 * (d - 1)] AS id, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
    ), below AS (
        SELECT DISTINCT a.id, b.id AS lower FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d
    ), totals AS (
        SELECT below.id, count(*) FILTER (c.id IS NULL) AS n_leaves, sum(n.value) AS saved
        FROM below JOIN nodes n ON n.id = lower LEFT JOIN children c ON c.id = lower GROUP BY below.id
    )
    SELECT n.least AS conv_id, n.d AS depth, p.least AS parent_conv_id, n.n_convs,
        coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
    FROM nodes n JOIN totals USING (id) LEFT JOIN children USING (id)
    LEFT JOIN nodes p ON n.d > 0 AND p.id = n.id[1:64 * (n.d - 1)]
    """,
)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.shared_openings(table(spark, folder, "conversations"))


def _merkle_levels(name: str, levels: int) -> str:
    """CTEs ``name``1 … over ``name``0 (tree, pos, digest), and ``name``_path per leaf (before, after of each level)."""
    made = []
    for k in range(levels):
        made.append(f"""{name}{k + 1} AS (
            SELECT tree, pos // 8 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY ALL
        )""")
        made.append(f"""{name}_by{k} AS (
            SELECT a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, any_value(a.n) AS n
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) a
            JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.pos
        )""")
    return ", ".join(made)


def _merkle_climb(name: str, source: str, tree: str, pos: str, levels: int) -> str:
    """CTEs ``name``_up0 … that fold ``source`` (now, proof) level by level."""
    made = [f"{name}_up0 AS (SELECT *, {tree} AS t_{name}, {pos} AS p_{name} FROM {source})"]
    for k in range(levels):
        made.append(f"""{name}_up{k + 1} AS (
            SELECT u.* REPLACE (p_{name} // 8 AS p_{name}, CASE WHEN b.n = 1 THEN now ELSE sha256(l || now || r) END AS now,
                proof || l || r AS proof)
            FROM {name}_up{k} u JOIN {name}_by{k} b ON b.tree = t_{name} AND b.pos = p_{name}
        )""")
    return ", ".join(made)


_FIELD = "coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
_LEAF = " || ".join(_FIELD.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", "{text}"))
_LOWERED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


@query(
    "op13_merkle_climb",
    f"""
    WITH leaves AS (
        SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
            sha256({_LEAF.format(text="text")}) AS digest,
            CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_LEAF.format(text=_LOWERED)}) END AS changed
        FROM documents
    ), low0 AS (SELECT tree, pos, digest FROM leaves), {_merkle_levels("low", 7)},
    top0 AS (SELECT 0 AS tree, tree AS pos, digest FROM low7), {_merkle_levels("top", 3)},
    start AS (SELECT *, coalesce(changed, digest) AS now, '' AS proof FROM leaves),
    {_merkle_climb("low", "start", "tree", "pos", 7)}, {_merkle_climb("top", "low_up7", "0", "tree", 3)}
    SELECT doc_id, u.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256,
        now AS folded_root, now = r.digest AS verified
    FROM top_up3 u JOIN low7 s ON s.tree = u.tree CROSS JOIN top3 r
    """,
)
def merkle_climb(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    text = F.when(id_remainder(3) == 0, lowered).otherwise(F.col("text"))
    return merkle.prove_documents(table(spark, folder, "documents"), text)
