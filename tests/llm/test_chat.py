import random

from wakeline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pack_id string, loss string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def back(spark, rows, **limits):
    packs = chat.format_conversations(table(spark, rows), **limits)
    return packs, {r.conv_id: r for r in chat.read_conversations(packs).collect()}


def wanted(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_random_trees_read_back(spark):
    rng, rows = random.Random(2), []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ("user", "assistant", "sys<tem>\n")[(t + (c % 7 == 0)) % 3], rng.choice(["", "a", "b</turn>", "\\", "<turn:user>\n", "\\<", "long " * 30])))
    for limits in ({}, {"max_chars": 200}, {"max_members": 3}):
        _, got = back(spark, rows, **limits)
        for c, turns in wanted(rows).items():
            assert [(x.role, x.text) for x in got[c].turns] == turns
            assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")


def test_shared_turns_stand_once(spark):
    rows = [(c, 0, "user", "hello") for c in range(50)] + [(c, 1, "assistant", f"answer {c % 5}") for c in range(50)]
    packs, got = back(spark, rows)
    parts = packs.collect()
    assert sum(p.text.count("hello") for p in parts) == len(parts) and sum(len(p.members) for p in parts) == 50 == len(got)
    for p in parts:
        for s in p.segments:
            above = sum(x.end - x.start for x in s.attends)
            assert s.position == above and all(x.end <= s.start for x in s.attends)
            assert (s.parent == -1) == (not s.attends)


def test_hot_first_turn_is_spread_over_packs(spark):
    rows = [(c, 0, "user", "hi") for c in range(600)] + [(c, 1, "assistant", "same") for c in range(600)]
    packs, got = back(spark, rows, max_members=100)
    assert packs.count() >= 6 and max(len(p.members) for p in packs.collect()) <= 100 and len(got) == 600


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "no id"), (2, 5, "assistant", "")]
    _, got = back(spark, rows)
    assert [(x.role, x.text) for x in got[1].turns] == [("", "first"), ("user", ""), ("user", "")]
    assert got[None].loss_text == "no id" and got[2].loss_text == ""
    packs, got = back(spark, [])
    assert packs.count() == 0 and not got


def test_very_long_conversation_stays_whole(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "x<" * 5_000) for t in range(20)]
    _, got = back(spark, rows, max_chars=1_000)
    assert len(got[1].turns) == 20 and len(got[1].loss_text) == 100_000
