"""Every registered query on the smallest tables, the pipeline against plain steps, and the SQL checks."""

import hashlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
import tiktoken  # noqa: F401
from check_oracles import check, open_oracle
from conftest import SMALL
from messy import ROWS, corpus
from test_neardup import plain
from test_pii import plain as plain_pii
from wakeline.llm import bpe, mixing, quality

CONTRACT = {
    "op1_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_": "doc_id held_out score predicted",
    "op4_": "doc_id held_out score predicted",
    "op5_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_": "doc_id n_shingles component_id kept",
    "op9_": "doc_id source block slot",
    "op10_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_": "doc_id keep_id group_size kept text_sha256",
    "op12_": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "pipeline": "doc_id position n_tokens ids_le decoded_sha256",
}


@pytest.mark.parametrize("start", CONTRACT)
def test_query(spark, start):
    (name,) = [n for n in entry.LLM_QUERIES if n.startswith(start)]
    con = open_oracle(SMALL)
    held = []

    def run(session, folder):
        held.append(entry.LLM_QUERIES[name](session, folder))
        return held[0]

    rows, problem = check(spark, con, name, run, entry.LLM_ORACLES.get(name), SMALL)
    assert problem is None, problem
    assert set(CONTRACT[start].split()) <= set(held[0].columns)
    if start not in ("op2_", "op12_", "pipeline"):
        assert rows == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_stages_against_plain_steps(spark, tmp_path):
    docs, labels = corpus(spark, 300)
    copies = docs.where("doc_id % 10 = 1").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(copies)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (_, reject), (_, dedup), (_, redact), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = reject(spark, docs, str(tmp_path)).cache()
    want = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = dedup(spark, good, str(tmp_path)).cache()
    roots = plain(rows, 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, root) in roots.items() if i == root}
    clean = redact(spark, one, str(tmp_path)).cache()
    assert clean.count() == one.count() and not any(plain_pii(r.text or "") for r in clean.collect())
    mixed = mix(spark, clean, str(tmp_path)).cache()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, clean.collect()))
    encoding = bpe.load_encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    final = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in encode(spark, mixed, str(tmp_path)).collect()}
    assert final == {(r.doc_id, len(encoding.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect()}
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_tokens) for r in done} == {x[:2] for x in final}
    # the result says in which order the mixing stage left the documents
    slots = {r.doc_id: r.slot for r in mixing.schedule(clean).collect()}
    by_place = [slots[r.doc_id] for r in sorted(done, key=lambda r: r.position)]
    assert len({r.position for r in done}) == len(done) and by_place == sorted(by_place) and len(set(by_place)) > 5
    assert len(ROWS) == 12
