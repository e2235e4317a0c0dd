import random

import numpy as np
import public_tokenizers
from messy import ROWS, empty, messy
from wakeline.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_round_trip_of_every_row(spark):
    encoding = bpe.load_encoding(RANKS, PATTERN)
    got = bpe.encode_and_decode(messy(spark), RANKS, PATTERN, piece=1000).collect()
    assert len(got) == len(ROWS)
    for row, (doc_id, text) in zip(got, ROWS):
        assert row.doc_id == doc_id and bytes(row.decoded) == (text or "").encode()
        assert np.frombuffer(row.ids_le, "<u4").tolist() == encoding.encode_ordinary(text or "")
    encoded = bpe.encode_documents(messy(spark), RANKS, PATTERN)
    decoded = bpe.decode_documents(encoded, RANKS, PATTERN).collect()
    assert [bytes(r.decoded) for r in decoded] == [(t or "").encode() for _, t in ROWS]
    assert bpe.encode_and_decode(empty(spark), RANKS, PATTERN).count() == 0
    assert bpe.encode_documents(empty(spark), RANKS, PATTERN).count() == 0


def test_cuts_change_no_token():
    encoding, rng = bpe.load_encoding(RANKS, PATTERN), random.Random(4)
    signs = ["a", "'s", " ", "\n", "\t", "  ", "1", "!", "\x1c", " ", " ", "é", "漢", "😀", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 120)))
        assert "".join(bpe.pieces(text, 7)) == text
        assert bpe.encode_text(encoding, text, 7).tolist() == encoding.encode_ordinary(text)


def test_broken_ids_give_their_raw_bytes(spark):
    encoding = bpe.load_encoding(RANKS, PATTERN)
    half = [encoding.encode_single_token(b"\xf0")]
    rows = spark.createDataFrame([(1, half, b"old"), (2, None, None), (3, [], None)], "doc_id long, ids array<int>, decoded binary")
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(rows, RANKS, PATTERN).collect()}
    assert bytes(got[1]) == b"\xf0" and got[2] is None and bytes(got[3]) == b""
