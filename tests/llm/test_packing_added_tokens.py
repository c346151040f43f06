"""Token ids against the vocabulary's own reader at its defaults."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import packing

TEXTS = [
    "a page <|endoftext|> about tokens", "<|endoftext|>", "<|endoftext|><|endoftext|> it's  12\n\n\t x", "end<|endoftext|>",
    "<|endoftext| > no token", "<|ENDOFTEXT|>", "", "  \n naïve ŝ 漢字 🙂 <|endoftext|>\n", "plain text alone",
]


def test_ids_at_the_defaults_of_the_reader():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [packing.token_ids()(t) for t in TEXTS] == [e.ids for e in slow.encode_batch(TEXTS, add_special_tokens=False)]
    assert packing.token_ids()(TEXTS[0]) == [64, 2443, 220, 50256, 546, 16326]


def test_pieces_hold_added_tokens(spark):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(docs).collect()}
    ids = {k: [*slow.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(TEXTS)}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids.items()}
