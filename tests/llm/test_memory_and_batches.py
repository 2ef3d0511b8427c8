"""Texts in one array are read as each alone; workers give back the encoder's tables."""

import sys

import numpy as np
import pyarrow as pa
import public_tokenizers

from orderloom.llm import decontaminate as D
from orderloom.llm import token_files as TF

TEXTS = [
    b"Alice went to 3 shops. Alice paid 12 dollars.", b"", b"...", b"Paid by alice. Bob and Alice left", b"Bob left. Then Bob came",
    "Zoë ran 5 km! Zoë stopped".encode(), b"Then",
]


def test_texts_together_are_words_of_each_alone():
    common = frozenset(D._word_hash(w) for w in ("bob", "paid"))
    hashes, kinds, marks, of = D.Words(common).of_texts(TEXTS)
    for i, text in enumerate(TEXTS):
        alone = D.Words(common).of(text)
        for own, together in zip(alone, (hashes, kinds, marks)):
            assert np.array_equal(own, together[of == i]), text
    assert [[len(t) for t in g] for _, g in D._together(iter([b"x" * D.TOGETHER, b"y", b"z"]))] == [[D.TOGETHER], [1, 1]]
    assert [b for b, _ in D._together(iter([b"x" * D.TOGETHER, b"y"]))] == [0, 1]


def test_reading_back_drops_the_encoders():
    encoder = TF.encoder_of(public_tokenizers.path(TF.TOKENIZER))
    encoder.encode(b"some words of a text")
    ids = pa.array([[5, 1]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([0]), ids], ["doc_id", "file", "at", "ids"])
    assert [b.column("n_tokens").to_pylist() for b in TF._crc(iter([batch]))] == [[2]]
    assert not TF._ENCODERS


def test_a_worker_holds_few_words():
    encoder = TF.Encoder(public_tokenizers.path(TF.TOKENIZER))
    expected = {}
    for start in range(0, 200_000, 20_000):
        text = " ".join(f"w{i}q" for i in range(start, start + 20_000)).encode()
        expected[start] = encoder.encode(text)
        assert len(encoder.words) <= 120_000
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.words.items())
    assert held < 20_000_000
    again = " ".join(f"w{i}q" for i in range(20_000)).encode()
    assert encoder.encode(again) == expected[0]
