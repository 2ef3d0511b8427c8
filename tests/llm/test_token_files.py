"""Ids against the tokenizer itself, and what the files say."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderloom.llm import token_files as tf

PATH = public_tokenizers.path(tf.TOKENIZER)
WHOLE, WORDS = Tokenizer.from_file(PATH), tf.Encoder(PATH, words=20, pieces=10)


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["it's ", "'", "!'s", "'LL", "É", "x²", "ª", "µ", "÷", "<|", "0'd", "<|endoftext|>", "é", " ́", "\x85", "\x1c", "\xa0", " ", "Ab9", "9 9", "\t\n\x0b\x0c\r", "日本", "ß", "İ", "!?", "ΑΣ Σ"])).map("".join))
def test_word_by_word_is_the_whole(text):
    assert np.frombuffer(WORDS.encode(text.encode()), "<u4").tolist() == ids(text)


TEXTS = st.lists(st.sampled_from(["it's", "''s", "'s's", "x'd'd!", "!'s", "'", "'l", "'ll", "'re", "É'VE", "×'m", "ß", " ", "\n", "Ab9", "99", "日本", "<|endoftext|>"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS))
def test_texts_together_are_each_alone(texts):
    got = [i.tolist() for i in WORDS.encode_all([t.encode() for t in texts])]
    assert got == [ids(t) for t in texts]
    plain = [t for t in texts if tf.is_plain(t.encode())]
    pieces, bounds = tf.pieces_of([t.encode() for t in plain]) if plain else (None, [0])
    split = tf._SETTINGS["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
    assert [pieces[a:b].to_pylist() for a, b in zip(bounds, bounds[1:])] == [re.findall(split, t.lower()) for t in plain]


def names(first, count):
    return ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(first, first + count)]


def test_pieces_that_come_again_are_not_asked_again():
    encoder, asked = tf.Encoder(PATH), []
    model = encoder._new_piece
    encoder._new_piece = lambda piece: asked.append(piece) or model(piece)
    texts = [" ".join(names(first, 10_000)).encode() for first in range(0, 150_000, 10_000)]
    once = [encoder.encode(t) for t in texts]
    assert [encoder.encode(t) for t in texts] == once
    assert len(asked) == 150_000


def test_the_table_forgets_what_was_used_longest_ago():
    encoder = tf.Encoder(PATH, words=1000, pieces=600)
    texts = [" ".join(["always", "z" * 100, *names(300 * i, 300)]) for i in range(20)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids(text)
        assert len(encoder.words) <= 1000 and "always" in encoder.words and "z" * 100 not in encoder.words
    assert np.frombuffer(encoder.words["always"], "<u4").tolist() == ids("always")


def test_a_tokenizer_with_other_rules_gets_texts_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = ["Hello World, it's 2024 ...", "two  spaces\n\n\ttab", "", "É naïve <|endoftext|> x", "a b " * 3000, "word " * 2_000_000]
    assert tf.Encoder(PATH).by_pieces and not tf.Encoder(path).by_pieces
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tf.through_files(docs, path).collect(), key=lambda r: r.doc_id)
    for row, text in zip(got, texts):
        own = [*other.encode(text, add_special_tokens=False).ids, tf.END_ID]
        assert (row.n_tokens, row.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))


def test_round_trip(spark):
    odd = ["", None, "One two  three", "z" * 100_000, "a b " * 40_000, "naïve café <|endoftext|> x", "it's (Well...) ÉTÉ! ×÷ a_b c-d 1st", "\x00"]
    rows = [((i * 7919) % 997, odd[i % len(odd)] if i % 3 else f"text number {i}") for i in range(400)]
    rows += [(None, "null id"), (5, "same id b"), (5, "same id a"), (5, "same id a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("file", F.lit(0))
    got = [tuple(r) for r in tf.through_files(docs.repartition(6), PATH).collect()]
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        own = [*ids(text or ""), tf.END_ID]
        want.append((doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.through_files(docs.limit(0), PATH).collect() == []


@pytest.fixture
def files(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), "id").alias("text"))
    encoded = tf.encode(docs, PATH)
    tf.write_ids(encoded, str(tmp_path / "ids"))
    return encoded, str(tmp_path / "ids")


def test_filters_reach_the_files(files):
    encoded, path = files
    rows = tf.read_ids(encoded, path).filter("doc_id = 12345")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12345)]" in plan
    assert [r.doc_id for r in rows.collect()] == [12345]
    bounds = tf.read_ids(encoded, path).groupBy("file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    bounds = bounds.orderBy("file").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))
