"""Leaks against a plain search for windows, and items asked with other numbers, names and units."""

import re

import pytest
from pyspark.sql import functions as F

from orderloom.llm import decontaminate as dc
from orderloom.llm.queries import QUERIES

ITEM = "Farmer John has 12 apples and sells 5 km of rope to Mary, then John buys 12 more apples each day. How many are left?"


def plain_words(text):
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", t).lower() for t in re.split(r"[ \t\n\v\f\r]+", text or "")) if w]


def brute(docs, items):
    out = set()
    for item, text in items:
        w = plain_words(text)
        size = min(5, len(w))
        wanted = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if size else []
        for doc, content in docs:
            d = plain_words(content)
            have = {tuple(d[i : i + size]) for i in range(len(d) - size + 1)}
            hits = sum(x in have for x in wanted)
            if wanted and hits >= 0.8 * len(wanted):
                out.add((doc, item))
    return out


def test_all_plain_leaks_are_found_and_nothing_else(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, folder).collect()}
    assert got == brute(docs, items) and got


@pytest.fixture(scope="module")
def found(spark):
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    docs = [
        (1, ITEM),
        (2, "Filler words first. " + ITEM.replace("John", "Peter").replace("Mary", "Anne").replace("12", "31").replace("5 km", "7 miles") + " More."),
        (3, ITEM.replace("John", "Peter", 1).replace("John", "Paul").replace("12", "31", 1).replace("12", "40")),  # disagrees
        (4, ITEM.upper()),
        (5, long + ITEM.replace(" ", " \n") + long),
        (6, "nothing of it"),
        (7, None),
        (8, ""),
        (9, ITEM[: len(ITEM) // 3]),
        (1, ITEM),
        (None, ITEM),
        (10, "short one two three"),
        (11, "A B C D E F G H"),
    ]
    items = [(100, ITEM), (101, "one two three"), (102, ""), (103, None), (None, "!!!")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("k1", F.lit(0))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("clash"))
    return docs, items, sorted((str(r.doc_id), r.item_id) for r in dc.leaks(docs.repartition(4), items).collect())


def test_other_numbers_names_and_units(found):
    assert found[2] == sorted([("1", 100), ("1", 100), ("2", 100), ("4", 100), ("5", 100), ("None", 100), ("10", 101)])


def test_clean_documents_stay(found):
    docs, items, _ = found
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8, 9, 11]


def test_empty_tables(found):
    docs, items, _ = found
    assert dc.leaks(docs.limit(0), items).collect() == [] and dc.leaks(docs, items.limit(0)).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_words_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(dc, "KEEP_WORDS", 3)
    one, many = dc.Words(), dc.Words()
    for text in (b"a b c d e f", b"g h i 5 km", b"a b x. Yes No", b"", b"a a"):
        fresh = dc.Words()
        for words in (one, many):
            got, want = words.of(text), fresh.of(text)
            assert all((g == w).all() for g, w in zip(got, want))


NAMES = "Tom has 5 apples. Ann has 7 apples. Bob has 9 apples. How many apples do they have?"
NUMBERS = "A baker fills five trays with bread and sells two of them to the school, and then the McDonald family takes a 3-page list."


def test_names_at_sentence_starts_number_words_and_coinciding_values(spark):
    docs = [
        (1, NAMES.replace("Tom", "Eve").replace("Ann", "Joe").replace("Bob", "Sue").replace("5", "3").replace("7", "8").replace("9", "4")),
        (2, NAMES.replace("5", "6").replace("7", "6")),  # two values of the item become one
        (3, NUMBERS.replace("five", "nine").replace("two", "four").replace("McDonald", "O'Brien").replace("3-page", "12-page")),
        (4, NUMBERS.replace("3-page list", "3-line note").replace("trays", "boxes").replace("school", "shop")),  # other words
        (5, "The has 5 apples. When has 7 apples. These has 9 apples. How many apples do they have?"),  # no names
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, NAMES), (2, NUMBERS)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()) == [(1, 1), (2, 1), (3, 2)]
