"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary is sharded by word length, each shard a run of 64-bit blocks of a blocked Bloom filter: a word sets
five bits of one block. A word's neighbours of equal length are its replacements, probed in its own shard; those
one shorter its deletions, probed in the shard below; those one longer find it by their own deletions. A replacement
is only made with a later letter and a deletion only at the last of equal letters, so each pair is made once. The
hash of an edit comes from its word's by arithmetic, without writing the edit out.

Edits that pass are rows of numbers (hash of the edit, hash of the word, place, letter). They are joined to the
vocabulary by hash, and a pair counts if the edited word equals the found one letter by letter, so neither the
filters' false positives nor equal hashes have an effect.

A filter takes ``BITS`` bits a word and goes to the tasks in rounds of ``ROUND`` blocks, 32 MB, however large the
vocabulary is; every round probes only the edits whose block is in it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import as_bytes, stretches, written

LEAST_LETTERS, LEAST_COUNT = 5, 3
STRONGER = 2  # a form is this many times as frequent, or more
BITS = 16
ROUND = 1 << 22
LONGEST_SHARD = 64  # longer words share the last shard
HELD_WORDS = 300_000  # that a task counts before it hands them on
PROBES = 1 << 18  # edits that are probed at once

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOREIGN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
# Letters A-Z in lower case, a-z and the bytes of U+00C0 to U+00FF as they are, all other bytes a space.
_RUNS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256)
)


def runs(text: bytes) -> list[bytes]:
    """The maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case."""
    return _FOREIGN.sub(b" ", text).translate(_RUNS).split()


def _letters(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def _mistyped(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, typos: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): the words of LEAST_LETTERS or more and how often they occur in all texts.

    typos: where this divides the crc32 of ``<doc_id>:<run>``, the run loses the letter at crc32 % length. A NULL id
    counts as empty text. Rows with the same text and id count each. NULL and empty texts have no words.
    """
    slim = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    most = HELD_WORDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Counter]:
        held: Counter = Counter()
        for batch in batches:
            for own, content in zip(as_bytes(batch.column("id")), as_bytes(batch.column("text"))):
                start = zlib.crc32(own + b":")
                for part in stretches(content):
                    found = Counter(runs(part))
                    if typos:
                        hit = [w for w in found if zlib.crc32(w, start) % typos == 0]
                        for w, n in [(w, found.pop(w)) for w in hit]:
                            held[_mistyped(w, zlib.crc32(w, start))] += n
                    held.update(found)
                    if len(held) > most:
                        yield held
                        held = Counter()
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in counted(batches):
            rows = ((w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS and _letters(w) >= LEAST_LETTERS)
            while some := list(islice(rows, 50_000)):
                words, n = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"]
                )

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- hashes and filters -----------------------------------------------------------------------------------------


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _STEP)]), dtype=np.uint64)[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points as a matrix) for each length, long words a few at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, PROBES // max(1, length))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            points = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le"), "<u4")
            yield some, points.reshape(len(some), length).astype(np.uint64)


def _hashes(points: np.ndarray) -> np.ndarray:
    return (points * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def _hashed(counts: DataFrame) -> DataFrame:
    """(word, n, h) with the hash of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            h = np.zeros(len(words), np.uint64)
            for places, points in _by_length(words):
                h[places] = _hashes(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "h"])

    return counts.mapInArrow(run, "word string, n long, h long")


class Shards:
    """Where the blocks of each length lie: shard ``l`` has the blocks from start[l] to start[l + 1]."""

    def __init__(self, sizes: dict[int, int]):
        blocks = [-(-sizes.get(length, 0) * BITS // 64) for length in range(LONGEST_SHARD + 1)]
        self.start = np.concatenate([[0], np.cumsum(blocks)])

    @staticmethod
    def of(length: int) -> int:
        return min(length, LONGEST_SHARD)

    def range(self, length: int) -> tuple[int, int]:
        shard = self.of(length)
        return int(self.start[shard]), int(self.start[shard + 1])

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of each hash of a word of this length."""
        low, high = self.range(length)
        mixed = _mixed(h)
        block = ((mixed >> np.uint64(32)) * np.uint64(high - low)) >> np.uint64(32)
        mask = np.zeros(h.shape, np.uint64)
        for shift in (0, 6, 12, 18, 24):
            mask |= np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63))
        return block.astype(np.int64) + low, mask


def _set_bits(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """(block, bits) of the words' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(w) for w in batch.column("word").to_pylist()], np.int64)
            h = batch.column("h").to_numpy().view(np.uint64)
            block, bits = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64)
            for length in np.unique(lengths).tolist():
                own = lengths == length
                block[own], bits[own] = shards.place(length, h[own])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    rows = vocabulary.select("word", "h").mapInArrow(run, "block long, bits long")
    return rows.groupBy("block").agg(F.bit_or("bits").alias("bits"))


# --- edits ------------------------------------------------------------------------------------------------------

_HITS = "edit long, h long, at int, letter string"


def _edits(points: np.ndarray, h: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(length, hashes of the edits, rows of their words, place, letters put in; 0 for a deletion), place by place."""
    length = points.shape[1]
    power = _powers(length)
    terms = points * power
    # A deletion keeps the terms before it and divides those behind it by the step.
    behind = h - np.cumsum(terms, axis=1, dtype=np.uint64).T  # row i: the sum of the terms behind place i
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    for at in range(length):
        last = points[:, at] != points[:, at + 1] if at + 1 < length else np.ones(len(points), bool)
        rows = np.flatnonzero(last)
        rest = behind[at]
        edits = (h - rest - terms[:, at]) + rest * inverse
        yield length - 1, edits[rows], rows, at, np.zeros(len(rows), np.uint64)
        later = alphabet[None, :] > points[:, at][:, None]
        rows, letters = np.nonzero(later)
        if len(rows):
            put = alphabet[letters]
            yield length, h[rows] + (put - points[rows, at]) * power[at], rows, at, put


def _probed(vocabulary: DataFrame, shards: Shards, alphabet: np.ndarray, low: int, bits: np.ndarray) -> DataFrame:
    """The edits that pass the filter's blocks from ``low`` on."""
    high, at_once = low + len(bits), PROBES

    def touched(length: int) -> bool:
        a, b = shards.range(length)
        return a < b and a < high and b > low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            known = batch.column("h").to_numpy().view(np.uint64)
            step = max(1, at_once // len(alphabet))
            for places, matrix in _by_length(words):
                length = matrix.shape[1]
                if not (touched(length) or touched(length - 1)):
                    continue
                for first in range(0, len(places), step):
                    own, points = places[first : first + step], matrix[first : first + step]
                    out = []
                    for size, edits, rows, at, put in _edits(points, known[own], alphabet):
                        if not touched(size):
                            continue
                        block, mask = shards.place(size, edits)
                        if shards.range(size)[0] < low or shards.range(size)[1] > high:
                            here = np.flatnonzero((block >= low) & (block < high))
                            edits, rows, put, block, mask = edits[here], rows[here], put[here], block[here], mask[here]
                        hit = np.flatnonzero((bits[block - low] & mask) == mask)
                        if len(hit):
                            out.append((edits[hit], known[own[rows[hit]]], np.full(len(hit), at, np.int32), put[hit]))
                    if out:
                        edits, h, at_, put = (np.concatenate(c) for c in zip(*out))
                        letters = [chr(p) if p else "" for p in put.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(edits.view(np.int64)), pa.array(h.view(np.int64)), pa.array(at_), pa.array(letters, pa.string())],
                            ["edit", "h", "at", "letter"],
                        )

    return vocabulary.select("word", "h").mapInArrow(run, _HITS)


def _alphabet(vocabulary: DataFrame) -> np.ndarray:
    """The letters of all words, in order; at most those of U+0041 to U+00FF come to the driver."""
    rows = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    return np.array(sorted(ord(r["c"]) for r in rows if r["c"]), np.uint64)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of a written vocabulary (word, n, h): pairs one edit apart, in either direction."""
    length = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    # One row a shard.
    sizes = {r["length"]: r["n"] for r in vocabulary.groupBy(length.alias("length")).agg(F.count("*").alias("n")).collect()}
    shards, alphabet = Shards(sizes), _alphabet(vocabulary)
    blocks = int(shards.start[-1])
    filters = written(_set_bits(vocabulary, shards), "spelling-filters") if blocks > ROUND else _set_bits(vocabulary, shards)
    hits = None
    for low in range(0, max(1, blocks), ROUND):
        bits = np.zeros(max(1, min(ROUND, blocks - low)), np.uint64)
        # ROUND rows of two numbers at most.
        own = filters.filter((F.col("block") >= low) & (F.col("block") < low + ROUND)).toArrow() if blocks else None
        if own is not None and own.num_rows:
            bits[own["block"].to_numpy() - low] = own["bits"].to_numpy().view(np.uint64)
        found = written(_probed(vocabulary, shards, alphabet, low, bits), "spelling-hits")
        hits = found if hits is None else hits.unionByName(found)

    to = vocabulary.select(F.col("h").alias("edit"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    edited = F.concat(
        F.expr("substring(word, 1, at)"), F.col("letter"), F.expr("substring(word, at + 2, length(word))")
    )
    pairs = hits.join(to, "edit").join(vocabulary, "h").filter(edited == F.col("near"))
    both = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(both))


# --- forms and roots --------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling.

    A form is at least twice as frequent as its word, so a chain has at most log2 of the largest count links, and
    the rounds are fewer than the logarithm of that.
    """
    step = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = step.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        step = written(moved, "spelling-roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")


def variants(docs: DataFrame, typos: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of LEAST_LETTERS letters that occurs LEAST_COUNT times.

    form: the most frequent word one edit away (of equally frequent ones the first in code point order), if it is
    STRONGER times as frequent; root: the end of the chain of forms, the word itself without one. Only the columns
    of the text and the id are read. An empty table has no words. See ``word_counts`` for NULL values and ``typos``.
    """
    counts = word_counts(docs, typos, text, doc_id).filter(F.col("n") >= LEAST_COUNT)
    vocabulary = written(_hashed(counts), "vocabulary")
    return grouped(vocabulary, near_pairs(vocabulary))


def grouped(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    per_word = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong: Column = -F.col("best.minus") >= STRONGER * F.col("n")
    per_word = written(
        per_word.select(
            "word",
            "n_near",
            F.when(strong, F.col("best.word")).alias("form"),
            F.when(strong, -F.col("best.minus")).alias("form_n"),
        ),
        "spelling-near",
    )
    roots = _roots(per_word.filter(F.col("form").isNotNull()))
    return (
        vocabulary.select("word", "n")
        .join(per_word, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )
