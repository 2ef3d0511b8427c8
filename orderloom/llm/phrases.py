"""Phrases that stand together: counts from suffix subtrees that are built prefix group by prefix group.

Texts are split into pieces and those into words; a suffix is cut off at its piece's end and at ``LONGEST`` words. The
suffix tree of a language is never built as a whole. A prefix of one word is extended by further words while more than
``BUDGET`` suffixes begin with it; the prefixes then fall to as many groups as hold ``BUDGET`` suffixes each. Every task
counts the suffixes of its texts and hands them on in one block a group, and each group's subtree is built alone, from
its sorted suffixes: where the first d words change, a node of depth d ends, and the total over its leaves is its
phrase's count. Nodes above a group's prefix have leaves in several groups; their totals are added up.

A phrase counts only if it occurs ``LEAST`` times, and then so do its parts. Words, and shorter phrases up to
``FILTERED`` words by their hashes, are therefore counted first, and suffixes are cut where they cannot be part of
such a phrase; the same counts tell which prefixes are extended. Both go to the tasks as bit maps of fixed size,
2^MAP_BITS bits for each length: a bit set by another phrase costs work, or splits a prefix that could be whole, and
changes no count, since suffixes are strings from there on.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.common import as_bytes, lengths_to_offsets, stretches, written

LONGEST = 5
LEAST = 100
SHARE = 100  # a longer phrase with this percentage of a phrase's count takes its place
TOP = 2000
BUDGET = 250_000
FILTERED = 3
MAP_BITS = 26
HELD = 200_000  # entries that a task counts before it hands them on
PART = 1 << 20  # bytes of text that are split at once
NO_LANGUAGE = "und"

_BREAK = b"\xff"  # in no UTF-8 text
# Letters A-Z in lower case, the ends of a piece as a break, a tab as a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, and a break wherever a piece ends."""
    return text.translate(_BYTES).replace(_BREAK, b" \xff ").split()


def parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, tokens, n): phrases that start among the first n tokens belong to this part.

    Short texts are put together up to ``size`` bytes; of a long one each part ends with the tokens with which the next begins, so that
    every phrase is whole in one of them.
    """
    for batch in batches:
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: Counter = Counter()
        for language, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            if len(text) > size:
                own: list[bytes] = []
                for part in stretches(text, size):
                    own += tokens(part)
                    n = max(0, len(own) - LONGEST + 1)
                    yield language, own, n
                    own = own[n:]
                yield language, own, len(own)
                continue
            held[language].append(text)
            sizes[language] += len(text)
            if sizes[language] > size:
                some = tokens(_BREAK.join(held.pop(language)))
                del sizes[language]
                yield language, some, len(some)
        for language, texts in held.items():
            some = tokens(_BREAK.join(texts))
            yield language, some, len(some)


def _emitted(counts: dict[str, Counter], name: str) -> Iterator[pa.RecordBatch]:
    for language, own in counts.items():
        rows = iter(own.items())
        while some := list(islice(rows, 50_000)):
            texts, n = zip(*some)
            columns = [pa.array([language] * len(n), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", name, "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    part, most = PART, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for language, some, n in parts(batches, part):
            own = counts[language]
            own.update(some if n == len(some) else some[:n])
            own.pop(_BREAK, None)
            if sum(map(len, counts.values())) > most:
                yield from _emitted(counts, "word")
                counts.clear()
        yield from _emitted(counts, "word")

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- which suffixes can be part of a frequent phrase --------------------------------------------------------------

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hash(language: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, zlib.crc32(language.encode())) or 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _bit_maps(counted: DataFrame, least: int, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of (h, n): bits of the hashes that occur ``least`` times, of those above the budget, and the former's sum of n.

    2^MAP_BITS / 64 rows of three numbers come to the driver at most.
    """
    place = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    heavy = F.when(F.col("n") > budget, bit).otherwise(F.lit(0).cast("long"))
    grouped = counted.filter(F.col("n") >= least).groupBy(F.shiftright(place, 6).alias("word"))
    rows = grouped.agg(F.bit_or(bit).alias("bits"), F.bit_or(heavy).alias("heavy"), F.sum("n").alias("n")).toArrow()
    out = []
    for name in ("bits", "heavy"):
        own = np.zeros(1 << (MAP_BITS - 6), np.int64)
        own[rows["word"].to_numpy()] = rows[name].to_numpy()
        out.append(own.view(np.uint64))
    return *out, int(rows["n"].to_numpy().sum())


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


class Filters:
    """maps[k - 1]: the bit map of frequent phrases of k words; heavy[k - 1]: of those with too many suffixes."""

    def __init__(self, maps: list[np.ndarray], heavy: list[np.ndarray], held: int):
        self.maps, self.heavy, self.held = maps, heavy, held
        self.known: dict[str, dict[bytes, int]] = {}

    def words(self, language: str, some: list[bytes]) -> np.ndarray:
        """Hashes of the tokens; 0 for a break and a word that is not frequent."""
        known = self.known.setdefault(language, {})
        if sum(map(len, self.known.values())) > self.held:
            self.known = {language: (known := {})}
        new = [w for w in set(some) if w not in known]
        if new:
            h = np.array([_word_hash(language, w) for w in new], np.uint64)
            h[~_set(self.maps[0], _mixed(h))] = 0
            known.update(zip(new, h.tolist()))
            known[_BREAK] = 0
        return np.fromiter(map(known.__getitem__, some), np.uint64, len(some))

    def passing(self, language: str, some: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For phrases of 2, 3, ... size words: hashes by place, whether the parts pass, and the phrase itself as well."""
        words = self.words(language, some)
        h, good = words, words != 0
        for k in range(2, size + 1):
            tried = good[:-1] & good[1:]
            h = _mixed(h[: len(tried)] * _STEP + words[k - 1 : k - 1 + len(tried)])
            good = tried
            if k <= len(self.maps):
                places = np.flatnonzero(tried)
                good = tried.copy()
                good[places] = _set(self.maps[k - 1], h[places])
            yield h, tried, good

    def suffixes(self, language: str, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: words of the suffix there that may be part of one phrase, and its prefix: words and hash."""
        words = self.words(language, some)
        length, prefix = (words != 0).astype(np.int64), words.copy()
        depth = np.ones(len(some), np.uint8)
        deeper = (words != 0) & _set(self.heavy[0], _mixed(words))
        for k, (h, _, good) in enumerate(self.passing(language, some, LONGEST), 2):
            length[: len(good)] += good
            longer = np.flatnonzero(deeper[: len(good)] & good)
            prefix[longer] = h[longer]
            depth[deeper] = k  # also of a suffix that ends here, since others go on
            deeper = np.zeros(len(some), bool)
            deeper[longer] = _set(self.heavy[k - 1], h[longer]) if k <= len(self.heavy) else True
        return length, depth, prefix


def _phrase_hashes(texts: DataFrame, maps: list[np.ndarray], size: int) -> DataFrame:
    """(h, n): hashes of the phrases of this size whose parts pass."""
    part, most = PART, HELD

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held, room = Filters(maps, [], most), [], 0
        for language, some, n in parts(batches, part):
            for h, tried, _ in filters.passing(language, some, size):
                pass
            own = h[:n][tried[:n]]
            held.append(own)
            room += len(own)
            if room > 4 * most:
                yield counted(held)
                held, room = [], 0
        if room:
            yield counted(held)

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def filters_of(
    texts: DataFrame, words: DataFrame, least: int, budget: int, filtered: int = FILTERED
) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The bit maps of words and of phrases of 2 to ``filtered`` words, the heavy ones, and how many suffixes there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), as_bytes(batch.column("word")))
            h = _mixed(np.array([_word_hash(language, w) for language, w in pairs], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("n")], ["h", "n"])

    counted = words.select("lang", "word", "n").mapInArrow(run, "h long, n long")
    maps, heavy, suffixes = [], [], 0
    for size in range(1, filtered + 1):
        bits, above, n = _bit_maps(_phrase_hashes(texts, maps, size) if size > 1 else counted, least, budget)
        maps.append(bits)
        heavy.append(above)
        suffixes = n if size <= 2 else suffixes  # those of two words or more
    return maps, heavy, suffixes


# --- subtrees by prefix group -----------------------------------------------------------------------------------

_BLOCKS = "group int, depth int, lang string, suffixes array<string>, n array<long>"


def blocks(texts: DataFrame, maps: list[np.ndarray], heavy: list[np.ndarray], groups: int) -> DataFrame:
    """(group, depth, lang, suffixes, n): a task's counted suffixes of two words or more, by prefix group.

    depth is the length of the prefixes; the suffixes of one prefix all have the same.
    """
    part, most = PART, HELD

    def emitted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for language, own in counts.items():
            # The first bytes of a key are its group and its depth.
            for head, some in groupby(sorted(own), key=lambda k: k[:5]):
                some = list(some)
                ends = pa.array(lengths_to_offsets(np.array([len(some)])), pa.int32())
                texts_ = pa.array([k[5:] for k in some], pa.binary()).cast(pa.string())
                n = pa.array([own[k] for k in some], pa.int64())
                columns = [pa.array([int.from_bytes(head[:4], "big")], pa.int32()), pa.array([head[4]], pa.int32())]
                columns += [pa.array([language], pa.string()), *(pa.ListArray.from_arrays(ends, c) for c in (texts_, n))]
                yield pa.RecordBatch.from_arrays(columns, ["group", "depth", "lang", "suffixes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, counts = Filters(maps, heavy, most), defaultdict(Counter)
        for language, some, n in parts(batches, part):
            length, depth, prefix = filters.suffixes(language, some)
            places = np.flatnonzero(length[:n] > 1)
            heads = np.zeros(len(places), [("group", ">u4"), ("depth", "u1")])
            heads["group"], heads["depth"] = _mixed(prefix[places]) % np.uint64(groups), depth[places]
            head = heads.tobytes()
            own = zip(places.tolist(), length[places].tolist())
            counts[language].update([head[5 * j : 5 * j + 5] + b" ".join(some[i : i + k]) for j, (i, k) in enumerate(own)])
            if sum(map(len, counts.values())) > most:
                yield from emitted(counts)
                counts.clear()
        yield from emitted(counts)

    return texts.mapInArrow(run, _BLOCKS)


def subtree(rows: list[list[str]], n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a leaf's row, total over the leaves) of each node of 2 words or more.

    Words are numbered in the order met: leaves of one node must only lie side by side, in whatever order.
    """
    numbers: dict[str, int] = {}
    table = np.full((len(rows), LONGEST), -1, np.int64)
    for i, words in enumerate(rows):
        table[i, : len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    order = np.lexsort(table.T[::-1])
    table, n = table[order], n[order]
    changed = np.ones(len(table), bool)
    changed[1:] = table[1:, 0] != table[:-1, 0]
    for depth in range(2, LONGEST + 1):
        changed[1:] |= table[1:, depth - 1] != table[:-1, depth - 1]
        starts = np.flatnonzero(changed)
        totals = np.add.reduceat(n, starts) if len(starts) else n
        real = table[starts, depth - 1] >= 0
        yield depth, order[starts[real]], totals[real]


def node_counts(dealt: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): phrases of two words or more that occur ``least`` times, from the groups' blocks."""

    def grown(language: str, prefix: int, counts: Counter) -> Iterator[pa.RecordBatch]:
        rows = [k.split(" ") for k in counts]
        for depth, leaves, totals in subtree(rows, np.array(list(counts.values()), np.int64)):
            # Above its group's prefixes a node has further leaves elsewhere.
            kept = totals >= (least if depth >= prefix else 1)
            phrases_ = [" ".join(rows[i][:depth]) for i in leaves[kept].tolist()]
            if phrases_:
                columns = [pa.array([language] * len(phrases_), pa.string()), pa.array(phrases_, pa.string()), pa.array(totals[kept])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterable[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield (row["group"], row["depth"], row["lang"]), zip(row["suffixes"], row["n"])

        for (_, depth, language), own in groupby(rows(), key=lambda r: r[0]):
            counts: Counter = Counter()
            for _, pairs in own:
                for suffix, n in pairs:
                    counts[suffix] += n
            yield from grown(language, depth, counts)

    grouped = dealt.repartition("group", "depth", "lang").sortWithinPartitions("group", "depth", "lang")
    nodes = grouped.mapInArrow(run, "lang string, phrase string, n long")
    counts = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return counts.filter(F.col("a") >= least)


# --- scores -------------------------------------------------------------------------------------------------------


def _exact(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the lowest-scoring cut of each phrase, of equal ones the first.

    The score, floor(1000 a n / (l r)), is computed in decimals of 38 digits, which hold the products exactly.
    """
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), size.alias("size"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substring_index(phrase, ' ', k - size)")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.withColumnsRenamed({"part": side, "f": name}), ["lang", side])
    cuts = cuts.join(totals, "lang")
    top = F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n")
    cuts = cuts.withColumn("top", top).withColumn("bottom", _exact("l") * _exact("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def longer_counts(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase that holds it."""
    split = phrases.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2)
    spans = F.expr(
        "flatten(transform(sequence(2, size(words) - 1),"
        " k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))"
    )
    inside = split.select("lang", F.explode(spans).alias("phrase"), "a")
    return inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def phrases(
    docs: DataFrame,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    budget: int = BUDGET,
    filtered: int = FILTERED,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, best first.

    A NULL language is ``und``; a NULL or empty text has no words; repeated rows count each. Phrases inside a longer
    one with ``share`` percent of their count or more are left out. Equal scores go by count, then by phrase, so the
    ranks are the same on every run. Only the columns of text and language are read. No documents, no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    counted = written(word_counts(texts), "phrase-words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter(F.col("n") >= least)
    maps, heavy, suffixes = filters_of(texts, words, least, budget, filtered)
    dealt = blocks(texts, maps, heavy, max(1, -(-suffixes // budget)))
    found = written(node_counts(dealt, least), "phrase-counts")
    kept = scored(found, words, totals).join(longer_counts(found), ["lang", "phrase"], "left")
    kept = kept.filter(~F.coalesce(100 * _exact("longer") >= share * _exact("a"), F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
