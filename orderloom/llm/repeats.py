"""Byte strings of ``MATCH`` bytes that occur more than once in a corpus, by suffix order within anchor groups.

Every window of MATCH bytes is assigned to its anchor, the gram of ``GRAM`` bytes in it whose hash is least (the
first of equal ones). The anchor follows from the window's bytes alone, so equal windows have equal anchors at
equal places and a group of equal anchor grams holds all copies of its windows; nothing else has to be compared.
Windows with one anchor lie next to each other: a segment is the run of them with the bytes that they cover.

Groups of one segment content are settled by counting. Where a group has several contents, one of each is put
into a suffix array of the group's window starts, ordered by MATCH bytes and then by position. In that order the
previous smaller position with a common prefix of MATCH bytes or more is the neighbour before, and the next
larger one is the neighbour behind: a longest previous factor of MATCH or more is an earlier match, a longest next
factor of MATCH or more a later one. Bytes covered by a window with either are repeated.

A group of more than ``GROUP`` contents is not put into one task: its windows are dealt out by their hash and
each part finds the equal ones among them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import KEY, as_bytes, text_key, written

MATCH, GRAM = 400, 50
SPREAD = MATCH - GRAM + 1
GROUP = 2000
PART_WINDOWS = 1_000_000
SUFFIX_BYTES = 2 << 20
CHUNK = 4 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(1 << 40, 1 << 62)) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = _powers.__dict__
    if len(cache.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            cache[name] = np.cumprod(steps)
    return cache["up"][:n], cache["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a text, from sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def sliding(self, size: int, first: int, count: int) -> np.ndarray:
        """Of the substrings of one size that start at first and the places after it."""
        sums = self.sums[first + size : first + size + count] - self.sums[first : first + count]
        return _mixed(sums * self.down[first : first + count])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values: of the rest of one block and the beginning of the next."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash of the anchor gram, hash of the segment) of a text's segments."""
    windows = len(data) - MATCH + 1
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = Hashes(data)
    anchors = []
    low = np.uint64((1 << 24) - 1)
    for first in range(0, windows, CHUNK):
        count = min(CHUNK, windows - first)
        grams = hashes.sliding(GRAM, first, count + SPREAD - 1)
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        anchors.append((_sliding_least(packed, SPREAD) & low).astype(np.int64) + first)
    anchors = np.concatenate(anchors)
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    last = np.concatenate([first[1:], [windows]]) - 1
    anchor = anchors[first]
    gram = hashes.of(anchor, anchor + GRAM)
    shape = ((anchor - first) * 65536 + (last - first)).astype(np.uint64)
    content = _mixed(hashes.of(first, last + MATCH) + shape * _MIX)
    return first, last, anchor, gram.view(np.int64), content.view(np.int64)


def suffix_groups(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the starts: another one further left has the same MATCH bytes, another one further right has.

    Ranks of prefixes are doubled up to the largest power of two below MATCH; two such prefixes that overlap
    order the suffixes by MATCH bytes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    size, rank = 8, np.unique(key, return_inverse=True)[1].astype(np.int64)

    def both(step: int, at: np.ndarray) -> np.ndarray:
        second = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        return rank[at] * (n + 2) + second

    everywhere = np.arange(n)
    while size * 2 < MATCH:
        rank = np.unique(both(size, everywhere), return_inverse=True)[1].astype(np.int64)
        size *= 2
    key = both(MATCH - size, starts)
    order = np.lexsort((starts, key))  # the suffix array of the starts
    same = key[order][1:] == key[order][:-1]  # the common prefix with the one before has MATCH bytes
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


_SEGMENT = "first long, last long, anchor long, gram long, content long"
_RANGES = "gram long, content long, from_window long, to_window long"


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "first", "last", "anchor", "gram", "content"]
    for batch in batches:
        found, rows = [], []
        for i, text in enumerate(as_bytes(batch.column("text"))):
            if len(text) >= MATCH:
                own = segments(np.frombuffer(text, np.uint8))
                found.append(own)
                rows.append(np.full(len(own[0]), i))
        if found:
            rows = pa.array(np.concatenate(rows))
            keys = [batch.column(c).take(rows) for c in KEY]
            own = [pa.array(np.concatenate(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*keys, *own], names)


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, wanted in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                out.append((w["gram"], w["content"], text[w["first"] : w["last"] + MATCH]))
        if out:
            grams, contents, cut = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), pa.array(contents, pa.int64()), pa.array(cut, pa.binary())],
                ["gram", "content", "bytes"],
            )


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(columns, ["gram", "content", "from_window", "to_window"])


def _order_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, content, bytes), equal grams together: which windows have an equal one in the same group."""

    def solve(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        sizes = np.array([len(r[2]) for r in rows])
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - s, e - MATCH + 1) for s, e in zip(sizes, ends)])
        earlier, later = suffix_groups(data, starts)
        repeated, at, out = earlier | later, 0, []
        for (gram, content, _), size in zip(rows, sizes.tolist()):
            count = size - MATCH + 1
            for a, b in zip(*_runs(repeated[at : at + count])):
                out.append((gram, content, int(a), int(b)))
            at += count
        return out

    held, group, weight = [], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][0] != row[0]:
                held += group
                weight, group = weight + sum(len(r[2]) for r in group), []
                if weight >= SUFFIX_BYTES:
                    if out := solve(held):
                        yield _range_batch(out)
                    held, weight = [], 0
            group.append(row)
    held += group
    if held and (out := solve(held)):
        yield _range_batch(out)


def _deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, content, bytes, before_anchor, parts): the window hashes of a segment, by part."""
    for batch in batches:
        out = []
        for gram, content, cut, ahead, parts in zip(*(c.to_pylist() for c in batch.columns)):
            count = len(cut) - MATCH + 1
            hashes = Hashes(np.frombuffer(cut, np.uint8)).sliding(MATCH, 0, count)
            # A window's place against its anchor is part of what must agree.
            hashes = _mixed(hashes + (np.arange(count) - ahead).astype(np.uint64) * _MIX)
            of = (hashes % np.uint64(parts)).astype(np.int64)
            for part in np.unique(of).tolist():
                own = np.flatnonzero(of == part)
                out.append((gram, content, part, own.tolist(), hashes[own].view(np.int64).tolist()))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "content", "part", "windows", "hashes"])


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _deal_windows, equal (gram, part) together: which windows have an equal one."""

    def solve(rows: list[tuple]) -> list[tuple]:
        hashes = np.concatenate([np.array(r[4], np.int64) for r in rows])
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated, at, out = counts[inverse] > 1, 0, []
        for gram, content, _, windows, _ in rows:
            found = np.array(windows)[repeated[at : at + len(windows)]]
            at += len(windows)
            if len(found):
                cuts = np.flatnonzero(np.diff(found) != 1) + 1
                for run in np.split(found, cuts):
                    out.append((gram, content, int(run[0]), int(run[-1])))
        return out

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and (group[0][0], group[0][2]) != (row[0], row[2]):
                if out := solve(group):
                    yield _range_batch(out)
                group = []
            group.append(row)
    if group and (out := solve(group)):
        yield _range_batch(out)


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, starts, ends): of each text the byte ranges covered by repeated windows, not yet merged.

    A text is known by the hash of its content, so equal texts have one row; texts without repeats have none.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", *text_key(F.col("text")))
    schema = T.StructType([*(texts.schema[c] for c in KEY), *T._parse_datatype_string(_SEGMENT).fields])
    found = written(texts.select(*KEY, "text").mapInArrow(_find_segments, schema), "segments")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
    several = grams.filter("n > 1").select("gram", (F.col("a") != F.col("b")).alias("several"))
    shared = written(found.join(several, "gram"), "shared-segments")

    mixed = shared.filter("several")
    one = F.min(F.struct(*KEY, "first", "last", "anchor")).alias("one")
    contents = written(mixed.groupBy("gram", "content").agg(F.count("*").alias("n"), one), "contents")
    sizes = contents.groupBy("gram").agg(F.count("*").alias("contents"))
    reps = contents.join(sizes, "gram").select("gram", "content", "contents", "one.*")
    reps = written(reps, "representatives")
    wanted = reps.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "content", "first", "last")).alias("wanted"))
    cut = texts.join(wanted, list(KEY)).select("text", "wanted")
    cut = cut.mapInArrow(_cut_segments, "gram long, content long, bytes binary").dropDuplicates(["gram", "content"])
    about = reps.select("gram", "content", "contents", (F.col("anchor") - F.col("first")).alias("ahead"))
    cut = written(cut.join(about, ["gram", "content"]), "segment-bytes")

    usual = cut.filter(F.col("contents") <= GROUP).select("gram", "content", "bytes")
    usual = usual.repartition("gram").sortWithinPartitions("gram").mapInArrow(_order_suffixes, _RANGES)
    parts = F.ceil(F.col("contents") * SPREAD / PART_WINDOWS).alias("parts")
    large = cut.filter(F.col("contents") > GROUP).select("gram", "content", "bytes", "ahead", parts)
    large = large.mapInArrow(
        _deal_windows, "gram long, content long, part long, windows array<long>, hashes array<long>"
    )
    large = large.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_equal_windows, _RANGES)
    copied = contents.filter("n > 1").select(
        "gram", "content", F.lit(0).cast("long").alias("from_window"), (F.col("one.last") - F.col("one.first")).alias("to_window")
    )
    ranges = reduce(DataFrame.unionByName, (usual, large, copied))
    partly = mixed.join(ranges, ["gram", "content"]).select(
        *KEY, (F.col("first") + F.col("from_window")).alias("start"), (F.col("first") + F.col("to_window") + MATCH).alias("end")
    )
    whole = shared.filter("NOT several").select(*KEY, F.col("first").alias("start"), (F.col("last") + MATCH).alias("end"))
    return (
        partly.unionByName(whole)
        .distinct()
        .groupBy(*KEY)
        .agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that meet or overlap as one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([new[1:], [True]])]


_KEPT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every row without its repeated bytes.

    ``kept`` are the remaining bytes, left out without with_bytes; they need not be valid UTF-8, since matches are
    bytes. A NULL text is empty; a text shorter than MATCH bytes loses nothing; repeated rows are copies of each
    other and lose all they have from MATCH bytes on; other columns are not read; an empty table gives an empty
    result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.select("doc_id", "text", *text_key(F.col("text")))
    joined = slim.join(repeated_spans(docs, text), list(KEY), "left")
    schema = T.StructType([joined.schema["doc_id"], *T._parse_datatype_string(_KEPT).fields])
    if not with_bytes:
        schema = T.StructType(schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
            for content, (starts, ends) in zip(as_bytes(batch.column("text")), spans):
                kept, n = content, 0
                if starts:
                    first, last = merged(np.array(starts), np.array(ends))
                    cuts = zip([0, *last.tolist()], [*first.tolist(), len(content)])
                    kept, n = b"".join(content[a:b] for a, b in cuts), len(first)
                row = (len(content), len(content) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept)
                out.append(row if with_bytes else row[:-1])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema.names)

    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(run, schema)
