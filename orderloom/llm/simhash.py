"""Near-duplicate documents by 64-bit SimHash fingerprints.

Fingerprints that differ in at most ``RADIUS`` bits are linked and groups are the connected components of the
links. Two such fingerprints agree in two of six bit blocks at least, so the fifteen pairs of blocks deal them
out into cells and every link lies inside some cell. In a cell a hierarchical index over Gray-ordered
fingerprints finds the links: each node holds the bits that all fingerprints below it share, a search adds up
the differences in the bits that a node fixes beyond its parent, and leaves whole groups out once the sum is
too large. A group that lies within the radius whatever its open bits are is taken as a whole, and one whose
members already belong to the searcher's component is not visited: links are never written out as all pairs.

A cell of more than ``CELL`` fingerprints is cut into k parts by hash and each pair of parts is searched in a
task of its own; all its links are found that way too. Copies of a text, and texts with one fingerprint, are one
row before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import as_bytes, unused, written
from orderloom.llm.graphs import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CELL = 4096
FAN = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """SimHash of the text's four-word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    starts, ends = starts[:n], ends[SHINGLE - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        cut = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cut], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Distinct codes in Gray order under a tree of the bits they share; ``labels`` holds their components."""

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes.astype(np.uint64))
        self.codes = codes[np.argsort(gray_rank(codes))]
        self.labels = np.arange(len(self.codes))
        ones, zeros = self.codes, ~self.codes
        levels = [(ones, zeros)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            levels.append((ones, zeros))
        self.levels = []  # from the leaves up: pattern, bits fixed beyond the parent, number of open bits
        for depth, (ones, zeros) in enumerate(levels):
            fixed = ones | zeros
            above = np.uint64(0)
            if depth + 1 < len(levels):
                upper = levels[depth + 1][0] | levels[depth + 1][1]
                above = upper[np.arange(len(ones)) // FAN]
            self.levels.append((ones, fixed & ~above, 64 - np.bitwise_count(fixed).astype(np.int64)))

    def _uniform(self) -> list[np.ndarray]:
        """Per level and node the component of all codes below it, or -1."""
        low = high = self.labels
        out = [self.labels]
        for _ in self.levels[1:]:
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            x, y = labels[a], labels[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]

    def link(self, radius: int, batch: int = 256) -> None:
        """Put codes that differ in at most ``radius`` bits into one component."""
        top = len(self.levels) - 1
        for first in range(0, len(self.codes), batch):
            query = np.arange(first, min(first + batch, len(self.codes)))
            uniform = self._uniform()
            pattern, fixed, _ = self.levels[top]
            node = np.zeros(len(query), np.int64)
            sums = np.bitwise_count((self.codes[query] ^ pattern[node]) & fixed[node]).astype(np.int64)
            found_a, found_b = [], []
            for depth in range(top, -1, -1):
                open_bits = self.levels[depth][2]
                near = sums <= radius
                query, node, sums = query[near], node[near], sums[near]
                other = uniform[depth][node] != self.labels[query]
                query, node, sums = query[other], node[other], sums[other]
                whole = sums + open_bits[node] <= radius
                if whole.any():  # all codes below are in reach, and then of each other too
                    width = FAN**depth
                    for step in range(width):
                        below = node[whole] * width + step
                        real = below < len(self.codes)
                        found_a.append(query[whole][real])
                        found_b.append(below[real])
                    query, node, sums = query[~whole], node[~whole], sums[~whole]
                if depth == 0 or not len(query):
                    break
                pattern, fixed, _ = self.levels[depth - 1]
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, sums = np.repeat(query, FAN), np.repeat(sums, FAN)
                real = child < len(pattern)
                query, node, sums = query[real], child[real], sums[real]
                sums = sums + np.bitwise_count((self.codes[query] ^ pattern[node]) & fixed[node])
            if found_a:
                self._unite(np.concatenate(found_a), np.concatenate(found_b))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from every code to one code of its component, without the loops."""
        away = self.labels != np.arange(len(self.codes))
        return self.codes[away], self.codes[self.labels[away]]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, code): the fingerprint as a signed long, and a hash of the text that tells rows apart."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    schema = T.StructType([*slim.schema.fields[:2], T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64)
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(codes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "code"])

    return slim.mapInArrow(run, schema)


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, low, high, code), sorted: a search in each run of equal (cell, low, high)."""

    def search(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(codes) == 2:
            near = int(np.bitwise_count(codes[0] ^ codes[1]) <= RADIUS)
            return codes[:near], codes[1 : 1 + near]
        index = GrayIndex(codes)
        index.link(RADIUS)
        return index.stars()

    left_key, left = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "low", "high")])
        codes = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(codes)]
        found = []
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(keys[:, a].tolist())
            if key == left_key:
                left = np.concatenate([left, codes[a:b]])
                continue
            if len(left) > 1:
                found.append(search(left))
            left_key, left = key, codes[a:b]
        left = left.copy()
        if found:
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    if len(left) > 1:
        a, b = search(left)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(codes: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the codes within ``RADIUS`` bits; codes (code) are distinct."""
    cells = []
    for n, ((i, wide_i), (j, wide_j)) in enumerate(combinations(BLOCKS, 2)):
        low = F.shiftrightunsigned("code", i).bitwiseAND(F.lit((1 << wide_i) - 1))
        high = F.shiftrightunsigned("code", j).bitwiseAND(F.lit((1 << wide_j) - 1))
        cells.append(F.lit(n << 22).bitwiseOR(low).bitwiseOR(F.shiftleft(high, wide_i)).cast("long"))
    rows = codes.select("code", F.explode(F.array(*cells)).alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    dealt = (
        rows.join(sizes, "cell")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "code")
    )
    dealt = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return dealt.mapInArrow(_search_cells, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, fingerprint, component_id, component) for every row; component names it if no id does.

    component_id is the smallest doc_id in the row's component (NULL if none has one). A NULL or wordless text
    has fingerprint zero and is linked like any other; repeated rows are rows of one component. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    first = rows.groupBy("code").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(first.select("code")))
    placed = first.join(roots.withColumnRenamed("node", "code"), "code", "left")
    placed = placed.select("code", F.coalesce("root", "code").alias("root"), "first_id")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.select("code", "root").join(smallest, "root")
    out = rows.join(named, "code")
    hexed = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return out.select(
        "doc_id", "digest", hexed.alias("fingerprint"), "component_id", F.col("root").alias("component")
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest id (NULL last); of equal rows one.

    All columns are kept. The texts move once, to be matched with the chosen ids.
    """
    groups = near_duplicates(docs, text, doc_id)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    chosen = groups.groupBy("component").agg(F.min(order).alias("first"))
    first_id, first_digest, digest = unused(docs, "_id", "_digest", "_row_digest")
    chosen = chosen.select(F.col("first.doc_id").alias(first_id), F.col("first.digest").alias(first_digest))
    marked = docs.withColumn(digest, F.xxhash64(F.col(text)))
    kept = marked.join(chosen, F.col(doc_id).eqNullSafe(F.col(first_id)) & (F.col(digest) == F.col(first_digest)), "left_semi")
    return kept.dropDuplicates([doc_id, digest]).select(*docs.columns)

