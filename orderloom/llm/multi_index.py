"""Nearest vectors by multi-index hashing over learned binary codes.

Codes: vectors are centred, rotated by several orthogonal maps that are learned so that the signs lose least
(iterative quantisation on a bounded sample), and each sign is a bit. The code is split into substrings, each
with an index of its own from value to rows. Codes that differ in r bits or less agree with the query up to
floor(r / m) bits in one of m substrings, and up to one bit less unless it is one of the first r mod m + 1; so
probing the values within these small radii meets every code within r. Those found are checked on the whole code
and reranked by their exact distance.

The radius is learned on the sample as well: it covers the neighbours that sample queries have within the sample,
which lie further off than those in the whole table. A query that finds fewer than k rows within it is answered by
an exact pass.

Every row is indexed. Rows and queries are dealt out by hash to blocks of bounded size, each pair of a row block
and a query block is one group, and a group returns the best k of each of its queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import unit_hash, written

SAMPLE = 4096
SAMPLE_QUERIES = 256
ROTATIONS = 4
SUBSTRING = 16
COVER = 0.99
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
MEMBERS = "vec_id long, vector array<double>"
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Codes:
    """The learned maps, as matrices, and the radius."""

    mean: np.ndarray
    maps: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = ((x - self.mean) @ self.maps) > 0
        return np.packbits(bits, axis=1).view("<u2")


def _rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(x @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(x.T @ signs)
        turn = left @ right
    return turn


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every code of a against every one of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, from differences of components, so that equal vectors have distance 0 exactly."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def learn(x: np.ndarray, k: int, seed: int = 5) -> Codes:
    """Maps and radius from a sample of vectors."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    maps, width = [], 0
    while len(maps) < ROTATIONS or width % SUBSTRING:
        maps.append(_rotation(x - mean, rng))
        width += dim
    codes = Codes(mean, np.concatenate(maps, axis=1), width)
    own, all_ = codes.of(x[:SAMPLE_QUERIES]), codes.of(x)
    bits = differences(own, all_)
    needed = []
    for i in range(len(own)):
        near = distances(x[i], x)
        near[i] = np.inf
        needed.append(bits[i, np.argsort(near, kind="stable")[: min(k, len(x) - 1)]])
    needed = np.concatenate(needed) if len(x) > 1 else np.zeros(1)
    codes.radius = int(np.quantile(needed, COVER, method="higher"))
    return codes


class SubstringIndex:
    """For each substring its values in order, and the rows that have each value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for i in range(codes.shape[1]):
            order = np.argsort(codes[:, i], kind="stable")
            values, first = np.unique(codes[order, i], return_index=True)
            self.tables.append((order, values, np.append(first, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ in at most radius bits."""
        m = len(self.tables)
        least, spare = divmod(radius, m)
        met = np.zeros(len(self.codes), bool)
        for i, (order, values, first) in enumerate(self.tables):
            reach = least if i <= spare else least - 1
            if reach < 0:
                continue
            probed = np.bitwise_count(values ^ code[i]) <= reach
            if probed.all():
                met[:] = True
                break
            spread = np.repeat(probed, np.diff(first))
            met[order[spread]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def _best(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[ids[rows] != own]
    far = distances(q, x[rows])
    if len(rows) > k:  # ties at the k-th distance stay in until ids decide
        rows, far = (a[far <= np.partition(far, k - 1)[k - 1]] for a in (rows, far))
    order = np.lexsort((ids[rows], far))[:k]
    return ids[rows][order], far[order]


def _search_block(codes: Codes | None, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Without codes every row is compared."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy())
            index = SubstringIndex(codes.of(x)) if codes else None
            q = np.stack(queries["vector"].to_numpy())
            q_codes = codes.of(q) if codes else None
            for i, own in enumerate(queries["vec_id"].to_numpy()):
                near = index.within(q_codes[i], codes.radius) if codes else np.arange(len(ids))
                got, far = _best(q[i], own, ids, x, near, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": got, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    return run


def _searched(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, codes: Codes | None, k: int) -> DataFrame:
    """The best k of each query in each block of rows, and of those the best k."""
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("rb", own(row_blocks, "rows")).withColumn("qb", all_blocks(query_blocks))
    right = queries.withColumn("qb", own(query_blocks, "queries")).withColumn("rb", all_blocks(row_blocks))
    found = (
        left.groupBy("rb", "qb")
        .cogroup(right.groupBy("rb", "qb"))
        .applyInPandas(_search_block(codes, k), FOUND)
    )
    # At most k rows a query and block; min-by-rank keeps ties in id order.
    ranked = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")
    )
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) as doubles, without vectors that are NULL or zero or hold NULLs or non-finite components."""
    slim = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("vector", lambda v: v != 0)
    return slim.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(nonzero, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector the k nearest found among the other ids.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. Only vectors of the length
    that is most common among the rows take part. Rows that are equal count once; of query rows with one id the
    vector that sorts first is asked. Empty tables give an empty result. Extra columns are not read.
    """
    rows = written(usable(vectors, vec_id, vector).distinct(), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == lengths["n"])
    asked = usable(queries, vec_id, vector).filter(F.size("vector") == lengths["n"])
    asked = written(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n_rows, n_queries = lengths["count"], asked.count()
    cut = int(min(1.0, SAMPLE / n_rows) * ((1 << 62) - 1))
    drawn = rows.filter(unit_hash(F.col("vec_id"), F.lit("sample")) <= cut).limit(2 * SAMPLE).collect()
    drawn = sorted({tuple(r["vector"]) for r in drawn})  # equal vectors teach nothing more
    sample = np.random.default_rng(3).permutation(np.array(drawn)) if drawn else None
    codes = learn(sample, k) if sample is not None and len(sample) > k else None
    found = _searched(rows, asked, n_rows, n_queries, codes, k)
    if codes is None:
        return found
    found = written(found, "neighbours")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.join(full, "vec_id", "left_anti"), "unanswered")
    n_short = short.count()
    if not n_short:
        return found
    exact = _searched(rows, short, n_rows, n_short, None, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
