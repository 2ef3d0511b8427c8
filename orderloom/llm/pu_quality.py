"""Quality of texts, learned from trusted positives and unlabelled text alone.

A small network is trained on the non-negative unbiased risk of positive-unlabelled learning:
``prior * loss+(P) + max(0, loss-(U) - prior * loss-(P))`` with the logistic loss. The class prior comes from the
same two samples: a plain classifier of P against U, trained on one half, orders the rows of the other half, and among
the top shares the least ratio of U's share to P's share bounds the prior, since hardly any negative is left there.

Features are counts over a text's bytes and words, so a text of any length is read whole and costs one pass.
``SAMPLE`` bounds the rows that either sample sends to the driver, which reads them one after the other into one array
and trains on that array in place; scoring reads every row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import as_bytes, crc_mod, give_back, unit_hash, unused

SAMPLE = 8192
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
HIDDEN = 24
EPOCHS, PLAIN_EPOCHS = 40, 8
PAIRS = 256
WIDTH = 256 + PAIRS + 13
COLUMNS = 64


def features(text: bytes) -> np.ndarray:
    """Roots of the shares of bytes and of hashed byte pairs, and a few ratios over words and lines."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    if len(data) > 1:
        pairs = data[:-1].astype(np.uint32) * np.uint32(40503) + data[1:].astype(np.uint32) * np.uint32(30011)
        pairs = np.bincount((pairs >> np.uint32(7)) % np.uint32(PAIRS), minlength=PAIRS)
        out[256 : 256 + PAIRS] = np.sqrt(pairs / (len(data) - 1))
    words, lines = text.split(), text.split(b"\n")
    upper, digit = counts[65:91].sum(), counts[48:58].sum()
    lower, high = counts[97:123].sum(), counts[128:].sum()
    space = counts[9:14].sum() + counts[32]
    mark = len(data) - upper - digit - lower - high - space
    n = max(len(words), 1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    out[256 + PAIRS :] = (
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 10,
        len(data) / n / 20,
        upper / len(data),
        digit / len(data),
        lower / len(data),
        high / len(data),
        np.sqrt(mark / len(data)),
        len(set(words)) / n,
        np.sqrt(again / n),
        np.sqrt(words.count(b"|") / n),
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 10,
    )
    return out


class Network:
    """One hidden layer; plain arrays, so that it goes along with the tasks."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.weights = [
            rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        ]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(np.clip((x - self.mean) / self.scale, -8, 8))

    def margin_of(self, z: np.ndarray) -> np.ndarray:
        """The same of rows that are standardised already."""
        w, b, v, c = self.weights
        return np.tanh(z @ w + b) @ v + c

    def train(self, z: np.ndarray, pull: np.ndarray | None, positive: np.ndarray, prior: float, seed: int, epochs: int) -> None:
        """Adam over mini-batches of standardised rows. pull: fixed targets of a plain classifier; None for the risk named above."""
        rng, moments, step = np.random.default_rng(seed), [(np.zeros_like(p), np.zeros_like(p)) for p in self.weights], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 1024)):
                w, b, v, c = self.weights
                hidden = np.tanh(z[rows] @ w + b)
                out = 1 / (1 + np.exp(-np.clip(hidden @ v + c, -30, 30)))
                p = positive[rows]
                if not p.any() or p.all():
                    continue
                if pull is not None:
                    slope = np.where(p, (out - pull[rows]) / p.sum(), (out - pull[rows]) / (~p).sum())
                else:
                    minus = -np.log(np.maximum(1 - out, 1e-12))
                    excess = minus[~p].mean() - prior * minus[p].mean()
                    if excess >= 0:
                        slope = np.where(p, prior * ((out - 1) - out) / p.sum(), out / (~p).sum())
                    else:  # the negatives' risk was estimated below zero: climb back out of that
                        slope = np.where(p, prior * out / p.sum(), -out / (~p).sum())
                slope = slope.astype(np.float32)
                back = np.outer(slope, v) * (1 - hidden**2)
                grads = [z[rows].T @ back, back.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    g = g + 1e-4 * self.weights[i]
                    m, s = moments[i]
                    m[:], s[:] = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                    rate = 0.01 if epoch < epochs // 2 else 0.002
                    self.weights[i] = self.weights[i] - rate * (m / (1 - 0.9**step)) / (
                        np.sqrt(s / (1 - 0.999**step)) + 1e-8
                    )

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def class_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the shares of U and P above a cut, over cuts that keep half of P or more."""
    cuts = np.quantile(positives, np.linspace(0.02, 0.5, 25))
    ratios = [(unlabelled >= c).mean() / max((positives >= c).mean(), 1e-9) for c in np.unique(cuts)]
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit(x: np.ndarray, positive: np.ndarray, seed: int = 11, in_place: bool = False) -> Network | None:
    """x: rows of either sample; positive: which of them are trusted. None without both.

    With in_place the rows, of 32-bit floats, are overwritten by their standardised form, which saves a copy of them.
    """
    if not positive.any() or positive.all():
        return None
    # Some columns at a time: a deviation takes a copy of what it is of.
    spread = [x[:, at : at + COLUMNS].std(0) for at in range(0, x.shape[1], COLUMNS)]
    mean, scale = x.mean(0), np.maximum(np.concatenate(spread), 1e-3)
    z = np.subtract(x, mean, out=x if in_place else None)
    z /= scale
    z = np.clip(z, -8, 8, out=z).astype(np.float32, copy=False)
    network = Network(mean, scale, seed + 1)
    network.train(z, None, positive, estimated_prior(z, positive, mean, scale, seed), seed + 1, EPOCHS)
    return network


def estimated_prior(z: np.ndarray, positive: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> float:
    half = np.random.default_rng(seed).random(len(z)) < 0.5
    found = []
    for own in (half, ~half):
        p = positive[~own]
        if positive[own].any() and not positive[own].all() and p.any() and not p.all():
            plain = Network(mean, scale, seed)
            plain.train(z[own], positive[own].astype(np.float32), positive[own], 0.5, seed, PLAIN_EPOCHS)
            margin = plain.margin_of(z[~own])
            found.append(class_prior(margin[p], margin[~p]))
    return float(np.mean(found)) if found else 0.5


def _featured(rows: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns and ``x``, the features of column ``text`` as packed floats."""
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A model from the training folds: trusted positives are labels of quality 1, unlabelled is every document.

    Which rows are drawn depends on a hash of their id alone. Without positives or documents there is no model.
    """
    slim = docs.select(F.col("doc_id"), F.col("text")).filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    trusted = labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    trusted = trusted.select("doc_id").distinct()
    n_trusted, n_docs = trusted.count(), slim.select("doc_id").count()
    if not n_trusted or not n_docs:
        return None
    spread, top = unit_hash(F.col("doc_id"), F.lit("sample")), (1 << 62) - 1
    cut_p, cut_u = (int(min(1.0, sample / n) * top) for n in (n_trusted, n_docs))
    drawn = slim.filter(spread <= max(cut_p, cut_u))
    drawn = drawn.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").select(
        "text",
        F.coalesce(F.col("trusted") & (spread <= cut_p), F.lit(False)).alias("p"),
        (spread <= cut_u).alias("u"),
    )
    # Twice the bound is far above what the cuts let through, and holds whatever ids repeat.
    rows = _featured(drawn.filter("p or u").limit(4 * sample), ["p", "u"])
    network = _fit_rows((r.x, r.p, r.u) for r in rows.toLocalIterator())
    give_back()
    return network


def _fit_rows(rows: Iterable[tuple[bytes, bool, bool]]) -> Network | None:
    """A model from rows (packed features, trusted, unlabelled), of which one is held at a time beside the array they go to."""
    both, unlabelled = bytearray(), bytearray()
    for x, p, u in rows:
        if p:
            both += x
        if u:
            unlabelled += x
    n = len(both) // (4 * WIDTH)
    both += unlabelled
    del unlabelled
    if not both:
        return None
    x = np.frombuffer(both, np.float32).reshape(-1, WIDTH)
    return fit(x, np.arange(len(x)) < n, in_place=True)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of the documents and ``score``; 0.5 throughout without a model.

    A NULL text is scored like an empty one. The id and all other columns take no part. A column of the input
    that is called score is replaced.
    """
    if network is None:
        return docs.withColumn("score", F.lit(0.5))
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in as_bytes(batch.column("text"))]
            scores = network.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with their columns as they were; all of them if there is no model."""
    network = train(docs, labels)
    if network is None:
        return docs
    (own,) = unused(docs, "_own_score")
    scored = score(docs.withColumnRenamed("score", own), network)
    kept = scored.filter(F.col("score") >= THRESHOLD).drop("score").withColumnRenamed(own, "score")
    return kept.select(*docs.columns)
