"""Katz backoff scores of texts: Good-Turing discounted word pairs that back off to discounted words.

P(w | v) = d(c(vw)) c(vw) / (c(v) + 1) for a pair seen in training, else alpha(v) P(w), where
alpha(v) = (1 - sum of the seen P(. | v)) / (1 - sum of P(.) over the same words), and 1 for a v that was not
seen. P(w) = d(c(w)) c(w) / (N + 1) for a known word; what is left of 1 is the probability of the unknown word. One
event is added to each total, so that something is left over even where every count is too large for a discount.

Only counts that some text needs have to meet some text, so tokens never travel one by one. The texts become chunks
of bounded size, a sorted table of word keys and the tokens as numbers in it, stored in the shared folder. A chunk
asks for its words and its pairs by key; keys are dealt out to parts by range, a part adds up what all chunks
counted and answers each chunk in the order of its question. So pairs are counted within a chunk before they are
shuffled, frequent words weigh no more than others, and a part or chunk that is lost is made anew from tables.
Three rounds: counts of words and pairs; sums over the seen pairs of each context, which makes alpha; the scores.

Keys are 56 bits of XXH64, of words or of two words' keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import as_bytes, crc_mod, lengths_to_offsets, stretches, written

FOLDS, HELD_OUT = 10, 0
CHUNK = 3_000_000  # tokens
SLICE = 4 << 20  # bytes of a text that are split into words at a time
DEEPEST = 5  # counts up to this are discounted
KEY_BITS = 56
WORDS, PAIRS = 0, 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - KEY_BITS)


# No word is empty or has a space in it.
START, END = word_key(b" start"), word_key(b"")


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * _MIX) ^ (second << np.uint64(7)) ^ (second >> np.uint64(50))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h >> np.uint64(64 - KEY_BITS)


# --- packed arrays ----------------------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of one weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def restore(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def restore_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(restore(packed, "<u8"), dtype=np.uint64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range begins in ascending keys, and their end."""
    bounds = np.array([-(-(p << KEY_BITS) // parts) for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


# --- chunks -----------------------------------------------------------------------------------------------

_CHUNK = "chunk long, rows array<long>, train binary, sizes binary, words binary, tokens binary"


def _word_keys(text: bytes) -> Iterator[np.ndarray]:
    """Keys of the words of a text, a bounded stretch at a time."""
    for part in stretches(text, SLICE):
        words = part.lower().split()
        if words:
            yield np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - KEY_BITS)


def _make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, train, text) to chunks; a piece is a run of tokens of one row with the one before it in front."""
    rows: list[int] = []
    train: list[bool] = []
    pieces: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        # END is asked for by every chunk, also by one that holds only the front of a text: its count is START's total.
        words, tokens = np.unique(np.concatenate([*pieces, np.array([END], np.uint64)]), return_inverse=True)
        tokens = tokens[:-1]
        columns = [
            pa.array([uuid.uuid4().int >> 65], pa.int64()),
            pa.array([rows], pa.list_(pa.int64())),
            *(
                pa.array([b], pa.binary())
                for b in (
                    squeeze(np.array(train, np.uint8)),
                    squeeze(np.array([len(p) for p in pieces], np.int64)),
                    squeeze_keys(words),
                    squeeze(tokens.astype(np.int32)),
                )
            ),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "rows", "train", "sizes", "words", "tokens"])

    for batch in batches:
        own = zip(batch.column("row").to_pylist(), batch.column("train").to_pylist(), as_bytes(batch.column("text")))
        for row, learned, text in own:
            before, end = START, np.array([END], np.uint64)
            stretches = _word_keys(text)
            now = next(stretches, None)
            while True:
                following = next(stretches, None) if now is not None else None
                parts = [np.array([before], np.uint64)] + ([now] if now is not None else [])
                if following is None:
                    parts.append(end)
                piece = np.concatenate(parts)
                rows.append(row)
                train.append(learned)
                pieces.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield flush()
                    rows, train, pieces, size = [], [], [], 0
                if following is None:
                    break
                before, now = piece[-1], following
    if pieces:
        yield flush()


class Chunk:
    """A stored chunk: word keys, tokens, and its distinct pairs in key order."""

    def __init__(self, row: dict):
        self.words = restore_keys(row["words"])
        self.tokens = restore(row["tokens"], "<i4")
        self.sizes = restore(row["sizes"], "<i8")
        self.train = restore(row["train"], "u1").astype(bool)
        offsets = lengths_to_offsets(self.sizes)
        second = np.ones(len(self.tokens), bool)
        second[offsets[:-1]] = False  # the token in front of a piece is no event of it
        self.events = np.flatnonzero(second)
        self.first, self.second = self.tokens[self.events - 1], self.tokens[self.events]
        self.event_offsets = lengths_to_offsets(self.sizes - 1)
        self.learned = np.repeat(self.train, self.sizes - 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, place of one event of each, number of each event's pair)."""
        keys = pair_keys(self.words[self.first], self.words[self.second])
        keys, number = np.unique(keys, return_inverse=True)
        place = np.zeros(len(keys), np.int64)
        place[number] = np.arange(len(number))
        return keys, place, number

    def per_piece(self, values: np.ndarray) -> np.ndarray:
        """Sums over the events of each piece, which has one at least."""
        return np.add.reduceat(values, self.event_offsets[:-1])


# --- rounds -----------------------------------------------------------------------------------------------

_ASKED = "kind int, part int, chunk long, keys binary, counts binary"
_STATS = DEEPEST + 3  # number, distinct, and how many have each of the counts 1 to DEEPEST + 1


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                words = np.bincount(chunk.second[chunk.learned], minlength=len(chunk.words))
                keys, _, number = chunk.pairs()
                pairs = np.bincount(number[chunk.learned], minlength=len(keys))
                out = []
                for kind, k, n in ((WORDS, chunk.words, words), (PAIRS, keys, pairs)):
                    cuts = _cuts(k, parts)
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            out.append((kind, part, row["chunk"], squeeze_keys(k[a:b]), squeeze(n[a:b].astype("<u4"))))
                yield _batch(out, _ASKED)

    return run


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_KINDS = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


_ANSWER = "kind int, part int, chunk long, counts binary, owned binary, stats array<long>"


def _answer(table: pa.Table) -> pa.Table:
    """All questions of one kind to one part: totals in the order of each, and whose pair a pair is to sum up."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    chunks = table["chunk"].to_pylist()
    keys = [restore_keys(k) for k in table["keys"].to_pylist()]
    counts = np.concatenate([restore(c, "<u4") for c in table["counts"].to_pylist()])
    offsets = lengths_to_offsets(np.array([len(k) for k in keys]))
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
    owner = np.zeros(len(distinct), np.int64)
    owner[number[::-1]] = np.arange(len(number))[::-1]  # the first that asks
    owned = np.zeros(len(number), np.uint8)
    owned[owner[totals > 0]] = 1
    seen = totals[totals > 0]
    stats = [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, DEEPEST + 2))]
    out = [
        (kind, part, chunk, squeeze(totals[number[a:b]]), squeeze(np.packbits(owned[a:b])) if kind == PAIRS else None, None)
        for chunk, a, b in zip(chunks, offsets, offsets[1:])
    ]
    out.append((kind, part, None, None, None, stats))
    return pa.Table.from_batches([_batch(out, _ANSWER)])


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0) to d(DEEPEST + 1) from n(1), n(2), ...; the last stands for all larger counts.

    Good-Turing with as many discounted counts as give factors above 0 and up to 1; where none do, as in very
    little text, half an event is taken off each count up to DEEPEST.
    """
    n = [0, *counts_of_counts]
    for deepest in range(DEEPEST, 0, -1):
        if all(n[r] for r in range(1, deepest + 2)):
            rest = (deepest + 1) * n[deepest + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest != 1 else 0 for r in range(1, deepest + 1)]
            if all(0 < x <= 1 for x in d):
                return np.array([1.0, *d] + [1.0] * (DEEPEST + 1 - deepest))
    return np.array([1.0, *(1 - 0.5 / r for r in range(1, DEEPEST + 1)), 1.0])


class Model:
    """The numbers that hold for the whole corpus."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.n, self.v = words[0], words[1]
        self.word_discount, self.pair_discount = discounts(words[2:]), discounts(pairs[2:])
        taken = sum(r * words[1 + r] * (1 - self.word_discount[r]) for r in range(1, DEEPEST + 1))
        self.unknown = 1 - (self.n - taken) / (self.n + 1)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        d = self.word_discount[np.minimum(counts, DEEPEST + 1)]
        return np.where(counts > 0, d * counts / (self.n + 1), self.unknown)

    def pair_mass(self, counts: np.ndarray) -> np.ndarray:
        return self.pair_discount[np.minimum(counts, DEEPEST + 1)] * counts


_HALF = (
    "part int, chunk long, keys binary, mass binary, words_mass binary, totals binary, rows array<long>, "
    "tokens array<long>, known array<long>, base array<double>, score array<double>, waiting binary, waits binary"
)


def _half_scores(model: Model, parts: int):
    """A chunk with its answers: scores but for the alphas, and the chunk's share of the contexts' sums."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return pa.Table.from_batches([], _arrow(_HALF))
        row = chunks.to_pylist()[0]
        chunk = Chunk(row)
        told = sorted(answers.to_pylist(), key=lambda a: (a["kind"], a["part"]))
        counts = np.concatenate([restore(a["counts"], "<i8") for a in told if a["kind"] == WORDS])
        keys, place, number = chunk.pairs()
        pairs = np.concatenate([restore(a["counts"], "<i8") for a in told if a["kind"] == PAIRS])
        owned = np.concatenate(
            [
                np.unpackbits(restore(a["owned"], "u1"))[: len(restore(a["counts"], "<i8"))]
                for a in told
                if a["kind"] == PAIRS
            ]
        ).astype(bool)
        words = model.word_probability(counts)
        totals = counts.copy()  # of a context: it is followed by something each time
        totals[chunk.words == START] = counts[np.searchsorted(chunk.words, END)]
        return _half(chunk, row, model, parts, counts, totals, words, place, number, pairs, owned)

    return run


def _half(chunk, row, model, parts, counts, totals, words, place, number, pairs, owned) -> pa.Table:
    event_count = counts[chunk.second]
    seen = pairs[number] > 0
    with np.errstate(divide="ignore"):
        of_pair = np.log10(model.pair_mass(pairs) / (totals[chunk.first[place]] + 1))[number]
    score = np.where(seen, of_pair, np.log10(words)[chunk.second])
    base = np.log10((event_count + 0.1) / (model.n + 0.1 * (model.v + 1)))
    waiting = ~seen & (totals[chunk.first] > 0)

    own = place[owned]  # one event of each pair that this chunk sums up
    first, second = chunk.first[own], chunk.second[own]
    mass = np.bincount(first, weights=model.pair_mass(pairs[owned]), minlength=len(chunk.words))
    words_mass = np.bincount(first, weights=words[second], minlength=len(chunk.words))
    involved = np.zeros(len(chunk.words), bool)
    involved[first] = True
    involved[chunk.first[waiting]] = True
    contexts = np.flatnonzero(involved)
    place_of = np.cumsum(involved) - 1

    rows = [row["rows"], (chunk.sizes - 1).tolist()]
    rows += [chunk.per_piece(v).tolist() for v in ((event_count > 0).astype(np.int64), base, score)]
    rows += [squeeze(place_of[chunk.first[waiting]].astype("<i4")), squeeze(chunk.per_piece(waiting.astype(np.int64)))]
    out = [(None, row["chunk"], None, None, None, None, *rows)]
    keys = chunk.words[contexts]
    cuts = _cuts(keys, parts)
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            c = contexts[a:b]
            sums = (squeeze_keys(keys[a:b]), squeeze(mass[c]), squeeze(words_mass[c]), squeeze(totals[c]))
            out.append((part, row["chunk"], *sums, *[None] * 7))
    return pa.Table.from_batches([_batch(out, _HALF)])


_ALPHAS = "part int, chunk long, alphas binary"


def _alphas(table: pa.Table) -> pa.Table:
    """log10 alpha of the contexts of a part, in the order in which each chunk asked."""
    keys = [restore_keys(k) for k in table["keys"].to_pylist()]
    offsets = lengths_to_offsets(np.array([len(k) for k in keys]))
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [
        np.bincount(number, weights=np.concatenate([restore(b, "<f8") for b in table[c].to_pylist()]), minlength=len(distinct))
        for c in ("mass", "words_mass")
    ]
    totals = np.zeros(len(distinct), np.int64)
    np.maximum.at(totals, number, np.concatenate([restore(b, "<i8") for b in table["totals"].to_pylist()]))
    alphas = np.log10((1 - sums[0] / (totals + 1)) / (1 - sums[1]))
    part, chunks = table["part"][0].as_py(), table["chunk"].to_pylist()
    out = [(part, c, squeeze(alphas[number[a:b]])) for c, a, b in zip(chunks, offsets, offsets[1:])]
    return pa.Table.from_batches([_batch(out, _ALPHAS)])


_SCORES = "row long, n_tokens long, n_known long, base_score double, score double"


def _whole_scores(halves: pa.Table, answers: pa.Table) -> pa.Table:
    if not halves.num_rows:
        return pa.Table.from_batches([], _arrow(_SCORES))
    row = halves.to_pylist()[0]
    told = sorted(answers.to_pylist(), key=lambda a: a["part"])
    alphas = np.concatenate([np.zeros(0), *(restore(a["alphas"], "<f8") for a in told)])
    waiting = alphas[restore(row["waiting"], "<i4")]
    upto = np.concatenate([[0.0], np.cumsum(waiting)])
    offsets = lengths_to_offsets(restore(row["waits"], "<i8"))
    score = np.array(row["score"]) + upto[offsets[1:]] - upto[offsets[:-1]]
    return pa.Table.from_batches([_batch(list(zip(row["rows"], row["tokens"], row["known"], row["base"], score.tolist())), _SCORES)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def _stats(answers: DataFrame, kind: int) -> list[int]:
    """Added up over the parts."""
    rows = answers.filter((F.col("kind") == kind) & F.col("stats").isNotNull())
    sums = rows.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(_STATS)]).first()
    return [int(s or 0) for s in sums]


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows that are not held out. A NULL text is empty and has its end alone; a row without an id is
    learned from; repeated rows count and are scored each; other columns are not read. An empty table gives an
    empty result, and one without training rows scores of an empty model: everything is unknown, at probability 1.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")
    )
    # Rows are told apart by a number that is fixed where the small table of them is written.
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, row long, " + _CHUNK).fields])
    made = written(slim.mapInArrow(_rows_and_chunks, schema), "chunks")
    rows = made.filter("chunk IS NULL").select("doc_id", "held_out", "row")
    chunks = made.filter("chunk IS NOT NULL").select("chunk", "rows", "train", "sizes", "words", "tokens")
    parts = max(1, chunks.select("chunk").count())

    asked = chunks.mapInArrow(_ask(parts), _ASKED)
    answers = written(asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "answers")
    model = Model(_stats(answers, WORDS), _stats(answers, PAIRS))
    told = answers.filter("chunk IS NOT NULL").select("chunk", "kind", "part", "counts", "owned")
    halves = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_half_scores(model, parts), _HALF)
    halves = written(halves, "half-scores")
    contexts = halves.filter("part IS NOT NULL").select("part", "chunk", "keys", "mass", "words_mass", "totals")
    alphas = contexts.groupBy("part").applyInArrow(_alphas, _ALPHAS)
    waiting = halves.filter("part IS NULL").select("chunk", "rows", "tokens", "known", "base", "score", "waiting", "waits")
    pieces = waiting.groupBy("chunk").cogroup(alphas.groupBy("chunk")).applyInArrow(_whole_scores, _SCORES)
    names = ("n_tokens", "n_known", "base_score", "score")
    scores = pieces.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    out = rows.join(scores, "row")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _rows_and_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with a number of its own, and the chunks that its tokens went to."""
    names = ["doc_id", "held_out", "row", "chunk", "rows", "train", "sizes", "words", "tokens"]
    base, at, done, kind = uuid.uuid4().int >> 66, 0, [], pa.int64()

    def numbered() -> Iterator[pa.RecordBatch]:
        nonlocal at, kind
        for batch in batches:
            row = pa.array(np.arange(at, at + batch.num_rows) + base, pa.int64())
            at += batch.num_rows
            kind = batch.column("doc_id").type
            done.append((batch.column("doc_id"), batch.column("held_out"), row))
            train = pa.array([not h for h in batch.column("held_out").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([row, train, batch.column("text")], ["row", "train", "text"])

    def rows() -> Iterator[pa.RecordBatch]:
        while done:
            own = done.pop()
            n = len(own[2])
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)]
            yield pa.RecordBatch.from_arrays([*own, *empty], names)

    for chunk in _make_chunks(numbered()):
        yield from rows()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), *chunk.columns], names)
    yield from rows()
