"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

A source's target is its weight's share of the total, at most ``EPOCHS`` times its own size; what the clamped
sources leave over goes to the others by weight until none is above its bound. Every document is then repeated
floor(target / size) times, and the seeded order of the documents decides which get one more: the first ones, up
to the words that are still wanted. The place where a source stops is found by counting words in ever finer
ranges of the hash, so neither a source nor its order is ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.common import WORD, unit_hash, unused, written

EPOCHS = 3.0
SEED = "mixing"
LEVELS, LEVEL_BITS = 4, 9
PLACES = LEVELS * LEVEL_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) in code point order of ``source``, NULL last, without sorting in one task.

    The sorted rows are written, so that their numbering is the same whenever it is read.
    """
    order = [F.col("source").isNull(), F.col("source").asc_nulls_last()]
    rows = written(sizes.orderBy(*order).withColumn("n", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("n", 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # One row per sorted partition.
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    place = F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(parts, "part").withColumn("rank", place).drop("part", "n", "before")


def water_fill(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to rows with ``size`` and ``weight``; the targets share the sum of all sizes.

    Each round clamps the sources whose share is above their bound and shares out the rest anew; only the two
    sums of a round come to the driver. A source of size zero gets zero.
    """
    cap = F.col("source_size") * EPOCHS
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight").cast("double"))).alias("weight"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row["weight"] or row["n"] == clamped:
            break
        clamped, level = row["n"], max(0.0, total - row["taken"]) / row["weight"]
    share = cap if level is None else F.least(cap, F.col("weight") * level)
    return sources.withColumn("target", share.cast("double"))


def _cut_places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): rows of a source whose ``place`` is below ``cut`` hold about ``words`` words.

    Level by level the range of places in which the wanted number is reached is narrowed down; a level counts
    2^9 ranges a source.
    """
    state = wanted.select(F.col("source").alias("of"), "words", F.lit(0).cast("long").alias("start"))
    for level in range(LEVELS):
        shift = PLACES - (level + 1) * LEVEL_BITS
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("of")))
        inside = inside.filter(
            F.shiftright("start", shift + LEVEL_BITS) == F.shiftright("place", shift + LEVEL_BITS)
        )
        counts = inside.groupBy("source", F.shiftright("place", shift).alias("range")).agg(
            F.sum("size").alias("size"), F.first("words").alias("words"), F.first("start").alias("start")
        )
        upto = F.sum("size").over(W.partitionBy("source").orderBy("range"))
        ranges = written(counts.withColumn("before", upto - F.col("size")), "ranges")
        if level < LEVELS - 1:
            # The last range that begins at or below the wanted number.
            last = ranges.filter("before <= words").groupBy("source").agg(F.max(F.struct("range", "before", "words")).alias("r"))
            state = last.select(
                F.col("source").alias("of"),
                (F.col("r.words") - F.col("r.before")).alias("words"),
                F.shiftleft("r.range", shift).alias("start"),
            )
    # On the finest level the last range of which half still fits; else what came before it.
    fits = F.max(F.when(F.col("before") + F.col("size") / 2 <= F.col("words"), F.col("range") + 1))
    return ranges.groupBy("source").agg(F.coalesce(fits, F.max("start")).alias("cut"))


def _row(doc_id: str, text: str, source: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(source))


def _place(row: Column) -> Column:
    return F.shiftright(unit_hash(row, F.lit(SEED)), 62 - PLACES)


def _sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    row = _row(doc_id, text, source)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        _place(row).alias("place"),
    )
    return written(rows, "sizes")


def _shares(rows: DataFrame) -> DataFrame:
    """(mix_source, source_size, target, whole, cut): one row a source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked_sources(sizes).withColumn("weight", F.col("rank") % 3 + 1)
    targets = water_fill(written(ranked, "weights"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", times.cast("long"))
    targets = written(
        targets.withColumn("words", F.col("target") - F.col("whole") * F.col("source_size")), "targets"
    )
    cuts = _cut_places(rows.select("source", "place", "size"), targets.select("source", "words"))
    joined = targets.join(
        cuts.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left"
    )
    clamped = F.col("target") >= F.col("source_size") * EPOCHS
    cut = F.when(clamped, F.lit(0)).otherwise(F.coalesce("cut", F.lit(0)))
    shares = joined.select(F.col("source").alias("mix_source"), "source_size", "target", "whole", cut.cast("long").alias("cut"))
    return written(shares, "shares")


def _times(place: Column) -> Column:
    return (F.col("whole") + F.when(place < F.col("cut"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, times, taken): how often the mix takes each row of the table.

    Texts that are NULL or hold no word have size 0; what is taken of them adds nothing. NULL is a source of its
    own, the last one. Rows that are equal are placed alike. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = _sized(docs, text, doc_id, source)
    out = rows.join(_shares(rows), F.col("source").eqNullSafe(F.col("mix_source")))
    out = out.withColumn("times", _times(F.col("place")))
    return out.select(
        "doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with their columns as they were.

    Only the table of sources is joined to the documents.
    """
    shares = _shares(_sized(docs, text, doc_id, source)).select("mix_source", "whole", "cut")
    own, whole, cut, times, again = unused(docs, "_mix_source", "_whole", "_cut", "_times", "_again")
    shares = shares.select(*(F.col(c).alias(n) for c, n in zip(shares.columns, (own, whole, cut))))
    out = docs.join(shares, F.col(source).eqNullSafe(F.col(own)))
    extra = F.when(_place(_row(doc_id, text, source)) < F.col(cut), 1).otherwise(0)
    out = out.withColumn(times, (F.col(whole) + extra).cast("int")).filter(F.col(times) > 0)
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
