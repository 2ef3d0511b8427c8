"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import chat, decontaminate, katz, mixing, multi_index, phrases, pii, pu_quality
from orderloom.llm import repeats, secret_scan, simhash, spelling, token_files

Query = Callable[[SparkSession, str], DataFrame]
TYPOS = 97  # one in so many (document, word) of op13 is mistyped
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op2_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document from a model of trusted positives and unlabelled text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    network = pu_quality.train(docs, table(spark, folder, "labels"))
    scored = pu_quality.score(docs, network)
    return scored.select(
        "doc_id",
        pu_quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, folder, "documents")).drop("times")


@query
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, and read back from its formatted text."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


@query
def op5_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without byte strings that occur more than once."""
    return repeats.remove_repeats(table(spark, folder, "documents"), with_bytes=False)


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.scan(table(spark, folder, "documents"))


@query
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, and which."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as token ids, written to ORC files and read back."""
    return token_files.through_files(table(spark, folder, "documents"))


@query
def op10_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by a model of nine tenths of them."""
    return katz.score(table(spark, folder, "documents"))


@query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language that stand together most."""
    return phrases.phrases(table(spark, folder, "documents"))


@query
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, from patterns and from a tagger trained on a sample of all of them."""
    docs = table(spark, folder, "documents")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents, its neighbours one edit away and its usual spelling."""
    return spelling.variants(table(spark, folder, "documents"), TYPOS)
