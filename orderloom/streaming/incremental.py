"""New landing files merged into a table, each file once.

A micro-batch's rows are first written as they landed, to ``{folder}/bronze/stream=ID/batch_id=N``; one row for each of
its files, with checksum, run id and number of rows, goes beside them to ``{folder}/files/...`` and to the run log.
``streamed_bronze`` reads both together, with the same provenance columns as any bronze table.

The stream writes every micro-batch to ``{changes}/stream=ID/batch_id=N``; replaying a batch overwrites its own
folder. The id is the checkpoint's: under a fresh checkpoint batches count from 0 again, as another stream. Once the available files are through, one merge brings all changes since the table's mark into the
next version of the table. So the table is rewritten once per run, not once per micro-batch, and a crash at
any point is repaired by the next run.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.dedupe import dedupe_first
from orderloom.plans.upsert import merge_into
from orderloom.schemas import BRONZE_AUDIT, TableSpec
from orderloom.sources.bronze import CSV_OPTIONS, decoded, header_name, missing_to_null, source_name
from orderloom.sources.runlog import OpsLog
from orderloom.sources.store import TableStore

STREAM, BATCH, STAGED_AT = "stream", "batch_id", "staged_at"


def landing_stream(
    spark: SparkSession, folder: str, schema: T.StructType, multi_line: bool = False, files_per_batch: int = 1000
) -> DataFrame:
    """All-text rows of CSV files as they arrive in a folder, with ``_source_file``.

    A file whose header differs from the schema's names fails the stream: columns are never taken by position.
    """
    named = T.StructType([T.StructField(header_name(f.name), f.dataType, f.nullable) for f in schema.fields])
    if len(set(named.names)) < len(named.names):
        raise ValueError(f"a column name occurs twice in {schema.names}")
    rows = (
        spark.readStream.schema(schema)
        .options(**CSV_OPTIONS)
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    path = source_name(decoded(F.col("_metadata.file_path")), folder)
    columns = [missing_to_null(f"`{c}`").alias(n) for c, n in zip(schema.names, named.names)]
    return rows.select(*columns, path.alias("_source_file"))


def batch_files(rows: DataFrame, spec: TableSpec, stream_id: str, batch_id: int) -> DataFrame:
    """One row for each file of a batch, with the fields of the run log.

    The checksum is the md5 over the number of rows and two exact sums over the md5 of each row's values. The run id
    depends on stream, batch and file, so a batch that is replayed has the same.
    """
    columns = [c for c in rows.columns if c != "_source_file"]
    row = F.md5(F.to_json(F.struct(*columns)))
    half = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.select("_source_file", row.alias("row")).groupBy("_source_file").agg(
        F.count("*").alias("total_rows"), half(1).alias("a"), half(17).alias("b")
    )
    return sums.select(
        F.md5(F.concat_ws("|", F.lit(stream_id), F.lit(batch_id), "_source_file")).alias("run_id"),
        F.lit("streaming").alias("pipeline_name"),
        F.lit(spec.name).alias("task_name"),
        F.col("_source_file").alias("source_file"),
        F.md5(F.concat_ws("|", "total_rows", "a", "b")).alias("source_checksum"),
        F.lit(spec.layer).alias("target_schema"),
        F.lit(spec.name).alias("target_table"),
        F.lit(1).alias("processed_chunks"),
        "total_rows",
        F.col("total_rows").alias("inserted_rows"),
    )


def streamed_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that streams staged, as they landed, with the provenance columns of a bronze table."""
    rows, files = spark.read.parquet(f"{folder}/bronze"), spark.read.parquet(f"{folder}/files")
    of = [STREAM, BATCH, "_source_file"]
    marks = files.select(
        STREAM,
        BATCH,
        F.col("source_file").alias("_source_file"),
        F.col("source_checksum").alias("_source_checksum"),
        F.col("run_id").alias("_ingestion_run_id"),
    )
    data = [c for c in rows.columns if c not in (*of, "_ingested_at")]
    return rows.join(marks, of, "left").select(*data, *BRONZE_AUDIT)


def stage_changes(
    stream: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    spec: TableSpec,
    order: Sequence[Column],
    folder: str,
    log: OpsLog | None = None,
) -> None:
    """Run the stream over what is available; each batch leaves its rows, its files and its cleaned rows, one per key."""
    started, stream_id, spark = threading.Event(), [], stream.sparkSession

    def write_batch(rows: DataFrame, batch_id: int) -> None:
        started.wait()
        at = f"{STREAM}={stream_id[0]}/{BATCH}={batch_id}"
        rows.withColumn("_ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/bronze/{at}")
        landed = spark.read.parquet(f"{folder}/bronze/{at}").drop("_ingested_at")
        batch_files(landed, spec, stream_id[0], batch_id).write.mode("overwrite").parquet(f"{folder}/files/{at}")
        once = dedupe_first(spec.conform(clean(landed)), spec.keys, list(order)).withColumn(STAGED_AT, F.current_timestamp())
        once.write.mode("overwrite").parquet(f"{folder}/changes/{at}")
        if log is not None:
            log.record_frame(spark.read.parquet(f"{folder}/files/{at}"), "success")

    query = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream_id.append(query.id)
    started.set()
    query.awaitTermination()


def merge_changes(spark: SparkSession, store: TableStore, spec: TableSpec, folder: str) -> bool:
    """Merge the staged changes after the table's marks into its next versions; False if there are none.

    Of several changes to one key the newest batch wins. Streams that staged something, of which there is one for
    each checkpoint the folder has had, are merged one after the other in the order in which they staged last.
    """
    try:
        staged = spark.read.parquet(f"{folder}/changes")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    streams = staged.groupBy(STREAM).agg(F.max(BATCH).alias("newest"), F.max(STAGED_AT).alias("at")).orderBy("at").collect()
    merged = False
    for row in streams:
        mark = store.mark(spec.layer, spec.name, row[STREAM])
        if row["newest"] <= mark:
            continue
        own = staged.filter((F.col(STREAM) == row[STREAM]) & (F.col(BATCH) > mark))
        last = dedupe_first(own, spec.keys, [F.col(BATCH).desc()]).select(*spec.columns)
        merge_into(store, spec, last, spec.update_cols, unique=True, mark=int(row["newest"]), marked_by=row[STREAM])
        merged = True
    return merged


def incremental_ingest(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    clean: Callable[[DataFrame], DataFrame],
    store: TableStore,
    spec: TableSpec,
    order: Sequence[Column],
    folder: str,
    multi_line: bool = False,
    files_per_batch: int = 1000,
    log: OpsLog | None = None,
) -> bool:
    """Bring a table up to date with the files that arrived since the last run; True if anything changed."""
    stream = landing_stream(spark, landing, schema, multi_line, files_per_batch)
    stage_changes(stream, clean, spec, order, folder, log)
    return merge_changes(spark, store, spec, folder)
