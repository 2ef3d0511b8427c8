"""Versioned tables on a shared folder.

A table version is written to a new path and becomes current by one appended row in the version log, so a
reader never sees half a table and a job may read a table and publish its successor. A write that dies
leaves a path that no log row names.

A table kept by month is a folder for each month of a version, and a version of it a manifest that names one folder
for each month: those that were written for it, and for all other months the folders of earlier versions as they are.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.sources.rows import append_part, read_parts, small_frame

VERSION_SCHEMA = """
    layer string, table_name string, version bigint, path string, mark bigint, marked_by string, published_at timestamp,
    manifest string, data_schema string
"""
# A table kept by month: the month of a row (its first day) and the version that wrote the row, both from folder names.
MONTH, WRITTEN_BY = "part_month", "part_version"
MANIFEST_SCHEMA = "month date, path string"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it; a local one only on a single machine."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"no shared folder is named: set {CHECKPOINT_DIR}")
    return tempfile.mkdtemp(prefix="orderloom-")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/orderloom/{purpose}-{uuid.uuid4().hex}"


class VersionConflict(RuntimeError):
    pass


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(file)


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def _make_folder(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(file)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the months' folders below a path."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = file.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(file)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(f"{MONTH}="))


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._log_path = f"{self.root}/_table_versions"
        self._claims = f"{self.root}/_version_claims"

    def _log(self) -> DataFrame:
        # Once something was published, a log that cannot be found is lost and no empty store.
        return read_parts(self.spark, self._log_path, VERSION_SCHEMA, not _exists(self.spark, self._claims))

    def tables(self) -> DataFrame:
        """The current version of every table."""
        fields = ("version", "path", "mark", "manifest", "data_schema")
        newest = self._log().groupBy("layer", "table_name").agg(F.max(F.struct(*fields)).alias("v"))
        return newest.select("layer", "table_name", *[f"v.{f}" for f in fields])

    def _current(self, layer: str, table: str):
        rows = self._log().filter((F.col("layer") == layer) & (F.col("table_name") == table))
        return rows.orderBy(F.col("version").desc()).first()

    def exists(self, layer: str, table: str) -> bool:
        return self._current(layer, table) is not None

    def mark(self, layer: str, table: str, stream: str | None = None) -> int:
        """The position in an input stream up to which the table is complete (-1 at the start)."""
        rows = self._log().filter((F.col("layer") == layer) & (F.col("table_name") == table))
        mark = rows.filter(F.col("marked_by").eqNullSafe(F.lit(stream))).agg(F.max("mark")).first()[0]
        return -1 if mark is None else mark

    def read(self, layer: str, table: str) -> DataFrame:
        current = self._current(layer, table)
        if current is None:
            raise LookupError(f"no table {layer}.{table}")
        if current["manifest"]:
            return self._months_of(current).drop(MONTH, WRITTEN_BY)
        return self.spark.read.parquet(current["path"])

    def is_by_month(self, layer: str, table: str) -> bool:
        current = self._current(layer, table)
        return current is not None and current["manifest"] is not None

    def manifest(self, layer: str, table: str) -> DataFrame:
        """(month, path) of the current version of a table kept by month; one row a month."""
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self._current(layer, table)["manifest"])

    def read_months(self, layer: str, table: str) -> DataFrame:
        """A table kept by month with the column MONTH; a filter on it leaves the other months' folders alone."""
        current = self._current(layer, table)
        if current is None or not current["manifest"]:
            raise LookupError(f"no table {layer}.{table} that is kept by month")
        return self._months_of(current).drop(WRITTEN_BY)

    def _months_of(self, current) -> DataFrame:
        paths = [r["path"] for r in self.spark.read.schema(MANIFEST_SCHEMA).parquet(current["manifest"]).collect()]
        schema = T.StructType.fromJson(json.loads(current["data_schema"]))
        schema = schema.add(WRITTEN_BY, T.StringType()).add(MONTH, T.DateType())
        if not paths:
            return self.spark.createDataFrame([], schema)
        root = f"{self.root}/{current['layer']}/{current['table_name']}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def publish(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        mark: int | None = None,
        marked_by: str | None = None,
        by_month: str | None = None,
        sorted_by: Sequence[str] = (),
        replaced: Sequence[date | None] | None = None,
        observation: Observation | None = None,
        measures: Sequence[Column] = (),
        accept: Callable[[dict], bool] | None = None,
        keys: Sequence[str] = (),
    ) -> DataFrame | None:
        """Write ``df`` as the next version and return the written table.

        by_month: the timestamp by whose month the table is kept. ``replaced`` then names the months that ``df``
        holds anew, gone if it has no row of them; None stands for all. sorted_by: order of the rows in each file.
        keys: columns that the catalog lists as never NULL.
        observation: gets the measures of the rows as they are written. accept: told these, it decides whether the
        rows become the next version; if not, what was written is deleted, and None is returned.

        The version is claimed by a file that can be made only once, so of two writers that began on the same
        version the second fails. A claim without a row in the log is left by a writer that died in between.
        """
        current = self._current(layer, table)
        version = 1 if current is None else current["version"] + 1
        name = f"v{version:06d}-{uuid.uuid4().hex[:8]}"
        root = f"{self.root}/{layer}/{table}"
        data_schema = T.StructType([T.StructField(f.name, f.dataType, f.name not in keys, f.metadata) for f in df.schema])
        if observation is not None:
            df = df.observe(observation, *measures)
        manifest = None
        if by_month is None:
            path = f"{root}/{name}"
            (df.sortWithinPartitions(*sorted_by) if sorted_by else df).write.parquet(path)
        else:
            path = f"{root}/{WRITTEN_BY}={name}"
            rows = df.withColumn(MONTH, F.trunc(F.col(by_month), "MM").cast("date")).hint("rebalance", MONTH)
            rows.sortWithinPartitions(MONTH, *sorted_by).write.partitionBy(MONTH).parquet(path)
            manifest = f"{root}/_manifests/{name}"
            self._write_manifest(current, path, replaced, manifest)
        if accept is not None and not accept(observation.get):
            _delete(self.spark, path)
            return None
        claim = f"{self._claims}/{layer}.{table}/v{version:06d}"
        # Before the first claim, after which others take a log that is not there for lost.
        _make_folder(self.spark, self._log_path)
        if not _claim(self.spark, claim):
            raise VersionConflict(f"{layer}.{table}: version {version} was claimed by another writer ({claim})")
        row = {
            "layer": layer,
            "table_name": table,
            "version": version,
            "path": path,
            "mark": mark,
            "marked_by": marked_by,
            "published_at": datetime.now(timezone.utc),
            "manifest": manifest,
            "data_schema": data_schema.json(),
        }
        append_part(small_frame(self.spark, [row], VERSION_SCHEMA), self._log_path)
        return self._months_of(row).drop(MONTH, WRITTEN_BY) if manifest else self.spark.read.parquet(path)

    def _write_manifest(self, current, path: str, replaced: Sequence[date | None] | None, manifest: str) -> None:
        """The folders just written, and those of the months that were not replaced. One row a month."""
        months = {}
        if replaced is not None and current is not None and current["manifest"]:
            before = self.spark.read.schema(MANIFEST_SCHEMA).parquet(current["manifest"]).collect()
            months = {r["month"]: r["path"] for r in before if r["month"] not in set(replaced)}
        for folder in _folders(self.spark, path):
            value = folder.rpartition("=")[2]
            months[None if value == NO_MONTH else date.fromisoformat(value)] = f"{path}/{folder}"
        rows = [{"month": m, "path": p} for m, p in months.items()]
        small_frame(self.spark, rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(manifest)
