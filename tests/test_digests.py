"""Checksums and digests: sums in a map by file, not over sorted lines."""

import hashlib

from pyspark.sql import functions as F

from orderloom.operators import quality
from orderloom.sources import bronze
from orderloom.sources.registry import REGISTRY


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_several_blocks_and_small_ones_in_one_task(spark, tmp_path):
    texts = {
        "a/t/p.csv": "id,name\n" + "".join(f"{i},{'x' * 90}\n" for i in range(5000)),
        "c/t/p.csv": "\nid\n1\n",
        "d/t/p.csv": "name,id\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100KB")
    try:
        summed = bronze.file_checksums(spark, str(tmp_path), bronze.landing_files(spark, str(tmp_path)))
        assert "SortAggregate" not in _plan(summed)
        got = {r["file_name"]: (r["checksum"], r["header"]) for r in summed.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        lines = text.split("\n")[:-1]
        sums = [sum(int(hashlib.md5(v.encode()).hexdigest()[i : i + 15], 16) for v in lines) for i in (0, 16)]
        told = [len(lines), *sums]
        assert got[name] == (hashlib.md5("|".join(map(str, told)).encode()).hexdigest(), lines[0])


def test_digest_sums_are_longs(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    digest = quality.content_digest(df, {"k": "string"})
    assert "decimal(38,0)" not in _plan(digest)
    rows = [hashlib.md5(str(i).encode()).hexdigest() for i in range(1000)]
    told = "|".join(map(str, [1000, *(sum(int(r[i : i + 15], 16) for r in rows) for i in (0, 16))]))
    assert tuple(digest.first()) == (1000, hashlib.md5(told.encode()).hexdigest())
    empty = quality.content_digest(df.filter("k is null"), {"k": "string"})
    assert tuple(empty.first()) == (0, hashlib.md5(b"0").hexdigest())


def test_lines_are_read_once_and_files_named_once_they_are_summed(spark, tmp_path):
    # More files in a task than an aggregate keeps in its map.
    folder = tmp_path / "day 1+1%20é"
    for i in range(20):
        (folder / f"{i}" / "sellers").mkdir(parents=True)
        (folder / f"{i}" / "sellers" / "p q.csv").write_text(f"h{i},seller_id\n" + "a,1\n" * i)
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "2")
    try:
        files = bronze.file_checksums(spark, str(folder), bronze.landing_files(spark, str(folder)))
        plan = _plan(files)
        assert plan.count("Scan text") == 1 and "decode" in plan
        assert "decode" not in plan[plan.rindex("ObjectHashAggregate") :]
        got = files.collect()
    finally:
        spark.conf.unset("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    assert {r["file_name"]: r["header"] for r in got} == {f"{i}/sellers/p q.csv": f"h{i},seller_id" for i in range(20)}

    listed = [r.asDict() for r in got]
    marks = spark.createDataFrame([{"uri": r["uri"], "file_no": i} for i, r in enumerate(listed)], "uri string, file_no int")
    rows = bronze.read_numbered(spark, [(r["path"], r["header"]) for r in listed], REGISTRY["sellers"], marks)
    assert "decode" not in _plan(rows)
    counted = {r["_source_no"]: r["count"] for r in rows.groupBy("_source_no").count().collect()}
    assert {listed[no]["file_name"]: n for no, n in counted.items()} == {f"{i}/sellers/p q.csv": i for i in range(1, 20)}
