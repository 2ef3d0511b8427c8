"""Counts and checksums of what was loaded, gated snapshots, the catalog, content digests, durations and urban places."""

import os
from datetime import datetime

from pyspark.sql import functions as F
from scans import rows_read

from orderloom import schemas as S
from orderloom.operators import profile, quality
from orderloom.plans import build, silver
from orderloom.plans import order_facts as facts
from orderloom.sources import bronze
from orderloom.sources.runlog import OpsLog, request_durations, request_log_summary
from orderloom.sources.store import TableStore
from orderloom.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def both(spark, tmp_path):
    return TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w")


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    store, log = both(spark, tmp_path)
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    put(tmp_path / "in" / "a" / "sellers" / "p.csv", header + "".join(f"s{i},1,a,SP\n" for i in range(500)))
    put(tmp_path / "in" / "b" / "sellers" / "q.csv", header + "t1,1,a,SP\n")
    put(tmp_path / "in" / "c" / "sellers" / "r.csv", header)
    loaded = []
    read = rows_read(spark, lambda: loaded.extend(build.ingest(spark, store, log, f"{tmp_path}/in")))
    assert [(r.files, r.inserted_rows) for r in loaded] == [(3, 501)]
    assert {r["source_file"]: r["inserted_rows"] for r in log.runs().collect()} == {
        "a/sellers/p.csv": 500, "b/sellers/q.csv": 1, "c/sellers/r.csv": 0
    }
    # Once for the checksum, once for the table; it is not read a third time. The rest are log rows.
    assert 2 * 501 <= read < 2 * 501 + 300


def test_keys_are_cleaned_on_the_first_load(spark, tmp_path):
    store, log = both(spark, tmp_path)
    put(tmp_path / "in" / "sellers.csv", 'seller_id,seller_city\n" s1 ",a\n')
    build.ingest(spark, store, log, f"{tmp_path}/in")
    put(tmp_path / "in" / "sellers.csv", "seller_id,seller_city\ns1,b\n")
    build.ingest(spark, store, log, f"{tmp_path}/in")
    assert [(r["seller_id"], r["seller_city"]) for r in store.read("bronze", "sellers").collect()] == [("s1", "b")]


def test_content_decides_even_at_equal_length_and_time(spark, tmp_path):
    store, log = both(spark, tmp_path)
    path = tmp_path / "in" / "sellers.csv"
    put(path, "seller_id,seller_city\ns1,a\n")
    build.ingest(spark, store, log, f"{tmp_path}/in")
    times = (path.stat().st_atime, path.stat().st_mtime)
    put(path, "seller_id,seller_city\ns1,b\n")
    os.utime(path, times)
    assert build.ingest(spark, store, log, f"{tmp_path}/in", trust_times=True) == []
    assert [r.inserted_rows for r in build.ingest(spark, store, log, f"{tmp_path}/in")] == [1]
    assert store.read("bronze", "sellers").first()["seller_city"] == "b"


def test_a_smaller_snapshot_is_kept_out(spark, tmp_path):
    store, log = both(spark, tmp_path)

    def load(name, rows, expected):
        put(tmp_path / name / "geolocation.csv", "geolocation_city\n" + "".join(f"{r}\n" for r in rows))
        got = build.ingest(spark, store, log, f"{tmp_path}/{name}", expected_rows={"geolocation": expected})
        return got[0].inserted_rows, sorted(r[0] for r in store.read("reference", "geolocation").select("geolocation_city").collect())

    assert load("one", "abc", 3) == (3, ["a", "b", "c"])
    assert load("two", "xy", 3) == (0, ["a", "b", "c"])
    assert load("three", "xyz", 3) == (0, ["a", "b", "c"])  # as many are no more
    version = store.tables().first()["version"]
    assert load("four", "pqrs", 3) == (4, ["p", "q", "r", "s"])
    assert store.tables().first()["version"] == version + 1 == 2
    runs = log.runs()
    assert sorted((r["status"], r["total_rows"], r["inserted_rows"]) for r in runs.collect()) == [
        ("kept", 2, 0), ("kept", 3, 0), ("success", 3, 3), ("success", 4, 4)
    ]
    assert runs.filter("finished_at IS NULL").isEmpty()
    # What was dropped is no longer there.
    folders = [p for p in (tmp_path / "w" / "reference" / "geolocation").iterdir() if p.is_dir()]
    assert len(folders) == 2


def test_a_streams_files_are_logged_and_marked(spark, tmp_path):
    store, log = both(spark, tmp_path)
    spec, no_places = S.SELLERS, spark.createDataFrame([], "raw_city string, canonical_city string, state string")
    schema = bronze.text_schema([" Seller ID ", "seller_zip_code_prefix", "seller_city", "seller_state"])

    def run():
        return incremental.incremental_ingest(
            spark, f"{tmp_path}/in", schema, lambda df: silver.sellers(df, no_places), store, spec,
            [F.col("seller_city").asc_nulls_last()], f"{tmp_path}/s", files_per_batch=1, log=log,
        )

    header = " Seller ID ,seller_zip_code_prefix,seller_city,seller_state\n"
    put(tmp_path / "in" / "a.csv", header + "s1,1,b,SP\ns1,1,b,SP\ns2,2,NA,SP\n")
    put(tmp_path / "in" / "day" / "b.csv", header + "s3,2,x,SP\n")
    assert run()
    put(tmp_path / "in" / "c.csv", header + "s4,1,b,SP\n")
    assert run()
    runs = {r["source_file"]: r for r in log.runs().collect()}
    assert {f: (r["status"], r["total_rows"]) for f, r in runs.items()} == {"a.csv": ("success", 3), "c.csv": ("success", 1)}
    rows = incremental.streamed_bronze(spark, f"{tmp_path}/s")
    assert rows.columns == ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", *S.BRONZE_AUDIT]
    got = rows.collect()
    assert len(got) == 4 and [r["seller_city"] for r in got].count(None) == 1
    for r in got:
        run_row = runs[r["_source_file"]]
        assert (r["_ingestion_run_id"], r["_source_checksum"]) == (run_row["run_id"], run_row["source_checksum"])
        assert r["_ingested_at"] is not None
    assert store.read("silver", "sellers").count() == 3


def test_the_catalog_comes_from_the_store_alone(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    build.refresh(store, S.SELLERS, spark.createDataFrame([("s1", 1, "a", "SP")], "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string"))
    nested = spark.createDataFrame([([1], {"a": 1})], "xs array<int>, m map<string,int>")
    store.publish(nested, "gold", "nested")
    store.publish(nested.select("xs"), "gold", "nested")
    commented = S.CUSTOMERS.conform(spark.createDataFrame([("c", "u", 1, "x", "y")], list(S.CUSTOMERS.columns)))
    store.publish(commented, "silver", "customers")
    got = {(r["table_name"], r["column_name"]): r for r in profile.catalog(store.tables()).collect()}
    assert got["sellers", "seller_id"]["nullable"] is False and got["sellers", "seller_city"]["nullable"] is True
    assert got["sellers", "seller_zip_code_prefix"]["data_type"] == "integer" and got["sellers", "seller_zip_code_prefix"]["position"] == 2
    assert ("nested", "m") not in got and "array" in got["nested", "xs"]["data_type"]
    assert got["customers", "customer_unique_id"]["description"].startswith("The buyer")


def test_digests_tell_contents_apart_and_not_their_order(spark):
    ddl = "k string, v double, d decimal(10,2), t timestamp_ntz, b boolean"
    rows = [("a", 0.1 + 0.2, None, datetime(2020, 1, 1, 1), True), ("b", None, None, None, None), ("b", None, None, None, None)]
    columns = {"k": "string", "v": "double", "d": "decimal(10,2)", "t": "timestamp_ntz", "b": "boolean"}
    digest = lambda r: tuple(quality.content_digest(spark.createDataFrame(r, ddl).repartition(3), columns).first())
    one = digest(rows)
    assert one == digest(rows[::-1]) and one[0] == 3
    others = [rows[:2], rows[:1] + [("b", None, None, None, False), rows[2]], [("a", 0.4, *rows[0][2:]), *rows[1:]], []]
    assert len({one, *map(digest, others)}) == 5


def test_durations_per_status(spark):
    at = lambda s: datetime(2020, 1, 1, 0, 0, s)
    events = [(1, at(0), 1, "start"), (1, at(4), 2, "ok"), (2, at(1), 3, "start"), (2, at(2), 4, "ok"), (3, at(5), 5, "start"), (4, at(7), 6, "bad")]
    events = spark.createDataFrame(events, "k int, t timestamp_ntz, n int, s string").repartition(4)
    runs = request_durations(events, "k", "t", "n", "s", F.col("s").isin("ok", "bad"))
    got = {r["status"]: r for r in request_log_summary(runs, "s", F.lit(1), F.col("duration_ms")).collect()}
    assert (got["ok"]["requests"], got["ok"]["avg_duration_ms"], got["ok"]["p95_duration_ms"], got["ok"]["p95_is_exact"]) == (2, 2500.0, 4000.0, True)
    assert got["bad"]["avg_duration_ms"] == 0.0 and got["start"]["avg_duration_ms"] is None


def test_urban_places(spark):
    places = [("a", "S", 0.1, 0.1), ("b", "S", 0.9, 1.1), ("c", "S", 5.0, 5.0), ("d", "S", -0.1, -0.1), ("e", "S", None, 1.0)]
    geography = spark.createDataFrame(places, "city string, state string, avg_lat double, avg_lng double")
    living = [("a", "S")] * 3 + [("b", "S")] * 2 + [("c", "S")] * 4 + [("zz", "S")] * 9 + [(None, None)]
    customers = spark.createDataFrame(living, "customer_city string, customer_state string")
    got = {r["city"]: (r["places_near"], r["customers_near"], r["is_urban"]) for r in facts.urban_places(geography, customers, 1.0, 5).collect()}
    assert got == {"a": (3, 5, True), "b": (2, 5, True), "c": (1, 4, False), "d": (2, 3, False)}
