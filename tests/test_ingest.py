"""Landing, run log, versioned tables, streaming and the whole build."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orderloom import schemas as S
from orderloom.plans import build, checks, silver
from orderloom.sources import bronze, standins
from orderloom.sources import store as table_store
from orderloom.sources.registry import REGISTRY, Landing, target_layer
from orderloom.sources.runlog import OpsLog, latest_runs
from orderloom.sources.store import TableStore, VersionConflict, shared_folder
from orderloom.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_landing_text(spark, tmp_path):
    text = ' Order ID ,Review Comment\n1,"two\nlines with ""quotes"""\n2,NA\n"",plain\n'
    path = put(tmp_path / "r.csv", text)
    got = bronze.read_landing(spark, path, Landing("x", "kaggle", "bronze", "fact", multi_line=True))
    assert got.columns == ["order_id", "review_comment", "_source_file"]
    assert [tuple(r)[:2] for r in got.collect()] == [("1", 'two\nlines with "quotes"'), ("2", None), (None, "plain")]


def test_checksums(spark, tmp_path):
    put(tmp_path / "l" / "a" / "t" / "p.csv", "x\n1\n2\n")
    put(tmp_path / "l" / "b" / "t" / "p.csv", "x\n1\n3\n")
    put(tmp_path / "l" / "c d+e" / "p.csv", "x\n2\n1\n")
    folder = str(tmp_path / "l")
    files = bronze.landing_files(spark, folder)
    got = {r["file_name"]: r for r in bronze.file_checksums(spark, folder, files).collect()}
    assert set(got) == {"a/t/p.csv", "b/t/p.csv", "c d+e/p.csv"}
    assert got["a/t/p.csv"]["checksum"] != got["b/t/p.csv"]["checksum"] == got["b/t/p.csv"]["checksum"]
    assert got["a/t/p.csv"]["checksum"] == got["c d+e/p.csv"]["checksum"]  # the order of lines does not count
    sums = [sum(int(hashlib.md5(v.encode()).hexdigest()[i : i + 15], 16) for v in ("x", "1", "2")) for i in (0, 16)]
    assert got["a/t/p.csv"]["checksum"] == hashlib.md5("|".join(map(str, [3, *sums])).encode()).hexdigest()
    assert got["a/t/p.csv"]["header"] == "x"


def test_files_are_read_by_their_own_header(spark, tmp_path):
    store, log, landing = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w"), tmp_path / "in"
    put(landing / "day1" / "sellers" / "p.csv", "seller_id,zip,city,state\ns1,1,a,SP\n")
    put(landing / "day2" / "sellers" / "p.csv", "state,city,zip,seller_id\nRJ,b,2,s2\n")
    put(landing / "day2" / "sellers" / "q.csv", "seller_id,city\ns3,c\n")
    build.ingest(spark, store, log, str(landing))
    rows = {r["seller_id"]: r for r in store.read("bronze", "sellers").collect()}
    assert {k: (r["zip"], r["city"], r["state"]) for k, r in rows.items()} == {
        "s1": ("1", "a", "SP"), "s2": ("2", "b", "RJ"), "s3": (None, "c", None)
    }
    assert rows["s2"]["_source_file"] == "day2/sellers/p.csv"
    assert {r["source_file"]: r["inserted_rows"] for r in log.runs().collect()} == {
        "day1/sellers/p.csv": 1, "day2/sellers/p.csv": 1, "day2/sellers/q.csv": 1
    }
    put(landing / "day3" / "sellers" / "r.csv", "seller_id,surprise\ns4,x\n")
    with pytest.raises(ValueError, match="surprise"):
        build.ingest(spark, store, log, str(landing))


def test_keys_are_checked_on_the_first_load(spark, tmp_path):
    store, log = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w")
    put(tmp_path / "in" / "sellers.csv", "seller_id,seller_city\ns1,a\ns1,b\n")
    with pytest.raises(Exception, match="duplicate merge key"):
        build.ingest(spark, store, log, f"{tmp_path}/in")
    assert not store.exists("bronze", "sellers")


def test_a_table_without_key_holds_all_its_files_whenever_they_came(spark, tmp_path):
    store, log, landing = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w"), tmp_path / "in"
    put(landing / "geolocation" / "a.csv", "geolocation_city\nx\n")
    build.ingest(spark, store, log, str(landing))
    put(landing / "geolocation" / "b.csv", "geolocation_city\ny\n")
    build.ingest(spark, store, log, str(landing))
    assert sorted(r[0] for r in store.read("reference", "geolocation").select("geolocation_city").collect()) == ["x", "y"]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    store.publish(spark.range(3), "gold", "t")
    monkeypatch.setattr(store, "_current", lambda layer, table, at=store._current("gold", "t"): at)
    store.publish(spark.range(4), "gold", "t")
    with pytest.raises(VersionConflict):
        store.publish(spark.range(5), "gold", "t")


def test_a_lost_log_is_no_empty_store(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/w")
    store.publish(spark.range(3), "gold", "t")
    store._log_path = f"{tmp_path}/elsewhere"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.exists("gold", "t")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_table_names(spark):
    paths = ["/l/olist_orders_dataset.csv", "/l/product_category_name_translation.csv", "/l/olist_sellers_dataset.csv/part-0.csv", "/l/other.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(bronze.table_name(F.col("p"))).collect()]
    assert got == ["orders", "product_category_name_translation", "sellers", "l"]
    assert target_layer("geolocation") == "reference"
    with pytest.raises(ValueError):
        target_layer("other")


def test_store_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert not store.exists("gold", "t") and store.mark("gold", "t") == -1
    with pytest.raises(LookupError):
        store.read("gold", "t")
    first = store.publish(spark.range(3), "gold", "t")
    store.publish(first.filter("id > 0"), "gold", "t", mark=4)
    assert store.read("gold", "t").count() == 2 and store.mark("gold", "t") == 4
    assert first.count() == 3
    assert [tuple(r)[:3] for r in store.tables().collect()] == [("gold", "t", 2)]


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.publish(spark.range(3), "gold", "t")
    with pytest.raises(Exception):
        store.publish(spark.range(3).withColumn("id", F.raise_error(F.lit("boom")).cast("long")), "gold", "t")
    assert store.read("gold", "t").count() == 3


def test_run_log(spark, tmp_path):
    log = OpsLog(spark, str(tmp_path))
    assert log.runs().count() == 0 and log.quality().count() == 0
    done = log.start(pipeline_name="p", task_name="t")
    log.event(done, "success", pipeline_name="p", task_name="t", inserted_rows=3)
    open_run = log.start(pipeline_name="p", task_name="u")
    runs = {r["run_id"]: r for r in log.runs().collect()}
    assert runs[done]["status"] == "success" and runs[done]["inserted_rows"] == 3
    assert runs[done]["finished_at"] >= runs[done]["started_at"]
    assert runs[open_run]["status"] == "running" and runs[open_run]["finished_at"] is None


def test_latest_event_breaks_ties_by_number(spark):
    events = spark.createDataFrame([("r", 1, 1, "running"), ("r", 1, 2, "failed")], "run_id string, event_time int, event_no int, status string")
    assert latest_runs(events).first()["status"] == "failed"


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == named.rstrip("/") if named else "orderloom-" in shared_folder(spark)


def test_ingest_skips_merges_and_replaces(spark, tmp_path):
    store, log, landing = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w"), tmp_path / "in"
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    put(landing / "olist_sellers_dataset.csv", header + "s1,1,a,SP\ns2,2,b,SP\n")
    put(landing / "olist_geolocation_dataset.csv", "geolocation_city\nx\ny\n")
    put(landing / "unknown.csv", "a\n1\n")
    got = {r.table: (r.files, r.inserted_rows) for r in build.ingest(spark, store, log, str(landing))}
    assert got == {"sellers": (1, 2), "geolocation": (1, 2)}
    row = store.read("bronze", "sellers").first()
    assert len(row["_source_checksum"]) == 32 and row["_source_file"] == "olist_sellers_dataset.csv"
    assert build.ingest(spark, store, log, str(landing)) == []

    put(landing / "olist_sellers_dataset.csv", header + "s2,2,changed,SP\ns3,3,c,SP\n")
    put(landing / "olist_geolocation_dataset.csv", "geolocation_city\nz\n")
    build.ingest(spark, store, log, str(landing))
    sellers = {r["seller_id"]: r["seller_city"] for r in store.read("bronze", "sellers").collect()}
    assert sellers == {"s1": "a", "s2": "changed", "s3": "c"}
    assert [r[0] for r in store.read("reference", "geolocation").select("geolocation_city").collect()] == ["z"]
    assert {r["status"] for r in log.runs().collect()} == {"success"}


def test_ingest_of_one_source_type_and_a_failure(spark, tmp_path):
    store, log, landing = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w"), tmp_path / "in"
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    put(landing / "sellers.csv", header + "s1,1,a,SP\n")
    put(landing / "geolocation.csv", "geolocation_city\nx\n")
    assert [r.table for r in build.ingest(spark, store, log, str(landing), "kaggle")] == ["geolocation"]
    build.ingest(spark, store, log, str(landing))
    put(landing / "sellers.csv", header + "s1,1,a,SP\ns1,1,b,SP\n")
    with pytest.raises(Exception, match="duplicate merge key"):
        build.ingest(spark, store, log, str(landing))
    assert store.read("bronze", "sellers").count() == 1
    assert sorted(r["status"] for r in log.runs().collect()) == ["failed", "success", "success"]


def test_counts_are_validated(spark, tmp_path):
    store, log = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w")
    columns = list(S.ORDERS.columns)
    line = "o1,c1,delivered,2017-05-01 10:00:00,,,,"
    put(tmp_path / "in" / "orders.csv", ",".join(columns) + f"\n{line}\n")
    put(tmp_path / "in" / "product_category_mapping.csv", "raw_category,canonical_category\na,b\n")
    expected = {"orders": 1, "product_category_mapping": 1}
    loaded, outcome = build.ingest_and_validate(spark, store, log, f"{tmp_path}/in", expected, {2017: 1})
    assert [r.table for r in loaded] == ["product_category_mapping", "orders"]
    assert outcome.count() == 3 and outcome.filter("passed").count() == 3
    assert build.ingest_and_validate(spark, store, log, f"{tmp_path}/in", expected, {2017: 1})[1].count() == 0
    put(tmp_path / "in" / "orders.csv", ",".join(columns) + f"\n{line}\n{line.replace('o1', 'o2')}\n")
    with pytest.raises(build.ValidationError, match="orders.row_count, orders.year_2017_count"):
        build.ingest_and_validate(spark, store, log, f"{tmp_path}/in", expected, {2017: 1})
    put(tmp_path / "in2" / "orders.csv", "order_id,customer_id\no1,c1\n")
    other = TableStore(spark, f"{tmp_path}/w2")
    with pytest.raises(build.ValidationError, match="columns_orders"):
        build.ingest_and_validate(spark, other, OpsLog(spark, f"{tmp_path}/w2"), f"{tmp_path}/in2", expected, {2017: 1})
    found = {r["layer_name"]: r["passed"] for r in checks.layer_presence(store.tables(), ("bronze", "gold")).collect()}
    assert found == {"bronze": True, "gold": False}


def test_expectations_are_stored(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    observed = spark.createDataFrame([("orders", 5)], "table_name string, actual bigint")
    for version in ("1.1.1", "1.1.2"):
        build.renew_stored_expectations(spark, store, observed)
        rows = {r["table_name"]: r for r in store.read("ops", "expectations").collect()}
        assert (rows["orders"]["row_count"], rows["orders"]["version"]) == (5, version)
        assert rows["orders"]["last_updated"] is not None and rows["sellers"]["last_updated"] is None
        assert set(rows) == set(S.EXPECTED_ROWS)


def test_stream_equals_batch_merge(spark, tmp_path):
    store, spec = TableStore(spark, f"{tmp_path}/w"), S.SELLERS
    schema = bronze.text_schema(spec.columns)
    no_places = spark.createDataFrame([], "raw_city string, canonical_city string, state string")
    header = ",".join(spec.columns) + "\n"

    def run():
        return incremental.incremental_ingest(
            spark, f"{tmp_path}/in", schema, lambda df: silver.sellers(df, no_places), store, spec,
            [F.col("seller_city").asc_nulls_last()], f"{tmp_path}/s", files_per_batch=1,
        )

    put(tmp_path / "in" / "a.csv", header + "s1,1,b,SP\ns1,1,a,SP\ns2,2,x,SP\n")
    assert run() is True
    assert {tuple(r) for r in store.read("silver", "sellers").collect()} == {("s1", 1, "a", "SP"), ("s2", 2, "x", "SP")}
    assert run() is False
    put(tmp_path / "in" / "b.csv", header + "s2,2,y,SP\ns3,3,z,SP\n")
    run()
    want = {("s1", 1, "a", "SP"), ("s2", 2, "y", "SP"), ("s3", 3, "z", "SP")}
    assert {tuple(r) for r in store.read("silver", "sellers").collect()} == want
    # A crash after staging and before the merge: the next run merges what was staged.
    put(tmp_path / "in" / "c.csv", header + "s4,4,q,SP\n")
    stream = incremental.landing_stream(spark, f"{tmp_path}/in", schema)
    incremental.stage_changes(stream, lambda df: silver.sellers(df, no_places), spec, [F.col("seller_city").asc()], f"{tmp_path}/s")
    assert store.read("silver", "sellers").count() == 3
    run()
    assert store.read("silver", "sellers").count() == 4


def test_a_fresh_checkpoint_loses_nothing_and_a_strange_header_fails(spark, tmp_path):
    store, spec = TableStore(spark, f"{tmp_path}/w"), S.SELLERS
    schema = bronze.text_schema(spec.columns)
    no_places = spark.createDataFrame([], "raw_city string, canonical_city string, state string")
    header = ",".join(spec.columns) + "\n"

    def run(checkpoint):
        stream = incremental.landing_stream(spark, f"{tmp_path}/in", schema)
        incremental.stage_changes(stream, lambda df: silver.sellers(df, no_places), spec, [F.col("seller_city").asc()], f"{tmp_path}/{checkpoint}")
        return incremental.merge_changes(spark, store, spec, f"{tmp_path}/{checkpoint}")

    put(tmp_path / "in" / "a.csv", header + "s1,1,a,SP\n")
    assert run("one")
    put(tmp_path / "in" / "b.csv", header + "s2,2,b,SP\n")
    assert run("two")  # batches count from 0 again
    assert store.read("silver", "sellers").count() == 2
    put(tmp_path / "in" / "c.csv", ",".join(reversed(list(spec.columns))) + "\nSP,c,3,s3\n")
    with pytest.raises(Exception):
        run("two")


def test_build_twice_gives_the_same_tables(spark, tmp_path, folder):
    s = standins.Silver(spark, folder)
    landing = {
        "customers": standins.bronze_customers(s),
        "sellers": standins.bronze_sellers(s),
        "products": standins.bronze_products(s),
        "orders": standins.bronze_orders(s),
        "order_items": standins.bronze_order_items(s),
        "order_payments": standins.bronze_order_payments(s),
        "order_reviews": standins.bronze_order_reviews(s),
        "geography_master": standins.place_map(s),
        "product_category_mapping": standins.category_map(s),
    }
    for table, rows in landing.items():
        bronze.export_csv(rows, f"{tmp_path}/in/{table}")
    store, log = TableStore(spark, f"{tmp_path}/w"), OpsLog(spark, f"{tmp_path}/w")
    build.ingest(spark, store, log, f"{tmp_path}/in")

    def contents():
        return {
            m.name: store.read(m.layer, m.name).select(F.sum(F.xxhash64(*m.columns).cast("decimal(38,0)")), F.count("*")).first()
            for m in S.MODELS
            if m is not S.GEOGRAPHY
        }

    first = build.build_warehouse(spark, store, log)
    assert first["quality_issue_count"] == 0 and "master.geography" not in first["executed_files"]
    before = contents()
    build.build_warehouse(spark, store, log)
    assert contents() == before
    run = {r["run_id"]: r for r in log.runs().filter("pipeline_name = 'transformation'").collect()}[first["run_id"]]
    assert run["status"] == "success" and run["executed_files"] == first["executed_files"]
    assert log.quality().count() == 8
    assert REGISTRY["order_reviews"].multi_line


def test_a_store_is_empty_until_its_first_claim_has_a_log_row(spark, tmp_path, monkeypatch):
    store, claim = TableStore(spark, str(tmp_path)), table_store._claim

    def claimed(spark, path):
        done = claim(spark, path)
        assert not store.exists("gold", "u")  # what another job asks at that moment
        return done

    monkeypatch.setattr(table_store, "_claim", claimed)
    store.publish(spark.range(3), "gold", "t")
    assert store.read("gold", "t").count() == 3
