"""Sources and sinks over files."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelode.sources import landing as L
from pricelode.sources import tables


def test_flattens_payloads(spark):
    page = {"products": [{"title": "T", "vendor": "V", "handle": "h", "variants": [{"id": 1, "sku": "s", "price": "9.50", "compare_at_price": "x", "available": True}, {"id": 2, "option3": "wide"}, {"id": 3, "available": False}]}, {"title": "none", "variants": []}]}
    df = spark.createDataFrame([(json.dumps(page),), ("not json",), (None,)], "payload string")
    got = sorted((r.title, r.external_variant_id or 0, float(r.price or 0), r.in_stock) for r in L.flatten_shop_snapshot(df).collect())
    assert got == [("T", 1, 9.5, True), ("T", 2, 0.0, True), ("T", 3, 0.0, False), ("none", 0, 0.0, False)]
    kept = L.flatten_shop_snapshot(df.selectExpr("payload", "7L AS snapshot_id")).where("external_variant_id is not null")
    assert {(r.external_variant_id, r.snapshot_id, r.o) for r in kept.selectExpr("external_variant_id", "snapshot_id", "variant_get(attributes, '$.option3', 'string') AS o").collect()} == {(1, 7, None), (2, 7, "wide"), (3, 7, None)}
    items = {"items": [{"id": 5, "name": "n", "price": 3.5, "custom_attributes": [{"attribute_code": "brand", "value": "B"}]}, {"id": 6, "status": 2, "custom_attributes": []}], "total_count": 2}
    got = sorted((r.external_variant_id, r.vendor, r.in_stock) for r in L.flatten_item_snapshot(spark.createDataFrame([(json.dumps(items),)], "payload string")).collect())
    assert got == [(5, "B", True), (6, None, False)]


def test_counts_products_of_snapshots(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, '{"total_products": 7, "products": [1]}'), (2, at, '{"products": [1, 2]}'), (3, at, "[1, 2, 3]"), (4, at, "bad"), (5, at, None)]
    got = {r.store_id: r.products_count for r in L.raw_snapshots(spark.createDataFrame(rows, "store_id int, fetched_at timestamp, payload string"), "v").collect()}
    assert got == {1: 7, 2: 2, 3: 3, 4: 0, 5: 0}


def test_files(spark, tmp_path):
    (tmp_path / "sites.txt").write_text("# all\n\nhttps://a.com \n https://b.com\n")
    sites = L.scan_site_list_text(spark, str(tmp_path / "sites.txt"))
    assert sorted(r.url for r in sites.collect()) == ["https://a.com", "https://b.com"]
    (tmp_path / "sites.json").write_text('[{"url": "https://a.com", "notes": "n"},\n {"url": "https://b.com", "enabled": true}]')
    assert L.scan_site_list_json(spark, str(tmp_path / "sites.json")).count() == 2
    L.sink_text(sites, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 2
    L.sink_json(sites, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == ["url"]
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "x")], "store_id int, fetched_at timestamp, payload string")
    for _ in range(2):
        L.append_raw_snapshot(df, str(tmp_path / "raw"))
        L.append_price_history(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == spark.read.parquet(str(tmp_path / "log")).count() == 2
    L.rebuild_overwrite(df, str(tmp_path / "table"))
    L.rebuild_overwrite(L.read_versioned(spark, str(tmp_path / "table")), str(tmp_path / "table"))
    assert L.read_versioned(spark, str(tmp_path / "table")).count() == 1


def test_readers_see_a_whole_table_between_any_two_steps(spark, tmp_path, monkeypatch):
    rows = lambda n: spark.range(n).toDF("k")
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        L.read_versioned(spark, path)
    L.rebuild_overwrite(rows(3), path)
    open_reader = L.read_versioned(spark, path)
    for step in ("_point", "_expire"):
        with monkeypatch.context() as m:
            m.setattr(L, step, lambda *a: (_ for _ in ()).throw(OSError("broken off")))
            with pytest.raises(OSError):
                L.rebuild_overwrite(rows(5), path)
        # Before the pointer the old table stands, after it the new one.
        assert L.read_versioned(spark, path).count() == (3 if step == "_point" else 5)
    # A pointer that was begun and not written names nothing, and its number isn't used again.
    (tmp_path / "table" / "_versions" / f"{9:012d}").touch()
    assert L.read_versioned(spark, path).count() == 5 and open_reader.count() == 3
    L.rebuild_overwrite(rows(6), path)
    L.rebuild_overwrite(rows(7), path)
    assert L.read_versioned(spark, path).count() == 7
    with pytest.raises(Exception, match="exist"):  # another writer took the number
        L._point(spark, path, 11, "v-other")
    assert L.read_versioned(spark, path).count() == 7


def test_snapshots_keep_headers_and_payload(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, '{"products": [{"title": "T"}]}', "shop", "u", 200, {"ETag": "x", "etag": "x"}), (2, at, "no json", "shop", "u", 500, None)]
    df = spark.createDataFrame(rows, "store_id int, fetched_at timestamp, payload string, adapter_name string, url string, http_status int, headers map<string,string>")
    L.append_raw_snapshot(L.raw_snapshots(df, "v"), str(tmp_path / "raw"))
    got = {r.store_id: r for r in spark.read.parquet(str(tmp_path / "raw")).selectExpr("*", "variant_get(payload, '$.products[0].title', 'string') AS title").collect()}
    assert got[1].title == "T" and got[1].response_headers == {"etag": "x"} and got[1].raw_text is None and got[1].http_status == 200
    assert got[2].title is None and got[2].raw_text == "no json" and got[2].response_headers is None and got[2].products_count == 0


def test_provenance(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "EUR", "eur", 5, at), (2, "EUR", None, 5, at), (3, "USD", "USD", 6, at), (4, None, None, 6, at)], "k int, currency string, api_currency string, snapshot_id long, fetched_at timestamp")
    got = {r.k: (r.exchange_rate_source, r.exchange_rate_timestamp, r.currency_source, r.raw_snapshot_id) for r in L.with_provenance(df, "v").collect()}
    assert got == {1: ("fixer_io", at, "api", 5), 2: ("fixer_io", at, "domain", 5), 3: (None, None, "api", 6), 4: (None, None, None, 6)}


def test_alerts_are_logged_once(spark, tmp_path):
    stores = spark.createDataFrame([(1, "one"), (2, "two")], "store_id int, name string")
    alerts = spark.createDataFrame([("one", "f1", 5.0), ("two", "f2", 6.0), ("gone", "f3", 7.0), ("one", "f1", 5.0)], "store string, fingerprint string, price double")
    for lot in (alerts.where("fingerprint = 'f1'"), alerts, alerts):
        L.append_deal_alerts(lot, stores, str(tmp_path / "log"))
    assert sorted((r.fingerprint, r.store_id) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("f1", 1), ("f2", 2)]


def keyed(spark, tmp_path, name, rows, columns, buckets=8):
    df = spark.createDataFrame(rows, columns)
    missing = [c.split()[0] for c in tables.SCHEMAS[name].split(", ") if c.split()[0] not in df.columns]
    whole = df.selectExpr("*", *[f"NULL AS {c}" for c in missing])
    tables.write_keyed(whole, name, str(tmp_path / name), f"t_{name}", buckets)
    return spark.table(f"t_{name}")


def test_keyed_tables_join_without_an_exchange_and_scan_one_bucket(spark, tmp_path):
    n = 500
    offers = keyed(spark, tmp_path, "offers", [(k, 1, k % 9 + 1.5) for k in range(n)], "variant_id long, store_id long, current_price double")
    variants = keyed(spark, tmp_path, "variants", [(k, f"s{k}") for k in range(n)], "variant_id long, sku string")
    changes = keyed(spark, tmp_path, "price_changes", [(k, 1, 2.5) for k in range(0, n, 2)], "variant_id long, store_id long, price double")
    joined = offers.join(variants.select("variant_id", "sku").hint("merge"), "variant_id").join(changes.select("variant_id", "price").hint("merge"), "variant_id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert joined.count() == n and joined.where("price is not null").count() == n // 2
    one = tables.scan_keys(spark, "offers", "t_offers", [77])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say which buckets it reads
    try:
        assert "SelectedBucketsCount: 1 out of 8" in tables.scan_keys(spark, "offers", "t_offers", [77])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert [(r.variant_id, float(r.current_price)) for r in one.collect()] == [(77, 6.5)]
    # Files under a declared schema: what a file lacks is null.
    spark.createDataFrame([(1, "n")], "store_id long, name string").write.parquet(str(tmp_path / "stores"))
    (row,) = tables.scan(spark, str(tmp_path / "stores"), "stores").collect()
    assert row.name == "n" and row.currency is None and len(row) == 7


def test_tables_of_a_database_are_read_in_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(k, k * 0.5) for k in range(-20, 300)], "variant_id long, price double")
    tables.write_jdbc(df, url, "prices", driver)
    back = tables.scan_jdbc(spark, url, "prices", "VARIANT_ID", 0, 200, 4, driver).toDF("variant_id", "price")
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_held_tables_are_released(spark):
    from urllib.parse import urlparse

    from pricelode import session

    df = session.held(spark.range(5), "released")
    folder = Path(urlparse(df.inputFiles()[0]).path).parent
    assert df.count() == 5 and "released" in folder.name and folder.exists()
    assert session.release(spark) >= 1 and session.release(spark) == 0
    assert not folder.exists()


def test_snapshots_of_many_stores_make_few_folders(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    texts = ['{"products": [1, {"title": "T"}]}', '{"total_products": 7, "products": []}', "[1, 2, 3]", '{"products": 5}', '{"products": [1}']
    rows = [(s, at, texts[s % 5]) for s in range(300)]
    L.append_raw_snapshot(L.raw_snapshots(spark.createDataFrame(rows, "store_id long, fetched_at timestamp, payload string"), "v"), str(tmp_path / "raw"), buckets=8)
    assert len(list((tmp_path / "raw").glob("*/*/*.parquet"))) <= 8
    table = spark.read.parquet(str(tmp_path / "raw"))
    assert {r.store_id: r.products_count for r in table.collect()} == {s: (2, 7, 3, 0, 0)[s % 5] for s in range(300)}
    # A reader of one store reads one folder.
    plan = table.where((F.col("store_id") == 5) & (F.col("bucket") == L.store_bucket(F.lit(5), 8)))
    assert [r.store_id for r in plan.collect()] == [5] and "bucket" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_rates_are_sent_to_rows_of_one_currency(spark):
    from pricelode.functions import normalize as N

    rates = spark.createDataFrame([("EUR", "0.5")], "currency string, rate string")
    rows = spark.range(9).select("id", F.lit("2").alias("price"), F.concat(F.lit("https://a"), "id", F.lit(".de")).alias("url"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("e"), F.lit("ur"))).alias("api_currency"))
    out = N.normalize_prices(rows, rates)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Dealt by currency, rows of one currency are one task's; the host is taken from the url once a row.
    assert "hashpartitioning(currency" not in plan and plan.count("regexp_extract(") == 1
    assert out.columns[-4:] == ["currency", "reject_reason", "usd_price", "rate"] and {float(r.usd_price) for r in out.collect()} == {4.0}


def test_lineage_parses_payloads_once(spark):
    from pricelode.plans import registry

    plan = registry.queries()["offer_lineage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan
