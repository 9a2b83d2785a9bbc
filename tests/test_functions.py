"""Golden values of the column functions and statistics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pricelode.functions import normalize as N
from pricelode.functions import statistics as T
from pricelode.operators import maintenance as U
from pricelode.operators import matching as M
from pricelode.operators import scoring as C
from pricelode.operators import shaping as S


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def group(spark, prices):
    return spark.createDataFrame([(1, float(p)) for p in prices], "g int, price double")


@pytest.mark.parametrize("prices,kept", [([100, 110, 105, 20000, 95], [95, 100, 105, 110]), ([100, 100, 100], [100] * 3), ([100] * 5 + [300, 700], [100] * 5 + [300]), ([], []), ([100], [100]), ([0, -5, 25000], [])])
def test_sanity(spark, prices, kept):
    assert sorted(r.price for r in T.sanitized(group(spark, prices), ["g"]).collect()) == kept


def test_median_deviation(spark):
    assert sorted(r.price for r in T.mad_kept(group(spark, [100, 110, 120, 130, 1000]), ["g"]).collect()) == [100, 110, 120, 130]
    assert T.mad_kept(group(spark, [1, 900]), ["g"]).count() == 2
    assert T.iqr_kept(group(spark, [10, 11, 12, 13, 99]), ["g"]).count() == 4


@pytest.mark.parametrize("pairs,want", [([(100, 10), (200, 1)], 100), ([(150, 0.2), (100, 0.5), (120, 1.5), (130, 1.0)], 120), ([(5, 1), (5, 1), (9, 2)], 5)])
def test_weighted_median(spark, pairs, want):
    df = spark.createDataFrame([(1, float(v), float(w)) for v, w in pairs], "g int, v double, w double")
    assert T.weighted_quantile(df, ["g"], "v", "w", [(1, 2)], ["m"]).first().m == want


def test_weighted_percentile_interpolates(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0), (1, 200.0, 1.0), (1, 300.0, 1.0)], "g int, v double, w double")
    assert abs(T.weighted_percentile(df, ["g"], "v", "w", F.lit(0.5), "p").first().p - 100) <= 10
    assert T.weighted_percentile(df, ["g"], "v", "w", F.lit(11 / 12), "p").first().p == pytest.approx(200)


def test_confidence(spark):
    rows = spark.createDataFrame([(0, 1, 0.0), (3, 2, 0.0), (3, 2, 0.5), (1, 1, 9.0)], "n int, s int, cv double").select(T.confidence(F.col("n"), F.col("s"), F.col("cv")).alias("c")).collect()
    assert [r.c for r in rows] == pytest.approx([0, 1, 0.92, 0.4 * math.log(2) / math.log(4) + 0.2 + 0.1])


def test_currency(spark):
    urls = ["https://oneblockdown.it/x", "https://www.dope-factory.com:443/", "https://shop.com", "https://a.co.uk/p", None, "nothing"]
    assert values(spark, N.detect_currency, urls) == ["EUR", "KRW", None, "GBP", None, None]


def test_prices(spark):
    rates = spark.createDataFrame([("EUR", "0.92"), ("GBP", "0.79"), ("KRW", "1320")], "currency string, rate string")
    rows = [(1, "590000", "https://x.com", "KRW"), (2, "100", "https://x.com", "EUR"), (3, "100", "https://x.com", "USD"), (4, "100", "https://x.com", "XYZ"), (5, "100", "https://x.com", "GBP"), (6, "5", "https://x.jp", None), (7, None, "https://x.de", None)]
    df = spark.createDataFrame(rows, "k int, price string, url string, api_currency string")
    got = {r.k: r for r in N.normalize_prices(df, rates).collect()}
    assert 400 < got[1].usd_price < 500 and float(got[2].usd_price) == 108.70 and got[3].usd_price == 100 and got[3].rate == 1
    assert got[4].usd_price is None and got[4].currency == "UNKNOWN" and got[4].reject_reason == "unknown_currency"
    assert float(got[5].usd_price) == 126.58 and got[6].reject_reason == "missing_rate" and got[7].usd_price is None
    quotes = spark.createDataFrame([("USD", 1.25), ("GBP", 1.0)], "currency string, rate double")
    assert [(r.currency, float(r.rate)) for r in N.rebase_rates_to_usd(quotes).collect()] == [("GBP", 0.8)]


def test_gtin(spark):
    codes = ["4006381333931", "4006381333932", "123", "abc", None, "96385074", "036000291452", "10614141000415"]
    assert values(spark, N.valid_gtin, codes) == [True, False, False, False, False, True, True, True]
    assert values(spark, N.gtin_type, codes)[-3:] == ["EAN-8", "UPC-A", "GTIN-14"]


def test_sizes(spark):
    raw = ["04.5B", "06.5M", "Sz 11", "$100", "*", "0-12MO", "", None, "L", "10,50 W", "007"]
    assert values(spark, N.normalize_size, raw) == ["4.5W", "6.5M", "11", None, None, "0K", None, None, None, "10.5W", "7"]


def test_colours(spark):
    raw = ["Black", "00000 Black", "Nero", "200 WHITE/BLACK", "Men", "XL", "8", None, "blackened", "10.5M", "navy blue"]
    assert values(spark, N.normalize_color, raw) == ["BLACK", "BLACK", "BLACK", "MULTI", None, None, None, None, None, None, "BLUE"]


def test_gender(spark):
    raw = ["Air Max GS", "Dunk (W) Low", "Jordan Men's", "Tee unisex", "Men in Black tee", "Card PSA 10 GS", None, "Boot"]
    assert values(spark, N.normalize_gender_age, raw) == ["KIDS", "WOMEN", "MEN", "UNISEX", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_names_and_regions(spark):
    assert values(spark, N.strip_accents, ["Café Ñ", None, "plain"]) == ["Cafe N", None, "plain"]
    assert values(spark, N.store_name, ["https://www.a-ma.it/x", "https://Shop.com"]) == ["A-Ma.It", "Shop"]
    assert values(spark, N.detect_region_full, ["x.co.uk", "x.com", "x.com.au"]) == ["GB", "US", "AU"]
    assert values(spark, N.detect_region, ["x.co.uk", "x.com"]) == ["GB", None]
    assert values(spark, lambda c: M.brand_key(c, F.lit("By Far")), ["", None, "A.P.C."]) == ["far", "far", "apc"]
    assert values(spark, lambda c: N.extract_brand(c, F.lit(" Nike Air")), ["", None, "Puma"]) == ["Nike", "Nike", "Puma"]


def test_eligible_sku(spark):
    raw = ["ABC-123", "one size", "1234", "123456", "12345678", "123456789012", " x1 ", "1234567890123"]
    assert values(spark, M.eligible_sku, raw) == [True, False, False, False, False, True, False, True]


def test_sale_prices(spark):
    now = F.lit("2024-05-05").cast("timestamp")
    rows = [(10.0, 8.0, "2024-05-01", "2024-06-01"), (10.0, 8.0, "2024-05-06", None), (10.0, 12.0, None, None), (10.0, 8.0, "rubbish", "rubbish"), (10.0, None, None, None)]
    df = spark.createDataFrame(rows, "p double, s double, a string, b string")
    assert [r.x for r in df.select(S.special_price_active(F.col("p"), F.col("s"), F.col("a"), F.col("b"), now).alias("x")).collect()] == [True, False, False, True, False]
    df = spark.createDataFrame([("50%_off",), ("50 off",)], "name string")
    assert df.where(S.contains_text("%_O", "name")).count() == 1


STORES = [(1, "one", 90.0), (2, "two", 50.0), (3, "three", 20.0)]


def test_scores(spark):
    stores = spark.createDataFrame(STORES, "store_id int, name string, reliability_score double")
    offers = spark.createDataFrame([(7, 1, 100.0, True), (7, 2, 120.0, True), (8, 1, 100.0, False), (9, 1, 90000.0, True)], "canonical_id int, store_id int, current_price double, in_stock boolean")
    history = spark.createDataFrame([], "canonical_id int, median double, p10 double, p90 double, least double, most double, total_days double, current_price double, days_since_update double, intervals long")
    got = {r.canonical_id: r for r in C.deal_score_v2(offers, stores, history).collect()}
    assert 0 <= got[7].deal_score <= 100 and got[7].best_price == 100
    assert got[8].classification == "OUT OF STOCK" and got[9].classification == "SANITY REJECT" and got[9].deal_score == 0
    canonical = {r.canonical_id: r.classification for r in C.deal_score_canonical(offers).collect()}
    assert canonical[8] == "OUT_OF_STOCK"


def test_upserts(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    old = spark.createDataFrame([(1, 1, 10.0, True, at(1)), (2, 1, 5.0, True, at(1))], "variant_id int, store_id int, current_price double, in_stock boolean, updated_at timestamp")
    new = spark.createDataFrame([(1, 1, 8.0, True, at(2)), (3, 1, 7.0, False, at(2))], old.schema)
    assert {(r.variant_id, r.current_price, r.old_price) for r in U.upsert_offers(old, new).collect()} == {(1, 8.0, None), (2, 5.0, None), (3, 7.0, None)}
    stated = spark.createDataFrame([(1, 1, 8.0, 12.0, at(2), "u1"), (1, 1, 1.5, None, at(3), "too low"), (2, 1, 25000.0, None, at(2), "insane"), (2, 1, 4.0, 6.0, at(0 + 1), "older"), (4, 1, 9.0, 9.5, at(2), "a"), (4, 1, 90.0, 9.5, at(3), "b")], "variant_id int, store_id int, current_price double, old_price double, updated_at timestamp, url string")
    got = {r.variant_id: (r.current_price, r.old_price, r.url, r.in_stock) for r in U.upsert_offers(old, stated).collect()}
    assert got == {1: (8.0, 12.0, "u1", None), 2: (4.0, 6.0, "older", None), 4: (9.0, 9.5, "a", None)}
    outcomes = {(r.variant_id, r.current_price): r.outcome for r in U.import_outcomes(old, stated).collect()}
    assert outcomes == {(1, 8.0): "updated", (1, 1.5): "skipped", (2, 25000.0): "skipped", (2, 4.0): "updated", (4, 9.0): "imported", (4, 90.0): "skipped"}
    brands = spark.createDataFrame([(4, "Café"), (2, "CAFE "), (9, "Other")], "brand_id int, name string")
    assert {(r.brand_id, r.survivor) for r in U.merge_brands(brands).collect()} == {(4, 2), (2, 2), (9, 9)}


def test_prices_are_held_against_the_last_accepted_one(spark):
    at = lambda minute: dt.datetime(2024, 1, 2, 0, minute)
    kinds = "variant_id long, store_id long, current_price double, updated_at timestamp, reject_reason string"
    rows = [(1, 1, p, at(k), None) for k, p in enumerate((10.0, 9.0, 90.0, 12.0, None))] + [(2, 1, 10.0, at(0), None), (2, 1, 9.0, at(0), None), (2, 1, 30.0, at(1), "unknown_currency"), (3, 1, 40.0, at(1), None), (3, 1, 39.0, at(2), None)]
    old = spark.createDataFrame([(3, 1, 5.0), (4, 1, 6.0), (5, 1, None)], "variant_id long, store_id long, current_price double")
    df = spark.createDataFrame(rows, kinds).repartition(3)
    got = sorted((r.variant_id, r.updated_at.minute, r.current_price or 0.0, r.outcome) for r in U.import_outcomes(old, df).collect())
    assert got == [
        (1, 0, 10.0, "imported"), (1, 1, 9.0, "updated"), (1, 2, 90.0, "skipped"), (1, 3, 12.0, "updated"), (1, 4, 0.0, "rejected"),
        (2, 0, 9.0, "updated"), (2, 0, 10.0, "imported"), (2, 1, 30.0, "rejected"), (3, 1, 40.0, "skipped"), (3, 2, 39.0, "skipped"),
    ]
    offers = {r.variant_id: r.current_price for r in U.upsert_offers(old, df).collect()}
    assert offers == {1: 12.0, 2: 9.0, 3: 5.0, 4: 6.0, 5: None}
    assert sorted((r.variant_id, r.current_price) for r in U.accepted(df.drop("reject_reason"), "current_price", "updated_at").collect()) == [(1, 9.0), (1, 10.0), (1, 12.0), (2, 9.0), (2, 10.0), (2, 30.0), (3, 39.0), (3, 40.0)]
    assert U.upsert_offers(old, df.limit(0)).count() == 3


def test_an_upsert_rewrites_only_the_buckets_it_falls_into(spark, tmp_path):
    path, at = str(tmp_path / "offers"), dt.datetime(2024, 1, 2)
    kinds = "variant_id long, store_id long, current_price double, updated_at timestamp"
    old = spark.createDataFrame([(k, k % 7, 10.0, at) for k in range(200)], kinds)
    U.write_offers(old, path, 16)
    stamps = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    before = stamps()
    lot = spark.createDataFrame([(5, 5, 12.0, at), (5, 5, 900.0, at), (1000, 1, 3.0, at)], kinds)
    U.merge_offers(lot, path, 16)
    after = stamps()
    touched = {f.split("/")[1] for f in before.keys() ^ after.keys()}
    want = {f"bucket={r.b}" for r in lot.select(U.offer_bucket(16).alias("b")).distinct().collect()}
    assert touched == want and all(before[f] == after[f] for f in before.keys() & after.keys())
    whole = lambda df: sorted(tuple(r) for r in df.select("variant_id", "store_id", "current_price").collect())
    assert whole(spark.read.parquet(path)) == whole(U.upsert_offers(old, lot))
    U.merge_offers(lot.limit(0), path, 16)
    assert stamps() == after


def test_stores_that_come_twice(spark):
    old = spark.createDataFrame([(1, "a", "a.de", "EUR"), (2, "b", "b.de", "EUR"), (3, "b", "bb.de", "EUR")], "store_id long, name string, domain string, currency string")
    new = [("x", "n.de", "USD"), ("y", "n.de", "EUR"), ("a", "a.de", "USD"), ("b", "b2.fr", "USD"), ("b", "b1.fr", "GBP"), ("z", "z.com", "USD")]
    got = sorted(tuple(r)[1:] for r in U.upsert_stores(old, spark.createDataFrame(new, "name string, domain string, currency string"), N.detect_region).collect())
    assert got == [("a", "a.de", "EUR", None), ("b", "b1.fr", "GBP", None), ("b", "bb.de", "EUR", None), ("x", "n.de", "USD", "DE"), ("z", "z.com", "USD", None)]


def test_collated_brands_are_those_of_the_decomposition(spark):
    names = ["Café", "CAFE ", "cafe\u0301", "Ångström", "angstrom", "ANGSTRÖM", "Zoë", "zoe", "Zo e", "", " ", None, None, "O'Neill", "ONeill", "Ñu", "nu", "İstanbul", "istanbul"]
    brands = spark.createDataFrame(list(enumerate(names)), "brand_id int, name string")
    plan = U.merge_brands(brands)
    got = {r.brand_id: r.survivor for r in plan.collect()}
    key = F.lower(N.strip_accents(F.trim("name")))
    groups = {}
    for r in brands.select("brand_id", key.alias("key")).orderBy("brand_id").collect():
        groups.setdefault(r.key if r.key is not None else r.brand_id, []).append(r.brand_id)
    assert got == {k: ids[0] for ids in groups.values() for k in ids}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    products = spark.createDataFrame([(100, 1, "p"), (101, 7, "q"), (102, 99, "r")], "product_id int, brand_id int, name string")
    moved, gone = U.repoint_products(products, plan)
    assert sorted(tuple(r) for r in moved.collect()) == [(100, 0, "p"), (101, 6, "q"), (102, 99, "r")] and 1 in {r.brand_id for r in gone.collect()}


def test_counters_are_observed_on_the_write(spark, tmp_path):
    rows = [("imported", "USD"), ("updated", "EUR"), ("skipped", "EUR"), ("rejected", "KRW"), ("updated", "USD")]
    df = spark.createDataFrame(rows, "outcome string, original_currency string")
    assert U.write_counted(df, str(tmp_path / "log")) == {"imported": 1, "updated": 2, "skipped": 1, "converted": 2, "rejected": 1}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_counters_of_a_running_import(spark, tmp_path):
    import time

    from pricelode.streaming import streams as T

    rows = [("imported", "USD"), ("updated", "EUR"), ("skipped", "EUR"), ("rejected", "KRW"), ("updated", "USD")] * 4
    df = spark.createDataFrame(rows, "outcome string, original_currency string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    watch = T.ImportWatch()
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = T.observed_import(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        for _ in range(100):
            if sum(watch.counts.values()) >= 28:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert watch.counts == {"imported": 4, "updated": 8, "skipped": 4, "converted": 8, "rejected": 4}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_late_observations_amend_intervals(spark):
    from pricelode.operators import intervals as I

    at = lambda d: dt.datetime(2024, 1, d)
    kinds = "variant_id long, store_id long, product_id long, ts timestamp, price double"
    soon = spark.createDataFrame([(1, 1, 7, at(1), 10.0), (1, 1, 7, at(5), 10.0), (1, 1, 7, at(9), 12.0), (2, 1, 8, at(1), 5.0)], kinds)
    late = spark.createDataFrame([(1, 1, 7, at(3), 11.0), (3, 1, 9, at(2), 4.0)], kinds)
    changes = I.build_price_intervals(soon)
    got = sorted((r.variant_id, r.started_at.day, r.ended_at and r.ended_at.day, r.price, r.old_price) for r in I.amend_price_intervals(changes, soon, late).collect())
    assert got == [(1, 1, 3, 10.0, None), (1, 3, 5, 11.0, 10.0), (1, 5, 9, 10.0, 11.0), (1, 9, None, 12.0, 10.0), (2, 1, None, 5.0, None), (3, 2, None, 4.0, None)]


def test_platforms(spark):
    pages = ["<script src='//CDN.SHOPIFY.com/a.js'>", "<link href='/wp-content/plugins/WooCommerce/x.css'>", "x Mage/Cookies", "powered by Magento", "<img src=/static/version12/a.png>", "shopify.com and magento", "plain", "", None]
    assert values(spark, N.platform, pages) == ["shopify", "woocommerce", "magento", "magento", "magento", "shopify", "custom", "custom", "custom"]


def test_overlaps_are_pairs(spark):
    from pricelode.operators import intervals as I

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 5.0, at(1), at(9)), (1, 1, 6.0, at(3), at(4)), (1, 1, 7.0, at(5), None), (1, 1, 8.0, at(9), None), (2, 1, 5.0, at(1), at(2)), (2, 1, 6.0, at(2), None), (3, 1, 5.0, at(1), None), (3, 1, 6.0, at(1), None)]
    changes = spark.createDataFrame(rows, "variant_id int, store_id int, price double, started_at timestamp, ended_at timestamp")
    got = sorted((r.variant_id, r.first_price, r.second_price) for r in I.overlap_pairs(changes, F.lit(at(20))).collect())
    assert got == [(1, 5.0, 6.0), (1, 5.0, 7.0), (1, 7.0, 8.0)]
    assert I.overlapping(changes, F.lit(at(20))).count() == 3


def test_global_rank(spark):
    df = spark.createDataFrame([(k, float(k * 7 % 50) if k % 9 else None) for k in range(300)], "k int, x double").repartition(7)
    got = [r.k for r in S.global_rank(df, "place", F.col("x").desc_nulls_last(), F.col("k")).orderBy("place").collect()]
    want = sorted(range(300), key=lambda k: (k % 9 == 0, -(k * 7 % 50) if k % 9 else 0, k))
    assert got == want


def test_merges_and_splits_of_variants(spark):
    remap = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "variant_id int, keep int")
    matches = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.95), (3, 9, 0.7)], "canonical_variant_id int, matched_variant_id int, confidence_score double")
    assert sorted(tuple(r) for r in U.dedup_matches(remap, matches).collect()) == [(1, 3, 0.95), (3, 9, 0.7)]
    variants = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "variant_id long, name string").withColumn("store_id", F.lit(None).cast("int"))
    fact = lambda *rows: spark.createDataFrame(list(rows), "variant_id long, store_id int, x int")
    v, offers, changes, history = U.split_tables(variants, fact((1, 5, 10), (1, 4, 11)), fact((1, 5, 12)), fact((2, 7, 13)))
    got = {(r.store_id, r.name): r.variant_id for r in v.collect()}
    clone = got[5, "a"]
    assert got == {(4, "a"): 1, (5, "a"): clone, (7, "b"): 2} and clone not in (1, 2)
    assert {tuple(r) for r in offers.collect()} == {(clone, 5, 10), (1, 4, 11)} and [tuple(r) for r in changes.collect()] == [(clone, 5, 12)] and [tuple(r) for r in history.collect()] == [(2, 7, 13)]
