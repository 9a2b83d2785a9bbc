"""Every query with SQL against DuckDB on the smallest tables; streams against their batch twins are among them."""

import math
from decimal import Decimal

import duckdb
import pytest

from pricelode.operators.shaping import top_per
from pricelode.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "null" if math.isnan(value) else f"{float(value):.9g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, oracle, name):
    df = registry.queries()[name](spark, FOLDER)
    want = oracle.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_queries_without_sql_run(spark):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, FOLDER).count() > 0


def test_no_cartesian_product_in_the_flagship(spark):
    plan = registry.queries()["find_best_deals"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_cooldown_keeps_what_a_loop_keeps(spark):
    got = {r.alert_id for r in registry.queries()["stream_alert_cooldown"](spark, FOLDER).collect()}
    rows = duckdb.sql(f"SELECT user_id, event_id, epoch_us(ts), floor(value * 100 + 0.5) / 100 FROM '{FOLDER}/events.parquet' WHERE event_type = 'purchase' ORDER BY ts, event_id").fetchall()
    sent, want = {}, set()
    for user, alert, at, price in rows:
        recent = [p for t, p in sent.get(user, []) if t > at - 86_400_000_000]
        if not recent or price < 0.95 * min(recent):
            want.add(alert)
            sent.setdefault(user, []).append((at, price))
    assert got == want


def test_flagship_scans_each_table_once(spark):
    plan = registry.queries()["find_best_deals"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 10


def test_deals_without_canonical_offers(spark):
    from pyspark.sql import functions as F

    from pricelode.operators import scoring as C
    from pricelode.plans.fixtures import Fixtures

    fx = Fixtures(spark, FOLDER, hold=True)
    history = C.weighted_history(fx.members, fx.changes, fx.as_of)
    stores = lambda **k: {r.canonical_id: r.store_count for r in C.best_deals(fx.member_offers, fx.stores, history, 10**6, **k).collect()}
    whole, less = stores(), stores(include_canonical=False)
    own = {r.canonical_id for r in fx.member_offers.where(F.col("variant_id") == F.col("canonical_id")).collect()}
    assert less and all(less[c] == whole[c] - (c in own) for c in less.keys() & whole.keys())


def test_shared_stores_are_looked_for_in_all_products(spark, oracle):
    got = {tuple(r) for r in registry.queries()["anti_shared_store_all"](spark, FOLDER).collect()}
    matches = oracle.sql(registry.oracle_sql()["match_products"]).fetchall()
    want = {(a, b) for a, b, *_ in matches if a % 100_000 % 5 != b % 100_000 % 5}
    assert got == want and any(a // 100_000 >= 50 for a, _ in got) and len(want) < len(matches)


def test_offers_of_every_product_are_sorted(spark):
    got = [tuple(r) for r in registry.queries()["sorted_offers_all"](spark, FOLDER).select("product_id", "current_price", "variant_id").collect()]
    assert got == sorted(got)
    assert {p for p, _, _ in got} == {p for (p,) in duckdb.sql(f"SELECT DISTINCT l_partkey FROM '{FOLDER}/lineitem.parquet'").fetchall()}


def test_cap_keeps_the_first_of_each_store(spark):
    rows = [(s, v) for s in (1, 2, 3) for v in range(s * 4)]
    got = top_per(spark.createDataFrame(rows, "store_id long, variant_id long"), ["store_id"], 5, "variant_id").collect()
    assert sorted((r.store_id, r.variant_id, r["rank"]) for r in got) == [(s, v, v + 1) for s, v in rows if v < 5]


def test_cap_of_the_reference_is_above_50(spark):
    got = registry.queries()["cap_products_per_store_50000"](spark, FOLDER).agg({"rank": "max", "*": "count"}).first()
    assert got["max(rank)"] > 50 and got["count(1)"] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()


def test_every_clause_of_matching_matters(spark):
    from pricelode.operators import matching as M
    from pricelode.plans.fixtures import Fixtures

    fx = Fixtures(spark, FOLDER, hold=True)
    variants, offers = fx.kept(fx.odd_variants, "odd"), fx.kept(fx.odd_offers, "oddoffers")
    pairs = lambda **k: {tuple(r) for r in M.match_candidates(variants, offers, **{"apart": True, **k}).collect()}
    whole = pairs()
    assert len(whole) > 50
    for name in M.match_clauses():
        if name == "not itself":
            continue  # a variant always shares a store with itself, so this clause only saves work once stores are compared
        assert pairs(without=(name,)) != whole, name
    assert pairs(apart=False) != whole and pairs(apart=False, without=("not itself",)) != pairs(apart=False)
    # Split skus give the same matches.
    assert pairs(hot=2) == whole
    plain = {r.variant_id for r in fx.odd_variants.join(fx.offers, "variant_id").select("variant_id").distinct().collect()}
    assert {r.variant_id for r in registry.queries()["filter_eligible_sku"](spark, FOLDER).collect()} < plain


def test_quantiles_of_hot_groups(spark):
    from pyspark.sql import functions as F

    from pricelode.functions import statistics as T

    rows = [(0, float(v % 977) / 4, 1 + v % 5) for v in range(6000)] + [(g, float(v), w) for g, v, w in ((1, 5, 3), (1, 7, 3), (2, -4, 1), (2, 0, 1), (2, 3, 1), (2, -8, 1), (3, 9, 0), (4, 1, 10), (4, 100, 1))] + [(5, None, 4), (5, 2.0, 1)]
    df = spark.createDataFrame(rows, "g int, v double, w long").repartition(5)
    got = {r.g: (r.a, r.b, r.c) for r in T.weighted_quantile(df, ["g"], "v", "w", [(1, 2), (1, 10), (9, 10)], ["a", "b", "c"]).collect()}
    want = {}
    for g in range(6):
        own = sorted((v, w) for k, v, w in rows if k == g and v is not None)
        total, out = sum(w for _, w in own), []
        for num, den in ((1, 2), (1, 10), (9, 10)):
            out.append(next(v for at, (v, _) in enumerate(own) if sum(w for x, w in own if x <= v) * den >= total * num))
        want[g] = tuple(out)
    assert got == want
    # A third of all rows in one group: what one window sees is the values of one band.
    bands = df.where("g = 0").groupBy(T.value_band(F.col("v")).alias("b")).agg(F.count_distinct("v").alias("n"))
    assert bands.agg(F.max("n")).first()[0] < 60
    edges = spark.createDataFrame([(float(x),) for x in (-1e300, -5, -1e-9, 0, 1e-13, 0.01, 0.011, 3, 3.2, 1e300)], "v double")
    order = [r.b for r in edges.select(T.value_band(F.col("v")).alias("b"), "v").orderBy("v").collect()]
    assert order == sorted(order)
