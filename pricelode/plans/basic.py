"""Queries: scans, filters, joins, rankings, set operations, windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.functions import normalize as N
from pricelode.functions.statistics import sane
from pricelode.operators import alerts as A
from pricelode.operators import intervals as I
from pricelode.operators import matching as M
from pricelode.operators import shaping as S
from pricelode.session import held, shared_folder
from pricelode.sources import tables as K

from .catalog import query
from .fixtures import BROKEN_CHANGES

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(col):
    return F.date_format(col, STAMP)


@query("scan_tables", "SELECT variant_id, store_id, current_price, in_stock, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM fx_offers WHERE in_stock AND current_price > 100")
def scan_tables(fx):
    """Offers written as files, and scanned under their declared schema."""
    folder = shared_folder(fx.spark, "offers")
    K.conform(fx.offers, "offers").write.parquet(folder)
    return K.scan(fx.spark, folder, "offers").where("in_stock and current_price > 100").select("variant_id", "store_id", "current_price", "in_stock", stamp("updated_at").alias("updated_at"))


@query("filter_eligible_sku", "SELECT variant_id, nsku AS sku FROM fx_odd_norm")
def filter_eligible_sku(fx):
    """Of variants with planted skus that say nothing."""
    return M.normalized_variants(fx.odd_variants, fx.odd_offers).select("variant_id", "sku")


@query("filter_sane_price", "SELECT variant_id, current_price FROM fx_offers WHERE current_price > 0 AND current_price <= 20000")
def filter_sane_price(fx):
    return fx.offers.where(sane(F.col("current_price"))).select("variant_id", "current_price")


@query("filter_plausible_change", "SELECT variant_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, price FROM fx_changes WHERE old_price IS NULL OR old_price <= 0 OR price::DOUBLE / old_price::DOUBLE BETWEEN 0.25 AND 4")
def filter_plausible_change(fx):
    return fx.changes.where(S.plausible_change(F.col("price"), F.col("old_price"))).select("variant_id", stamp("started_at").alias("started_at"), "price")


@query("filter_in_stock", "SELECT product_id, coalesce(min(current_price) FILTER (in_stock), min(current_price)) AS best_price, count(*) FILTER (in_stock) AS in_stock FROM fx_offers GROUP BY product_id")
def filter_in_stock(fx):
    p = F.col("current_price")
    return fx.offers.groupBy("product_id").agg(F.coalesce(F.min(F.when(F.col("in_stock"), p)), F.min(p)).alias("best_price"), F.count_if("in_stock").alias("in_stock"))


@query("search_catalogue", "SELECT variant_id, sku, brand FROM fx_variants JOIN fx_products USING (product_id, brand) WHERE canonical_name ILIKE '%red%' OR sku ILIKE '%sku-0001%' OR brand ILIKE '%#12%'")
def search_catalogue(fx):
    rows = fx.variants.join(fx.products, ["product_id", "brand"])
    return rows.where(S.contains_text("red", "canonical_name") | S.contains_text("sku-0001", "sku") | S.contains_text("#12", "brand")).select("variant_id", "sku", "brand")


@query("filter_recent", "SELECT count(*) FILTER (updated_at > $AS_OF - INTERVAL 24 HOUR) AS day, count(*) FILTER (updated_at > $AS_OF - INTERVAL 7 DAY) AS week, count(*) FILTER (updated_at > $AS_OF - INTERVAL 30 DAY) AS month FROM fx_offers")
def filter_recent(fx):
    since = lambda text: F.count_if(F.col("updated_at") > fx.as_of - F.expr(f"INTERVAL {text}"))
    return fx.offers.agg(since("24 HOURS").alias("day"), since("7 DAYS").alias("week"), since("30 DAYS").alias("month"))


@query("cap_products_per_store", "SELECT store_id, variant_id, row_number() OVER (PARTITION BY store_id ORDER BY variant_id) AS rank FROM fx_offers QUALIFY rank <= 50000")
def cap_products_per_store(fx):
    return S.top_per(fx.offers, ["store_id"], 50_000, "variant_id").select("store_id", "variant_id", F.col("rank").cast("long").alias("rank"))


@query("cap_products_per_store_50000", "SELECT store_id, variant_id, row_number() OVER (PARTITION BY store_id ORDER BY variant_id) AS rank FROM fx_offers QUALIFY rank <= 50000")
def cap_products_per_store_50000(fx):
    """At the reference's cap."""
    return S.top_per(fx.offers, ["store_id"], 50_000, "variant_id").select("store_id", "variant_id", F.col("rank").cast("long").alias("rank"))


_SPECIAL = "l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS special"


@query(
    "special_price_active",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice * (1 - l_discount) < l_extendedprice AND TIMESTAMP '1995-06-17' BETWEEN CAST(l_shipdate AS TIMESTAMP) AND CAST(l_shipdate AS TIMESTAMP) + INTERVAL 30 DAY
       THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 4) AS current_price FROM lineitem""",
)
def special_price_active(fx):
    li = fx.table("lineitem")
    price, special, now = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")), F.lit("1995-06-17").cast("timestamp")
    start, end = F.date_format("l_shipdate", STAMP), F.date_format(F.date_add("l_shipdate", 30), STAMP)
    return li.select("l_orderkey", "l_linenumber", F.round(F.when(S.special_price_active(price, special, start, end, now), special).otherwise(price), 4).alias("current_price"))


@query(
    "unlabeled_matches",
    """SELECT m.canonical_variant_id, m.matched_variant_id, match_method AS stratum, a.sku, a.brand AS brand_a, b.brand AS brand_b, s.name AS store_a, t.name AS store_b, a.size AS size_a, b.size AS size_b, a.color AS color_a, b.color AS color_b, o.current_price AS price_a, p.current_price AS price_b
 FROM fx_matches m JOIN fx_variants a ON a.variant_id = m.canonical_variant_id JOIN fx_variants b ON b.variant_id = m.matched_variant_id JOIN fx_stores s ON s.store_id = a.store_id JOIN fx_stores t ON t.store_id = b.store_id
 JOIN fx_offers o ON o.variant_id = a.variant_id JOIN fx_offers p ON p.variant_id = b.variant_id WHERE (m.canonical_variant_id + m.matched_variant_id) % 4 <> 0""",
    hold=True,
)
def unlabeled_matches(fx):
    """A quarter of the matches have a label; the rest wait, by stratum."""
    keys = ["canonical_variant_id", "matched_variant_id"]
    labels = fx.matches.where("(canonical_variant_id + matched_variant_id) % 4 = 0").select(*keys, F.lit(1).alias("label"))
    return A.match_queue(fx.matches, labels, fx.variants, fx.offers, fx.stores)


@query("join_offer_context", "SELECT o.variant_id, s.name, s.currency, v.sku, v.gender, p.canonical_name, p.category, o.current_price FROM fx_offers o JOIN fx_stores s USING (store_id) JOIN fx_variants v ON v.variant_id = o.variant_id JOIN fx_products p ON p.product_id = o.product_id")
def join_offer_context(fx):
    return S.offer_context(fx.offers, fx.stores, fx.variants, fx.products).select("variant_id", "name", "currency", "sku", "gender", "canonical_name", "category", "current_price")


def keyed(fx, name, df):
    """A fixture as a keyed table of eight buckets, and the name it has in the catalog."""
    folder = shared_folder(fx.spark, name)
    table = "keyed_" + folder.rsplit("-", 1)[-1]
    K.write_keyed(df, name, folder, table, 8)
    return table


@query("scan_keyed_offers", "SELECT variant_id, store_id, current_price, in_stock FROM fx_offers WHERE variant_id IN (SELECT max(variant_id) FROM fx_offers UNION ALL SELECT min(variant_id) FROM fx_offers)")
def scan_keyed_offers(fx):
    """The offers of the first and the last variant, from the buckets that hold them."""
    table = keyed(fx, "offers", fx.offers)
    ends = fx.spark.table(table).agg(F.min("variant_id"), F.max("variant_id")).first()
    return K.scan_keys(fx.spark, "offers", table, list(ends)).select("variant_id", "store_id", "current_price", "in_stock")


@query("join_keyed_context", "SELECT o.variant_id, o.store_id, o.current_price, v.sku, c.price AS open_price FROM fx_offers o JOIN fx_variants v USING (variant_id) LEFT JOIN fx_changes c ON c.variant_id = o.variant_id AND c.store_id = o.store_id AND c.ended_at IS NULL")
def join_keyed_context(fx):
    """Offers with their variants and open intervals, three tables bucketed alike: no exchange on variant_id."""
    offers, variants, changes = (fx.spark.table(keyed(fx, name, df)) for name, df in (("offers", fx.offers), ("variants", fx.variants), ("price_changes", fx.changes)))
    # Sorted buckets are merged as they lie; without the hint small tables would be broadcast.
    v = variants.select("variant_id", "sku").hint("merge")
    open_ = changes.where("ended_at is null").select("variant_id", F.col("store_id").alias("c_store"), F.col("price").alias("open_price")).hint("merge")
    rows = offers.join(v, "variant_id").join(open_, (offers.variant_id == open_.variant_id) & (F.col("store_id") == F.col("c_store")), "left").drop(open_.variant_id)
    return rows.select("variant_id", "store_id", "current_price", "sku", "open_price")


@query("join_brand_canonical", "SELECT p_partkey AS product_id, coalesce('canonical ' || right(p_brand, 1), p_brand) AS brand FROM part WHERE CAST(right(p_brand, 1) AS INTEGER) > 2 UNION ALL SELECT p_partkey, p_brand FROM part WHERE CAST(right(p_brand, 1) AS INTEGER) <= 2")
def join_brand_canonical(fx):
    aliases = fx.products.select("brand").distinct().where(F.right(F.col("brand"), F.lit(1)).cast("int") > 2).select("brand", F.concat(F.lit("canonical "), F.right(F.col("brand"), F.lit(1))).alias("canonical"))
    return fx.products.join(aliases, "brand", "left").select("product_id", F.coalesce("canonical", "brand").alias("brand"))


@query("join_canonical_self", "SELECT n.variant_id, c.variant_id AS canonical, n.size IS NOT DISTINCT FROM c.size AS same_size FROM fx_norm n JOIN (SELECT * FROM fx_norm QUALIFY row_number() OVER (PARTITION BY nsku ORDER BY quality DESC, variant_id) = 1) c ON c.nsku = n.nsku")
def join_canonical_self(fx):
    norm = M.normalized_variants(fx.variants, fx.offers)
    return norm.join(M.match_group_stats(norm), "sku").select("variant_id", F.col("canonical.variant_id").alias("canonical"), F.col("size").eqNullSafe(F.col("canonical.size")).alias("same_size"))


@query("anti_conflicting_ean", "SELECT n.variant_id FROM fx_norm n WHERE NOT EXISTS (SELECT 1 FROM fx_norm m WHERE m.nsku = n.nsku AND m.variant_id <> n.variant_id AND m.ean IS NOT NULL AND n.ean IS NOT NULL AND m.ean <> n.ean)")
def anti_conflicting_ean(fx):
    norm = M.normalized_variants(fx.variants, fx.offers)
    return norm.join(M.match_group_stats(norm), "sku").where(F.col("ean").isNull() | ~F.coalesce("ean_conflict", F.lit(False))).select("variant_id")


@query(
    "anti_shared_store",
    "SELECT m.canonical_variant_id, m.matched_variant_id FROM fx_matches m JOIN fx_offers a ON a.variant_id = m.canonical_variant_id JOIN fx_offers b ON b.variant_id = m.matched_variant_id WHERE a.store_id % 3 <> b.store_id % 3",
    hold=True,
)
def anti_shared_store(fx):
    """Every candidate pair, without those whose offers share one of three groups of stores."""
    pairs = M.match_candidates(fx.variants, fx.offers).select("canonical_variant_id", "matched_variant_id")
    grouped = fx.offers.withColumn("store_id", F.col("store_id") % 3)
    return pairs.join(M.shared_store_pairs(pairs, grouped), pairs.columns, "left_anti")


@query(
    "anti_shared_store_all",
    "SELECT m.canonical_variant_id, m.matched_variant_id FROM fx_matches m JOIN fx_offers a ON a.variant_id = m.canonical_variant_id JOIN fx_offers b ON b.variant_id = m.matched_variant_id WHERE a.store_id % 5 <> b.store_id % 5",
    hold=True,
)
def anti_shared_store_all(fx):
    """Every candidate pair of a sku's canonical variant, without those that share a region of stores."""
    pairs = M.match_candidates(fx.variants, fx.offers).select("canonical_variant_id", "matched_variant_id")
    regional = fx.offers.withColumn("store_id", F.col("store_id") % 5)
    return pairs.join(M.shared_store_pairs(pairs, regional), pairs.columns, "left_anti")


@query("join_disjunctive_or", "SELECT m.canonical_variant_id AS canonical_id, o.variant_id FROM (SELECT DISTINCT canonical_variant_id FROM fx_matches) c JOIN fx_matches m USING (canonical_variant_id) JOIN fx_offers o ON o.variant_id = m.canonical_variant_id OR o.variant_id = m.matched_variant_id GROUP BY ALL", hold=True)
def join_disjunctive_or(fx):
    return fx.member_offers.select("canonical_id", "variant_id")


@query(
    "join_adjacent_interval",
    "SELECT c.variant_id, c.price, o.price AS prev_price, strftime(c.started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM fx_changes c JOIN fx_changes o ON o.variant_id = c.variant_id AND o.store_id = c.store_id AND o.ended_at = c.started_at WHERE c.ended_at IS NULL AND o.price > c.price",
)
def join_adjacent_interval(fx):
    return I.adjacent_drops(fx.changes).select("variant_id", "price", "prev_price", stamp("started_at").alias("started_at"))


@query(
    "join_overlap_check",
    f"""WITH {BROKEN_CHANGES},
 fx_reach AS (SELECT *, max(coalesce(ended_at, $AS_OF)) OVER (PARTITION BY variant_id, store_id ORDER BY started_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS reach FROM fx_broken)
 SELECT b.variant_id, b.store_id, a.price AS first_price, b.price AS second_price, strftime(a.started_at, '%Y-%m-%d %H:%M:%S') AS first_started, strftime(b.started_at, '%Y-%m-%d %H:%M:%S') AS second_started
 FROM (SELECT * FROM fx_reach WHERE reach > started_at) b JOIN fx_broken a USING (variant_id, store_id) WHERE a.started_at < b.started_at AND b.started_at < coalesce(a.ended_at, $AS_OF)""",
    hold=True,
)
def join_overlap_check(fx):
    """Pairs of intervals that overlap, of changes with planted violations."""
    return I.overlap_pairs(fx.broken_changes, fx.as_of).select("variant_id", "store_id", "first_price", "second_price", stamp("first_started").alias("first_started"), stamp("second_started").alias("second_started"))


@query("anti_new_stores", "SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages WHERE regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') NOT IN (SELECT domain FROM fx_stores)")
def anti_new_stores(fx):
    sites = fx.pages.select(F.regexp_replace(N.url_host(F.col("url")), r"^www\.", "").alias("domain")).distinct()
    return sites.join(fx.stores.select(F.regexp_replace("domain", r"^www\.", "").alias("domain")), "domain", "left_anti")


@query("anti_unlabeled_alerts", "SELECT alert_id FROM fx_alerts a LEFT JOIN (SELECT alert_id FROM fx_alerts WHERE label IS NOT NULL) l USING (alert_id) WHERE l.alert_id IS NULL AND sent_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def anti_unlabeled_alerts(fx):
    labels = fx.alerts.where("label is not null").select("alert_id")
    return fx.alerts.where(F.col("sent_at") > fx.alerts_as_of - F.expr("INTERVAL 7 DAYS")).join(labels, "alert_id", "left_anti").select("alert_id")


@query("join_alert_by_price", "SELECT DISTINCT a.alert_id, o.variant_id FROM fx_alerts a LEFT JOIN fx_offers o ON o.current_price = a.price AND o.store_id = a.canonical_id % 10 + 1")
def join_alert_by_price(fx):
    a = fx.alerts.withColumn("store_id", F.col("canonical_id") % 10 + 1)
    o = fx.offers.select("variant_id", "store_id", F.col("current_price").alias("price"))
    return a.join(o, ["store_id", "price"], "left").select("alert_id", "variant_id").distinct()


@query("semi_membership", "SELECT variant_id, current_price FROM fx_offers WHERE variant_id IN (SELECT matched_variant_id FROM fx_matches)", hold=True)
def semi_membership(fx):
    return fx.offers.join(fx.matches.select(F.col("matched_variant_id").alias("variant_id")), "variant_id", "left_semi").select("variant_id", "current_price")


@query(
    "scalar_subqueries_per_alert",
    "SELECT a.alert_id, (SELECT count(DISTINCT o.store_id) FROM fx_offers o WHERE o.product_id = a.canonical_id) AS stores, (SELECT min(o.current_price) FROM fx_offers o WHERE o.product_id = a.canonical_id) AS least, (SELECT round(quantile_cont(o.current_price::DOUBLE, 0.5), 4) FROM fx_offers o WHERE o.product_id = a.canonical_id) AS median FROM fx_alerts a",
)
def scalar_subqueries_per_alert(fx):
    per = fx.offers.groupBy(F.col("product_id").alias("canonical_id")).agg(F.count_distinct("store_id").alias("stores"), F.min("current_price").alias("least"), F.round(F.percentile(F.col("current_price").cast("double"), F.lit(0.5)), 4).alias("median"))
    return fx.alerts.join(per, "canonical_id", "left").select("alert_id", F.coalesce("stores", F.lit(0)).alias("stores"), "least", "median")


@query("scalar_error_count", "SELECT s.store_id, (SELECT count(*) FROM fx_changes c WHERE c.store_id = s.store_id AND c.price > 1500 AND c.started_at > $AS_OF - INTERVAL 30 DAY) AS errors FROM fx_stores s")
def scalar_error_count(fx):
    errors = fx.changes.where((F.col("price") > 1500) & (F.col("started_at") > fx.as_of - F.expr("INTERVAL 30 DAYS"))).groupBy("store_id").count()
    return fx.stores.join(errors, "store_id", "left").select("store_id", F.coalesce("count", F.lit(0)).alias("errors"))


@query("cross_counts", "SELECT (SELECT count(*) FROM fx_offers) AS offers, (SELECT count(*) FROM fx_products) AS products, (SELECT count(*) FROM fx_stores) AS stores, (SELECT count(*) FROM fx_matches) AS matches", hold=True)
def cross_counts(fx):
    tagged = [df.select(F.lit(name).alias("t")) for name, df in (("offers", fx.offers), ("products", fx.products), ("stores", fx.stores), ("matches", fx.matches))]
    rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).unionAll(tagged[3])
    return rows.agg(*[F.count_if(F.col("t") == name).alias(name) for name in ("offers", "products", "stores", "matches")])


@query("rank_canonical", "SELECT nsku AS sku, variant_id, quality, row_number() OVER (PARTITION BY nsku ORDER BY quality DESC, variant_id) AS rank FROM fx_norm")
def rank_canonical(fx):
    return M.rank_canonical(M.normalized_variants(fx.variants, fx.offers)).select("sku", "variant_id", F.col("quality").cast("long").alias("quality"), F.col("rank").cast("long").alias("rank"))


@query("running_weight", "SELECT variant_id, price, CAST(sum(epoch_us(coalesce(ended_at, $AS_OF)) - epoch_us(started_at)) OVER (PARTITION BY variant_id ORDER BY price) AS BIGINT) AS cumulative FROM fx_changes")
def running_weight(fx):
    run = Window.partitionBy("variant_id").orderBy("price").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    us = I.microseconds(F.col("started_at"), F.coalesce("ended_at", fx.as_of))
    return fx.changes.select("variant_id", "price", F.sum(us).over(run).alias("cumulative"))


@query("partition_totals", "SELECT variant_id, price, count(*) OVER (PARTITION BY variant_id) AS intervals, max(price) OVER (PARTITION BY variant_id) AS most FROM fx_changes")
def partition_totals(fx):
    w = Window.partitionBy("variant_id")
    return fx.changes.select("variant_id", "price", F.count("*").over(w).alias("intervals"), F.max("price").over(w).alias("most"))


@query("first_value_current", "SELECT DISTINCT variant_id, first_value(price) OVER (PARTITION BY variant_id ORDER BY started_at DESC) AS current_price FROM fx_changes")
def first_value_current(fx):
    return fx.changes.groupBy("variant_id").agg(F.max_by("price", "started_at").alias("current_price"))


@query("distinct_on_first", "SELECT DISTINCT ON (product_id) product_id, store_id, current_price FROM fx_offers ORDER BY product_id, current_price, store_id")
def distinct_on_first(fx):
    best = fx.offers.groupBy("product_id").agg(F.min(F.struct("current_price", "store_id")).alias("o"))
    return best.select("product_id", "o.store_id", "o.current_price")


@query("prev_price", "SELECT variant_id, price, lag(price) OVER (PARTITION BY variant_id, store_id ORDER BY ts) AS prev_price FROM fx_obs")
def prev_price(fx):
    return fx.obs.select("variant_id", "price", F.lag("price").over(Window.partitionBy(*I.PAIR).orderBy("ts")).alias("prev_price"))


@query("open_close_lead", "SELECT variant_id, price, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(lead(ts) OVER (PARTITION BY variant_id, store_id ORDER BY ts), '%Y-%m-%d %H:%M:%S') AS ended_at FROM fx_kept")
def open_close_lead(fx):
    return fx.changes.select("variant_id", "price", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"))


@query("top_matched_products", "SELECT canonical_variant_id, count(*) AS matches FROM fx_matches GROUP BY 1 ORDER BY matches DESC, canonical_variant_id LIMIT 10")
def top_matched_products(fx):
    return fx.matches.groupBy("canonical_variant_id").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "canonical_variant_id").limit(10)


@query("digest_top_deals", "SELECT canonical_id, min(current_price) AS best_price, count(DISTINCT store_id) AS stores FROM fx_moffers GROUP BY 1 HAVING count(DISTINCT store_id) >= 3 ORDER BY best_price, canonical_id LIMIT 5", hold=True)
def digest_top_deals(fx):
    return fx.member_offers.groupBy("canonical_id").agg(F.min("current_price").alias("best_price"), F.count_distinct("store_id").alias("stores")).where("stores >= 3").orderBy("best_price", "canonical_id").limit(5)


@query("best_offer", "SELECT product_id, store_id, current_price FROM fx_offers WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY current_price, store_id) = 1")
def best_offer(fx):
    best = fx.offers.where("in_stock").groupBy("product_id").agg(F.min(F.struct("current_price", "store_id")).alias("o"))
    return best.select("product_id", "o.store_id", "o.current_price")


@query("latest_open_interval", "SELECT variant_id, store_id, price, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM fx_changes WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY variant_id, store_id ORDER BY started_at DESC) = 1")
def latest_open_interval(fx):
    return I.latest_open(fx.changes).select("variant_id", "store_id", "price", stamp("started_at").alias("started_at"))


@query("stale_order_nulls_last", "SELECT store_id, epoch($AS_OF - last_successful_sync) / 3600 AS hours, row_number() OVER (ORDER BY last_successful_sync ASC NULLS LAST, store_id) AS place FROM fx_stores")
def stale_order_nulls_last(fx):
    hours = I.microseconds(F.col("last_successful_sync"), fx.as_of) / F.lit(3_600_000_000)
    return S.global_rank(fx.stores.select("store_id", hours.alias("hours")), "place", F.col("hours").desc_nulls_last(), F.col("store_id"))


@query("sorted_offers", "SELECT product_id, variant_id, store_id, current_price, in_stock FROM fx_offers ORDER BY product_id, current_price, variant_id")
def sorted_offers(fx):
    return fx.offers.select("product_id", "variant_id", "store_id", "current_price", "in_stock").orderBy("product_id", "current_price", "variant_id")


@query("sorted_offers_all", "SELECT product_id, variant_id, current_price FROM fx_offers ORDER BY product_id, current_price, variant_id")
def sorted_offers_all(fx):
    return fx.offers.select("product_id", "variant_id", "current_price").orderBy("product_id", "current_price", "variant_id")


@query("top_reliable", "SELECT store_id, reliability_score FROM fx_stores WHERE sync_status <> 'dead' ORDER BY reliability_score DESC, store_id LIMIT 10")
def top_reliable(fx):
    return fx.stores.where("sync_status <> 'dead'").select("store_id", "reliability_score").orderBy(F.desc("reliability_score"), "store_id").limit(10)


@query("worst_stores", "SELECT store_id, reliability_score FROM fx_stores WHERE reliability_score < 50")
def worst_stores(fx):
    return fx.stores.where("reliability_score < 50").select("store_id", "reliability_score").orderBy("reliability_score", "store_id")


@query("examples_per_category", "SELECT category, canonical_name, row_number() OVER (PARTITION BY category ORDER BY product_id) AS rank FROM fx_products QUALIFY rank <= 3")
def examples_per_category(fx):
    return S.top_per(fx.products, ["category"], 3, "product_id").select("category", "canonical_name", F.col("rank").cast("long").alias("rank"))


@query("union_members", "SELECT canonical_id, variant_id FROM fx_members", hold=True)
def union_members(fx):
    return fx.members


@query("union_offers", "SELECT canonical_id, variant_id, store_id, current_price FROM fx_moffers", hold=True)
def union_offers(fx):
    m, o = fx.matches, fx.offers.select("variant_id", "store_id", "current_price")
    own = m.select(F.col("canonical_variant_id").alias("canonical_id"), F.col("canonical_variant_id").alias("variant_id")).distinct().join(o, "variant_id")
    matched = m.select(F.col("canonical_variant_id").alias("canonical_id"), F.col("matched_variant_id").alias("variant_id")).join(o, "variant_id")
    return own.unionByName(matched).distinct()


@query("union_all_series", "SELECT canonical_id, store_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS ts, price FROM fx_members JOIN fx_changes USING (variant_id) UNION ALL SELECT canonical_id, store_id, strftime(coalesce(ended_at, $AS_OF), '%Y-%m-%d %H:%M:%S'), price FROM fx_members JOIN fx_changes USING (variant_id)")
def union_all_series(fx):
    """What is read twice is written once: the matches' members; observations and changes are read once each."""
    return S.price_series(held(fx.members, "members"), fx.changes, fx.as_of).withColumn("ts", stamp("ts"))


@query("set_union_stores", "SELECT variant_id, store_id FROM fx_offers UNION SELECT variant_id, store_id FROM fx_changes UNION SELECT variant_id, store_id FROM fx_obs")
def set_union_stores(fx):
    pick = lambda df: df.select("variant_id", "store_id")
    return pick(fx.offers).union(pick(fx.changes)).union(pick(fx.obs)).distinct()


@query("distinct_prices", "SELECT DISTINCT canonical_id, current_price FROM fx_moffers", hold=True)
def distinct_prices(fx):
    return fx.member_offers.select("canonical_id", "current_price").distinct()


@query("match_products", "SELECT * FROM fx_matches", hold=True)
def match_products(fx):
    return fx.matches


@query("match_products_odd", "SELECT * FROM fx_odd_matches", hold=True)
def match_products_odd(fx):
    """Matches among variants that meet every clause of matching."""
    return M.match_products(fx.odd_variants, fx.odd_offers)


@query("match_summary", "SELECT match_method, count(*) AS matches FROM fx_matches GROUP BY 1")
def match_summary(fx):
    return fx.matches.groupBy("match_method").agg(F.count("*").alias("matches"))


@query("match_group_stats", "SELECT nsku AS sku, count(DISTINCT store_id) AS stores, count(DISTINCT brand_key) AS brands, count(*) AS variants FROM fx_odd_norm GROUP BY 1")
def match_group_stats(fx):
    return M.match_group_stats(M.normalized_variants(fx.odd_variants, fx.odd_offers)).select("sku", "stores", "brands", "variants")


@query("build_price_intervals", "SELECT variant_id, store_id, price, old_price, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at FROM fx_changes")
def build_price_intervals(fx):
    return fx.changes.select("variant_id", "store_id", "price", "old_price", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"))


@query("interval_days", "SELECT variant_id, price, round((epoch_us(coalesce(ended_at, $AS_OF)) - epoch_us(started_at)) / 86400000000.0::DOUBLE, 6) AS days FROM fx_changes")
def interval_days(fx):
    return I.interval_hours(fx.changes, fx.as_of).select("variant_id", "price", F.round("days", 6).alias("days"))


@query("price_change_frequency", "SELECT variant_id, store_id, count(*) FILTER (started_at > $AS_OF - INTERVAL 30 DAY) AS changes FROM fx_changes GROUP BY ALL")
def price_change_frequency(fx):
    return I.change_frequency(fx.changes, fx.as_of)
