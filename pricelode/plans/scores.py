"""Queries: monitoring, alerts, invariants, streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.functions import normalize as N
from pricelode.operators import alerts as A
from pricelode.operators import intervals as I
from pricelode.operators import monitoring as O
from pricelode.operators import quality as Q
from pricelode.operators.maintenance import accepted
from pricelode.session import held, shared_folder
from pricelode.streaming import streams as T

from .catalog import query
from .fixtures import BROKEN_CHANGES
from .ingest import JUMPY, jumpy

RELIABILITY = """fx_err AS (SELECT store_id, count(*) AS errors FROM fx_changes WHERE price > 15000 AND started_at > $AS_OF - INTERVAL 30 DAY GROUP BY 1),
 fx_r0 AS (SELECT s.store_id, name, sync_status AS st, epoch($AS_OF - last_successful_sync) / 3600 AS h, coalesce(errors, 0) AS e FROM fx_stores s LEFT JOIN fx_err USING (store_id) WHERE sync_status <> 'dead'),
 fx_rel AS (SELECT store_id, name, st AS sync_status, CAST(greatest(0, least(100, CASE st WHEN 'success' THEN 40 WHEN 'empty' THEN 20 WHEN 'error' THEN 5 ELSE 10 END + CASE WHEN h < 6 THEN 30 WHEN h < 24 THEN 20 WHEN h < 72 THEN 10 ELSE 0 END
  + greatest(0, 30 - CASE WHEN e > 10 THEN 15 WHEN e > 5 THEN 10 WHEN e > 0 THEN 5 ELSE 0 END - CASE st WHEN 'error' THEN 15 WHEN 'empty' THEN 10 ELSE 0 END))) AS INTEGER) AS score FROM fx_r0)"""


def reliability(fx):
    errors = fx.changes.where((F.col("price") > 15000) & (F.col("started_at") > fx.as_of - F.expr("INTERVAL 30 DAYS"))).groupBy("store_id").agg(F.count("*").alias("errors"))
    return O.store_reliability(fx.stores, errors, fx.as_of)


@query("store_reliability", f"WITH {RELIABILITY} SELECT * FROM fx_rel")
def store_reliability(fx):
    return reliability(fx)


@query("reliability_bands", f"WITH {RELIABILITY} SELECT CASE WHEN score >= 80 THEN 'Excellent (80-100)' WHEN score >= 60 THEN 'Good (60-79)' WHEN score >= 40 THEN 'Fair (40-59)' WHEN score >= 20 THEN 'Poor (20-39)' ELSE 'Critical (0-19)' END AS band, count(*) AS stores, round(avg(score), 6) AS avg_score FROM fx_rel GROUP BY 1")
def reliability_bands(fx):
    return reliability(fx).groupBy(O.reliability_band(F.col("score")).alias("band")).agg(F.count("*").alias("stores"), F.round(F.avg("score"), 6).alias("avg_score"))


FRESH = "fx_f AS (SELECT *, epoch($AS_OF - last_successful_sync) / 3600 AS h FROM fx_stores), fx_fp AS (SELECT store_id, h AS hours, unnest(list_filter([CASE WHEN sync_status IN ('error', 'empty') THEN 'errors' END, CASE WHEN h > 168 THEN 'dead' END, CASE WHEN h > 72 AND h <= 168 THEN 'very_stale' END, CASE WHEN h > 24 AND h <= 72 THEN 'stale' END], lambda x: x IS NOT NULL)) AS bucket FROM fx_f)"


@query(
    "store_freshness_alerts",
    f"""WITH {FRESH}, fx_t AS (SELECT count(*) AS total, count(*) FILTER (h <= 24) AS fresh FROM fx_f) SELECT bucket, count(*) AS stores, max(hours) AS longest FROM fx_fp GROUP BY 1
 UNION ALL SELECT 'never', count(*), NULL FROM fx_f WHERE h IS NULL AND sync_status NOT IN ('error', 'empty') HAVING count(*) > 0 UNION ALL SELECT 'fresh', fresh, round(100.0::DOUBLE * fresh / total, 6) FROM fx_t""",
)
def store_freshness_alerts(fx):
    """Stores and longest hours by problem; the row `fresh` has the fresh stores and their percentage of all."""
    problems = O.freshness_problems(fx.stores, fx.as_of)
    counted = problems.groupBy(F.coalesce("bucket", F.lit("never")).alias("bucket")).agg(F.count("*").alias("stores"), F.max("hours").alias("longest"))
    return counted.unionByName(O.fresh_share(fx.stores, fx.as_of).select(F.lit("fresh").alias("bucket"), F.col("fresh").alias("stores"), F.round("percent", 6).alias("longest")))


@query("cap_per_freshness_bucket", f"WITH {FRESH}, fx_fr AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hours DESC NULLS LAST, store_id) AS rank, count(*) OVER (PARTITION BY bucket) AS n FROM fx_fp) SELECT bucket, store_id, rank, greatest(n - CASE bucket WHEN 'stale' THEN 10 ELSE 5 END, 0) AS more FROM fx_fr WHERE rank <= CASE bucket WHEN 'stale' THEN 10 ELSE 5 END")
def cap_per_freshness_bucket(fx):
    limit = F.when(F.col("bucket") == "stale", 10).otherwise(5)
    rows = O.freshness_problems(fx.stores, fx.as_of).where("bucket is not null")
    # The constant bound lets every task keep its ten first rows of a bucket before any is shuffled.
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("hours").desc_nulls_last(), "store_id")).cast("long")).where("rank <= 10")
    return first.join(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").where(F.col("rank") <= limit).select("bucket", "store_id", "rank", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("more"))


@query(
    "weekly_digest",
    """WITH fx_c AS (SELECT unnest(['stores', 'fresh', 'errors', 'dead', 'products', 'offers', 'matches']) AS item, unnest([(SELECT count(*) FROM fx_stores), (SELECT count(*) FROM fx_stores WHERE epoch($AS_OF - last_successful_sync) / 3600 <= 24), (SELECT count(*) FROM fx_stores WHERE sync_status = 'error'), (SELECT count(*) FROM fx_stores WHERE sync_status = 'dead'), (SELECT count(*) FROM fx_products), (SELECT count(*) FROM fx_offers), (SELECT count(*) FROM fx_matches)]) AS n),
 fx_w AS (SELECT DISTINCT variant_id FROM fx_members),
 fx_top AS (SELECT p.canonical_name, p.brand, min(current_price) AS least, count(DISTINCT o.store_id) AS stores, p.product_id FROM fx_offers o JOIN fx_w USING (variant_id) JOIN fx_products p ON p.product_id = o.product_id WHERE in_stock GROUP BY p.product_id, p.canonical_name, p.brand HAVING count(DISTINCT o.store_id) >= 3 ORDER BY least, p.product_id LIMIT 5)
 SELECT item, NULL AS brand, NULL AS price, n FROM fx_c UNION ALL SELECT canonical_name, brand, least, stores FROM fx_top""",
    hold=True,
)
def weekly_digest(fx):
    """Counts, and the five cheapest matched products that three stores or more have in stock."""
    counts = O.digest_counts({"stores": fx.stores, "products": fx.products, "offers": fx.offers, "matches": fx.matches}, fx.stores, fx.as_of)
    top = O.digest_deals(fx.offers, fx.members, fx.products)
    none = F.lit(None)
    return counts.select("item", none.cast("string").alias("brand"), none.cast("decimal(10,2)").alias("price"), "n").unionByName(top.select(F.col("canonical_name").alias("item"), "brand", F.col("least").alias("price"), F.col("stores").alias("n")))


@query("cooldown_minima", "SELECT canonical_id, min(price) AS least_price FROM fx_alerts WHERE sent_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR GROUP BY 1")
def cooldown_minima(fx):
    return A.cooldown_minima(fx.alerts, fx.alerts_as_of)


@query("precision_metrics", "SELECT count(*) FILTER (label = 1) AS true_positives, count(*) FILTER (label = 0) AS false_positives, count(label) AS labeled, count(*) AS total_alerts, round(100.0::DOUBLE * count(*) FILTER (label = 1) / nullif(count(label), 0), 1) AS precision_pct FROM fx_alerts WHERE sent_at > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY")
def precision_metrics(fx):
    return A.precision_metrics(fx.alerts, fx.alerts_as_of)


@query(
    "auto_label_alerts",
    """WITH fx_mk AS (SELECT product_id AS canonical_id, count(DISTINCT store_id) AS stores, quantile_cont(current_price, 0.5) AS med, min(current_price) AS lo FROM fx_offers GROUP BY 1 HAVING count(DISTINCT store_id) >= 2),
 fx_l AS (SELECT alert_id, stores, (med - price) / med * 100 AS d, (price - lo) / med * 100 AS f FROM fx_alerts JOIN fx_mk USING (canonical_id) WHERE label IS NULL)
 SELECT alert_id, CASE WHEN d >= 15 AND f <= 20 AND stores >= 3 THEN 1 ELSE 0 END AS auto_label, stores FROM fx_l WHERE (d >= 15 AND f <= 20 AND stores >= 3) OR d < 5 OR f > 50""",
)
def auto_label_alerts(fx):
    return A.auto_labels(fx.alerts.where("label is null"), fx.offers.withColumnRenamed("product_id", "canonical_id"))


@query(
    "label_queue",
    """WITH fx_a AS (SELECT alert_id, sent_at, s.store_id, s.name AS store, o.price FROM (SELECT a.alert_id, a.sent_at, a.label, CASE WHEN alert_id % 2 = 0 THEN coalesce(f.current_price, a.price) ELSE a.price END AS price, a.canonical_id % 10 + 1 AS store_id FROM fx_alerts a LEFT JOIN (SELECT store_id, min(current_price) AS current_price FROM fx_offers GROUP BY 1) f ON f.store_id = a.canonical_id % 10 + 1) o JOIN fx_stores s ON s.store_id = o.store_id WHERE label IS NULL ORDER BY sent_at DESC, alert_id LIMIT 20)
 SELECT DISTINCT a.alert_id, strftime(a.sent_at, '%Y-%m-%d %H:%M:%S') AS sent_at, a.store, a.price, p.canonical_name, v.brand, v.sku, m.canonical_variant_id FROM fx_a a LEFT JOIN fx_offers o ON o.store_id = a.store_id AND o.current_price = a.price LEFT JOIN fx_variants v ON v.variant_id = o.variant_id LEFT JOIN fx_products p ON p.product_id = v.product_id
 LEFT JOIN (SELECT DISTINCT matched_variant_id, canonical_variant_id FROM fx_matches) m ON m.matched_variant_id = o.variant_id ORDER BY sent_at DESC, alert_id, canonical_name NULLS FIRST, brand NULLS FIRST, sku NULLS FIRST, canonical_variant_id NULLS FIRST LIMIT 20""",
    hold=True,
)
def label_queue(fx):
    """Every second alert has the lowest price of its store, so that an offer is found."""
    least = fx.offers.groupBy("store_id").agg(F.min("current_price").alias("least"))
    a = fx.alerts.withColumn("store_id", F.col("canonical_id") % 10 + 1).join(least, "store_id", "left")
    a = a.withColumn("price", F.when(F.col("alert_id") % 2 == 0, F.coalesce("least", "price")).otherwise(F.col("price")))
    return A.label_queue(a, fx.stores, fx.offers, fx.variants, fx.products, fx.matches).withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"))


BROKEN = "WITH " + BROKEN_CHANGES


@query("dq_interval_overlap", BROKEN + " SELECT count(*) AS violations FROM (SELECT epoch_us(started_at) < max(epoch_us(coalesce(ended_at, $AS_OF))) OVER (PARTITION BY variant_id, store_id ORDER BY epoch_us(started_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM fx_broken) WHERE bad")
def dq_interval_overlap(fx):
    return I.overlapping(fx.broken_changes, fx.as_of).agg(F.count("*").alias("violations"))


@query("dq_single_open_interval", BROKEN + " SELECT variant_id, store_id FROM fx_broken WHERE ended_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def dq_single_open_interval(fx):
    return Q.multiple_open(fx.broken_changes).select("variant_id", "store_id")


@query("dq_compression_ratio", "SELECT round((SELECT count(*) FROM fx_obs)::DOUBLE / (SELECT count(*) FROM fx_changes), 6) AS ratio")
def dq_compression_ratio(fx):
    rows = fx.obs.select(F.lit(1).alias("o")).unionAll(fx.changes.select(F.lit(0).alias("o")))
    return rows.agg(F.round(F.try_divide(F.count_if(F.col("o") == 1).cast("double"), F.count_if(F.col("o") == 0)), 6).alias("ratio"))


@query("dq_color_consistency", "WITH v AS (SELECT variant_id, CASE WHEN store_id % 3 = 0 THEN 'other' WHEN store_id % 10 > 0 THEN color END AS color FROM fx_variants) SELECT m.canonical_variant_id, m.matched_variant_id FROM fx_matches m JOIN v a ON a.variant_id = m.canonical_variant_id JOIN v b ON b.variant_id = m.matched_variant_id WHERE a.color <> b.color", hold=True)
def dq_color_consistency(fx):
    """With colours that are changed in a third of the stores and unknown in some."""
    color = F.when(F.col("store_id") % 3 == 0, "other").when(F.col("store_id") % 10 > 0, F.col("color"))
    return Q.differing_colours(fx.matches, fx.variants.withColumn("color", color)).select("canonical_variant_id", "matched_variant_id")


@query("dq_color_coverage", "SELECT coloured, total, coloured * 2 > total AS holds FROM (SELECT count(*) FILTER (canonical_name LIKE '%red%' OR canonical_name LIKE '%blue%' OR canonical_name LIKE '%green%') AS coloured, count(*) AS total FROM fx_products WHERE product_id % 9 <> 0)")
def dq_color_coverage(fx):
    """Of the products that state a colour (here all but every ninth), more than half must have a normalised one."""
    return Q.colour_coverage(fx.products.where("product_id % 9 <> 0").withColumn("normalized_color", N.normalize_color(F.col("canonical_name"))), "canonical_name", "normalized_color")


@query(
    "dq_match_constraints",
    """WITH fx_bm AS (SELECT canonical_variant_id AS c, matched_variant_id AS m, confidence_score AS s FROM fx_matches UNION ALL SELECT canonical_variant_id, canonical_variant_id, 1.5 FROM fx_matches WHERE matched_variant_id % 5 = 0 UNION ALL SELECT canonical_variant_id, matched_variant_id, confidence_score FROM fx_matches WHERE matched_variant_id % 3 = 0 UNION ALL SELECT canonical_variant_id + 1, matched_variant_id, confidence_score FROM fx_matches WHERE matched_variant_id % 11 = 0)
 SELECT count(*) FILTER (c = m) AS self_matches, count(*) FILTER (NOT s BETWEEN 0 AND 1) AS bad_confidence, (SELECT count(*) FROM (SELECT 1 FROM fx_bm GROUP BY c, m HAVING count(*) > 1)) AS repeated_pairs, (SELECT count(*) FROM (SELECT 1 FROM fx_bm GROUP BY m HAVING count(DISTINCT c) > 1)) AS repeated_matched FROM fx_bm""",
    hold=True,
)
def dq_match_constraints(fx):
    """With self matches, a confidence above 1, repeated pairs, and matched variants of two canonical ones planted."""
    m = fx.matches.select("canonical_variant_id", "matched_variant_id", F.col("confidence_score").cast("double").alias("confidence_score"))
    own = m.where("matched_variant_id % 5 = 0").select("canonical_variant_id", F.col("canonical_variant_id").alias("matched_variant_id"), F.lit(1.5).alias("confidence_score"))
    other = m.where("matched_variant_id % 11 = 0").withColumn("canonical_variant_id", F.col("canonical_variant_id") + 1)
    return Q.match_violations(m.unionByName(own).unionByName(m.where("matched_variant_id % 3 = 0")).unionByName(other))


@query("dq_positive_price", BROKEN + " SELECT 'offers' AS table_name, count(*) FILTER (current_price <= 0) AS violations FROM (SELECT CASE WHEN variant_id % 19 = 0 THEN 0 ELSE current_price END AS current_price FROM fx_offers) UNION ALL SELECT 'history', count(*) FILTER (price <= 0) FROM (SELECT CASE WHEN variant_id % 23 = 0 THEN -price ELSE price END AS price FROM fx_obs) UNION ALL SELECT 'changes', count(*) FILTER (price <= 0) FROM fx_broken", hold=True)
def dq_positive_price(fx):
    v = F.col("variant_id")
    offers = fx.offers.withColumn("current_price", F.when(v % 19 == 0, 0).otherwise(F.col("current_price")))
    history = fx.obs.withColumn("price", F.when(v % 23 == 0, -F.col("price")).otherwise(F.col("price")))
    return Q.nonpositive(offers, "current_price", "offers").unionByName(Q.nonpositive(history, "price", "history")).unionByName(Q.nonpositive(fx.broken_changes, "price", "changes"))


@query("dq_unique_scoped_variant", "SELECT store_id, external_id, count(*) AS n FROM (SELECT store_id, CASE WHEN product_id % 10 = 0 THEN '' WHEN product_id % 10 = 1 THEN NULL ELSE CAST(product_id // 3 AS VARCHAR) END AS external_id FROM fx_variants) WHERE external_id <> '' GROUP BY ALL HAVING count(*) > 1")
def dq_unique_scoped_variant(fx):
    """External ids that neighbouring products share; empty and null ones are no violation."""
    n = F.col("product_id")
    external = F.when(n % 10 == 0, "").when(n % 10 == 1, None).otherwise(F.floor(n / 3).cast("string"))
    return Q.repeated_external(fx.variants.withColumn("external_id", external))


@query("dq_reliability_range", "SELECT count(*) FILTER (NOT score BETWEEN 0 AND 100) AS violations, count(*) FILTER (score IS NULL) AS unknown FROM (SELECT CASE WHEN s_suppkey % 12 > 0 THEN s_acctbal / 90 END AS score FROM supplier)")
def dq_reliability_range(fx):
    """Over scores that aren't clamped."""
    rows = fx.table("supplier").select(F.when(F.col("s_suppkey") % 12 > 0, F.col("s_acctbal") / 90).alias("reliability_score"))
    return Q.outside(rows, "reliability_score", 0, 100)


def streamed(fx, df, name, build, parts=1):
    """What build makes of df read as a stream, run to its end into a table."""
    folder = shared_folder(fx.spark, name)
    df.repartition(4).write.parquet(f"{folder}/in")
    stream = fx.spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.parquet(f"{folder}/out")


def with_state_store(fx):
    fx.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("stream_dedup_observations", "SELECT variant_id, store_id, count(*) AS n FROM (SELECT DISTINCT variant_id, store_id, ts FROM fx_obs) GROUP BY ALL")
def stream_dedup_observations(fx):
    twice = fx.obs.select("variant_id", "store_id", "ts").unionAll(fx.obs.select("variant_id", "store_id", "ts"))
    out = streamed(fx, twice, "dedup", lambda s: T.stream_dedup_observations(s, "400 days"))
    return out.groupBy("variant_id", "store_id").agg(F.count("*").alias("n"))


@query("stream_upsert_offers", "SELECT variant_id, store_id, current_price AS price FROM fx_offers")
def stream_upsert_offers(fx):
    folder = shared_folder(fx.spark, "offers")
    fx.obs.select("variant_id", "store_id", "ts", "price", "in_stock").repartition(6).write.parquet(f"{folder}/in")
    stream = fx.spark.readStream.schema("variant_id long, store_id long, ts timestamp, price decimal(10,2), in_stock boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = T.stream_upsert_offers(stream, fx.spark, f"{folder}/table", f"{folder}/state", compact=2).trigger(availableNow=True).start()
    run.awaitTermination()
    return T.read_offers(fx.spark, f"{folder}/table").select("variant_id", "store_id", "price")


#: The last accepted price is the base of the next: each row of a pair in turn.
REPLAYED = f"""RECURSIVE {JUMPY}, fx_seq AS (SELECT variant_id, store_id, ts, price, row_number() OVER (PARTITION BY variant_id, store_id ORDER BY ts) AS k FROM fx_jumps),
 fx_fold AS (
  SELECT DISTINCT variant_id, store_id, 0::BIGINT AS k, NULL::DOUBLE AS base, false AS taken FROM fx_seq
  UNION ALL
  SELECT variant_id, store_id, k, CASE WHEN taken THEN price ELSE base END, taken
  FROM (SELECT q.*, f.base, price > 0 AND price <= 20000 AND (base IS NULL OR price::DOUBLE / base::DOUBLE BETWEEN 0.25 AND 4) AS taken FROM fx_fold f JOIN fx_seq q ON q.variant_id = f.variant_id AND q.store_id = f.store_id AND q.k = f.k + 1)
 ),
 fx_taken AS (SELECT q.* FROM fx_seq q JOIN fx_fold f USING (variant_id, store_id, k) WHERE taken)"""


@query("accepted_observations", f"WITH {REPLAYED} SELECT variant_id, store_id, price, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM fx_taken")
def accepted_observations(fx):
    rows = jumpy(fx).select("variant_id", "store_id", "price", "ts")
    return accepted(rows).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_price_intervals",
    f"""WITH {REPLAYED} SELECT variant_id, store_id, price, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM fx_taken
 QUALIFY price IS DISTINCT FROM lag(price) OVER (PARTITION BY variant_id, store_id ORDER BY ts)""",
    hold=True,
)
def stream_price_intervals(fx):
    """Observations with planted jumps arrive in four lots, up to three days late; a row of the year 2100 lets the watermark pass all others."""
    with_state_store(fx)
    folder = shared_folder(fx.spark, "intervals")
    rows = jumpy(fx).select("variant_id", "store_id", "ts", F.col("price").cast("decimal(12,2)").alias("price"))
    late = F.timestamp_add("HOUR", F.pmod(F.xxhash64("variant_id", "ts"), F.lit(72)).cast("int"), F.col("ts"))
    lots = rows.withColumn("lot", F.floor((F.unix_timestamp(late) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (30 * 86_400)))
    rows = held(lots, "arrivals")
    ends = fx.spark.range(1).select(F.lit(-1).cast("long").alias("variant_id"), F.lit(-1).cast("long").alias("store_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(1).cast("decimal(12,2)").alias("price"))
    arrivals = [rows.where(F.col("lot") == r.lot).drop("lot") for r in rows.select("lot").distinct().orderBy("lot").collect()]  # a handful
    for arrival in (*arrivals, ends):
        # The stream goes on where it stopped when the lot before was done.
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream = fx.spark.readStream.schema(ends.schema).parquet(f"{folder}/in")
        T.stream_price_intervals(stream, f"{folder}/out", f"{folder}/state", "4 days").trigger(availableNow=True).start().awaitTermination()
    out = T.read_price_intervals(fx.spark, f"{folder}/out").where("variant_id >= 0")
    return out.select("variant_id", "store_id", F.col("price").cast("double").alias("price"), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query(
    "amend_price_intervals",
    "SELECT variant_id, store_id, price, old_price, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at FROM fx_changes",
    hold=True,
)
def amend_price_intervals(fx):
    """A tenth of all observations comes after the intervals were built; with these they are what they would have been."""
    late = F.pmod(F.xxhash64("variant_id", "ts"), F.lit(10)) == 0
    soon = fx.obs.where(~late)
    out = I.amend_price_intervals(I.build_price_intervals(soon), soon, fx.obs.where(late))
    return out.select("variant_id", "store_id", "price", "old_price", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "ended_at")])


@query(
    "stream_alert_cooldown",
    """WITH RECURSIVE fx_seq AS (SELECT canonical_id, alert_id, epoch_us(sent_at) AS t, price, row_number() OVER (PARTITION BY canonical_id ORDER BY sent_at, alert_id) AS k FROM fx_alerts),
 fx_fold AS (
  SELECT DISTINCT canonical_id, 0::BIGINT AS k, NULL::BIGINT AS alert_id, NULL::DOUBLE AS price, []::STRUCT(t BIGINT, p DOUBLE)[] AS sent, false AS kept FROM fx_seq
  UNION ALL
  SELECT canonical_id, k, alert_id, price, CASE WHEN kept THEN list_append(recent, {'t': t, 'p': price::DOUBLE}) ELSE recent END, kept
  FROM (SELECT *, len(recent) = 0 OR price < 0.95::DOUBLE * list_min(list_transform(recent, lambda x: x.p)) AS kept
   FROM (SELECT q.*, list_filter(f.sent, lambda x: x.t > q.t - 86400000000) AS recent FROM fx_fold f JOIN fx_seq q ON q.canonical_id = f.canonical_id AND q.k = f.k + 1))
 )
 SELECT canonical_id, alert_id, price FROM fx_fold WHERE kept""",
)
def stream_alert_cooldown(fx):
    with_state_store(fx)
    return streamed(fx, fx.alerts.select("canonical_id", "alert_id", "sent_at", "price"), "cooldown", T.stream_alert_cooldown)
