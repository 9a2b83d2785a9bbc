"""Queries: market statistics and deal scores."""

from pyspark.sql import functions as F

from pricelode.functions import normalize as N
from pricelode.functions import statistics as T
from pricelode.operators import scoring as C

from .catalog import query

PRICES = "fx_p AS (SELECT product_id, store_id, in_stock, current_price AS price FROM fx_offers)"


def prices(fx):
    return fx.offers.select("product_id", "store_id", "in_stock", F.col("current_price").alias("price"))


def rounded(df, *columns, places=8):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(
    "market_metrics",
    """SELECT product_id, round(coalesce(quantile_cont(current_price, 0.5) FILTER (in_stock), quantile_cont(current_price, 0.5)), 8) AS median, round(coalesce(avg(current_price) FILTER (in_stock), avg(current_price)), 8) AS mean,
       coalesce(min(current_price) FILTER (in_stock), min(current_price)) AS min, coalesce(max(current_price) FILTER (in_stock), max(current_price)) AS max, count(DISTINCT store_id) AS stores, count(DISTINCT store_id) FILTER (in_stock) AS in_stock_stores FROM fx_offers GROUP BY 1""",
)
def market_metrics(fx):
    return rounded(T.market_metrics(prices(fx), ["product_id"]), "median", "mean")


MAD = """fx_d AS (SELECT product_id, store_id, current_price AS price, count(*) OVER (PARTITION BY product_id) AS n, abs(current_price - quantile_cont(current_price, 0.5) OVER (PARTITION BY product_id)) AS dev FROM fx_offers),
 fx_m AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY product_id) AS mad FROM fx_d),
 fx_keep AS (SELECT * FROM fx_m WHERE n < 3 OR mad = 0 OR dev / (1.4826 * mad) <= 3.5)"""


@query("mad_outliers", f"WITH {MAD} SELECT product_id, store_id, price FROM fx_keep")
def mad_outliers(fx):
    return T.mad_kept(prices(fx), ["product_id"]).select("product_id", "store_id", "price")


@query(
    "robust_market_metrics",
    f"""WITH {MAD}, fx_w AS (SELECT product_id, count(*) AS observations, count(DISTINCT store_id) AS stores FROM fx_offers GROUP BY 1),
 fx_k AS (SELECT product_id, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.1) AS p10, quantile_cont(price, 0.9) AS p90, min(price) AS min, max(price) AS max, avg(price) AS mean, stddev_pop(price) AS std, count(*) AS count FROM fx_keep GROUP BY 1)
 SELECT product_id, round(median, 8) AS median, round(p10, 8) AS p10, round(p90, 8) AS p90, min, max, round(mean, 8) AS mean, round(std, 8) AS std, count, observations - count AS outliers_removed,
 round(0.4 * least(1, ln(observations + 1) / ln(4)) + 0.4 * least(1, stores / 2) + 0.2 * CASE WHEN std / mean > 0.3 THEN greatest(0.5, 1 - (std / mean - 0.3) * 2) ELSE 1 END, 8) AS confidence FROM fx_k JOIN fx_w USING (product_id)""",
)
def robust_market_metrics(fx):
    df = T.robust_market_metrics(prices(fx), ["product_id"]).drop("observations", "stores")
    return rounded(df, "median", "p10", "p90", "mean", "std", "confidence")


@query("iqr_outliers", "SELECT product_id, store_id, price FROM (SELECT product_id, store_id, current_price AS price, count(*) OVER w AS n, quantile_cont(current_price, 0.25) OVER w AS q1, quantile_cont(current_price, 0.75) OVER w AS q3 FROM fx_offers WINDOW w AS (PARTITION BY product_id)) WHERE n < 4 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def iqr_outliers(fx):
    return T.iqr_kept(prices(fx), ["product_id"]).select("product_id", "store_id", "price")


SANE = "fx_sane AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, quantile_cont(current_price, 0.5) OVER w AS med FROM {source} WHERE current_price > 0 AND current_price <= 20000 WINDOW w AS (PARTITION BY {by})) WHERE n < 2 OR current_price BETWEEN med / 3.0::DOUBLE AND med * 3.0::DOUBLE)"


@query("sanitize_prices", f"WITH {SANE.format(source='fx_offers', by='product_id')} SELECT product_id, store_id, current_price AS price FROM fx_sane")
def sanitize_prices(fx):
    return T.sanitized(prices(fx), ["product_id"]).select("product_id", "store_id", "price")


@query("weighted_median", "WITH fx_c AS (SELECT product_id, current_price, sum(w) OVER (PARTITION BY product_id ORDER BY current_price) AS cum, sum(w) OVER (PARTITION BY product_id) AS total FROM (SELECT product_id, current_price, 1 + store_id % 7 AS w FROM fx_offers)) SELECT product_id, min(current_price) AS median FROM fx_c WHERE cum * 2 >= total GROUP BY 1")
def weighted_median(fx):
    rows = prices(fx).withColumn("w", 1 + F.col("store_id") % 7)
    return T.weighted_quantile(rows, ["product_id"], "price", "w", [(1, 2)], ["median"])


@query(
    "weighted_percentile",
    """WITH fx_g AS (SELECT product_id, current_price AS p, sum(1 + store_id % 7) AS w FROM fx_offers GROUP BY ALL), fx_c AS (SELECT *, sum(w) OVER (PARTITION BY product_id ORDER BY p) AS cum, sum(w) OVER (PARTITION BY product_id) * 0.25::DOUBLE AS target, lag(p) OVER (PARTITION BY product_id ORDER BY p) AS prev FROM fx_g)
 SELECT product_id, round(coalesce(prev + (target - (cum - w)) / w * (p - prev), p), 8) AS p25 FROM fx_c WHERE cum >= target QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p) = 1""",
)
def weighted_percentile(fx):
    rows = prices(fx).withColumn("w", 1 + F.col("store_id") % 7)
    return rounded(T.weighted_percentile(rows, ["product_id"], "price", "w", F.lit(0.25), "p25"), "p25")


@query("confidence_score", "SELECT product_id, round(0.4 * least(1, ln(count(*) + 1) / ln(4)) + 0.4 * least(1, count(DISTINCT store_id) / 2) + 0.2 * CASE WHEN stddev_pop(current_price) / avg(current_price) > 0.3 THEN greatest(0.5, 1 - (stddev_pop(current_price) / avg(current_price) - 0.3) * 2) ELSE 1 END, 4) AS confidence FROM fx_offers GROUP BY 1")
def confidence_score(fx):
    p = F.col("price").cast("double")
    df = prices(fx).groupBy("product_id").agg(F.count("*").alias("n"), F.count_distinct("store_id").alias("stores"), (F.stddev_pop(p) / F.avg(p)).alias("cv"))
    return df.select("product_id", F.round(T.confidence(F.col("n"), F.col("stores"), F.col("cv")), 4).alias("confidence"))


@query("historical_percentiles", "SELECT variant_id, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.1), 4) AS p10, count(*) AS n, CAST(floor(epoch($AS_OF - max(started_at)) / 86400) AS BIGINT) AS days FROM fx_changes GROUP BY 1")
def historical_percentiles(fx):
    p = F.col("price").cast("double")
    return fx.changes.groupBy("variant_id").agg(F.round(T.median(p), 4).alias("median"), F.round(F.percentile(p, F.lit(0.1)), 4).alias("p10"), F.count("*").alias("n"), F.floor((F.unix_micros(fx.as_of) - F.unix_micros(F.max("started_at"))) / C.DAY_US).alias("days"))


HISTORY = """fx_h AS (SELECT canonical_id, store_id, price, started_at, coalesce(ended_at, $AS_OF) AS ended, epoch_us(coalesce(ended_at, $AS_OF)) - epoch_us(started_at) AS us FROM fx_members JOIN fx_changes USING (variant_id) WHERE price > 0),
 fx_hc AS (SELECT *, sum(us) OVER (PARTITION BY canonical_id ORDER BY price) AS cum, sum(us) OVER (PARTITION BY canonical_id) AS total FROM fx_h),
 fx_hist AS (SELECT canonical_id, min(price) FILTER (cum * 2 >= total) AS median, min(price) FILTER (cum * 10 >= total) AS p10, min(price) FILTER (cum * 10 >= total * 9) AS p90, min(price) AS least, max(price) AS most, sum(us) / 86400000000.0::DOUBLE AS total_days,
  arg_max(price, struct_pack(a := ended, b := started_at, c := -store_id)) AS current_price, (epoch_us($AS_OF) - epoch_us(max(ended))) / 86400000000.0::DOUBLE AS days_since_update, count(*) AS intervals FROM fx_hc GROUP BY 1)"""


@query("weighted_history", f"WITH {HISTORY} SELECT canonical_id, median, p10, p90, least, most, round(total_days, 8) AS total_days, current_price, days_since_update, intervals FROM fx_hist", hold=True)
def weighted_history(fx):
    return rounded(C.weighted_history(fx.members, fx.changes, fx.as_of), "total_days")


SCORE = (
    HISTORY
    + ", "
    + SANE.format(source="fx_moffers JOIN fx_stores USING (store_id)", by="canonical_id")
    + """,
 fx_sm AS (SELECT canonical_id, min(current_price) FILTER (cum * 2 >= total) AS market_median, min(current_price) AS market_min, max(current_price) AS market_max, count(*) AS sane FROM (SELECT *, sum(greatest(1, reliability_score)) OVER (PARTITION BY canonical_id ORDER BY current_price) AS cum, sum(greatest(1, reliability_score)) OVER (PARTITION BY canonical_id) AS total FROM fx_sane) GROUP BY 1),
 fx_stock AS (SELECT canonical_id, arg_min(store_id, struct_pack(a := current_price, b := store_id)) AS best_store, min(current_price) AS best FROM (SELECT *, count(*) OVER w AS n, quantile_cont(current_price, 0.5) OVER w AS med FROM fx_moffers WHERE in_stock AND current_price > 0 AND current_price <= 20000 WINDOW w AS (PARTITION BY canonical_id)) WHERE n < 2 OR current_price BETWEEN med / 3.0::DOUBLE AND med * 3.0::DOUBLE GROUP BY 1),
 fx_all AS (SELECT canonical_id, count(DISTINCT store_id) AS store_count, count(*) FILTER (in_stock) AS in_stock_count, avg(reliability_score) FILTER (in_stock) AS trust FROM fx_moffers JOIN fx_stores USING (store_id) GROUP BY 1),
 fx_s1 AS (SELECT *, best IS NOT NULL AND market_median IS NOT NULL AS ok, CASE WHEN best IS NOT NULL AND market_median > 0 THEN (market_median - best) / market_median * 100 ELSE 0 END AS discount FROM fx_all LEFT JOIN fx_sm USING (canonical_id) LEFT JOIN fx_stock USING (canonical_id) LEFT JOIN fx_hist USING (canonical_id)),
 fx_s2 AS (SELECT *, least(100, least(80, greatest(0, discount * 2)) + greatest(0, 20 - (best - market_min) / market_median * 100)) AS cross_score,
  CASE WHEN best <= p10 THEN 80 ELSE least(70, greatest(0, (median - best) / median * 200)) END * CASE WHEN days_since_update > 7 THEN 0.7 ELSE 1 END * CASE WHEN total_days > 30 THEN 0.8 ELSE 1 END AS past FROM fx_s1),
 fx_score AS (SELECT *, round(CASE WHEN NOT ok THEN 0 WHEN intervals >= 2 THEN least(100, cross_score * 0.5 + past * 0.5) ELSE cross_score END, 4) AS deal_score,
  CASE WHEN ok THEN CAST(floor(round(least(100, store_count * 25) * CASE WHEN sane > 1 AND market_max - market_min > market_median * 0.5 THEN 0.7 ELSE 1 END * CASE WHEN days_since_update < 1 THEN 1 WHEN days_since_update < 7 THEN 0.8 ELSE 0.5 END * coalesce(trust, 50) / 100, 6)) AS INTEGER) ELSE 0 END AS confidence FROM fx_s2),
 fx_final AS (SELECT canonical_id, deal_score, confidence, CASE WHEN in_stock_count = 0 THEN 'OUT OF STOCK' WHEN NOT ok THEN 'SANITY REJECT' WHEN deal_score >= 80 AND confidence >= 70 THEN 'VERY GOOD DEAL' WHEN deal_score >= 60 AND confidence >= 50 THEN 'GOOD DEAL' WHEN deal_score >= 40 THEN 'NORMAL PRICE' ELSE 'BAD DEAL' END AS classification,
  best AS best_price, best_store, market_median, round(discount, 4) AS discount_pct, store_count, in_stock_count, CASE WHEN NOT ok THEN 'none' WHEN best < market_median * 0.8 THEN 'below market' WHEN intervals >= 2 AND best <= p10 THEN 'rare price' ELSE 'close to market' END AS reason FROM fx_score)"""
)


def history(fx):
    return C.weighted_history(fx.members, fx.changes, fx.as_of)


@query("deal_score_v2", f"WITH {SCORE} SELECT * FROM fx_final", hold=True)
def deal_score_v2(fx):
    return C.deal_score_v2(fx.member_offers, fx.stores, history(fx))


@query("find_best_deals", f"WITH {SCORE} SELECT * FROM fx_final WHERE deal_score > 0 ORDER BY deal_score DESC, canonical_id LIMIT 50", hold=True)
def find_best_deals(fx):
    return C.best_deals(fx.member_offers, fx.stores, history(fx))


@query("filter_min_score", f"WITH {SCORE} SELECT canonical_id, deal_score, confidence FROM fx_final WHERE deal_score >= 70 AND confidence >= 50", hold=True)
def filter_min_score(fx):
    return deal_score_v2(fx).where("deal_score >= 70 and confidence >= 50").select("canonical_id", "deal_score", "confidence")


@query("top_deals", f"WITH {SCORE} SELECT canonical_id, deal_score, discount_pct FROM fx_final ORDER BY deal_score DESC, discount_pct DESC, canonical_id LIMIT 50", hold=True)
def top_deals(fx):
    return deal_score_v2(fx).orderBy(F.desc("deal_score"), F.desc("discount_pct"), "canonical_id").limit(50).select("canonical_id", "deal_score", "discount_pct")


COOL = f"""WITH {SCORE}, fx_cool AS (SELECT canonical_id, min(price) AS least_price FROM (SELECT canonical_id * 100000 + 1 AS canonical_id, price FROM fx_alerts WHERE sent_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) GROUP BY 1),
 fx_cand AS (SELECT f.* FROM fx_final f LEFT JOIN fx_cool USING (canonical_id) WHERE deal_score >= 40 AND confidence >= 20 AND (least_price IS NULL OR best_price < 0.95 * least_price))"""


def candidates(fx):
    from pricelode.operators.alerts import alert_candidates, cooldown_minima

    sent = cooldown_minima(fx.alerts.withColumn("canonical_id", F.col("canonical_id") * 100000 + 1), fx.alerts_as_of)
    return alert_candidates(deal_score_v2(fx), sent, 40, 20)


@query("deal_alert_candidates", COOL + " SELECT canonical_id, deal_score, confidence, best_price FROM fx_cand", hold=True)
def deal_alert_candidates(fx):
    return candidates(fx).select("canonical_id", "deal_score", "confidence", "best_price")


@query("top_alerts", COOL + " SELECT canonical_id, deal_score FROM fx_cand ORDER BY deal_score DESC, canonical_id LIMIT 5", hold=True)
def top_alerts(fx):
    return candidates(fx).orderBy(F.desc("deal_score"), "canonical_id").limit(5).select("canonical_id", "deal_score")


BEFORE = "fx_b AS (SELECT *, lag(price) OVER w AS before, lag(started_at) OVER w AS before_started FROM fx_changes WINDOW w AS (PARTITION BY variant_id, store_id ORDER BY started_at))"


@query(
    "discount_duration_v1",
    f"""WITH {BEFORE} SELECT variant_id, store_id, price, before AS old_price, round((epoch_us(started_at) - epoch_us(before_started)) / 86400000000.0::DOUBLE, 6) AS duration_days, epoch_us(started_at) - epoch_us(before_started) > 14 * 86400000000 AS is_fake, epoch_us(started_at) - epoch_us(before_started) < 7 * 86400000000 AS is_real,
  round((before - price) / before * 100, 4) AS discount_pct FROM fx_b WHERE ended_at IS NULL AND before > price""",
)
def discount_duration_v1(fx):
    return C.discount_duration(fx.changes)


TAGS = f"""{BEFORE}, fx_n AS (SELECT variant_id, store_id, count(*) FILTER (started_at > $AS_OF - INTERVAL 30 DAY) AS changes_30d FROM fx_changes GROUP BY ALL),
 fx_t AS (SELECT b.variant_id, b.store_id, changes_30d, CASE WHEN before = old_price THEN epoch_us(started_at) - epoch_us(before_started) END AS us FROM fx_b b JOIN fx_n n ON n.variant_id = b.variant_id AND n.store_id = b.store_id WHERE ended_at IS NULL),
 fx_tags AS (SELECT variant_id, store_id, CASE WHEN changes_30d > 3 THEN 'PRICE VOLATILE' WHEN us < 7 * 86400000000 THEN 'REAL SALE' WHEN us > 14 * 86400000000 THEN 'PERMANENT SALE' WHEN us IS NOT NULL THEN 'UNCERTAIN' ELSE 'DEAL' END AS discount_tag, changes_30d > 3 OR coalesce(us > 14 * 86400000000, false) AS is_fake, changes_30d FROM fx_t)"""


@query("discount_duration_v2", f"WITH {TAGS} SELECT * FROM fx_tags")
def discount_duration_v2(fx):
    return C.discount_tags(fx.changes, fx.as_of)


@query("time_at_price", "SELECT variant_id, store_id, h AS hours, CASE WHEN h < 24 THEN 'new' WHEN h < 72 THEN 'recent' ELSE 'stable' END AS band FROM (SELECT *, round((epoch_us($AS_OF) - epoch_us(started_at)) / 3600000000.0::DOUBLE, 1) AS h FROM fx_changes WHERE ended_at IS NULL)")
def time_at_price(fx):
    return C.time_at_price(fx.changes, fx.as_of)


@query(
    "deal_score_canonical",
    """WITH fx_i AS (SELECT canonical_id, store_id, current_price AS price FROM fx_moffers WHERE in_stock AND current_price > 0), fx_d AS (SELECT *, count(*) OVER (PARTITION BY canonical_id) AS n, abs(price - quantile_cont(price, 0.5) OVER (PARTITION BY canonical_id)) AS dev FROM fx_i),
 fx_m AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY canonical_id) AS mad FROM fx_d), fx_k AS (SELECT canonical_id, quantile_cont(price, 0.5) AS med FROM fx_m WHERE n < 3 OR mad = 0 OR dev / (1.4826 * mad) <= 3.5 GROUP BY 1),
 fx_w AS (SELECT canonical_id, count(DISTINCT store_id) AS num_stores, count(*) FILTER (in_stock) AS num_observations, min(current_price) FILTER (in_stock) AS best_price FROM fx_moffers GROUP BY 1),
 fx_c AS (SELECT *, CAST(floor(least(100, round((med - best_price) / med * 100 * 2, 6))) AS INTEGER) AS score FROM fx_w LEFT JOIN fx_k USING (canonical_id))
 SELECT canonical_id, coalesce(score, 0) AS deal_score, CASE WHEN best_price IS NULL THEN 0 ELSE CAST(floor(round((0.4 * least(1, ln(num_observations + 1) / ln(4)) + 0.4 * least(1, num_stores / 2) + 0.2) * 100, 6)) AS INTEGER) END AS confidence,
 CASE WHEN best_price IS NULL THEN 'OUT_OF_STOCK' WHEN score >= 80 THEN 'EXCELLENT_DEAL' WHEN score >= 60 THEN 'GOOD_DEAL' WHEN score >= 40 THEN 'FAIR_PRICE' ELSE 'OVERPRICED' END AS classification, best_price, coalesce(round(med, 4), 0) AS market_median, num_stores, num_observations FROM fx_c""",
    hold=True,
)
def deal_score_canonical(fx):
    return C.deal_score_canonical(fx.member_offers)


@query(
    "deal_score_simple",
    """WITH fx_m AS (SELECT canonical_id, min(current_price) AS price, quantile_cont(current_price, 0.5) AS med, min(current_price) FILTER (variant_id = canonical_id) AS own FROM fx_moffers GROUP BY 1)
 SELECT canonical_id, round(greatest(0, least(100, least(100, greatest(0, (med - own) / med * 200)) - least(20, (own - price) / med * 100))), 4) AS deal_score FROM fx_m WHERE own IS NOT NULL""",
    hold=True,
)
def deal_score_simple(fx):
    p = F.col("current_price").cast("double")
    df = fx.member_offers.groupBy("canonical_id").agg(F.min(p).alias("least"), T.median(p).alias("med"), F.min(F.when(F.col("variant_id") == F.col("canonical_id"), p)).alias("own")).where("own is not null")
    return df.select("canonical_id", F.round(C.simple_score(F.col("own"), F.col("med"), F.col("least")), 4).alias("deal_score"))


@query(
    "deal_score_enhanced",
    f"""WITH {TAGS}, fx_e AS (SELECT m.*, CAST(floor(greatest(0.1::DOUBLE, least(1.0::DOUBLE, reliability_score / 100)) * exp(-0.1::DOUBLE * greatest(0.0::DOUBLE, (epoch_us($AS_OF) - epoch_us(updated_at)) / 86400000000.0::DOUBLE)) * CASE WHEN in_stock THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * 1e9) AS BIGINT) AS weight FROM fx_moffers m JOIN fx_stores USING (store_id)),
 fx_ec AS (SELECT *, sum(weight) OVER (PARTITION BY canonical_id ORDER BY current_price) AS cum, sum(weight) OVER (PARTITION BY canonical_id) AS total FROM fx_e),
 fx_em AS (SELECT canonical_id, min(current_price) FILTER (cum * 2 >= total) AS med, min(current_price) AS lo, max(current_price) AS hi, count(*) AS n, count(DISTINCT store_id) AS stores, min(current_price) FILTER (in_stock) AS best, arg_min(struct_pack(s := store_id, v := variant_id), struct_pack(a := current_price, b := store_id, c := variant_id)) FILTER (in_stock) AS who FROM fx_ec GROUP BY 1),
 fx_ej AS (SELECT e.*, coalesce(t.discount_tag, 'DEAL') AS tag, coalesce(t.is_fake, false) AS fake FROM fx_em e LEFT JOIN fx_tags t ON t.variant_id = who.v AND t.store_id = who.s WHERE best IS NOT NULL),
 fx_es AS (SELECT *, least(100, least(80, greatest(0, (med - best) / med * 200)) + greatest(0, 20 - (best - lo) / med * 100)) AS s0, floor(least(100, stores * 25) * CASE WHEN n > 1 AND hi - lo > med * 0.5 THEN 0.7 ELSE 1 END) AS c0 FROM fx_ej),
 fx_et AS (SELECT *, CASE WHEN fake THEN greatest(0, s0 - 15) ELSE s0 END AS s1, CASE WHEN fake THEN floor(c0 * 0.8) ELSE c0 END AS c1 FROM fx_es)
 SELECT canonical_id, CAST(floor(round(s1, 6)) AS INTEGER) AS deal_score, CAST(c1 AS INTEGER) AS confidence, CASE WHEN s1 >= 80 AND c1 >= 70 THEN 'VERY GOOD DEAL' WHEN s1 >= 60 AND c1 >= 50 THEN 'GOOD DEAL' WHEN s1 >= 40 THEN 'NORMAL PRICE' ELSE 'BAD DEAL' END AS classification, best AS best_price, med AS market_median, tag AS discount_tag FROM fx_et""",
    hold=True,
)
def deal_score_enhanced(fx):
    return C.deal_score_enhanced(fx.member_offers, fx.stores, C.discount_tags(fx.changes, fx.as_of), fx.as_of)


PAST = "fx_hs AS (SELECT product_id, price FROM (SELECT product_id, price, count(*) OVER w AS n, quantile_cont(price, 0.5) OVER w AS med FROM fx_obs WHERE price > 0 AND price <= 20000 WINDOW w AS (PARTITION BY product_id)) WHERE n < 2 OR price BETWEEN med / 3.0::DOUBLE AND med * 3.0::DOUBLE), fx_best AS (SELECT product_id, min(current_price) AS best_price FROM fx_offers GROUP BY 1), fx_hl AS (SELECT product_id, best_price, quantile_cont(price, 0.5) AS h_median, min(price) AS h_low, max(price) AS h_high, avg(CASE WHEN price <= best_price THEN 1.0 ELSE 0.0 END) * 100 AS percentile FROM fx_hs JOIN fx_best USING (product_id) GROUP BY 1, 2 HAVING count(*) >= 3)"


@query("history_layer", f"WITH {PAST} SELECT product_id, best_price, round(h_median, 8) AS h_median, h_low, h_high, round(percentile, 8) AS percentile, round((h_median - best_price) / h_median * 100, 8) AS h_discount FROM fx_hl")
def history_layer(fx):
    best = prices(fx).groupBy("product_id").agg(F.min(F.col("price").cast("double")).alias("best_price"))
    return rounded(C.history_layer(best, fx.obs, ["product_id"]).drop("n"), "h_median", "percentile", "h_discount")


@query(
    "deal_metrics",
    f"""WITH {PAST}, {MAD}, {SANE.format(source='fx_offers', by='product_id')}, fx_cm AS (SELECT product_id, quantile_cont(current_price, 0.5) AS market_median FROM fx_sane GROUP BY 1), fx_tm AS (SELECT product_id, min(price) AS trusted FROM fx_keep GROUP BY 1),
 fx_op AS (SELECT product_id, max(old_price) AS old_price FROM fx_changes WHERE ended_at IS NULL GROUP BY 1),
 fx_j AS (SELECT b.product_id, b.best_price, market_median, (market_median - b.best_price) / market_median * 100 AS d, h_median, percentile, (h_median - b.best_price) / h_median * 100 AS hd, coalesce(old_price > h_median * 1.15::DOUBLE AND b.best_price >= h_median * 0.9::DOUBLE, false) AS fake
  FROM fx_best b JOIN fx_cm USING (product_id) JOIN fx_tm USING (product_id) LEFT JOIN fx_hl h ON h.product_id = b.product_id LEFT JOIN fx_op o ON o.product_id = b.product_id WHERE b.best_price > 0 AND b.best_price <= 20000 AND trusted = b.best_price)
 SELECT product_id, best_price, round(market_median, 4) AS market_median, CAST(floor(round(CASE WHEN h_median IS NOT NULL THEN 0.5 * least(100, greatest(0, d * 2)) + 0.5 * least(100, greatest(0, hd * 2)) ELSE least(100, greatest(0, d * 2)) END, 6)) AS INTEGER) AS deal_score, fake AS fake_discount,
 coalesce(nullif(concat_ws(', ', CASE WHEN hd >= 15 THEN 'below history' END, CASE WHEN percentile <= 15 THEN 'rare price' END, CASE WHEN d >= 15 THEN 'below market' END, CASE WHEN fake THEN 'old price overstated' END), ''), 'no gain') AS reasons FROM fx_j""",
    hold=True,
)
def deal_metrics(fx):
    old = fx.changes.where("ended_at is null").groupBy("product_id").agg(F.max(F.col("old_price").cast("double")).alias("old_price"))
    return C.deal_metrics(prices(fx), fx.obs.select("product_id", "price"), ["product_id"], old).drop("discount_pct")


PRICED_GROUPS = """fx_dp AS (SELECT DISTINCT canonical_id, current_price AS price FROM fx_moffers), fx_d1 AS (SELECT *, price > 0 AND price <= 20000 AS ok, count(*) OVER w AS n, abs(price - quantile_cont(price, 0.5) OVER w) AS dev, count(*) FILTER (price > 0 AND price <= 20000) OVER w AS sn, quantile_cont(price, 0.5) FILTER (price > 0 AND price <= 20000) OVER w AS smed FROM fx_dp WINDOW w AS (PARTITION BY canonical_id)),
 fx_d2 AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY canonical_id) AS mad FROM fx_d1),
 fx_dm AS (SELECT canonical_id, quantile_cont(price, 0.5) FILTER (ok AND (sn < 2 OR price BETWEEN smed / 3.0::DOUBLE AND smed * 3.0::DOUBLE)) AS med, list(price) FILTER (n < 3 OR mad = 0 OR dev / (1.4826 * mad) <= 3.5) AS trusted FROM fx_d2 GROUP BY 1)"""


@query(
    "dashboard_overview",
    f"""WITH {PRICED_GROUPS}, fx_b AS (SELECT m.canonical_id, v.sku, p.canonical_name AS name, v.brand, min(current_price) AS best_price, count(DISTINCT m.store_id) AS stores FROM fx_moffers m JOIN fx_variants v ON v.variant_id = m.canonical_id JOIN fx_products p ON p.product_id = v.product_id WHERE in_stock AND (p.canonical_name ILIKE '%e%' OR v.sku ILIKE '%e%' OR v.brand ILIKE '%e%') GROUP BY ALL),
 fx_s AS (SELECT *, (med - best_price) / med * 100 AS d FROM fx_b JOIN fx_dm USING (canonical_id) WHERE best_price > 0 AND best_price <= 20000 AND med IS NOT NULL AND list_contains(trusted, best_price))
 SELECT canonical_id, sku, name, brand, best_price, stores, round(med, 4) AS market_median, CAST(floor(round(least(100, greatest(0, d * 2)), 6)) AS INTEGER) AS deal_score, round(d, 4) AS discount_pct, (SELECT count(*) FROM fx_stores) AS all_stores, (SELECT count(*) FROM fx_products) AS all_products, (SELECT count(*) FROM fx_variants) AS all_variants, (SELECT count(*) FROM fx_matches) AS all_matches
 FROM fx_s WHERE floor(round(least(100, greatest(0, d * 2)), 6)) >= 40 ORDER BY deal_score DESC, discount_pct DESC, canonical_id LIMIT 50""",
    hold=True,
)
def dashboard_overview(fx):
    """Articles that a search finds, from a score of 40 on."""
    totals = {"stores": fx.stores, "products": fx.products, "variants": fx.variants, "matches": fx.matches}
    return C.dashboard(fx.member_offers, fx.variants, fx.products, totals, term="e", least_score=40)


POINTS = "fx_pts AS (SELECT canonical_id, store_id, ts, max(price) AS price FROM (SELECT canonical_id, store_id, started_at AS ts, price FROM fx_members JOIN fx_changes USING (variant_id) UNION ALL SELECT canonical_id, store_id, coalesce(ended_at, $AS_OF), price FROM fx_members JOIN fx_changes USING (variant_id)) WHERE price > 0 AND price <= 20000 GROUP BY ALL)"


@query(
    "product_detail_series",
    f"""WITH {POINTS}, fx_l AS (SELECT DISTINCT canonical_id, ts FROM fx_pts), fx_st AS (SELECT DISTINCT canonical_id, store_id FROM fx_pts)
 SELECT canonical_id, store_id, count(*) AS points, string_agg(strftime(ts, '%m-%d %H:%M'), ',' ORDER BY ts) AS labels, string_agg(coalesce(printf('%.2f', price), '-'), ',' ORDER BY ts) AS data FROM fx_st JOIN fx_l USING (canonical_id) LEFT JOIN fx_pts USING (canonical_id, store_id, ts) GROUP BY ALL""",
    hold=True,
)
def product_detail_series(fx):
    """A row per article and store: prices at all time points of the article, `-` where the store has none."""
    series = C.product_series(fx.members, fx.changes, fx.as_of)
    text = lambda p: F.coalesce(p.cast("decimal(12,2)").cast("string"), F.lit("-"))
    return series.select("canonical_id", "store_id", F.size("times").cast("long").alias("points"), F.array_join(F.transform("times", lambda t: F.date_format(t, "MM-dd HH:mm")), ",").alias("labels"), F.array_join(F.transform("prices", text), ",").alias("data"))


@query(
    "product_detail_offers",
    "SELECT canonical_id, s.name AS store, current_price AS price, in_stock, 'https://' || domain || '/products/' || variant_id AS url, row_number() OVER (PARTITION BY canonical_id ORDER BY current_price, m.store_id, variant_id) AS place FROM fx_moffers m JOIN fx_stores s USING (store_id)",
    hold=True,
)
def product_detail_offers(fx):
    """Offers of each article by price."""
    offers = fx.member_offers.join(fx.stores.select("store_id", F.col("name").alias("store"), "domain"), "store_id")
    url = N.product_url(F.concat(F.lit("https://"), "domain"), F.col("variant_id").cast("string"))
    ranked = C.offers_by_price(offers.withColumn("url", url), ["canonical_id"])
    return ranked.select("canonical_id", "store", F.col("current_price").alias("price"), "in_stock", "url", F.col("place").cast("long").alias("place"))


@query(
    "product_detail_stats",
    f"""WITH {POINTS}, fx_hp AS (SELECT canonical_id, count(*) * 2 AS hist_points FROM fx_members JOIN fx_changes USING (variant_id) WHERE price > 0 AND price <= 20000 GROUP BY 1)
 SELECT canonical_id, round(quantile_cont(current_price, 0.5), 4) AS market_median, min(current_price) AS market_min, max(current_price) AS market_max, count(DISTINCT store_id) AS store_count, coalesce(any_value(hist_points), 0) AS hist_points FROM fx_moffers LEFT JOIN fx_hp USING (canonical_id) GROUP BY 1""",
    hold=True,
)
def product_detail_stats(fx):
    return C.product_stats(fx.member_offers, fx.members, fx.changes)


@query(
    "top_product_market_report",
    """WITH fx_top AS (SELECT canonical_variant_id AS canonical_id, count(*) + 1 AS total_stores FROM fx_matches GROUP BY 1 ORDER BY total_stores DESC, canonical_id LIMIT 10), fx_r AS (SELECT canonical_id, coalesce(quantile_cont(current_price, 0.5) FILTER (in_stock), quantile_cont(current_price, 0.5)) AS med, coalesce(avg(current_price) FILTER (in_stock), avg(current_price)) AS mean, coalesce(min(current_price) FILTER (in_stock), min(current_price)) AS lo, coalesce(max(current_price) FILTER (in_stock), max(current_price)) AS hi,
  coalesce(min(current_price) FILTER (variant_id = canonical_id AND in_stock), min(current_price) FILTER (variant_id = canonical_id)) AS own, count(DISTINCT store_id) AS stores FROM fx_moffers GROUP BY 1),
 fx_rs AS (SELECT *, greatest(0, least(100, least(100, greatest(0, (med - own) / med * 200)) - least(20, (own - lo) / med * 100))) AS s FROM fx_top JOIN fx_r USING (canonical_id))
 SELECT r.canonical_id, p.canonical_name AS name, v.sku, total_stores, stores, own AS price, round(med, 4) AS median, round(mean, 6) AS average, lo AS least, hi AS most, round((med - own) / med * 100, 4) AS vs_median_pct, round(s, 4) AS deal_score, CASE WHEN s >= 80 THEN 'VERY GOOD DEAL' WHEN s >= 60 THEN 'GOOD DEAL' WHEN s >= 40 THEN 'NORMAL PRICE' ELSE 'BAD DEAL' END AS classification,
 row_number() OVER (PARTITION BY r.canonical_id ORDER BY o.current_price, o.store_id, o.variant_id) AS place, st.name AS offer_store, o.current_price AS offer_price, o.in_stock AS offer_in_stock
 FROM fx_rs r JOIN fx_variants v ON v.variant_id = r.canonical_id JOIN fx_products p ON p.product_id = v.product_id JOIN fx_moffers o ON o.canonical_id = r.canonical_id JOIN fx_stores st ON st.store_id = o.store_id""",
    hold=True,
)
def top_product_market_report(fx):
    """The ten most matched articles, a row per offer, by price."""
    return C.market_report(fx.matches, fx.member_offers, fx.variants, fx.products, fx.stores)
