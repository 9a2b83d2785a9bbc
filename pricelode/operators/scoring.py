"""Deal scores of articles across stores, from grouped aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.functions.normalize import freshness_decay
from pricelode.functions.statistics import confidence, is_mad_kept, is_sanitized, market_metrics, median, robust_market_metrics, sane, sanitized, weight_sums, weighted_quantile
from pricelode.operators.intervals import DAY_US, latest_open, microseconds
from pricelode.operators.shaping import contains_text, price_series

def classify(score, trust):
    return F.when((score >= 80) & (trust >= 70), "VERY GOOD DEAL").when((score >= 60) & (trust >= 50), "GOOD DEAL").when(score >= 40, "NORMAL PRICE").otherwise("BAD DEAL")


def classify_simple(score):
    return F.when(score >= 80, "VERY GOOD DEAL").when(score >= 60, "GOOD DEAL").when(score >= 40, "NORMAL PRICE").otherwise("BAD DEAL")


def weighted_history(members, changes, as_of):
    """Per canonical article: prices weighted by how long they held, over all its variants' intervals.

    All sums and extremes are partial aggregates; the quantiles go by bands of
    prices, so that an article with very many intervals is no task of its own.
    """
    rows = members.join(changes.where("price > 0"), "variant_id").withColumn("us", microseconds(F.col("started_at"), F.coalesce("ended_at", as_of))).withColumn("p", F.col("price").cast("double"))
    sums = rows.groupBy("canonical_id").agg(
        F.min("p").alias("least"),
        F.max("p").alias("most"),
        (F.sum("us") / DAY_US).alias("total_days"),
        F.max_by("p", F.struct(F.coalesce("ended_at", as_of), "started_at", -F.col("store_id"))).alias("current_price"),
        ((F.unix_micros(as_of) - F.unix_micros(F.max(F.coalesce("ended_at", as_of)))) / DAY_US).alias("days_since_update"),
        F.count("*").alias("intervals"),
    )
    shares = weighted_quantile(rows, ["canonical_id"], "p", "us", [(1, 2), (1, 10), (9, 10)], ["median", "p10", "p90"])
    return shares.join(sums, "canonical_id")


def cross_market(discount, best, least, market):
    """Score of a price against the market: twice the discount up to 80, and up to 20 for nearness to the lowest price."""
    base = F.least(F.lit(80.0), F.greatest(F.lit(0.0), discount * 2))
    near = F.when(least > 0, F.greatest(F.lit(0.0), 20 - (best - least) / market * 100)).otherwise(0.0)
    return F.when(market == 0, 0.0).otherwise(F.least(F.lit(100.0), base + near))


def deal_score_v2(offers, stores, history):
    """Half market, half history; offers has canonical_id, store_id, current_price, in_stock.

    Articles without stock, or without a sane price, get score 0.
    """
    s = stores.select("store_id", "name", F.col("reliability_score").cast("double").alias("reliability"))
    by = ["canonical_id"]
    rows = offers.join(s, "store_id").withColumn("price", F.col("current_price").cast("double"))
    # One pass over an article's offers: what is sane among all and among those in stock, then one aggregate.
    rows = rows.withColumns({"sane": is_sanitized(F.col("price"), by), "sane_stock": F.col("in_stock") & is_sanitized(F.col("price"), by, F.col("in_stock"))})
    # Whole-number weights, so that sums don't depend on the order of rows.
    rows = rows.withColumn("weight", F.when(F.col("sane"), F.greatest(F.lit(100), F.round(F.coalesce("reliability", F.lit(0.0)) * 100))).otherwise(0).cast("long"))
    rows, at_share = weight_sums(rows, by, "price", "weight", F.col("sane"))
    kept = F.when(F.col("sane"), F.col("price"))
    df = rows.groupBy(*by).agg(
        at_share(1, 2).alias("market_median"),
        F.min(kept).alias("market_min"),
        F.max(kept).alias("market_max"),
        F.count(kept).alias("sane"),
        F.min(F.when(F.col("sane_stock"), F.struct("price", "store_id", "name"))).alias("best"),
        F.count_distinct("store_id").alias("store_count"),
        F.count_if("in_stock").alias("in_stock_count"),
        F.avg(F.when(F.col("in_stock"), F.col("reliability"))).alias("trust"),
    )
    df = df.join(history, by, "left")
    best, med = F.col("best.price"), F.col("market_median")
    ok = best.isNotNull() & med.isNotNull()
    discount = F.when(ok & (med > 0), (med - best) / med * 100).otherwise(0.0)
    cross = cross_market(discount, best, F.col("market_min"), med)
    known = F.coalesce(F.col("intervals") >= 2, F.lit(False))
    past = F.when(best <= F.col("p10"), 80.0).when(F.col("median") > 0, F.least(F.lit(70.0), F.greatest(F.lit(0.0), (F.col("median") - best) / F.col("median") * 200))).otherwise(0.0)
    past = past * F.when(F.col("days_since_update") > 7, 0.7).otherwise(1.0) * F.when(F.col("total_days") > 30, 0.8).otherwise(1.0)
    score = F.when(~ok, 0.0).when(known, F.least(F.lit(100.0), cross * 0.5 + past * 0.5)).otherwise(cross)
    fresh = F.when(F.col("days_since_update") < 1, 1.0).when(F.col("days_since_update") < 7, 0.8).otherwise(0.5)
    wide = (F.col("sane") > 1) & (med > 0) & (F.col("market_max") - F.col("market_min") > med * 0.5)
    trust = F.least(F.lit(100.0), F.col("store_count") * 25.0) * F.when(wide, 0.7).otherwise(1.0) * fresh * (F.coalesce("trust", F.lit(50.0)) / 100)
    df = df.withColumn("deal_score", F.round(score, 4)).withColumn("confidence", F.when(ok, F.floor(F.round(trust, 6))).otherwise(0).cast("int"))
    kind = F.when(F.col("in_stock_count") == 0, "OUT OF STOCK").when(~ok, "SANITY REJECT").otherwise(classify(F.col("deal_score"), F.col("confidence")))
    reason = F.when(~ok, "none").when(best < med * 0.8, "below market").when(known & (best <= F.col("p10")), "rare price").otherwise("close to market")
    return df.select("canonical_id", "deal_score", "confidence", kind.alias("classification"), best.alias("best_price"), F.col("best.store_id").alias("best_store"), med.alias("market_median"), F.round(discount, 4).alias("discount_pct"), "store_count", "in_stock_count", reason.alias("reason"))


def best_deals(offers, stores, history, n=50, include_canonical=True):
    """The n best scored articles; without include_canonical the canonical variant's own offers don't count."""
    if not include_canonical:
        offers = offers.where("variant_id <> canonical_id")
    return deal_score_v2(offers, stores, history).where("deal_score > 0").orderBy(F.desc("deal_score"), "canonical_id").limit(n)


def deal_score_enhanced(offers, stores, tags, as_of):
    """Market score with offers weighted by reliability, freshness and stock; suspicious discounts cost 15 points.

    tags: variant_id, store_id, discount_tag, is_fake of offers' discounts.
    """
    by = ["canonical_id"]
    s = stores.select("store_id", (F.col("reliability_score").cast("double") / 100).alias("reliability"))
    rows = offers.join(s, "store_id").withColumn("price", F.col("current_price").cast("double"))
    weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("reliability"))) * freshness_decay(F.col("updated_at"), as_of) * F.when(F.col("in_stock"), 1.0).otherwise(0.1)
    # Whole-number weights, so that sums don't depend on the order of rows.
    rows = rows.withColumn("weight", F.floor(weight * 1e9).cast("long"))
    rows, at_share = weight_sums(rows, by, "price", "weight")
    whole = rows.groupBy(*by).agg(at_share(1, 2).alias("market_median"), F.min("price").alias("least"), F.max("price").alias("most"), F.count("*").alias("n"), F.count_distinct("store_id").alias("stores"), F.min(F.when(F.col("in_stock"), F.struct("price", "store_id", "variant_id"))).alias("best"))
    df = whole.where("best is not null").select("*", F.col("best.store_id").alias("store_id"), F.col("best.variant_id").alias("variant_id")).join(tags, ["variant_id", "store_id"], "left")
    best, med, fake = F.col("best.price"), F.col("market_median"), F.coalesce("is_fake", F.lit(False))
    score = cross_market((med - best) / med * 100, best, F.col("least"), med)
    score = F.when(fake, F.greatest(F.lit(0.0), score - 15)).otherwise(score)
    trust = F.floor(F.least(F.lit(100.0), F.col("stores") * 25.0) * F.when((F.col("n") > 1) & (F.col("most") - F.col("least") > med * 0.5), 0.7).otherwise(1.0))
    trust = F.when(fake, F.floor(trust * 0.8)).otherwise(trust)
    return df.select("canonical_id", F.floor(F.round(score, 6)).cast("int").alias("deal_score"), trust.cast("int").alias("confidence"), classify(score, trust).alias("classification"), best.alias("best_price"), "market_median", F.coalesce("discount_tag", F.lit("DEAL")).alias("discount_tag"))


def deal_score_canonical(offers):
    """Twice the discount from the robust median of in-stock prices."""
    by = ["canonical_id"]
    rows = offers.withColumn("price", F.col("current_price").cast("double"))
    whole = rows.groupBy(*by).agg(F.count_distinct("store_id").alias("num_stores"), F.count_if("in_stock").alias("num_observations"), F.min(F.when(F.col("in_stock"), F.col("price"))).alias("best_price"))
    metrics = robust_market_metrics(rows.where(F.col("in_stock") & (F.col("price") > 0)), by).select("canonical_id", F.col("median").alias("market_median"))
    df = whole.join(metrics, by, "left")
    med, best = F.col("market_median"), F.col("best_price")
    discount = F.when(med > 0, (med - best) / med * 100)
    score = F.floor(F.least(F.lit(100.0), F.round(discount * 2, 6))).cast("int")
    kind = F.when(best.isNull(), "OUT_OF_STOCK").when(score >= 80, "EXCELLENT_DEAL").when(score >= 60, "GOOD_DEAL").when(score >= 40, "FAIR_PRICE").otherwise("OVERPRICED")
    trust = F.floor(F.round(confidence(F.col("num_observations"), F.col("num_stores"), F.lit(0.0)) * 100, 6))
    return df.select("canonical_id", F.coalesce(score, F.lit(0)).alias("deal_score"), F.when(best.isNull(), 0).otherwise(trust).cast("int").alias("confidence"), kind.alias("classification"), "best_price", F.coalesce(F.round(med, 4), F.lit(0.0)).alias("market_median"), "num_stores", "num_observations")


def simple_score(price, market, least):
    """Twice the discount up to 100, less up to 20 for the distance from the lowest price."""
    base = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (market - price) / market * 200))
    far = F.when(least > 0, (price - least) / market * 100).otherwise(0.0)
    return F.when(market == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - F.least(F.lit(20.0), far))))


def history_layer(best, history, by):
    """Of sane past prices, where there are at least 3: median, low, high, share at or under the best price, discount."""
    rows = sanitized(history, by).join(best, by)
    p = F.col("price").cast("double")
    df = rows.groupBy(*by, "best_price").agg(F.count("*").alias("n"), median(p).alias("h_median"), F.min(p).alias("h_low"), F.max(p).alias("h_high"), (F.avg(F.when(p <= F.col("best_price"), 1.0).otherwise(0.0)) * 100).alias("percentile")).where("n >= 3")
    return df.withColumn("h_discount", (F.col("h_median") - F.col("best_price")) / F.col("h_median") * 100)


def deal_metrics(prices, history, by, old_prices, best=None):
    """Market and history halves with a gate on the best price, a flag for overstated old prices, and reasons.

    prices and history have a column price; old_prices has the stated old
    price, best the best_price of each group (else the lowest price). Without
    history (None) the market counts alone.
    """
    p = F.col("price").cast("double")
    rows = prices.withColumns({"sane": is_sanitized(p, by), "trusted": (p > 0) & is_mad_kept(p, by, p > 0)})
    df = rows.groupBy(*by).agg(median(F.when(F.col("sane"), p)).alias("market_median"), F.min(p).alias("least_price"), F.sort_array(F.collect_set(F.when(F.col("trusted"), p))).alias("trusted"))
    df = df.withColumnRenamed("least_price", "best_price") if best is None else df.drop("least_price").join(best, by)
    df = df.where(sane(F.col("best_price")) & F.col("market_median").isNotNull() & F.array_contains("trusted", F.col("best_price"))).drop("trusted")
    if history is None:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("h_median", "h_low", "h_high", "percentile", "h_discount")})
    else:
        df = df.join(history_layer(df.select(*by, "best_price"), history, by).drop("best_price", "n"), by, "left")
    df = df.withColumn("old_price", F.lit(None).cast("double")) if old_prices is None else df.join(old_prices, by, "left")
    b, hm = F.col("best_price"), F.col("h_median")
    discount = (F.col("market_median") - b) / F.col("market_median") * 100
    half = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x * 2))
    score = F.floor(F.round(F.when(hm.isNotNull(), 0.5 * half(discount) + 0.5 * half(F.col("h_discount"))).otherwise(half(discount)), 6)).cast("int")
    fake = F.coalesce((F.col("old_price") > hm * 1.15) & (b >= hm * 0.9), F.lit(False))
    reasons = F.array_compact(F.array(F.when(F.col("h_discount") >= 15, F.lit("below history")), F.when(F.col("percentile") <= 15, F.lit("rare price")), F.when(discount >= 15, F.lit("below market")), F.when(fake, F.lit("old price overstated"))))
    return df.select(*by, "best_price", F.round("market_median", 4).alias("market_median"), F.round(discount, 4).alias("discount_pct"), score.alias("deal_score"), fake.alias("fake_discount"), F.when(F.size(reasons) == 0, F.lit("no gain")).otherwise(F.array_join(reasons, ", ")).alias("reasons"))


def offers_by_price(offers, by):
    """Offers with their place in each group by price, from 1."""
    return offers.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("current_price", "store_id", "variant_id")))


def dashboard(offers, variants, products, totals, term=None, least_score=40, n=50):
    """The n best articles with stock: what they are, best price, stores, market score (deal_metrics), and rows of the named tables.

    offers are those of all members of an article; term is searched for in
    name, sku and brand.
    """
    by = ["canonical_id"]
    best = offers.where("in_stock").groupBy(*by).agg(F.min(F.col("current_price").cast("double")).alias("best_price"), F.count_distinct("store_id").alias("stores"))
    what = variants.select(F.col("variant_id").alias("canonical_id"), "sku", "brand", "product_id").join(products.select("product_id", F.col("canonical_name").alias("name")), "product_id").drop("product_id")
    if term:
        what = what.where(contains_text(term, "name", "sku", "brand"))
    prices = offers.select(*by, F.col("current_price").alias("price")).distinct()
    scored = deal_metrics(prices, None, by, None, best=best.select(*by, "best_price")).where(F.col("deal_score") >= least_score)
    rows = scored.drop("fake_discount", "reasons").join(best.drop("best_price"), by).join(what, by)
    top = rows.orderBy(F.desc("deal_score"), F.desc("discount_pct"), *by).limit(n).withColumn("one", F.lit(1))
    for name, df in totals.items():
        top = top.join(F.broadcast(df.agg(F.count("*").alias(f"all_{name}")).withColumn("one", F.lit(1))), "one")  # one row
    return top.drop("one")


def product_series(members, changes, as_of):
    """Per article and store: all time points of the article in order, and the store's price at each, null where it has none.

    Points are starts and ends of intervals with a sane price; of prices at one point the highest counts.
    """
    points = price_series(members, changes.where(sane(F.col("price"))), as_of).groupBy("canonical_id", "store_id", "ts").agg(F.max("price").alias("price"))
    own = points.groupBy("canonical_id", "store_id").agg(F.map_from_entries(F.collect_list(F.struct("ts", "price"))).alias("at"))
    times = points.groupBy("canonical_id").agg(F.sort_array(F.collect_set("ts")).alias("times"))
    return own.join(times, "canonical_id").select("canonical_id", "store_id", "times", F.transform("times", lambda t: F.try_element_at("at", t)).alias("prices"))


def product_stats(offers, members, changes):
    """Per article: median, least and highest price and stores of its offers, and points of its history."""
    p = F.col("current_price").cast("double")
    market = offers.groupBy("canonical_id").agg(F.round(median(p), 4).alias("market_median"), F.min(p).alias("market_min"), F.max(p).alias("market_max"), F.count_distinct("store_id").alias("store_count"))
    history = members.join(changes.where(sane(F.col("price"))), "variant_id").groupBy("canonical_id").agg((F.count("*") * 2).alias("hist_points"))
    return market.join(history, "canonical_id", "left").withColumn("hist_points", F.coalesce("hist_points", F.lit(0)))


def market_report(matches, offers, variants, products, stores, n=10):
    """The n articles with most matches: market prices, the canonical variant's own price, its score, and a row per offer by price."""
    by = ["canonical_id"]
    top = matches.groupBy(F.col("canonical_variant_id").alias("canonical_id")).agg((F.count("*") + 1).alias("total_stores")).orderBy(F.desc("total_stores"), *by).limit(n)
    rows = offers.join(top, by)
    p, own = F.col("current_price").cast("double"), F.col("variant_id") == F.col("canonical_id")
    market = market_metrics(rows.withColumn("price", F.col("current_price")), [*by, "total_stores"]).drop("in_stock_stores")
    price = rows.groupBy(*by).agg(F.coalesce(F.min(F.when(own & F.col("in_stock"), p)), F.min(F.when(own, p))).alias("price"))
    score = simple_score(F.col("price"), F.col("median"), F.col("min"))
    report = market.join(price, by).select(*by, "total_stores", "stores", "price", F.round("median", 4).alias("median"), F.round("mean", 6).alias("average"), F.col("min").alias("least"), F.col("max").alias("most"), F.round((F.col("median") - F.col("price")) / F.col("median") * 100, 4).alias("vs_median_pct"), F.round(score, 4).alias("deal_score"), classify_simple(score).alias("classification"))
    what = variants.select(F.col("variant_id").alias("canonical_id"), "sku", "product_id").join(products.select("product_id", F.col("canonical_name").alias("name")), "product_id").drop("product_id")
    listed = offers_by_price(rows.drop("total_stores"), by).join(stores.select("store_id", F.col("name").alias("offer_store")), "store_id")
    listed = listed.select(*by, F.col("place").cast("long").alias("place"), "offer_store", F.col("current_price").alias("offer_price"), F.col("in_stock").alias("offer_in_stock"))
    return report.join(what, by).join(listed, by)


def discount_duration(changes):
    """Days that the higher price before an open interval had held; over 14 counts as fake, under 7 as real."""
    w = Window.partitionBy("variant_id", "store_id").orderBy("started_at")
    rows = changes.withColumn("before", F.lag(F.struct("price", "started_at", "ended_at")).over(w)).where(F.col("ended_at").isNull() & (F.col("before.price") > F.col("price")))
    us = microseconds(F.col("before.started_at"), F.col("started_at"))
    old, new = F.col("before.price").cast("double"), F.col("price").cast("double")
    return rows.select("variant_id", "store_id", "price", F.col("before.price").alias("old_price"), F.round(us / DAY_US, 6).alias("duration_days"), (us > 14 * DAY_US).alias("is_fake"), (us < 7 * DAY_US).alias("is_real"), F.round((old - new) / old * 100, 4).alias("discount_pct"))


def discount_tags(changes, as_of):
    """Tag of each open interval by how long its old price had held, and by how often the price changes."""
    w = Window.partitionBy("variant_id", "store_id").orderBy("started_at")
    rows = changes.withColumn("before", F.lag(F.struct("price", "started_at", "ended_at")).over(w))
    recent = F.col("started_at") > as_of - F.expr("INTERVAL 30 DAYS")
    often = changes.groupBy("variant_id", "store_id").agg(F.count_if(recent).alias("changes_30d"))
    rows = rows.where(F.col("ended_at").isNull()).join(often, ["variant_id", "store_id"])
    us = F.when(F.col("before.price") == F.col("old_price"), microseconds(F.col("before.started_at"), F.col("started_at")))
    volatile = F.col("changes_30d") > 3
    tag = F.when(volatile, "PRICE VOLATILE").when(us < 7 * DAY_US, "REAL SALE").when(us > 14 * DAY_US, "PERMANENT SALE").when(us.isNotNull(), "UNCERTAIN").otherwise("DEAL")
    return rows.select("variant_id", "store_id", tag.alias("discount_tag"), (volatile | F.coalesce(us > 14 * DAY_US, F.lit(False))).alias("is_fake"), "changes_30d")


def time_at_price(changes, as_of):
    """Hours that the current price has held, and its band."""
    rows = latest_open(changes)
    hours = F.bround(microseconds(F.col("started_at"), as_of) / F.lit(3_600_000_000), 1)
    return rows.select("variant_id", "store_id", hours.alias("hours"), F.when(hours < 24, "new").when(hours < 72, "recent").otherwise("stable").alias("band"))
