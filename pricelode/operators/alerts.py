"""Alerts: cooldown, labels and their precision."""

from pyspark.sql import functions as F


def cooldown_minima(alerts, as_of, hours=24):
    """Least alerted price per article within the last hours."""
    return alerts.where(F.col("sent_at") > as_of - F.make_interval(hours=F.lit(hours))).groupBy("canonical_id").agg(F.min("price").alias("least_price"))


def alert_candidates(scores, sent, least_score=70, least_confidence=50):
    """Scored articles worth an alert that weren't alerted lately, or are 5 % cheaper than then."""
    rows = scores.where((F.col("deal_score") >= least_score) & (F.col("confidence") >= least_confidence)).join(sent, "canonical_id", "left")
    return rows.where(F.col("least_price").isNull() | (F.col("best_price") < 0.95 * F.col("least_price").cast("double")))


def match_queue(matches, labels, variants, offers, stores):
    """Matches without a label and what tells their two sides apart, ordered by stratum (the method) and ids."""
    keys = ["canonical_variant_id", "matched_variant_id"]
    rows = matches.join(labels.select(*keys), keys, "left_anti").withColumnRenamed("match_method", "stratum")
    side = variants.join(offers.select("variant_id", "current_price"), "variant_id").join(stores.select("store_id", "name"), "store_id")
    for key, mark in zip(keys, "ab", strict=True):
        own = ["sku"] if mark == "a" else []
        rows = rows.join(side.select(F.col("variant_id").alias(key), *own, *[F.col(c).alias(f"{to}_{mark}") for c, to in (("brand", "brand"), ("name", "store"), ("size", "size"), ("color", "color"), ("current_price", "price"))]), key)
    return rows.drop("confidence_score").orderBy("stratum", *keys)


def label_queue(alerts, stores, offers, variants, products, matches, n=20):
    """The newest n alerts without a label, with store and, where an offer of the store has the alert's price, what it is of.

    alerts: alert_id, sent_at, store_id, price, label.
    """
    open_ = alerts.where("label is null").join(stores.select("store_id", F.col("name").alias("store")), "store_id")
    priced = offers.select("store_id", F.col("current_price").alias("price"), "variant_id")
    of_variant = variants.select("variant_id", "product_id", "sku", "brand")
    # The newest alerts are found first, so that only they are joined; each has at least one row.
    newest = open_.orderBy(F.desc("sent_at"), "alert_id").limit(n)
    rows = newest.join(priced, ["store_id", "price"], "left").join(of_variant, "variant_id", "left").join(products.select("product_id", "canonical_name"), "product_id", "left")
    rows = rows.join(matches.select(F.col("matched_variant_id").alias("variant_id"), "canonical_variant_id").distinct(), "variant_id", "left")
    out = ["alert_id", "sent_at", "store", "price", "canonical_name", "brand", "sku", "canonical_variant_id"]
    return rows.select(*out).distinct().orderBy(F.desc("sent_at"), "alert_id", *out[4:]).limit(n)


def auto_labels(alerts, offers):
    """Label 1 or 0 for alerts that the market settles, none for the rest; at least two stores are needed."""
    p = F.col("current_price").cast("double")
    market = offers.groupBy("canonical_id").agg(F.count_distinct("store_id").alias("stores"), F.percentile(p, F.lit(0.5)).alias("med"), F.min(p).alias("lo")).where("stores >= 2 and med > 0 and lo > 0")
    rows = alerts.join(market, "canonical_id")
    price = F.col("price").cast("double")
    discount, far = (F.col("med") - price) / F.col("med") * 100, (price - F.col("lo")) / F.col("med") * 100
    label = F.when((discount >= 15) & (far <= 20) & (F.col("stores") >= 3), 1).when((discount < 5) | (far > 50), 0)
    return rows.withColumn("auto_label", label).where("auto_label is not null").select("alert_id", "auto_label", "stores")


def precision_metrics(alerts, as_of, days=30):
    """True and false positives of the labelled alerts of the last days, and their precision in percent."""
    rows = alerts.where(F.col("sent_at") > as_of - F.make_interval(days=F.lit(days)))
    good, seen = F.count_if(F.col("label") == 1), F.count("label")
    return rows.agg(good.alias("true_positives"), F.count_if(F.col("label") == 0).alias("false_positives"), seen.alias("labeled"), F.count("*").alias("total_alerts"), F.round(F.try_divide(100.0 * good, seen), 1).alias("precision_pct"))
