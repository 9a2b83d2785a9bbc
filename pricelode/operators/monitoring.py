"""Store reliability, freshness, and digests."""

from pyspark.sql import functions as F

from pricelode.operators.intervals import microseconds


def hours_since_sync(as_of):
    return microseconds(F.col("last_successful_sync"), as_of) / F.lit(3_600_000_000)


def store_reliability(stores, errors, as_of):
    """0 to 100 of stores that aren't dead: status up to 40, freshness up to 30, and 30 less penalties.

    errors: store_id, errors (currency errors of the last 30 days).
    """
    h, status, n = F.col("hours"), F.col("sync_status"), F.coalesce("errors", F.lit(0))
    up = F.when(status == "success", 40).when(status == "empty", 20).when(status == "error", 5).otherwise(10)
    fresh = F.when(h < 6, 30).when(h < 24, 20).when(h < 72, 10).otherwise(0)
    penalty = F.when(n > 10, 15).when(n > 5, 10).when(n > 0, 5).otherwise(0) + F.when(status == "error", 15).when(status == "empty", 10).otherwise(0)
    rows = stores.where("sync_status <> 'dead'").withColumn("hours", hours_since_sync(as_of)).join(errors, "store_id", "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), up + fresh + F.greatest(F.lit(0), 30 - penalty)))
    return rows.select("store_id", "name", "sync_status", score.alias("score"))


def reliability_band(score):
    return F.when(score >= 80, "Excellent (80-100)").when(score >= 60, "Good (60-79)").when(score >= 40, "Fair (40-59)").when(score >= 20, "Poor (20-39)").otherwise("Critical (0-19)")


def fresh_share(stores, as_of, hours=24):
    """One row: all stores, those synced within the hours, and their percentage."""
    fresh = F.count_if(hours_since_sync(as_of) <= hours)
    return stores.agg(F.count("*").alias("total"), fresh.alias("fresh"), F.try_divide(100.0 * fresh, F.count("*")).alias("percent"))


def digest_counts(tables, stores, as_of):
    """item, n: rows of the named tables, and stores that are fresh, in error or dead."""
    tagged = None
    for name, df in tables.items():
        # Counted where the table lies; one row a table is put together.
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        tagged = n if tagged is None else tagged.unionByName(n)
    state = stores.agg(F.count_if(hours_since_sync(as_of) <= 24).alias("fresh"), F.count_if(F.col("sync_status") == "error").alias("errors"), F.count_if(F.col("sync_status") == "dead").alias("dead"))
    return tagged.unionByName(state.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in state.columns])).alias("s")).select("s.*"))


def digest_deals(offers, members, products, least_stores=3, n=5):
    """The n cheapest products of matched variants with in-stock offers in least_stores stores or more."""
    rows = offers.where("in_stock").join(members.select("variant_id").distinct(), "variant_id", "left_semi")
    per = rows.groupBy("product_id").agg(F.min("current_price").alias("least"), F.count_distinct("store_id").alias("stores")).where(F.col("stores") >= least_stores)
    return per.join(products.select("product_id", "canonical_name", "brand"), "product_id").orderBy("least", "product_id").limit(n)


def freshness_problems(stores, as_of, stale=24, very_stale=72, dead=168):
    """Stores with trouble, one row per problem bucket that they fall in."""
    h = F.col("hours")
    rows = stores.withColumn("hours", hours_since_sync(as_of)).where(F.col("sync_status").isin("error", "empty") | (h > stale) | h.isNull())
    buckets = F.array_compact(F.array(F.when(F.col("sync_status").isin("error", "empty"), F.lit("errors")), F.when(h > dead, F.lit("dead")), F.when((h > very_stale) & (h <= dead), F.lit("very_stale")), F.when((h > stale) & (h <= very_stale), F.lit("stale"))))
    return rows.select("store_id", "name", "hours", F.explode_outer(buckets).alias("bucket"))
