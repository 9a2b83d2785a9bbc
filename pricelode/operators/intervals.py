"""Price history as valid-time intervals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

PAIR = ("variant_id", "store_id")
DAY_US = 86_400_000_000


def build_price_intervals(observations, carried=()):
    """Intervals of equal price per (variant, store): started_at, ended_at (null: still open), old_price, and the carried columns of the row that opened it.

    An observation opens an interval only if its price differs from the one before.
    """
    w = Window.partitionBy(*PAIR).orderBy("ts")
    kept = observations.withColumn("old_price", F.lag("price").over(w)).where(~F.col("price").eqNullSafe(F.col("old_price")))
    return kept.select("variant_id", "product_id", "store_id", "price", "old_price", F.col("ts").alias("started_at"), F.lead("ts").over(w).alias("ended_at"), *carried)


def amend_price_intervals(changes, history, late):
    """changes after observations that came too late for them: the pairs that late rows are of are built anew from their history and these, all others stay.

    A late row may fall inside a closed interval, which it splits, or at an
    interval's start, which it moves. history: all observations so far, as
    intervals don't say when an equal price was seen again. Of rows of one pair
    and time the lowest price counts.
    """
    touched = late.select(*PAIR).distinct()
    columns = [*PAIR, "product_id", "ts", "price"]
    rows = history.join(touched, list(PAIR), "left_semi").select(*columns).unionByName(late.select(*columns))
    once = rows.groupBy(*PAIR, "ts").agg(F.min("product_id").alias("product_id"), F.min("price").alias("price"))
    return changes.join(touched, list(PAIR), "left_anti").unionByName(build_price_intervals(once))


def microseconds(start, end):
    """Exact length of [start, end) as a long."""
    return F.unix_micros(end) - F.unix_micros(start)


def interval_hours(changes, as_of):
    """Whole-second exact length in hours and days; an open interval ends at as_of."""
    us = microseconds(F.col("started_at"), F.coalesce("ended_at", as_of))
    return changes.withColumn("hours", us / F.lit(3_600_000_000)).withColumn("days", us / F.lit(DAY_US))


def adjacent_drops(changes):
    """Open intervals whose predecessor ended when they began at a higher price."""
    w = Window.partitionBy(*PAIR).orderBy("started_at")
    before = changes.withColumn("prev_price", F.lag("price").over(w)).withColumn("prev_started", F.lag("started_at").over(w)).withColumn("prev_ended", F.lag("ended_at").over(w))
    return before.where(F.col("ended_at").isNull() & (F.col("prev_ended") == F.col("started_at")) & (F.col("prev_price") > F.col("price")))


def overlapping(changes, as_of):
    """Intervals that begin before an earlier one of the pair has ended."""
    # Intervals that begin at one instant are peers: only earlier ones count.
    w = Window.partitionBy(*PAIR).orderBy(F.unix_micros("started_at")).rangeBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("reach", F.max(F.coalesce("ended_at", as_of)).over(w)).where(F.col("reach") > F.col("started_at")).drop("reach")


def overlap_pairs(changes, as_of):
    """Each pair of intervals of one variant and store of which the second begins within the first.

    Only intervals that a running maximum shows to begin too early are joined
    to those before, so tables without overlaps are not paired at all.
    """
    end = F.coalesce("ended_at", as_of)
    second = overlapping(changes, as_of).select(*PAIR, F.col("price").alias("second_price"), F.col("started_at").alias("second_started"))
    first = changes.select(*PAIR, F.col("price").alias("first_price"), F.col("started_at").alias("first_started"), end.alias("first_ended"))
    return first.join(second, list(PAIR)).where((F.col("first_started") < F.col("second_started")) & (F.col("second_started") < F.col("first_ended")))


def latest_open(changes):
    """The newest open interval of each pair."""
    rows = changes.where(F.col("ended_at").isNull())
    last = rows.groupBy(*PAIR).agg(F.max(F.struct("started_at", "price", "old_price")).alias("o"))
    return last.select(*PAIR, "o.started_at", "o.price", "o.old_price")


def change_frequency(changes, as_of, days=30):
    """Intervals of each pair that began within the last days."""
    return changes.groupBy(*PAIR).agg(F.count_if(F.col("started_at") > F.timestamp_add("DAY", F.lit(-days), as_of)).alias("changes"))


def backfill_interval_context(changes, stores, variants):
    """Region (here currency area) of the store, size of the variant, and stock that defaults to true."""
    s = stores.select("store_id", F.col("currency").alias("region"))
    v = variants.select("variant_id", F.col("size").alias("normalized_size"))
    return changes.join(s, "store_id", "left").join(v, "variant_id", "left").withColumn("in_stock", F.lit(True))
