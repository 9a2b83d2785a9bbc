"""Robust statistics of grouped prices, as windows and aggregates without Python."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.session import held

MAX_PRICE = 20000
OUTLIER_RATIO = 3.0
MAD_SCALE = 1.4826


def median(col):
    return F.percentile(col, F.lit(0.5))


def mad_kept(df, by, price="price", threshold=3.5):
    """Rows within threshold scaled median deviations; groups under 3 rows or without deviation stay whole."""
    w = Window.partitionBy(*by)
    p = F.col(price).cast("double")
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_med", median(p).over(w))
    df = df.withColumn("_dev", F.abs(p - F.col("_med"))).withColumn("_mad", median(F.col("_dev")).over(w))
    keep = (F.col("_n") < 3) | (F.col("_mad") == 0) | (F.col("_dev") / (MAD_SCALE * F.col("_mad")) <= threshold)
    return df.where(keep).drop("_n", "_med", "_dev", "_mad")


def iqr_kept(df, by, price="price", multiplier=1.5):
    """Rows within the quartiles widened by multiplier; groups under 4 rows stay whole."""
    w = Window.partitionBy(*by)
    p = F.col(price).cast("double")
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_q1", F.percentile(p, F.lit(0.25)).over(w)).withColumn("_q3", F.percentile(p, F.lit(0.75)).over(w))
    reach = multiplier * (F.col("_q3") - F.col("_q1"))
    return df.where((F.col("_n") < 4) | p.between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_n", "_q1", "_q3")


def sane(price):
    return (price > 0) & (price <= MAX_PRICE)


def is_sanitized(price, by, among=None):
    """Whether `sanitized` keeps a row's price among the rows of its group, or among those of them for which `among` holds."""
    w = Window.partitionBy(*by)
    valid = F.coalesce(sane(price) if among is None else sane(price) & among, F.lit(False))
    n, med = F.count_if(valid).over(w), median(F.when(valid, price)).over(w)
    return valid & ((n < 2) | price.between(med / OUTLIER_RATIO, med * OUTLIER_RATIO))


def is_mad_kept(price, by, among, threshold=3.5):
    """Whether `mad_kept` keeps a row's price among the rows of its group for which `among` holds."""
    w = Window.partitionBy(*by)
    valid = F.coalesce(among, F.lit(False))
    n, deviation = F.count_if(valid).over(w), F.when(valid, F.abs(price - median(F.when(valid, price)).over(w)))
    spread = median(deviation).over(w)
    return valid & ((n < 3) | (spread == 0) | (deviation / (MAD_SCALE * spread) <= threshold))


def sanitized(df, by, price="price"):
    """Sane prices of each group, and of two or more those within a factor 3 of their median."""
    w = Window.partitionBy(*by)
    p = F.col(price).cast("double")
    df = df.where(sane(p)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_med", median(p).over(w))
    return df.where((F.col("_n") < 2) | p.between(F.col("_med") / OUTLIER_RATIO, F.col("_med") * OUTLIER_RATIO)).drop("_n", "_med")


def weight_sums(df, by, value, weight, among=None):
    """df with running and whole sums of weights per group, and a function that gives the lower weighted quantile of a share as an aggregate.

    Only rows for which `among` holds are values; the weight of others must be 0. Ties of value are peers.
    """
    g = Window.partitionBy(*by)
    run = g.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_cum", F.sum(weight).over(run)).withColumn("_total", F.sum(weight).over(g))

    def at_share(num, den):
        reached = F.col("_cum") * den >= F.col("_total") * num
        return F.min(F.when(reached if among is None else reached & among, F.col(value)))

    return df, at_share


def value_band(value):
    """A whole number that grows with the value: sixteen to a doubling, with zero and negative values below."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-12))) * 16) + 1000
    return (F.signum(value) * size).cast("long")


def weighted_quantile(df, by, value, weight, shares, names):
    """Lower weighted quantiles per group: the least value with cumulative weight of at least the share.

    Ties of value are peers; rows without a value don't count. Whole-number
    weights make the sums exact. Weights are summed by value first, then by bands
    of values, and running sums are taken over a group's bands and over the values
    of one band, so that no window holds all rows, or all values, of a large group.
    """
    v = F.col(value)
    # Written, as both the bands and the values of the few that matter come from it.
    sums = held(df.where(v.isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w")).withColumn("_band", value_band(v.cast("double"))), "sums")
    group = Window.partitionBy(*by)
    bands = sums.groupBy(*by, "_band").agg(F.sum("_w").alias("_in"))
    bands = bands.withColumn("_upto", F.sum("_in").over(group.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_in").over(group))
    hit = lambda cum, num, den: F.col(cum) * den >= F.col("_total") * num
    # Of each share the first band that reaches it holds the value.
    first = bands.groupBy(*by).agg(*[F.min(F.when(hit("_upto", num, den), F.col("_band"))).alias(f"_b{k}") for k, (num, den) in enumerate(shares)])
    near = bands.join(first, by).where(" or ".join(f"_band = _b{k}" for k in range(len(shares))))
    run = Window.partitionBy(*by, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.join(near, [*by, "_band"]).withColumn("_cum", F.col("_upto") - F.col("_in") + F.sum("_w").over(run))
    return rows.groupBy(*by).agg(*[F.min(F.when((F.col("_band") == F.col(f"_b{k}")) & hit("_cum", num, den), v)).alias(name) for k, ((num, den), name) in enumerate(zip(shares, names, strict=True))])


def weighted_percentile(df, by, value, weight, share, name):
    """Weighted percentile per group, interpolated between the value that reaches the share and the one before."""
    order = Window.partitionBy(*by).orderBy(value)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    df = df.withColumn("_cum", F.sum("_w").over(run)).withColumn("_target", F.sum("_w").over(Window.partitionBy(*by)) * share).withColumn("_prev", F.lag(value).over(order))
    first = df.where(F.col("_cum") >= F.col("_target")).groupBy(*by).agg(F.min(F.struct(value, "_prev", "_cum", "_w", "_target")).alias("r"))
    v, p = F.col(f"r.{value}").cast("double"), F.col("r._prev").cast("double")
    inside = p + (F.col("r._target") - (F.col("r._cum") - F.col("r._w"))) / F.col("r._w") * (v - p)
    return first.select(*by, F.coalesce(inside, v).alias(name))


def confidence(observations, stores, variation):
    """0 to 1 from how many observations and stores there are and how much prices vary."""
    penalty = F.when(variation > 0.3, F.greatest(F.lit(0.5), 1 - (variation - 0.3) * 2)).otherwise(1.0)
    score = F.least(F.lit(1.0), F.log(observations + 1) / F.log(F.lit(4.0))) * 0.4 + F.least(F.lit(1.0), stores / F.lit(2.0)) * 0.4 + penalty * 0.2
    return F.when((observations < 1) | (stores < 1), 0.0).otherwise(score)


def market_metrics(df, by):
    """Of in-stock prices, or of all where none is in stock: median, mean, min, max; and numbers of stores."""
    p = F.col("price").cast("double")
    stocked = F.when(F.col("in_stock"), p)
    both = lambda f: F.coalesce(f(stocked), f(p))
    return df.groupBy(*by).agg(both(median).alias("median"), both(F.avg).alias("mean"), both(F.min).alias("min"), both(F.max).alias("max"), F.count_distinct("store_id").alias("stores"), F.count_distinct(F.when(F.col("in_stock"), F.col("store_id"))).alias("in_stock_stores"))


def robust_market_metrics(df, by):
    """Metrics of the prices that the median deviation keeps, and how far to trust them."""
    p = F.col("price").cast("double")
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("store_id").alias("stores"))
    q = lambda x: F.percentile(p, F.lit(x))
    kept = mad_kept(df, by).groupBy(*by).agg(q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("count"))
    joined = kept.join(whole, by)
    variation = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return joined.withColumn("outliers_removed", F.col("observations") - F.col("count")).withColumn("confidence", confidence(F.col("observations"), F.col("stores"), variation))
