"""Filters, joins, rankings and set operations over the retail tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.session import held


def plausible_change(new, old, low=0.25, high=4):
    """New to old price within a factor 4; passes without an old price."""
    ratio = new.cast("double") / old.cast("double")
    return old.isNull() | (old <= 0) | ratio.between(low, high)


def contains_text(term, *columns):
    """Any column contains the term, whatever its case; % and _ stand for themselves."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{escaped}%"), F.lit(False))
    return out


def of_platform(sites, platform):
    """url and notes of the sites of one platform."""
    return sites.where(F.col("platform") == platform).select("url", "notes")


def special_price_active(price, special, start, end, as_of):
    """A sale price counts when it is lower and as_of lies in its span; dates that can't be read don't limit."""
    since, until = F.coalesce(F.try_to_timestamp(start), as_of), F.coalesce(F.try_to_timestamp(end), as_of)
    return F.coalesce((special < price) & (as_of >= since) & (as_of <= until), F.lit(False))


def first_per(df, by, *order):
    """The first row of each group in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def global_rank(df, name, *order):
    """df with each row's place from 1 in the given order of all rows.

    Rows are dealt by ranges of the order, ranked within each, and moved on by
    the rows of the ranges before: only one row per range is ranked in one task.
    """
    dealt = held(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_within", within).join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def top_per(df, by, n, *order):
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def offer_context(offers, stores, variants, products):
    """Offers with what describes them; stores and products are joined as Catalyst sees fit."""
    return offers.join(stores, "store_id").join(variants.drop("product_id", "store_id", "brand"), "variant_id").join(products, "product_id")


def price_series(members, changes, as_of):
    """Start and end of every interval of a canonical's variants, as points of a step series."""
    rows = members.join(changes, "variant_id")
    ends = F.explode(F.array(F.col("started_at"), F.coalesce("ended_at", as_of))).alias("ts")
    return rows.select("canonical_id", "store_id", ends, "price")
