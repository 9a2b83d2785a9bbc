"""Invariants of the tables as queries that return what breaks them."""

from pyspark.sql import functions as F


def multiple_open(changes):
    """Pairs with more than one open interval."""
    return changes.where("ended_at is null").groupBy("variant_id", "store_id").count().where("count > 1")


def match_violations(matches):
    """Numbers of self matches, of confidences outside 0 to 1, and of pairs and matched variants that repeat."""
    pairs = matches.groupBy("canonical_variant_id", "matched_variant_id").agg(F.count("*").alias("n"), F.count_if(F.col("canonical_variant_id") == F.col("matched_variant_id")).alias("own"), F.count_if(~F.col("confidence_score").between(0, 1)).alias("off"))
    per = pairs.groupBy("matched_variant_id").agg(F.sum("own").alias("own"), F.sum("off").alias("off"), F.count_if(F.col("n") > 1).alias("twice"), F.count("*").alias("canonicals"))
    return per.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("self_matches"), F.coalesce(F.sum("off"), F.lit(0)).alias("bad_confidence"), F.coalesce(F.sum("twice"), F.lit(0)).alias("repeated_pairs"), F.count_if(F.col("canonicals") > 1).alias("repeated_matched"))


def nonpositive(df, column, name):
    return df.agg(F.count_if(F.col(column) <= 0).alias("violations")).withColumn("table_name", F.lit(name))


def differing_colours(matches, variants):
    """Matches between different known colours."""
    c = variants.select("variant_id", "color")
    rows = matches.join(c.select(F.col("variant_id").alias("canonical_variant_id"), F.col("color").alias("c1")), "canonical_variant_id").join(c.select(F.col("variant_id").alias("matched_variant_id"), F.col("color").alias("c2")), "matched_variant_id")
    return rows.where("c1 <> c2").select("canonical_variant_id", "matched_variant_id", "c1", "c2")


def colour_coverage(df, raw, normalised):
    """Rows with a stated colour, those of them with a normalised one, and whether these are more than half."""
    given = df.where(F.col(raw).isNotNull() & (F.trim(raw) != ""))
    return given.agg(F.count(normalised).alias("coloured"), F.count("*").alias("total")).withColumn("holds", F.col("coloured") * 2 > F.col("total"))


def repeated_external(variants):
    """Stores' external ids, given and not empty, that several variants have."""
    return variants.where("external_id <> ''").groupBy("store_id", "external_id").agg(F.count("*").alias("n")).where("n > 1")


def outside(df, column, low, high):
    """Numbers of values outside a range, and of nulls."""
    return df.agg(F.count_if(~F.col(column).between(low, high)).alias("violations"), F.count_if(F.col(column).isNull()).alias("unknown"))
