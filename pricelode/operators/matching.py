"""The same article across stores."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelode.session import held

# Codes that say nothing.
STOP_SKUS = ("ONE SIZE", "ONESIZE", "DEFAULT", "N/A", "NA", "STD", "STANDARD", "TEST", "UNIVERSAL", "GENERIC", "OS")


def normalize_sku(sku):
    return F.upper(F.trim(sku))


def brand_key(*names):
    """The first name that is given, as lower-case letters and digits without a leading `by`; empty is null."""
    name = F.coalesce(*[F.nullif(n, F.lit("")) for n in names])
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "^by", "")


def is_gtin_ean(ean):
    return F.coalesce(F.trim(ean).rlike("^[0-9]{12,14}$"), F.lit(False))


def is_gtin_sku(sku):
    return F.coalesce(F.trim(sku).rlike("^[0-9]{12,13}$"), F.lit(False))


def eligible_sku(sku):
    s = F.trim(sku)
    numeric = s.rlike("^[0-9]+$")
    return (F.length(s) > 4) & ~F.upper(s).isin(*STOP_SKUS) & ~s.rlike("^[0-9]{1,6}$") & ~(numeric & ~F.length(s).isin(12, 13))


def quality_score(ean, size, color, gender, sku):
    """How well a variant is described."""
    worth = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    return worth(is_gtin_ean(ean), 100) + worth(size != "", 10) + worth(color != "", 10) + worth(gender != "UNKNOWN", 5) + worth(is_gtin_sku(sku), 50) + worth(F.length(F.trim(sku)) > 6, 5)


def normalized_variants(variants, offers):
    """Eligible variants that have an offer, with the columns that matching needs; offer_stores is the set of a variant's stores."""
    stores = offers.groupBy("variant_id").agg(F.collect_set("store_id").alias("offer_stores"))
    rows = variants.where(eligible_sku(F.col("sku"))).join(stores, "variant_id")
    return rows.select(
        "variant_id",
        "store_id",
        normalize_sku(F.col("sku")).alias("sku"),
        F.nullif(F.trim("ean"), F.lit("")).alias("ean"),
        "size",
        "color",
        "gender",
        brand_key(F.col("brand")).alias("brand_key"),
        is_gtin_ean(F.col("ean")).alias("ean_gtin"),
        is_gtin_sku(F.col("sku")).alias("sku_gtin"),
        quality_score(F.col("ean"), F.col("size"), F.col("color"), F.col("gender"), F.col("sku")).alias("quality"),
        "offer_stores",
    )


def rank_canonical(norm):
    """Variants of each sku by quality, best first."""
    return norm.withColumn("rank", F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("quality"), "variant_id")))


def match_group_stats(norm):
    """Per sku: stores, brands, canonical variant (by a partial aggregate), and whether EANs conflict."""
    best = F.max_by(F.struct("variant_id", "size", "color", "gender", "offer_stores"), F.struct("quality", -F.col("variant_id")))
    return norm.groupBy("sku").agg(F.count_distinct("store_id").alias("stores"), F.count_distinct("brand_key").alias("brands"), best.alias("canonical"), (F.min("ean") != F.max("ean")).alias("ean_conflict"), F.count("*").alias("variants"))


def shared_store_pairs(pairs, offers):
    """Pairs (canonical_variant_id, matched_variant_id) that have offers in a common store."""
    o = offers.select("variant_id", "store_id")
    left = pairs.join(o, pairs.canonical_variant_id == o.variant_id).select("canonical_variant_id", "matched_variant_id", "store_id")
    right = o.withColumnRenamed("variant_id", "matched_variant_id")
    return left.join(right, ["matched_variant_id", "store_id"], "left_semi").select("canonical_variant_id", "matched_variant_id").distinct()


#: A sku with more variants than this is dealt over tasks when they are held against its canonical one.
HOT_SKU = 100_000


def match_clauses():
    """What a variant must meet beside the canonical one of its sku, by name."""
    gtin = F.col("ean_gtin") | F.col("sku_gtin")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"canonical.{c}"), F.lit(False))
    neither = lambda c: F.col(c).isNull() & F.col(f"canonical.{c}").isNull() & gtin
    return {
        "several stores": F.col("stores") >= 2,
        "not itself": F.col("variant_id") != F.col("canonical.variant_id"),
        "no conflict of EANs": F.col("ean").isNull() | ~F.coalesce("ean_conflict", F.lit(False)),
        "one brand": gtin | (F.col("brands") == 1),
        "size": same("size") | neither("size"),
        "color": same("color") | neither("color"),
        "gender": (same("gender") & (F.col("gender") != "UNKNOWN")) | gtin,
    }


def beside_group(norm, hot=HOT_SKU):
    """Variants beside what their sku's group says of it (match_group_stats).

    Both are written first, so that the variants are normalised once. Skus above
    `hot` variants get as many salts as they have lots of that size: their
    group's row is repeated for each salt, and their variants are dealt among them.
    """
    norm = held(norm, "normalized")
    stats = held(match_group_stats(norm), "groups")
    frequent = stats.where(F.col("variants") > hot).select("sku", F.ceil(F.col("variants") / hot).cast("int").alias("_lots"))
    if frequent.isEmpty():
        return norm.join(stats, "sku")
    salted = norm.join(frequent, "sku", "left").withColumn("_salt", F.when(F.col("_lots").isNull(), 0).otherwise(F.pmod(F.xxhash64("variant_id"), F.col("_lots"))).cast("int"))
    repeated = stats.join(frequent, "sku", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_lots", F.lit(1)) - 1)))
    return salted.drop("_lots").join(repeated.drop("_lots"), ["sku", "_salt"]).drop("_salt")


def match_candidates(variants, offers, apart=False, without=(), hot=HOT_SKU):
    """Matches before the common-store test, or with apart after it: by the stores of each variant and its canonical one, without a join of offers.

    without: names of clauses (match_clauses) that are left out.
    """
    n = beside_group(normalized_variants(variants, offers), hot)
    for name, clause in match_clauses().items():
        n = n if name in without else n.where(clause)
    if apart:
        n = n.where(~F.arrays_overlap("offer_stores", "canonical.offer_stores"))
    method = F.when(F.col("ean_gtin"), "ean_gtin").when(F.col("sku_gtin"), "sku_gtin").otherwise("sku_exact")
    confidence = F.when(F.col("ean_gtin"), 0.99).when(F.col("sku_gtin"), 0.97).otherwise(0.95).cast("decimal(3,2)")
    return n.select(F.col("canonical.variant_id").alias("canonical_variant_id"), F.col("variant_id").alias("matched_variant_id"), method.alias("match_method"), confidence.alias("confidence_score"))


def match_products(variants, offers):
    """canonical_variant_id, matched_variant_id, match_method, confidence_score."""
    return match_candidates(variants, offers, apart=True)
