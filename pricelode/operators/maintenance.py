"""Upserts, merges and backfills as DataFrame rewrites.

Plain Parquet has no MERGE: each function returns the new table, to be written
beside the old one and swapped in.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pricelode.functions.statistics import sane
from pricelode.operators.shaping import plausible_change


def brand_name_key(name):
    return F.lower(F.trim(F.coalesce(name, F.lit("unknown"))))


def upsert_brands(brands, incoming):
    """brands (brand_id, name, normalized_name) and the incoming names that none has; ids are hashes of the key."""
    new = incoming.select(F.coalesce("name", F.lit("Unknown")).alias("name"), brand_name_key(F.col("name")).alias("normalized_name"))
    new = new.groupBy("normalized_name").agg(F.min("name").alias("name")).join(brands.select("normalized_name"), "normalized_name", "left_anti")
    return brands.select("brand_id", "name", "normalized_name").unionByName(new.select(F.xxhash64("normalized_name").alias("brand_id"), "name", "normalized_name"))


def upsert_stores(stores, incoming, region=None):
    """Match by domain, else by name (then domain and currency are taken over), else create.

    A domain that comes several times is one store, under its least name; of
    stored stores that share a name the least id is meant, and it takes over the
    least of several new domains. region: a function of the domain's column for
    new stores; without it, or a region column, regions stay null.
    """
    given = lambda df, c: (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
    s = stores.select("store_id", "name", "domain", "currency", given(stores, "region"))
    once = incoming.groupBy("domain").agg(F.min(F.struct("name", "currency")).alias("r")).select("domain", "r.*")
    unknown = once.join(s.select("domain").distinct(), "domain", "left_anti")
    by_name = s.where("name is not null").groupBy("name").agg(F.min("store_id").alias("store_id"))
    found = unknown.join(by_name, "name", "left")
    renamed = found.where("store_id is not null").groupBy("store_id").agg(F.min(F.struct("domain", "currency")).alias("new"))
    kept = s.join(renamed, "store_id", "left").select("store_id", "name", F.coalesce("new.domain", "domain").alias("domain"), F.coalesce("new.currency", "currency").alias("currency"), "region")
    new = found.where("store_id is null").select(F.xxhash64("domain").alias("store_id"), "name", "domain", "currency", (region(F.col("domain")) if region else F.lit(None).cast("string")).alias("region"))
    return kept.unionByName(new)


def upsert_products(products, incoming):
    """Products by brand and name; new ones come once."""
    keys = ["brand", "canonical_name"]
    new = incoming.groupBy(*keys).agg(F.min("category").alias("category")).join(products.select(*keys).distinct(), keys, "left_anti")
    return products.unionByName(new.select(F.xxhash64(*keys).alias("product_id"), *keys, "category"))


def resolve_variant_identity(variants, incoming):
    """incoming (external_id, product_id, store_id, sku) with the variant it is: by store and external id, else product and sku, else new."""
    one = variants.select(F.col("variant_id").alias("v1"), "store_id", F.col("external_id"))
    two = variants.groupBy("product_id", "sku").agg(F.min("variant_id").alias("v2"))
    rows = incoming.join(one, ["store_id", "external_id"], "left").join(two, ["product_id", "sku"], "left")
    return rows.select("store_id", "external_id", "product_id", "sku", F.coalesce("v1", "v2", F.xxhash64("store_id", "external_id")).alias("variant_id"), F.when(F.col("v1").isNotNull(), "external").when(F.col("v2").isNotNull(), "sku").otherwise("new").alias("how"))


OFFER_COLUMNS = ("current_price", "old_price", "in_stock", "updated_at", "url", "original_currency", "exchange_rate", "exchange_rate_timestamp", "exchange_rate_source", "currency_source", "parser_version", "raw_snapshot_id")
_OUTCOMES = {"r": "rejected", "s": "skipped", "i": "imported", "u": "updated"}


def replay(offers, incoming):
    """incoming with its outcome, its place (`_at`) among the rows of its variant and store, which go by time, and the stored offer's price (`_before`).

    Each row is held against the last accepted price before it: that of the
    stored offer at first, then that of the last row which was imported or
    updated the offer. Rows of one time go from the highest price down. The rows
    of one variant and store in one batch are folded in one array, with a letter
    for each row as the only thing that grows.
    """
    keys = ["variant_id", "store_id"]
    before = offers.select(*keys, F.col("current_price").alias("_before"), F.lit(True).alias("_known"))
    price = F.col("current_price")
    rejected = price.isNull() | (F.col("reject_reason").isNotNull() if "reject_reason" in incoming.columns else F.lit(False))
    rest = [c for c in incoming.columns if c not in (*keys, "updated_at")]
    row = F.struct("updated_at", (-price).alias("_down"), rejected.alias("_rejected"), *rest)
    lots = incoming.select(*keys, row.alias("r")).groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("rows")).join(before, keys, "left")
    kind = incoming.schema["current_price"].dataType

    def step(acc, r):
        good = ~r["_rejected"] & F.coalesce(sane(r["current_price"]) & plausible_change(r["current_price"], acc["price"]), F.lit(False))
        letter = F.when(r["_rejected"], "r").when(~good, "s").when(acc["known"], "u").otherwise("i")
        return F.struct(F.when(good, r["current_price"]).otherwise(acc["price"]).cast(kind).alias("price"), (acc["known"] | good).alias("known"), F.concat(acc["said"], letter).alias("said"))

    start = F.struct(F.col("_before").cast(kind).alias("price"), F.coalesce("_known", F.lit(False)).alias("known"), F.lit("").alias("said"))
    folded = lots.select(*keys, "rows", "_before", F.aggregate("rows", start, step, lambda acc: acc["said"]).alias("said"))
    flat = folded.select(*keys, "said", "_before", F.posexplode("rows").alias("_at", "r"))
    letter = F.substring("said", F.col("_at") + 1, F.lit(1))
    outcome = F.element_at(F.create_map(*[F.lit(x) for pair in _OUTCOMES.items() for x in pair]), letter)
    return flat.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in incoming.columns], outcome.alias("outcome"), "_at", "_before")


def import_outcomes(offers, incoming):
    """incoming with its outcome: rejected, skipped, imported or updated.

    Rejected rows have a reject_reason (or no price); skipped ones have an
    insane price, or one that no plausible change leads to from the last
    accepted price, be that the stored offer's or an earlier row's (replay).
    """
    return replay(offers, incoming).drop("_at", "_before")


def accepted(observations, price="price", ts="ts"):
    """Observations that a replay from nothing accepts; jumps beyond plausible changes go."""
    keys = ["variant_id", "store_id"]
    none = observations.sparkSession.createDataFrame([], "variant_id long, store_id long, current_price double")
    rows = replay(none, observations.withColumnsRenamed({price: "current_price", ts: "updated_at"}))
    return rows.where(F.col("outcome").isin("imported", "updated")).drop("outcome", "_at", "_before").withColumnsRenamed({"current_price": price, "updated_at": ts}).select(*keys, *[c for c in observations.columns if c not in keys])


def upsert_offers(offers, incoming):
    """The last accepted row of each variant and store; without one the offer stays as it is.

    Accepted are sane prices within a plausible change of the last accepted
    price (replay). A row brings its own stated old price, url, snapshot and
    currency provenance; what either table lacks is null. Of rows of one time
    the lowest price wins.
    """
    keys = ["variant_id", "store_id"]
    kinds = {f.name: f.dataType for df in (incoming, offers) for f in df.schema.fields}
    kinds.setdefault("old_price", kinds["current_price"])
    columns = [c for c in OFFER_COLUMNS if c in kinds]
    whole = lambda df, at: df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns], at.alias("_at"))
    taken = replay(offers, incoming).where(F.col("outcome").isin("imported", "updated"))
    both = whole(offers, F.lit(-1)).unionByName(whole(taken, F.col("_at")))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_at").alias("o"))
    return last.select(*keys, "o.*")


def offer_bucket(buckets):
    """The partition of an offers table that holds a variant and store."""
    return F.pmod(F.xxhash64("variant_id", "store_id"), F.lit(buckets)).cast("int")


def write_offers(offers, path, buckets=256):
    """A new offers table at path, partitioned by bucket, to be kept up by merge_offers with as many buckets."""
    rows = offers.drop("bucket").withColumn("bucket", offer_bucket(buckets))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def merge_offers(incoming, path, buckets=256):
    """Upsert incoming rows into the offers table at path; only the buckets that they fall into are read and rewritten.

    Spark swaps in whole partitions (dynamic overwrite): the files of all other
    buckets stay as they are. A run that is tried again gives the same table.
    """
    spark = incoming.sparkSession
    rows = incoming.withColumn("bucket", offer_bucket(buckets))
    # At most as many numbers as there are buckets; they prune the scan.
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    if not touched:
        return
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert_offers(stored, incoming).withColumn("bucket", offer_bucket(buckets))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def counters():
    """The counters of an import as aggregate columns over its outcomes."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    converted = F.count_if((F.col("outcome") != "rejected") & (F.col("original_currency") != "USD")).alias("converted")
    return n("imported"), n("updated"), n("skipped"), converted, n("rejected")


def import_counters(outcomes):
    """Per store: imported, updated, skipped, converted and rejected rows of an import."""
    return outcomes.groupBy("store_id").agg(*counters())


def write_counted(outcomes, path):
    """Append outcomes to the table at path; returns the counters of the whole import, observed while the rows were written."""
    seen = Observation("import")
    outcomes.observe(seen, *counters()).write.mode("append").parquet(path)
    return seen.get


def import_summary(results):
    """Per status: stores, and the products that they brought."""
    return results.groupBy("status").agg(F.count("*").alias("stores"), F.sum(F.coalesce("products", F.lit(0))).alias("products"))


def update_store_sync(stores, results):
    """The latest result per store: time, status and error; only success moves the last successful sync and the number of products.

    results: store_id, at, status, and error and products where given.
    """
    given = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    last = results.groupBy("store_id").agg(F.max(F.struct("at", "status", given(results, "error", "string").alias("error"), given(results, "products", "long").alias("products"))).alias("r"))
    ok, any_ = F.col("r.status") == "success", F.col("r").isNotNull()
    return stores.join(last, "store_id", "left").select(
        "store_id",
        F.coalesce("r.status", "sync_status").alias("sync_status"),
        F.when(any_, F.col("r.at")).otherwise(given(stores, "last_sync", "timestamp")).alias("last_sync"),
        F.when(ok, F.col("r.at")).otherwise(F.col("last_successful_sync")).alias("last_successful_sync"),
        F.when(any_, F.col("r.error")).otherwise(given(stores, "last_error", "string")).alias("last_error"),
        F.when(ok, F.col("r.products")).otherwise(given(stores, "products_count", "long")).alias("products_count"),
    )


def merge_brands(brands):
    """brand_id and the survivor, the least id, among brands whose names agree without accents and case.

    Names are compared by Spark's accent- and case-insensitive Unicode
    collation, without Python. A null name agrees with no other.
    """
    key = F.collate(F.trim("name"), "UNICODE_CI_AI")
    rows = brands.select("brand_id", key.alias("key"))
    least = rows.where("key is not null").groupBy("key").agg(F.min("brand_id").alias("survivor"))
    return rows.join(least, "key", "left").select("brand_id", F.coalesce("survivor", "brand_id").alias("survivor"))


def repoint_products(products, survivors):
    """products (brand_id, ...) of the surviving brands, and the brands that are left without products of their own."""
    moved = products.join(survivors.where("brand_id <> survivor"), "brand_id", "left").withColumn("brand_id", F.coalesce("survivor", "brand_id")).select(*products.columns)
    return moved, survivors.where("brand_id <> survivor").select("brand_id")


def duplicate_groups(variants):
    """Stores and skus with several variants: the least id, and all in order."""
    rows = variants.groupBy("store_id", "sku").agg(F.min("variant_id").alias("keep"), F.sort_array(F.collect_set("variant_id")).alias("ids"))
    return rows.where(F.size("ids") > 1)


def variant_remap(variants):
    """Each variant and the least id of its store and sku."""
    least = variants.groupBy("store_id", "sku").agg(F.min("variant_id").alias("keep"))
    return variants.join(least, ["store_id", "sku"]).select("variant_id", "keep")


def dedup_variants(remap, rows, key):
    """rows repointed to the kept variants; of rows that then share a key the one of the least old id stays."""
    moved = rows.join(remap, "variant_id").withColumn("_old", F.col("variant_id")).withColumn("variant_id", F.col("keep")).drop("keep")
    first = moved.groupBy(*key).agg(F.min_by(F.struct(*[c for c in moved.columns if c not in key]), "_old").alias("r"))
    return first.select(*key, "r.*").drop("_old")


def dedup_matches(remap, matches):
    """Matches between kept variants, each pair once with its best confidence; a match within one kept variant goes."""
    to = lambda name: remap.select(F.col("variant_id").alias(name), F.col("keep").alias(f"_{name}"))
    keys = ["canonical_variant_id", "matched_variant_id"]
    moved = matches.join(to(keys[0]), keys[0], "left").join(to(keys[1]), keys[1], "left").withColumns({k: F.coalesce(f"_{k}", k) for k in keys}).drop(*[f"_{k}" for k in keys])
    rest = [c for c in matches.columns if c not in keys]
    best = moved.where(f"{keys[0]} <> {keys[1]}").groupBy(*keys).agg(F.max(F.struct("confidence_score", *[c for c in rest if c != "confidence_score"])).alias("r"))
    return best.select(*keys, "r.*")


def dedup_tables(remap, variants, offers, history, matches):
    """The four tables after equal variants became one: kept variants, their offers by store, history without clashes in time, matches."""
    return (
        variants.join(remap.where("variant_id = keep").select("variant_id"), "variant_id", "left_semi"),
        dedup_variants(remap, offers, ["variant_id", "store_id"]),
        dedup_variants(remap, history, ["variant_id", "store_id", "ts"]),
        dedup_matches(remap, matches),
    )


def drop_gender_conflicts(matches, variants):
    """Matches but those between different known genders."""
    g = variants.select("variant_id", F.nullif("gender", F.lit("UNKNOWN")).alias("gender"))
    rows = matches.join(g.select(F.col("variant_id").alias("canonical_variant_id"), F.col("gender").alias("g1")), "canonical_variant_id", "left").join(g.select(F.col("variant_id").alias("matched_variant_id"), F.col("gender").alias("g2")), "matched_variant_id", "left")
    return rows.where(F.col("g1").isNull() | F.col("g2").isNull() | (F.col("g1") == F.col("g2"))).select(*matches.columns)


def split_multi_store(seen):
    """(variant_id, store_id) pairs with the id each store gets: the least store keeps the variant's, others get clones."""
    seen = seen.select("variant_id", "store_id").distinct()
    least = seen.groupBy("variant_id").agg(F.min("store_id").alias("_least"))
    return seen.join(least, "variant_id").select("variant_id", "store_id", F.when(F.col("store_id") == F.col("_least"), F.col("variant_id")).otherwise(F.xxhash64("variant_id", "store_id")).alias("new_id"))


def split_tables(variants, offers, changes, history):
    """The four tables with one store per variant: clones for further stores, facts repointed to them; variants that no store has go."""
    facts = (offers, changes, history)
    ids = split_multi_store(facts[0].select("variant_id", "store_id").unionAll(facts[1].select("variant_id", "store_id")).unionAll(facts[2].select("variant_id", "store_id")))
    own = [c for c in variants.columns if c not in ("variant_id", "store_id")]
    cloned = variants.drop("store_id").join(ids, "variant_id").select(F.col("new_id").alias("variant_id"), "store_id", *own)
    moved = [f.join(ids, ["variant_id", "store_id"]).withColumn("variant_id", F.col("new_id")).select(*f.columns) for f in facts]
    return cloned, *moved


def backfill_store_scope(variants, offers):
    """Variants with the least store that offers them; those without an offer go."""
    return variants.join(offers.groupBy("variant_id").agg(F.min("store_id").alias("store_id")), "variant_id").select("variant_id", "store_id")


def offers_in_scope(scoped, offers):
    """Offers of their variant's own store."""
    return offers.join(scoped.select("variant_id", "store_id"), ["variant_id", "store_id"], "left_semi")


def nullify_nonpositive(df, column):
    """df with null for values of the column that aren't above zero."""
    return df.withColumn(column, F.when(F.col(column) > 0, F.col(column)))


def incremental_normalise(df, source, target, normalise, id_col=None, low=None, high=None):
    """df with target filled from source where it is null, in the half-open range of ids if one is given; done rows stay."""
    open_ = F.col(target).isNull()
    if id_col is not None:
        open_ = open_ & (F.col(id_col) >= low) & (F.col(id_col) < high)
    return df.withColumn(target, F.when(open_, normalise(F.col(source))).otherwise(F.col(target)))


def normalisation_coverage(df, raw, normalised, top=15):
    """What a normalisation covers, as rows kind, raw, value, n, percent.

    totals: all rows, those with and without a value; value: rows by value;
    pair: the `top` most frequent pairs of raw and normalised value.
    """
    row = lambda kind, r, v, n, p: [F.lit(kind).alias("kind"), r.cast("string").alias("raw"), v.cast("string").alias("value"), n.alias("n"), F.round(p, 4).alias("percent")]
    pairs = df.groupBy(F.col(raw).alias("r"), F.col(normalised).alias("v")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    sums = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("given"))
    parts = sums.select("total", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), n.alias("n")) for name, n in (("all", F.col("total")), ("normalised", F.col("given")), ("null", F.col("total") - F.col("given")))])).alias("s"))
    share = lambda n: F.try_divide(100.0 * n, F.col("total"))
    # The one row of sums comes by an equi-join on a constant.
    whole = sums.select(F.lit(1).alias("one"), "total")
    by_value = pairs.groupBy("v").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    frequent = pairs.where("v is not null").orderBy(F.desc("n"), "r", "v").limit(top).withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    return (
        parts.select(*row("totals", none, F.col("s.name"), F.col("s.n"), share(F.col("s.n"))))
        .unionByName(by_value.select(*row("value", none, F.col("v"), F.col("n"), share(F.col("n")))))
        .unionByName(frequent.select(*row("pair", F.col("r"), F.col("v"), F.col("n"), share(F.col("n")))))
    )


def propagate_gender(products, variants, classify):
    """Classify each product's name once and hand the class to its variants."""
    classes = products.select("product_id", classify(F.col("canonical_name")).alias("gender_age"))
    return variants.join(classes, "product_id", "left").select("variant_id", F.coalesce("gender_age", F.lit("UNKNOWN")).alias("gender_age"))
