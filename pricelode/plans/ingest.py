"""Queries: landing, normalisation, upserts and maintenance."""

from pyspark.sql import functions as F

from pricelode.functions import normalize as N
from pricelode.operators import intervals as I
from pricelode.operators import maintenance as U
from pricelode.operators import matching as M
from pricelode.operators import shaping as S
from pricelode.session import shared_folder
from pricelode.sources import landing as L

from .catalog import query
from .fixtures import pick

CURRENCY_CASE = "CASE WHEN d LIKE '%.kr' THEN 'KRW' WHEN d LIKE '%.jp' THEN 'JPY' WHEN d LIKE '%.de' THEN 'EUR' WHEN d LIKE '%.uk' THEN 'GBP' END"


@query("detect_currency", f"SELECT store_id, {CURRENCY_CASE} AS detected FROM (SELECT store_id, domain AS d FROM fx_stores)")
def detect_currency(fx):
    return fx.stores.select("store_id", N.detect_currency(F.concat(F.lit("https://"), "domain", F.lit("/x"))).alias("detected"))


def rates(fx):
    return fx.spark.createDataFrame([(k, v) for k, v in N.FALLBACK_RATES.items()], "currency string, rate string")


def priced_rows(fx):
    rows = fx.offers.join(fx.stores.select("store_id", "domain", "currency"), "store_id")
    # A fifth of the stores state no currency, another states one that is not supported.
    stated = F.when(F.col("store_id") % 5 == 0, F.lit(None)).when(F.col("store_id") % 5 == 1, F.lit("XYZ")).otherwise(F.col("currency"))
    return rows.select("variant_id", F.col("current_price").alias("price"), F.concat(F.lit("https://"), "domain").alias("url"), stated.alias("api_currency"))


def priced(fx):
    return N.normalize_prices(priced_rows(fx), rates(fx))


PRICED = f"""fx_rates(currency, rate) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in N.FALLBACK_RATES.items())}),
 fx_stated AS (SELECT variant_id, current_price AS price, CASE WHEN store_id % 5 IN (0, 1) THEN NULL ELSE currency END AS stated, {CURRENCY_CASE.replace('d LIKE', 'domain LIKE')} AS seen FROM fx_offers JOIN fx_stores USING (store_id)),
 fx_priced AS (SELECT variant_id, price, coalesce(stated, seen, 'UNKNOWN') AS currency, coalesce(stated, seen) IS NULL AS bad FROM fx_stated)"""


@query(
    "normalize_price",
    f"""WITH {PRICED} SELECT variant_id, p.currency, CASE WHEN bad THEN NULL WHEN p.currency = 'USD' THEN price ELSE ((2 * CAST(round(price * 100) AS HUGEINT) * 1000000 + CAST(round(r.rate::DOUBLE * 1000000) AS HUGEINT)) // (2 * CAST(round(r.rate::DOUBLE * 1000000) AS HUGEINT)))::DOUBLE / 100 END AS usd_price,
 CASE WHEN bad THEN NULL WHEN p.currency = 'USD' THEN 1.0 ELSE r.rate::DOUBLE END AS rate, CASE WHEN bad THEN 'unknown_currency' END AS reject_reason FROM fx_priced p LEFT JOIN fx_rates r ON r.currency = p.currency""",
)
def normalize_price(fx):
    return priced(fx).select("variant_id", "currency", "usd_price", "rate", "reject_reason")


@query("broadcast_fx", f"WITH {PRICED} SELECT p.currency, count(*) AS n, count(r.rate) AS rated FROM fx_priced p LEFT JOIN fx_rates r ON r.currency = p.currency GROUP BY 1")
def broadcast_fx(fx):
    return priced(fx).groupBy("currency").agg(F.count("*").alias("n"), F.count(F.when(F.col("currency") != "USD", F.col("rate"))).alias("rated"))


@query(
    "quarantine_currency_errors",
    f"""WITH {PRICED} SELECT variant_id, CASE WHEN bad AND variant_id % 2 = 0 THEN 'unsupported_currency' WHEN bad THEN 'unknown_currency' ELSE 'missing_rate' END AS reject_reason FROM fx_priced WHERE bad OR currency = 'GBP'""",
)
def quarantine_currency_errors(fx):
    """Rejected for each of three reasons: no known currency, a default that isn't supported, and a currency without a rate."""
    rows, known = priced_rows(fx), rates(fx).where("currency <> 'GBP'")
    odd = L.quarantine(N.normalize_prices(rows.where("variant_id % 2 = 1"), known))[1]
    even = L.quarantine(N.normalize_prices(rows.where("variant_id % 2 = 0"), known, default_currency="XAU"))[1]
    return odd.unionByName(even).select("variant_id", "reject_reason")


@query("with_provenance", f"WITH {PRICED} SELECT variant_id, CASE WHEN currency <> 'USD' THEN 'fixer_io' END AS exchange_rate_source, 'v1' AS parser_version FROM fx_priced WHERE NOT bad")
def with_provenance(fx):
    return L.with_provenance(L.quarantine(priced(fx))[0], "v1").select("variant_id", "exchange_rate_source", "parser_version")


@query(
    "fx_rebase_to_usd",
    "WITH q AS (SELECT currency, CAST(floor(avg(reliability_score) * 100 + 50) AS BIGINT) AS rate FROM fx_stores GROUP BY 1), u AS (SELECT rate AS usd FROM q WHERE currency = 'USD') SELECT currency, ((2 * rate * 1000000 + usd) // (2 * usd))::DOUBLE / 1000000 AS rate FROM q, u WHERE currency <> 'USD'",
)
def fx_rebase_to_usd(fx):
    quotes = fx.stores.groupBy("currency").agg((F.floor(F.avg(F.col("reliability_score").cast("double")) * 100 + 50).cast("decimal(10,0)") / 100).cast("decimal(10,2)").alias("rate"))
    return N.rebase_rates_to_usd(quotes)


@query("strip_accents", "SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents")
def strip_accents(fx):
    """Over whole texts."""
    return fx.table("documents").select("doc_id", F.md5(N.strip_accents(F.lower("text")).cast("binary")).alias("digest"))


@query("brand_key", "SELECT DISTINCT brand, regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'), '^by', '') AS brand_key FROM fx_products")
def brand_key(fx):
    return fx.products.select("brand").distinct().select("brand", M.brand_key(F.lit(None).cast("string"), F.col("brand")).alias("brand_key"))


@query("extract_brand", "SELECT product_id, CASE WHEN product_id % 3 = 0 THEN coalesce(nullif(regexp_extract(trim(canonical_name), '^(\\S+)', 1), ''), 'Unknown') ELSE brand END AS brand FROM fx_products")
def extract_brand(fx):
    vendor = F.when(F.col("product_id") % 3 == 0, F.lit("")).otherwise(F.col("brand"))
    return fx.products.select("product_id", N.extract_brand(vendor, F.col("canonical_name")).alias("brand"))


@query("normalize_size", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_size || 'K' WHEN p_partkey % 5 = 0 THEN p_size || '.5W' WHEN p_partkey % 3 = 0 THEN p_size || '.5M' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def normalize_size(fx):
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(key % 11 == 0, F.concat(F.lit("$"), n)).when(key % 7 == 0, F.concat(F.lit("0"), n, F.lit(" GS"))).when(key % 5 == 0, F.concat(F.lit("0"), n, F.lit(".5B"))).when(key % 3 == 0, F.concat(F.lit("Sz "), n, F.lit(",50 M"))).otherwise(n)
    return fx.table("part").select("p_partkey", N.normalize_size(raw).alias("size"))


COLOUR_SQL = "CASE WHEN p_name LIKE '%red%' THEN 'RED' WHEN p_name LIKE '%blue%' THEN 'BLUE' WHEN p_name LIKE '%green%' THEN 'GREEN' END"


@query("normalize_color", f"SELECT product_id, {COLOUR_SQL.replace('p_name', 'canonical_name')} AS color FROM fx_products")
def normalize_color(fx):
    return fx.products.select("product_id", N.normalize_color(F.col("canonical_name")).alias("color"))


GENDER_NAMES = {0: " Men's", 1: " wmns", 2: " (GS) ", 3: " unisex", 4: " PSA kids", 5: " men in black"}


def gendered(fx):
    """Products whose names say for whom they are."""
    n = F.col("product_id") % 7
    tail = F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in GENDER_NAMES.items()], F.lit(""))
    return fx.products.withColumn("canonical_name", F.concat("canonical_name", tail))


@query("normalize_gender_age", "SELECT product_id, CASE product_id % 7 WHEN 0 THEN 'MEN' WHEN 1 THEN 'WOMEN' WHEN 2 THEN 'KIDS' WHEN 3 THEN 'UNISEX' ELSE 'UNKNOWN' END AS gender FROM fx_products")
def normalize_gender_age(fx):
    return gendered(fx).select("product_id", N.normalize_gender_age(F.col("canonical_name")).alias("gender"))


@query("normalize_sku", "SELECT DISTINCT sku, upper(trim(sku)) AS nsku FROM fx_variants")
def normalize_sku(fx):
    return fx.variants.select("sku", M.normalize_sku(F.col("sku")).alias("nsku")).distinct()


@query("classify_gtin_shape", "SELECT variant_id, regexp_full_match(coalesce(ean, ''), '[0-9]{12,14}') AS ean_gtin, regexp_full_match(sku, '[0-9]{12,13}') AS sku_gtin FROM fx_variants")
def classify_gtin_shape(fx):
    return fx.variants.select("variant_id", M.is_gtin_ean(F.col("ean")).alias("ean_gtin"), M.is_gtin_sku(F.col("sku")).alias("sku_gtin"))


@query("validate_gtin", "SELECT DISTINCT ean, list_sum(list_transform(range(1, 14), lambda i: CAST(ean[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 AS valid, 'EAN-13' AS kind FROM fx_variants WHERE ean IS NOT NULL")
def validate_gtin(fx):
    return fx.variants.where("ean is not null").select("ean").distinct().select("ean", N.valid_gtin(F.col("ean")).alias("valid"), N.gtin_type(F.col("ean")).alias("kind"))


@query("detect_region", "SELECT store_id, CASE WHEN domain LIKE '%.uk' THEN 'GB' WHEN domain LIKE '%.de' THEN 'DE' WHEN domain LIKE '%.jp' THEN 'JP' END AS region, CASE WHEN domain LIKE '%.uk' THEN 'GB' WHEN domain LIKE '%.de' THEN 'DE' WHEN domain LIKE '%.jp' THEN 'JP' WHEN domain LIKE '%.kr' THEN 'KR' ELSE 'US' END AS full_region FROM fx_stores")
def detect_region(fx):
    return fx.stores.select("store_id", N.detect_region(F.col("domain")).alias("region"), N.detect_region_full(F.col("domain")).alias("full_region"))


@query("store_name_from_url", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(replace(replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'www.', ''), '.com', ''), '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM pages")
def store_name_from_url(fx):
    return fx.pages.select("page_id", N.store_name(F.col("url")).alias("name"))


@query("product_url", "SELECT product_id, 'https://shop.example/products/' || replace(canonical_name, ' ', '-') AS url FROM fx_products")
def product_url(fx):
    return fx.products.select("product_id", N.product_url(F.lit("https://shop.example/"), F.replace("canonical_name", F.lit(" "), F.lit("-"))).alias("url"))


@query("alert_fingerprint", "SELECT variant_id, substr(sha256(sku || '|' || s.name || '|' || printf('%.2f', current_price)), 1, 16) AS fingerprint FROM fx_variants v JOIN fx_offers o USING (variant_id) JOIN fx_stores s ON s.store_id = v.store_id")
def alert_fingerprint(fx):
    rows = fx.variants.join(fx.offers.select("variant_id", "current_price"), "variant_id").join(fx.stores.select("store_id", "name"), "store_id")
    return rows.select("variant_id", N.alert_fingerprint(F.col("sku"), F.col("name"), F.col("current_price").cast("string")).alias("fingerprint"))


@query("quality_score", "SELECT variant_id, quality FROM fx_norm")
def quality_score(fx):
    return M.normalized_variants(fx.variants, fx.offers).select("variant_id", F.col("quality").cast("long").alias("quality"))


@query("freshness_decay", "SELECT variant_id, round(exp(-0.1 * (epoch_us($AS_OF) - epoch_us(updated_at)) / 86400000000.0), 8) AS decay FROM fx_offers")
def freshness_decay(fx):
    return fx.offers.select("variant_id", F.round(N.freshness_decay(F.col("updated_at"), fx.as_of), 8).alias("decay"))


MARKERS = ("<script src='https://cdn.Shopify.com/s/files/x.js'></script>", "<link href='/wp-content/plugins/woocommerce/a.css'>", "<script data-x='Mage/Cookies'></script>", "<link href='/static/version17/x.css'>", "")
PLATFORM_SQL = "CASE page_id % 5 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'magento' WHEN 3 THEN 'magento' ELSE 'custom' END"


def sites(fx):
    """Pages as sites: markers of a platform planted by page, and notes of what their catalogue answered."""
    n = F.col("page_id") % 5
    marked = F.concat("html", F.coalesce(*[F.when(n == k, F.lit(m)) for k, m in enumerate(MARKERS)]))
    note = F.when(F.col("page_id") % 3 == 0, "products.json available").when(F.col("page_id") % 3 == 1, "products.json blocked (403)").otherwise("timeout")
    return fx.pages.select("page_id", "url", N.platform(marked).alias("platform"), note.alias("notes"))


@query("detect_platform_markers", f"SELECT {PLATFORM_SQL} AS platform, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, platform")
def detect_platform_markers(fx):
    return sites(fx).groupBy("platform").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "platform")


@query("filter_shop_platform", "SELECT count(*) AS sites, count(*) FILTER (page_id % 3 = 0) AS available, count(*) FILTER (page_id % 3 = 1) AS blocked FROM pages WHERE page_id % 5 = 0")
def filter_shop_platform(fx):
    rows = S.of_platform(sites(fx), "shopify")
    return rows.agg(F.count("*").alias("sites"), F.count_if(F.col("notes").contains("available")).alias("available"), F.count_if(F.col("notes").contains("blocked")).alias("blocked"))


@query("format_time_label", "SELECT variant_id, strftime(updated_at, '%m-%d %H:%M') AS label FROM fx_offers")
def format_time_label(fx):
    return fx.offers.select("variant_id", F.date_format("updated_at", "MM-dd HH:mm").alias("label"))


@query(
    "normalisation_coverage",
    f"""WITH fx_c AS (SELECT canonical_name AS raw, {COLOUR_SQL.replace('p_name', 'canonical_name')} AS value FROM fx_products), fx_t AS (SELECT count(*) AS total, count(value) AS given FROM fx_c),
 fx_p AS (SELECT raw, value, count(*) AS n FROM fx_c WHERE value IS NOT NULL GROUP BY ALL ORDER BY n DESC, raw, value LIMIT 15)
 SELECT 'totals' AS kind, NULL AS raw, unnest(['all', 'normalised', 'null']) AS value, unnest([total, given, total - given]) AS n, round(100.0::DOUBLE * unnest([total, given, total - given]) / total, 4) AS percent FROM fx_t
 UNION ALL SELECT 'value', NULL, value, count(*), round(100.0::DOUBLE * count(*) / any_value(total), 4) FROM fx_c, fx_t GROUP BY value
 UNION ALL SELECT 'pair', raw, value, n, round(100.0::DOUBLE * n / total, 4) FROM fx_p, fx_t""",
)
def normalisation_coverage(fx):
    return U.normalisation_coverage(fx.products.withColumn("color", N.normalize_color(F.col("canonical_name"))), "canonical_name", "color")


@query("upsert_brands", "SELECT DISTINCT lower(trim(brand)) AS normalized_name, CAST(right(brand, 1) AS INTEGER) <= 2 AS old FROM fx_products")
def upsert_brands(fx):
    names = fx.products.select(F.col("brand").alias("name")).distinct()
    old = names.where(F.right(F.col("name"), F.lit(1)).cast("int") <= 2).select(F.lit(-1).cast("long").alias("brand_id"), "name", U.brand_name_key(F.col("name")).alias("normalized_name"))
    return U.upsert_brands(old, fx.products.select(F.col("brand").alias("name"))).select("normalized_name", (F.col("brand_id") == -1).alias("old"))


@query(
    "upsert_stores",
    """SELECT name, CASE WHEN store_id % 3 = 1 THEN 'new-' || domain ELSE domain END AS domain, store_id % 3 < 2 AS old,
 CASE WHEN store_id % 3 < 2 THEN 'OLD' WHEN domain LIKE '%.co.uk' THEN 'GB' WHEN domain LIKE '%.de' THEN 'DE' WHEN domain LIKE '%.jp' THEN 'JP' END AS region FROM fx_stores""",
)
def upsert_stores(fx):
    """Known domains, new domains of known names, and new stores, each of which comes twice under two names."""
    old = fx.stores.where("store_id % 3 < 2").withColumn("region", F.lit("OLD"))
    incoming = fx.stores.select("name", F.when(F.col("store_id") % 3 == 1, F.concat(F.lit("new-"), "domain")).otherwise(F.col("domain")).alias("domain"), "currency")
    again = incoming.withColumn("name", F.concat("name", F.lit(" again")))
    out = U.upsert_stores(old, incoming.unionByName(again), N.detect_region)
    return out.join(old.select("store_id", F.lit(True).alias("was")), "store_id", "left").select("name", "domain", F.coalesce("was", F.lit(False)).alias("old"), "region")


@query("upsert_products", "SELECT brand, canonical_name, count(*) FILTER (product_id % 2 = 0) > 0 AS old FROM fx_products GROUP BY ALL")
def upsert_products(fx):
    old = fx.products.where("product_id % 2 = 0")
    new = U.upsert_products(old, fx.products.drop("product_id"))
    seen = old.select("product_id", F.lit(True).alias("was"))
    return new.join(seen, "product_id", "left").groupBy("brand", "canonical_name").agg(F.coalesce(F.max("was"), F.lit(False)).alias("old"))


@query("resolve_variant_identity", "SELECT v.store_id, v.product_id, CASE WHEN v.variant_id % 3 = 0 THEN 'external' WHEN m.sku IS NOT NULL THEN 'sku' ELSE 'new' END AS how FROM fx_variants v LEFT JOIN (SELECT DISTINCT product_id, sku FROM fx_variants WHERE variant_id % 3 = 0) m ON m.product_id = v.product_id AND m.sku = v.sku")
def resolve_variant_identity(fx):
    rows = fx.variants.withColumn("external_id", F.col("variant_id") * 7)
    return U.resolve_variant_identity(rows.where("variant_id % 3 = 0"), rows.select("store_id", "external_id", "product_id", "sku")).select("store_id", "product_id", "how")


RATE_OF = "CASE currency WHEN 'USD' THEN 1.0 " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in N.FALLBACK_RATES.items()) + " END"


def jumpy(fx):
    """Observations, and after each of every fifth product's three more within the hour: a bit lower, nine times as high, a bit higher."""
    more = F.array(*[F.struct(F.lit(minutes).alias("m"), F.lit(factor).alias("f")) for minutes, factor in JUMPS])
    each = fx.obs.withColumn("j", F.explode(F.when(F.col("product_id") % 5 == 0, more).otherwise(F.slice(more, 1, 1))))
    price = F.round(F.col("price") * F.col("j.f").cast("decimal(4,1)"), 2).cast("decimal(12,2)")
    return each.withColumn("price", price).withColumn("ts", F.timestamp_add("MINUTE", F.col("j.m"), F.col("ts"))).drop("j")


#: Minutes after an observation, and the factor of its price.
JUMPS = ((0, "1.0"), (10, "0.9"), (20, "9.0"), (30, "1.2"))
JUMPY = f"""fx_jumps AS (SELECT * REPLACE (ts + to_minutes(j[1]::INTEGER) AS ts, floor(round(price * 100) * round(j[2] * 10) / 10 + 0.5) / 100 AS price)
  FROM (SELECT *, unnest(CASE WHEN product_id % 5 = 0 THEN [{', '.join(f'[{m}, {f}]' for m, f in JUMPS)}] ELSE [[0, 1.0]] END) AS j FROM fx_obs))"""


def catalogue_rows(fx):
    """Observations with planted jumps as priced catalogue rows: stated old price, url, currency and rate; every thirteenth names no known currency, some prices are beyond all bounds."""
    s = fx.stores.select("store_id", "domain", "currency")
    price = F.when(F.col("variant_id") % 17 == 0, F.col("price") * 40).otherwise(F.col("price")).cast("decimal(12,2)")
    rate = F.create_map(*[x for k, v in {"USD": "1", **N.FALLBACK_RATES}.items() for x in (F.lit(k), F.lit(v).cast("decimal(12,6)"))])[F.col("currency")]
    return jumpy(fx).join(s, "store_id").select(
        "variant_id",
        "store_id",
        price.alias("current_price"),
        F.when(F.col("variant_id") % 3 == 0, (F.col("price") * 2).cast("decimal(12,2)")).alias("old_price"),
        "in_stock",
        F.col("ts").alias("updated_at"),
        N.product_url(F.concat(F.lit("https://"), "domain"), F.col("variant_id").cast("string")).alias("url"),
        F.col("currency").alias("original_currency"),
        rate.alias("exchange_rate"),
        F.when(F.col("currency") != "USD", "fixer_io").alias("exchange_rate_source"),
        F.when(F.col("variant_id") % 13 == 0, "unknown_currency").alias("reject_reason"),
    )


def stood(rows):
    """The offers that stood on the first of March: the last good row of each variant."""
    old = rows.where("updated_at < timestamp '2024-03-01' and reject_reason is null and variant_id % 17 <> 0").drop("reject_reason")
    kept = [c for c in old.columns if c not in ("variant_id", "store_id")]
    return old.groupBy("variant_id", "store_id").agg(F.max(F.struct("updated_at", *[c for c in kept if c != "updated_at"])).alias("o")).select("variant_id", "store_id", "o.*")


CATALOGUE = f"""RECURSIVE {JUMPY}, fx_rows AS (SELECT variant_id, o.store_id, CASE WHEN variant_id % 17 = 0 THEN round(price * 40, 2) ELSE price END AS current_price, CASE WHEN variant_id % 3 = 0 THEN round(price * 2, 2) END AS old_price, in_stock, ts, 'https://' || domain || '/products/' || variant_id AS url, currency AS original_currency,
  {RATE_OF} AS exchange_rate, CASE WHEN currency <> 'USD' THEN 'fixer_io' END AS exchange_rate_source, variant_id % 13 = 0 AS bad FROM fx_jumps o JOIN fx_stores s ON s.store_id = o.store_id),
 fx_stood AS (SELECT * FROM fx_rows WHERE ts < TIMESTAMP '2024-03-01' AND NOT bad AND variant_id % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY variant_id, store_id ORDER BY ts DESC) = 1),
 fx_seq AS (SELECT *, row_number() OVER (PARTITION BY variant_id, store_id ORDER BY ts, current_price DESC) AS k FROM fx_rows WHERE ts >= TIMESTAMP '2024-03-01'),
 fx_fold AS (
  SELECT q.variant_id, q.store_id, 0::BIGINT AS k, s.current_price AS base, s.variant_id IS NOT NULL AS known, NULL::VARCHAR AS outcome
  FROM (SELECT DISTINCT variant_id, store_id FROM fx_seq) q LEFT JOIN fx_stood s ON s.variant_id = q.variant_id AND s.store_id = q.store_id
  UNION ALL
  SELECT variant_id, store_id, k, CASE WHEN outcome IN ('imported', 'updated') THEN current_price ELSE base END, known OR outcome = 'imported', outcome
  FROM (SELECT q.*, f.base, f.known, CASE WHEN bad THEN 'rejected' WHEN NOT (current_price > 0 AND current_price <= 20000) OR NOT (base IS NULL OR base <= 0 OR current_price::DOUBLE / base::DOUBLE BETWEEN 0.25 AND 4) THEN 'skipped' WHEN known THEN 'updated' ELSE 'imported' END AS outcome
   FROM fx_fold f JOIN fx_seq q ON q.variant_id = f.variant_id AND q.store_id = f.store_id AND q.k = f.k + 1)
 ),
 fx_in AS (SELECT q.*, f.outcome FROM fx_seq q JOIN fx_fold f USING (variant_id, store_id, k))"""
OFFER_OUT = "variant_id, store_id, current_price, old_price, in_stock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, url, original_currency, exchange_rate, exchange_rate_source"
UPSERTED = f"""WITH {CATALOGUE}, fx_both AS (SELECT {OFFER_OUT}, 0 AS k FROM fx_stood UNION ALL SELECT {OFFER_OUT}, k FROM fx_in WHERE outcome IN ('imported', 'updated'))
 SELECT * EXCLUDE (k) FROM fx_both QUALIFY row_number() OVER (PARTITION BY variant_id, store_id ORDER BY k DESC) = 1"""


def timed(offers):
    return offers.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("upsert_offers", UPSERTED, hold=True)
def upsert_offers(fx):
    rows = catalogue_rows(fx)
    return timed(U.upsert_offers(stood(rows), rows.where("updated_at >= timestamp '2024-03-01'")))


@query("merge_offers", UPSERTED, hold=True)
def merge_offers(fx):
    """The same upsert into a table of buckets, a store's rows after another's: each lot rewrites the buckets it falls into."""
    folder, rows = shared_folder(fx.spark, "buckets"), fx.kept(catalogue_rows(fx), "rows")
    U.write_offers(stood(rows), folder, 16)
    new = rows.where("updated_at >= timestamp '2024-03-01'")
    for part in (0, 1):
        U.merge_offers(new.where(F.col("store_id") % 2 == part), folder, 16)
    return timed(fx.spark.read.parquet(folder).drop("bucket"))


COUNTED = """count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome <> 'rejected' AND original_currency <> 'USD') AS converted, count(*) FILTER (outcome = 'rejected') AS rejected"""


@query("import_counters", f"WITH {CATALOGUE} SELECT store_id, {COUNTED} FROM fx_in GROUP BY 1", hold=True)
def import_counters(fx):
    rows = catalogue_rows(fx)
    return U.import_counters(U.import_outcomes(stood(rows), rows.where("updated_at >= timestamp '2024-03-01'")))


@query("live_import_counters", f"WITH {CATALOGUE} SELECT {COUNTED} FROM fx_in", hold=True)
def live_import_counters(fx):
    """What a write of outcomes observes on its way, without a second pass."""
    rows = catalogue_rows(fx)
    outcomes = U.import_outcomes(stood(rows), rows.where("updated_at >= timestamp '2024-03-01'"))
    counts = U.write_counted(outcomes, shared_folder(fx.spark, "outcomes"))
    return fx.spark.range(1).select(*[F.lit(n).alias(name) for name, n in counts.items()])


def sync_results(fx):
    """Two results for every second store: an error, and an hour later a success with its number of offers."""
    even = fx.stores.where("store_id % 2 = 0")
    n = fx.offers.groupBy("store_id").agg(F.count("*").alias("products"))
    none = F.lit(None)
    good = even.join(n, "store_id", "left").select("store_id", fx.as_of.alias("at"), F.when(F.col("store_id") % 6 == 0, "error").otherwise("success").alias("status"), F.when(F.col("store_id") % 6 == 0, "HTTP 503").alias("error"), "products")
    return good.unionByName(even.select("store_id", (fx.as_of - F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("error").alias("status"), F.lit("timeout").alias("error"), none.cast("long").alias("products")))


SYNCED = "fx_n AS (SELECT store_id, count(*) AS products FROM fx_offers GROUP BY 1), fx_y AS (SELECT s.*, store_id % 2 = 0 AS seen, store_id % 2 = 0 AND store_id % 6 <> 0 AS ok, products FROM fx_stores s LEFT JOIN fx_n USING (store_id))"


@query(
    "update_store_sync",
    f"""WITH {SYNCED} SELECT store_id, CASE WHEN ok THEN 'success' WHEN seen THEN 'error' ELSE sync_status END AS sync_status, strftime(CASE WHEN seen THEN $AS_OF END, '%Y-%m-%d %H:%M:%S') AS last_sync, strftime(CASE WHEN ok THEN $AS_OF ELSE last_successful_sync END, '%Y-%m-%d %H:%M:%S') AS last_successful_sync,
 CASE WHEN seen AND NOT ok THEN 'HTTP 503' END AS last_error, CASE WHEN ok THEN products END AS products_count FROM fx_y""",
)
def update_store_sync(fx):
    out = U.update_store_sync(fx.stores, sync_results(fx))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_sync", "last_successful_sync")})


@query(
    "import_summary",
    f"WITH {SYNCED} SELECT status, count(*) AS stores, CAST(sum(coalesce(products, 0)) AS BIGINT) AS products FROM (SELECT CASE WHEN ok THEN 'success' ELSE 'error' END AS status, products FROM fx_y WHERE seen UNION ALL SELECT 'error', NULL FROM fx_y WHERE seen) GROUP BY 1",
)
def import_summary(fx):
    return U.import_summary(sync_results(fx))


def spelt(fx):
    """Customers as brands, whose names differ by nation, and within one by case and accents."""
    c = fx.table("customer")
    way = pick(("Café Öresund ", "CAFE ORESUND ", " cafe\u0301 o\u0308resund ", "Cafè ÖRESUND "), F.col("c_custkey") % 4)
    return c.select(F.col("c_custkey").alias("brand_id"), F.concat(way, F.col("c_nationkey").cast("string"), F.lit(" ")).alias("name"))


@query("merge_brands", "SELECT c_custkey AS brand_id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS survivor FROM customer")
def merge_brands(fx):
    return U.merge_brands(spelt(fx))


@query("repoint_products", "SELECT o_orderkey AS product_id, survivor AS brand_id FROM orders JOIN (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS survivor FROM customer) ON c_custkey = o_custkey")
def repoint_products(fx):
    """Orders as products of their customers' brands, after these were merged."""
    products = fx.table("orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("brand_id"))
    return U.repoint_products(products, U.merge_brands(spelt(fx)))[0]


def crowded(fx):
    """Variants whose stores are thought to be ten only, so that skus repeat within a store."""
    return fx.variants.withColumn("store_id", F.col("store_id") % 10)


CROWD = "fx_crowd AS (SELECT variant_id, store_id % 10 AS store_id, sku FROM fx_variants)"


@query("duplicate_groups", f"WITH {CROWD} SELECT store_id, sku, min(variant_id) AS keep, CAST(count(DISTINCT variant_id) AS INTEGER) AS n FROM fx_crowd GROUP BY ALL HAVING count(DISTINCT variant_id) > 1")
def duplicate_groups(fx):
    return U.duplicate_groups(crowded(fx)).select("store_id", "sku", "keep", F.size("ids").alias("n"))


@query(
    "dedup_variants",
    f"""WITH {CROWD}, fx_map AS (SELECT variant_id, min(variant_id) OVER (PARTITION BY store_id, sku) AS keep FROM fx_crowd),
 fx_mm AS (SELECT DISTINCT a.keep AS c, b.keep AS m FROM fx_matches x JOIN fx_map a ON a.variant_id = x.canonical_variant_id JOIN fx_map b ON b.variant_id = x.matched_variant_id WHERE a.keep <> b.keep)
 SELECT 'variants' AS table_name, keep AS variant_id, NULL AS other, NULL AS price FROM fx_map WHERE keep = variant_id
 UNION ALL SELECT 'offers', keep, o.store_id % 10, arg_min(current_price, o.variant_id) FROM fx_offers o JOIN fx_map USING (variant_id) GROUP BY keep, o.store_id % 10
 UNION ALL SELECT 'history', keep, epoch(ts)::BIGINT, arg_min(price, h.variant_id) FROM fx_obs h JOIN fx_map USING (variant_id) GROUP BY keep, h.store_id % 10, ts
 UNION ALL SELECT 'matches', c, m, NULL FROM fx_mm""",
    hold=True,
)
def dedup_variants(fx):
    crowd = lambda df: df.withColumn("store_id", F.col("store_id") % 10)
    # The remap is read under each of the four tables.
    variants = fx.kept(crowded(fx), "variants")
    tables = U.dedup_tables(fx.kept(U.variant_remap(variants), "remap"), variants, crowd(fx.offers.select("variant_id", "store_id", "current_price")), crowd(fx.obs.select("variant_id", "store_id", "ts", "price")), fx.matches)
    row = lambda df, name, other, price: df.select(F.lit(name).alias("table_name"), "variant_id", other.cast("long").alias("other"), price.cast("decimal(12,2)").alias("price"))
    none, matches = F.lit(None), tables[3].withColumnRenamed("canonical_variant_id", "variant_id")
    out = row(tables[0], "variants", none, none).unionByName(row(tables[1], "offers", F.col("store_id"), F.col("current_price")))
    return out.unionByName(row(tables[2], "history", F.unix_timestamp("ts"), F.col("price"))).unionByName(row(matches, "matches", F.col("matched_variant_id"), none))


@query("delete_orphan_products", "SELECT product_id FROM fx_products WHERE product_id NOT IN (SELECT product_id FROM fx_variants WHERE store_id % 4 = 0)")
def delete_orphan_products(fx):
    return fx.products.join(fx.variants.where("store_id % 4 = 0"), "product_id", "left_anti").select("product_id")


@query("drop_gender_conflicts", "SELECT m.canonical_variant_id, m.matched_variant_id FROM fx_matches m WHERE NOT (m.matched_variant_id % 2 = 1 AND (m.canonical_variant_id // 100000) % 3 = 1)", hold=True)
def drop_gender_conflicts(fx):
    v = fx.variants.withColumn("gender", F.when((F.col("gender") == "MEN") & (F.col("variant_id") % 2 == 1), "WOMEN").otherwise(F.col("gender")))
    canonical = fx.matches.select(F.col("canonical_variant_id").alias("variant_id")).distinct()
    own = fx.variants.join(canonical, "variant_id", "left_semi")
    v = v.join(canonical, "variant_id", "left_anti").unionByName(own)
    return U.drop_gender_conflicts(fx.matches, v).select("canonical_variant_id", "matched_variant_id")


@query(
    "split_multi_store_variants",
    """WITH fx_seen AS (SELECT DISTINCT product_id AS variant_id, store_id FROM fx_obs), fx_own AS (SELECT variant_id, store_id, store_id = min(store_id) OVER (PARTITION BY variant_id) AS keeps FROM fx_seen)
 SELECT 'variants' AS table_name, store_id, keeps, count(*) AS n, count(DISTINCT variant_id) AS ids FROM fx_own GROUP BY ALL
 UNION ALL SELECT t, f.store_id, keeps, count(*), count(DISTINCT f.v) FROM (SELECT 'offers' AS t, product_id AS v, store_id FROM fx_offers UNION ALL SELECT 'changes', product_id, store_id FROM fx_changes UNION ALL SELECT 'history', product_id, store_id FROM fx_obs) f JOIN fx_own o ON o.variant_id = f.v AND o.store_id = f.store_id GROUP BY ALL""",
    hold=True,
)
def split_multi_store_variants(fx):
    """Products as variants that many stores share; per table and store the facts that the kept id and the clones hold."""
    shared = lambda df: df.drop("variant_id").withColumnRenamed("product_id", "variant_id")
    variants = fx.products.select(F.col("product_id").alias("variant_id"), F.lit(None).cast("long").alias("store_id"), "brand")
    tables = U.split_tables(variants, shared(fx.offers), shared(fx.changes), shared(fx.obs))
    out = None
    for name, df in zip(("variants", "offers", "changes", "history"), tables, strict=True):
        rows = df.join(variants.select("variant_id", F.lit(True).alias("own")), "variant_id", "left").groupBy("store_id", F.coalesce("own", F.lit(False)).alias("keeps"))
        rows = rows.agg(F.count("*").alias("n"), F.count_distinct("variant_id").alias("ids")).withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "backfill_store_scope",
    "WITH fx_own AS (SELECT product_id AS variant_id, min(store_id) AS store_id FROM fx_offers WHERE in_stock GROUP BY 1) SELECT v.variant_id, v.store_id, count(*) AS offers, min(o.current_price) AS least FROM fx_own v JOIN fx_offers o ON o.product_id = v.variant_id AND o.store_id = v.store_id AND o.in_stock GROUP BY ALL",
    hold=True,
)
def backfill_store_scope(fx):
    offers = fx.offers.where("in_stock").select(F.col("product_id").alias("variant_id"), "store_id", "current_price")
    scoped = U.backfill_store_scope(fx.products.select(F.col("product_id").alias("variant_id")), offers)
    return U.offers_in_scope(scoped, offers).groupBy("variant_id", "store_id").agg(F.count("*").alias("offers"), F.min("current_price").alias("least"))


@query("backfill_interval_context", "SELECT c.variant_id, c.price, s.currency AS region, v.size AS normalized_size, true AS in_stock FROM fx_changes c LEFT JOIN fx_stores s USING (store_id) LEFT JOIN fx_variants v ON v.variant_id = c.variant_id")
def backfill_interval_context(fx):
    return I.backfill_interval_context(fx.changes, fx.stores, fx.variants).select("variant_id", "price", "region", "normalized_size", "in_stock")


@query(
    "nullify_nonpositive",
    "SELECT 'offers' AS table_name, variant_id, CASE WHEN variant_id % 13 <> 0 THEN current_price END AS price FROM fx_offers UNION ALL SELECT 'changes', variant_id, CASE WHEN variant_id % 13 <> 0 THEN price END FROM fx_changes UNION ALL SELECT 'history', variant_id, CASE WHEN variant_id % 13 <> 0 THEN price END FROM fx_obs",
    hold=True,
)
def nullify_nonpositive(fx):
    """Three tables, with planted prices at and below zero."""
    out = None
    for name, df, column in (("offers", fx.offers, "current_price"), ("changes", fx.changes, "price"), ("history", fx.obs, "price")):
        broken = F.when(F.col("variant_id") % 26 == 0, F.lit(0)).when(F.col("variant_id") % 13 == 0, -F.col(column)).otherwise(F.col(column))
        rows = U.nullify_nonpositive(df.withColumn(column, broken.cast("decimal(10,2)")), column).select(F.lit(name).alias("table_name"), "variant_id", F.col(column).alias("price"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "incremental_normalise",
    f"SELECT product_id, CASE WHEN product_id % 2 = 0 THEN 'DONE' ELSE {COLOUR_SQL.replace('p_name', 'canonical_name')} END AS color, CASE WHEN p_size % 3 = 0 THEN 'OLD' WHEN product_id >= 100 AND product_id < 1500 THEN CAST(p_size AS VARCHAR) END AS size FROM fx_products JOIN part ON p_partkey = product_id",
)
def incremental_normalise(fx):
    """Colours of all open rows, sizes of those in a range of ids."""
    p = fx.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("canonical_name"), F.when(F.col("p_partkey") % 2 == 0, "DONE").alias("color"), F.concat(F.lit("Sz "), F.col("p_size").cast("string")).alias("raw_size"), F.when(F.col("p_size") % 3 == 0, "OLD").alias("size"))
    p = U.incremental_normalise(p, "canonical_name", "color", N.normalize_color)
    return U.incremental_normalise(p, "raw_size", "size", N.normalize_size, "product_id", 100, 1500).select("product_id", "color", "size")


@query("propagate_gender", "SELECT variant_id, CASE product_id % 7 WHEN 0 THEN 'MEN' WHEN 1 THEN 'WOMEN' WHEN 2 THEN 'KIDS' WHEN 3 THEN 'UNISEX' ELSE 'UNKNOWN' END AS gender_age FROM fx_variants")
def propagate_gender(fx):
    return U.propagate_gender(gendered(fx), fx.variants, N.normalize_gender_age)


def payloads(fx):
    """Catalogue pages made of the products and their variants, a page per hundred products; a third of the variants don't say whether they are available."""
    v = fx.variants.join(fx.offers.select("variant_id", "current_price", "in_stock"), "variant_id")
    v = v.groupBy("product_id").agg(F.collect_list(F.struct(F.col("variant_id").alias("id"), "product_id", "sku", F.col("ean").alias("barcode"), F.col("size").alias("option1"), F.col("color").alias("option2"), F.col("current_price").cast("string").alias("price"), F.when(F.col("variant_id") % 3 != 0, F.col("in_stock")).alias("available"))).alias("variants"))
    p = fx.products.join(v, "product_id").select("product_id", F.struct(F.col("canonical_name").alias("title"), F.col("brand").alias("vendor"), F.col("category").alias("product_type"), F.replace("canonical_name", F.lit(" "), F.lit("-")).alias("handle"), "variants").alias("p"))
    return p.groupBy((F.col("product_id") / 100).cast("int").alias("store_id")).agg(F.to_json(F.struct(F.collect_list("p").alias("products"))).alias("payload")).withColumn("fetched_at", fx.as_of)


@query("flatten_shop_snapshot", "SELECT variant_id AS external_variant_id, canonical_name AS title, p.brand AS vendor, v.sku, v.ean, current_price AS price, in_stock OR variant_id % 3 = 0 AS in_stock FROM fx_variants v JOIN fx_products p USING (product_id) JOIN fx_offers o USING (variant_id)")
def flatten_shop_snapshot(fx):
    return L.flatten_shop_snapshot(payloads(fx)).select("external_variant_id", "title", "vendor", "sku", "ean", "price", "in_stock")


def fetched(fx):
    """Payloads with what their request and response say."""
    store = F.col("store_id").cast("string")
    headers = F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("X-Page"), store)
    return payloads(fx).withColumns({"adapter_name": F.lit("shop"), "url": F.concat(F.lit("https://store"), store, F.lit(".de/products.json")), "http_status": F.lit(200), "headers": headers})


@query("append_raw_snapshot", "SELECT product_id // 100 AS store_id, count(DISTINCT product_id) AS products_count, 'v2' AS parser_version, '2024-04-15' AS fetched_on, CAST(product_id // 100 AS VARCHAR) AS page, 200 AS http_status, count(DISTINCT product_id) AS listed FROM fx_variants GROUP BY 1")
def append_raw_snapshot(fx):
    """Two appends to one table, read back: headers, and the payload's own number of products."""
    folder = shared_folder(fx.spark, "raw")
    snapshots = L.raw_snapshots(fetched(fx), "v2")
    for part in (0, 1):
        L.append_raw_snapshot(snapshots.where(F.col("store_id") % 2 == part), folder)
    listed = F.json_array_length(F.get_json_object(F.to_json("payload"), "$.products")).cast("long")
    return fx.spark.read.parquet(folder).select(F.col("store_id").cast("long").alias("store_id"), "products_count", "parser_version", F.col("fetched_on").cast("string").alias("fetched_on"), F.col("response_headers")["x-page"].alias("page"), "http_status", listed.alias("listed"))


@query(
    "offer_lineage",
    """SELECT variant_id, v.product_id // 100 AS page, 'EUR' AS original_currency, 'fixer_io' AS exchange_rate_source, CASE WHEN v.product_id // 100 % 2 = 0 THEN 'api' ELSE 'domain' END AS currency_source, '2024-04-15' AS rate_day, 'v2' AS parser_version, 1 AS snapshots, 1 AS intervals
 FROM fx_variants v JOIN fx_offers o USING (variant_id) WHERE current_price / 0.92 <= 20000""",
    hold=True,
)
def offer_lineage(fx):
    """From landed payloads to offers and intervals, each of which is joined back to the one snapshot it came from."""
    folder = shared_folder(fx.spark, "lineage")
    L.append_raw_snapshot(L.raw_snapshots(fetched(fx), "v2"), folder)
    snapshots = fx.spark.read.parquet(folder).where("payload is not null")
    rows = L.flatten_shop_snapshot(snapshots).withColumn("url", F.concat(F.lit("https://store"), F.col("store_id").cast("string"), F.lit(".de")))
    rows = rows.withColumn("api_currency", F.when(F.col("store_id") % 2 == 0, "EUR"))
    good = L.with_provenance(L.quarantine(N.normalize_prices(rows, rates(fx)))[0], "v2")
    lot = good.select(F.col("external_variant_id").alias("variant_id"), "store_id", F.col("usd_price").alias("current_price"), "in_stock", F.col("fetched_at").alias("updated_at"), "url", F.col("currency").alias("original_currency"), F.col("rate").alias("exchange_rate"), "exchange_rate_timestamp", "exchange_rate_source", "currency_source", "parser_version", "raw_snapshot_id")
    # Payloads are parsed once, for offers and intervals.
    lot = fx.kept(lot, "lot")
    none = lot.limit(0).select("variant_id", "store_id", "current_price")
    offers = U.upsert_offers(none, lot)
    seen = lot.select("variant_id", "store_id", "current_price", "updated_at", "raw_snapshot_id")
    taken = U.accepted(seen, "current_price", "updated_at").withColumnsRenamed({"current_price": "price", "updated_at": "ts"}).withColumn("product_id", F.lit(None).cast("long"))
    intervals = I.build_price_intervals(taken, carried=("raw_snapshot_id",)).groupBy("variant_id", "store_id", "raw_snapshot_id").agg(F.count("*").alias("intervals"))
    back = snapshots.groupBy(F.col("snapshot_id").alias("raw_snapshot_id")).agg(F.count("*").alias("snapshots"), F.max(F.col("response_headers")["x-page"]).cast("long").alias("page"))
    # As many intervals as offers, so none is sent whole, however small their files are.
    out = offers.join(back, "raw_snapshot_id", "left").join(intervals.hint("merge"), ["variant_id", "store_id", "raw_snapshot_id"], "left")
    return out.select("variant_id", "page", "original_currency", "exchange_rate_source", "currency_source", F.date_format("exchange_rate_timestamp", "yyyy-MM-dd").alias("rate_day"), "parser_version", "snapshots", "intervals")


@query("flatten_item_snapshot", "SELECT p_partkey AS external_variant_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS vendor, p_retailprice AS price, p_partkey % 3 <> 0 AS in_stock FROM part")
def flatten_item_snapshot(fx):
    p = fx.table("part")
    attributes = F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, "brand").otherwise("other").alias("attribute_code"), F.col("p_brand").alias("value")))
    items = p.select(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 == 0, 2).alias("status"), attributes.alias("custom_attributes")).alias("i"), (F.col("p_partkey") / 100).cast("int").alias("page"))
    pages = items.groupBy("page").agg(F.to_json(F.struct(F.collect_list("i").alias("items"))).alias("payload"))
    return L.flatten_item_snapshot(pages).select("external_variant_id", "title", "vendor", "price", "in_stock")


@query(
    "append_deal_alerts",
    "SELECT substr(sha256(v.sku || '|' || s.name || '|' || printf('%.2f', current_price)), 1, 16) AS fingerprint, s.store_id, o.variant_id AS canonical_id, v.sku, current_price AS price, 1 AS n FROM fx_variants v JOIN fx_offers o USING (variant_id) JOIN fx_stores s ON s.store_id = v.store_id WHERE v.store_id % 7 <> 0",
    hold=True,
)
def append_deal_alerts(fx):
    """Alerts appended in two overlapping lots; those of stores that aren't known go, and none is logged twice."""
    rows = fx.variants.join(fx.offers.select("variant_id", F.col("current_price").alias("price")), "variant_id").join(fx.stores.select("store_id", F.col("name").alias("store")), "store_id")
    alerts = rows.select("store", F.col("variant_id").alias("canonical_id"), "sku", "price", N.alert_fingerprint(F.col("sku"), F.col("store"), F.col("price").cast("string")).alias("fingerprint"))
    folder = shared_folder(fx.spark, "alerts")
    known = fx.stores.where("store_id % 7 <> 0")
    L.append_deal_alerts(alerts.where("canonical_id % 5 = 0"), known, folder)
    L.append_deal_alerts(alerts, known, folder)
    log = fx.spark.read.parquet(folder).drop("bucket")
    return log.groupBy("fingerprint", "store_id", "canonical_id", "sku", "price").agg(F.count("*").cast("int").alias("n"))
