"""Retail tables derived from the star-schema tables, in Spark and as DuckDB common table expressions.

Time is compressed: a day of l_shipdate is an hour here.
"""

import re
from functools import cached_property

from pyspark.sql import functions as F

from pricelode.operators.intervals import build_price_intervals
from pricelode.operators.matching import match_products
from pricelode.session import held

AS_OF = "2024-04-15 00:00:00"
SUFFIXES = (".com", ".de", ".co.uk", ".jp", ".kr")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "KRW")
STATUSES = ("success", "success", "empty", "error", "dead")


def two_places(col):
    """A double as decimal with two places, rounded half up by the same floating-point steps as in SQL."""
    return (F.floor(col * 100 + 0.5).cast("decimal(16,0)") / 100).cast("decimal(10,2)")


def pick(values, index):
    return F.element_at(F.array([F.lit(v) for v in values]), (index + 1).cast("int"))


class Fixtures:
    """The derived tables of one data folder, each a lazy DataFrame; with hold those that others build on are written once."""

    def __init__(self, spark, sf_dir, hold=False):
        self.spark, self.sf_dir, self.hold = spark, sf_dir, hold
        self.as_of = F.lit(AS_OF).cast("timestamp")

    def kept(self, df, name):
        return held(df, name) if self.hold else df

    def table(self, name):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stores(self):
        s = self.table("supplier")
        n = F.col("s_nationkey") % 5
        back = (F.col("s_suppkey") % 10 * 20).cast("int")
        return s.select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("store"), F.col("s_suppkey").cast("string"), pick(SUFFIXES, n)).alias("domain"),
            pick(CURRENCIES, n).alias("currency"),
            two_places(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("s_acctbal") / 100))).cast("decimal(5,2)").alias("reliability_score"),
            pick(STATUSES, F.col("s_suppkey") % 5).alias("sync_status"),
            F.when(F.col("s_suppkey") % 11 != 0, F.timestamp_add("HOUR", -back, self.as_of)).alias("last_successful_sync"),
        )

    @cached_property
    def obs(self):
        """One observation per part, supplier and time; the latest line wins ties."""
        li = self.table("lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.struct("l_orderkey", "l_linenumber", two_places(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_returnflag").alias("line"))
        last = li.groupBy("l_partkey", "l_suppkey", "day").agg(F.max("line").alias("line"))
        rows = last.select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("variant_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("store_id"),
            F.timestamp_add("HOUR", F.datediff("day", F.lit("1995-01-01").cast("date")), F.lit("2024-01-01").cast("timestamp")).alias("ts"),
            F.col("line.price").alias("price"),
            (F.col("line.l_returnflag") != "R").alias("in_stock"),
        )
        return self.kept(rows, "obs")

    @cached_property
    def changes(self):
        return self.kept(build_price_intervals(self.obs), "changes")

    @cached_property
    def offers(self):
        last = self.obs.groupBy("variant_id", "product_id", "store_id").agg(F.max(F.struct("ts", "price", "in_stock")).alias("o"))
        rows = last.select("variant_id", "product_id", "store_id", F.col("o.price").alias("current_price"), F.col("o.in_stock").alias("in_stock"), F.col("o.ts").alias("updated_at"))
        return self.kept(rows, "offers")

    @cached_property
    def variants(self):
        p = self.table("part")
        # An offer is the last observation of its variant, so these are all variants.
        v = self.offers.select("variant_id", "product_id", "store_id")
        key = F.col("p_partkey")
        return v.join(p, v.product_id == p.p_partkey).select(
            "variant_id",
            "product_id",
            "store_id",
            F.when(key % 4 == 0, (F.lit(500000000000) + key).cast("string")).otherwise(F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 6, "0"))).alias("sku"),
            F.when(key % 50 == 0, (F.lit(4006381000000) + F.col("store_id") % 3).cast("string")).when(key % 5 == 0, (F.lit(4006381000000) + key).cast("string")).alias("ean"),
            (F.col("p_size") + F.when(F.col("store_id") % 7 == 0, 1).otherwise(0)).cast("string").alias("size"),
            F.split("p_name", " ")[0].alias("color"),
            pick(("UNKNOWN", "MEN", "WOMEN"), key % 3).alias("gender"),
            F.col("p_brand").alias("brand"),
        )

    @cached_property
    def odd_variants(self):
        """Variants that meet every clause of matching: skus that say nothing, of two brands, in small letters and padded; null and blank sizes, colours, EANs and genders; a tenth of the products in one store, as far as their variants say."""
        v = self.variants
        k, s = F.col("product_id"), F.col("store_id")
        way = k % 40
        plain = F.concat(F.lit("SKU-"), F.lpad(k.cast("string"), 6, "0"))
        sku = (
            F.when(way == 7, "One Size").when(way == 11, "X1").when(way == 13, F.lpad(k.cast("string"), 6, "0")).when(way == 17, F.lpad(k.cast("string"), 8, "1"))
            .when(way == 19, F.when(s % 2 == 0, F.concat(F.lit(" "), F.lower(plain), F.lit(" "))).otherwise(plain)).when(way == 23, F.lit(None)).when(way == 29, "n/a").otherwise(F.col("sku"))
        )
        none = lambda test, c: F.when(test, F.lit(None)).otherwise(F.col(c)).alias(c)
        return v.select(
            "variant_id",
            "product_id",
            F.when(k % 10 == 9, 1).otherwise(s).cast("long").alias("store_id"),
            sku.alias("sku"),
            F.when((k % 5 != 0) & (s % 3 == 1), " ").otherwise(F.col("ean")).alias("ean"),
            none((k % 8 == 0) | (k % 8 == 3) & (s % 4 == 0), "size"),
            none((k % 12 == 4) | (k % 12 == 5) & (s % 4 == 1), "color"),
            F.when((k % 9 == 1) & (s % 2 == 0), "UNKNOWN").when((k % 9 == 2) & (s % 2 == 0), F.lit(None)).otherwise(F.col("gender")).alias("gender"),
            F.when((k % 6 == 1) & (s % 2 == 1), "By Other-Brand").when((k % 6 == 2) & (s % 2 == 1), F.lower(F.concat(F.lit("by "), "brand"))).otherwise(F.col("brand")).alias("brand"),
        )

    @cached_property
    def odd_offers(self):
        """Offers, of which every third variant has another in the next store but one."""
        o = self.offers
        return o.unionByName(o.where("variant_id % 3 = 0").withColumn("store_id", F.col("store_id") % 7 + 1))

    @cached_property
    def products(self):
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))

    @cached_property
    def matches(self):
        return self.kept(match_products(self.variants, self.offers), "matches")

    @cached_property
    def members(self):
        """Each canonical variant with itself and what is matched to it."""
        m = self.matches
        return self.kept(m.select(F.col("canonical_variant_id").alias("canonical_id"), F.explode(F.array("canonical_variant_id", "matched_variant_id")).alias("variant_id")).distinct(), "members")

    @cached_property
    def member_offers(self):
        return self.members.join(self.offers, "variant_id")

    @cached_property
    def alerts(self):
        e = self.table("events").where("event_type = 'purchase'")
        return e.select(F.col("event_id").alias("alert_id"), F.col("ts").alias("sent_at"), F.col("user_id").alias("canonical_id"), two_places(F.col("value")).alias("price"), F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 0).alias("label"))

    @cached_property
    def broken_changes(self):
        """Changes with planted violations: ends put off by 400 hours, open intervals twice, prices below zero."""
        c, v = self.changes, F.col("variant_id")
        late = F.when((v % 7 == 0) & F.col("ended_at").isNotNull(), F.timestamp_add("HOUR", F.lit(400), F.col("ended_at"))).otherwise(F.col("ended_at"))
        c = c.withColumn("ended_at", late).withColumn("price", F.when(v % 13 == 0, -F.col("price")).otherwise(F.col("price")).cast("decimal(10,2)"))
        again = c.where((v % 11 == 0) & F.col("ended_at").isNull()).withColumn("started_at", F.timestamp_add("HOUR", F.lit(-1), F.col("started_at")))
        return c.unionByName(again)

    @cached_property
    def pages(self):
        return self.table("pages")

    @property
    def alerts_as_of(self):
        return F.lit("2024-01-31 00:00:00").cast("timestamp")


#: The planted violations of broken_changes, as a definition for SQL that begins with WITH.
BROKEN_CHANGES = """fx_late AS (SELECT variant_id, product_id, store_id, CASE WHEN variant_id % 13 = 0 THEN -price ELSE price END AS price, old_price, started_at, CASE WHEN variant_id % 7 = 0 THEN ended_at + INTERVAL 400 HOUR ELSE ended_at END AS ended_at FROM fx_changes),
 fx_broken AS (SELECT * FROM fx_late UNION ALL SELECT variant_id, product_id, store_id, price, old_price, started_at - INTERVAL 1 HOUR, ended_at FROM fx_late WHERE variant_id % 11 = 0 AND ended_at IS NULL)"""

_PICK = "CASE {i} WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' WHEN 3 THEN '{3}' ELSE '{4}' END"

#: DuckDB definitions, each of those before it.
SQL = {
    "fx_stores": f"""
  SELECT s_suppkey AS store_id, s_name AS name, 'store' || s_suppkey || {_PICK.format(*SUFFIXES, i='s_nationkey % 5')} AS domain,
         {_PICK.format(*CURRENCIES, i='s_nationkey % 5')} AS currency,
         floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, s_acctbal / 100)) * 100 + 0.5) / 100 AS reliability_score,
         {_PICK.format(*STATUSES, i='s_suppkey % 5')} AS sync_status,
         CASE WHEN s_suppkey % 11 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(s_suppkey % 10 * 20 AS INTEGER)) END AS last_successful_sync
  FROM supplier""",
    "fx_obs": """
  SELECT l_partkey * 100000 + l_suppkey AS variant_id, l_partkey AS product_id, l_suppkey AS store_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)) AS ts,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_returnflag <> 'R' AS in_stock
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC) = 1""",
    "fx_kept": """
  SELECT *, lag(price) OVER (PARTITION BY variant_id, store_id ORDER BY ts) AS old_price FROM fx_obs
  QUALIFY price IS DISTINCT FROM lag(price) OVER (PARTITION BY variant_id, store_id ORDER BY ts)""",
    "fx_changes": """
  SELECT variant_id, product_id, store_id, price, old_price, ts AS started_at, lead(ts) OVER (PARTITION BY variant_id, store_id ORDER BY ts) AS ended_at FROM fx_kept""",
    "fx_offers": """
  SELECT variant_id, product_id, store_id, price AS current_price, in_stock, ts AS updated_at FROM fx_obs
  QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY ts DESC) = 1""",
    "fx_variants": """
  SELECT v.variant_id, v.product_id, v.store_id,
         CASE WHEN p_partkey % 4 = 0 THEN CAST(500000000000 + p_partkey AS VARCHAR) ELSE 'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS sku,
         CASE WHEN p_partkey % 50 = 0 THEN CAST(4006381000000 + v.store_id % 3 AS VARCHAR) WHEN p_partkey % 5 = 0 THEN CAST(4006381000000 + p_partkey AS VARCHAR) END AS ean,
         CAST(p_size + CASE WHEN v.store_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS size, split_part(p_name, ' ', 1) AS color,
         CASE p_partkey % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'MEN' ELSE 'WOMEN' END AS gender, p_brand AS brand
  FROM (SELECT DISTINCT variant_id, product_id, store_id FROM fx_obs) v JOIN part ON p_partkey = v.product_id""",
    "fx_products": "SELECT p_partkey AS product_id, p_name AS canonical_name, p_brand AS brand, p_type AS category FROM part",
    "fx_norm": """
  SELECT *, upper(trim(sku)) AS nsku, regexp_replace(regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'), '^by', '') AS brand_key,
         regexp_full_match(coalesce(ean, ''), '[0-9]{12,14}') AS ean_gtin, regexp_full_match(sku, '[0-9]{12,13}') AS sku_gtin,
         CASE WHEN regexp_full_match(coalesce(ean, ''), '[0-9]{12,14}') THEN 100 ELSE 0 END + CASE WHEN size <> '' THEN 10 ELSE 0 END + CASE WHEN color <> '' THEN 10 ELSE 0 END
         + CASE WHEN gender <> 'UNKNOWN' THEN 5 ELSE 0 END + CASE WHEN regexp_full_match(sku, '[0-9]{12,13}') THEN 50 ELSE 0 END + CASE WHEN length(sku) > 6 THEN 5 ELSE 0 END AS quality
  FROM fx_variants
  WHERE variant_id IN (SELECT variant_id FROM fx_offers) AND length(trim(sku)) > 4
    AND upper(trim(sku)) NOT IN ('ONE SIZE','ONESIZE','DEFAULT','N/A','NA','STD','STANDARD','TEST','UNIVERSAL','GENERIC','OS')
    AND NOT regexp_full_match(sku, '[0-9]{1,6}') AND NOT (regexp_full_match(sku, '[0-9]+') AND length(sku) NOT IN (12, 13))""",
    "fx_matches": """
  SELECT c.variant_id AS canonical_variant_id, n.variant_id AS matched_variant_id,
         CASE WHEN n.ean_gtin THEN 'ean_gtin' WHEN n.sku_gtin THEN 'sku_gtin' ELSE 'sku_exact' END AS match_method,
         CAST(CASE WHEN n.ean_gtin THEN 0.99 WHEN n.sku_gtin THEN 0.97 ELSE 0.95 END AS DOUBLE) AS confidence_score
  FROM fx_norm n
  JOIN (SELECT nsku, count(DISTINCT store_id) AS stores, count(DISTINCT brand_key) AS brands, min(ean) AS least, max(ean) AS most FROM fx_norm GROUP BY nsku) a ON a.nsku = n.nsku
  JOIN (SELECT * FROM fx_norm QUALIFY row_number() OVER (PARTITION BY nsku ORDER BY quality DESC, variant_id) = 1) c ON c.nsku = n.nsku
  WHERE a.stores >= 2 AND n.variant_id <> c.variant_id AND (n.ean IS NULL OR a.least = a.most)
    AND NOT EXISTS (SELECT 1 FROM fx_offers o1 JOIN fx_offers o2 ON o1.store_id = o2.store_id WHERE o1.variant_id = c.variant_id AND o2.variant_id = n.variant_id)
    AND (n.ean_gtin OR n.sku_gtin OR a.brands = 1)
    AND (n.size = c.size OR (n.size IS NULL AND c.size IS NULL AND (n.ean_gtin OR n.sku_gtin)))
    AND (n.color = c.color OR (n.color IS NULL AND c.color IS NULL AND (n.ean_gtin OR n.sku_gtin)))
    AND ((n.gender = c.gender AND n.gender <> 'UNKNOWN') OR n.ean_gtin OR n.sku_gtin)""",
    "fx_members": """
  SELECT canonical_variant_id AS canonical_id, canonical_variant_id AS variant_id FROM fx_matches UNION SELECT canonical_variant_id, matched_variant_id FROM fx_matches""",
    "fx_moffers": "SELECT m.canonical_id, o.* FROM fx_members m JOIN fx_offers o USING (variant_id)",
    "fx_alerts": """
  SELECT event_id AS alert_id, ts AS sent_at, user_id AS canonical_id, floor(value * 100 + 0.5) / 100 AS price, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label
  FROM events WHERE event_type = 'purchase'""",
}


SQL["fx_odd_variants"] = """
  SELECT variant_id, product_id, CASE WHEN product_id % 10 = 9 THEN 1 ELSE store_id END AS store_id,
         CASE product_id % 40 WHEN 7 THEN 'One Size' WHEN 11 THEN 'X1' WHEN 13 THEN lpad(product_id::VARCHAR, 6, '0') WHEN 17 THEN lpad(product_id::VARCHAR, 8, '1')
           WHEN 19 THEN CASE WHEN store_id % 2 = 0 THEN ' ' || lower('SKU-' || lpad(product_id::VARCHAR, 6, '0')) || ' ' ELSE 'SKU-' || lpad(product_id::VARCHAR, 6, '0') END
           WHEN 23 THEN NULL WHEN 29 THEN 'n/a' ELSE sku END AS sku,
         CASE WHEN product_id % 5 <> 0 AND store_id % 3 = 1 THEN ' ' ELSE ean END AS ean,
         CASE WHEN product_id % 8 = 0 OR product_id % 8 = 3 AND store_id % 4 = 0 THEN NULL ELSE size END AS size,
         CASE WHEN product_id % 12 = 4 OR product_id % 12 = 5 AND store_id % 4 = 1 THEN NULL ELSE color END AS color,
         CASE WHEN product_id % 9 = 1 AND store_id % 2 = 0 THEN 'UNKNOWN' WHEN product_id % 9 = 2 AND store_id % 2 = 0 THEN NULL ELSE gender END AS gender,
         CASE WHEN product_id % 6 = 1 AND store_id % 2 = 1 THEN 'By Other-Brand' WHEN product_id % 6 = 2 AND store_id % 2 = 1 THEN lower('by ' || brand) ELSE brand END AS brand
  FROM fx_variants"""
SQL["fx_odd_offers"] = "SELECT * FROM fx_offers UNION ALL SELECT * REPLACE (store_id % 7 + 1 AS store_id) FROM fx_offers WHERE variant_id % 3 = 0"
SQL["fx_odd_trim"] = "SELECT * REPLACE (trim(sku) AS sku, nullif(trim(ean), '') AS ean) FROM fx_odd_variants"
for _name, _of in (("fx_odd_norm", "fx_norm"), ("fx_odd_matches", "fx_matches")):
    SQL[_name] = SQL[_of].replace("fx_variants", "fx_odd_trim").replace("fx_offers", "fx_odd_offers").replace("fx_norm", "fx_odd_norm")


def with_fixtures(sql):
    """sql after the definitions it needs; $AS_OF stands for the time of all queries."""
    need, stack = set(), [sql]
    while stack:
        for name in re.findall(r"\bfx_\w+", stack.pop()):
            if name in SQL and name not in need:
                need.add(name)
                stack.append(SQL[name])
    heads = [f"{name} AS MATERIALIZED ({SQL[name]})" for name in SQL if name in need]
    body = sql.strip()
    if heads:
        more = re.match(r"WITH( RECURSIVE)?\s+", body)
        body = f"WITH{more[1] or '' if more else ''} " + ", ".join(heads) + (", " + body[more.end() :] if more else " " + body)
    return body.replace("$AS_OF", f"TIMESTAMP '{AS_OF}'")
