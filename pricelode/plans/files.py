"""Queries: file sources and sinks, each written to a shared folder and read back."""

from pyspark.sql import functions as F

from pricelode.session import shared_folder
from pricelode.sources import landing as L

from .catalog import query


@query("scan_site_list_text", "SELECT url FROM pages WHERE page_id % 3 <> 0")
def scan_site_list_text(fx):
    folder = shared_folder(fx.spark, "sites")
    # Every third line is a comment or blank.
    line = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit(" # "), "url")).when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    fx.pages.select(line.alias("value")).write.text(folder)
    return L.scan_site_list_text(fx.spark, folder)


@query("scan_site_list_json", "SELECT 'https://' || domain AS url, currency, sync_status <> 'dead' AS enabled FROM fx_stores")
def scan_site_list_json(fx):
    folder = shared_folder(fx.spark, "list")
    # A file holds one array, of a hundred stores or fewer.
    rows = fx.stores.groupBy(F.floor(F.col("store_id") / 100).alias("k")).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("https://"), "domain").alias("url"), "currency", (F.col("sync_status") != "dead").alias("enabled")))).alias("value"))
    rows.write.partitionBy("k").text(folder)
    return L.scan_site_list_json(fx.spark, folder).select("url", "currency", "enabled")


@query("sink_json", "SELECT variant_id, store_id, current_price FROM fx_offers WHERE in_stock")
def sink_json(fx):
    folder = shared_folder(fx.spark, "json")
    L.sink_json(fx.offers.where("in_stock").select("variant_id", "store_id", F.col("current_price").cast("double").alias("current_price")), folder)
    return fx.spark.read.schema("variant_id long, store_id long, current_price double").json(folder)


@query("sink_text", "SELECT DISTINCT url AS value FROM pages")
def sink_text(fx):
    folder = shared_folder(fx.spark, "text")
    L.sink_text(fx.pages.select("url").distinct(), folder)
    return fx.spark.read.text(folder)


@query("append_price_history", "SELECT variant_id, price, count(*) AS n FROM (SELECT variant_id, price FROM fx_obs UNION ALL SELECT variant_id, price FROM fx_obs WHERE in_stock) GROUP BY ALL")
def append_price_history(fx):
    folder = shared_folder(fx.spark, "log")
    L.append_price_history(fx.obs.select("variant_id", "price"), folder)
    L.append_price_history(fx.obs.where("in_stock").select("variant_id", "price"), folder)
    return fx.spark.read.parquet(folder).groupBy("variant_id", "price").agg(F.count("*").alias("n"))


@query("rebuild_overwrite", "SELECT canonical_variant_id, matched_variant_id, match_method FROM fx_matches")
def rebuild_overwrite(fx):
    folder = shared_folder(fx.spark, "matches")
    rows = fx.matches.select("canonical_variant_id", "matched_variant_id", "match_method")
    L.rebuild_overwrite(rows.where("match_method = 'ean_gtin'"), folder)
    L.rebuild_overwrite(rows, folder)
    return L.read_versioned(fx.spark, folder)
