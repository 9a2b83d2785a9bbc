"""Curated tables: declared schemas, tables laid out by key, and scans of them by file, bucket or JDBC."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns and types of the curated tables.
SCHEMAS = {
    "stores": "store_id bigint, name string, domain string, currency string, reliability_score decimal(5,2), sync_status string, last_successful_sync timestamp",
    "products": "product_id bigint, canonical_name string, brand string, category string",
    "variants": "variant_id bigint, product_id bigint, store_id bigint, sku string, ean string, size string, color string, gender string, brand string",
    "offers": "variant_id bigint, product_id bigint, store_id bigint, current_price decimal(10,2), in_stock boolean, updated_at timestamp",
    "price_changes": "variant_id bigint, product_id bigint, store_id bigint, price decimal(10,2), old_price decimal(10,2), started_at timestamp, ended_at timestamp",
    "product_matches": "canonical_variant_id bigint, matched_variant_id bigint, match_method string, confidence_score decimal(3,2)",
}
#: The keys by which large tables are read and joined; tables of one key have equal buckets.
KEYS = {"variants": "variant_id", "offers": "variant_id", "price_changes": "variant_id"}


def conform(df, name):
    """df with the columns of a curated table, in its order and types; a value that doesn't fit is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[name]).fields])


def scan(spark, path, name):
    """A curated table's files under its declared schema; nothing is inferred, and files that lack a column give nulls."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_keyed(df, name, path, table, buckets=64):
    """Write a curated table bucketed and sorted by its key, as `table` of the session's catalog with its files at path.

    Each bucket is one file, so rows are brought together by key once, here, and
    not in every later join. Two tables with as many buckets are joined on their
    key without an exchange; a scan for one key reads one bucket.
    """
    key = KEYS[name]
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    rows = conform(df, name).repartition(buckets, key)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table, format="parquet")


def scan_keys(spark, name, table, keys):
    """Rows of some keys of a keyed table; only their buckets are read."""
    return spark.table(table).where(F.col(KEYS[name]).isin(*keys))


def write_jdbc(df, url, table, driver=None):
    options = {"driver": driver} if driver else {}
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()


def scan_jdbc(spark, url, table, column, low, high, partitions=8, driver=None):
    """A table of a database, read in ranges of a numeric column at once; rows outside low..high are in the first and last range."""
    options = {"driver": driver} if driver else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options).load()
