"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected e = target / source size times. Along a
fixed order of the source's documents the running sum of e, shifted by one
random offset u in [0, 1), crosses whole numbers; a document is emitted once for
each that it crosses, so n copies of every source come out within one of their
expectation, whatever the order. The order is by size class and then by a hash,
so that the words taken come near the target as well.

The prefix sum is e times the rank in the source, and ranks are taken in two
steps: within small cells (source, size class, first hash digits), and over the
cells' counts. A source, a size or a group of copies that holds much of the
table is spread over many cells.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
RANGES = 16


def source_targets(sizes, weights=WEIGHTS, share=SHARE, most=MOST):
    """One row per source: source, source_size, target.

    sizes has a row per source. Targets share `share` of all sizes by weight;
    none exceeds `most` times its source's size, and what is above is shared
    again by weight: the level of target per weight rises until no further
    source is above its cap. Sources are ranked for their weights within
    RANGES ranges, so no task sees them all.
    """
    order = F.col("source").asc_nulls_last()
    # Written, as the ranges' bounds are sampled and must not be drawn twice.
    ranged = durable(sizes.repartitionByRange(RANGES, order).withColumn("range", F.spark_partition_id()))
    counts = dict(ranged.groupBy("range").count().collect())
    starts = [sum(n for r, n in counts.items() if r < k) for k in range(RANGES)]
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.get(F.array(*map(F.lit, starts)), F.col("range"))
    weight = F.get(F.array([F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    rows = durable(ranged.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)))

    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        sums = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("left"), F.count_if(over).alias("capped")).first()
        if sums["capped"] == capped or not sums["left"]:
            break
        level, capped = (sums["total"] * share - (sums["taken"] or 0.0)) / sums["left"], sums["capped"]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix_copies(docs, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED, keep=()):
    """Per row: id_col, size, source_size, target, copies, taken, and the columns `keep` of docs.

    size: words of the text (null or empty: 0); a null source is a source of its
    own, ordered last. Rows of size 0 in a source without words are taken 0
    times. Repeated rows count as rows of their own; ties in the order are
    between equal rows (rows that `keep` tells apart are ordered by its hash). An
    empty table gives an empty result; further columns of docs are ignored.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    size = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(size)
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), digest.alias("digest"), kept.alias("kept"))
    rows = durable(rows.withColumn("bin", F.floor(F.sqrt(F.col("size").cast("double"))).cast("int")).withColumn("head", F.substring("digest", 1, 2)))

    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double")
    targets = targets.withColumn("u", draw / F.lit(2.0**32)).withColumn("e", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))

    cells = rows.groupBy("source", "bin", "head").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bin", "head").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    cells = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "bin", "head", "before", "source_size", "target", "u", "e")

    rank = F.row_number().over(Window.partitionBy("source", "bin", "head").orderBy("digest", "id", "size", *([F.xxhash64("kept")] if keep else [])))
    ranked = rows.withColumn("rank", rank).alias("r")
    joined = ranked.join(cells.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bin") == F.col("c.bin")) & (F.col("r.head") == F.col("c.head")))
    place = F.col("before") + F.col("rank")
    copies = (F.floor(F.col("u") + F.col("e") * place) - F.floor(F.col("u") + F.col("e") * (place - 1))).cast("long")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), *[F.col(f"kept.{c}") for c in keep]).withColumn("taken", F.col("copies") * F.col("size"))


def op9_systematic_mixture(spark, sf_dir):
    return mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS place, source_size * 2.0::DOUBLE AS cap
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS own_level
  FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT own_level FROM l WHERE own_level * weight <= cap ORDER BY cap / weight, place LIMIT 1) * weight, cap)) AS target FROM l
), e AS (
  SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS e,
         CAST(('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size::DOUBLE)), md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) AS place FROM d
)
SELECT r.doc_id, r.size, e.source_size, e.target,
       CAST((floor(u + e * r.place) - floor(u + e * (r.place - 1))) * r.size AS BIGINT) AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
