"""Exact top-k inner products by columnar branch and bound.

Candidates lie dimension by dimension. A query's sums grow block by block of
dimensions; after each block the part still to come is bounded by the product of
the remaining norms (Cauchy-Schwarz), and candidates whose sum plus bound stays
below the k-th best sum minus bound are compacted away.

Candidates are dealt to groups and queries to blocks, both of bounded size; each
pair of a group and a block is one unit of work, and units' best k are ranked
together. No unit grows with the input, as long as no id comes with one and the
same vector in many rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import durable, table

K = 10
SCALE = 1024.0
GROUP_ROWS = 16_384
QUERY_ROWS = 8_192
BLOCK_DIMS = 16


def _matrix(vectors, dims):
    """Integer-valued matrix, a row per dimension; shorter vectors end in zeros."""
    out = np.zeros((dims, len(vectors)))
    for k, v in enumerate(vectors):
        out[: len(v), k] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
    return out


def best_of_group(queries, candidates, k=K):
    """(query number, candidate number, score) of each query's best k.

    Both have id and vec; a candidate with the query's id is left out. Ties go
    to the smaller id.
    """
    dims = max(max(map(len, queries["vec"]), default=0), max(map(len, candidates["vec"]), default=0))
    q, c = _matrix(queries["vec"], dims), _matrix(candidates["vec"], dims)
    most = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
    ids, own = candidates["id"].to_numpy(), queries["id"].to_numpy()
    if most * most * max(dims, 1) >= 2.0**53:  # sums in doubles would not be exact
        q, c = q.astype(object), c.astype(object)
        for row in (*q, *c):
            row[:] = [int(x) for x in row]
        found = []
        for n in range(len(own)):
            scores = q[:, n].dot(c) if dims else np.zeros(len(ids), dtype=object)
            order = sorted((-s, i, m) for m, (s, i) in enumerate(zip(scores, ids, strict=True)) if i != own[n])[:k]
            found += [(n, m, max(-(2**63), min(2**63 - 1, -s))) for s, _, m in order]
        return found

    starts = list(range(0, dims, BLOCK_DIMS)) or [0]
    rest_c = [np.sqrt((c[s:] ** 2).sum(axis=0)) for s in [*starts[1:], dims]]
    rest_q = [np.sqrt((q[s:] ** 2).sum(axis=0)) for s in [*starts[1:], dims]]
    # The first candidates' full scores give every query a floor to begin with.
    first = (q.T @ c[:, :256]) if dims else np.zeros((len(own), min(256, len(ids))))
    found = []
    for n in range(len(own)):
        head = first[n][ids[:256] != own[n]]
        floor = np.partition(head, len(head) - k)[len(head) - k] if len(head) >= k else -np.inf
        alive = np.flatnonzero(ids != own[n])
        sums = np.zeros(len(alive))
        for b, s in enumerate(starts):
            block, weights = c[s : s + BLOCK_DIMS], q[s : s + BLOCK_DIMS, n]
            sums = sums + weights @ (block if len(alive) == len(ids) else block[:, alive])
            bound = rest_q[b][n] * rest_c[b][alive] * (1 + 1e-12)
            if len(alive) > k:
                low = sums - bound
                floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
                stay = sums + bound >= floor
                if not stay.all():
                    alive, sums = alive[stay], sums[stay]
        order = np.lexsort((ids[alive], -sums))[:k]
        found += [(n, int(alive[m]), int(sums[m])) for m in order]
    return found


def top_k(vectors, queries, id_col="vec_id", vec_col="embedding", k=K, group_rows=GROUP_ROWS, query_rows=QUERY_ROWS):
    """query_id, rank (from 1), vec_id, score: the k rows of vectors with the highest inner product for each query.

    Components count as floor(1024 * x). Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part. Vectors of
    unequal length end in zeros; scores beyond a long are held at its ends. A
    query never finds rows of its own id; other rows that repeat an id are found
    as often as they come. A query id that repeats is asked once, with its least
    vector. Empty tables give an empty result; further columns are ignored.
    """
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def usable(df):
        rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", whole))

    candidates, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = durable(asked)
    groups = max(1, -(-candidates.count() // group_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    # A row number would need one task. Rows that repeat an id are parted by their vectors.
    deal = lambda n: F.pmod(F.xxhash64("id", "vec", F.lit(7)), F.lit(n)).cast("int")
    left = candidates.withColumn("g", deal(groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("b", deal(blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    kind = candidates.schema["id"].dataType.simpleString()

    def unit(key, some, asking):
        some, asking = some.reset_index(drop=True), asking.reset_index(drop=True)
        found = best_of_group(asking, some, k) if len(some) and len(asking) else []
        n, m, score = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pd.DataFrame({"query_id": asking["id"].take(n).to_numpy(), "vec_id": some["id"].take(m).to_numpy(), "score": np.array(score, dtype=np.int64)})

    best = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(unit, f"query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_branch_and_bound(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.ints::DOUBLE[], c.ints::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
