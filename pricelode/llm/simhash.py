"""SimHash near-duplicates, linked exactly by vantage-point trees.

Fingerprints that differ in at most r of 64 bits agree, in one of any n bands of
the bits, up to r // n bits. So each band gets a vantage-point tree under its
own Hamming distance with that smaller radius, where shells are thin and pruning
works; over all 64 bits at once distances lie so close to 32 that a ball of
radius 4 would reach almost every branch.

The upper levels of the trees are grown on the driver from a bounded sample and
sent to the tasks; the number of leaves follows the number of fingerprints. A
fingerprint goes home to one leaf per band, and by the triangle inequality
visits those leaves whose shell its ball crosses. Leaves are shards: each links
its members exactly, whatever the sample was. The sample only decides how even
they are; a leaf that came out large is split into blocks, and pairs of blocks
are compared, so no task holds more than two blocks.

Only distinct fingerprints are compared; shards return spanning forests of their
links, never all pairs, and distributed connected components join them.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import durable, small_batches, table
from .components import connected_components

RADIUS = 4
SHINGLE = 4
BANDS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that the trees' upper levels are grown from.
SAMPLE = 65_536
LEAF_ROWS = 2_048
#: A leaf above this many rows is split into blocks.
BLOCK_ROWS = 16_384
SEED = 42
#: Parts of a component's rows, and the share of all rows above which copies of one fingerprint are kept out of shuffles.
SALTS, HOT = 16, 1_000


def fingerprint(text, shingle=SHINGLE, seed=SEED):
    """64-bit fingerprint of a text, as an unsigned integer; 0 for null or no words."""
    import xxhash

    # Words by single spaces: every shingle is then a slice of one byte string.
    data = b" ".join((text or "").encode().lower().split())  # bytes know ASCII letters and white space only
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(data)]]).tolist()[shingle - 1 :] or [len(data)]
    digest = xxhash.xxh64_intdigest
    n = len(ends)
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=False)), dtype=np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > n, bitorder="little").tobytes(), "little")


def fingerprints(docs, id_col="doc_id", text_col="text", shingle=SHINGLE):
    """id and fp (a long with the fingerprint's bits) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": found.view(np.int64)})

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"id {kind}, fp long")


def _band(values, band):
    at, width = band
    return (values >> np.uint64(at)) & np.uint64((1 << width) - 1)


def grow_tree(sample, leaves):
    """A vantage-point tree over band values: arrays vantage, radius, inner, outer.

    A child below 0 is leaf ~child. A node's inner child holds values within
    radius of its vantage. Values that no vantage parts stay in one leaf.
    """
    nodes, count = [], 0

    def grow(values, want):
        nonlocal count
        if want > 1:
            for vantage in values[: 4 * (len(values) > 3)].tolist() + values[:1].tolist():
                distance = np.bitwise_count(values ^ np.uint64(vantage))
                radius = int(np.partition(distance, len(distance) // 2)[len(distance) // 2])
                if (distance <= radius).all():
                    radius -= 1
                inside = distance <= radius
                if radius >= 0 and inside.any() and not inside.all():
                    here = len(nodes)
                    nodes.append([vantage, radius, 0, 0])
                    # Leaves are shared out by the sample's parts.
                    part = min(want - 1, max(1, round(want * inside.mean())))
                    nodes[here][2] = grow(values[inside], part)
                    nodes[here][3] = grow(values[~inside], want - part)
                    return here
        count += 1
        return ~(count - 1)

    root = grow(sample, leaves) if len(sample) else ~0
    columns = np.array(nodes, dtype=np.int64).reshape(-1, 4)
    return root, columns[:, 0].astype(np.uint64), columns[:, 1], columns[:, 2], columns[:, 3]


def leaves_of(tree, values, reach):
    """Row numbers and leaves: each value's home, and the inner leaves that its ball of radius `reach` touches from outside.

    One side is enough: of a linked pair on two sides of a shell the outer one visits the inner side.
    """
    root, vantage, radius, inner, outer = tree
    rows, found = [], []
    stack = [(root, np.arange(len(values)))]
    while stack:
        node, some = stack.pop()
        if not len(some):
            continue
        if node < 0:
            rows.append(some)
            found.append(np.full(len(some), ~node, dtype=np.int32))
            continue
        distance = np.bitwise_count(values[some] ^ vantage[node]).astype(np.int64)
        stack.append((int(inner[node]), some[distance <= radius[node] + reach]))
        stack.append((int(outer[node]), some[distance > radius[node]]))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    return np.concatenate(rows), np.concatenate(found)


def forest(left, right, radius):
    """Spanning forest edges of all links within left, and between left and right."""
    others = np.concatenate([left, right])
    group, edges = np.arange(len(others)), []
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at : at + 256, None] ^ others[None, at:]) <= radius
        for row in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            mine = at + row
            linked = at + np.flatnonzero(near[row])
            labels, first = np.unique(group[linked], return_index=True)
            for label, k in zip(labels.tolist(), first.tolist(), strict=True):
                if label != group[mine]:
                    edges.append((int(others[mine]), int(others[linked[k]])))
                    group[group == label] = group[mine]
    return edges


def link_fingerprints(distinct, radius=RADIUS, bands=BANDS, sample=SAMPLE, leaf_rows=LEAF_ROWS, block_rows=BLOCK_ROWS):
    """u, v: edges whose components are those of all pairs of fp at most `radius` bits apart.

    distinct has a long column fp without repeats.
    """
    spark, reach = distinct.sparkSession, radius // len(bands)
    total = distinct.count()
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(1, total // sample))) == 0).limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64)
    some = np.sort(some).view(np.uint64)
    some = some[np.random.default_rng(1).permutation(len(some))]
    # The tree's size is bounded like the sample; beyond that leaves grow and are split into blocks.
    leaves = min(max(1, total // leaf_rows), max(1, sample // 4))
    trees = [grow_tree(np.unique(_band(some, b))[np.random.default_rng(2).permutation(len(np.unique(_band(some, b))))], leaves) for b in bands]
    shared = spark.sparkContext.broadcast(trees)

    def place(batches):
        waiting, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                waiting.append(batch["fp"].to_numpy(dtype=np.int64))
                n += len(batch)
            if waiting and (batch is None or n >= 65_536):
                values, waiting, n = np.concatenate(waiting), [], 0
                for number, band in enumerate(bands):
                    rows, leaf = leaves_of(shared.value[number], _band(values.view(np.uint64), band), reach)
                    yield pd.DataFrame({"band": np.full(len(rows), number, dtype=np.int32), "leaf": leaf, "fp": values[rows]})

    placed = distinct.select("fp").mapInPandas(place, "band int, leaf int, fp long")
    sizes = placed.groupBy("band", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    sizes = sizes.select("band", "leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    cut = placed.join(durable(sizes), ["band", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(2)), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = cut.select("band", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def link(key, rows):
        first = rows["own"].to_numpy() == key[2]
        values = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        edges = np.array(forest(values[first], values[~first], radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return unit.groupBy("band", "leaf", "i", "j").applyInPandas(link, "u long, v long")


def near_duplicates(docs, id_col="doc_id", text_col="text", radius=RADIUS, shingle=SHINGLE):
    """Per row: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Words are runs of anything but ASCII white space after lower-casing A-Z; a
    text of fewer words than a shingle is one shingle; null, empty and blank
    texts have fingerprint 0, which links like any other. Rows that repeat an
    id are rows of their own; null ids come last: a component that has no other
    id has the id null. An empty table gives an empty result; further columns
    are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    heads = durable(prints.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("n")))
    linked = connected_components(link_fingerprints(heads.select("fp"), radius))
    # Only linked fingerprints have a component to ask; a large component is spread by a salt.
    members = durable(linked.withColumnRenamed("node", "fp").join(heads.select("fp", "head"), "fp"))
    least = members.groupBy("component").agg(F.min("head").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"])
    grouped = heads.join(spread.select("fp", "least", F.lit(True).alias("grouped")), "fp", "left")
    by_print = durable(grouped.select("fp", "n", F.when(F.col("grouped"), F.col("least")).otherwise(F.col("head")).alias("component_id")))
    # Fewer than HOT fingerprints can each hold more than one in HOT of all rows, so these few are broadcast and their rows not shuffled.
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = by_print.where(F.col("n") > total / HOT).drop("n")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(by_print.drop("n"), "fp")
    out = prints.join(F.broadcast(hot), "fp").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_vantage_trees(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
