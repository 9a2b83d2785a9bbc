"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the distinct shingle sets are linked by vantage-point
trees (simhash.link_fingerprints) up to REACH of 64 bits, and what they link is
tested on the sets themselves. At similarity 0.8 fingerprints differ in about 10
bits, and trees wide enough for all such pairs would reach nearly every leaf. So
pairs that the trees did not give are candidates too if they share one of BANDS
MinHash buckets; a pair at similarity 0.8 misses all of them once in 14,000
times, a pair above it less often. Fingerprints up to RADIUS bits apart and
sizes that allow it are asked for, and the sets are tested likewise.

A large group of near copies must not make all its pairs. The trees give
spanning forests. Each bucket's members are compared with one of them, another
in each bucket, and, where several components are left, with the one that has
the fewest shingles of its own. Only then are pairs in different components
compared, and of those only pairs that can be similar enough: a set shares at
most the shingles that some other set of the open buckets holds, and two sets
differ at least in as many elements as their odd sketches do in bits. These
bounds rule out most pairs of a large family whose members differ too much; no
link is lost to them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import drop_unused, durable, small_batches
from .components import connected_components
from .simhash import link_fingerprints

SHINGLE = 5
LEAST = 0.8
#: Trees over a third of the bits each prune while balls of 1 bit are asked for, which find all fingerprints so many bits apart; balls of 2 bits visit twice the leaves at 50,000 fingerprints and four times at 240,000.
REACH = 5
#: Fingerprints at similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 24
BANDS, ROWS = 24, 5

_RANDOM = np.random.default_rng(5)
_ODD, _FLIP = (_RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
_ODD |= np.uint32(1)
_PLACE = _RANDOM.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = None


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n):
    """Powers of the base and of its inverse modulo 2 ** 64, n at least."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(65_536, 2 * n)
        _powers = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def shingle_set(text, shingle=SHINGLE):
    """Sorted distinct 64-bit hashes of a text's shingles; none for null or no words. A text of fewer words is one shingle."""
    data = b" ".join((text or "").encode().lower().split())  # bytes know ASCII letters and white space only
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    ends = ends[min(shingle, len(ends)) - 1 :]
    starts = starts[: len(ends)]
    # Hashes of slices are differences of one running polynomial.
    powers, inverses = _powers_to(len(raw) + 1)
    total = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64))
    return np.unique(_mix((total[ends] - total[starts]) * inverses[starts]))


def fingerprint(hashes):
    """SimHash of a shingle set, as an unsigned integer."""
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        totals += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * totals > len(hashes), bitorder="little").view(np.uint64)[0]


def buckets(hashes):
    """One key per band: equal keys for sets whose ROWS smallest permuted hashes of the band are equal."""
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.empty(BANDS * ROWS, dtype=np.uint64)
    for at in range(0, len(least), 8):
        some = slice(at, at + 8)
        least[some] = ((short[None, :] ^ _FLIP[some, None]) * _ODD[some, None]).min(axis=1)
    keys = (_mix(least.reshape(BANDS, ROWS) + np.uint64(1)) * _PLACE).sum(axis=1, dtype=np.uint64)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64))


def similarity(a, b):
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _marks(rows):
    """key, node (a hash of the shingle set), n (its size), fp and keys of every row; node 0 has no words."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingle_set(text)
                if len(found):
                    node = _mix(found ^ np.uint64(_BASE)).sum(dtype=np.uint64)
                    out.append((node.astype(np.int64), len(found), fingerprint(found).astype(np.int64), buckets(found).view(np.int64)))
                else:
                    out.append((0, 0, 0, np.zeros(0, dtype=np.int64)))
            yield pd.concat([batch[["key"]].reset_index(drop=True), pd.DataFrame(out, columns=["node", "n", "fp", "keys"])], axis=1)

    return rows.select("key", "text").mapInPandas(run, "key string, node long, n long, fp long, keys array<long>")


def _sets(texts):
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "set": [shingle_set(t).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(run, "node long, set binary")


def _linked(pairs, sets):
    """Of pairs u, v those that are near copies."""

    def run(batches):
        for batch in batches:
            near = [similarity(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) >= LEAST for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[near, ["u", "v"]]

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def _pairs(both, able=None):
    """Distinct pairs of the structs a and b that fingerprints and sizes allow, and the condition able if given."""
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS) & (F.least("a.n", "b.n") >= LEAST * F.greatest("a.n", "b.n") - 1e-6)
    both = both.where(near if able is None else near & able)
    return both.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _told(df, name, source, *more):
    """df with the struct `name` of the node that stands in its column `name`."""
    own = source.select(F.col("node").alias(name), F.struct("node", "n", "fp", *more).alias("_told"))
    return df.join(own, name).drop(name).withColumnRenamed("_told", name)


def tree_pairs(nodes):
    """Pairs u, v of nodes (node, n, fp) that vantage-point trees over their fingerprints link, and sizes allow.

    Forests of all links of at most REACH bits between distinct fingerprints,
    each by its smallest node, which the others of the same fingerprint are tied to.
    """
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(prints, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = link_fingerprints(prints.select("fp"), REACH).distinct()
    for fp, end in (("u", "a"), ("v", "b")):
        links = links.join(prints.select(F.col("fp").alias(fp), F.col("head").alias(end)), fp)
    return _pairs(_told(_told(same.unionByName(links.select("a", "b")), "a", nodes), "b", nodes))


def _unshared(sets):
    """node, lone: how many of its shingles no other of the sets holds, for nodes that have such."""

    def run(batches):
        for batch in batches:
            for node, data in zip(batch["node"].tolist(), batch["set"], strict=True):
                found = np.frombuffer(data, dtype=np.int64)
                for at in range(0, len(found), 65_536):
                    some = found[at : at + 65_536]
                    yield pd.DataFrame({"node": np.full(len(some), node, dtype=np.int64), "shingle": some})

    rows = sets.mapInPandas(run, "node long, shingle long")
    held = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return held.groupBy("node").agg(F.count("*").alias("lone"))


def odd_sketch(hashes):
    """512 bits, as longs: each hash turns one of them over.

    Sketches of two sets differ in at most as many bits as the sets differ in
    elements, which is a bound and no estimate.
    """
    bits = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(sets):
    def run(batches):
        for batch in batches:
            found = np.array([odd_sketch(np.frombuffer(x, dtype=np.uint64)) for x in batch["set"]], dtype=np.int64).reshape(-1, 8)
            yield pd.DataFrame({"node": batch["node"], **{f"o{k}": found[:, k] for k in range(8)}})

    return sets.mapInPandas(run, "node long, " + ", ".join(f"o{k} long" for k in range(8)))


def near_copies(rows):
    """key and component of every row of rows, which has the string key and text.

    Rows have one component when near copies connect them; rows with equal sets
    of shingles are near copies, and so are all rows without a word (null, empty
    and blank texts). Rows of one key are one row. An empty table gives an empty
    result; further columns, of whatever names, are not read.
    """
    small_batches(rows.sparkSession)
    marks = durable(_marks(rows))
    nodes = durable(marks.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("key").alias("key")))
    near = durable(tree_pairs(nodes.select("node", "n", "fp")))
    drop_unused(rows.sparkSession)
    # Buckets hold numbers alone; what pairs are judged by joins only those that are not alone in theirs.
    all_members = nodes.select(F.explode("keys").alias("bucket"), "node")
    hub = F.min(F.struct(F.xxhash64("node", "bucket").alias("draw"), "node"))["node"]
    hubs = all_members.groupBy("bucket").agg(F.count("*").alias("members"), hub.alias("hub")).where("members > 1")
    members = durable(all_members.join(hubs, "bucket"))
    asked = members.select("node").unionByName(near.select(F.explode(F.array("u", "v")).alias("node")))
    wanted = durable(asked.distinct().join(nodes, "node").select("node", "key", "n", "fp"))
    texts = rows.select("key", "text").join(wanted.select("node", "key"), "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = durable(_sets(texts))
    drop_unused(rows.sparkSession)
    what = wanted.select("node", "n", "fp")

    def stars(df):
        """Pairs of members of a bucket and its hub, which stand in the columns node and hub."""
        return _pairs(_told(_told(df.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "a", what), "b", what))

    def still_open(placed):
        """Members, with their components, of buckets that hold several. The rounds that found these components have left shuffles that nothing reads again."""
        drop_unused(rows.sparkSession)
        rest = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        return durable(placed.join(rest, "bucket", "left_semi"))

    def placed_by(some, linked):
        return some.select("bucket", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))

    edges = lambda linked: linked.select(F.col("node").alias("u"), F.col("component").alias("v"))
    # What the trees did not pair is looked for in the buckets; one search takes the links of both.
    tried = durable(stars(members).join(near, ["u", "v"], "left_anti"))
    linked = connected_components(_linked(near, sets).unionByName(_linked(tried, sets)))
    tried = tried.unionByName(near)
    open_ = still_open(placed_by(members.where("members > 2"), linked))
    # Shingles that no other open set holds bound what a set can share with any other.
    own = open_.select("node").distinct()
    lone = _unshared(sets.join(own, "node", "left_semi"))
    shared = F.col("n") - F.coalesce("lone", F.lit(0))
    what_open = what.join(own, "node", "left_semi").join(lone, "node", "left").select("node", "n", "fp", shared.alias("shared"))
    bits = [f"o{k}" for k in range(8)]
    what_open = durable(what_open.join(_sketches(sets.join(own, "node", "left_semi")), "node"))
    # A second hub for each open bucket: the set that shares the largest part of itself.
    central = open_.join(what_open, "node").groupBy("bucket").agg(F.max_by("node", F.struct(F.col("shared") / F.col("n"), "node")).alias("hub"))
    more = durable(stars(open_.join(central, "bucket")).join(tried, ["u", "v"], "left_anti"))
    linked = connected_components(edges(linked).unionByName(_linked(more, sets)))

    # What is still apart is compared pair by pair, where the bound leaves a chance.
    left = _told(still_open(placed_by(open_, linked)).withColumnRenamed("node", "a"), "a", what_open, "shared", *bits)
    left = durable(left.where(F.col("a.shared") >= LEAST * F.col("a.n") - 1e-6))
    other = left.select("bucket", F.col("a").alias("b"), F.col("component").alias("with"))
    enough = F.least("a.shared", "b.shared") >= LEAST / (1 + LEAST) * (F.col("a.n") + F.col("b.n")) - 1e-6
    apart = sum(F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}"))) for k in bits)
    enough = enough & (apart <= (1 - LEAST) / (1 + LEAST) * (F.col("a.n") + F.col("b.n")) + 1e-6)
    rest = _pairs(left.join(other, "bucket").where(F.col("component") < F.col("with")), enough)
    rest = rest.join(tried.unionByName(more), ["u", "v"], "left_anti")
    linked = connected_components(edges(linked).unionByName(_linked(rest, sets)))
    drop_unused(rows.sparkSession)
    return marks.select("key", "node").join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
