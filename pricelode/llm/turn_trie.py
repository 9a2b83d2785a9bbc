"""Conversation prefixes as adaptive radix trees over fixed-width turn ids.

A turn's id is big-endian and of WIDTH bytes: 16 of a hash of role and text,
then the code points of the text. A conversation is its ids in a row. Equal
conversations are counted first; the distinct ones are dealt to parts by ranges
of their bytes, so neither a common first turn nor many copies make one part
large. Each part grows one tree. What a part knows about the prefixes that it
shares with the parts before and after it is summed over the parts.
"""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from .common import durable, small_batches, table

HASH = 16
WIDTH = HASH + 4
#: Bytes of distinct conversations in a part, about.
PART_BYTES = 2_000_000
#: Ids of members that agree but for so many low bits are gathered in one row.
RUN_BITS = 12


class Node:
    """A node of a radix tree: the bytes [start, end) of the key `like`, then children by their next byte.

    Children lie in one of four layouts, each replaced by the next larger when
    full: up to 4 or 16 in order of their bytes, up to 48 behind an index of 256
    bytes, or 256 places.
    """

    __slots__ = ("like", "start", "end", "size", "bytes", "kids", "value")

    def __init__(self, like, start, end, value=None):
        self.like, self.start, self.end, self.value = like, start, end, value
        self.size, self.bytes, self.kids = 4, bytearray(), []

    def find(self, byte):
        if self.size == 256:
            return self.kids[byte]
        if self.size == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte, kid):
        """Add a child, or put another in its place."""
        if self.size <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) == self.size:
                self._grow()
        elif self.size == 48 and not self.bytes[byte] and len(self.kids) == 48:
            self._grow()
        if self.size == 256:
            self.kids[byte] = kid
        elif self.size == 48:
            if self.bytes[byte]:
                self.kids[self.bytes[byte] - 1] = kid
            else:
                self.kids.append(kid)
                self.bytes[byte] = len(self.kids)
        else:
            at = sum(x < byte for x in self.bytes)
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)

    def _grow(self):
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            index = bytearray(256)
            for k, byte in enumerate(self.bytes):
                index[byte] = k + 1
            self.size, self.bytes = 48, index
        else:
            places = [None] * 256
            for byte in range(256):
                if self.bytes[byte]:
                    places[byte] = self.kids[self.bytes[byte] - 1]
            self.size, self.bytes, self.kids = 256, None, places

    def children(self):
        """In order of their bytes."""
        if self.size == 256:
            return [k for k in self.kids if k is not None]
        if self.size == 48:
            return [self.kids[at - 1] for at in self.bytes if at]
        return self.kids


def shared(a, b, start, end):
    """The first place from start on where a and b differ, at most end and their lengths."""
    end = min(end, len(a), len(b))
    step = 64
    while start < end:
        if a[start : min(start + step, end)] == b[start : min(start + step, end)]:
            start += step
            step *= 2
        elif step == 1:
            return start
        else:
            step = max(1, step // 2) if step <= 64 else 64
    return end


def grow_tree(items):
    """The tree of (key, value) pairs with distinct keys, of which there is at least one."""
    root = None
    for key, value in items:
        if root is None:
            root = Node(key, 0, len(key), value)
            continue
        above, node = None, root
        while True:
            at = shared(key, node.like, node.start, node.end)
            if at < node.end:
                # The path splits: what both share gets a node of its own.
                fork = Node(node.like, node.start, at)
                node.start = at
                fork.put(node.like[at], node)
                if at == len(key):
                    fork.value = value
                else:
                    fork.put(key[at], Node(key, at, len(key), value))
                if above is None:
                    root = fork
                else:
                    above.put(key[fork.start], fork)
                break
            if at == len(key):
                node.value = value
                break
            kid = node.find(key[at])
            if kid is None:
                node.put(key[at], Node(key, at, len(key), value))
                break
            above, node = node, kid
    return root


def _prefix_keys(key, width):
    """A hash of each prefix of whole turns, by depth, in one pass over the key."""
    if key is None:
        return []
    digest = hashlib.md5()
    out = [digest.digest()]
    for end in range(width, len(key) + 1, width):
        digest.update(key[end - width : end])
        out.append(digest.copy().digest())
    return out


NODE = "conv_id long, depth long, parent_conv_id long, node_key binary, parent_key binary, n_convs long, n_children long, n_leaves long, sum_all long, sum_own long, ends string"


def walk_tree(root, before, after, width=WIDTH):
    """Rows of NODE for the prefixes of a part's tree that end at whole turns.

    A value is (members, smallest member, hash of the members). before, after:
    the last key of the parts before and the first of those after, or None. A
    prefix of either has a node_key, under which the parts' rows are to be
    summed. sum_all: over the subtree, members times code points; sum_own: the
    code points once, where no part before has the prefix.
    """
    # Of the prefixes that are the neighbours' too: those of the first key and of the last one.
    early_keys, late_keys = _prefix_keys(before, width), _prefix_keys(after, width)
    done, rows, stack = {}, [], [(root, before is not None, after is not None, False)]
    while stack:
        node, early, late, open_ = stack.pop()
        # Up to which byte the node's path is also that of the neighbours.
        upto_early = shared(node.like, before, node.start, node.end) if early else -1
        upto_late = shared(node.like, after, node.start, node.end) if late else -1
        if not open_:
            stack.append((node, early, late, True))
            stack += [(k, upto_early == node.end, upto_late == node.end, False) for k in node.children()]
            continue
        n, least, leaves, all_, own, kids, below = 0, None, 0, 0, 0, 0, []
        for k in node.children():
            m, low, ends, a, o, c, tops = done.pop(id(k))
            n, leaves, all_, own, kids = n + m, leaves + ends, all_ + a, own + o, kids + c
            least = low if least is None or low < least else least
            below += tops
        if node.value is not None:
            n += node.value[0]
            least = node.value[1] if least is None or node.value[1] < least else least
        # From the deepest whole turn on the path to the first; the textless one is the root's.
        last, first = node.end // width, 0 if node is root else node.start // width + 1
        for depth in range(last, first - 1, -1):
            end = depth * width
            was, goes_on = upto_early >= end, upto_late >= end
            if not kids and not below and not (goes_on and len(after) > end):
                leaves = 1
            size = int.from_bytes(node.like[end - 4 : end], "big") if depth else 0
            all_, own = all_ + n * size, own + (0 if was else size)
            value = node.value if node.value is not None and end == node.end else None
            row = [least, depth, None, None, None, n, kids, leaves, all_, own, value[2] if value else None]
            if was or goes_on:
                row[3] = early_keys[depth] if was else late_keys[depth]
            for x in below:
                x[2] = least
                if row[3] is not None:
                    x[4] = row[3]
            rows += below
            below, kids = [row], 0 if was else 1
        done[id(node)] = (n, least, leaves, all_, own, kids, below)
    for x in done.pop(id(root))[6]:
        rows.append(x)
    return rows


def _part_rows(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one part: its distinct conversations, and the neighbouring keys as rows of other kinds."""
    kinds = frame["kind"]
    edge = {k: bytes(frame["key"][kinds == k].iloc[0]) if (kinds == k).any() else None for k in (-1, 1)}
    own = frame[kinds == 0]
    values = zip(own["n"], own["least"], own["ends"], strict=True)
    root = grow_tree((bytes(k), (int(n), int(c), e)) for k, (n, c, e) in zip(own["key"], values, strict=True))
    rows = walk_tree(root, edge[-1], edge[1])
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")]).astype({"parent_conv_id": "Int64"})


def _hash_members(frames):
    """Per key, whose rows come one after the other and in order: the members' ids, comma-joined, hashed as they pass."""
    key = None
    for frame in frames:
        out = []
        for k, n, least, ids in zip(frame["key"], frame["n"], frame["least"], frame["ids"], strict=True):
            k = bytes(k)
            if k != key:
                if key is not None:
                    out.append((key, members, first, digest.hexdigest()))
                key, members, first, digest = k, 0, least, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            members += n
        yield pd.DataFrame(out, columns=["key", "n", "least", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, members, first, digest.hexdigest())], columns=["key", "n", "least", "ends"])


def turn_sequences(turns):
    """conv_id, ids: a conversation's turn ids in order.

    Rows go by turn (null first); rows of one turn by role, then by id. A null
    role or text is empty. Rows without a conv_id belong to no conversation.
    A conversation's ids are one value: 100 million turns at most.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps role and text apart.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn_id = F.concat(F.substring(F.unhex(F.sha2(whole, 256)), 1, HASH), F.substring(F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")), 1, 4))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_id.alias("turn_id"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "turn_id"))), lambda t: t["turn_id"])
    return rows.groupBy("conv_id").agg(ids.alias("ids"))


def _joined(ids):
    """An array of binaries as one binary."""
    return F.unhex(F.array_join(F.transform(ids, F.hex), ""))


def rebuilt_keys(sequences, group=100, lent=6):
    """conv_id, key: the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % lent."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string")) % lent).cast("int")
    lenders = sequences.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, lent - 1).alias("lent"))
    rows = sequences.select("conv_id", "ids", base.alias("base"), h.alias("h")).join(lenders, "base", "left")
    none = F.array().cast("array<binary>")
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("lent", none), 1, F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("ids", F.col("h") + 1, F.size("ids"))
    return rows.select("conv_id", _joined(F.concat(first, rest)).alias("key"))


def prefix_trie(keys, part_bytes=PART_BYTES):
    """The nodes of all prefixes of whole turns.

    keys: conv_id (distinct, not null), key. Further columns are not read.
    Copies are members of the same nodes. Without rows there are no nodes.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = keys.sparkSession
    # Members in runs of ids, then hashed one after the other: no list of all members is ever held.
    runs = keys.groupBy("key", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("c"))
    runs = runs.select("key", "run", F.size("c").cast("long").alias("n"), F.element_at("c", 1).alias("least"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"))
    small_batches(spark)
    members = runs.repartition("key").sortWithinPartitions("key", "run").mapInPandas(_hash_members, "key binary, n long, least long, ends string")
    members = durable(members)
    size = members.agg(F.sum(F.length("key") + WIDTH)).first()[0]
    if size is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    parts = max(1, -(-size // part_bytes))
    ranged = durable(members.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # Parts that got rows, in order; their neighbours are the next that got some. One row per part.
    order = ends.select("part").withColumn("one", F.lit(1)).groupBy("one").agg(F.sort_array(F.collect_list("part")).alias("all")).select("all", F.posexplode("all").alias("at", "part"))
    near = order.select("part", F.when(F.col("at") > 0, F.element_at("all", F.greatest("at", F.lit(1)))).alias("prior"), F.try_element_at("all", F.col("at") + 2).alias("next"))
    edge = lambda side, key, kind: near.join(ends.select(F.col("part").alias(side), F.col(key).alias("key")), side).select("part", F.lit(kind).alias("kind"), "key", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("least", "long"), ("ends", "string"))])
    rows = ranged.select("part", F.lit(0).alias("kind"), "key", "n", "least", "ends").unionByName(edge("prior", "high", -1)).unionByName(edge("next", "low", 1))
    nodes = durable(rows.groupBy("part").applyInPandas(_part_rows, NODE))
    none = F.sha2(F.lit(""), 256)
    seam = nodes.where("node_key is not null").groupBy("node_key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "sum_all", "sum_own")], F.max("ends").alias("ends"))
    all_ = nodes.where("node_key is null").drop("node_key").unionByName(seam.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("node_key"))
    # Parents that several parts share have their smallest member only now.
    parents = seam.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent"))
    inner = all_.where("parent_key is null").withColumn("parent", F.col("parent_conv_id"))
    outer = all_.where("parent_key is not null").join(parents, "parent_key")
    return inner.unionByName(outer).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("sum_all") - F.col("sum_own")).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def op12_radix_tree(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt on the first turns of every hundredth."""
    return prefix_trie(rebuilt_keys(turn_sequences(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH RECURSIVE given AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, c, bytes) AS (
    SELECT conv_id, 4294967295::BIGINT, conv_id::VARCHAR FROM given
    UNION ALL
    SELECT conv_id, list_reduce(list_prepend(xor(c, ascii(bytes)::BIGINT), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), bytes[2:]
    FROM crc WHERE bytes <> ''
), rebuilt AS (
    SELECT g.conv_id, list_concat(coalesce(b.own, [])[:h], g.own[h + 1:]) AS turns
    FROM (SELECT given.*, (xor(c, 4294967295) % 6)::INT AS h FROM given JOIN crc USING (conv_id) WHERE bytes = '') g
    LEFT JOIN given b ON b.conv_id = g.conv_id - g.conv_id % 100
), prefixes AS (
    SELECT conv_id, d AS depth, turns[:d] AS seq, d = len(turns) AS last FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM prefixes GROUP BY seq, depth
), children AS (
    SELECT seq[:depth - 1] AS seq, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT seq[:d] AS seq, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT n.seq, unnest(range(n.depth + 1)) AS d, c.seq IS NULL AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.seq[n.depth].t) END AS saved FROM nodes n LEFT JOIN children c ON c.seq = n.seq)
    GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.seq = n.seq[:n.depth - 1] LEFT JOIN children c ON c.seq = n.seq JOIN below b ON b.seq = n.seq
"""
