"""Sum-of-squares packing of token sequences into bins of a fixed capacity.

For each item of length s the rule looks at the numbers N(g) of open bins with
residual gap g and puts the item where the sum of N(g)^2 becomes smallest: into
a bin of gap g that changes N(g) to N(g)-1 and N(g-s) to N(g-s)+1, or into a new
bin that raises N(capacity-s). Only differences matter: the best gap is the one
with the smallest N(g-s) - N(g), where closed bins (gap 0) cost nothing.

Scale: items are dealt to shards by a hash, each shard is packed on its own with
state of capacity+1 counts, and bins that stay badly filled are opened and
packed again, over all shards, in rounds with ever fewer shards. Shards hold a
bounded expected number of items, whatever the input's skew.
"""

import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import durable, small_batches
from .word_tokens import worker_encoder

CAPACITY = 2048
#: Expected items in a shard.
SHARD_ITEMS = 40_000
_END = array("I", [0]).tobytes()
_joined = b"".join


def _id_bytes(ids):
    return array("I", ids).tobytes()


def sum_of_squares(lengths, capacity=CAPACITY):
    """Bin number and offset for every length, in the order given.

    Ties go to the smallest gap that can take the item, a new bin comes last.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for s in lengths:
        took = -1
        if s <= capacity:
            have = counts[s:]
            after = counts[: capacity + 1 - s]
            cost = np.where(have > 0, after - have, np.iinfo(np.int64).max)
            k = int(cost.argmin())
            # A new bin adds 2 N(capacity-s) + 1 to the sum of squares, gap g 2 cost + 2, or 2 cost + 1 when it is closed.
            if have[k] and (cost[k] <= counts[capacity - s] if k == 0 else cost[k] < counts[capacity - s]):
                took = k + s
        if took < 0:
            number, filled, made = made, 0, made + 1
        else:
            number, filled = open_bins[took].pop(), capacity - took
            counts[took] -= 1
        left = capacity - filled - s
        if left > 0:
            counts[left] += 1
            open_bins[left].append(number)
        bins.append(number)
        offsets.append(filled)
    return bins, offsets


def token_pieces(docs, tokenizer_path, id_col="doc_id", text_col="text", capacity=CAPACITY, end=_END):
    """Per piece: id, piece, start, length, ids_crc32, nth (a number that parts repeated rows)."""
    small_batches(docs.sparkSession)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(tokenizer_path, _id_bytes, _joined)
        size = 4 * capacity
        for batch in batches:
            at, piece, length, crc = [], [], [], []
            for k, ids in enumerate(encoder.batch(batch["text"].tolist())):
                ids += end
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    at.append(k)
                    piece.append(start // size)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            piece = np.array(piece, dtype=np.int32)
            yield pd.DataFrame({"id": batch["id"].take(at).to_numpy(), "piece": piece, "start": piece.astype(np.int64) * capacity, "length": np.array(length, dtype=np.int64), "ids_crc32": np.array(crc, dtype=np.int64), "nth": np.array(at, dtype=np.int32)})

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth int")


def _pack_shards(items, shards, round_no, capacity):
    """items with new sequence_id, offset and gap; every shard is packed in one call, longest first."""
    base = round_no << 58

    def run(key, group):
        group = group.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].tolist(), capacity)
        bins = np.array(bins, dtype=np.int64)
        used = np.bincount(bins, weights=group["length"].to_numpy()).astype(np.int64)
        return group.assign(sequence_id=base + (key[0] << 26) + bins, offset=np.array(offsets, dtype=np.int64), gap=capacity - used[bins]).drop(columns="shard")

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "nth", F.lit(round_no)), F.lit(shards)))
    kind = items.schema["id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth int, sequence_id long, offset long, gap long")


def pack_documents(docs, tokenizer_path, id_col="doc_id", text_col="text", capacity=CAPACITY, shard_items=SHARD_ITEMS, loose=0.01):
    """Cut token sequences into pieces of at most `capacity` and pack them by sum of squares.

    Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text gives one piece that holds the end token alone.
    Repeated rows are packed as often as they come; an empty table gives an
    empty result; further columns of docs are ignored. Equal lengths go in the
    order of id and piece. Bins with a gap above `loose` of the capacity are
    opened and packed again together with those of other shards, as long as
    that needs at most half as many shards as before.
    """
    items = durable(token_pieces(docs, tokenizer_path, id_col, text_col, capacity))
    shards, done, round_no = max(1, -(-items.count() // shard_items)), [], 0
    while True:
        packed = _pack_shards(items, shards, round_no, capacity)
        if shards == 1:
            done.append(packed)
            break
        packed = durable(packed)
        is_loose = F.col("gap") > loose * capacity
        left = packed.where(is_loose).count()
        fewer = max(1, -(-left // shard_items))
        if not left or 2 * fewer > shards:
            done.append(packed)
            break
        done.append(packed.where(~is_loose))
        items = packed.where(is_loose).drop("sequence_id", "offset", "gap")
        shards, round_no = fewer, round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_sum_of_squares_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
