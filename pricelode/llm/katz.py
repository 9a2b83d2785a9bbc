"""Bigram language model with Katz backoff, learnt and evaluated in one Spark job.

Model. Words are counted in the training texts, each text ending with one end
token and beginning after one start history. Counts r up to 5 are discounted by
Good-Turing (Katz's form), larger ones by a small constant, so that every
history leaves mass. With the discounted counts r*:

    P(w | v) = r*(vw) / c(v)        if vw was seen
             = alpha(v) P(w)        if v was seen
             = P(w)                 otherwise
    P(w)     = r*(w) / N            if w was seen
             = 1 - sum of the others' P   for everything unseen, taken as one word

and alpha(v) = (1 - sum of P(w | v)) / (1 - sum of P(w)), both over the w seen
after v, so that every P(. | v) sums to one exactly.

Data flow. Tokens are not shuffled one by one. A unit is a bounded run of
documents in one task; it sends its distinct (word, history, document) triples,
sorted and packed, to count tables partitioned by the word's hash. There c(w)
and c(vw) are complete. The tables answer each unit (for every triple its two
counts), and send what each history needs for alpha to tables partitioned by the
history's hash, which answer for the unseen bigrams. A unit's answers meet again
per unit and give each document's score.

Skew. Triples are pre-aggregated per unit. Words with a large share, found in a
bounded sample, are spread over several partitions by their histories; the
sample decides only about balance, as every partition gets the exact count of
such a word. Per history only sums travel.

Words are told apart by 64-bit hashes; among a billion distinct words the chance
that any two share one is 3 %.
"""

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import functions as F

from .common import small_batches, table

#: Good-Turing is used up to this count; larger counts lose LARGE.
K = 5
LARGE = 0.5
UNIT_TOKENS = 1_000_000
PART_BYTES = 9_000_000
SAMPLE_DOCS = 2_000
HOT_WORDS = 1_000
_END, _START = b"", b" "


def _hash(word):
    return xxhash.xxh64_intdigest(word)


# ---------------------------------------------------------------- packed columns


def _pack(**columns):
    """Arrays as one compressed byte string; bytes of equal weight stand together, which compresses best."""
    head, body = [], []
    for name, values in columns.items():
        values = np.ascontiguousarray(values)
        if values.dtype.kind in "iu" and name not in ("docs",):
            most = int(values.max(initial=0))
            values = values.astype(np.min_scalar_type(most))
        head.append(f"{name}:{values.dtype.str}:{len(values)}")
        body.append(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(",".join(head).encode() + b"\n" + b"".join(body))


def _unpack(data):
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = raw.index(b"\n")
    found, place = {}, at + 1
    for item in raw[:at].decode().split(","):
        name, kind, n = item.split(":")
        kind, n = np.dtype(kind), int(n)
        size = n * kind.itemsize
        found[name] = np.frombuffer(raw, dtype=np.uint8, count=size, offset=place).reshape(kind.itemsize, n).T.copy().view(kind).reshape(-1)
        place += size
    return found


def _steps(sorted_keys):
    return np.diff(sorted_keys, prepend=np.uint64(0))


# ---------------------------------------------------------------- units


def _unit_blobs(docs, trains, words, parts, hot):
    """(partition, blob) of a unit. words: per document its list of byte strings."""
    number = defaultdict(itertools.count().__next__)
    start, end = number[_START], number[_END]
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    token = np.empty(int(lengths.sum()), dtype=np.int64)
    at = 0
    for w in words:
        token[at : at + len(w)] = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))
        token[at + len(w)] = end
        at += len(w) + 1
    history = np.roll(token, 1)
    begins = np.cumsum(lengths) - lengths
    history[begins] = start
    doc = np.repeat(np.arange(len(words)), lengths)
    hashes = np.fromiter(map(_hash, number), dtype=np.uint64, count=len(number))
    spread = np.ones(len(number), dtype=np.uint64)
    if hot:
        for k, h in enumerate(hashes.tolist()):
            if h in hot:
                spread[k] = hot[h]
    part = ((hashes[token] + hashes[history] % spread[token]) % np.uint64(parts)).astype(np.int64)

    # Words by their hashes' order, so that sorting by number sorts by hash.
    order = np.argsort(hashes)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    sorted_hashes = hashes[order]
    bits_w, bits_d = max(1, len(order).bit_length()), max(1, len(words).bit_length())
    key = (rank[token] << (bits_w + bits_d)) | (rank[history] << bits_d) | doc
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
    train = np.asarray(trains, dtype=bool)
    hot_words = np.flatnonzero(spread > 1)
    hot_counts = np.bincount(token[train[doc]], minlength=len(number))[hot_words]
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        keys, times = np.unique(key[by_part[cuts[p] : cuts[p + 1]]], return_counts=True)
        w, v, d = keys >> (bits_w + bits_d), (keys >> bits_d) & ((1 << bits_w) - 1), keys & ((1 << bits_d) - 1)
        w_first = np.flatnonzero(np.diff(w, prepend=-1))
        v_all, v_index = np.unique(v, return_inverse=True)
        # A spread word's count goes to all partitions that hold it.
        here = (np.uint64(p) + np.uint64(parts) - hashes[hot_words] % np.uint64(parts)) % np.uint64(parts) < spread[hot_words]
        hot_order = np.argsort(hashes[hot_words][here])
        extra = {"docs": np.asarray(docs, dtype=np.int64), "lengths": lengths, "train": train} if not out else {}
        out.append((p, _pack(w=_steps(sorted_hashes[w[w_first]]), w_run=np.diff(np.append(w_first, len(w))), v=_steps(sorted_hashes[v_all]), v_index=v_index, doc=d * 2 + train[d], times=times, hot=_steps(hashes[hot_words][here][hot_order]), hot_count=hot_counts[here][hot_order], **extra)))
    return out


def _units(parts, hot):
    def run(batches):
        from pyspark import TaskContext

        serial, docs, trains, words, tokens = 0, [], [], [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for doc, train, text in zip(batch["nth"].tolist(), batch["train"].tolist(), batch["text"].tolist(), strict=True):
                    docs.append(doc)
                    trains.append(train)
                    words.append((text or "").encode().lower().split())
                    tokens += len(words[-1]) + 1
            if docs and (batch is None or tokens >= UNIT_TOKENS):
                unit = (TaskContext.get().partitionId() << 32) + serial
                blobs = _unit_blobs(docs, trains, words, parts, hot)
                yield pd.DataFrame({"part": np.array([p for p, _ in blobs], dtype=np.int32), "unit": np.full(len(blobs), unit, dtype=np.int64), "blob": [b for _, b in blobs]})
                serial, docs, trains, words, tokens = serial + 1, [], [], [], 0

    return run


# ---------------------------------------------------------------- count tables


class _Table:
    """One partition of the count tables: the units' triples with c(w) and c(vw) of each."""

    def __init__(self, part, parts, blobs):
        self.part, self.parts = part, parts
        units = [_unpack(b) for b in blobs]
        w_keys = [np.cumsum(u["w"].astype(np.uint64)) for u in units]
        v_keys = [np.cumsum(u["v"].astype(np.uint64)) for u in units]
        self.words, w_of = np.unique(np.concatenate(w_keys), return_inverse=True)
        self.histories, v_of = np.unique(np.concatenate(v_keys), return_inverse=True)
        w, v, times, self.sizes = [], [], [], []
        at_w = at_v = 0
        for u, wk, vk in zip(units, w_keys, v_keys, strict=True):
            w.append(np.repeat(w_of[at_w : at_w + len(wk)], u["w_run"]))
            v.append(v_of[at_v + u["v_index"].astype(np.int64)])
            doc = u["doc"].astype(np.int64)
            u["doc"], learnt = doc >> 1, doc & 1
            times.append(u["times"] * learnt)
            self.sizes.append(len(u["doc"]))
            at_w, at_v = at_w + len(wk), at_v + len(vk)
        self.units = units
        w, v = np.concatenate(w).astype(np.int64), np.concatenate(v).astype(np.int64)
        times = np.concatenate(times).astype(np.int64)
        pair, self.pair_of = np.unique(w * len(self.histories) + v, return_inverse=True)
        self.count = np.bincount(self.pair_of, weights=times, minlength=len(pair)).astype(np.int64)
        self.pair_w, self.pair_v = np.divmod(pair, len(self.histories))
        self.word_count = np.bincount(self.pair_w, weights=self.count, minlength=len(self.words)).astype(np.int64)
        self.primary = np.ones(len(self.words), dtype=bool)
        hot = np.concatenate([np.cumsum(u["hot"].astype(np.uint64)) for u in units])
        if len(hot):
            keys, of = np.unique(hot, return_inverse=True)
            total = np.bincount(of, weights=np.concatenate([u["hot_count"] for u in units])).astype(np.int64)
            at = np.searchsorted(self.words, keys)
            there = (at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == keys)
            self.word_count[at[there]] = total[there]
            self.primary[at[there]] = False
            self.hot_home = total[(keys % np.uint64(parts)).astype(np.int64) == part]
        else:
            self.hot_home = np.zeros(0, dtype=np.int64)


def _counts_of_counts(counts):
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]


def _answers_stats(parts):
    """What a partition adds to N, V, and the numbers of words and bigrams with counts 1 to 6."""

    def run(key, rows):
        t = _Table(key[0], parts, rows["blob"])
        own = np.concatenate([t.word_count[t.primary], t.hot_home])
        words, pairs = _counts_of_counts(own), _counts_of_counts(t.count)
        big = own[own > K]
        start = t.count[t.histories[t.pair_v] == np.uint64(_hash(_START))].sum()
        return pd.DataFrame({"n": [own.sum()], "v": [(own > 0).sum()], "big": [big.sum()], "big_words": [len(big)], "texts": [start], **{f"w{r}": [words[r - 1]] for r in range(1, K + 2)}, **{f"b{r}": [pairs[r - 1]] for r in range(1, K + 2)}})

    return run


_STATS = ["n", "v", "big", "big_words", "texts", *[f"w{r}" for r in range(1, K + 2)], *[f"b{r}" for r in range(1, K + 2)]]


def _answers_units(parts):
    """To each unit: for every triple, by document, c(w) and c(vw)."""

    def run(key, rows):
        t = _Table(key[0], parts, rows["blob"])
        end_hash = np.uint64(_hash(_END))
        at, out = 0, []
        for u, n in zip(t.units, t.sizes, strict=True):
            pair = t.pair_of[at : at + n]
            at += n
            order = np.argsort(u["doc"], kind="stable")
            w = t.pair_w[pair][order]
            extra = {k: u[k] for k in ("docs", "lengths", "train") if "docs" in u}
            out.append(_pack(doc=np.diff(u["doc"][order], prepend=0), times=u["times"][order], word=t.word_count[w], pair=t.count[pair][order], is_end=t.words[w] == end_hash, **extra))
        return pd.DataFrame({"unit": rows["unit"], "kind": np.zeros(len(rows), dtype=np.int32), "blob": out})

    return run


def _answers_histories(parts):
    """To the history tables: per history sums over the words seen after it; and the unseen bigrams, which ask for alpha."""

    def run(key, rows):
        t = _Table(key[0], parts, rows["blob"])
        seen = t.count > 0
        v, r, c = t.pair_v[seen], t.count[seen], t.word_count[t.pair_w[seen]]
        sums = {f"b{k}": np.bincount(v[r == k], minlength=len(t.histories)) for k in range(1, K + 1)}
        sums |= {f"w{k}": np.bincount(v[c == k], minlength=len(t.histories)) for k in range(1, K + 1)}
        for name, x in (("b", r), ("w", c)):
            large = x > K
            sums[f"{name}n"] = np.bincount(v[large], minlength=len(t.histories))
            sums[f"{name}s"] = np.bincount(v[large], weights=x[large], minlength=len(t.histories)).astype(np.int64)
        home = (t.histories % np.uint64(parts)).astype(np.int64)
        known = np.bincount(v, minlength=len(t.histories)) > 0
        # Unseen bigrams: which unit's document asks for which history.
        at, asks = 0, []
        for number, (u, n) in enumerate(zip(t.units, t.sizes, strict=True)):
            pair = t.pair_of[at : at + n]
            at += n
            new = np.flatnonzero(~seen[pair])
            asks.append((np.full(len(new), number), t.pair_v[pair[new]], u["doc"][new], u["times"][new].astype(np.int64)))
        unit, ask_v, doc, times = (np.concatenate(x) for x in zip(*asks, strict=True))
        ids = rows["unit"].to_numpy()
        out_part, out = [], []
        for p in np.unique(np.concatenate([home[known], home[ask_v]])).tolist():
            some = np.flatnonzero(known & (home == p))
            asking = np.flatnonzero(home[ask_v] == p)
            out_part.append(p)
            out.append(_pack(v=_steps(t.histories[some]), **{k: x[some] for k, x in sums.items()}, unit=ids[unit[asking]].astype(np.uint64), ask=t.histories[ask_v[asking]], doc=doc[asking], times=times[asking]))
        return pd.DataFrame({"part": np.array(out_part, dtype=np.int32), "blob": out})

    return run


# ---------------------------------------------------------------- model


def discounted(numbers):
    """r* for r = 1..5 from the numbers n_1..n_6 of types with these counts.

    Katz's Good-Turing discount where it lies strictly between 0 and 1, else r
    less the constant that large counts lose.
    """
    out = []
    n = [float(x) for x in numbers]
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(r * d if 0 < d < 1 else r - LARGE)
    return np.array(out)


class _Model:
    def __init__(self, row):
        self.n, self.v, self.texts = int(row["n"]), int(row["v"]), int(row["texts"])
        self.word = discounted([row[f"w{r}"] for r in range(1, K + 2)])
        self.pair = discounted([row[f"b{r}"] for r in range(1, K + 2)])
        seen = sum(self.word[r - 1] * row[f"w{r}"] for r in range(1, K + 1)) + row["big"] - LARGE * row["big_words"]
        self.unseen = 1 - seen / self.n if self.n else 1.0

    @staticmethod
    def star(counts, small):
        return np.where(counts > K, counts - LARGE, np.append(0.0, small)[np.minimum(counts, K)])

    def p(self, counts):
        return np.where(counts > 0, self.star(counts, self.word) / max(1, self.n), self.unseen)


def _answer_asked(key, rows):
    """A partition of the history tables: log10 of alpha(v) c(v) for each unseen bigram whose history was seen."""
    model = _Model(rows.iloc[0])
    found = [_unpack(b) for b in rows["blob"]]
    keys, of = np.unique(np.concatenate([np.cumsum(u["v"].astype(np.uint64)) for u in found]), return_inverse=True)
    total = lambda name: np.bincount(of, weights=np.concatenate([u[name] for u in found]), minlength=len(keys))
    left = total("bs") - LARGE * total("bn")
    count, words = total("bs"), (total("ws") - LARGE * total("wn")) / max(1, model.n)
    for r in range(1, K + 1):
        types = total(f"b{r}")
        count, left = count + r * types, left + model.pair[r - 1] * types
        words = words + model.word[r - 1] / max(1, model.n) * total(f"w{r}")
    alpha = (1 - left / count) / (1 - words)
    value = np.log10(alpha) + np.log10(count)
    unit, ask, doc, times = (np.concatenate([u[k] for u in found]) for k in ("unit", "ask", "doc", "times"))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, ask.astype(np.uint64)), len(keys) - 1)
        there = keys[at] == ask
    else:
        at, there = np.zeros(len(ask), dtype=np.int64), np.zeros(len(ask), dtype=bool)
    unit, doc, add = unit[there].astype(np.int64), doc[there].astype(np.int64), value[at[there]] * times[there]
    units, out = np.unique(unit), []
    for u in units:
        docs, group = np.unique(doc[unit == u], return_inverse=True)
        out.append(_pack(doc=docs, add=np.bincount(group, weights=add[unit == u])))
    return pd.DataFrame({"unit": units, "kind": np.ones(len(units), dtype=np.int32), "blob": out})


def _score_unit(key, rows):
    """Documents of a unit with their sums over all answers."""
    model = _Model(rows.iloc[0])
    # The order of addition is fixed, so that reruns agree to the last bit.
    answers = [(k, _unpack(b)) for k, b in sorted(zip(rows["kind"], rows["blob"], strict=True))]
    meta = next(u for _, u in answers if "docs" in u)
    size = len(meta["docs"])
    known, base, score = np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size)
    scale = np.log10(model.n + 0.1 * (model.v + 1))
    for kind, u in answers:
        if kind:
            np.add.at(score, u["doc"].astype(np.int64), u["add"])
            continue
        doc, times = np.cumsum(u["doc"].astype(np.int64)), u["times"].astype(np.float64)
        word, pair = u["word"].astype(np.int64), u["pair"].astype(np.int64)
        add = lambda values: np.bincount(doc, weights=values * times, minlength=size)  # noqa: E731, B023
        known += add(word > 0).astype(np.int64)
        base += add(np.log10(word + 0.1) - scale)
        with np.errstate(divide="ignore"):
            score += add(np.where(pair > 0, np.log10(model.star(pair, model.pair)), np.log10(model.p(word))))
        # Every word but the end is the next one's history.
        score -= add(np.where((word > 0) & ~u["is_end"], np.log10(np.maximum(word, 1)), 0.0))
    score -= np.log10(max(1, model.texts))
    return pd.DataFrame({"nth": meta["docs"], "held_out": ~meta["train"], "n_tokens": meta["lengths"].astype(np.int64), "n_known": known, "train_tokens": np.full(size, model.n, dtype=np.int64), "base_score": base, "score": score})


def score_texts(docs, train, id_col="doc_id", text_col="text"):
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    id_col holds whole numbers (or null, but not the least long); train is a boolean column, null meaning false.
    Words are runs of anything but ASCII white space after lower-casing A-Z; a
    null or empty text is its end token alone. Repeated rows count as often as
    they come, an empty table gives an empty result, further columns are
    ignored. Without training texts every token has probability 1.
    """
    small_batches(docs.sparkSession)
    no_id = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("nth"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // PART_BYTES))
    step = max(1, size["n"] // SAMPLE_DOCS)

    def heads(batches):
        for batch in batches:
            found = pd.Series([w for t in batch["text"] for w in (t or "").encode().lower().split()], dtype=object).value_counts()
            yield pd.DataFrame({"word": found.index.to_numpy(), "n": found.to_numpy(dtype=np.int64)})

    hot = {}
    if parts > 1:
        sample = rows.where(F.pmod(F.xxhash64("nth"), F.lit(step)) == 0).limit(2 * SAMPLE_DOCS).select("text").mapInPandas(heads, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        total = sample.agg(F.sum("n")).first()[0] or 1
        least = total / (16 * parts)
        hot = {_hash(bytes(r["word"])): min(parts, 1 + int(16 * parts * r["n"] / total)) for r in sample.orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect() if r["n"] >= least}
        hot[_hash(_END)] = parts

    # A task for each partition of the tables: joined ones would grow up to what a task is advised to read.
    units = rows.mapInPandas(_units(parts, hot), "part int, unit long, blob binary").repartitionById(parts, "part")
    tables = units.groupBy("part")
    stats = tables.applyInPandas(_answers_stats(parts), ", ".join(f"{k} long" for k in _STATS))
    stats = stats.agg(*[F.sum(k).alias(k) for k in _STATS])
    # One row, in a copy for each value of a short key, so that it comes by an equi-join.
    stats = stats.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(15))))
    with_stats = lambda df, by: df.withColumn("key", F.pmod(F.hash(by), F.lit(16))).join(F.broadcast(stats), "key").drop("key")
    answer = "unit long, kind int, blob binary"
    asked = with_stats(tables.applyInPandas(_answers_histories(parts), "part int, blob binary"), "part").groupBy("part").applyInPandas(_answer_asked, answer)
    counted = tables.applyInPandas(_answers_units(parts), answer)
    scored = with_stats(counted.unionByName(asked), "unit").groupBy("unit").applyInPandas(_score_unit, "nth long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("nth", F.nullif("nth", no_id)).withColumnRenamed("nth", id_col)


def op8_katz_backoff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
