"""Divergence of each source's terms from its language's, by chunk factorization.

Documents are cut into chunks at ASCII white space, which no term crosses.
Chunks are counted document by document; the counts of a chunk meet in one
place, where it is tokenized once for the whole corpus, and its terms are joined
back to the counts. What is counted travels packed: a row per lang and chunk (or
term) of a task, with its sources' counts and some of its documents as bytes.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import reread, small_batches, table

#: A term, in UTF-8: no ASCII character but letters.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A lang keeps terms of so many of its documents.
LEAST_DOCS = 3
#: p is in parts of this.
UNIT = 1_000_000_000
#: Term ranks are listed up to this.
TOP = 200
#: Bytes of text whose chunks are counted together in a task, about.
COUNT_BYTES = 32_000_000
#: Bytes of text that are split at a time, about; all chunks of a lot are held as numbers only.
SPLIT_BYTES = 2_000_000
#: Rows that are merged together in a task, about.
MERGE_ROWS = 100_000
#: Pairs of sources that are compared at a time.
COMPARE_PAIRS = 300_000

#: postings: pairs of a source's key and its count, 8 bytes each; docs: 8 bytes each.
PACKED = "lang string, name string, postings binary, docs binary"
_POSTING = np.dtype([("source", "<i8"), ("n", "<i8")])


def _bytes_column(values, ends):
    """A column of binaries: values cut before each of the ends (in items, the first is 0)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _items(column, kind):
    """The items of a column of binaries, and how many each row has."""
    column = column.combine_chunks().cast(pa.large_binary()) if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


def _codes(column):
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = found.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _begins(*keys):
    """Where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _first_of_each(group, least):
    """Which of sorted rows are among the first `least` of their group."""
    at = np.flatnonzero(_begins(group))
    return np.arange(len(group)) - np.repeat(at, np.diff(np.r_[at, len(group)])) < least


def _packed(lang, name, rows, group, postings, doc_group, docs):
    """PACKED rows: rows are the groups in order, group and doc_group say whose the sorted postings and docs are."""
    out = np.empty(len(postings[0]), _POSTING)
    out["source"], out["n"] = postings
    ends = lambda of: np.r_[np.searchsorted(of, rows), len(of)]
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.Table.from_arrays([lang, name.cast(pa.string()), _bytes_column(out, ends(group)), _bytes_column(docs.astype("<i8"), ends(doc_group))], names=names)


def _chunks(texts):
    """The row and the code of every chunk of a column of texts, and the distinct chunks.

    Texts are split SPLIT_BYTES at a time, or one by one where they are longer, as split text takes many times its room.
    """
    rows, found, at = [np.zeros(0, np.int32)], [pa.array([], pa.large_string()).dictionary_encode()], 0
    for column in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // SPLIT_BYTES
        cuts = np.flatnonzero(_begins(part)).tolist() + [len(column)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            chunks = pc.ascii_split_whitespace(column.slice(start, end - start).cast(pa.large_string()))
            flat = pc.list_flatten(chunks)
            filled = pc.not_equal(pc.binary_length(flat), 0)
            rows.append((pc.list_parent_indices(chunks).filter(filled).to_numpy() + at + start).astype(np.int32))
            found.append(flat.filter(filled).dictionary_encode())
        at += len(column)
    found = pa.chunked_array(found).unify_dictionaries()
    return np.concatenate(rows), np.concatenate([c.indices.to_numpy() for c in found.chunks]), found.chunk(0).dictionary


def _count(part, least):
    """The chunks of some documents (doc, lang, source: a key, text) as tables of PACKED rows.

    `least` documents of a lang and chunk are named: more say no more about
    whether a term is in that many.
    """
    row, code, words = _chunks(part.column("text"))
    lang, langs = _codes(part.column("lang"))
    source, sources = np.unique(part.column("source").to_numpy(), return_inverse=True)[::-1]
    n_words, n_sources, n_rows = max(len(words), 1), max(len(sources), 1), max(len(part), 1)
    if len(langs) * n_words * n_sources * n_rows >= 2**63:
        # The numbers below would not fit a long; those of a single document always do.
        yield from _count(part.slice(0, n_rows // 2), least)
        yield from _count(part.slice(n_rows // 2), least)
        return
    # One number for lang, chunk, source and document, in this order; made and sorted in place, as these are the largest arrays here.
    key = lang[row]
    for size, value in ((n_words, code), (n_sources, source[row]), (n_rows, row)):
        key *= size
        key += value
    del row, code, value
    key.sort()
    start = np.flatnonzero(_begins(key))
    n = np.diff(np.r_[start, len(key)])
    key, doc = np.divmod(key[start], n_rows)
    start = np.flatnonzero(_begins(key))
    n = np.add.reduceat(n, start) if len(start) else n
    group, at_source = np.divmod(key, n_sources)
    del key
    named = np.flatnonzero(_first_of_each(group, least))
    rows = group[np.flatnonzero(_begins(group))]
    at_lang, at_word = np.divmod(rows, n_words)
    docs = part.column("doc").to_numpy()[doc[named]]
    yield _packed(langs.take(pa.array(at_lang)), words.take(pa.array(at_word)), rows, group[start], (sources[at_source[start]], n), group[named], docs)


def _merge(lang, langs, name, names, rows, least):
    """PACKED rows summed up per lang and name, in the order of their codes; rows: postings, their numbers, docs, their numbers."""
    postings, n_postings, docs, n_docs = rows
    key = lang * max(len(names), 1) + name
    group = np.repeat(key, n_postings)
    order = np.lexsort((postings["source"], group))
    group, postings = group[order], postings[order]
    start = np.flatnonzero(_begins(group, postings["source"]))
    summed = np.add.reduceat(postings["n"], start) if len(start) else np.zeros(0, np.int64)
    doc_group = np.repeat(key, n_docs)
    order = np.lexsort((docs, doc_group))
    doc_group, docs = doc_group[order], docs[order]
    keep = _begins(doc_group, docs)
    doc_group, docs = doc_group[keep], docs[keep]
    first = _first_of_each(doc_group, least)
    rows = np.unique(key)
    at_lang, at_name = np.divmod(rows, max(len(names), 1))
    return _packed(langs.take(pa.array(at_lang)), names.take(pa.array(at_name)), rows, group[start], (postings["source"][start], summed), doc_group[first], docs[first])


def _ranges(starts, sizes):
    """The indices of all ranges one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _tokenized(part, least):
    """PACKED rows of chunks as PACKED rows of their terms; each chunk is tokenized once."""
    lang, langs = _codes(part.column("lang"))
    chunk, chunks = _codes(part.column("name"))
    found = [TERM.findall(c.lower()) for c in chunks.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    term, terms = _codes(pa.array([t for f in found for t in f], pa.binary()))
    # The terms are joined back: a row for each term of each row's chunk.
    row = np.repeat(np.arange(len(chunk)), sizes[chunk])
    name = term[_ranges((np.cumsum(sizes) - sizes)[chunk], sizes[chunk])]
    taken = []
    for column, kind in (("postings", _POSTING), ("docs", np.dtype("<i8"))):
        items, n = _items(part.column(column), kind)
        taken += [items[_ranges((np.cumsum(n) - n)[row], n[row])], n[row]]
    return _merge(lang[row], langs, name, terms, taken, least)


def _lots(batches, full):
    """Batches as tables, each of batches until these are full."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += full(batch)
        if size >= 1:
            part, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
            yield part
            del part
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed_chunks(docs, least=LEAST_DOCS):
    """PACKED rows of the chunks of documents: doc (tells rows apart), lang, source (a key), text, not null."""

    def run(batches):
        for part in _lots(batches, lambda b: b.nbytes / COUNT_BYTES):
            for found in _count(part, least):
                yield from found.to_batches(20_000)

    return docs.select("doc", "lang", "source", "text").mapInArrow(run, PACKED)


def packed_terms(chunks, least=LEAST_DOCS):
    """PACKED rows of terms; a term's rows are not all summed up yet."""

    def run(batches):
        kept = None
        for part in _lots(batches, lambda b: b.num_rows / MERGE_ROWS):
            part = pa.concat_tables([kept, part]).combine_chunks() if kept is not None else part
            # The last chunk may go on in the next lot.
            last = pc.index(part.column("name"), part.column("name")[-1]).as_py()
            kept = part.slice(last) if 0 < last else None
            yield from _tokenized(part.slice(0, last) if last else part, least).to_batches(20_000)
        if kept is not None:
            yield from _tokenized(kept, least).to_batches(20_000)

    return chunks.repartition("name").sortWithinPartitions("name").mapInArrow(run, PACKED)


KEPT = "lang string, term string, n long, sources array<struct<source:long,n:long>>"


def _kept_rows(part, least):
    items, sizes = _items(part.column("postings"), _POSTING)
    keep = _items(part.column("docs"), np.dtype("<i8"))[1] >= least
    ends = np.r_[0, np.cumsum(sizes)]
    whole = np.add.reduceat(items["n"], ends[:-1]) if len(sizes) else np.zeros(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(items["source"])), pa.array(np.ascontiguousarray(items["n"]))], names=["source", "n"])
    made = pa.Table.from_arrays([part.column("lang"), part.column("name"), pa.array(whole), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)], names=["lang", "term", "n", "sources"])
    return made.filter(pa.array(keep))


def kept_terms(docs, least=LEAST_DOCS):
    """lang, term, n, sources (array of struct<source, n>) of the terms in at least `least` documents of their lang."""

    def run(batches):
        kept = None
        for part in _lots(batches, lambda b: b.num_rows / MERGE_ROWS):
            part = pa.concat_tables([kept, part]).combine_chunks() if kept is not None else part
            (lang, langs), (name, names) = _codes(part.column("lang")), _codes(part.column("name"))
            # Codes are given in order of appearance, so the last row is the one that may go on.
            merged = _merge(lang, langs, name, names, [*_items(part.column("postings"), _POSTING), *_items(part.column("docs"), np.dtype("<i8"))], least)
            last = pc.and_(pc.equal(merged.column("lang"), part.column("lang")[-1]), pc.equal(merged.column("name"), part.column("name")[-1]))
            kept = merged.filter(last)
            yield from _kept_rows(merged.filter(pc.invert(last)), least).to_batches(20_000)
        if kept is not None:
            yield from _kept_rows(kept, least).to_batches()

    terms = packed_terms(packed_chunks(docs, least), least)
    return terms.repartition("lang", "name").sortWithinPartitions("lang", "name").mapInArrow(run, KEPT)


def source_keys(rows):
    """rows with `key`, a number for the source: a hash with the first seed that gives no two sources the same."""
    names = rows.select("source").distinct()
    seed = 0
    while True:
        key = F.xxhash64(F.lit(seed), "source")
        one = names.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
        if one.n == one.keys:
            return rows.withColumn("key", key)
        seed += 1


def share(count, total):
    """p of a count among `total` (occurrences and kept terms), exactly."""
    wide = lambda x: x.cast("decimal(28,0)")
    small = F.call_function("div", (count + 1) * F.lit(UNIT), total)
    # Longs hold the product up to 9e18.
    return (1 + F.when(count < 9_000_000_000, small).otherwise(F.call_function("div", wide(count + 1) * F.lit(UNIT), wide(total)).cast("long"))).cast("long")


def divergence(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


SHARED = "lang string, a long, b long, terms long, excess decimal(38,0)"


def _shared_terms(batches):
    """Per lang and ordered pair of sources: the terms that both have, and how far the divergence summed over these is from what the sums over single sources hold.

    Rows: lang, sources (array of struct<source, p, none>).
    """
    found = {}

    def add(lang, names, entries, sizes):
        source, p, none = entries
        start, width = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        # Every entry beside each of its term's entries.
        left, right = np.repeat(np.arange(len(source)), width), _ranges(start, width)
        left, right = left[left != right], right[left != right]
        if not len(left):
            return
        f = lambda x, y: (x - y) * (x - y) // y
        excess = f(p[left], p[right]) - f(p[left], none[right]) - f(none[left], p[right])
        pair = source[left] * len(names) + source[right]
        order = np.argsort(pair, kind="stable")
        pair, excess = pair[order], excess[order]
        at = np.flatnonzero(_begins(pair))
        terms = np.diff(np.r_[at, len(pair)])
        # Summed in two halves, so that no sum overflows.
        for k, n, low, high in zip(pair[at].tolist(), terms.tolist(), np.add.reduceat(excess & 0xFFFFFFFF, at).tolist(), np.add.reduceat(excess >> 32, at).tolist(), strict=True):
            key = (lang, int(names[k // len(names)]), int(names[k % len(names)]))
            was = found.get(key, (0, 0))
            found[key] = (was[0] + n, was[1] + low + (high << 32))

    for part in _lots(batches, lambda b: b.num_rows / MERGE_ROWS):
        code, langs = _codes(part.column("lang"))
        lists = part.column("sources").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size, entries = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
        names, source = np.unique(entries.field("source").to_numpy(), return_inverse=True)
        p, none = entries.field("p").to_numpy(), entries.field("none").to_numpy()
        start = np.cumsum(size) - size
        for k, lang in enumerate(langs.to_pylist()):
            rows = np.flatnonzero(code == k)
            # As many terms at a time as make COMPARE_PAIRS pairs, or one term.
            cut = np.cumsum(size[rows] ** 2) // COMPARE_PAIRS
            for some in np.split(rows, np.flatnonzero(np.diff(cut)) + 1):
                at = _ranges(start[some], size[some])
                add(lang, names, (source[at], p[at], none[at]), size[some])
        if len(found) > 200_000:
            yield _pairs_batch(found)
            found = {}
    yield _pairs_batch(found)


def _pairs_batch(found):
    from decimal import Decimal

    rows = [(*k, n, Decimal(x)) for k, (n, x) in found.items()]
    kinds = [("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("terms", pa.int64()), ("excess", pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def audit_sources(docs, least=LEAST_DOCS, top=TOP):
    """How each source's term shares differ from those of its language's other sources, and in which terms it stands out.

    docs: lang, source, text; further columns, of whatever names, are not read.
    Null is ''. Every row is a document of its own, repeated ones too. An empty
    table gives no rows; a lang whose terms are all rare has pairs of value 0.

    Returns lang, source, part, item, value, rank. Part `pair`: every other
    source of the lang, by f(p, q) summed over all kept terms. Part `term`: the
    `top` kept terms of the source with p above the lang's q, by f(p, q). Equal
    values go by item.
    """
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    small_batches(docs.sparkSession, 1_000)
    rows = source_keys(docs.select(blank("lang"), blank("source"), blank("text"), F.monotonically_increasing_id().alias("doc")))
    kept = reread(kept_terms(rows.select("doc", "lang", F.col("key").alias("source"), "text"), least))
    flat = kept.select("lang", "term", F.col("n").alias("whole"), F.explode("sources").alias("s")).select("lang", "term", "whole", F.col("s.source").alias("key"), "s.n")
    in_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    in_source = flat.groupBy("lang", "key").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    groups = rows.select("lang", "source", "key").distinct().join(in_source, ["lang", "key"], "left").join(in_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.select("lang", "source", "key", zero("terms"), zero("n"), zero("v"), zero("lang_n"))
    # What a source gives a term that it hasn't; 1 where there are no terms at all.
    none = F.when(F.col("v") > 0, share(F.lit(0), F.col("n") + F.col("v"))).otherwise(F.lit(1))
    groups = reread(groups.select("*", none.alias("none"), (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total")))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_values(flat, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))
    own = flat.join(groups.select("lang", "key", "source", "total", "lang_total"), ["lang", "key"])
    own = own.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("whole"), F.col("lang_total")).alias("q")).where("p > q")
    own = own.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return pairs.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _pair_values(flat, groups):
    """lang, source, item (each other source of the lang), value.

    Most terms are missing in most sources, where p is the source's `none`. The
    sum over all kept terms is put together from sums over the terms of either
    source against the other's `none`, corrected for the terms of both, and
    the divergence of both `none`s for each term of neither.
    """
    # Per source, how many terms have each count: far fewer rows than terms.
    counts = flat.groupBy("lang", "key", "n").agg(F.count("*").alias("k")).join(groups.select("lang", "key", "total"), ["lang", "key"])
    counts = counts.select("lang", "key", share(F.col("n"), F.col("total")).alias("p"), "k")
    f = lambda p, q: divergence(p, q).cast("decimal(28,0)")
    against = counts.join(groups.select("lang", F.col("key").alias("other"), "none"), "lang").where("key <> other")
    sums = against.groupBy("lang", "key", "other").agg(F.sum(F.col("k") * f(F.col("p"), F.col("none"))).alias("ours"), F.sum(F.col("k") * f(F.col("none"), F.col("p"))).alias("theirs"))
    with_p = flat.join(groups.select("lang", "key", "total", "none"), ["lang", "key"])
    listed = with_p.groupBy("lang", "term").agg(F.collect_list(F.struct(F.col("key").alias("source"), share(F.col("n"), F.col("total")).alias("p"), "none")).alias("sources"))
    both = listed.where(F.size("sources") > 1).select("lang", "sources").mapInArrow(_shared_terms, SHARED)
    both = both.groupBy("lang", F.col("a").alias("key"), F.col("b").alias("other")).agg(F.sum("terms").alias("both"), F.sum("excess").alias("excess"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("key").alias("other"), F.col("terms").alias("other_terms"), F.col("none").alias("other_none")), "lang").where("key <> other")
    swapped = sums.select("lang", F.col("other").alias("key"), F.col("key").alias("other"), "theirs")
    found = pairs
    for part in (sums.drop("theirs"), swapped, both):
        found = found.join(part, ["lang", "key", "other"], "left")
    given = lambda c: F.coalesce(c, F.lit(0))
    neither = F.col("v") - F.col("terms") - F.col("other_terms") + given("both")
    whole = given("ours") + given("theirs") + given("excess") + neither * f(F.col("none"), F.col("other_none"))
    return found.select("lang", "source", "item", whole.cast("long").alias("value"))


def op13_chunk_factorization(spark, sf_dir):
    """The audit of all documents."""
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs
    FROM (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
    GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM found GROUP BY ALL HAVING sum(docs) >= 3
), groups AS (
    SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v, coalesce(lang_n, 0)::HUGEINT AS lang_n
    FROM (SELECT DISTINCT lang, source FROM docs)
    LEFT JOIN (SELECT lang, source, sum(f.n) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL) USING (lang, source)
    LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS lang_n FROM kept GROUP BY lang) USING (lang)
), shares AS (
    SELECT g.lang, g.source, k.term, f.n IS NOT NULL AS has,
        1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 1) // (g.n + g.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (g.lang_n + g.v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE has AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 200
"""
