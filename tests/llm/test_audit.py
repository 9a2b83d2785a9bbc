"""The source audit against plain Python on whole counts."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pricelode.llm import source_audit

KINDS = "doc_id long, text string, lang string, source string, key long, doc long, name string, n long"
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_audit(rows, least=3, top=200):
    found, docs, groups = Counter(), defaultdict(set), set()
    for at, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            found[lang, source, t] += 1
            docs[lang, t].add(at)
    kept = defaultdict(list)
    for (lang, t), d in docs.items():
        if len(d) >= least:
            kept[lang].append(t)
    out = []
    for lang in {g[0] for g in groups}:
        terms, sources = kept[lang], sorted(s for g, s in groups if g == lang)
        n = {s: sum(found[lang, s, t] for t in terms) for s in sources}
        share = lambda c, total, terms=terms: 1 + 10**9 * (c + 1) // (total + len(terms))
        p = {s: [share(found[lang, s, t], n[s]) for t in terms] for s in sources}
        q = [share(sum(found[lang, s, t] for s in sources), sum(n.values())) for t in terms]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            own = [(f(a, b), t) for a, b, t in zip(p[s], q, terms, strict=True) if found[lang, s, t] and a > b]
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def audit_rows():
    """Terms that differ by case and marks, chunks with several terms or none, Unicode white space, nulls, empty, long and repeated texts, sources without terms, a lang of rare terms."""
    draw = random.Random(4)
    words = ["foo", "Foo,", "(foo)", "bar-bar", "don't", "é", "É", "naïve", "x\u00a0y", "\u3000", "12", "a1b2", "ΣΑΣ", "ÀB", "𝄞", "foo_bar", "z" * 40, "\x1c", "q\x0bq", "\u2003w"]
    rows = []
    for k in range(400):
        lang, source = draw.choice(("en", "en", "de", None)), draw.choice(("s0", "s0", "s0", "s1", "s2", None))
        text = draw.choice((" ", "\n", "\t ")).join(draw.choice(words[: 4 + k % 17]) for _ in range(draw.randint(0, 12)))
        rows.append((k, text, lang, source, 1, 2, "n", 3))
    rows += [(None, None, None, None, None, None, None, None), (900, "", "en", "bare", 1, 2, "n", 3), (901, "rare words only", "xx", "r1", 1, 2, "n", 3), (902, "others", "xx", "r2", 1, 2, "n", 3), (903, None, "yy", "alone", 1, 2, "n", 3)]
    return rows + [(904, "foo bar " * 30_000, "de", "s9", 1, 2, "n", 3), rows[0], rows[0], rows[7]]


def as_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_against_plain_python(spark, monkeypatch):
    rows = audit_rows()
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    kept = [tuple(r)[:8] for r in df.collect()]
    assert as_rows(source_audit.audit_sources(df)) == plain_audit(kept)
    assert as_rows(source_audit.audit_sources(df, least=1, top=3)) == plain_audit(kept, 1, 3)


def test_lots_of_any_size_give_the_same(spark):
    """Counts and merges cut into lots of a few rows, within a chunk's and a term's rows too."""
    df = spark.createDataFrame(audit_rows(), KINDS).repartition(3)
    rows = source_audit.source_keys(df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")], F.monotonically_increasing_id().alias("doc")))
    docs = rows.select("doc", "lang", F.col("key").alias("source"), "text").cache()
    as_kept = lambda: sorted((r.lang, r.term, r.n, sorted((s.source, s.n) for s in r.sources)) for r in source_audit.kept_terms(docs).collect())
    whole = as_kept()
    was = source_audit.COUNT_BYTES, source_audit.MERGE_ROWS, source_audit.COMPARE_PAIRS
    try:
        source_audit.COUNT_BYTES, source_audit.MERGE_ROWS = 200, 3
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        cut = [r for r in docs.collect()]
        assert len(cut) == len(audit_rows())
        assert as_kept() == whole and len(whole) > 20
    finally:
        source_audit.COUNT_BYTES, source_audit.MERGE_ROWS, source_audit.COMPARE_PAIRS = was
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_shares_are_exact_beyond_longs(spark):
    rows = [(0, 1), (8_999_999_999, 10**10), (9_000_000_000, 10**10), (10**13, 10**14 + 7), (5, 5 + 6)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", source_audit.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // t for c, t in rows]


def test_audit_of_nothing(spark):
    assert source_audit.audit_sources(spark.createDataFrame([], KINDS)).count() == 0


def lot_of_texts(n, words):
    draw = np.random.default_rng(2)
    texts = [" ".join(f"{w:x}" for w in draw.integers(0, 60_000, words)) for _ in range(n)]
    return pa.table({"doc": np.arange(n), "lang": pa.array(["en", "de"] * (n // 2)), "source": np.arange(n) % 3, "text": pa.array(texts)})


def packed_rows(tables):
    table = pa.concat_tables(tables)
    return sorted(zip(*[table.column(c).to_pylist() for c in ("lang", "name", "postings", "docs")], strict=True))


def test_counting_takes_few_bytes_a_chunk(monkeypatch):
    lot = lot_of_texts(400, 2_000)
    monkeypatch.setattr(source_audit, "SPLIT_BYTES", 100_000, raising=False)
    tracemalloc.start()
    found = source_audit._count(lot, 3)
    found = [found] if isinstance(found, pa.Table) else list(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * 400 * 2_000
    small = lot_of_texts(40, 30)
    whole = packed_rows(source_audit._count(small, 3))
    for size in (1, 1_000):
        monkeypatch.setattr(source_audit, "SPLIT_BYTES", size)
        assert packed_rows(source_audit._count(small, 3)) == whole
