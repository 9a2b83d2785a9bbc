"""Stages of the corpus pipeline against brute force."""

import itertools
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pricelode.llm import common, mixing, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts):
    """A component number per text: all pairs at 0.8 or more are linked."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if group[a] != group[b] and jaccard(sets[a], sets[b]) >= 0.8:
            group = [group[a] if g == group[b] else g for g in group]
    return group


def copies_at_every_similarity():
    """Texts of 20 to 200 words, each with copies that have words replaced, and a chain of small changes."""
    rng, texts = np.random.default_rng(3), []
    for length in (20, 40, 80, 120, 200) * 6:
        base = [f"w{k}" for k in rng.integers(0, 5_000, length)]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.choice(length, changed, replace=False):
                copy[at] = f"x{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(60)]
    for k in range(12):
        chain = chain[:-1] + [] if k % 2 else [f"d{k}"] + chain
        texts.append(" ".join(chain))
    return texts + ["a b", "a  B", "", " ", "a b c"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def test_shingle_sets_against_python():
    for text in ["", None, "a", "A b  c d e f", "x " * 50, "Straße ÜBER\tdas Meer und zurück"]:
        assert len(near_copies.shingle_set(text)) == len(shingles(text))
    a, b = "a b c d e f g h", "a b c d e f g x"
    assert near_copies.similarity(near_copies.shingle_set(a), near_copies.shingle_set(b)) == jaccard(shingles(a), shingles(b))


def test_near_copies_from_0_8_are_one_group(spark):
    texts = copies_at_every_similarity()
    got = corpus_pipeline.without_near_duplicates(spark, frame(spark, texts), "").collect()
    group = brute_components(texts)
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, k)
    assert sorted(r.doc_id for r in got) == sorted(first.values())


def test_odd_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for size in (0, 1, 50, 700):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], rng.integers(0, 2**63, size // 7, dtype=np.uint64)]))
        bits = np.bitwise_count(near_copies.odd_sketch(a) ^ near_copies.odd_sketch(b)).sum()
        assert bits <= len(np.setxor1d(a, b)) and near_copies.odd_sketch(a).shape == (8,)


def test_a_large_family_makes_few_pairs(spark, monkeypatch):
    """Members of one family with edits of many degrees: groups as by brute force, pairs far fewer than all."""
    rng, base = np.random.default_rng(6), [f"w{k}" for k in range(150)]
    texts = []
    for k in range(220):
        copy = list(base)
        for at in rng.choice(150, k % 16, replace=False):
            copy[at] = f"x{k}_{at}"
        texts.append(" ".join(copy))
    tested, linked = [], near_copies._linked

    def look(pairs, sets):
        tested.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(near_copies, "_linked", look)
    got = corpus_pipeline.without_near_duplicates(spark, frame(spark, texts), "").collect()
    first = {}
    for k, g in enumerate(brute_components(texts)):
        first.setdefault(g, k)
    assert sorted(r.doc_id for r in got) == sorted(first.values()) and len(first) > 20
    assert sum(tested) < 220 * 219 / 2 / 3


def test_trees_link_near_copies_first(spark, monkeypatch):
    """Pairs of copies whose fingerprints are in reach are tested because trees linked them, and buckets are asked only for the rest."""
    rng, texts = np.random.default_rng(9), []
    for k in range(60):
        base = [f"w{i}" for i in rng.integers(0, 50_000, 150)]
        texts.append(" ".join(base))
        base[k] = f"x{k}"
        texts.append(" ".join(base[: 149 - k % 9]))
    tested, linked = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, sets: tested.append({(r.u, r.v) for r in pairs.collect()}) or linked(pairs, sets))
    rows = frame(spark, texts).withColumn("key", F.col("doc_id").cast("string"))
    groups = {int(r.key): r.component for r in near_copies.near_copies(rows).collect()}
    marks = {int(r.key): r for r in near_copies._marks(rows).collect()}
    near, apart = set(), set()
    for k in range(0, 120, 2):
        a, b = marks[k], marks[k + 1]
        if jaccard(shingles(texts[k]), shingles(texts[k + 1])) >= 0.8:
            assert groups[k] == groups[k + 1]
            (near if ((a.fp ^ b.fp) & 2**64 - 1).bit_count() <= near_copies.REACH else apart).add((min(a.node, b.node), max(a.node, b.node)))
    assert tested[0] == near and len(near) > 30 and near.isdisjoint(set().union(*tested[1:]))
    assert len(set(groups.values())) == 120 - len(near) - len(apart)


def test_trees_visit_few_leaves_as_fingerprints_grow_in_number():
    """Rows to compare, with a leaf's rows once for each of its blocks, for five times the fingerprints."""
    values, made = np.random.default_rng(10).integers(0, 2**64, 240_000, dtype=np.uint64), []
    for some in (values[:48_000], values):
        made.append(0)
        for band in simhash.BANDS:
            told = simhash._band(some, band)
            tree = simhash.grow_tree(np.unique(told[: simhash.SAMPLE])[::-1], len(some) // simhash.LEAF_ROWS)
            sizes = np.bincount(simhash.leaves_of(tree, told, near_copies.REACH // len(simhash.BANDS))[1])
            made[-1] += int((sizes * -(-sizes // simhash.BLOCK_ROWS)).sum())
    assert made[1] < 10 * made[0] and made[1] < 15 * len(values)


def test_shuffles_that_nothing_reads_are_dropped(spark, monkeypatch):
    """Spent shuffles go when asked for, and that is asked for after each search for groups."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = held.size()
    for _ in range(50):
        spark.range(1_000, numPartitions=3).groupBy(F.col("id") % 7).count().collect()
    common.drop_unused(spark)
    for _ in range(40):
        if held.size() < before + 25:
            break
        time.sleep(0.25)
    assert held.size() < before + 25

    seen, connect = [], near_copies.connected_components
    monkeypatch.setattr(near_copies, "connected_components", lambda edges: seen.append("search") or connect(edges))
    monkeypatch.setattr(near_copies, "drop_unused", lambda spark: seen.append("drop"))
    rows = frame(spark, distinct_texts(9)).withColumn("key", F.col("doc_id").cast("string"))
    assert near_copies.near_copies(rows).count() == 9
    assert all(seen[k + 1] == "drop" for k, what in enumerate(seen) if what == "search") and seen.count("search") > 2


def test_junk_is_rejected_and_short_texts_are_kept(spark):
    rng = np.random.default_rng(8)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    junk = [word(alphabet + alphabet.upper() + "0123456789", 60) for _ in range(5)] + [word("0123456789abcdef", 40) for _ in range(5)]
    junk += [" ".join(word(alphabet, 8) for _ in range(60)) for _ in range(5)]
    junk += ["card 4111 1111 1111 1111 2223 0031 2200 3222", "x 1 2 3 4 5 6 7 8 9", "Это текст на другом языке", "これは日本語の文章です", "", None]
    prose = [r.text.split() for r in real.where("lang = 'en'").orderBy("doc_id").limit(20).collect()]
    short = [" ".join(w[:n]) for w in prose for n in (3, 6, 12) if len(w) >= n]
    planted = spark.createDataFrame([(-1 - k, t, None, "s", len(t or "")) for k, t in enumerate(junk)] + [(-1_000 - k, t, None, "s", len(t)) for k, t in enumerate(short)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.by_language(spark, real.unionByName(planted), "").select("doc_id").collect()}
    assert not [junk[k] for k in range(len(junk)) if -1 - k in kept]
    assert not [t for k, t in enumerate(short) if -1_000 - k not in kept]
    assert {r.doc_id for r in real.collect()} <= kept


def distinct_texts(n):
    rng = np.random.default_rng(4)
    return [" ".join(f"w{k}" for k in rng.integers(0, 10_000, 12)) for _ in range(n)]


def test_rows_without_or_with_repeated_ids_are_kept(spark):
    texts = distinct_texts(9)
    ids = [None, None, None, 5, 5, 5, 6, 4, None]
    # A row of id 5 is a copy of 4's text, a null row one of 6's, and a null row one of another null row.
    texts[5], texts[2], texts[8] = texts[7], texts[6], texts[1]
    got = corpus_pipeline.without_near_duplicates(spark, frame(spark, texts, ids), "").collect()
    want = [(None, texts[0]), (None, texts[1]), (5, texts[3]), (5, texts[4]), (6, texts[6]), (4, texts[7])]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_equal_and_empty_rows_leave_one(spark, docs, no_docs):
    got = corpus_pipeline.without_near_duplicates(spark, docs, "").collect()
    texts = [r.text for r in docs.collect()]
    assert len(got) == len(set(brute_components(texts)))
    assert corpus_pipeline.without_near_duplicates(spark, no_docs, "").count() == 0


def test_mixing_gives_each_row_its_own_copies(spark, docs, no_docs):
    texts = distinct_texts(60)
    rows = frame(spark, texts, [None if k % 3 == 0 else k // 10 for k in range(60)]).union(frame(spark, texts[:4], [None, 1, 1, 0]).withColumn("source", F.lit(None).cast("string")))
    for some in (rows, docs.select(*corpus_pipeline.COLUMNS)):
        got = Counter((r.source, len((r.text or "").split())) for r in corpus_pipeline.mixed(spark, some, "").collect())
        want = Counter()
        for r in mixing.mix_copies(some, id_col="doc_id", keep=("text", "source")).collect():
            want[r.source, len((r.text or "").split())] += r.copies
        assert got == +want
        targets = {r.source: (r.target, r["size"]) for r in mixing.mix_copies(some, keep=("source",)).collect()}
        if some is rows:
            assert all(abs(n * 12 - targets[source][0]) <= 12 for (source, _), n in got.items())
    assert corpus_pipeline.mixed(spark, no_docs, "").count() == 0


def test_packing_holds_every_token_once(spark, docs, no_docs, tokenizer_path):
    """Pieces against the library's ids: repeats as often as they come, sequences without gaps and not too long, and nearly full."""
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    rows = docs.select(*corpus_pipeline.COLUMNS).collect()
    want = Counter()
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            some = ids[k : k + 2048]
            want[r.doc_id, k // 2048, k, len(some), zlib.crc32(np.array(some, dtype="<u4").tobytes())] += 1
    got = corpus_pipeline.packed(spark, docs.select(*corpus_pipeline.COLUMNS), "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    whole = sum(r.length for r in got)
    assert len(places) <= -(-whole // 2048) + 1
    assert corpus_pipeline.packed(spark, no_docs.select(*corpus_pipeline.COLUMNS), "").count() == 0


def test_stages_read_what_the_one_before_wrote(spark, docs, no_docs, tmp_path, monkeypatch):
    seen = []
    look = lambda spark, rows, folder: seen.append(rows.inputFiles()) or rows.where("doc_id > 1")
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    with monkeypatch.context() as m:
        m.setattr(corpus_pipeline, "STAGES", [("one", look), ("two", look)])
        corpus_pipeline.run(spark, str(tmp_path))
    assert seen[0] and seen[1] and all(f.endswith(".parquet") and str(tmp_path) not in f for f in seen[1])


def test_the_whole_runs_on_nulls_and_nothing(spark, docs, no_docs, tmp_path):
    for name, rows in (("some", docs), ("none", no_docs)):
        rows.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
