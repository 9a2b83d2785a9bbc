import numpy as np
import pytest
import xxhash

from pricelode.llm import simhash
from pricelode.llm.components import connected_components
from pricelode.llm.topk import best_of_group, top_k

import pandas as pd


def union(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_connected_components(spark):
    draw = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)]
    df = spark.createDataFrame([*pairs, (None, 5), (7, None), (9, 9)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == union([(a, b) for a, b in pairs if a != b])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(draw, n, dims=20):
    return draw.normal(size=(n, dims))


def brute(ids, ints, own, k):
    out = {}
    for q in own:
        scores = sorted((-int(np.dot(ints[q], ints[c])), ids[c], c) for c in range(len(ids)) if ids[c] != ids[q])[:k]
        out[ids[q]] = [(r, i, -s) for r, (s, i, _) in enumerate(scores, 1)]
    return out


def test_top_k_against_brute_force(spark):
    draw = np.random.default_rng(5)
    v = vectors(draw, 400)
    v[50:60] = v[40]  # ties
    rows = [(k, v[k].tolist(), "x") for k in range(400)]
    odd = [(None, [1.0]), (400, None), (401, [float("nan")] * 20), (402, [float("inf")] * 20), (403, [None] * 20)]
    df = spark.createDataFrame([*rows, *[(*r, "y") for r in odd]], "vec_id long, embedding array<double>, score string").repartition(4)
    ints = np.floor(1024 * v).astype(np.int64)
    want = brute(list(range(400)), ints, range(0, 400, 40), 10)
    for sizes in ({}, {"group_rows": 90, "query_rows": 3}):
        got = {}
        for r in top_k(df, df.where("vec_id % 40 = 0"), **sizes).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score string")
    assert sorted((r.query_id, r.rank) for r in top_k(few, few.where("vec_id = 0")).collect()) == [(0, 1), (0, 2)]
    assert top_k(df.where("1 = 0"), df).count() == 0 and top_k(df, df.where("1 = 0")).count() == 0


def test_huge_components_stay_exact():
    some = pd.DataFrame({"id": [1, 2, 3], "vec": [[1e9, 3.0], [1e9, 2.0], [5.0]]})
    found = best_of_group(pd.DataFrame({"id": [9], "vec": [[1e9, 1.0]]}), some, 2)
    assert [(m, s) for _, m, s in found] == [(0, 1024**2 * (10**18 + 3)), (1, 1024**2 * (10**18 + 2))] or all(s == 2**63 - 1 for _, _, s in found)


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A B c d", "a b c d e f g É x\x1cy", "to be or not to be " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(draw, n):
    base = draw.integers(0, 2**64, n // 4, dtype=np.uint64)
    out = set(base.tolist())
    while len(out) < n:
        x = int(draw.choice(list(base)))
        for b in draw.integers(0, 64, draw.integers(1, 6)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_links_all_within_radius(spark):
    values = clustered(np.random.default_rng(8), 900)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = union((a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
    df = spark.createDataFrame(pd.DataFrame({"fp": values.view(np.int64)}))
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}
    for sizes in ({}, {"leaf_rows": 40, "sample": 300}, {"leaf_rows": 40, "block_rows": 25}, {"sample": 8, "leaf_rows": 10, "block_rows": 100}):
        edges = [(at[r.u], at[r.v]) for r in simhash.link_fingerprints(df, **sizes).collect()]
        assert all(near[a, b] for a, b in edges)
        got = union(edges)
        assert {x: want[x] for x in want} == {x: got.get(x) for x in want} and set(got) <= set(want)


def test_near_duplicates(docs, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert all(len(x) == 1 for x in by_id.values())
    assert by_id[2] == by_id[1] and next(iter(by_id[1]))[1] == 1
    assert by_id[3] == by_id[4] == by_id[5] == {("0" * 16, 3)}
    assert simhash.near_duplicates(no_docs).count() == 0
