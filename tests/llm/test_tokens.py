import math
import zlib
from array import array
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricelode.llm import word_tokens
from pricelode.llm.packing import pack_documents, sum_of_squares, token_pieces
from pricelode.llm.token_counts import count_tokens
from pricelode.llm.word_tokens import WordEncoder

from .conftest import rows

_kept = {}


def encoder(path):
    if not _kept:
        _kept["e"] = WordEncoder(path, lambda ids: array("I", ids).tobytes(), b"".join)
        _kept["t"] = Tokenizer.from_file(path)
    return _kept["e"], _kept["t"]


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(), st.text(alphabet="abAB'stéÉΣİ \t\x0b\x1c\x85\xa0<|endoftext|>½1.,!́")))
def test_encodes_as_the_library(text):
    import public_tokenizers

    ours, library = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert ours.batch([text])[0] == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def test_counts_all_rows(docs, no_docs, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path)
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    got = count_tokens(docs, tokenizer_path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(no_docs, tokenizer_path).count() == 0


def cost(counts):
    return sum(n * n for n in counts.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_rule(lengths):
    bins, offsets = sum_of_squares(lengths, 20)
    gaps, counts = {}, defaultdict(int)
    for s, b, o in zip(lengths, bins, offsets, strict=True):
        def after(gap, s=s):
            new = defaultdict(int, counts)
            if gap != 20:
                new[gap] -= 1
            if gap - s:
                new[gap - s] += 1
            return cost(new)

        took = gaps.get(b, 20)
        assert o == 20 - took and took >= s
        best = min(after(g) for g in {20, *(g for g, n in counts.items() if n and g >= s)})
        assert after(took) == best
        if took != 20:
            counts[took] -= 1
        gaps[b] = took - s
        if took - s:
            counts[took - s] += 1


def test_packs_everything_once(spark, docs, no_docs, tokenizer_path):
    library = Tokenizer.from_file(tokenizer_path)
    want = []
    for r in rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((-1 if r[0] is None else r[0], k // 2048, k, len(part), zlib.crc32(array("I", part).tobytes())))
    for size in (40_000, 20):  # one shard, and several with repacking
        got = pack_documents(docs, tokenizer_path, shard_items=size).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        by_bin = defaultdict(list)
        for r in got:
            by_bin[r.sequence_id].append((r.offset, r.length))
        for parts in by_bin.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by_bin) <= math.ceil(sum(w[3] for w in want) / 2048) + 2
    assert pack_documents(no_docs, tokenizer_path).count() == 0


def test_tasks_of_a_worker_share_proofs(spark, docs, tokenizer_path, monkeypatch):
    """Two tasks that run in one process prove the vocabulary once, and give the same."""
    seen, prove = [], word_tokens.prove_whole_tokens
    frame, kept = type(docs), {}
    monkeypatch.setattr(word_tokens, "prove_whole_tokens", lambda tokenizer: seen.append(1) or prove(tokenizer))
    with monkeypatch.context() as m:
        m.setattr(frame, "mapInPandas", lambda self, run, schema: kept.setdefault("run", run))
        token_pieces(docs, tokenizer_path)
    batch = docs.selectExpr("doc_id AS id", "text").where("id IS NOT NULL").toPandas()
    first, second = (list(kept["run"](iter([batch.copy()])))[0] for _ in range(2))
    assert first.equals(second) and len(first) >= len(batch)
    assert len(seen) <= 1
