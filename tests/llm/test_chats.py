"""Chat formatting and the prefix trie: round trips and plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelode.llm import chat_format, turn_trie

KINDS = "conv_id long, turn long, role string, text string, id long, t string, segments int"
BITS = ["### ", "</turn>", "\\", "### Assistant: ", "\n</turn>\n", "\n", "#", "<", "x", "é𝄞", "System", ": ", "###", "</turn"]


def odd_rows():
    """Texts put together from control strings, nulls in every column, ties, repeated rows, other roles."""
    draw = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(draw.randint(1, 6)):
            text = "".join(draw.choice(BITS) for _ in range(draw.randint(0, 7)))
            rows.append((conv, turn, draw.choice(("system", "user", "assistant", "assistant", "tool", "", "Assistant", "a: b\n### c", "Ünï")), text, 1, "t", 2))
    rows += [(None, None, None, None, None, None, None), (None, 1, "assistant", "no id", 1, "t", 2), (7, None, "user", "first", 1, "t", 2), (8, 0, "user", "tie b", 1, "t", 2), (8, 0, "user", "tie a", 1, "t", 2)]
    rows += [rows[0], (9, 99, "assistant", "\\" * 20_000 + "</turn>", 1, "t", 2), (9, 100, "user", "lorem ### " * 20_000, 1, "t", 2), (9, 101, "assistant", None, 1, "t", 2)]
    return rows


def in_order(rows):
    """Turns by conversation."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in by.items()}


def test_formatted_chats_are_read_back(spark):
    rows = odd_rows()
    want = in_order(rows)
    made = chat_format.format_conversations(spark.createDataFrame(rows, KINDS).repartition(5))
    got = made.select("*", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.learnt_text("segments").alias("learnt")).collect()
    assert len(got) == len(want) and all(r.exact for r in got)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.learnt == "".join(t for role, t in want[r.conv_id] if role == "assistant")


def test_only_conflicting_texts_are_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text # < \\n", 0, "", 0), (2, 0, "user", "say </turn>", 0, "", 0), (3, 0, "user", "\\\\### x", 0, "", 0), (4, 0, "user", "ends in \\", 0, "", 0)]
    got = {r.conv_id: r.formatted for r in chat_format.format_conversations(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {1: "### User: plain \\ text # < \\n\n</turn>", 2: "### User: say \\</turn>\n</turn>", 3: "### User: \\\\\\### x\n</turn>", 4: "### User: ends in \\\n</turn>"}
    assert chat_format.format_conversations(spark.createDataFrame([], KINDS)).count() == 0


def test_broken_texts_are_not_parsed(spark):
    texts = ["### User: a\n</turn>", "### Nobody: a\n</turn>", "### User: a ### b\n</turn>", "### User: a</turn>", "no grammar", ""]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", chat_format.parse(F.col("t")).alias("p")).orderBy("k").collect()
    assert [[x and tuple(x) for x in r.p] for r in got] == [[("user", "a")], [None], [None], [None], [], []]


def test_op11_runs_no_python(spark):
    plan = chat_format.op11_grammar_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def plain_trie(sequences):
    """Nodes as rows, from conv_id -> list of turns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        turns = tuple(sequences[c])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    for seq, who in members.items():
        own = (len(who) - 1) * len(seq[-1][1]) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += own
            leaves[seq[:d]] += not kids[seq]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((who[0], len(seq), members[seq[:-1]][0] if seq else -1, len(who), kids[seq], leaves[seq], saved[seq], sha(ends[seq])) for seq, who in members.items())


def rebuilt(given):
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = given.get(c - c % 100, [])[:h] + own[h:]
    return out


def as_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie_rows():
    """Shared beginnings of all lengths, copies, prefixes of others, a very long conversation, ties, nulls."""
    draw = random.Random(9)
    say = [("user", "a"), ("assistant", "bb"), ("user", ""), ("us", "era"), ("user", "long " * 50), ("system", "é𝄞")]
    rows = []
    for c in range(700):
        kind = draw.random()
        turns = [say[0], say[1]] * 2 if kind < 0.3 else [draw.choice(say) for _ in range(draw.randint(1, 9))]
        turns = turns + [("user", str(c))] if kind > 0.8 else turns
        rows += [(c + 350, k, r, t, 0, "", 0) for k, (r, t) in enumerate(turns)]
    rows += [(1500, k, "user", f"turn {k % 7}", 0, "", 0) for k in range(150)] + [(1501, k, "user", f"turn {k % 7}", 0, "", 0) for k in range(143)]
    return rows + [(None, 0, "user", "x", 0, "", 0), (2000, None, None, None, 0, "", 0), (2001, 0, "user", "a", 0, "", 0), (2001, 0, "system", "a", 0, "", 0), (2001, 0, "system", "a", 0, "", 0)]


@pytest.mark.parametrize("part_bytes", [10**9, 8_000, 1_000])
def test_trie_against_plain_python(spark, part_bytes):
    rows = trie_rows()
    keys = turn_trie.rebuilt_keys(turn_trie.turn_sequences(spark.createDataFrame(rows, KINDS).repartition(3)))
    given = in_order([r for r in rows if r[0] is not None])
    assert as_rows(turn_trie.prefix_trie(keys, part_bytes)) == plain_trie(rebuilt(given))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], KINDS)
    assert turn_trie.prefix_trie(turn_trie.turn_sequences(none).selectExpr("conv_id", "unhex('') AS key")).count() == 0


def test_trees_change_their_layouts_and_find_all_keys():
    draw = random.Random(3)
    for width, n in ((1, 256), (2, 3000), (20, 500)):
        keys = list({bytes(draw.randrange(256) for _ in range(width * draw.randint(1, 3))) for _ in range(n)})
        root = turn_trie.grow_tree((k, (1, at, "")) for at, k in enumerate(keys))
        found, stack, sizes = [], [root], set()
        while stack:
            node = stack.pop()
            kids = node.children()
            sizes.add(node.size)
            assert len(kids) <= node.size and [k.like[k.start] for k in kids] == sorted({k.like[k.start] for k in kids})
            assert all(node.find(k.like[k.start]) is k and k.start == node.end for k in kids)
            if node.value is not None:
                found.append(node.like[: node.end])
                assert keys[node.value[1]] == found[-1]
            stack += kids
        assert sorted(found) == sorted(keys)
        assert width != 2 or sizes == {4, 16, 48, 256} or 256 in sizes


def test_members_are_hashed_in_runs(spark):
    ids = [*range(-9000, 9000, 3), 2**62, -(2**62)]
    df = spark.createDataFrame([(i,) for i in ids], "conv_id long").select("conv_id", F.expr("unhex('')").alias("key")).repartition(4)
    (row,) = turn_trie.prefix_trie(df).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() and row.n_convs == len(ids) and row.conv_id == -(2**62)
