"""The trie against a plain one that makes every node, over several bounds of parts."""

import hashlib
import math
import random
import re
import zlib

import pytest
from vecloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(seqs):
    """Nodes of {conv: [(role, text), ...]}; null ids come last."""
    order = lambda c: (c is None, c or 0)
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    first = {k: min(m, key=order) for k, m in members.items()}
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = own + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in m if len(seqs[c]) == len(k)), key=order))
        out.append((first[k], len(k), first[k[:-1]] if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuild(rows):
    """The contract's sequences, from (conv_id, turn, role, text); the remainder of a negative id is negative, as in SQL."""
    own = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        out[c] = (own.get(c - int(math.fmod(c, 20)), [])[:h] if c is not None else []) + turns[h:]
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def random_rows(rng, convs, turns, texts):
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randrange(texts)))) for c in convs for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize(("turns", "texts", "paths"), [(7, 3, 10), (9, 2, 3), (4, 2, 1000), (3, 12, 5)])
def test_against_a_plain_trie(spark, turns, texts, paths):
    rng = random.Random(turns * 31 + paths)
    rows = random_rows(rng, range(300), turns, texts)
    table = spark.createDataFrame(rows, SCHEMA)
    found = queries.rebuilt(trie.sequences(table))
    assert rows_of(trie.prefix_trie(found, paths)) == plain(rebuild(rows))


def test_parts_cut_one_path(spark, monkeypatch):
    """Each part holds a path or two, long shared prefixes run over many parts."""
    monkeypatch.setattr(trie, "LEAST_TASKS", 40)
    rng = random.Random(4)
    stem = [("user", f"s{i} " * (i % 5)) for i in range(60)]
    seqs = {c: stem[: rng.randrange(61)] + [("user", rng.choice("xyz"))] * rng.randrange(4) for c in range(90)}
    rows = [(c, t, r, x) for c, s in seqs.items() for t, (r, x) in enumerate(s)]
    kept = {c: s for c, s in seqs.items() if s}
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(trie.prefix_trie(trie.sequences(table), 2)) == plain(kept)


def test_the_compressed_tree_has_points_only():
    t = [bytes([i]) * trie.TURN for i in range(9)]
    paths = sorted([t[0] + t[1] + t[2] + t[3], t[0] + t[1] + t[2] + t[4] + t[5], t[0] + t[1] + t[2]])
    tree = trie.Patricia(paths, [[1] * (len(p) // trie.TURN) for p in paths], [1, 1, 1], [5, 6, 7], 0, 0)
    assert sorted(tree.depth) == [0, 3, 4, 5]  # the root, an end that branches, two leaves


def test_nulls_ties_repeats_and_an_empty_table(spark):
    rows = [(None, 0, "user", "a b"), (3, None, None, None), (3, 0, "user", "a b"), (4, 0, "user", "a b"), (24, 0, "user", "a b"), (24, 1, "user", None), (25, 0, "user", "a b"), (25, 0, "user", "a b"), (-21, 1, "x", "long " * 90_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    own = {None: [("user", "a b")], 3: [("", ""), ("user", "a b")], 4: [("user", "a b")], 24: [("user", "a b"), ("user", "")], 25: [("user", "a b")] * 2, -21: [("x", "long " * 90_000)]}
    clash = table.selectExpr("*", "1 AS path", "2 AS words", "3 AS key", "4 AS conv")
    assert rows_of(trie.prefix_trie(trie.sequences(clash))) == plain(own)
    assert trie.prefix_trie(trie.sequences(table.limit(0))).collect() == []
    got = queries.rebuilt(trie.sequences(table))
    assert {r.conv for r in got.collect()} == set(own)
    assert [(r.depth, r.n_convs) for r in trie.prefix_trie(got.where("size(turns) = 0")).collect()] in ([], [(0, got.where("size(turns) = 0").count())])


def test_ids_of_a_hot_end_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(1000, 1500)] + [(c, 0, "user", f"other {c % 3}") for c in range(40)]
    got = rows_of(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain({c: [(r, x)] for c, _, r, x in rows})


def test_query_against_a_plain_trie(spark, tmp_path):
    rng = random.Random(11)
    rows = random_rows(rng, [*range(-45, 130), 1000, 1001], 6, 3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_patricia_conversations(spark, str(tmp_path))) == plain(rebuild(rows))
