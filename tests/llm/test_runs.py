"""Runs against a loop over all periods, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from vecloom.llm import queries, runs


def brute(w, least=12):
    """Maximal stretches of smallest period p, by start, then period."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            part = w[s : i + p]
            smallest = all(any(part[x] != part[x + q] for x in range(len(part) - q)) for q in range(1, p))
            if len(part) >= max(2 * p, least) and smallest:
                out.add((s, len(part), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    words = plant(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_random_words_against_all_periods():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            k, n = rng.choice([1, 2, 2, 3, 30]), rng.randrange(60)
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for least in (1, 5, 12):
            got = runs.runs_of([np.array(w, np.int64) for w in texts], least)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(w, least) for w in texts]
            strings = [" ".join(f"w{i}" for i in w) for w in texts]
            assert [[tuple(r) for r in g.tolist()] for _, g, _ in runs._described(strings, least)] == [brute(w, least) for w in texts]


@pytest.mark.parametrize("word", ["Fibonacci", "one letter", "period 7", "halves"])
def test_long_sequences(word):
    if word == "Fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 900:
            a, b = b, b + a
        assert [tuple(r) for r in runs.runs_of([np.array(b)])[0].tolist()] == brute(b)
    else:
        w, want = {"one letter": (np.zeros(50_000, int), (0, 50_000, 1)), "period 7": (np.arange(70_000) % 7, (0, 70_000, 7)), "halves": (np.arange(60_000) % 30_000, (0, 60_000, 30_000))}[word]
        assert [tuple(r) for r in runs.runs_of([w])[0].tolist()] == [want]


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    for _ in range(40):
        letters = np.append(rng.integers(1, 4, rng.integers(1, 60)), 0)
        suffixes = sorted(range(len(letters)), key=lambda i: letters[i:].tolist())
        assert runs.suffix_ranks(letters)[suffixes].tolist() == list(range(len(letters)))


def test_nulls_ties_empty_and_clashing_columns(spark):
    beat = " ".join(["a b c"] * 6)
    rows = [(1, None, 0, "x"), (1, "", 0, "x"), (None, beat, 0, "x"), (2, beat, 0, "x"), (2, beat, 0, "x"), (3, " \t\n", 0, "x"), (4, "é b c d " * 12, 0, "x"), (5, "q " * 11, 0, "x"), (6, "z " * 300_000, 0, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = {(r.doc_id, r.n_words): r for r in runs.find_runs(table).collect()}
    assert runs.find_runs(table).count() == len(rows)
    assert got[1, 0].runs == [] and bytes(got[1, 0].collapsed) == b"" and got[3, 0].runs == []
    assert [tuple(r) for r in got[None, 18].runs] == [(0, 18, 3)] and bytes(got[2, 18].collapsed) == b"a b c"
    assert bytes(got[4, 36].collapsed).decode() == "é b c d" and got[5, 11].runs == []
    assert [tuple(r) for r in got[6, 300_000].runs] == [(0, 300_000, 1)] and bytes(got[6, 300_000].collapsed) == b"z"
    assert runs.find_runs(table.limit(0)).collect() == []


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i == 7 else "".join(rng.choice("ab") + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(70)))) for i in range(300)]
    rows += [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(200)))) for i in range(300, 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_lyndon_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(plain(*r) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
