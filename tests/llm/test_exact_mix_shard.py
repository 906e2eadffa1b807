import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from vecloom.llm import common, exact, langid, mixing, sharding


def random_docs(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab \t\n\x0bcé\x1c") for _ in range(rng.randrange(0, 12))) for _ in range(n // 3)]
    rows = [(i, rng.choice([*base, None]), rng.choice(["a", "b", "c", None])) for i in range(n)]
    return rows + [(n, "x" * 300_000, "a"), (n + 1, " " + "x" * 300_000, "a")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_equals_brute_force(docs):
    rows = random_docs(1, 200)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append((-len(t or ""), i))
    got = exact.exact_dedup(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        g = groups[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), r.doc_id == min(g)[1])
        assert r.text_sha256 == hashlib.sha256(norm(texts[r.doc_id]).encode()).hexdigest()
    kept = exact.drop_exact(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g)[1] for g in groups.values())


def test_texts_of_one_digest_are_told_apart(docs, monkeypatch):
    # A digest of one value for all texts: only the comparison of bytes separates them.
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.lit("ab"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(docs([(1, "a"), (2, "b b"), (3, "bb"), (4, "c")])).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_index_takes_batches_and_answers_lookups(spark, docs):
    first, second = docs([(5, "a b"), (6, "c")]), docs([(2, "ab")])
    index = exact.DigestIndex.empty(spark).flush(first, "doc_id", "text").flush(second, "doc_id", "text").compact()
    assert index.runs == 1 and [m[0] for m in index.merges] == [8, 2]
    asked = docs([(9, "a\tb"), (10, "zz")])
    assert {r.id: r.keep_id for r in index.lookup(asked, "doc_id", "text", first.unionByName(second)).collect()} == {9: 5}
    with pytest.raises(ValueError):
        exact.DigestIndex.empty(spark).compact()


def test_a_lookup_compares_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.lit("ab"))
    held = docs([(1, "a")])
    index = exact.DigestIndex.empty(spark).flush(held, "doc_id", "text")
    assert [r.id for r in index.lookup(docs([(9, "b"), (10, " a")]), "doc_id", "text", held).collect()] == [10]


def test_filters_send_few_digests_to_be_merged(spark, docs):
    """Digests of one run alone pass by, those of several are merged: whatever the filter lets through, the level is right."""
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    index = exact.DigestIndex.empty(spark).flush(docs(rows), "doc_id", "text")
    level0 = index.level.count()
    done = index.compact()
    (runs, digests, merged), groups = done.merges[0], Counter(i % 900 for i, _ in rows)
    assert (runs, digests) == (exact.MEMTABLES, level0) and 0 < merged < 0.4 * digests
    assert Counter(r.n for r in done.level.collect()) == Counter(groups.values())


def test_exact_edge_cases(docs, spark):
    assert exact.exact_dedup(docs([])).count() == 0 and exact.drop_exact(docs([])).count() == 0
    table = spark.createDataFrame([(1, "a", 1, "k"), (1, "a", 1, "k"), (2, "a", 2, "l"), (None, "b", 3, "m")], "doc_id long, text string, n int, digest string")
    kept = exact.drop_exact(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.n) for r in kept.collect()) == [(0, 3), (1, 1)]


def test_texts_of_one_id_all_stay(docs, spark):
    """Rows fall one by one, not by their id."""
    for rows, want in (
        ([(3, "same"), (7, "same"), (7, "unique other")], [(3, "same"), (7, "unique other")]),
        ([(7, "alpha"), (7, "beta"), (7, "be ta")], [(7, "alpha"), (7, "be ta")]),
        ([(None, "x"), (None, "y"), (None, "x"), (None, None), (4, "")], [(None, "x"), (None, "y"), (4, "")]),
    ):
        got = [(r.doc_id, r.text) for r in exact.drop_exact(docs(rows)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    clash = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a ", 5, 6, 7)], "doc_id long, text string, __id int, mark int, kept int")
    assert [tuple(r) for r in exact.drop_exact(clash).collect()] == [(2, "a ", 5, 6, 7)]


def test_groups_are_joined_alike_above_the_broadcast_bound(docs, monkeypatch):
    rows = random_docs(9, 120)
    want = sorted(map(str, exact.exact_dedup(docs(rows)).collect()))
    kept = sorted(r.doc_id for r in exact.drop_exact(docs(rows)).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HEAVY", 10)
    monkeypatch.setattr(exact, "BROADCAST_BLOCKS", 0)
    assert sorted(map(str, exact.exact_dedup(docs(rows)).collect())) == want
    assert sorted(r.doc_id for r in exact.drop_exact(docs(rows)).collect()) == kept


def test_samples_of_huge_tables_are_not_empty(docs, monkeypatch):
    """The rate keeps the hash's 64 bits: no count rounds it to zero."""
    table = docs([(i, f"word {i}") for i in range(3000)])
    monkeypatch.setattr(type(table), "count", lambda self: 10**11)
    some = common.hash_sample(table, ["doc_id", "text"], 4 * 10**9, 3).collect()
    assert 60 < len(some) < 190  # 3000 * 4e9 / 1e11 = 120
    none = common.hash_sample(table, ["doc_id"], 4_000, 3).collect()
    assert len(none) <= 1


def test_a_repeated_row_fills_no_sample(spark):
    table = spark.createDataFrame([(1, "x")] * 500 + [(i, "y") for i in range(2, 102)], "doc_id long, text string")
    assert common.hash_sample(table, ["doc_id", "text"], 550, 1).count() <= 101


def test_a_null_id_has_a_fold(docs):
    got = langid.learned_rows(docs([(None, "a"), (1, "b"), (2, "c")])).collect()
    assert [r.text for r in got] == [t for i, t in ((None, "a"), (1, "b"), (2, "c")) if zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 1]


def slow_poisson(rate, u):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def plain_mixture(rows, weights, budget):
    """Counter of (id, copies) by the inverse distribution, rounds of 64 at most."""
    mass = Counter()
    for _, t, s in rows:
        mass[s] += len((t or "").encode()) + 1
    w = dict.fromkeys(mass, 1.0) if weights is None else {s: weights.get(s, 0.0) for s in mass}
    want = Counter()
    for i, _, s in rows:
        rate = w[s] * budget * sum(mass.values()) / (sum(w.values()) * mass[s])
        rounds = max(1, math.ceil(rate / 64))
        for r in range(rounds if rate else 0):
            key = f"17|{i}" + (f"|{r}" if r else "")
            want[i] += slow_poisson(rate / rounds, (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    return +want


@pytest.mark.parametrize(("weights", "budget"), [(None, 1.0), ({"b": 3.0, "c": 1.0, "zz": 5.0}, 0.01), (None, 0.02)])
def test_mixture_equals_the_inverse_distribution(docs, weights, budget):
    rows = random_docs(2, 300)
    want = plain_mixture(rows, weights, budget)
    got = mixing.poisson_mix(docs(rows), weights=weights, budget=budget).collect()
    assert Counter(r.doc_id for r in got) == want
    assert len({(r.doc_id, r.mix_copy) for r in got}) == len(got)


def test_large_rates(docs, monkeypatch):
    """A rare source: its few rows are drawn in many rounds, dealt over the cluster in spans."""
    rows = [(i, "x" * 400, "much") for i in range(200)] + [(1000, "", "rare"), (1001, "", "rare")]
    want = plain_mixture(rows, None, 1.0)
    assert want[1000] > 15_000
    for span in (1024, 7):
        monkeypatch.setattr(mixing, "SPAN", span)
        assert Counter(r.doc_id for r in mixing.poisson_mix(docs(rows)).collect()) == want


def test_any_rate_has_a_short_table(spark):
    table = spark.createDataFrame([("a", 5e9), ("b", 1e15), ("c", 0.25), ("d", 64.0)], "source string, rate double")
    got = {r.source: r for r in mixing.distribution(table).collect()}
    assert {k: r.rounds for k, r in got.items()} == {"a": 78_125_000, "b": 15_625_000_000_000, "c": 1, "d": 1}
    assert all(len(r.cdf) <= 192 and abs(r.cdf[-1] - 1) < 1e-12 for r in got.values())


def test_mixture_keeps_columns_and_copies(docs, spark):
    table = spark.createDataFrame([(i, "x" * 10, f"s{i % 2}", "keep", 7, 8) for i in range(400)], "doc_id long, text string, source string, mix_copy string, k int, __mix_n int")
    mixed = mixing.poisson_mix(table, weights={"s0": 3, "s1": 1})
    assert mixed.columns == ["doc_id", "text", "source", "k", "__mix_n", "mix_copy", "mix_key"]
    out = mixed.collect()
    assert Counter(r.doc_id for r in out) == plain_mixture([(i, "x" * 10, f"s{i % 2}") for i in range(400)], {"s0": 3, "s1": 1}, 1.0)
    assert {(r.k, r["__mix_n"]) for r in out} == {(7, 8)}
    assert len({(r.doc_id, r.mix_copy) for r in out}) == len(out)
    assert mixing.poisson_mix(docs([])).count() == 0
    twins = [(None, None, None), (None, None, None)]
    assert mixing.poisson_mix(docs(twins), budget=5.0).count() == 2 * slow_poisson(5.0, (int(hashlib.md5(b"17|").hexdigest()[:13], 16) + 0.5) / 2**52)


def check_shards(rows, got, k=8):
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(k))


@pytest.mark.parametrize(("chunk", "heavy"), [(8192, 4096), (10, 4096), (10, 20), (8192, 1)])
def test_shards(docs, chunk, heavy):
    rows = random_docs(4, 300)
    got = sharding.shard(docs(rows), shards=4, chunk=chunk, heavy=heavy, rows_per_bucket=10).collect()
    check_shards(rows, got, 4)
    texts, home = {i: t for i, t, _ in rows}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(raw, r.shard) == r.shard


def test_odd_tables_in_shards(docs):
    assert sharding.shard(docs([])).count() == 0
    check_shards([(None,), (None,), (3,)], sharding.shard(docs([(None, None), (None, None), (3, "")])).collect())
    same = [(1, "t")] * 50 + [(2, "u")] * 3
    check_shards(same, sharding.shard(docs(same), rows_per_bucket=2).collect())


def test_few_groups_are_plain_differencing(docs):
    rows = [(i, "y" * (17 * i % 301) + str(i)) for i in range(400)]
    part, sums = sharding.difference([(hashlib.sha256(t.encode()).digest(), len(t) + 1) for _, t in rows], 8)
    got = sharding.shard(docs(rows), heavy=10**6).collect()  # all groups are large then
    texts = dict(rows)
    assert all(part[hashlib.sha256(texts[r.doc_id].encode()).digest()] == r.shard for r in got)
    assert max(sums) - min(sums) <= 1


def test_shards_are_even(docs):
    rng = random.Random(6)
    rows = [(i, "y" * rng.randrange(1, 3000) + str(i)) for i in range(800)]
    for chunk, heavy in ((8192, 4096), (8192, 100), (100, 100), (100, 900)):
        assert sharding.spread(sharding.shard(docs(rows), chunk=chunk, heavy=heavy))[1] < 0.0005


def test_a_large_group_is_made_up_for_by_all_chunks(docs):
    """A group of half a shard, in far more bytes than its own chunk holds."""
    rng = random.Random(16)
    rows = [(i, "z" * rng.randrange(50, 150) + str(i)) for i in range(1500)]
    rows += [(10_000 + i, "w" * 999) for i in range(10)] + [(20_000, "v" * 7000)]
    for chunk in (8192, 60):
        assert sharding.spread(sharding.shard(docs(rows), chunk=chunk, heavy=100))[0] <= 60


def test_combining_partitions_keeps_places_apart():
    rng = random.Random(8)
    partitions = [(n, [rng.randrange(0, 50) for _ in range(5)]) for n in range(40)]
    part, sums = sharding.combine(partitions, 5)
    own = [0] * 5
    for key, places in partitions:
        used = [p for p, s in zip(part[key], places) if s]
        assert len(set(used)) == len(used)  # places of one partition never share a part
        for p, s in zip(part[key], places):
            own[p] += s
    assert own == sums and max(sums) - min(sums) < 10


def test_differencing_matches_a_plain_version():
    part, sums = sharding.difference([("a", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4)], 2)
    assert sorted(sums) == [14, 16]  # the textbook case
    rng = random.Random(7)
    sizes = [(f"k{i}", rng.randrange(1, 1000)) for i in range(200)]
    part, sums = sharding.difference(sizes, 5)
    own = Counter()
    for k, v in sizes:
        own[part[k]] += v
    assert [own[i] for i in range(5)] == sums and max(sums) - min(sums) <= 5
    assert sharding.difference([], 3) == ({}, [0, 0, 0])


def test_rows_of_one_id_that_differ_in_white_space(spark):
    """One class, one id, equally many code points: one row stays."""
    from vecloom.llm import exact

    rows = [(7, "a b "), (7, "ab  "), (7, " a b"), (8, "ab"), (None, "x y"), (None, "xy ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact.exact_dedup(docs).collect()
    assert sorted(((r.keep_id, r.group_size) for r in found), key=repr) == sorted([(7, 4)] * 4 + [(None, 2)] * 2, key=repr)
    assert sum(r.kept for r in found) == 2 and {r.doc_id for r in found if r.kept} == {7, None}
    left = [tuple(r) for r in exact.drop_exact(docs).collect()]
    assert len(left) == 2 and {i for i, _ in left} == {7, None} and sorted(left, key=repr) == sorted((tuple(r) for r in exact.drop_exact(docs.repartition(3)).collect()), key=repr)


def test_samples_count_equal_rows_once(spark):
    from vecloom.llm.common import hash_sample

    rows = [(i % 10, "t", i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, label int")
    small, large = hash_sample(docs, ["id", "text"], 1000, 1).collect(), hash_sample(docs, ["id", "text"], 30, 1).collect()
    assert sorted(tuple(r) for r in small) == sorted((i, "t", min(label for j, _, label in rows if j == i)) for i in range(10))
    assert {tuple(r) for r in large} <= {tuple(r) for r in small} and 0 < len(large) < 10
    assert hash_sample(docs.select("id"), ["id"], 1000, 1).count() == 10


def test_copies_of_a_row_are_spelled_out_in_spans(spark, monkeypatch):
    from vecloom.llm import sharding

    monkeypatch.setattr(sharding, "SPAN", 5)
    rows = [(None, None)] * 23 + [(1, "a")] * 5 + [(i, f"text {i}") for i in range(2, 30)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 23
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_mixture_keeps_columns_of_its_own_names(spark):
    from vecloom.llm import mixing

    rows = [(i, "word " * (i + 1), f"s{i % 2}", -i, 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy long, `x.y` double")
    got = mixing.poisson_mix(docs, copy_col="c", key_col="k")
    assert got.columns == [*docs.columns, "c", "k"] and all(r.mix_copy == -r.doc_id and r["x.y"] == 0.5 for r in got.collect())
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.poisson_mix(docs).collect())
