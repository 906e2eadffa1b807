import hashlib
import math
import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from vecloom.llm import bpe, mixing, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocab) for _ in range(rng.randrange(3, 80))]
        if i % 6 == 0:
            words[1:1] = ["vermin", "imbecil", "vermin"]
        rows.append([i, " ".join(words), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [[300 + j, rows[j][1].replace(" ", "\n"), "en", "s0", 0] for j in range(30)]
    rows += [[400 + j, " ".join(rows[100 + j][1].split() * 40) + " end", "en", "s1", 0] for j in range(5)]
    rows += [[500 + j, " ".join(rows[100 + j][1].split() * 40) + " end.", "en", "s1", 0] for j in range(5)]
    rows += [[600, None, None, None, None], [601, "", "en", "s2", 0]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_equals_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    stage = dict(pipeline.STAGES)
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}

    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")), "id")
    ids = {r.doc_id for r in clean.collect()}
    assert ids == {i for i, r in before.items() if float(model.scores(model.mean * 0 + [model.features(r.text)])[0]) < 0.5}
    assert not {i for i in range(0, 260, 6)} & ids and len(ids) > 230

    once = stage["exact_dedup"](spark, clean, folder)
    assert once.columns == columns
    best = {}
    for i in ids:
        t = before[i].text or ""
        k = re.sub(r"[ \t-\r]", "", t)
        best[k] = min(best.get(k, (1, 0)), (-len(t), i))
    kept = {r.doc_id for r in once.collect()}
    assert kept == {i for _, i in best.values()}

    apart = stage["near_dedup"](spark, once, folder)
    assert apart.columns == columns
    # Links are Jaccard similarities of 0.8 or more of 5-word shingles, by a loop over all pairs.
    words = {i: (before[i].text or "").lower().split() for i in kept}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)} for i, w in words.items()}
    near = [(a, b) for a in kept for b in kept if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    reach = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if reach[a] != reach[b]:
                reach[a] = reach[b] = min(reach[a], reach[b])
                changed = True
    left = {r.doc_id for r in apart.collect()}
    assert left == {i for i in kept if reach[i] == i} and len(left) < len(kept)

    mixed = stage["mixing"](spark, apart, folder)
    assert mixed.columns == columns
    drawn = sorted(r.doc_id for r in mixed.collect())
    assert drawn == sorted(r.doc_id for r in mixing.poisson_mix(apart).collect()) and set(drawn) <= left

    encoder = bpe.load()
    got = stage["bpe"](spark, mixed, folder).collect()
    assert sorted(r.doc_id for r in got) == drawn
    for r in got:
        raw = (before[r.doc_id].text or "").encode()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest() and r.n_tokens * 4 == len(r.ids)
        assert bytes(r.ids) == encoder.encode_batch([before[r.doc_id].text])[0]


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 100


def plain_draw(rate, key):
    u, k, p = (int(hashlib.md5(f"17|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_empty_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    # Null and empty texts are equal and the one with an id stays; then two rows of mass 1 and 6 are drawn at equal shares.
    odd = [(None, None, None, None, None)] * 2 + [(1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b c", "en", None, 5)]
    want = [1] * plain_draw(7 / 2, "1") + [2] * plain_draw(7 / 12, "2")
    for name, rows, ids in (("none", [], []), ("odd", odd, want)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        got = pipeline.run(spark, path)
        assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
        assert sorted(r.doc_id for r in got.collect()) == ids


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "mixing"])
def test_stages_keep_clashing_columns(spark, folder, name):
    """Extra columns, whatever their names, pass through unchanged; rows of one id and different texts are rows of their own."""
    rows = [(5, "red green blue", "s", i, i, i, i, i, i) for i in (1, 1)] + [(5, "one two three", "s", 2, 2, 2, 2, 2, 2), (None, "x y z", "s", 3, 3, 3, 3, 3, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, id int, mark int, kept int, mix_copy int, mix_key int, `x.y` int")
    got = dict(pipeline.STAGES)[name](spark, table, folder)
    assert got.columns == table.columns
    found = {tuple(r) for r in got.collect()}
    assert found <= set(rows) and (name == "mixing" or found == set(rows))
    if name in ("exact_dedup", "near_dedup"):
        assert got.count() == 3
    if name == "mixing":
        assert {r.doc_id for r in got.collect()} <= {5, None} and got.count() > 0


def test_encoding_does_not_read_other_columns(spark, folder):
    table = spark.createDataFrame([(5, "red green", "a", 1), (5, None, "a", 2), (None, "word " * 70_000, "b", 3), (5, "red green", "a", 1)], "doc_id long, text string, ids string, `x.y` int")
    got = dict(pipeline.STAGES)["bpe"](spark, table, folder).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(bpe.load().encode_batch([t])[0]) // 4 for t in ("red green", None, "word " * 70_000, "red green"))
    assert dict(pipeline.STAGES)["bpe"](spark, table.limit(0), folder).collect() == []


def test_near_copies_of_a_hot_group(spark, folder):
    """A large group of near copies and a passage that other texts share: one of the group stays, and all others."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, passage, rows = prose(200), prose(60), []
    for i in range(120):
        words = list(base)
        words[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(words), "s"))
    rows += [(1000 + i, " ".join(prose(60) + passage + prose(60)), "s") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, folder).collect()}
    assert got == {0} | set(range(1000, 1080))
