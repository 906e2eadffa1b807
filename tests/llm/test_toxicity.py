import random

from pyspark.sql import functions as F
from vecloom.llm import toxicity as tox


def slow_distance(a, b):
    """Edits between two words, a swap of neighbours being one."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_the_edit_table():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(2))
        for k in (1, 2):
            auto = tox.Levenshtein(a, k)
            state = auto.start()
            for c in b:
                state = auto.step(state, c)
            d = slow_distance(a, b)
            assert auto.distance(state) == (d if d <= k else None)
            assert auto.alive(state) == any(slow_distance(a[:i], b) <= k for i in range(len(a) + 1))


def misspelled(rng, word, n):
    word = list(word)
    for _ in range(n):
        at = rng.randrange(len(word))
        if rng.random() < 0.3 and at:
            word[at - 1], word[at] = word[at], word[at - 1]
        else:
            word[at] = rng.choice(["a", "b", "", "cd"])
    return "".join(word)


def test_trie_walk_finds_every_near_term():
    rng = random.Random(2)
    draw = lambda low, high: "".join(rng.choice("abcd") for _ in range(rng.randrange(low, high)))
    words = {draw(5, 14): rng.random() for _ in range(60)}
    near = {draw(5, 14): rng.random() for _ in range(10)}
    stems = {draw(3, 9): rng.random() for _ in range(8)}
    lexicon = tox.Lexicon(words, stems, near)
    for _ in range(1500):
        word = misspelled(rng, rng.choice(sorted([*words, *near, *(s + "zzz" for s in stems)])), rng.randrange(1, 3))
        found = [(v, t) for t, v in {**words, **near}.items() if t != word and slow_distance(word, t) <= (2 if len(t) >= tox.LONG_FROM else 1)]
        found += [(v, s + "-") for s, v in stems.items() if len(s) >= tox.FUZZY_FROM and any(slow_distance(word[:i], s) <= 1 for i in range(len(word) + 1))]
        assert lexicon.fuzzy(word) == max(found, default=None)
        if word not in words and not any(word.startswith(s) for s in stems) and len(word) >= tox.FUZZY_FROM:
            assert (lexicon.match(word) or (None,))[0] == max(found, default=(0, None))[1]


def test_passes_over_words_find_the_same():
    rng = random.Random(4)
    draw = lambda low, high: "".join(rng.choice("abcde") for _ in range(rng.randrange(low, high)))
    lexicon = tox.Lexicon({draw(3, 14): rng.random() for _ in range(30)}, {draw(3, 9): rng.random() for _ in range(6)}, {draw(5, 9): rng.random() for _ in range(9)})
    words = {draw(1, 15) for _ in range(3000)} | {misspelled(rng, w, 1) for w in [*lexicon.words, *lexicon.near, *lexicon.stems] * 5}
    assert lexicon.matches(words) == {w: hit for w in words if (hit := lexicon.match(w))}


def test_misspelled_stems_and_swaps():
    lexicon = tox.Lexicon({"idiot": 1.0, "contemptible": 1.0}, {"imbec": 1.0}, {"imbecile": 2.0})
    for word, term in (("imbecilic", "imbec-"), ("imbcile", "imbecile"), ("imebcility", "imbec-"), ("idoit", "idiot"), ("conetmptibel", "contemptible"), ("cntemptble", "contemptible")):
        assert lexicon.match(word)[0] == term
    assert lexicon.match("imbecilic")[2] is False and lexicon.match("idoit")[2] is True
    assert lexicon.match("timber") is lexicon.match("ridicule") is lexicon.match("temptation") is None


def test_terms_that_a_stem_explains_stand_for_their_misspellings():
    words, stems, near = tox._distinct_terms([("imbecile", 20, 1.0), ("imbecilic", 15, 1.0), ("imbec-", 35, 1.0), ("scum", 9, 0.9), ("scum-", 9, 0.9)])
    assert (words, stems, near) == ({"scum": 0.9}, {"imbec": 1.0}, {"imbecile": 1.0, "imbecilic": 1.0})


def test_quotation_of_any_length():
    model = tox.Model(tox.Lexicon({"moron": 2.0}, {}), 0, 1, 0, 0)
    for inside in (5, 500, 700, 20_000):
        text = f'moron and "{"x" * inside} moron end" so'
        assert [h[4] for h in model.hits(text)[0]] == [False, True]
    assert tox.quotations('a "b\nc" d « e » f „g“ h “i” > j\n> k "l\n""') == [(10, 15), (18, 21), (24, 27), (32, 38)]
    assert tox.quotations("«" * 50_000 + "\n") == []  # in one pass


def test_hits_in_windows_and_quotes():
    model = tox.Model(tox.Lexicon({"moron": 2.0, "scum": 1.0}, {"veju": 1.5}), 0, 1, 0, 0)
    hits, n = model.hits('You MORON! She wrote "you m0ron, scum". morron vejuxyz scumm')
    assert [(h[1], h[3], h[4]) for h in hits] == [("moron", False, False), ("scum", False, True), ("moron", True, False), ("veju-", False, False)]
    assert n == 11
    assert model.features(None) == model.features("") == [0.0] * tox.FEATURES


def test_long_texts_are_read_whole(monkeypatch):
    model = tox.Model(tox.Lexicon({"moron": 2.0}, {}), 0, 1, 0, 0)
    text = "word " * 500 + "moron"
    whole = model.features(text)
    monkeypatch.setattr(tox, "_LONG", 7)
    assert model.features(text) == whole and whole[0] > 0


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta lorem ipsum dolor sit amet".split()) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["stupido", "vermin", "imbecil", "vermim"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_rows_are_told_apart(spark, docs):
    rows = corpus(600, 3)
    table, labels = docs([r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = tox.fit(tox.labelled_rows(table, labels), "id")
    assert {"stupido", "imbecil"} & (set(model.lexicon.words) | set(model.lexicon.stems)) or model.lexicon.stems
    got = tox.score(table, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in got)
    assert right >= 0.97 * len(got)
    kept = tox.drop_toxic(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in tox.score(table, model).where("score < 0.5").collect()}


def test_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    table = docs([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x " * 1000)])
    model = tox.fit(tox.labelled_rows(table, labels), "id")  # one class alone
    got = tox.score(table, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert tox.score(docs([]), tox.fit(tox.labelled_rows(docs([]), labels), "id")).count() == 0
    clash = spark.createDataFrame([(1, "a", 3.0, "z")], "doc_id long, text string, score double, terms string")
    assert tox.score(clash, model).columns == ["doc_id", "score", "n_hits", "terms"]
    assert tox.drop_toxic(clash, model).columns == clash.columns


def test_no_labels_score_low(docs, spark):
    model = tox.fit(tox.labelled_rows(docs([(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int")), "id")
    assert tox.score(docs([(1, "a")]), model).first().score < 1e-6
