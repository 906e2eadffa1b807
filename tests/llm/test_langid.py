import random

import numpy as np
from pyspark.sql import functions as F
from vecloom.llm import langid

WORDS = {
    "aa": "the and of that tion ing with from".split(),
    "bb": "der die und nicht keit schaft ung für".split(),
    "cc": "слово это как для ния ость".split(),
}


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 300))), lang))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], rng)
    for k in ("embed", "filters", "bias", "dense", "dense_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    truth = np.array([0, 1, 2, 0, 1])

    def loss():
        m = len(windows)
        pooled = np.maximum((net.unfolded(windows) @ net.filters).max(axis=1) + net.bias, 0)
        return -np.log(langid._softmax(pooled @ net.dense + net.dense_bias)[np.arange(m), truth]).mean()

    grads = net.step(windows, truth)
    for p, g, k in zip((net.embed, net.filters, net.bias, net.dense, net.dense_bias), grads, range(5)):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if k == 0 and at[0] == 0 or k == 1 and not net.mask()[at]:
                continue
            old, e = p[at], 1e-6
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-4


def test_held_out_accuracy_and_whole_texts(docs, spark):
    table = spark.createDataFrame(rows(500, 1), "doc_id long, text string, lang string")
    net = langid.fit(langid.learned_rows(table))
    got = langid.identify(table, net).join(table, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 and r.n_windows == -(-len(r.text.encode()) // langid.WINDOW) for r in got)
    # A short beginning in one language, all the rest in another: the rest decides.
    mixed = docs([(1, " ".join(WORDS["aa"] * 8) + " " + " ".join(WORDS["cc"] * 3000))])
    assert langid.identify(mixed, net).first().lang_pred == "cc"


def test_edge_cases(docs, spark):
    table = docs([(1, None), (2, ""), (3, "12 ... 5 \u00b2 \u2167"), (None, "the and"), (4, "the and"), (4, "the and")])
    net = langid.train(["aa", "bb"], langid.windows_of(b"abc " * 200), np.array([0, 1, 0, 1]))
    got = langid.identify(table, net).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len(got) == 6 and langid.identify(docs([]), net).count() == 0
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    assert langid.identify(none, None).first().lang_pred == "und"
    clash = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, lang_pred string, score int")
    assert langid.identify(clash, net).columns == ["doc_id", "lang_pred", "score", "n_windows"]
