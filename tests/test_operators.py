import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F
from vecloom.operators import clustering, diffusion, features, graphs, losses, metrics, neighbors, retrieval, selection, subspace


def pairs(df):
    return {(r.i, r.j): r.w for r in df.collect()}


def same_clusters(got, truth):
    labels = [got[i] for i in range(len(truth))]
    return len(set(zip(labels, truth))) == len(set(truth)) == len(set(labels))


def test_blocks_equal_the_broadcast_index(table):
    rng = np.random.default_rng(0)
    a, b = table(rng.normal(size=(90, 6))), table(np.round(rng.normal(size=(70, 6)), 1), 30)
    for metric in ("ip", "l2"):
        for own in (False, True):
            want = sorted(map(tuple, neighbors.top_k(a, b, 4, metric, own).collect()))
            got = sorted(map(tuple, neighbors.top_k(a, b, 4, metric, own, block=20, broadcast_numbers=0).collect()))
            assert want == got and len(want) == 90 * 4


def test_equal_vectors_keep_their_neighbours(table):
    near = neighbors.without_self(table([[1, 0], [1, 0], [1, 0], [0, 1]]), 2)
    assert {(r.i, r.j) for r in near.collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)}
    assert [(r.i, r.n) for r in neighbors.short_rows(near, 3).collect() if r.i == 0] == [(0, 2)]
    with pytest.raises(ValueError):
        neighbors.top_k(near, near, 0)


def test_empty_sides(table):
    some, none = table([[1, 0], [0, 1]]), table([[1, 0]]).limit(0)
    assert neighbors.top_k(some, none, 2).count() == neighbors.top_k(none, some, 2).count() == 0


def test_soft_retrieval_in_blocks(table):
    rng = np.random.default_rng(1)
    a, b = table(rng.normal(size=(20, 5))), table(rng.normal(size=(40, 5)))
    want, got = ({r.id: r.x for r in retrieval.soft_retrieval(a, b, 0.1, n).collect()} for n in (10**6, 10))
    assert all(np.allclose(want[i], got[i]) for i in range(20)) and len(got) == 20


def test_matching_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 7)):
        if n <= m:
            c = rng.integers(0, 9, (n, m)).astype(float)
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            at = metrics.hungarian(c)
            assert len(set(at)) == n and c[np.arange(n), at].sum() == best


def test_metrics_do_not_depend_on_names(spark):
    rng = np.random.default_rng(4)
    label, pred = rng.integers(0, 4, 200), rng.integers(0, 5, 200)
    make = lambda p: spark.createDataFrame([(int(a), int(b)) for a, b in zip(label, p)], "label long, pred long")
    values = [{r.metric: r.value for r in metrics.evaluate(make(p)).collect()} for p in (pred, (pred * 3 + 1) % 5)]
    assert values[0] == pytest.approx(values[1])
    perfect = {r.metric: r.value for r in metrics.evaluate(make(label)).collect()}
    assert perfect == pytest.approx({"nmi": 1, "ari": 1, "acc": 1})
    with pytest.raises(ValueError):
        metrics.evaluate(make(pred), ("f1",))


def test_silhouette_of_hand_made_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.6, 0.8], 0), (2, [0.0, 1.0], 1)], "id long, x array<double>, pred int")
    # a = 0.4, b = 1 | a = 0.4, b = 0.2 | alone
    assert metrics.silhouette(rows).first().sil == pytest.approx((0.6 - 0.5 + 0) / 3)
    with pytest.raises(ValueError):
        metrics.valid_clusters(rows.withColumn("pred", F.lit(1)))


def test_pursuit_finds_planted_subspaces(table):
    from vecloom import pipelines

    rng = np.random.default_rng(9)
    truth = np.repeat(np.arange(4), 25)
    planes = [np.linalg.qr(rng.normal(size=(20, 4)))[0] for _ in range(4)]
    x = np.array([planes[c] @ rng.normal(size=4) for c in truth])
    got = {r.id: r.cluster for r in pipelines.run("ssc_omp", table(x), 4, n_nonzero=4).collect()}
    assert same_clusters(got, truth)


@pytest.mark.parametrize("method", ["kmeans", "spectral", "ensc"])
def test_methods_find_planted_clusters(table, planted, method):
    from vecloom import pipelines

    x, truth = planted
    p = {"redo": 4} if method == "kmeans" else {"n_nonzero": 4, "gamma": 5.0}
    got = {r.id: r.cluster for r in pipelines.run(method, table(x), 4, **p).collect()}
    assert same_clusters(got, truth)


def test_gradients_of_two_heads(spark):
    rng = np.random.default_rng(10)
    x, y, k = rng.normal(size=(30, 3)), rng.normal(size=(30, 4)), 3
    rows = spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    start = (rng.normal(size=(k, 3)), rng.normal(size=k), rng.normal(size=(k, 4)), rng.normal(size=k))

    def loss(h):
        p, q = losses._softmax(x @ h[0].T + h[1]), losses._softmax(y @ h[2].T + h[3])
        z = np.concatenate([p, q], axis=1)
        m = z.mean(axis=0)
        return losses.column_contrast(z.T @ z, 0.5) - np.log((p * q).sum(axis=1)).mean() + 5 * (m * np.log(m)).sum()

    heads, found = losses.fit_two_heads(rows, k, 1, rate=1.0, start=start)
    assert found[0] == pytest.approx(loss(start))
    for i in range(4):
        for at in np.ndindex(start[i].shape):
            ends = []
            for e in (1e-6, -1e-6):
                h = [np.array(p) for p in start]
                h[i][at] += e
                ends.append(loss(h))
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx((start[i] - heads[i])[at], abs=1e-6)


def test_views(table):
    rows = table([[float(i) for i in range(16)]] * 3)
    same = {r.id: r.x for r in features.random_view(rows, 4, "none").collect()}
    for preset in ("standard_train", "simclr"):
        a, b = ({r.id: r.x for r in features.random_view(rows, 4, preset).collect()} for _ in range(2))
        assert a == b and len(a[0]) == 16 and a != same
    with pytest.raises(ValueError):
        features.random_view(rows, 4, "other")


def test_gradients_of_aligned_heads(spark):
    rng = np.random.default_rng(12)
    x, y, k = 0.3 * rng.normal(size=(6, 3)), 0.3 * rng.normal(size=(6, 4)), 3
    rows = spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    start = [rng.normal(size=(k, 3)), rng.normal(size=k), rng.normal(size=(k, 4)), rng.normal(size=k)]
    soft = lambda z: np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    def loss(w, b, v, c):
        p, q = soft(x @ w.T + b), soft(y @ v.T + c)
        return -0.4 * np.log((p * q).sum(axis=1)).mean() + 0.6 * np.log1p(np.exp(-(p * q).sum(axis=0))).mean()

    heads, found = losses.fit_two_heads(rows, k, 1, 1.0, start=tuple(start), beta=0.4)
    assert found[0] == pytest.approx(loss(*start))
    for h, (before, after) in enumerate(zip(start, heads)):
        for at in np.ndindex(before.shape):
            up, down = ([s.copy() for s in start] for _ in "ab")
            up[h][at] += 1e-6
            down[h][at] -= 1e-6
            assert before[at] - after[at] == pytest.approx((loss(*up) - loss(*down)) / 2e-6, abs=1e-6)


def test_gradients_of_a_taught_head(spark):
    rng = np.random.default_rng(13)
    x, y, k = rng.normal(size=(7, 3)), rng.normal(size=(7, 3)), 3
    pairs = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in zip(x, y)], "x array<double>, y array<double>")
    start = [rng.normal(size=(k, 3)), rng.normal(size=k)]
    soft = lambda z: np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    q = soft((y @ start[0].T + start[1]) / 0.5)
    loss = lambda w, b: -np.log(((soft(x @ w.T + b) * q) ** 0.6 * k).sum(axis=1)).mean()
    # A teacher that keeps nothing is the student after its step.
    *head, found = losses.fit_taught_head(pairs, tuple(start), 1, 1.0, keep=0.0)
    assert len(found) == 2 and found[0] == pytest.approx(loss(*start))
    for h, (before, after) in enumerate(zip(start, head)):
        for at in np.ndindex(before.shape):
            up, down = ([s.copy() for s in start] for _ in "ab")
            up[h][at] += 1e-6
            down[h][at] -= 1e-6
            assert before[at] - after[at] == pytest.approx((loss(*up) - loss(*down)) / 2e-6, abs=1e-6)


def test_taught_heads_find_planted_clusters(table, planted):
    from vecloom import pipelines

    x, truth = planted
    got = {r.id: r.cluster for r in pipelines.run("temi", table(x), 4, linear=True, heads=3, neighbours=8, rounds=8).collect()}
    assert same_clusters(got, truth)


@pytest.mark.parametrize("method", ["tac", "tac_trained", "sac", "gradnorm", "seic", "magic", "sic"])
def test_language_methods_find_planted_clusters(table, planted, method):
    from vecloom import pipelines

    x, truth = planted
    nouns = table(np.roll(x, 1, axis=0)[::3])
    got = {r.id: r.cluster for r in pipelines.run(method, table(x), 4, nouns, redo=3, centre_redo=3, filter_clusters=4, linear=True).collect()}
    assert same_clusters(got, truth)
    with pytest.raises(ValueError):
        pipelines.run(method, table(x), 4)


def test_several_heads_and_the_best_of_them(table, planted):
    from vecloom import pipelines

    x, truth = planted
    heads = pipelines.scan_heads(table(x), 4, heads=3, near=8, rounds=10)
    assert len(heads) == 3 and [h[0] for h in heads] == sorted(h[0] for h in heads)
    got = pipelines.scan_predictions(table(x), 4, heads=3, near=8, rounds=10).collect()
    main = {r.id: r.cluster for r in got if r.head == "main"}
    assert {r.head for r in got} == {"main", "head_1", "head_2"} and same_clusters(main, truth)
    assert {r.id: r.cluster for r in pipelines.run("scan", table(x), 4, heads=3, neighbours=8, rounds=10).collect()} == main


def test_gradient_of_one_head(spark):
    rng = np.random.default_rng(13)
    x, y, k = rng.normal(size=(25, 3)), rng.normal(size=(25, 3)), 4
    pairs = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in zip(x, y)], "x array<double>, y array<double>")
    start = (rng.normal(size=(k, 3)), rng.normal(size=k))

    def loss(w, b):
        p, q = losses._softmax(x @ w.T + b), losses._softmax(y @ w.T + b)
        m = p.mean(axis=0)
        return -np.log((p * q).sum(axis=1)).mean() + 2 * (m * np.log(m)).sum()

    w, b, found = losses.fit_scan_head(pairs, start, 1, 1.0, 2.0)
    assert found == [pytest.approx(loss(*start)), pytest.approx(loss(w, b))]
    for at in np.ndindex(k, 3):
        e = np.zeros((k, 3))
        e[at] = 1e-6
        assert (loss(start[0] + e, start[1]) - loss(start[0] - e, start[1])) / 2e-6 == pytest.approx((start[0] - w)[at], abs=1e-6)


def test_negative_answers_push_away(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(12, 3))
    make = lambda rows, c: spark.createDataFrame([(list(map(float, v)), int(k)) for v, k in zip(rows, c)], "x array<double>, cluster int")
    yes, no = make(x[:8], np.arange(8) % 3), make(x[8:], [0, 1, 2, 0])
    start = (rng.normal(size=(3, 3)), rng.normal(size=3))
    p = losses._softmax(x @ start[0].T + start[1])
    counts = np.bincount(np.arange(8) % 3)
    want = -np.log(p[np.arange(8), np.arange(8) % 3]) @ (1 / counts[np.arange(8) % 3] / 3) - np.log(1 - p[np.arange(8, 12), [0, 1, 2, 0]]).mean()
    w, b, found = losses.fit_labelled_head(yes, start, 3, 0.1, 0.0, negatives=no)
    assert found[0] == pytest.approx(want) and found[2] < found[1] < found[0]


def test_subspace_iteration_equals_the_dense_solver(table, planted):
    x, _ = planted
    rows = table(x)
    edges = graphs.cut_lineage(graphs.rbf_affinity(rows, 0.5))
    spans = []
    for driver in (10_000, 0):
        got = clustering.spectral_embedding(rows, edges, 4, driver_nodes=driver).orderBy("id").collect()
        v = np.array([r.x for r in got])
        spans.append(v @ v.T)  # rows are unit vectors in the same plane, however it is turned
    assert np.abs(spans[0] - spans[1]).max() < 1e-3


def test_lloyd_keeps_empty_clusters(table):
    found, centres = clustering.lloyd(table([[0, 0], [0, 0], [5, 5], [6, 6]]), 2, 3)
    assert {r.id: r.cluster for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0} or len(centres) == 2
    with pytest.raises(ValueError):
        clustering.lloyd(table([[1, 0]]), 2, 1)


def test_discretised_eigenvectors(planted):
    x, truth = planted
    label = clustering.discretised(np.linalg.eigh(x @ x.T)[1][:, -4:])
    assert same_clusters(dict(enumerate(label)), truth)


def test_negative_degrees_are_refused(table):
    rows = table([[1, 0], [-1, 0.1]])
    with pytest.raises(ValueError, match="degrees"):
        clustering.spectral_clustering(rows, graphs.dot_affinity(rows), 2)
    with pytest.raises(ValueError, match="refused"):
        graphs.dot_affinity(rows, guard=1)


def test_transition_floors_degrees_at_one(spark):
    edges = spark.createDataFrame([(0, 1, 0.25), (1, 0, 0.25), (1, 2, 4.0), (2, 1, 4.0)], "i long, j long, w double")
    assert pairs(graphs.transition(edges))[(0, 1)] == pytest.approx(0.25 / np.sqrt(1 * 4.25))


def test_components_and_summary(spark):
    nodes = spark.range(8).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(0, 3, 1.0), (3, 5, 1.0), (1, 2, 1.0), (7, 7, 1.0)], "i long, j long, w double")
    assert {r.id: r.component for r in graphs.components(nodes, edges).collect()} == {0: 0, 3: 0, 5: 0, 1: 1, 2: 1, 4: 4, 6: 6, 7: 7}
    assert tuple(graphs.summary(nodes, edges).first())[:2] == (8, 3)


def test_pursuit_compares_squares_with_the_plain_length():
    x = np.array([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]])
    # After one atom the squared residual is 0.36: below 1 * 0.5, so one atom is enough.
    zero = np.array([0])
    assert len(subspace.pursue(x, zero, 2, 0.5)[0]) == 1
    assert len(subspace.pursue(x, zero, 2, 0.3)[0]) == 2


def test_pursuit_equals_a_plain_version(planted):
    """Row by row, with least squares over the atoms chosen so far."""
    x, _ = planted
    rows, atoms, weights = subspace.pursue(x, np.arange(40), 5, 0.02)
    for at in range(40):
        support, rest = [], x[at]
        for _ in range(5):
            strength = np.abs(x @ rest)
            strength[at] = -1
            support.append(int(strength.argmax()))
            c = np.linalg.lstsq(x[support].T, x[at], rcond=None)[0]
            rest = x[at] - c @ x[support]
            if rest @ rest < 0.02 * np.linalg.norm(x[at]):
                break
        assert atoms[rows == at].tolist() == support and weights[rows == at] == pytest.approx(c, abs=1e-8)


def test_active_set_reaches_the_lasso(planted):
    x, _ = planted
    others = x.copy()
    others[5] = 0
    full = subspace.lasso(others, x[5], 0.1)
    few = subspace.working_set_lasso(others, x[5], 0.1, first=2)
    value = lambda c: 0.5 * ((x[5] - c @ others) ** 2).sum() + 0.1 * np.abs(c).sum()
    assert value(few) == pytest.approx(value(full), abs=1e-8)


def test_gradient_nouns_keep_the_smallest(table, spark):
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, x array<double>")
    scores = {r.noun: r.score for r in retrieval.gradient_scores(centres, table([[1, 0], [0.8, 0.6], [0.9, 0.1]])).collect()}
    kept = [r.noun for r in retrieval.gradient_nouns(centres, table([[1, 0], [0.8, 0.6], [0.9, 0.1]]), 1).collect()]
    assert kept == [min(scores, key=scores.get)]


def test_semantic_clusters():
    assert retrieval.semantic_clusters("CIFAR-10", 50_000, 10, 300) == (167, "official_default")
    assert retrieval.semantic_clusters("other", 1000, 10, 300) == (30, "size_heuristic")
    assert retrieval.semantic_clusters("other", 750, 2, 300) == (2, "size_heuristic")  # 2.5 rounds to even
    assert retrieval.semantic_clusters("dtd", 10, 10, 300, 7) == (7, "explicit")


def test_greedy_equals_a_plain_loop(table, planted, spark):
    x, _ = planted
    value = np.random.default_rng(5).normal(size=120)
    got = [r.id for r in selection.greedy(table(x), spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "id long, value double"), 6).orderBy("step").collect()]
    want = [int(value.argmax())]
    while len(want) < 6:
        d = np.log(np.maximum(1 - x @ x[want].T, 1e-8)).min(axis=1)
        d[want] = -np.inf
        want.append(int((value + d).argmax()))
    assert got == want
    with pytest.raises(ValueError):
        selection.greedy(table(x), spark.createDataFrame([(i, 0.0) for i in range(120)], "id long, value double"), 6, most=10)


def test_attack_targets_have_other_labels(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(100 + i, 0) for i in range(40)], "id long, label int")
    label = {r.id: r.label for r in rows.collect()}
    got = selection.attack_targets(rows).collect()
    assert len(got) == 100 and all(label[r.id] != label[r.target] for r in got)
    one = selection.attack_targets(rows.where("label = 1")).collect()
    assert sorted(r.target for r in one) == sorted(r.id for r in one) and all(r.id != r.target for r in one)


def test_pseudo_labels(spark):
    rows = spark.createDataFrame([(0, 0, 0.9, -1), (1, 0, 0.8, -1), (2, 0, 0.7, 1), (3, 1, 0.1, 1), (4, 1, 0.4, -1)], "id long, pred int, confidence double, label int")
    got = {r.id: r.label for r in selection.pseudo_labels(rows, 2, 0.4, 0.5, 0.2).collect()}
    assert got == {0: 0, 1: -1, 2: 1, 3: -1, 4: -1}


def test_diffusion_step_equals_matrices(spark):
    rng = np.random.default_rng(6)
    t, a = rng.random((5, 5)), np.eye(5) + 0.1
    make = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(5)], "i long, j long, w double")
    nodes = spark.range(5)
    got = pairs(diffusion.diffusion_step(make(a), [make(t)], [0.7], nodes))
    want = 0.7 * t @ a @ t.T + 0.3 * np.eye(5)
    assert all(got[(i, j)] == pytest.approx((want + want.T)[i, j] / 2) for i in range(5) for j in range(5))
    assert diffusion.smoothness(make(a), make(t)) == pytest.approx((a * a).sum() - (a * (t @ a @ t.T)).sum())


def test_graph_weights():
    assert diffusion.graph_weights([1.0, 3.0], 10.0) == pytest.approx([0.6, 0.4])
    assert diffusion.graph_weights([0.0, 100.0], 10.0) == pytest.approx([1, 0])
    assert diffusion.graph_weights([2.0], 10.0) == pytest.approx([1])
    rng = np.random.default_rng(12)
    for _ in range(20):
        h, penalty = rng.normal(0, 5, 6), rng.uniform(0.5, 20)
        b = diffusion.graph_weights(h, penalty)
        assert b.sum() == pytest.approx(1) and b.min() >= 0
        slope = h + penalty * b
        assert (slope >= slope[b > 1e-9].max() - 1e-6).all()  # no weight gains by moving


def test_head_training_lowers_the_loss(table, planted, spark):
    x, truth = planted
    rows = table(x)
    pair = neighbors.gather(neighbors.without_self(rows, 1), rows).select(F.col("i").alias("id"), F.col("x").alias("y")).join(rows, "id")
    rng = np.random.default_rng(7)
    _, _, loss = losses.fit_scan_head(pair, (0.1 * rng.normal(size=(4, 12)), np.zeros(4)), 12, rate=2.0)
    assert loss[-1] < loss[0] and all(b <= a + 1e-6 for a, b in zip(loss, loss[1:]))


def test_coding_rates(table, planted, spark):
    x, truth = planted
    rows = table(x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "id long, cluster int"), "id")
    want = np.linalg.slogdet(np.eye(12) + 12 / (120 * 0.01) * x.T @ x)[1] / 2
    assert losses.coding_rate(rows, 12) == pytest.approx(want)
    assert losses.compressed_rate(rows, 12) < want


def test_strict_rows(table):
    with pytest.raises(Exception, match="length zero"):
        features.strictly_unit(table([[1, 0], [0, 0]])).collect()
    with pytest.raises(Exception, match="finite"):
        features.strictly_unit(table([[1, 0], [float("nan"), 0]])).collect()
    with pytest.raises(ValueError):
        features.strictly_unit(table([[1, 0]]))


def test_cache_names():
    assert features.cache_key("A b/c.d", None, " ", 0.5) == "a-b-cpd__0p5"
    name = features.cache_name("x" * 400, "npz")
    assert len(name) <= 240 and name.endswith(".npz") and "__hash" in name
    assert features.cache_name("a b", ".npz") == "a-b.npz"


def test_encoder_is_linear(table):
    got = {r.id: np.array(r.x) for r in features.encode(table([[1, 0, 2], [2, 0, 4]]), 8).collect()}
    assert np.allclose(2 * got[0], got[1])


def test_ordinals(spark):
    from vecloom.functions.ordinal import with_ordinal

    rows = spark.range(500).select(((F.col("id") * 7919) % 1009).alias("key"), F.col("id").alias("v")).repartition(7)
    got = [(r.ordinal, r.key) for r in with_ordinal(rows, "key").orderBy("ordinal").collect()]
    assert [o for o, _ in got] == list(range(500)) and [k for _, k in got] == sorted(k for _, k in got)
    assert with_ordinal(rows.limit(0), "key").count() == 0


def test_interactive_clusters(spark, planted):
    from vecloom import pipelines

    x, truth = planted
    rows = spark.createDataFrame([(i, [float(e) for e in v], int(c)) for i, (v, c) in enumerate(zip(x, truth))], "id long, x array<double>, label int")
    got = {r.id: r.cluster for r in pipelines.interactive(rows, 4, 12, 5, 2, 1, redo=3, rounds=8).collect()}
    by_name = pipelines.run("idc", rows, 4, budget=12, neighbours=5, candidates=2, updates=1, redo=3, rounds=8, random_state=1)
    assert {r.id: r.cluster for r in by_name.collect()} == got
    with pytest.raises(ValueError):
        pipelines.run("idc", rows.drop("label"), 4)
    assert same_clusters(got, truth)


def test_labelled_head_learns(spark, planted):
    x, truth = planted
    rows = spark.createDataFrame([([float(e) for e in v], int(c)) for v, c in zip(x, truth)], "x array<double>, cluster int")
    w, b, loss = losses.fit_labelled_head(rows, (np.zeros((4, 12)), np.zeros(4)), 15, 5.0)
    assert loss[-1] < 0.5 * loss[0] and ((x @ w.T + b).argmax(axis=1) == truth).all()


def optimality(x, at, alpha, ridge, atoms, c):
    """How far a code is from the conditions of the least elastic net."""
    full = np.zeros(len(x))
    full[atoms] = c
    g = x @ (x[at] - full @ x) - ridge * full
    g[at] = 0
    on = full != 0
    return max(np.abs(g[on] - alpha * np.sign(full[on])).max(initial=0), (np.abs(g[~on]) - alpha).max(initial=0))


@pytest.mark.parametrize("tau", [1.0, 0.9, 0.5])
def test_paths_end_at_the_elastic_net(tau):
    rng = np.random.default_rng(21)
    for trial in range(40):
        n, d = rng.integers(2, 50), rng.integers(2, 10)
        x = rng.normal(size=(n, d))
        if trial % 3 == 0:
            x[: n // 2] = x[n // 2 : n // 2 * 2]  # equal atoms
        if trial % 4:
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        if trial % 5 == 0:
            x[-1] = 0
        for gamma in (2, 20, 500):
            strong = np.abs(x @ x.T)
            np.fill_diagonal(strong, 0)
            alpha = strong.max(axis=1) / (tau * gamma)
            for at, (atoms, c) in enumerate(subspace.homotopy(x, np.arange(n), tau * alpha, (1 - tau) * alpha)):
                assert at not in atoms and optimality(x, at, tau * alpha[at], (1 - tau) * alpha[at], atoms, c) < 1e-8


def test_paths_equal_coordinate_descent(table):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(40, 60))  # more numbers than atoms, so that the descent converges
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lars, descent = (subspace.elastic(x.copy(), np.arange(40), 20.0, 50, True, algorithm=a) for a in ("lars", "descent"))
    dense = [np.zeros((40, 40)), np.zeros((40, 40))]
    for out, (i, j, w) in zip(dense, (lars, descent)):
        out[i, j] = w
    assert np.allclose(*dense, atol=1e-6)
    few = subspace.elastic(x, np.arange(40), 20.0, 2, True)
    assert (np.bincount(few[0]) <= 2).all()
    got = {(r.i, r.j): r.w for r in subspace.elastic_net(table(x), 20.0).collect()}
    assert got == {(i, j): pytest.approx(w) for i, j, w in zip(*lars)}
    for bad in ({"tau": 0.0}, {"tau": 0.5, "algorithm": "descent"}, {"algorithm": "none"}):
        with pytest.raises(ValueError):
            subspace.elastic_net(table(x), **bad)


@pytest.mark.parametrize("tau", [1.0, 0.7])
def test_elastic_net_of_passing_atoms_is_that_over_all(table, monkeypatch, tau):
    rng = np.random.default_rng(27)
    x = rng.normal(size=(300, 12))
    x[:40] = x[40:80] + 1e-3 * rng.normal(size=(40, 12))  # near copies
    x[80:90] = x[90]  # equal atoms
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(subspace, "MOST_NUMBERS", 1000)  # such a table was refused
    i, j, w = subspace.elastic(x, np.arange(300), 20.0, 300, True, tau=tau)
    whole = np.zeros((300, 300))
    whole[i, j] = w
    for sizes in ({"broadcast_numbers": 0}, {"block": 7}):
        got = np.zeros((300, 300))
        for r in subspace.elastic_net(table(x), 20.0, 300, tau=tau, **sizes).collect():
            got[r.i, r.j] = r.w
        assert np.allclose(got @ x, whole @ x, atol=1e-8) and np.allclose(np.abs(got).sum(axis=1), np.abs(whole).sum(axis=1), atol=1e-8)
    blocks = lambda: ((np.arange(at, min(at + 70, 300)), x[at : at + 70]) for at in range(0, 300, 70))
    few = subspace.elastic_passing(x, np.arange(300), blocks, 20.0, 300, tau=tau, first=2, more=1)
    strong = np.abs(x @ x.T)
    np.fill_diagonal(strong, 0)
    alpha = strong.max(axis=1) / (tau * 20.0)
    for at in range(300):
        assert at not in few[1][few[0] == at]
        assert optimality(x, at, tau * alpha[at], (1 - tau) * alpha[at], few[1][few[0] == at], few[2][few[0] == at]) < 1e-8


def test_rows_of_a_factor_are_taken_out():
    rng = np.random.default_rng(23)
    a = rng.normal(size=(7, 9))
    gram = a @ a.T
    for k in range(7):
        factor = np.eye(10)
        factor[:7, :7] = np.linalg.cholesky(gram)
        subspace._without(factor, k, 7)
        rest = np.delete(np.delete(gram, k, 0), k, 1)
        assert np.allclose(factor[:6, :6] @ factor[:6, :6].T, rest) and np.allclose(np.triu(factor[:6, :6], 1), 0) and factor[6, 6] == 1


def test_dense_spectral_embedding_without_edges(spark, table, planted):
    """The eigenvectors of a dense graph by passing blocks are those of its matrix, and no table of edges is made."""
    x, truth = planted
    rows = table(x)
    want = clustering.spectral_embedding(rows, graphs.rbf_affinity(rows, 0.5), 4)
    for got in (
        clustering.dense_embedding(rows, graphs.rbf(0.5), 4, tolerance=1e-8, block=32, broadcast_numbers=100),
        clustering.spectral_embedding(rows, graphs.rbf_affinity(rows, 0.5), 4, driver_nodes=0, tolerance=1e-8),
    ):
        a, b = (np.array([r.x for r in t.orderBy("id").collect()]) for t in (got, want))
        assert np.allclose(a @ a.T, b @ b.T, atol=1e-5)
    found = clustering.dense_spectral_clustering(rows, graphs.rbf(0.5), 4)
    assert len({(truth[r.id], r.cluster) for r in found.collect()}) == 4
    with pytest.raises(ValueError, match="degrees"):
        clustering.dense_embedding(table([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]]), None, 2)


def counted(rows):
    """Rows that tell how many of them have been read."""
    read = rows.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), read


def test_graphs_are_made_from_one_reading_of_their_edges(spark, table, planted):
    rows = [(0, 1, 0.5), (1, 0, 0.25), (1, 2, 1.0), (3, 1, 0.75), (4, 5, 2.0)]
    edges = spark.createDataFrame(rows, "i long, j long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    for make in (graphs.half_sum, graphs.max_symmetric, graphs.transition, lambda e: graphs.summary(nodes, e)):
        seen, read = counted(edges)
        make(seen).collect()
        assert read.value == len(rows)
    x, _ = planted
    seen, read = counted(table(x))
    neighbors.without_self(seen, 5).collect()
    once = read.value
    graphs.mutual_knn(seen, 5, 0.5).collect()
    assert read.value == 2 * once
    assert graphs.summary(nodes, edges).first().asDict() == {"n_nodes": 7, "nnz": 5, "density": 5 / 49, "isolated": 1, "n_components": 3}


def test_smoothness_makes_no_product_of_three_graphs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, t = (np.where(rng.random((9, 9)) < 0.4, rng.random((9, 9)), 0) for _ in "at")
    edges = [spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*m.nonzero())], "i long, j long, w double") for m in (a, t)]
    made, plain = [], diffusion.product

    def product(left, right):
        assert not any(left is m or right is m for m in made)
        made.append(plain(left, right))
        return made[-1]

    monkeypatch.setattr(diffusion, "product", product)
    assert abs(diffusion.smoothness(*edges) - ((a * a).sum() - (a * (t @ a @ t.T)).sum())) < 1e-10


@pytest.mark.parametrize("single", [False, True])
def test_fused_graph_in_panels_is_that_of_matrices(spark, monkeypatch, single):
    monkeypatch.setattr(diffusion, "guarded_edges", lambda _: pytest.fail("a table of all its edges"), raising=False)
    rng = np.random.default_rng(28)
    n, ids = 23, np.sort(rng.choice(1000, 23, False))
    ts = []
    for _ in range(2):
        m = np.where(rng.random((n, n)) < 0.2, rng.random((n, n)), 0)
        m = np.maximum(m, m.T)
        d = 1 / np.sqrt(np.maximum(m.sum(axis=1), 1))
        ts.append(m * d[:, None] * d)
    if single:
        monkeypatch.setattr(diffusion, "SINGLE_NODES", 10)
    edges = [spark.createDataFrame([(int(ids[i]), int(ids[j]), float(m[i, j])) for i, j in zip(*m.nonzero())], "i long, j long, w double") for m in ts]
    nodes = spark.createDataFrame([(int(i),) for i in ids], "id long")
    a, beta = np.eye(n), np.array([0.5, 0.5])
    for _ in range(2):
        alpha = beta / 1.1
        for _ in range(3):
            a = sum(s * t @ a @ t.T for s, t in zip(alpha, ts)) + (1 - alpha.sum()) * np.eye(n)
        beta = np.array(diffusion.graph_weights([(a * a).sum() - (a * (t @ a @ t.T)).sum() for t in ts], 10.0))
    for panel, nearest in ((23 * 5, None), (1000, 4)):
        fused, weights = diffusion.diffuse(nodes, edges, outer=2, inner=3, nearest=nearest, panel=panel)
        got, place = np.zeros((n, n)), {int(i): k for k, i in enumerate(ids)}
        for r in fused.collect():
            got[place[r.i], place[r.j]] = r.w
        want = a if nearest is None else np.where(a >= np.sort(a, axis=1)[:, -nearest][:, None], a, 0)
        assert np.allclose(got, want, atol=1e-6 if single else 1e-12) and np.allclose(weights, beta, atol=1e-6)


def test_spectral_embedding_of_one_task_is_that_of_many(spark, monkeypatch):
    """Also with a node without edges, an edge to no node, and thick restarts; no product is a job."""
    rng = np.random.default_rng(31)
    n = 60
    m = np.where(rng.random((n, n)) < 0.2, rng.random((n, n)), 0)
    m = m + m.T
    m[9], m[:, 9] = 0, 0
    edges = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*m.nonzero())] + [(900, 901, 1.0)], "i long, j long, w double")
    monkeypatch.setattr(clustering, "VECTORS", 20)
    d = m.sum(axis=1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    v = np.linalg.eigh(m * s[:, None] * s)[1][:, -2:]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    grams, gram = [], clustering._gram
    monkeypatch.setattr(clustering, "_gram", lambda state: grams.append(1) or gram(state))
    for held in (clustering.HELD, 0):
        monkeypatch.setattr(clustering, "HELD", held)
        got = {r.id: r.x for r in clustering.spectral_embedding(spark.range(n), edges, 2, driver_nodes=0).collect()}
        x = np.array([got[i] for i in range(n)])
        assert np.allclose(x @ x.T, v @ v.T, atol=1e-3) and not x[9].any()
        assert bool(grams) == (held == 0)


@pytest.mark.parametrize("held", [0, 100])
def test_fused_graph_held_by_one_task_is_that_of_panels(spark, monkeypatch, held):
    rng = np.random.default_rng(29)
    n = 30
    m = np.where(rng.random((n, n)) < 0.1, rng.random((n, n)), 0)
    m[0, 3:25] = 0.5  # a row of many edges, and one of none
    m = np.maximum(m, m.T)
    m[7], m[:, 7] = 0, 0
    d = 1 / np.sqrt(np.maximum(m.sum(axis=1), 1))
    t = m * d[:, None] * d
    edges = spark.createDataFrame([(int(i), int(j), float(t[i, j])) for i, j in zip(*t.nonzero())], "i long, j long, w double")
    monkeypatch.setattr(diffusion, "HELD_NODES", held)
    monkeypatch.setattr(diffusion, "EDGES", 9)
    asked, cores = [], diffusion.executor_cores
    monkeypatch.setattr(diffusion, "executor_cores", lambda spark: asked.append(1) or cores(spark))
    got, weights = diffusion.diffuse(spark.range(n), [edges, edges], outer=1, inner=3, nearest=None)
    a = np.eye(n)
    for _ in range(3):
        a = t @ a @ t.T / 1.1 + (1 - 1 / 1.1) * np.eye(n)
    out = np.zeros((n, n))
    for r in got.collect():
        out[r.i, r.j] = r.w
    assert np.allclose(out, a, atol=1e-12) and np.allclose(weights, [0.5, 0.5])
    assert bool(held) == bool(asked)


def test_graphs_times_panels(tmp_path, monkeypatch):
    """Rows of any degree, also none, in stretches."""
    rng = np.random.default_rng(30)
    m = np.where(rng.random((20, 20)) < 0.3, rng.random((20, 20)), 0)
    m[4], m[5] = 0, 1
    x = rng.normal(size=(20, 7))
    a, b = m.nonzero()
    pyarrow.parquet.write_table(pa.table({"a": a, "b": b, "w": m[a, b]}), f"{tmp_path}/edges.parquet")
    for edges in (3, 10_000):
        monkeypatch.setattr(diffusion, "EDGES", edges)
        assert np.allclose(diffusion._edges_of([f"file://{tmp_path}/edges.parquet"], 20, np.float64).times(x), m @ x)


def test_diffusion_step_is_read_once_by_its_symmetric_sum(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (2, 3, 1.0)], "i long, j long, w double")
    seen, read = counted(nodes)
    got = {(r.i, r.j): r.w for r in diffusion.diffusion_step(edges, [edges], [0.9], seen).collect()}
    assert read.value == 4
    m = np.zeros((4, 4))
    m[0, 1], m[1, 0], m[2, 3] = 0.5, 0.5, 1.0
    want = 0.9 * m @ m @ m.T + 0.1 * np.eye(4)
    want = (want + want.T) / 2
    assert got == {(i, j): pytest.approx(want[i, j]) for i, j in zip(*want.nonzero())}


def test_greedy_holds_few_rows_and_chooses_over_all(table, planted, spark):
    x, _ = planted
    value = np.round(np.random.default_rng(6).normal(size=120), 1)  # with ties
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "id long, value double")
    want, d = [], np.zeros(120)
    for step in range(20):
        at = int(np.where(np.isin(np.arange(120), want), -np.inf, np.round(value + d, 10)).argmax())
        want.append(at)
        fresh = np.log(np.maximum(1 - x @ x[at], 1e-8))
        d = np.minimum(d, fresh) if step else fresh
    for held in (1, 7, 500):
        assert [r.id for r in selection.greedy(table(x), values, 20, held=held).orderBy("step").collect()] == want
    assert len(selection.greedy(table(x[:3]), values, 20).collect()) == 3
    assert selection.greedy(table(x[:3]), values.limit(0), 20).count() == 0


def test_runs_of_kmeans_overlap_and_the_best_is_taken(table, planted, monkeypatch):
    import threading

    lock, now, most, plain = threading.Lock(), [0], [0], clustering.KMeans.fit

    def fit(self, *args):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return plain(self, *args)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(clustering.KMeans, "fit", fit)
    rows = table(planted[0])
    _, centres = clustering.kmeans(rows, 4, 5, 6)
    assert most[0] > 1
    cost = lambda c: -(planted[0] @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).max(axis=1).sum()
    assert cost(centres) <= min(cost(clustering.kmeans(rows, 4, 5, 1, seed=42 + r)[1]) for r in range(6)) + 1e-9


def test_tf_idf_counts_only_terms_that_stay(spark):
    rows = [(1, "aa bb bb cc x"), (2, "AA aa rare"), (3, None), (4, ""), (5, "bb cc"), (5, "bb")]
    got = features.tf_idf(spark.createDataFrame(rows, "id long, text string"), 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counted = [at for at, line in enumerate(plan) if "Aggregate [id#" in line]
    assert counted and all(any("Join Inner" in line for line in plan[at : at + 3]) for at in counted)
    tf = {(1, "aa"): 1, (1, "bb"): 2, (2, "aa"): 2, (5, "bb"): 2}
    w = {k: v * (np.log(7 / 3) + 1) for k, v in tf.items()}
    length = {i: np.sqrt(sum(v * v for (j, _), v in w.items() if j == i)) for i, _ in w}
    assert {(r.id, r.term): r.weight for r in got.collect()} == {k: pytest.approx(v / length[k[0]]) for k, v in w.items()}


def test_scan_head_makes_its_pairs_once(spark, planted):
    x = planted[0]
    rows = spark.createDataFrame([([float(e) for e in a], [float(e) for e in b]) for a, b in zip(x, x[::-1])], "x array<double>, y array<double>")
    seen, read = counted(rows)
    losses.fit_scan_head(seen, losses.linear_head(x[::30]), rounds=2)
    assert read.value == 120
