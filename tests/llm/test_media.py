import numpy as np
import pytest
from vecloom.llm import media

SCHEMA = "media_id long, image binary"


def pictures(n, seed=0):
    rng = np.random.default_rng(seed)
    return [media.picture(rng.normal(0, 0.125, 64).tolist()) for _ in range(n)]


def test_pgm_round_trip_and_broken_files():
    p = pictures(1)[0]
    assert (media.decode_pgm(media.encode_pgm(p)) == p).all()
    for raw in (None, b"", b"P5\n", b"P5\n3 3\n255\nxx", b"P6\n1 1\n255\nx", b"P5\n-1 2\n255\n", b"P5\na b\n255\nx"):
        assert media.decode_pgm(raw) is None


def test_descriptors_turn_with_the_picture():
    same = []
    for p in pictures(12):
        (_, a), (_, b) = media.describe(p), media.describe(np.rot90(p).copy())
        d = np.unpackbits(a[:, None] ^ b[None], axis=2).sum(axis=2)
        same.append((d.min(axis=1) <= 24).mean())
    assert np.mean(same) > 0.5
    assert len(media.describe(np.full((80, 80), 7, np.uint8))[1]) == len(media.describe(np.zeros((4, 4), np.uint8))[1]) == 0


def test_copies_are_found_and_others_left_alone(spark):
    own = pictures(40, 1)
    rows = [(10 * i, media.encode_pgm(p)) for i, p in enumerate(own)]
    rows += [(10 * i + 1, media.encode_pgm(media.edited(own[i], i))) for i in range(0, 40, 2)]
    rows += [(10 * i + 2, media.encode_pgm(own[i])) for i in range(0, 40, 5)]
    rows += [(1000, media.encode_pgm(np.rot90(own[3]).copy()))]
    got = {r.media_id: r.class_id for r in media.find_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == 10 * (i // 10) for i in got if i % 10 == 2 or i < 400 and i % 10 == 0)
    assert sum(got[10 * i + 1] == 10 * i for i in range(0, 40, 2)) == 20
    assert got[1000] == 30


def slow_links(spots, votes):
    """The same geometry by loops over all pairs of corners."""
    out = {}
    for p in spots:
        for q in spots:
            if p.id < q.id and any(x == y for x, y in zip(p.bands, q.bands)):
                turn, size = q.angle - p.angle, q.scale / p.scale
                sx = q.x - size * (np.cos(turn) * p.x - np.sin(turn) * p.y)
                sy = q.y - size * (np.sin(turn) * p.x + np.cos(turn) * p.y)
                for o in (0.0, 0.5):
                    key = (p.id, q.id, round(np.log2(size) * 2), np.floor(((turn + np.pi / 8) % (2 * np.pi)) / (np.pi / 4)), np.floor(sx / media.BIN + o), np.floor(sy / media.BIN + o), o)
                    out.setdefault(key, set()).add((round(p.x), round(p.y)))
    return {k[:2] for k, v in out.items() if len(v) >= votes}


def test_links_equal_brute_force(spark):
    own = pictures(10, 2)
    rows = [(i, media.encode_pgm(p)) for i, p in enumerate(own)] + [(100 + i, media.encode_pgm(media.edited(p, i))) for i, p in enumerate(own)]
    spots = media.corners(media.described(spark.createDataFrame(rows, "id long, image binary"))).collect()
    table = spark.createDataFrame(spots)
    want = slow_links(spots, media.VOTES)
    assert {(r.a, r.b) for r in media.links(table).collect()} == want and len(want) >= 10


@pytest.mark.parametrize("n", [30, 90])
def test_large_groups_of_copies(spark, n):
    """More distinct edited copies of one picture than corners of a key may meet freely: one class, in few meetings."""
    own = pictures(6, 4)
    rows = [(i, media.encode_pgm(p)) for i, p in enumerate(own)] + [(100 + i, media.encode_pgm(media.edited(own[0], i))) for i in range(n)]
    got = {r.media_id: r.class_id for r in media.find_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(6)] == list(range(6))
    assert sum(got[100 + i] == 0 for i in range(n)) >= 0.97 * n
    assert all(got[100 + i] in (0, 100 + i) for i in range(n))


def test_one_band_alone_links_a_crowd(spark):
    """Images that agree in a single band of each corner, at one geometry."""
    rows = []
    for i in range(60):
        for c in range(8):
            rows.append((i, 10.0 * c, 7.0 * c * c, 1.0, 0.0, [1000 + c] + [10**6 * i + 100 * c + b for b in range(1, 8)]))
    spots = spark.createDataFrame(rows, "id long, x double, y double, scale double, angle double, bands array<bigint>")
    roots = {r.node: r.root for r in media.components(media.links(spots)).collect()}
    assert roots == {i: 0 for i in range(1, 60)}
    assert media.links(spots).count() <= 60 * media.REPS


def test_exact_links_of_a_crowd(spark, monkeypatch):
    """Images of a crowd whose corners agree in a single band are all linked, as by a loop over all pairs; references leave links out."""
    monkeypatch.setattr(media, "SPREAD", 16)
    rows = []
    for i in range(60):
        for c in range(8):
            rows.append((i, 10.0 * c, 7.0 * c * c, 1.0, 0.0, [1000 + c] + [10**6 * i + 100 * c + b for b in range(1, 8)]))
    spots = spark.createDataFrame(rows, "id long, x double, y double, scale double, angle double, bands array<bigint>")
    exact = {(r.a, r.b) for r in media.links(spots, exact=True).collect()}
    assert exact == slow_links(spots.collect(), media.VOTES) and len(exact) == 60 * 59 // 2
    assert media.links(spots).count() < len(exact)


def test_corners_follow_the_area():
    """A crop keeps the corners of its part, and a large picture has more of them."""
    rng = np.random.default_rng(5)
    large = np.kron(rng.integers(40, 210, (60, 60)), np.ones((5, 5))).astype(np.uint8)
    spots, codes = media.describe(large)
    part, own = media.describe(large[100:180, 60:160])
    assert len(spots) > 5 * len(part) > 100
    known = {c.tobytes() for c in codes}
    assert np.mean([c.tobytes() in known for c, s in zip(own, part) if s[2] == 1]) > 0.6
    assert len(media.describe(np.zeros((20, 400), np.uint8))[0]) == 0


def test_one_id_for_two_pictures(spark):
    a, b = (media.encode_pgm(p) for p in pictures(2, 7))
    rows = [(1, a), (1, b), (2, b), (None, a), (None, b"junk")]
    got = sorted(((r.media_id, r.class_id, r.image_sha256) for r in media.find_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [(i, c) for i, c, _ in got] == [(1, 1), (1, 1), (2, 1), (None, 1), (None, None)] and len({s for *_, s in got}) == 3


def test_edge_cases(spark):
    same = media.encode_pgm(pictures(1)[0])
    rows = [(1, None), (2, None), (3, b"junk"), (4, same), (4, same), (5, media.encode_pgm(np.full((70, 70), 9, np.uint8))), (None, same)]
    got = media.find_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.media_id or 0, r.class_id, r.n_links) for r in got) == [(0, 4, 0), (1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (4, 4, 0), (5, 5, 0)]
    assert media.find_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, same, "x", 2)], "media_id long, image binary, sha string, class_id int")
    assert media.find_copies(clash).columns == ["media_id", "image_sha256", "class_id", "n_links"]


@pytest.mark.parametrize("vector", [None, [], [float("nan"), 1.0]])
def test_odd_vectors_draw_something(vector):
    assert media.picture(vector).shape == (80, 80)
