"""Cropped and edited copies of images by local descriptors.

Corners are found at all scales of a pyramid that ends where a patch no longer
fits: every place whose response is the largest within APART pixels, so that the
number of corners follows a picture's area and a crop keeps its own.  Around
each, the direction of brightness gives an orientation, and binary tests turned
by it give a descriptor of 512 bits.  Descriptors meet in Hamming tables (equal
bits in one of the bands), and each meeting proposes a shift, turn and scale.
Images whose meetings agree on one geometry are linked, and linked images form
classes.

Corners of a key that few share all meet.  Those of a crowded key meet REPS
reference images of the key, drawn by hashes of the ids, so that images that
share many keys meet the same references and their votes add up.  So a group of
copies, however large, costs a fixed number of meetings a corner.  On request
(``exact``) those of a crowded key all meet too, dealt to many tasks, and no link
is lost; a crowd then costs the square of its size.

Images that are byte for byte the same collapse before any of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import join_groups, pick, small, stored
from vecloom.llm.simhash import components

#: Step of the pyramid, distance that corners keep, patch radius, bits and bands of a descriptor.
STEP = 1.5
APART = 4
RADIUS = 9
BITS = 512
BANDS = 8
#: Meetings that must agree on a geometry, and the width of its bins in pixels.
VOTES = 4
BIN = 8
#: Corners of a key that all meet, and reference images of a key that more share.
COMMON = 24
REPS = 8
#: Corners of a crowded key on one side of a task's join, where all meet.
SPREAD = 256

_rng = np.random.default_rng(20)
#: The binary tests: two points each, spread evenly over the patch's disc, so that tests say different things.
_polar = _rng.uniform(0, 1, (BITS, 2, 2))
_reach = (RADIUS - 1) * np.sqrt(_polar[:, :, 0])
TESTS = np.column_stack([f(2 * np.pi * _polar[:, k, 1]) * _reach[:, k] for k in (0, 1) for f in (np.cos, np.sin)])


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey picture as binary PGM."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM, None if it is none."""
    try:
        kind, size, most, rest = (raw or b"").split(b"\n", 3)
        w, h = map(int, size.split())
        if kind != b"P5" or int(most) != 255 or w < 1 or h < 1 or len(rest) != w * h:
            return None
        return np.frombuffer(rest, np.uint8).reshape(h, w)
    except ValueError:
        return None


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing, five taps each way."""
    x = np.pad(x, 2, mode="edge")
    x = x[:-4] + x[4:] + 4 * (x[1:-3] + x[3:-1]) + 6 * x[2:-2]
    return (x[:, :-4] + x[:, 4:] + 4 * (x[:, 1:-3] + x[:, 3:-1]) + 6 * x[:, 2:-2]) / 256


def _shrunk(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[0] / scale), int(x.shape[1] / scale)
    ys, xs = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[0] - 2), np.clip(xs.astype(int), 0, x.shape[1] - 2)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1][:, x0] * (1 - fx) + x[y0 + 1][:, x0 + 1] * fx) * fy


def _highest(x: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within ``reach`` pixels each way."""
    for axis in (0, 1):
        p = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        x = np.lib.stride_tricks.sliding_window_view(p, 2 * reach + 1, axis=axis).max(axis=-1)
    return x


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in the picture's own pixels, and their descriptors (64 bytes each)."""
    spots, codes = [], []
    smallest, scale = 2 * RADIUS + 3, 1 / STEP
    while min(pixels.shape) / (scale := scale * STEP) >= smallest:
        x = _blur(_shrunk(pixels.astype(np.float64), scale))
        if min(x.shape) < smallest:
            break
        gy, gx = np.gradient(x)
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        strength = a * c - b * b - 0.05 * (a + c) ** 2
        inner = np.full_like(strength, -np.inf)
        m = RADIUS + 1
        inner[m:-m, m:-m] = strength[m:-m, m:-m]
        # The largest within APART pixels each way; what the rim cuts off counts as nothing.
        ys, xs = np.nonzero((inner >= _highest(inner, APART)) & (inner > 1e-3))
        if not len(ys):
            continue
        span = np.arange(-RADIUS, RADIUS + 1)
        dy, dx = np.meshgrid(span, span, indexing="ij")
        disc = (dy**2 + dx**2 <= RADIUS**2).astype(float)
        patch = x[ys[:, None, None] + dy, xs[:, None, None] + dx] * disc
        angle = np.arctan2((patch * dy).sum(axis=(1, 2)), (patch * dx).sum(axis=(1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def sample(px: np.ndarray, py: np.ndarray) -> np.ndarray:
            u, v = np.rint(cos * px - sin * py).astype(int), np.rint(sin * px + cos * py).astype(int)  # noqa: B023
            return x[np.clip(ys[:, None] + v, 0, x.shape[0] - 1), np.clip(xs[:, None] + u, 0, x.shape[1] - 1)]  # noqa: B023

        codes.append(np.packbits(sample(TESTS[:, 0], TESTS[:, 1]) < sample(TESTS[:, 2], TESTS[:, 3]), axis=1))
        spots.append(np.column_stack([(xs + 0.5) * scale, (ys + 0.5) * scale, np.full(len(ys), scale), angle]))
    if not spots:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(spots), np.concatenate(codes)


def described(media: DataFrame) -> DataFrame:
    """id, sha, geometry, bands for each row of (id, image).

    ``geometry`` holds x, y, scale and angle of each corner in turn, ``bands``
    its BANDS times 64 bits; both are empty for pictures without corners.
    Nothing but these small arrays leaves the task, the pictures themselves are
    neither shuffled nor written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas, geometry, bands = [], [], []
            for image in b.column(1):
                raw = image.as_py() or b""
                pixels = decode_pgm(raw)
                spots, codes = describe(pixels) if pixels is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                shas.append(hashlib.sha256(raw).hexdigest())
                geometry.append(spots.astype(np.float32).ravel())
                bands.append(np.ascontiguousarray(codes).view("<i8").ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.string()), pa.array(geometry, pa.list_(pa.float32())), pa.array(bands, pa.list_(pa.int64()))], names=["id", "sha", "geometry", "bands"])

    return media.select("id", "image").mapInArrow(run, f"id {media.schema['id'].dataType.simpleString()}, sha string, geometry array<float>, bands array<bigint>")


def corners(found: DataFrame) -> DataFrame:
    """A row for each corner of (id, geometry, bands): id, x, y, scale, angle, bands."""
    at = found.where(F.size("geometry") > 0).select("id", "geometry", "bands", F.explode(F.sequence(F.lit(0), (F.size("geometry") / 4).cast("int") - 1)).alias("c"))
    part = [F.col("geometry")[F.col("c") * 4 + k].cast("double").alias(n) for k, n in enumerate(("x", "y", "scale", "angle"))]
    return at.select("id", *part, F.slice("bands", F.col("c") * BANDS + 1, BANDS).alias("bands"))


def _pairs(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """All pairs of corners of (keys, place) that share the keys."""
    left = rows.select(*keys, *(F.col(c).alias(f"{c}_a") for c in place))
    right = rows.select(*keys, *(F.col(c).alias(f"{c}_b") for c in place))
    return left.join(right, keys).where("id_a < id_b").drop(*keys)


def _spread_pairs(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """:func:`_pairs` of crowded keys of ``n`` corners: about SPREAD of them at a time meet all others, so no key is one task's."""
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    left = rows.select(*keys, F.pmod(F.xxhash64(*place), parts).cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in place))
    right = rows.select(*keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in place))
    return left.join(right, [*keys, "part"]).where("id_a < id_b").drop(*keys, "part")


def _to_references(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Pairs of each corner with REPS reference corners of its keys; the image of the least hash under each salt gives one."""
    least = [F.min(F.struct(F.xxhash64("id", F.lit(s)).alias("hash"), *place)).alias(f"r{s}") for s in range(REPS)]
    reps = rows.groupBy(*keys).agg(*least).select(*keys, F.array(*(F.struct(*(F.col(f"r{s}")[c].alias(c) for c in place)) for s in range(REPS))).alias("reps"))
    reps = stored(reps.withColumn("reps", F.array_distinct("reps")), "references")
    met = rows.join(small(reps, reps.count(), 20_000), keys).select(*place, F.explode("reps").alias("rep"))
    swap = F.col("id") < F.col("rep.id")
    ends = [F.when(swap, F.col(c)).otherwise(F.col("rep")[c]).alias(f"{c}_a") for c in place] + [F.when(swap, F.col("rep")[c]).otherwise(F.col(c)).alias(f"{c}_b") for c in place]
    return met.where(F.col("id") != F.col("rep.id")).select(*ends)


def links(spots: DataFrame, votes: int = VOTES, common: int = COMMON, exact: bool = False) -> DataFrame:
    """Links (a, b), a < b, between images whose corners (as :func:`corners` gives them) agree on one geometry.

    All corners of a key that ``common`` at most share meet; those of a key that
    more share meet its references or, if ``exact``, all others as well.
    """
    place = ["id", "x", "y", "scale", "angle"]
    keyed = spots.select(*place, F.posexplode("bands").alias("band", "bits"))
    # Most keys occur once; only those that repeat, counted first, meet the corners again.
    sizes = stored(spots.select(F.posexplode("bands").alias("band", "bits")).groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    keys = ["band", "bits"]
    held = stored(keyed.join(small(sizes, sizes.count()), keys), "corners")
    few, crowd = held.where(F.col("n") <= common), held.where(F.col("n") > common)
    met = _pairs(few, keys, place).unionByName(_spread_pairs(crowd, keys, place) if exact else _to_references(crowd.drop("n"), keys, place))
    both = met.distinct()
    # The turn and scale of one meeting fix the shift; votes go to two overlapping grids, so no agreement is split by an edge of both.
    turn, size = F.col("angle_b") - F.col("angle_a"), F.col("scale_b") / F.col("scale_a")
    sx = F.col("x_b") - size * (F.cos(turn) * F.col("x_a") - F.sin(turn) * F.col("y_a"))
    sy = F.col("y_b") - size * (F.sin(turn) * F.col("x_a") + F.cos(turn) * F.col("y_a"))
    octant = F.floor(F.pmod(turn + np.pi / 8, F.lit(2 * np.pi)) / (np.pi / 4))
    grid = both.select("id_a", "id_b", F.round("x_a").alias("px"), F.round("y_a").alias("py"), F.round(F.log2(size) * 2).alias("size"), octant.alias("turn"), sx.alias("sx"), sy.alias("sy"))
    cells = grid.select("id_a", "id_b", "px", "py", "size", "turn", F.explode(F.array(*(F.struct(F.floor(F.col("sx") / BIN + o).alias("cx"), F.floor(F.col("sy") / BIN + o).alias("cy"), F.lit(o).alias("o")) for o in (0.0, 0.5)))).alias("cell"))
    agreed = cells.groupBy("id_a", "id_b", "size", "turn", "cell").agg(F.countDistinct("px", "py").alias("n")).where(F.col("n") >= votes)
    return agreed.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def find_copies(media: DataFrame, id_col: str = "media_id", image_col: str = "image", exact: bool = False) -> DataFrame:
    """One row for each row of ``media``: id, image_sha256, class_id, n_links.

    ``class_id`` is the smallest id that an image reaches over equal bytes and
    links, ``n_links`` the links found of its picture to different pictures (in a
    crowd, those to references unless ``exact``).  Null, broken, tiny and plain pictures have no
    corners and so are alone with their equal bytes; null images are one class.
    Pictures, not ids, are compared: an id that several rows share may stand for
    several pictures, and class_id is null where all ids of a class are.  Large
    pictures have more corners.  Other columns are not read, whatever their
    names.  An empty table gives an empty result.
    """
    rows = stored(described(pick(media, id=id_col, image=image_col)), "described")
    total = rows.count()
    # Equal pictures have equal corners, so any row of a picture stands for it; its number is a hash of its bytes.
    pictures = rows.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("geometry").alias("geometry"), F.first("bands").alias("bands"))
    pictures = stored(pictures.withColumn("node", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")), "pictures")
    found = stored(links(corners(pictures.select(F.col("node").alias("id"), "geometry", "bands")), exact=exact), "links")
    roots = components(found).select(F.col("node").alias("of"), "root")
    degree = found.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n_links"))
    placed = pictures.select("sha", "least", "n", "node").join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("pictures"))
    classes = join_groups(placed, least, "root", pictures.count(), "pictures").join(degree, F.col("node") == F.col("end"), "left")
    classes = stored(classes.select("sha", "class_id", "n", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return join_groups(rows.select("id", "sha"), classes, "sha", total).select(F.col("id").alias(id_col), F.col("sha").alias("image_sha256"), "class_id", "n_links")


def picture(vector: list[float] | None, size: int = 80) -> np.ndarray:
    """A picture that a vector draws: shades of its values over a texture that its bits seed."""
    v = np.nan_to_num(np.asarray(vector if vector else [0.0], np.float32))
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(v.tobytes()).digest()[:8], "little"))
    out = np.kron(rng.integers(60, 160, (size // 4, size // 4)), np.ones((4, 4))) + rng.integers(-6, 7, (size, size))
    for value in v.tolist():
        x, y, w, h = rng.integers(0, size - 8), rng.integers(0, size - 8), *rng.integers(5, 18, 2)
        out[y : y + h, x : x + w] += 220 * value
    return np.clip(out, 0, 255).astype(np.uint8)


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy, brighter or darker, with a bar across a corner of it."""
    rng = np.random.default_rng(seed)
    y, x = rng.integers(0, 12, 2)
    out = pixels[y : y + 66, x : x + 66].astype(float) * rng.uniform(0.8, 1.1) + rng.uniform(-8, 12)
    out[:6, :20] = 255
    return np.clip(out, 0, 255).astype(np.uint8)


def drawn_media(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 10) -> DataFrame:
    """A media table from a table of vectors: media_id, image.

    Each vector draws one picture (media_id 2 * id), and those whose id is
    divisible by ``every`` also an edited copy of it (media_id 2 * id + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, images = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pixels = picture(v)
                ids.append(2 * i)
                images.append(encode_pgm(pixels))
                if i % every == 0:
                    ids.append(2 * i + 1)
                    images.append(encode_pgm(edited(pixels, i)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])

    return pick(vectors, id=id_col, vector=vector_col).where("id IS NOT NULL").mapInArrow(run, "media_id long, image binary")
