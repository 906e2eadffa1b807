"""Operators from rows to features."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import mean_vector, norm, unit

# The prompt wordings of the benchmark.
PROMPTS = ("itap of a %s.", "a bad photo of the %s.", "a origami %s.", "a photo of the large %s.", "a %s in a video game.", "art of the %s.", "a photo of the small %s.")
SINGLE_PROMPT = ("a photo of a %s",)


def pixels(images: DataFrame) -> DataFrame:
    """Raw pixels (id, x) scaled by 1/255 in those images whose largest value exceeds 1."""
    return images.withColumn("x", F.when(F.array_max("x") > 1, F.transform("x", lambda e: e / 255.0)).otherwise(F.col("x")))


def tf_idf(docs: DataFrame, max_features: int = 512) -> DataFrame:
    """id, term, weight: unit rows over the most frequent terms.

    Terms are lower-cased runs of two or more word characters; of all terms the
    ``max_features`` with the most occurrences (then in alphabetical order)
    stay; idf is ln((1 + n) / (1 + df)) + 1.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) >= 2)
    found = docs.select("id", F.explode(words).alias("term"))
    n = docs.count()
    # The terms are known before documents are counted, so only those that stay are shuffled by document.
    most = found.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).orderBy(F.col("cf").desc(), "term").limit(max_features)
    counts = found.join(F.broadcast(most.select("term")), "term").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Read by its counts, so that both uses of the counts share one shuffle.
    terms = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighed = counts.join(F.broadcast(terms), "term").select("id", "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighed.select("id", "term", (F.col("w") / length).alias("weight"))


def prompts(names: DataFrame, templates: tuple[str, ...] = PROMPTS) -> DataFrame:
    """id, prompt (from 0), text: each name in each template."""
    filled = F.array(*(F.format_string(t, F.col("name")) for t in templates))
    return names.select("id", F.posexplode(filled).alias("prompt", "text"))


def ensemble(prompted: DataFrame, normalise: bool = True) -> DataFrame:
    """The mean over prompts of (id, prompt, x) for each id, to unit length if asked."""
    out = prompted.groupBy("id").agg(mean_vector("x").alias("x"))
    return out.withColumn("x", unit("x")) if normalise else out


def strictly_unit(vectors: DataFrame) -> DataFrame:
    """Unit rows; fails on fewer than two rows, on null, NaN or infinite numbers, and on zero vectors."""
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    checked = vectors.withColumn(
        "x",
        F.when(F.col("x").isNull() | bad, F.raise_error(F.lit("vectors need finite numbers")).cast("array<double>"))
        .when(norm("x") == 0, F.raise_error(F.lit("vectors of length zero have no direction")).cast("array<double>"))
        .otherwise(unit("x", 0.0)),
    )
    if len(vectors.select("id").take(2)) < 2:
        raise ValueError("at least two rows are needed")
    return checked


def standardised(vectors: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Each dimension less its mean over its population deviation, which counts as ``floor`` at least."""
    v = array_to_vector("x")
    stats = vectors.agg(vector_to_array(Summarizer.mean(v)).alias("m"), vector_to_array(Summarizer.variance(v)).alias("s"), F.count(F.lit(1)).alias("n"))
    # The summarizer's variance is that of a sample.
    sides = stats.select("m", F.transform("s", lambda e: F.greatest(F.sqrt(e * (F.col("n") - 1) / F.col("n")), F.lit(floor))).alias("s"))
    shift = F.zip_with(F.zip_with("x", "m", lambda a, b: a - b), "s", lambda a, b: a / b)
    return vectors.crossJoin(F.broadcast(sides)).withColumn("x", shift).drop("m", "s")  # one row on the right


def concatenated(left: DataFrame, right: DataFrame) -> DataFrame:
    """[left | right] for each id of both."""
    return left.select("id", F.col("x").alias("a")).join(right.select("id", F.col("x").alias("b")), "id").select("id", F.concat("a", "b").alias("x"))


def encode(images: DataFrame, width: int = 64, seed: int = 42) -> DataFrame:
    """Features (id, x) of pictures (id, x pixels) by a fixed random projection, in Arrow batches.

    Stands where a pretrained encoder would: any function from a matrix of
    pixels to a matrix of features may take its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            out = flat @ np.random.default_rng(seed).normal(0, 1 / np.sqrt(width), (flat.shape[1], width)) if b.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["id", "x"])

    return images.select("id", "x").mapInArrow(run, "id long, x array<double>")


VIEWS = ("none", "standard_train", "simclr")


def random_view(images: DataFrame, width: int, preset: str = "standard_train", seed: int = 42) -> DataFrame:
    """Training views of grey pictures (id, x pixels in rows of ``width``): (id, x).

    ``none`` leaves them; ``standard_train`` shifts by up to an eighth and may
    mirror; ``simclr`` crops between a quarter and all of the picture, scales
    that back up, may mirror, and changes brightness and contrast.  The draw of
    a picture depends on seed and id alone.
    """
    if preset not in VIEWS:
        raise ValueError(f"preset is one of {', '.join(VIEWS)}")

    def view(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        h, w = pixels.shape
        if preset == "standard_train":
            dy, dx = rng.integers(-(h // 8), h // 8 + 1), rng.integers(-(w // 8), w // 8 + 1)
            pixels = np.roll(pixels, (dy, dx), (0, 1))
        else:
            side = np.sqrt(rng.uniform(0.25, 1))
            ch, cw = max(1, round(h * side)), max(1, round(w * side))
            y, x = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
            pixels = pixels[y + np.arange(h) * ch // h][:, x + np.arange(w) * cw // w]
            pixels = np.clip((pixels - pixels.mean()) * rng.uniform(0.6, 1.4) + pixels.mean() * rng.uniform(0.6, 1.4), 0, None)
        return pixels[:, ::-1] if rng.random() < 0.5 else pixels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1, width) if b.num_rows else []
            out = [view(p, np.random.default_rng([seed, i % 2**63])).ravel().tolist() for i, p in zip(b.column(0).to_pylist(), flat)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "x"])

    return images.select("id", "x") if preset == "none" else images.select("id", "x").mapInArrow(run, "id long, x array<double>")


def name_token(name: Column) -> Column:
    """A registry name as it is compared: lower case, without blanks, dashes and underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), "[-_ ]", "")


def readable(name: Column) -> Column:
    """A class name as words: dashes and underscores become blanks."""
    return F.translate(name, "_-", "  ")


# Fixed values of cache paths: what parts words, what stands for a dot, the bytes of a
# name, and of a longer one the characters kept, the mark and the hash's digits.
WORD_ENDS, DOT = r"[-/\\ :=]+", "p"
NAME_BYTES, STEM_KEPT, HASH_MARK, HASH_DIGITS = 240, 160, "__hash", 16


def cache_token(value: object) -> str:
    """A value as part of a cache path: its words in lower case, with dashes between."""
    words = re.split(WORD_ENDS, str(value).strip().lower().replace(".", DOT))
    return "-".join(w for w in words if w)


def cache_key(*parts: object) -> str:
    """The tokens of all parts that are neither None nor blank."""
    given = ["" if p is None else str(p).strip() for p in parts]
    return "__".join(cache_token(p) for p in given if p)


def cache_name(stem: str, suffix: str, most: int = STEM_KEPT) -> str:
    """A file name of NAME_BYTES at most; longer stems are cut and told apart by a hash of the whole."""
    stem, ending = cache_key(stem), f".{suffix.lstrip('.')}"
    if len(stem.encode()) + len(ending.encode()) > NAME_BYTES:
        told_apart = HASH_MARK + hashlib.sha1(stem.encode()).hexdigest()[:HASH_DIGITS]
        stem = stem[:most].rstrip("_-") + told_apart
    return stem + ending


def cache_token_column(value: Column) -> Column:
    """:func:`cache_token` of a column."""
    text = F.translate(F.lower(F.trim(value)), "/\\ :=.", "-----p")
    return F.array_join(F.filter(F.split(text, "-"), lambda t: t != ""), "-")
