"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths run over them, each filter keeps
its largest response in a window (max pooling), and a softmax gives the
language.  The network is trained in numpy on windows of a bounded sample of
labelled rows and applied to all windows of every text, in batches of one fixed
shape; a text's probabilities are the mean over its windows, by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import fold, hash_sample, pick

#: Bytes of a window; the last one of a text is filled up with zero bytes.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
#: Labelled rows that the network is fitted on at most, each with all of its windows.
SAMPLE_ROWS = 1_500
BATCH = 128

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as superscripts are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Network:
    """Weights: ``embed`` (256 x EMBEDDED), ``filters`` (widest * EMBEDDED x all filters), ``dense``."""

    names: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        """1 where a filter of its width reads: narrower filters are rows of zeros beyond it."""
        wide = max(WIDTHS)
        return np.concatenate([np.repeat((np.arange(wide * EMBEDDED) < w * EMBEDDED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)

    @staticmethod
    def fresh(names: list[str], rng: np.random.Generator) -> Network:
        n = len(WIDTHS) * FILTERS
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        embed = 0.5 * draw(256, EMBEDDED)
        embed[0] = 0
        return Network(names, embed, Network.mask() * draw(max(WIDTHS) * EMBEDDED, n) * 0.25, np.zeros(n, np.float32), 0.1 * draw(n, len(names)), np.zeros(len(names), np.float32))

    def unfolded(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes below each filter position: windows x positions x (widest * EMBEDDED)."""
        wide, m = max(WIDTHS), len(windows)
        flat = np.ascontiguousarray(self.embed[windows].reshape(m, -1))
        positions, step = WINDOW - wide + 1, flat.strides[1]
        return np.lib.stride_tricks.as_strided(flat, (m, positions, wide * EMBEDDED), (flat.strides[0], EMBEDDED * step, step))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """A row of probabilities for each window of WINDOW bytes."""
        out = np.empty((len(windows), len(self.names)), np.float32)
        for at in range(0, len(windows), BATCH):
            part = windows[at : at + BATCH]
            pooled = np.maximum((self.unfolded(part).reshape(-1, self.filters.shape[0]) @ self.filters).reshape(len(part), -1, self.filters.shape[1]).max(axis=1) + self.bias, 0)
            out[at : at + len(part)] = _softmax(pooled @ self.dense + self.dense_bias)
        return out

    def step(self, windows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy: embed, filters, bias, dense, dense_bias."""
        m, n = len(windows), self.filters.shape[1]
        wide = max(WIDTHS)
        x = self.unfolded(windows)
        response = (x.reshape(-1, self.filters.shape[0]) @ self.filters).reshape(m, -1, n)
        at = response.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + self.bias, 0)
        p = _softmax(pooled @ self.dense + self.dense_bias)
        p[np.arange(m), truth] -= 1
        p /= m
        back = (p @ self.dense.T) * (pooled > 0)
        seen = x[np.arange(m)[:, None], at]  # windows x filters x inputs
        d_filters = np.einsum("mf,mfi->if", back, seen) * self.mask()
        d_inputs = back[:, :, None] * self.filters.T[None]
        below = windows[np.arange(m)[:, None, None], at[:, :, None] + np.arange(wide)]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, below.reshape(-1), d_inputs.reshape(-1, EMBEDDED))
        d_embed[0] = 0
        return [d_embed, d_filters, back.sum(axis=0), pooled.T @ p, p.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a whole text; the last one is filled up with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(names: list[str], windows: np.ndarray, truth: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> Network:
    """Fit a network with Adam; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(names, rng)
    params = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            t += 1
            rows = order[at : at + 64]
            for p, m, v, g in zip(params, first, second, net.step(windows[rows], truth[rows])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * 0.6**epoch * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_ROWS, seed: int = 3) -> Network | None:
    """A network from about ``most`` labelled rows at most; None if there is no row with a label and a letter.

    What reaches the driver are the texts of these rows, cut to windows.
    """
    rows = hash_sample(pick(labelled, id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL"), ["id", "text"], most, seed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, lang, out = [], [], []
            for i, t, name in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = t.as_py()
                if not has_letter(text):
                    continue
                all_of = windows_of(text.encode("utf-8", "replace"))
                key += [f"{i}/{w}" for w in range(len(all_of))]
                lang += [name] * len(all_of)
                out += [w.tobytes() for w in all_of]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["key", "lang", "window"])

    sample = rows.mapInArrow(cut, "key string, lang string, window binary").toPandas().sort_values(["key", "window", "lang"])
    if not len(sample):
        return None
    names = sorted(sample["lang"].unique())
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return train(names, windows, np.searchsorted(names, sample["lang"].to_numpy(object)))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, n_windows for each row.

    ``und`` with score 0 if the text is null or has no letter, or if there is no
    network.  Every window of a text counts, however long it is.  Of equal
    probabilities the first name in order wins.  Equal texts get equal answers,
    so repeated rows do; other columns are not read, whatever their names.  An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            n = b.num_rows
            sums, counts = np.zeros((n, len(own.names) if own else 0)), np.zeros(n, np.int64)
            waiting: list[np.ndarray] = []
            owner: list[np.ndarray] = []

            def flush(sums: np.ndarray = sums, waiting: list = waiting, owner: list = owner) -> None:
                if waiting:
                    w, o = np.concatenate(waiting), np.concatenate(owner)
                    np.add.at(sums, o, own.probabilities(w) * np.count_nonzero(w, axis=1)[:, None])
                    waiting.clear()
                    owner.clear()

            held = 0
            for i in range(n):
                text = b.column(1)[i].as_py()
                if own is None or text is None or not has_letter(text):
                    continue
                all_of = windows_of(text.encode("utf-8", "replace"))
                counts[i] = len(all_of)
                for at in range(0, len(all_of), 4096):
                    waiting.append(all_of[at : at + 4096])
                    owner.append(np.full(len(waiting[-1]), i))
                    held += len(waiting[-1])
                    if held >= 4096:
                        flush()
                        held = 0
            flush()
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1) if own else np.zeros(n, int)
            names = [own.names[k] if c else "und" for k, c in zip(best, counts)]
            score = [float(sums[i, best[i]] / total[i]) if counts[i] else 0.0 for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(counts)], names=[id_col, "lang_pred", "score", "n_windows"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_windows long")


def learned_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the id's text modulo 3 is not 1."""
    return docs.where(fold(F.col(id_col), 3) != 1)
