"""Toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

The lexicon comes from a bounded sample of labelled rows: words and word stems
that occur in far more toxic than other documents, counted once for each group
of near copies.  A word of a text matches a term exactly, by its stem, or
misspelled: the word's Levenshtein automaton (a swap of neighbours is one edit)
is walked along the trie of the lexicon.  Terms of FUZZY_FROM letters take one
edit, words of LONG_FROM two; a stem is accepted where a beginning of the word is
near it, and words that a stem explains stay in the trie for their misspellings.
Each hit is weighed by its term, less inside quotation, and hits that share a
window of words add up.  A logistic regression over these sums, fitted on the
same sample, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import fold, hash_sample, pick, small, stored

#: Labelled rows that the lexicon and the regression are fitted on.
SAMPLE_ROWS = 12_000
#: Lengths of the beginnings of words that may become stems.
STEMS = (3, 4, 5, 6, 7, 8)
#: Terms shorter than this only match exactly; words of LONG_FROM letters may be two edits off.
FUZZY_FROM = 5
LONG_FROM = 11
WINDOW = 30
QUOTED = 0.25
#: Words of a generation of the memo; the last two are kept, so frequent words stay.
MEMO = 100_000
FEATURES = 8
#: Terms of an Arrow batch, about, where the terms of texts are listed.
LISTED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r'["“”«»„\n]')
#: Which marks close an opening one.
_CLOSE = {'"': '"', "“": "”", "«": "»", "„": "“”"}
_CITED = re.compile(r"^>[^\n]*", re.M)
_LONG = 1_000_000


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotation, in order and apart: from a mark to the one that closes it on the same line, however far, and lines that begin with ``>``."""
    marks = [(m.start(), m.group()) for m in _MARK.finditer(text)]
    marks.append((len(text), "\n"))
    # From the back: the next place of each closing mark on the line.
    after: dict[str, int] = {}
    closed = [-1] * len(marks)
    for n in range(len(marks) - 1, -1, -1):
        at, c = marks[n]
        if c == "\n":
            after = {}
            continue
        closed[n] = min((after[x] for x in _CLOSE.get(c, "") if x in after), default=-1)
        after[c] = n
    spans, n = [m.span() for m in _CITED.finditer(text)], 0
    while n < len(marks):
        if closed[n] >= 0 and marks[closed[n]][0] > marks[n][0] + 1:
            spans.append((marks[n][0], marks[closed[n]][0] + 1))
            n = closed[n]
        n += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


State = tuple[int, int, int, int, int, str]


class Levenshtein:
    """The automaton of the words within ``k`` (1 or 2) edits of ``word``: letters put in, left out, replaced, or swapped with their neighbour.

    A state holds, for 0, 1 and 2 edits, the set (as bits) of the lengths of
    ``word`` that may have been read; the sets for 0 and 1 before it and the last
    letter serve the swaps.
    """

    def __init__(self, word: str, k: int):
        self.n, self.two, self.full = len(word), k > 1, (2 << len(word)) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def start(self) -> State:
        return 1, 3 & self.full, 7 & self.full if self.two else 0, 0, 0, ""

    def step(self, state: State, c: str) -> State:
        r0, r1, r2, p0, p1, last = state
        here = self.masks.get(c, 0)
        swap = here & self.masks.get(last, 0) >> 1
        a = (r0 & here) << 1
        b = ((r1 & here) << 1 | r0 | r0 << 1 | a << 1 | (p0 & swap) << 2) & self.full
        d = ((r2 & here) << 1 | r1 | r1 << 1 | b << 1 | (p1 & swap) << 2) & self.full if self.two else 0
        return a, b, d, r0, r1, c

    def distance(self, state: State) -> int | None:
        """The distance if the state accepts, else None."""
        return next((d for d in range(3) if state[d] >> self.n & 1), None)

    @staticmethod
    def alive(state: State) -> bool:
        """Whether what was read is near a beginning of the word."""
        return bool(state[0] or state[1] or state[2])


def _shortened(word: str) -> set[str]:
    """The word without one of its letters."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _put(trie: dict, term: str, what: tuple[str, float, bool]) -> None:
    for c in term:
        trie = trie.setdefault(c, {})
    trie.setdefault("", []).append(what)


@dataclass
class Lexicon:
    """Weights of words, of stems (words that start so), and of ``near`` words, of which only misspellings count as a stem stands for them; in tries."""

    words: dict[str, float]
    stems: dict[str, float]
    near: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        #: Terms that take one edit, and long words that take two.
        self.trie, self.long = {}, {}
        self.heads, self.swapped, self.inner, self.trigrams, self.shorter = set(), set(), set(), set(), set()
        every = [(w, w, v, False) for w, v in [*self.words.items(), *self.near.items()]] + [(s, s + "-", v, True) for s, v in self.stems.items()]
        for term, name, weight, stem in every:
            if len(term) < FUZZY_FROM:
                continue
            _put(self.trie, term, (name, weight, stem))
            if stem:
                # A beginning of the word within one edit of a stem shares its first or its last half, or has the two letters in the middle swapped.
                h = len(term) // 2
                self.heads.add(term[:h])
                self.inner.add(term[h:])
                self.swapped.add(term[: h - 1] + term[h] + term[h - 1] + term[h + 1 :])
            else:
                # Two words one edit apart are equal once each has lost one letter at most.
                self.shorter |= {term} | _shortened(term)
            if not stem and len(term) >= LONG_FROM:
                # Two edits destroy eight trigrams at most; a long word has nine.
                _put(self.long, term, (name, weight, False))
                self.trigrams |= {term[i : i + 3] for i in range(len(term) - 2)}
        sizes = lambda x: sorted(set(map(len, x)))
        self.head_sizes, self.inner_sizes, self.swapped_sizes = sizes(self.heads), sizes(self.inner), sizes(self.swapped)
        self.longest = max(map(len, self.shorter), default=-1) + 1
        self.stem_sizes = sizes(self.stems)

    def _may(self, word: str) -> bool:
        """Whether the word may be one edit from a term."""
        if len(word) <= self.longest and (word in self.shorter or not self.shorter.isdisjoint(_shortened(word))):
            return True
        for n in self.head_sizes:
            if word[:n] in self.heads:
                return True
        for n in self.swapped_sizes:
            if word[:n] in self.swapped:
                return True
        for n in self.inner_sizes:
            for i in range(max(n - 2, 0), n + 2):
                if word[i : i + n] in self.inner:
                    return True
        return False

    @staticmethod
    def _walk(trie: dict, word: str, k: int) -> list[tuple[float, str]]:
        """Weights and names of the terms that the word's automaton accepts along the trie."""
        own, found = Levenshtein(word, k), []
        step, stack = own.step, [(trie, own.start())]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    found += [(weight, name) for name, weight, stem in below if name != word and (stem or own.distance(state) is not None)]
                    continue
                after = step(state, c)
                if after[1] or after[2]:  # alive: what no edit reaches, one edit reaches too
                    stack.append((below, after))
        return found

    def fuzzy(self, word: str) -> tuple[float, str] | None:
        """Weight and name of the heaviest term near the word but not equal to it."""
        found = self._walk(self.trie, word, 1)
        if len(word) >= LONG_FROM - 2:
            found += self._walk(self.long, word, 2)
        return max(found, default=None)

    def match(self, word: str) -> tuple[str, float, bool] | None:
        """Term, weight and whether it matched inexactly."""
        best = (word, self.words[word], False) if word in self.words else None
        for n in self.stem_sizes:
            if (stem := word[:n]) in self.stems and (best is None or self.stems[stem] > best[1]):
                best = (stem + "-", self.stems[stem], False)
        if best is None and len(word) >= FUZZY_FROM - 1:
            found = self._walk(self.trie, word, 1) if self._may(word) else []
            if len(word) >= LONG_FROM - 2 and not self.trigrams.isdisjoint([word[i : i + 3] for i in range(len(word) - 2)]):
                found += self._walk(self.long, word, 2)
            if found:
                weight, term = max(found)
                best = (term, weight, True)
        return best

    def matches(self, words: set[str]) -> dict[str, tuple[str, float, bool]]:
        """:meth:`match` of those of the words that match, found by whole passes over the words."""
        some = {w for w in words if w in self.words}
        for n in self.stem_sizes:
            some |= {w for w in words if w[:n] in self.stems}
        rest = [w for w in words - some if len(w) >= FUZZY_FROM - 1]
        for n in self.head_sizes:
            some |= {w for w in rest if w[:n] in self.heads}
        like = [w for w in rest if len(w) <= self.longest]
        some |= {w for w in like if w in self.shorter}
        for i in range(self.longest):
            some |= {w for w in like if w[:i] + w[i + 1 :] in self.shorter}
        for n in self.swapped_sizes:
            some |= {w for w in rest if w[:n] in self.swapped}
        for n in self.inner_sizes:
            for i in range(max(n - 2, 0), n + 2):
                some |= {w for w in rest if w[i : i + n] in self.inner}
        if self.trigrams:
            some |= {w for w in rest if len(w) >= LONG_FROM - 2 and not self.trigrams.isdisjoint([w[i : i + 3] for i in range(len(w) - 2)])}
        return {w: hit for w in some if (hit := self.match(w))}


@dataclass
class Model:
    """A lexicon with the coefficients of the regression."""

    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.memo: dict[str, tuple[str, float, bool] | None] = {}
        self.older: dict[str, tuple[str, float, bool] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "older": {}}

    def hits(self, text: str) -> tuple[list[tuple[int, str, float, bool, bool]], int]:
        """(place among the words, term, weight, inexact, quoted) of each hit in the whole text, and the number of words."""
        memo, low = self.memo, text.lower()
        n, found = 0, []
        for at in self._cuts(low):
            words = _WORD.findall(low, *at)
            seen = set(words)
            if len(memo) > MEMO:
                self.older, self.memo = memo, {}
                memo = self.memo
            fresh = {w for w in seen if w not in memo}
            known = {w: self.older[w] for w in fresh if w in self.older}
            fresh.difference_update(known)
            memo |= known
            memo |= dict.fromkeys(fresh)
            memo |= self.lexicon.matches(fresh)
            hot = {w: hit for w in seen if (hit := memo[w])}
            if hot:
                found += [(n + i, *hot[w]) for i, w in enumerate(words) if w in hot]
            n += len(words)
        spans = quotations(low) if found else []
        if not spans:
            return [(*hit, False) for hit in found], n
        # Where the hits are in the text matters only next to quotations.
        out, s, h = [], 0, 0
        for place, m in enumerate(_WORD.finditer(low)):
            if place == found[h][0]:
                while s < len(spans) and spans[s][1] <= m.start():
                    s += 1
                out.append((*found[h], s < len(spans) and spans[s][0] <= m.start()))
                h += 1
                if h == len(found):
                    break
        return out, n

    @staticmethod
    def _cuts(text: str) -> Iterator[tuple[int, int]]:
        """Ranges that cover a text, cut where no word is; a very long text is read block by block."""
        at = 0
        while at < len(text):
            end = min(len(text), at + _LONG)
            while end < len(text) and _WORD.match(text, end - 1) and _WORD.match(text, end):
                end += 1
            yield at, end
            at = end

    def features(self, text: str | None) -> list[float]:
        return self.weigh(*self.hits(text)) if text else self.weigh([], 0)

    @staticmethod
    def weigh(hits: list[tuple[int, str, float, bool, bool]], n: int) -> list[float]:
        """The sums that the regression reads, from the hits among ``n`` words."""
        if not hits:
            return [0.0] * (FEATURES - 1) + [np.log1p(n)]
        weights = [w * (QUOTED if quoted else 1) for _, _, w, _, quoted in hits]
        total, first, window, best = sum(weights), 0, 0.0, 0.0
        for i, (place, *_) in enumerate(hits):
            window += weights[i]
            while hits[first][0] <= place - WINDOW:
                window -= weights[first]
                first += 1
            best = max(best, window)
        exact = sum(w for w, h in zip(weights, hits) if not h[3])
        return [
            np.log1p(exact), np.log1p(total - exact), np.log1p(best), np.log1p(100 * total / n), np.log1p(len({h[1] for h in hits})),
            max(weights), np.log1p(sum(h[4] for h in hits)), np.log1p(n),
        ]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def _sketch(words: list[str]) -> int:
    """The least hash of the 3-word shingles; near copies mostly share it."""
    return min((zlib.crc32(" ".join(s).encode("utf-8", "replace")) for s in zip(words, words[1:], words[2:])), default=zlib.crc32(" ".join(words).encode("utf-8", "replace")))


def _distinct_terms(found: list[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Words, stems and words for their misspellings alone, out of (term, toxic documents, weight).

    A stem that is one word in 9 of 10 documents gives way to the word; words
    and longer stems that weigh hardly more than a stem of theirs give way to it,
    though such words still stand for their misspellings.
    """
    words = {t: (n, w) for t, n, w in found if not t.endswith("-")}
    stems = {t[:-1]: (n, w) for t, n, w in found if t.endswith("-")}
    shadowed = {t[:k] for t, (n, _) in words.items() for k in STEMS if t[:k] in stems and n >= 0.9 * stems[t[:k]][0]}
    kept: dict[str, float] = {}
    for t in sorted(set(stems) - shadowed, key=lambda t: (len(t), t)):
        if all(t[:k] not in kept or stems[t][1] > 1.15 * kept[t[:k]] for k in STEMS if k < len(t)):
            kept[t] = stems[t][1]
    own = {t for t, (_, w) in words.items() if all(t[:k] not in kept or w > 1.15 * kept[t[:k]] for k in STEMS)}
    return {t: w for t, (_, w) in words.items() if t in own}, kept, {t: w for t, (_, w) in words.items() if t not in own}


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and bias of a ridge-regularised logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_ROWS, seed: int = 5) -> Model:
    """Learn lexicon and regression from at most about ``most`` labelled rows.

    Rows without a label are left out, null texts are empty, very long ones are
    read whole.  Repeated rows and near copies count once in the lexicon; of near
    copies the least list of terms stands for all, so the same rows give the same
    model.  Terms of equal weight go by name.  All terms that pass the thresholds
    are kept.  With no rows, or with one class alone, the model has no terms and
    scores every text with the (smoothed) rate of toxic rows.
    """
    # Written once: the texts are read by two passes below, and the sample is all that they need of the corpus.
    rows = stored(hash_sample(pick(labelled, id=id_col, text=text_col, label=label_col).where("label IS NOT NULL"), ["id", "text"], most, seed), "labelled")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch, label, terms, held = [], [], [], 0
            for i in range(b.num_rows):
                words = _WORD.findall((b.column(1)[i].as_py() or "").lower())
                seen = set(words)
                sketch.append(_sketch(words))
                label.append(int(b.column(2)[i].as_py() != 0))
                terms.append(sorted(seen | {f"{w[:n]}-" for w in seen for n in STEMS if len(w) >= n}))
                held += len(terms[-1])
                if held > LISTED or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(sketch, pa.int64()), pa.array(label, pa.int32()), pa.array(terms, pa.list_(pa.string()))], names=["sketch", "label", "found"])
                    sketch, label, terms, held = [], [], [], 0

    one_each = rows.mapInArrow(sketches, "sketch long, label int, found array<string>").groupBy("sketch", "label").agg(F.min("found").alias("found"))
    one_each = one_each.persist()
    totals = {r.label: r.n for r in one_each.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        one_each.unpersist()
        bias = float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else -30.0
        return Model(Lexicon({}, {}), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), bias)
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    found = (
        one_each.select("label", F.explode("found").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"))
        .where((F.col("c1") >= max(3, round(0.006 * n1))) & (F.col("c1") * n0 >= 6 * F.col("c0") * n1))
        .withColumn("odds", odds)
        .where("odds > 2")
        .orderBy("term")
        .collect()  # terms of the sample's toxic rows that 0.6 % of these share
    )
    one_each.unpersist()
    lexicon = Lexicon(*_distinct_terms([(r.term, r.c1, r.odds / 4) for r in found]))
    blank = Model(lexicon, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(blank)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([int(v.as_py() != 0) for v in b.column(2)], pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    sample = rows.mapInArrow(measured, "y int, x array<double>").toPandas()  # FEATURES numbers for each of ``most`` rows
    x, y = np.array(sample["x"].tolist()), sample["y"].to_numpy(float)
    return Model(lexicon, *_regression(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), n_hits, terms (found in the whole text, in order) for each row.

    Null and empty texts get the score of a text without hits.  Equal texts get
    equal scores, so repeated rows do; other columns are not read, whatever
    their names.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x, terms, counts = [], [], []
            for t in b.column(1):
                text = t.as_py()
                hits, n = own.hits(text) if text else ([], 0)
                x.append(own.weigh(hits, n))
                counts.append(len(hits))
                terms.append([f"{k}:{v}" for k, v in sorted(Counter(h[1] for h in hits).items())])
            p = own.scores(np.array(x).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(counts, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=[id_col, "score", "n_hits", "terms"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double, n_hits long, terms array<string>")


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled rows of the folds to learn from: crc32 of the id's text modulo 5 is not 0."""
    known = pick(labels, id=id_col, toxic="toxic").where((fold(F.col("id"), 5) != 0) & F.col("toxic").isNotNull() & F.col("id").isNotNull())
    # One label an id: toxic if any of its labels says so.  Only sampled ids meet the texts, and equal rows count once.
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = hash_sample(known, ["id"], SAMPLE_ROWS, 5)
    return pick(docs, id=id_col, text=text_col).join(small(known, SAMPLE_ROWS * 2), "id").dropDuplicates(["id", "text"])


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; all columns stay as they are, whatever their names.

    The rows go through the scorer whole, so nothing is joined by id: null ids
    and repeated rows are rows like any other.  Null and empty texts have no hits.
    An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x = np.array([own.features(t.as_py()) for t in b.column(place)]).reshape(-1, FEATURES)
            yield b.filter(pa.array(own.scores(x) < cut))

    # By place, since a name may hold a dot.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
