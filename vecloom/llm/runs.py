"""Periodic runs of words, by the runs theorem.

Every maximal repetition of a sequence holds a root that is the longest Lyndon
word at its place under one of two opposite orders.  With the suffixes ranked
once, that word ends at the next smaller rank, for the opposite order at the
next larger one.  So a sequence of n words has 2n candidates; each is extended
to the right by the longest common prefix of two suffixes and to the left by
that of two reversed prefixes, and is a run if it then spans its period twice.
Common prefixes are range minima of the LCP array, answered from a sparse table
that is built level by level, so that one level is held at a time.

Texts without any repeated stretch of half the least length are passed by.  All
others of a batch are one sequence: words of different texts are different
letters, and each text ends in the smallest letter of its own, so nothing
reaches from one text into the next.  A text whose words fill a batch is alone
in its batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.common import pick

#: A run has so many words at least, and two periods.
LEAST = 12
#: Words that are ranked together, unless one text has more.
WORDS = 200_000

SHAPE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def suffix_ranks(letters: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by prefix doubling; only suffixes that still tie are sorted again.

    No two suffixes may be equal over the whole array, which the end letters see to.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    head = np.ones(n, bool)
    head[1:] = letters[order[1:]] != letters[order[:-1]]
    # Tied suffixes share the place of the first of them.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = order[~(head & np.append(head[1:], True))]
    width = 1
    while len(tied):
        key = rank[tied] * (n + 1) + np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        place = np.arange(len(tied))
        first = np.ones(len(tied), bool)
        first[1:] = old[1:] != old[:-1]
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        # Within a tie the new rank is the old one plus the number of suffixes before.
        began = np.maximum.accumulate(np.where(first, place, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(head, place, 0)) - began
        tied = tied[~(head & np.append(head[1:], True))]
        width *= 2
    return rank


def common_prefixes(letters: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of the suffixes at ``a`` and ``b`` (a != b), pair by pair."""
    n = len(letters)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    lcp = _lcp(letters, rank, place)
    low, high = np.minimum(rank[a], rank[b]) + 1, np.maximum(rank[a], rank[b])
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    by_level = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[by_level], np.arange(int(level.max(initial=0)) + 2))
    table = lcp
    for k in range(len(ends) - 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = by_level[ends[k] : ends[k + 1]]
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
    return out


def _lcp(letters: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in rank: Kasai's walk over those whose first letters agree."""
    n = len(letters)
    lcp = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[place[1:]] = place[:-1]
    at = np.flatnonzero((before >= 0) & (letters == letters[before]))
    if len(at):
        text, prior, held, last = array("q", letters.tobytes()), array("q", before.tobytes()), 0, -2
        found = array("q", bytes(8 * len(at)))
        for k, i in enumerate(at.tolist()):
            # A suffix loses at most one letter of what the suffix before it shared.
            held = max(held - 1, 1) if i == last + 1 else 1
            j = prior[i]
            while i + held < n and j + held < n and text[i + held] == text[j + held]:
                held += 1
            found[k], last = held, i
        lcp[rank[at]] = np.frombuffer(found, np.int64)
    return lcp


def next_places(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one of smaller rank, and the next one of larger rank; n where there is none."""
    n = len(rank)
    values = rank.tolist()
    smaller, larger = array("q", [n]) * n, array("q", [n]) * n
    low: list[int] = []
    high: list[int] = []
    for i, v in enumerate(values):
        while low and values[low[-1]] > v:
            smaller[low.pop()] = i
        low.append(i)
        while high and values[high[-1]] < v:
            larger[high.pop()] = i
        high.append(i)
    return np.frombuffer(smaller, np.int64), np.frombuffer(larger, np.int64)


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) of the runs of each sequence of word numbers, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total = int((sizes + 1).sum())
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    if inside.any():
        words[inside] = np.concatenate(texts) + 1
    letters = np.unique(of * (int(words.max(initial=0)) + 1) + words, return_inverse=True)[1].astype(np.int64)
    rank = suffix_ranks(letters)
    smaller, larger = next_places(rank)
    at = np.flatnonzero(inside)
    i = np.concatenate([at, at])
    j = np.concatenate([smaller[at], larger[at]])
    within = j <= ends[of[i]]
    i, j = i[within], j[within]
    # Where neither the first letters nor those before agree, nothing extends the root.
    right = letters[i] == letters[j]
    left = (i > starts[of[i]]) & (letters[i - 1] == letters[j - 1])
    i, j, right, left = (v[right | left] for v in (i, j, right, left))
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    if right.any():
        ahead[right] = common_prefixes(letters, rank, i[right], j[right])
    if left.any():
        # Mirrored, each text is led by its own smallest letter; the ends stay apart because letters differ by text.
        mirror = letters[::-1].copy()
        back[left] = common_prefixes(mirror, suffix_ranks(mirror), total - i[left], total - j[left])
        back = np.minimum(back, i - starts[of[i]])
    period = j - i
    length = period + ahead + back
    kept = (length >= 2 * period) & (length >= least)
    rows = np.unique(np.stack([of[i], i - back - starts[of[i]], period, length], axis=1)[kept], axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b][:, [1, 3, 2]] for a, b in zip(cut[:-1], cut[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def repeating(texts: list[list[bytes]], words: int) -> np.ndarray:
    """Which texts may hold some stretch of so many words twice.

    A run of length n and period q has n - q, so at least n / 2, places whose
    word comes again q words on: a text without such a stretch has no run.
    Stretches are compared by a 64-bit hash, so a text may be named in vain but
    none is missed.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    one = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    n = len(one) - words + 1
    out = np.zeros(len(texts), bool)
    if n < 2:
        return out
    of = np.repeat(np.arange(len(texts)), sizes)
    mark = of[:n].astype(np.uint64)
    for k in range(words):
        mark = mark * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    mark = mark[of[:n] == of[words - 1 :]]
    of = of[:n][of[:n] == of[words - 1 :]]
    order = np.argsort(mark)
    again = mark[order[1:]] == mark[order[:-1]]
    out[of[order[1:][again]]] = True
    return out


def _described(texts: list[str | None], least: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs and collapsed text of each text."""
    # bytes.split() cuts at ASCII white space alone.
    cut = [(t or "").encode("utf-8", "replace").split() for t in texts]
    some = np.flatnonzero(repeating(cut, -(-least // 2))).tolist()
    codes = pd.factorize(np.array([w for i in some for w in cut[i]] + [b""], object))[0][:-1].astype(np.int64)
    ends = np.cumsum([len(cut[i]) for i in some]).tolist()
    found = dict(zip(some, runs_of([codes[b - len(cut[i]) : b] for i, b in zip(some, ends)], least) if some else []))
    none = np.zeros((0, 3), np.int64)
    for i, words in enumerate(cut):
        runs = found.get(i, none)
        if len(runs):
            words_left = [w for w, s in zip(words, kept_words(len(words), runs).tolist()) if s]
            yield len(words), runs, b" ".join(words_left)
        else:
            yield len(words), runs, b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, runs, collapsed for each row of ``docs``.

    ``runs`` are all maximal stretches of words with smallest period q that have
    ``least`` words and 2 q words at least, as (start, length, period) by start,
    then period.  ``collapsed`` is the text of the words that stay, joined by one
    space, in UTF-8: a word goes if a run holds it after the run's first period.
    Words are what ASCII white space parts.  A null or empty text has no words
    and no runs; a very long text is read whole, in a pass of its own; ids may
    repeat or be null, and each row has its result; an empty table gives an empty
    result.  Other columns are not read, whatever their names.
    """
    rows = pick(docs, id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A rough count of words cuts the batch into passes.
            size = [1 + (t.count(" ") + t.count("\n") if t else 0) for t in whole.column(1).to_pylist()]
            a = 0
            while a < whole.num_rows:
                b, held = a + 1, size[a]
                while b < whole.num_rows and held + size[b] <= WORDS:
                    held += size[b]
                    b += 1
                part = whole.slice(a, b - a)
                found = list(_described(part.column(1).to_pylist(), least))
                table = np.concatenate([runs for _, runs, _ in found])
                offsets = np.cumsum([0, *(len(runs) for _, runs, _ in found)]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(table[:, c]) for c in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans, type=kind), pa.array([c for _, _, c in found], pa.binary())],
                    names=[id_col, "n_words", "runs", "collapsed"],
                )
                a = b

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, {SHAPE}")
