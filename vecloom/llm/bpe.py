"""Byte-level BPE encoding and decoding.

A piece's bytes are the leaves of a segment tree whose nodes hold the leftmost
minimum rank of the pairs below them.  A merge takes the pair at the root and
makes three point updates on the way up: the merged pair, the pair of its left
live neighbour, and the pair that is gone.  Pieces of like length run through
one stack of trees in step, so each point update is one numpy operation over all
of them; a very long piece runs alone through a plain array.  Pieces that were
seen before are looked up.
"""

from __future__ import annotations

import array
import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecloom.llm.common import pick

NONE = 2**62
#: Pieces of more bytes run alone.
STACKED = 256
#: Seen pieces that a Python worker remembers; then it starts anew.
MEMO = 300_000
_LONG = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes, of a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """The encoding of one vocabulary: ``ranks`` by bytes, ``pattern`` to cut texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self._ready = False

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "byte": self.byte, "pairs": self.pairs, "pair_rank": self.pair_rank, "_ready": False}

    def _start(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.split = regex.compile(self.pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pair_dict = None
        self._ready = True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def _stack(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Encode pieces of 2 to ``leaves`` bytes in step; ids as little-endian unsigned 32-bit numbers."""
        m = len(pieces)
        n = np.array([len(p) for p in pieces])
        raw = np.zeros((m, leaves), np.uint8)
        for i, p in enumerate(pieces):
            raw[i, : len(p)] = np.frombuffer(p, np.uint8)
        token = np.concatenate([self.byte[raw], np.zeros((m, 1), np.int64)], axis=1)
        position = np.arange(leaves)
        # A node holds rank * leaves + position, so the smallest is the leftmost of the least rank.
        tree = np.full((m, 2 * leaves), NONE, np.int64)
        rank = np.full((m, leaves), NONE, np.int64)
        rank[:, :-1] = self._rank(token[:, : leaves - 1], token[:, 1:leaves])
        rank[position[None, :] >= n[:, None] - 1] = NONE
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + position, NONE)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        after = np.minimum(np.tile(position + 1, (m, 1)), n[:, None])
        before = np.tile(position - 1, (m, 1))
        before = np.concatenate([before, np.zeros((m, 1), before.dtype)], axis=1)
        alive = position[None, :] < n[:, None]

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            at = at + leaves
            tree[row, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            top = tree[row, 1]
            i, new = top % leaves, top // leaves
            j = after[row, i]
            k = after[row, j]
            token[row, i] = new
            alive[row, j] = False
            after[row, i] = k
            inner = k < n[row]
            before[row, np.where(inner, k, leaves)] = i
            right = np.where(inner, self._rank(new, token[row, np.minimum(k, leaves)]), NONE)
            put(row, j, np.full(len(row), NONE))
            put(row, i, np.where(right < NONE, right * leaves + i, NONE))
            h = before[row, i]
            has = h >= 0
            if has.any():
                r, h, t = row[has], h[has], new[has]
                left = self._rank(token[r, h], t)
                put(r, h, np.where(left < NONE, left * leaves + h, NONE))
            row = row[tree[row, 1] < NONE]
        flat = token[:, :leaves][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _alone(self, piece: bytes) -> bytes:
        """Encode one long piece."""
        if self.pair_dict is None:
            self.pair_dict = dict(zip(self.pairs.tolist(), self.pair_rank.tolist()))
        rank_of, n = self.pair_dict, len(piece)
        leaves = 1 << (n - 1).bit_length()
        token = array.array("q", self.byte[np.frombuffer(piece, np.uint8)].tobytes())
        t = np.frombuffer(token, np.int64)
        tree_np = np.full(2 * leaves, NONE, np.int64)
        rank = self._rank(t[:-1], t[1:])
        tree_np[leaves : leaves + n - 1] = np.where(rank < NONE, rank * leaves + np.arange(n - 1), NONE)
        level = leaves
        while level > 1:
            half = level // 2
            tree_np[half:level] = np.minimum(tree_np[level : 2 * level : 2], tree_np[level + 1 : 2 * level : 2])
            level = half
        tree = array.array("q", tree_np.tobytes())
        after, before = array.array("q", range(1, n + 1)), array.array("q", range(-1, n))
        alive = bytearray(b"\x01" * n)

        def put(at: int, value: int) -> None:
            at += leaves
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b

        while (top := tree[1]) < NONE:
            new, i = divmod(top, leaves)
            j = after[i]
            k = after[j]
            token[i], alive[j], after[i] = new, 0, k
            put(j, NONE)
            right = None
            if k < n:
                before[k] = i
                right = rank_of.get(new << 32 | token[k])
            put(i, NONE if right is None else right * leaves + i)
            if (h := before[i]) >= 0:
                left = rank_of.get(token[h] << 32 | new)
                put(h, NONE if left is None else left * leaves + h)
        return np.frombuffer(token, np.int64)[np.frombuffer(alive, np.uint8) == 1].astype("<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that were not seen before and remember them."""
        waiting: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                self.memo[p] = rank.to_bytes(4, "little")
            elif len(raw) > STACKED:
                self.memo[p] = self._alone(raw)
            else:
                waiting.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for leaves, found in waiting.items():
            step = max(1, 400_000 // leaves)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                self.memo.update(zip((p for p, _ in part), self._stack([raw for _, raw in part], leaves)))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a whole text; of a very long one block by block."""
        if len(text) <= _LONG:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(itertools.islice(found, 200_000)):
            yield block

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers; null encodes as empty."""
        if not self._ready:
            self._start()
        cut: list[list[str]] = []
        out: list[bytes] = []

        def flush() -> None:
            fresh = [p for p in set(itertools.chain.from_iterable(cut)) if p not in self.memo]
            if len(self.memo) + len(fresh) > MEMO:
                self.memo.clear()
                fresh = set(itertools.chain.from_iterable(cut))
            self.learn(fresh)
            out.extend(b"".join(map(self.memo.__getitem__, pieces)) for pieces in cut)
            cut.clear()

        held = 0
        for text in texts:
            if text is not None and len(text) > _LONG:
                flush()
                parts = []
                for block in self._pieces(text):
                    cut.append(block)
                    flush()
                    parts.append(out.pop())
                out.append(b"".join(parts))
                continue
            cut.append(self.split.findall(text) if text else [])
            held += len(cut[-1])
            if held > 200_000:
                flush()
                held = 0
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, given as little-endian unsigned 32-bit numbers."""
        if not self._ready:
            self._start()
        numbers, part = np.frombuffer(ids, "<u4"), 500_000
        return b"".join(b"".join(map(self.bytes_of.__getitem__, numbers[at : at + part].tolist())) for at in range(0, len(numbers), part))


def load(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, read on the driver."""
    return Encoder(load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


#: What :func:`round_trip` can return of a text, beside its id and number of tokens.
OUTPUTS = {"ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Encoder | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id, n_tokens and ``outputs`` for each row of ``docs``.

    ``ids`` are the tokens of the whole text as little-endian unsigned 32-bit
    numbers, ``decoded`` the bytes that they decode to; ``ids_sha256`` and
    ``decoded_sha256`` are their lowercase digests, made where the text is, so
    that what is only hashed is never sent.  A null text is empty: no tokens.
    Ids may repeat or be null, and each row has its result; very long texts are
    read whole; other columns are not read, whatever their names; an empty table
    gives an empty result.  The vocabulary (of a fixed size) goes to the
    executors once.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}; known: {', '.join(OUTPUTS)}")
    shared = docs.sparkSession.sparkContext.broadcast(encoder or load())
    rows = pick(docs, id=id_col, text=text_col)

    def described(own: Encoder, ids: list[bytes]) -> Iterator[pa.Array]:
        decoded = [own.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & set(outputs) else []
        for name in outputs:
            found = ids if name.startswith("ids") else decoded
            yield pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()) if name.endswith("sha256") else pa.array(found, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = own.encode_batch(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *described(own, ids)], names=[id_col, "n_tokens", *outputs])

    kinds = ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, {kinds}")
