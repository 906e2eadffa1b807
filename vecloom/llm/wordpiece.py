"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie.  Each node knows where matching goes on
when its next byte is missing (its failure link) and how many tokens greedy
longest match pops on the way, so a word is counted in one pass over its bytes
and no piece is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.bpe import load_ranks
from vecloom.llm.common import pick

MEMO = 400_000
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LONG = 4_000_000
_NONE = -1


class Automaton:
    """Counts the greedy longest-match pieces of words.

    ``first`` are pieces that may begin a word, ``rest`` those that may go on.
    A word that can't be cut into pieces counts as one unknown token.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        # Nodes 0 and 1 are the roots for the rest of a word and for its beginning.
        self.goto: dict[int, int] = {}
        depth, parent, ends = [0, 0], [(_NONE, 0), (_NONE, 0)], [False, False]
        for root, pieces in ((0, rest), (1, first)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 8 | c
                    if key not in self.goto:
                        self.goto[key] = len(depth)
                        depth.append(depth[node] + 1)
                        parent.append((node, c))
                        ends.append(False)
                    node = self.goto[key]
                if piece:
                    ends[node] = True
        n = len(depth)
        self.fail, self.popped = [_NONE] * n, [0] * n
        for node in sorted(range(2, n), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            up, c = parent[node]
            z, popped = self.fail[up], self.popped[up]
            while z != _NONE and z << 8 | c not in self.goto:
                popped += self.popped[z]
                z = self.fail[z]
            if z != _NONE:
                self.fail[node], self.popped[node] = self.goto[z << 8 | c], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; 0 for a word that can't be cut, and for an empty one."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node, n = 1, 0
        for c in word:
            while (after := goto.get(node << 8 | c)) is None:
                n += popped[node]
                node = fail[node]
                if node == _NONE:
                    return 0
            node = after
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node == _NONE:
                return 0
        return n


def load(path: str | None = None) -> Automaton:
    """Word pieces from a byte-level vocabulary: those with a leading space begin a word, the others go on."""
    pieces = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return Automaton([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", automaton: Automaton | None = None, mark: bytes = b" ") -> DataFrame:
    """id, n_words, n_tokens, n_unknown for each row.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``; each is
    counted with ``mark`` before it.  A word that can't be cut is one token, and
    counted in ``n_unknown``.  Null and empty texts have no words.  Whole texts
    are read, very long ones block by block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton or load())
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, {}

        def counts(words: list[bytes]) -> tuple[int, int, int]:
            fresh = [w for w in set(words) if w not in memo]
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
                fresh = set(words)
            for w in fresh:
                memo[w] = own.count(mark + w)
            found = list(map(memo.__getitem__, words))
            unknown = found.count(0)
            return len(words), sum(found) + unknown, unknown

        for b in batches:
            out = []
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                if len(raw) <= _LONG:
                    out.append(counts(raw.split()))
                    continue
                total, block = [0, 0, 0], []
                for m in _WORD.finditer(raw):
                    block.append(m.group())
                    if len(block) == 200_000:
                        total = [x + y for x, y in zip(total, counts(block))]
                        block = []
                out.append(tuple(x + y for x, y in zip(total, counts(block))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
