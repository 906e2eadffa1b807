"""Token ids in files: frequency-ranked ids in bytes of variable number, with control bytes apart.

A rank takes 1 to 4 bytes; the lengths of four ranks are one control byte.  All
control bytes of a block come first, then all data bytes, so a table that gives
the four lengths of each control byte decodes a block by numpy lookups alone.

Documents are dealt to parts by ranges of their id and encoded in order; each
part is one file of blocks.  Ranks need counts over all documents, so a part is
first written as a draft, and when the counts are known each draft is coded
anew and removed.  A file gets its name by a rename, and a task that finds its
draft gone takes the file as it is: tasks may run again at any time.  The index
holds a row for each block, so blocks are read wherever there is room.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import pick, scratch, small, stored

#: A block is closed once it holds so many ids; a document is never cut, so a longer one is a block of its own.
BLOCK_IDS = 500_000
#: Rows of counts that reach the driver.
FAN = 16
#: Words that a Python worker remembers at most (about 200 bytes each).
MEMO = 800_000
#: Fixed values of the file format: names of a draft and a coded block, then documents, ids, and bytes of the data.
DRAFT, CODED = b"VLDRAFT1", b"VLCODED1"
HEAD = struct.Struct("<8sQQQ")

#: The lengths of four ranks by control byte, and what to keep of four bytes by length.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

#: White space before a space does not end a word; texts that hold it are cut by the second pattern.
_MIXED, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")

INDEX = "part int, block long, name string, at long, size long, docs long, ids long, before long"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.ravel()[: len(ranks)] = length - 1
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that :func:`pack` coded."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    padded = np.frombuffer(data + bytes(4), np.uint8)
    # Four bytes from every place of the data, the surplus masked away.
    words = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(data) + 1,), (1,))
    return words[at] & KEEP[length]


class Words:
    """Ids of texts by the tokenizers library.

    A space after a character that is not white space always begins a new piece
    of a byte-level tokenizer, so texts are cut there and each different word is
    encoded once, many in one call; the places where the words part are found
    again by the bytes that each id stands for.  Any other tokenizer gets whole
    texts.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = tokenizer
        self._ready = False

    def __getstate__(self):
        return {"tokenizer": self.tokenizer, "_ready": False}

    def _start(self) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.tokenizer)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        told = json.loads(self.tokenizer)
        cut = told.get("pre_tokenizer") or {}
        self.by_word = told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
        for piece, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(piece)  # one character a byte
        #: Ids of words that follow a space, which of these came again, and ids of words that begin a text.
        self.memo: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.first: dict[str, bytes] = {}
        self._ready = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode words that follow a space."""
        # White space at the end would join with the next word; such words are few.
        odd = [w for w in words if not w or w[-1].isspace()]
        joined = list(set(words).difference(odd)) if odd else words
        for at in range(0, len(joined), 20_000):
            part = joined[at : at + 20_000]
            text = " " + " ".join(part)
            ids = np.frombuffer(self._whole([text])[0], "<u4")
            reached = np.cumsum(self.bytes_of[ids])
            # A word ends where the next space is, unless words of mixed white space hold spaces themselves.
            whole = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(whole == 32)[1:], len(whole))
            if len(ends) != len(part):
                ends = np.cumsum([1 + len(w.encode()) for w in part])
            cut = np.searchsorted(reached, ends) + 1
            if not len(ids) or cut[-1] != len(ids) or (reached[cut - 1] != ends).any():
                raise RuntimeError("the tokenizer joins words over a space")
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, [0, *cut], cut))))
        self.memo.update(zip(odd, self._whole([" " + w for w in odd])))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null is empty."""
        if not self._ready:
            self._start()
        texts = [(t or "").encode("utf-8", "replace").decode() for t in texts]
        if not self.by_word:
            return self._whole(texts)
        cut = [text.split(" ") if _MIXED.search(text) is None else [w[i > 0 :] for i, w in enumerate(_CUT.split(text))] for text in texts]
        met = set().union(*cut)
        fresh = met.difference(self.memo)
        self.again.update(met.difference(fresh))
        if len(self.memo) + len(fresh) > MEMO:
            # Words that came once only are forgotten, and at least half of the room is free again.
            self.memo = {w: self.memo[w] for w in itertools.islice(self.again, MEMO // 2)}
            self.again = set()
            self.first.clear()
            fresh = met.difference(self.memo)
        self._learn(list(fresh))
        heads = list({words[0] for words in cut} - self.first.keys())
        self.first.update(zip(heads, self._whole(heads)))
        return [self.first[words[0]] + b"".join(map(self.memo.__getitem__, words[1:])) for words in cut]


def load(path: str | None = None) -> Words:
    """The encoder of a tokenizer file, read on the driver."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return Words(file.read())


def _block(kind: bytes, ids: list[int | None], lengths: np.ndarray, control: bytes, data: bytes) -> bytes:
    none = np.array([i is None for i in ids], np.uint8)
    keys = np.array([0 if i is None else i for i in ids], "<i8")
    return b"".join([HEAD.pack(kind, len(ids), int(lengths.sum()), len(data)), keys.tobytes(), none.tobytes(), lengths.astype("<i8").tobytes(), control, data])


def _parse(raw: bytes) -> tuple[bytes, list[int | None], np.ndarray, np.ndarray]:
    """Kind, document ids, lengths and numbers of a block."""
    kind, docs, n, size = HEAD.unpack_from(raw)
    at = HEAD.size
    keys = np.frombuffer(raw, "<i8", docs, at).tolist()
    none = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).tolist()
    lengths = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    if kind == DRAFT:
        numbers = np.frombuffer(pa.decompress(raw[at : at + size], 4 * n, codec="zstd") if n else b"", "<u4")
    else:
        control = -(-n // 4)
        numbers = unpack(raw[at : at + control], raw[at + control : at + control + size], n)
    return kind, [None if gone else key for key, gone in zip(keys, none)], lengths, numbers


def _put(folder: str, name: str, blocks: Iterator[bytes]) -> list[tuple[int, int]]:
    """Write a file of blocks under a name of its own, then rename it; place and size of each block."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own, found, at = f"{root}/.{uuid.uuid4().hex}", [], 0
    with fs.open_output_stream(own) as out:
        for b in blocks:
            out.write(b)
            found.append((at, len(b)))
            at += len(b)
    fs.move(own, f"{root}/{name}")
    return found


def _get(folder: str, name: str, at: int, size: int) -> bytes:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as file:
        return file.read_at(size, at)


def _exists(folder: str, name: str) -> bool:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    return fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.File


def _heads(folder: str, name: str) -> Iterator[tuple[int, int, int, int]]:
    """Place, size, documents and ids of each block of a file."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as file:
        at, whole = 0, file.size()
        while at < whole:
            kind, docs, n, data = HEAD.unpack(file.read_at(HEAD.size, at))
            size = HEAD.size + 17 * docs + data + (-(-n // 4) if kind == CODED else 0)
            yield at, size, docs, n
            at += size


def _added(counts: DataFrame, rows: int) -> DataFrame:
    """Counts (token, n), a row a file, added up to FAN rows, in two levels where there are many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for token, n in zip(b.column(0), b.column(1)):
                at = np.asarray(token.values)
                if len(at):
                    total = np.pad(total, (0, max(0, int(at[-1]) + 1 - len(total))))
                    total[at] += np.asarray(n.values)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([total[used].tolist()], pa.list_(pa.int64()))], names=["token", "n"])

    for parts in sorted({FAN, max(FAN, math.isqrt(rows))}, reverse=True):
        counts = counts.repartition(parts).mapInArrow(add, "token array<long>, n array<long>")
    return counts


@dataclass(frozen=True)
class TokenFiles:
    """Files of ids in ``folder``: an index row for each block, and the id of each rank."""

    folder: str
    index: DataFrame
    ranked: np.ndarray
    id_col: str
    id_type: str


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", encoder: Words | None = None, end: int | None = 2, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Write the ids of all ``docs`` to files in ``folder``, in ascending order of document.

    ``id_col`` holds whole numbers; null ids come first, rows of one id are
    ordered by a hash of their text and each is a document of its own.  A null
    text is empty; each document ends in the id ``end`` if that is given.  Whole
    texts are encoded, however long; an empty table makes no block.  Other
    columns are not read, whatever their names.  Ranks are by the counts over
    all documents, ties by id; ids that never occur come last.
    """
    spark = docs.sparkSession
    encoder = encoder or load()
    shared = spark.sparkContext.broadcast(encoder)
    rows = pick(docs, id=id_col, text=text_col)
    # Rows that are the same are dealt apart by their place, so no id or text makes a large part.
    keyed = rows.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), F.col("mark").asc(), F.col("place").asc()]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, found = shared.value, TaskContext.get().partitionId(), []
        counts = np.zeros(0, np.int64)

        def close(ids: list[int | None], texts: list[bytes]) -> bytes:
            nonlocal counts
            raw = b"".join(texts)
            seen = np.bincount(np.frombuffer(raw, "<u4"), minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            found.append((len(ids), int(lengths.sum())))
            return _block(DRAFT, ids, lengths, b"", pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")

        def blocks() -> Iterator[bytes]:
            ids, texts, held = [], [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    for i, t in zip(b.column(0).to_pylist(), own.encode_batch(b.column(1).to_pylist())):
                        ids.append(i)
                        texts.append(t + tail)
                        held += len(texts[-1])
                        if held >= 4 * block_ids:
                            yield close(ids, texts)
                            ids, texts, held = [], [], 0
            if ids:
                yield close(ids, texts)

        name = f"part-{part:06d}.draft"
        if _put(folder, name, blocks()):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([sum(n for _, n in found)], pa.int64()), pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([counts[used].tolist()], pa.list_(pa.int64()))],
                names=["part", "name", "ids", "token", "n"],
            )

    drafts = stored(dealt.mapInArrow(draft, "part int, name string, ids long, token array<long>, n array<long>"), "drafts")
    told = json.loads(encoder.tokenizer)
    ranked = np.arange(1 + max([end or 0, *told["model"]["vocab"].values(), *(t["id"] for t in told.get("added_tokens", []))]))
    weight = np.zeros(len(ranked), np.int64)
    for r in _added(drafts.select("token", "n"), drafts.count()).collect():  # FAN rows of an entry an id
        weight[r.token] += np.array(r.n, np.int64)
    ranked = ranked[np.argsort(-weight, kind="stable")].astype("<u4")
    rank = np.empty(len(ranked), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    _put(folder, "ranked.ids", iter([ranked.tobytes()]))
    table = spark.sparkContext.broadcast(rank)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                final = name.replace(".draft", ".ids")

                def blocks(name: str = name) -> Iterator[bytes]:
                    for at, size, _, _ in _heads(folder, name):
                        _, ids, lengths, numbers = _parse(_get(folder, name, at, size))
                        yield _block(CODED, ids, lengths, *pack(table.value[numbers]))

                if _exists(folder, name):
                    _put(folder, final, blocks())
                    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                    try:
                        fs.delete_file(f"{root}/{name}")
                    except FileNotFoundError:
                        pass  # another attempt at this task was first
                found = list(_heads(folder, final))
                before = np.cumsum([0, *(n for *_, n in found)]).tolist()
                columns = [[part] * len(found), range(len(found)), [final] * len(found), *zip(*found), before[:-1]]
                kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

    parts = drafts.select("part", "ids").collect()  # a row a file
    starts, total = [], 0
    for r in sorted(parts):
        starts.append((r.part, total))
        total += r.ids
    files = drafts.select("part", "name").repartition(max(1, len(parts)), "part")
    index = files.mapInArrow(code, INDEX).join(small(spark.createDataFrame(starts, "part int, start long"), len(starts)), "part")
    return TokenFiles(folder, stored(index.withColumn("start", F.col("start") + F.col("before")).drop("before"), "index", len(parts)), ranked, id_col, rows.schema["id"].dataType.simpleString())


def read(files: TokenFiles) -> DataFrame:
    """id, start, n_tokens, ids of each document in the files: ids as little-endian unsigned 32-bit numbers, ``start`` counts those of all documents before it."""
    spark, folder = files.index.sparkSession, files.folder
    table = spark.sparkContext.broadcast(files.ranked)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                _, ids, lengths, numbers = _parse(_get(folder, name, at, size))
                ends = np.cumsum(lengths)
                raw = table.value[numbers].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array([raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())],
                    names=["id", "start", "n_tokens", "ids"],
                )

    blocks = files.index.select("name", "at", "size", "start").repartition("name", "at")
    found = blocks.mapInArrow(decode, "id long, start long, n_tokens long, ids binary")
    return found.select(F.col("id").cast(files.id_type).alias(files.id_col), "start", "n_tokens", "ids")


def token_files(docs: DataFrame, **options) -> TokenFiles:  # noqa: ANN003
    """:func:`write` to a fresh folder of the shared one."""
    return write(docs, scratch(docs.sparkSession, "ids"), **options)
