"""Images in folders, tar and zip archives as one data source, read by byte ranges.

The driver reads the index alone: the listing of a folder, the headers of a tar
archive, the directory of a zip archive.  Ids follow the sorted names, labels the
sorted class names, and both travel with the ranges, so nothing is shuffled to
attach them.  Members are dealt to ranges of about ``rangeBytes``; a task opens
the file and reads its members where they are, so one archive fills many tasks
whatever its size.  A compressed tar archive can't be entered in the middle: it
is one task.

Paths are what ``pyarrow.fs`` opens; for stores that Spark's readers alone reach,
:func:`vecloom.sources.files.image_folder` reads folders by shuffles.
"""

from __future__ import annotations

import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of the members that a task holds at once.
RANGE_BYTES = 64 * 2**20
HELD_BYTES = 16 * 2**20
#: What an image's name ends in, and the size of a zip member's header before its names.
IMAGES = r"(?i).*\.(jpg|jpeg|png|ppm|bmp|pgm|tif|tiff|webp)$"
ZIP_HEADER = struct.Struct("<4s5HIIIHH")

SCHEMA = "id long, class_name string, label int, file string, name string, content binary"


@dataclass(frozen=True)
class Member:
    """A member of a file: where its bytes are, and how they are packed (0 plain, 8 deflated, -1 within a compressed tar)."""

    file: str
    name: str
    at: int
    size: int
    packing: int = 0


def _open(path: str):  # noqa: ANN202
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(root)


def _kind(path: str) -> str:
    low = path.lower()
    return "tar" if low.endswith(".tar") else "packed" if low.endswith((".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")) else "zip" if low.endswith(".zip") else "plain"


def _safe(file: str, name: str) -> str:
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{file}: {name} leaves the archive")
    return name


def _of_archive(path: str) -> Iterator[Member]:
    kind = _kind(path)
    with _open(path) as file:
        if kind == "zip":
            for m in zipfile.ZipFile(pa.PythonFile(file, "r")).infolist():
                if not m.is_dir():
                    if m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or m.flag_bits & 1:
                        raise ValueError(f"{path}: {m.filename} is packed in a way that can't be read")
                    yield Member(path, _safe(path, m.filename), m.header_offset, m.compress_size, m.compress_type)
        else:
            with tarfile.open(fileobj=pa.PythonFile(file, "r") if kind == "tar" else _stream(file), mode="r:" if kind == "tar" else "r|*") as tar:
                for m in tar:
                    if m.isfile():
                        yield Member(path, _safe(path, m.name), m.offset_data, m.size, 0 if kind == "tar" else -1)


def _stream(file):  # noqa: ANN001, ANN202
    """A file as tarfile reads streams."""
    return pa.PythonFile(file, "r")


def members(path: str) -> list[Member]:
    """The members of an archive, of all archives of a folder, or the files of a folder, by name."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        found = list(_of_archive(path))
    else:
        files = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if i.type == pyarrow.fs.FileType.File]
        prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
        found = [m for i in files if _kind(i.path) != "plain" for m in _of_archive(prefix + i.path)]
        found += [Member(prefix + i.path, i.path[len(root) :].lstrip("/"), 0, i.size) for i in files if _kind(i.path) == "plain"]
    return sorted(found, key=lambda m: (m.name, m.file))


def class_of(name: str, split: str | None) -> str:
    """The folder that names an image's class: below the split's folder, or the innermost one."""
    parts = name.split("/")[:-1]
    if split and split in parts and parts.index(split) + 1 < len(parts):
        return parts[parts.index(split) + 1]
    return parts[-1] if parts else ""


def payload(file, m: Member) -> bytes:  # noqa: ANN001
    """The bytes of a member that can be read where they are."""
    at = m.at
    if _kind(m.file) == "zip":
        head = ZIP_HEADER.unpack(file.read_at(ZIP_HEADER.size, at))
        at += ZIP_HEADER.size + head[-2] + head[-1]
    raw = file.read_at(m.size, at)
    return zlib.decompress(raw, -15) if m.packing == 8 else raw


@dataclass
class Range(InputPartition):
    """Members of one file, with their ids, classes and labels."""

    file: str
    rows: list[tuple[int, str, int, Member]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = options.get("split")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.pattern = options.get("pattern", IMAGES)

    def partitions(self) -> list[Range]:
        wanted = [m for m in members(self.path) if re.fullmatch(self.pattern, m.name)]
        if self.split:
            wanted = [m for m in wanted if self.split in m.name.split("/")[:-1] or class_of(m.name, None) == ""]
        named = [class_of(m.name, self.split) for m in wanted]
        label = {c: i for i, c in enumerate(sorted(set(named)))}
        rows = [(i, c, label[c], m) for i, (c, m) in enumerate(zip(named, wanted))]
        out: list[Range] = []
        # In the order of the bytes, so that a range is read from front to back; plain files share ranges.
        held = 0
        of = {m.file: "" if _kind(m.file) == "plain" else m.file for m in wanted}
        for row in sorted(rows, key=lambda r: (of[r[3].file], r[3].at, r[0])):
            m = row[3]
            group = of[m.file]
            if not out or out[-1].file != group or (held + m.size > self.range_bytes and m.packing != -1):
                out.append(Range(group, []))
                held = 0
            out[-1].rows.append(row)
            held += m.size
        return out or [Range("", [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row, content in self._contents(partition):
            rows.append((*row[:3], row[3].file, row[3].name, content))
            size += len(content)
            if size >= HELD_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _contents(part: Range) -> Iterator[tuple[tuple, bytes]]:
        if part.rows and part.rows[0][3].packing == -1:
            by_name = {row[3].name: row for row in part.rows}
            with _open(part.file) as file, tarfile.open(fileobj=_stream(file), mode="r|*") as tar:
                for m in tar:
                    if m.isfile() and m.name in by_name:
                        yield by_name[m.name], tar.extractfile(m).read()
        elif part.file:
            with _open(part.file) as file:
                for row in part.rows:
                    yield row, payload(file, row[3])
        else:
            for row in part.rows:
                with _open(row[3].file) as file:
                    yield row, payload(file, row[3])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


class ImageArchive(DataSource):
    """``spark.read.format("image_archive").option("split", ...).load(path)``; options ``rangeBytes`` and ``pattern`` (of member names)."""

    @classmethod
    def name(cls) -> str:
        return "image_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def images(spark: SparkSession, path: str, split: str | None = None, range_bytes: int = RANGE_BYTES, classes: int | None = None, prefix: str = "") -> DataFrame:
    """id, class_name, label, file, name, content of the images of a folder or archive.

    ``classes`` and ``prefix`` say how many classes there must be and what their
    names begin with; a layout of class folders directly below the root needs no
    split.
    """
    spark.dataSource.register(ImageArchive)
    reader = spark.read.format("image_archive").option("rangeBytes", str(range_bytes))
    rows = (reader.option("split", split) if split else reader).load(path)
    if classes is not None:
        checked_classes(rows, classes, prefix)
    return rows


def checked_classes(rows: DataFrame, expected: int, prefix: str = "") -> DataFrame:
    """``rows``, if they have the expected number of classes, all beginning with the prefix."""
    n, odd = rows.agg(F.count_distinct("class_name"), F.count_if(~F.col("class_name").startswith(prefix))).first()
    if n != expected or odd:
        raise ValueError(f"{n} classes, {odd} rows of classes that don't begin with '{prefix}'; expected {expected} classes")
    return rows
