"""Archives and folders by byte ranges, fingerprints and manifests."""

import io
import os
import tarfile
import zipfile

import pytest
from vecloom.sources import archives, fingerprints

FILES = {f"train/{c}/{i}.png": f"{c}{i}".encode() * (50 * i + 1) for c in ("dog", "ant", "cat") for i in range(7)} | {"train/readme.txt": b"no image", "test/ant/0.png": b"other split"}


def rows_of(frame):
    return sorted((r.id, r.class_name, r.label, r.name, bytes(r.content)) for r in frame.collect())


def wanted():
    names = sorted(n for n in FILES if n.startswith("train/") and n.endswith(".png"))
    return [(i, n.split("/")[1], ["ant", "cat", "dog"].index(n.split("/")[1]), n, FILES[n]) for i, n in enumerate(names)]


def make(kind, root):
    if kind == "folder":
        for n, raw in FILES.items():
            os.makedirs(f"{root}/data/{os.path.dirname(n)}", exist_ok=True)
            with open(f"{root}/data/{n}", "wb") as f:
                f.write(raw)
        return f"{root}/data"
    path = f"{root}/data.{kind}"
    if kind.startswith("zip"):
        path = f"{root}/data.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if kind == "zip deflated" else zipfile.ZIP_STORED) as z:
            for n, raw in FILES.items():
                z.writestr(n, raw)
    else:
        with tarfile.open(path, "w:gz" if kind == "tar.gz" else "w") as t:
            for n, raw in FILES.items():
                info = tarfile.TarInfo(n)
                info.size = len(raw)
                t.addfile(info, io.BytesIO(raw))
    return path


@pytest.mark.parametrize("kind", ["folder", "tar", "tar.gz", "zip", "zip deflated"])
def test_images_of_any_container(spark, tmp_path, kind):
    path = make(kind, str(tmp_path))
    found = archives.images(spark, path, "train", range_bytes=100)
    assert rows_of(found) == wanted()
    assert found.rdd.getNumPartitions() == 1 if kind == "tar.gz" else found.rdd.getNumPartitions() > 1
    assert archives.images(spark, path, "train", classes=3).count() == 21
    with pytest.raises(ValueError):
        archives.images(spark, path, "train", classes=4)
    with pytest.raises(ValueError):
        archives.images(spark, path, "train", classes=3, prefix="n0")


def test_a_member_larger_than_a_range_is_whole(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/big.tar", "w") as t:
        for i, size in enumerate((5, 70_000, 3)):
            info = tarfile.TarInfo(f"c{i}/x.png")
            info.size = size
            t.addfile(info, io.BytesIO(bytes([i]) * size))
    got = archives.images(spark, f"{tmp_path}/big.tar", range_bytes=100).collect()
    assert sorted((r.class_name, len(r.content)) for r in got) == [("c0", 5), ("c1", 70_000), ("c2", 3)]


def test_folders_of_archives_and_empty_ones(spark, tmp_path):
    os.makedirs(f"{tmp_path}/all/none")
    make("tar", f"{tmp_path}/all")
    assert rows_of(archives.images(spark, f"{tmp_path}/all", "train")) == wanted()
    assert archives.images(spark, f"{tmp_path}/all/none").collect() == []


def test_names_that_leave_an_archive_are_refused(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/bad.tar", "w") as t:
        t.addfile(tarfile.TarInfo("../x.png"), io.BytesIO())
    with pytest.raises(Exception, match="leaves the archive"):
        archives.images(spark, f"{tmp_path}/bad.tar").collect()
    with pytest.raises(Exception, match="none.tar"):
        archives.images(spark, f"{tmp_path}/none.tar").collect()


def test_fingerprints_of_rows(spark):
    rows = [(1, "a", None), (2, None, 0.5), (2, None, 0.5), (3, "b|c", 1.0)]
    of = lambda r, schema="id long, `x.y` string, w double": fingerprints.of_rows(spark.createDataFrame(r, schema))
    assert of(rows) == of(rows[::-1]) == fingerprints.of_rows(spark.createDataFrame(rows, "id long, `x.y` string, w double").repartition(3))
    assert len({of(rows), of(rows[:3]), of(rows[:2] + rows[3:]), of([(1, None, None), *rows[1:]]), of([]), of(rows, "id long, z string, w double")}) == 6


def test_manifests_read_new_files_alone(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.bin").write_bytes(bytes([i]) * 10)
    first = fingerprints.manifest(spark, str(root)).cache()
    assert first.count() == 4 and fingerprints.of_manifest(first) == fingerprints.of_manifest(fingerprints.manifest(spark, str(root)))
    # A digest that an earlier manifest holds is taken as it is: the file is not read.
    marked = first.withColumn("digest", first.digest.substr(1, 0)).cache()
    assert {r.digest for r in fingerprints.manifest(spark, str(root), marked).collect()} == {""}
    (root / "4.bin").write_bytes(b"new")
    (root / "0.bin").unlink()
    second = fingerprints.manifest(spark, str(root), first).cache()
    assert second.count() == 4 and fingerprints.of_manifest(second) != fingerprints.of_manifest(first)
    assert fingerprints.of_manifest(second) == fingerprints.of_manifest(fingerprints.manifest(spark, str(root)))


def test_kept_samples_match_their_manifest(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(b"x")
    samples = spark.createDataFrame([(f"{tmp_path}/{i}.png",) for i in range(3)], "path string")
    check = lambda s=samples, f="a", n=3: fingerprints.matches(spark, s, "a", n, f, str(tmp_path))
    assert check() and not check(f="b") and not check(n=4)
    (tmp_path / "1.png").unlink()
    assert not check()
