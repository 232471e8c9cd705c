"""Archives as a data source: a task for each member, rows with archive and place."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from phonoweave.sources import archives, corpora


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"d/": b"", "d/two.txt": "二\n".encode(), "d/one.txt": b"", "x.bin": b"\xff"}))
    (tmp_path / "b.tar").write_bytes(tarred({"n.zip": zipped({"q.txt": b"q", "p.txt": b"p"}), "m.txt": b"m"}, "w"))
    (tmp_path / "c.tgz").write_bytes(tarred({"z.txt": b"z", "t.tar": tarred({"y.txt": b"\xef\xbb\xbfy"}, "w")}, "w:gz"))
    return tmp_path


def test_members_of_all_archives(spark, folder):
    got = archives.members(spark, str(folder)).orderBy("archive", "position", "place").collect()
    rows = [(r.archive.rsplit("/", 1)[1], r.position, r.place, r.name, bytes(r.content)) for r in got]
    assert rows == [
        ("a.zip", 0, 0, "d/one.txt", b""), ("a.zip", 1, 0, "d/two.txt", "二\n".encode()), ("a.zip", 2, 0, "x.bin", b"\xff"),
        ("b.tar", 0, 0, "m.txt", b"m"), ("b.tar", 1, 0, "p.txt", b"p"), ("b.tar", 1, 1, "q.txt", b"q"),
        ("c.tgz", 0, 0, "y.txt", b"\xef\xbb\xbfy"), ("c.tgz", 1, 0, "z.txt", b"z"),
    ]
    some = archives.members(spark, str(folder / "*.zip"), suffix=".txt")
    assert sorted((r.position, r.name) for r in some.collect()) == [(0, "d/one.txt"), (1, "d/two.txt")]


def test_a_task_for_each_member(spark, folder):
    df = archives.members(spark, str(folder / "a.zip")).withColumn("task", F.spark_partition_id())
    assert df.select("task").distinct().count() == 3
    # An archive inside an archive is a task; a packed tar is read in one pass.
    assert [m.member for m in archives.plan(str(folder / "b.tar"))] == ["m.txt", "n.zip"]
    assert [m.member for m in archives.plan(str(folder / "c.tgz"))] == [None]


def test_texts_of_members(spark, folder):
    got = {r.name: r.content for r in corpora.archive_members(spark, str(folder), ".txt").collect()}
    assert got == {"d/one.txt": "", "d/two.txt": "二\n", "m.txt": "m", "p.txt": "p", "q.txt": "q", "y.txt": "y", "z.txt": "z"}
    with pytest.raises(Exception, match="MALFORMED|malformed|UTF-8"):
        corpora.archive_members(spark, str(folder / "a.zip"), ".bin").collect()


def test_no_archive(spark, folder, tmp_path):
    (tmp_path / "not.zip").write_bytes(b"text")
    for path, message in ((tmp_path / "not.zip", "no zip or tar archive"), (tmp_path / "none", "no archive at")):
        with pytest.raises(Exception, match=message):
            archives.members(spark, str(path)).collect()
