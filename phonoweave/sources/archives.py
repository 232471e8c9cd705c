"""Members of archives as a data source: a partition for each member.

    archives.members(spark, "/data/corpora/*.zip")      or
    spark.dataSource.register(archives.Archives)
    spark.read.format("archive").option("path", ...).load()

The plan is made from the directories of the archives alone: a zip's is at its end, a tar's headers are skipped through. A
task opens the archive again and reads its own member; one that is an archive itself is unpacked there, in one pass. A packed
tar has to be unpacked up to a member to reach it, so all its members are one partition; those of unpacked tars and zips are
not. Tasks can be run again anywhere: they hold nothing but a path and a name, so the archives lie where all executors see
them.
"""

from __future__ import annotations

import glob
import os
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, position int, place int, name string, content binary"
#: Bytes of an inner archive that are held in memory; longer ones go to a file of the task's own, deleted with it.
SPOOLED = 64 << 20
_TAR = (".tar", ".tar.gz", ".tgz")


@dataclass
class Member(InputPartition):
    """What one task reads: a member and its place by name, or (without a name) a whole packed tar."""

    archive: str
    position: int = 0
    member: str | None = None


@contextmanager
def _spooled(stream):
    """A stream that can be searched, of one that may not be."""
    with tempfile.SpooledTemporaryFile(max_size=SPOOLED) as copy:
        shutil.copyfileobj(stream, copy, 1 << 20)
        copy.seek(0)
        yield copy


def _is_packed(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def _names(archive) -> list[str]:
    """Files of an open archive, by name, repeated names once: the last one counts, as both formats have it."""
    if isinstance(archive, zipfile.ZipFile):
        return sorted({n for n in archive.namelist() if not n.endswith("/")})
    return sorted({m.name for m in archive.getmembers() if m.isfile()})


def _open(archive, name: str):
    return archive.open(name) if isinstance(archive, zipfile.ZipFile) else archive.extractfile(name)


@contextmanager
def _archive(path: str):
    """The archive at a path; ValueError for what is neither zip nor tar."""
    # Tars first: one that holds a zip near its end looks like a zip.
    if path.endswith(_TAR) and os.path.getsize(path) and tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            yield t
    elif zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            yield z
    else:
        raise ValueError(f"{path} is no zip or tar archive")


@contextmanager
def _inner(archive, name: str):
    """The archive that a member is, or None; by its name and what it holds."""
    with _open(archive, name) as stream:
        if not name.endswith((".zip", *_TAR)):
            yield None
            return
        with _spooled(stream) as copy:
            if name.endswith(_TAR) and tarfile.is_tarfile(copy):
                copy.seek(0)
                with tarfile.open(fileobj=copy) as t:
                    yield t
            elif zipfile.is_zipfile(copy):
                copy.seek(0)
                with zipfile.ZipFile(copy) as z:
                    yield z
            else:
                yield None


def files(path: str) -> list[str]:
    """Archives at a path: the file, those of a folder, or those that a pattern matches, in order."""
    found = [os.path.join(path, n) for n in os.listdir(path)] if os.path.isdir(path) else glob.glob(path)
    found = sorted(f for f in found if os.path.isfile(f))
    if not found:
        raise ValueError(f"no archive at {path}")
    return found


def plan(path: str) -> list[Member]:
    """A partition for each member of the archives at a path, but one for a packed tar."""
    out: list[Member] = []
    for file in files(path):
        if file.endswith(_TAR) and _is_packed(file):
            out.append(Member(file))
            continue
        with _archive(file) as archive:
            out += [Member(file, k, name) for k, name in enumerate(_names(archive))]
    return out


def read(task: Member, suffix: str = "") -> Iterator[tuple]:
    """Rows of a partition; position: a member's place in its archive by name, place: that inside an archive which the member is."""
    with _archive(task.archive) as archive:
        names = enumerate(_names(archive)) if task.member is None else [(task.position, task.member)]
        for position, name in names:
            with _inner(archive, name) as inner:
                if inner is None:
                    if name.endswith(suffix):
                        with _open(archive, name) as stream:
                            yield task.archive, position, 0, name, stream.read()
                    continue
                for place, part in enumerate(_names(inner)):
                    if part.endswith(suffix):
                        with _open(inner, part) as stream:
                            yield task.archive, position, place, part, stream.read()


class Archives(DataSource):
    """Options: path (a file, a folder or a pattern), suffix (of names of members)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ""))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Member]:
        return plan(self.path)

    def read(self, partition: Member | None) -> Iterator[tuple]:
        return iter(()) if partition is None else read(partition, self.suffix)


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, position, place, name, content of the members whose names end so."""
    spark.dataSource.register(Archives)
    return spark.read.format("archive").option("path", path).option("suffix", suffix).load()
