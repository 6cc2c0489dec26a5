"""Zip and tar archives by their directories.

An archive's directory is read first, without its content: a zip's stands at its end, a tar's headers are found by jumping
over the members.  Members then are rows, dealt out over tasks, each of which reads the bytes of its own members
only; so one large archive is not one task's, and what is filtered by name is never read.  (A compressed tar has no place
to jump to: each of its tasks reads from the start.)
"""

from __future__ import annotations

import contextlib
import io
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of what the catalog itself puts into archives, and the pattern of the entries that hold an archive's pipeline.
OWN = "pipelines/"
PIPELINE = r"^pipelines/pipeline[0-9]+\.json"


def _store(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


class _Raw(io.RawIOBase):
    """A store's file as Python's readers want it: a place before its start is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell() if whence == 1 else 0, self.file.size() if whence == 2 else 0)[whence]
        if at < 0:
            raise OSError("a place before the start of the file")
        return self.file.seek(at)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


@contextlib.contextmanager
def _opened(uri: str):
    """The archive and its members as (ordinal, name, size, read); nothing of a file that is no archive."""
    store, path = _store(uri)
    with store.open_input_file(path) as file:
        raw = io.BufferedReader(_Raw(file), 1 << 16)
        if zipfile.is_zipfile(raw):
            with zipfile.ZipFile(raw) as z:
                yield [(i, x.filename, x.file_size, lambda x=x: z.read(x)) for i, x in enumerate(z.infolist()) if not x.is_dir()]
            return
        raw.seek(0)
        try:
            with tarfile.open(fileobj=raw) as t:
                yield [(i, m.name, m.size, lambda m=m: t.extractfile(m).read()) for i, m in enumerate(t.getmembers()) if m.isfile()]
        except tarfile.ReadError:
            yield []


def entries(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, name and size of every file in the archives of a path; files that are no archives have none."""

    def run(frames):
        for pdf in frames:
            for uri in pdf["path"]:
                with _opened(uri) as members:
                    rows = [(uri, i, name, size) for i, name, size, _ in members]
                yield pd.DataFrame(rows, columns=["path", "ordinal", "name", "size"])

    found = spark.read.format("binaryFile").load(path).select("path")
    return found.repartition("path").mapInPandas(run, "path string, ordinal int, name string, size long")


def contents(chosen: DataFrame, bytes_: int = 64 << 20) -> DataFrame:
    """The chosen entries (path, ordinal, name, size) with their content, and whether it is a driver's (starts with #!).

    Entries are dealt out by their place, a task's rows are read one archive after the other, and a batch of results holds
    about `bytes_` bytes at most.
    """

    def run(frames):
        for pdf in frames:
            for uri, own in pdf.groupby("path", sort=False):
                wanted, held, out = set(own["ordinal"]), 0, []
                with _opened(uri) as members:
                    for i, name, size, read in members:
                        if i in wanted:
                            data = read()
                            out.append((uri, i, name, size, data, data[:2] == b"#!"))
                            held += size
                            if held >= bytes_:
                                yield pd.DataFrame(out, columns=["path", "ordinal", "name", "size", "content", "driver"])
                                held, out = 0, []
                yield pd.DataFrame(out, columns=["path", "ordinal", "name", "size", "content", "driver"])

    dealt = chosen.select("path", "ordinal", "name", "size").repartition("path", "ordinal").sortWithinPartitions("path", "ordinal")
    return dealt.mapInPandas(run, "path string, ordinal int, name string, size long, content binary, driver boolean")


def pipelines(spark: SparkSession, path: str, pattern: str = PIPELINE) -> DataFrame:
    """path and pipeline (text) of each archive: its last entry, if that is a pipeline's, else null."""
    last = entries(spark, path).groupBy("path").agg(F.max_by(F.struct("ordinal", "name", "size"), "ordinal").alias("e")).select("path", "e.*")
    read = contents(last.where(F.col("name").rlike(pattern))).select("path", F.decode("content", "UTF-8").alias("pipeline"))
    return last.select("path").join(read, "path", "left")


def files_of(spark: SparkSession, path: str, own: str = OWN) -> DataFrame:
    """path, name and driver of the files of archives, without what the catalog itself has put there."""
    return contents(entries(spark, path).where(~F.col("name").startswith(own))).select("path", "name", "driver")


def appended(spark: SparkSession, texts: DataFrame, before: str = "pipelines/pipeline", after: str = ".json") -> DataFrame:
    """Append to each archive of texts (path, text) an entry with the text, under the first number (from 1) that no entry has;
    returns path and name.

    The archive is written anew beside itself and then put in its place, so a task that is lost leaves it as it was.  One that
    is run again after it has put it there finds its text in the last entry and adds nothing.
    """

    def one(uri: str, text: str) -> str:
        store, path = _store(uri)
        with store.open_input_file(path) as f:
            raw = f.read()
        data = text.encode()
        with _opened(uri) as members:
            names = [name for _, name, _, _ in members]
            if members and members[-1][1].startswith(before) and members[-1][3]() == data:
                return names[-1]
        free = next(f"{before}{i}{after}" for i in range(1, len(names) + 2) if f"{before}{i}{after}" not in names)
        out = io.BytesIO(raw)
        if zipfile.is_zipfile(out):
            with zipfile.ZipFile(out, "a") as z:
                z.writestr(free, data)
        else:
            out.seek(0)
            with tarfile.open(fileobj=out, mode="a") as t:
                info = tarfile.TarInfo(free)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        new = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        with store.open_output_stream(new) as f:
            f.write(out.getvalue())
        store.move(new, path)
        return free

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "name": [one(p, t) for p, t in zip(pdf["path"], pdf["text"], strict=True)]})

    return texts.select("path", "text").repartition("path").mapInPandas(run, "path string, name string")
