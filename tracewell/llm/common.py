"""What the operators share: tables, words, the shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from itertools import pairwise
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.  bytes.split() cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: The folder of each table that saved() wrote.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session; only where it is unset (a local session, tests)
    is a temporary folder chosen, which then is the checkpoint folder as well.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    FOLDERS[out] = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what saved() wrote for df: its rows have been read for the last time."""
    spark, path = df.sparkSession, FOLDERS.pop(df)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI, for the tasks that write whole files."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(uri: str):
    """A file open for writing: under a name of this attempt's own, then moved to its place.

    A task that is run again writes the same bytes again, so a lost executor does no harm.
    """
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(own) as out:
        yield out
    store.move(own, path)


def write_file(uri: str, chunks) -> None:
    """Write a file in one piece."""
    with new_file(uri) as out:
        for chunk in chunks:
            out.write(chunk)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with as many lines behind it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def fold_of(doc_id, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class Known(dict):
    """What `make` gives for each key.  Of the keys used of late `most` to twice as many are remembered."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def peek(self, key):
        """The value of a key that is remembered, None of others."""
        value = self.get(key)
        if value is None and (value := self.before.get(key)) is not None:
            self.put(key, value)
        return value


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch whose texts hold about `limit` bytes at most (a longer text stands alone)."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + (n or 0) > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < len(lengths):
        yield batch.slice(at)


def pieces(column: pa.Array, uncut: np.ndarray | None = None, recut=None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut where ASCII white space begins: the distinct pieces, the number of the piece at each
    place, and where each text's pieces end.

    A piece is a run of white space (none at the start of a text) and the word behind it (none at the
    end).  Texts marked in `uncut` are one piece each.  A null text has no piece.  `recut` gets the bytes of
    all texts, the marks where pieces begin, which it changes, and where the texts begin and the last one ends.
    """
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    n = int(ends[-1] - ends[0])
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(len(whole), np.int64)
    data = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = BLANK[data]
    begins[1:] &= ~begins[:-1]
    if recut is not None:
        recut(data, begins, ends)
    for i in np.flatnonzero(uncut) if uncut is not None else ():
        begins[ends[i] : ends[i + 1]] = False
    begins[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(begins)
    cut = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, n)), pa.py_buffer(data)])
    coded = cut.dictionary_encode()
    _, stops, raw = coded.dictionary.buffers()
    stops, raw = np.frombuffer(stops, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes()
    return [raw[i:j] for i, j in pairwise(stops)], coded.indices.to_numpy(), np.searchsorted(at, ends[1:])


def spread(made: list[bytes], kind, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the pieces at all places give, one after the other, and where each text's part ends.

    made: for each distinct piece its values (of numpy type `kind`) as bytes.
    """
    flat = np.frombuffer(b"".join(made), kind)
    sizes = np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(kind).itemsize
    first = np.cumsum(sizes) - sizes
    own = sizes[index]
    stops = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(first[index] - stops[:-1], own)
    at += np.arange(len(at))
    return flat[at], stops[ends]
