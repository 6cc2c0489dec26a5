"""Length-delimited binary records of token ids, with a separate offset index.

A record is framed as

    length       8 bytes, little-endian
    masked crc   4 bytes, of the 8 length bytes
    data         `length` bytes
    masked crc   4 bytes, of the data

with CRC-32C, rotated right by 15 bits and moved by a constant, so that a checksum stored in a
checksummed block doesn't disturb it.  The data of a record are a head of 16 bytes (bytes per id,
whether the id is null, doc_id) and then the ids, in two bytes each where the vocabulary allows.

Documents are dealt out by ranges of doc_id and sorted within a range (ties by text, so that a
repeat of a task writes the same bytes); each range becomes one file `part-NNNNN.rec`.  The files
of all ranges in order hold the corpus in ascending doc_id order (nulls first).  The index, a
Parquet table, has part, offset, length, doc_id and n_tokens of every record: `read_at` fetches
records in any order through it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BLANK, Known, file_system, new_file, slices, spread
from tracewell.llm.common import pieces as words_of

HEAD = "<IIq"
#: Fixed values of the frame's checksum: reflected Castagnoli polynomial, mask constant.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 64
#: Pieces whose ids a Python worker remembers at least, bytes of the longest of them, and pieces sent to the library at once.
REMEMBERED, LONGEST, SENT = 450_000, 100, 1024
#: White space that isn't ASCII, the last bytes of its characters, and all white space.
WIDE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WIDE_LAST = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
BLANKS = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | set(map(chr, range(0x2000, 0x200B)))
ASCII_BLANKS = frozenset(map(ord, "\t\n\v\f\r "))
#: 1 for ASCII letters and digits, 2 for printable ASCII signs but the apostrophe, 0 for all other bytes.
KIND = np.array([1 if chr(b).isalnum() and b < 128 else 2 if 32 < b < 127 and b != 39 else 0 for b in range(256)], np.uint8)
INDEX = "part int, offset long, length long, doc_id long, n_tokens long"


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


@lru_cache(maxsize=1)
def crc_pair_table() -> np.ndarray:
    """What two zero bytes make of a state of 16 bits."""
    table, c = crc_table(), np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        c = table[c & 255] ^ (c >> 8)
    return c


@lru_cache(maxsize=1)
def crc_block_shift() -> np.ndarray:
    """What BLOCK zero bytes make of a state, as four tables, one for each byte of the state."""
    table = crc_table()
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            c = table[c & 255] ^ (c >> 8)
        out[k] = c
    return out


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of many messages of 4 bytes or more at once.

    Inverting the first four bytes stands for the start value of ones; zeros put in front of that
    change nothing, so all messages are cut into blocks of BLOCK bytes that are summed side by
    side, and the block sums of each message are then chained (the sum is linear).
    """
    if not messages:
        return np.zeros(0, np.uint32)
    n = np.array([len(m) for m in messages])
    blocks = -(-n // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    data = np.zeros(ends[-1], np.uint8)
    for m, end in zip(messages, ends, strict=True):
        data[end - len(m) : end] = np.frombuffer(m, np.uint8)
    first = (ends - n)[:, None] + np.arange(4)
    data[first] ^= 0xFF
    columns = np.ascontiguousarray(data.view("<u2").reshape(-1, BLOCK // 2).T)  # two bytes at a time
    table, state = crc_pair_table(), np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = table[(state ^ column) & 0xFFFF] ^ (state >> 16)
    a, b, c, d = crc_block_shift()
    order = np.argsort(-blocks, kind="stable")
    at, left = (ends // BLOCK - blocks)[order], blocks[order]
    total = np.zeros(len(messages), np.uint32)
    for k in range(int(left[0])):
        m = int(np.searchsorted(-left, -k, "left"))  # messages with more than k blocks
        t = total[:m]
        total[:m] = a[t & 255] ^ b[(t >> 8) & 255] ^ c[(t >> 16) & 255] ^ d[t >> 24] ^ state[at[:m] + k]
    out = np.empty(len(messages), np.uint32)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (((crc >> 15) | (crc << 17)) + np.uint32(MASK)).astype(np.uint32)


def frames(data: list[bytes]) -> list[bytes]:
    """Every record framed."""
    lengths = [struct.pack("<Q", len(x)) for x in data]
    heads, tails = masked(crc32c(lengths)).tolist(), masked(crc32c(data)).tolist()
    return [n + struct.pack("<I", h) + x + struct.pack("<I", t) for n, h, x, t in zip(lengths, heads, data, tails, strict=True)]


def check(lengths: list[bytes], heads: list[int], data: list[bytes], tails: list[int]) -> None:
    if masked(crc32c(lengths)).tolist() != heads or masked(crc32c(data)).tolist() != tails:
        raise ValueError("a record's checksum doesn't match its bytes")


class Pieces:
    """The tokenizers library's ids of a byte-level vocabulary file.

    Texts are cut at places that the library's merges never cross, and the library encodes each distinct piece
    once: new ones are sent many in one text, and the bytes of the tokens tell where each piece's ids end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level file with the usual pattern of pieces")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.holding = "|".join(f"(?:{re.escape(t.content)})" for t in added.values())
        #: Tokens that depend on what stands beside a word.
        self.reaching = "|".join(f"(?:{re.escape(t.content)})" for t in added.values() if t.lstrip or t.rstrip or t.single_word or BLANKS & set(t.content))
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token; one letter stands for one byte
        for token, i in vocab.items():
            self.size[i] = len(added[i].content.encode()) if i in added else len(token)
        self.known = Known(None, REMEMBERED)

    def raw(self, ids: list[int]) -> bytes:
        """Little-endian, as array() is on the machines that Spark runs on."""
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def apart(self, piece: bytes) -> bool:
        """Whether a piece has to be encoded by itself.

        White space at its end would be one run with that of the next piece, and wide white space at its start
        with the line break that is put before it.
        """
        if piece.isascii():
            return piece[-1] in ASCII_BLANKS
        text = piece.decode()
        return text[-1] in BLANKS or text[0] not in " \t\n\v\f\r" and text[0] in BLANKS

    def together(self, some: list[bytes]) -> list[bytes]:
        """Ids of pieces in one text, in which each begins with ASCII white space: a line break is put before others, and left out."""
        led = [w if w[0] in ASCII_BLANKS else b"\n" + w for w in some]
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(led).decode()], add_special_tokens=False)[0].ids, f"<u{self.width}")
        sizes = np.fromiter(map(len, led), np.int64, len(led))
        stops = np.cumsum(sizes)
        starts = stops - np.fromiter(map(len, some), np.int64, len(some))
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        first, last = np.searchsorted(ends, starts), np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or (ends[first] != starts).any() or (ends[last] != stops).any():
            return self.singly(some)  # tokens don't tell pieces apart: the vocabulary lacks bytes, or pieces make a special token
        data, width = ids.tobytes(), self.width
        return [data[i:j] for i, j in zip((first * width).tolist(), (last * width).tolist(), strict=True)]

    def singly(self, some: list[bytes]) -> list[bytes]:
        return [self.raw(e.ids) for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]

    def learn(self, fresh: list[bytes], special: bool) -> list[bytes]:
        """The library's ids of pieces; special: whether some may hold special tokens."""
        alone = [self.apart(w) or special and any(t in w for t in self.special) for w in fresh]
        many, own = [w for w, a in zip(fresh, alone, strict=True) if not a], [w for w, a in zip(fresh, alone, strict=True) if a]
        ids = chain.from_iterable(self.together(many[at : at + SENT]) for at in range(0, len(many), SENT))
        rest = iter(self.singly(own))
        return [next(rest) if a else next(ids) for a in alone]

    def ids(self, words: list[bytes], special: bool = False) -> list[bytes]:
        """Ids of pieces; the library encodes those that aren't known."""
        known = self.known
        out = list(map(known.get, words))
        new = []
        for k in [k for k, x in enumerate(out) if x is None]:
            if (x := known.before.get(words[k])) is not None:
                out[k] = x
                known.put(words[k], x)
            else:
                new.append(k)
        for k, x in zip(new, self.learn([words[k] for k in new], special), strict=True):
            out[k] = x
            if len(words[k]) <= LONGEST:
                known.put(words[k], x)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end.

        The pattern begins a piece wherever white space begins, and between an ASCII letter or digit and a sign on
        either side (but an apostrophe may go with the letters behind it): texts are cut there.  White space beyond
        ASCII can stand before ASCII white space and belong to the same run, which is not cut then.  Texts with special
        tokens are cut at white space only, and not at all where such a token reaches beyond its word.
        """

        def marked(pattern: str) -> np.ndarray:
            if not pattern:
                return np.zeros(len(column), bool)
            return pc.fill_null(pc.match_substring_regex(column, pattern), False).to_numpy(zero_copy_only=False)

        wide, special = marked(WIDE), marked(self.holding)

        def recut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
            kind = KIND[data]
            for i in np.flatnonzero(special):
                kind[ends[i] : ends[i + 1]] = 0
            begins[1:] |= (kind[1:] ^ kind[:-1]) == 3
            for i in np.flatnonzero(wide):
                begins[ends[i] + 1 : ends[i + 1]] &= ~(WIDE_LAST[data[ends[i] : ends[i + 1] - 1]] & BLANK[data[ends[i] + 1 : ends[i + 1]]])

        distinct, index, ends = words_of(column, marked(self.reaching), recut)
        return spread(self.ids(distinct, bool(special.any())), f"<u{self.width}", index, ends)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def write(df: DataFrame, path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, and write record files and the index below `folder`.

    Returns the index.  Null texts are empty (the end id alone), null ids are kept and come first,
    rows with equal ids each get a record, an empty table gives an empty index and no file.
    Ids are 64-bit integers (others are cast, and fail where they can't be).  Files are ranges of ids, so rows of one id, or
    without one, are in one file, whatever their number: give repeated rows ids of their own first.
    Every task holds a few MB of text at a time; a file and its index are streamed out.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        first = next(batches := iter(batches), None)
        if first is None:
            return
        tok = pieces(path)
        last = tok.raw([end_id])
        with new_file(f"{folder}/part-{part:05d}.rec") as out:
            for whole in chain([first], batches):
                for batch in slices(whole, "text"):
                    ids, ends = tok.encode(batch.column("text"))
                    keys = batch.column("doc_id").to_pylist()
                    data = [struct.pack(HEAD, tok.width, k is None, k or 0) + x.tobytes() + last for k, x in zip(keys, np.split(ids, ends[:-1]), strict=True)]
                    framed = frames(data)
                    sizes = np.array([len(f) for f in framed], np.int64)
                    out.write(b"".join(framed))
                    offsets = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    counts = np.diff(ends, prepend=0) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), *map(pa.array, (offsets, sizes)), batch.column("doc_id"), pa.array(counts)], names=["part", "offset", "length", "doc_id", "n_tokens"])

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return rows.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _records(stream, size: int = 8 << 20):
    """(offset, length bytes, its checksum, data, its checksum) of each record of an open file."""
    held, at = b"", 0
    while more := stream.read(size):
        held += more
        k = 0
        while len(held) - k >= 12:
            n, head = struct.unpack_from("<QI", held, k)
            if len(held) - k < 16 + n:
                break
            yield at + k, held[k : k + 8], head, held[k + 12 : k + 12 + n], struct.unpack_from("<I", held, k + 12 + n)[0]
            k += 16 + n
        held, at = held[k:], at + k
    if held:
        raise ValueError("the file ends within a record")


def _ids(data: bytes) -> tuple[int | None, np.ndarray]:
    width, null, key = struct.unpack_from(HEAD, data)
    return None if null else key, np.frombuffer(data, f"<u{width}", offset=struct.calcsize(HEAD))


READ = "part int, offset long, before long, doc_id long, n_tokens long, ids_crc32 long"


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read the record files whole, one task for each, checking all checksums.

    Rows: part, offset, before (ids in the same file before the record), doc_id, n_tokens and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers).
    """
    parts = index.select("part").distinct()
    tasks = max(1, min(parts.count(), 4 * index.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                store, path = file_system(f"{folder}/part-{part:05d}.rec")
                before = 0
                with store.open_input_stream(path) as stream:
                    source = _records(stream)
                    while True:
                        got = list(islice(source, 500))
                        if not got:
                            break
                        check(*map(list, zip(*[x[1:] for x in got], strict=True)))
                        rows = []
                        for offset, _, _, data, _ in got:
                            key, ids = _ids(data)
                            rows.append((part, offset, before, key, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            before += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], names=["part", "offset", "before", "doc_id", "n_tokens", "ids_crc32"])

    return parts.repartition(tasks, "part").mapInArrow(run, READ)


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids (array<int>) of the index rows given, in their order: a shuffled read."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for part, offset, length in zip(*[batch.column(c).to_pylist() for c in ("part", "offset", "length")], strict=True):
                store, path = file_system(f"{folder}/part-{part:05d}.rec")
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    raw = f.read(length)
                n, head = struct.unpack_from("<QI", raw)
                check([raw[:8]], [head], [raw[12 : 12 + n]], [struct.unpack_from("<I", raw, 12 + n)[0]])
                key, ids = _ids(raw[12 : 12 + n])
                keys.append(key)
                out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.select("part", "offset", "length").mapInArrow(run, "doc_id long, ids array<int>")


def positions(records: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of read records.

    Only one sum for each file is ordered in one place; it is joined back by file.
    """
    total = records.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return records.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def folder_in(spark: SparkSession) -> str:
    from tracewell.llm.common import shared_dir

    return shared_dir(spark, "records")
