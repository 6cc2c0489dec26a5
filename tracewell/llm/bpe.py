"""BPE encoding by backtracking, and decoding by an offset table.

Encoding.  All tokens stand in an Aho-Corasick automaton.  One pass over a word lists, for
every start, the tokens that match there.  The encoder takes the longest match that is
compatible with the token before it and goes back to the next shorter one where the rest of
the word can't be reached; a position found unreachable is never tried again, so the work is
linear in the number of matches.  Two tokens are compatible if no merge across their border
would have come before the merges that made the two tokens; with only compatible neighbours the
sequence is the one that applying the merges in rank order gives (lowest rank first, leftmost
first among equals).

Decoding.  The bytes of all tokens lie in one buffer; ids select ranges of it through an
offset table.

Both run as mapInArrow over the rows; nothing is shuffled and every text is encoded whole: tokens never
cross white space, so each distinct word of a batch is encoded once and its ids are put at all its places.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import is_normalized, normalize

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm.common import Known, pieces, slices, spread

#: Unicode white space as the tokenizer's pattern engine has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Words, or pairs of tokens, that a Python worker remembers at least.
REMEMBERED, PAIRS = 150_000, 50_000
END = "\0"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class BacktrackingBpe:
    """A BPE model: `vocab` maps tokens to ids, `merges` lists pairs in rank order, `suffix` ends words."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix = suffix
        inner = {t: (t.removesuffix(suffix) + END if suffix and t.endswith(suffix) else t) for t in vocab}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list | tuple) else pair.split(" ")
            whole = vocab.get(left + right)
            if whole is not None and left in vocab and right in vocab:
                self.rank.setdefault((vocab[left], vocab[right]), rank)
                self.parts.setdefault(whole, (rank, vocab[left], vocab[right]))
        self.compatible = Known(lambda pair: not self._crossed(*pair), PAIRS)  # the pair table, filled as pairs occur
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i not in self.parts or self._stands(i):
                self.automaton.add_word(inner[token], (i, len(inner[token])))
        self.automaton.make_automaton()

    def _stands(self, i: int) -> bool:
        """Whether the token's own text encodes to the token: nothing crosses its last border earlier."""
        rank, left, right = self.parts[i]
        return not self._crossed(left, right, rank)

    def _edge(self, i: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at one edge while token i was built, each with the rank that ended it."""
        out, ends = [(i, float("inf"))], 0.0
        while i in self.parts:
            ends, i = self.parts[i][0], self.parts[i][1 + side]
            out.append((i, ends))
        return out

    def _crossed(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether some merge joins both tokens at their border before either is complete.

        At equal ranks the leftmost pair merges first: the left token's own merge comes before
        the crossing one, which comes before the right token's.
        """
        edge = self._edge(right, 0)
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in edge:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends and rank < before:
                    return True
        return False

    def encode(self, word: str) -> list[int]:
        """Ids of one word, which is given in byte letters."""
        text = word + END if self.suffix else word
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (i, length) in self.automaton.iter(text):
            starts[last - length + 1].append((i, length))  # shorter ones end, and so come, first
        taken: list[tuple[int, int, int]] = []  # id, length, place in the list of its start
        dead = bytearray(n + 1)
        at, k = 0, len(starts[0]) - 1
        while at < n:
            found = starts[at]
            while k >= 0:
                i, length = found[k]
                if not dead[at + length] and (not taken or self.compatible[taken[-1][0], i]):
                    break
                k -= 1
            if k >= 0:
                taken.append((i, length, k))
                at += length
                k = len(starts[at]) - 1 if at < n else 0
            elif taken:
                dead[at] = 1
                _, length, k = taken.pop()
                at -= length
                k -= 1
            else:
                raise ValueError(f"no sequence of tokens makes {word!r}")
        return [i for i, _, _ in taken]


class WordTokenizer:
    """A word-level BPE file: special tokens first, then NFC, lower case, words, bytes and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        try:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        except (KeyError, TypeError):
            raise ValueError(f"{path} isn't a word-level file: it has no pattern of words") from None
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.model = BacktrackingBpe(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.letters = byte_letters()
        self.split = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special)) if self.special else None
        self.known = Known(lambda w: np.array(self.model.encode("".join([self.letters[b] for b in w.encode()])), np.int32).tobytes(), REMEMBERED)

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = text if is_normalized("NFC", text) else normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter: no final form
        return self.pattern.findall(text.lower())

    def one(self, piece: bytes) -> bytes:
        """Ids of a piece of text as little-endian 32-bit integers."""
        text, get = piece.decode(), self.known.__getitem__
        if self.split is None or not self.split.search(text):
            return b"".join(map(get, self.words(text)))
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                out += map(get, self.words(part))
        return b"".join(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end."""
        distinct, index, ends = pieces(column)
        return spread([self.one(w) for w in distinct], np.int32, index, ends)


class OffsetTable:
    """The tokens of a word-level file in one buffer; ids select ranges of it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        tokens = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and where each ends; `ends`: where each text's ids end.

        Tokens are joined by one space (the file names no decoder).
        """
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(stops[-1]) + np.repeat(first - stops[:-1], size)
        data = self.buffer[at]
        text_ends = stops[ends]
        full = np.diff(ends, prepend=0) > 0
        keep = np.ones(len(data), bool)
        keep[text_ends[full] - 1] = False  # no space after the last token
        return data[keep], text_ends - np.cumsum(full)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != name], T.StructField(name, kind, True)])


def _text(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string column from the bytes of all texts and where each ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add the ids of every text as array<int> in column `out` (which replaces one of that name).

    `path` names the vocabulary file, which every worker must have.  Null and empty texts give an
    empty array; texts of any length are encoded whole.  `keep` lists the columns that stay (all).  With
    `decoded` the ids are turned back in the same pass, and the text they give is added in a column of that name.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out, decoded)]
    rows = df.select(*dict.fromkeys([*keep, text]))
    schema = _with(rows.select(*keep).schema, out, T.ArrayType(T.IntegerType(), True))
    if decoded:
        schema = _with(schema, decoded, T.StringType())

    def run(batches):
        tok, table = tokenizer(path), offset_table(path) if decoded else None
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                flat, ends = tok.encode(batch.column(text))
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))]
                if decoded:
                    made.append(_text(*table.decode(flat, ends)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=schema.names)
        tok.known.forget()  # the worker goes on to other stages

    return rows.mapInArrow(run, schema)


def _id_slices(batch: pa.RecordBatch, ids: str, limit: int = 200_000):
    """Parts of a batch that hold about `limit` ids at most (a longer list stands alone)."""
    at = held = 0
    for i, n in enumerate(pa.compute.list_value_length(batch.column(ids)).to_pylist()):
        if i > at and held + (n or 0) > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of every id array in column `out`; null and empty arrays give an empty text."""
    keep = [c for c in df.columns if c != out]
    schema = _with(df.schema, out, T.StringType())

    def run(batches):
        table = offset_table(path)
        for whole in batches:
            for batch in _id_slices(whole, ids):
                lists = batch.column(ids)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, ends = table.decode(flat, np.cumsum(sizes).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _text(data, ends)], names=[*keep, out])

    return df.mapInArrow(run, schema)
