"""Quality rules: base counts and compression bands.

The verdict comes from zstandard.  A document is compressed whole, and in fixed chunks of
CHUNK bytes; ratio = compressed / plain.  Text that compresses too well repeats itself, text that
hardly compresses is noise.  Short texts compress worse for lack of history, so the limits depend
on length: each band of byte lengths has its own lowest and highest whole ratio, and one pair of
limits holds for chunks (a last chunk below half the size is judged with the one before it; a text of fewer
than two chunks has its whole ratio only).
A document is rejected if its whole ratio leaves its band, or if more than a given share of its
chunks leave theirs: long boilerplate that varies slowly passes as a whole but not by chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, texts_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of compression.  bands: (least bytes, lowest ratio, highest ratio), ascending.

    Highest ratios are 0.03 or more above the most that sf0.1 and English technical prose reached at that
    length.  They tell base64 from 256 bytes, random letters from 1536 and hex from 4096 bytes; shorter ones lie
    within what prose reaches.
    """

    level: int = 3
    chunk: int = 4096
    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.20, 1.40),
        (256, 0.22, 0.84),
        (384, 0.22, 0.81),
        (512, 0.22, 0.77),
        (768, 0.22, 0.70),
        (1024, 0.20, 0.64),
        (1536, 0.20, 0.59),
        (2048, 0.20, 0.56),
        (4096, 0.18, 0.515),
        (16384, 0.15, 0.50),
        (65536, 0.12, 0.50),
    )
    chunk_low: float = 0.20
    chunk_high: float = 0.56
    bad_chunks: float = 0.5

    def limits(self, n: int) -> tuple[float, float]:
        return [b for b in self.bands if b[0] <= n][-1][1:]


def repeated(ids: np.ndarray, ends: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of `width` words found twice or more in that text.

    ids: words of all texts, distinct words of distinct texts having distinct numbers; ends: where
    each text's words end.  Windows are named exactly: those of 2, 4 and 8 words by pairs of
    the names of their halves.  width: a power of two.
    """
    n = len(ids)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    names, size = ids.astype(np.int64), 1
    while size < width:
        m = len(names) - size
        if m <= 0:
            return np.zeros(len(ends), np.int64)
        names = np.unique(names[:m] * np.int64(names.max() + 1) + names[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    inside = owner[: len(names)] == owner[width - 1 : width - 1 + len(names)]
    counts = np.bincount(names[inside], minlength=int(names.max()) + 1)
    twice = inside & (counts[names] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(names)] += twice
    edge[width : width + len(names)] -= twice
    covered = np.cumsum(edge)[:n] > 0
    return np.bincount(owner[covered], minlength=len(ends))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of UTF-8 texts."""
    number: dict = {}
    ids: list[int] = []
    ends, chars, symbols, dups = [], [], [], []
    for raw in texts:
        words = raw.split()
        number = {}  # names start anew with each text; the owner keeps windows apart
        base = len(ids)
        ids += [number.setdefault(w, base + len(number)) for w in words]
        ends.append(len(ids))
        text = raw.decode("utf-8", "replace")
        chars.append(len(text) - sum(map(text.count, SPACES)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        dups.append(len(lines) - len(set(lines)))
    ends = np.array(ends, np.int64)
    return {
        "n_words": np.diff(ends, prepend=0),
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": repeated(np.array(ids, np.int64), ends),
    }


def ratios(raw: bytes, limits: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Whole ratio, number of chunks, chunks out of their limits.  An empty text has ratio 1 and no chunk."""
    n = len(raw)
    if not n:
        return 1.0, 0, 0
    whole = len(press.compress(raw)) / n
    if n < 2 * limits.chunk:
        return whole, 0, 0
    cuts = list(range(0, n - limits.chunk // 2, limits.chunk))
    ends = [*cuts[1:], n]
    parts = [len(press.compress(raw[a:b])) / (b - a) for a, b in zip(cuts, ends, strict=True)]
    return whole, len(parts), sum(not limits.chunk_low <= x <= limits.chunk_high for x in parts)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, band_failed boolean"


def measure(df: DataFrame, limits: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, base counts, compression ratios and the bands' verdict of every whole text.

    Null texts count as empty (no word, ratio 1).  Nothing is shuffled.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def run(batches):
        press = zstandard.ZstdCompressor(level=limits.level)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = texts_of(batch.column("text"))
                out = base_counts(texts)
                got = [ratios(x, limits, press) for x in texts]
                out["ratio"] = np.array([r for r, _, _ in got], float)
                out["n_chunks"] = np.array([n for _, n, _ in got], np.int64)
                out["n_bad_chunks"] = np.array([b for _, _, b in got], np.int64)
                bands = [limits.limits(len(x)) for x in texts]
                out["band_failed"] = np.array([not low <= r <= high or b > limits.bad_chunks * n for (r, n, b), (low, high) in zip(got, bands, strict=True)], bool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])

    return rows.mapInArrow(run, schema)


def verdict(measured: DataFrame, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """base_failed (too few words, or too large a share, in percent, of repeated ones) and kept."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))
