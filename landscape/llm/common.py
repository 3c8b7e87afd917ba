"""Small shared helpers: table readers, stage tables, Arrow text access and
vectorised hashing of words held in byte buffers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landscape.session import scratch_path

SLICE_BYTES = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back:
    cuts lineage, survives lost executors, gives AQE real statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow text

ARROW_BYTES = 8 << 20  # of a batch that goes to a Python worker


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session in bytes, as texts are of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(name)
    if int(str(now).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def carried(docs: DataFrame, text: str, results: Sequence[str], keep: Sequence[str] | None = None,
            **extra: Column) -> tuple[DataFrame, list[Column]]:
    """Input of a pass over the texts, and how to name its columns again.

    The columns to ``keep`` (all, unless named) get numbers for names, so that
    none clashes with those a pass adds; columns named like the ``results`` are
    left out; the text, as ``text_``, is sent once. ``extra`` columns are added.
    """
    bound_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if keep is None else keep) if c not in results]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c != text],
                      F.col(f"`{text}`").alias("text_"), *[v.alias(k) for k, v in extra.items()])
    return src, [F.col("text_" if c == text else f"c{i}").alias(c) for i, c in enumerate(columns)]


def map_texts(src: DataFrame, run: Callable, added: str, text_back: bool) -> DataFrame:
    """``src.mapInArrow(run)`` with the ``added`` columns; without ``text_back``
    the texts are not sent back."""
    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.drop_columns(["text_"])

    kinds = [f"`{k}` {v}" for k, v in src.dtypes if text_back or k != "text_"]
    return src.mapInArrow(run if text_back else without, ", ".join([*kinds, added]))

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column, without making
    Python strings. Null rows come out empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type):
        width = np.dtype(np.int32)
    else:
        col = col.cast(pa.large_string())
        width = np.dtype(np.int64)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, width, count=len(col) + 1, offset=col.offset * width.itemsize).astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def rows_of(batches: Iterator[pa.RecordBatch], column: str,
            limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        _, offs = text_buffer(batch.column(column))
        for lo, hi in row_slices(offs, limit):
            yield batch.slice(lo, hi - lo)


# ------------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_tables(separators: bytes, lower: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(is-word flag, random 64-bit value) for each byte; with ``lower`` A-Z
    share the values of a-z."""
    rng = np.random.default_rng(seed)
    value = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        value[65:91] = value[97:123]
    word = np.ones(256, bool)
    word[list(separators)] = False
    return word, value


WHITE = bytes([0x20, *range(0x09, 0x0E)])
POWER = np.uint64(0xD6E8FEB86659FD93)


class WordHasher:
    """64-bit hashes of all words of a run of rows, computed on bytes.

    A word is a maximal run of bytes outside ``separators`` inside one row.
    Long rows are worked off in segments cut at separators, so memory stays
    bounded by the segment (or by one very long word), not by the row.
    """

    def __init__(self, separators: bytes = WHITE, lower: bool = True, seed: int = 1):
        self.word, self.value = byte_tables(separators, lower, seed)
        self.pow = np.cumprod(np.full(256, POWER, np.uint64))

    def _powers(self, n: int) -> np.ndarray:
        if n > len(self.pow):
            self.pow = np.cumprod(np.full(1 << int(n - 1).bit_length(), POWER, np.uint64))
        return self.pow

    def _segment(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start positions of the words of ``data``; a word also
        ends before each position in ``breaks``."""
        is_word = self.word[data]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        if len(breaks):
            first[breaks] = is_word[breaks]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        at = np.flatnonzero(is_word)
        cut = np.searchsorted(at, starts)
        size = np.diff(np.append(cut, len(at)))
        pos = np.arange(len(at)) - np.repeat(cut, size)
        value = self.value[data[at]] * self._powers(int(size.max()))[pos]
        total = np.add.reduceat(value, cut)
        return mix64(total + size.astype(np.uint64) * MIX), starts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word in order, word offsets of the rows)."""
        n = len(offsets) - 1
        hashes, counts = [], np.zeros(n, np.int64)
        for lo, hi in row_slices(offsets, SLICE_BYTES):
            a, b = int(offsets[lo]), int(offsets[hi])
            inner = offsets[lo:hi] - a
            while True:
                end = b
                if hi - lo == 1 and b - a > 2 * SLICE_BYTES:  # a long row: cut at a separator
                    end = a + SLICE_BYTES
                    while end < b:
                        gap = np.flatnonzero(~self.word[data[end:end + SLICE_BYTES]])
                        if len(gap):
                            end += int(gap[0])
                            break
                        end += SLICE_BYTES
                    end = min(end, b)
                h, starts = self._segment(data[a:end], inner[inner < end - a])
                hashes.append(h)
                row = np.searchsorted(inner, starts, side="right") - 1
                # empty rows share their start with the next one: the last row at a start holds the bytes
                counts[lo:hi] += np.bincount(row, minlength=hi - lo)
                if end >= b:
                    break
                inner = np.zeros(1, np.int64)
                a = end
        out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return out, np.concatenate([[0], np.cumsum(counts)])


def windows_hash(words: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of every row (a row with fewer words, but
    at least one, has one window: its whole sequence) and the row offsets."""
    counts = np.diff(word_offsets)
    rows = len(counts)
    full = np.maximum(counts - n + 1, 0)
    short = (counts > 0) & (counts < n)
    out_counts = np.where(short, 1, full)
    offs = np.concatenate([[0], np.cumsum(out_counts)])
    total = int(offs[-1])
    out = np.zeros(total, np.uint64)
    if not total:
        return out, offs
    row = np.repeat(np.arange(rows), out_counts)
    at = np.arange(total) - offs[row] + word_offsets[:-1][row]
    size = np.where(short, counts, n)[row]
    factor = np.uint64(1)
    for j in range(n):
        ok = size > j
        with np.errstate(over="ignore"):
            factor = factor * POWER
            term = words[np.where(ok, at + j, 0)] * factor
        out += np.where(ok, term, np.uint64(0))
    with np.errstate(over="ignore"):
        return mix64(out + size.astype(np.uint64) * MIX), offs


# ------------------------------------------------------------------ sampling

def bounded_sample(rows: DataFrame, group: str, key: str, per_group: int, text: str | None = None,
                   max_bytes: int = 0, groups: int = 64, seed: int = 5, counted: bool = True) -> DataFrame:
    """At most ``per_group`` rows, and about ``max_bytes`` of ``text`` where it is named, of each
    value of ``group`` (null left out), by a seeded hash of ``key``. With more than ``groups``
    values, each has fewer rows (one at least), so that the sample stays as large in all.

    The sizes of the groups are counted first, so that only a little more than
    the sample itself is shuffled, whatever the size of the table (``counted``
    off: for rows that are few anyway). A row that alone exceeds the bytes is
    passed over.
    """
    rows = rows.filter(F.col(group).isNotNull())
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40))
    near = rows.withColumn("draw_", draw)
    if text:
        near = near.filter(F.octet_length(text) <= max_bytes)
    if counted:
        counts = (rows.groupBy(group).agg(F.count(F.lit(1)).alias("c"))
                  .collect())
        if len(counts) > groups:
            per_group = max(1, per_group * groups // len(counts))
        n = per_group + 6 * math.isqrt(per_group) + 12  # the bound is exact below; this only limits the shuffle
        kind = T.StructType([T.StructField(group, rows.schema[group].dataType), T.StructField("bound_", T.LongType())])
        bounds = rows.sparkSession.createDataFrame([(r[group], min(1 << 40, (n << 40) // r["c"] + 1)) for r in counts], kind)
        near = (near.join(F.broadcast(bounds), group).filter(F.col("draw_") < F.col("bound_"))
                .select(*rows.columns, "draw_"))
    order = W.partitionBy(group).orderBy("draw_", key, *([text] if text else []))
    out = near.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= per_group)
    if text:
        size = F.octet_length(text).cast("long")
        out = (out.withColumn("b_", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
               .filter(F.col("b_") <= max_bytes).drop("b_"))
    return out.drop("draw_", "n_")
