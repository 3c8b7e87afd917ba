"""Packing token pieces into fixed-length sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths - at most ``capacity`` numbers, however large the corpus - goes
to the driver. There, per bin, the longest piece left is fixed and a bitset
subset-sum finds the fullest combination of available lengths for the rest;
the combination is removed as often as the counts allow, which gives the same
bins as removing it one by one, as a combination stays the fullest while it is
available. Pieces are then numbered within their length and looked up in the
table of combinations, in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, rows_of, stage

CACHE_ENTRIES = 400_000  # words per Python worker; forgotten when full
JOINED = 64               # plain words encoded in one line
GROUP_ROWS = 5_000        # pieces per numbering bucket, over all lengths
SLICE = 4 << 20           # bytes of text tokenised at once
#: closing marks after a Latin letter are a token run of their own
MARKS = ".,;:!?%*#$&"
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size), end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordIds:
    """Token ids of texts by a ``tokenizers`` file that drops white space and
    marks the last token of a word. Words between blanks and line ends are
    numbered; the ids of a number are a run of one flat array, so that the ids of
    a batch are gathered from the numbers of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Give the words' memory back."""
        self.number: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        pa.default_memory_pool().release_unused()

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Number ``words``, whose ids lie end to end."""
        first = len(self.number)
        for name, more in (("flat", self.used + len(ids)), ("start", first + len(words)), ("size", first + len(words))):
            old = getattr(self, name)
            if more > len(old):
                grown = np.zeros(1 << more.bit_length(), old.dtype)
                grown[:len(old)] = old
                setattr(self, name, grown)
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[first:first + len(words)] = self.used + np.cumsum(size) - size
        self.size[first:first + len(words)] = size
        self.used += len(ids)
        self.number.update(zip(words, range(first, first + len(words))))

    def _encode(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _learn(self, words: list[str]) -> None:
        """Number new words. A Latin word and the marks behind it are encoded apart."""
        known, plain, other = self.number, set(), set()
        made, lows, tails = [], [], []  # of words unlike their lowered base: no tuples, which the collector would trace
        for w in words:
            base = w.rstrip(MARKS)
            if (base.isascii() and base.isalpha()) or LATIN.fullmatch(base):
                low = base.lower()
                plain.add(low)
                if low != w:
                    made.append(w)
                    lows.append(low)
                    tails.append(w[len(base):])
            else:
                other.add(w)
        other.update(tails)
        self._learn_plain([w for w in plain if w not in known])
        need = [w for w in other if w not in known]
        for i in range(0, len(need), 4096):
            self._add(need[i:i + 4096], *self._encode(need[i:i + 4096]))
        if made:
            pair = np.empty((len(made), 2), np.int64)
            pair[:, 0] = [known[low] for low in lows]
            pair[:, 1] = [known[marks] for marks in tails]
            size = self.size[pair]
            self._add(made, self.flat[spans(self.start[pair.ravel()], size.ravel())], size.sum(1))

    def _learn_plain(self, words: list[str]) -> None:
        """Latin words are one pre-token each: many are encoded in a line and
        told apart by the tokens that end a word."""
        for i in range(0, len(words), JOINED * 64):
            part = words[i:i + JOINED * 64]
            ids, _ = self._encode([" ".join(part[k:k + JOINED]) for k in range(0, len(part), JOINED)])
            size = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)
            if len(size) != len(part):  # a file without marks of word ends
                ids, size = self._encode(part)
            self._add(part, ids, size)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the offsets of the texts. Null texts have none."""
        if len(self.number) > CACHE_ENTRIES:
            self.forget()
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        unique, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.number
        new = [w for w in unique if w not in known]
        if new:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, unique), np.int64, len(unique))[coded.indices.to_numpy()]
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        return self.flat[spans(self.start[number], size)], ends[rows]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        flat, at = self.batch(pa.array(texts, pa.string()))
        for lo, hi in zip(at.tolist(), at[1:].tolist()):
            yield flat[lo:hi].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int, closing_id: int = 0,
                 with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc[, ids]) of (id, text) rows. Every text
    gets ``closing_id`` after its ids; only longer ones are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last, step = word_ids(vocab_path), np.array([closing_id], "<u4").tobytes(), 4 * capacity
        for batch in rows_of(batches, "text", SLICE):
            flat, at = coder.batch(batch.column("text"))
            rows, piece, length, crc, ids = [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(at.tolist(), at[1:].tolist())):
                blob = flat[lo:hi].astype("<u4", copy=False).tobytes() + last
                for k in range(0, len(blob), step):
                    cut = blob[k:k + step]
                    rows.append(i)
                    piece.append(k // step)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
            piece = np.array(piece, np.int32)
            cols = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "crc"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        coder.forget()  # the worker goes on to other tasks

    schema = "id long, piece int, start long, length long, crc long" + (", ids array<int>" if with_ids else "")
    return docs.select("id", "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """length -> how often it is used in the fullest bin that holds the longest
    available length. ``order``: available lengths, longest first."""
    top = order[0]
    used = {top: 1}
    room = capacity - top
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        if length > room:
            continue
        many = min(counts[length] - (length == top), room // length)
        k = 1
        while many > 0 and not reach >> room:
            k = min(k, many)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            many -= k
            k *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def slack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins) covering a histogram of lengths."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        used = fullest(counts, order, capacity)
        times = min(counts[k] // u for k, u in used.items())
        out.append((used, times))
        gone = False
        for k, u in used.items():
            counts[k] -= u * times
            gone |= not counts[k]
        if gone:
            order = [k for k in order if counts[k]]
    return out


def slot_table(patterns: list[tuple[dict[int, int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, bins, first sequence, offset), sorted: pieces of
    a length from that rank on fill the slots of one combination, bin by bin."""
    rows, rank, seq = [], {}, 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, rank.get(length, 0), times, seq, offset))
            rank[length] = rank.get(length, 0) + used[length] * times
            offset += length * used[length]
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = 2048, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: id, ``piece`` (from 0), ``start`` (tokens of its document
    before it), ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (place in
    its sequence, gapless from 0), and ``ids`` on request.

    Null and empty texts are one piece holding the closing id. Null ids stay
    null; repeated rows are packed each; equal lengths are interchangeable, and
    ties go by id, piece and checksum. An empty table gives no rows. Other columns
    are ignored. A document is cut only if it is longer than ``capacity``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    pieces = stage(token_pieces(slim, vocab_path, capacity, closing_id, with_ids), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    slots = slot_table(slack_patterns(histogram, capacity), capacity)
    buckets = 1 + sum(histogram.values()) // GROUP_ROWS
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)))
    held = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    first = held.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    number = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece", "crc"))
    ranked = (keyed.withColumn("number", number).join(first, ["length", "bucket"])
              .withColumn("rank", (F.col("first") + F.col("number") - 1).cast("long")).drop("first", "number", "bucket"))
    table = spark.sparkContext.broadcast(slots)  # bounded by the capacity, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = t[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            slot, copy = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)],
                names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in ranked.dtypes) + ", sequence_id long, offset long"
    out = ranked.mapInArrow(place, kinds)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                      "sequence_id", "offset", *(["ids"] if with_ids else []))
