"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring
words and of words with one word between them. Training runs over a bounded
sample of labelled rows: executors turn texts into feature arrays, the driver
applies the per-coordinate FTRL-proximal updates. L1 leaves few non-zero
weights; these are sent to the scoring tasks, which read every text whole in
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WHITE, WordHasher, bound_batches, bounded_sample, carried, map_texts, mix64, rows_of, stage, text_buffer

SEPARATORS = WHITE + bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])


SAMPLE_TASKS = 16  # tasks that turn the training sample into features


@dataclass(frozen=True)
class FtrlParams:
    """``per_label`` rows and ``label_bytes`` bytes of text per label bound the
    training sample; ``bits``: the feature space; ``alpha``, ``beta``, ``l1``,
    ``l2``: the usual FTRL-proximal constants."""

    per_label: int = 6000
    label_bytes: int = 32 << 20
    bits: int = 21
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    epochs: int = 8
    seed: int = 3


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by feature index, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    params: FtrlParams

    def table(self) -> np.ndarray:
        w = np.zeros(1 << self.params.bits, np.float32)
        w[self.index] = self.weight
        return w


def features(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray,
             bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature index) arrays, one pair each for words, word pairs and
    skip pairs; features repeat as they do in the text."""
    words, at = hasher(data, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    shift = np.uint64(64 - bits)
    yield row, (mix64(words) >> shift).astype(np.int64)
    for gap, salt in ((1, 2), (2, 3)):
        same = row[gap:] == row[:-gap]
        left, right = words[:-gap][same], words[gap:][same]
        yield row[gap:][same], (mix64(left * MIX + right * np.uint64(2 * salt + 1)) >> shift).astype(np.int64)


def _feature_rows(rows: DataFrame, p: FtrlParams) -> DataFrame:
    """(label, x): distinct feature indices of each text as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SEPARATORS, seed=p.seed)
        for batch in rows_of(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            row, idx = (np.concatenate(x) for x in zip(*features(hasher, data, offs, p.bits)))
            pair = np.unique((row << p.bits) + idx)
            cut = np.searchsorted(pair >> p.bits, np.arange(batch.num_rows + 1))
            idx = (pair & ((1 << p.bits) - 1)).astype("<i4")
            x = [idx[cut[i]:cut[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(x, pa.binary())],
                                             names=["draw", "label", "x"])

    return rows.select("draw", "label", "text").mapInArrow(run, "draw long, label int, x binary")


def ftrl(examples: list[tuple[int, np.ndarray]], p: FtrlParams) -> ToxicityModel:
    """FTRL-proximal over (label, distinct feature indices), in seeded order."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the intercept, without L1
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in rng.permutation(len(examples)):
            y, idx = examples[i]
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) > p.l1,
                         -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2), 0.0)
            b = -z[size] / ((p.beta + np.sqrt(n[size])) / p.alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[idx] += g - step * w
            n[idx] += g * g
            step = (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / p.alpha
            z[size] += g - step * b
            n[size] += g * g
    zi, ni = z[:size], n[:size]
    on = np.flatnonzero(np.abs(zi) > p.l1)
    w = -(zi[on] - np.sign(zi[on]) * p.l1) / ((p.beta + np.sqrt(ni[on])) / p.alpha + p.l2)
    b = -z[size] / ((p.beta + np.sqrt(n[size])) / p.alpha)
    return ToxicityModel(on, w.astype(np.float32), float(b), p)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "toxic", params: FtrlParams = FtrlParams()) -> ToxicityModel:
    """A model from ``docs`` (id, text) whose id has the label 0 or 1 in
    ``labels`` (id, label); other labels and nulls are left out. The sample is
    drawn among those labels whose id is in ``docs`` (ids alone are joined), so
    that labels of other documents take no place in it, and texts are only read
    where they are drawn and never shuffled for the join. Without usable rows the
    score is 0 for every text."""
    bound_batches(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    present = docs.select(F.col(f"`{id_col}`").alias("id")).distinct()
    marks = stage(marks.filter("label IN (0, 1) AND id IS NOT NULL").distinct().join(present, "id", "left_semi"), "marks")
    # at most 2 * per_label rows: a bounded broadcast
    drawn = bounded_sample(marks, "label", "id", params.per_label, seed=params.seed)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = texts.join(F.broadcast(drawn), "id")
    sample = bounded_sample(found, "label", "id", params.per_label, "text", params.label_bytes,
                            seed=params.seed, counted=False)
    slim = sample.select(F.xxhash64("id", "text").alias("draw"), "label", "text").repartition(SAMPLE_TASKS, "draw")
    # a part at a time, so that the driver holds the packed features once
    found = [(r.draw, r.label, r.x) for r in _feature_rows(slim, params).toLocalIterator()]
    found.sort(key=lambda r: r[:2])
    if not found:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0, params)
    return ftrl([(label, np.frombuffer(x, "<i4")) for _, label, x in found], params)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score",
                   keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: toxic). Null, empty and
    wordless texts get the score of the intercept alone; the columns of ``docs``
    (those to ``keep``, if named) but one named like the score stay; repeated
    rows score alike."""
    src, back = carried(docs, text, (score,), keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, bits = WordHasher(SEPARATORS, seed=model.params.seed), model.table(), model.params.bits
        for batch in rows_of(batches, "text_"):
            data, offs = text_buffer(batch.column("text_"))
            hits = []
            for row, idx in features(hasher, data, offs, bits):
                on = np.flatnonzero(table[idx])
                hits.append((row[on] << bits) + idx[on])
            pair = np.unique(np.concatenate(hits))
            total = np.bincount(pair >> bits, table[pair & ((1 << bits) - 1)], batch.num_rows) + model.intercept
            s = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "s_"])

    out = map_texts(src, run, "s_ double", keep is None or text in keep)
    return out.select(*back, F.col("s_").alias(score))
