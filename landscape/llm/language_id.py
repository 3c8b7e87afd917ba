"""Language identification by a byte convolutional network.

A text is cut into overlapping windows of a fixed number of bytes that cover
it whole. In every window, filters of several widths slide over embedded
bytes, each filter keeps its largest response (max pooling), and a softmax
layer turns the responses into language probabilities; a text's probabilities
are the mean over its windows, weighted by their bytes. The network is trained
in numpy on windows of a bounded sample of labelled texts and, where asked for,
on made-up noise as a class of its own, so that it can reject. For inference the
embedding and the filters fold into tables over pairs of byte classes, so the
convolution is a few table look-ups per byte, whole batches of windows at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, carried, map_texts, mix64, rows_of, text_buffer

UNKNOWN = "und"


@dataclass(frozen=True)
class ConvParams:
    """``per_language`` texts and ``language_bytes`` bytes of text per language
    bound the training sample; with more than ``languages`` languages, each has
    fewer texts, and none is left out;
    ``sample_windows`` windows are drawn from each text, anywhere in it. Training
    runs ``epochs`` times over them, or more often up to ``least_steps`` batches.
    ``noise``: windows of made-up noise, as a multiple of those of an average
    language (0: none); a text that is noise with a probability of more than
    ``doubt`` is in no language. Made-up noise differs from the labelled texts, so
    that clean ones stay far below it."""

    window: int = 96
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embed: int = 8
    per_language: int = 1000
    language_bytes: int = 16 << 20
    languages: int = 64
    sample_windows: int = 6
    epochs: int = 8
    least_steps: int = 800
    batch: int = 128
    rate: float = 0.01
    noise: float = 0.0
    doubt: float = 0.5
    seed: int = 9


def byte_classes() -> np.ndarray:
    """Class of each byte: letters without case, one class each for digits and
    blanks, the other bytes by themselves; class 0 pads."""
    out = np.zeros(256, np.int64)
    seen: dict[object, int] = {}
    for b in range(256):
        c = chr(b)
        key: object = "0" if c in "0123456789" else " " if b <= 32 else c.lower() if b < 128 else b
        out[b] = seen.setdefault(key, len(seen) + 1)
    return out


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, bytes held) of windows that cover every row whole; an empty
    row has none."""
    length = np.diff(offsets)
    step = size - overlap
    count = np.where(length > 0, np.maximum(1, -(-(length - overlap) // step)), 0)
    row = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + k * step
    return row, start, np.minimum(size, offsets[1:][row] - start)


def window_classes(data: np.ndarray, start: np.ndarray, held: np.ndarray, size: int) -> np.ndarray:
    """Byte classes of windows, padded with class 0."""
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < held[:, None]
    return np.where(inside, CLASSES[data[np.where(inside, at, 0)]], 0)


#: first and last letters of scripts, for made-up text
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x628, 0x64A), (0x905, 0x939), (0xE01, 0xE2E),
           (0x10D0, 0x10F0), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def made_up_noise(x: np.ndarray, count: int, p: ConvParams) -> np.ndarray:
    """``count`` windows of byte classes that are no text: random letters in
    words, hex, base64, mark-up, symbols, one repeated letter, and random letters
    of scripts that the labelled windows ``x`` hardly hold."""
    rng = np.random.default_rng(p.seed + 1)
    held = np.bincount(x.ravel(), minlength=N_CLASSES) / max(1, (x > 0).sum())
    scripts = [s for s in SCRIPTS if all(held[CLASSES[chr(c).encode()[0]]] < 0.002 for c in s)]
    lower = "abcdefghijklmnopqrstuvwxyz"

    def word(letters: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(list(letters), rng.integers(lo, hi)))

    def mark() -> str:
        return f"<{word(lower, 1, 6)} {word(lower, 1, 4)}=\"{word(lower + '0123456789#-;:', 2, 12)}\">" + word("<>/={}();&|\n\t ", 1, 6)

    def foreign() -> str:
        lo, hi = scripts[rng.integers(len(scripts))]
        return "".join("".join(map(chr, rng.integers(lo, hi + 1, rng.integers(1, 12)))) + " " for _ in range(20))

    kinds = [lambda: " ".join(word(lower, 1, 13) for _ in range(16)), lambda: word(lower, 96, 97),
             lambda: word("0123456789abcdef", 96, 97), lambda: " ".join(word("0123456789abcdef", 2, 17) for _ in range(20)),
             lambda: word(lower + lower.upper() + "0123456789+/", 96, 97), lambda: "".join(mark() for _ in range(8)),
             lambda: word("!#$%&()*+,-./:;<=>?@[]^_{|}~ 0123456789", 90, 91) + word(lower, 1, 6), lambda: word(lower, 1, 2) * 96]
    kinds += [foreign, foreign] if scripts else []
    out = np.zeros((count, p.window), np.int64)
    for i in range(count):
        data = np.frombuffer(kinds[i % len(kinds)]().encode(), np.uint8)
        size = min(p.window if rng.random() < 0.6 else int(rng.integers(16, p.window + 1)), len(data))
        out[i, :size] = CLASSES[data[:size]]
    return out


@dataclass
class ConvModel:
    languages: list[str]               # the class of noise, if any, comes after them
    embedding: np.ndarray              # classes x embed
    kernels: list[np.ndarray]          # width x embed x filters
    bias: np.ndarray                   # all filters
    dense: np.ndarray                  # all filters x languages
    dense_bias: np.ndarray
    params: ConvParams

    def tables(self) -> list[list[np.ndarray]]:
        """Per width: pair tables (and a last single table if the width is odd)."""
        out = []
        for kernel in self.kernels:
            single = [(self.embedding @ k).astype(np.float32) for k in kernel]
            out.append([(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(N_CLASSES * N_CLASSES, -1)
                        if j + 1 < len(single) else single[j] for j in range(0, len(single), 2)])
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Languages of windows of byte classes."""
        pair = x[:, :-1] * N_CLASSES + x[:, 1:]
        pooled = []
        for width, parts in zip(self.params.widths, tables):
            n = x.shape[1] - width + 1
            z = parts[0][pair[:, :n]]
            for j, t in enumerate(parts[1:], 1):
                z += t[(pair if 2 * j + 1 < width else x)[:, 2 * j:2 * j + n]]
            pooled.append(z.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        logit = h @ self.dense + self.dense_bias
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], p: ConvParams) -> ConvModel:
    """Adam on the cross entropy of windows ``x`` (byte classes) and labels ``y``."""
    rng = np.random.default_rng(p.seed)
    classes = len(languages) + (p.noise > 0)
    f = p.filters
    w = {"e": rng.normal(0, 0.3, (N_CLASSES, p.embed)), "b": np.zeros(f * len(p.widths)),
         "d": rng.normal(0, 0.3, (f * len(p.widths), classes)), "c": np.zeros(classes)}
    for k in p.widths:
        w[f"k{k}"] = rng.normal(0, (2 / (k * p.embed)) ** 0.5, (k, p.embed, f))
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    t = 0
    for _ in range(max(p.epochs, -(-p.least_steps * p.batch // len(x)))):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), p.batch):
            bx, by = x[order[lo:lo + p.batch]], y[order[lo:lo + p.batch]]
            n, emb = len(bx), w["e"][bx]
            pooled, where = [], []
            for k in p.widths:
                size = bx.shape[1] - k + 1
                z = sum(emb[:, j:j + size] @ w[f"k{k}"][j] for j in range(k))
                at = z.argmax(axis=1)
                where.append(at)
                pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + w["b"]
            h = np.maximum(pre, 0)
            logit = h @ w["d"] + w["c"]
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(n), by] -= 1
            prob /= n
            g = {"d": h.T @ prob, "c": prob.sum(0)}
            dh = (prob @ w["d"].T) * (pre > 0)
            g["b"] = dh.sum(0)
            g["e"] = np.zeros_like(w["e"])
            for i, k in enumerate(p.widths):
                dz, at = dh[:, i * f:(i + 1) * f], where[i]
                gk = np.zeros_like(w[f"k{k}"])
                for j in range(k):
                    cls = np.take_along_axis(bx, at + j, 1)          # n x filters
                    gk[j] = np.einsum("nfe,nf->ef", w["e"][cls], dz)
                    np.add.at(g["e"], cls, dz[:, :, None] * w[f"k{k}"][j].T[None])
                g[f"k{k}"] = gk
            t += 1
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] -= p.rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    return ConvModel(languages, w["e"], [w[f"k{k}"] for k in p.widths], w["b"].astype(np.float32),
                     w["d"].astype(np.float32), w["c"].astype(np.float32), p)


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                    params: ConvParams = ConvParams()) -> ConvModel | None:
    """A network from rows with a non-null text and language; None without any."""
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"),
                           F.col(f"`{lang}`").alias("lang"))
    sample = bounded_sample(rows, "lang", "id", params.per_language, "text", params.language_bytes,
                            groups=params.languages, seed=params.seed)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            row, start, held = cut_windows(data, offs, params.window, max(params.widths) - 1)
            if not len(row):
                continue
            draw = batch.column("draw").to_numpy()[row].view(np.uint64)
            first = np.searchsorted(row, row)
            key = mix64(draw + (np.arange(len(row)) - first).astype(np.uint64))
            order = np.lexsort((key, row))
            pick = np.sort(order[np.arange(len(row)) - first < params.sample_windows])
            x = window_classes(data, start[pick], held[pick], params.window).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick].view(np.int64)), batch.column("lang").take(pa.array(row[pick])),
                 pa.array([r.tobytes() for r in x], pa.binary())], names=["draw", "lang", "x"])

    found = (sample.select(F.xxhash64("id", "text").alias("draw"), "lang", "text")
             .mapInArrow(windows, "draw long, lang string, x binary").collect())
    if not found:
        return None
    found.sort(key=lambda r: (r.draw, r.lang, r.x))
    names = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(names)}
    x = np.frombuffer(b"".join(r.x for r in found), np.uint8).reshape(len(found), -1).astype(np.int64)
    y = np.array([place[r.lang] for r in found])
    noise = made_up_noise(x, math.ceil(params.noise * len(x) / len(names)), params)
    return train(np.concatenate([x, noise]), np.append(y, np.full(len(noise), len(names))), names, params)


def identify_languages(docs: DataFrame, model: ConvModel | None, text: str = "text",
                       lang_pred: str = "lang_pred", score: str = "score", keep: Sequence[str] | None = None,
                       block: int = 256) -> DataFrame:
    """``docs`` with the predicted language and its probability.

    ``und`` with score 0 where the text is null or has no letter, or where
    nothing could be learned; ``und`` with the probability of noise where a model
    that knows noise finds more of it than ``doubt``. The columns of ``docs`` (those to ``keep``, if
    named) but those named like the results stay; repeated rows get the same result.
    """
    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    src, back = carried(docs, text, (lang_pred, score), keep, letter_=letter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else []
        names = np.array([*model.languages, UNKNOWN], object) if model else np.array([UNKNOWN], object)
        for batch in rows_of(batches, "text_"):
            n = batch.num_rows
            best, top = np.full(n, len(names) - 1), np.zeros(n)
            if model:
                data, offs = text_buffer(batch.column("text_"))
                row, start, held = cut_windows(data, offs, model.params.window, max(model.params.widths) - 1)
                total = np.zeros((n, len(model.dense_bias)))
                for lo in range(0, len(row), block):
                    part = slice(lo, lo + block)
                    x = window_classes(data, start[part], held[part], model.params.window)
                    np.add.at(total, row[part], model.probabilities(x, tables) * held[part, None])
                ok = np.flatnonzero(batch.column("letter_").to_numpy(zero_copy_only=False) & (np.diff(offs) > 0))
                share = total[ok] / total[ok].sum(axis=1, keepdims=True)
                known = share[:, :len(model.languages)]
                best[ok], top[ok] = known.argmax(axis=1), known.max(axis=1)
                noise = 1 - known.sum(axis=1)
                no = (noise > model.params.doubt) & (share.shape[1] > known.shape[1])
                best[ok[no]], top[ok[no]] = len(names) - 1, noise[no]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(np.clip(top, 0, 1))],
                names=[*batch.schema.names, "l_", "s_"])

    out = map_texts(src, run, "l_ string, s_ double", keep is None or text in keep)
    return out.select(*back, F.col("l_").alias(lang_pred), F.col("s_").alias(score))
