"""Alignment of two tokenizers by an associative fragment monoid.

A document's bytes are cut into ranges; a token belongs to the range its last
byte lies in. The fragment of a range is what can be said without its
neighbours: the open prefix (tokens up to the first offset where tokens of both
sides end), the closed groups between such offsets, and the open suffix behind
the last. Two neighbouring fragments compose: suffix and prefix between them
close into one group, or, without a common end, stay open. The operation is
associative, so the ranges of a document may be worked on in any tasks and
composed in a tree.

Short documents are composed in the task that reads them. The text of a long one
is cut before words, where no token of either side can cross; the pieces are
tokenised by many tasks, each giving the fragments of its ranges, and neighbours
are composed in rounds, eight at a time, until one fragment is left.

Inside a group the tokens whose bytes overlap are linked. How many documents
hold a linked pair of ids is counted over the whole table. The commonest pairs,
up to a bound, are sent to all tasks; the others are joined.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, rows_of, stage
from .token_counts import byte_symbols

NONE = np.zeros(0, np.int64)
WORDS_KEPT = 500_000  # words per Python worker; forgotten when full
SPACES = regex.compile(r"\s |\s$")  # a blank after white space: tokens may reach over it


@dataclass(frozen=True)
class AlignParams:
    """``chunk``: bytes of a range; ``long_text``: bytes from which a document is
    spread over tasks, in pieces of about ``piece`` characters; ``fan``: fragments
    composed at once; ``sent``: pairs sent to all tasks, at most."""

    chunk: int = 1 << 14
    long_text: int = 1 << 18
    piece: int = 1 << 17
    fan: int = 8
    sent: int = 1 << 20


# ------------------------------------------------------------------ tokenizers

class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
                        for i, x in enumerate(pieces)]
        #: may a text be cut before a blank that follows no white space? Not if a piece reaches over it
        self.divisible = not any("▁" in x.lstrip("▁") for i, x in enumerate(pieces)
                                 if not (self.b.is_control(i) or self.b.is_unknown(i)))
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: a comma, the bar behind the A ids, the end of a group
        self.digits = [b"%d%s" % (i, s) for i in range(max(len(self.a_bytes), n)) for s in (b",", b"|", b";")]

        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """(A ids, A ends, B ids, B ends) of texts that begin with a blank; None
        where the tokens of either side don't spell the text. Where no token can
        reach over a blank, words are encoded once and remembered."""
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        apart = [self.divisible and not SPACES.search(t) for t in texts]
        words = [t.split(" ")[1:] if alone else [t[1:]] for t, alone in zip(texts, apart)]
        new = list(set(chain.from_iterable(words)).difference(self.known))
        for i in range(0, len(new), 8192):
            part = new[i:i + 8192]
            one = self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False)
            for w, e, b in zip(part, one, self.b.encode(part, num_threads=1)):
                raw, a = (" " + w).encode(), e.ids
                spelt = b"".join([self.a_bytes[x] for x in a]) == raw and b"".join([self.b_bytes[x] for x in b]) == raw
                self.known[w] = (array("i", a).tobytes(), array("i", b).tobytes()) if spelt else None
        for ws, alone in zip(words, apart):
            found = [self.known[w] for w in ws]
            if None in found:
                yield None
            else:
                a, b = (np.frombuffer(b"".join([f[side] for f in found]), np.int32).astype(np.int64) for side in (0, 1))
                yield a, np.cumsum(self.a_len[a]), b, np.cumsum(self.b_len[b])
            if not alone:
                self.known.pop(ws[0], None)  # a whole text


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


# ------------------------------------------------------------------- fragments

@dataclass(frozen=True)
class Run:
    """Tokens of a stretch without a common end inside: ids and ends of both sides."""

    a: np.ndarray = field(default_factory=lambda: NONE)
    a_end: np.ndarray = field(default_factory=lambda: NONE)
    b: np.ndarray = field(default_factory=lambda: NONE)
    b_end: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: Run) -> Run:
        return Run(*(np.concatenate([x, y]) for x, y in zip(vars(self).values(), vars(other).values())))


@dataclass(frozen=True)
class Fragment:
    """``head`` | closed groups | ``tail``. Without a common end (``cut`` false) all
    tokens are in the head. ``text`` spells the closed groups, each with a ';'
    behind it; ``pairs`` and ``many`` are their distinct linked id pairs, A << 32 | B."""

    cut: bool = False
    head: Run = Run()
    tail: Run = Run()
    n_a: int = 0
    n_b: int = 0
    groups: int = 0
    text: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: NONE)
    many: np.ndarray = field(default_factory=lambda: NONE)


def _tallied(pairs: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if many is None:
        return np.unique(pairs, return_counts=True)
    keys, at = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(at, many, len(keys)).astype(np.int64)


def closed(run: Run, digits: list[bytes], cuts: np.ndarray) -> Fragment:
    """The groups of a run that ends at the last of its common ends ``cuts``."""
    of_a, of_b = np.searchsorted(cuts, run.a_end), np.searchsorted(cuts, run.b_end)
    codes = np.empty(len(of_a) + len(of_b), np.int64)
    codes[np.arange(len(of_a)) + np.searchsorted(of_b, of_a)] = 3 * run.a + (run.a_end == cuts[of_a])
    codes[np.arange(len(of_b)) + np.searchsorted(of_a, of_b, side="right")] = 3 * run.b + 2 * (run.b_end == cuts[of_b])
    # between neighbouring ends of either side lies exactly one overlap of two tokens
    ends = np.union1d(run.a_end, run.b_end)
    link = (run.a[np.searchsorted(run.a_end, ends)] << 32) + run.b[np.searchsorted(run.b_end, ends)]
    return Fragment(True, n_a=len(run.a), n_b=len(run.b), groups=len(cuts),
                    text=b"".join(map(digits.__getitem__, codes.tolist())), **dict(zip(("pairs", "many"), _tallied(link))))


def fragment(run: Run, digits: list[bytes], first: bool) -> Fragment:
    """The fragment of a byte range; the ``first`` of a document begins at a cut."""
    cuts = np.intersect1d(run.a_end, run.b_end, assume_unique=True)
    if not len(cuts):
        return Fragment(True, tail=run) if first else Fragment(False, head=run)

    def part(lo: int, hi: int) -> Run:
        (i, j), (k, m) = (np.searchsorted(e, [lo, hi], side="right") for e in (run.a_end, run.b_end))
        return Run(run.a[i:j], run.a_end[i:j], run.b[k:m], run.b_end[k:m])

    start = -1 if first else int(cuts[0])
    inner = cuts if first else cuts[1:]
    body = closed(part(start, int(cuts[-1])), digits, inner) if len(inner) else Fragment(True)
    return replace(body, head=part(-1, start), tail=part(int(cuts[-1]), 1 << 62))


def compose(x: Fragment, y: Fragment, digits: list[bytes]) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.cut:
        return replace(y, head=x.head + y.head)
    if not y.cut:
        return replace(x, tail=x.tail + y.head)
    mid = x.tail + y.head
    parts = [x, closed(mid, digits, mid.a_end[-1:]), y]
    pairs, many = _tallied(np.concatenate([p.pairs for p in parts]), np.concatenate([p.many for p in parts]))
    return Fragment(True, x.head, y.tail, sum(p.n_a for p in parts), sum(p.n_b for p in parts),
                    sum(p.groups for p in parts), b"".join([p.text for p in parts]), pairs, many)


def tree(parts: list[Fragment], digits: list[bytes]) -> Fragment:
    while len(parts) > 1:
        parts = [compose(*parts[i:i + 2], digits) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def ranges(tokens: tuple[np.ndarray, ...], offset: int, chunk: int) -> Iterator[Run]:
    """The tokens of each byte range that has any; ``offset``: where in the document the tokens begin."""
    a, a_end, b, b_end = tokens
    if not len(a):
        return
    a_end, b_end = a_end + offset, b_end + offset
    for c in range(offset // chunk, int(a_end[-1] - 1) // chunk + 1):
        (i, j), (k, m) = (np.searchsorted(e, [c * chunk, (c + 1) * chunk], side="right") for e in (a_end, b_end))
        if j > i or m > k:
            yield Run(a[i:j], a_end[i:j], b[k:m], b_end[k:m])


def _of_ranges(tokens: tuple[np.ndarray, ...], start: int, digits: list[bytes], chunk: int) -> Fragment:
    return tree([fragment(r, digits, start == 0 and k == 0) for k, r in enumerate(ranges(tokens, start, chunk))], digits)


# ------------------------------------------------------------------ Spark side

DOCUMENT = "id string, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, many array<long>"
FRAGMENT = ("row long, id string, seq long, ok boolean, cut boolean, n_a long, n_b long, groups long, text binary, "
            "pairs binary, many binary, head binary, tail binary")
SAFE = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")  # where no token of either side reaches over


def _documents(ids: list, parts: list[Fragment | None]) -> pa.RecordBatch:
    """Rows of whole documents; None: no tokens."""
    some = [p or Fragment() for p in parts]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p.pairs) for p in some])]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([getattr(p, c) for p in some] or [NONE]), pa.int64()))
             for c in ("pairs", "many")]
    shas = [hashlib.sha256(p.text[:-1]).hexdigest() if p.groups else "" for p in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), *(pa.array([getattr(p, c) for p in some], pa.int64()) for c in ("n_a", "n_b", "groups")),
         pa.array(shas, pa.string()), *lists], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "many"])


def _short(docs: DataFrame, paths: tuple[str, str], p: AlignParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(*paths)
        for batch in rows_of(batches, "text"):
            texts = [" " + t if t else "" for t in batch.column("text").to_pylist()]
            done: list[Fragment | None] = []
            coded = s.tokens([t for t in texts if t])
            for t in texts:
                found = next(coded) if t else None
                done.append(found and _of_ranges(found, 0, s.digits, p.chunk))
            yield _documents(batch.column("id").to_pylist(), done)

    return docs.mapInArrow(run, DOCUMENT)


def _pieces(docs: DataFrame, paths: tuple[str, str], p: AlignParams) -> DataFrame:
    """(row, id, piece, start, text): long texts, a blank before them, cut before
    words; ``start``: bytes of the document before the piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divisible = sides(*paths).divisible
        for batch in rows_of(batches, "text"):
            for row, i, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
                text, lo, start, number = " " + text, 0, 0, 0
                while lo < len(text):
                    cut = SAFE.search(text, pos=lo + p.piece) if divisible and len(text) - lo > 2 * p.piece else None
                    hi = cut.start() if cut else len(text)
                    part = text[lo:hi]
                    yield pa.RecordBatch.from_pylist([{"row": row, "id": i, "piece": number, "start": start, "text": part}],
                                                     pa.schema([("row", pa.int64()), ("id", pa.string()), ("piece", pa.int64()),
                                                                ("start", pa.int64()), ("text", pa.string())]))
                    lo, start, number = hi, start + len(part.encode()), number + 1

    return docs.mapInArrow(run, "row long, id string, piece long, start long, text string")


def _packed(run: Run) -> bytes:
    return np.concatenate([[len(run.a)], run.a, run.a_end, run.b, run.b_end]).astype("<i8").tobytes()


def _run(blob: bytes) -> Run:
    x = np.frombuffer(blob, "<i8")
    n = int(x[0])
    m = (len(x) - 1 - 2 * n) // 2
    return Run(x[1:1 + n], x[1 + n:1 + 2 * n], x[1 + 2 * n:1 + 2 * n + m], x[1 + 2 * n + m:])


def _row(row: int, i: str | None, seq: int, f: Fragment | None) -> pa.RecordBatch:
    ok, f = f is not None, f or Fragment()
    values = [row, i, seq, ok, f.cut, f.n_a, f.n_b, f.groups, f.text, f.pairs.astype("<i8").tobytes(),
              f.many.astype("<i8").tobytes(), _packed(f.head), _packed(f.tail)]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in FRAGMENT.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, k in zip(values, types)], names=list(names))


def _read(r: dict) -> Fragment | None:
    return Fragment(r["cut"], _run(r["head"]), _run(r["tail"]), r["n_a"], r["n_b"], r["groups"], r["text"],
                    np.frombuffer(r["pairs"], "<i8"), np.frombuffer(r["many"], "<i8")) if r["ok"] else None


def _long(docs: DataFrame, paths: tuple[str, str], p: AlignParams) -> DataFrame:
    """Documents spread over tasks: fragments of all ranges, composed in rounds."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    pieces = stage(_pieces(rows, paths, p), "pieces")
    spread = max(1, pieces.count() // 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(*paths)
        for batch in rows_of(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("row", "id", "piece", "start")]
            for row, i, piece, start, found in zip(*columns, s.tokens(batch.column("text").to_pylist())):
                yield _row(row, i, piece, found and _of_ranges(found, start, s.digits, p.chunk))

    parts = stage(pieces.repartition(spread, "row", "piece").mapInArrow(cut, FRAGMENT), "fragments")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        found = [_read(r) for r in table.sort_by("seq").to_pylist()]
        whole = None if any(f is None for f in found) else tree(found, sides(*paths).digits)
        return pa.Table.from_batches([_row(key[0].as_py(), table["id"][0].as_py(), key[1].as_py(), whole)])

    while (parts.agg(F.max("seq")).first()[0] or 0) > 0:
        parts = stage(parts.groupBy("row", F.expr(f"seq DIV {p.fan}").alias("up")).applyInArrow(merge, FRAGMENT), "fragments")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield _documents([r["id"] for r in rows], [_read(r) for r in rows])

    return parts.mapInArrow(finish, DOCUMENT)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text",
                 params: AlignParams = AlignParams()) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, pairs, many) for every row of
    ``docs``, the linked id pairs (A << 32 | B) and how often each is linked.

    Null and empty texts, and texts that the tokens of either side don't spell,
    have no tokens: zeros, an empty digest, no pairs. Null ids stay null, repeated
    rows give one row each, other columns are ignored, an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    p, paths = params, (a_path, b_path)
    slim = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    long = F.coalesce(F.octet_length("text") > p.long_text, F.lit(False))
    done = _short(slim.filter(~long), paths, p).unionByName(_long(slim.filter(long), paths, p))
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): how many rows hold each linked pair."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def score_links(aligned: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """``aligned`` without its pairs, with ``n_links``, ``n_best`` (links whose
    pair is held by as many rows as any pair of its A id) and ``count_sum`` (over
    links, rows that hold the pair)."""
    spark = aligned.sparkSession
    held = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(held), "pairs")
    # a power of two from which on pairs are sent to all tasks: no more than ``sent`` of them
    bits = {r.b: r.n for r in counts.groupBy((F.length(F.bin("docs")) - 1).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    floor, room = 1 + max(bits, default=0), params.sent
    while floor > 1 and bits.get(floor - 1, 0) <= room:
        floor -= 1
        room -= bits.get(floor, 0)
    least = 1 << floor  # pairs of fewer rows are not sent; 2: only those of one row, which need no table
    common = counts.filter(F.col("docs") >= least).orderBy("pair").toArrow()
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("docs")).toArrow()  # <= A's vocabulary
    top = np.zeros(1 + int(max(best["a"].to_numpy(), default=0)), np.int64)
    top[best["a"].to_numpy()] = best["docs"].to_numpy()
    sent = spark.sparkContext.broadcast((common["pair"].to_numpy().copy(), common["docs"].to_numpy().copy(), top))
    keep = [c for c in held.columns if c not in ("pairs", "many")]

    def looked_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold each pair, and where that is known."""
        keys, docs, _ = sent.value
        if not len(keys):
            return np.ones(len(pair), np.int64), np.full(len(pair), least == 2)
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[at] == pair
        return np.where(hit, docs[at], 1), hit | (least == 2)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("pairs")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return (np.repeat(np.arange(batch.num_rows), size), np.asarray(lists.flatten()).astype(np.int64),
                np.asarray(batch.column("many").flatten()).astype(np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value[2]
        for batch in batches:
            owner, pair, many = flat(batch)
            docs, known = looked_up(pair)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in
                    (many, many * (known & (docs == top[pair >> 32])), many * docs * known)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.diff(x)) for x in sums)],
                                             names=[*keep, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in held.dtypes if k in keep)
    out = held.mapInArrow(score, kinds + ", n_links long, n_best long, count_sum long")
    if least > 2:  # the other pairs: rare ones, so no key of the join is hot
        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, pair, many = flat(batch)
                new = np.flatnonzero(~looked_up(pair)[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(owner[new])), pa.array(pair[new]), pa.array(many[new])],
                    names=["row", "pair", "many"])

        per_a = F.broadcast(spark.createDataFrame(best))  # as many rows as A has ids, at most
        rare = counts.filter(F.col("docs") < least)
        met = (held.select("row", "pairs", "many").mapInArrow(rest, "row long, pair long, many long").join(rare, "pair")
               .join(per_a.select("a", F.col("docs").alias("top")), F.shiftright("pair", 32) == F.col("a")))
        more = met.groupBy("row").agg(F.sum(F.expr("if(docs = top, many, 0)")).alias("b_"), F.sum(F.expr("many * docs")).alias("c_"))
        out = (out.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b_", F.lit(0)))
               .withColumn("count_sum", F.col("count_sum") + F.coalesce("c_", F.lit(0))).drop("b_", "c_"))
    return out.drop("row")
