"""Near-duplicate classes on word shingles: MinHash, banding, signature
check, exact check on whole sets, connected components.

1. One pass over the texts computes per document its number of distinct
   shingles, a 128-bit hash of its shingle set, ``bands`` hashes of ``rows``
   minima each, and a sketch of one bit per minimum.
2. Documents with equal sets form a class; only its smallest id goes on, so a
   group of copies, however large, is one row from here.
3. Buckets (equal band hashes) propose links in three rounds of growing
   completeness: each document with the best-connected one it meets in any
   bucket; each member of a bucket with the bucket's best-connected one; and
   every pair of a bucket that still lies in two components, except pairs inside
   its largest component. Members already connected are never paired again.
4. In the last round, bitmaps of the shingle sets bound how much two documents
   can share, so edited copies that resemble only their common origin, or texts
   around a shared passage, are not paired with one another. No pair that could
   join two components is left out, and there is no cap.
5. A proposed pair must pass the bit sketch (a bound far below the threshold)
   and is then confirmed on the two whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX, WordHasher, bound_batches, mix64, rows_of, stage, text_buffer, windows_hash
from .components import components


@dataclass(frozen=True)
class NearDupParams:
    """A pair is linked when ``share`` * union <= 100 * intersection.

    ``bands`` x ``rows`` minima: a pair at similarity 0.75 misses all 32 bands
    of 4 with probability (1 - 0.75^4)^32 = 5e-6. ``sketch_bits``: of the bits
    of two sketches at similarity 0.75, 7/8 agree on average; fewer than 90 of
    128 has probability below 1e-8. ``map_bits``: size of the bitmaps of the
    last round.
    """

    words: int = 5
    share: int = 75
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 90
    map_bits: int = 2048
    seed: int = 7


def distinct_shingles(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray,
                      words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and offsets."""
    h, word_offsets = hasher(data, offsets)
    sh, offs = windows_hash(h, word_offsets, words)
    parts, counts = [], np.zeros(len(offs) - 1, np.int64)
    for i in np.flatnonzero(np.diff(offs)):
        s = np.unique(sh[offs[i]:offs[i + 1]])
        parts.append(s)
        counts[i] = len(s)
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return out, np.concatenate([[0], np.cumsum(counts)])


def _minima(sets: np.ndarray, starts: np.ndarray, k: int, seed: int, block: int = 1 << 15) -> np.ndarray:
    """k universal (multiply-add-shift) hash minima of each non-empty set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)
    out = np.full((len(starts), k), np.iinfo(np.uint64).max, np.uint64)
    ends = np.append(starts[1:], len(sets))
    lo = 0
    while lo < len(starts):  # whole sets up to a block of values at a time; a larger set piecewise
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        base, end = int(starts[lo]), int(ends[hi - 1])
        for p in range(base, end, max(block, 1)) if hi == lo + 1 else [base]:
            x = sets[p:min(end, p + block)] if hi == lo + 1 else sets[base:end]
            cut = np.zeros(1, np.int64) if hi == lo + 1 else starts[lo:hi] - base
            tmp = np.empty_like(x)
            for j in range(k):
                np.multiply(x, a[j], out=tmp)
                tmp += b[j]
                tmp >>= np.uint64(32)
                out[lo:hi, j] = np.minimum(out[lo:hi, j], np.minimum.reduceat(tmp, cut))
        lo = hi
    return out


SIGNATURE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def signatures(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, n, h1, h2, s1, s2, bands) of (id, text) rows; n = 0: nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(seed=p.seed)
        k = p.bands * p.rows
        for batch in rows_of(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            sets, so = distinct_shingles(hasher, data, offs, p.words)
            n = np.diff(so)
            some = np.flatnonzero(n)
            size = len(n)
            cols = [np.zeros(size, np.uint64) for _ in range(4)]
            keys = np.zeros((size, p.bands), np.uint64)
            if len(some):
                starts = so[some]
                cols[0][some] = np.add.reduceat(mix64(sets ^ MIX), starts)
                cols[1][some] = np.add.reduceat(mix64(sets + np.uint64(p.seed + 1)), starts)
                m = _minima(sets, starts, k, p.seed)
                bits = (mix64(m) & np.uint64(1)).reshape(len(some), k)
                weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
                half = (k + 1) // 2
                for c, part in ((2, bits[:, :half][:, :64]), (3, bits[:, half:][:, :64])):
                    cols[c][some] = (part * weight[:part.shape[1]]).sum(1, dtype=np.uint64)
                key = np.zeros((len(some), p.bands), np.uint64)
                for r in range(p.rows):
                    key = mix64(key * MIX + m[:, r::p.rows][:, :p.bands])
                keys[some] = mix64(key + np.arange(1, p.bands + 1, dtype=np.uint64) * MIX)
            null = n == 0
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(size + 1) * p.bands, pa.int32()), pa.array(keys.view(np.int64).ravel()),
                mask=pa.array(null))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()),
                 *(pa.array(c.view(np.int64), mask=null) for c in cols), bands],
                names=SIGNATURE.names)

    return docs.select("id", "text").mapInArrow(run, SIGNATURE)


def _similar(p: NearDupParams, a: str, b: str) -> str:
    """SQL bound that every linked pair meets: set sizes and bit sketches."""
    k = min(p.bands * p.rows, 128)
    return (f"100 * least({a}.n, {b}.n) >= {p.share} * greatest({a}.n, {b}.n) AND "
            f"{k} - bit_count({a}.s1 ^ {b}.s1) - bit_count({a}.s2 ^ {b}.s2) >= {p.sketch_bits}")


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed, so that joins move fewer bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in rows_of(batches, "text", 8 << 20):
            data, offs = text_buffer(batch.column("text"))
            out = [z.compress(data[offs[i]:offs[i + 1]].tobytes()) for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "z"])

    return texts.mapInArrow(run, "id long, z binary")


def confirmed(pairs: DataFrame, packed: DataFrame, p: NearDupParams) -> DataFrame:
    """Those (a, b) pairs whose whole shingle sets reach the threshold."""
    left = packed.select(F.col("id").alias("a"), F.col("z").alias("za"))
    right = packed.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, z = WordHasher(seed=p.seed), zstandard.ZstdDecompressor()
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def shingles(blob: bytes) -> np.ndarray:
            data = np.frombuffer(z.decompress(blob), np.uint8)
            return distinct_shingles(hasher, data, np.array([0, len(data)]), p.words)[0]

        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                if last[0] != a:
                    last = (a, shingles(batch.column("za")[i].as_py()))
                x, y = last[1], shingles(batch.column("zb")[i].as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= p.share * (len(x) + len(y) - same):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with components merged along links between nodes."""
    comp = stage(components(links), "components")
    return (members.withColumnRenamed("comp", "node")
            .join(comp, "node", "left")
            .select(*[c for c in members.columns if c != "comp"],
                    F.coalesce("component", "node").alias("comp")))


def _open(members: DataFrame) -> DataFrame:
    """Members of those buckets that lie in more than one component. What is
    known per bucket is a table of its own before it is joined back, so that AQE
    can split a hot bucket (it can't where the join shares the grouping's shuffle)."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo_"), F.max("comp").alias("hi_"))
    return members.join(stage(mixed.filter("lo_ <> hi_").select("key"), "mixed"), "key", "left_semi")


def _still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    return stage(_open(stage(_relabel(members, links), "labelled")), "open")


def _bitmaps(members: DataFrame, packed: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, level, bits): a bitmap of ``map_bits`` bits over the shingles of each
    member whose hash has ``level`` zero bits at its end; level 0 takes them all
    and is used up to a quarter of the bits, each further level halves them."""
    words = p.map_bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, z = WordHasher(seed=p.seed), zstandard.ZstdDecompressor()
        for batch in batches:
            levels, maps = [], []
            for blob in batch.column("z"):
                data = np.frombuffer(z.decompress(blob.as_py()), np.uint8)
                s = distinct_shingles(hasher, data, np.array([0, len(data)]), p.words)[0]
                level = max(0, (4 * len(s) // p.map_bits).bit_length())
                s = s[s & np.uint64((1 << level) - 1) == 0] >> np.uint64(32)
                bit = (s % np.uint64(p.map_bits)).astype(np.int64)
                on = np.zeros(p.map_bits, np.uint8)
                on[bit] = 1
                levels.append(level)
                maps.append(np.packbits(on).view(np.int64))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1) * words, pa.int32()),
                                            pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(levels, pa.int32()), bits],
                                             names=["id", "level", "bits"])

    nodes = members.select("id").distinct()
    return packed.join(nodes, "id", "left_semi").mapInArrow(run, "id long, level int, bits array<long>")


def _may_link(p: NearDupParams, a: str, b: str) -> str:
    """SQL test on bitmaps that every linked pair of equal level passes: the
    shingles of ``a`` missing from ``b`` are at most those that a link allows
    (exactly at level 0; with six standard deviations of room above)."""
    room = f"({a}.n - {p.share}D * ({a}.n + {b}.n) / {100 + p.share})"
    seen = f"aggregate(zip_with({a}.bits, {b}.bits, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    scale = f"shiftleft(1L, {a}.level)"
    return (f"({a}.level <> {b}.level OR {scale} * {seen} <= {room} + "
            f"if({a}.level = 0, 0D, 6 * sqrt({room} * {scale})))")


def link_components(docs: DataFrame, sigs: DataFrame, p: NearDupParams) -> DataFrame:
    """(h1, h2, n, comp): the component of every class of equal sets."""
    reps = stage(sigs.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n")
                 .agg(F.min(F.struct("id", "s1", "s2", "bands")).alias("r"))
                 .select("h1", "h2", "n", "r.*"), "classes")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = stage(keyed.join(stage(shared, "shared"), "key"), "buckets")
    degree = met.groupBy("id").agg(F.sum("c").alias("deg"))  # how many others it meets, over all buckets
    about = stage(reps.select("id", "n", "s1", "s2").join(degree, "id"), "nodes")
    members = stage(met.select("key", "id", F.col("id").alias("comp")).join(about, "id"), "members")
    # merge join at every size: the nodes grow with the corpus
    packed = stage(_packed(docs.select("id", "text").join(about.select("id").hint("merge"), "id", "left_semi")), "texts")

    # round 1: the best-connected document met in any bucket
    best = F.max(F.struct("deg", (-F.col("id")).alias("k"))).alias("lead")
    lead = stage(members.groupBy("key").agg(best), "leads")
    first = (members.select("key", "id").join(lead, "key").groupBy("id").agg(F.max("lead").alias("lead"))
             .select("id", (-F.col("lead.k")).alias("lead")).filter("id <> lead"))
    pairs = (first.join(about, "id").alias("x")
             .join(about.withColumnRenamed("id", "lead").alias("y"), "lead")
             .filter(_similar(p, "x", "y"))
             .select(F.col("lead").alias("a"), F.col("x.id").alias("b")))
    links = stage(confirmed(pairs, packed, p), "links")
    found = [links]
    members = _still_open(members, links)

    for everything in (False, True):
        if members.isEmpty():
            break
        if everything:  # round 3: all pairs between components, but none inside a bucket's largest
            members = stage(members.join(_bitmaps(members, packed, p), "id"), "bitmaps")
            size = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
            main = size.groupBy("key").agg(F.max(F.struct("c", (-F.col("comp")).alias("k"))).alias("m")) \
                .select("key", (-F.col("m.k")).alias("main"))
            x = members.join(stage(main, "mains"), "key").filter("comp <> main").alias("x")
            meet = F.expr("x.key = y.key AND x.comp <> y.comp AND (y.comp = x.main OR x.id < y.id) AND "
                          + " AND ".join([_similar(p, "x", "y"), _may_link(p, "x", "y"), _may_link(p, "y", "x")]))
        else:  # round 2: the best-connected document of each bucket
            chief = members.groupBy("key").agg(F.max(F.struct(
                "deg", (-F.col("id")).alias("k"), "id", "comp", "n", "s1", "s2")).alias("r"))
            x = stage(chief.select("key", "r.id", "r.comp", "r.n", "r.s1", "r.s2"), "chiefs").alias("x")
            meet = F.expr("x.key = y.key AND x.comp <> y.comp AND " + _similar(p, "x", "y"))
        pairs = (x.join(members.alias("y"), meet)
                 .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        links = stage(confirmed(pairs, packed, p), "links")
        found.append(links)
        if not everything:  # node links become links between components
            comp = members.select(F.col("id").alias("node"), "comp").distinct()
            merged = (links.join(comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u")
                      .join(comp.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v")
                      .select(F.col("cu").alias("u"), F.col("cv").alias("v")))
            members = _still_open(members, merged)

    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    comp = components(edges)
    return (reps.select("h1", "h2", "n", "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
            .select("h1", "h2", "n", F.coalesce("component", "id").alias("comp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    params: NearDupParams = NearDupParams()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of non-blank characters, A-Z lowered; a text of fewer words
    than ``words`` is one shingle. Null, empty and blank texts have no shingle
    and are linked with nothing. ``component_id`` is the smallest id reachable
    over links; ``kept`` marks the row whose id it is. Rows with a null id take
    part in no link: component null, kept. Exactly repeated rows share a class
    and all carry its result. An empty table gives no rows. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sigs = stage(signatures(slim, params), "signatures")
    comp = link_components(slim, sigs, params)
    out = sigs.select("id", "n", "h1", "h2").join(comp, ["h1", "h2", "n"], "left")
    group = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))
