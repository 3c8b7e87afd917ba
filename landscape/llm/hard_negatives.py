"""Hard negatives of anchors, found in an R-tree packed by sort-tile-recursion.

Rows are tiled by label and then by the coordinates of largest variance: each
step cuts every tile at quantiles of the next coordinate, counted over all rows.
A tile of bounded size is a subtree, packed in one task in the same way down to
leaves; every node keeps its minimum bounding box and its interval of labels.
The boxes of the subtrees' roots, bounded in bytes, are known to every task.

For a query q the inner product with any point of a box lies between the sums of
min(q_i * lo_i, q_i * hi_i) and of max(q_i * lo_i, q_i * hi_i). A best-first queue
takes nodes by falling upper bound. Boxes whose interval misses the score window
or whose labels cannot match are left out, and the search ends when the next
bound is strictly below the k-th score found; equal bounds are searched, as ties
go by id. An anchor first searches its most promising subtrees; the k-th score
found there then prunes the others. The result is exact.

Two searches answer the question: the k nearest rows of the anchor's label give a
score window each, and the best rows of other labels are searched in every window.
Where the boxes prune little (vectors without clusters in many dimensions), the
anchors, in blocks, meet all subtrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, mix64, stage


@dataclass(frozen=True)
class TreeParams:
    """``subtree``: rows of a subtree; it grows where the boxes of all subtrees
    would take more than ``box_bytes``. ``slabs``: parts a tile or node is cut into;
    ``leaf``: rows of a leaf; ``block``: anchors searched together; ``first``:
    subtrees an anchor searches before the others."""

    subtree: int = 4096
    box_bytes: int = 16 << 20
    slabs: int = 4
    leaf: int = 64
    block: int = 128
    first: int = 2


# ------------------------------------------------------------------- the tree

@dataclass(frozen=True)
class Boxes:
    lo: np.ndarray      # nodes x components
    hi: np.ndarray
    low: np.ndarray     # smallest and largest label
    high: np.ndarray

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest inner product possible: queries x boxes."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        return plus @ self.lo.T + minus @ self.hi.T, plus @ self.hi.T + minus @ self.lo.T

    def may_match(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Queries x boxes: may the box hold a row of the label, or of another one?"""
        inside = (self.low <= labels[:, None]) & (labels[:, None] <= self.high)
        return inside if same else ~(inside & (self.low == self.high))


def box_of(v: np.ndarray, labels: np.ndarray, cuts: list[tuple[int, int]]) -> Boxes:
    return Boxes(np.array([v[a:b].min(0) for a, b in cuts]), np.array([v[a:b].max(0) for a, b in cuts]),
                 np.array([labels[a:b].min() for a, b in cuts]), np.array([labels[a:b].max() for a, b in cuts]))


@dataclass(frozen=True)
class Subtree:
    """Rows in packed order; node 0 is the root, node n holds the rows from
    ``span[n, 0]`` to ``span[n, 1]`` and the nodes from ``child[n, 0]`` to ``child[n, 1]``
    (none: a leaf)."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    span: np.ndarray
    child: np.ndarray
    boxes: Boxes


def packed(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, p: TreeParams) -> Subtree:
    """Sort-tile-recursion: a node's rows are sorted by their coordinate of largest
    variance (the label, where labels differ, at the root) and cut into slabs of whole leaves."""
    order = np.lexsort((ids, labels))  # whatever order the rows arrive in
    span, child, at = [(0, len(ids))], [], 0
    while at < len(span):
        a, b = span[at]
        if b - a <= p.leaf:
            child.append((0, 0))
        else:
            part = order[a:b]
            if at or labels[part].min() == labels[part].max():
                part = part[np.argsort(v[part, int(v[part].var(0).argmax())], kind="stable")]
                order[a:b] = part
            step = -(-(b - a) // (p.slabs * p.leaf)) * p.leaf
            child.append((len(span), len(span) + -(-(b - a) // step)))
            span += [(s, min(b, s + step)) for s in range(a, b, step)]
        at += 1
    ids, labels, v = ids[order], labels[order], v[order]
    return Subtree(ids, labels, v, np.array(span), np.array(child), box_of(v, labels, span))


def best_first(t: Subtree, q: np.ndarray, own: int, label: int, same: bool, k: int, windows: np.ndarray,
               lower: np.ndarray, upper: np.ndarray, fits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest score, highest score, score to reach): the ids and
    scores of the ``k`` best rows, ties by smaller id. ``lower``, ``upper``, ``fits``:
    of every node, for this query."""
    scores, scored = np.empty(len(t.ids)), np.zeros(len(t.span), bool)  # leaves are scored once for all windows
    right = ((t.labels == label) == same) & (t.ids != own)
    out = []
    for low, high, reach in windows:
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        least = max(low, reach)
        queue = [(-min(upper[0], high), 0)] if fits[0] and upper[0] >= least and lower[0] <= high else []
        while queue and -queue[0][0] >= least:
            bound, nodes = queue[0][0], []
            while queue and queue[0][0] == bound:  # nodes of one bound are opened together
                nodes.append(heappop(queue)[1])
            rows = []
            for n in nodes:
                a, b = t.child[n]
                if b > a:
                    on = fits[a:b] & (upper[a:b] >= least) & (lower[a:b] <= high)
                    for c in (a + np.flatnonzero(on)).tolist():
                        heappush(queue, (-min(upper[c], high), c))
                    continue
                a, b = t.span[n]
                if not scored[n]:
                    scores[a:b], scored[n] = t.v[a:b] @ q, True
                some = a + np.flatnonzero(right[a:b] & (scores[a:b] >= least) & (scores[a:b] <= high))
                rows.append(some)
            found = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            if len(found):
                best_id, best = np.append(best_id, t.ids[found]), np.append(best, scores[found])
                keep = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[keep], best[keep]
                if len(best) == k:
                    least = max(least, best[-1])
        out.append((best_id, best))
    return out


# ----------------------------------------------------------------- Spark side

SUBTREE = ("shard long, ids binary, labels binary, v binary, span binary, child binary, "
           "lo binary, hi binary, low binary, high binary")
VISIT = "shard long, part long, ids binary, labels binary, q binary, windows binary"
FOUND = "anchor long, w int, id long, score long"


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _one(values: dict) -> pa.Table:
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in values.items()})


def integer_rows(rows: DataFrame, id_col: str, vec: str, label: str, scale: int, anchor: Column) -> DataFrame:
    """(id, label, q, anchor): rows that take part, with components floor(scale * x)."""
    v = F.col(f"`{vec}`").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                       v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    slim = slim.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(~F.coalesce(odd, F.lit(True)))
    return slim.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int")).alias("q"), "anchor")


def _single(rows: DataFrame) -> DataFrame:
    """One row per id: of several, the one with the largest label and vector.
    Only ids are shuffled where none repeats."""
    twice = stage(rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"), "repeated")
    if twice.isEmpty():
        return rows
    most = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.max(F.struct("label", "q", "anchor")).alias("r"))
    return rows.join(twice, "id", "left_anti").unionByName(most.select("id", "r.*"))


class Tiles:
    """Quantiles that cut tiles, level by level."""

    def __init__(self, axes: list[int], slabs: int):
        self.axes, self.slabs, self.cuts, self.parts = axes, slabs, [], {}

    def tile(self, labels: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(labels), np.int64)
        for level, cuts in enumerate(self.cuts):
            x = self.coordinate(level, labels, q)
            tile = tile * self.slabs + (x[:, None] > cuts[tile]).sum(1)
        if self.parts:  # tiles that no coordinate divides are dealt out
            many = np.array([self.parts.get(t, 1) for t in range(self.slabs ** len(self.cuts))], np.uint64)[tile]
            tile = (tile << 24) + (mix64(ids.astype(np.uint64)) % many).astype(np.int64)
        return tile

    def coordinate(self, level: int, labels: np.ndarray, q: np.ndarray) -> np.ndarray:
        return labels.astype(np.float64) if level == 0 else q[:, self.axes[level - 1]]

    def numbered(self, rows: DataFrame, dim: int, coordinate: bool = False) -> DataFrame:
        """``rows`` with their tile, as ``shard``, or with the tile and the next coordinate only."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, labels, q = b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("q"), dim)
                tile = pa.array(self.tile(labels, q, ids))
                if coordinate:
                    yield pa.RecordBatch.from_arrays([tile, pa.array(self.coordinate(len(self.cuts), labels, q))], names=["shard", "x"])
                else:
                    yield pa.RecordBatch.from_arrays([tile, *b.columns], names=["shard", *b.schema.names])

        kinds = "x double" if coordinate else ", ".join(f"{k} {v}" for k, v in rows.dtypes)
        return rows.mapInArrow(run, f"shard long, {kinds}")


def tiles_of(rows: DataFrame, count: int, dim: int, p: TreeParams) -> Tiles:
    """Cuts until tiles hold about a subtree's rows; the driver gets their quantiles and sizes only."""
    size = max(p.subtree, -(-count * 16 * dim // p.box_bytes))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dim))
        for b in batches:
            q = _matrix(b.column("q"), dim)
            total += [q.sum(0), (q * q).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), *map(pa.array, total)], names=["i", "s", "ss"])

    found = rows.select("q").mapInArrow(moments, "i long, s double, ss double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    spread = {r.i: r.ss / count - (r.s / count) ** 2 for r in found.collect()}
    tiles = Tiles(sorted(spread, key=lambda i: (-spread[i], i)), p.slabs)
    while size * p.slabs ** len(tiles.cuts) < count and len(tiles.cuts) <= dim:
        at = [i / p.slabs for i in range(1, p.slabs)]
        cut = tiles.numbered(rows, dim, True).groupBy("shard").agg(F.percentile_approx("x", at, 1000).alias("at")).collect()
        cuts = np.full((p.slabs ** len(tiles.cuts), p.slabs - 1), np.inf)
        for r in cut:
            cuts[r.shard] = r["at"]
        tiles.cuts.append(cuts)
    held = tiles.numbered(rows, dim).groupBy("shard").count().collect()
    tiles.parts = {r.shard: max(1, round(r["count"] / size)) for r in held}
    return tiles


def _blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def subtrees(rows: DataFrame, dim: int, p: TreeParams) -> DataFrame:
    """One row per shard: its packed rows, nodes and boxes."""
    def build(key: tuple, table: pa.Table) -> pa.Table:
        t = packed(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["q"], dim), p)
        return _one({"shard": key[0].as_py(), "ids": _blob(t.ids, "<i8"), "labels": _blob(t.labels, "<i8"), "v": _blob(t.v, "<i4"),
                     "span": _blob(t.span, "<i8"), "child": _blob(t.child, "<i8"), "lo": _blob(t.boxes.lo, "<i4"),
                     "hi": _blob(t.boxes.hi, "<i4"), "low": _blob(t.boxes.low, "<i8"), "high": _blob(t.boxes.high, "<i8")})

    return rows.select("shard", "id", "label", "q").groupBy("shard").applyInArrow(build, SUBTREE)


def _subtree(r: dict, dim: int) -> Subtree:
    def get(name: str, kind: str, *shape: int) -> np.ndarray:
        x = np.frombuffer(r[name], kind)
        return x.reshape(*shape).astype(np.float64) if kind == "<i4" else x.reshape(*shape)

    boxes = Boxes(get("lo", "<i4", -1, dim), get("hi", "<i4", -1, dim), get("low", "<i8", -1), get("high", "<i8", -1))
    return Subtree(get("ids", "<i8", -1), get("labels", "<i8", -1), get("v", "<i4", -1, dim), get("span", "<i8", -1, 2),
                   get("child", "<i8", -1, 2), boxes)


class Forest:
    """All subtrees of a table, searched in blocks of anchors."""

    def __init__(self, rows: DataFrame, count: int, dim: int, p: TreeParams):
        self.dim, self.p = dim, p
        self.tiles = tiles_of(rows, count, dim, p)
        self.shards = stage(subtrees(self.tiles.numbered(rows, dim), dim, p), "subtrees")
        # root boxes: bounded by box_bytes, whatever the number of rows
        roots = self.shards.select("shard", *[F.substring(c, 1, w * n).alias(c) for c, w, n in
                                              (("lo", 4, dim), ("hi", 4, dim), ("low", 8, 1), ("high", 8, 1))]).collect()
        roots.sort(key=lambda r: r.shard)
        self.numbers = np.array([r.shard for r in roots], np.int64)
        self.roots = Boxes(*(np.array([np.frombuffer(r[c], k) for r in roots]).reshape(len(roots), -1).astype(np.float64)
                             for c, k in (("lo", "<i4"), ("hi", "<i4"))),
                           *(np.array([np.frombuffer(r[c], "<i8")[0] for r in roots], np.int64) for c in ("low", "high")))

    def visits(self, asked: DataFrame, same: bool, rest: bool) -> DataFrame:
        """(shard, block of anchors) rows of (block, id, label, q, windows): the
        most promising subtrees of each anchor, or the ``rest`` that may hold an answer."""
        dim, p, numbers = self.dim, self.p, self.numbers
        sent = asked.sparkSession.sparkContext.broadcast(self.roots)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            ids, labels, q = table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["q"], dim)
            windows = _matrix(table["windows"], len(table["windows"][0])).reshape(len(ids), -1, 3)
            lower, upper = sent.value.products(q)
            fits = sent.value.may_match(labels, same)
            rank = np.argsort(np.argsort(np.where(fits, -upper, np.inf), axis=1, kind="stable"), axis=1)
            least, high = np.maximum(windows[..., 0], windows[..., 2]), windows[..., 1]
            on = ((upper[:, None, :] >= least[..., None]) & (lower[:, None, :] <= high[..., None]) & (least <= high)[..., None]).any(1)
            on &= fits & ((rank >= p.first) if rest else (rank < p.first))
            out = []
            for s in np.flatnonzero(on.any(0)):
                who = np.flatnonzero(on[:, s])
                out.append(_one({"shard": int(numbers[s]), "part": key[0].as_py(), "ids": _blob(ids[who], "<i8"),
                                 "labels": _blob(labels[who], "<i8"), "q": _blob(q[who], "<i4"),
                                 "windows": _blob(windows[who], "<f8")}))
            return pa.concat_tables(out) if out else _one({c.split()[0]: b"" if "binary" in c else 0 for c in VISIT.split(", ")}).slice(0, 0)

        return stage(asked.groupBy("block").applyInArrow(run, VISIT), "visits")

    def answers(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, w, id, score): the k best rows of each visit in each window."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple[int, Subtree | None] = (-1, None)
            for batch in batches:
                for r in batch.to_pylist():
                    if last[1] is None or last[0] != r["shard"]:
                        last = (r["shard"], _subtree(r | {"ids": r["rows"], "labels": r["row_labels"]}, dim))
                    t = last[1]
                    ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                    q = np.frombuffer(r["q"], "<i4").reshape(-1, dim).astype(np.float64)
                    windows = np.frombuffer(r["windows"], "<f8").reshape(len(ids), -1, 3)
                    lower, upper = t.boxes.products(q)
                    fits = t.boxes.may_match(labels, same)
                    cols: list[list] = [[], [], [], []]
                    for i, own in enumerate(ids.tolist()):
                        found = best_first(t, q[i], own, labels[i], same, k, windows[i], lower[i], upper[i], fits[i])
                        for w, (best_id, best) in enumerate(found):
                            for c, x in zip(cols, (np.full(len(best), own), np.full(len(best), w), best_id, best.astype(np.int64))):
                                c.append(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                        names=["anchor", "w", "id", "score"])

        spread = max(1, 4 * len(self.numbers))  # visits are few rows of much work: spread by number, not by bytes
        trees = self.shards.withColumnsRenamed({"ids": "rows", "labels": "row_labels"}).repartition(spread, "shard")
        met = visits.repartition(spread, "shard").join(trees.hint("merge"), "shard")
        return met.mapInArrow(run, FOUND)

    def search(self, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(anchor, w, id, score, rank): the k best rows of each window of (block, id,
        label, q, windows: lowest and highest score, window by window)."""
        def best(found: DataFrame) -> DataFrame:
            order = W.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        def with_reach(df: DataFrame, reach: Column) -> DataFrame:
            flat = F.flatten(F.transform("windows", lambda x, w: F.array(x["low"], x["high"], reach_of(reach, w))))
            return df.select("block", "id", "label", "q", flat.alias("windows"))

        def reach_of(reach: Column, w: Column) -> Column:
            return F.coalesce(F.element_at(reach, w.cast("int")), F.lit(float("-inf")))

        nothing = F.expr("map_from_arrays(CAST(array() AS array<int>), CAST(array() AS array<double>))")
        first = stage(best(self.answers(self.visits(with_reach(asked, nothing), same, False), same, k)), f"{name}-first")
        kth = (first.filter(F.col("rank") == k).groupBy("anchor")
               .agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("score").cast("double")))).alias("reach")))  # a few windows
        open_ = asked.join(kth.withColumnRenamed("anchor", "id"), "id", "left")
        rest = self.answers(self.visits(with_reach(open_, F.coalesce("reach", nothing)), same, True), same, k)
        return stage(best(first.drop("rank").unionByName(rest)), name)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
                   params: TreeParams = TreeParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), and a score is the integer inner product
    with the anchor; higher scores come first, ties by smaller id. The positives
    of an anchor (a row where ``anchor`` holds) are its first rows of the same
    label; the negatives of a positive are the first rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score.

    Rows with a null id, label or vector, with null or non-finite components, or
    with another number of components than most take no part; neither does an
    anchor without positives appear. Of rows that repeat an id, the one with the
    largest label and vector counts. Of equal vectors of one label only the
    smallest ids that any answer can hold are kept. Scores are exact while sums of
    products stay below 2^53; a component beyond 2^31 fails. Empty tables give no
    rows; other columns are ignored.
    """
    spark, p = rows.sparkSession, params
    bound_batches(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    valid = integer_rows(rows, id_col, vec, label, scale, anchor)
    shape = valid.groupBy(F.size("q").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], out)
    dim = shape[0].dim
    every = stage(_single(valid.filter(F.size("q") == dim)), "rows")
    copy = F.row_number().over(W.partitionBy("label", "q").orderBy("id"))
    kept = stage(every.select("id", "label", "q").withColumn("n", copy).filter(F.col("n") <= max(positives, negatives) + 1).drop("n"), "vectors")
    forest = Forest(kept, kept.count(), dim, p)

    asked = stage(forest.tiles.numbered(every.filter("anchor").select("id", "label", "q"), dim), "anchors")
    sizes = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / float(p.block)).alias("parts"))
    asked = asked.join(sizes, "shard").select(F.xxhash64("shard", F.pmod(F.xxhash64("id"), "parts")).alias("block"), "id", "label", "q")

    wide = "array(struct(CAST('-Infinity' AS DOUBLE) AS low, CAST('Infinity' AS DOUBLE) AS high))"
    near = forest.search(asked.withColumn("windows", F.expr(wide)), True, positives, "positives")
    # windows by integer division: ceil(least * s / 100) and floor(most * s / 100); missing ones are empty
    low = f"CAST(-((-{least} * score - pmod(-{least} * score, 100L)) DIV 100) AS DOUBLE)"
    high = f"CAST(({most} * score - pmod({most} * score, 100L)) DIV 100 AS DOUBLE)"
    ranked = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.expr(f"struct(rank, {low} AS low, {high} AS high)"))).alias("r"))
    padded = F.expr(f"""transform(sequence(0, {positives - 1}), i -> struct(
        coalesce(get(r, i).low, CAST('Infinity' AS DOUBLE)) AS low, coalesce(get(r, i).high, CAST('-Infinity' AS DOUBLE)) AS high))""")
    windows = ranked.select(F.col("anchor").alias("id"), padded.alias("windows"))
    far = forest.search(asked.join(windows, "id"), False, negatives, "negatives")
    pos = near.select(F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    neg = far.select(F.col("anchor").alias("anchor_id"), "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pos.join(neg, ["anchor_id", "w"]).select(*[c.split()[0] for c in out.split(", ")])
