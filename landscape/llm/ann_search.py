"""Approximate nearest neighbours by largest inner product: multiprobe
p-stable hashing.

Vectors get one more component so that all have the largest norm; queries are
scaled to that norm. Then the largest inner product is the smallest Euclidean
distance. In each table, Gaussian projections cut into cells of equal width give
a row's bucket. A query visits buckets in falling order of the estimated
probability that a neighbour at a given distance lies there - the product,
over the projections, of a normal mass in the cell - until the tables together
reach the wanted probability of success. Candidates of all buckets and tables
are merged and ranked by the inner product itself.

The distance is each query's own. A first visit, at the usual distance of a
sample, keeps candidates above a score that most queries' k-th neighbours
reach; queries that find fewer than k so visit again at a far distance, without
that floor. The k-th distance found, never less than the true one, is then the
query's own: where it is more than that of the visit, the missing buckets are
visited too. Queries still short of k, or whose buckets do not reach the wanted
probability, are compared with all rows.

Buckets are gathered in bins of about ``rows_per_bin`` rows. A bin with more
rows or queries (a hot bucket) is split on both sides into blocks that meet
each other, so no task holds more than a block, and nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MIX, mix64, stage


@dataclass(frozen=True)
class AnnParams:
    """``success``: wanted probability that a neighbour at the query's own k-th
    distance is visited; ``sample``: queries (at most) whose true k-th distance,
    measured against all rows, sets the distances of the first visits; ``cell``:
    width of a cell in units of the projections' deviation; ``beam``: buckets of
    a table that are ranked per query (where they hold too little, all rows are compared)."""

    tables: int = 2
    cell: float = 2.5
    success: float = 0.96
    sample: int = 64
    beam: int = 4096
    rows_per_bin: int = 4096
    queries_per_block: int = 1024
    seed: int = 13

    def functions(self, rows: int) -> int:
        """Projections per table: buckets grow in number with the rows."""
        return max(2, round(0.62 * math.log2(max(rows, 2)) - 3.5))


class Hashing:
    """Projections of one index: ``norm`` is the largest norm of its vectors."""

    def __init__(self, dim: int, rows: int, norm: float, p: AnnParams):
        self.p, self.norm, self.m = p, norm, p.functions(rows)
        rng = np.random.default_rng(p.seed)
        self.a = rng.normal(size=(dim + 1, p.tables * self.m))
        self.width = p.cell * norm
        self.b = rng.uniform(0, self.width, p.tables * self.m)
        self.bins = max(1, -(-rows // p.rows_per_bin))

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in cell units, vectors x tables x functions."""
        length = np.sqrt((x * x).sum(1))
        if query:
            x, last = x * (self.norm / length)[:, None], np.zeros(len(x))
        else:
            last = np.sqrt(np.maximum(self.norm ** 2 - length ** 2, 0))
        z = np.concatenate([x, last[:, None]], 1) @ self.a
        return ((z + self.b) / self.width).reshape(len(x), self.p.tables, self.m)

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """64-bit bucket keys of cells (last axis: functions)."""
        h = np.full(cells.shape[:-1], mix64(np.array([table + 1], np.uint64))[0])
        for j in range(cells.shape[-1]):
            h = mix64(h * MIX + cells[..., j].astype(np.int64).view(np.uint64))
        return h

    def bin_of(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (keys % np.uint64(self.bins)).astype(np.int64) + table * self.bins

    def ranked(self, x: np.ndarray, table: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, bucket key) visits of one table, best first per query, and the
        probability they reach at each query's ``radius``. Steps go so far from
        the home cell that what lies beyond them is negligible."""
        at = self.places(x, True)[:, table]
        cell = np.floor(at)
        inside = at - cell
        share = 1 - (1 - self.p.success) ** (1 / self.p.tables)
        scale = self.width / radius[:, None, None]
        far = max(1, math.ceil(2.5 * radius.max(initial=0) / self.width))
        cut = _normal((np.arange(-far, far + 2) - inside[:, :, None]) * scale)
        logp = np.log(np.maximum(np.diff(cut, axis=2), 1e-300))  # queries x functions x steps
        wide = 2 * far + 1
        best = np.zeros((len(x), 1))
        steps = np.zeros((len(x), 1, 0), np.int8)
        for j in range(self.m):  # grow the step vectors, keeping the likeliest
            grown = (best[:, :, None] + logp[:, j, None, :]).reshape(len(x), -1)
            order = np.argsort(-grown, axis=1, kind="stable")[:, :self.p.beam]
            best = np.take_along_axis(grown, order, 1)
            before = np.take_along_axis(steps, (order // wide)[:, :, None], 1)
            steps = np.concatenate([before, (order % wide - far).astype(np.int8)[:, :, None]], 2)
        mass = np.cumsum(np.exp(best), axis=1)
        many = np.minimum((mass < share).sum(1) + 1, best.shape[1])
        query, rank = np.nonzero(np.arange(best.shape[1]) < many[:, None])
        return query, self.keys(cell[query] + steps[query, rank], table), mass[np.arange(len(x)), many - 1]

    def probes(self, x: np.ndarray, table: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket key) visits of one table at one radius."""
        return self.ranked(x, table, np.full(len(x), radius))[:2]

    def visits(self, x: np.ndarray, radius: np.ndarray, before: np.ndarray
               ) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per table the (query, bucket key) visits at each query's ``radius`` but
        those made at the radius ``before`` (0: none); and which queries reach
        the wanted probability. The others visit nothing."""
        out, missed = [], np.ones(len(x))
        for t in range(self.p.tables):
            query, key, mass = self.ranked(x, t, radius)
            missed *= 1 - mass
            again = np.flatnonzero(before > 0)
            if len(again):
                old, old_key, _ = self.ranked(x[again], t, before[again])
                mark = MIX  # bucket keys are hashes: so are the marked ones
                new = ~np.isin(mix64(key + query.astype(np.uint64) * mark),
                               mix64(old_key + again[old].astype(np.uint64) * mark))
                query, key = query[new], key[new]
            out.append((query, key))
        reached = 1 - missed >= self.p.success - 1e-5  # the normal function is good to 1.5e-7 a step
        return [(q[reached[q]], k[reached[q]]) for q, k in out], reached


def _normal(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz-Stegun 7.1.26, error 1.5e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    e = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * e)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _taking_part(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _usual_products(rows: DataFrame, queries: DataFrame, dim: int, norm: float, k: int,
                    p: AnnParams) -> tuple[float, float]:
    """Two k-th largest inner products with other rows (exact, one pass over the
    rows) of a bounded sample of queries scaled to length ``norm``: the median,
    and one that nine in ten reach."""
    some = queries.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample).collect()
    ids = np.array([r.id for r in some])
    q = np.array([r.v for r in some], np.float64).reshape(-1, dim)
    q *= (norm / np.sqrt((q * q).sum(1)))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(q), k), -np.inf)
        for batch in batches:
            s = q @ _matrix(batch.column("v"), dim).T
            s[ids[:, None] == batch.column("id").to_numpy()[None, :]] = -np.inf
            top = -np.sort(-np.concatenate([top, s], 1), axis=1)[:, :k]
        at, rank = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(top[at, rank])], names=["s", "ip"])

    near = rows.select("id", "v").mapInArrow(run, "s long, ip double")
    order = W.partitionBy("s").orderBy(F.desc("ip"))
    last = (near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
            .groupBy("s").agg(F.min("ip").alias("ip")).agg(F.percentile("ip", F.array(F.lit(0.5), F.lit(0.1)))).first()[0])
    usual, floor = last if last is not None else (0.0, 0.0)
    return usual, floor


def nearest_neighbours(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                       k: int = 20, params: AnnParams = AnnParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` rows of ``index`` with the
    largest inner product found for each row of ``queries``, the row with the
    query's own id excepted; ties go to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no
    part on either side, nor do rows with a null id or with another number of
    components than most of the index. Of equal vectors, the k + 1 smallest ids
    are enough for any answer, so a group of copies of any size stays small. An id
    that repeats with several vectors counts once, with its largest score; a query
    id that repeats asks with all its vectors, and an answer has its largest score.
    Scores are computed on the original components in double precision. Empty
    tables give no rows; other columns are ignored.
    """
    p = params

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec}`").cast("array<double>")
        return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
                .filter(F.col("id").isNotNull() & _taking_part(F.col("v"))))

    rows = valid(index)
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    shape = (rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m"))
             .orderBy(F.desc("n"), "dim").limit(1).collect())
    out = "query_id long, rank int, vec_id long, score double"
    if not shape:
        return index.sparkSession.createDataFrame([], out)
    dim, norm = shape[0].dim, math.sqrt(shape[0].m)
    same = W.partitionBy("v").orderBy("id")
    rows = stage(rows.filter(F.size("v") == dim).withColumn("n", F.row_number().over(same))
                 .filter(F.col("n") <= k + 1).drop("n"), "vectors")
    asked = stage(valid(queries).filter(F.size("v") == dim), "queries")
    usual, floor = _usual_products(rows, asked, dim, norm, k, p)
    near, far = (math.sqrt(max(2 * norm * norm - 2 * ip, 1e-12)) for ip in (usual, floor))
    hashing = Hashing(dim, rows.count(), norm, p)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.floor(hashing.places(_matrix(batch.column("v"), dim), False))
            for t in range(p.tables):
                key = hashing.keys(cells[:, t], t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashing.bin_of(key, t)), pa.array(key.view(np.int64)), *batch.columns],
                    names=["bin", "key", "id", "v"])

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visits by bin; a query that does not reach its probability goes to bin -1 alone."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                x = _matrix(batch.column("v"), dim)
                tables, reached = hashing.visits(x, batch.column("radius").to_numpy(), batch.column("before").to_numpy())
                short = np.flatnonzero(~reached)
                for t, (query, key) in enumerate([*tables, (short, np.zeros(len(short), np.uint64))]):
                    where = hashing.bin_of(key, t) if t < p.tables else np.full(len(short), -1)
                    order = np.lexsort((where, query))
                    query, key, where = query[order], key[order], where[order]
                    if not len(query):
                        continue
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(query) != 0) | (np.diff(where) != 0)]))
                    keys = pa.ListArray.from_arrays(pa.array(np.append(cut, len(query)), pa.int32()),
                                                    pa.array(key.view(np.int64)))
                    take = pa.array(query[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where[cut]), keys, *[batch.column(c).take(take) for c in ("id", "v", "least")]],
                        names=["bin", "keys", "id", "v", "least"])

    visit = "bin long, keys array<long>, id long, v array<double>, least double"

    def visits(some: DataFrame, name: str) -> DataFrame:
        return stage(some.select("id", "v", "radius", "before", "least").mapInArrow(probe_rows, visit), name)

    held = stage(rows.mapInArrow(index_rows, "bin long, key long, id long, v array<double>"), "hashed")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        found = [(empty, empty, np.zeros(0))]
        if left.num_rows and right.num_rows:
            x, ids, key = _matrix(left["v"], dim), left["id"].to_numpy(), left["key"].to_numpy()
            q, qids = _matrix(right["v"], dim), right["id"].to_numpy()
            lists = right["keys"].combine_chunks()
            asked_key = np.asarray(lists.flatten())
            asker = np.repeat(np.arange(len(q)), np.diff(np.asarray(lists.offsets)))
            order = np.argsort(asked_key, kind="stable")
            asked_key, asker = asked_key[order], asker[order]
            by_key = np.argsort(key, kind="stable")
            sorted_key = key[by_key]
            score = np.full((len(q), len(x)), -np.inf)
            for b in np.unique(sorted_key):
                lo, hi = np.searchsorted(asked_key, [b, b + 1] if b < np.iinfo(np.int64).max else [b, b])
                if hi > lo:
                    some = by_key[np.searchsorted(sorted_key, b):np.searchsorted(sorted_key, b, side="right")]
                    who = asker[lo:hi]
                    score[np.ix_(who, some)] = q[who] @ x[some].T
            score[qids[:, None] == ids[None, :]] = -np.inf
            score[score < right["least"].to_numpy()[:, None]] = -np.inf
            if score.shape[1] > k:  # everything within rounding of the k-th goes on
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                kth = np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth), -np.inf)
                keep = np.isfinite(score) & (score >= kth[:, None])
            else:
                keep = np.isfinite(score)
            who, some = np.nonzero(keep)
            exact = np.concatenate([(q[who[i:i + 65536]] * x[some[i:i + 65536]]).sum(1)
                                    for i in range(0, len(who), 65536)] or [np.zeros(0)])
            found.append((qids[who], ids[some], exact))
        cols = [np.concatenate(c) for c in zip(*found)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    def answers(held: DataFrame, visits: DataFrame) -> DataFrame:
        """Candidates of each query, merged over bins."""
        plan = (held.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / (2.0 * p.rows_per_bin)).alias("nr"))
                .join(visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / float(p.queries_per_block)).alias("nq")), "bin"))

        def blocks(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
            return (side.join(plan, "bin").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)))
                    .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("nr", "nq"))

        left = blocks(held, "nr", "nq", "r", "q").groupBy("bin", "r", "q")
        right = blocks(visits, "nq", "nr", "q", "r").groupBy("bin", "r", "q")
        return left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return (single.repartition("query_id")
                .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    def last(found: DataFrame, radius: float) -> DataFrame:
        """Queries that have k answers: the k-th score and the distance of their visit."""
        return found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"),
                                                       F.lit(radius).alias("before"))

    def some(radius: Column, before: Column, least: Column, of: DataFrame) -> DataFrame:
        return of.select("id", "v", radius.alias("radius"), before.alias("before"), least.alias("least"))

    # at the usual distance, above the floor; then those short of k at the far distance, without it
    none = F.lit(0.0)
    first = visits(some(F.lit(near), none, length * (floor / norm), asked), "visits-usual")
    found = stage(best(answers(held, first)), "answers-usual")
    full = last(found, near)
    unreached = first.filter("bin = -1").select("id")
    short = asked.join(full, "id", "left_anti").join(unreached, "id", "left_anti")
    again = stage(best(answers(held, visits(some(F.lit(far), none, F.lit(-math.inf), short), "visits-far"))), "answers-far")
    known = stage(full.unionByName(last(again, far)), "kth")
    # at the query's own distance: the missing buckets, for what is no worse than the k-th found
    own = F.sqrt(F.greatest(2 * norm * norm - 2 * norm * F.col("kth") / length, F.lit(1e-12)))
    wider = (asked.join(known, "id").withColumn("own", own).filter(F.col("own") > F.col("before") * (1 + 1e-9)))
    third = visits(some(F.col("own"), F.col("before"), F.col("kth") - 1e-9 * F.abs("kth"), wider), "visits-own")
    more = answers(held, third)
    # against all rows: no k found, or the wanted probability out of reach
    out_of_reach = third.filter("bin = -1").select("id")
    rest = asked.join(known, "id", "left_anti").unionByName(asked.join(out_of_reach, "id", "left_semi"))
    all_rows = rows.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("key"), "id", "v")
    everything = F.array(F.lit(0).cast("long"))
    whole = stage(rest.select(F.lit(0).cast("long").alias("bin"), everything.alias("keys"), "id", "v",
                              F.lit(-math.inf).alias("least")), "exact")
    parts = [found.drop("rank"), again.drop("rank"), more, answers(all_rows, whole)]
    out_rows = parts[0]
    for part in parts[1:]:
        out_rows = out_rows.unionByName(part)
    return best(out_rows)
