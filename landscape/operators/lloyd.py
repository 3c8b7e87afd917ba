"""K-means of several configurations in one joint Lloyd loop (survey 2.I).

A configuration is a number of clusters and a seed. All of them read the points
together: every round is one job without a shuffle, in which each task adds up its
points per configuration and centre, and the sums - of every task as many as all
centres have components - come to the driver, which holds the centres. The points
are staged once, packed ``ROWS`` to a row, so that a round reads bytes and no lists. The first centres are drawn in
parallel (k-means||): in each of ``SEEDING`` rounds, as many points as there are
clusters, with chances in proportion to their squared distance from the
candidates so far, and then k of the candidates, weighted by the points nearest to
them. A configuration ends where its centres no longer move; nothing cuts the
rounds off, and the report says how many there were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SEEDING = 5
ROWS = 512


@dataclass(frozen=True)
class Config:
    k: int
    seed: int = 1


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _squares(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (v @ centres.T), 0.0)


def _drawn(points: DataFrame, centres: dict[str, np.ndarray], configs: dict[str, Config], turn: int) -> dict[str, np.ndarray]:
    """For each configuration, k points drawn with chances in proportion to their
    squared distances: those with the smallest -ln(u) / d, of every task and then
    of all. Before there is a candidate, one point, all alike."""
    draws = [F.pmod(F.xxhash64("entity", F.lit(c.seed), F.lit(turn)), F.lit(1 << 52)).alias(f"u{i}") for i, c in enumerate(configs.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            for i, (name, c) in enumerate(configs.items()):
                u = (batch.column(f"u{i}").to_numpy() + 0.5) / (1 << 52)
                d = _squares(v, centres[name]).min(1) if name in centres else np.ones(len(v))
                key = np.where(d > 1e-12, -np.log(u) / np.maximum(d, 1e-300), np.inf)
                old = held.get(name, (np.zeros(0), np.zeros((0, v.shape[1]))))
                key, rows = np.append(old[0], key), np.concatenate([old[1], v])
                best = np.argsort(key, kind="stable")[:c.k if name in centres else 1]
                held[name] = key[best], rows[best]
        for name, (key, rows) in held.items():
            some = np.isfinite(key)
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(some.sum()), pa.string()), pa.array(key[some]),
                                              pa.array(list(rows[some]), pa.list_(pa.float64()))], names=["config", "key", "v"])

    found: dict[str, list] = {}
    order = Window.partitionBy("config").orderBy("key", "v")  # each task keeps its best, so does Spark before the shuffle
    best = (points.select("v", *draws).mapInArrow(run, "config string, key double, v array<double>")
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(c.k for c in configs.values())))
    for r in best.orderBy("config", "n").collect():
        own = found.setdefault(r.config, [])
        if len(own) < (configs[r.config].k if r.config in centres else 1):
            own.append(r.v)
    return {name: np.concatenate([centres[name], rows]) if name in centres else np.array(rows, np.float64) for name, rows in found.items()} \
        | {name: c for name, c in centres.items() if name not in found}


def staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"kmeans-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(points: DataFrame, by: str | None = None) -> DataFrame:
    """Points (v, and a key ``by``) as rows (n, v, the key) of up to ``ROWS`` points of
    one key, their vectors one after the other as bytes; staged."""
    key = [f"{by} {points.schema[by].dataType.simpleString()}"] if by else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(by).dictionary_encode(null_encoding="encode").indices.to_numpy() if by else np.zeros(batch.num_rows, int)
            at = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), batch.num_rows)
            for i, end in zip(at[:-1], at[1:]):
                for first in range(i, end, ROWS):
                    rows = batch.slice(first, min(ROWS, end - first))
                    v = pa.array([_matrix(rows.column("v")).tobytes()], pa.binary())
                    own = [rows.column(by).slice(0, 1)] if by else []
                    yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64()), v, *own], names=["n", "v", *([by] if by else [])])

    return staged(points.mapInArrow(run, ", ".join(["n long", "v binary", *key])), "packed")


def unpacked(n: int, v: bytes) -> np.ndarray:
    return np.frombuffer(v, np.float64).reshape(n, -1)


def spread(points: DataFrame) -> DataFrame:
    """Dealt over all cores, however few files the points came from."""
    return points.repartition(points.sparkSession.sparkContext.defaultParallelism, "entity")


def _sums(blocks: DataFrame, centres: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Per configuration: the sum of the packed points nearest to each centre, how many
    they are, and the squared distances in all. One job, one row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {name: np.zeros((len(c), c.shape[1] + 2)) for name, c in centres.items()}
        for batch in batches:
            for r in batch.to_pylist():
                v = unpacked(r["n"], r["v"])
                for name, c in centres.items():
                    d = _squares(v, c)
                    near = d.argmin(1)
                    rows = np.concatenate([v, np.ones((len(v), 1)), d[np.arange(len(v)), near][:, None]], 1)
                    order = np.argsort(near, kind="stable")
                    first = np.flatnonzero(np.diff(near[order], prepend=-1))
                    total[name][near[order][first]] += np.add.reduceat(rows[order], first)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in total.values()], pa.binary()), pa.array(list(total), pa.string())],
                                         names=["s", "config"])

    few = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    total = {name: np.zeros((len(c), c.shape[1] + 2)) for name, c in centres.items()}
    for r in few.mapInArrow(run, "s binary, config string").collect():
        total[r.config] += np.frombuffer(r.s, np.float64).reshape(total[r.config].shape)
    return {name: (t[:, :-2], t[:, -2], float(t[:, -1].sum())) for name, t in total.items()}


def _chosen(candidates: np.ndarray, weight: np.ndarray, c: Config) -> np.ndarray:
    """k of the candidates: weighted k-means++ and a few rounds over them."""
    rng = np.random.default_rng(c.seed)
    keep = weight > 0
    candidates, weight = candidates[keep], weight[keep]
    if len(candidates) <= c.k:
        return candidates
    best, least = candidates[:c.k], np.inf
    for _ in range(4):
        centres = candidates[[rng.choice(len(candidates), p=weight / weight.sum())]]
        while len(centres) < c.k:
            p = weight * _squares(candidates, centres).min(1)
            if p.sum() <= 0:
                break
            centres = np.concatenate([centres, candidates[[rng.choice(len(candidates), p=p / p.sum())]]])
        for _ in range(30):
            near = _squares(candidates, centres).argmin(1)
            centres = np.array([np.average(candidates[near == i], axis=0, weights=weight[near == i]) if (near == i).any() else m
                                for i, m in enumerate(centres)])
        cost = float((weight * _squares(candidates, centres).min(1)).sum())
        if cost < least:
            best, least = centres, cost
    return best


def kmeans_many(points: DataFrame, configs: dict[str, Config], tolerance: float = 1e-9,
                report: list | None = None) -> DataFrame:
    """(config, entity, cluster) of points (entity, v) for every configuration.

    Rounds go on for a configuration until the squared movement of its centres is
    within ``tolerance`` of the points' mean squared length; a centre without
    points stays where it is. ``report`` gets rounds, inertia (of the last centres
    but one round) and whether the configuration converged, which it always does.
    Null vectors take no part; fewer distinct points than clusters give as many
    clusters as points; no points give no rows.
    """
    points = staged(spread(points.where("v IS NOT NULL").select(F.col("entity").cast("string").alias("entity"), "v")), "points")
    scale = points.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    schema = "config string, entity string, cluster string"
    if scale is None:
        return points.sparkSession.createDataFrame([], schema)
    centres: dict[str, np.ndarray] = {}
    for turn in range(SEEDING + 1):
        centres = _drawn(points, centres, configs, turn)
    blocks = packed(points.select("v"))
    weights = _sums(blocks, centres)
    centres = {name: _chosen(c, weights[name][1], configs[name]) for name, c in centres.items()}
    moving, rounds = dict(centres), 0
    while moving:
        rounds += 1
        for name, (total, n, inertia) in _sums(blocks, moving).items():
            old = moving[name]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)
            centres[name] = new
            if ((new - old) ** 2).sum() <= tolerance * max(scale, 1e-300):
                moving.pop(name)
                if report is not None:
                    report.append({"config": name, "rounds": rounds, "inertia": inertia, "converged": True})
            else:
                moving[name] = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            for name, c in centres.items():
                near = _squares(v, c).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), batch.column("entity"),
                                                  pa.array(near.astype(str).tolist(), pa.string())], names=["config", "entity", "cluster"])

    return points.mapInArrow(run, schema)
