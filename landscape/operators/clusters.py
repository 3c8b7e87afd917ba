"""Embedding clusters (survey 2.I).

Entity embeddings arrive as ``array<float>``; ``array_to_vector`` turns them
into ML vectors. Mixtures, bisecting k-means and PCA are MLlib's distributed
implementations with fixed seeds; k-means is ``lloyd``, all pairs are ``blocked``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.sampling import unit_hash
from .blocked import BLOCK, dendrogram_cuts, silhouettes
from .lloyd import Config, kmeans_many, packed, spread, staged, unpacked


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("entity", array_to_vector("embedding").alias("features"))


def _points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("entity", F.col("embedding").cast("array<double>").alias("v"))


def kmeans_flat(embeddings: DataFrame, k: int, seed: int = 1, report: list | None = None) -> DataFrame:
    """(entity, cluster), to convergence (see ``lloyd``)."""
    return kmeans_many(_points(embeddings), {"": Config(k, seed)}, report=report).drop("config")


def kmeans_grid(embeddings: DataFrame, configs: dict[str, tuple[int, int]], report: list | None = None) -> DataFrame:
    """(config, entity, cluster) for named (k, seed) configurations, in one loop."""
    return kmeans_many(_points(embeddings), {name: Config(*c) for name, c in configs.items()}, report=report)


def fuzzy_multi_resolution(embeddings: DataFrame, ks: Sequence[int], seed: int = 1, report: list | None = None) -> DataFrame:
    """Independent clusterings at several k, one level each (long form), in one loop."""
    out = kmeans_many(_points(embeddings), {str(i): Config(k, seed) for i, k in enumerate(ks, start=1)}, report=report)
    return out.select("entity", "cluster", F.col("config").cast("int").alias("level"))


def kmeans_centroid_hierarchy(embeddings: DataFrame, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Cluster entities at ks[0]; then cluster the cluster centroids at ks[1],
    and so on. Entities inherit the labels of their centroids. Levels are
    returned coarse -> fine (level 1 = last, coarsest clustering)."""
    cur = kmeans_flat(embeddings, ks[0], seed).withColumnRenamed("cluster", "node").checkpoint()
    out = cur.withColumnRenamed("node", f"l{len(ks)}")
    for i, k in enumerate(ks[1:], start=1):
        cent = (cur.join(vectors(embeddings), "entity").groupBy("node").agg(Summarizer.mean(F.col("features")).alias("m"))
                .select(F.col("node").alias("entity"), vector_to_array("m").alias("embedding")))
        up = kmeans_flat(cent, k, seed).select(F.col("entity").alias("node"), F.col("cluster").alias("parent"))
        cur = cur.join(up, "node").select("entity", F.col("parent").alias("node")).checkpoint()
        out = out.join(cur.withColumnRenamed("node", f"l{len(ks) - i}"), "entity")
    return out.select("entity", *[F.col(f"l{j}").alias(f"Level_{j}") for j in range(1, len(ks) + 1)])


def bisecting_hierarchy(embeddings: DataFrame, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """Top-down binary hierarchy cut at several k (one column per cut)."""
    v = vectors(embeddings)
    out = v.select("entity")
    for lvl, k in enumerate(ks, start=1):
        pred = BisectingKMeans(k=k, seed=seed).fit(v).transform(v)
        out = out.join(pred.select("entity", F.col("prediction").cast("string").alias(f"Level_{lvl}")), "entity")
    return out


def pca_reduce(embeddings: DataFrame, min_variance: float = 0.5, components: int | None = None) -> DataFrame:
    """Centred and whitened principal components: the fewest that explain
    ``min_variance`` of the variance, or ``components`` of them. All components
    are fitted (the covariance matrix is dimension x dimension, whatever the
    number of rows), so the wanted share is always reached. No rows stay no rows."""
    v = vectors(embeddings)
    moments = v.agg(Summarizer.mean(F.col("features")).alias("m"), Summarizer.variance(F.col("features")).alias("s"),
                    F.count("*").alias("n")).first()
    if not moments.n:
        return v.select("entity", F.array().cast("array<double>").alias("embedding"))
    mean, total = moments.m.toArray(), float(moments.s.toArray().sum())
    model = PCA(k=len(mean), inputCol="features", outputCol="pca").fit(v)
    share = model.explainedVariance.toArray()
    k = components or int((share.cumsum() < min_variance - 1e-12).sum()) + 1
    axes = model.pc.toArray()[:, :k]
    shift = mean @ axes  # the model projects without centring
    scale = [1.0 / (total * e) ** 0.5 if total * e > 0 else 0.0 for e in share[:k]]
    arr = vector_to_array(F.col("pca"))
    return model.transform(v).select("entity", F.array(*[
        (arr[i] - F.lit(float(shift[i]))) * F.lit(float(scale[i])) for i in range(k)]).alias("embedding"))


def gmm_overlap(embeddings: DataFrame, k: int, threshold: float = 0.1, seed: int = 1) -> DataFrame:
    """Soft clusters: an entity belongs to every component with posterior > threshold;
    its second, third ... membership is suffixed _2, _3."""
    v = vectors(embeddings)
    model = GaussianMixture(k=k, seed=seed, maxIter=50).fit(v)
    post = (model.transform(v).select("entity", F.posexplode(vector_to_array("probability")).alias("cluster", "p"))
            .where(F.col("p") > threshold))
    w = Window.partitionBy("entity").orderBy(F.col("p").desc(), "cluster")
    post = post.withColumn("_n", F.row_number().over(w))
    return post.select(F.when(F.col("_n") == 1, F.col("entity"))
                       .otherwise(F.concat(F.col("entity"), F.lit("_"), F.col("_n").cast("string"))).alias("entity"),
                       F.col("cluster").cast("string").alias("cluster"), "p")


def silhouette_by_level(embeddings: DataFrame, labels: DataFrame, levels: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Silhouette (mean over entities, Euclidean distances to all others) of the
    cumulative label path at each level; a level with a single label scores 0."""
    paths = {f"_p{i}": F.concat_ws("_", *levels[: i + 1]) for i in range(len(levels))}
    points = embeddings.select("entity", F.col("embedding").cast("array<double>").alias("v")).join(labels, "entity")
    return silhouettes(points.select("entity", "v", *[c.alias(n) for n, c in paths.items()]), list(paths), block)


def dendrogram_hierarchy(embeddings: DataFrame, ks: Sequence[int], block: int = BLOCK) -> DataFrame:
    """Bottom-up (single linkage) hierarchy cut at several k, one column per cut."""
    return dendrogram_cuts(embeddings.select("entity", F.col("embedding").cast("array<double>").alias("v")), ks, block)


def cluster_sizes(labels: DataFrame, levels: Sequence[str]) -> DataFrame:
    long = labels.select(F.inline(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("cluster"))
                                            for c in levels])))
    return long.groupBy("level", "cluster").agg(F.count("*").alias("n")).orderBy("level", F.col("n").desc())


def cluster_members(labels: DataFrame, level: str, cluster: str) -> DataFrame:
    return labels.where(F.col(level) == cluster).select("entity")


def label_paths(labels: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Cumulative non-empty labels joined by '_' per level."""
    arr = F.array(*[F.col(c).cast("string") for c in levels])
    return labels.select("entity", *[
        F.array_join(F.filter(F.slice(arr, 1, i + 1), lambda x: x.isNotNull() & (x != "")), "_").alias(c)
        for i, c in enumerate(levels)])


# -- nested k-means: one joint Lloyd iteration for all parents --------------------------
def _sqdist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def nested_k(points: DataFrame, k: int, imbalanced: bool = False, min_size: int = 10) -> DataFrame:
    """(parent, n, kp): members of each parent and the clusters it is split
    into; kp is NULL where it passes through. With ``imbalanced``, kp =
    max(round(n / N * k), 2)."""
    sizes = points.groupBy("parent").agg(F.count("*").alias("n"))
    total = points.agg(F.count("*").alias("_total"))
    kp = F.greatest(F.round(F.col("n") / F.col("_total") * k), F.lit(2)).cast("int") if imbalanced else F.lit(k)
    return (sizes.crossJoin(total).withColumn("kp", kp)  # one-row side
            .select("parent", "n", F.when((F.col("n") >= min_size) & (F.col("kp") < F.col("n")), F.col("kp")).alias("kp")))


def kmeans_nested(points: DataFrame, k: int, seed: int = 1, imbalanced: bool = False, min_size: int = 10,
                  tolerance: float = 1e-6) -> DataFrame:
    """Cluster inside every parent at once: (entity, parent, cluster).

    ``points``: (entity, parent, embedding). A parent with fewer than
    ``min_size`` members, or with no more members than clusters, passes through
    with an empty label (see ``nested_k``). The first centroids are the members
    with the smallest seeded hash; no parent needs more than the largest k, a
    literal, so Spark limits each parent's ranking before the shuffle. Members are
    staged once, packed by parent (see ``lloyd``), and a parent's centroids travel as
    one array to its packed rows, of which one sum per centroid leaves the task;
    ties go to the smaller index. Rounds run until the squared movement of all
    centroids together is within ``tolerance``; every round's centroids are written
    to the shared checkpoint folder by one job.
    """
    pts = staged(spread(points.select("entity", "parent", F.col("embedding").cast("array<double>").alias("v"))), "nested")
    active = nested_k(pts, k, imbalanced, min_size).where("kp IS NOT NULL").select("parent", "kp")
    members = pts.join(active, "parent")
    most = max(k, 2)  # no kp is larger
    first = Window.partitionBy("parent").orderBy(F.xxhash64("entity", F.lit(seed)), "entity")
    cents = staged(members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
                   .where(F.col("_r") <= F.col("kp")).groupBy("parent")
                   .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda s: s["v"]).alias("cs")), "nested-centres")
    blocks = packed(members.where("v IS NOT NULL").select("parent", "v").sortWithinPartitions("parent"), "parent")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = unpacked(r["n"], r["v"])
                d = np.array([np.full(len(v), -np.inf) if c is None else ((v - np.array(c)) ** 2).sum(1) for c in r["cs"]])  # as null distances sort
                near = np.where(np.isnan(d), np.inf, d).argmin(0)
                cids = np.unique(near)
                yield pa.RecordBatch.from_pydict(
                    {"parent": pa.array([r["parent"]] * len(cids), batch.schema.field("parent").type), "cid": pa.array(cids, pa.int32()),
                     "n": pa.array(np.bincount(near)[cids], pa.int64()),
                     "s": pa.array([v[near == c].sum(0) for c in cids], pa.list_(pa.float64()))})

    parent = blocks.schema["parent"].dataType.simpleString()
    while True:
        mean = (blocks.join(cents, "parent").select("parent", "n", "v", "cs")
                .mapInArrow(sums, f"parent {parent}, cid int, n long, s array<double>")
                .groupBy("parent", "cid").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n"))
                .select("parent", "cid", F.transform(vector_to_array("s"), lambda x: x / F.col("n")).alias("m"))
                .groupBy("parent").agg(F.map_from_entries(F.collect_list(F.struct("cid", "m"))).alias("ms")))
        # a centroid that lost all its points keeps its position
        moved = cents.join(mean, "parent").select(
            "parent", "cs", F.transform("cs", lambda c, i: F.coalesce(F.element_at("ms", i), c)).alias("new"))
        step = F.aggregate(F.zip_with("cs", "new", _sqdist), F.lit(0.0), lambda s, x: s + x)
        seen = Observation()
        cents = staged(moved.withColumn("_step", step).observe(seen, F.sum("_step").alias("shift"))
                       .select("parent", F.col("new").alias("cs")), "nested-centres")
        if (seen.get.get("shift") or 0.0) <= tolerance:
            break
    d = F.transform("cs", lambda c, i: F.struct(_sqdist(F.col("v"), c).alias("d"), i.alias("i")))
    final = members.join(cents, "parent").select("entity", "parent", F.array_min(d)["i"].cast("string").alias("cluster"))
    passing = pts.join(active.select("parent"), "parent", "left_anti").select("entity", "parent", F.lit("").alias("cluster"))
    return final.unionByName(passing)


def param_grid(params: dict[str, list]) -> list[dict]:
    """Cartesian product of list-valued parameters (a handful of runs)."""
    import itertools
    keys = list(params)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[params[k] for k in keys])]


def gmm_model_selection(embeddings: DataFrame, ks: Sequence[int], dimensions: Sequence[int], seed: int = 1,
                        max_iter: int = 50) -> DataFrame:
    """AIC / BIC of full-covariance Gaussian mixtures over a grid of component
    counts and PCA dimensions; ``converged`` tells whether the fit ended before
    ``max_iter``."""
    rows = []
    for d in dimensions:
        v = vectors(pca_reduce(embeddings, components=d))
        n = v.count()
        for k in ks:
            summary = GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(v).summary
            ll = summary.logLikelihood
            p = k * (d + d * (d + 1) / 2) + (k - 1)
            rows.append((int(d), int(k), float(ll), float(2 * p - 2 * ll), float(p * math.log(n) - 2 * ll),
                         summary.numIter < max_iter))
    return embeddings.sparkSession.createDataFrame(
        rows, "dimensions int, k int, log_likelihood double, aic double, bic double, converged boolean")


def embedding_sample(embeddings: DataFrame, pinned: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Hash sample of the embeddings plus the pinned entities."""
    sampled = embeddings.where(unit_hash("entity", seed) < fraction)
    pins = embeddings.join(pinned.select("entity"), "entity", "left_semi")
    return sampled.unionByName(pins).dropDuplicates(["entity"])


def scaled_k(k: int, fraction: float) -> int:
    """Clusters for a sample of that fraction, two at least."""
    return max(int(round(k * fraction)), 2)


def embedding_noise(kept: DataFrame, discarded: DataFrame, fractions: Sequence[float], seed: int = 0) -> DataFrame:
    """Per fraction: all kept embeddings plus that fraction of discarded
    entities not already kept (one pass, fraction as a key)."""
    spark = kept.sparkSession
    fr = F.broadcast(spark.createDataFrame([(float(f),) for f in fractions], "fraction double"))  # literal
    extra = discarded.join(kept.select("entity"), "entity", "left_anti")
    noisy = extra.crossJoin(fr).where(unit_hash("entity", seed) < F.col("fraction"))
    return kept.crossJoin(fr).unionByName(noisy)


def normalise_centroid_ids(labels: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Strip the "ce" prefix, renumber the children of every parent 0..n-1 in
    integer order, give an only child an empty label and rebuild the paths.
    A parent holds at most k children, so its window stays small."""
    out = labels.select("entity", *[F.regexp_replace(c, "^ce", "").cast("int").alias(c) for c in levels])
    for i, c in enumerate(levels):
        parent = F.concat_ws("_", F.lit(""), *[F.col(x).cast("string") for x in levels[:i]])
        out = out.withColumn("_par", parent)
        kids = out.select("_par", c).distinct()
        kids = (kids.withColumn("_r", F.dense_rank().over(Window.partitionBy("_par").orderBy(c)) - 1)
                .withColumn("_k", F.count("*").over(Window.partitionBy("_par"))))
        out = (out.join(kids, ["_par", c])
               .withColumn(f"_n_{c}", F.when(F.col("_k") > 1, F.col("_r").cast("string")).otherwise(F.lit("")))
               .drop("_r", "_k", "_par"))
    cols = []
    for i, c in enumerate(levels):
        arr = F.array(*[F.col(f"_n_{x}") for x in levels[: i + 1]])
        cols.append(F.array_join(F.filter(arr, lambda s: s != ""), "_").alias(c))
    return out.select("entity", *cols)
