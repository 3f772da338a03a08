"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries one upper bound, on the distance to its own centroid, and one lower bound, on
the distance to the second nearest. After the centroids have moved, the upper bound grows by the
drift of its centroid and the lower one shrinks by the largest drift of another. While the upper
bound stays below the lower one (or below half the way from its centroid to the next) nothing
else can be as near, and no distance is computed. Else the upper bound is made tight with one
distance; vectors that are still ambiguous get an exact integer scan of all centroids. Bounds are
rounded outwards, so rounding never decides, and ties always end in the scan.

A round is one pass over the vectors, which writes them with their bounds and clusters as a table.
Only vectors that changed their cluster add to the sums of the next centroids: minus where they
were, plus where they are. Tasks send a row for each cluster and component; the driver sees
k * (size + 1) numbers a round, whatever the input. No vector is shuffled, so common vectors and
large clusters do no harm.

Defined results: vectors that are null, of another length, or with a null, infinite or NaN component
are left out; repeated rows are separate vectors; a null id hashes as the word null; seeds with
equal hashes are ordered by their vectors; with fewer vectors than centroids there is one centroid
for each; equal centroids keep the smaller number's vectors and the others stay empty; an empty
table has no rows; other columns give way. Components whose magnitude is past ``largest`` after
scaling raise an error, for squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, digits
from evidentia.plans.staging import staged

#: More than the relative error of a few operations on doubles.
SLACK = 2.0**-40


@dataclass(frozen=True)
class Clustering:
    """clusters and rounds of updates; components of a vector; the factor before rounding down; what
    precedes an id in the hash that picks the seeds; the largest magnitude of a component."""

    clusters: int = 16
    rounds: int = 3
    size: int = 64
    scale: float = 64.0
    salt: str = "1:"
    largest: int = 2**27


def usable(vector: Column, size: int) -> Column:
    """Vectors of the length asked for, without null, infinite or NaN components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def integers(column: pa.Array, rule: Clustering) -> np.ndarray:
    """The vectors' components, scaled and rounded down."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * rule.scale)
    if len(x) and np.abs(x).max() > rule.largest:
        raise ValueError(f"a component is past {rule.largest} after scaling; squared distances would not fit 64 bits")
    return x.astype(np.int64).reshape(-1, rule.size)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared, exact, of every vector to every centroid."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)[None, :]


@dataclass(frozen=True)
class Movement:
    """What a round needs to know of its centroids: where they are, how far each came, how far the
    farthest other one came, and half the way to the next one."""

    centroids: np.ndarray
    drift: np.ndarray
    other_drift: np.ndarray
    half_way: np.ndarray

    @classmethod
    def between(cls, before: np.ndarray, after: np.ndarray) -> Movement:
        k = len(after)
        drift = np.sqrt(((after - before) ** 2).sum(1)) * (1 + SLACK)
        others = np.where(np.eye(k, dtype=bool), 0.0, drift[None, :]).max(1)
        apart = np.where(np.eye(k, dtype=bool), np.inf, np.sqrt(distances(after, after)))
        return cls(after, drift, others, apart.min(1) / 2 * (1 - SLACK))


def scanned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), upper and lower bound, by all distances."""
    exact = distances(v, centroids)
    nearest = exact.argmin(1)
    upper = np.sqrt(exact[np.arange(len(v)), nearest]) * (1 + SLACK)
    exact[np.arange(len(v)), nearest] = np.iinfo(np.int64).max
    lower = np.sqrt(exact.min(1)) * (1 - SLACK) if len(centroids) > 1 else np.full(len(v), np.inf)
    return nearest, upper, lower


def moved_on(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, to: Movement) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids moved, and how many vectors needed the full scan."""
    cluster = cluster.copy()
    upper = (upper + to.drift[cluster]) * (1 + SLACK)
    lower = lower - to.other_drift[cluster]
    lower -= np.abs(lower) * SLACK
    least = np.maximum(lower, to.half_way[cluster])
    open_ = np.flatnonzero(upper >= least)
    upper[open_] = np.sqrt(((v[open_] - to.centroids[cluster[open_]]) ** 2).sum(1)) * (1 + SLACK)
    open_ = open_[upper[open_] >= least[open_]]
    cluster[open_], upper[open_], lower[open_] = scanned(v[open_], to.centroids)
    return cluster, upper, lower, len(open_)


_STATE = "v array<int>, was int, cluster int, upper double, lower double"


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel().astype(np.int32)))


def _first(centroids: np.ndarray, rule: Clustering):
    """(vec_id, embedding) -> (vec_id, state)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(batch.column(1), rule)
            nearest, upper, lower = scanned(v, centroids)
            columns = [batch.column(0), _lists(v), pa.nulls(len(v), pa.int32()), pa.array(nearest, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "was", "cluster", "upper", "lower"])

    return run


def _next(to: Movement, last: bool):
    """(vec_id, state) -> (vec_id, state), or (vec_id, cluster, distance) the last time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, to.centroids.shape[1])
            was = batch.column(3).to_numpy()
            cluster, upper, lower, _ = moved_on(v, was, batch.column(4).to_numpy(), batch.column(5).to_numpy(), to)
            new = pa.array(cluster, pa.int32())
            if last:
                exact = ((v - to.centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), new, pa.array(exact)], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), new, pa.array(upper), pa.array(lower)], ["vec_id", "v", "was", "cluster", "upper", "lower"])

    return run


def _changes(clusters: int, size: int):
    """(v, was, cluster) of vectors that changed -> (cluster, component, total); component ``size`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((clusters, size + 1), np.int64)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], 1)
            was = batch.column(1).fill_null(-1).to_numpy()
            now = batch.column(2).to_numpy()
            for c in range(clusters):
                totals[c] += v[now == c].sum(0) - v[was == c].sum(0)
        cluster, component = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(totals[cluster, component])], ["cluster", "component", "total"])

    return run


def seeds(kept: DataFrame, rule: Clustering) -> np.ndarray:
    """The vectors of the ids with the smallest hashes, in their order: ``clusters`` rows at most."""
    mark = F.sha2(F.concat(F.lit(rule.salt), digits(F.col("vec_id"))), 256)
    rows = kept.select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(rule.clusters).collect()
    found = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
    return integers(found, rule)


def centroid_clusters(vectors: DataFrame, rule: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every usable vector, and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col("embedding"), rule.size)).select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = seeds(kept, rule)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    totals = np.zeros((len(centroids), rule.size + 1), np.int64)
    move = None
    for _ in range(rule.rounds):
        if move is None:
            state = bounded_batches(kept).mapInArrow(_first(centroids, rule), f"vec_id {kind}, {_STATE}")
        else:
            state = state.mapInArrow(_next(move, last=False), f"vec_id {kind}, {_STATE}")
        state = staged(state, "cluster_bounds")
        changed = state.filter(~F.col("cluster").eqNullSafe(F.col("was"))).select("v", "was", "cluster")
        parts = changed.mapInArrow(_changes(len(centroids), rule.size), "cluster int, component int, total long")
        for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():
            totals[r["cluster"], r["component"]] += r["total"]
        some = totals[:, -1] > 0
        new = centroids.copy()
        new[some] = totals[some, :-1] // totals[some, -1:]
        move, centroids = Movement.between(centroids, new), new
    if move is None:
        still = Movement.between(centroids, centroids)
        state = bounded_batches(kept).mapInArrow(_first(centroids, rule), f"vec_id {kind}, {_STATE}")
        return state.mapInArrow(_next(still, last=True), f"vec_id {kind}, cluster int, distance long"), centroids
    return state.mapInArrow(_next(move, last=True), f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame, rule: Clustering = Clustering()) -> DataFrame:
    """The clusters with cluster_inertia, inertia (sums of distances over the cluster and over all) and
    centroid_sha256. At most a row for each cluster is broadcast."""
    spark = vectors.sparkSession
    found, centroids = centroid_clusters(vectors, rule)
    found = staged(found, "clusters")
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    said = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, total, sum(sums.values()), said[c]) for c, total in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
