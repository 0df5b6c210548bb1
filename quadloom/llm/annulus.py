"""Centroid clustering of integer vectors by annulus search.

A vector whose distance to some centroid is u can only be as near to centroids whose norms differ from its own by at most
u. Centroids are sorted by norm; each vector's distance to the centroid it had before (at first: to the one next in norm)
is its bound, two binary searches give the centroids in its annulus, and those alone are compared, exactly and with the
borders, so that ties go to the smaller number.

Each round is one pass: tasks read the vectors with their last cluster and write them with the new one; Spark sums the
components by cluster (partially before the shuffle), and the sums of at most ``k`` clusters reach the driver, which
divides them exactly. Norms and bounds are doubles, widened by more than their error; distances are integers.

Edge cases: vectors that are null, of another length or hold null or non-finite components take no part. Vectors without
an id are clustered but start no centroid. Rows that repeat an id are vectors each. With fewer than ``k`` vectors there
are as many centroids. Components are cut to +-2^62; a distance or sum beyond a long is null. Other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime

#: Production parameters of the query.
DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
LONG = (1 << 63) - 1
LARGEST = 1 << 62


def kept_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of ``scale`` times the components, of all vectors that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    cells = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST)))
    return vectors.where((F.size(v) == dims) & whole).select(F.col(id_col).cast("bigint").alias("vec_id"), cells.alias("v"))


class Centroids:
    """Centroids in the order of their norms, for exact search of the nearest."""

    def __init__(self, rows: list[list[int]]):
        norms = [float(sum(x * x for x in r)) ** 0.5 for r in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: norms[i]), np.int64)
        self.place = np.argsort(self.order)
        self.norms = np.array([norms[i] for i in self.order])
        self.rows = rows
        self.largest = max((abs(x) for r in rows for x in r), default=0)

    def nearest(self, v: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, squared distance and how many centroids were compared; ``last`` < 0: no centroid before."""
        n, d = v.shape
        top = max(self.largest, int(np.abs(v).max(initial=0)))
        if 4 * d * top * top > LONG:  # Python's integers know no limit
            v = v.astype(object)
        rows = np.array([self.rows[i] for i in self.order], dtype=v.dtype)
        norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(rows) - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(norms - self.norms[left] < self.norms[right] - norms, left, right)
        start = np.where(last >= 0, self.place[last], start)
        best, number = ((v - rows[start]) ** 2).sum(axis=1), self.order[start].copy()
        bound = np.sqrt(best.astype(float))
        margin = 1e-9 * (norms + bound) + 1e-6
        low = np.searchsorted(self.norms, norms - bound - margin, "left")
        high = np.searchsorted(self.norms, norms + bound + margin, "right")
        for j in range(len(rows)):
            own = np.flatnonzero((low <= j) & (j < high) & (start != j))
            if len(own):
                dist = ((v[own] - rows[j]) ** 2).sum(axis=1)
                c = self.order[j]
                nearer = (dist < best[own]) | (dist == best[own]) & (c < number[own])
                best[own[nearer]], number[own[nearer]] = dist[nearer], c
        return number, best, high - low


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows (vec_id, v, cluster) -> vec_id, v, cluster, distance, compared: the nearest centroid, its squared distance and how
    many were compared; ``cluster`` before is the last round's or null."""
    runtime.ship(rows.sparkSession)
    dims = len(centroids[0]) if centroids else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            if batch.num_rows and centroids:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                last = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                number, best, compared = search.nearest(v, last)
                distance = pa.array([x if x <= LONG else None for x in best.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int32()), distance, pa.array(compared, pa.int32())], ["vec_id", "v", "cluster", "distance", "compared"])

    return rows.select("vec_id", "v", F.col("cluster").cast("int").alias("cluster")).mapInArrow(run, "vec_id bigint, v array<bigint>, cluster int, distance bigint, compared int")


def first_centroids(kept: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed``:id (equal ids: the smaller vector first)."""
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.where("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the clusters' means; clusters without vectors stay."""
    dims = len(centroids[0]) if centroids else 0
    sums = lambda kind: rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[kind(F.col("v")[i]) for i in range(dims)]).alias("s")).collect()
    found = sums(F.try_sum) if dims else []
    if any(x is None for r in found for x in r.s):  # beyond a long
        found = sums(lambda x: F.sum(x.cast("decimal(38,0)")))
    new = {r.cluster: [int(x) // r.n for x in r.s] for r in found}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, v, cluster, distance, compared of every vector after ``rounds`` rounds, and the final centroids."""
    rows = kept_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    centroids = first_centroids(rows, k, seed)
    rows = rows.withColumn("cluster", F.lit(None).cast("int"))
    before = None
    for i in range(rounds + 1):
        rows = runtime.materialize(assign(rows, centroids), f"round-{i}")
        if before is not None:
            runtime.drop_table(before)
        before = rows
        if i < rounds:
            centroids = moved(rows, centroids)
    return rows, centroids


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, the clusters' and the whole inertia, and a digest of the centroid."""
    per = rows.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.try_sum("distance")).alias("cluster_inertia")).collect()  # at most k rows
    parts = [r.cluster_inertia for r in per]
    whole = sum(parts) if None not in parts else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(r.cluster, r.cluster_inertia, whole if whole is not None and whole <= LONG else None, digests[r.cluster]) for r in per]
    small = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(runtime.table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    square = "list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, 65)])::BIGINT"
    near = "SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min({{'d': " + square + ", 'c': c.c}}) AS best FROM k x, c{0} c GROUP BY x.r"
    move = ("SELECT c.c, CASE WHEN s.n IS NULL THEN c.v ELSE [((t - ((t % s.n) + s.n) % s.n) // s.n)::BIGINT for t in s.s] END AS v FROM c{0} c LEFT JOIN "
            "(SELECT best.c AS c, count(*)::HUGEINT AS n, [" + ", ".join(f"sum(v[{i}])" for i in range(1, 65)) + "] AS s FROM a{0} GROUP BY best.c) s ON s.c = c.c")
    steps = [f"a{i} AS MATERIALIZED ({near.format(i)}), c{i + 1} AS MATERIALIZED ({move.format(i)})" for i in range(ROUNDS)]
    return ("WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings "
            "WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),\n"
            "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1)::INTEGER AS c, v FROM k WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16),\n"
            + ",\n".join(steps) + f",\nz AS MATERIALIZED ({near.format(ROUNDS)})\n"
            "SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,\n"
            f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON c.c = best.c")


ORACLE = _oracle()
