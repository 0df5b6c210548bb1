"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected on DIMS Gaussian (2-stable) directions; a distance d becomes d times the root of a chi-square
variable. A kd-tree over a bounded sample of projections deals all rows into cells, large ones in parts; each part builds
its own kd-tree. A query walks leaves in the order of projected distance and verifies their projected neighbours, nearest
first, and stops once the chi-square test holds: a vector nearer than the k-th found would lie within the projected radius
already walked with probability of at least CONFIDENCE. Every query starts in its own cell; the bound it gets there
decides, by the same test against the cells' boxes, which other cells it visits. A task holds one part's vectors; queries
pass by in batches.

Edge cases: vectors that are null, empty, zero, or hold nulls, NaN or infinities, rows without an id, and vectors of
another length than the commonest take no part, as query or candidate. Of equal vectors only the k + 1 smallest ids
can be answers, so only those are indexed; equal queries are searched once. Repeated rows of one id count once. Ties
go to the smaller id. With fewer than k candidates all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import runtime

#: The more directions, the fewer vectors lie inside the stopping radius. The test's confidence leaves recall above 0.9.
DIMS, CONFIDENCE = 24, 0.9
#: Vectors of a leaf; leaves walked between two tests; projected neighbours verified first, where no bound is known.
LEAF, TOGETHER, FIRST = 64, 16, 64
#: What a worker holds of a cell.
CELL_BYTES = 16 << 20
#: Projections that shape the cells: the documented bound.
SAMPLE = 20_000
SEED = 11


def chi_square_quantile(dims: int, p: float) -> float:
    """For an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Split:
    """A kd-tree over projections as flat arrays: leaves are numbered, inner nodes hold a dimension and a value."""

    dim: np.ndarray
    value: np.ndarray
    left: np.ndarray  # child nodes; ~leaf for a leaf
    right: np.ndarray
    low: np.ndarray  # leaves x dims, borders of their boxes
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if not len(self.dim):
            return out
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            n = node[live]
            go = np.where(x[live, self.dim[n]] < self.value[n], self.left[n], self.right[n])
            end = go < 0
            out[live[end]] = ~go[end]
            node[live] = go
            live = live[~end]
        return out


def build(x: np.ndarray, leaf_rows: int, max_leaves: int | None = None) -> tuple[Split, list[np.ndarray]]:
    """Median splits of the widest dimension until leaves hold leaf_rows or fewer; equal points stay together."""
    dims = x.shape[1]
    dim, value, left, right, lows, highs, members = [], [], [], [], [], [], []
    want = max_leaves or max(1, -(-len(x) // leaf_rows))

    def add(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: int) -> int:
        if share > 1 and len(rows) > 1:
            own = x[rows]
            d = int(np.ptp(own, axis=0).argmax())
            v = float(np.median(own[:, d]))
            less = own[:, d] < v
            if not less.any():  # half or more lie on the lowest value
                above = own[:, d][own[:, d] > v]
                if len(above):
                    v = float(above.min())
                    less = own[:, d] < v
            if less.any() and not less.all():
                node = len(dim)
                dim.append(d)
                value.append(v)
                left.append(0)
                right.append(0)
                hi_l, lo_r = hi.copy(), lo.copy()
                hi_l[d] = lo_r[d] = v
                left[node] = add(rows[less], lo, hi_l, (share + 1) // 2)
                right[node] = add(rows[~less], lo_r, hi, share // 2)
                return node
        members.append(rows)
        lows.append(lo)
        highs.append(hi)
        return ~(len(members) - 1)

    add(np.arange(len(x)), np.full(dims, -np.inf), np.full(dims, np.inf), want)
    as_int = lambda v: np.array(v, np.int64)
    return Split(as_int(dim), np.array(value, float), as_int(left), as_int(right), np.array(lows), np.array(highs)), members


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    d = np.maximum(np.maximum(low - q, q - high), 0)
    return (d * d).sum(1)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in the same order of operations, so that equal vectors have equal scores."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Cell:
    """One cell's vectors under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, proj: np.ndarray):
        self.unit = x / np.sqrt((x * x).sum(1))[:, None]
        p = (self.unit @ proj).astype(np.float32)
        _, members = build(p, LEAF)
        order = np.concatenate(members)
        self.ids, self.x, self.unit, self.p = ids[order], x[order], self.unit[order], p[order]
        self.starts = np.concatenate([[0], np.cumsum([len(m) for m in members])])
        self.low = np.minimum.reduceat(self.p, self.starts[:-1])
        self.high = np.maximum.reduceat(self.p, self.starts[:-1])

    def search(self, q: np.ndarray, proj: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best found, and how many vectors were verified; ``bound``: the squared distance of the
        k-th known from elsewhere; ``limit``: chi-square quantile. Leaves are walked by the distance of their boxes, some
        at a time; their projected neighbours are verified nearest first, and the test is made anew at every step."""
        u = q / np.sqrt((q * q).sum())
        at = (u @ proj).astype(np.float32)
        near = box_distance(at, self.low, self.high)
        order = np.argsort(near, kind="stable")
        near = near[order]
        kept, dist = np.zeros(0, np.int64), np.zeros(0)
        best, verified, i = bound, 0, 0
        while i < len(order) and near[i] <= limit * best:  # else the chi-square test holds for all that is left
            leaves = order[i : i + TOGETHER]
            i += len(leaves)
            rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in leaves])
            r = self.p[rows] - at
            r = np.einsum("ij,ij->i", r, r)
            if len(rows) > FIRST and best == np.inf:
                nearest = np.argpartition(r, FIRST - 1)
                steps = [nearest[:FIRST], nearest[FIRST:]]
            else:
                steps = [np.arange(len(rows))]
            for step in steps:
                own = rows[step[r[step] <= limit * best]]
                if not len(own):
                    continue
                verified += len(own)
                kept, dist = np.concatenate([kept, own]), np.concatenate([dist, 2 - 2 * (self.unit[own] @ u)])
                if len(kept) >= k:
                    kth = float(np.partition(dist, k - 1)[k - 1])
                    ok = dist <= kth + 1e-9  # ties are settled below
                    kept, dist = kept[ok], dist[ok]
                    best = min(best, max(kth, 0.0) + 1e-9)
        s = cosines(self.x[kept], q)
        top = np.lexsort((self.ids[kept], -s))[:k]
        return self.ids[kept][top], s[top], verified


FOUND = "qkey bigint, vec_id bigint, score double, verified bigint"
PLACED = "key bigint, cell bigint, vec binary"


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _walk(batches: Iterator[pa.RecordBatch], proj: np.ndarray, k: int, limit: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, kind, key, vec, bound) in order: a part's vectors, then the queries that visit it."""
    place = cell = None
    ids: list[np.ndarray] = []
    xs: list[np.ndarray] = []
    for batch in batches:
        cells, parts, kinds = (batch.column(i).to_numpy() for i in range(3))
        keys, bounds = batch.column(3).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        x = _vectors(batch.column(4), len(proj))
        out: list[list] = [[], [], [], []]
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if place != (cells[lo], parts[lo]):
                place, cell, ids, xs = (cells[lo], parts[lo]), None, [], []
            if kinds[lo] == 0:
                ids.append(keys[lo:hi])
                xs.append(x[lo:hi])
                continue
            if cell is None and ids:
                cell = Cell(np.concatenate(ids), np.concatenate(xs), proj)
                ids, xs = [], []
            for j in range(lo, hi) if cell else ():
                got, scores, verified = cell.search(x[j], proj, k, float(bounds[j]), limit)
                out[0] += [keys[j]] * (len(got) + 1)
                out[1] += [*got.tolist(), None]
                out[2] += [*scores.tolist(), None]
                out[3] += [*[0] * len(got), verified]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["qkey", "vec_id", "score", "verified"])


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries`` but itself: query_id, rank, vec_id, score, and
    verified, the number of vectors that the query's search compared."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)

    rows = clean(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")
    if sizes is None:
        return empty
    d, total = sizes.d, sizes.n
    proj = np.random.default_rng(SEED).normal(size=(d, DIMS))
    cell_rows = max(LEAF, CELL_BYTES // (8 * d))
    key = [F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")]
    # a limit per group before the shuffle: at most k + 1 rows of a vector leave a task
    top = Window.partitionBy("h1", "h2").orderBy("id")
    index = rows.where(F.size("v") == d).select("id", "v", *key).dropDuplicates(["h1", "h2", "id"]).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    mine = runtime.materialize(clean(queries).where(F.size("v") == d).select("id", "v", *key).dropDuplicates(["h1", "h2", "id"]).withColumn("qkey", F.min("id").over(Window.partitionBy("h1", "h2"))), "queries")
    one = mine.where("id = qkey").select("qkey", "v")

    share = min(1.0, 2.0 * SAMPLE / max(1, total))
    got = rows.where(F.size("v") == d).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(SAMPLE).select("v").toPandas()
    sample = np.array(got["v"].tolist(), float).reshape(-1, d)
    sample = sample / np.sqrt((sample * sample).sum(1))[:, None] @ proj if len(sample) else np.zeros((1, DIMS))
    split, _ = build(sample, LEAF, max(1, -(-total // cell_rows)))
    limit = chi_square_quantile(DIMS, CONFIDENCE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            x = v.flatten().to_numpy().reshape(-1, d)
            cells = split.leaves(x / np.sqrt((x * x).sum(1))[:, None] @ proj)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "cell", "vec"])

    indexed = runtime.materialize(index.select("id", "v").mapInArrow(place, PLACED), "indexed")
    home = runtime.materialize(one.mapInArrow(place, PLACED), "home")
    # a cell of more rows than a worker should hold is dealt in parts; each meets the cell's queries
    parts = runtime.materialize(indexed.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).alias("parts")), "cells")  # a row a cell

    def visit(asked: DataFrame) -> DataFrame:
        held = indexed.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), F.lit(0).alias("kind"), "key", "vec", F.lit(0.0).alias("bound"))
        asked = asked.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "key", "vec", "bound")
        both = held.union(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return both.mapInArrow(lambda it: _walk(it, proj, k + 1, limit), FOUND)

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    first = runtime.materialize(visit(home.withColumn("bound", F.lit(float("inf")))), "found")
    # the (k+1)-th found so far bounds what other cells can add
    bounds = first.where("vec_id is not null").withColumn("r", F.row_number().over(best)).where(F.col("r") == k + 1).select(F.col("qkey").alias("key"), (2 - 2 * F.col("score")).alias("b"))
    roads = home.join(bounds, "key", "left").select("key", "cell", "vec", F.coalesce("b", F.lit(float("inf"))).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(2), d)
            at = x / np.sqrt((x * x).sum(1))[:, None] @ proj
            for i, (key, cell, bound) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                bound = max(bound, 0.0) + 1e-9
                to = np.flatnonzero(box_distance(at[i], split.low, split.high) <= limit * bound)
                to = to[to != cell]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(to), pa.int64()), pa.array(to, pa.int64()), pa.array([x[i].tobytes()] * len(to), pa.binary()), pa.array([bound] * len(to), pa.float64())], ["key", "cell", "vec", "bound"])

    others = runtime.materialize(visit(roads.mapInArrow(route, f"{PLACED}, bound double")), "found-elsewhere")
    both = first.union(others)
    found = both.where("vec_id is not null").select("qkey", "vec_id", "score").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    found = found.join(both.groupBy("qkey").agg(F.sum("verified").alias("verified")), "qkey")
    answers = mine.select(F.col("id").alias("query_id"), "qkey").join(found, "qkey").where("vec_id <> query_id")
    mine_best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(mine_best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op8_stable_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = runtime.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
