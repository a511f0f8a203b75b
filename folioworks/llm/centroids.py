"""Clustering of vectors around centroids, exactly, by Orchard's search.

Components become whole numbers, so every sum is exact and the same on any cluster. A round assigns each vector to its nearest
centroid and moves each centroid to the mean of its vectors. The search keeps, for every centroid, the other centroids by rising
distance. A vector starts at a centroid and walks that centroid's list; when it meets one that is nearer, it goes over to the
list of that one. Centroids measured once are marked and not measured again. By the triangle inequality nothing nearer comes
once the list is more than twice as far as the vector's present distance; entries at exactly twice are still looked at, so a tie
finds the centroid of smaller number. All vectors of a batch walk at once.

Vectors are kept if they have exactly `dims` components, none of them null or not finite. A component is at most LARGEST in
size after scaling, so that a squared distance fits 63 bits; a vector beyond that is left out like one that is not finite. A
null id is an id like any other, repeated rows are vectors of their own, extra columns do not matter. With fewer vectors than
centroids there are as many centroids as vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

SCALE = 256
LARGEST = 1 << 26
#: Vectors that walk at once.
WALKERS = 4096


def whole(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = SCALE) -> DataFrame:
    """(vec_id, x: array of long) of the vectors kept, written once."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))
    kept = vectors.where((F.size(v) == dims) & fine)
    return common.written(kept.select(F.col(id_).alias("vec_id"), F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("x")), "vectors")


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors of smallest hash of seed and id, in the order of their hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(h.alias("h"), "vec_id", "x").orderBy("h", "vec_id", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


class Orchard:
    """Nearest centroid of many vectors at once, by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.int64)
        k = len(self.c)
        gap = np.empty((k, k), dtype=np.int64)
        for i in range(k):
            gap[i] = ((self.c - self.c[i]) ** 2).sum(axis=1)
        self.list = np.argsort(gap, axis=1, kind="stable")  # a centroid itself has distance 0
        self.gap = np.take_along_axis(gap, self.list, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, centroids measured) of every row of `x`."""
        n, k = len(x), len(self.c)
        cur = np.zeros(n, dtype=np.int64)
        dist = ((x - self.c[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        place = np.zeros(n, dtype=np.int64)
        walking = np.arange(n)
        while len(walking):
            at, on = place[walking], cur[walking]
            beyond = (at >= k) | (self.gap[on, np.minimum(at, k - 1)] > 4 * dist[walking])
            walking, at, on = walking[~beyond], at[~beyond], on[~beyond]
            if not len(walking):
                break
            place[walking] = at + 1
            other = self.list[on, at]
            new = ~seen[walking, other]
            who, other = walking[new], other[new]
            seen[who, other] = True
            d = ((x[who] - self.c[other]) ** 2).sum(axis=1)
            nearer = (d < dist[who]) | ((d == dist[who]) & (other < cur[who]))
            jump = who[nearer]
            cur[jump], dist[jump], place[jump] = other[nearer], d[nearer], 0
        return cur, dist, seen.sum(axis=1)


def _blocks(batch: pa.RecordBatch, column: int, dims: int):
    lists = batch.column(column)
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for i in range(0, len(x), WALKERS):
        yield i, x[i : i + WALKERS]


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The means of the vectors of each centroid, rounded down; a centroid without vectors stays.

    Every task sums its own vectors, so one row per task and centroid is shuffled and one per centroid comes back.
    """
    k, dims = centroids.shape

    def sums(batches):
        search, n, total = Orchard(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for b in batches:
            for _, x in _blocks(b, 0, dims):
                cur, _, _ = search.nearest(x)
                n += np.bincount(cur, minlength=k)
                own = (cur[None, :] == np.arange(k)[:, None]).astype(np.float64)
                total += (own @ x.astype(np.float64)).astype(np.int64)  # exact: WALKERS x LARGEST stays far under 2**53
        rows = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(n[rows]), pa.array(total[rows].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = points.select("x").mapInArrow(sums, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def assigned(points: DataFrame, centroids: np.ndarray, keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """`keep`, cluster (int), distance (long, squared) and measured (int: centroids whose distance was taken), written once."""
    keep, dims = list(keep), centroids.shape[1]

    def run(batches):
        search = Orchard(centroids)
        for b in batches:
            for i, x in _blocks(b, len(keep), dims):
                cur, dist, n = search.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(j).slice(i, len(x)) for j in range(len(keep))), pa.array(cur.astype(np.int32)), pa.array(dist), pa.array(n.astype(np.int32))],
                    names=[*keep, "cluster", "distance", "measured"],
                )

    kept = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep)
    return common.written(points.select(*keep, "x").mapInArrow(run, f"{kept}, cluster int, distance long, measured int"), "assigned")


def spelt(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_: str = "vec_id", vector: str = "embedding", dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and measured of every vector kept.

    Only the centroids and their sums, as many as `k`, are seen by the driver.
    """
    points = whole(vectors, id_, vector, dims)
    centroids = first_centroids(points, k, seed)
    none = F.lit(None)
    if not len(centroids):
        return points.select("vec_id", none.cast("int").alias("cluster"), none.cast("long").alias("distance"), none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"), none.cast("int").alias("measured"))
    for _ in range(rounds):
        centroids = moved(points, centroids)
    out = assigned(points, centroids)
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    about = out.sparkSession.createDataFrame([(r.cluster, r.s, sum(q.s for q in sums), spelt(centroids[r.cluster])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")


ship_by_value(__name__)
