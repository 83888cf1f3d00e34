"""Operator 11: centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to
any other. When centroids move, the upper bound grows by the drift of the vector's own centroid and the lower one shrinks by
the largest drift among the others. While the upper bound is below the lower one, or below half the way from the own centroid
to its nearest neighbour, the assignment can't change and no distance is computed. Otherwise the upper bound
is replaced by the distance itself, and if that doesn't settle it, all centroids are scanned with exact integers.
Bounds are doubles rounded outwards at each step, so a decision never rests on a rounding error, and ties go to the smaller number.

Vectors and bounds are written to the shared folder once a round; sums of a cluster follow from the vectors that moved (added where
they came, taken off where they went), summed up in each task and then in Spark. The driver holds centroids only: clusters x dims numbers.

Defined results: a vector counts if it has exactly `dims` components, none null, NaN or infinite; others are left out. Integers beyond
+-2^27 are taken as that (a squared distance must fit 64 bits); sums of distances beyond 64 bits are given as the largest number. Repeated rows
count each; rows of one id start as centroids in the order of their components; a row without an id counts, and starts a centroid
only after all that have one. With fewer vectors than clusters each is a centroid. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm.common import park, table, unpark

#: Largest size of a component: 64 squares of twice that stay below 2^63.
LIMIT = 1 << 27
#: Below this size of all components, products of doubles are exact integers.
EXACT = 1 << 22
#: Full scans go over this many vectors at a time.
CHUNK = 4096
STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, scans int"


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each v to each c, exact."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT else np.int64
    x, y = v.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


def reassign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, scanned) of vectors v after the centroids have drifted to c; own is -1 where a vector has no cluster yet."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    known = own >= 0
    if known.any():
        a, top = own[known], int(drift.argmax())
        others = np.full(len(drift), drift[top])
        others[top] = np.delete(drift, top).max(initial=0.0)
        upper[known] = _up(upper[known] + drift[a])
        lower[known] = _down(lower[known] - others[a])
    apart = squares(c, c).astype(float)
    np.fill_diagonal(apart, np.inf)
    half = _down(np.sqrt(apart.min(1)) / 2)
    bound = np.where(known, np.maximum(lower, half[own]), -np.inf)
    open_ = np.nonzero(upper >= bound)[0]
    near = open_[known[open_]]
    if len(near):
        diff = v[near].astype(np.int64) - c[own[near]]
        upper[near] = _up(np.sqrt((diff * diff).sum(1)))
    scan = np.nonzero(upper >= bound)[0]
    for at in range(0, len(scan), CHUNK):
        rows = scan[at:at + CHUNK]
        d = squares(v[rows], c)
        best = d.argmin(1)
        least = d[np.arange(len(rows)), best]
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        own[rows], upper[rows] = best, _up(np.sqrt(least))
        lower[rows] = _down(np.sqrt(d.min(1))) if len(c) > 1 else np.inf
    scanned = np.zeros(len(v), bool)
    scanned[scan] = True
    return own, upper, lower, scanned


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _round(c: np.ndarray, drift: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                own = b.column("cluster").to_numpy(zero_copy_only=False)
                now, upper, lower, scanned = reassign(_vectors(b, c.shape[1]), own, b.column("upper").to_numpy(), b.column("lower").to_numpy(), c, drift)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array(now, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower),
                     pa.array(b.column("scans").to_numpy() + scanned.astype(np.int32), pa.int32())], ["vec_id", "v", "cluster", "was", "upper", "lower", "scans"])

    return run


def _moves(clusters: int, dims: int):
    """What a task's moved vectors add to each cluster: dims sums, and their number as one more."""
    def run(batches):
        total = np.zeros((clusters, dims + 1), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.column_stack([_vectors(b, dims).astype(np.int64), np.ones(b.num_rows, np.int64)])
                for sign, name in ((1, "cluster"), (-1, "was")):
                    at = b.column(name).to_numpy()
                    for k in np.unique(at[at >= 0]):
                        total[k] += sign * v[at == k].sum(0)
        k, dim = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(dim, pa.int32()), pa.array(total[k, dim])], ["k", "dim", "n"])

    return run


def _distances(c: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                own = b.column("cluster").to_numpy()
                diff = _vectors(b, c.shape[1]).astype(np.int64) - c[own]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array((diff * diff).sum(1)), b.column("scans")], ["vec_id", "cluster", "distance", "scans"])

    return run


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v: rows of vectors(vec_id, embedding) that count, as integers."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))
    return vectors.select("vec_id", "embedding").where((F.size(e) == dims) & ~bad).select("vec_id", whole.alias("v"))


def centroid_clusters(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, scans) per vector, and the final centroids; scans says how many of the assignments took a full scan."""
    kept = whole_vectors(vectors, dims, scale)
    state = park(kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans")))
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = [r["v"] for r in state.orderBy(order, "v").select("v").limit(clusters).collect()]
    c = np.array(first, np.int64).reshape(-1, dims)
    total, drift = np.zeros((len(c), dims + 1), object), np.zeros(len(c))
    for _ in range(rounds if first else 0):
        before, state = state, park(state.mapInArrow(_round(c, drift), STATE))
        unpark(before)
        moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_moves(len(c), dims), "k int, dim int, n long")
        for r in moved.groupBy("k", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            total[r["k"], r["dim"]] += int(r["n"])
        new = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else old for t, old in zip(total, c.tolist(), strict=True)], np.int64)
        drift, c = _up(np.sqrt(((new - c) ** 2).sum(1).astype(float))), new
    if not first:
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), "scans"), []
    done = park(state.mapInArrow(_round(c, drift), STATE).select("vec_id", "v", "cluster", "scans")
                .mapInArrow(_distances(c), "vec_id long, cluster int, distance long, scans int"))
    unpark(state)
    return done, c.tolist()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table."""
    found, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    most = Decimal((1 << 63) - 1)
    fits = lambda x: F.least(x, F.lit(most)).cast("long")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = sum(sums.values(), Decimal(0))
    rows = [(k, sums.get(k, Decimal(0)), every, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in enumerate(centroids)]
    # one row a centroid
    known = spark.createDataFrame(rows, "cluster int, own decimal(38,0), every decimal(38,0), centroid_sha256 string")
    return (found.join(F.broadcast(known), "cluster")
            .select("vec_id", "cluster", "distance", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("every")).alias("inertia"), "centroid_sha256"))


def _oracle(clusters: int = 40, rounds: int = 5, dims: int = 64) -> str:
    near = ("(SELECT vec_id, v, k, c, d FROM (SELECT v.vec_id, v.v, c.k, c.c, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, "
            "row_number() OVER (PARTITION BY v.row ORDER BY d, c.k) AS place FROM v CROSS JOIN {c} c) WHERE place = 1)")
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS k, v AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {clusters})"]
    for r in range(rounds):
        # // rounds to zero; the sum is shifted to a positive one first
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list(m ORDER BY dim) AS c FROM (
          SELECT k, dim, (sum(x + 1000000)::BIGINT // count(*)) - 1000000 AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM {near.format(c=f"c{r}")}) GROUP BY k, dim) GROUP BY k) n ON n.k = o.k)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {near.format(c=f"c{rounds}")}"""


ORACLE = _oracle()
