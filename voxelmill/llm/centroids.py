"""Centroid clustering by a bisector tournament, in whole numbers.

Components become ``floor(scale * x)``. For centroids a < b the plane halfway between them has the integer normal
``2 (b - a)`` and threshold ``|b|^2 - |a|^2``: a vector's product with the normal lies above the threshold exactly where b is
nearer. So k - 1 sign tests, each between the winner so far and the next centroid, leave the nearest one; zero favours the
smaller number, and only the winner's distance is computed. Normals and thresholds, k (k - 1) / 2 pairs, go to the tasks
with the function; k and the length of a vector are parameters, so their size is bounded.

Vectors are put into whole numbers once and written. A round is a scan whose tasks add up their own vectors by centroid; Spark
adds up the tasks' sums, and k x length numbers come to the driver, which floors the means exactly. The last assignment is
written too, then its sums are joined to it. No vector is shuffled, so no cluster, however full, meets in one task.

Vectors that are null, of another length, or hold null, NaN or infinite components are left out. Rows without an id take part,
but don't start as centroids. Repeated rows are vectors of their own; where they share an id at the start, they are ordered by their numbers. Fewer vectors
than k give fewer centroids; an empty table gives an empty result. Numbers of 2^27 and more are an error, since a distance
may not fit a long then; sums and inertia beyond a long are errors of Spark's. Further columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.session import materialize

K, ROUNDS, LENGTH, SCALE, LIMIT = 16, 3, 64, 64, 1 << 27


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (k, k, length) and thresholds (k, k) of the planes halfway between centroids, used where the first is the smaller number."""
    squares = (centroids**2).sum(1)
    return 2 * (centroids[None] - centroids[:, None]), squares[None] - squares[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid's number for each vector: the winner so far meets each next centroid once."""
    winner = np.zeros(len(vectors), np.int64)
    for b in range(1, len(thresholds)):
        side = np.einsum("ij,ij->i", normals[winner, b], vectors) - thresholds[winner, b]
        winner[side > 0] = b
    return winner


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, length)


def whole_numbers(df: DataFrame, length: int = LENGTH, scale: int = SCALE, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, v``: usable vectors as whole numbers."""
    x = F.col("x")
    usable = (F.size(x) == length) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    number = lambda c: F.when(F.abs(c) < LIMIT / scale, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too great for exact distances")).cast("long"))
    own = df.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("x")).filter("x is not null")
    return own.filter(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("x", number).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose ids have the least hash."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in vectors.filter("vec_id is not null").orderBy(order, "v").limit(k).collect()], np.int64)  # k rows


def add_up(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By centroid, how many vectors are nearest to it and their sum."""
    normals, thresholds = bisectors(centroids)
    k, length = centroids.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            m = _matrix(batch["v"], length)
            won = tournament(m, normals, thresholds)
            n += np.bincount(won, minlength=k)
            for c in np.unique(won):
                sums[c] += m[won == c].sum(0)
        own = np.flatnonzero(n)
        flat = [pa.array(np.repeat(own, length)), pa.array(np.tile(np.arange(length), len(own))), pa.array(np.repeat(n[own], length)), pa.array(sums[own].ravel())]
        yield pa.RecordBatch.from_arrays(flat, ["cluster", "at", "n", "total"])

    parts = vectors.select("v").mapInArrow(walk, "cluster long, at long, n long, total long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "at").collect():  # k x length rows
        out.setdefault(r.cluster, (r.n, []))[1].append(r.total)
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared)."""
    normals, thresholds = bisectors(centroids)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch["v"], centroids.shape[1])
            won = tournament(m, normals, thresholds)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(won.astype(np.int32)), pa.array(((m - centroids[won]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(walk, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long")


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of every usable vector, and the final centroids."""
    vectors = materialize(whole_numbers(df, length, scale, vec_id, vec), "centroid-vectors")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        # no id to start from: the one centroid is the origin
        centroids = np.zeros((1, length), np.int64)
    for _ in range(rounds):
        for c, (n, total) in add_up(vectors, centroids).items():
            centroids[c] = [t // n for t in total]  # floors
    found = materialize(assign(vectors, centroids), "centroid-assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = {r.cluster: r.cluster_inertia for r in sums.collect()}  # k rows
    own = F.get(F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids)))), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia")), centroids


def with_digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with ``centroid_sha256``: the digest of each row's centroid, its numbers joined by commas."""
    named = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return found.withColumn("centroid_sha256", F.get(F.array(*map(F.lit, named)), F.col("cluster")))


def oracle_sql(k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE) -> str:
    """The query's rows in DuckDB SQL: all distances, round by round."""
    near = lambda r: f"a{r} as materialized (select p, arg_min(c, (d, c)) as c, min(d) as d from (select v.p, q.c, list_sum(list_transform(range(1, {length + 1}), lambda i: (v.v[i] - q.v[i]) * (v.v[i] - q.v[i])))::bigint as d from v, c{r} q) group by p)"
    parts = [
        f"with v as materialized (select row_number() over () as p, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {length} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as c, v from v where vec_id is not null order by sha256('1:' || vec_id), v limit {k})",
    ]
    for r in range(rounds):
        parts += [
            near(r),
            f"s{r} as (select c, i, sum(v.v[i])::bigint as s, count(*) as n from a{r} join v using (p), range(1, {length + 1}) t(i) group by all)",
            f"c{r + 1} as materialized (select q.c, coalesce(m.v, q.v) as v from c{r} q left join (select c, list((s - ((s % n) + n) % n) // n order by i) as v from s{r} group by 1) m using (c))",
        ]
    parts += [near(rounds), f"t as (select c, sum(d)::bigint as ci from a{rounds} group by 1), w as (select c, sha256(array_to_string(v, ',')) as h from c{rounds})"]
    return ", ".join(parts) + f" select vec_id, c as cluster, d as distance, ci as cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia, h as centroid_sha256 from a{rounds} join v using (p) join t using (c) join w using (c)"
