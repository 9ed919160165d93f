"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``. An index cuts the rows, ranged by their leading component and id, into
blocks with the least and greatest value of each component. For a query, the sum of each component's best product bounds
a block's scores; blocks are visited by falling bound, whole blocks are scored from their forward index (the rows'
matrix), and a query stops when the next bound falls below its k-th score.

The index is written once. Queries go to every task in slices of at most ``SLICE`` rows (a fixed size), each slice
passes over the index once, and only k rows for each query and task are shuffled. Results are exact: ties go to the
smaller id, and a block whose bound equals the k-th score is still scored. How much is pruned is up to the vectors:
blocks of vectors that spread evenly over a sphere have bounds above every k-th score, and all of them are scored.

Rows whose id is null, or whose vector is null, empty or holds null or non-finite components take no part. A vector meets
only vectors of its length. A query never meets rows with its own id; repeated candidates count each, repeated query
rows once. Integers and sums are exact whatever their size; a score among the k best that doesn't fit a long is an error,
as is a component beyond 1e305. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.session import materialize, scratch_path, shuffle_partitions

BLOCK_ROWS, SLICE, SEARCHED, TOP = 256, 16_384, 2048, (1 << 63) - 1
BLOCKS = "dims int, n int, ids binary, rows binary, low binary, high binary"


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def to_integers(values: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers as doubles: those of a double times a power of two are exact."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values.astype(np.float64))
    if not np.isfinite(whole).all():
        raise OverflowError("a scaled component is beyond a double")
    return whole


def _matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer rows, by vector length."""
    vec = batch["vec"]
    sizes = np.diff(vec.offsets.to_numpy())
    flat, starts, ids = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()[:-1], batch["id"].to_numpy()
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        yield ids[own], to_integers(flat[starts[own][:, None] + np.arange(d)], scale)


def build_index(df: DataFrame, scale: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``id, vec`` rows."""
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    lead = F.array_position(F.transform("vec", lambda x: F.abs(x.cast("double"))), top)
    ranged = df.withColumn("lead", F.struct(F.size("vec"), lead, F.signum(F.element_at("vec", lead.cast("int"))))).repartitionByRange(shuffle_partitions(df.sparkSession), "lead", "id").sortWithinPartitions("lead", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in _matrices(batch, scale):
                for at in range(0, len(ids), block_rows):
                    i, x = ids[at : at + block_rows], m[at : at + block_rows]
                    cell = {"dims": [x.shape[1]], "n": [len(i)], "ids": [i.astype("<i8").tobytes()], "rows": [x.astype("<f8").tobytes()], "low": [x.min(0).astype("<f8").tobytes()], "high": [x.max(0).astype("<f8").tobytes()]}
                    yield pa.RecordBatch.from_pydict(cell, pa.schema([("dims", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "low", "high"))]))

    return ranged.select("id", "vec").mapInArrow(cut, BLOCKS)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; exact, or ``TOP`` with their sign where a long doesn't hold them."""
    with np.errstate(over="ignore"):
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.array([[max(-TOP, min(TOP, v)) for v in row] for row in whole(q) @ whole(x).T], np.int64).reshape(len(q), len(x))


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of each query on each block, a little above the exact sums."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        return np.nan_to_num(bound + size * 1e-9 + 1, nan=np.inf, posinf=np.inf, neginf=-np.inf)


class Best:
    """Running k best (score, id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.n = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max), np.zeros(n, np.int64)

    def part(self, a: int, b: int) -> Best:
        """A view of some queries."""
        out = object.__new__(Best)
        out.k, out.score, out.id, out.n = self.k, self.score[a:b], self.id[a:b], self.n[a:b]
        return out

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.n[rows] >= self.k, self.score[rows, -1].astype(np.float64), -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, live: np.ndarray) -> None:
        hot = ((score >= self.score[rows, -1][:, None]) & live).any(axis=1)
        rows, score, live = rows[hot], score[hot], live[hot]
        if not len(rows):
            return
        s = np.concatenate([self.score[rows], np.where(live, score, np.iinfo(np.int64).min)], 1)
        i = np.concatenate([self.id[rows], np.where(live, ids[None], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((i, -np.maximum(s, -np.iinfo(np.int64).max)), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.n[rows] = np.minimum(self.k, self.n[rows] + live.sum(1))


def search_blocks(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], best: Best) -> int:
    """Visit blocks (ids, rows, low, high) by each query's falling bound; returns how many (query, block) pairs were scored."""
    bound = _bounds(q, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    active, scored = np.arange(len(q)), 0
    for w in range(len(blocks)):
        b = order[active, w]
        open_ = bound[active, b] >= best.kth(active)
        active, b = active[open_], b[open_]
        if not len(active):
            break
        scored += len(active)
        for one in np.unique(b):
            rows = active[b == one]
            ids, x = blocks[one][:2]
            best.add(rows, _product(q[rows], x), ids, ids[None] != q_ids[rows][:, None])
    return scored


def _searched(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(ids), k) for d, (ids, _) in shared.value.items()}
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d, (q_ids, q) in shared.value.items():
                cells = [tuple(np.frombuffer(batch[c][int(r)].as_buffer(), t) for c, t in (("ids", "<i8"), ("rows", "<f8"), ("low", "<f8"), ("high", "<f8"))) for r in np.flatnonzero(dims == d)]
                blocks = [(i, x.reshape(-1, d), lo, hi) for i, x, lo, hi in cells]
                for at in range(0, len(q_ids) if blocks else 0, SEARCHED):
                    search_blocks(q_ids[at : at + SEARCHED], q[at : at + SEARCHED], blocks, best[d].part(at, at + SEARCHED))
        for d, (q_ids, _) in shared.value.items():
            b = best[d]
            real = np.arange(k)[None] < b.n[:, None]
            yield pa.record_batch({"query_id": np.repeat(q_ids, k).reshape(-1, k)[real], "vec_id": b.id[real], "score": b.score[real]})

    return search


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``df`` for each row of ``queries`` (a table of the same columns)."""
    spark = df.sparkSession
    shape = lambda t: t.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    index = materialize(build_index(shape(df), scale), "topk-index")
    asked = materialize(shape(queries).distinct(), "topk-queries")
    slices = max(1, -(-2 * asked.count() // SLICE))
    parts = []
    for s in range(slices):
        # hash slices of half SLICE rows on average; a fuller one is searched in pieces
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == s).toArrow() if slices > 1 else asked.toArrow()
        for at in range(0, max(1, len(own)), SLICE):
            by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in own.slice(at, SLICE).combine_chunks().to_batches():
                for ids, m in _matrices(batch, scale):
                    by[m.shape[1]] = (ids, m) if m.shape[1] not in by else tuple(np.concatenate(x) for x in zip(by[m.shape[1]], (ids, m)))
            shared = spark.sparkContext.broadcast(by)
            path = scratch_path(spark, "topk-part")
            index.mapInArrow(_searched(shared, k), "query_id long, vec_id long, score long").write.parquet(path)
            shared.unpersist()
            parts.append(path)
    from pyspark.sql import Window

    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    held = F.when(F.abs("score") < TOP, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))


def oracle_sql(k: int = 10) -> str:
    """The query's rows in DuckDB SQL."""
    return (
        "with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as z from embeddings where embedding is not null and len(embedding) > 0"
        " and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),"
        " s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.z::double[], c.z::double[])::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)"
        f" select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= {k}"
    )
