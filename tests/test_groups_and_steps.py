"""Quantiles of hot groups, assignment by parts, spreading in tiles, steps that are not consecutive, boxes and shifts by table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import kernels as K
from voxelmill.operators import regions as R
from voxelmill.operators import stencil as S
from voxelmill.operators import tracking as T
from voxelmill.operators.numbering import group_quantiles


def test_group_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(0 if rng.random() < 0.9 else rng.integers(1, 5)), float(rng.integers(0, 300) / 7), float(rng.normal())) for _ in range(4000)] + [(9, None, 1.0), (None, 2.0, None), (None, 4.0, None), (3, math.nan, 0.5)]
    df = spark.createDataFrame(rows, "label int, a double, b double").repartition(6)
    wants = {"a50": ("a", 0.5), "a95": ("a", 0.95), "b0": ("b", 0.0), "b31": ("b", 0.31), "b100": ("b", 1.0)}
    plain, ranged = ({r.label: r for r in group_quantiles(df, ["label"], wants, most).collect()} for most in (1_000_000, 0))
    assert set(plain) == set(ranged) == {0, 1, 2, 3, 4, 9, None}
    for label in plain:
        for n, (c, p) in wants.items():
            own = [r[1 + (c == "b")] for r in rows if r[0] == label and r[1 + (c == "b")] is not None]
            # NaN is the greatest
            want = None if not own else float(np.quantile(np.nan_to_num(own, nan=1e300), p)) if not any(map(math.isnan, own)) else None
            for got in (plain[label][n], ranged[label][n]):
                assert (got is None) if not own else want is None or abs(got - want) < 1e-9
    assert group_quantiles(df.limit(0), ["label"], wants, 0).count() == 0


def test_a_hot_group_is_split_over_ranges(spark):
    """No task numbers more than a share of a group with nine tenths of all values."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    key = F.struct("label").alias("_k")
    counted = df.select(key, F.lit(0).alias("_c"), F.col("v").alias("_v")).groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in counted.repartitionByRange(8, "_k", "_c", "_v").groupBy(F.spark_partition_id()).count().collect()]
        got = {r.label: r.q for r in group_quantiles(df, ["label"], {"q": ("v", 0.5)}, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 20_000 / 4
    v = np.arange(20_000) * 7919 % 20_011
    assert got == {0: np.median(v[np.arange(20_000) % 10 != 0]), 1: np.median(v[::10])}


def scan(rows):
    out, a, b = set(), set(), set()
    for _, la, lb in sorted((-s, la, lb) for _, la, lb, s in rows):
        if la not in a and lb not in b:
            a.add(la), b.add(lb), out.add((la, lb))
    return out


def test_assignment_of_a_long_chain_of_preferences(spark):
    """500 candidates, each of which depends on the one before it, end in a bounded number of jobs."""
    chain = [(0, k, k, 1000.0 - 2 * k) for k in range(250)] + [(0, k + 1, k, 999.0 - 2 * k) for k in range(250)]
    rng = np.random.default_rng(2)
    other = [(1, int(a), int(b), float(rng.random())) for a, b in {tuple(p) for p in rng.integers(0, 12, (60, 2)).tolist()}] + [(1, 50, 50, 0.5), (1, 51, 51, math.nan)]
    df = spark.createDataFrame(chain + other, "pair int, label_a int, label_b int, tracking_score double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {(r.pair, r.label_a, r.label_b) for r in T.greedy_assignment(df).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    assert jobs <= 6
    finite = [r for r in other if not math.isnan(r[3])]
    want = {(0, *p) for p in scan(chain)} | {(1, *p) for p in scan(finite)} | {(1, 51, 51)}
    assert got == want
    # by parts, and the greatest parts by rounds
    small = spark.createDataFrame(other, df.schema)
    for most in (40, 3):
        assert {(r.pair, r.label_a, r.label_b) for r in T.greedy_assignment(small, scan=most).collect()} == {w for w in want if w[0] == 1}
    assert T.greedy_assignment(df.limit(0)).count() == 0


def test_spreading_over_tiles_equals_a_dense_array(spark):
    rng = np.random.default_rng(6)
    shape = (3, 40, 70)
    seeds = [(int(rng.integers(3)), int(rng.integers(40)), int(rng.integers(70)), int(rng.integers(1, 4))) for _ in range(60)] + [(1, 31, 31, 7), (1, 32, 32, 7), (0, 0, 0, 2)]
    vox = spark.createDataFrame(seeds + [(2, 39, 69, 0)], "z int, y int, x int, label int")
    for footprint, iterations in ((S.box((1, 3, 3), True), 1), (S.cross(3, True), 2), ([(0, 2, 1), (0, 0, 0)], 3)):
        pads = [max(abs(o[k]) for o in footprint) for k in range(3)]
        now = {(k, z, y, x) for z, y, x, k in seeds}
        for _ in range(iterations):
            now = {(k, z + a, y + b, x + c) for k, z, y, x in now for a, b, c in footprint}
            now = {p for p in now if all(q <= v < n - q for v, n, q in zip(p[1:], shape, pads))}
        got = [tuple(r) for r in S.dilate(vox, footprint, iterations).collect()]
        assert len(got) == len(set(got)) and set(got) == now


def test_registering_steps_with_gaps(spark):
    rng = np.random.default_rng(3)
    a = rng.random((8, 9))
    moves = [(-2, 3), (0, 0), (1, -4)]
    for steps in ((0, 1, 2), (0, 10, 20), (-5, 7, 8)):
        rows = [(t, y, x, float(np.roll(a, m, (0, 1))[y, x])) for t, m in zip(steps, moves) for y in range(8) for x in range(9)]
        got = {r.t: (r.dy, r.dx) for r in K.register(spark.createDataFrame(rows, "t int, y int, x int, c0 double")).collect()}
        assert got == {t: (-m[0], -m[1]) for t, m in zip(steps, moves)}


def test_boxes_and_crops(spark):
    places = spark.createDataFrame([(1, 5, 6), (2, 7, 9)], "z int, y int, x int")
    assert tuple(T.bounding_box(places).first()) == (1, 2, 5, 7, 6, 9)
    assert tuple(T.bounding_box(places, 2, {"z": 3, "y": 9, "x": 20}).first()) == (0, 2, 3, 8, 4, 11)
    assert {tuple(r) for r in T.crop(places, T.bounding_box(places)).collect()} == {(0, 0, 0), (1, 2, 3)}
    with pytest.raises(Exception, match="empty mask"):
        T.bounding_box(places.limit(0)).collect()
    steps = spark.createDataFrame([(t, z, 0, 0, z != t) for t in (0, 5) for z in range(4)], "t int, z int, y int, x int, mask boolean")
    assert {tuple(r) for r in T.common_mask(steps).collect()} == {(1, 0, 0), (2, 0, 0), (3, 0, 0)}  # z = 5 is no place


def test_statistics_of_inner_parts(spark):
    rows = [(0, y, x, 1 if x < 5 else 2, float(y), float(x), 1.0 + x) for y in range(9) for x in range(10)]
    vox = spark.createDataFrame(rows, "z int, y int, x int, label int, c0 double, c1 double, kam double")
    got = {r.label: r for r in R.cell_statistics(vox, fit=True, wall=True).collect()}
    v = np.array([(y, x) for y in range(1, 8) for x in range(1, 4)], float)
    d = np.linalg.norm(v - v.mean(0), axis=1)
    assert np.allclose([got[1].mean_c0, got[1].mean_c1, got[1].variance, got[1].q], [*v.mean(0), d.var(), np.percentile(d, 95)])
    assert abs(got[1].wall_kam - np.mean([1.0 + x for x in (3, 4)])) < 1e-9  # grown by one, inside the cell's box and the border
    assert math.isfinite(got[1].fit_var) and R.cell_statistics(vox.filter("x < 2"), wall=True).count() == 0
