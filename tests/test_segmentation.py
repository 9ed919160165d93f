import math

import numpy as np
from pyspark.sql import functions as F

from voxelmill.operators import kernels as K
from voxelmill.operators.numbering import number_keys
from voxelmill.plans.segmentation import Parameters, segment

SCHEMA = "dataset_id string, z int, y int, x int, c0 double, c1 double, mask boolean"


def volume(name, shape=(3, 12, 12), cuts=(6, 6), seed=0):
    """Four quadrants of different channels with a little noise; one corner column is outside the mask."""
    rng, rows = np.random.default_rng(seed), []
    for z, y, x in np.indices(shape).reshape(3, -1).T.tolist():
        rows.append((name, z, y, x, float(y >= cuts[0]) + rng.normal(0, 1e-3), float(x >= cuts[1]) + rng.normal(0, 1e-3), bool(y + x)))
    return rows


def test_datasets_are_segmented_side_by_side(spark):
    rows = volume("a") + volume("b", (2, 10, 14), (4, 8), 1) + [("flat", 0, 0, k, 1.0, 2.0, True) for k in range(5)] + [("b", 5, 0, 0, None, 1.0, True), ("b", 5, 0, 1, math.nan, 1.0, None)]
    p = Parameters(local_threshold=0.1, tolerance=0.45, min_size=10, max_iterations=300)
    both = segment(spark.createDataFrame(rows, SCHEMA), p)
    cells = sorted((r.dataset_id, r.label, r.volume_voxels) for r in both.cells.collect())
    assert [c[:2] for c in cells] == [(d, k) for d in "ab" for k in (1, 2, 3, 4)]
    assert sum(v for d, _, v in cells if d == "a") == 3 * 143 and sum(v for d, _, v in cells if d == "b") == 2 * 139
    found = {}
    for r in both.voxels.collect():
        cut = (6, 6) if r.dataset_id == "a" else (4, 8)
        found.setdefault((r.dataset_id, r.y >= cut[0], r.x >= cut[1]), []).append(r.label)
    main = {q: max(set(v), key=v.count) for q, v in found.items()}
    assert all(v.count(main[q]) > 0.9 * len(v) for q, v in found.items())  # ties at borders go by age
    assert all(len({main[q] for q in main if q[0] == d}) == 4 for d in "ab")
    summary = {r.dataset_id: r for r in both.summary.collect()}
    assert set(summary) == {"a", "b"}  # a volume without spread can't be normalised
    assert summary["a"].coverage == 1 and summary["a"].n_cells == 4 and summary["a"].chi_df is None
    alone = segment(spark.createDataFrame(volume("b", (2, 10, 14), (4, 8), 1), SCHEMA), p)
    place = lambda s: sorted((r.z, r.y, r.x, r.label) for r in s.voxels.filter("dataset_id = 'b'").collect())
    assert place(alone) == place(both)
    edges = both.edges.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.min("misorientation").alias("m")).collect()
    assert {r.dataset_id for r in edges} == {"a", "b"} and all(4 <= r.n <= 6 and r.m > 0.9 for r in edges)


def test_no_voxels(spark):
    out = segment(spark.createDataFrame([], SCHEMA))
    assert out.cells.count() == out.edges.count() == out.summary.count() == 0


def test_numbers_follow_the_order_of_keys(spark):
    keys = [(k * 7919 % 1000 - 500, k % 3) for k in range(3000)] + [(5, 1)] * 4
    got = {(r.a, r.b): r.n for r in number_keys(spark.createDataFrame(keys, "a int, b int").repartition(7), "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)), 1)}
    assert number_keys(spark.createDataFrame([], "a int"), "n").count() == 0


def test_gaussian_variance_of_counts(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(3, 2, 20000)
    rows = [(1, float(x)) for x in v] + [(1, math.nan), (1, None), (1, math.inf)] + [(2, 1.0)] * 9 + [(3, float(k)) for k in range(5)] + [(4, None)]
    got = {r.label: r.gauss_var for r in K.gaussian_variance(spark.createDataFrame(rows, "label int, d double")).collect()}
    assert abs(got[1] - 4) < 0.4 and all(math.isnan(got[k]) for k in (2, 3, 4))
    y, edges = np.histogram(v, 50, density=True)
    x = (edges[1:] + edges[:-1]) / 2
    s = math.sqrt(got[1])
    loss = lambda p: ((y - p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))) ** 2).sum()
    # least squares over height and centre at this width, compared with widths beside it
    best = lambda w: min(loss((h, m, w)) for h in np.linspace(y.max() * 0.8, y.max() * 1.1, 41) for m in np.linspace(2.8, 3.2, 41))
    assert best(s) <= min(best(s * 0.97), best(s * 1.03))
