import math

import numpy as np
from pyspark.sql import functions as F

from voxelmill.operators import kernels as K
from voxelmill.operators import regions as R
from voxelmill.operators import tracking as T
from voxelmill.operators.numbering import exact_quantiles
from voxelmill.plans import segmentation


def test_an_accepted_cell_takes_claimed_voxels_too(spark):
    # level 1: one cell of 40 voxels; level 0: a cell of 33, three of them (under a tenth) claimed
    rows = [("a", 1, 0, 0, x, 0.0, 0.0, 1) for x in range(40)] + [("a", 0, 0, 0, x, 0.0, 0.0, 5) for x in range(37, 70)]
    levels = spark.createDataFrame(rows, "dataset_id string, level int, z int, y int, x int, c0 double, c1 double, label int")
    got = {r.x: r.label for r in K.top_down(levels, 1.0).collect()}
    assert got == {x: 1 if x < 37 else 2 for x in range(70)}


def test_phase_registration_of_planes_and_volumes(spark):
    rng = np.random.default_rng(1)
    plane, volume = rng.random((12, 15)), rng.random((4, 8, 9))
    # a strong smooth ramp hides the shift from a plain correlation, not from one that weighs frequencies alike
    moves = {0: (2, -3), 1: (0, 0), 2: (-1, 4)}
    rows = [(t, y, x, float(np.roll(plane, m, (0, 1))[y, x])) for t, m in moves.items() for y in range(12) for x in range(15)]
    got = {r.t: (r.dy, r.dx) for r in K.register(spark.createDataFrame(rows, "t int, y int, x int, c0 double")).collect()}
    assert got == {t: (-m[0], -m[1]) for t, m in moves.items()}
    moves = {0: (1, 2, -3), 1: (0, 0, 0), 2: (-1, 0, 4)}
    rows = [(t, z, y, x, float(np.roll(volume, m, (0, 1, 2))[z, y, x])) for t, m in moves.items() for z in range(4) for y in range(8) for x in range(9)]
    got = {r.t: (r.dz, r.dy, r.dx) for r in K.register(spark.createDataFrame(rows, "t int, z int, y int, x int, c0 double")).collect()}
    assert got == {t: tuple(-v for v in m) for t, m in moves.items()}
    ref, mov = rng.random((6, 7)) + np.arange(7) * 50, np.zeros((6, 7))
    mov[:] = np.roll(ref, (1, 2), (0, 1))
    product = np.fft.fft2(ref) * np.conj(np.fft.fft2(mov))
    cc = np.abs(np.fft.ifft2(product / np.maximum(np.abs(product), 2.2e-14)))
    peak = np.unravel_index(cc.argmax(), cc.shape)
    assert K.phase_shift(ref, mov) == tuple(int(p) if p <= n // 2 else int(p) - n for p, n in zip(peak, cc.shape)) == (-1, -2)


def test_tracking_of_volumes_with_a_mask(spark):
    rows = [(t, z, 0, x, 1 + (z > 4), 0.0, 0.0, x > 0) for t in (0, 1) for z in range(10) for x in range(4)]
    steps = spark.createDataFrame(rows, "t int, z int, y int, x int, label int, c0 double, c1 double, mask boolean")
    over = {(r.label_a, r.label_b): r.overlap_voxels for r in T.step_overlaps(steps).collect()}
    assert over == {(1, 1): 15, (2, 2): 15}
    near = {(r.label_a, r.label_b): r.centroid_distance for r in T.centroid_pairs(T.step_features(steps), 6.0).collect()}
    assert near == {(1, 1): 0.0, (2, 2): 0.0, (1, 2): 5.0, (2, 1): 5.0}  # their centroids differ in z alone
    assert {(r.label_a, r.label_b) for r in T.centroid_pairs(T.step_features(steps), 4.0).collect()} == {(1, 1), (2, 2)}
    pairs = T.candidates(steps, 6.0)
    assert {(r.label_a, r.label_b): r.centroid_distance for r in pairs.collect()} == near


def test_events_carry_their_counts(spark):
    cells = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (0, 9), (1, 8)], "t int, label int").withColumns({"y": F.lit(0), "x": F.lit(0)})
    pairs = spark.createDataFrame([(0, 1, 1, 5.0), (0, 1, 2, 4.0), (0, 2, 2, 3.0)], "pair int, label_a int, label_b int, tracking_score double").withColumns({"frac_of_a": F.lit(1.0), "frac_of_b": F.lit(1.0), "centroid_distance": F.lit(0.0)})
    got = {(r.event, r.label_a, r.label_b, r.n_children, r.n_parents) for r in T.classify_events(cells, pairs, T.greedy_assignment(pairs, 1.0), 1.0, 0.1, 1.0).collect()}
    assert got == {
        ("one_to_one", 1, 1, 2, 1), ("one_to_one", 2, 2, 1, 2), ("split_candidate", 1, None, 2, None), ("merge_candidate", None, 2, None, 2),
        ("death_candidate", 9, None, 0, None), ("birth_candidate", None, 3, None, 0), ("birth_candidate", None, 8, None, 0),
    }


def test_normalising_reads_finite_voxels_only(spark):
    rows = [(k, float(k), float(k)) for k in range(101)] + [(200, math.nan, 5000.0), (201, math.inf, 1.0), (202, None, 1.0)]
    out = {r.k: (r.c0, r.c1) for r in R.normalise(spark.createDataFrame(rows, "k int, c0 double, c1 double")).collect()}
    assert out[1] == (0.0, 0.0) and out[99] == (1.0, 1.0) and out[50] == (0.5, 0.5)
    assert out[200][0] == out[201][0] == out[202][0] == 0.0 and out[200][1] > 50


def test_datasets_that_fail_are_listed(spark):
    rows = [("a", 0, y, x, float(y), float(x), True) for y in range(6) for x in range(6)] + [("flat", 0, y, 0, 1.0, 1.0, True) for y in range(5)] + [("out", 0, 0, 0, 1.0, 1.0, False)]
    vox = spark.createDataFrame(rows, "dataset_id string, z int, y int, x int, c0 double, c1 double, mask boolean")
    found = segmentation.segment(vox, segmentation.Parameters(local_threshold=0.3, kam_size=(1, 3, 3)))
    assert {(r.dataset_id, r.error) for r in found.failures.collect()} == {("flat", "a channel has no spread"), ("out", "no voxel in the mask")}


def test_exact_quantiles_by_ranges_equal_the_aggregate(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.integers(0, 40, 500) / 7] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    probs = [0.0, 0.01, 0.29, 0.5, 0.95, 1.0]
    want = np.quantile([v for v in values if v is not None], probs)
    for most in (1_000_000, 0):
        assert np.allclose(exact_quantiles(df, "v", probs, most), want, atol=1e-12)
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    assert math.isnan(exact_quantiles(df.limit(3).selectExpr("double('nan') as v"), "v", [1.0], 0)[0])
