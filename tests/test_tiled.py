"""Flood, thinning and top-down cells by tiles and levels against the kernels of a whole volume; faults of single datasets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import kernels as K
from voxelmill.operators import stencil as S
from voxelmill.operators import tiled as D
from voxelmill.plans.queries import QUERIES
from voxelmill.plans.segmentation import Parameters, segment


def volume(spark, a, labels, there):
    rows = [("a", *map(int, p), float(a[tuple(p)]), int(labels[tuple(p)])) for p in np.argwhere(there)]
    return spark.createDataFrame(rows, "dataset_id string, z int, y int, x int, c0 double, label int")


@pytest.mark.parametrize("ties", [False, True])
def test_flood_in_tiles_equals_the_queue(spark, monkeypatch, ties):
    monkeypatch.setattr(S, "TILE", 4)
    rng = np.random.default_rng(4)
    shape = (5, 13, 11)
    a = rng.integers(0, 6, shape).astype(float) if ties else rng.permutation(np.prod(shape)).reshape(shape).astype(float)
    labels, there = np.where(rng.random(shape) < 0.02, rng.integers(1, 6, shape), 0), rng.random(shape) < 0.8
    a[0, 0, 0] = np.nan
    labels[~there] = 0
    vox = volume(spark, a, labels, there)
    got = {(r.z, r.y, r.x): r.label for r in D.watershed(vox).collect()}
    f = np.where(np.isnan(a), a[there & ~np.isnan(a)].max(), a)
    # ties go by place: ranks of (feature, place) are distinct
    rank = np.empty(f.size)
    rank[np.lexsort((np.arange(f.size), f.ravel()))] = np.arange(f.size)
    want = K.priority_flood(rank.reshape(shape), labels.astype(np.int32), there)
    assert got == {tuple(map(int, p)): int(want[tuple(p)]) for p in np.argwhere(there)}
    assert D.watershed(vox.limit(0)).count() == 0
    assert {r.label for r in D.watershed(vox.withColumn("label", F.lit(0))).collect()} == {0}


def test_flood_query(spark, sf):
    vox = QUERIES["watershed_tiles"](spark, sf)
    rows = QUERIES["percentile_normalise"](spark, sf)  # the same places
    assert vox.count() == rows.count() and vox.filter("label > 0").count() > 0


def test_thinning_in_tiles_equals_a_plane(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    monkeypatch.setattr(D, "HALO", 4)
    rng = np.random.default_rng(5)
    img = np.zeros((2, 45, 38), bool)
    img[0, 3:40, 4:30] = True
    img[0, 10:14, 8:12] = False
    img[1] = rng.random((45, 38)) < 0.7
    vox = spark.createDataFrame([(*map(int, p), bool(img[tuple(p)])) for p in np.indices(img.shape).reshape(3, -1).T], "z int, y int, x int, over boolean")
    got = {(r.z, r.y, r.x) for r in D.thin(vox).collect()}
    assert got == {(z, int(y), int(x)) for z in range(2) for y, x in np.argwhere(K.thin(img[z]))}
    assert D.thin(vox.filter("not over")).count() == 0


def test_top_down_by_levels_equals_one_task(spark):
    rng = np.random.default_rng(7)
    rows = []
    for d in "ab":
        for y in range(12):
            for x in range(12):
                c = (float(rng.normal(0, 1 + (x > 5))), float(rng.normal()))
                for level, label in ((2, y // 6 + 1), (1, (y // 4) * 3 + x // 4 + 1), (0, (y // 2) * 6 + x // 2)):
                    rows.append((d, level, 0, y, x, label, *c))
    levels = spark.createDataFrame(rows, "dataset_id string, level int, z int, y int, x int, label int, c0 double, c1 double")
    for threshold, share in ((2.6, 0.1), (3.4, 0.6), (9.0, 1.1), (0.0, 0.1)):
        want = {tuple(r) for r in K.top_down(levels, threshold, share).collect()}
        assert {tuple(r) for r in D.top_down(levels, threshold, share).select("dataset_id", "z", "y", "x", "label").collect()} == want


def test_a_fault_stays_with_its_dataset(spark):
    rng = np.random.default_rng(8)
    plane = lambda d: [(d, 0, y, x, float(y > 5) + rng.normal(0, 1e-3), float(x > 5) + rng.normal(0, 1e-3)) for y in range(12) for x in range(12)]
    rows = plane("good") + plane("other") + plane("twice") + [("twice", 0, 3, 3, 0.5, 0.5)] + [("negative", 0, y - 1, x, float(y), float(x)) for y in range(5) for x in range(5)] + [("flat", 0, 0, k, 1.0, 1.0) for k in range(4)]
    vox = spark.createDataFrame(rows, "dataset_id string, z int, y int, x int, c0 double, c1 double")
    registry = spark.createDataFrame([("good", 1.0), ("twice", 2.0), ("negative", 3.0), ("flat", 4.0), ("absent", 5.0)], "dataset_id string, strain double")
    p = Parameters(local_threshold=0.1, tolerance=0.45, min_size=5, kam_size=(1, 3, 3))
    found = segment(vox, p, registry)
    assert {tuple(r) for r in found.failures.collect()} == {("twice", "ValueError('a voxel is given twice')"), ("negative", "ValueError('a coordinate is negative')"), ("flat", "a channel has no spread"), ("absent", "missing")}
    summary = found.summary.collect()
    assert [(r.dataset_id, r.strain, r.valid_voxels, r.n_cells) for r in summary] == [("good", 1.0, 144, 4)] and summary[0].n_markers == 4
    alone = segment(vox.filter("dataset_id = 'good'"), p)
    near = lambda s: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in s.cells.collect())
    assert near(alone) == near(found)


def test_sampled_seeds_are_filled_in_one_stage(spark):
    rng = np.random.default_rng(42)
    rows = [(d, z, y, x, float(y > 7) + rng.normal(0, 1e-3), float(x > 7) + rng.normal(0, 1e-3)) for d in "ab" for z in range(3) for y in range(16) for x in range(16)]
    vox = spark.createDataFrame(rows, "dataset_id string, z int, y int, x int, c0 double, c1 double")
    found = segment(vox, Parameters(local_threshold=0.1, tolerance=0.85, min_size=50, kam_size=(1, 3, 3), seeds=300))
    summary = {r.dataset_id: r for r in found.summary.collect()}
    assert set(summary) == {"a", "b"} and all(r.n_markers >= 4 and r.coverage == 1.0 and r.n_cells == 4 for r in summary.values())
    labels = {}
    for r in found.voxels.collect():
        labels.setdefault((r.dataset_id, r.y > 7, r.x > 7), []).append(r.label)
    main = {q: max(set(v), key=v.count) for q, v in labels.items()}
    assert all(v.count(main[q]) > 0.9 * len(v) for q, v in labels.items()) and len({main[q] for q in main if q[0] == "a"}) == 4
    # one seed of each dataset gives at most one marker
    alone = segment(vox, Parameters(local_threshold=0.1, tolerance=0.85, min_size=1, kam_size=(1, 3, 3), seeds=1)).summary.collect()
    assert [r.n_markers for r in alone] == [1, 1]


def test_flood_through_levels_of_tiles(spark, monkeypatch):
    """Two tiles a side make a group, so heights go up and down through several levels; jobs don't grow with the tiles that a way crosses."""
    monkeypatch.setattr(S, "TILE", 3)
    monkeypatch.setattr(D, "FAN", 2)
    written, inner = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: (written.append(name), inner(df, name))[1])
    rng = np.random.default_rng(6)
    shape = (40, 4, 4)
    a, labels = rng.permutation(np.prod(shape)).reshape(shape).astype(float), np.zeros(shape, int)
    labels[0, 0, 0], labels[3, 2, 2] = 1, 2
    got = {(r.z, r.y, r.x): r.label for r in D.watershed(volume(spark, a, labels, np.ones(shape, bool))).collect()}
    want = K.priority_flood(a, labels.astype(np.int32), np.ones(shape, bool))
    assert got == {tuple(map(int, p)): int(want[tuple(p)]) for p in np.argwhere(want >= 0)}
    assert written.count("pass-edges") == 4 and written.count("pass-heights") == 4
