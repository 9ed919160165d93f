import math

from voxelmill.operators import kernels as K

SCHEMA = "dataset_id string, z int, y int, x int, c0 double, c1 double, label int"


def test_regions_grow_to_the_nearer_mean(spark):
    rows = [(d, 0, y, x, float(x >= 6), 0.0, 1 if (y, x) == (0, 0) else 2 if (y, x) == (4, 9) else 0) for d in ("a", "b") for y in range(5) for x in range(10)]
    rows += [("b", 0, 5, 0, math.nan, 0.0, 0), ("c", 0, 0, 0, 0.0, 0.0, 0)]
    got = {(r.dataset_id, r.y, r.x): r.label for r in K.region_grow(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and got["b", 5, 0] == 1 and got["c", 0, 0] == 0  # NaN costs most but is reached; no markers, no labels
    assert all(label == (1 if x < 6 else 2) for (d, y, x), label in got.items() if (d, y) != ("b", 5) and d != "c")


def test_coarse_cells_come_first(spark):
    # level 1: x < 4 is flat and taken, x >= 4 is uneven and left; level 0 offers pairs of columns
    rows = [("a", level, 0, y, x, 0.0 if x < 6 else 5.0, 0.0, x // 4 + 1 if level else x // 2 + 1) for level in (0, 1) for y in range(5) for x in range(8)]
    levels = spark.createDataFrame(rows, "dataset_id string, level int, z int, y int, x int, c0 double, c1 double, label int")
    got = {(r.y, r.x): r.label for r in K.top_down(levels, 1.0).collect()}
    assert got == {(y, x): 1 if x < 4 else 2 if x < 6 else 3 for y in range(5) for x in range(8)}
