"""Layer stacks, readers, chi fits and registration features against plain numbers."""

import math

import numpy as np
import pytest

from voxelmill.operators import filters as L
from voxelmill.operators import regions as R
from voxelmill.operators import tracking as T
from voxelmill.plans.queries import BALL_BOX, QUERIES
from voxelmill.sources import lattice


def test_layers_of_one_shape_stack(spark):
    rows = [(k, y, x, float(k)) for k in (7, 2, 11) for y in range(3) for x in range(4)]
    vox = spark.createDataFrame(rows, "layer int, y int, x int, c0 double")
    assert {(r.layer, r.z) for r in T.stack_layers(vox).select("layer", "z").distinct().collect()} == {(2, 0), (7, 1), (11, 2)}
    with pytest.raises(ValueError, match="layer 11"):
        T.stack_layers(vox.filter("layer <> 11 or x < 3"))
    assert T.stack_layers(vox.limit(0)).count() == 0


def test_absent_layers_are_filled_in_all_columns(spark):
    vox = spark.createDataFrame([(3, 0, 0, 0, 1.5, 2.5, 4, True), (3, 0, 0, 1, None, 0.5, 5, False)], "layer int, z int, y int, x int, c0 double, c1 double, label int, mask boolean")
    got = {(r.layer, r.z, r.x): (r.c0, r.c1, r.label, r.mask) for r in T.expand_layers(vox, spark.createDataFrame([(3,), (1,), (1,)], "layer int")).collect()}
    assert got[3, 1, 0] == (1.5, 2.5, 4, True) and got[3, 1, 1] == (None, 0.5, 5, False)
    assert all(math.isnan(got[1, 0, x][0]) and math.isnan(got[1, 0, x][1]) and got[1, 0, x][2:] == (0, False) for x in (0, 1)) and len(got) == 4


def test_volumes_and_tables_come_back(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(2, 3, 4, 2))
    np.save(tmp_path / "run_1.npy", a)
    got = lattice.read_npy_volumes(spark, str(tmp_path / "*.npy")).collect()
    assert {(r.z, r.y, r.x): (r.c0, r.c1) for r in got} == {(z, y, x): tuple(a[z, y, x]) for z, y, x in np.ndindex(2, 3, 4)} and {r.dataset_id for r in got} == {"run_1"}
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "k int, s string, v double")
    for kind in ("csv", "json", "parquet"):
        lattice.write_table(df, str(tmp_path / kind), kind)
        schema = "k int, s string, v double"
        assert sorted(map(tuple, lattice.read_table(spark, str(tmp_path / kind), kind, schema).collect())) == sorted(map(tuple, df.collect()))


def test_chi_fit_finds_its_parameters_and_quantiles(spark):
    rng = np.random.default_rng(5)
    v = 0.7 * np.sqrt(rng.chisquare(3, 4000))
    df = spark.createDataFrame([(float(x),) for x in v] + [(-1.0,), (0.0,), (math.nan,), (math.inf,), (None,)], "v double")
    fit = R.fit_chi(df, "v")
    assert fit["n"] == 4000 and abs(fit["df"] - 3) < 0.2 and abs(fit["scale"] - 0.7) < 0.03

    def loss(k, s):
        return -np.mean((1 - k / 2) * math.log(2) - math.lgamma(k / 2) - math.log(s) + (k - 1) * np.log(v / s) - (v / s) ** 2 / 2)

    best = loss(fit["df"], fit["scale"])
    assert all(best <= loss(fit["df"] * a, fit["scale"] * b) for a in (0.99, 1, 1.01) for b in (0.99, 1, 1.01))
    rows = R.chi_quantiles(df, "v").orderBy("k").collect()
    assert len(rows) == 99 and all(abs(r.quantile - np.quantile(v, r.k / 100)) < 1e-9 and abs(r.quantile - r.fitted) < 0.12 and r.density > 0 for r in rows)
    few = R.chi_quantiles(df.limit(3), "v").collect()
    assert all(r.fitted is None and r.density is None for r in few)


def test_chi_fit_query(spark, sf):
    edges = R.neighbour_table(lattice.lattice_e(spark, sf)).toPandas()["misorientation"].to_numpy()
    got = QUERIES["chi_fit"](spark, sf).first()
    edges = edges[edges > 0]
    assert got.n == len(edges) and abs(got.scale**2 * got.df - np.mean(edges**2)) < 1e-4


def test_plain_features(spark):
    vox = spark.createDataFrame([(True, 2, 2.0), (True, 0, 4.0), (True, 0, math.nan), (False, 0, 9.0), (None, None, None)], "mask boolean, label int, c0 double")
    got = [[r.feature for r in L.plain_feature(vox, m).collect()] for m in ("mask", "label_binary", "channel0")]
    filled = np.array([2.0, 4.0, 4.0, 9.0, 4.0])  # missing values are the median of 2, 4 and 9
    z = (filled - filled.mean()) / (filled.std() + 1e-8)
    assert got[:2] == [[1, 1, 1, 0, 0], [1, 0, 0, 0, 0]] and np.allclose(got[2], [*z[:3], 0, 0])
    with pytest.raises(ValueError):
        L.plain_feature(vox, "other")


def test_a_ball_of_100_nm_is_flat():
    assert BALL_BOX == (1, 5, 5)
