import numpy as np
import pytest

import __spark_entry__
from voxelmill.functions import chi_quantile
from voxelmill.operators import kernels as K
from voxelmill.operators import stencil as S
from voxelmill.plans.queries import ORACLE_SQL, QUERIES


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    got, cursor = QUERIES[name](spark, sf), duck(sf).execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    # plain rows: pandas would turn integers with nulls into floats on one side alone
    plain = lambda r: [None if v != v else v for _, v in sorted(r.items())]
    rows = sorted(repr(plain(r.asDict())) for r in got.collect())
    assert rows == sorted(repr(plain(dict(zip(names, r)))) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 9
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def bridge():
    v = np.concatenate([np.zeros(5), np.arange(1, 10) * 0.05, np.full(5, 0.5)])
    return v.reshape(1, 1, 19, 1), np.ones((1, 1, 19), bool), [(0, 0, -1), (0, 0, 0), (0, 0, 1)]


@pytest.mark.parametrize("cap,last", [(None, 1), (0.0, 1), (-1.0, 1), (0.15, 0)])
def test_a_global_cap_cuts_the_bridge(cap, last):
    field, mask, offs = bridge()
    labels, _ = K.flood(field, mask, offs, 0.1, cap, 0.6, 1, 1, seeds=[(0, 0, 0)])
    assert labels[0, 0, 0] == 1 and (labels[0, 0, -5:] == last).all()
    if cap == 0.15:
        assert (labels.ravel() > 0).tolist() == [True] * 8 + [False] * 11


def test_seeded_fill_repeats():
    field = np.random.default_rng(0).random((1, 16, 16, 1))
    mask = np.zeros((1, 16, 16), bool)
    mask[0, 1:-1, 1:-1] = True
    a = K.flood(field, mask, S.box((1, 3, 3), True), 0.2, None, 0.5, 200, 2, seed=42)
    b = K.flood(field, mask, S.box((1, 3, 3), True), 0.2, None, 0.5, 200, 2, seed=42)
    assert (a[0] == b[0]).all() and a[1] == b[1] and a[0].max() > 0


def quadrants():
    rng = np.random.default_rng(42)
    truth = np.zeros((6, 24, 24), int)
    field = np.zeros((6, 24, 24, 2))
    for k, (y, x, v) in enumerate([(0, 0, (0, 0)), (0, 12, (1, 0)), (12, 0, (0, 1)), (12, 12, (1, 1))]):
        truth[:, y : y + 12, x : x + 12] = k + 1
        field[:, y : y + 12, x : x + 12] = v
    mask = np.zeros(truth.shape, bool)
    mask[1:-1, 1:-1, 1:-1] = True
    return field + rng.normal(0, 1e-3, field.shape), truth, mask


def test_quadrants_fill_and_flood():
    field, truth, mask = quadrants()
    labels, found = K.flood(field, mask, S.box((3, 3, 3), True), 0.1, None, 0.85, 300, 50, seed=42)
    assert len(found) >= 4
    cost = np.linalg.norm(field - np.roll(field, 1, 2), axis=-1)
    full = K.priority_flood(cost, labels, mask)
    assert (full[mask] > 0).all()
    tops = set()
    for k in range(1, 5):
        own = np.bincount(full[mask & (truth == k)])
        assert own.max() > 0.9 * own.sum()
        tops.add(int(own.argmax()))
    assert len(tops) == 4


def test_kam_is_flat_inside_and_steep_between(spark):
    field, truth, _ = quadrants()
    at = np.indices(truth.shape).reshape(3, -1).T
    rows = [(*map(int, p), *map(float, field[tuple(p)])) for p in at]
    vox = spark.createDataFrame(rows, "z int, y int, x int, c0 double, c1 double")
    kam = {(r.z, r.y, r.x): r.kam for r in S.kam(vox).collect()}
    inner = [v for (z, y, x), v in kam.items() if 1 <= z <= 4 and 2 <= y <= 9 and 2 <= x <= 9]
    edge = [v for (z, y, x), v in kam.items() if 1 <= z <= 4 and 2 <= y <= 9 and x in (11, 12)]
    assert max(inner) < 0.05 and np.median(edge) > 10 * np.median(inner)
    assert kam[(0, 5, 5)] == 0.0
    with pytest.raises(ValueError):
        S.kam(vox, (2, 3, 3))


def test_phase_shift_and_skeleton():
    a = np.random.default_rng(1).random((20, 30))
    assert K.phase_shift(a, np.roll(a, (3, -4), (0, 1))) == (-3, 4)
    bar = np.zeros((11, 21), bool)
    bar[3:8, 2:19] = True
    s = K.thin(bar)
    assert 0 < s.sum() < 20 and (s <= bar).all()


def test_greedy_equals_the_scan(spark, sf):
    from voxelmill.operators import tracking as T
    from voxelmill.plans.queries import steps_e

    pairs = T.candidates(steps_e(spark, sf), 1.5)
    got = {(r.pair, r.label_a, r.label_b) for r in T.greedy_assignment(pairs).collect()}
    used, want = set(), set()
    for r in sorted(pairs.collect(), key=lambda r: (-r.tracking_score, r.label_a, r.label_b)):
        a, b = (r.pair, "a", r.label_a), (r.pair, "b", r.label_b)
        if a not in used and b not in used:
            used |= {a, b}
            want.add((r.pair, r.label_a, r.label_b))
    assert got == want


def test_layers_from_npy(spark, tmp_path):
    from voxelmill.sources.lattice import read_npy_layers

    for k in (7, 3):
        (tmp_path / f"layer_{k}").mkdir()
        np.save(tmp_path / f"layer_{k}" / "mean.npy", np.full((2, 3, 2), float(k)))
    rows = read_npy_layers(spark, f"{tmp_path}/layer_*/mean.npy").collect()
    assert {(r.z, r.layer, r.c0) for r in rows} == {(0, 3, 3.0), (1, 7, 7.0)} and len(rows) == 12


def test_chi_quantile():
    assert abs(chi_quantile(0.5, 2, 1) - np.sqrt(2 * np.log(2))) < 1e-9
