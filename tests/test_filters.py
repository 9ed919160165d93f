import numpy as np
import pytest

from voxelmill.operators import filters as L
from voxelmill.operators import kernels as K
from voxelmill.operators import shifts as H


def table(spark, shape=(3, 7, 9), seed=3):
    rng = np.random.default_rng(seed)
    c, label, mask = rng.normal(0, 1, (*shape, 2)), rng.integers(0, 3, shape), rng.random(shape) < 0.9
    rows = [(*map(int, p), *map(float, c[tuple(p)]), int(label[tuple(p)]), bool(mask[tuple(p)])) for p in np.indices(shape).reshape(3, -1).T]
    return spark.createDataFrame(rows, "z int, y int, x int, c0 double, c1 double, label int, mask boolean"), c, label, mask


def test_gaussian_and_median_mirror_the_border(spark):
    vox, c, _, _ = table(spark)
    want = c[..., 0]
    for axis, s in enumerate((0.5, 1.0, 1.0)):
        r = int(4 * s + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        want = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, "symmetric"), w / w.sum(), "valid"), axis, want)
    for row in L.gaussian(vox, "c0").collect():
        assert abs(row.c0 - want[row.z, row.y, row.x]) < 1e-9
    wide = np.pad(c[..., 1], ((1, 1), (2, 2), (1, 1)), "symmetric")
    rows = L.median_filter(vox, (3, 5, 3)).collect()
    assert len(rows) == c[..., 0].size
    for r in rows:
        assert r.median_c1 == np.median(wide[r.z : r.z + 3, r.y : r.y + 5, r.x : r.x + 3])


def test_refine_shift_finds_a_known_shift(spark):
    _, c, _, _ = table(spark, (4, 12, 14))
    rows = lambda a: spark.createDataFrame([(*map(int, p), *map(float, a[tuple(p)]), True) for p in np.indices(a.shape[:3]).reshape(3, -1).T], "z int, y int, x int, c0 double, c1 double, mask boolean")
    ref, mov = rows(c), rows(np.roll(c, (0, -2, 1), (0, 1, 2)))
    out = H.refine_shift(ref, mov, (1, 2, 2), initial=spark.createDataFrame([(0, 1, 0)], "dz int, dy int, dx int"), feature="c0").collect()
    best = [(r.shift_z, r.shift_y, r.shift_x) for r in out if r.best]
    assert best == [(0, 2, -1)] and len(out) == 75
    got = {(r.shift_z, r.shift_y, r.shift_x): r for r in out}[(1, 0, 1)]
    moved = np.roll(c, (0, -2, 1), (0, 1, 2))
    a, b = c[1:, :, 1:].reshape(-1, 2), moved[:-1, :, :-1].reshape(-1, 2)
    want = np.corrcoef(a[:, 0], b[:, 0])[0, 1] - 0.75 * np.median(np.linalg.norm(a - b, axis=1)) + 0.25 * len(a) / c[..., 0].size
    assert got.n == len(a) and abs(got.score - want) < 1e-6
    assert H.refine_shift(ref, mov, (0, 0, 0), feature="c0", min_voxels=10_000).count() == 0
    assert H.refine_shift(ref.limit(0), mov, (0, 0, 0), feature="c0").count() == 0


def test_refine_shift_settles_a_volume_of_one_tile_in_it(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(t, z, y, x, float(rng.integers(9)), float("nan") if rng.random() < 0.05 else float(rng.normal()), bool(rng.random() < 0.9)) for t in range(3) for z in range(2) for y in range(9) for x in range(11 - t)]
    ref = spark.createDataFrame(rows, "t int, z int, y int, x int, c0 double, c1 double, mask boolean")
    mov = ref.withColumn("t", ref["t"] - 1)
    made, keep = {}, H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, name: made.setdefault(name, keep(df, name)))
    score = lambda **k: {tuple(r[:4]): r[4:] for r in H.refine_shift(ref, mov, (1, 1, 2), by=("t",), feature="c0", min_voxels=20, **k).collect()}
    one = score()
    # a row a trial leaves the tile, without counts of distances
    assert made["trial-moments"].count() == 2 * 45 and made["trial-moments"].filter("code is not null").count() == 0 and "trial-beginnings" not in made
    made.clear()
    many = score(tile=(1, 4, 4))
    assert made["trial-beginnings"].count() > 0
    assert one.keys() == many.keys() and len(one) == 2 * 45
    for k, a in one.items():
        assert a[0] == many[k][0] and a[2] == many[k][2] and a[4] == many[k][4] and np.allclose([a[1], a[3]], [many[k][1], many[k][3]], atol=1e-12)
    # volumes of one tile beside those of several: the third's box alone is small
    mixed = score(tile=(2, 9, 10))
    assert made and one.keys() == mixed.keys() and all(a[2] == mixed[k][2] and a[4] == mixed[k][4] for k, a in one.items())


def test_contacts_and_registration_feature(spark):
    vox, _, label, mask = table(spark)
    feature = {(r.z, r.y, r.x): r.feature for r in L.registration_feature(vox).collect()}
    assert len(feature) == label.size and all(feature[tuple(p)] == 0 for p in np.argwhere(~mask))
    assert max(map(abs, feature.values())) <= 5
    alone = L.contact_feature(vox.withColumn("label", L.F.lit(1))).collect()
    assert {r.contact for r in alone} == {0.0}


def test_registration_feature_by_arrays(spark):
    vox, c, label, mask = table(spark, (3, 8, 9), 11)
    label = np.where(mask, label, 0)

    def score(v):
        middle = np.median(v[mask])
        scale = 1.4826 * np.median(np.abs(v[mask] - middle)) or v[mask].std() or 1.0
        return np.where(mask, np.clip((v - middle) / scale, -5, 5), 0.0)

    painted = np.zeros_like(c)
    for k in (1, 2):
        painted[label == k] = np.median(c[label == k], axis=0)
    size = score(np.hypot(score(painted[..., 0]), score(painted[..., 1])))
    met = np.zeros(mask.shape)
    for p in np.argwhere(label > 0):
        for o in [(0, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)] + [(1, 0, 0), (-1, 0, 0)]:
            q = p + o
            if (q >= 0).all() and (q < mask.shape).all() and label[tuple(q)] not in (0, label[tuple(p)]):
                met[tuple(p)] = 1.0
    for k, s in enumerate((0.5, 1.0, 1.0)):
        r = int(4 * s + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        wide = np.pad(met, [(r, r) if a == k else (0, 0) for a in range(3)], mode="symmetric")
        met = sum(x * np.take(wide, range(i, i + mask.shape[k]), axis=k) for i, x in enumerate(w / w.sum()))
    want = score(size + 0.35 * score(met))
    got = L.registration_feature(vox).collect()
    assert len(got) == want.size and all(abs(r.feature - want[r.z, r.y, r.x]) < 1e-8 for r in got)


def test_walls_and_empty_masks(spark):
    vox, c, _, mask = table(spark)
    wall = mask & (c[..., 0] >= np.percentile(c[..., 0][mask], 80))
    want = np.argwhere(mask & ~wall)
    got = L.wall_cells(vox, 0.8, 0, 0, 1, "c0").collect()
    assert {(r.z, r.y, r.x) for r in got} == {tuple(map(int, p)) for p in want}
    by = {(r.z, r.y, r.x): r.label for r in got}
    assert sorted(set(by.values())) == list(range(1, max(by.values()) + 1))
    for (z, y, x), k in by.items():
        assert all(by.get(n, k) == k for n in ((z + 1, y, x), (z, y + 1, x), (z, y, x + 1)))
    with pytest.raises(ValueError):
        L.wall_cells(vox.withColumn("mask", L.F.lit(False)), 0.8, value="c0")


def test_template_peak():
    rng = np.random.default_rng(5)
    plane = rng.normal(0, 1, (9, 11))
    for h, w in ((3, 4), (4, 3), (9, 11)):
        piece = rng.normal(0, 1, (h, w))
        wide, best = np.pad(plane, ((h, h), (w, w))), -1.0
        for i in range(9):
            for j in range(11):
                y, x = i + 1 + (h - 1) // 2, j + 1 + (w - 1) // 2
                own = wide[y : y + h, x : x + w]
                best = max(best, np.corrcoef(own.ravel(), piece.ravel())[0, 1] if own.std() else 0.0)
        assert abs(K.template_peak(plane, piece) - best) < 1e-9
    assert abs(K.template_peak(plane, plane[2:6, 3:8]) - 1) < 1e-9


def test_a_tighter_cap_claims_no_more(spark, sf):
    from voxelmill.plans.queries import QUERIES

    rows = sorted(QUERIES["global_threshold_sweep"](spark, sf).collect(), key=lambda r: r.step)
    assert [r.cap for r in rows] == [-1.0, 30.0, 10.0] and rows[0].not_risen
    assert all(0 <= r.claimed_fraction <= 1 for r in rows)
