import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import meshes as M
from voxelmill.sources import files


def test_planes_of_npy_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.random((7, 4, 5, 2)), rng.random((3, 2, 3, 2)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    vox = files.read_npy_planes(spark, str(tmp_path), 2, 2)
    assert vox.rdd.getNumPartitions() == 4 + 2
    got = {(r.dataset_id, r.z, r.y, r.x): (r.c0, r.c1) for r in vox.collect()}
    assert len(got) == a.size // 2 + b.size // 2
    assert all(got[n, *p] == tuple(map(float, v[p])) for n, v in (("a", a), ("b", b)) for p in np.ndindex(v.shape[:3]))
    # only the wanted planes' bytes are read: a file cut after its second plane still gives these
    os.truncate(tmp_path / "a.npy", 128 + 2 * a[0].nbytes)
    for wanted, planes in (("z < 2", {0, 1}), ("z = 1", {1}), ("z >= 0 and z <= 1", {0, 1}), ("z in (0, 1)", {0, 1})):
        assert {r.z for r in vox.filter(wanted).filter("dataset_id = 'a'").collect()} == planes
    with pytest.raises(Exception, match="ends within plane 2"):
        vox.collect()
    np.save(tmp_path / "b.npy", np.asfortranarray(b))
    with pytest.raises(Exception, match="C-ordered"):
        files.read_npy_planes(spark, str(tmp_path / "b.npy"), 2).collect()


def test_image_pieces_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    there = np.argwhere(rng.random((6, 3, 4)) < 0.9).tolist()
    rows = [(*p, float(rng.normal()), int(rng.integers(9))) for p in there] + [(5, 2, 3, 1e-300, 7)] * ([5, 2, 3] not in there)
    vox = spark.createDataFrame(rows, "z int, y int, x int, kam double, label int")
    path = f"file://{tmp_path}/image"
    files.write_vti(vox, path, (6, 3, 4), ["kam", "label"], (400.0, 50.0, 50.0), 3)
    assert len([f for f in os.listdir(tmp_path / "image") if f.endswith(".vti")]) == 3 and not [f for f in os.listdir(tmp_path / "image") if f.startswith("_")]
    back = {(r.z, r.y, r.x): (r.kam, r.label) for r in files.read_vti(spark, path).collect() if not np.isnan(r.kam)}
    assert back == {(z, y, x): (k, float(n)) for z, y, x, k, n in rows}
    index = (tmp_path / "image" / "index.pvti").read_text()
    assert 'WholeExtent="0 3 0 2 0 5"' in index and 'Spacing="50.0 50.0 400.0"' in index
    # a second run takes the place of the first, a failed one leaves it alone
    files.write_vti(vox.filter("z < 2"), path, (6, 3, 4), ["kam", "label"], pieces=1)
    assert {r.z for r in files.read_vti(spark, path).collect()} == {0, 1}
    before = sorted(os.listdir(tmp_path / "image"))
    bad = vox.withColumn("kam", F.when(F.col("z") == 3, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("kam")))
    with pytest.raises(Exception, match="boom"):
        files.write_vti(bad, path, (6, 3, 4), ["kam", "label"], pieces=3)
    assert sorted(os.listdir(tmp_path / "image")) == before


def test_a_closed_surface_smoothed_and_written(spark, tmp_path):
    rows = [(z, y, x, 1 if x < 2 else 2, 0.2, 1.7, -3.0) for z in range(2) for y in range(3) for x in range(4)]
    vox = spark.createDataFrame(rows, "z int, y int, x int, label int, r double, g double, b double")
    faces = M.quads(vox)
    assert faces.count() == 2 * 2 * (2 * 3 + 2 * 2 + 3 * 2)
    assert {r.faces for r in M.edges(faces).collect()} == {2}
    # outward order: the boxes' volumes by their faces' signed shares
    volume = 0.0
    for f in faces.collect():
        v = np.array([(c.vx, c.vy, c.vz) for c in f.corners], float)
        volume += sum(np.dot(v[0], np.cross(v[k], v[k + 1])) for k in (1, 2)) / 6
    assert abs(volume - len(rows)) < 1e-9
    links, start = {}, {}
    for e in M.edges(faces).collect():
        for p, q in ((e.a, e.b), (e.b, e.a)):
            links.setdefault((e.label, *p), []).append((e.label, *q))
    start = {k: np.array(k[1:], float) * (4, 2, 1) for k in links}
    for method in ("laplacian", "taubin"):
        want = dict(start)
        for k in range(2 * (1 + (method == "taubin"))):
            mean = {v: np.mean([want[n] for n in links[v]], 0) for v in want}
            want = {v: (p + mean[v] * len(links[v])) / (1 + len(links[v])) if method == "laplacian" else p + (0.5, -0.53)[k % 2] * (mean[v] - p) for v, p in want.items()}
        got = {(r.label, r.vz, r.vy, r.vx): (r.pz, r.py, r.px) for r in M.smooth(faces, method, 2, (4.0, 2.0, 1.0)).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[v], want[v]) for v in want)
    assert {tuple(round(v, 9) for v in r) for r in M.colours(vox, ("r", "g", "b")).collect()} == {(1, 0.2, 1.0, 0.0), (2, 0.2, 1.0, 0.0)}
    with pytest.raises(ValueError):
        M.smooth(faces, "other")
    placed = M.placed_quads(faces, M.smooth(faces, "none")).join(M.colours(vox, ("r", "g", "b")), "label").repartition(2)
    files.write_vtp(placed, f"file://{tmp_path}/mesh")
    names = os.listdir(tmp_path / "mesh")
    texts = [(tmp_path / "mesh" / n).read_text() for n in names if n.endswith(".vtp")]
    assert "index.pvtp" in names and sum(int(t.split('NumberOfPolys="')[1].split('"')[0]) for t in texts) == faces.count()
