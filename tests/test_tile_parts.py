"""Connected parts are joined inside tiles; only links between tiles go through the rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import regions as R
from voxelmill.operators import stencil as S
from voxelmill.sources.lattice import lattice_v


@pytest.mark.parametrize("tile", [4, 32])
def test_parts_of_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rounds = []
    inner = R.connected_components
    monkeypatch.setattr(R, "connected_components", lambda edges: (rounds.append(edges.count()), inner(edges))[1])
    rng = np.random.default_rng(1)
    shape = (6, 11, 9)
    label = rng.integers(0, 3, shape)
    vox = spark.createDataFrame([(*map(int, p), int(label[tuple(p)])) for p in np.indices(shape).reshape(3, -1).T], "z int, y int, x int, label int")
    got = {(r.z, r.y, r.x): r.component for r in R.components(vox).collect()}
    lin, want = np.arange(label.size).reshape(shape), {}
    for p in map(tuple, np.argwhere(label > 0)):
        if p in want:
            continue
        want[p], stack = int(lin[p]), [p]
        while stack:
            at = stack.pop()
            for o in S.halved():
                for s in (1, -1):
                    to = tuple(a + s * d for a, d in zip(at, o))
                    if all(0 <= c < n for c, n in zip(to, shape)) and label[to] == label[at] and to not in want:
                        want[to] = want[p]
                        stack.append(to)
    assert got == {tuple(map(int, k)): v for k, v in want.items()}
    assert rounds[0] == 0 if tile == 32 else 0 < rounds[0] < 3 * label.size


def test_the_clock_has_a_fraction(spark, sf):
    c1 = lattice_v(spark, sf, clock=True).agg(F.max(F.abs(F.col("c1") - F.floor("c1"))).alias("m"), F.countDistinct("c1").alias("n")).first()
    assert c1["m"] > 0.5 and c1["n"] > 100


def test_queue_over_a_frame():
    """The flood by a queue at the faces of a volume, with places outside the mask and equal heights."""
    from voxelmill.operators import kernels as K

    height, markers = np.zeros((1, 3, 4)), np.zeros((1, 3, 4), np.int32)
    markers[0, 0, 0], markers[0, 2, 3] = 1, 2
    mask = np.ones(height.shape, bool)
    mask[0, 1, 1:3] = False
    got = K.priority_flood(height, markers, mask)
    assert got.dtype == np.int32 and got[0].tolist() == [[1, 1, 1, 2], [1, 0, 0, 2], [1, 2, 2, 2]]
