import numpy as np
import pytest

from voxelmill.operators import kernels as K
from voxelmill.plans.queries import QUERIES
from voxelmill.sources.lattice import lattice_v


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_skeleton_cells_equal_a_brute_force(spark, scale):
    sf = f"/root/testdata/{scale}"
    pdf = lattice_v(spark, sf).toPandas()
    shape = tuple(int(pdf[c].max()) + 1 for c in "zyx")
    cut = np.percentile(pdf.c0[pdf["mask"]], 29)
    over = np.zeros(shape, bool)
    over[pdf.z, pdf.y, pdf.x] = pdf["mask"] & (pdf.c0 >= cut)
    want = []
    for plane in over:
        arms = lambda a, border: [np.pad(a, 1, constant_values=border)[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
        walls = np.any(arms(np.all(arms(plane, True), 0), False), 0)
        free, seen = ~K.thin(walls), set()
        for at in map(tuple, np.argwhere(free)):
            if at in seen:
                continue
            stack, n = [at], 0
            seen.add(at)
            while stack:
                y, x = stack.pop()
                n += 1
                for to in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                    if 0 <= to[0] < shape[1] and 0 <= to[1] < shape[2] and free[to] and to not in seen:
                        seen.add(to)
                        stack.append(to)
            if 10 <= n <= 4000:
                want.append(n)
    assert sorted(r["size"] for r in QUERIES["skeleton_cells"](spark, sf).collect()) == sorted(want)
