"""Surfaces of cells: welded vertices, edges, smoothing and colours, all as tables keyed by label and corner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.operators.kernels import surface_faces
from voxelmill.operators.stencil import COORDS
from voxelmill.session import materialize

VERTEX = ["label", "vz", "vy", "vx"]
#: A quad's corners along its two own axes, in turn around it.
TURN = [(0, 0), (0, 1), (1, 1), (1, 0)]


def quads(vox: DataFrame, min_voxels: int = 1) -> DataFrame:
    """``label, axis, side, corners``: the four corners (``vz, vy, vx``, whole steps) of each bare voxel face, seen from outside
    against the clock. Faces of one label share their corners; every edge belongs to two faces (four where voxels meet at an edge alone)."""
    faces = surface_faces(vox, min_voxels=min_voxels)
    corner = {a: [F.struct(*((F.col(f"p{c}") + (0 if c == a else o[[b for b in COORDS if b != a].index(c)])).cast("int").alias(f"v{c}") for c in COORDS)) for o in TURN] for a in COORDS}
    # z, y, x is a left-handed order of axes for one axis out of three, as for sides below
    flip = {"z": 1, "y": -1, "x": 1}
    around = lambda a: F.when(F.col("side") * flip[a] > 0, F.array(*corner[a])).otherwise(F.array(*corner[a][::-1]))
    return faces.select("label", "axis", "side", F.when(F.col("axis") == "z", around("z")).when(F.col("axis") == "y", around("y")).otherwise(around("x")).alias("corners"))


def vertices(faces: DataFrame) -> DataFrame:
    """Every corner of a label once: ``label, vz, vy, vx``."""
    return faces.select("label", F.explode("corners").alias("v")).select("label", "v.*").distinct()


def edges(faces: DataFrame) -> DataFrame:
    """Every undirected edge of a label once, with the number of faces that it borders: ``label, a, b, faces``."""
    ends = F.explode(F.array(*(F.struct(F.least(F.col("corners")[k], F.col("corners")[(k + 1) % 4]).alias("a"), F.greatest(F.col("corners")[k], F.col("corners")[(k + 1) % 4]).alias("b")) for k in range(4)))).alias("e")
    return faces.select("label", ends).select("label", "e.a", "e.b").groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("faces"))


def smooth(faces: DataFrame, method: str = "none", iterations: int = 30, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), strength: float = 0.5, back: float = -0.53) -> DataFrame:
    """``label, vz, vy, vx, pz, py, px``: the corners with their places in physical units, smoothed over the edge graph.

    ``laplacian`` takes the mean of a vertex and its neighbours; ``taubin`` moves it by ``strength`` towards its neighbours' mean
    and then by ``back`` (away), which keeps volumes. A step is one join of the edges with the places and one aggregate; steps are written."""
    if method not in ("none", "laplacian", "taubin"):
        raise ValueError(f"no smoothing {method}")
    place = vertices(faces).withColumns({f"p{c}": F.col(f"v{c}") * F.lit(float(s)) for c, s in zip(COORDS, spacing)})
    if method == "none" or not iterations:
        return place
    place, links = materialize(place, "mesh-places"), edges(faces)
    side = lambda s, o: links.select("label", *(F.col(f"{s}.v{c}").alias(f"v{c}") for c in COORDS), *(F.col(f"{o}.v{c}").alias(f"n{c}") for c in COORDS))
    both = materialize(side("a", "b").unionByName(side("b", "a")), "mesh-links")
    for k in range(iterations * (2 if method == "taubin" else 1)):
        near = both.join(place.select("label", *(F.col(f"v{c}").alias(f"n{c}") for c in COORDS), *(F.col(f"p{c}").alias(f"q{c}") for c in COORDS)), ["label", *(f"n{c}" for c in COORDS)])
        near = near.groupBy(*VERTEX).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"q{c}").alias(f"q{c}") for c in COORDS))
        own = place.join(near, VERTEX)
        if method == "laplacian":
            moved = {f"p{c}": (F.col(f"p{c}") + F.col(f"q{c}")) / (F.col("n") + 1) for c in COORDS}
        else:
            by = strength if k % 2 == 0 else back
            moved = {f"p{c}": F.col(f"p{c}") + by * (F.col(f"q{c}") / F.col("n") - F.col(f"p{c}")) for c in COORDS}
        place = materialize(own.withColumns(moved).select(*VERTEX, *(f"p{c}" for c in COORDS)), "mesh-places")
    return place


def colours(vox: DataFrame, rgb: tuple[str, str, str]) -> DataFrame:
    """Each label's mean colour, NaN left out, held within 0 and 1: ``label, r, g, b``."""
    mean = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None)))))
    return vox.filter("label > 0").groupBy("label").agg(*(mean(c).alias(n) for c, n in zip(rgb, "rgb")))


def placed_quads(faces: DataFrame, places: DataFrame) -> DataFrame:
    """Faces with the places of their corners (``x0, y0, z0`` to ``x3, y3, z3``), as ``write_vtp`` takes them."""
    own = faces.withColumn("face", F.struct("axis", "side", "corners"))
    long = own.select("label", "face", F.posexplode("corners").alias("k", "v")).select("label", "face", "k", "v.*").join(places, VERTEX)
    at = F.map_from_entries(F.collect_list(F.struct("k", F.struct("px", "py", "pz").alias("p"))))
    return long.groupBy("label", "face").agg(at.alias("p")).select("label", *(F.col("p")[k][f"p{c}"].alias(f"{c}{k}") for k in range(4) for c in "xyz"))
