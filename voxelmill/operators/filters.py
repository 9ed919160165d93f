"""Windows with mirrored borders, registration features, shift search and wall-based cells, in joins and aggregates."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.numbering import exact_quantiles, number_keys
from voxelmill.operators.regions import components, fit_chi, median_field, robust_zscore
from voxelmill.operators.stencil import COORDS, Arrays, boundaries, box, cross, extent, halved, neighbours, spread, windows
from voxelmill.session import checkpoint

Offset = tuple[int, int, int]


def mirrored(vox: DataFrame, pads: Offset, shape: Offset) -> DataFrame:
    """Voxels with their mirror images (edge included) up to ``pads`` steps outside the grid."""
    out = vox
    for c, pad, n in zip(COORDS, pads, shape):
        if not pad or not n:
            continue
        turns = range(-(pad // (2 * n)) - 1, pad // (2 * n) + 2)
        images = F.array(*(at + F.lit(2 * n * k) for k in turns for at in (F.col(c), -F.col(c) - 1)))
        out = out.withColumn(c, F.explode(images)).filter(F.col(c).between(-pad, n - 1 + pad))
    return out


def median_filter(vox: DataFrame, size: Offset, channels: tuple[str, ...] = ("c0", "c1")) -> DataFrame:
    """Each channel's median over a box of odd sizes, as ``median_<channel>``; borders are mirrored, absent voxels left out."""
    own, pads = vox.select(*COORDS, *(F.col(c).cast("double").alias(c) for c in channels)), tuple(s // 2 for s in size)

    def middle(_: Arrays, near: Arrays, there: np.ndarray) -> Arrays:
        out = {}
        for c in channels:
            n = (there & ~np.isnan(near[c])).sum(1)
            v = np.sort(np.where(there, near[c], np.nan), axis=1)  # NaN comes last
            pick = lambda k: np.take_along_axis(v, np.maximum(k, 0)[:, None], 1)[:, 0]
            out[f"median_{c}"] = np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)
        return out

    return windows(own, box(size, True), list(channels), middle, {f"median_{c}": "double" for c in channels}, mirrored(own, pads, extent(vox)))


def gaussian(vox: DataFrame, column: str, sigma: tuple[float, float, float] = (0.5, 1.0, 1.0), reach: float = 4.0) -> DataFrame:
    """``z, y, x, column`` smoothed axis by axis with normed weights up to ``reach`` deviations; borders are mirrored."""
    out, shape = vox.select(*COORDS, F.col(column).cast("double").alias(column)), extent(vox)
    for k, s in enumerate(sigma):
        r = int(reach * s + 0.5)
        if r < 1:
            continue
        raw = np.array([math.exp(-0.5 * (i / s) ** 2) for i in range(-r, r + 1)])
        weights = raw / raw.sum()
        along = [tuple(i if a == k else 0 for a in range(3)) for i in range(-r, r + 1)]
        pads = tuple(r if a == k else 0 for a in range(3))

        def blend(_: Arrays, near: Arrays, there: np.ndarray, weights: np.ndarray = weights) -> Arrays:
            return {column: np.where(there & ~np.isnan(near[column]), near[column], 0.0) @ weights}

        out = windows(out, along, [column], blend, {column: "double"}, mirrored(out, pads, shape))
    return out


def masked_zscore(vox: DataFrame, column: str) -> DataFrame:
    """``column`` as a clipped robust z-score of the voxels in ``mask``, 0 outside."""
    scored = robust_zscore(vox.withColumn("_in", F.when(F.col("mask"), F.col(column))), "_in")
    return scored.withColumn(column, F.when(F.col("mask"), F.coalesce("zscore", F.lit(0.0))).otherwise(0.0)).drop("_in", "zscore")


def contact_feature(vox: DataFrame) -> DataFrame:
    """``z, y, x, contact``: voxels at contacts of two cells (both sides, in the mask), smoothed, as a z-score."""
    both = halved() + [tuple(-v for v in o) for o in halved()]
    cells = vox.filter("mask and label > 0").select(*COORDS, "label")
    met = boundaries(cells, both).select(*COORDS).withColumn("contact", F.lit(1.0))
    marked = vox.select(*COORDS, "mask").join(met, COORDS, "left").fillna(0.0, ["contact"])
    # the scores' scalars are found by jobs of their own: what they read is written once
    smooth = checkpoint(gaussian(marked, "contact").join(marked.drop("contact"), COORDS))
    return masked_zscore(smooth, "contact").select(*COORDS, "contact")


def registration_feature(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), weight: float = 1.0, contact_weight: float = 0.35) -> DataFrame:
    """``vox`` with its cells' medians and a scalar ``feature``: magnitude of the medians' z-scores plus weighted contacts."""
    inside = vox.withColumn("label", F.when(F.col("mask"), F.col("label")).otherwise(0))
    painted = checkpoint(median_field(inside, channels))
    for c in channels:
        painted = masked_zscore(painted.withColumn(f"s_{c}", F.col(f"median_{c}")), f"s_{c}")
    painted = masked_zscore(painted.withColumn("size", F.sqrt(sum((F.col(f"s_{c}") ** 2 for c in channels), F.lit(0.0)))), "size")
    both = checkpoint(painted.join(contact_feature(vox), COORDS).withColumn("feature", weight * F.col("size") + contact_weight * F.col("contact")))
    return masked_zscore(both, "feature").drop("size", "contact", *(f"s_{c}" for c in channels))


def plain_feature(vox: DataFrame, mode: str) -> DataFrame:
    """``feature`` of one kind: ``mask`` or ``label_binary`` as 0 and 1, or a channel (``channel0``, ...) as plain z-scores of all
    voxels, whose missing and infinite values are the finite ones' median; 0 outside the mask."""
    if mode == "mask":
        value = F.col("mask").cast("double")
    elif mode == "label_binary":
        value = (F.col("label") > 0).cast("double")
    elif mode.startswith("channel"):
        c = f"c{int(mode[7:])}"
        fine = F.abs(F.col(c)) < float("inf")  # neither null, NaN nor infinite
        middle = exact_quantiles(vox.filter(fine), c, [0.5])[0]
        filled = F.when(fine, F.col(c)).otherwise(F.lit(middle)).cast("double")
        row = vox.agg(F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("dev")).first()
        value = F.when(F.col("mask"), (filled - F.lit(row["mean"])) / F.lit((row["dev"] or 0.0) + 1e-8)).otherwise(0.0)
    else:
        raise ValueError(f"no mode {mode}")
    return vox.withColumn("feature", F.coalesce(value, F.lit(0.0)))


def opened_walls(vox: DataFrame, percentile: float, erosions: int, dilations: int, value: str, near: list[Offset], outside: bool = False) -> DataFrame:
    """``z, y, x`` of the mask's voxels from the percentile of ``value`` in the mask on, eroded and dilated by ``near``.

    With ``outside`` what lies outside the grid doesn't erode."""
    shape = extent(vox)
    fine = vox.filter(F.col("mask") & F.col(value).isNotNull() & ~F.isnan(value))
    cut = exact_quantiles(fine, value, [percentile])[0]
    if cut is None:
        raise ValueError("no finite value in the mask")
    wall = fine.filter(F.col(value) >= cut).select(*COORDS)
    inside = (" and ".join(f"{c} + {v} between 0 and {n - 1}" for c, v, n in zip(COORDS, o, shape)) for o in near)
    need = sum((F.expr(f"({i})").cast("int") for i in inside), F.lit(0)) if outside else F.lit(len(near))

    def held(own: Arrays, at: Arrays, there: np.ndarray) -> Arrays:
        return {"held": there.sum(1)}

    for _ in range(erosions):
        wall = windows(wall, near, [], held, {"held": "long"}).filter(F.col("held") == need).select(*COORDS)
    if dilations:
        wall = spread(wall.withColumn("label", F.lit(1)), near, (0, 0, 0), tuple(n - 1 for n in shape), dilations).select(*COORDS)
    return wall


def wall_cells(vox: DataFrame, percentile: float = 0.7, erosions: int = 1, dilations: int = 1, min_size: int = 1, value: str = "kam") -> DataFrame:
    """Cells between walls: ``z, y, x, label`` of the 6-connected parts of the mask without the opened high-``value`` voxels.

    Outside the grid nothing is wall. Parts below ``min_size`` go; labels follow the parts' first voxels."""
    wall = opened_walls(vox, percentile, erosions, dilations, value, cross(3, True))
    free = vox.filter("mask").select(*COORDS).join(wall, COORDS, "left_anti").withColumn("label", F.lit(1))
    parts = components(free, [(0, 0, 1), (0, 1, 0), (1, 0, 0)])
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    ranks = number_keys(sizes.select("component"), "new")
    return parts.join(ranks, "component").select(*COORDS, F.col("new").alias("label"))


def sample_seeds(vox: DataFrame, n: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``n`` voxels of the mask (of each ``by``) without replacement, the first in the order of a hash of place and seed."""
    word = F.concat_ws("|", *COORDS, F.lit(seed))
    drawn = vox.filter("mask").select(*by, *COORDS, F.md5(word.cast("binary")).alias("draw"))
    if not by:
        return drawn.orderBy("draw").limit(n)
    # the limit on ranks is applied before the shuffle too
    return drawn.withColumn("seed_rank", F.row_number().over(Window.partitionBy(*by).orderBy("draw", *COORDS))).filter(F.col("seed_rank") <= n)


def region_summary(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: cells, voxels, median, mean and deviation of volumes, mean and median of neighbours' misorientations and
    their chi fit (null below ten)."""
    fit = fit_chi(edges, "misorientation")
    middle = [exact_quantiles(d, c, [0.5])[0] for d, c in ((cells, "volume_voxels"), (edges, "misorientation"))]
    held = lambda v: F.lit(None if v is None or math.isnan(v) else v).cast("double")
    b = edges.agg(F.avg("misorientation").alias("m")).first()["m"]
    a = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("volume_voxels").alias("valid_voxels"), F.avg("volume_voxels").alias("mean_volume"), F.stddev_pop("volume_voxels").alias("std_volume"))
    return a.select("n_cells", "valid_voxels", held(middle[0]).alias("median_volume"), "mean_volume", "std_volume", held(b).alias("mean_misorientation"), held(middle[1]).alias("median_misorientation"), held(fit["df"]).alias("chi_df"), held(fit["scale"]).alias("chi_scale"))


def selected_cells(vox: DataFrame, n: int) -> DataFrame:
    """Voxels of the n largest cells (ties to the smaller label), the k-th chosen renamed k."""
    from voxelmill.operators.regions import top_cells

    chosen = top_cells(vox.filter("label > 0"), n).select("label", F.row_number().over(Window.orderBy(F.desc("size"), "label")).alias("k"))
    return vox.join(F.broadcast(chosen), "label").select(*COORDS, "k")  # n rows
