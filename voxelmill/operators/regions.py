"""Region statistics: sizes, cell tables, neighbour tables, fits, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import chi_pdf, chi_quantile
from voxelmill.operators.components import connected_components
from voxelmill.operators.numbering import exact_quantiles, greatest_group, group_quantiles, number_keys
from voxelmill.session import materialize
from voxelmill.operators.stencil import COORDS, contacts, extent, halved, neighbours, other_label, tile_parts, touching


def _median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def cell_sizes(vox: DataFrame, background: int = 0, pixel: tuple[float, ...] | None = None, min_size: float | None = None) -> DataFrame:
    """Voxels per label without the background, in units of a pixel's volume, above ``min_size``."""
    out = vox.filter(F.col("label") != background).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    if pixel:
        out = out.withColumn("size", F.col("size") * float(math.prod(p for p in pixel if not math.isnan(p))))
    return out.filter(F.col("size") > min_size) if min_size is not None else out


def top_cells(vox: DataFrame, n: int) -> DataFrame:
    """The n largest labels, ties to the smaller label."""
    return cell_sizes(vox).orderBy(F.desc("size"), "label").limit(n)


def coverage(vox: DataFrame) -> DataFrame:
    inside = F.sum(F.when(F.col("mask"), 1).otherwise(0))
    return vox.agg((F.sum(F.when(F.col("mask") & (F.col("label") > 0), 1).otherwise(0)) / F.greatest(inside, F.lit(1))).alias("coverage"))


def group_medians(values: DataFrame, keys: list[str], columns: tuple[str, ...], prefix: str = "median_") -> DataFrame:
    return group_quantiles(values, keys, {f"{prefix}{c}": (c, 0.5) for c in columns})


def cell_table(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), boxes: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per positive label: volume, median and mean of each channel, spread about the median; with ``boxes`` also
    centroid and bounding box. Rows with a non-finite channel count in the volume alone."""
    cells = vox.filter("label > 0")
    fine = F.lit(True)
    for c in channels:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cells = cells.withColumn("fine", F.coalesce(fine, F.lit(False)))
    own = lambda c: F.when(F.col("fine"), F.col(c))
    place = [f(c).alias(n + c) for n, f in (("c", F.avg), ("min_", F.min), ("max_", F.max)) for c in COORDS] if boxes else []
    key = [*by, "label"]
    counts = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("volume_voxels"), *(F.avg(own(c)).alias(f"mean_{c}") for c in channels), *place)
    most = greatest_group(cells.select(*key), key)
    middle = group_quantiles(cells.filter("fine").select(*key, *channels), key, {f"median_{c}": (c, 0.5) for c in channels}, most=most)
    if by:  # cells of many datasets: too many for a broadcast, whatever their compressed files seem to hold
        middle = middle.hint("merge")
    spread = F.sqrt(sum(((F.col(c) - F.col(f"median_{c}")) ** 2 for c in channels), F.lit(0.0)))
    apart = cells.filter("fine").select(*key, *channels).join(middle, key).select(*key, spread.alias("d"))
    mean = apart.groupBy(*key).agg(F.avg("d").alias("internal_spread_mean"))
    share = group_quantiles(apart, key, {"internal_spread_median": ("d", 0.5), "internal_spread_q95": ("d", 0.95)}, most=most)
    if by:
        mean, share = mean.hint("merge"), share.hint("merge")
    out = counts.join(middle, key, "left").join(mean, key, "left").join(share, key, "left")
    return out.select(*key, "volume_voxels", *(f"median_{c}" for c in channels), *(f"mean_{c}" for c in channels), *(n + c for n in ("c", "min_", "max_") for c in COORDS if boxes), "internal_spread_median", "internal_spread_mean", "internal_spread_q95")


def orientation_stats(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), q: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """Per label (and ``by``, e.g. a level): mean vector, variance and quantile of the distances to it."""
    key, apart = [*by, "label"], distances(vox, channels, by)
    spread = apart.groupBy(*key).agg(*(F.first(f"mean_{c}").alias(f"mean_{c}") for c in channels), F.var_pop("d").alias("variance"))
    return spread.join(group_quantiles(apart, key, {"q": ("d", q)}), key)


def distances(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), by: tuple[str, ...] = ()) -> DataFrame:
    """Labelled voxels with their cell's mean vector (``mean_<channel>``) and their distance ``d`` to it."""
    key, cells = [*by, "label"], vox.filter("label > 0")
    means = cells.groupBy(*key).agg(*(F.avg(c).alias(f"mean_{c}") for c in channels))
    return cells.join(means, key).withColumn("d", F.sqrt(sum(((F.col(c) - F.col(f"mean_{c}")) ** 2 for c in channels), F.lit(0.0))))


def cell_statistics(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), q: float = 0.95, fit: bool = False, wall: bool = False, erosions: int = 1) -> DataFrame:
    """One table per label: mean vector, variance and quantile ``q`` of the distances to it, ``fit_var`` (with ``fit``: the
    variance of a Gaussian fitted to their density) and, with ``wall``, ``wall_kam``.

    With ``wall`` the distances are those of the cell's eroded inner part (a cell without one is left out), and ``wall_kam``
    is the mean of ``kam`` over the cell's inner boundary grown as often, inside the cell's bounding box."""
    from voxelmill.operators.kernels import gaussian_variance
    from voxelmill.operators.stencil import boundaries, box, cross, dilate, erode

    inner = erode(vox.select(*COORDS, "label"), cross(2, True), erosions).join(vox.drop("label"), COORDS) if wall else vox
    inner = materialize(distances(inner, channels), "inner-distances")
    out = inner.groupBy("label").agg(*(F.first(f"mean_{c}").alias(f"mean_{c}") for c in channels), F.when(F.count(F.lit(1)) > 1, F.var_pop("d")).alias("variance"))
    out = out.join(group_quantiles(inner, ["label"], {"q": ("d", q)}), "label")
    if fit:
        out = out.join(gaussian_variance(inner.select("label", "d")).withColumnRenamed("gauss_var", "fit_var"), "label", "left")
    if wall:
        edges = vox.filter("label > 0").groupBy("label").agg(*(f(c).alias(n + c) for n, f in (("lo_", F.min), ("hi_", F.max)) for c in COORDS))
        grown = dilate(boundaries(vox), box((1, 3, 3), True), erosions).join(edges, "label")
        for c in COORDS:
            grown = grown.filter(F.col(c).between(F.col("lo_" + c), F.col("hi_" + c)))
        out = out.join(grown.join(vox.select(*COORDS, "kam"), COORDS).groupBy("label").agg(F.avg(F.nanvl("kam", F.lit(None))).alias("wall_kam")), "label", "left")
    return out


def quantile_cutoff(stats: DataFrame, q: float = 0.95) -> DataFrame:
    return stats.agg(F.percentile("q", F.lit(q)).alias("cutoff"))


def wall_kam(vox: DataFrame) -> DataFrame:
    """Mean of ``kam`` over each label's walls: its inner boundary grown by one voxel."""
    from voxelmill.operators.stencil import boundaries, box, dilate

    walls = dilate(boundaries(vox), box((1, 3, 3), True))
    return walls.join(vox.select(*COORDS, "kam"), COORDS).groupBy("label").agg(F.avg(F.nanvl("kam", F.lit(None))).alias("wall_kam"))


def median_field(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1")) -> DataFrame:
    """Every voxel with its cell's medians, 0 in the background."""
    med = group_medians(vox.filter("label > 0"), ["label"], channels)
    out = vox.join(med, "label", "left")
    return out.withColumns({f"median_{c}": F.coalesce(f"median_{c}", F.lit(0.0)) for c in channels})


def neighbour_table(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), by: tuple[str, ...] = ()) -> DataFrame:
    """Contacts with the distance of the cells' medians and signed differences (no wrap)."""
    med = group_medians(vox.filter("label > 0"), [*by, "label"], channels, "")
    if by:  # as in cell_table
        med = med.hint("merge")
    side = lambda s: med.select(*by, F.col("label").alias(f"label_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in channels))
    out = contacts(vox, by=by).join(side("a"), [*by, "label_a"]).join(side("b"), [*by, "label_b"])
    deltas = {f"delta_{c}": F.col(f"b_{c}") - F.col(f"a_{c}") for c in channels}
    return out.withColumns(deltas).withColumn("misorientation", F.sqrt(sum((F.col(d) ** 2 for d in deltas), F.lit(0.0)))).filter(~F.isnan("misorientation")).select(*by, "label_a", "label_b", "misorientation", *deltas)


def wrapped_misorientation(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1")) -> DataFrame:
    """Neighbour pairs ``other > label`` with differences wrapped at 360 degrees."""
    med = group_medians(vox.filter("label > 0"), ["label"], channels, "")
    pairs = touching(vox).filter("other > label")
    out = pairs.join(med.select("label", *(F.col(c).alias(f"a_{c}") for c in channels)), "label").join(med.select(F.col("label").alias("other"), *(F.col(c).alias(f"b_{c}") for c in channels)), "other")
    wrapped = [F.least(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), 360 - F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))) for c in channels]
    return out.select("label", "other", F.sqrt(sum((w**2 for w in wrapped), F.lit(0.0))).alias("misorientation"))


def neighbour_summary(edges: DataFrame) -> DataFrame:
    """Per cell: number, mean, median and deviation of its neighbours' misorientations."""
    both = edges.select(F.col("label_a").alias("label"), "misorientation").unionByName(edges.select(F.col("label_b").alias("label"), "misorientation"))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n_neighbours"), F.avg("misorientation").alias("mean_misorientation"), _median("misorientation").alias("median_misorientation"), F.stddev_pop("misorientation").alias("std_misorientation"))


def delta_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("delta_c0").alias("mean_c0"), F.avg("delta_c1").alias("mean_c1"), F.stddev_pop("delta_c0").alias("std_c0"), F.stddev_pop("delta_c1").alias("std_c1"), F.corr("delta_c0", "delta_c1").alias("corr"))


def normalise(vox: DataFrame, channels: tuple[str, ...] = ("c0", "c1"), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Channels scaled by their percentiles, without clipping; a flat channel is an error.

    The percentiles are those of voxels whose channels are all finite; values that aren't become 0."""
    fine = F.lit(True)
    for c in channels:
        fine = fine & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    row = {c: exact_quantiles(vox.filter(fine), c, [low, high]) for c in channels}
    if any(row[c][0] is None or not row[c][1] > row[c][0] for c in channels):
        raise ValueError("a channel has no spread")
    return vox.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), (F.col(c) - row[c][0]) / (row[c][1] - row[c][0])).otherwise(0.0) for c in channels})


def robust_zscore(vox: DataFrame, column: str = "c0", clip: float | None = 5.0, mad: bool = True) -> DataFrame:
    """``zscore`` about the median, by 1.4826 MAD (the deviation where that is 0) or, without ``mad``, by the deviation."""
    middle, spread = exact_quantiles(vox, column, [0.5])[0], vox.agg(F.stddev_pop(column)).first()[0]
    apart = F.abs(F.col(column) - F.lit(middle)).alias("apart")
    scale = 1.4826 * (exact_quantiles(vox.select(apart), "apart", [0.5])[0] or 0.0) if mad else 0.0
    scale = scale or spread or 1.0
    z = (F.col(column) - F.lit(middle)) / F.lit(scale)
    return vox.withColumn("zscore", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z)


def chi_statistics(values: DataFrame, column: str) -> DataFrame:
    """Sufficient statistics of a chi distribution on the finite positive values."""
    v = values.select(F.col(column).cast("double").alias("v")).filter((F.col("v") > 0) & (F.col("v") < float("inf")))
    return v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") ** 2).alias("sum_sq"), F.sum(2 * F.log("v")).alias("sum_log_sq"))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def chi_from_statistics(n: int, sum_sq: float, sum_log_sq: float) -> tuple[float, float]:
    """Degrees of freedom and scale by maximum likelihood; NaN below ten values."""
    if n < 10:
        return math.nan, math.nan
    # squares follow a gamma distribution: log a - digamma(a) has a known value
    s = math.log(sum_sq / n) - sum_log_sq / n
    low, high = 1e-6, 1e6
    for _ in range(200):
        a = math.sqrt(low * high)
        low, high = (a, high) if math.log(a) - _digamma(a) > s else (low, a)
    return 2 * a, math.sqrt(sum_sq / n / (2 * a))


def fit_chi(values: DataFrame, column: str) -> dict[str, float]:
    """Chi distribution (location 0) of the finite positive values; NaN below ten of them."""
    row = chi_statistics(values, column).first()
    df, scale = chi_from_statistics(row["n"] or 0, row["sum_sq"], row["sum_log_sq"])
    return {"df": df, "scale": scale, "n": row["n"] or 0}


def fit_lognormal(cells: DataFrame, column: str = "size") -> DataFrame:
    """Log-normal fit (location 0) of positive sizes; null below five cells."""
    fine = cells.filter(F.col(column) > 0)
    n = F.count(F.lit(1))
    return fine.agg(F.when(n >= 5, F.avg(F.log(column))).alias("mu"), F.when(n >= 5, F.stddev_pop(F.log(column))).alias("sigma"), n.alias("n_used"))


def quantiles(values: DataFrame, column: str, n: int = 99) -> DataFrame:
    """Empirical quantiles k / (n + 1)."""
    found = exact_quantiles(values, column, [(k + 1) / (n + 1) for k in range(n)])
    return values.sparkSession.createDataFrame([(k + 1, q) for k, q in enumerate(found)], "k int, quantile double")


def chi_quantiles(values: DataFrame, column: str, n: int = 99) -> DataFrame:
    """Empirical quantiles k / (n + 1) of the finite positive values beside those of the fitted chi distribution, and its density there."""
    fine = values.filter((F.col(column) > 0) & (F.col(column) < float("inf")))
    fit = fit_chi(fine, column)
    fitted = [chi_quantile((k + 1) / (n + 1), fit["df"], fit["scale"]) if fit["n"] >= 10 else None for k in range(n)]
    both = quantiles(fine, column, n).join(values.sparkSession.createDataFrame(list(enumerate(fitted, 1)), "k int, fitted double"), "k")
    return both.withColumn("density", chi_pdf(F.col("fitted"), fit["df"], fit["scale"]) if fit["n"] >= 10 else F.lit(None).cast("double"))


def chi_density(values: DataFrame, column: str, points: int = 500, top: float = 0.995) -> DataFrame:
    """The fitted chi density at equal steps from 0 to the quantile ``top`` of the finite positive values: ``k, x, density``;
    no rows below ten of them."""
    fine = values.filter((F.col(column) > 0) & (F.col(column) < float("inf")))
    fit = fit_chi(fine, column)
    if fit["n"] < 10:
        return values.sparkSession.createDataFrame([], "k int, x double, density double")
    high = exact_quantiles(fine, column, [top])[0]
    steps = values.sparkSession.range(points).select(F.col("id").cast("int").alias("k"), (F.col("id") * F.lit(high / (points - 1))).alias("x"))
    return steps.withColumn("density", F.when(F.col("x") > 0, chi_pdf(F.col("x"), fit["df"], fit["scale"])).otherwise(0.0))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between least and greatest value: ``bin`` from 0, ``n`` and density."""
    row = values.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("n")).first()
    if not row["n"]:
        return values.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density")).limit(0)
    width = (row["b"] - row["a"]) / bins or 1.0
    own = F.least(F.lit(bins - 1), F.floor((F.col(column) - row["a"]) / F.lit(float(width)))).cast("int").alias("bin")
    return values.filter(F.col(column).isNotNull()).groupBy(own).agg(F.count(F.lit(1)).alias("n")).withColumn("density", F.col("n") / F.lit(float(row["n"] * width)))


def relabel(vox: DataFrame) -> DataFrame:
    """Positive labels renumbered without gaps, in order; ``new_label``."""
    ranks = number_keys(vox.filter("label > 0").select("label"), "new_label")
    return vox.join(ranks, "label", "left").withColumn("new_label", F.coalesce("new_label", F.lit(0)))


def linear(shape: tuple[int, int, int]) -> Column:
    return (F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")


def components(vox: DataFrame, offsets: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Voxels with ``component``: the least linear index that steps between equal labels reach."""
    shape = extent(vox)
    own = vox.filter("label > 0").select(*COORDS, "label", linear(shape).alias("lin"))
    return joined_parts(own, offsets or halved()).select(*COORDS, "label", "component")


def joined_parts(own: DataFrame, offsets: list[tuple[int, int, int]], by: tuple[str, ...] = ()) -> DataFrame:
    """``own`` (with ``label`` and a number ``lin`` of each voxel) and ``component``: the least number that steps between equal labels reach.

    Voxels are joined inside their tile first; only links between tiles, and the parts that they tie together, go through the rounds."""
    parts = materialize(tile_parts(own, offsets, by), "tile-parts")
    links = parts.filter("links is not null").select("lin", "part", F.explode("links").alias("to"))
    ends = parts.join(links.select(F.col("to").alias("lin")).distinct().hint("merge"), "lin", "left_semi").select(F.col("lin").alias("a"), F.col("part").alias("b"))
    edges = ends.unionByName(links.select(F.col("part").alias("a"), F.col("to").alias("b")))
    found = connected_components(edges).select(F.col("node").alias("part"), "component")
    found = found.join(parts.select("part").distinct().hint("merge"), "part", "left_semi")
    return parts.drop("links").join(found.hint("merge"), "part", "left").withColumn("component", F.coalesce("component", "part")).drop("part")


def split_labels(vox: DataFrame) -> DataFrame:
    """Labels cut into connected parts, numbered by (label, first voxel) as ``new_label``."""
    parts = components(vox)
    order = number_keys(parts.select("label", "component"), "new_label")
    return parts.join(order, ["label", "component"]).select(*COORDS, "label", "new_label")


def drop_edge_labels(vox: DataFrame, axes: tuple[str, ...] = tuple(COORDS)) -> DataFrame:
    """Voxels of labels that touch no face of the grid."""
    shape = dict(zip(COORDS, extent(vox)))
    at_face = F.lit(False)
    for c in axes:
        at_face = at_face | (F.col(c) == 0) | (F.col(c) == shape[c] - 1)
    return vox.filter("label > 0").join(vox.filter(at_face).select("label").distinct(), "label", "left_anti")


def component_stats(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Sizes in voxels and physical units, and each label's share of all labelled voxels."""
    out = cell_sizes(vox).withColumn("volume", F.col("size") * float(math.prod(spacing)))
    total = vox.filter("label > 0").count() or 1
    return out.withColumn("fraction", F.col("size") / F.lit(float(total)))


def method_summary(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Cells, median and quartiles of their size, the largest cell's share, and the median equivalent diameter."""
    s = component_stats(vox, spacing)
    diameter = F.cbrt(6 * F.col("volume") / math.pi)
    return s.agg(F.count(F.lit(1)).alias("n_cells"), _median("size").alias("median_size"), F.percentile("size", F.lit(0.25)).alias("q25_size"), F.percentile("size", F.lit(0.75)).alias("q75_size"), F.max("fraction").alias("largest_fraction"), _median(diameter).alias("median_diameter"))


def cell_metrics(vox: DataFrame) -> DataFrame:
    """Size and summed sample variance of both channels; mean and median KAM over the cell's 6-neighbour shell inside its bounding box."""
    from voxelmill.operators.stencil import cross

    own = vox.filter("label > 0")
    base = own.groupBy("label").agg(F.count(F.lit(1)).alias("size"), (F.var_samp("c0") + F.var_samp("c1")).alias("variance"), *(f(c).alias(n + c) for n, f in (("lo_", F.min), ("hi_", F.max)) for c in COORDS))
    pairs = neighbours(vox.select(*COORDS, "label", "kam"), cross(), ["label", "kam"], keep=other_label, select=[*COORDS, "kam", "n_label"]).filter("n_label > 0").select(*COORDS, "kam", F.col("n_label").alias("label")).distinct()
    near = pairs.join(base, "label")
    for c in COORDS:
        near = near.filter(F.col(c).between(F.col("lo_" + c), F.col("hi_" + c)))
    shell = near.groupBy("label").agg(F.avg("kam").alias("wall_mean")).join(group_quantiles(near, ["label"], {"wall_median": ("kam", 0.5)}), "label")
    return base.select("label", "size", "variance").join(shell, "label", "left")
