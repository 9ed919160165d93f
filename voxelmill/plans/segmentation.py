"""Whole segmentations: every dataset of a voxel table in one run, from raw channels to cells, contacts and a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.operators import kernels as K
from voxelmill.operators import regions as R
from voxelmill.operators import stencil as S
from voxelmill.operators.filters import sample_seeds
from voxelmill.operators.numbering import group_quantiles, number_keys
from voxelmill.session import checkpoint, materialize

BY = ("dataset_id",)


@dataclass
class Parameters:
    """Thresholds of the two-stage fill are in normalised units; ``global_threshold`` None: no cap."""

    channels: tuple[str, ...] = ("c0", "c1")
    footprint: list[tuple[int, int, int]] = field(default_factory=lambda: S.box((3, 3, 3), True))
    local_threshold: float = 0.02
    global_threshold: float | None = None
    tolerance: float = 0.45
    min_size: int = 0
    max_iterations: int = 1_000_000
    kam_size: tuple[int, int, int] = (3, 3, 3)
    low: float = 0.01
    high: float = 0.99
    seed: int = 42
    #: So many seeds of each dataset, drawn from its voxels beforehand, are filled in one stage; None: the two-stage fill.
    seeds: int | None = None


@dataclass
class Segmentation:
    voxels: DataFrame  # dataset_id, z, y, x, channels (normalised), label
    cells: DataFrame
    edges: DataFrame
    summary: DataFrame  # a row a dataset
    failures: DataFrame  # datasets that can't be segmented: dataset_id, error
    markers: DataFrame | None = None  # a row a dataset: markers of the fill and their voxels


def normalise(vox: DataFrame, channels: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Voxels with finite channels, each scaled by its dataset's own percentiles, not clipped; datasets without spread go."""
    for c in channels:
        vox = vox.filter(F.abs(F.col(c)) < float("inf"))  # null and NaN fail too
    cuts = group_quantiles(vox, list(BY), {f"{n}_{c}": (c, p) for c in channels for n, p in (("low", low), ("high", high))})
    for c in channels:
        cuts = cuts.filter(F.col(f"high_{c}") > F.col(f"low_{c}"))
    scaled = {c: (F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")) for c in channels}
    return vox.join(cuts, list(BY)).withColumns(scaled).drop(*(f"{n}_{c}" for c in channels for n in ("low", "high")))


def split_labels(vox: DataFrame) -> DataFrame:
    """Labels cut into connected parts, numbered within their dataset by (label, first voxel)."""
    z, y, x = S.extent(vox)
    # a voxel's number: its dataset's, then its place in the widest grid
    numbers = number_keys(vox.select(*BY), "dataset_no")
    own = vox.filter("label > 0").join(numbers, list(BY)).withColumn("lin", (F.col("dataset_no").cast("long") - 1) * (z * y * x) + R.linear((z, y, x)))
    parts = R.joined_parts(own.drop("dataset_no"), S.halved(), BY).drop("lin")
    order = number_keys(parts.select(*BY, "label", "component"), "n")
    # the numbers run over all datasets: each one's begin after its least
    first = order.groupBy(*BY).agg((F.min("n") - 1).alias("first"))
    order = order.join(first, list(BY)).select(*BY, "label", "component", (F.col("n") - F.col("first")).alias("new"))
    return parts.join(order.hint("merge"), [*BY, "label", "component"]).withColumn("label", F.col("new").cast("int")).drop("component", "new")


@F.pandas_udf(T.StructType([T.StructField("df", T.DoubleType()), T.StructField("scale", T.DoubleType())]))
def chi_of(n: pd.Series, sum_sq: pd.Series, sum_log_sq: pd.Series) -> pd.DataFrame:
    """Chi fits (location 0) from sufficient statistics, a row a dataset; null below ten values."""
    return pd.DataFrame([R.chi_from_statistics(*row) for row in zip(n, sum_sq, sum_log_sq)], columns=["df", "scale"])


def summarise(vox: DataFrame, labelled: DataFrame, cells: DataFrame, edges: DataFrame, markers: DataFrame) -> DataFrame:
    """A row for each dataset of ``vox``: voxels, coverage, cells, volumes, misorientations and their chi fit; null without cells."""
    key = list(BY)
    a = vox.groupBy(*BY).agg(F.count(F.lit(1)).alias("valid_voxels"))
    b = labelled.groupBy(*BY).agg(F.count(F.lit(1)).alias("labelled_voxels"))
    c = cells.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("volume_voxels").alias("mean_volume")).join(group_quantiles(cells, key, {"median_volume": ("volume_voxels", 0.5)}), key)
    m = F.col("misorientation")
    kept = F.when((m > 0) & (m < float("inf")), m)
    d = edges.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(m).alias("mean_misorientation"), F.count(kept).alias("n"), F.coalesce(F.sum(kept**2), F.lit(0.0)).alias("s"), F.coalesce(F.sum(2 * F.log(kept)), F.lit(0.0)).alias("l"))
    d = d.withColumn("chi", chi_of("n", "s", "l")).select("*", F.col("chi.df").alias("chi_df"), F.col("chi.scale").alias("chi_scale")).drop("chi", "n", "s", "l")
    d = d.join(group_quantiles(edges, key, {"median_misorientation": ("misorientation", 0.5)}), key)
    out = a.join(markers, key, "left").join(b, key, "left").join(c, key, "left").join(d, key, "left").fillna(0, ["n_markers", "marker_voxels", "labelled_voxels", "n_cells", "n_pairs"])
    return out.withColumn("marker_coverage", F.col("marker_voxels") / F.col("valid_voxels")).withColumn("coverage", F.col("labelled_voxels") / F.col("valid_voxels"))


def segment(vox: DataFrame, parameters: Parameters | None = None, registry: DataFrame | None = None) -> Segmentation:
    """Normalise, fill in two stages, grow by watershed over the KAM, cut into connected cells, and describe them.

    Columns: dataset_id, z, y, x, the channels and, if wanted, mask. All datasets run side by side; the fill and the
    watershed take a dataset a task, all else is joins and aggregates keyed by dataset. An empty table gives empty results.

    ``registry`` (``dataset_id`` and any further columns, such as a strain) tells which datasets to process; its columns stand in the
    summary, and those of its datasets that ``vox`` lacks are failures. So are datasets without a voxel in the mask or
    without spread, and those in which the fill or the watershed raises: their kernels hand the exception on as a row, and
    the other datasets go on."""
    p, key = parameters or Parameters(), list(BY)
    if registry is not None:
        vox = vox.join(registry.select(*BY), key, "left_semi")
    inside = vox.filter("mask") if "mask" in vox.columns else vox
    scaled = materialize(normalise(inside.select(*BY, *S.COORDS, *p.channels), p.channels, p.low, p.high), "normalised")
    start = scaled
    if p.seeds is not None:
        drawn = sample_seeds(scaled.withColumn("mask", F.lit(True)), p.seeds, p.seed, BY).drop("draw")
        start = scaled.join(drawn, [*BY, *S.COORDS], "left")
    filled = K.flood_fill(start, p.footprint, p.local_threshold, p.channels, two_stage=p.seeds is None, errors=True, cap=p.global_threshold, tolerance=p.tolerance, min_size=p.min_size, max_iterations=p.max_iterations, seed=p.seed)
    filled = materialize(filled, "filled")
    seeds = filled.filter("error is null").drop("error")
    markers = seeds.filter("label > 0").groupBy(*BY).agg(F.countDistinct("label").alias("n_markers"), F.count(F.lit(1)).alias("marker_voxels"))
    sound = scaled.join(filled.filter("error is not null").select(*BY), key, "left_anti")
    kam = S.kam(sound, p.kam_size, p.channels, by=BY).select(*BY, *S.COORDS, "kam")
    grown = materialize(K.watershed(checkpoint(kam.join(seeds.hint("merge"), [*BY, *S.COORDS])), "kam", errors=True), "grown")
    labelled = materialize(split_labels(grown.filter("error is null").drop("error").join(scaled.hint("merge"), [*BY, *S.COORDS])), "segmented")
    cells, edges = R.cell_table(labelled, p.channels, by=BY), R.neighbour_table(labelled, p.channels, by=BY)
    failed = vox.select(*BY).distinct().join(scaled.select(*BY).distinct(), key, "left_anti").join(inside.select(*BY, F.lit(True).alias("some")).distinct(), key, "left")
    failures = failed.select(*BY, F.when(F.col("some"), "a channel has no spread").otherwise("no voxel in the mask").alias("error"))
    for stage in (filled, grown):
        failures = failures.unionByName(stage.filter("error is not null").select(*BY, "error"))
    lost = filled.unionByName(grown).filter("error is not null").select(*BY)
    summary = summarise(scaled.join(lost, key, "left_anti"), labelled, cells, edges, markers)
    if registry is not None:
        failures = failures.unionByName(registry.select(*BY).join(vox.select(*BY).distinct(), key, "left_anti").select(*BY, F.lit("missing").alias("error")))
        summary = registry.join(summary, key)
    return Segmentation(labelled, cells, edges, summary, failures, markers)
