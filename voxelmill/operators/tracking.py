"""Tracking of cells between steps: overlaps, candidates, assignment, events. All pairs of steps at once (``pair`` keys)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.components import connected_components
from voxelmill.operators.numbering import group_quantiles
from voxelmill.session import materialize

SIDES = ("a", "b")


def step_overlaps(steps: DataFrame, min_overlap: int = 1) -> DataFrame:
    """``pair, label_a, label_b, overlap_voxels`` of steps t and t + 1 (columns t, y, x, label; further keys z).

    With a column ``mask`` only voxels inside the mask of both steps count."""
    keys = [c for c in ("z", "y", "x") if c in steps.columns]
    own = (steps.filter("mask") if "mask" in steps.columns else steps).filter("label > 0").select("t", *keys, "label")
    later = own.select((F.col("t") - 1).alias("t"), *keys, F.col("label").alias("label_b"))
    out = own.withColumnRenamed("label", "label_a").join(later, ["t", *keys]).groupBy(F.col("t").alias("pair"), "label_a", "label_b").agg(F.count(F.lit(1)).alias("overlap_voxels"))
    return out.filter(F.col("overlap_voxels") >= min_overlap)


def step_features(steps: DataFrame) -> DataFrame:
    """Per step and label: volume, centroid (with ``cz`` where the steps are volumes) and median channels."""
    place = [F.avg(c).alias(f"c{c}") for c in ("z", "y", "x") if c in steps.columns]
    cells = steps.filter("label > 0")
    return cells.groupBy("t", "label").agg(F.count(F.lit(1)).alias("volume"), *place).join(group_quantiles(cells, ["t", "label"], {"m0": ("c0", 0.5), "m1": ("c1", 0.5)}), ["t", "label"])


def centroid_pairs(features: DataFrame, radius: float) -> DataFrame:
    """Pairs of consecutive steps' cells whose centroids are within ``radius``: an equi-join of grid buckets, then the distance."""
    axes = [c for c in "zyx" if f"c{c}" in features.columns]
    cell = lambda c: F.floor(F.col(f"c{c}") / radius).cast("long")
    a = features.select(F.col("t").alias("pair"), F.col("label").alias("label_a"), *(F.col(f"c{c}").alias(f"a{c}") for c in axes), *(cell(c).alias(f"g{c}") for c in axes))
    b = features.select((F.col("t") - 1).alias("pair"), F.col("label").alias("label_b"), *(F.col(f"c{c}").alias(f"b{c}") for c in axes), *(cell(c).alias(f"g{c}") for c in axes))
    for c in axes:
        b = b.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + k for k in (-1, 0, 1)))))
    d = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in axes), F.lit(0.0)))
    return a.join(b, ["pair", *(f"g{c}" for c in axes)]).withColumn("centroid_distance", d).filter(F.col("centroid_distance") <= radius).select("pair", "label_a", "label_b", "centroid_distance")


def candidates(steps: DataFrame, radius: float, min_overlap: int = 1, distance_scale: float = 10.0, orientation_scale: float = 0.25) -> DataFrame:
    """Pairs by overlap or distance, with shares, similarities and ``tracking_score``."""
    f = step_features(steps)
    over = step_overlaps(steps, min_overlap)
    pairs = over.select("pair", "label_a", "label_b").unionByName(centroid_pairs(f, radius).select("pair", "label_a", "label_b")).distinct()
    place = [c for c in ("cz", "cy", "cx") if c in f.columns]
    side = lambda s, t: f.select(t.alias("pair"), F.col("label").alias(f"label_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("volume", *place, "m0", "m1")))
    out = pairs.join(over, ["pair", "label_a", "label_b"], "left").withColumn("overlap_voxels", F.coalesce("overlap_voxels", F.lit(0)))
    out = out.join(side("a", F.col("t")), ["pair", "label_a"]).join(side("b", F.col("t") - 1), ["pair", "label_b"])
    out = out.withColumns({
        "frac_of_a": F.col("overlap_voxels") / F.col("volume_a"), "frac_of_b": F.col("overlap_voxels") / F.col("volume_b"),
        "dice_overlap": 2 * F.col("overlap_voxels") / (F.col("volume_a") + F.col("volume_b")),
        "centroid_distance": F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in place), F.lit(0.0))),
        "orientation_difference": F.sqrt((F.col("m0_a") - F.col("m0_b")) ** 2 + (F.col("m1_a") - F.col("m1_b")) ** 2),
        "volume_similarity": F.least("volume_a", "volume_b") / F.greatest("volume_a", "volume_b"),
    })
    out = out.withColumns({"centroid_similarity": F.exp(-F.col("centroid_distance") / distance_scale), "orientation_similarity": F.exp(-F.col("orientation_difference") / orientation_scale)})
    score = 2 * F.col("dice_overlap") + F.col("frac_of_a") + F.col("frac_of_b") + F.col("centroid_similarity") + F.col("orientation_similarity") + 0.5 * F.col("volume_similarity")
    return out.withColumn("tracking_score", score).drop(*(f"{c}_{s}" for c in (*place, "m0", "m1") for s in SIDES))


def _scanned(pairs: DataFrame, key: list[str], score: str) -> DataFrame:
    """The scan by falling score within each group of ``key``, a group a task."""

    def walk(table: pa.Table) -> pa.Table:
        a, b, s = (table[c].to_numpy() for c in ("label_a", "label_b", score))
        taken, used = [], (set(), set())
        for k in np.lexsort((b, a, np.where(np.isnan(s), -np.inf, -s))).tolist():
            if a[k] not in used[0] and b[k] not in used[1]:
                used[0].add(a[k])
                used[1].add(b[k])
                taken.append(k)
        return table.take(pa.array(taken, pa.int64()))

    return pairs.groupBy(*key).applyInArrow(walk, pairs.schema)


def greedy_assignment(pairs: DataFrame, min_score: float = -math.inf, score: str = "tracking_score", scan: int = 1_000_000) -> DataFrame:
    """One-to-one pairs by falling score (ties by labels, NaN first), each step ``pair`` on its own; pairs without a score are left out.

    A step's candidates are scanned in one task up to ``scan`` rows. Those of greater steps are cut into connected parts,
    which don't touch each other's choices, and each part is scanned; only parts above ``scan`` rows go by rounds of pairs that are
    best for both their sides. All three ways choose the same pairs."""
    own = pairs.filter(F.col(score) >= min_score)
    if (own.groupBy("pair").count().agg(F.max("count")).first()[0] or 0) <= scan:
        return _scanned(own, ["pair"], score)
    own = materialize(own, "candidates")
    great = own.groupBy("pair").count().filter(F.col("count") > scan).select("pair")
    out = [_scanned(own.join(great, "pair", "left_anti"), ["pair"], score)]
    node = lambda s: F.concat_ws(":", F.col("pair"), F.lit(s), F.col(f"label_{s}"))
    wide = own.join(great, "pair", "left_semi").withColumn("_node", node("a"))
    parts = connected_components(wide.select(F.col("_node").alias("a"), node("b").alias("b")))
    wide = materialize(wide.join(parts.withColumnRenamed("node", "_node"), "_node").drop("_node"), "candidate-parts")
    giant = wide.groupBy("component").count().filter(F.col("count") > scan).select("component")
    out.append(_scanned(wide.join(giant, "component", "left_anti"), ["component"], score).drop("component"))
    left = materialize(wide.join(giant, "component", "left_semi").drop("component"), "candidates-left")
    while left.head(1):
        best = lambda s: F.row_number().over(Window.partitionBy("pair", f"label_{s}").orderBy(F.desc(score), "label_a", "label_b"))
        taken = materialize(left.withColumn("ra", best("a")).withColumn("rb", best("b")).filter("ra = 1 and rb = 1").drop("ra", "rb"), "assigned")
        out.append(taken)
        left = left.join(taken.select("pair", "label_a"), ["pair", "label_a"], "left_anti").join(taken.select("pair", "label_b"), ["pair", "label_b"], "left_anti")
        left = materialize(left, "candidates-left")
    return reduce(DataFrame.unionByName, (d.select(*pairs.columns) for d in out))


def overlap_events(steps: DataFrame, min_overlap: int = 1, min_fraction: float = 0.1) -> DataFrame:
    """Events from overlaps alone: death, one_to_one, merge, split candidates of parents and births of untouched children."""
    over = step_overlaps(steps, min_overlap)
    sizes = steps.filter("label > 0").groupBy("t", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.select((F.col("t") - 1).alias("pair")).distinct().join(sizes.select(F.col("t").alias("pair")).distinct(), "pair")
    parents = sizes.select(F.col("t").alias("pair"), F.col("label").alias("label_a"), F.col("n").alias("n_a")).join(pairs, "pair", "left_semi")
    children = sizes.select((F.col("t") - 1).alias("pair"), F.col("label").alias("label_b"), F.col("n").alias("n_b")).join(pairs, "pair", "left_semi")
    sig = over.join(parents, ["pair", "label_a"]).join(children, ["pair", "label_b"]).filter((F.col("overlap_voxels") / F.col("n_a") >= min_fraction) | (F.col("overlap_voxels") / F.col("n_b") >= min_fraction))
    out_degree = sig.groupBy("pair", "label_a").agg(F.countDistinct("label_b").alias("n_children"))
    in_degree = sig.groupBy("pair", "label_b").agg(F.countDistinct("label_a").alias("n_parents"))
    linked = sig.select("pair", "label_a", "label_b").join(out_degree, ["pair", "label_a"]).join(in_degree, ["pair", "label_b"])
    event = F.when(F.col("n_children") >= 2, "split_candidate").when(F.col("n_parents") >= 2, "merge_candidate").otherwise("one_to_one")
    seen = linked.select("pair", event.alias("event"), "label_a", "label_b", "n_children", "n_parents")
    none = F.lit(None)
    dead = parents.join(sig, ["pair", "label_a"], "left_anti").select("pair", F.lit("death_candidate").alias("event"), "label_a", none.cast("int").alias("label_b"), F.lit(0).cast("long").alias("n_children"), none.cast("long").alias("n_parents"))
    born = children.join(sig, ["pair", "label_b"], "left_anti").select("pair", F.lit("birth_candidate").alias("event"), none.cast("int").alias("label_a"), "label_b", none.cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_parents"))
    return seen.unionByName(dead).unionByName(born)


def classify_events(steps: DataFrame, pairs: DataFrame, assigned: DataFrame, min_score: float, min_fraction: float, max_distance: float) -> DataFrame:
    """Events from scored candidates; a label may stand in several. Counts of children and parents where they apply."""
    fits = (F.col("frac_of_a") >= min_fraction) | (F.col("frac_of_b") >= min_fraction) | (F.col("centroid_distance") <= max_distance)
    sig = pairs.filter((F.col("tracking_score") >= min_score) & fits).select("pair", "label_a", "label_b")
    none = F.lit(None)
    row = lambda d, name, a, b, c, p: d.select("pair", F.lit(name).alias("event"), a.cast("int").alias("label_a"), b.cast("int").alias("label_b"), c.cast("long").alias("n_children"), p.cast("long").alias("n_parents"))
    children = sig.groupBy("pair", "label_a").agg(F.countDistinct("label_b").alias("n"))
    parents = sig.groupBy("pair", "label_b").agg(F.countDistinct("label_a").alias("n"))
    splits, merges = children.filter("n > 1"), parents.filter("n > 1")
    tied = assigned.select("pair", "label_a", "label_b").join(children.withColumnRenamed("n", "c"), ["pair", "label_a"], "left").join(parents.withColumnRenamed("n", "p"), ["pair", "label_b"], "left").fillna(0, ["c", "p"])
    zero = F.lit(0)
    cells = steps.filter("label > 0").select("t", "label").distinct()
    last = steps.agg(F.min("t"), F.max("t")).first()
    dead = cells.filter(F.col("t") < F.lit(last[1])).select(F.col("t").alias("pair"), F.col("label").alias("label_a")).join(sig, ["pair", "label_a"], "left_anti")
    born = cells.filter(F.col("t") > F.lit(last[0])).select((F.col("t") - 1).alias("pair"), F.col("label").alias("label_b")).join(sig, ["pair", "label_b"], "left_anti")
    parts = [
        row(tied, "one_to_one", F.col("label_a"), F.col("label_b"), F.col("c"), F.col("p")), row(splits, "split_candidate", F.col("label_a"), none, F.col("n"), none),
        row(merges, "merge_candidate", none, F.col("label_b"), none, F.col("n")), row(dead, "death_candidate", F.col("label_a"), none, zero, none), row(born, "birth_candidate", none, F.col("label_b"), none, zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EVENTS = ["birth_candidate", "death_candidate", "merge_candidate", "one_to_one", "split_candidate"]


def event_pivot(events: DataFrame, fractions: bool = False) -> DataFrame:
    """Counts of events by pair, 0 where absent; as shares of the row with ``fractions``."""
    out = events.groupBy("pair").pivot("event", EVENTS).agg(F.count(F.lit(1))).fillna(0)
    if fractions:
        total = sum((F.col(e) for e in EVENTS), F.lit(0))
        out = out.select("pair", *((F.col(e) / total).alias(e) for e in EVENTS))
    return out


def assignment_summary(assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """By step ``pair``: candidates, assignments, and mean and median of the assignments' scores, orientation differences,
    centroid distances and dice overlaps (null without assignments)."""
    named = {"assignment_score": "tracking_score", "orientation_difference": "orientation_difference", "centroid_distance": "centroid_distance", "dice_overlap": "dice_overlap"}
    counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n_candidates"))
    means = assigned.groupBy("pair").agg(F.count(F.lit(1)).alias("n_assignments"), *(F.avg(c).alias(f"mean_{n}") for n, c in named.items()))
    medians = group_quantiles(assigned, ["pair"], {f"median_{n}": (c, 0.5) for n, c in named.items()})
    return counts.join(means, "pair", "left").join(medians, "pair", "left").fillna(0, ["n_assignments"])


def split_parents(over: DataFrame) -> DataFrame:
    """Parents ranked by total overlap within their pair, with their number of children."""
    out = over.groupBy("pair", "label_a").agg(F.sum("overlap_voxels").alias("total_overlap"), F.count(F.lit(1)).alias("n_children"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("total_overlap"), "label_a")))


def common_mask(steps: DataFrame) -> DataFrame:
    """Places (y, x; of volumes also z) that every step holds inside its mask."""
    n, place = steps.select("t").distinct().count(), [c for c in ("z", "y", "x") if c in steps.columns]
    return steps.filter("mask").groupBy(*place).agg(F.countDistinct("t").alias("n")).filter(F.col("n") == n).select(*place)


def common_fractions(steps: DataFrame) -> DataFrame:
    """By step: voxels of its mask and the common mask's share of them."""
    common = common_mask(steps).withColumn("common", F.lit(1))
    place = [c for c in common.columns if c != "common"]
    both = steps.filter("mask").select("t", *place).join(common, place, "left")
    return both.groupBy("t").agg(F.count(F.lit(1)).alias("n_mask"), (F.count("common") / F.count(F.lit(1))).alias("common_fraction"))


def bounding_box(places: DataFrame, pad: int = 0, shape: dict[str, int] | None = None, required: bool = True) -> DataFrame:
    """Least and greatest coordinates (both inside), moved apart by ``pad`` but not below 0 nor beyond the grid's ``shape``
    (sizes by axis). No place at all is an error; where none is ``required`` the box is null then, or with ``shape`` the whole grid."""
    axes = [c for c in ("z", "y", "x") if c in places.columns]
    out = places.agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))))
    held = lambda v: F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit("an empty mask has no box")).cast("int")) if required else v
    some = lambda c, v: v if required or shape else F.when(F.col(f"min_{c}").isNotNull(), v)
    # the greater or less of a null and a number is the number
    low = lambda c: some(c, F.greatest(held(F.col(f"min_{c}")) - pad, F.lit(0)))
    high = lambda c: held(F.col(f"max_{c}")) + pad if not shape else F.least(held(F.col(f"max_{c}")) + pad, F.lit(shape[c] - 1))
    return out.select(*(f(c).cast("int").alias(f"{n}_{c}") for c in axes for n, f in (("min", low), ("max", high))))


def crop(vox: DataFrame, box: DataFrame, moved: bool = True) -> DataFrame:
    """Voxels inside a box of one row, none inside a box of nulls; with ``moved`` their coordinates count from its corner."""
    row = box.first()
    axes = [c for c in ("z", "y", "x") if f"min_{c}" in box.columns]
    if any(row[f"min_{c}"] is None for c in axes):
        return vox.limit(0)
    for c in axes:
        vox = vox.filter(F.col(c).between(row[f"min_{c}"], row[f"max_{c}"]))
    return vox.withColumns({c: (F.col(c) - row[f"min_{c}"]).cast("int") for c in axes}) if moved else vox


def shift(vox: DataFrame, dz: int, dy: int, dx: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels moved by whole steps; what leaves the grid is dropped, what enters is absent."""
    out = vox
    for c, d, n in zip(("z", "y", "x"), (dz, dy, dx), shape):
        out = out.withColumn(c, (F.col(c) + d).cast("int")).filter(F.col(c).between(0, n - 1))
    return out


def shift_linear(vox: DataFrame, d: tuple[float, float, float], channels: tuple[str, ...], shape: tuple[int, int, int]) -> DataFrame:
    """Voxels moved by fractions of a step: weighted sums of at most eight corners; voxels without all corners are absent."""
    low = [math.floor(v) for v in d]
    part = [v - k for v, k in zip(d, low)]
    corners = [(o, math.prod(p if s else 1 - p for s, p in zip(o, part))) for o in product((0, 1), repeat=3)]
    corners = [(o, w) for o, w in corners if w > 0]
    steps = F.explode(F.array(*(F.struct(*(F.lit(k + s).alias(c) for k, s, c in zip(low, o, ("z", "y", "x"))), F.lit(float(w)).alias("w")) for o, w in corners))).alias("o")
    moved = vox.select("*", steps).select(*((F.col(c) + F.col(f"o.{c}")).cast("int").alias(c) for c in ("z", "y", "x")), *((F.col(c) * F.col("o.w")).alias(c) for c in channels))
    for c, n in zip(("z", "y", "x"), shape):
        moved = moved.filter(F.col(c).between(0, n - 1))
    return moved.groupBy("z", "y", "x").agg(*(F.sum(c).alias(c) for c in channels), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(corners)).drop("n")


def apply_shifts(frames: DataFrame, shifts: DataFrame, columns: tuple[str, ...], shape: tuple[int, int, int], order: int = 1, pad_z: int = 0) -> DataFrame:
    """Frames ``t`` moved by their own row (``t, dz, dy, dx``; null: not moved, as is a frame without a row) of a table of shifts.

    Order 1 blends ``columns`` from up to eight corners, whose weights follow from the frame's shift; a voxel that lacks a
    corner with weight, or has NaN there, is absent or NaN. Order 0, for labels and masks, takes the nearest voxel. What leaves the grid is
    dropped; ``pad_z`` planes more are kept on both sides in z."""
    axes = ("z", "y", "x")
    own = frames.select("t", *axes, *columns).join(shifts.select("t", *(F.coalesce(F.col(f"d{c}"), F.lit(0.0)).cast("double").alias(f"d{c}") for c in axes)), "t", "left").fillna(0.0, [f"d{c}" for c in axes])
    inside = F.lit(True)
    for c, n, pad in zip(axes, shape, (pad_z, 0, 0)):
        inside = inside & F.col(c).between(-pad, n - 1 + pad)
    if order == 0:
        return own.select("t", *((F.col(c) + F.ceil(F.col(f"d{c}") - 0.5)).cast("int").alias(c) for c in axes), *columns).filter(inside)
    ends = [F.array(F.struct(F.floor(f"d{c}").alias("k"), (1 - F.col(f"d{c}") + F.floor(f"d{c}")).alias("w")), F.struct((F.floor(f"d{c}") + 1).alias("k"), (F.col(f"d{c}") - F.floor(f"d{c}")).alias("w"))) for c in axes]
    corners = [F.struct(*(ends[k][s]["k"].alias(c) for k, (c, s) in enumerate(zip(axes, o))), (ends[0][o[0]]["w"] * ends[1][o[1]]["w"] * ends[2][o[2]]["w"]).alias("w")) for o in product((0, 1), repeat=3)]
    moved = own.withColumn("o", F.filter(F.array(*corners), lambda o: o["w"] > 0)).withColumn("need", F.size("o")).withColumn("o", F.explode("o"))
    moved = moved.select("t", *((F.col(c) + F.col(f"o.{c}")).cast("int").alias(c) for c in axes), "need", *((F.col(c) * F.col("o.w")).alias(c) for c in columns)).filter(inside)
    out = moved.groupBy("t", *axes).agg(*(F.sum(c).alias(c) for c in columns), F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return out.filter(F.col("n") == F.col("need")).select("t", *axes, *columns)


def expand_layers(vox: DataFrame, layers: DataFrame) -> DataFrame:
    """Voxels aligned to the union of layers: absent layers have NaN in fractional columns, 0 in whole ones and false in flags."""
    ranks = layers.select("layer").distinct().withColumn("z", (F.dense_rank().over(Window.orderBy("layer")) - 1).cast("int"))
    # every place of a plane unfolds to the layers' ranks
    grid = vox.select("y", "x").distinct().withColumn("z", F.explode(F.expr(f"sequence(0, {ranks.count() - 1})"))).join(ranks, "z")
    fills = {"double": F.lit(math.nan), "float": F.lit(math.nan).cast("float"), "boolean": F.lit(False)}
    own = [(c, fills.get(t, F.lit(0).cast(t))) for c, t in vox.dtypes if c not in ("layer", "z", "y", "x")]
    found = grid.join(vox.drop("z").withColumn("found", F.lit(True)), ["layer", "y", "x"], "left")
    return found.select("layer", "z", "y", "x", *(F.when(F.col("found"), F.col(c)).otherwise(fill).alias(c) for c, fill in own))


def layer_shapes(layers: DataFrame) -> DataFrame:
    """Rows and columns of each layer, and whether they are those of the first one."""
    own = layers.groupBy("layer").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    first = own.agg(F.min_by(F.struct("ny", "nx"), "layer").alias("f")).first()["f"]
    ny, nx = (first["ny"], first["nx"]) if first else (0, 0)
    return own.withColumn("fits", (F.col("ny") == ny) & (F.col("nx") == nx))


def stack_layers(layers: DataFrame) -> DataFrame:
    """Layers as one volume, z by rising layer number; layers of another shape than the first are an error."""
    shapes = layer_shapes(layers)
    odd = shapes.filter("not fits").orderBy("layer").first()
    if odd:
        raise ValueError(f"layer {odd['layer']} has {odd['ny']} x {odd['nx']} places, the first one others")
    ranks = shapes.select("layer", (F.dense_rank().over(Window.orderBy("layer")) - 1).cast("int").alias("z"))
    return layers.drop("z").join(ranks, "layer")


def split_children(over: DataFrame) -> DataFrame:
    """The children of each pair's parent with the greatest overlap, in falling order."""
    top = split_parents(over).filter("rank = 1").select("pair", "label_a")
    own = over.join(top, ["pair", "label_a"], "left_semi").select("pair", "label_a", "label_b", "overlap_voxels")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("overlap_voxels"), "label_b")))
