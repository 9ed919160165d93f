"""Operators whose order is part of their meaning: one volume a task (``applyInPandas`` by dataset), datasets side by side.

Flood fill, watershed, region growing, skeletons and phase correlation visit voxels in an order that each step changes,
so a volume is the unit of work; a volume of the reference's sizes (10^6 voxels) fits in a task.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.stencil import COORDS, neighbours, windows
from voxelmill.operators.components import connected_components
from voxelmill.operators.shifts import correlate

NEAR6 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def dense(pdf: pd.DataFrame, columns: list[str], fill: float = np.nan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (Z, Y, X, columns), presence and the rows' coordinates. Negative or repeated places are an error."""
    at = pdf[COORDS].to_numpy(np.int64)
    if (at < 0).any():
        raise ValueError("a coordinate is negative")
    shape = tuple(at.max(0) + 1)
    a = np.full((*shape, len(columns)), fill, np.float64)
    a[tuple(at.T)] = pdf[columns].to_numpy(np.float64)
    there = np.zeros(shape, bool)
    there[tuple(at.T)] = True
    if there.sum() < len(at):
        raise ValueError("a voxel is given twice")
    return a, there, at


def near_bits(field: np.ndarray, offsets, local: float) -> list[np.ndarray]:
    """For each offset, the flat array of voxels whose neighbour there is near to them."""
    limit, shape, out = np.float32(local) ** 2 * np.float32(field.shape[-1]), field.shape[:-1], []
    for o in offsets:
        near = np.zeros(shape, bool)
        own = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, shape))
        to = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, shape))
        if all(abs(d) < n for d, n in zip(o, shape)):
            near[own] = ((field[to] - field[own]) ** 2).sum(-1, dtype=np.float32) < limit
        out.append(near.ravel())
    return out


class Growth:
    """Regions of one field, each grown depth first. A voxel joins where enough of its free neighbours are near to it (and, with a cap
    above 0, near to the region's running mean); single precision throughout. Which neighbours are near to a voxel doesn't
    depend on the region, so it is found once, by array shifts, over a frame that is never free."""

    def __init__(self, field: np.ndarray, offsets, local: float, cap: float, tolerance: float) -> None:
        self.pads = [max((abs(o[k]) for o in offsets), default=0) for k in range(3)]
        wide = np.pad(field.astype(np.float32), [*((p, p) for p in self.pads), (0, 0)])
        self.shape = wide.shape[:-1]
        strides = (self.shape[1] * self.shape[2], self.shape[2], 1)
        steps = [sum(d * s for d, s in zip(o, strides)) for o in offsets]
        # neighbours in the offsets' order, each with its nearness as a byte string, which plain Python reads fast
        self.around = [(step, near.tobytes()) for step, near in zip(steps, near_bits(wide, offsets, local))]
        self.flat = wide.reshape(-1, wide.shape[-1])
        self.cap, self.tolerance = cap, np.float32(tolerance)
        self.cap_limit = np.float32(cap) ** 2 * np.float32(field.shape[-1])
        self.need = [math.ceil(self.tolerance * np.float32(n)) for n in range(len(offsets) + 1)]

    def wide(self, free: np.ndarray) -> bytearray:
        return bytearray(np.pad(free.astype(np.uint8), [(p, p) for p in self.pads]).tobytes())

    def place(self, at: tuple[int, int, int]) -> int:
        z, y, x = (c + p for c, p in zip(at, self.pads))
        return (z * self.shape[1] + y) * self.shape[2] + x

    def grow(self, free: bytearray, seed: int) -> list[int]:
        if not free[seed]:
            return []
        around, need, capped, flat = self.around, self.need, self.cap > 0, self.flat
        mean, n, region, seen, stack = flat[seed], 0, [], {seed}, [seed]
        while stack:
            at = stack.pop()
            valid, passing = 0, []
            for step, near in around:
                to = at + step
                if free[to]:
                    valid += 1
                    if near[at] and (not capped or ((flat[to] - mean) ** 2).sum(dtype=np.float32) < self.cap_limit):
                        passing.append(to)
            if at != seed and len(passing) < need[valid]:
                continue
            region.append(at)
            n += 1
            if capped:
                mean = mean + (flat[at] - mean) / np.float32(n)
            for to in passing:
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return region


def flood(field: np.ndarray, mask: np.ndarray, offsets, local: float, cap: float | None = None, tolerance: float = 0.9, max_iterations: int | None = 250, min_size: int = 50, seeds=None, fill_remaining: bool = False, seed: int | None = None, consume: bool = False) -> tuple[np.ndarray, list[tuple[int, tuple]]]:
    """Label a volume from seeds (last first), then from random voxels; ``consume`` also takes the small regions out.

    Each seed costs an iteration; with ``max_iterations`` None they go on until no seed is left."""
    growth = Growth(field, offsets, local, cap or -1.0, tolerance)
    free, pool = growth.wide(mask), growth.wide(mask)
    out, found = np.zeros(len(free), np.int32), []
    inside = lambda at: all(0 <= c < n for c, n in zip(at, mask.shape))
    rng = np.random.Generator(np.random.Philox(0 if seed is None or seed < 0 else seed))
    order = rng.permutation(np.flatnonzero(mask.ravel()))
    user, k = list(seeds) if seeds is not None else [], 0
    drawn = [growth.place(p) for p in np.stack(np.unravel_index(order, mask.shape), 1).tolist()]
    for _ in count() if max_iterations is None else range(max_iterations):
        while user and not (inside(user[-1]) and free[growth.place(user[-1])] and pool[growth.place(user[-1])]):
            user.pop()
        if user:
            at = growth.place(user.pop())
        elif seeds is not None and not fill_remaining:
            break
        else:
            while k < len(drawn) and not pool[drawn[k]]:
                k += 1
            if k == len(drawn):
                break
            at = drawn[k]
        region = growth.grow(free, at)
        for p in region:
            pool[p] = 0
        pool[at] = 0
        if len(region) >= min_size and region:
            found.append((len(region), tuple(int(v) - p for v, p in zip(np.unravel_index(at, growth.shape), growth.pads))))
            out[region] = len(found)
        if region and (consume or len(region) >= min_size):
            for p in region:
                free[p] = 0
    own = tuple(slice(p, n - p) for p, n in zip(growth.pads, growth.shape))
    return out.reshape(growth.shape)[own].copy(), found


LABELLED = "dataset_id string, z int, y int, x int, label int"


def _by_dataset(vox: DataFrame, kernel, schema: str, errors: bool = False) -> DataFrame:
    """The kernel's rows of each dataset. With ``errors`` there is a column ``error``: a dataset whose kernel raises gives one
    row with the exception and nulls, and the others aren't touched."""
    if not errors:
        return vox.groupBy("dataset_id").applyInPandas(kernel, schema)
    names = [part.split()[0] for part in schema.split(", ")]

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return kernel(pdf).assign(error=None)
        except Exception as failure:  # whatever a dataset does belongs to that dataset
            return pd.DataFrame({n: [pdf["dataset_id"].iloc[0] if n == "dataset_id" else repr(failure) if n == "error" else None] for n in [*names, "error"]})

    return vox.groupBy("dataset_id").applyInPandas(guarded, schema + ", error string")


def _labelled(pdf: pd.DataFrame, at: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"dataset_id": pdf["dataset_id"].to_numpy(), "z": at[:, 0].astype(np.int32), "y": at[:, 1].astype(np.int32), "x": at[:, 2].astype(np.int32), "label": labels[tuple(at.T)].astype(np.int32)})


def fillable(pdf: pd.DataFrame, a: np.ndarray, there: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Voxels that are present, finite and, where the table has a mask, inside it."""
    mask = there & np.isfinite(a).all(-1)
    if "mask" in pdf:
        inside = np.zeros(mask.shape, bool)
        inside[tuple(at.T)] = pdf["mask"].to_numpy(bool)
        mask &= inside
    return mask


def flood_fill(vox: DataFrame, offsets, local: float, channels: tuple[str, ...] = ("c0", "c1"), two_stage: bool = False, errors: bool = False, **options) -> DataFrame:
    """Exact flood fill of each dataset. Two-stage: seeds are collected first and filled from the largest on. A column ``seed_rank`` (null: no seed)
    names the seeds, the first of which is filled first. ``errors`` as in ``_by_dataset``."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, there, at = dense(pdf, list(channels))
        mask = fillable(pdf, a, there, at)
        own = dict(options)
        if "seed_rank" in pdf:
            picked = pdf["seed_rank"].notna().to_numpy()
            # the last seed of a list is filled first
            own |= {"seeds": [tuple(map(int, p)) for p in at[picked][np.argsort(-pdf["seed_rank"].to_numpy(float)[picked])]]}
        if two_stage:
            _, found = flood(a, mask, offsets, local, consume=True, **own)
            own |= {"seeds": [s for _, s in sorted(found, key=lambda f: f[0])]}
            if not found:
                return _labelled(pdf, at, np.zeros(mask.shape, np.int32))
        labels, _ = flood(a, mask, offsets, local, **own)
        return _labelled(pdf, at, labels)

    return _by_dataset(vox, kernel, LABELLED, errors)


def collect_seeds(vox: DataFrame, offsets, local: float, channels: tuple[str, ...] = ("c0", "c1"), **options) -> DataFrame:
    """Regions' sizes and seeds, each region taken out once found."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, there, at = dense(pdf, list(channels))
        _, found = flood(a, fillable(pdf, a, there, at), offsets, local, consume=True, **options)
        rows = [(pdf["dataset_id"].iloc[0], k, n, *s) for k, (n, s) in enumerate(found)]
        return pd.DataFrame(rows, columns=["dataset_id", "seed_rank", "size", *COORDS]).astype({"seed_rank": "int64", "size": "int64", **{c: "int32" for c in COORDS}})

    return _by_dataset(vox, kernel, "dataset_id string, seed_rank long, size long, z int, y int, x int")


def core_components(vox: DataFrame, offsets, local: float, tolerance: float, shape: tuple[int, int, int], min_size: int = 1, channels: tuple[str, ...] = ("c0", "c1")) -> DataFrame:
    """The order-free fill in joins alone: voxels with enough near neighbours, connected through near steps between them."""
    lin = ((F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")).alias("lin")
    own = vox.select(*COORDS, lin, *channels)
    near = sum(((F.col(f"n_{c}") - F.col(c)) ** 2 for c in channels), F.lit(0.0)) < F.lit(local * local * len(channels))
    pairs = neighbours(own, offsets, ["lin", *channels], select=["lin", "n_lin", *channels, *(f"n_{c}" for c in channels)]).select("lin", "n_lin", near.alias("near"))
    core = pairs.groupBy("lin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("near").cast("int")).alias("k")).filter(F.col("k") >= F.ceil(F.col("n") * tolerance)).select("lin")
    edges = pairs.filter("near and lin < n_lin").join(core, "lin", "left_semi").join(core.withColumnRenamed("lin", "n_lin"), "n_lin", "left_semi").select(F.col("lin").alias("a"), F.col("n_lin").alias("b"))
    found = connected_components(edges)
    labelled = core.join(found, core["lin"] == found["node"], "left").select("lin", F.coalesce("component", "lin").alias("component"))
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labelled.join(sizes, "component")


def priority_flood(feature: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed from markers over 6-neighbours: lowest feature first, ties by age."""
    wide = lambda a: np.pad(a, 1).ravel().tolist()
    # plain lists over a frame outside the mask, which Python reads faster than arrays
    shape = tuple(n + 2 for n in markers.shape)
    steps = [(o[0] * shape[1] + o[1]) * shape[2] + o[2] for o in NEAR6]
    out, height, open_ = wide(markers), wide(feature), wide(mask & (markers == 0))
    heap = [(height[p], age, p) for age, p in enumerate(np.flatnonzero(np.pad((markers > 0) & mask, 1)).tolist())]
    age = len(heap)
    heapq.heapify(heap)
    while heap:
        _, _, at = heapq.heappop(heap)
        for step in steps:
            to = at + step
            if open_[to]:
                open_[to] = False
                out[to] = out[at]
                heapq.heappush(heap, (height[to], age, to))
                age += 1
    return np.array(out, markers.dtype).reshape(shape)[1:-1, 1:-1, 1:-1]


def watershed(vox: DataFrame, feature: str = "c0", errors: bool = False) -> DataFrame:
    """Labels grown over each dataset by rising ``feature``; NaN counts as the greatest finite value."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, there, at = dense(pdf, [feature, "label"], 0.0)
        f = a[..., 0].copy()
        finite = np.isfinite(f) & there
        f[~np.isfinite(f)] = f[finite].max() if finite.any() else 1.0
        return _labelled(pdf, at, priority_flood(f, a[..., 1].astype(np.int32), there))

    return _by_dataset(vox, kernel, LABELLED, errors)


def region_grow(vox: DataFrame, channels: tuple[str, str] = ("c0", "c1")) -> DataFrame:
    """Labels grown by least distance to the label's running mean; costs are those of the time they were pushed."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, there, at = dense(pdf, [*channels, "label"], 0.0)
        v, out = a[..., :2], a[..., 2].astype(np.int64)
        n = int(out.max()) + 1
        own = out[there]
        sums = np.stack([np.bincount(own, np.nan_to_num(v[there][:, k]), n) for k in range(2)], 1)
        count = np.bincount(own, minlength=n).astype(float)
        heap, age = [], 0

        def push(frm) -> None:
            nonlocal age
            label = out[frm]
            mean = sums[label] / max(1.0, count[label])
            for o in NEAR6:
                to = (frm[0] + o[0], frm[1] + o[1], frm[2] + o[2])
                if all(0 <= c < m for c, m in zip(to, out.shape)) and there[to] and out[to] == 0:
                    d = math.dist(v[to], mean)
                    heapq.heappush(heap, (1e300 if math.isnan(d) else d, age, to, label))
                    age += 1

        for frm in map(tuple, np.argwhere((out > 0) & there)):
            push(frm)
        while heap:
            _, _, to, label = heapq.heappop(heap)
            if out[to]:
                continue
            out[to] = label
            if not np.isnan(v[to]).any():
                sums[label] += v[to]
                count[label] += 1
            push(to)
        return _labelled(pdf, at, out)

    return _by_dataset(vox, kernel, LABELLED)


def thin(image: np.ndarray) -> np.ndarray:
    """Skeleton of a plane by alternating boundary passes (Zhang and Suen)."""
    return thinned(image)


def thinned(image: np.ndarray, most: int | None = None) -> np.ndarray:
    """A plane after at most ``most`` pairs of passes; None: until nothing changes."""
    img = np.pad(image.astype(np.uint8), 1)
    for _ in count() if most is None else range(most):
        changed = False
        for step in (0, 1):
            p = [img[0:-2, 1:-1], img[0:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, 0:-2], img[1:-1, 0:-2], img[0:-2, 0:-2]]
            around = sum(x.astype(int) for x in p)
            turns = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            sides = (north * east * south == 0) & (east * south * west == 0) if step == 0 else (north * east * west == 0) & (north * south * west == 0)
            gone = (img[1:-1, 1:-1] == 1) & (around >= 2) & (around <= 6) & (turns == 1) & sides
            if gone.any():
                img[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            break
    return img[1:-1, 1:-1].astype(bool)


def skeleton(planes: DataFrame, over: str = "over") -> DataFrame:
    """Skeleton flag of each plane's boolean column, plane by plane."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["y", "x"]].to_numpy(np.int64)
        img = np.zeros(tuple(at.max(0) + 1), bool)
        img[tuple(at.T)] = pdf[over].to_numpy(bool)
        return pd.DataFrame({"z": pdf["z"].to_numpy(np.int32), "y": at[:, 0].astype(np.int32), "x": at[:, 1].astype(np.int32), "skeleton": thin(img)[tuple(at.T)]})

    return planes.groupBy("z").applyInPandas(kernel, "z int, y int, x int, skeleton boolean")


def phase_shift(ref: np.ndarray, mov: np.ndarray) -> tuple[int, ...]:
    """Whole-step shift that brings ``mov`` onto ``ref``: the peak of their cross-correlation, every frequency weighing alike."""
    return correlate(ref, mov)[0]


def register(frames: DataFrame, feature: str = "c0") -> DataFrame:
    """Shift (dy, dx; with a column z also dz) of each frame t onto the middle one of the sorted steps; frames are scaled by one range, NaN
    counts as 0.

    The middle frame goes to the tasks by a join on its own key."""
    axes = [c for c in COORDS if c in frames.columns]
    row = frames.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"), F.countDistinct("t").alias("n")).first()
    if not row["n"]:
        return frames.select("t", *(F.lit(0).alias(f"d{c}") for c in axes)).limit(0)
    middle = frames.select("t").distinct().orderBy("t").offset(row["n"] // 2).first()["t"]
    span = (row["hi"] - row["lo"]) or 1.0
    scaled = frames.select("t", *axes, F.coalesce(F.nanvl((F.col(feature) - row["lo"]) / F.lit(span), F.lit(0.0)), F.lit(0.0)).alias("v"))
    ref = scaled.filter(F.col("t") == middle).select(*axes, F.col("v").alias("r"))
    both = scaled.join(ref, axes, "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[axes].to_numpy(np.int64)
        a = np.zeros((*(at.max(0) + 1), 2))
        a[tuple(at.T)] = pdf[["r", "v"]].fillna(0.0).to_numpy(np.float64)
        moved = phase_shift(a[..., 0], a[..., 1])
        return pd.DataFrame({"t": pdf["t"].iloc[:1].to_numpy(np.int32), **{f"d{c}": np.array([d], np.int32) for c, d in zip(axes, moved)}})

    return both.groupBy("t").applyInPandas(kernel, "t int, " + ", ".join(f"d{c} int" for c in axes))


def template_peak(plane: np.ndarray, piece: np.ndarray) -> float:
    """Greatest normalised correlation of ``piece`` with the windows of ``plane``, centred on its pixels; outside it is 0.

    Windows' sums come from running totals, their products with the piece from one product of spectra."""
    h, w = piece.shape
    wide = np.pad(plane, ((h, h), (w, w)))
    t = piece - piece.mean()
    size = (wide.shape[0] + h - 1, wide.shape[1] + w - 1)
    products = np.fft.irfft2(np.fft.rfft2(wide, size) * np.fft.rfft2(t[::-1, ::-1], size), size)[h - 1 : wide.shape[0], w - 1 : wide.shape[1]]

    def sums(a: np.ndarray) -> np.ndarray:
        c = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]

    power = np.sqrt(np.maximum(sums(wide**2) - sums(wide) ** 2 / t.size, 0) * (t**2).sum())
    peak = np.where(power > 1e-9, products / np.maximum(power, 1e-9), 0.0)
    y, x = 1 + (h - 1) // 2, 1 + (w - 1) // 2
    return float(peak[y : y + plane.shape[0], x : x + plane.shape[1]].max())


def slice_to_volume(planes: DataFrame, piece: DataFrame, feature: str = "c0") -> DataFrame:
    """Best template correlation of a plane with each plane z of a volume; the best z (ties: the smallest) has ``best``.

    Both are scaled to mean 0 and deviation 1; missing values count as 0. The piece lies within the planes' extent."""
    both = planes.select("z", "y", "x", F.col(feature).alias("v")).join(piece.select("y", "x", F.col(feature).alias("r"), F.lit(True).alias("there")), ["y", "x"], "left")

    def scaled(rows: pd.DataFrame, column: str) -> np.ndarray:
        at = rows[["y", "x"]].to_numpy(np.int64)
        a = np.zeros(tuple(at.max(0) + 1))
        a[tuple(at.T)] = rows[column].fillna(0.0).to_numpy(np.float64)
        return (a - a.mean()) / (a.std() + 1e-8)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf[pdf["there"].notna()]
        found = template_peak(scaled(pdf, "v"), scaled(part, "r")) if len(part) else math.nan
        return pd.DataFrame({"z": pdf["z"].iloc[:1].to_numpy(np.int32), "correlation": [found]})

    out = both.groupBy("z").applyInPandas(kernel, "z int, correlation double")
    best = out.agg(F.max_by(F.col("z"), F.struct("correlation", -F.col("z"))).alias("best_z"))
    return out.join(F.broadcast(best)).withColumn("best", F.col("z") == F.col("best_z")).drop("best_z")


def cap_sweep(vox: DataFrame, caps: list[float], offsets, local: float, **options) -> DataFrame:
    """Exact fills of every dataset under each cap, summed up by cap in the list's order: cells, their sizes, the share of
    voxels claimed, cells' q95 distances to their mean, and whether the greatest of these has not risen."""
    runs = [flood_fill(vox, offsets, local, cap=c, **options).withColumn("step", F.lit(k)).withColumn("cap", F.lit(float(c))) for k, c in enumerate(caps)]
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    cell = ["step", "cap", "dataset_id", "label"]
    filled = every.join(vox.select("dataset_id", *COORDS, "c0", "c1"), ["dataset_id", *COORDS])
    counts = filled.groupBy("step", "cap").agg(F.avg((F.col("label") > 0).cast("int")).alias("claimed_fraction"))
    own = filled.filter("label > 0")
    means = own.groupBy(*cell).agg(F.avg("c0").alias("m0"), F.avg("c1").alias("m1"), F.count(F.lit(1)).alias("size"))
    spread = own.join(means, cell).groupBy(*cell, "size").agg(F.percentile(F.hypot(F.col("c0") - F.col("m0"), F.col("c1") - F.col("m1")), F.lit(0.95)).alias("q"))
    cells = spread.groupBy("step").agg(F.count(F.lit(1)).alias("n_labels"), F.avg("size").alias("size_mean"), F.stddev_pop("size").alias("size_std"), F.avg("q").alias("mean_q95"), F.max("q").alias("max_q95"))
    before = F.lag("max_q95").over(Window.orderBy("step"))  # a row for each cap
    return counts.join(cells, "step", "left").fillna(0, ["n_labels", "size_mean", "size_std"]).withColumn("not_risen", F.coalesce(F.col("max_q95") <= before, F.lit(True)))


def top_down(levels: DataFrame, threshold: float, claimed_share: float = 0.1) -> DataFrame:
    """From the coarsest level to the finest, accept cells whose distances' q95 is below the threshold and that are mostly
    unclaimed; an accepted cell takes all its voxels, those of cells before it too."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        claimed, number = {}, 0
        for _, level in sorted(pdf.groupby("level"), key=lambda g: -g[0]):
            for _, cell in level[level["label"] > 0].groupby("label"):
                v = cell[["c0", "c1"]].to_numpy(float)
                places = list(map(tuple, cell[COORDS].to_numpy()))
                if np.percentile(np.linalg.norm(v - v.mean(0), axis=1), 95) < threshold and sum(p in claimed for p in places) < claimed_share * len(places):
                    number += 1
                    claimed.update(dict.fromkeys(places, number))
        out = [(pdf["dataset_id"].iloc[0], *map(int, p), n) for p, n in claimed.items()]
        return pd.DataFrame(out, columns=["dataset_id", *COORDS, "label"]).astype({**{c: "int32" for c in COORDS}, "label": "int32"})

    return _by_dataset(levels, kernel, LABELLED)


def gaussian_variance(values: DataFrame, key: str = "label", value: str = "d", bins: int = 50) -> DataFrame:
    """Variance of a Gaussian fitted to each group's density over equal bins; NaN below six finite values or without spread.

    Spark counts the bins, so the fit reads at most ``bins`` rows of a group, however many values it has."""
    v = F.col(value).cast("double")
    fine = values.select(key, F.when(F.abs(v) < float("inf"), v).alias("v"))  # neither null, NaN nor infinite
    stats = fine.groupBy(key).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width)).cast("int").alias("bin")
    usable = stats.filter("n >= 6 and high > low")
    counts = fine.filter("v is not null").join(usable.select(key, "low", "high"), key).groupBy(key, at).agg(F.count(F.lit(1)).alias("k"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, std, low, high = (float(pdf[c].iloc[0]) for c in ("n", "mean", "std", "low", "high"))
        wide = (high - low) / bins
        x, y = low + (np.arange(bins) + 0.5) * wide, np.zeros(bins)
        y[pdf["bin"].to_numpy(int)] = pdf["k"].to_numpy(float) / (n * wide)
        p, damp = np.array([y.max(), mean, std]), 1e-2
        model = lambda p: p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))
        for _ in range(200):
            m = model(p)
            j = np.stack([m / p[0], m * (x - p[1]) / p[2] ** 2, m * (x - p[1]) ** 2 / p[2] ** 3], 1)
            step = np.linalg.lstsq(j.T @ j + damp * np.diag(np.diag(j.T @ j) + 1e-12), j.T @ (y - m), rcond=None)[0]
            better = ((y - model(p + step)) ** 2).sum() < ((y - m) ** 2).sum() and abs((p + step)[2]) > 1e-12 and (p + step)[0] != 0
            p, damp = (p + step, damp / 3) if better else (p, damp * 4)
            if damp > 1e12 or (better and np.abs(step).max() < 1e-12):
                break
        return pd.DataFrame({key: pdf[key].iloc[:1].to_numpy(), "gauss_var": [float(p[2] ** 2)]})

    fitted = counts.join(usable, key).groupBy(key).applyInPandas(kernel, f"{key} {dict(values.dtypes)[key]}, gauss_var double")
    return stats.select(key).join(fitted, key, "left").select(key, F.coalesce("gauss_var", F.lit(math.nan)).alias("gauss_var"))


def surface_faces(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), min_voxels: int = 1) -> DataFrame:
    """Surface quads of each label (label, axis, side, corner in physical units): voxel faces without an equal neighbour."""
    own = vox.filter("label > 0").select(*COORDS, "label")
    big = own.groupBy("label").count().filter(F.col("count") >= min_voxels).select("label")
    own = own.join(big, "label", "left_semi")

    def bare(voxels, near, there: np.ndarray) -> dict[str, np.ndarray]:
        alone = ~(there & (near["label"] == voxels["label"][:, None]))
        return {"bare": (alone << np.arange(6)).sum(1).astype(np.int32)}

    # a voxel's six sides are bits, unfolded where they lie
    sides = windows(own, NEAR6, ["label"], bare, {"bare": "int"}, keep=("label",)).filter("bare > 0")
    steps = F.explode(F.filter(F.array(*(F.struct(*(F.lit(v).alias(d) for v, d in zip(o, ("dz", "dy", "dx"))), F.lit(1 << k).alias("bit")) for k, o in enumerate(NEAR6))), lambda o: F.col("bare").bitwiseAND(o["bit"]) > 0)).alias("o")
    faces = sides.select(*COORDS, "label", steps).select(*COORDS, "label", "o.dz", "o.dy", "o.dx")
    axis = F.when(F.col("dz") != 0, "z").when(F.col("dy") != 0, "y").otherwise("x")
    side = F.col("dz") + F.col("dy") + F.col("dx")
    place = [((F.col(c) + F.when(F.col(f"d{c}") > 0, 1).otherwise(0)) * float(s)).alias(f"p{c}") for c, s in zip(COORDS, spacing)]
    return faces.select("label", axis.alias("axis"), side.cast("int").alias("side"), *place)
