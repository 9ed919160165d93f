"""Shifts between volumes: correlation with its error, several features side by side, and a local search without pair rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.stencil import COORDS, TILES, _dealt
from voxelmill.session import materialize

Offset = tuple[int, int, int]
#: Leading bits of a distance that the first pass counts by: sign, exponent and six more.
BITS = 18
#: Sides of the tiles that trials are scored in.
TRIAL_TILE = (32, 64, 64)


def correlate(ref: np.ndarray, mov: np.ndarray, phase: bool = True) -> tuple[tuple[int, ...], float]:
    """Whole-step shift that brings ``mov`` onto ``ref``, and its error.

    The shift is the peak of the circular cross-correlation (ties: the first), with ``phase`` every frequency weighing alike. The error is
    that part of both energies which the peak doesn't explain, as a root; 0 for two empty frames."""
    product_ = np.fft.fftn(ref) * np.conj(np.fft.fftn(mov))
    if phase:
        product_ /= np.maximum(np.abs(product_), 100 * np.finfo(np.float64).eps)
    c = np.fft.ifftn(product_)
    peak = np.array(np.unravel_index(int(np.round(np.abs(c), 9).argmax()), c.shape))
    size = np.array(c.shape)
    energy = float((ref**2).sum() * (mov**2).sum())
    error = np.sqrt(abs(1 - abs(c[tuple(peak)]) ** 2 / energy)) if energy > 0 else 0.0
    return tuple(int(v) for v in np.where(peak > size // 2, peak - size, peak)), float(error)


def correlate_pairs(ref: DataFrame, mov: DataFrame, by: list[str], features: list[str], phase: bool = True) -> DataFrame:
    """``by, feature, dz, dy, dx, error``: for each pair of volumes (keys ``by``) and each feature, the shift of ``mov`` onto ``ref``.

    A pair is a task's group, since its spectrum needs every voxel. Missing values count as 0; pairs with one side alone are left out."""
    side = lambda d, s: d.select(*by, *COORDS, *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features), F.lit(s).alias("_side"))
    both = side(ref, 0).unionByName(side(mov, 1))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        at, own = pdf[COORDS].to_numpy(np.int64), pdf["_side"].to_numpy()
        out = []
        for f in features if len(set(own)) == 2 else []:
            a = np.zeros((2, *(at.max(0) + 1)))
            a[(own, *at.T)] = pdf[f].to_numpy()
            moved, error = correlate(a[0], a[1], phase)
            out.append((*pdf[by].iloc[0], f, *moved, error))
        return pd.DataFrame(out, columns=[*by, "feature", "dz", "dy", "dx", "error"])

    types = dict(ref.dtypes)
    return both.groupBy(*by).applyInPandas(kernel, ", ".join([*(f"{c} {types[c]}" for c in by), "feature string, dz int, dy int, dx int, error double"]))


def correlation_table(frames: DataFrame, features: list[str], phase: bool = False) -> DataFrame:
    """For each frame ``t`` and feature the shift onto the middle one of the sorted steps, its error, and whether all
    features agree on the shift. The middle frame goes to the other ones' tasks once for each of them."""
    steps = frames.select("t").distinct()
    n = steps.count()
    if not n:
        return frames.select("t", F.lit("").alias("feature"), *(F.lit(0).alias(f"d{c}") for c in COORDS), F.lit(0.0).alias("error"), F.lit(True).alias("agree")).limit(0)
    middle = steps.orderBy("t").offset(n // 2).first()["t"]
    volumes = frames if "z" in frames.columns else frames.withColumn("z", F.lit(0))
    ref = volumes.filter(F.col("t") == middle).drop("t").withColumn("t", F.explode(F.lit(sorted(r["t"] for r in steps.collect()))))  # steps
    out = correlate_pairs(ref, volumes, ["t"], features, phase)
    spot = F.struct("dz", "dy", "dx")
    by = Window.partitionBy("t")  # a row a feature
    return out.withColumn("agree", F.min(spot).over(by) == F.max(spot).over(by))


def trial_steps(radius: Offset = (1, 4, 8), step: int = 1) -> list[Offset]:
    """Steps about a shift: none first, then in rising order."""
    around = product(*(range(-r, r + 1, step) for r in radius))
    return [(0, 0, 0), *(o for o in around if any(o))]


def refine_shift(ref: DataFrame, mov: DataFrame, radius: Offset = (1, 4, 8), step: int = 1, initial: DataFrame | None = None, by: tuple[str, ...] = (), feature: str = "feature", channels: tuple[str, ...] = ("c0", "c1"), min_voxels: int = 100, tile: Offset = TRIAL_TILE) -> DataFrame:
    """Scores of all trial shifts of ``mov`` onto ``ref`` (its coordinate plus the shift is that of ``ref``), for each pair of volumes ``by``.

    Trials lie about ``initial`` (``by, dz, dy, dx``; none: about no shift). The score is the features' correlation, less 0.75 of the
    median distance of the channels, plus 0.25 of the overlap's share of ``ref``; trials under ``min_voxels`` common voxels are
    left out. ``best`` marks the greatest score, ties the initial shift, then the earlier trial.

    No row per voxel and trial leaves a tile: voxels and neighbours are slices of dense arrays. Moments are summed there. A ``ref`` that
    lies in one tile has its median there too, so a row a trial leaves it; for others the exact median takes two passes, the first of which
    counts distances by their leading bits, the second the values of those alone that begin like the median (about one in a hundred and fifty)."""
    key = list(by) or ["_all"]
    if not by:
        ref, mov = ref.withColumn("_all", F.lit(0)), mov.withColumn("_all", F.lit(0))
        initial = initial.withColumn("_all", F.lit(0)) if initial is not None else None
    carry, trials = list(dict.fromkeys([feature, *channels])), trial_steps(radius, step)
    own = lambda d: d.select(*key, *COORDS, *(F.col(c).cast("double").alias(c) for c in carry))
    fixed, moved = own(ref.filter("mask")), own(mov.filter("mask"))
    if initial is not None:
        starts = materialize(initial.select(*key, *(F.col(f"d{c}").alias(f"_d{c}") for c in COORDS)), "trial-starts")
        moved = moved.join(starts, key).withColumns({c: (F.col(c) + F.col(f"_d{c}")).cast("int") for c in COORDS}).drop(*(f"_d{c}" for c in COORDS))
    reach = [max(abs(t[k]) for t in trials) for k in range(3)]
    homes = [F.floor(F.col(c) / size).cast("int") for c, size in zip(COORDS, tile)]
    bounds = materialize(fixed.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), *(f(x).alias(f"_{n}{t}") for x, t in zip(homes, TILES) for f, n in ((F.min, "min"), (F.max, "max")))), "trial-bounds")
    alone, held = F.lit(True), F.lit(True)  # a ref of one tile; tiles that can hold a voxel of it
    for t in TILES:
        alone, held = alone & (F.col(f"_min{t}") == F.col(f"_max{t}")), held & F.col(t).between(F.col(f"_min{t}"), F.col(f"_max{t}"))
    dealt = _dealt(fixed, reach, carry, moved, tuple(key), tile).join(bounds, key).filter(held).withColumn("_alone", alone)
    dealt = materialize(dealt.drop("total", *(f"_{n}{t}" for t in TILES for n in ("min", "max"))), "trial-tiles")
    about = fixed.agg(F.avg(feature)).first()[0] or 0.0  # sums about a middle value lose no digits
    kinds = dealt.schema

    def parts(tile: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By trial: the voxels' and neighbours' feature and the bits of their distance (no NaN), which sort like it."""
        at = np.stack([tile[c].to_numpy().astype(np.int64) for c in COORDS], 1)
        home, away = (np.flatnonzero(tile[c].to_numpy(zero_copy_only=False)) for c in ("_own", "_other"))
        if not len(home) or not len(away):
            return
        low, size = at[home].min(0), at[home].max(0) - at[home].min(0) + 1
        wide = size + 2 * np.array(reach)
        near = away[((at[away] >= low - reach) & (at[away] < low + size + reach)).all(1)]
        v = {c: tile[c].to_numpy() for c in carry}
        fixed_there, moved_there = np.zeros(size, bool), np.zeros(wide, bool)
        fixed_there[tuple((at[home] - low).T)] = True
        moved_there[tuple((at[near] - low + reach).T)] = True
        a, b = {}, {}
        for c in carry:
            a[c], b[c] = np.zeros(size), np.zeros(wide)
            a[c][tuple((at[home] - low).T)] = v[c][home] - (about if c == feature else 0.0)
            b[c][tuple((at[near] - low + reach).T)] = v[c][near] - (about if c == feature else 0.0)
        for k, t in enumerate(trials):
            box = tuple(slice(r - s, r - s + n) for r, s, n in zip(reach, t, size))
            both = fixed_there & moved_there[box]
            if both.any():
                x, y = {c: a[c][both] for c in carry}, {c: b[c][box][both] for c in carry}
                d = np.sqrt(sum((x[c] - y[c]) ** 2 for c in channels))
                yield k, x[feature], y[feature], d[~np.isnan(d)].view(np.int64)

    def median(bits: np.ndarray) -> float | None:
        if not len(bits):
            return None
        ends = [(len(bits) - 1) // 2, len(bits) // 2]
        low, high = np.partition(bits, ends)[ends].view(np.float64).tolist()
        return (low + high) / 2

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, out = pa.Table.from_batches(list(batches)), []
        whole = tile["_alone"][0].as_py()
        for k, a, b, bits in parts(tile):
            code, n = (None, None) if whole else (x.tolist() for x in np.unique(bits >> (64 - BITS), return_counts=True))
            out.append((k, len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b, code, n, median(bits) if whole else None))
        if out:
            names = ["k", "n", "a", "b", "aa", "bb", "ab", "code", "c", "apart"]
            types = [pa.int32(), pa.int64(), *[pa.float64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]
            first = [pa.array([tile[c][0].as_py()] * len(out), tile.schema.field(c).type) for c in key]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(list(x), t) for x, t in zip(zip(*out), types))], [*key, *names])

    names = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in key)
    first = materialize(dealt.groupBy(*key, *TILES).applyInArrow(moments, f"{names}, k int, n long, a double, b double, aa double, bb double, ab double, code array<long>, c array<long>, apart double"), "trial-moments")
    n, mean = F.sum("n"), lambda c: F.sum(c) / F.sum("n")
    covar = mean("ab") - mean("a") * mean("b")
    dev = lambda c: F.sqrt(F.greatest(mean(c + c) - mean(c) ** 2, F.lit(0.0)))
    sums = first.groupBy(*key, "k").agg(n.alias("n"), (covar / (dev("a") * dev("b") + 1e-8)).alias("corr"), F.max("apart").alias("apart"))

    def medians(spread: DataFrame, wide: DataFrame) -> DataFrame:
        """Of volumes that lie in several tiles, by the tiles' counts."""
        counts = spread.select(*key, "k", F.explode(F.arrays_zip("code", "c")).alias("o")).groupBy(*key, "k", F.col("o.code").alias("code")).agg(F.sum("o.c").alias("c"))
        total = F.sum("c").over(Window.partitionBy(*key, "k"))
        ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("total") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil((F.col("total") - 1) / 2).alias("rank"))))
        wanted = counts.withColumn("total", total).withColumn("e", ends).select(*key, "k", "code", "c", F.col("e.side").alias("side"), F.col("e.rank").alias("rank"))
        wanted = wanted.withColumn("value", F.lit(None).cast("double"))

        def settled(rows: DataFrame, name: str) -> DataFrame:
            """The code that holds each wanted place, and the place among its own."""
            upto = F.sum("c").over(Window.partitionBy(*key, "k", "side").orderBy("code"))  # of one trial
            found = rows.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
            return materialize(found.select(*key, "k", "side", "code", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "value"), name)

        wanted = settled(wanted, "trial-beginnings")
        tiles = wide.select(*(F.col(c).alias(c) for c in (*key, *TILES))).distinct()  # columns of its own beside those of wide

        def values(tile: pa.Table, want: pa.Table) -> pa.Table:
            """Counts of the whole distances that begin like a wanted place's."""
            codes, out = {}, ([], [], [], [])
            for w in want["asked"][0].as_py() if len(want) else []:
                codes.setdefault(w["k"], []).append(w["code"])
            for k, _, _, bits in parts(tile) if codes and len(tile) else []:
                begin = bits >> (64 - BITS)
                own = bits[np.logical_or.reduce([begin == c for c in codes.get(k, [-1])])]
                if len(own):
                    code, c = np.unique(own, return_counts=True)
                    for x, y in zip(out, (np.full(len(code), k), code, c, code.view(np.float64))):
                        x.append(y)
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.float64))]
            source = tile if len(tile) else want
            begun = [pa.array([source[c][0].as_py()] * len(flat[0]), source.schema.field(c).type) for c in key]
            return pa.table([*begun, pa.array(flat[0].astype(np.int32)), *map(pa.array, flat[1:])], names=[*key, "k", "code", "c", "value"])

        asked = tiles.join(wanted.groupBy(*key).agg(F.collect_set(F.struct("k", "code")).alias("asked")), key)  # two codes a trial
        found = wide.groupBy(*key, *TILES).cogroup(asked.groupBy(*key, *TILES)).applyInArrow(values, f"{names}, k int, code long, c long, value double")
        found = found.groupBy(*key, "k", "code").agg(F.sum("c").alias("c"), F.min("value").alias("value")).withColumn("above", F.shiftright("code", 64 - BITS))
        wanted = settled(found.join(wanted.select(*key, "k", "side", "rank", F.col("code").alias("above")), [*key, "k", "above"]), "trial-middles")
        return wanted.groupBy(*key, "k").agg(F.avg("value").alias("apart"))

    spread = first.filter("code is not null")
    if not spread.isEmpty():
        more = medians(spread, dealt.filter(~F.col("_alone"))).withColumnRenamed("apart", "middle")
        sums = sums.join(more, [*key, "k"], "left").withColumn("apart", F.coalesce("apart", "middle")).drop("middle")

    places = ref.sparkSession.createDataFrame([(k, *t) for k, t in enumerate(trials)], "k int, sz int, sy int, sx int")
    out = sums.filter(F.col("n") >= min_voxels).join(F.broadcast(places), "k").join(bounds.select(*key, "total"), key)
    if initial is not None:
        out = out.join(starts, key)
    moved_by = {f"shift_{c}": (F.col(f"s{c}") + (F.col(f"_d{c}") if initial is not None else 0)).cast("int") for c in COORDS}
    scored = out.withColumns(moved_by).withColumn("score", F.col("corr") - 0.75 * F.col("apart") + 0.25 * F.col("n") / F.col("total"))
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last("score"), "k")  # a row a trial
    return scored.withColumn("best", F.row_number().over(order) == 1).select(*by, *(f"shift_{c}" for c in COORDS), "n", "corr", "apart", "score", "best")
