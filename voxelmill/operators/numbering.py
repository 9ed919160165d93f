"""Numbers without gaps in key order, and exact quantiles, by range partitions: no task sees all keys or values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.session import materialize


def number_keys(keys: DataFrame, name: str) -> DataFrame:
    """The distinct rows of ``keys`` with ``name``, their place (int, from 1) in the order of all their columns.

    Keys are sorted by range and written once with their place in their partition; the partitions' sizes, one row each,
    give the offsets. No keys, no rows."""
    columns = keys.columns
    ranged = keys.distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the low 33 bits count the rows of a partition
    kept = materialize(ranged.select(*columns, F.spark_partition_id().alias("_part"), within.alias("_at")), "numbered")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # a row a partition
    return kept.join(F.broadcast(starts), "_part").select(*columns, (F.col("_at") + F.col("_start") + 1).cast("int").alias(name))


def exact_quantiles(values: DataFrame, column: str, probs: list[float], in_one_task: int = 1_000_000) -> list[float | None]:
    """Quantiles (linear between neighbours) of a column's non-null values, NaN being the greatest; None without any.

    Up to ``in_one_task`` values are summed up by one aggregate. More are sorted by range and written once; the partitions'
    sizes, one row each, tell where the wanted places lie, and only those values come back."""
    own = values.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = own.count()
    if not n:
        return [None] * len(probs)
    if n <= in_one_task:
        return list(own.agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in probs)))).first()[0])
    ranged = own.repartitionByRange("v").sortWithinPartitions("v")
    kept = materialize(ranged.select("v", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranged")
    places, before = {}, 0
    wanted = sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    for part, size in kept.groupBy("_part").count().orderBy("_part").collect():
        places.update({(part, k - before): k for k in wanted if before <= k < before + size})
        before += size
    spot = values.sparkSession.createDataFrame([(p, a, k) for (p, a), k in places.items()], "_part int, _at long, k long")
    at = {r.k: r.v for r in kept.join(F.broadcast(spot), ["_part", "_at"]).select("k", "v").collect()}  # two rows a quantile
    out = []
    for p in probs:
        x = p * (n - 1)
        a, b = at[math.floor(x)], at[math.ceil(x)]
        out.append(a if a == b else a + (x - math.floor(x)) * (b - a))
    return out


def greatest_group(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def group_quantiles(values: DataFrame, keys: list[str], wants: dict[str, tuple[str, float]], in_one_task: int = 1_000_000, most: int | None = None) -> DataFrame:
    """``keys`` and, for each ``name: (column, share)``, that exact quantile of the group's non-null values, NaN being the greatest.

    Groups of up to ``in_one_task`` rows are one aggregate each. With a greater group, equal values are counted together
    and sorted by range over (group, column, value), so a hot group is split over tasks; the ranges' sizes tell in which
    one a wanted place lies, and only there values are numbered. Both ways give the same numbers. ``most`` is the greatest group's size, where it is known."""
    columns = list(dict.fromkeys(c for c, _ in wants.values()))
    own = values.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    if most is None:
        most = greatest_group(own, keys)
    if most <= in_one_task:
        return own.groupBy(*keys).agg(*(F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wants.items()))
    key = F.struct(*keys).alias("_k")  # nulls in a struct are equal to each other
    counted = own.select(key, F.posexplode(F.array(*columns)).alias("_c", "_v")).filter("_v is not null").groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    kept = materialize(counted.repartitionByRange("_k", "_c", "_v").withColumn("_part", F.spark_partition_id()), "by-group")
    group = Window.partitionBy("_k", "_c")
    before = F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = kept.groupBy("_k", "_c", "_part").agg(F.sum("_n").alias("_size")).select("_k", "_c", "_part", "_size", before.alias("_before"), F.sum("_size").over(group).alias("_total"))
    places = F.array(*(F.struct(F.lit(columns.index(c)).alias("c"), F.lit(i).alias("want"), (F.lit(p) * (F.col("_total") - 1)).alias("x")) for i, (c, p) in enumerate(wants.values())))
    asked = sizes.withColumn("w", F.explode(places)).filter("w.c = _c").withColumn("k", F.explode(F.array_distinct(F.array(F.floor("w.x"), F.ceil("w.x")))))
    asked = asked.filter((F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("_size"))).select("_k", "_c", "_part", "w.want", "w.x", "k", (F.col("k") - F.col("_before")).alias("at"))
    upto = F.sum("_n").over(Window.partitionBy("_k", "_c", "_part").orderBy("_v"))  # within a range
    found = kept.withColumn("upto", upto).join(asked, ["_k", "_c", "_part"]).filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("_n")))
    low, high = F.min_by("_v", "k"), F.max_by("_v", "k")
    each = found.groupBy("_k", "want").agg(F.when(low.eqNullSafe(high), low).otherwise(low + (F.first("x") - F.min("k")) * (high - low)).alias("q"))
    table = each.groupBy("_k").pivot("want", list(range(len(wants)))).agg(F.first("q"))
    # groups without values have a row of nulls
    table = own.select(key).distinct().join(table, "_k", "left")
    return table.select(*(F.col("_k")[k].alias(k) for k in keys), *(F.col(str(i)).alias(n) for i, n in enumerate(wants)))
