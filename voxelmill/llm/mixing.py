"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents are counted into cells (source, language, topic) by one partial aggregate; every later step works on the
cells, whose number is the product of the three margins and not of the documents. A sweep scales the cells' token
weights to each margin in turn. A cell's factor is its fitted weight over its tokens; a document is kept with
probability ``min(1, c * factor)``, where ``c`` makes the expected tokens the budget, and the draw is a hash of its doc_id.
The minimum takes from cells that should grow, so the margins are met only where no cell is at 1. With ``repeat`` they are
met always: a document is expected ``budget * factor`` times, whole parts for certain and the rest by the draw.

Null sources, languages and texts are values of their own. Documents without words have weight in no margin; they are
kept with their cell's probability (1 where the cell has no words). Repeated rows get equal draws; a null doc_id draws
as the text ``null``. An empty table gives an empty result. Input columns with the names of outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.session import checkpoint

WORD = "[^\\x20\\x09-\\x0D]+"
MARGINS = ("source", "lang", "topic")
SWEEPS, SWEEPS_A_JOB, ALPHA, BUDGET = 12, 4, 0.7, 0.9


def topic_column(text: Column) -> Column:
    """A coarse topic from the form of a text, for tables without one."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(text.contains("License"), "licence")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 1000, "short")
        .when(F.length(text) < 4000, "medium")
        .otherwise("long")
    )


def draw_column(doc_id: Column) -> Column:
    """Uniform in [0, 1) from the document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def tempered_targets(cells: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The default targets: cells with each margin's share ``t_<margin>``, its token share to the power ``alpha``."""
    out = cells
    for m in MARGINS:
        own = F.sum("tokens").over(Window.partitionBy(m))
        size = out.withColumn("own", own).withColumn("one", F.count(F.lit(1)).over(Window.partitionBy(m)))
        share = F.when(F.col("own") > 0, F.pow(F.col("own"), F.lit(alpha))).otherwise(0.0)
        # one number a session needs: the sum over the margin's values
        total = size.agg(F.sum(share / F.col("one")).alias("s")).first()["s"] or 1.0
        out = size.withColumn(f"t_{m}", share / F.lit(total)).drop("own", "one")
    return out


def fit_cells(cells: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """Rake ``weight`` (from ``tokens``) to the shares ``t_<margin>`` of all tokens."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for k in range(sweeps):
        for m in MARGINS:
            own = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("own", own).withColumn("weight", F.when(F.col("own") > 0, F.col("weight") * F.col(f"t_{m}") * F.lit(float(total)) / F.col("own")).otherwise(0.0)).drop("own")
        if k % SWEEPS_A_JOB == SWEEPS_A_JOB - 1:
            out = checkpoint(out)
    return out


def keep_probabilities(cells: DataFrame, budget: float = BUDGET, rounds: int = 12) -> DataFrame:
    """Cells with ``factor`` and ``keep_prob``: expected kept tokens are ``budget`` of all (or all that can be kept)."""
    rated = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))
    rated = checkpoint(rated)
    c = 1.0
    want = None
    for _ in range(rounds):
        row = rated.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(F.col("factor") * c >= 1, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(F.col("factor") * c < 1, F.col("tokens") * F.col("factor")).otherwise(0.0)).alias("rest"),
        ).first()
        want = budget * (row["all"] or 0)
        if not row["rest"] or want <= row["full"]:
            break
        new = (want - row["full"]) / row["rest"]
        if abs(new - c) <= 1e-12 * c:
            break
        c = new
    return rated.withColumn("keep_prob", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") * F.lit(float(c)))).otherwise(1.0))


def repeat_rates(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with ``factor`` and ``keep_prob``, here expected copies: the kept tokens have the fitted margins, at ``budget`` of all.

    Raked weights may sum to less than all tokens where targets name values without any; ``c`` makes up for that."""
    rated = checkpoint(cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)))
    row = rated.agg(F.sum("tokens").alias("all"), F.sum("weight").alias("fitted")).first()
    c = budget * (row["all"] or 0) / (row["fitted"] or 1.0)
    return rated.withColumn("keep_prob", F.when(F.col("tokens") > 0, F.col("factor") * F.lit(float(c))).otherwise(1.0))


def mix(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, repeat: bool = False) -> DataFrame:
    """Every row of ``df`` with ``topic, n_tokens, factor, keep_prob, selected``; with ``repeat`` also ``copies``, and
    ``keep_prob`` is their expectation.

    ``targets`` gives shares by margin and value (values it leaves out get 0); a margin that it leaves out is tempered."""
    spark = df.sparkSession
    plain = df.drop("factor", "keep_prob", "selected", *(["copies"] if repeat else []))  # the other outputs are replaced in place, so ``topic`` may read a column of that name
    counted = plain.withColumn("topic", topic if topic is not None else topic_column(F.col(text))).withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(m) for c, m in ((source, "source"), (lang, "lang"), ("topic", "topic"))]
    cells = checkpoint(counted.select(*keys, "n_tokens").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    aimed = tempered_targets(cells)
    for m, shares in (targets or {}).items():
        total = float(sum(shares.values()))
        given = spark.createDataFrame([(str(k), float(v) / total) for k, v in shares.items()], f"{m} string, given double")
        aimed = aimed.join(given, m, "left").withColumn(f"t_{m}", F.coalesce("given", F.lit(0.0))).drop("given")
    fitted = (repeat_rates if repeat else keep_probabilities)(fit_cells(aimed), budget).select(*(F.col(m).alias(f"k_{m}") for m in MARGINS), "factor", "keep_prob")
    on = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) == F.col(f"k_{m}") for c, m in ((source, "source"), (lang, "lang"), ("topic", "topic"))]
    rated = (
        counted.join(fitted, on, "left")
        .drop(*(f"k_{m}" for m in MARGINS))
    )
    draw = draw_column(F.col(doc_id))
    if not repeat:
        return rated.withColumn("selected", draw < F.col("keep_prob"))
    whole = F.floor("keep_prob")
    return rated.withColumn("copies", (whole + (draw < F.col("keep_prob") - whole).cast("long")).cast("long")).withColumn("selected", F.col("copies") > 0)


def oracle_sql(sweeps: int = SWEEPS, alpha: float = ALPHA, budget: float = BUDGET, rounds: int = 12) -> str:
    """The same rows for ``documents`` in DuckDB SQL."""
    word = "[^\\x20\\x09-\\x0D]+"
    ctes = [
        "docs as materialized (select doc_id, source, lang, case when coalesce(length(text), 0) = 0 then 'empty' when contains(text, 'License') then 'licence' when contains(text, ' | ') then 'table'"
        " when length(text) < 1000 then 'short' when length(text) < 4000 then 'medium' else 'long' end as topic,"
        f" coalesce(len(regexp_extract_all(text, '{word}')), 0)::bigint as n_tokens from documents)",
        "cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from docs group by all)",
    ]
    for m in MARGINS:
        ctes.append(f"t_{m} as materialized (select {m}, pow(s, {alpha}) / sum(pow(s, {alpha})) over () as t from (select {m}, sum(tokens) as s from cells group by 1) where s > 0)")
    last, k = "cells", 0
    ctes.append("f0 as materialized (select *, tokens as weight from cells)")
    last = "f0"
    for _ in range(sweeps):
        for m in MARGINS:
            k += 1
            ctes.append(f"f{k} as materialized (select c.source, c.lang, c.topic, c.tokens, case when c.own > 0 then c.weight * coalesce(t.t, 0) * c.total / c.own else 0 end as weight from (select *, sum(weight) over (partition by {m}) as own, sum(tokens) over () as total from {last}) c left join t_{m} t on c.{m} is not distinct from t.{m})")
            last = f"f{k}"
    ctes.append(f"rated as materialized (select *, case when tokens > 0 then weight / tokens else 1 end as factor from {last})")
    ctes.append("c0 as materialized (select 1.0::double as c)")
    for r in range(1, rounds + 1):
        ctes.append(f"c{r} as materialized (select case when s.rest > 0 and {budget} * s.total > s.kept then ({budget} * s.total - s.kept) / s.rest else s.c end as c from (select any_value(c) as c, sum(tokens) as total, sum(case when factor * c >= 1 then tokens else 0 end) as kept, sum(case when factor * c < 1 then tokens * factor else 0 end) as rest from rated, c{r - 1}) s)")
    ctes.append(f"final as (select source, lang, topic, factor, case when tokens > 0 then least(1.0, factor * c) else 1 end as keep_prob from rated, c{rounds})")
    return (
        "with " + ",\n".join(ctes) + "\nselect d.doc_id, d.topic, d.n_tokens, round(f.factor, 6) as factor, round(f.keep_prob, 6) as keep_prob,"
        " ('0x' || substr(md5(d.doc_id::varchar), 1, 8))::bigint / 4294967296.0 < f.keep_prob as selected"
        " from docs d join final f on d.source is not distinct from f.source and d.lang is not distinct from f.lang and d.topic = f.topic"
    )
