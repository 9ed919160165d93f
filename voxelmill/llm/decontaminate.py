"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's words are the runs outside ``BREAKS`` after A-Z are lower-cased. Every window of ``window`` words holds
``window - gram + 1`` k-grams; the least of their hashes is its fingerprint, which follows from the window's words alone.
So a document and an item that share ``window`` or more words in a row share a fingerprint there: none can be missed, and
neighbouring windows mostly share theirs, so a document is known by about one hash in three words. An item of fewer words
is one window; its hash is looked for among the documents' word runs of its length (lengths that no item has cost nothing).

Three scans of the documents. The first joins runs of windows with one fingerprint against the items' distinct ones; no
text travels. The second takes the texts that met one, and extends each hit to the windows around it, whose words are
compared in full with the items' distinct windows; a window holds the ids of its items, so copies of an item, or a passage
of many, make no pairs. The third counts words and takes the result over. Small sides are broadcast after a count of their
bytes (``BROADCAST_BYTES``); beyond that the joins are shuffled ones, which adaptive execution splits at a hot key. A row is
known by a 128-bit digest of its id and text, so neither a null or repeated id nor a text in many copies is a hot key.

Null and empty texts have no words, no hits and are clean; so are all documents beside an empty benchmark; empty documents
give an empty result. Items without words have no window. Items are counted by distinct id; items without an id mark words
but are in neither ``items`` nor ``n_items``. Repeated rows are judged each. Further columns, also such that bear an
output's name, are left behind. A document's hits are gathered in its own row, as its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.session import materialize

WINDOW, GRAM, BROADCAST_BYTES = 10, 6, 32 << 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "array<struct<h: bigint, first: int, last: int, len: int>>"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def _upto(n: Column, make) -> Column:
    """``make(i)`` for i from 0 below ``n``."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make))


def _grams(hashes: Column, size: int) -> Column:
    """A hash of every ``size`` words in a row."""
    if size == 1:
        return F.transform(hashes, lambda h: F.xxhash64(F.lit(1), h))
    return _upto(F.size(hashes) - (size - 1), lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size))))


def with_runs(texts: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """``texts`` (column ``words``) with ``runs``: windows in a row with one fingerprint, and each run of words of the lengths ``short``.

    Every array is a column of its own that later ones name more than once, so that the optimizer keeps it; for the same
    reason rows are unfolded by ``explode_outer``, whose input the optimizer doesn't test once more below these columns."""
    out = texts.withColumn("_w", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_g", F.coalesce(_grams(F.col("_w"), gram), F.array().cast("array<bigint>")))
    wide = window - gram + 1
    least = lambda j: F.least(*(F.get("_g", j + k) for k in range(wide)))
    out = out.withColumn("_m", F.coalesce(_upto(F.size("words") - (window - 1), least), F.array().cast("array<bigint>")) if wide > 1 else F.col("_g"))
    out = out.withColumn("_s", F.filter(F.coalesce(_upto(F.size("_m"), lambda j: j), F.array().cast("array<int>")), lambda j: (j == 0) | (F.get("_m", j) != F.get("_m", j - 1))))
    runs = F.transform("_s", lambda s, i: F.struct(F.get("_m", s).alias("h"), s.alias("first"), (F.coalesce(F.get("_s", i + 1), F.size("_m")) - 1).alias("last"), F.lit(window).alias("len"))).cast(RUN)
    one = lambda size: F.coalesce(F.transform(_grams(F.col("_w"), size), lambda h, i: F.struct(h.alias("h"), i.alias("first"), i.alias("last"), F.lit(size).alias("len"))).cast(RUN), F.array().cast(RUN))
    return out.withColumn("runs", F.concat(runs, *(one(s) for s in short)) if short else runs).drop("_w", "_g", "_m", "_s")


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """A written table, to be broadcast where its bytes allow it."""
    return F.broadcast(df) if (df.agg(F.sum(size + 48)).first()[0] or 0) <= BROADCAST_BYTES else df


def find_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, spans`` (word places, end excluded, ascending and apart), ``items``
    (ids as strings, ascending) and ``contaminated``."""
    if not 0 < gram <= window:
        raise ValueError("a k-gram fits in a window")
    items = bench.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect())  # below ``window`` lengths
    length = F.least(F.size("words"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda j: F.array_join(F.slice("words", j + 1, length), " "))
    # a window's ids are gathered once for all documents
    wins = materialize(items.select("item", F.explode_outer(cut).alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("ids")), "decontam-windows")
    prints = with_runs(items, window, gram, short).select(F.size("words").alias("n"), F.explode_outer("runs").alias("r")).filter((F.col("r.len") == window) | (F.col("r.len") == F.col("n")))
    prints = materialize(prints.select("r.h", "r.len").distinct(), "decontam-prints")

    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("key")
    runs = with_runs(docs.select(key, words(F.col(text)).alias("words")), window, gram, short).select("key", F.explode_outer("runs").alias("r")).select("key", "r.h", "r.first", "r.last", "r.len")
    met = runs.join(_sized(prints, F.lit(16)), ["h", "len"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("first", "last", "len")).alias("runs"))
    met = materialize(met, "decontam-met")
    texts = docs.select(key, F.col(text).alias("text")).join(_sized(met, 40 + 12 * F.size("runs")), "key").select("key", words(F.col("text")).alias("words"), "runs")
    # ``words`` is named twice, so that it stays a column and isn't found again for every window
    around = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], F.least(r["last"], F.size("words"))), lambda j: F.struct(j.alias("at"), r["len"].alias("len"), F.array_join(F.slice("words", j + 1, r["len"]), " ").alias("win")))))
    found = texts.select("key", F.explode_outer(around).alias("o")).select("key", "o.at", "o.len", "o.win").join(_sized(wins, F.length("win") + 24 * F.size("ids")), "win")
    hits = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("at"), F.flatten(F.collect_set("ids")).alias("ids"))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("at", lambda h: F.sequence(h["at"], h["end"] - 1)))))
    hits = hits.withColumn("at", covered)
    starts = F.filter("at", lambda p, k: (k == 0) | (F.get("at", k - 1) != p - 1))
    ends = F.filter("at", lambda p, k: (k == F.size("at") - 1) | (F.get("at", k + 1) != p + 1))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    hits = materialize(hits.select("key", spans.alias("spans"), F.size("at").cast("long").alias("n_hit"), F.sort_array(F.array_distinct("ids")).alias("items")), "decontam-hits")
    out = docs.select(F.col(doc_id).alias("doc_id"), key, F.size(words(F.col(text))).cast("long").alias("n_words")).join(_sized(hits, 40 + 8 * F.size("spans") + 24 * F.size("items")), "key", "left")
    out = out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def digests(hits: DataFrame) -> DataFrame:
    """The report of ``find_hits`` with its items as a count and a digest."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def oracle_sql(window: int = WINDOW) -> str:
    """The query's rows in DuckDB SQL: every window of every document against every window of the items."""
    own = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(UPPER, LOWER)
    return (
        f"with d as materialized (select row_number() over () as r, doc_id, {own} as w from documents), i as materialized (select item_id, {own} as w from benchmark),"
        f" iw as materialized (select distinct item_id, least(len(w), {window}) as n, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') as win from i, unnest(range(1, len(w) - least(len(w), {window}) + 2)) t(s) where len(w) > 0),"
        " ns as (select distinct n from iw), o as materialized (select r, s, n, array_to_string(w[s:s + n - 1], ' ') as win from d, ns, unnest(range(1, len(w) - n + 2)) t(s)),"
        " m as materialized (select o.r, o.s, o.n, iw.item_id from o join iw using (n, win)),"
        " h as (select r, count(distinct p) as n_hit from m, unnest(range(s, s + n)) t(p) group by 1),"
        " c as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by 1)"
        " select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, h.r is not null as contaminated from d left join h using (r) left join c using (r)"
    )
