"""Merkle manifest of a dataset: a tree of SHA-256 digests over its rows, proofs for every row, and folding.

A row's leaf is the digest of its fields. Per group (``lang``), leaves ascend by id; every ``FAN`` neighbours become their
digest, level by level, until one is left, the group's subroot; subroots, by group, become the root in the same way.

Rows (ids and two digests, no texts) are sorted by range over (group, id, leaf, place in the input) and written with their
place in their partition; the partitions' sizes give every row its number within its group, whatever the group's size. Then
blocks of ``BLOCK`` neighbours, ``STEP`` levels of the tree, are one task's group each; their tops are the next round's
leaves, so rounds grow with the logarithm and a group's rows are dealt to as many blocks as it has. Each round's nodes are
written. Going down, a block hands its children the siblings on their way up, a row a block, so a proof's upper part
travels once for a whole block.

In a block, a parent keeps a copy of its hash state from before each child slot. Folding a replaced child takes up the state before its
slot, adds the replacement and the siblings to its right, and does so again a level up; siblings to the left are never
hashed again. Above the block the state before the block's own slot is made once for all its rows.

Null fields are written ``-``; a null id comes first in its group, a null group is one of its own and comes first; empty and
very long texts are hashed whole by Spark. Repeated rows are leaves of their own; rows with the same id follow by their leaf's
digest, and equal ones take neighbouring places in either order. An empty table gives an empty result. Further columns are
left behind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm.decontaminate import LOWER, UPPER
from voxelmill.session import materialize

FAN, STEP = 8, 3
BLOCK = FAN**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    word = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(word).cast("string"), F.lit(":"), word), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def tampered_text(text: Column, doc_id: Column) -> Column:
    """Texts with A-Z lower-cased where 3 divides the CRC-32 of the id in decimal."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their number (from 0) within ``group`` by ``order``, and ``n``, the group's size."""
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the low 33 bits count the rows of a partition
    kept = materialize(ranged.drop("_tie").select("*", F.spark_partition_id().alias("_part"), within.alias("_at")), "merkle-sorted")
    own = kept.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row a partition, and one more for each group
    by = Window.partitionBy(group)
    own = own.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(by).alias("n"))
    own = materialize(own, "merkle-offsets")
    if own.count() <= 1_000_000:  # about 40 bytes each
        own = F.broadcast(own)
    return kept.join(own, (kept["_part"] == own["_p"]) & kept[group].eqNullSafe(own["_group"])).withColumn("at", F.col("_at") + F.col("_start")).drop("_part", "_at", "_p", "_start", "_group")


def _levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


class Tree:
    """The levels of a block. Each parent keeps a copy of its hash state from before every child slot."""

    def __init__(self, leaves: list[str], levels: int) -> None:
        self.nodes, self.states = [leaves], []
        for _ in range(levels):
            below, above, states = self.nodes[-1], [], []
            for a in range(0, len(below), FAN):
                h = hashlib.sha256()
                for child in below[a : a + FAN]:
                    states.append(h.copy())
                    h.update(child.encode())
                above.append(h.hexdigest())
            self.nodes.append(above)
            self.states.append(states)

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Digests to the left and to the right of a leaf's way up, level by level."""
        out = []
        for nodes in self.nodes[:-1]:
            a = at - at % FAN
            out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + FAN])))
            at //= FAN
        return out

    def fold(self, at: int, value: str, rights: list[bytes]) -> str:
        """The block's top with another digest at a leaf."""
        for states, right in zip(self.states, rights):
            h = states[at].copy()
            h.update(value.encode())
            h.update(right)
            value, at = h.hexdigest(), at // FAN
        return value


def _tops(nodes: DataFrame, group: str, depth: int) -> DataFrame:
    """The nodes ``STEP`` levels up: ``group, at, h, n`` from such rows. ``depth`` levels are done already."""

    def walk(table: pa.Table) -> pa.Table:
        own = table.sort_by("at")
        levels = min(STEP, _levels(own["n"][0].as_py()) - depth)
        top = Tree(own["h"].to_pylist(), levels).nodes[-1][0]
        return pa.table({group: own[group].slice(0, 1), "at": pa.array([own["at"][0].as_py() // BLOCK]), "h": [top], "n": own["n"].slice(0, 1)}, schema=pa.schema([own.schema.field(group), ("at", pa.int64()), ("h", pa.string()), ("n", pa.int64())]))

    return nodes.groupBy(group, F.expr(f"at div {BLOCK}").alias("_block")).applyInArrow(walk, nodes.select(group, "at", "h", "n").schema)


PATH = "array<struct<left: string, right: string>>"


def _ways(nodes: DataFrame, above: DataFrame, group: str, depth: int) -> DataFrame:
    """``group, at, way`` for every node: the siblings up to the root, from those of the blocks' tops (``above``)."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def walk(key: tuple, table: pa.Table, top: pa.Table) -> pa.Table:
        own = table.sort_by("at")
        tree = Tree(own["h"].to_pylist(), min(STEP, _levels(own["n"][0].as_py()) - depth))
        upper = top["way"][0].as_py()
        ways = [[{"left": a, "right": b} for a, b in tree.siblings(k)] + upper for k in range(len(own))]
        return pa.table({group: own[group], "at": own["at"], "way": pa.array(ways, kind)})

    block = F.expr(f"at div {BLOCK}").alias("_block")
    own, up = nodes.select(group, "at", "h", "n").groupBy(group, block), above.select(group, F.col("at").alias("_up"), "way").groupBy(group, F.col("_up").alias("_block"))
    return own.cogroup(up).applyInArrow(walk, f"{group} {dict(nodes.dtypes)[group]}, at long, way {PATH}")


def _climb(leaves: DataFrame, group: str) -> list[DataFrame]:
    """The nodes of every round: the leaves, then the tops of blocks, until each group has one."""
    rounds, most = [leaves], _levels(leaves.agg(F.max("n")).first()[0] or 0)
    for depth in range(0, most, STEP):
        # groups that are done keep their one node: a block of no further level
        rounds.append(materialize(_tops(rounds[-1], group, depth), "merkle-tops"))
    return rounds


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None, text: str = "text") -> DataFrame:
    """A row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``changed`` is the text that is held against the manifest (default: ``tampered_text``): its leaf is folded with the
    manifest's siblings, and ``verified`` tells whether that gives the root."""
    new = tampered_text(F.col(text), F.col(doc_id)) if changed is None else changed
    other = leaf([new if c == text else F.col(c) for c in fields])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("grp"), leaf([F.col(c) for c in fields]).alias("h"), other.alias("new"))
    rows = materialize(numbered(rows, "grp", ["doc_id", "h"]), "merkle-leaves")
    below = _climb(rows.select("grp", "at", "h", "n"), "grp")
    subroots = below[-1].select(F.lit(0).alias("all"), "grp", "h")
    tops = materialize(numbered(subroots, "all", ["grp"]), "merkle-subroots")
    above = _climb(tops.select("all", "at", "h", "n"), "all")
    root = above[-1].select("h").first()
    root = root["h"] if root else None

    way = above[-1].select("all", "at", F.array().cast(PATH).alias("way"))
    for depth, nodes in reversed(list(enumerate(above[:-1]))):
        way = _ways(nodes, way, "all", depth * STEP)
    way = tops.join(way, ["all", "at"]).select("grp", F.lit(0).cast("long").alias("at"), "way", F.col("h").alias("subroot"))
    subs = materialize(way, "merkle-ways")
    way = subs.select("grp", "at", "way")
    for depth, nodes in reversed(list(enumerate(below[1:-1], 1))):
        way = materialize(_ways(nodes, way, "grp", depth * STEP), "merkle-ways")
    # without a level between, the leaves' blocks are the groups themselves
    up = way.join(subs.select(F.col("grp").alias("_g"), "subroot"), F.col("grp").eqNullSafe(F.col("_g"))).select("grp", F.col("at").alias("_up"), "way", "subroot")

    def prove(key: tuple, table: pa.Table, top: pa.Table) -> pa.Table:
        own = table.sort_by("at")
        tree = Tree(own["h"].to_pylist(), min(STEP, _levels(own["n"][0].as_py())))
        upper = top["way"][0].as_py()
        tail = "".join(p["left"] + p["right"] for p in upper).encode()
        starts = [hashlib.sha256(p["left"].encode()) for p in upper]
        proofs, folded = [], []
        for k, new in enumerate(own["new"].to_pylist()):
            own_way = tree.siblings(k)
            h = hashlib.sha256("".join(a + b for a, b in own_way).encode())
            h.update(tail)
            proofs.append(h.hexdigest())
            value = tree.fold(k, new, [b.encode() for _, b in own_way])
            for start, p in zip(starts, upper):
                state = start.copy()
                state.update(value.encode())
                state.update(p["right"].encode())
                value = state.hexdigest()
            folded.append(value)
        return pa.table({"doc_id": own["doc_id"], "leaf": own["h"], "subroot": pa.array([top["subroot"][0].as_py()] * len(own), pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    block = F.expr(f"at div {BLOCK}").alias("_block")
    pairs = rows.groupBy("grp", block).cogroup(up.groupBy("grp", F.col("_up").alias("_block")))
    out = pairs.applyInArrow(prove, f"doc_id {dict(rows.dtypes)['doc_id']}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL: the tree by recursion over levels, the fold by recursion over each row's way."""
    put = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    h = lambda text: "sha256(" + " || ".join(put(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(encode_list, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384::ubigint * (xor(c, e) & 1::ubigint))), 4294967295::ubigint)"
    crc = crc.replace("encode_list", "list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::ubigint)").replace("[b, 0, 0, 0, 0, 0, 0, 0]", "[b, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]")
    fold = "sha256(coalesce(l, '') || v || coalesce(r, ''))"
    return (
        f"with recursive d as materialized (select *, case when {crc} % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end as other from documents),"
        f" lf as materialized (select doc_id, lang, {h('text')} as h, {h('other')} as new from d),"
        " ls as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as i, count(*) over (partition by lang) as n, row_number() over () as id from lf),"
        " t(lang, lv, i, h, n) as (select lang, 0, i, h, n from ls union all select lang, lv + 1, i // 8, sha256(string_agg(h, '' order by i)), any_value((n + 7) // 8) from t where n > 1 group by lang, lv, i // 8),"
        " sub as materialized (select lang, h as subroot, lv as top, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t where n = 1),"
        " u(lv, i, h, n) as (select 0, i, subroot, n from sub union all select lv + 1, i // 8, sha256(string_agg(h, '' order by i)), any_value((n + 7) // 8) from u where n > 1 group by lv, i // 8),"
        # a node's siblings: those before and after it in its run
        " sb as materialized (select lang, lv, i, string_agg(h, '') over (partition by lang, lv, i // 8 order by i rows between unbounded preceding and 1 preceding) as l, string_agg(h, '') over (partition by lang, lv, i // 8 order by i rows between 1 following and unbounded following) as r from t where n > 1),"
        " ub as materialized (select lv, i, string_agg(h, '') over (partition by lv, i // 8 order by i rows between unbounded preceding and 1 preceding) as l, string_agg(h, '') over (partition by lv, i // 8 order by i rows between 1 following and unbounded following) as r from u where n > 1),"
        " w(id, lang, lv, i, v, p) as (select id, lang, 0, i, new, '' from ls union all"
        f" select id, w.lang, w.lv + 1, w.i // 8, {fold}, p || coalesce(l, '') || coalesce(r, '') from w join sb on sb.lang is not distinct from w.lang and sb.lv = w.lv and sb.i = w.i),"
        " e as materialized (select w.id, sub.i, v, p, subroot from w join sub on sub.lang is not distinct from w.lang and sub.top = w.lv),"
        " x(id, lv, i, v, p) as (select id, 0, i, v, p from e union all"
        f" select id, x.lv + 1, x.i // 8, {fold}, p || coalesce(l, '') || coalesce(r, '') from x join ub on ub.lv = x.lv and ub.i = x.i),"
        " rt as (select h as root, lv as top from u where n = 1)"
        " select doc_id, ls.h as leaf, subroot, root, sha256(x.p) as proof_sha256, x.v as folded_root, x.v = root as verified from x join rt on x.lv = rt.top join e using (id) join ls using (id)"
    )
