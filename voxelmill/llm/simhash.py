"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: ASCII lower case, words split at ASCII white space, three-word shingles with repeats, XXH64 with seed
42; a bit is set where it is set in over half of the hashes. No words give fingerprint zero, linked like any other.

Join: distinct fingerprints are dealt by pigeonhole (within ``distance`` bits, one of ``distance + 1`` blocks is
equal), each deal rotated so that the equal block leads: a subtree of the binary trie. In a subtree, pairs of nodes
are walked together from the root; each level adds the bits in which they differ, and a pair beyond the budget is
dropped with all below it. Subtrees above ``node_rows`` fingerprints are cut into parts and joined part by part, so no
task grows with a hot subtree. Links are contracted inside the task to spanning edges: all connections, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators.components import connected_components
from voxelmill.session import materialize, shuffle_partitions

SEED = 42
CHUNK, BUFFER, LEAF_PAIRS = 200_000, 200_000, 48


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text; null counts as no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        grams = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column) -> Column:
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())

    return simhash(text)


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair; the least member is the root."""

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    while len(i):
        a, b = root(i), root(j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(group: np.ndarray, value: np.ndarray, budget: int) -> np.ndarray:
    """Least linked index of each value, over links inside a group of at most ``budget`` differing bits.

    ``value`` (unsigned 64 bits) ascends within each group, so a trie node is a slice. The walk keeps arrays of node
    pairs at one depth, in chunks, depth first."""
    n = len(value)
    parent = np.arange(n)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    lo, hi = cut, np.r_[cut[1:], n] if n else cut
    many = hi - lo > 1
    ones: dict[int, np.ndarray] = {}
    stack = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > CHUNK:
            stack += [(depth, *(x[s : s + CHUNK] for x in (alo, ahi, blo, bhi, err))) for s in range(0, len(alo), CHUNK)]
            continue
        na, nb = ahi - alo, bhi - blo
        small = (na * nb <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            a0, b0, nbs, total = alo[small], blo[small], nb[small], (na * nb)[small]
            which = np.repeat(np.arange(len(total)), total)
            k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
            i, j = a0[which] + k // nbs[which], b0[which] + k % nbs[which]
            i, j = i[i != j], j[i != j]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            _union(parent, i[near], j[near])
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, err = (x[big] for x in (alo, ahi, blo, bhi, err))
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        c = ones[depth]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        children = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + np.int8(1)), (am[~same], ahi[~same], blo[~same], bm[~same], err[~same] + np.int8(1))]
        pairs = [np.concatenate(x) for x in zip(*children)]
        keep = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget)
        # a node with itself needs two members to hold a pair
        keep &= ~((pairs[0] == pairs[2]) & (pairs[1] - pairs[0] < 2))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in pairs)))
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _joined(budget: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(table: pa.Table) -> pa.RecordBatch:
            group, turned, own = (table[c].to_numpy() for c in ("grp", "turned", "fp"))
            parent = trie_links(group, turned.view(np.uint64) ^ np.uint64(1 << 63), budget)
            hung = np.flatnonzero(parent != np.arange(len(parent)))
            return pa.record_batch({"a": own[hung], "b": own[parent[hung]]})

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BUFFER:
                table = pa.Table.from_batches(held)
                group = table["grp"].to_numpy()
                at = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if at:
                    yield links(table.slice(0, at))
                held = table.slice(at).to_batches()
                rows = len(table) - at
        if rows:
            yield links(pa.Table.from_batches(held))

    return join


def hamming_edges(fingerprints: DataFrame, distance: int = 3, node_rows: int = 50_000) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``, long) that connect exactly what links of at most
    ``distance`` differing bits connect."""
    spark = fingerprints.sparkSession
    blocks = distance + 1
    width = 64 // blocks
    turns = [F.struct(F.lit(r).alias("turn"), (F.shiftleft("fp", r * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - r * width)) if r else F.col("fp")).alias("bits")) for r in range(blocks)]
    dealt = fingerprints.select("fp", F.explode(F.array(*turns)).alias("t")).select("fp", F.col("t.turn").alias("turn"), F.col("t.bits").alias("bits"), F.shiftrightunsigned("t.bits", 64 - width).alias("node"))
    hot = dealt.groupBy("turn", "node").count().filter(F.col("count") > node_rows).select("turn", "node", F.ceil(F.col("count") / node_rows).cast("int").alias("parts"))
    split = (
        dealt.join(hot, ["turn", "node"], "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .select("fp", F.col("bits").bitwiseXOR(F.lit(-(1 << 63))).alias("turned"), F.xxhash64("turn", "node", F.least("part", "other"), F.greatest("part", "other")).alias("grp"))
    )
    return split.repartition(shuffle_partitions(spark), "grp").sortWithinPartitions("grp", "turned").mapInArrow(_joined(distance), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp`` (signed long) and ``component_id``, the smallest doc_id that links reach.

    Null and empty texts share fingerprint zero. Repeated rows and doc_ids give repeated rows; a null doc_id takes the
    component of its fingerprint and never names one. An empty table gives an empty result. Other columns are ignored."""
    marked = materialize(df.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp")), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(hamming_edges(distinct.select("fp"), distance))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    classes = materialize(classes, "simhash-classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = classes.join(named, "root").select("fp", "component_id")
    return marked.join(members, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """Rows of ``df`` without the near-duplicates: the document that names its component stays. Rows with a null
    doc_id stay; of repeated rows with one doc_id each stays."""
    found = near_duplicates(df, doc_id, text, distance)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return df.join(gone, doc_id, "left_anti").select(*df.columns)
