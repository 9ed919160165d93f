"""Embedding near-duplicates over robust-pruned flat graphs.

Equal vectors of a label are first counted into one node. Nodes go to the shard of their nearest centre and to every
shard whose border is within half the search angle: the middle of two linked nodes lies in some shard and is within half
the angle of both, so both are members of that shard. Where they share several, the least numbered one counts the link. A
shard above ``SHARD_ROWS`` nodes is cut into parts; each task holds the nodes of one part that ask and of one part that
may answer, so tasks stay bounded and no pair is lost.

In a task, candidates (all within the range, and the nearest) are pruned robustly: a candidate goes if a kept one is
nearer to it by the factor ``ALPHA`` than the node is. Adjacency lists of all tasks are united. Each asking node walks
greedily from its task's medoid, then expands from what it reached and from its own place through nodes within twice the
range. From a node, every chain of pruned candidates comes nearer to a linked node with each step and stays in that
ball, so the expansion finds all links inside a task. An audit holds a sample of nodes against brute force and raises
below ``MIN_RECALL``; every link is verified by its cosine in double precision.

Links are counted and contracted to spanning edges inside the task; no list of pairs is made.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing.
Vectors of different lengths never link. Repeated rows are vectors of their own. A null vec_id never names a component
(a component of such rows alone has a null id). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.simhash import _union
from voxelmill.llm.topk import usable
from voxelmill.operators.components import connected_components
from voxelmill.session import materialize

SHARD_ROWS, MAX_CENTRES, SAMPLE_ROWS, NEAREST, ALPHA, MIN_RECALL, AUDIT_ROWS = 6000, 4096, 65_536, 12, 1.1, 0.9, 20
MEMBERS = "shard int, node long, homes binary, unit binary"


def centres(sample: list[tuple[str, np.ndarray]], nodes: int, shard_rows: int = SHARD_ROWS, rounds: int = 6) -> dict[str, np.ndarray]:
    """Unit centres by group (label and length), from a bounded sample; at most ``MAX_CENTRES`` beyond one a group."""
    by: dict[str, list[np.ndarray]] = {}
    for g, v in sample:
        by.setdefault(g, []).append(v)
    out = {}
    for g, vs in sorted(by.items()):
        x = np.array(sorted(map(tuple, vs)))
        share = len(x) / max(1, len(sample))
        k = int(max(1, min(np.ceil(nodes * share / shard_rows), MAX_CENTRES * share, len(x))))
        c = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
            for j in range(k):
                own = x[near == j]
                if len(own) and (norm := np.linalg.norm(s := own.sum(0))) > 0:
                    c[j] = s / norm
        out[g] = np.unique(c, axis=0)
    return out


def _members(shared, cosine: float):
    """Deal nodes to their own shard and to shards whose border is within half the angle; ``homes`` lists them all."""
    reach = float(np.sqrt((1 - cosine) / 2)) + 1e-9

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = {}, 0
        for g, c in shared.value.items():
            table[g] = (c, first)
            first += len(c)
        for batch in batches:
            out = {"shard": [], "node": [], "homes": [], "unit": []}
            for g, node, unit in zip(batch["grp"].to_pylist(), batch["node"].to_pylist(), batch["unit"].to_pylist()):
                x = np.frombuffer(unit, "<f8")
                if g not in table:  # a group that the sample missed has a shard of its own
                    homes = np.array([-1 - (hash_of(g) % (1 << 30))])
                else:
                    c, base = table[g]
                    s = c @ x
                    own = int(s.argmax())
                    homes = base + np.flatnonzero(s[own] - s <= reach * np.linalg.norm(c - c[own], axis=1) + 1e-12)
                packed = homes.astype("<i4").tobytes()
                for shard in homes.tolist():
                    for name, v in zip(out, (shard, node, packed, unit)):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("node", pa.int64()), ("homes", pa.binary()), ("unit", pa.binary())]))

    return deal


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text)


def robust_prune(x: np.ndarray, cosine: float, alpha: float = ALPHA, nearest: int = NEAREST) -> list[np.ndarray]:
    """Adjacency lists over unit rows: candidates are all rows within the range and the nearest."""
    n, out = len(x), []
    for at in range(0, n, 256):
        s = x[at : at + 256] @ x.T
        for k, row in enumerate(s):
            p = at + k
            cand = np.flatnonzero(row >= cosine - 1e-9)
            if n - 1 > len(cand):
                top = np.argpartition(-row, min(nearest, n - 1))[: nearest + 1]
                cand = np.union1d(cand, top)
            cand = cand[cand != p]
            far = np.sqrt(np.maximum(0, 2 - 2 * row[cand]))
            order = np.argsort(far, kind="stable")
            cand, far = cand[order], far[order]
            kept = []
            while len(cand):
                r = cand[0]
                kept.append(r)
                between = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[r])))
                stay = alpha * between >= far
                stay[0] = False
                cand, far = cand[stay], far[stay]
            out.append(np.array(kept, np.int64))
    return out


def _neighbours(ptr: np.ndarray, adj: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``nodes``, its neighbours: positions and neighbours."""
    n = ptr[nodes + 1] - ptr[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    return which, adj[np.repeat(ptr[nodes] - (np.cumsum(n) - n), n) + np.arange(len(which))]


def range_search(x: np.ndarray, ptr: np.ndarray, adj: np.ndarray, asking: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking row, row) of at least ``cosine``, slice by slice of the asking rows."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    # within twice the chord of the range
    ball = 1 - 0.5 * (2 * np.sqrt(2 - 2 * cosine) + 1e-9) ** 2
    for at in range(0, len(asking), 256):
        q = asking[at : at + 256]
        place, score = np.full(len(q), medoid), x[q] @ x[medoid]
        moving = np.arange(len(q))
        while len(moving):
            which, to = _neighbours(ptr, adj, place[moving])
            s = np.einsum("ij,ij->i", x[q[moving[which]]], x[to])
            best = np.full(len(moving), -2.0)
            np.maximum.at(best, which, s)
            better = best > score[moving]
            hit = better[which] & (s == best[which])
            place[moving[which[hit]]] = to[hit]
            score[moving[better]] = best[better]
            moving = moving[better]
        seen = np.unique(np.concatenate([np.arange(len(q)) * n + q, np.arange(len(q)) * n + place]))
        edge, found = seen, []
        while len(edge):
            k, node = edge // n, edge % n
            s = np.einsum("ij,ij->i", x[q[k]], x[node])
            found.append(edge[s >= cosine])
            inside = s >= ball
            which, to = _neighbours(ptr, adj, node[inside])
            edge = np.unique(k[inside][which] * n + to)
            edge = edge[~np.isin(edge, seen, assume_unique=True)]
            seen = np.union1d(seen, edge)
        code = np.unique(np.concatenate(found))
        a, b = q[code // n], code % n
        yield a[a != b], b[a != b]


def _build(cosine: float):
    def build(members: pa.Table) -> pa.Table:
        """Edges of a task's graph, between nodes."""
        node = members["node"].to_numpy()
        node, at = np.unique(node, return_index=True)
        x = np.stack([np.frombuffer(b.as_buffer(), "<f8") for b in members["unit"].take(pa.array(at))])
        lists = robust_prune(x, cosine)
        return pa.table({"node": np.repeat(node, list(map(len, lists))), "to": node[np.concatenate(lists)] if lists else node[:0]})

    return build


class _Duty:
    """Which pairs of a shard's nodes it counts: those that share no shard of a lesser number."""

    def __init__(self, shard: int, homes: list[bytes]):
        lists = [np.frombuffer(h, "<i4") for h in homes]
        size = np.array([len(h) for h in lists])
        self.several = size > 1  # other nodes are here alone
        flat = np.concatenate(lists)
        lesser, column = np.unique(flat[flat < shard], return_inverse=True)
        self.held = np.zeros((len(lists), (len(lesser) + 7) // 8), np.uint8)
        np.bitwise_or.at(self.held, (np.repeat(np.arange(len(lists)), size)[flat < shard], column // 8), (1 << column % 8).astype(np.uint8))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        both = np.flatnonzero(self.several[i] & self.several[j]) if self.held.shape[1] else np.zeros(0, np.int64)
        for at in range(0, len(both), 1 << 16):
            k = both[at : at + (1 << 16)]
            out[k] = ~(self.held[i[k]] & self.held[j[k]]).any(1)
        return out


def _search(cosine: float, audit_rows: int):
    def search(key, members: pa.Table, edges: pa.Table) -> pa.Table:
        """Per asking node: its links to answering nodes (weighted), and spanning edges of what was linked."""
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(members):
            return empty
        raw = members["node"].to_numpy()
        node, at, inverse = np.unique(raw, return_index=True, return_inverse=True)
        asks, answers = np.zeros(len(node), bool), np.zeros(len(node), bool)
        np.logical_or.at(asks, inverse, members["asks"].to_numpy(zero_copy_only=False))
        np.logical_or.at(answers, inverse, members["answers"].to_numpy(zero_copy_only=False))
        weight = members["n"].to_numpy()[at]
        duty = _Duty(members["shard"][0].as_py(), members["homes"].take(pa.array(at)).to_pylist())
        x = np.stack([np.frombuffer(b.as_buffer(), "<f8") for b in members["unit"].take(pa.array(at))])
        a, b = edges["src"].to_numpy(), edges["to"].to_numpy()
        ia, ib = np.minimum(np.searchsorted(node, a), len(node) - 1), np.minimum(np.searchsorted(node, b), len(node) - 1)
        own = (node[ia] == a) & (node[ib] == b)
        code = np.unique(ia[own] * len(node) + ib[own])
        adj = code % len(node)
        ptr = np.searchsorted(code // len(node), np.arange(len(node) + 1))
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in range_search(x, ptr, adj, np.flatnonzero(asks), cosine):
            keep = answers[j]
            keep[keep] = duty.of(i[keep], j[keep])
            np.add.at(links, i[keep], weight[j[keep]])
            _union(parent, i[keep], j[keep])
        sample = np.flatnonzero(asks)[:: max(1, int(asks.sum()) // audit_rows)]
        near = (x[sample] @ x.T >= cosine + 1e-12) & answers[None]
        near[np.arange(len(sample)), sample] = False
        row, other = np.nonzero(near)
        near[row, other] = duty.of(sample[row], other)
        exact = (near * weight[None]).sum()
        if exact and links[sample].sum() < MIN_RECALL * exact:
            raise RuntimeError(f"recall {links[sample].sum() / exact:.3f} in task {key}")
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        rows = np.flatnonzero(asks | (parent != np.arange(len(node))))
        return pa.table({"node": node[rows], "links": np.where(asks, links, 0)[rows], "root": node[parent[rows]]})

    return search


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", cosine: float = 0.98, shard_rows: int = SHARD_ROWS, audit_rows: int = AUDIT_ROWS) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    ok = F.coalesce(F.col("label").isNotNull() & usable(F.col("vec")) & F.exists("vec", lambda x: x != 0), F.lit(False))
    whole = rows.withColumn("ok", ok)
    valid = whole.filter("ok").select("id", "label", "vec")
    keyed = valid.withColumn("grp", F.concat_ws("/", F.col("label").cast("string"), F.size("vec").cast("string")))
    nodes = keyed.groupBy("grp", "label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())

    def to_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [np.array(v, np.float64) for v in b["vec"].to_pylist()]
            vs = [v / np.abs(v).max() for v in vs]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names), pa.array([(v / np.linalg.norm(v)).astype("<f8").tobytes() for v in vs], pa.binary())], [*b.schema.names, "unit"])

    kind = dict(nodes.dtypes)
    nodes = materialize(nodes.mapInArrow(to_unit, ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", unit binary"), "ann-nodes")
    total = nodes.count()
    sample = [(r.grp, np.frombuffer(bytes(r.unit), "<f8")) for r in nodes.select("grp", "unit", "node").orderBy(F.xxhash64("grp", "unit"), "node").limit(SAMPLE_ROWS).select("grp", "unit").collect()]
    shared = spark.sparkContext.broadcast(centres(sample, total, shard_rows))
    members = materialize(nodes.select("grp", "node", "unit").mapInArrow(_members(shared, cosine), MEMBERS).join(nodes.select("node", "n"), "node"), "ann-members")
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    placed = members.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    kept = ("node", "unit", "homes", "n")
    asking = placed.select("shard", F.col("part").alias("i"), other, *kept).withColumnRenamed("other", "j").withColumns({"asks": F.lit(True), "answers": F.lit(False)})
    answering = placed.select("shard", F.col("part").alias("j"), other, *kept).withColumnRenamed("other", "i").withColumns({"asks": F.lit(False), "answers": F.lit(True)})
    # a part that asks itself is sent once
    once = asking.unionByName(answering).filter("asks or i <> j").withColumn("answers", F.col("answers") | (F.col("i") == F.col("j")))
    dealt = materialize(once.withColumn("task", F.xxhash64("shard", "i", "j")).select("task", "shard", *kept, "asks", "answers").repartition("task"), "ann-tasks")
    graph = materialize(dealt.groupBy("task").applyInArrow(_build(cosine), "node long, to long").distinct(), "ann-graph")
    placed_at = dealt.select(F.col("task").alias("at"), F.col("node").alias("member")).distinct()
    routed = placed_at.join(graph, F.col("member") == F.col("node")).select("at", F.col("member").alias("src"), "to")
    found = materialize(dealt.groupBy("task").cogroup(routed.groupBy("at")).applyInArrow(_search(cosine, audit_rows), "node long, links long, root long"), "ann-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.select("node", "least", "n").join(links, "node", "left").join(roots, "node", "left").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    classes = materialize(classes, "ann-classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = classes.join(named, "root").select("node", "n_links", "component_id").join(nodes.select("node", "label", "vec"), "node").drop("node")
    linked = valid.join(by_node, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = whole.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle_sql(cosine: float = 0.98) -> str:
    """The query's rows in DuckDB SQL; components by a recursive walk."""
    return (
        "with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0"
        " and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),"
        f" l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {cosine}),"
        " r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),"
        " n as (select a, count(*) as n from l group by a)"
        " select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e join (select a, min(b) as component_id from r group by a) c on c.a = e.vec_id left join n on n.a = e.vec_id"
    )
