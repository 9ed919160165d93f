"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their beginnings of ``PREFIXES`` characters (inflected forms share one),
hashed to ``SLOTS`` places. A text is the set of its places. The machine adds a bias, a weight for each place and, for
each two places, the product of their factor vectors: an insult may weigh more, or less, beside another word. A place
is in the machine where it stands in ``MIN_TEXTS`` training texts and its log-likelihood ratio to the labels reaches
``MIN_EVIDENCE``, or where a pair makes texts toxic that neither of its places does (``pair_places``), or takes away the
toxicity of a place (``soothing_places``): a word that tells nothing alone may weigh beside another. Other places have no
weight and no factors, so the many unrelated words of a long text add nothing.

Training: stochastic gradients with per-place step sizes on at most ``MAX_ROWS`` labelled texts, the first in the order
of a hash of their doc_id (the bound is for the driver's memory; scoring covers every text). Places are counted on
Spark first; those that can't come into the machine, most of them, stay with the tasks. Nothing but the text enters
a score. Without labels of both kinds the score is the share of toxic labels (0 without any).

Null and empty texts have no terms and get the score of the bias. Repeated rows get equal scores; labels that are
null, or contradict each other for one doc_id, are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.session import materialize

SLOTS, PREFIXES, STEM, MIN_TEXTS, MAX_ROWS, FACTORS, MIN_EVIDENCE = 1 << 20, (4, 5, 6), 5, 3, 12_000, 8, 8.0
TABLE_WORDS = 300_000
_WORDS = re.compile(r"\w+").findall


def word_slots(word: str) -> list[int]:
    """Places of a word and of its beginnings. One of them is even, that of the ``STEM`` or the shorter word; others are odd."""
    raw = [f"w {word}", *(f"p{k} {word[:k]}" for k in PREFIXES if len(word) >= k)]
    stem = f"p{STEM} {word[:STEM]}" if len(word) >= STEM else raw[0]
    return [xxhash.xxh32_intdigest(x.encode()) % SLOTS & ~1 | (x != stem) for x in raw]


class _Table(dict):
    """Packed places of words, in a bounded table. ``slot_of`` maps places to a model's, -1 where it has none."""

    def __init__(self, slot_of: np.ndarray | None = None):
        super().__init__()
        self.slot_of = slot_of

    def __missing__(self, word: str) -> bytes:
        slots = np.array(word_slots(word), np.int32)
        if self.slot_of is not None:
            slots = self.slot_of[slots]
            slots = slots[slots >= 0]
        packed = slots.astype("<i4").tobytes()
        if len(self) >= TABLE_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = packed
        return packed

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(_WORDS((text or "").lower())))), "<i4"))


@dataclass(frozen=True)
class Machine:
    slot_of: np.ndarray  # a place's row in weight and factor, or -1
    weight: np.ndarray
    factor: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, rows: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        v = self.factor[rows]
        s = v.sum(axis=0)
        z = self.bias + self.weight[rows].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _evidence(k: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of a place's texts (``n``, ``k`` of them toxic) against the other texts."""

    def part(a, b):
        return np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(b, 1e-9)), 0.0)

    share = toxic / total
    rest, rest_k = total - n, toxic - k
    return 2 * (part(k, n * share) + part(n - k, n * (1 - share)) + part(rest_k, rest * share) + part(rest - rest_k, rest * (1 - share)))


def pair_places(texts: list[np.ndarray], labels: np.ndarray, used: np.ndarray, n: np.ndarray, toxic: np.ndarray, block: int = 64) -> np.ndarray:
    """Rows of ``used`` (counts ``n``, ``toxic``) in pairs whose texts are toxic beyond those of either place.

    A word has one place in the search, the even one. Every two that share ``MIN_TEXTS`` toxic texts are tried. The evidence of a pair is the lesser of two ratios,
    each within the texts of one of its places; it must reach ``MIN_EVIDENCE`` raised for the number of pairs. Places
    that couldn't reach it with any other, as even their toxic texts alone wouldn't, are left out before the search."""
    able = np.flatnonzero((toxic >= MIN_TEXTS) & (used % 2 == 0))
    m = len(able)
    if m < 2:
        return able[:0]
    limit = MIN_EVIDENCE + 2 * np.log(m * (m - 1) / 2)
    able = able[_evidence(toxic[able], toxic[able], toxic[able], n[able]) >= limit]
    m = len(able)
    spot = np.full(SLOTS, -1, np.int32)
    spot[used[able]] = np.arange(m, dtype=np.int32)
    bits, held = np.zeros((m, (len(texts) + 7) // 8), np.uint8), np.zeros((m, int(labels.sum())), np.float32)  # a bounded number of texts
    bad = 0
    for i, (t, y) in enumerate(zip(texts, labels)):
        at = spot[t]
        at = at[at >= 0]
        bits[at, i // 8] |= np.uint8(1 << i % 8)
        if y:
            held[at, bad] = 1
            bad += 1
    na, ka, chosen = n[able].astype(float), toxic[able].astype(float), np.zeros(m, bool)
    # a pair's texts are at least its toxic ones, and with no others its evidence is greatest: each place needs so many
    low, need = np.zeros(m), ka.copy()
    while (need - low > 1).any():
        k = np.floor((low + need) / 2)
        enough = _evidence(k, k, ka, na) >= limit
        low, need = np.where(enough, low, k), np.where(enough, k, need)
    need = np.maximum(need, MIN_TEXTS).astype(np.float32)

    def least(k, n, i, j):
        return np.minimum(*(np.where(k * na[x] > n * ka[x], _evidence(k, n, ka[x], na[x]), 0.0) for x in (i, j)))

    # pairs with the same texts as one of their places tell nothing that it doesn't tell alone
    for a in range(0, m, block):
        k = held[a : a + block] @ held[a:].T
        i, j = np.nonzero(k >= np.maximum(need[a : a + block, None], need[a:]))
        i, j, k = (x[i < j] for x in (i, j, k[i, j]))
        i, j = i + a, j + a
        for c in range(0, len(i), 8_000):
            p, q = i[c : c + 8_000], j[c : c + 8_000]
            both = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64).astype(float)
            good = least(k[c : c + 8_000], both, p, q) >= limit
            chosen[p[good]] = chosen[q[good]] = True
    return able[chosen]


def soothing_places(texts: list[np.ndarray], labels: np.ndarray, used: np.ndarray, n: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Rows of ``used`` beside which a place of ``hot`` (rows of toxic evidence) is toxic less often than elsewhere.

    A word has one place in the search, the even one, on either side. Every two that share ``MIN_TEXTS`` texts are tried;
    the evidence is that of their texts within the hot place's, raised for the number of pairs. Places in every text of
    the hot place tell nothing."""
    hot = hot[used[hot] % 2 == 0]
    able = np.flatnonzero((n >= MIN_TEXTS) & (used % 2 == 0))
    if not len(hot) or not len(able):
        return able[:0]
    limit = MIN_EVIDENCE + 2 * np.log(max(1, len(hot) * len(able)))
    row_of = np.full(SLOTS, -1, np.int32)
    row_of[used] = np.arange(len(used), dtype=np.int32)
    hot_row = np.zeros(len(used), bool)
    hot_row[hot] = True
    rows = [row_of[t[t % 2 == 0]] for t in texts]
    holders: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for h in r[hot_row[r]].tolist():
            holders.setdefault(h, []).append(i)
    chosen = np.zeros(len(used), bool)
    for h, at in holders.items():
        y = labels[at] > 0
        size, toxic = len(at), int(y.sum())
        if not 0 < toxic < size:  # one kind of texts alone: no place tells them apart
            continue
        flat, bad = np.concatenate([rows[i] for i in at]), np.repeat(y, [len(rows[i]) for i in at])
        both, k = np.bincount(flat, minlength=len(used)), np.bincount(flat[bad], minlength=len(used))
        tried = np.flatnonzero((both >= MIN_TEXTS) & (both < size) & (k * size < both * toxic))
        chosen[tried[_evidence(k[tried], both[tried], toxic, size) >= limit]] = True
    return np.flatnonzero(chosen)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 15, step: float = 0.08, shrink: float = 1e-4, size: int = 32, seed: int = 7) -> Machine:
    """Fit a machine to sets of places, in the given order of rows."""
    slot_of = np.full(SLOTS, -1, np.int32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Machine(slot_of, np.zeros(0), np.zeros((0, FACTORS)), 0.0, float(labels.mean()) if len(labels) else 0.0)
    used, n = np.unique(np.concatenate(texts), return_counts=True)
    toxic = np.bincount(np.searchsorted(used, np.concatenate([t for t, y in zip(texts, labels) if y])), minlength=len(used))
    alone = (n >= MIN_TEXTS) & (_evidence(toxic, n, int(labels.sum()), len(labels)) >= MIN_EVIDENCE)
    hot = np.flatnonzero(alone & (toxic * len(labels) > n * labels.sum()))
    pairs = pair_places(texts, labels, used, n, toxic)
    alone[np.concatenate([pairs, soothing_places(texts, labels, used, n, hot)])] = True
    used = used[alone]
    slot_of[used] = np.arange(len(used), dtype=np.int32)
    rows = [r[r >= 0] for r in (slot_of[t] for t in texts)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used), np.float32), rng.normal(0, 0.01, (len(used), FACTORS)).astype(np.float32)
    gw, gv = np.full(len(used), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32)
    bias, gb = float(np.log(labels.mean() / (1 - labels.mean()))), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            idx = np.concatenate([rows[i] for i in pick])
            n = np.array([len(rows[i]) for i in pick])
            row = np.repeat(np.arange(len(pick)), n)
            own, inverse = np.unique(idx, return_inverse=True)
            x = v[idx]
            s = np.stack([np.bincount(row, x[:, f], len(pick)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(row, w[idx], len(pick)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (x * x).sum(1), len(pick)))
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]
            # long texts would otherwise move every factor by their length
            scale = 1 / np.maximum(1.0, np.sqrt(n / 50.0))
            dw = np.bincount(inverse, g[row], len(own)) + shrink * w[own]
            gw[own] += dw**2
            w[own] -= step * dw / np.sqrt(gw[own])
            inner = (g * scale)[row, None] * (s[row] - x)
            dv = np.stack([np.bincount(inverse, inner[:, f], len(own)) for f in range(FACTORS)], 1) + shrink * v[own]
            gv[own] += dv**2
            v[own] -= 0.3 * step * dv / np.sqrt(gv[own])
            gb += g.sum() ** 2
            bias -= step * g.sum() / np.sqrt(gb)
    return Machine(slot_of, w.astype(np.float64), v.astype(np.float64), float(bias))


def held_out(doc_id: Column) -> Column:
    """Fold of rows that training never reads."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def eligible(n: np.ndarray, toxic: np.ndarray, bad: int, total: int) -> np.ndarray:
    """Which places ``fit`` can take in, or searches pairs by: those of evidence, and the even ones, all in ``MIN_TEXTS`` texts. ``n`` and
    ``toxic`` count every place's texts, ``total`` and ``bad`` all texts; the machine is the same without the other places."""
    if not 0 < bad < total:
        return np.zeros(len(n), bool)
    return (n >= MIN_TEXTS) & ((np.arange(len(n)) % 2 == 0) | (_evidence(toxic, n, bad, total) >= MIN_EVIDENCE))


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows of ``df`` outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("id", F.col("y").cast("int").alias("y"))
    picked = known.join(df.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def places(batches):
        table = _Table()
        for b in batches:
            yield pa.record_batch({"at": b["at"], "y": b["y"], "places": pa.array([table.of(t.as_py()).astype("<i4").tobytes() for t in b["text"]], pa.binary())})

    # at most max_rows ids go to every task
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select(F.xxhash64("id").alias("at"), "y", "text").mapInArrow(places, "at long, y int, places binary")
    chosen = materialize(rows.distinct().orderBy("at", "places", "y").limit(max_rows), "toxicity-places")

    def counts(batches):
        n, toxic = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in batches:
            for p, y in zip(b["places"], b["y"].to_pylist()):
                own = np.frombuffer(p.as_buffer(), "<i4")
                n[own] += 1
                toxic[own] += y
        at = np.flatnonzero(n)
        yield pa.record_batch({"place": pa.array(at.astype(np.int32)), "n": n[at], "toxic": toxic[at]})

    counted = chosen.select("y", "places").mapInArrow(counts, "place int, n long, toxic long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= MIN_TEXTS)
    found = counted.toArrow()  # at most SLOTS rows
    n, toxic = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    n[found["place"].to_numpy()], toxic[found["place"].to_numpy()] = found["n"].to_numpy(), found["toxic"].to_numpy()
    total, bad = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    wanted = df.sparkSession.sparkContext.broadcast(np.packbits(eligible(n, toxic, bad, total)))

    def kept(batches):
        use = np.unpackbits(wanted.value).astype(bool)
        for b in batches:
            sets = (np.frombuffer(p.as_buffer(), "<i4") for p in b["places"])
            yield pa.record_batch({"y": b["y"], "places": pa.array([p[use[p]].tobytes() for p in sets], pa.binary())})

    got = chosen.orderBy("at", "places", "y").select("y", "places").mapInArrow(kept, "y int, places binary").toArrow()
    return fit([np.frombuffer(p.as_buffer(), "<i4") for p in got["places"]], got["y"].to_numpy().astype(np.float64))


def score_column(text: Column, machine: Machine, df: DataFrame) -> Column:
    """Score of every whole text; the machine is at most ``SLOTS`` weights and factor vectors large."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    state: dict = {}

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        if "table" not in state:
            state["table"] = _Table(shared.value.slot_of)
        table, model = state["table"], shared.value
        return pa.array([model.score(table.of(t.as_py())) for t in texts], pa.float64())

    return toxicity(text)


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "score", flag: str = "predicted", threshold: float = 0.5) -> DataFrame:
    """``df`` with the score (0 to 1) of every text and a flag (int) from ``threshold``; same-named columns are replaced."""
    scored = df.withColumn(out, score_column(F.col(text), train(df, labels, doc_id, text), df))
    return scored.withColumn(flag, (F.col(out) >= threshold).cast("int"))
