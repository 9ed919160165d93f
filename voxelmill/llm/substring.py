"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has a word sequence
that also starts earlier (smaller doc_id, or same document and earlier start); windows are judged on the input.

The levels are stretches of a length that doubles up to the window's (5, 10, then 20 words). At a level, of each window
only the stretch with the least hash stands for it, so equal windows agree on their stretch and a sixth to an eighth of
all stretches are counted. Windows whose stretch occurs once are settled; only the others go to the next level. At the
full length windows are known by two hashes (128 bits) and ranked by their place. Windows that stand at one stretch
travel as one row. With no candidates left, a level passes nothing on.

Documents are dealt into hash buckets by doc_id and text. Tasks sum what one bucket or one map task repeats before
anything is shuffled, so a passage in a third of all documents is a row per map task (first level; the buckets that hold
it are a list, unfolded after the count) or per bucket (later levels), not per document. Text is shuffled once,
compressed; all levels and the cut read that one exchange. Nothing is collected.

Null text has no words. Repeated rows (same doc_id and text) are one place, so neither is earlier, and stay in one
bucket; texts that differ under one doc_id stand in order of their 64-bit hash. A null doc_id is the greatest long.
doc_id is of an integer type. Input columns with the names of outputs are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.session import bucket_count

LAST_ID, FLUSH_ROWS, WIDE, SHORTEST = (1 << 63) - 1, 2_000_000, 8, 4
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pair(x: np.ndarray, y: np.ndarray, kind: int = 0) -> np.ndarray:
    z = x * MIX[kind] + y
    z ^= z >> np.uint64(29)
    z *= MIX[kind + 2]
    z ^= z >> np.uint64(32)
    return z


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hash of each stretch of ``length`` words, from those of half the length."""
    if length == 1:
        return h
    half = length // 2
    g = gram_hashes(h, half)
    z = _pair(g[: len(g) - half], g[half:], kind)
    return _pair(z[: len(z) - 1], h[2 * half :], kind) if length % 2 else z


def stretch_lengths(window: int) -> list[int]:
    """Lengths of the levels below ``window``: each half of the next, the first of ``SHORTEST`` words at least if it can."""
    lengths = [max(1, window // 2)]
    while lengths[0] // 2 >= SHORTEST:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def window_stretches(h: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its stretch of ``length`` words with the least hash (the first of them): hash and place."""
    g = gram_hashes(h, length)
    at = np.lib.stride_tricks.sliding_window_view(g, window - length + 1).argmin(axis=1)
    at += np.arange(len(at))
    return g[at], at


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


#: A stretch, the bucket that holds it (or a list of them), and how often it occurs (2 stands for more).
COUNT = "stretch long, bucket int, more array<int>, n byte"
COUNT_SCHEMA = pa.schema([("stretch", pa.int64()), ("bucket", pa.int32()), ("more", pa.list_(pa.int32())), ("n", pa.int8())])


def _first_level(window: int, length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of this task's stretches; a stretch in many buckets is one row with their list."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            key, bucket = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((bucket, key))
            key, bucket = key[order], bucket[order]
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            n, key, bucket = np.diff(np.r_[at, len(key)]), key[at], bucket[at].astype(np.int32)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            width = np.diff(np.r_[first, len(key)])
            wide, total = width > WIDE, np.add.reduceat(n, first)
            narrow = np.repeat(~wide, width)
            lists = np.r_[0, np.cumsum(np.r_[np.zeros(narrow.sum(), np.int64), width[wide]])].astype(np.int32)
            none = np.r_[np.ones(narrow.sum(), bool), np.zeros(wide.sum(), bool)]
            stretch = np.concatenate([key[narrow], key[first[wide]]]).view(np.int64)
            times = np.minimum(np.concatenate([n[narrow], total[wide]]), 2).astype(np.int8)
            one = pa.array(np.concatenate([bucket[narrow], np.zeros(wide.sum(), np.int32)]), mask=~none)
            more = pa.ListArray.from_arrays(lists, bucket[~narrow], mask=pa.array(none))
            return pa.record_batch([pa.array(stretch), one, more, pa.array(times)], schema=COUNT_SCHEMA)

        for batch in batches:
            for text, bucket in zip(batch["text"], batch["bucket"].to_pylist()):
                words = _split(text.as_py())
                if len(words) < window:
                    continue
                least, at = window_stretches(word_hashes(words), window, length)
                # one count for each place of a stretch, however many windows it stands for
                places = least[np.r_[True, at[1:] != at[:-1]]]
                held.append((places, np.full(len(places), bucket, np.int64)))
                rows += len(places)
            if rows >= FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return count


def _known(repeated: pa.Table) -> np.ndarray:
    return np.unique(repeated["stretch"].to_numpy().view(np.uint64))


def _candidates(h: np.ndarray, window: int, length: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose stretch is among the known ones, and those stretches."""
    least, _ = window_stretches(h, window, length)
    at = np.searchsorted(known, least)
    at[at == len(known)] = 0
    starts = np.flatnonzero(known[at] == least)
    return starts, least[starts]


def _next_level(window: int, length: int, longer: int):
    def count(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        """Counts of a bucket's longer stretches, for windows whose shorter one is repeated."""
        known, held = _known(repeated), []
        for text in _texts(docs) if len(known) else ():
            words = _split(text)
            if len(words) < window:
                continue
            h = word_hashes(words)
            starts, _ = _candidates(h, window, length, known)
            if len(starts):
                least, at = (x[starts] for x in window_stretches(h, window, longer))
                held.append(least[np.r_[True, at[1:] != at[:-1]]])
        if not held:
            return COUNT_SCHEMA.empty_table()
        stretch, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = np.full(len(stretch), docs["bucket"][0].as_py(), np.int32)
        return pa.table([pa.array(stretch.view(np.int64)), pa.array(bucket), pa.nulls(len(stretch), pa.list_(pa.int32())), pa.array(np.minimum(n, 2).astype(np.int8))], schema=COUNT_SCHEMA)

    return count


def _packed(text: Column) -> Column:
    """Compressed text, for a shuffle."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=3)
        return pa.array([None if (t := x.as_py()) is None else z.compress(t.encode()) for x in texts], pa.binary())

    return pack(text)


def _texts(table: pa.Table) -> list[str | None]:
    z = zstandard.ZstdDecompressor()
    return [None if (b := x.as_py()) is None else z.decompress(b).decode() for x in table["text"]]


#: Windows of one stretch and document: their second hashes, the document's id and text hash, the first window's start,
#: how far each is from the last; or, with a run, starts that are known to be later ones.
OCCURRENCE = "stretch long, hashes array<long>, id long, t long, start long, steps array<byte>, run int"
SCHEMA = pa.schema([("stretch", pa.int64()), ("hashes", pa.list_(pa.int64())), ("id", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("steps", pa.list_(pa.int8())), ("run", pa.int32())])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    return np.r_[np.ones(min(1, len(columns[0])), bool), np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]


def _last_level(window: int, length: int):
    def rank(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        """Of a bucket's candidate windows, the first place of each sequence (run 0), and the later ones as runs of starts."""
        known, parts = _known(repeated), []
        for i, t, text in zip(docs["id"].to_pylist(), docs["t"].to_pylist(), _texts(docs)) if len(known) else ():
            words = _split(text)
            if len(words) < window:
                continue
            h = word_hashes(words)
            starts, least = _candidates(h, window, length, known)
            if len(starts):
                parts.append((least, gram_hashes(h, window, 1)[starts], np.full(len(starts), i, np.int64), np.full(len(starts), t, np.int64), starts))
        if not parts:
            return SCHEMA.empty_table()
        wa, wb, i, t, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, t, i, wb, wa))
        wa, wb, i, t, s = wa[order], wb[order], i[order], t[order], s[order]
        new = _changes(wa, wb)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        later = (i != i[first][group]) | (t != t[first][group]) | (s != s[first][group])
        order = np.lexsort((s[later], t[later], i[later]))
        li, lt, ls = i[later][order], t[later][order], s[later][order]
        cut = np.flatnonzero(_changes(li, lt) | np.r_[np.zeros(min(1, len(ls)), bool), ls[1:] > ls[:-1] + 1])
        run = (ls[np.r_[cut[1:] - 1, len(ls) - 1]] - ls[cut] + 1).astype(np.int32) if len(li) else np.zeros(0, np.int32)
        rows = np.flatnonzero(new)
        rows = rows[np.lexsort((s[rows], t[rows], i[rows], wa[rows]))]
        fa, fb, fi, ft, fs = wa[rows], wb[rows], i[rows], t[rows], s[rows]
        step = np.diff(fs, prepend=fs[:1])
        head = np.flatnonzero(_changes(fa, fi, ft) | (step > 100))
        step[head] = 0
        ends = np.r_[head, len(rows)].astype(np.int32)
        none = np.zeros(len(cut) + 1, np.int32)
        return pa.concat_tables([
            pa.table([pa.array(fa[head].view(np.int64)), pa.ListArray.from_arrays(ends, fb.view(np.int64)), pa.array(fi[head]), pa.array(ft[head]), pa.array(fs[head]), pa.ListArray.from_arrays(ends, step.astype(np.int8)), pa.array(np.zeros(len(head), np.int32))], schema=SCHEMA),
            pa.table([pa.array(li[cut]), pa.ListArray.from_arrays(none, np.zeros(0, np.int64)), pa.array(li[cut]), pa.array(lt[cut]), pa.array(ls[cut]), pa.ListArray.from_arrays(none, np.zeros(0, np.int8)), pa.array(run)], schema=SCHEMA),
        ])

    return rank


def _cut(window: int, schema: T.StructType, text_at: str, out: tuple[str, str]):
    def cut(docs: pa.Table, later: pa.Table) -> pa.Table:
        """The bucket's rows with the words of later windows taken out."""
        lid, lt, start, run = (later[c].to_numpy() for c in ("id", "t", "start", "run"))
        order = np.lexsort((start, lt, lid))
        lid, lt, start, run = lid[order], lt[order], start[order], run[order]
        head = np.flatnonzero(_changes(lid, lt))
        found = dict(zip(zip(lid[head].tolist(), lt[head].tolist()), zip(head, np.r_[head[1:], len(lid)])))
        kept, words_n, removed_n = [], [], []
        for i, t, text in zip(docs["id"].to_pylist(), docs["t"].to_pylist(), _texts(docs)):
            words = _split(text)
            lo, hi = found.get((i, t), (0, 0))
            own, n = start[lo:hi], run[lo:hi]
            gone = 0
            if len(own):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, own, 1)
                np.add.at(edge, own + np.maximum(n, 1) - 1 + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                text = b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode()
            kept.append(text)
            words_n.append(len(words))
            removed_n.append(gone)
        made = {text_at: pa.array(kept, pa.string()), out[0]: pa.array(words_n, pa.int64()), out[1]: pa.array(removed_n, pa.int64())}
        return pa.table({f.name: made[f.name] if f.name in made else docs[f"c_{n}"] for n, f in enumerate(schema)})

    return cut


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``df`` with later repeats of ``window`` words taken out of ``text``, and ``n_words`` and ``n_removed``.

    A text that loses words is what is left of it, joined by single spaces; others stay as they are."""
    if window < 2:
        raise ValueError("a window has two words at least")
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is not of an integer type")
    buckets = bucket_count(df)
    bucket = F.pmod(F.xxhash64("id", "t"), F.lit(buckets)).cast("int").alias("bucket")
    plain = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"), *(F.col(c).alias(f"c_{n}") for n, c in enumerate(df.columns) if c != text)).withColumn("bucket", bucket)
    by_bucket = plain.withColumn("text", _packed(F.col("text"))).groupBy("bucket")
    lengths = stretch_lengths(window)
    counted = plain.select("text", "bucket").mapInArrow(_first_level(window, lengths[0]), COUNT)
    for length, longer in zip(lengths, [*lengths[1:], None]):
        again = counted.withColumn("all", F.sum("n").over(Window.partitionBy("stretch"))).filter("all > 1")
        repeated = again.select("stretch", F.explode(F.coalesce("more", F.array("bucket"))).alias("bucket")).groupBy("bucket")
        if longer:
            counted = by_bucket.cogroup(repeated).applyInArrow(_next_level(window, length, longer), COUNT)
    found = by_bucket.cogroup(repeated).applyInArrow(_last_level(window, length), OCCURRENCE).repartition("stretch")
    starts = F.transform("steps", lambda x, n: F.struct(F.element_at("hashes", n + 1).alias("hash"), F.aggregate(F.slice("steps", 1, n + 1), F.col("start"), lambda a, y: a + y).alias("start")))
    windows = found.select("stretch", "id", "t", "run", F.explode(F.when(F.col("run") > 0, F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.col("start")))).otherwise(starts)).alias("w")).select("stretch", "id", "t", "run", "w.hash", "w.start")
    # runs are settled: each ranks apart
    place = F.rank().over(Window.partitionBy("stretch", "hash", "run").orderBy("id", "t", "start"))
    later = windows.withColumn("place", place).filter("run > 0 or place > 1").select(bucket, "id", "t", "start", "run")
    kept = [f for f in df.schema if f.name not in (n_words, n_removed)]
    schema = T.StructType([*df.schema, *(T.StructField(c, T.LongType()) for c in (n_words, n_removed) if c not in df.columns)])
    schema = T.StructType([T.StructField(f.name, T.LongType() if f not in kept else f.dataType, True) for f in schema])
    return by_bucket.cogroup(later.groupBy("bucket")).applyInArrow(_cut(window, schema, text, (n_words, n_removed)), schema)
