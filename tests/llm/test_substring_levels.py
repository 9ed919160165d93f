"""Levels of substring dedup against brute force: passages in many buckets, hot and repeated ids, one shuffle of the texts."""

import numpy as np
import pytest

from voxelmill.llm import substring


def brute(rows, window):
    """Texts left, by row; texts under one id in any order, so callers give those that no order changes."""
    places = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            key = ((1 << 63) - 1 if d is None else d, t, i)
            seq = tuple(w[i : i + window])
            places[seq] = min(places.get(seq, key), key)
    out = []
    for d, t in rows:
        w = (t or "").split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] != ((1 << 63) - 1 if d is None else d, t, i):
                gone[i : i + window] = True
        out.append((d, int(gone.sum()), " ".join(np.array(w)[~gone]) if gone.any() else t))
    return sorted(out, key=repr)


def test_lengths_double_up_to_the_window():
    assert substring.stretch_lengths(20) == [5, 10] and substring.stretch_lengths(21) == [5, 10]
    assert substring.stretch_lengths(64) == [4, 8, 16, 32]
    assert substring.stretch_lengths(2) == [1] and substring.stretch_lengths(7) == [3]


@pytest.mark.parametrize("window", [2, 7, 20, 33])
def test_passages_in_many_buckets(spark, window):
    rng = np.random.default_rng(window)
    passages = [" ".join(f"p{k}_{j}" for j in range(60)) for k in range(3)]
    rows = [(i, f"{' '.join(f'u{i}_{j}' for j in range(rng.integers(0, 30)))} {passages[i % 3][rng.integers(0, 40):]} " + " ".join(rng.choice(list("abcd"), 50))) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        got = sorted(((r.doc_id, r.n_removed, r.text) for r in substring.dedup_substrings(df, window=window).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, window) and sum(n for _, n, _ in got) > 1000


def test_a_hot_id_is_dealt_by_text(spark):
    tail = " ".join(f"t{j}" for j in range(25))
    # under the null id all share a passage with an earlier document, so that no order among them matters
    rows = [(1, tail)] + [(None, f"own{i} {tail}") for i in range(40)] + [(5, f"alone{i} word") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in substring.dedup_substrings(df).collect()), key=repr)
    assert got == brute(rows, 20)
    twice = [(3, f"{x} {tail}") for x in "ab"]
    left = [r.n_removed for r in substring.dedup_substrings(spark.createDataFrame(twice, "doc_id long, text string")).collect()]
    assert sorted(left) == [0, 25]
    with pytest.raises(TypeError):
        substring.dedup_substrings(df.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_texts_are_shuffled_once(spark, sf):
    out = substring.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ArrowEvalPython") == 1 and final.count("+- ReusedExchange") == 2
