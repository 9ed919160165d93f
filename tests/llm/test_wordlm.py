from collections import Counter

import numpy as np

from voxelmill.llm import wordlm
from voxelmill.llm.queries import QUERIES


def plain(rows, targets, leave_one_out=True):
    """Scores of (doc_id, text) by a plain word trigram model."""
    seqs = [(i, [None, None, *(t or "").encode().split(), 0]) for i, t in rows]
    counts = {}
    for name, own in (("target", [s for i, s in seqs if i is not None and i in targets]), ("background", [s for _, s in seqs])):
        hit, before = Counter(), Counter()
        for s in own:
            for j in range(2, len(s)):
                for k in range(3):
                    hit[tuple(s[j - k : j + 1])] += 1
                    before[tuple(s[j - k : j])] += 1
        counts[name] = hit, before
    vocabulary = len({w for _, s in seqs for w in s[2:]})
    out = []
    for i, s in seqs:
        loss = {}
        own, own_before = Counter(), Counter()
        for j in range(2, len(s)):
            for k in range(3):
                own[tuple(s[j - k : j + 1])] += 1
                own_before[tuple(s[j - k : j])] += 1
        for name, (hit, before) in counts.items():
            at, gone = [], leave_one_out and (name == "background" or (i is not None and i in targets))
            for j in range(2, len(s)):
                p = 1 / vocabulary
                for k in range(3):
                    a, b = tuple(s[j - k : j + 1]), tuple(s[j - k : j])
                    p = (hit[a] - gone * own[a] + wordlm.PRIOR * p) / (before[b] - gone * own_before[b] + wordlm.PRIOR)
                at.append(-np.log(p))
            loss[name] = float(np.mean(at))
        out.append((-1 if i is None else i, len(s) - 2, round(loss["target"], 8), round(loss["background"], 8)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.target_loss, 8), round(r.background_loss, 8)) for r in df.collect())


def test_the_query_equals_a_plain_word_model(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    targets = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert got(QUERIES["op5_lm"](spark, sf)) == plain(rows, targets)


def test_word_order_counts_and_odd_rows_score(spark, monkeypatch):
    rows = [(1, "the red fox"), (2, "fox red the"), (3, None), (4, "é  ü x\n"), (2, "fox red the"), (None, "the red dog"), (None, None), (5, "")] + [(k, "a red fox ran") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", wordlm.F.lit("clash"))
    targets = spark.createDataFrame([(1,), (4,), (4,), (77,), (None,)], "doc_id long")
    out = wordlm.score(df, targets)
    assert got(out) == plain(rows, {1, 4, 77})
    # rated with its own counts, a target is like the target; left out, it isn't
    by = {r.doc_id: r.ce_difference for r in wordlm.score(df, targets, leave_one_out=False).collect()}
    assert by[1] < by[2]
    assert wordlm.score(df.limit(0), targets).count() == 0
    assert got(wordlm.score(df, targets, leave_one_out=False)) == plain(rows, {1, 4, 77}, False)
    assert got(wordlm.score(df, targets.limit(0))) == plain(rows, set())


def test_texts_are_shuffled_once_and_a_slice_is_bounded(spark, monkeypatch):
    rows = [(k, f"word{k % 7} and other{k % 5} words " * (k % 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", wordlm.F.lit("clash")).withColumn("c_0", wordlm.F.lit("clash"))
    targets = spark.createDataFrame([(k,) for k in range(0, 200, 3)], "doc_id long")
    out = wordlm.score(df, targets)
    assert got(out) == plain(rows, set(range(0, 200, 3)))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("pack(") <= 2 * plan.count("ReusedExchange") + 1 or "ReusedExchange" in plan, plan
    assert {r["range"] for r in out.collect()} == {"clash"}


def test_parties_of_buckets_ask_in_messages_that_grow_with_the_buckets(spark, monkeypatch):
    rows = [(k % 190, f"w{k % 7} x{k * k % 31} y{k} again w{k % 3} " * (1 + k % 4)) for k in range(200)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(k,) for k in range(0, 200, 3)], "doc_id long")
    want, sent = plain(rows, set(range(0, 200, 3))), {}
    monkeypatch.setattr(wordlm, "FAN", 4)
    for buckets in (3, 16, 23):
        monkeypatch.setattr(wordlm, "bucket_count", lambda df, n=buckets: n)
        assert got(wordlm.score(df, targets)) == want
        assert wordlm.score(df.limit(0), targets).count() == 0
    # a bucket of many n-grams sends a message for each of its ranges, or for FAN runs of neighbouring ones
    text = " ".join(f"w{k}" for k in range(20_000))
    packed = wordlm.zstandard.ZstdCompressor().compress(text.encode())
    bucket = wordlm.pa.table({"bucket": wordlm.pa.array([0], "int32"), "id": ["1"], "mark": [False], "text": wordlm.pa.array([packed], "binary")})
    for buckets in (16, 64, 256):
        sent[buckets] = buckets * wordlm._ask(buckets, -(-buckets // 4))(bucket).num_rows
    assert sent == {16: 64, 64: 256, 256: 1024} and wordlm._ask(256, 1)(bucket).num_rows == 256
