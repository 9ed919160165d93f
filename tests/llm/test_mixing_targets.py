import pytest
from pyspark.sql import functions as F

from voxelmill.llm import mixing
from voxelmill.llm.queries import QUERIES


def test_expected_margins_are_the_targets_at_the_query_s_parameters(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang")
    out = QUERIES["op8_mixing_repeats"](spark, sf).join(docs, "doc_id").toPandas()
    total = out.n_tokens.sum()
    assert (out.keep_prob * out.n_tokens).sum() == pytest.approx(mixing.BUDGET * total, rel=1e-3)
    assert (out.keep_prob > 1).any() and (out.copies - out.keep_prob).abs().max() < 1
    for m in mixing.MARGINS:
        own = out.groupby(m, dropna=False).n_tokens.sum() ** mixing.ALPHA
        kept = (out.keep_prob * out.n_tokens).groupby([out[m]], dropna=False).sum()
        assert (kept / kept.sum() - own / own.sum()).abs().max() < 2e-3, m


def test_copies_of_odd_rows(spark):
    rows = [(i, "a b c", "big" if i % 4 else "small", "en") for i in range(400)] + [(None, None, None, None), (500, "", "small", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("copies", F.lit("clash"))
    out = mixing.mix(df, {"source": {"big": 0.5, "small": 0.5}}, budget=0.9, repeat=True)
    share = {r.source: (r.t, r.least, r.most) for r in out.filter("n_tokens > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("keep_prob")).alias("t"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect()}
    assert share["big"][0] == pytest.approx(540, abs=1) and share["small"][0] == pytest.approx(540, abs=1)
    assert share["small"][1:] == (1, 2) and share["big"][2] == 1
    assert out.count() == len(rows) and out.filter("keep_prob is null or copies is null").count() == 0
    assert mixing.mix(df.limit(0), repeat=True).count() == 0
