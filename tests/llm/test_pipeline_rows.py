import corpus_pipeline as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUN = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, RUN, "en", "a", 150), (2, f"x {RUN} y", "en", None, 154), (3, None, None, None, None), (4, "", "de", "a", 0), (5, " ", "en", "b", 1), (6, "word " * 60_000, "en", "b", 300_000),
    (7, "same text here again", "en", "b", 20), (7, "same text here again", "en", "b", 20), (8, "same text here again", "de", "b", 20), (None, "no id", "en", "a", 5), (None, None, "en", "a", None), (9, "<|endoftext|> \u00e9\u4e2d", "zh", "a", 15),
]
NAMES = ["score", "predicted", "tox_score", "tox_flag", "fp", "fingerprint", "component_id", "n_words", "n_removed", "topic", "n_tokens", "factor", "keep_prob", "selected", "token_ids", "id", "bucket"]


def texts(df):
    return sorted((r.doc_id or -1, r.text) if r.text is not None else (r.doc_id or -1, "\x00") for r in df.collect())


def test_stages_take_odd_rows(spark, sf):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in NAMES})
    out = {name: stage(spark, docs, sf).cache() for name, stage in P.STAGES}
    for name, df in out.items():
        assert df.columns == (P.COLUMNS if name != "bpe" else ["doc_id", "lang", "source", "n_tokens", "token_ids"]), name
    assert texts(out["toxicity"]) == texts(docs)  # none of them is toxic
    near = texts(out["simhash_near_dedup"])
    assert near.count((7, "same text here again")) == 2 and (8, "same text here again") not in near
    assert [d for d, t in near if t in ("", " ", "\x00")] == [-1, 3] and (-1, "no id") in near
    cut = dict(texts(out["substring_dedup"]))
    assert len(texts(out["substring_dedup"])) == len(ROWS) and cut[1] == RUN and cut[2] == "x y" and cut[3] == "\x00" and cut[6] == "word" and cut[7] == "same text here again"
    assert {(r.doc_id, r.n_chars) for r in out["substring_dedup"].filter("doc_id in (1, 2, 3)").collect()} == {(1, 150), (2, 3), (3, None)}
    mixed = texts(out["mixing"])
    assert set(mixed) <= set(texts(docs)) and mixed.count((7, "same text here again")) in (0, 2)
    ids = {r.doc_id: (r.n_tokens, len(r.token_ids)) for r in out["bpe"].collect()}
    assert out["bpe"].count() == len(ROWS) and ids[3] == ids[4] == (0, 0) and all(a == b for a, b in ids.values()) and ids[6][0] > 50_000


def test_stages_take_an_empty_table(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name
