import zlib

import numpy as np

from voxelmill.llm import toxicity


def test_a_pair_is_toxic_where_neither_term_is(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(3000):
        kind = i % 25
        # the pair in 1 of 25 texts; each of its terms alone in clean texts, so often that its share of toxic texts is the general one
        extra = {0: "grub zorn", **dict.fromkeys(range(1, 6), "grub"), **dict.fromkeys(range(6, 11), "zorn"), 11: "vile", 12: "vile", 13: "vile"}.get(kind, "")
        toxic = kind == 0 or extra == "vile"
        rows.append((i, " ".join([*rng.choice(words, 30), *extra.split()]), toxic, extra))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    share = {e: np.mean([got[r[0]].predicted for r in held if r[3] == e]) for e in {r[3] for r in rows}}
    assert share["grub zorn"] > 0.9 and share["vile"] > 0.9
    assert share["grub"] < 0.1 and share["zorn"] < 0.1 and share[""] < 0.05


def test_no_pairs_in_noise():
    rng = np.random.default_rng(5)
    texts = [np.unique(rng.integers(0, 400, 40)).astype("<i4") for _ in range(1500)]
    labels = (rng.random(1500) < 0.15).astype(float)
    used, n = np.unique(np.concatenate(texts), return_counts=True)
    toxic = np.bincount(np.searchsorted(used, np.concatenate([t for t, y in zip(texts, labels) if y])), minlength=len(used))
    assert len(toxicity.pair_places(texts, labels, used, n, toxic)) == 0


def test_scores_equal_an_explicit_sum_over_pairs(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.weight)
    texts = [*(t for _, t, _ in rows[:40]), "", None, "vile " * 20_000 + "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score_column(df["text"], model, df).alias("s")).collect()}
    for i, t in enumerate(texts):
        own = sorted({int(model.slot_of[p]) for w in set((t or "").lower().split()) for p in toxicity.word_slots(w)} - {-1})
        z = model.bias + sum(model.weight[a] for a in own) + sum(float(model.factor[a] @ model.factor[b]) for k, a in enumerate(own) for b in own[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_ids_of_any_type_and_odd_rows(spark):
    rows = [(i, "vile thing" if i % 3 == 0 else "fine thing", int(i % 3 == 0)) for i in range(300)]
    want = None
    for kind in ("long", "int", "string"):
        docs = spark.createDataFrame([r[:2] for r in rows] + [(0, "vile thing"), (None, "vile thing")], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "'x' as score", "'y' as predicted")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").selectExpr(f"cast(doc_id as {kind}) as doc_id", "toxic")
        out = toxicity.score(docs, labels)
        assert out.columns == docs.columns and dict(out.dtypes)["score"] == "double"
        found = {(r.text, r.predicted) for r in out.collect()}
        assert out.count() == len(rows) + 2 and found == {("vile thing", 1), ("fine thing", 0)}
        assert toxicity.score(docs.limit(0), labels).count() == 0


def test_a_word_takes_toxicity_away(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(3000):
        kind = i % 25
        # "quote" stands in toxic and clean texts at the general rate, but never beside "vile" in a toxic one
        extra = {0: "vile", 1: "vile", 2: "vile", 3: "vile quote", 4: "vile quote", 5: "grim quote", 6: "quote", 7: "quote"}.get(kind, "")
        toxic = extra in ("vile", "grim quote")
        rows.append((i, " ".join([*rng.choice(words, 30), *extra.split()]), toxic, extra))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    share = {e: np.mean([got[r[0]].predicted for r in held if r[3] == e]) for e in {r[3] for r in rows}}
    assert share["vile"] > 0.9 and share["grim quote"] > 0.9, share
    assert share["vile quote"] < 0.1 and share["quote"] < 0.1 and share[""] < 0.05, share


def test_nothing_soothes_in_noise():
    rng = np.random.default_rng(6)
    texts = [np.unique(rng.integers(0, 400, 40)).astype("<i4") for _ in range(1500)]
    labels = (rng.random(1500) < 0.15).astype(float)
    used, n = np.unique(np.concatenate(texts), return_counts=True)
    assert len(toxicity.soothing_places(texts, labels, used, n, np.arange(len(used)))) == 0
