import numpy as np

from voxelmill.llm import toxicity


def test_only_eligible_places_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(words, 20), f"only{i}x", *["vile"] * (i % 6 == 0), *["grub zorn"] * (i % 11 == 0)]), int(i % 6 == 0 or i % 11 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fit, seen = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **k: seen.append((texts, y)) or fit(texts, y, **k))
    model = toxicity.train(docs, labels)
    sets, y = seen[0]
    held = np.bincount(np.concatenate(sets), minlength=toxicity.SLOTS)
    assert held[held > 0].min() >= toxicity.MIN_TEXTS  # words of one text stay with the tasks
    # the machine is that of the whole texts, in the order of their ids' hashes
    table = toxicity._Table()
    known = docs.join(labels, "doc_id").filter(~toxicity.held_out(docs["doc_id"])).selectExpr("xxhash64(doc_id) as at", "text", "toxic").orderBy("at").collect()
    whole = [table.of(r.text) for r in known]
    assert [r.toxic for r in known] == y.tolist() and sum(map(len, sets)) < 0.6 * sum(map(len, whole))
    same = fit(whole, y)
    assert (same.slot_of == model.slot_of).all() and (same.weight == model.weight).all() and (same.factor == model.factor).all() and same.bias == model.bias
    assert len(model.weight) > 0
