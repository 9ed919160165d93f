import numpy as np
import xxhash
from pyspark.sql import functions as F

from voxelmill.llm import bpe, simhash
from voxelmill.llm.queries import QUERIES, tokenizer_path

ODD = ["", None, " ", "a", "  two  spaces ", "it's we'll", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "éüß 中文字 ١٢٣ ½   \x1c\x1d\x85 ​", "a" * 5000, "ab" * 3000 + " " * 300, "\U0001f600" * 50, "\n\n \t\n x", "1234567 89,0!?...", "\x00\x01\x7f", "é"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library():
    t, v = library(), bpe.Vocabulary(tokenizer_path())
    for text in ODD:
        want = t.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(v.encode(text or ""), "<u4").tolist()
        assert got == want, text
        assert v.decode(v.encode(text or "")) == t.decode(want, skip_special_tokens=False)
    assert v.decode(np.array([128, 50256, 1000, 200], "<u4").tobytes()) == t.decode([128, 50256, 1000, 200], skip_special_tokens=False)


def test_every_assigned_character_splits_as_the_library_does():
    t, v = library(), bpe.Vocabulary(tokenizer_path())
    import unicodedata

    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(f"a{c}1{c} {c}" for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        if np.frombuffer(v.encode(text), "<u4").tolist() != e.ids:
            for c in text[1::7]:
                one = f"a{c}1{c} {c}"
                assert np.frombuffer(v.encode(one), "<u4").tolist() == t.encode(one, add_special_tokens=False).ids, hex(ord(c))


def test_op1_rows(spark, sf):
    import hashlib

    t = library()
    rows = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = t.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frame_of_odd_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(ODD)], "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).withColumn("list", bpe.unpack()).collect()
    assert [r.decoded for r in out] == [x or "" for x in ODD]
    assert [r.n_tokens for r in out] == [len(r.list) for r in out]
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, d=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def test_op3_rows(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [brute(d.text) for d in docs]
    want = components([d.doc_id for d in docs], fps)
    rows = QUERIES["op3_simhash"](spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d.doc_id: f"{f:016x}" for d, f in zip(docs, fps)}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_trie_equals_all_pairs_and_split_nodes_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    vals = {int(v) for v in base}
    for v in list(vals):
        for _ in range(12):
            x = v
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            vals.add(x)
    vals |= {int(base[0]) ^ (1 << b) ^ (1 << c) for b in range(16, 40) for c in range(16, 40)}
    vals = sorted(vals)
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    from voxelmill.operators.components import connected_components

    want = components(signed, vals)
    for rows in (50_000, 40):
        got = {r.node: r.component for r in connected_components(simhash.hamming_edges(df, 3, rows)).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_simhash_of_odd_rows(spark):
    rows = [(1, "", "a"), (2, None, "b"), (3, "One two", "c"), (3, "One two", "c"), (4, "one  TWO", None), (None, "one two", "d"), (9, "x " * 100_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert out == [(-1, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (9, 9)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 3, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_a_text_is_encoded_once_and_all_forms_agree(spark, sf):
    import corpus_pipeline

    path, docs = tokenizer_path(), spark.read.parquet(f"{sf}/documents.parquet")
    for df in (QUERIES["op1_bpe"](spark, sf), corpus_pipeline.tokenize(spark, docs, sf), bpe.decode(bpe.encode(docs, path), path).select("token_ids", "n_tokens", "decoded")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        nodes = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
        assert sum(line.split("], [")[0].count("bpe_encode") for line in nodes) == 1, plan
    df = spark.createDataFrame([(i, x, "z", "y") for i, x in enumerate(ODD)], "doc_id long, text string, decoded string, token_ids string")
    two, one, lists = bpe.decode(bpe.encode(df, path), path), bpe.round_trip(df, path), bpe.token_lists(df, path)
    row = lambda r: (r.doc_id, r.n_tokens, bytes(r.token_ids), r.decoded)
    assert sorted(map(row, two.collect())) == sorted(map(row, one.collect()))
    assert {r.doc_id: np.array(r.token_ids, "<i4").tobytes() for r in lists.collect()} == {r.doc_id: bytes(r.token_ids) for r in one.collect()}


def test_a_small_table_gives_the_same_ids(monkeypatch):
    texts = [f"some words {i} and others{i * 7} " * 5 for i in range(300)]
    want = list(bpe.Vocabulary(tokenizer_path()).encode_all(texts))
    monkeypatch.setattr(bpe, "TABLE_BYTES", 30_000)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 1000)
    monkeypatch.setattr(bpe, "TREE_ROWS", 7)
    v = bpe.Vocabulary(tokenizer_path())
    assert list(v.encode_all(iter(texts))) == want and v.held <= 30_000
