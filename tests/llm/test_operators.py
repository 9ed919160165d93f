import hashlib
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import ann, mixing, substring, topk, toxicity, urlfilter, warc
from voxelmill.llm.queries import ORACLE_SQL, QUERIES


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck(sf).execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def brute_substring(docs, window=20):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_op9_rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring"](spark, sf).collect()}
    assert got == brute_substring(docs)


def test_substring_of_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "", 5), (2, None, 5), (3, run, 5), (4, f"a b {run} c", 5), (5, "x " * 100, 5), (6, "short", 5), (7, run, 5), (7, run, 5), (None, run + " tail", 5), (8, "z\x85z\xa0 y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = substring.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert got == [(1, 0, 0, ""), (2, 0, 0, None), (3, 30, 0, run), (4, 33, 30, "a b c"), (5, 100, 99, "x"), (6, 1, 0, "short"), (7, 30, 30, ""), (7, 30, 30, ""), (8, 2, 0, "z\x85z\xa0 y"), (99, 31, 30, "tail")]
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" grubsnarf" + rng.choice(["ly", "ish", "", "ed"]) if i % 5 == 0 else ""), i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held for i in held) and len(held) == sum(got[i].held for i, _, _ in rows)
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.95
    assert got[9001].score == got[9002].score and 0 <= got[9001].score < 0.5
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_ranks_the_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op6_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    rank, bad = rows.score.rank(), rows.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.95 and rows.predicted[bad].mean() > 0.8 and rows.predicted[~bad].mean() < 0.01


def test_mixing_meets_its_targets(spark):
    rows = [(i, "a b c", "big" if i % 4 else "small", "en" if i % 3 else "de") for i in range(400)] + [(None, None, None, None), (500, "", "small", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("factor", F.lit("clash"))
    out = mixing.mix(df, {"source": {"big": 0.5, "small": 0.5}}, budget=0.3)
    assert out.count() == len(rows)
    share = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("keep_prob")).alias("t")).collect()}
    assert abs(share["big"] - share["small"]) < 1 and abs(share["big"] + share["small"] - 360) < 1
    assert out.filter("n_tokens = 0 and keep_prob is null").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    own = mixing.mix(df.withColumn("Topic", F.lit("t")).withColumn("keep_prob", F.lit("x")), topic=F.upper("topic"), budget=1.0)
    assert {r.topic for r in own.select(F.col("topic").alias("topic")).collect()} == {"T"} and dict(own.dtypes)["keep_prob"] == "double"


def test_near_duplicate_vectors_with_many_shards_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows, vecs = [], []
    for i in range(240):
        v = (base[i % 12] + rng.normal(size=8) * (0.0 if i % 5 == 0 else 0.08)).astype(np.float32)
        rows.append((i, v.tolist(), int(i % 12 // 4)))
        vecs.append(v.astype(float))
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] * 8, 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    ids, x, lab = [r[0] for r in rows] + [0], np.array([*vecs, vecs[0]]), np.array([r[2] for r in rows] + [0])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    comp = list(range(len(ids)))
    for _ in ids:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))], key=lambda k: (ids[k], k)) for i in range(len(ids))]
    want = sorted([(ids[i], int(near[i].sum()), ids[comp[i]]) for i in range(len(ids))] + [(r[0], 0, r[0]) for r in odd[:-1]])
    for size in (6000, 15):
        got = ann.near_duplicates(df, shard_rows=size)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert ann.near_duplicates(df.limit(0)).count() == 0


def test_top_k_of_odd_rows_and_pruning():
    rng = np.random.default_rng(2)
    q = rng.integers(-900, 900, (20, 16))
    x = np.concatenate([rng.integers(-900, 900, (64, 16)) + s for s in (0, 0, -3000, 3000)])
    ids = np.arange(len(x)) + 100
    blocks = [(ids[a : a + 16], x[a : a + 16], x[a : a + 16].min(0), x[a : a + 16].max(0)) for a in range(0, len(x), 16)]
    best = topk.Best(20, 5)
    scored = topk.search_blocks(np.full(20, -1), q, blocks, best)
    s = q @ x.T
    for k in range(20):
        order = np.lexsort((ids, -s[k]))[:5]
        assert best.id[k].tolist() == ids[order].tolist() and best.score[k].tolist() == s[k][order].tolist()
    assert scored < 20 * len(blocks)


def test_top_k_frame(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1e30, -1e30]), (None, [9.0, 9.0]), (200, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 1)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    big = [(0, [1.0, 0.0]), (1, [2.0**31, 0.0]), (2, [2.0**30 + 1024, 0.0]), (3, [-(2.0**31), 5.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2251799813685248), (2, 1125900980584448), (3, -2251799813685248)]
    rng = np.random.default_rng(6)
    for scale in (2.0**14, 2.0**17, 2.0**18):
        rows = [(i, (rng.normal(size=3) * scale).tolist()) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 5).collect()}
        z = [[int(np.floor(1024 * v)) for v in x] for _, x in rows]
        for q in (0, 100):
            best = sorted((-sum(a * b for a, b in zip(z[q], z[i])), i) for i in range(120) if i != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    over = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(over, over).collect()


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?casino"), (2, "https://example.net/fr/"), (3, "https://b.example.com/de/1#x"), (4, "x.org/fr/"), (5, None), (6, "http://q.org/fr/casino"), (7, "http://casinos.org/"), (8, "http://my-casino.org"), (9, "http://free.bets.org"), (10, "http://free-free.org"), (11, "http://net"), (12, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3] == ("b.example.com", "/de/1", "example.com/de/", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and [got[k][3] for k in (7, 8, 9, 10)] == ["allow", "block", "block", "allow"]
    assert got[11] == ("net", "", None, "allow") and got[12] == ("", "", None, "allow")


def test_urls_are_weighed_by_distinct_terms(spark):
    texts = ["free-bets", "bet-bets", "loan/loans", "free-online-game", "free-online-game-cash", "buy-cash-chat-coupon-deal", "buy-cash-chat-coupon-deal-hot", "cash-hot-games/" * 3,
             "pharmacies?x=prizes", "free_PILLS", "freepills", "xpoker-prize", "poker\u00e9prize", "my.TORRENT", "torrents", "", None, "word-" * 200_000 + "poker-" + "w" * 300_000 + "/slots", "x" * 500_000 + "poker-slots1"]
    rows = [(k, None if t is None else "http://h.org/" + t) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("soft_weight", F.lit("clash"))
    words = lambda t: {x for x in re.split("[^a-z0-9]+", t.lower())}

    def plain(t):
        have = words("http://h.org/" + t) if t is not None else set()
        hit = [w for term, w in urlfilter.SOFT.items() if have & set(urlfilter.forms(term))]
        return "block" if have & set(urlfilter.STRICT) or (len(hit) >= 2 and sum(hit) >= 6) else "allow"

    got = urlfilter.judge(df, rules=[]).collect()
    assert len(got) == len(rows) and all(r.verdict == plain(texts[r.page_id]) for r in got)
    by = {r.page_id: (r.verdict, r.soft_hits, r.soft_weight) for r in got}
    assert [by[k][0] for k in range(9)] == ["block", "allow", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert by[4] == ("block", 4, 6) and by[2] == ("allow", 1, 3) and by[16] == ("allow", 0, 0) and by[17][0] == "block" and by[18][0] == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0 and {r.verdict for r in urlfilter.judge(df, rules=[], strict=[], soft={}).collect()} == {"allow"}
    one = urlfilter.judge(df, rules=[], strict=[], soft={"pharmacy": 9, "prize": 1}, min_soft=1, limit=9)
    assert {r.page_id for r in one.filter("verdict = 'block'").collect()} == {8}
    assert all(x.isalnum() and x.isascii() and x == x.lower() for x in [*urlfilter.STRICT, *urlfilter.SOFT])


def test_archives_roll_and_come_back(spark, tmp_path):
    rows = [(k, f"http://a/{k}\r\n", f"<p>{k % 7}é" * 40) for k in range(-3, 60)] + [(None, None, "<p>1é" * 40), (70, "u", None), (71, "u", ""), (5, "again", "<p>5é" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = []
    for name, parts in (("a", 1), ("b", 5)):
        root = (tmp_path / name).as_uri()
        files.append(sorted((r.path, r.records, r.bytes, r.sha1) for r in warc.write_archives(df.repartition(parts), root, shard_bytes=6000, roll_bytes=700).collect()))
    assert files[0] == files[1] and len(files[0]) > 6 and sum(f[1] for f in files[0]) == len(rows)
    got = warc.read_archives(spark, root).collect()
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(r[0] for r in rows if r[0] is not None) and len(got) == len(rows)
    least = {}
    for k, _, h in rows:
        if k is not None:
            least[h or ""] = min(k, least.get(h or "", k))
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        text = html[r.page_id]
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == warc.digest(text.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == least[text] else ("revisit", least[text]))
        assert r.record_type == "revisit" or r.html == text
    empty = (tmp_path / "c").as_uri()
    assert warc.write_archives(df.limit(0), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_sparse_hot_and_rewritten_archives(spark, tmp_path):
    root = (tmp_path / "w").as_uri()
    sparse = spark.createDataFrame([(k * 1_000_003, f"u{k}", f"<p>{k}") for k in range(300)], "page_id long, url string, html string")
    assert warc.write_archives(sparse, root).count() == 1 and warc.read_archives(spark, root).count() == 300
    assert warc.write_archives(sparse.limit(5), root).count() == 1 and warc.read_archives(spark, root).count() == 5
    # the former version is gone, with what it held
    held = [f for f in (tmp_path / "w").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    assert len([f for f in held if f.name.endswith(".warc.gz")]) == 1 and len([f for f in held if f.parent.name == "manifest"]) == 1
    hot = spark.createDataFrame([(None if k % 2 else 7, f"u{k}", f"<p>{k}" * 20) for k in range(400)] + [(9, "long", "é" * 300_000)], "page_id long, url string, html string")
    files = warc.write_archives(hot, root, shard_bytes=20_000).collect()
    sizes = {}
    for f in files:
        sizes[f["shard"]] = sizes.get(f["shard"], 0) + f["records"]
    assert len(sizes) > 8 and max(sizes.values()) < 60
    got = warc.read_archives(spark, root)
    assert got.count() == 401 and {(r.url, r.html) for r in got.collect()} == {(r.url, r.html) for r in hot.collect()}


def test_a_retried_shard_and_an_unfinished_version(spark, tmp_path, monkeypatch):
    rows = [(k, f"u{k}", f"<p>{k}" * 30) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = (tmp_path / "r").as_uri()
    warc.write_archives(df, root)

    def attempt(fails):
        out = warc._ShardWriter(root, "version-0000000002", 0, 400)
        for k, (i, u, h) in enumerate(rows):
            if k == fails:
                return None  # lost with its executor
            out.add(warc.page_record(i, u, h.encode(), None))

        class Strict:  # a file system whose move refuses a name that is taken
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return getattr(self.fs, name)

            def move(self, a, b):
                if self.fs.get_file_info(b).type == pafs.FileType.File:
                    raise FileExistsError(b)
                self.fs.move(a, b)

        out.fs = Strict(out.fs)
        return out.commit()

    assert attempt(30) is None
    first = attempt(None)
    data = {f.name: f.read_bytes() for f in (tmp_path / "r/version-0000000002/data").iterdir()}
    assert attempt(None) == first and {f.name: f.read_bytes() for f in (tmp_path / "r/version-0000000002/data").iterdir()} == data
    # files without the archive's manifest are no version: the former one is read, and the next write goes past them
    assert warc.read_archives(spark, root).count() == 50
    with pytest.raises(ValueError, match="ends early"):
        list(warc.parse_records(next(iter(data.values()))[:-20]))
    assert {r.path.split("/")[0] for r in warc.write_archives(df.limit(7), root).collect()} == {"version-0000000003"}
    assert warc.read_archives(spark, root).count() == 7 and sorted(f.name for f in (tmp_path / "r").iterdir()) == ["_manifest", "version-0000000003"]


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "bpe"]
    clean = P.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    one = P.drop_near_copies(spark, docs, sf).collect()
    groups = {r.doc_id: r.component_id for r in QUERIES["op3_simhash"](spark, sf).collect()}
    assert {r.doc_id for r in one} == set(groups.values())
    cut = {r.doc_id: r.text for r in P.drop_substrings(spark, docs, sf).collect()}
    want = brute_substring([(r.doc_id, r.text) for r in docs.collect()])
    for r in docs.collect():
        assert hashlib.sha256(b" ".join(cut[r.doc_id].encode().split())).hexdigest() == want[r.doc_id][2]
    kept = {r.doc_id for r in P.mix_sources(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in QUERIES["op8_mixing"](spark, sf).filter("selected").collect()}
    assert 0 < P.run(spark, sf).count() <= len(one)


def test_links_across_borders_are_counted_once():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.03 * np.linalg.norm(base, axis=1, keepdims=True) / 4])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann.centres([("g", v) for v in x], len(x), shard_rows=40)
    assert len(c["g"]) > 10
    batch = ann.pa.record_batch({"grp": ["g"] * len(x), "node": range(len(x)), "unit": [v.tobytes() for v in x]})
    rows = [r for b in ann._members(type("B", (), {"value": c}), 0.98)([batch]) for r in b.to_pylist()]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.98)) if i != j}
    found = []
    for shard in {r["shard"] for r in rows}:
        own = [r for r in rows if r["shard"] == shard]
        node, duty = np.array([r["node"] for r in own]), ann._Duty(shard, [r["homes"] for r in own])
        i, j = np.nonzero((x[node] @ x[node].T >= 0.98) & ~np.eye(len(node), dtype=bool))
        keep = duty.of(i, j)
        found += zip(node[i[keep]].tolist(), node[j[keep]].tolist())
    assert len(want) > 300 and len(found) == len(set(found)) and set(found) == want
