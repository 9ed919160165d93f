"""Decontamination, centroid clustering and the Merkle manifest: brute force on odd rows, hot keys and several rounds."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxelmill.llm import centroids, decontaminate, merkle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def brute_hits(docs, items, window=10):
    words = lambda t: WORD.findall((t or "").translate(ASCII_LOWER))
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def hits(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, key int")
    found = decontaminate.find_hits(d, b, **options)
    return found, sorted(map(tuple, decontaminate.digests(found).collect()), key=repr)


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("a b c é Ünder 7 x9 ſ".split())
    passage = [f"p{k}" for k in range(25)]
    items = [(1, " ".join(passage)), (2, "Short Item here"), (3, "one"), (4, ""), (5, None), (None, " ".join(f"q{k}" for k in range(12))), (6, " ".join(passage)), (6, " ".join(passage)), (7, "é É x9"), (10, "a a a a a a a a a a a a"), (20, " ".join(f"t{k}" for k in range(10)))]
    docs = [(1, None), (2, ""), (3, " ".join(passage[3:13])), (4, " ".join(passage[3:12])), (5, "A short item, here! ONE."), (6, "x " + " ".join(passage) + " y " + " ".join(passage[5:20])), (7, " ".join(f"q{k}" for k in range(12))), (7, "clean"), (7, "clean"), (None, "one")]
    docs += [(8, "a " * 5000), (9, "é É x9 \x85 z"), (10, ".,;"), (11, " ".join(word() for _ in range(3000)) + " " + " ".join(passage[2:16]) + "\n" + " ".join(f"T{k}" for k in range(10)))]
    docs += [(100 + k, " ".join(word() for _ in range(rng.randrange(40)))) for k in range(60)]
    found, got = hits(spark, docs, items)
    assert got == brute_hits(docs, items)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert spans[6] == [(1, 26), (27, 42)] and spans[1] == []
    for window, gram in ((3, 1), (4, 4), (5, 2)):
        assert hits(spark, docs, items, window=window, gram=gram)[1] == brute_hits(docs, items, window)


def test_decontamination_of_empty_tables(spark):
    some = [(1, "a b c"), (2, None)]
    assert hits(spark, [], some)[1] == []
    assert hits(spark, some, [])[1] == brute_hits(some, []) and not hits(spark, some, [])[1][0][-1]


def test_decontamination_of_shuffled_sides(spark, monkeypatch):
    """Beyond the broadcast's bytes the same rows come by shuffled joins."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    docs = [(k, " ".join(f"w{(k * j) % 13}" for j in range(40))) for k in range(40)]
    items = [(k, " ".join(f"w{(k * j) % 13}" for j in range(5, 5 + k))) for k in range(1, 20)]
    assert hits(spark, docs, items)[1] == brute_hits(docs, items)


def test_decontamination_stays_in_the_jvm(spark, sf):
    from voxelmill.llm.queries import QUERIES

    plan = QUERIES["op11_decontaminate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_clusters(rows, k=16, rounds=3, length=64, scale=64):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [list(v) for _, v in order[:k]] or [[0] * length]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        won = [near(v)[1] for _, v in kept]
        for n in set(won):
            own = [v for (_, v), w in zip(kept, won) if w == n]
            cents[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    own = {n: sum(d for _, c, d in found if c == n) for n in range(len(cents))}
    return sorted(((i, c, d, own[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def test_centroids_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(150)]
    rows += [(150 + k, rows[k % 3][1]) for k in range(40)] + [(7, rows[8][1]), (None, rows[9][1]), (400, None), (401, []), (402, [0.5] * 63), (403, [None] + [0.5] * 63), (404, [float("nan")] + [0.5] * 63), (405, [float("inf")] * 64), (406, [0.0] * 64), (407, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    got = centroids.with_digest(*centroids.cluster(df))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows)
    few = df.filter("vec_id in (3, 4, 402)")
    assert sorted(map(tuple, centroids.with_digest(*centroids.cluster(few)).collect()), key=repr) == brute_clusters([r for r in rows if r[0] in (3, 4, 402)])
    assert centroids.with_digest(*centroids.cluster(df.limit(0))).collect() == []
    assert centroids.with_digest(*centroids.cluster(df.filter("vec_id is null"))).count() == 1
    with pytest.raises(Exception, match="too great"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_tournament_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(0)
    cents = rng.integers(-2, 3, (9, 4))
    vectors = rng.integers(-2, 3, (500, 4))
    d = ((vectors[:, None] - cents[None]) ** 2).sum(2)
    assert (centroids.tournament(vectors, *centroids.bisectors(cents)) == d.argmin(1)).all()


def brute_manifest(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(put(v) for v in (r[0], r[3], r[2], r[4], text)))

    def build(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][a : a + 8])) for a in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            a = at - at % 8
            yield "".join(nodes[a:at]), "".join(nodes[at + 1 : a + 8])
            at //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        trees[g] = build([h for _, h in groups[g]])
    top = build([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (r, h) in enumerate(groups[g]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(ASCII_LOWER)
            sides = [*way(trees[g], at), *way(top, k)]
            value = leaf(r, text)
            for a, b in sides:
                value = sha(a + value + b)
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), value, value == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int, at int"


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], MANIFEST)
    return sorted(map(tuple, merkle.manifest(df).collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(k, f"Text {k}", ("en", "fr", None)[k % 3], "web", k) for k in range(700)]
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "No id", "en", "web", 5), (None, "no ID", "en", "web", 5), (12, "twice", "fr", "s", 1), (12, "Twice", "fr", "s", 1), (13, "X" * 200_000, "é", "ß", -1), (14, "alone", "zz", "a", 0)]
    rows += [(2000, "Same", "en", "web", 4)] * 9
    want = brute_manifest(rows)
    assert manifest(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, f"T{k}", "en", "web", k) for k in range(n)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_many_groups_and_none(spark):
    rows = [(k, f"T{k}", f"g{k % 77}", "web", k) for k in range(300)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, []) == []


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of eight leaves need a round a level."""
    monkeypatch.setattr(merkle, "STEP", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, f"T{k}", "en" if k % 5 else "de", "web", k) for k in range(700)]
    assert manifest(spark, rows) == brute_manifest(rows)
