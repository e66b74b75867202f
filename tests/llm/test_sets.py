"""Near duplicates, nearest chips and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopygrid.llm import nearest, neardup, shingles


def shingle(t):
    w = (t or "").encode("utf-8").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def brute(docs):
    sets, parent = [shingle(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(docs):
        least.setdefault(top(i), []).append(k)
    return {k: (len(sets[i]), min(least[top(i)])) for i, (k, _) in enumerate(docs)}


def corpus(n_base, copies, edits, seed):
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(n_base):
        base = [word() for _ in range(r.randint(30, 90))]
        for _ in range(r.choice(copies)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


def check(cfgs, docs):
    want = brute(docs)
    rows = neardup.near_duplicates(cfgs(docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.name] and r.kept == (r.component_id == r.name)


def test_near_duplicates_equal_brute_force(cfgs):
    docs = corpus(30, [1, 1, 2, 5, 12], 4, 1)
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one"), (n + 6, "x" * 5000), (n + 7, docs[0][1])]
    check(cfgs, docs)


def test_large_group_of_varied_copies(cfgs, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 16)  # so that points, blocks and branches all take part
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "WORK", 2000)
    check(cfgs, corpus(2, [160], 7, 2) + [(5000 + i, t) for i, t in corpus(10, [1, 3], 2, 3)])


def test_near_duplicates_of_nothing_and_repeats(cfgs):
    assert neardup.near_duplicates(cfgs([])).count() == 0
    rows = neardup.near_duplicates(cfgs([(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "zz yy")])).collect()
    assert sorted((r.name, r.component_id, r.kept) for r in rows if r.name) == [(2, 2, True), (3, 2, False), (3, 2, False)]
    assert [r.kept for r in rows if r.name is None] == [True]


def test_one_row_of_each_group_stays(cfgs):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k).replace(f"w{k}x30 ", "other ")
    docs = [(None, text(1)), (None, near(1)), (None, text(1)),  # a group without keys
            (None, text(2)), (7, near(2)),  # a key goes before none
            (8, text(3)), (8, text(3)), (8, near(3)),  # repeated rows, one key on near texts
            (9, text(4)), (9, text(5)),  # one key on different texts
            (None, text(6)), (None, None), (None, "")]
    rows = neardup.near_duplicates(cfgs(docs)).collect()
    assert len(rows) == len(docs) and sum(r.kept for r in rows) == 8
    kept = neardup.keep_one(cfgs(docs), name="name", doc="doc")
    assert kept.columns == cfgs(docs).columns
    got = [(r.name, r.doc) for r in kept.collect()]
    assert len(got) == 8 and set(docs[3:5]) & set(got) == {(7, near(2))} and {docs[8], docs[9], *docs[10:]} <= set(got)
    assert sum(k == 8 for k, _ in got) == 1 and sum(t in (text(1), near(1)) for _, t in got) == 1


def test_signatures_estimate_likeness():
    a, b = shingles.shingle_sets(["w%d " % i * 1 for i in [0]] + ["x"])[:2]
    assert len(a) == len(b) == 1 and a[0] != b[0]
    base = " ".join(f"w{i}" for i in range(400))
    near = shingles.shingle_sets([base, base.replace("w50 ", "q "), base.upper()])
    assert np.array_equal(near[0], near[2]) and len(near[0]) == 396
    sig = shingles.signatures(near)
    assert (sig[0] == sig[1]).mean() > 0.85


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.cid: r.label for r in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


def chips(spark, rows):
    return spark.createDataFrame(rows, "chip long, v array<float>, list string")


def test_nearest_chips(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    v[300:800] = v[5]  # a third of all chips are the same
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(2000, None, "x"), (2100, [0.0] * 16, "x"), (2200, [float("nan")] * 16, "x"), (2300, [None] + [1.0] * 15, "x"), (100, v[100].tolist(), "x")]
    df = chips(spark, rows)
    got = {}
    for x in nearest.nearest_chips(df, df.where("chip % 100 = 0")).collect():
        got.setdefault(x.query, []).append((x.rank, x.score, x.chip))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(v)), d))[:10]
        assert [x[0] for x in sorted(found)] == list(range(1, 11))
        assert all(x[1] == pytest.approx(d[x[2]], abs=1e-12) for x in found)
        hit += len({x[2] for x in found} & set(want.tolist()))
    assert hit / (10 * len(got)) >= 0.9
    assert [x[2] for x in sorted(got[400])] == [5, *range(300, 309)]  # ties go to the smaller id


def test_few_chips(spark):
    df = chips(spark, [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [1.0, 0.5], "x")])
    got = nearest.nearest_chips(df, df.where("chip = 0")).orderBy("rank").collect()
    assert [(r.query, r.rank, r.chip) for r in got] == [(0, 1, 2), (0, 2, 1)]
    assert nearest.nearest_chips(df.limit(0), df.limit(0)).count() == 0
    mixed = df.unionByName(chips(spark, [(3, [1.0], "x"), (4, [1.0, 2.0, 3.0], "x")]))  # those of another length take no part
    assert [(r.query, r.chip) for r in nearest.nearest_chips(mixed, mixed).orderBy("query", "rank").collect()] == [(0, 2), (0, 1), (1, 2), (1, 0), (2, 0), (2, 1)]


def test_graph_search_finds_the_nearest():
    r = np.random.default_rng(5)
    g = nearest.Graph.build(r.normal(size=(300, 8)))
    q = r.normal(size=(200, 8))
    ids, dist = g.search(q)
    d = np.sqrt(((q[:, None] - g.points) ** 2).sum(axis=2))
    assert (ids[:, 0] == d.argmin(axis=1)).mean() > 0.95
    assert np.allclose(dist, np.take_along_axis(d, ids, axis=1)) and (np.diff(dist, axis=1) >= 0).all()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    named = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near duplicates", "personal data", "packing"]
    told = named["language"](spark, docs, sf).cache()
    assert told.columns == columns and told.count() >= 0.97 * len(before)
    lined = named["lines"](spark, told, sf).cache()
    assert lined.columns == columns and lined.where("n_chars <> length(text)").isEmpty()
    assert {r.doc_id for r in lined.collect()} <= {r.doc_id for r in told.collect()}
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    one = named["near duplicates"](spark, lined, sf).cache()
    assert {r.doc_id for r in one.collect()} == {k for k, (_, c) in brute(rows).items() if k == c}
    safe = named["personal data"](spark, one, sf).cache()
    assert safe.columns == columns and safe.count() == one.count()
    from canopygrid.llm.private import base_spans
    assert not any(base_spans(r.text or "") for r in safe.collect())
    last = named["packing"](spark, safe, sf)
    assert last.select("doc_id").distinct().count() == safe.count()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
