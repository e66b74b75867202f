"""Shortest-pack-first packing, whitening and conversation repair against plain versions; their queries as well."""

import hashlib
import heapq
import random
import struct
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from canopygrid.llm import queries, shortest, turns, whiten
from canopygrid.session import cut_lineage

WORDS = public_tokenizers.path("word_bpe_49k.json")
POWERS = {1 << k for k in range(20)}


# ---------------------------------------------------------------- packing

def checked(parts, lengths, capacity, slack):
    """Every piece whole, every sequence gapless; returns the sequences' lengths."""
    by_piece, by_sequence = {}, {}
    for piece, start, size, sequence, at in parts:
        by_piece.setdefault(piece, []).append((start, size))
        by_sequence.setdefault(sequence, []).append((at, size))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_piece.pop(i)):
            assert start == at and size > 0
            at += size
        assert at == n
    fill = []
    for places in by_sequence.values():
        at = 0
        for start, size in sorted(places):
            assert start == at
            at += size
        fill.append(at)
    assert not by_piece and max(fill, default=0) <= capacity
    odd = [x for x in fill if x < capacity - slack]
    assert all(x in POWERS for x in odd) and sum(odd) < capacity
    return fill


@pytest.mark.parametrize("capacity", [1, 8, 16, 100, 2048])
def test_plans(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        slack = r.choice([0, capacity // 256, capacity // 16])
        some = r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 40)))
        counts = {n: r.choice([0, 1, r.randint(0, 5), r.randint(0, 200)]) for n in some}
        lengths = [n for n, c in counts.items() for _ in range(c)]
        ranks = [k for c in counts.values() for k in range(c)]
        find = shortest.Lookup(shortest.plan(counts, capacity, slack))
        parts = zip(*(c.tolist() for c in find(np.array(lengths, dtype=int), np.array(ranks, dtype=int))))
        fill = checked(parts, lengths, capacity, slack)
        assert sum(fill) == sum(lengths)


def test_shortest_pack_first():
    got = shortest.patterns({70: 2, 60: 1, 30: 3, 10: 1}, 100)
    # 70, 70 and 60 open packs; the three 30s go to 60, then 70 and 70; the 10 to the 90
    assert sorted((t, n, s) for t, n, s in got) == [(100, 1, ((60, 1), (30, 1), (10, 1))), (100, 2, ((70, 1), (30, 1)))]
    one = shortest.patterns({10: 7}, 100)
    assert one == [(70, 1, ((10, 7),))]
    huge = {n: 10 ** 12 + n for n in range(1, 2049)}  # the plan depends on the lengths, not on how many there are
    done = shortest.plan(huge, 2048, 8)
    assert len(done.whole) + len(done.cut) < 20_000
    with pytest.raises(ValueError):
        shortest.plan({9: 1}, 8, 0)


DOCS = [(1, "naip_scale 255.0 " * 900), (2, None), (3, ""), (4, "ndvi"), (4, "ndvi"), (None, "chm_clip_m 30"), (None, None),
        (5, "é漢字😀 ſK"), (6, "x" * 4000), *[(i, "class_names " * (i % 17)) for i in range(10, 90)]]


def test_pack_cfgs(cfgs, monkeypatch):
    tok = Tokenizer.from_file(WORDS)
    pieces = cut_lineage(shortest.cfg_pieces(cfgs(DOCS), WORDS, capacity=64))
    packed = shortest.pack_cfgs(pieces, capacity=64, slack=1)
    assert packed.columns == ["name", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = packed.collect()
    checked([(i, 0, r.length, r.sequence_id, r.offset) for i, r in enumerate(rows)], [r.length for r in rows], 64, 1)
    want, got = {}, {}
    for name, doc in DOCS:
        want.setdefault(name, []).extend(tok.encode(doc or "", add_special_tokens=False).ids + [1])
    for r in sorted(rows, key=lambda r: r.start):
        assert 4 * r.length == len(r.ids)
        got.setdefault(r.name, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for name, ids in want.items():
        assert sorted(sum(got[name], [])) == sorted(ids)
        if name not in (4, None):
            assert sum(got[name], []) == ids and {r.doc_tokens for r in rows if r.name == name} == {len(ids)}
    lines = {r.sequence_id: r.ids for r in shortest.sequences(packed).collect()}
    monkeypatch.setattr(shortest, "SENT_ROWS", 0)  # the table of earlier rows is joined by a shuffle
    assert sorted(map(str, shortest.pack_cfgs(pieces, capacity=64, slack=1).collect())) == sorted(map(str, rows))
    assert sum(map(len, lines.values())) == 4 * sum(map(len, want.values()))
    assert shortest.pack_cfgs(cut_lineage(shortest.cfg_pieces(cfgs([]), WORDS))).count() == 0


# ---------------------------------------------------------------- whitening

def chips(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1.0) for k, v in rows], "chip long, v array<double>, deviation string, whitened double")


def plain(vectors, components, scale=64, offset=1_000_000):
    """(n, sums, variances, components) with exact sums and a covariance from exactly centred rows."""
    x = sorted({tuple(int(np.floor(c * scale)) + offset for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, sums, values[::-1], vectors.T[::-1][:components], x


def assert_whitened(spark, rows, components=16):
    done, fit = whiten.whiten_chips(chips(spark, rows), components=components)
    assert done.columns == ["chip", "deviation", "whitened"]
    usable = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, values, _, _ = plain([v for _, v in usable], components)
    assert (fit.rows, list(fit.sums)) == (n, sums)
    k = len(fit.variances)
    assert np.allclose(fit.variances, values[:k], rtol=1e-7) and np.allclose(fit.explained, values[:k] / values.sum(), rtol=1e-7)
    assert np.abs(fit.components @ fit.components.T - np.eye(k)).max() < 1e-13
    assert fit.identity_error < 1e-9
    got = sorted((r.chip if r.chip is not None else -1, r.deviation, r.whitened) for r in done.collect())
    assert len(got) == len(usable)
    want = []
    for key, v in usable:
        x = [int(np.floor(c * 64)) + 1_000_000 for c in v]
        z = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)])
        want.append((key if key is not None else -1, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                     (fit.components @ z / np.sqrt(fit.variances)).tolist()))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2], b[2], rtol=1e-9, atol=1e-9)
    return fit


def test_whitening(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 20)) * np.geomspace(20, 0.1, 20)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (1, v[1].tolist()), (1, v[1].tolist())]
    rows += [(500, None), (501, []), (502, [None] + [0.0] * 19), (503, [float("nan")] * 20), (504, [float("inf")] * 20)]
    fit = assert_whitened(spark, rows)
    assert len(fit.variances) == 16 and fit.passes <= 5
    assert_whitened(spark, rows, components=3)


def test_whitening_of_nearly_dependent_bands(spark):
    """Variances twelve orders apart, far from zero: centred before multiplying, several passes."""
    r = np.random.default_rng(2)
    base = r.integers(-2 ** 20, 2 ** 20, size=(300, 3)).astype(float)
    v = np.column_stack([base, base.sum(axis=1) + r.integers(0, 2, 300) / 64, base[:, 0] + 1e6])
    done, fit = whiten.whiten_chips(chips(spark, [(i, x.tolist()) for i, x in enumerate(v)]))
    assert len(fit.variances) == 4  # the last column only repeats the first
    # the unit step is spread over x4 - x1 - x2 - x3 with x1 in two columns: a quarter over 3.5
    assert 0.068 < fit.variances[3] < 0.0715 and fit.variances[0] > 1e12
    assert fit.identity_error < 1e-4 and done.count() == 300


def test_whitening_without_variance(spark):
    done, fit = whiten.whiten_chips(chips(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert (fit.rows, len(fit.variances), fit.identity_error) == (1, 0, 0.0)
    assert [(r.deviation, r.whitened) for r in done.collect()] == [(0, [])] * 2
    done, fit = whiten.whiten_chips(chips(spark, []))
    assert fit is None and done.count() == 0 and done.columns == ["chip", "deviation", "whitened"]


def test_whitening_of_two_lengths_and_large_values(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [2.0 ** 40, 1.0]), (4, [1.0]), (5, [1e300, 0.0])]
    done, fit = whiten.whiten_chips(chips(spark, rows))
    got = {r.chip: (r.deviation, r.whitened) for r in done.collect()}
    assert fit.rows == 3 and set(got) == {1, 2, 3, 4} and got[4] == (None, None)
    assert got[3][0] is None and len(got[3][1]) == 2  # its deviation has no 64-bit number


# ---------------------------------------------------------------- repair

def least(codes):
    """Least (cost, letters) by uniform-cost search, without bounds or dominance by cost alone."""
    heap, seen = [(0, "", 0, turns.START)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(codes) and q in turns.FINAL:
            return cost, audit
        if (i, q) not in seen:
            seen.add((i, q))
            for letter, c, rows, to in turns.edits(codes[i:i + 1], q):
                heapq.heappush(heap, (cost + c, audit + letter, i + rows, to))


def test_search():
    r = random.Random(0)
    for _ in range(3000):
        codes = "".join(r.choice("suaxSUAX-uaua") for _ in range(r.randint(0, 9)))
        want = least(codes)
        assert turns.repair_plan(codes) == want
        assert turns.repair_plan(codes, turns.no_bounds) == want  # incumbent and dominance alone
    long = "".join(r.choice("sxXU-uauaua") for _ in range(5000))
    assert turns.repair_plan(long) == least(long)


def repaired(rows):
    """Plain version of the whole operator for one conversation: (turn, role, text) rows."""
    rows = [(t, " " if a is None else a, " " if b is None else b) for t, a, b in rows]
    digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x)))
    seen, faults, codes = set(), [], ""
    for t, a, b in rows:
        bare = b.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (a, b) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((a, b))
        faults.append(fault)
        c = a[:1] if a[:1] in ("s", "u", "a") else "x"
        codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit = least(codes)
    out, i = [], 0
    for letter in audit:
        want = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "K":
            out.append((rows[i][1], rows[i][2]))
        elif letter == "R":
            out.append((want, rows[i][2]))
        elif letter == "I":
            out.append((want, ""))
        i += letter != "I"
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:])]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), out


def talks(seed, n):
    r = random.Random(seed)
    for conv in [None, *range(n)]:
        for t in range(r.randint(0, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "uncle"])
            text = r.choice(["Hi.", "ok", " \t\n", "", None, "why?\n", "no! ", " ", "é…", "Hi.", f"{t}."])
            yield conv, r.choice([t, t, t, 3 * t, None]), role, text


def test_repair(spark):
    rows = list(talks(5, 300))
    rows += [(900, 1, "user", "x" * 300_000 + "."), (900, 2, "assistant", "y" * 300_000)] + [(901, t, "user", f"Turn {t}.") for t in range(3000)]
    df = spark.createDataFrame([(*x, "k", 7) for x in rows], "conv_id long, turn long, role string, text string, said string, place int")
    got = turns.repair_turns(df)
    report = {r.conv_id: tuple(r)[1:] for r in got.report.collect()}
    out = {}
    for r in sorted(got.turns.collect(), key=lambda r: r.place):
        assert r.place == len(out.setdefault(r.conv_id, []))
        out[r.conv_id].append((r.role, r.text))
    sha = {r.conv_id: r.sha256 for r in turns.digests(got.turns).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(tuple(row))
    assert set(report) == set(by_conv)
    for conv, said in by_conv.items():
        want, lines = repaired(said)
        assert report[conv] == want and out.get(conv, []) == lines
        assert sha.get(conv) == (hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() if lines else None)
    empty = turns.repair_turns(df.limit(0))
    assert empty.report.count() == empty.turns.count() == turns.digests(empty.turns).count() == 0


# ---------------------------------------------------------------- the queries

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*x, 1, 2) for x in DOCS], "doc_id long, text string, start int, offset int").write.parquet(f"{d}/documents.parquet")
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=8).astype("f4").tolist()) for i in range(200)] + [(None, [0.5] * 8), (7, [0.5] * 8), (8, None), (9, [None] * 8)]
    spark.createDataFrame([(*x, 3) for x in vectors], "vec_id long, embedding array<float>, component int").write.parquet(f"{d}/embeddings.parquet")
    talk = [(c, t, a, b) for c, t, a, b in talks(9, 120) if t is not None]
    spark.createDataFrame([(*x, 0) for x in talk], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{d}/conversations.parquet")
    return d


def test_op11(spark, folder):
    tok = Tokenizer.from_file(WORDS)
    rows = queries.QUERIES["op11_shortest_pack"](spark, folder).collect()
    checked([(i, 0, r.length, r.sequence_id, r.offset) for i, r in enumerate(rows)], [r.length for r in rows], 2048, 8)
    for name, doc in DOCS:
        ids = tok.encode(doc or "", add_special_tokens=False).ids + [1]
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == name and r.doc_tokens == len(ids))
        for start, length, crc in mine:
            part = ids[start:start + length]
            assert name is None or (len(part) == length and zlib.crc32(struct.pack(f"<{length}I", *part)) == crc)
    assert sum(r.length for r in rows) == sum(len(tok.encode(d or "", add_special_tokens=False).ids) + 1 for _, d in DOCS)


def test_op12(spark, folder):
    rows = queries.QUERIES["op12_whitening"](spark, folder).collect()
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and None not in r.embedding]
    n, sums, values, parts, _ = plain([v for _, v in given], 16)
    assert len(rows) == len(given) * 8 and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 9))
    for r in rows:
        assert abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    key, v = given[0]
    x = [int(np.floor(c * 64)) + 1_000_000 for c in v]
    for r in rows:
        if r.vec_id == key:
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = float(parts[r.component - 1] @ [a - s / n for a, s in zip(x, sums)]) / values[r.component - 1] ** 0.5
            assert abs(abs(r.whitened) - abs(want)) < 1e-6


def test_op13(spark, folder):
    done = queries.QUERIES["op13_structure_repair"](spark, folder)
    got = sorted(map(tuple, done.collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    sql = sorted(con.execute(queries.ORACLES["op13_structure_repair"]).fetchall(), key=str)
    assert got == sql
    text = lambda x: " " if x is None else str(x)
    by_conv = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        rows = by_conv.setdefault(r.conv_id, [])
        draw, role, said = zlib.crc32(f"{text(r.conv_id)}:{text(r.turn)}".encode()) % 20, text(r.role), text(r.text)
        if draw:
            said = "" if draw == 1 else said.translate(dict.fromkeys(map(ord, ".!?"))) if draw == 2 else said
            rows += [(r.turn, "user" if draw == 4 else role, said)] * (2 if draw == 3 else 1)
    want = []
    for conv, rows in by_conv.items():
        report, lines = repaired(rows)
        want.append((conv, *report, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op11_shortest_pack", "op12_whitening", "op13_structure_repair"])
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    full = queries.QUERIES[name](spark, folder)
    none = queries.QUERIES[name](spark, str(tmp_path))
    assert none.count() == 0 and none.dtypes == full.dtypes
