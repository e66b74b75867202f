"""The numbered queries on a small folder of odd tables, against plain Python and the libraries."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from canopygrid.llm import bpe, queries

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LINE = "All rights reserved by the owners of this page and its parts in every country."


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def documents():
    r = random.Random(2)
    words = ["river", "stone", "green", "mira", "tolva", "ankle", "über", "été", "casa", "nube", "cloud", "paper", "light", "seven"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n)) + "."
    long = text(30_000)
    base = text(60)
    rows = [(1, base), (2, base), (3, base.replace("river", "delta", 1)), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "two words"),
            (9, long), (10, "漢字 😀 ſK ́x"), (11, "mail a.b@c-d.org or +1 (415) 555-0134, 10.0.0.12 and 4111 1111 1111 1111; not 300.1.1.1"),
            (12, base + "\n" + LINE), (13, text(40) + "\n" + LINE), (14, text(40) + "\n" + LINE), (14, "the same id with another text entirely, yes")]
    rows += [(20 + i, text(r.randint(1, 50))) for i in range(30)]
    return [(k, t, r.choice(["en", "de", None]), "web", len(t or ""), "x", 1) for k, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `_rank` int"
    spark.createDataFrame(documents(), schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=6).astype("f4").tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [1.0]), (303, [None] * 6), (5, [9.0] * 6)]
    spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    talk = [(c, t, role, text) for c in range(12) for t, (role, text) in enumerate(
        [("system", "be brief"), ("user", f"<s>[INST] {c}"), ("assistant", "</s> ok \\ |"), ("user", None), ("assistant", "")][: 2 + c % 4])]
    spark.createDataFrame([(*x, "z") for x in talk], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def given(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_op1(spark, folder, given):
    rows = run(spark, folder, "op1_packing")
    want = []
    for k, t in given:
        ids = WORDS.encode(t, add_special_tokens=False).ids + [0]
        want += [(k, i, a, len(ids[a:a + 2048]), crc(ids[a:a + 2048])) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    lines = {}
    for r in rows:
        lines.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in lines.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048
    assert len(lines) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_op2(spark, folder):
    rows = run(spark, folder, "op2_nearest")
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.vec_id < 300 and r.vec_id != 5}
    hit = total = 0
    for q in (0, 100, 200):
        mine = sorted((r.rank, r.score, r.vec_id) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        best = {k for _, k in sorted((np.sqrt(((v[q] - x) ** 2).sum()), k) for k, x in v.items() if k != q)[:10]}
        hit, total = hit + len(best & {m[2] for m in mine}), total + 10
        assert all(k == 5 or abs(s - np.sqrt(((v[q] - v[k]) ** 2).sum())) < 1e-12 for _, s, k in mine)
    assert {r.query_id for r in rows} == {0, 100, 200} and hit >= 0.9 * total


def test_op3(spark, folder, given):
    rows = run(spark, folder, "op3_fingerprints")
    assert sorted((r.doc_id, r.n_chars) for r in rows) == sorted((k, len(t)) for k, t in given)
    once = sorted(((k, t) for k, t in given if k != 14), reverse=True)  # the two texts of id 14 have no stated order
    texts = dict(once)
    order = [k for k, _ in once]
    for r in rows:
        if r.doc_id in texts and r.doc_id not in (13, 20):
            nxt = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            t, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
            assert r.edited_sha256 == sha(t[:len(t) - half] + nxt[:half])
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in rows:
        if r.doc_id in texts:
            prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op4(spark, folder, given):
    rows = run(spark, folder, "op4_near_duplicates")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(k, shingles(t)) for k, t in given]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[top(i)] = min(k, least.get(top(i), k))
    want = sorted((k, len(s), least[top(i)]) for i, (k, s) in enumerate(sets))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op5(spark, folder, given):
    ranks = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, t in given:
        ids = enc.encode_ordinary(t)
        want.append((k, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t)))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op5_bpe")) == sorted(want)


def test_op6(spark, folder, given):
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in run(spark, folder, "op6_token_files"))
    ids = {}
    for k, t in given:
        ids.setdefault(k, []).append(WORDS.encode(t, add_special_tokens=False).ids + [1])
    at = 0
    for start, k, n, c in rows:
        assert start == at and (n, c) in {(len(x), crc(x)) for x in ids[k]}
        at += n
    assert [r[1] for r in rows] == sorted(k for k, _ in given)


def test_op7(spark, folder):
    done = queries.QUERIES["op7_templates"](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["op7_templates"])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in done.collect()), key=str) == want


def test_op8(spark, folder, given):
    rows = run(spark, folder, "op8_language")
    assert sorted(r.doc_id for r in rows) == sorted(k for k, _ in given)
    texts = {}
    for k, t in given:
        texts.setdefault(k, []).append(t)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        blank = [not any(c.isalpha() for c in t) for t in texts[r.doc_id]]
        assert r.lang_pred in ({"und"} if all(blank) else {"en", "de"} | ({"und"} if any(blank) else set()))


def test_op9(spark, folder):
    rows = {r.conv_id: r for r in run(spark, folder, "op9_chat")}
    talk = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: r.turn):
        talk.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(rows) == set(talk)
    for k, turns in talk.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = rows[k]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, t in turns)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15)}


def test_op10(spark, folder, given):
    rows = run(spark, folder, "op10_private")
    want = []
    for k, t in given:
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in PATTERNS.items() for m in re.finditer(pattern, t) if ok(m.group())]
        want.append((k, sha(",".join(base))))
    assert sorted((r.doc_id, r.base_sha256) for r in rows) == sorted(want)
    (one,) = [r for r in rows if r.doc_id == 11]
    assert min(one.n_email, one.n_ip, one.n_card, one.n_phone) >= 1
