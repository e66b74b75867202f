"""Byte-level BPE, token files and packing against the libraries and plain loops."""

import random
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from canopygrid.llm import bpe, packing, tokenfiles
from canopygrid.llm.wordids import WordIds
from canopygrid.session import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = [(1, '{"num_classes": 7, "class_names": ["Tree", "Shrub"]}'), (2, None), (3, ""), (4, "naip_scale 255.0 " * 40),
        (4, "naip_scale 255.0 " * 40), (5, "é漢字😀\x1c ſK\n\n  x"), (None, "chm_clip_m 30"), (6, "a" * 3000), (7, " ")]


@pytest.fixture(scope="module")
def reference():
    v = bpe.Vocabulary.read(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_merges_equal_the_library(reference):
    enc, r = bpe.Encoder(bpe.Vocabulary.read(RANKS), public_tokenizers.PATTERN), random.Random(1)
    texts = ["".join(r.choice("ab cdé\n\t'sß漢あ😀\x1c\xa01२.,") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 5000, "ab" * 700, "x" * 257, "th" * 128]
    for t, ids in zip(texts, enc(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert enc.vocab.decode(ids) == t.encode()


def test_encode_docs(cfgs, reference):
    df = bpe.encode_docs(cfgs(DOCS), RANKS, public_tokenizers.PATTERN, decoded="back")
    rows = df.collect()
    assert len(rows) == len(DOCS) and df.columns == ["name", "n_tokens", "ids", "back"]
    for (name, doc), r in zip(DOCS, rows, strict=True):
        want = reference.encode_ordinary(doc or "")
        assert (r.name, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.back)) == (name, len(want), want, (doc or "").encode())
    again = bpe.decode_docs(df.drop("back"), RANKS).collect()
    assert [bytes(r.doc_bytes) for r in again] == [(d or "").encode() for _, d in DOCS]
    assert bpe.encode_docs(cfgs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    w, r = WordIds(WORDS), random.Random(2)
    texts = ["".join(r.choice("ab Cdé\n'sß漢😀\x1c\xa01२.,!́ſKİµª\x85 Σσ|#") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for t, ids in zip(texts, w(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.tok.encode(t, add_special_tokens=False).ids
    small = WordIds(WORDS, word_bytes=4000, stem_bytes=2000)  # ages many times, with the same ids
    assert [x for i in range(0, 1500, 10) for x in small(texts[i:i + 10])] == w(texts)
    assert small.words.old and len(small.words) + len(small.words.old) < 300


def test_token_files(spark, cfgs):
    tok = Tokenizer.from_file(WORDS)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    docs = [(n, d) for n, d in DOCS if n is not None]
    random.Random(3).shuffle(docs)
    tokenfiles.write_tokens(cfgs(docs), path, WORDS, end_id=1, files=3)
    got = tokenfiles.with_starts(tokenfiles.summaries(tokenfiles.read_tokens(spark, path))).orderBy("start").collect()
    at, want = 0, []
    for n, d in sorted(docs, key=lambda x: x[0]):
        ids = tok.encode(d or "", add_special_tokens=False).ids + [1]
        want.append((n, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert [(r.name, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    found = tokenfiles.read_tokens(spark, path, tokenfiles.F.col("name") == 6)
    assert found.count() == 1
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,6)]" in found._jdf.queryExecution().toString()
    empty = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(cfgs([]), empty, WORDS)
    assert spark.read.schema("name long, part int, ids array<int>").orc(empty).count() == 0


def laid_out(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; returns how many there are."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_is_gapless_and_tight():
    r = random.Random(4)
    for _ in range(120):
        cap = r.choice([10, 30, 64, 2048])
        counts = {}
        for _ in range(r.randint(1, 200)):
            n = r.randint(1, cap) if r.random() < 0.5 else r.randint(1, max(1, cap // 4))
            counts[n] = counts.get(n, 0) + r.choice([1, 2, 7, 60])
        rows = [(f + (k - a) // e, o + ((k - a) % e) * n, n) for n, a, b, f, e, o in packing.plan(counts, cap) for k in range(a, b)]
        got = {}
        for _, _, n in rows:
            got[n] = got.get(n, 0) + 1
        assert got == counts
        total = sum(n * c for n, c in counts.items())
        large = sum(c for n, c in counts.items() if 2 * n > cap)
        assert laid_out(rows, cap) <= max(1.25 * max(total / cap, large) + 1, 1)


def test_large_items_pair_at_most_twice():
    rows = packing.plan({700: 5, 1000: 3, 1300: 2, 2048: 1}, 2048)
    per = {}
    for n, a, b, f, e, _ in rows:
        for k in range(a, b):
            per.setdefault(f + (k - a) // e, []).append(n)
    assert max(map(len, per.values())) == 2 and [2048] in per.values()
    assert sorted(x) == [700, 1300] if (x := per[1]) else True


def test_pack_documents(spark, cfgs):
    tok = Tokenizer.from_file(WORDS)
    pieces = packing.pieces_of(cfgs(DOCS), WORDS, capacity=50).cache()
    for n, d in DOCS:
        ids = tok.encode(d or "", add_special_tokens=False).ids + [0]
        got = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in pieces.where(f"name <=> {n or 'null'}").distinct().collect())
        raw = np.array(ids, "<u4").tobytes()
        assert got == [(i, a, min(50, len(ids) - a), raw[4 * a:4 * (a + 50)]) for i, a in enumerate(range(0, len(ids), 50))]
    packed = packing.pack(pieces, capacity=50).cache()
    rows = packed.collect()
    assert len(rows) == pieces.count()
    n = laid_out([(r.sequence_id, r.offset, r.length) for r in rows], 50)
    assert n <= -(-sum(r.length for r in rows) // 50) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(pieces.limit(0), capacity=50).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, None)], "name long, piece int, length long"))


def test_hot_length_is_ranked_once_each(spark):
    rows = spark.range(5000).selectExpr("id as name", "0 as piece", "CASE WHEN id % 3 = 0 THEN 2048L ELSE 1 + id % 700 END as length")
    packed = packing.pack(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == 5000
    laid_out([(r.sequence_id, r.offset, r.length) for r in packed], 2048)


def test_token_files_are_summed_up_once(spark, cfgs):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(cfgs([(n, d) for n, d in DOCS if n is not None]), path, WORDS, end_id=1, files=3)
    starts = tokenfiles.with_starts(tokenfiles.summaries(tokenfiles.read_tokens(spark, path)))
    assert "MapInArrow" not in starts._jdf.queryExecution().toString()  # neither level reads the files again
