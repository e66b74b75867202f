"""Fingerprints, line templates, language, chat and personal data against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import boilerplate, chat, fingerprints, language, private, templates
from canopygrid.llm.tagger import Tagger


def test_winnow_equals_plain_loops(spark, cfgs):
    k, w, r = 12, 16, random.Random(1)
    texts = [None, ""] + ["".join(r.choice("abé😀 c") for _ in range(n)) for n in (1, 11, 12, 20, 27, 28, 60, 500, 9000)] + ["a" * 3000, "a" * 3000]
    df = fingerprints.fingerprint_docs(cfgs(list(enumerate(texts))))
    rows = df.select("name", "doc", "prints", fingerprints.digest("prints").alias("d")).orderBy("name").collect()
    grams = [(i, j, t[j:j + k].encode("utf-32-be")) for i, t in enumerate(texts) if t for j in range(max(1, len(t) - k + 1))]
    h = {}
    for x in spark.createDataFrame(grams, "i int, j int, g binary").select("i", "j", F.hash("g").alias("h")).collect():
        h.setdefault(x.i, {})[x.j] = x.h
    for x in rows:
        hashes = [h[x.name][j] for j in range(len(h.get(x.name, ())))]
        want = []
        for a in range(max(1, len(hashes) - w + 1) if hashes else 0):
            win = hashes[a:a + w]
            pos = a + max(i for i, v in enumerate(win) if v == min(win))
            if (min(win), pos) not in want[-1:]:
                want.append((min(win), pos))
        assert [(p["hash"], p["pos"]) for p in x.prints] == want
    assert rows[-1].d == rows[-2].d and rows[0].d == rows[1].d
    assert fingerprints.fingerprint_docs(cfgs([])).count() == 0
    with pytest.raises(ValueError):
        fingerprints.winnow("doc", 12, 24)


def test_shared_passage_is_found(spark):
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(12 + 16 - 1))
    rows = [("".join(r.choice("xyz ") for _ in range(r.randint(0, 90))) + passage + "".join(r.choice("uvw") for _ in range(50)),) for _ in range(2)]
    a, b = (set(x[0]) for x in spark.createDataFrame(rows, "doc string").select(fingerprints.winnow("doc")["hash"]).collect())
    assert a & b


def test_next_document_and_likeness(spark, cfgs):
    r = random.Random(3)
    keys = r.sample(range(-500, 90000), 600) + [7]
    docs = [(k, f"doc {k}") for k in keys] + [(7, "again"), (None, "no key")]
    rows = fingerprints.with_next(cfgs(docs)).withColumn("nxt", fingerprints.ahead("doc")).where("not guest").collect()
    assert len(rows) == len(docs)
    nxt = {(x.key, x.doc): x.nxt for x in rows}
    order = sorted({k for k in keys if k != 7}, reverse=True)
    for a, b in zip(order, order[1:], strict=False):
        if not b < 7 < a:
            assert nxt[a, f"doc {a}"] == f"doc {b}"
    assert nxt[None, "no key"] == f"doc {order[0]}"  # the last looks at the first
    one = fingerprints.with_next(cfgs([(5, "alone")])).withColumn("nxt", fingerprints.ahead("doc")).where("not guest").first()
    assert one.nxt == "alone"
    assert fingerprints.with_next(cfgs([])).count() == 0
    near = spark.sql("SELECT array(1,2,3) a, array(2,3,4) b, array() c").select(
        fingerprints.likeness("a", "b"), fingerprints.likeness("a", "a"), fingerprints.likeness("c", "c"), fingerprints.likeness("a", "c")).first()
    assert tuple(near) == (0.5, 1.0, 1.0, 0.0)


def test_outlying_keys_leave_buckets_even(cfgs, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 5)
    keys = [*range(2000), 10**15, 10**15 + 7, -10**18, None, None]
    rows = fingerprints.with_next(cfgs([(k, f"doc {k}") for k in keys])).withColumn("nxt", fingerprints.ahead("doc")).where("not guest").collect()
    order = sorted((k for k in keys if k is not None), reverse=True)
    after = {r.key: r.nxt for r in rows if r.key is not None}
    assert all(after[a] == f"doc {b}" for a, b in zip(order, order[1:]))
    held = {}
    for r in rows:
        held[r.bucket] = held.get(r.bucket, 0) + 1
    assert max(held.values()) <= 20


def test_a_column_of_the_same_name_is_replaced(cfgs):
    df = cfgs([(1, "ndvi and chm")])
    assert fingerprints.fingerprint_docs(df.withColumnRenamed("key", "prints")).columns == ["name", "doc", "prints", "text"]


def test_templates_drop_recurring_lines(spark):
    own = lambda k: "\n".join(f"unique words of run {'abcdefghij'[k % 10]} number {'klmnop'[k // 10]} line {c} here" for c in "qrs")
    logs = [(k, f"{own(k)}\nepoch {k} done in {k * 7} sec\nshort line\n") for k in range(20)]
    logs += [(20, logs[3][1]), (20, logs[3][1]), (21, None), (22, ""), (None, "epoch 1 done in 7 sec")]
    df = spark.createDataFrame([(k, d, "x") for k, d in logs], "run_dir long, log string, line string")
    out = templates.drop_templates(df, dropped="gone")
    rows = {}
    for r in out.collect():
        rows.setdefault(r.run_dir, []).append(r)
    assert out.columns == ["run_dir", "log", "line", "gone"] and len(rows[20]) == 2
    assert rows[0][0].log == logs[0][1] and rows[0][0].gone == 0  # the first occurrence stays
    for k in range(1, 20):
        assert "epoch" not in rows[k][0].log and "short line" not in rows[k][0].log
    # copies keep the lines that only copies share
    assert rows[20][0].log == rows[20][1].log == rows[3][0].log != logs[3][1]
    assert rows[21][0].log is None and rows[22][0].log == "" and rows[None][0].log == "epoch 1 done in 7 sec"
    assert templates.drop_templates(df.limit(0)).count() == 0


def test_templates_take_in_variants(spark):
    base = "loaded the checkpoint for model resnet with all weights from disk today"
    filler = lambda k: f"something else entirely {chr(97 + k) * 5} and more {chr(98 + k) * 4} words"
    logs = [(k, f"{filler(k)}\n{base}") for k in range(4)] + [(9, f"{filler(9)}\n{base.replace('resnet', 'swin')}"), (10, base.replace("weights from disk today", "a b c d"))]
    rows = {r.run_dir: r.log for r in templates.drop_templates(spark.createDataFrame(logs, "run_dir long, log string")).collect()}
    assert base in rows[0] and all(base not in rows[k] for k in (1, 2, 3))
    assert "swin" not in rows[9] and rows[10] == logs[5][1]


def test_templates_let_words_vary(spark):
    names, towns = "anna bert carl dora emil fritz gerd hanna ida jens".split(), "Paris Rome Oslo Bonn Kiel Bern Graz Linz Ulm Jena".split()
    say = [lambda i: f"the user account {names[i]} signed in from the office at {towns[i]} this very morning",
           lambda i: f"the user account was then closed by {names[i]} after a call with {towns[i]} this noon"]
    doc = lambda k, *more: "\n".join([*own_lines(k), *more])
    rows = [(i, doc(i, say[i % 2](i // 2))) for i in range(20)]  # two groups of one path, every wording once
    rows += [(30 + i, "\n".join([*own_lines("copied", 16), f"a line of copies only in which the word {names[i]} varies each time"])) for i in range(6)]
    rows += [(40, doc(40, "the user account moved over to some quite unlike plan for its last days today"))]  # same path, alike to none
    # near copies: every line differs in a word, so only their shingles tell them
    rows += [(50 + i, "\n".join(" ".join([*own_lines(f"near {c}"), names[i]]) for c in range(4))) for i in range(4)]
    # a path with two recurring templates, and a variant of each
    loaded = ["loaded the checkpoint for model resnet with all weights from disk today", "loaded the checkpoint and then wrote all of its tensors out again"]
    rows += [(60 + i, doc(60 + i, loaded[i > 3])) for i in range(7)]
    rows += [(70, doc(70, loaded[0].replace("resnet", "swin"))), (71, doc(71, loaded[1].replace("tensors", "layers")))]
    got = {r.run_dir: (r.log, r.n) for r in templates.drop_templates(spark.createDataFrame(rows, "run_dir long, log string"), dropped="n").collect()}
    texts = dict(rows)
    stay = {0, 1, *range(30, 36), 40, *range(50, 54), 60, 64}  # the first of each group, copies, what is alike to none
    assert {k for k in got if got[k] == (texts[k], 0)} == stay
    assert all(got[k] == (doc(k), 1) for k in got if k not in stay)


def test_templates_move_only_lines_in_company(spark):
    words = "a lone line of its own here|the common path goes on with one|the common path goes on with two|a line that stands twice here|Short one".split("|")
    docs = spark.createDataFrame([(1, "\n".join(words[:2])), (2, "\n".join(words[2:])), (3, "\n".join([*words[3:], "", " \t "])), (None, words[0])], "run_dir long, log string")
    rows = templates.line_rows(docs, "run_dir", "log").cache()
    assert rows.count() == 7
    assert {(r.key, r.line) for r in templates.company(rows).collect()} == {(1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)}
    # the bitmap loses no key, nulls included, and lets few others through
    every, keys = spark.range(20000).selectExpr("nullif(id, 19998) AS id"), spark.range(0, 20000, 7).selectExpr("nullif(id, 7) AS k")
    got = [r.id for r in templates.among(every, "id", keys).collect()]
    assert {None, *range(0, 20000, 7)} - {7, None} <= set(got) and None in got and len(got) < 2900 and len(set(got)) == len(got)
    assert templates.among(every, "id", keys.limit(0)).count() == 0


def test_tokens_of_lines_with_odd_blanks(spark):
    lines = ["", " ", "one", " lead and 5 trail\t", "two  spaces x1y 22", "tab\tand\x0bvt\x0cff\rcr", "a1 b <*> 2c d\u00a0e3 f", "\t\tab9  cd", "\U0001f600x1 \u00e9t\u00e9 9\u00e9", None]
    rule = lambda s: ["<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r\x0b\x0c]+", s.strip(" \t\r\x0b\x0c"))]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", templates.tokens_of(F.col("line")).alias("t")).collect()
    assert [r.t for r in rows] == [None if x is None else rule(x) for x in lines]


def test_templates_count_documents_not_copies(spark):
    shared, short = "this line stands in different documents here", "All rights reserved."
    text = lambda k, *more: "\n".join([*own_lines(k), *more])
    logs = [(1, text("a", shared)), (2, text("a", shared)), (3, text("b", shared)), (4, text("b", shared))]
    logs += [(10 + i, text(f"s{i}", short)) for i in range(20)] + [(40 + i, text(f"r{i}", "Only a few.")) for i in range(5)]
    logs += [(100 + i, text("copied", "end of the copied text here")) for i in range(30)]
    logs += [(200 + i, text("copied", "end of the copied text here").replace(own_lines("copied")[i % 4], f"changed {i}")) for i in range(8)]
    got = {r.run_dir: (r.log, r.n) for r in templates.drop_templates(spark.createDataFrame(logs, "run_dir long, log string"), dropped="n").collect()}
    assert [got[k][1] for k in (1, 2, 3, 4)] == [0, 0, 1, 1] and shared not in got[3][0]
    assert [got[10 + i][1] for i in range(20)] == [0] + [1] * 19
    assert all(got[40 + i][1] == 0 for i in range(5))  # short lines need more documents
    assert all(got[100 + i][1] == 0 for i in range(30))  # copies keep what only copies share


def own_lines(k, n=4):
    r = random.Random(f"own {k}")
    return [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(n)]


def test_boilerplate_counts_classes_not_copies(spark):
    shared, block = "this line stands in different documents here", [f"block line {c} travels with the others always" for c in "pqr"]
    doc = lambda k, *more: "\n".join([*own_lines(k), *more])
    texts = [doc("a", shared)] * 2 + [doc("b", shared)] * 2  # A, A, B, B
    texts += [doc("c", "a line of one text copied and of others")] * 60 + [doc(f"d{i}", "a line of one text copied and of others") for i in range(20)]
    texts += [doc(f"e{i}", *block) for i in range(12)]
    texts += [doc("f").replace(own_lines("f")[0], own_lines("f")[0] + f" {c}") for c in "xyz"] + [doc("g")] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, doc("h", shared)), (0, doc("i", shared))]
    got = boilerplate.drop_boilerplate(spark.createDataFrame(rows, "run_dir long, log string"), dropped="gone").collect()
    by = {r.run_dir: r for r in got if r.run_dir}
    assert len(got) == len(rows)
    # the first text of a line keeps it in all its copies
    firsts = [r for r in got if shared in r.log]
    assert {r.log for r in firsts} in ({doc("a", shared)}, {doc("i", shared)}) and all(r.gone == 0 for r in firsts)
    assert by[2].log == by[3].log == doc("b") and [r.log for r in got if r.run_dir is None] == [doc("h")]
    assert all(by[i].log == texts[i] for i in range(4, 64)) and all(by[i].log == doc(f"d{i - 64}") for i in range(64, 84))
    assert by[84].log == texts[84] and all(by[i].log == doc(f"e{i - 84}") for i in range(85, 96))
    # near and exact copies are left whole
    assert all(by[i].log == texts[i] for i in range(96, len(texts)))
    assert boilerplate.drop_boilerplate(spark.createDataFrame([], "run_dir long, log string")).count() == 0


def test_boilerplate_takes_short_lines(spark):
    doc = lambda k, *more: "\n".join([*own_lines(k), *more])
    rows = [(i, doc(i, "All rights reserved.", " ", "", str(1000 + i), f"page {i}")) for i in range(12)]
    rows += [(20 + i, doc(f"few {i}", "Yes indeed.")) for i in range(3)] + [(30 + i, doc("copied", "The end.")) for i in range(40)]
    got = {r.run_dir: r.log for r in boilerplate.drop_boilerplate(spark.createDataFrame(rows, "run_dir long, log string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == doc(i, " ", "", str(1000 + i)) for i in range(1, 12))
    assert all(got[k] == t for k, t in rows[12:])


def test_boilerplate_lets_words_vary(spark):
    names, towns = "anna bert carl dora emil fritz gerd hanna ida jens".split(), "Paris Rome Oslo Bonn Kiel Bern Graz Linz Ulm Jena".split()
    say = [lambda i: f"the user account {names[i]} signed in from the office at {towns[i]} this very morning",
           lambda i: f"the user account was then closed by {names[i]} after a call with {towns[i]} this noon"]
    rows = [(i, "\n".join([*own_lines(i), say[i % 2](i // 2)])) for i in range(20)]  # two groups of one path, every wording once
    rows += [(30 + i, "\n".join([*own_lines("copied"), f"a line of copies only in which the word {names[i]} varies each time"])) for i in range(6)]
    other = "the user account moved over to some quite unlike plan for its last days today"  # same path, alike to none
    rows += [(40, "\n".join([*own_lines(40), other]))]
    got = {r.run_dir: (r.log, r.gone) for r in boilerplate.drop_boilerplate(spark.createDataFrame(rows, "run_dir long, log string"), dropped="gone").collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == (rows[1][1], 0)  # the first of each group stays
    assert all(got[i] == ("\n".join(own_lines(i)), 1) for i in range(2, 20))
    assert all(got[k] == (t, 0) for k, t in rows[20:])


def test_alike_templates_meet_every_centre(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "CENTRES", 2)
    r = random.Random(7)
    base = [["same"] * 3 + [r.choice("abcdefgh") * 3 for _ in range(7)] for _ in range(30)]  # all share their first part
    rests = [b if k == 0 else [*b[:j], f"w{k}", *b[j + 1:]] for b in base for k, j in ((0, 0), (1, 5), (2, 8))]
    rows = [(i, 5 if i % 3 == 0 else 1, 1, x) for i, x in enumerate(rests)]
    got = boilerplate.alike_templates(spark.createDataFrame(rows, "template long, n long, leaf long, rest array<string>")).collect()
    alike = lambda a, b: sum(x == y for x, y in zip(rests[a], rests[b])) >= 8
    assert all(alike(x.a, x.b) for x in got) and len({x.a for x in got}) == len(got)
    joined = {x.a for x in got}
    better = lambda a, b: (-rows[b][1], b) < (-rows[a][1], a)
    # what joined nothing is unlike everything that joined nothing, however many share a part
    alone = [i for i in range(len(rests)) if i not in joined]
    assert all(i in joined for i in range(len(rests)) if i % 3) and not any(alike(a, b) for a in alone for b in alone if better(a, b))


LANGS = {"en": "the of and to in is that was for on are with this from have", "de": "der die und das von mit nicht ein auf ist zu den im für auch",
         "es": "de la que el en los se del las por un para con una su"}


def test_language(spark, cfgs):
    r = random.Random(5)
    say = lambda lang, n: " ".join(r.choice(LANGS[lang].split()) for _ in range(n)).capitalize()
    train = [(say(x, 60), x) for x in LANGS for _ in range(80)] + [(None, "en"), ("x", None)] + [("the same text", "en")] * 500
    learned = language.learn(spark.createDataFrame(train, "text string, lang string"))
    assert sorted(learned) == sorted(LANGS)
    asked = [(i, say(x, 40)) for i, x in enumerate(list(LANGS) * 20)] + [(90, None), (91, ""), (92, "12 +- 3"), (93, say("de", 20000)), (93, say("de", 5).upper())]
    rows = {}
    for x in language.languages(cfgs(asked), learned).collect():
        rows.setdefault(x.name, x)
    assert np.mean([rows[i].lang_pred == x for i, x in enumerate(list(LANGS) * 20)]) > 0.95
    for i in (90, 91, 92):
        assert (rows[i].lang_pred, rows[i].rejected, rows[i].score) == ("und", True, 0.0)
    assert rows[93].lang_pred == "de" and 0 <= rows[93].score <= 1
    kept = language.keep_known(cfgs(asked), learned)
    assert kept.columns == ["name", "doc", "key", "text"] and not {90, 91, 92} & {x.name for x in kept.collect()}
    assert language.languages(cfgs([]), learned).count() == 0
    assert {x.lang_pred for x in language.languages(cfgs(asked[:3]), {}).collect()} == {"und"}
    assert language.learn(spark.createDataFrame([], "text string, lang string")) == {}


def turn_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|assistant|>\nx<|end|>\n", "\\0\\1|[<", "", None, "a|b\n\\", "é" * 5000]
    convs = {1: [("system", "s"), ("user", nasty[0]), ("assistant", nasty[1])], 2: [("user", nasty[2]), ("assistant", nasty[3]), ("user", nasty[4])],
             3: [("assistant", nasty[5])], 4: [("user", "q"), ("tool|<", "t"), (None, nasty[6])], None: [("user", "a"), ("assistant", "b")]}
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("back", chat.read_turns("formatted")).withColumn("loss", chat.loss_text("segments"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        assert turn_digest([(x.role, x.text) for x in got[c].back]) == turn_digest(turns)
        assert got[c].loss == "".join(t or "" for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].formatted == "".join(s.text for s in got[c].segments)
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert (got[2].end_state, got[3].end_state, got[4].end_state) == ("user", "error", "error")
    assert chat.format_chats(df.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [x.text for x in chat.format_chats(tied).select(chat.read_turns("formatted").alias("t")).first().t] == ["a", "a", "b"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and private.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns():
    r = random.Random(7)
    for _ in range(6000):
        t = "".join(r.choice("a1234567890@.. -+()é") for _ in range(r.randint(0, 50)))
        assert private.base_spans(t) == plain_spans(t)
    assert private.base_spans("4" * 60000) == [] and private.base_spans("a" * 60000 + "@" + "b" * 60000) == []


def test_tagger_gradient():
    m, r = Tagger.new(3, hidden=4, emb=3), np.random.default_rng(0)
    ids, tags = r.integers(1, 100, (3, 7)), r.integers(0, 3, (3, 7))
    ids[1, 5:] = ids[2, 3:] = 0
    tags[ids == 0] = 0
    _, g = m.loss_and_grad(ids, tags)
    for q, w in m.p.items():
        at = (ids[0, 2], 1) if q == "emb" else tuple(r.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = m.loss_and_grad(ids, tags)[0]
        w[at] = old - 1e-5
        assert (up - m.loss_and_grad(ids, tags)[0]) / 2e-5 == pytest.approx(g[q][at], abs=1e-6)
        w[at] = old


def pii(r):
    d = "".join(r.choice("0123456789") for _ in range(15))
    return r.choice([f"{r.choice('abcde')}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(0, 255)) for _ in range(4)),
                     next(d + str(c) for c in range(10) if private.luhn(d + str(c))), f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"])


@pytest.fixture(scope="module")
def model(cfgs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    docs = [(i, " ".join(pii(r) if r.random() < 0.05 else word() for _ in range(60)) + f" {r.randint(1, 999)} items") for i in range(150)]
    examples = private.labelled_windows(cfgs(docs), limit=500)
    assert 0 < len(examples) <= 500 and len({t for t, _ in examples}) == len(examples)
    return private.train(examples, epochs=5)


def test_model_learns_and_adds(model):
    r = random.Random(9)
    texts = [f"seen near {pii(r)} by the gate" for _ in range(60)]
    found = hit = 0
    for t in texts:
        for kind, a, b in private.base_spans(t):
            ids = np.array([private.char_ids(t)])
            path, lead = model.decode(ids)
            found += 1
            hit += any(k == kind and x < b and a < y for k, x, y, _ in private.spans_of_tags(path[0], lead[0], 0))
    assert found and hit / found > 0.8  # held-out spans, by the model alone
    base, every = private.find_spans(["call 1-415-555-0134 or write to anna4 @ mail2.example.com today"], model)[0]
    assert base == [] and {k for k, _, _ in every} <= set(private.KINDS)


def test_private_spans_and_masks(spark, cfgs, model):
    long = "word " * 4000 + "x9@mail.example.org " + "word " * 4000
    docs = [(1, "a1@mail.example.com"), (2, None), (3, ""), (4, long), (4, long), (None, "ip 10.0.0.1 é"), (5, "nothing here")]
    rows = private.private_spans(cfgs(docs), model).collect()
    for (n, d), r in zip(docs, rows, strict=True):
        assert r.name == n and [tuple(x) for x in r.base] == plain_spans(d or "")
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    out = private.mask_private(cfgs(docs), model)
    masked = out.collect()
    assert out.columns == ["name", "doc", "key", "text"]
    assert [r.doc for r in masked][:3] == ["<email>", None, ""] and masked[3].doc == long.replace("x9@mail.example.org", "<email>")
    assert masked[5].doc == "ip <ip> é" and masked[6].doc == "nothing here"
    assert private.private_spans(cfgs([]), model).count() == 0 and private.train([]).tags == 9


def test_reconcile_prefers_weight():
    got = private.reconcile([("ip", 0, 5, 1.0), ("card", 3, 12, 1.0), ("phone", 12, 20, 0.5), ("ip", 30, 35, 1.0)], [("email", 33, 40)])
    assert got == [("card", 3, 12), ("phone", 12, 20)]
