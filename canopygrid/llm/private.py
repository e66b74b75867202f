"""Personal data in the text of run logs and configuration documents.

Exact patterns give the base spans. A character-level bidirectional LSTM with CRF transitions,
fitted on labelled spans, adds spans the patterns miss (other separators, a missing plus sign,
blanks around the at sign). Every kind holds a digit or an at sign, so windows are laid only
around those characters; windows overlap, each is decoded, and the spans of all windows of a
text are reconciled in one weighted choice of non-overlapping spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.common import need, slices, texts_of
from canopygrid.llm.tagger import Tagger, char_ids

Span = tuple[str, int, int]

# The kinds, in their order, and the longest texts and numbers they allow.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

# The base patterns. Digit runs are possessive and begin at their first digit,
# which finds the same matches in linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", re.ASCII)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]")

WINDOW, STRIDE, REACH = 96, 48, 40
SAMPLE_WINDOWS = 2000


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    """The rules a span must meet beyond its pattern."""
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)
    d = _only_digits(s)
    if kind == "card":
        return CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)
    return kind == "email" or PHONE_DIGITS[0] <= len(d) <= PHONE_DIGITS[1]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from their at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield "email", start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not CUE.search(text):
        return []
    found = list(_emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m[0])]
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that cover every stretch within ``REACH`` of a digit or an at sign."""
    regions: list[list[int]] = []
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    return [(s, min(s + WINDOW, b)) for a, b in regions for s in range(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE)]


def encode_tags(start: int, end: int, spans: list[Span]) -> np.ndarray:
    """Tags of one window: 2k+1 begins kind k, 2k+2 goes on, 0 is outside. Cut spans count as outside."""
    tags = np.zeros(end - start, dtype=np.int64)
    for kind, a, b in spans:
        if start <= a and b <= end and not tags[a - start:b - start].any():
            k = KINDS.index(kind)
            tags[a - start:b - start] = 2 * k + 2
            tags[a - start] = 2 * k + 1
    return tags


def spans_of_tags(path: np.ndarray, lead: np.ndarray, start: int) -> list[tuple[str, int, int, float]]:
    """Spans of one decoded window with their mean lead."""
    out, i, n = [], 0, len(path)
    while i < n:
        if path[i] % 2 == 0:
            i += 1
            continue
        j = i + 1
        while j < n and path[j] == path[i] + 1:
            j += 1
        out.append((KINDS[path[i] // 2], start + i, start + j, float(lead[i:j].mean())))
        i = j
    return out


def reconcile(candidates: list[tuple[str, int, int, float]], taken: list[Span]) -> list[Span]:
    """The non-overlapping candidates of greatest total weight that touch no taken span."""
    weight: dict[Span, float] = defaultdict(float)
    for kind, a, b, w in candidates:
        if all(b <= x or a >= y for _, x, y in taken):
            weight[kind, a, b] += max(w, 0.0) * (b - a)
    spans = sorted((s for s in weight if weight[s] > 0), key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends, best = [s[2] for s in spans], [(0.0, ())]
    for i, s in enumerate(spans):
        total, chosen = best[bisect_right(ends, s[1], 0, i)]
        best.append(max(best[-1], (total + weight[s], (chosen, s)), key=lambda x: x[0]))
    out, chain = [], best[-1][1]
    while chain:
        chain, s = chain
        out.append(s)
    return out[::-1]


def plausible(kind: str, s: str) -> bool:
    """What an added span must look like, so that plain numbers in prose stay out."""
    if s != s.strip() or not passes(kind, s):
        return False
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+( ?\. ?[A-Za-z0-9-]+)+", s) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+( ?\. ?[0-9]+){3}", s) is not None
    if kind == "card":
        return re.fullmatch(r"[0-9]+([ .\-]+[0-9]+)+", s) is not None
    return len(_only_digits(s)) >= 10 and re.fullmatch(r"[+(]?[0-9]+([ ().\-/]+[0-9]+)+", s) is not None


def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The window as it is and with its first span written another way, for training."""
    out = [(text, spans)]
    if spans:
        kind, a, b = spans[0]
        s = text[a:b]
        other = {"email": s.replace("@", " @ "), "ip": s.replace(".", " . "), "card": re.sub("[ -]", ".", s),
                 "phone": s.lstrip("+").replace(" ", "-")}[kind]
        if other != s:
            d = len(other) - len(s)
            moved = [(k, x + d, y + d) for k, x, y in spans[1:] if x >= b]
            out.append((text[:a] + other + text[b:], [(kind, a, a + len(other)), *moved]))
    return out


def labelled_windows(docs: DataFrame, name: str = "name", doc: str = "doc", limit: int = SAMPLE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """At most ``limit`` different windows with their base spans, chosen by a hash of their text."""
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "doc"):
            rows = []
            for t in texts_of(b, "doc"):
                spans = base_spans(t)
                for s, e in windows(t):
                    own = [f"{k}:{x - s}:{y - s}" for k, x, y in spans if s <= x and y <= e]
                    rows.append((t[s:e], ",".join(own)))
            if rows:
                text, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(spans, pa.string())], names=out.names)

    found = docs.select(docs[doc].cast("string").alias("doc")).where(F.col("doc").rlike("[0-9@]")).mapInArrow(run, out)
    # windows with a span before those without, each in the order of its hash
    rows = (found.distinct().orderBy((F.col("spans") == "") & (F.pmod(F.xxhash64("text"), F.lit(4)) > 0), F.xxhash64("text"), "text")
            .limit(limit).collect())
    parse = lambda x: [(k, int(a), int(b)) for k, a, b in (y.split(":") for y in x.split(",") if y)]
    return [(r[0], parse(r[1])) for r in rows]


def train(examples: list[tuple[str, list[Span]]], epochs: int = 8) -> Tagger:
    """Fit the tagger on labelled texts of at most one window each."""
    model = Tagger.new(2 * len(KINDS) + 1)
    rows = [v for text, spans in examples if text for v in variants(text, spans) if len(v[0]) <= WINDOW + 16]
    if not rows:
        return model
    ids, tags = (np.zeros((len(rows), max(len(t) for t, _ in rows)), dtype=np.int64) for _ in range(2))
    for i, (text, spans) in enumerate(rows):
        ids[i, :len(text)] = char_ids(text)
        tags[i, :len(text)] = encode_tags(0, len(text), spans)
    model.fit(ids, tags, epochs)
    return model


def find_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Per text: its base spans, and base and added spans together, by kind and start."""
    base = [base_spans(t) for t in texts]
    where = [(i, s, e) for i, t in enumerate(texts) for s, e in windows(t)]
    candidates: dict[int, list] = defaultdict(list)
    for at in range(0, len(where), 512):
        part = where[at:at + 512]
        ids = np.zeros((len(part), max(e - s for _, s, e in part)), dtype=np.int64)
        for r, (i, s, e) in enumerate(part):
            ids[r, :e - s] = char_ids(texts[i][s:e])
        path, lead = model.decode(ids)
        for r, (i, s, e) in enumerate(part):
            for kind, a, b, w in spans_of_tags(path[r, :e - s], lead[r, :e - s], s):
                # a span cut by the window's edge is left to the neighbour that holds it whole
                cut = (a == s and s > 0) or (b == e and e < len(texts[i]))
                if not cut and plausible(kind, texts[i][a:b]):
                    candidates[i].append((kind, a, b, w))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return [(b, sorted(b + reconcile(candidates[i], b), key=order)) for i, b in enumerate(base)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def private_spans(docs: DataFrame, model: Tagger, name: str = "name", doc: str = "doc") -> DataFrame:
    """``name, base, spans``: arrays of (kind, start, end), in code points, end exclusive.

    ``spans`` holds the base spans and those the model adds, by kind and start. A null or empty
    document has none. Row by row: repeated rows give repeated results, other columns are
    ignored, an empty table gives no rows.
    """
    need(docs, name, doc)
    out = T.StructType([T.StructField("name", docs.schema[name].dataType), T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "doc"):
            both = find_spans(texts_of(b, "doc"), model)
            columns = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[w]] for x in both], kind) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=out.names)

    done = docs.select(docs[name].alias("name"), docs[doc].cast("string").alias("doc")).mapInArrow(run, out)
    return done.withColumnRenamed("name", name)


def mask_private(docs: DataFrame, model: Tagger, doc: str = "doc") -> DataFrame:
    """The table with every span in ``doc`` replaced by its kind in angle brackets; null stays null."""
    need(docs, doc)
    at = docs.columns.index(doc)
    names = [f"c{i}" for i in range(len(docs.columns))]  # positions, so repeated names cannot clash

    def hide(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= done:
                out += [text[done:s], f"<{kind}>"]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            texts = b.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], model)
            masked = [t if not t else hide(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            columns = [*b.columns]
            columns[at] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
