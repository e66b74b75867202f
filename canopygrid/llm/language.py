"""Language of a text by compression: the dictionary that shrinks it most names its language.

Each language is a raw-content zstandard dictionary made of a bounded sample of its labelled
texts. A text is cut into blocks (so that its own repetitions do not outweigh the
dictionaries), every block is compressed once per language, and the language with the fewest
bytes over the whole text wins. A narrow margin means that the text is rejected.

The land-cover project's records hold no natural-language field of their own, so this
operator is general: any table with a text column, and labelled rows of the same kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.common import need, slices, texts_of

SAMPLE_TEXTS = 400  # labelled texts a language, at most
SAMPLE_CHARS = 1500  # characters taken from each
DICT_BYTES = 256 << 10  # a dictionary, at most
BLOCK = 4096
LEVEL = 6
MARGIN = 0.003
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionary content by language, from at most ``texts`` different texts of each.

    Rows with a null text or label are left out. Texts are chosen by a hash of their content:
    labels are counted, each label's share that is expected to give twice as many texts as
    needed is kept, and only that bounded rest is ranked. The most telling (first chosen) texts
    stand at the end of the dictionary, where the compressor finds them cheapest.
    """
    need(labelled, text, lang)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    # different texts a language, told by their hash: the same text in a third of all rows counts once
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, 2.0 * texts / max(1, n))).otherwise(share)
    unit = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(unit <= share).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"),
                                              F.xxhash64("text").alias("h")).distinct()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():  # about twice ``texts`` rows a language
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for name, found in sorted(by.items()):
        body = "\n".join(t for _, t in sorted(found)[:texts][::-1]).lower().encode("utf-8", "replace")
        out[name] = body[-DICT_BYTES:]
    return out


class Classifier:
    """One prepared compressor per language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(n for n, b in dictionaries.items() if len(b) >= 8)
        self.packers = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each language's dictionary."""
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(z.compress(b)) for b in blocks) for z in self.packers]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in 0..1 and margin over the next best, as a share of its bytes."""
        if not text or not LETTER.search(text) or not self.names:
            return UNKNOWN, 0.0, 0.0
        s = np.array(self.sizes(text), dtype=float)
        best = int(s.argmin())  # ties go to the first name
        if len(s) == 1:
            return self.names[0], 1.0, 1.0
        margin = float(1.0 - s[best] / np.delete(s, best).min())
        w = np.exp((s[best] - s) / (0.03 * s[best]))
        return self.names[best], float(1.0 / w.sum()), margin


def languages(docs: DataFrame, dictionaries: dict[str, bytes], name: str = "name", doc: str = "doc",
              margin: float = MARGIN) -> DataFrame:
    """``name, lang_pred, score, margin, rejected`` for every row.

    ``lang_pred`` is the best language, ``und`` for a null text or one without a letter;
    ``rejected`` is true for ``und`` and for margins below ``margin``. Nothing but the text is
    looked at. Row by row: repeated rows repeat, other columns are ignored, an empty table
    gives no rows; without any dictionary every text is ``und``.
    """
    need(docs, name, doc)
    out = T.StructType([T.StructField("name", docs.schema[name].dataType), T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()),
                        T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Classifier(dictionaries)
        for b in slices(batches, "doc"):
            found = [tell(t) for t in texts_of(b, "doc")]
            lang, score, gap = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()),
                 pa.array([x == UNKNOWN or g < margin for x, g in zip(lang, gap, strict=True)])], names=out.names)

    done = docs.select(docs[name].alias("name"), docs[doc].cast("string").alias("doc")).mapInArrow(run, out)
    return done.withColumnRenamed("name", name)


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], doc: str = "doc", margin: float = MARGIN) -> DataFrame:
    """The rows, unchanged, whose language is told with at least ``margin``."""
    need(docs, doc)
    at = docs.columns.index(doc)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Classifier(dictionaries)
        for b in slices(batches, names[at]):
            found = [tell(t) for t in texts_of(b, names[at])]
            yield b.filter(pa.array([x != UNKNOWN and g >= margin for x, _, g in found]))

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
