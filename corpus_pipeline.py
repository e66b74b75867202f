"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
all but the last return the columns of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm import boilerplate, language, neardup, packing, private
from canopygrid.session import cut_lineage, shared_dir

WORD_BYTES = 12 << 20


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; rejected ones go."""
    return language.keep_known(docs, language.learn(docs), doc="text")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go."""
    done = boilerplate.drop_boilerplate(docs, name="doc_id", doc="text", dropped="_dropped")
    return _measured(done.where((F.col("_dropped") == 0) | F.rlike("text", F.lit("[^\\s]"))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id."""
    return neardup.keep_one(docs, name="doc_id", doc="text")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal span replaced by its kind."""
    model = private.train(private.labelled_windows(docs, name="doc_id", doc="text"))
    return _measured(private.mask_private(docs, model, doc="text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their place in training sequences."""
    # the workers have served four stages before, so this one remembers fewer words
    pieces = packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json"), name="doc_id", doc="text", word_bytes=WORD_BYTES).drop("ids")
    return packing.pack(cut_lineage(pieces), order=("doc_id", "piece"))


STAGES = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# Language models, minwise trees and taggers have no SQL form; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
