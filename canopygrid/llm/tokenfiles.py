"""Token ids of configuration documents in ORC files, in ascending key order.

ORC gives what a token store needs: integer run-length encoding of the ids, stripes that
are read in parallel, row indexes every ``ROW_STRIDE`` rows and a Bloom filter on the
document key, so a lookup of a few documents skips stripes and row groups by metadata alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.bpe import local_path
from canopygrid.llm.common import need, slices, texts_of
from canopygrid.llm.wordids import word_ids
from canopygrid.session import cut_lineage

ROW_STRIDE = 2000
STRIPE_BYTES = 16 << 20
DOCS_PER_FILE = 100_000


def tokenize(cfgs: DataFrame, vocab: str, end_id: int, name: str = "name", doc: str = "doc") -> DataFrame:
    """``name, ids``: ids of the whole document and then ``end_id``. A null document is empty."""
    need(cfgs, name, doc)
    key = cfgs.schema[name].dataType
    out = T.StructType([T.StructField("name", key), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_ids(local_path(vocab)), np.uint32(end_id).tobytes()
        for b in slices(batches, "doc"):
            ids = [x + end for x in tok(texts_of(b, "doc"))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["name", "ids"])

    return cfgs.select(cfgs[name].alias("name"), cfgs[doc].cast("string").alias("doc")).mapInArrow(run, out)


def write_tokens(cfgs: DataFrame, path: str, vocab: str, end_id: int = 1, name: str = "name", doc: str = "doc",
                 files: int | None = None) -> None:
    """Write ``name, part, ids`` as ORC under ``path``, keys ascending through the files and in each.

    Texts, not ids, are moved for the order: they are smaller, and a lost task repeats its own
    tokens only. ``part`` numbers the key ranges in order. Repeated keys stay repeated; a null
    key comes first; an empty table gives files without rows. Other columns are ignored.
    """
    need(cfgs, name, doc)
    rows = cfgs.select(cfgs[name].alias("name"), cfgs[doc].cast("string").alias("doc"))
    if files is None:
        shuffle = int(cfgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = max(shuffle, -(-cfgs.count() // DOCS_PER_FILE))
    ranged = rows.repartitionByRange(files, F.asc_nulls_first("name")).sortWithinPartitions(
        F.asc_nulls_first("name"), F.xxhash64("doc"))
    done = tokenize(ranged, vocab, end_id, "name", "doc").withColumn("part", F.spark_partition_id())
    (done.select(F.col("name").alias(name), "part", "ids").write
     .option("orc.bloom.filter.columns", name).option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", str(ROW_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.compress", "ZSTD").orc(path))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The stored rows; ``where`` on the key reaches the ORC reader as a search argument."""
    df = spark.read.orc(path)
    return df if where is None else df.where(where)


def summaries(stored: DataFrame, name: str = "name") -> DataFrame:
    """``name, part, n_tokens, ids_crc32`` of the stored rows; the checksum is over little-endian unsigned 32-bit ids."""
    need(stored, name, "part", "ids")
    out = T.StructType([T.StructField("name", stored.schema[name].dataType), T.StructField("part", T.IntegerType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=out.names)

    return stored.select(stored[name].alias("name"), "part", "ids").mapInArrow(run, out).withColumnRenamed("name", name)


def with_starts(rows: DataFrame, name: str = "name") -> DataFrame:
    """Add ``start``: how many ids all documents before this one hold, in stored order.

    Two levels: totals per part (one row each) carry the offsets, and rows are added up inside
    their own part only. Rows with equal keys go by checksum, then by length. Both levels read ``rows`` as
    written once, so that what makes them runs once.
    """
    need(rows, name, "part", "n_tokens", "ids_crc32")
    rows = cut_lineage(rows)
    upto = F.sum("_n").over(Window.orderBy("part"))
    offsets = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", (upto - F.col("_n")).alias("_from"))
    within = Window.partitionBy("part").orderBy(F.asc_nulls_first(name), "ids_crc32", "n_tokens")
    before = F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("_before", before).join(offsets, "part").withColumn(
        "start", F.col("_from") + F.col("_before")).drop("_from", "_before")
