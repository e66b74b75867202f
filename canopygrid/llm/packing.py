"""Best-fit packing of tokenized configuration documents into training sequences.

Only lengths decide where a piece goes, and there are at most ``capacity`` different lengths.
So the plan is made on the table of counts per length (its size does not grow with the data):
lengths above one third of the capacity are matched greedily, at most two in a sequence, the
largest with the largest partner that still fits; shorter lengths then go, longest first,
into the tightest gap that holds them. The plan says, for the r-th piece of a length, which
sequence and offset it takes; pieces are ranked per length in hashed buckets, so no length
is ever sorted in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.bpe import local_path
from canopygrid.llm.common import need, slices, texts_of
from canopygrid.llm.wordids import WORD_BYTES, word_ids

ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 1024


def pieces_of(cfgs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0,
              name: str = "name", doc: str = "doc", word_bytes: int = WORD_BYTES) -> DataFrame:
    """``name, piece, start, length, ids``: each document's ids and ``end_id``, cut only above ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit. A null or empty document is the end id alone.
    Row by row: repeated rows give repeated pieces; other columns are ignored. A worker remembers
    about twice ``word_bytes`` of words.
    """
    need(cfgs, name, doc)
    out = T.StructType([
        T.StructField("name", cfgs.schema[name].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_ids(local_path(vocab), word_bytes), np.uint32(end_id).tobytes()
        for b in slices(batches, "doc"):
            rows = [(i, k, at, ids[4 * at:4 * (at + capacity)])
                    for i, ids in enumerate(x + end for x in tok(texts_of(b, "doc")))
                    for k, at in enumerate(range(0, len(ids) // 4, capacity))]
            i, k, at, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(at, pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=out.names)

    done = cfgs.select(cfgs[name].alias("name"), cfgs[doc].cast("string").alias("doc")).mapInArrow(run, out)
    return done.withColumnRenamed("name", name)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    Pieces of ``length`` ranked ``rank_from <= r < rank_to`` fill sequences from
    ``first_sequence`` on, ``per_sequence`` in each, the first of them at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many), sorted
    opened = 0

    def put(n: int, many: int, first: int, each: int, offset: int) -> None:
        rows.append((n, used[n], used[n] + many, first, each, offset))
        used[n] += many
        left[n] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1  # the largest partner that fits
        while at >= 0 and (not left[large[at]] or (large[at] == n and left[n] < 2)):
            at -= 1
        if at < 0:
            many = left[n]
            put(n, many, opened, 1, 0)
            gap = capacity - n
        elif (m := large[at]) == n:
            many = left[n] // 2
            put(n, 2 * many, opened, 2, 0)
            gap = capacity - 2 * n
        else:
            many = min(left[n], left[m])
            put(n, many, opened, 1, 0)
            put(m, many, opened, 1, n)
            gap = capacity - n - m
        if gap:
            insort(gaps, (gap, opened, many))
        opened += many
    for n in sorted((x for x in left if left[x]), reverse=True):
        while left[n]:
            at = bisect_left(gaps, (n, -1, -1))
            if at < len(gaps):
                gap, first, many = gaps.pop(at)
            else:
                gap, first, many = capacity, opened, -(-left[n] // (capacity // n))
                opened += many
            each = gap // n
            full = min(many, left[n] // each)
            rest = left[n] - full * each if full < many else 0
            if full:
                put(n, full * each, first, each, capacity - gap)
                if gap % n:
                    insort(gaps, (gap - each * n, first, full))
            if rest:
                put(n, rest, first + full, rest, capacity - gap)
                if gap - rest * n:
                    insort(gaps, (gap - rest * n, first + full, 1))
            if (free := many - full - bool(rest)) > 0:
                insort(gaps, (gap, first + full + bool(rest), free))
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("name", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row; at most ``capacity`` tokens share a sequence.

    ``pieces`` is read several times and should be a written table. The ``order`` columns give
    equal lengths their order (null first); rows equal in all of them are interchangeable. All
    columns are kept, an empty table stays empty, and a null length is an error.
    """
    need(pieces, length, *order)
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(LEAST_BUCKETS, n // ROWS_PER_BUCKET)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    per_bucket = rows.groupBy(F.col(length).alias("_len"), "_bucket").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if None in counts:
        raise ValueError("a piece without a length cannot be packed")
    schema = "_len long, _from long, _to long, _first long, _each long, _at long"
    steps = spark.createDataFrame(plan(counts, capacity), schema)
    upto = F.sum("_n").over(Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    offsets = per_bucket.select("_len", "_bucket", (upto - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*[F.asc_nulls_first(c) for c in order]))
    ranked = rows.withColumn("_r", inside - 1).join(
        offsets.withColumnRenamed("_bucket", "_b"), (F.col(length) == F.col("_len")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("_rank", F.col("_r") + F.col("_before")).drop("_len", "_b", "_r", "_before", "_bucket")
    # the plan has a few rows per length whatever the size of the data, so it may be sent to every task
    placed = ranked.join(F.broadcast(steps), (F.col(length) == F.col("_len")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")))
    k = F.col("_rank") - F.col("_from")
    slot = F.floor(k / F.col("_each"))
    return placed.select(*[F.col(c) for c in pieces.columns], (F.col("_first") + slot).cast("long").alias("sequence_id"),
                         (F.col("_at") + (k % F.col("_each")) * F.col(length)).cast("long").alias("offset"))


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id, ids``: the packed pieces put together, each sequence at most one capacity long."""
    need(packed, "sequence_id", "offset", ids)
    parts = F.sort_array(F.collect_list(F.struct("offset", ids)))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.aggregate(F.col(f"_p.{ids}"), F.lit(b""), lambda a, x: F.concat(a, x)).alias(ids))
