"""Two-level windows: ranks and running maxima without one task per hot group.

A plain window sorts each whole group in a single task. Here every group is cut
into ordered buckets; a small table with one row per bucket carries the totals of
the buckets before it, and only a bucket is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopygrid.session import cut_lineage


def row_number_in(df: DataFrame, keys: list[str], bucket: Column, order_by: list,
                  name: str, upto: int | None = None) -> DataFrame:
    """1-based position under (bucket, order_by) within ``keys``.

    ``bucket`` must be monotone in the wanted order. With no keys the rank is global, and
    ``rank_all`` cuts the order itself. With ``upto``, buckets that begin beyond that position
    are left out before anything is sorted, and later positions of the others as well.
    """
    if not keys:
        ranked = rank_all(df.withColumn("_bucket", bucket), ["_bucket", *order_by], name).drop("_bucket")
        return ranked if upto is None else ranked.where(F.col(name) <= upto)
    b = df.withColumn("_bucket", bucket)
    totals = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if upto is not None:
        offsets = offsets.where(F.col("_before") < upto)
    local = b.join(offsets, [*keys, "_bucket"]).withColumn(
        "_pos", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order_by)))
    ranked = local.withColumn(name, (F.col("_pos") + F.col("_before")).cast("bigint")).drop("_pos", "_before", "_bucket")
    return ranked if upto is None else ranked.where(F.col(name) <= upto)


def rank_all(df: DataFrame, order_by: list, name: str) -> DataFrame:
    """1-based position in the whole table.

    Rows are dealt by ranges of the order and written once with the number of their range, so
    the ranges are the same for totals and ranks; the totals have one row per range.
    """
    cut = cut_lineage(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order_by))
    return cut.withColumn("_pos", place).join(offsets, "_range").withColumn(
        name, (F.col("_pos") + F.col("_before")).cast("bigint")).drop("_pos", "_before", "_range")


def max_before(df: DataFrame, keys: list[str], bucket: Column, order_by: list,
               value: str, name: str) -> DataFrame:
    """Largest ``value`` on the rows strictly before this one (NULL on the first)."""
    b = df.withColumn("_bucket", bucket)
    tops = b.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(*keys, "_bucket", F.max("_top").over(earlier).alias("_prior"))
    inside = (W.partitionBy(*keys, "_bucket").orderBy(*order_by)
              .rowsBetween(W.unboundedPreceding, -1))
    return (
        b.withColumn("_inner", F.max(value).over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.greatest("_inner", "_prior"))
        .drop("_inner", "_prior", "_bucket")
    )
