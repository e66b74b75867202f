"""Parquet scans and sinks for pixels, points, features and chips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.model import FEATURE_SCHEMA


def scan_points(pt: DataFrame, epsg: int) -> DataFrame:
    """Point returns with the reference system overridden, never converted."""
    return pt.select("x", "y", "z", "cls", "file").withColumn("epsg", F.lit(epsg))


def write_chips(chips: DataFrame, path: str) -> None:
    """Chip set partitioned by size and split; readers of one split open only its files."""
    chips.write.partitionBy("patch_size", "split").mode("overwrite").parquet(path)


def read_chips(spark: SparkSession, path: str, size: int | None = None, split: str | None = None) -> DataFrame:
    """Chips of one size and split. ``mask`` may be stored as ``mask4`` in older sets."""
    df = spark.read.parquet(path)
    if "mask" not in df.columns:
        if "mask4" not in df.columns:
            raise KeyError("chip set has neither mask nor mask4")
        df = df.withColumnRenamed("mask4", "mask")
    if size is not None:
        df = df.where(F.col("patch_size") == size)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def empty_features(spark: SparkSession) -> DataFrame:
    """No features, full schema: what a patch without objects writes."""
    return spark.createDataFrame([], FEATURE_SCHEMA)


def publish(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace whole partitions atomically; partitions not in ``df`` stay untouched."""
    (df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def publish_spread(df: DataFrame, path: str, by: list[str], files: int, spread_on: list[str]) -> None:
    """As ``publish``, with each partition written by up to ``files`` tasks: one scene
    may hold a large part of all rows."""
    part = F.pmod(F.xxhash64(*spread_on), F.lit(files))
    (df.withColumn("_f", part).repartition(*by, "_f").drop("_f").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def guard_complete(expected: DataFrame, published: DataFrame, key: str) -> None:
    """Stop the next stage while any scene is unfinished."""
    left = expected.select(key).join(published.select(key).distinct(), key, "left_anti")
    n = left.count()
    if n:
        few = [str(r[0]) for r in left.orderBy(key).limit(5).collect()]
        raise RuntimeError(f"{n} unfinished: {', '.join(few)}{', ...' if n > len(few) else ''}")

