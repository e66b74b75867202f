"""Tables whose partitions change together: versioned folders and a commit record that readers follow.

A writer first writes its rows under ``data/version=<new>``, which nobody reads yet. One small file, the
commit record, then names for every live partition the version that holds it; it appears at once or not
at all. Readers follow the newest record, so they see all of a publication or nothing of it, and a writer that
is lost in between leaves the old state and a folder that ``leftovers`` shows. A publication with a token it
had before is not done again, which makes retries and replayed stream batches safe.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another writer published at the same time; nothing of this publication is to be seen."""


def _listed(spark: SparkSession, root: str) -> dict[int, list[tuple[int, str]]]:
    """Complete records by number: (when it was complete, folder name). Only names are listed, no file is opened."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[int, str]]] = {}
    for status in fs.listStatus(home) if fs.exists(home) else ():
        name, mark = status.getPath().getName(), jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if fs.exists(mark):
            found.setdefault(int(name.split("-")[0]), []).append((fs.getFileStatus(mark).getModificationTime(), name))
    return found


def _record(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """The newest record, or that of commit ``at``: one row per live partition (n, token, schema, version, live)."""
    found = _listed(spark, root)
    if not found:
        return None
    return spark.read.parquet(f"{root}/commits/{min(found[at or max(found)])[1]}")


def _name(n: int, token: str) -> str:
    return f"{n:010d}-{hashlib.sha256(token.encode()).hexdigest()[:24]}"


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def latest(spark: SparkSession, root: str) -> int:
    """Number of the newest commit, 0 if there is none."""
    return max(_listed(spark, root), default=0)


def write_version(df: DataFrame, root: str, by: list[str], files: int = 1, spread_on: list[str] | None = None) -> str:
    """Rows as a new version that no record names yet. Each partition is written by up to ``files`` tasks."""
    version = uuid.uuid4().hex
    part = F.pmod(F.xxhash64(*(spread_on or [c for c in df.columns if c not in by])), F.lit(files))
    dealt = df.withColumn("_file", part).repartition(*by, "_file").drop("_file") if files > 1 else df.repartition(*by)
    dealt.write.partitionBy(*by).parquet(f"{root}/data/version={version}")
    return version


def commit(spark: SparkSession, root: str, version: str, by: list[str], schema: T.StructType, token: str | None = None,
           replace_all: bool = False) -> int:
    """Make a written version live: its partitions replace those of the same values, all in one record.

    The record is one file, in a folder named by its number and token, and also keeps the ``schema``. If two writers take
    the same number, the record that was complete first counts and the other writer raises ``ConflictError``.
    """
    n = latest(spark, root)
    before = _record(spark, root, n)
    new = spark.read.schema(schema).parquet(f"{root}/data/version={version}")
    rows = new.select(F.lit(version).alias("version"), F.struct(*by).alias("live")).distinct()
    if before is not None and not replace_all:
        kept = before.where(F.col("version").isNotNull()).select("version", "live")
        rows = kept.alias("o").join(rows.alias("f"), _same("o.live", "f.live", by), "left_anti").unionByName(rows)
    # a commit without any live partition still has one row, which names no version
    empty = spark.range(1).select(F.lit(None).cast("string").alias("version"), F.lit(None).cast(rows.schema["live"].dataType).alias("live"))
    record = rows.unionByName(empty).select(F.lit(n + 1).cast("long").alias("n"), F.lit(token).cast("string").alias("token"),
                                            F.lit(schema.json()).alias("schema"), "version", "live")
    name = _name(n + 1, token or version)
    record.coalesce(1).write.mode("error").parquet(f"{root}/commits/{name}")
    if min(_listed(spark, root)[n + 1])[1] != name:
        raise ConflictError(f"commit {n + 1} of {root} is another writer's")
    return n + 1


def done(spark: SparkSession, root: str, token: str) -> bool:
    """Whether a publication with this token was committed."""
    return any(min(c)[1] == _name(n, token) for n, c in _listed(spark, root).items())


def publish_commit(df: DataFrame, root: str, by: list[str], token: str | None = None, replace_all: bool = False,
                   files: int = 1, spread_on: list[str] | None = None) -> int:
    """Replace the partitions of ``df`` (with ``replace_all``, everything) as one commit; its number.

    With a ``token`` that was committed before nothing happens. Partitions that ``df`` does not have stay. One writer at a
    time; of several at once at most one succeeds, the others raise ``ConflictError`` and may try again.
    """
    spark = df.sparkSession
    if token is not None and done(spark, root, token):
        return latest(spark, root)
    return commit(spark, root, write_version(df, root, by, files, spread_on), by, df.schema, token, replace_all)


def read_published(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """Live rows as of the newest commit, or of commit ``at``; None before the first.

    The record's few rows name version and partition of everything that is live; both are folders, so what is not
    live is not read.
    """
    record = _record(spark, root, at)
    if record is None:
        return None
    schema = T.StructType.fromJson(json.loads(record.select("schema").first()[0]))
    live = record.where(F.col("version").isNotNull()).select("version", "live").distinct()
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).option("basePath", f"{root}/data").parquet(f"{root}/data")
    by = live.schema["live"].dataType.names
    named = live.select(F.col("version").alias("_version"), *[F.col(f"live.{c}").alias(f"_{c}") for c in by])
    same = [F.col("version") == F.col("_version"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    return data.join(named, reduce(Column.__and__, same), "left_semi").select(*schema.names)


def leftovers(spark: SparkSession, root: str) -> list[str]:
    """Versions that no record names: of lost writers, or of one at work."""
    try:
        found = spark.read.schema("version string").option("basePath", f"{root}/data").parquet(f"{root}/data").select("version").distinct()
    except AnalysisException:
        return []
    if _listed(spark, root):
        records = [f"{root}/commits/{min(c)[1]}" for c in _listed(spark, root).values()]
        found = found.join(spark.read.parquet(*records).select("version"), "version", "left_anti")
    return sorted(r[0] for r in found.collect())
