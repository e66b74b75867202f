"""Incremental ingest, exactly-once publishing and live boards."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopygrid.session import cut_lineage, shared_dir
from canopygrid.sources import commits
from canopygrid.sources.discovery import pending
from canopygrid.sources.tables import publish_spread


def open_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """File-source stream over a table, be it one file or a folder of them; each file is read exactly once across restarts.

    A plain path must be a folder, so the table is named by a pattern that only it matches.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
             mode: str = "append") -> None:
    """Process everything available now, then stop; a rerun continues from the checkpoint."""
    q = (stream.writeStream.foreachBatch(handle).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def ingest_scenes(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str, key: str = "scene", done: DataFrame | None = None,
                  files: int = 16, spread_on: list[str] | None = None) -> None:
    """Compute and publish arriving scenes, each input file exactly once.

    A batch replaces the partitions (scene, part = batch number) it owns, so a replay after
    a failure repeats its own output, and a scene whose files arrive in several batches
    keeps all of them. Each partition is written by up to ``files`` tasks, dealt by the
    ``spread_on`` columns (all but the key if not given). ``done`` names scenes to leave out: those whose record says they
    were complete before this run.
    """
    def handle(batch: DataFrame, n: int) -> None:
        todo = batch if done is None else pending(batch, done.select(key).distinct(), key)
        ready = compute(todo)
        spread = spread_on or [c for c in ready.columns if c != key]
        publish_spread(ready.withColumn("part", F.lit(n)), out, [key, "part"], files, spread)

    run_once(stream, handle, checkpoint)


def board(stream: DataFrame, out: str, keys: list[str], checkpoint: str, buckets: int = 16) -> None:
    """Keep the latest row of every key of an aggregated stream as one published table.

    Update mode emits only the keys that changed. A batch rewrites the buckets of those keys, old rows of other keys
    included, and publishes them as one commit: readers meet each key once, however many batches there were, and never half
    a batch. The commit's token is the batch, so a batch that is replayed after a failure is not applied twice.
    """
    def handle(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        token = f"{checkpoint}#{n}"
        if commits.done(spark, out, token):
            return
        changed = cut_lineage(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        before = commits.read_published(spark, out)
        if before is not None:
            touched = before.join(changed.select("bucket").distinct(), "bucket", "left_semi").select(*before.columns)
            same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ["bucket", *keys]])
            changed = touched.alias("o").join(changed.alias("c"), same, "left_anti").unionByName(changed)
        commits.publish_commit(changed, out, ["bucket"], token)

    run_once(stream, handle, checkpoint, mode="update")


def read_board(spark: SparkSession, out: str) -> DataFrame:
    """The row of every key as of the last batch; an error before the first."""
    rows = commits.read_published(spark, out)
    if rows is None:
        raise FileNotFoundError(f"no batch of {out} was published yet")
    return rows.drop("bucket")


def status_stream(stream: DataFrame, status: str = "status") -> DataFrame:
    return stream.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def best_stream(stream: DataFrame, keys: list[str], metric: str = "miou", at: str = "event_id") -> DataFrame:
    """Best metric per run so far and where it occurred (earliest on ties); NaN ignored."""
    ok = F.col(metric).isNotNull() & ~F.isnan(metric)
    top = F.max(F.when(ok, F.struct(F.col(metric).alias("v"), (-F.col(at)).alias("p"))))
    return stream.groupBy(*keys).agg(top.alias("_b")).select(
        *keys, F.col("_b.v").alias("best"), (-F.col("_b.p")).alias("best_at"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared directory."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
