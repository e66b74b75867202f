"""Experiment grid, results tables and run compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.operators.metrics import best_epoch
from canopygrid.operators.ranking import row_number_in
from canopygrid.sources import commits


def job_grid(wanted: DataFrame, available: DataFrame, patches: list[int], seeds: list[int]) -> DataFrame:
    """All (seed, arch, init, patch) jobs whose (arch, init) arm is available.

    Patch and seed axes are constants, so they are array literals exploded in place.
    """
    arms = wanted.join(available, ["arch", "init"], "left_semi")
    axis = lambda v: F.explode(F.array(*[F.lit(i) for i in v]))
    return arms.withColumn("patch", axis(patches)).withColumn("seed", axis(seeds))


def number_jobs(jobs: DataFrame) -> DataFrame:
    """Job index with the seed outermost."""
    return row_number_in(jobs, [], F.col("seed"), ["arch", "init", "patch"], "job_no")


def results_table(runs: DataFrame) -> DataFrame:
    """Rounded metrics of finished runs, in table order."""
    return runs.withColumn("miou", F.bround("miou", 6)).orderBy(
        "arch", "init", F.col("patch").cast("int"), F.col("seed").cast("int"))


def check_run(runs: DataFrame, in_channels: int, coord: str, n_classes: int, patch: int) -> DataFrame:
    """Fatal mismatches and the patch-size warning, one row per run.

    An absent field passes, and so does an empty class list.
    """
    differs = lambda c, v: F.coalesce(F.col(c) != v, F.lit(False))
    bad = {
        "bad_channels": differs("in_channels", in_channels),
        "bad_coord": differs("coord", coord),
        "bad_classes": differs("n_classes", n_classes) & (F.coalesce("n_classes", F.lit(0)) != 0),
    }
    return runs.withColumns(bad).withColumns({
        "fatal": F.col("bad_channels") | F.col("bad_coord") | F.col("bad_classes"),
        "warn_patch": differs("patch", patch) & (F.coalesce("patch", F.lit(0)) != 0),
    })


def append_log(log: DataFrame, root: str, run: list[str], round_: str = "round") -> int:
    """Add a run's rounds to the epoch log as one commit; the log's commit number.

    A round of a run is a partition of the log, so appending it again, after a retry or a restart, replaces it by itself.
    """
    return commits.publish_commit(log, root, [*run, round_])


def run_records(log: DataFrame, run: list[str], metric: str = "miou", round_: str = "round") -> DataFrame:
    """One row per run: its rounds, its best round (the first of equals) and the metric there."""
    best = best_epoch(log, run, metric, round_)
    return log.groupBy(*run).agg(F.count(F.lit(1)).alias("rounds")).join(best, run)
