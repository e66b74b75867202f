"""Confusion, IoU, losses, class weights, epoch and seed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopygrid.model import IGNORE, MAX_CLASS_WEIGHT
from canopygrid.operators.ranking import max_before


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", k: int = 7) -> DataFrame:
    """(truth, pred, n); truth outside [0, k) is dropped, which removes the ignore id."""
    return df.where(F.col(truth).between(0, k - 1)).groupBy(
        F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def iou(conf: DataFrame, k: int = 7) -> DataFrame:
    """Per class: inter, union, iou (NULL when the union is empty)."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").cast("int").alias("cls"), F.col("n").alias("u"), hit.alias("i")),
        F.struct(F.col("pred").cast("int").alias("cls"), (F.col("n") - hit).alias("u"), F.lit(0).cast("bigint").alias("i")))
    per = conf.select(F.explode(sides).alias("_s")).groupBy("_s.cls").agg(
        F.sum("_s.i").alias("inter"), F.sum("_s.u").alias("union_px"))
    classes = conf.sparkSession.range(k).select(F.col("id").cast("int").alias("cls"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return classes.join(per, "cls", "left").select("cls", z("inter"), z("union_px")).withColumn(
        "iou", F.try_divide("inter", "union_px"))


def mean_iou(per_class: DataFrame) -> DataFrame:
    """Mean over classes with a union; NULL if there is none."""
    return per_class.agg(F.avg("iou").alias("miou"))


def miou_pair(conf: DataFrame, k: int = 7, ignored: int = 0) -> DataFrame:
    """Mean over all classes, and the mean without the ignored one, whose truth row
    (not its column) is emptied first. Both come from one scan of the K*K rows."""
    cls = F.explode(F.array(
        F.struct(F.col("truth").cast("int").alias("c"), F.lit(True).alias("row")),
        F.struct(F.col("pred").cast("int").alias("c"), F.lit(False).alias("row"))))
    e = conf.select("truth", "pred", "n", cls.alias("_s"))
    hit = F.col("truth") == F.col("pred")
    real = F.col("truth") != ignored
    once = F.col("_s.row") | ~hit
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    per = e.where(F.col("_s.c").between(0, k - 1)).groupBy(F.col("_s.c").alias("cls")).agg(
        s(hit & F.col("_s.row")).alias("i7"), s(once).alias("u7"),
        s(hit & F.col("_s.row") & real).alias("i6"), s(once & real).alias("u6"))
    return per.agg(
        F.avg(F.try_divide("i7", "u7")).alias("miou_all"),
        F.avg(F.when(F.col("cls") != ignored, F.try_divide("i6", "u6"))).alias("miou_without_ignored"))


def class_weights(counts: DataFrame, cls: str = "cls", n: str = "n", cap: float = MAX_CLASS_WEIGHT) -> DataFrame:
    """Inverse-frequency weights scaled to mean 1, then capped. K rows, so the
    unpartitioned windows are bounded."""
    w = W.partitionBy(F.lit(1))
    c = counts.withColumn("_c", F.greatest(F.col(n).cast("double"), F.lit(1.0)))
    raw = c.withColumn("_w", F.sum("_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("_c")))
    return raw.withColumn("weight", F.least(F.col("_w") / F.avg("_w").over(w), F.lit(cap))).select(cls, "weight")


def weighted_ce(scored: DataFrame, weights: DataFrame, truth: str = "truth", probs: str = "probs",
                k: int = 7) -> DataFrame:
    """Weighted mean of -ln p(truth) over labeled pixels; infinite where a truth has probability 0.

    Per-class sums first, so the K weights meet K rows and not every pixel.
    """
    p = F.get(F.col(probs), F.col(truth).cast("int"))
    per = scored.where(F.col(truth).between(0, k - 1)).groupBy(F.col(truth).alias("cls")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log(p))).alias("_l"))
    return per.join(weights, "cls").agg(
        (F.sum(F.col("weight") * F.col("_l")) / F.sum(F.col("weight") * F.col("_n"))).alias("ce"))


def soft_dice(scored: DataFrame, truth: str = "truth", probs: str = "probs", k: int = 7,
              ignore: int = IGNORE, eps: float = 1e-6) -> DataFrame:
    """1 - mean soft Dice over all classes; 3*k sums in one pass, no row per class."""
    p = lambda i: F.get(F.col(probs), F.lit(i))
    t = lambda i: F.col(truth) == i
    sums = []
    for i in range(k):
        sums += [F.sum(F.when(t(i), p(i)).otherwise(0.0)).alias(f"_pt{i}"),
                 F.sum(p(i)).alias(f"_p{i}"), F.sum(t(i).cast("double")).alias(f"_t{i}")]
    one = scored.where(F.col(truth) != ignore).agg(*sums)
    dice = [(F.col(f"_pt{i}") * 2 + eps) / (F.col(f"_p{i}") + F.col(f"_t{i}") + eps) for i in range(k)]
    return one.select((F.lit(1.0) - sum(dice[1:], dice[0]) / k).alias("dice_loss"))


def best_epoch(log: DataFrame, keys: list[str], metric: str = "miou", epoch: str = "epoch",
               extra: tuple = ()) -> DataFrame:
    """First epoch with the highest metric per run; NaN never wins, -1 if none.

    ``extra`` columns are taken from that same epoch.
    """
    ok = F.col(metric).isNotNull() & ~F.isnan(metric)
    rank = F.when(ok, F.struct(F.col(metric).alias("v"), (-F.col(epoch)).alias("e"),
                               *[F.col(x).alias(x) for x in extra]))
    best = log.groupBy(*keys).agg(F.max(rank).alias("_b"))
    return best.select(*keys, F.coalesce(-F.col("_b.e"), F.lit(-1)).alias(f"best_{epoch}"),
                       F.coalesce("_b.v", F.lit(-1.0)).alias(f"best_{metric}"),
                       *[F.col(f"_b.{x}").alias(f"{x}_at_best") for x in extra])


def new_bests(log: DataFrame, keys: list[str], metric: str = "miou", epoch: str = "epoch") -> DataFrame:
    """Epochs that strictly improved on everything before them."""
    ok = log.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    prior = max_before(ok, keys, F.floor(F.col(epoch) / 1024), [epoch], metric, "_prior")
    return prior.where(F.col("_prior").isNull() | (F.col(metric) > F.col("_prior"))).drop("_prior")


def latest_runs(runs: DataFrame, keys: list[str], path: str = "path", ok: str = "readable") -> DataFrame:
    """Newest readable record per key: the last path in sorted order wins."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.where(F.col(ok)).groupBy(*keys).agg(
        F.max(F.struct(F.col(path), *[F.col(c) for c in rest if c != path])).alias("_b"))
    return best.select(*keys, "_b.*")


def seed_summary(results: DataFrame, keys: list[str], metrics: list[str], seed: str = "seed") -> DataFrame:
    """Mean and population deviation over seeds (NaN skipped), four decimals, plus the
    sorted distinct seeds joined by ``|``."""
    aggs = [F.count(F.lit(1)).alias("n_seeds"),
            F.array_join(F.array_sort(F.collect_set(F.col(seed).cast("string"))), "|").alias("seeds")]
    for m in metrics:
        v = F.when(~F.isnan(m), F.col(m))
        aggs += [F.bround(F.avg(v), 4).alias(f"{m}_mean"), F.bround(F.stddev_pop(v), 4).alias(f"{m}_std")]
    return results.groupBy(*keys).agg(*aggs)


def status_counts(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def first_failures(log: DataFrame, order: str, n: int = 20, status: str = "status") -> DataFrame:
    """The first ``n`` failures of the report (top-k, not a full sort)."""
    return log.where(F.col(status) == "fail").orderBy(order).limit(n)
