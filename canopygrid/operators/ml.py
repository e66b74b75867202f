"""Per-pixel classification with Spark ML, and batch scoring of chips."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.model import IGNORE
from canopygrid.operators.layers import class_balance
from canopygrid.operators.metrics import class_weights, confusion, iou
from canopygrid.operators.raster import to_pixels
from canopygrid.sources import commits


def train_pixels(px: DataFrame, inputs: list[str], mask: str = "mask", estimator=None,
                 k: int = 7, ignore: int = IGNORE) -> PipelineModel:
    """Fit on labeled pixels with capped inverse-frequency class weights.

    The K weights are read once (K rows) and enter the plan as an array literal.
    """
    labeled = px.where(F.col(mask) != ignore)
    rows = class_weights(class_balance(labeled, [], mask, k)).collect()
    by = {r["cls"]: float(r["weight"]) for r in rows}
    table = F.array(*[F.lit(by.get(i, 1.0)) for i in range(k)])
    data = labeled.select(*inputs, F.col(mask).cast("double").alias("label"),
                          F.get(table, F.col(mask).cast("int")).alias("weight"))
    est = estimator or LogisticRegression(maxIter=20, family="multinomial")
    est = est.setLabelCol("label").setFeaturesCol("features").setWeightCol("weight")
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"), est]
    return Pipeline(stages=stages).fit(data)


def fingerprint(df: DataFrame, settings: dict) -> str:
    """Hash of a table's rows (in any order) and of the settings used on them."""
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    said = json.dumps([[c, t] for c, t in df.dtypes]) + json.dumps(settings, sort_keys=True) + repr([str(v) for v in row])
    return hashlib.sha256(said.encode()).hexdigest()


def kept_model(data: DataFrame, settings: dict, fit: Callable[[DataFrame, dict], PipelineModel], root: str) -> PipelineModel:
    """The model fitted on these rows with these settings: from ``root`` if it was fitted before, else fitted and kept.

    The model is saved first and then published under its fingerprint, so a reader never meets half of one, and a job that is
    lost while fitting leaves nothing that counts.
    """
    spark, key = data.sparkSession, fingerprint(data, settings)
    stored = commits.read_published(spark, root)
    found = stored.where(F.col("key") == key).first() if stored is not None else None
    if found is None:
        path = f"{root}/models/{uuid.uuid4().hex}"
        fit(data, settings).write().save(path)
        commits.publish_commit(spark.createDataFrame([(key, path, json.dumps(settings))], "key string, path string, settings string"), root, ["key"], key)
        return PipelineModel.load(path)
    return PipelineModel.load(found["path"])


def train_rounds(train: DataFrame, held: DataFrame, inputs: list[str], rounds: tuple[int, ...], root: str, run: dict,
                 mask: str = "mask", k: int = 7) -> DataFrame:
    """One log row per round: ``run``'s columns, round, iterations, miou and iou per class on held-out pixels.

    A round fits with more iterations than the one before; models are kept, so a run that is done again only reads them.
    """
    logs = []
    for n, steps in enumerate(rounds, 1):
        fit = lambda df, s: train_pixels(df, s["inputs"], mask, LogisticRegression(maxIter=s["steps"], family="multinomial"), k)
        model = kept_model(train, {"inputs": inputs, "steps": steps}, fit, root)
        per = evaluate(predict_pixels(held, model), mask, "pred", k)
        one = per.agg(F.avg("iou").alias("miou"), F.array_sort(F.collect_list(F.struct("cls", "iou"))).alias("per"))
        logs.append(one.select(*[F.lit(v).alias(c) for c, v in run.items()], F.lit(n).alias("round"), F.lit(steps).alias("steps"), "miou", F.col("per.iou").alias("iou")))
    return reduce(DataFrame.unionByName, logs)


def predict_pixels(px: DataFrame, model: PipelineModel) -> DataFrame:
    """Internal id per pixel; the fitted model runs inside the executors' JVM."""
    return model.transform(px).withColumn("pred", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction")


def predict(chips: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
            bands: list[str], size: int, batch: int = 16,
            keep=("scene", "r0", "c0", "valid_h", "valid_w")) -> DataFrame:
    """Score chips with any array model, in batches. ``make_model`` is called once per
    task and returns f(batch, bands, size, size) -> scores(batch, k, size, size); the first
    maximum wins, and codes are id+1. Only ``keep`` (with ``seen``, where chips have it) and the codes leave the Python worker."""
    keep = [*keep, *(["seen"] if "seen" in chips.columns and "seen" not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_model()
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                planes = [part.column(b).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size) for b in bands]
                ids = score(np.stack(planes, axis=1).astype("float32")).argmax(axis=1)
                ends = pa.array(np.arange(0, ids.size + 1, size * size, dtype="int32"))
                codes = pa.ListArray.from_arrays(ends, pa.array((ids + 1).ravel().astype("int32")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), codes], names=[*keep, "lc"])

    schema = T.StructType([chips.schema[c] for c in keep] + [T.StructField("lc", T.ArrayType(T.IntegerType()))])
    return chips.select(*keep, *bands).mapInArrow(run, schema)


def complete_scenes(chips: DataFrame, meta: DataFrame, scene: str = "scene") -> DataFrame:
    """Chips found per scene against the number its record promises."""
    got = chips.groupBy(scene).agg(F.count(F.lit(1)).alias("n_found"))
    return meta.join(got, scene, "left").select(
        scene, "n_tiles", F.coalesce("n_found", F.lit(0)).alias("n_found"),
        (F.coalesce("n_found", F.lit(0)) == F.col("n_tiles")).alias("complete"))


def write_back(scored: DataFrame, size: int, keep=("scene",)) -> DataFrame:
    """Predicted codes of the valid area at their raster positions."""
    return to_pixels(scored, size, ["lc"], keep)


def evaluate(px: DataFrame, truth: str = "mask", pred: str = "pred", k: int = 7) -> DataFrame:
    return iou(confusion(px, truth, pred, k), k)
