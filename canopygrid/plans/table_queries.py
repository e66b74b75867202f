"""Metrics, experiment tables, names, models and streams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.functions import bands as B
from canopygrid.functions import names as N
from canopygrid.functions.keys import order_key_sql
from canopygrid.operators import experiments, layers, metrics, ml, raster, sampling
from canopygrid.plans import fixtures as X
from canopygrid.plans.fixtures import RUN, with_
from canopygrid.plans.pixel_queries import COVER_MASK, label_mask, ndvi_pixels
from canopygrid.plans.registry import query
from canopygrid.session import cut_lineage, shared_dir
from canopygrid.sources import commits, config, discovery
from canopygrid.streaming import jobs

# ------------------------------------------------------------------ accuracy

@query("confusion", with_("SELECT truth, pred, count(*) AS n FROM sc WHERE truth BETWEEN 0 AND 6 GROUP BY 1,2", "sc"))
def confusion(spark, d):
    return metrics.confusion(X.scored(spark, d))


IOU = """, i AS (SELECT CAST(k AS INTEGER) AS cls, (SELECT count(*) FROM sc WHERE truth=k AND pred=k) AS inter,
  (SELECT count(*) FROM sc WHERE truth BETWEEN 0 AND 6 AND (truth=k OR pred=k)) AS union_px FROM range(7) t(k))
"""


@query("iou", with_(IOU + "SELECT cls, inter, union_px, round(CASE WHEN union_px>0 THEN inter/union_px::DOUBLE END,9) AS iou FROM i", "sc"))
def iou(spark, d):
    return metrics.iou(metrics.confusion(X.scored(spark, d))).withColumn("iou", F.round("iou", 9))


@query("mean_iou", with_(IOU + "SELECT round(avg(inter/union_px::DOUBLE),9) AS miou FROM i WHERE union_px>0", "sc"))
def mean_iou(spark, d):
    return metrics.mean_iou(metrics.iou(metrics.confusion(X.scored(spark, d)))).select(F.round("miou", 9).alias("miou"))


@query("miou_two_ways", with_(IOU + """, j AS (SELECT CAST(k AS INTEGER) AS cls, (SELECT count(*) FROM sc WHERE truth=k AND pred=k) AS inter,
  (SELECT count(*) FROM sc WHERE truth BETWEEN 1 AND 6 AND (truth=k OR pred=k)) AS u FROM range(1,7) t(k))
 SELECT round((SELECT avg(inter/union_px::DOUBLE) FROM i WHERE union_px>0),9) AS miou_all, round((SELECT avg(inter/u::DOUBLE) FROM j WHERE u>0),9) AS miou_without_ignored""", "sc"))
def miou_two_ways(spark, d):
    out = metrics.miou_pair(metrics.confusion(X.scored(spark, d)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


WEIGHTS = """, cw AS (SELECT CAST(k AS INTEGER) AS cls, greatest((SELECT count(*) FROM sc WHERE truth=k),1)::DOUBLE AS c FROM range(7) t(k)),
 w0 AS (SELECT cls, sum(c) OVER ()/(7*c) AS w FROM cw), wt AS (SELECT cls, least(w/avg(w) OVER (), 10.0) AS weight FROM w0)
"""


def _weights(spark, d):
    return metrics.class_weights(layers.class_balance(X.scored(spark, d), [], "truth"))


@query("class_weights", with_(WEIGHTS + "SELECT cls, round(weight,9) AS weight FROM wt", "sc"))
def class_weights(spark, d):
    return _weights(spark, d).withColumn("weight", F.round("weight", 9))


@query("weighted_ce", with_(WEIGHTS + """SELECT round(sum(weight*-ln(CASE WHEN pred=truth THEN 0.7::DOUBLE ELSE 0.05::DOUBLE END))/sum(weight),8) AS ce
 FROM sc JOIN wt ON cls=truth""", "sc"))
def weighted_ce(spark, d):
    return metrics.weighted_ce(X.scored(spark, d), _weights(spark, d)).select(F.round("ce", 8).alias("ce"))


@query("soft_dice", with_(""", v AS (SELECT * FROM sc WHERE truth<>255), k AS (SELECT i,
  (SELECT sum(CASE WHEN truth=i THEN (CASE WHEN pred=i THEN 0.7::DOUBLE ELSE 0.05::DOUBLE END) ELSE 0 END) FROM v) AS pt,
  (SELECT sum(CASE WHEN pred=i THEN 0.7::DOUBLE ELSE 0.05::DOUBLE END) FROM v) AS p, (SELECT count(*) FROM v WHERE truth=i) AS t FROM range(7) r(i))
 SELECT round(1-avg((2*pt+1e-6)/(p+t+1e-6)),8) AS dice_loss FROM k""", "sc"))
def soft_dice(spark, d):
    return metrics.soft_dice(X.scored(spark, d)).select(F.round("dice_loss", 8).alias("dice_loss"))


@query("class_counts_json", with_(COVER_MASK + """, k AS (SELECT chip, i, count(*) FILTER (WHERE mask=i) AS n FROM m, range(7) t(i) GROUP BY ALL)
 SELECT chip, '{'||string_agg('"'||['Tree','Shrub','Grass','Soil','Building','Asphalt','Water'][i+1]||'":'||CAST(n AS VARCHAR), ',' ORDER BY i)||'}' AS class_pixel_counts
 FROM k GROUP BY chip""", "px", "cover"))
def class_counts_json(spark, d):
    return config.class_counts_json(layers.class_balance(label_mask(spark, d), ["chip"]), ["chip"])


# ------------------------------------------------------------------ epochs and runs

@query("best_epoch", with_(""", g AS (SELECT * FROM ep WHERE NOT isnan(miou)), b AS (SELECT arch,init,patch,seed,max(miou) AS best_miou FROM g GROUP BY ALL),
 f AS (SELECT g.arch,g.init,g.patch,g.seed,best_miou,min(epoch) AS best_epoch FROM g JOIN b USING (arch,init,patch,seed) WHERE miou=best_miou GROUP BY ALL)
 SELECT k.arch,k.init,k.patch,k.seed,coalesce(best_epoch,-1) AS best_epoch, round(coalesce(best_miou,-1.0),9) AS best_miou, round(ep.shrub,9) AS shrub_at_best
 FROM (SELECT DISTINCT arch,init,patch,seed FROM ep) k LEFT JOIN f USING (arch,init,patch,seed)
 LEFT JOIN ep ON ep.arch=k.arch AND ep.init=k.init AND ep.patch=k.patch AND ep.seed=k.seed AND ep.epoch=f.best_epoch""", "ep"))
def best_epoch(spark, d):
    b = metrics.best_epoch(X.epochs(spark, d), RUN, extra=("shrub",))
    return b.select(*RUN, "best_epoch", F.round("best_miou", 9).alias("best_miou"), F.round("shrub_at_best", 9).alias("shrub_at_best"))


@query("best_class_epoch", with_(""", b AS (SELECT arch,init,patch,seed,max(shrub) AS v FROM ep GROUP BY ALL)
 SELECT ep.arch,ep.init,ep.patch,ep.seed,min(epoch) AS best_epoch, round(v,9) AS best_shrub FROM ep JOIN b USING (arch,init,patch,seed) WHERE shrub=v GROUP BY ep.arch,ep.init,ep.patch,ep.seed,v""", "ep"))
def best_class_epoch(spark, d):
    b = metrics.best_epoch(X.epochs(spark, d), RUN, metric="shrub")
    return b.select(*RUN, "best_epoch", F.round("best_shrub", 9).alias("best_shrub"))


@query("new_best_epochs", with_("""SELECT arch,init,patch,seed,epoch,round(miou,9) AS miou FROM (SELECT *, max(miou) OVER (PARTITION BY arch,init,patch,seed ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ep WHERE NOT isnan(miou)) WHERE prior IS NULL OR miou>prior""", "ep"))
def new_best_epochs(spark, d):
    return metrics.new_bests(X.epochs(spark, d), RUN).select(*RUN, "epoch", F.round("miou", 9).alias("miou"))


LATEST = """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arch,init,patch,seed ORDER BY path DESC) AS rn FROM runs WHERE readable) WHERE rn=1)
"""


def _latest(spark, d):
    return metrics.latest_runs(X.runs(spark, d), RUN)


@query("latest_run", with_(LATEST + "SELECT arch,init,patch,seed,path,event_id FROM newest", "runs"))
def latest_run(spark, d):
    return _latest(spark, d).select(*RUN, "path", "event_id")


@query("seed_summary", with_(LATEST + """SELECT arch,init,patch,count(*) AS n_seeds, string_agg(CAST(seed AS VARCHAR),'|' ORDER BY seed) AS seeds,
  round_even(avg(miou) FILTER (WHERE NOT isnan(miou)),4) AS miou_mean, round_even(stddev_pop(miou) FILTER (WHERE NOT isnan(miou)),4) AS miou_std FROM newest GROUP BY arch,init,patch""", "runs"))
def seed_summary(spark, d):
    return metrics.seed_summary(_latest(spark, d), ["arch", "init", "patch"], ["miou"])


@query("results_table", with_(LATEST + "SELECT arch,init,patch,seed,round_even(miou,6) AS miou,path FROM newest", "runs"))
def results_table(spark, d):
    return experiments.results_table(_latest(spark, d)).select(*RUN, "miou", "path")


@query("status_counts", with_("SELECT status, count(*) AS n FROM st GROUP BY 1", "st"))
def status_counts(spark, d):
    return metrics.status_counts(X.status_log(spark, d))


@query("first_failures", with_("SELECT event_id, status FROM st WHERE status='fail' ORDER BY event_id LIMIT 20", "st"))
def first_failures(spark, d):
    return metrics.first_failures(X.status_log(spark, d), "event_id")


JOBS = """, offered AS (SELECT DISTINCT arch, init FROM runs WHERE readable AND miou>0.4 AND NOT isnan(miou)),
 grid AS (SELECT arch, init, patch, seed FROM (SELECT DISTINCT arch, init FROM runs) w JOIN offered USING (arch,init), (VALUES (128),(256)) p(patch), (VALUES (1),(2),(3)) s(seed))
"""


def _jobs(spark, d):
    r = X.runs(spark, d)
    good = r.where(F.col("readable") & (F.col("miou") > 0.4) & ~F.isnan("miou")).select("arch", "init").distinct()
    return experiments.job_grid(r.select("arch", "init").distinct(), good, [128, 256], [1, 2, 3])


@query("job_grid", with_(JOBS + "SELECT *, row_number() OVER (ORDER BY seed, arch, init, patch) AS job_no FROM grid", "runs"))
def job_grid(spark, d):
    return experiments.number_jobs(_jobs(spark, d)).select(*RUN, "job_no")


@query("jobs_pending", with_(JOBS + LATEST + "SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.arch=g.arch AND n.init=g.init AND n.patch=g.patch AND n.seed=g.seed)", "runs"))
def jobs_pending(spark, d):
    return discovery.pending(_jobs(spark, d), _latest(spark, d), RUN).select(*RUN)


@query("compat_check", """SELECT event_id, (k=1) AS bad_channels, (k=2) AS bad_coord, (k=3) AS bad_classes, k IN (1,2,3) AS fatal, event_id%2=1 AS warn_patch
 FROM (SELECT event_id, event_id%6 AS k FROM events)""")
def compat_check(spark, d):
    k = F.col("event_id") % 6
    runs = X.table(spark, d, "events").select(
        "event_id", F.when(k == 1, 22).when(k == 5, F.lit(None)).otherwise(6).alias("in_channels"),
        F.when(k == 2, "xy").when(k == 5, F.lit(None)).otherwise("none").alias("coord"),
        F.when(k == 3, 4).when(k == 4, 0).otherwise(7).alias("n_classes"),
        F.when(F.col("event_id") % 2 == 1, 128).otherwise(256).alias("patch"))
    return experiments.check_run(runs, 6, "none", 7, 256).select(
        "event_id", "bad_channels", "bad_coord", "bad_classes", "fatal", "warn_patch")


# ------------------------------------------------------------------ names

@query("path_stem", with_(r"SELECT path, regexp_extract(path,'([^/]+?)(\.[^./]*)?/*$',1) AS stem, lower(path) AS path_key FROM pa", "pa"))
def path_stem(spark, d):
    return X.paths(spark, d).select("path", N.stem("path").alias("stem"), N.path_key("path").alias("path_key"))


@query("parse_tile_name", """SELECT page_id, CAST((page_id%200)*256 AS INTEGER) AS r0, CAST((page_id%200)*128 AS INTEGER) AS c0,
 CASE WHEN page_id%3<>0 THEN lpad(CAST(page_id AS VARCHAR),5,'0') END AS tile_id FROM pages""")
def parse_tile_name(spark, d):
    i = F.col("page_id")
    name = N.chip_file((i % 200) * 256, (i % 200) * 128)
    chm = F.concat(F.when(i % 3 != 0, "chm_").otherwise("old_"), N.padded("page_id", 5), F.lit(".tif"))
    p = X.table(spark, d, "pages").select("page_id", name.alias("name"), chm.alias("chm"))
    return p.select("page_id", N.tile_offset("name", 1).alias("r0"), N.tile_offset("name", 2).alias("c0"), N.tile_id("chm").alias("tile_id"))


@query("format_ids", """SELECT o_orderkey, 'patch_'||CASE WHEN o_orderkey>9999 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR),4,'0') END AS patch,
 'tile_r'||lpad(CAST(o_orderkey%90000 AS VARCHAR),5,'0')||'_c'||lpad(CAST(o_custkey%90000 AS VARCHAR),5,'0')||'.npz' AS tile FROM orders""")
def format_ids(spark, d):
    return X.table(spark, d, "orders").select(
        "o_orderkey", N.patch_name("o_orderkey").alias("patch"),
        N.chip_file(F.col("o_orderkey") % 90000, F.col("o_custkey") % 90000).alias("tile"))


@query("source_key", """SELECT o_orderkey, 'm_'||CAST(o_custkey AS VARCHAR)||'_r'||CAST(o_orderkey%512 AS VARCHAR)||'_c'||CAST(o_orderkey%256 AS VARCHAR) AS scene_key,
 'label_'||CAST(o_custkey AS VARCHAR)||'/'||CAST(o_orderkey AS VARCHAR)||CASE WHEN o_orderkey%2=0 THEN '' ELSE '_p128_r0_c128' END AS crop_key FROM orders""")
def source_key(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return X.table(spark, d, "orders").select(
        "o_orderkey", N.scene_source(F.concat(F.lit("m_"), c), k % 512, k % 256).alias("scene_key"),
        N.crop_source(F.concat(F.lit("label_"), c), k.cast("string"), 128, F.lit(0), F.lit(128), k % 2 == 0).alias("crop_key"))


@query("file_fallback", """WITH f AS (SELECT l_orderkey AS tile, l_linenumber AS k, CASE WHEN l_linenumber=3 THEN 'naip_'||CAST(l_orderkey AS VARCHAR)||'.tif'
  ELSE 'naip_x'||CAST(l_partkey AS VARCHAR)||'_'||CAST(l_orderkey AS VARCHAR)||'.tif' END AS path FROM lineitem)
 SELECT tile, coalesce(min(path) FILTER (WHERE k=3), min(path)) AS path, bool_or(k=3) AS exact FROM f GROUP BY tile""")
def file_fallback(spark, d):
    t = F.col("l_orderkey").cast("string")
    exact = F.concat(F.lit("naip_"), t, F.lit(".tif"))
    other = F.concat(F.lit("naip_x"), F.col("l_partkey").cast("string"), F.lit("_"), t, F.lit(".tif"))
    f = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tile"), F.when(F.col("l_linenumber") == 3, exact).otherwise(other).alias("path"))
    want = F.concat(F.lit("naip_"), F.col("tile").cast("string"), F.lit(".tif"))
    return discovery.choose_file(f, ["tile"], F.col("path") == want)


@query("stem_date", """SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts,'%Y-%m-%d_%H%M%S') AS stamp FROM events""")
def stem_date(spark, d):
    stem = F.concat(F.lit("m_3311218_"), F.col("event_id").cast("string"), F.lit("_ne_12_030_"), F.date_format("ts", "yyyyMMdd"))
    e = X.table(spark, d, "events").select("event_id", "ts", stem.alias("stem"))
    return e.select("event_id", N.stem_date("stem").alias("day"), N.run_stamp("ts").alias("stamp"))


# ------------------------------------------------------------------ models

INPUTS = [*X.BANDS, "ndvi", "chm"]


def _training(spark, d):
    px = ndvi_pixels(spark, d).select("scene", "chip", "row", "col", *X.BANDS, "ndvi", "chm")
    px = px.withColumns({**{b: F.col(b) / 255.0 for b in X.BANDS},
                         "ndvi": (F.coalesce("ndvi", F.lit(0.0)) + 1) / 2, "chm": B.scaled_height(F.coalesce("chm", F.lit(0.0)), 30.0)})
    label = (F.when(F.col("ndvi") < 0.55, 3).when(F.col("chm") < 0.01, 2).when(F.col("chm") <= 0.05, 1).otherwise(0))
    px = px.withColumn("mask", F.when((F.col("row") + F.col("col")) % 10 == 0, 255).otherwise(label))
    return sampling.assign_split(px, "chip")


LEARNED = 0.5  # mean intersection over union that a fitted model must reach on held-out pixels
ROUNDS = (3, 10, 30)
SPLIT = f"CASE WHEN {order_key_sql('chip')}%1000000<200000 THEN 'val' ELSE 'train' END"
# the labels' rule on the pixels themselves
TRAINING = f""", tr AS (SELECT scene, row, col, {SPLIT} AS split, CASE WHEN (row+col)%10=0 THEN 255 WHEN (coalesce(ndvi,0.0)+1)/2<0.55 THEN 3
 WHEN h<0.01 THEN 2 WHEN h<=0.05 THEN 1 ELSE 0 END AS mask FROM (SELECT *, least(greatest(coalesce(chm,0.0),0.0),30.0)/30.0 AS h FROM ndvi))"""


def _models(spark):
    return f"{shared_dir(spark)}/pixel-models"


def _rounds(spark, d):
    """Rounds of one run; models are kept, so only the first query that needs them fits."""
    data = _training(spark, d).select("scene", "chip", "row", "col", *INPUTS, "mask", "split")
    train, held = (data.where(F.col("split") == x) for x in ("train", "val"))
    return ml.train_rounds(train.drop("split"), held, INPUTS, ROUNDS, _models(spark), {"arch": "logistic", "seed": 1})


def _fit(spark, d):
    data = _training(spark, d).select("scene", "chip", "row", "col", *INPUTS, "mask", "split")
    fit = lambda df, s: ml.train_pixels(df, s["inputs"], "mask", LogisticRegression(maxIter=s["steps"], family="multinomial"))
    model = ml.kept_model(data.where(F.col("split") == "train").drop("split"), {"inputs": INPUTS, "steps": ROUNDS[-1]}, fit, _models(spark))
    return data, model


@query("train_pixels", with_(TRAINING + """, n AS (SELECT CAST(k AS INTEGER) AS cls, (SELECT count(*) FROM tr WHERE split='train' AND mask=k) AS n FROM range(7) t(k)),
 w AS (SELECT *, (sum(greatest(n,1)) OVER ())/(7.0*greatest(n,1)) AS w FROM n)
 SELECT cls, n AS n_train, round(least(w/avg(w) OVER (), 10.0),6)::DOUBLE AS weight, TRUE AS learned FROM w""", "ndvi"))
def train_pixels(spark, d):
    """Labeled pixels and weight of each class, and whether the model fitted with them is good enough on held-out pixels."""
    data, model = _fit(spark, d)
    train = data.where((F.col("split") == "train") & (F.col("mask") != 255))
    counts = layers.class_balance(train, [], "mask", 7)
    held = ml.predict_pixels(data.where(F.col("split") == "val"), model)
    miou = metrics.mean_iou(ml.evaluate(held)).first()[0]
    return counts.join(metrics.class_weights(counts), "cls").select(
        "cls", F.col("n").alias("n_train"), F.round("weight", 6).alias("weight"), F.lit(miou >= LEARNED).alias("learned"))


@query("predict_pixels", with_(TRAINING + """ SELECT scene, count(*) AS n_px, count(*) FILTER (WHERE mask<>255) AS n_labeled, TRUE AS valid, TRUE AS agrees
 FROM tr GROUP BY scene""", "ndvi"))
def predict_pixels(spark, d):
    """Codes of the fitted model for every pixel: all valid, and mostly the labels' own."""
    data, model = _fit(spark, d)
    px = ml.predict_pixels(data, model).withColumn("lc", F.col("pred") + 1)
    labeled = F.col("mask") != 255
    return px.groupBy("scene").agg(
        F.count(F.lit(1)).alias("n_px"), F.count(F.when(labeled, 1)).alias("n_labeled"), F.bool_and(F.col("lc").between(1, 7)).alias("valid"),
        (F.avg(F.when(labeled, (F.col("pred") == F.col("mask")).cast("double"))) > 0.75).alias("agrees"))


def brightest_band():
    """Small array model used by the query: scores are the bands themselves."""
    return lambda x: x


@query("predict_chips", with_("""SELECT scene, row%32 AS row, col, CAST(list_position([red,green,blue,nir], list_max([red,green,blue,nir])) AS INTEGER) AS lc FROM px""", "px"))
def predict_chips(spark, d):
    px = X.pixels(spark, d).withColumn("row", F.col("row") % 32)
    chips = raster.to_chips(px, 48, X.BANDS, "pad", scenes=X.scenes(spark, d), holes="fill")
    return ml.write_back(ml.predict(chips, brightest_band, X.BANDS, 48), 48)


@query("predict_complete", with_("""SELECT scene, n_tiles, n_tiles - CASE WHEN CAST(substr(scene, 3) AS INTEGER)%3=1 THEN 1 ELSE 0 END AS n_found,
 CAST(substr(scene, 3) AS INTEGER)%3<>1 AS complete FROM (SELECT scene, CAST(5*ceil(max(row%32+1)/48.0) AS INTEGER) AS n_tiles FROM px GROUP BY scene)""", "px"))
def predict_complete(spark, d):
    """Every third scene has not yet published its last chip column."""
    px = X.pixels(spark, d).withColumn("row", F.col("row") % 32)
    chips = raster.to_chips(px, 48, ["red"], "pad")
    late = (F.substring("scene", 3, 9).cast("int") % 3 == 1) & (F.col("c0") == 192)
    return ml.complete_scenes(chips.where(~late), config.scene_meta(px, 48)).withColumn("n_found", F.col("n_found").cast("int"))


@query("eval_model", with_(TRAINING + """ SELECT CAST(k AS INTEGER) AS cls, (SELECT count(*) FROM tr WHERE split='val' AND mask=k) AS n_truth,
 (SELECT count(*) FROM tr WHERE split='val' AND mask<>255) AS n_held, TRUE AS learned FROM range(7) t(k)""", "ndvi"))
def eval_model(spark, d):
    """The fitted model's confusion on held-out pixels: its rows are the truth's counts, its mean overlap is bounded."""
    data, model = _fit(spark, d)
    held = ml.predict_pixels(data.where(F.col("split") == "val"), model)
    conf = metrics.confusion(held, "mask", "pred")
    miou = metrics.mean_iou(metrics.iou(conf)).first()[0]
    per = conf.groupBy(F.col("truth").cast("int").alias("cls")).agg(F.sum("n").alias("n_truth"))
    classes = spark.range(7).select(F.col("id").cast("int").alias("cls"))
    return classes.join(per, "cls", "left").crossJoin(conf.agg(F.sum("n").alias("n_held"))).select(  # one row
        "cls", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), "n_held", F.lit(miou >= LEARNED).alias("learned"))


@query("run_log", """SELECT 'logistic' AS arch, CAST(1 AS INTEGER) AS seed, CAST(3 AS BIGINT) AS rounds, TRUE AS best_is_logged, TRUE AS learned, CAST(2 AS BIGINT) AS commits""")
def run_log(spark, d):
    """A run's rounds appended to the log, appended again as after a restart, and its record."""
    root = X.stored(spark, "log")
    log = cut_lineage(_rounds(spark, d))
    experiments.append_log(log.where("round <= 2"), root, ["arch", "seed"])
    experiments.append_log(log, root, ["arch", "seed"])
    kept = commits.read_published(spark, root)
    record = experiments.run_records(kept, ["arch", "seed"])
    best = kept.select("arch", "seed", F.col("round").alias("best_round"), F.col("miou").alias("_there"))
    return record.join(best, ["arch", "seed", "best_round"]).select(
        "arch", "seed", "rounds", (F.col("best_miou") == F.col("_there")).alias("best_is_logged"),
        (F.col("best_miou") >= LEARNED).alias("learned"), F.lit(commits.latest(spark, root)).cast("long").alias("commits"))


# ------------------------------------------------------------------ streams

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _event_stream(spark, d):
    return jobs.open_stream(spark, f"{d}/events.parquet", EVENT_SCHEMA)


@query("stream_status", with_("SELECT status, count(*) AS n FROM st GROUP BY 1", "st"))
def stream_status(spark, d):
    m = F.col("event_id") % 10
    log = _event_stream(spark, d).select(F.when(m <= 6, "ok").when(m <= 8, "skip").otherwise("fail").alias("status"))
    home = jobs.scratch(spark, "status")
    jobs.board(jobs.status_stream(log), f"{home}/board", ["status"], f"{home}/state")
    return jobs.read_board(spark, f"{home}/board")


@query("stream_best", with_(""", b AS (SELECT arch,init,patch,seed,max(miou) AS best FROM runs WHERE NOT isnan(miou) GROUP BY ALL)
 SELECT r.arch,r.init,r.patch,r.seed,round(best,9) AS best,min(event_id) AS best_at FROM runs r JOIN b USING (arch,init,patch,seed) WHERE miou=best GROUP BY r.arch,r.init,r.patch,r.seed,best""", "runs"))
def stream_best(spark, d):
    u, i = F.col("user_id"), F.col("event_id")
    log = _event_stream(spark, d).select(
        "event_id", F.col("event_type").alias("arch"), (u % 4).cast("int").alias("init"),
        F.when(u % 2 == 0, 128).otherwise(256).alias("patch"), (u % 3 + 1).cast("int").alias("seed"),
        F.when(i % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 600).alias("miou"))
    home = jobs.scratch(spark, "best")
    jobs.board(jobs.best_stream(log, RUN), f"{home}/board", RUN, f"{home}/state")
    out = jobs.read_board(spark, f"{home}/board")
    return out.where(F.col("best").isNotNull()).withColumn("best", F.round("best", 9))


EMBEDDING_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@query("stream_ingest", """SELECT 'm_'||CAST(vec_id//100 AS VARCHAR) AS scene, count(*) AS n_chips FROM embeddings GROUP BY 1""")
def stream_ingest(spark, d):
    scene = F.concat(F.lit("m_"), F.floor(F.col("vec_id") / 100).cast("string"))
    src = jobs.open_stream(spark, f"{d}/embeddings.parquet", EMBEDDING_SCHEMA).select(scene.alias("scene"), "vec_id", "embedding")
    home = jobs.scratch(spark, "ingest")
    jobs.ingest_scenes(src, lambda b: b.select("scene", "vec_id", F.array_max("embedding").alias("peak")), f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out").groupBy("scene").agg(F.count(F.lit(1)).alias("n_chips"))
