"""Sinks, resume, publishing, configuration and streams."""

import pytest
from pyspark.sql import functions as F

from canopygrid.operators import experiments, layers, ml, raster, sampling
from canopygrid.plans import fixtures as X
from canopygrid.plans.table_queries import EVENT_SCHEMA, brightest_band
from canopygrid.sources import commits, config, discovery, tables
from canopygrid.streaming import jobs


def chipset(spark, sf):
    px = X.pixels(spark, sf).withColumn("row", F.col("row") % 32)
    ch = raster.to_chips(px, 16, ["red", "nir"], "pad").withColumn("mask", F.transform("red", lambda x: x % 7))
    key = F.regexp_extract("scene", r"(\d+)", 1).cast("bigint") * 1000 + F.col("r0") + F.col("c0")
    return sampling.assign_split(ch, key).withColumn("patch_size", F.lit(16))


def test_chip_set_round_trip_prunes_partitions(spark, sf, tmp_path):
    p = str(tmp_path / "chips")
    ch = chipset(spark, sf)
    tables.write_chips(ch, p)
    val = tables.read_chips(spark, p, 16, "val")
    assert val.count() == ch.where("split = 'val'").count() > 0
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(patch_size" in plan


def test_old_mask_name(spark, sf, tmp_path):
    p = str(tmp_path / "old")
    tables.write_chips(chipset(spark, sf).withColumnRenamed("mask", "mask4"), p)
    assert "mask" in tables.read_chips(spark, p).columns
    tables.write_chips(chipset(spark, sf).drop("mask"), str(tmp_path / "none"))
    with pytest.raises(KeyError):
        tables.read_chips(spark, str(tmp_path / "none"))


def test_publish_is_idempotent_and_partial(spark, tmp_path):
    p = str(tmp_path / "pub")
    a = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "scene string, v int")
    tables.publish(a, p, ["scene"])
    tables.publish(a.where("scene = 's2'").withColumn("v", F.lit(9)), p, ["scene"])
    assert sorted(map(tuple, spark.read.parquet(p).select("scene", "v").collect())) == [("s1", 1), ("s1", 2), ("s2", 9)]
    tables.publish_spread(a, p, ["scene"], 3, ["v"])
    assert spark.read.parquet(p).count() == 3
    tables.guard_complete(a.select("scene").distinct(), spark.read.parquet(p), "scene")
    with pytest.raises(RuntimeError, match="s3"):
        tables.guard_complete(spark.createDataFrame([("s3",)], "scene string"), spark.read.parquet(p), "scene")


def test_csv_manifest_and_empty_layer(spark, tmp_path):
    p = str(tmp_path / "m")
    tables.write_table_csv(spark.createDataFrame([("patch_0001", 3)], "patch_id string, n int"), p)
    assert spark.read.csv(p, header=True).columns == ["patch_id", "n"]
    e = str(tmp_path / "e")
    tables.empty_features(spark).write.parquet(e)
    got = spark.read.parquet(e)
    assert got.count() == 0 and dict(got.dtypes)["class"] == "int"
    seeds = layers.seed_features(got.withColumn("comp", F.lit(1)), 3, "patch_id")
    assert seeds.isEmpty() and dict(seeds.dtypes)["class"] == "int"


def test_file_listing_skips_nothing(spark, tmp_path):
    for n in ("a/one.tif", "b/One.TIF", "b/two.tif", "c/x.txt"):
        f = tmp_path / n
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    found = discovery.list_files(spark, str(tmp_path), "*.[tT][iI][fF]")
    assert found.count() == 3


def test_config_resolution(spark):
    good = '{"naip_band_count":4,"naip_scale":255,"chm_clip_m":30}'
    rows = [("tiles_2024-01-01_n1", good), ("tiles_2024-01-02_n1", good.replace("255", "1023")),
            ("tiles_2024-01-03_n1", '{"naip_scale":1}'), ("tiles_2024-01-04_n1", "{broken")]
    df = spark.createDataFrame(rows, "name string, doc string")
    cfg = config.load_config(df)
    assert (cfg.naip_scale, cfg.chm_clip_m, cfg.ndvi_auto_rescale) == (1023.0, 30.0, True)
    assert config.load_config(df, contains="01-01").naip_scale == 255.0
    with pytest.raises(ValueError):
        config.load_config(df.where("name > 'tiles_2024-01-03'"))


def test_batches_of_any_size_score_alike(spark, sf):
    px = X.pixels(spark, sf).withColumn("row", F.col("row") % 32)
    chips = raster.to_chips(px, 16, X.BANDS, "pad")
    a, b = (sorted(map(tuple, ml.write_back(ml.predict(chips, brightest_band, X.BANDS, 16, batch=n), 16).collect())) for n in (1, 16))
    assert a == b and len(a) == px.count()


def small_files(spark, sf, folder, n=6):
    X.table(spark, sf, "events").repartition(n).write.parquet(folder)


def test_stream_counts_equal_batch_and_restart(spark, sf, tmp_path):
    src, out, state = (str(tmp_path / k) for k in ("src", "out", "state"))
    small_files(spark, sf, src)
    log = lambda df: df.select(F.when(F.col("event_id") % 10 <= 6, "ok").otherwise("fail").alias("status"))
    stream = lambda: jobs.status_stream(log(jobs.open_stream(spark, src, EVENT_SCHEMA, files_per_batch=2)))
    jobs.board(stream(), out, ["status"], state, buckets=4)
    batch = log(spark.read.parquet(src)).groupBy("status").count()
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, jobs.read_board(spark, out).collect())) == want
    X.table(spark, sf, "events").limit(50).write.mode("append").parquet(src)
    jobs.board(stream(), out, ["status"], state, buckets=4)
    want = sorted(map(tuple, log(spark.read.parquet(src)).groupBy("status").count().collect()))
    assert sorted(map(tuple, jobs.read_board(spark, out).collect())) == want
    # a batch that was committed before is not applied again
    n = commits.latest(spark, out)
    again = spark.createDataFrame([("ok", -1, 0)], "status string, n long, bucket int")
    assert n >= 4 and commits.publish_commit(again, out, ["bucket"], f"{state}#0") == n
    with pytest.raises(FileNotFoundError):
        jobs.read_board(spark, str(tmp_path / "none"))


def test_boards_hold_each_key_once(spark, tmp_path):
    src, out, state = (str(tmp_path / k) for k in ("src", "out", "state"))
    schema = "arch string, event_id long, miou double"
    for rows in ([("a", 1, 0.5), ("b", 2, 0.1)], [("a", 3, 0.4), (None, 4, 0.9)], [("b", 5, 0.7), ("c", 6, float("nan"))], [("a", 7, 0.5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.open_stream(spark, src, spark.createDataFrame([], schema).schema)
        jobs.board(jobs.best_stream(stream, ["arch"]), out, ["arch"], state, buckets=3)
    want = [("a", 0.5, 1), ("b", 0.7, 5), (None, 0.9, 4), ("c", None, None)]
    assert sorted(map(tuple, jobs.read_board(spark, out).collect()), key=str) == sorted(want, key=str)


def test_damaged_files_are_counted(spark, sf, tmp_path):
    p = str(tmp_path / "files")
    rows = spark.range(400).select("id", F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("scene"))
    rows.repartition("scene").write.partitionBy("scene").parquet(p)
    X.truncate(spark, f"{p}/scene=s2")
    got, status = discovery.tolerant_read(spark, p, rows.schema)
    assert sorted(r.id for r in got.collect()) == [i for i in range(400) if i % 4 != 2]
    assert sorted((r.file.split("scene=")[1][:2], r.n_rows, r.readable) for r in status.collect()) == [("s0", 100, True), ("s1", 100, True), ("s2", 0, False), ("s3", 100, True)]
    assert tuple(discovery.read_summary(status).first()) == (4, 3)


def test_models_are_kept_by_data_and_settings(spark, tmp_path):
    root, fits = str(tmp_path / "models"), []
    px = spark.range(600).select((F.col("id") % 30 / 30).alias("red"), (F.col("id") % 3).cast("int").alias("mask"), F.col("id"))
    px = px.withColumn("red", F.col("red") * 0.1 + F.col("mask"))

    def fit(df, s):
        fits.append(s["steps"])
        return ml.train_pixels(df, ["red"], "mask", ml.LogisticRegression(maxIter=s["steps"], family="multinomial"), 3)

    for steps in (5, 5, 30):
        model = ml.kept_model(px, {"steps": steps}, fit, root)
    ml.kept_model(px.orderBy(F.desc("id")), {"steps": 30}, fit, root)  # the same rows in another order
    ml.kept_model(px.where("id < 300"), {"steps": 30}, fit, root)
    assert fits == [5, 30, 30]
    assert ml.predict_pixels(px, model).where("pred <> mask").count() == 0


def test_log_rounds_replace_themselves(spark, tmp_path):
    root = str(tmp_path / "log")
    log = lambda *r: spark.createDataFrame([("a", 1, n, m) for n, m in r], "arch string, seed int, round int, miou double")
    experiments.append_log(log((1, 0.1), (2, 0.4)), root, ["arch", "seed"])
    experiments.append_log(log((2, 0.4), (3, 0.4), (4, float("nan"))), root, ["arch", "seed"])
    kept = commits.read_published(spark, root)
    assert kept.count() == 4
    assert tuple(experiments.run_records(kept, ["arch", "seed"]).select("rounds", "best_round", "best_miou").first()) == (4, 2, 0.4)


def test_ingest_keeps_every_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / k) for k in ("src", "out", "state"))
    first = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "scene string, v int")
    add = lambda df: df.coalesce(1).write.mode("append").parquet(src)
    run = lambda **k: jobs.ingest_scenes(
        jobs.open_stream(spark, src, first.schema, files_per_batch=1), lambda b: b.withColumn("w", F.col("v") * 10), out, state, **k)
    rows = lambda: sorted(map(tuple, spark.read.parquet(out).select("scene", "v", "w").collect()))
    add(first)
    run()
    run()
    assert rows() == [("s1", 1, 10), ("s1", 2, 20), ("s2", 3, 30)]
    # a late part of s2 is kept; s1 is recorded as complete and not computed again
    add(spark.createDataFrame([("s2", 4)], "scene string, v int"))
    add(spark.createDataFrame([("s1", 7), ("s3", 5)], "scene string, v int"))
    run(done=spark.createDataFrame([("s1",)], "scene string"))
    assert rows() == [("s1", 1, 10), ("s1", 2, 20), ("s2", 3, 30), ("s2", 4, 40), ("s3", 5, 50)]


def test_stream_queries_over_a_folder_table(spark, sf, tmp_path):
    import compare

    from canopygrid.plans.catalog import ORACLES, QUERIES

    for name in ("events", "embeddings"):
        X.table(spark, sf, name).repartition(5).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = compare.connect(sf)
    for q in ("stream_status", "stream_best", "stream_ingest"):
        assert compare.compare(spark, con, q, QUERIES[q], ORACLES[q], str(tmp_path)) is None
