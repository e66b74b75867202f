"""Stored rasters and layers: key ranges, pruning on both axes, boxes in another system."""

import random

import pytest
from pyspark.sql import functions as F

from canopygrid.functions import coords as C
from canopygrid.plans import fixtures as X
from canopygrid.sources import clustered


def key_of(r, c):
    return sum(((r >> i & 1) << (2 * i + 1)) | ((c >> i & 1) << (2 * i)) for i in range(31))


def test_keys(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 9), (2 ** 31 - 1, 0), (2 ** 31 - 1, 2 ** 31 - 1), (123456789, 987654321)]
    df = spark.createDataFrame(cells, "r long, c long").select("r", "c", clustered.morton(F.col("r"), F.col("c")).alias("k"))
    assert all(x.k == key_of(x.r, x.c) for x in df.collect())


@pytest.mark.parametrize("most", [1, 4, 48, 4096])
def test_ranges_hold_the_rectangle(most):
    rnd = random.Random(most)
    for _ in range(40):
        r0, c0 = rnd.randint(0, 60), rnd.randint(0, 60)
        r1, c1 = r0 + rnd.randint(0, 30), c0 + rnd.randint(0, 30)
        ranges = clustered.key_ranges(r0, c0, r1, c1, most)
        assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        wanted = {key_of(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
        assert all(any(a <= k <= b for a, b in ranges) for k in wanted)
        if most == 4096:
            assert sum(b - a + 1 for a, b in ranges) == len(wanted)
    assert clustered.key_ranges(0, 0, 0, 0) == [(0, 0)]
    wide = clustered.key_ranges(3, 1_000_003, 70_000, 1_900_000)
    assert len(wide) <= clustered.RANGES and sum(b - a + 1 for a, b in wide) < 3 * 70_000 * 900_000


def scanned(df):
    """(rows that the reader handed on, text of the plan) once the frame has run."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)  # the text names all pushed filters
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    scan = plan.collectLeaves().head()
    if "AdaptiveSparkPlan" in plan.nodeName():
        scan = plan.executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), plan.toString()


@pytest.fixture(scope="module")
def raster(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("raster") / "r")
    px = spark.range(512 * 512).select(F.floor(F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"),
                                       F.col("id").alias("red"), (-F.col("id")).alias("nir"))
    clustered.write_raster(px, p, block=16, group_bytes=1 << 16)
    return p


def test_a_window_prunes_on_both_axes(spark, raster):
    px = clustered.read_window(spark, raster, 100, 300, 40, 20)
    assert {(r.row, r.col) for r in px.select("row", "col").collect()} == {(r, c) for r in range(100, 140) for c in range(300, 320)}
    assert all(r.red == r.row * 512 + r.col for r in px.collect())
    read, plan = scanned(px.select("row", "col", "red"))
    # the window's rows alone are 20480 pixels, its columns 10240
    assert read < 8000
    assert "GreaterThanOrEqual(block_key" in plan and "nir" not in plan.split("ReadSchema")[1]
    assert clustered.read_window(spark, raster, 500, 500, 100, 100).count() == 144
    assert clustered.read_window(spark, raster, -5, -5, 7, 7).count() == 4
    assert clustered.read_window(spark, raster, 10, 10, 0, 5).count() == clustered.read_window(spark, raster, -9, 0, 5, 5).count() == 0
    assert clustered.read_bands(spark, raster, ["nir"]).columns == ["row", "col", "nir"]


def test_a_box_is_moved_to_the_layer(spark, tmp_path):
    p = str(tmp_path / "layer")
    n = 200
    ft = spark.range(n * n).select(F.col("id").alias("fid"), (F.floor(F.col("id") / n) * 50.0 + 395000).alias("xmin"), ((F.col("id") % n) * 50.0 + 3695000).alias("ymin"))
    ft = ft.withColumns({"xmax": F.col("xmin") + 10, "ymax": F.col("ymin") + 10})
    clustered.write_layer(ft, p, 26912, cell=100.0, group_bytes=1 << 16)
    lon, lat = -112.09, 33.43
    got = clustered.read_layer(spark, p, (lon, lat, lon + 0.01, lat + 0.01), 4326, pad=0.0)
    # every feature with a corner inside the degree box is there, and nothing a few metres beyond it
    x, y = C.reproject("xmin", "ymin", 26912, 4326)
    placed = ft.select("fid", x.alias("x"), y.alias("y"))
    inside = {r.fid for r in placed.where(F.col("x").between(lon, lon + 0.01) & F.col("y").between(lat, lat + 0.01)).collect()}
    near = {r.fid for r in placed.where(F.col("x").between(lon - 4e-4, lon + 0.0104) & F.col("y").between(lat - 4e-4, lat + 0.0104)).collect()}
    found = {r.fid for r in got.collect()}
    assert inside and inside <= found <= near
    read, plan = scanned(got.select("fid", "xmin"))
    assert read < 8_000 and "GreaterThanOrEqual(xmax" in plan and "LessThanOrEqual(ymin" in plan
    assert clustered.read_layer(spark, p, (400000.0, 3700000.0, 400000.0, 3700000.0), None, buffer_m=3.0).count() == 1


def test_columns_reach_the_scan(spark, sf, tmp_path):
    p = str(tmp_path / "raster")
    clustered.write_raster(X.pixels(spark, sf).select("scene", "row", "col", *X.BANDS), p, block=8)
    px = clustered.read_bands(spark, p, ["red"])
    plan = px._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row:int,col:int,red:int>" in plan
    assert clustered.read_window(spark, p, 16, 0, 8, 8).count() == 64
