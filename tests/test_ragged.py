"""Queries over rasters whose last scene lacks some of its chips."""

import compare
import pytest
from pyspark.sql import functions as F

from canopygrid.operators import ml, raster
from canopygrid.plans import catalog


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """Chips 0 to 99 and 56 of the next hundred, as a folder."""
    folder = tmp_path_factory.mktemp("ragged")
    value = lambda j: ((F.col("id") * 37 + j * 11) % 101 / 101.0 - 0.5).cast("float")
    spark.range(156).select(F.col("id").alias("vec_id"), (F.col("id") % 7).cast("int").alias("label"),
                            F.transform(F.sequence(F.lit(0), F.lit(63)), value).alias("embedding")).toPandas().to_parquet(
        folder / "embeddings.parquet")
    return str(folder)


def _same(spark, ragged, name):
    assert compare.compare(spark, compare.connect(ragged), name, catalog.QUERIES[name], catalog.ORACLES[name], ragged) is None


@pytest.mark.parametrize("name", ["chips_pad", "chips_drop", "landcover_pixels", "predict_chips", "writeback"])
def test_chips_of_a_scene_with_missing_chips(spark, ragged, name):
    _same(spark, ragged, name)


def test_missing_pixels_do_not_come_back(spark):
    cells = [("a", r, c, r * 8 + c) for r in range(7) for c in range(8) if (r, c) not in ((5, 6), (0, 0))]
    px = spark.createDataFrame([*cells, ("b", 1, 1, 9)], "scene string, row int, col int, v int")
    size = spark.createDataFrame([("a", 8, 8), ("b", 3, 2)], "scene string, width int, height int")
    ch = raster.to_chips(px, 4, ["v"], "pad", scenes=size, holes="fill").cache()
    assert {(r.scene, r.r0, r.c0): (r.seen is None, len(r.v)) for r in ch.collect()} == {
        ("a", 0, 0): (False, 16), ("a", 0, 4): (True, 16), ("a", 4, 0): (False, 16), ("a", 4, 4): (False, 16), ("b", 0, 0): (False, 16)}
    want = sorted(map(tuple, px.collect()))
    assert sorted(map(tuple, raster.to_pixels(ch, 4, ["v"]).collect())) == want
    scored = ml.write_back(ml.predict(ch, lambda: lambda x: x, ["v"], 4), 4)
    assert sorted((r.scene, r.row, r.col) for r in scored.collect()) == [w[:3] for w in want]
    # a repeated pixel that makes up for a missing one is found as well
    twice = px.where("not (row = 3 and col = 3)").union(px.where("row = 2 and col = 2"))
    with pytest.raises(Exception, match="repeat or lie outside"):
        raster.to_chips(twice, 4, ["v"], "pad", scenes=size, holes="fill").collect()
