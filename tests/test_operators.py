"""Property, boundary-value and scale-path tests."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import coords as C
from canopygrid.functions import geometry as G
from canopygrid.functions import names as N
from canopygrid.model import ChipConfig
from canopygrid.functions.keys import is_validation, order_key, unit_draw
from canopygrid.operators import augment, cover, layers, metrics, morphology, points, ranking, raster, sampling, vector

NAN, INF = float("nan"), float("inf")


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---------------------------------------------------------------- rules at their limits

def test_tree_threshold_differs_between_rules(spark):
    df = spark.createDataFrame([(0.2, 1.5, 0), (0.2, 0.3, 0), (0.19999, 5.0, 0), (0.5, 1.50001, 0)], "ndvi double, chm double, pred5 int")
    got = one(df, B.veg_stratum(), B.pseudolabel4(), B.hybrid_codes())
    assert got == [("shrub", 1, 1), ("shrub", 1, 2), (None, 3, 1), ("tree", 0, 1)]


def test_missing_height_and_index(spark):
    df = spark.createDataFrame([(0.5, None, 0), (0.5, NAN, 0), (None, 2.0, 3), (NAN, 2.0, 4)], "ndvi double, chm double, pred5 int")
    got = one(df, B.veg_stratum(), B.veg_stratum(null_is_ground=False), B.pseudolabel4(), B.hybrid_codes())
    assert got == [("grass", None, 3, 0), (None, None, 3, 0), (None, None, 3, 6), (None, None, 3, 7)]


def test_ndvi_zero_sum(spark):
    df = spark.createDataFrame([(0, 0), (0, 4), (4, 0), (1, 3)], "red int, nir int")
    assert one(df, B.ndvi()) == [(None,), (1.0,), (-1.0,), (0.5,)]


def test_remap_keeps_ignore(spark):
    df = spark.createDataFrame([(i,) for i in (*range(7), 255)], "m int")
    assert [r[0] for r in one(df, B.remap("m", "five"))] == [0, 0, 0, 1, 2, 3, 4, 255]
    assert [r[0] for r in one(df, B.remap("m", "four"))] == [0, 1, 2, 3, 3, 3, 3, 255]


def test_normalize_nonfinite_and_rescale(spark):
    px = [0.0, 255.0, 510.0, 51.0]
    df = spark.createDataFrame([(1, px, px, px, px, [NAN, INF, -INF, 0.5], [NAN, INF, -5.0, 15.0]),
                                (2, px, px, px, px, [5000.0, -20000.0, 0.0, 10000.0], [30.0, 31.0, 0.0, 3.0])],
                               "chip int, red array<double>, green array<double>, blue array<double>, nir array<double>, ndvi array<double>, chm array<double>")
    a, b = B.normalize(df, ChipConfig()).orderBy("chip").collect()
    assert a["ndvi"] == [0.0, 1.0, 0.0, 0.75] and a["chm"] == [0.0, 1.0, 0.0, 0.5]
    assert a["red"] == [0.0, 1.0, 2.0, 0.2]
    assert b["ndvi"] == [0.75, 0.0, 0.5, 1.0] and b["chm"] == [1.0, 1.0, 0.0, 0.1]
    p = B.physical(df, ChipConfig()).orderBy("chip").collect()[0]
    assert p["ndvi"] == [0.0, 1.0, -1.0, 0.5] and p["chm"] == [0.0, 0.0, -5.0, 15.0]


def test_share_limits_are_strict(spark):
    px = spark.createDataFrame([(1, 0 if i < 20 else 9) for i in range(100)] + [(2, 0 if i < 21 else 9) for i in range(100)], "k int, b int")
    assert [r[0] for r in one(sampling.black_share_ok(px, ["k"], ["b"]), "k")] == [1]
    m = spark.createDataFrame([(1, 0 if i < 1 else 255) for i in range(100)] + [(2, 0 if i < 1 else 255) for i in range(101)], "k int, mask int")
    assert dict(one(sampling.labeled_share(m, ["k"]), "k", "kept")) == {1: True, 2: False}


def test_coord_layouts(spark):
    assert [len(C.LAYOUTS[m]) for m in ("none", "xy", "sincos")] == [0, 2, 16]
    px = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "scene string, x double, y double")
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 4.0), ("b", 1.0, 0.0, 1.0, 8.0)],
                                  "scene string, xmin double, ymin double, xmax double, ymax double")
    out = {r.scene: (r.coord_x, r.coord_y) for r in C.with_position(px, "xy", "x", "y", boxes, ["scene"]).collect()}
    assert out == {"a": (0.5, 0.5), "b": (None, 0.25)}
    with pytest.raises(ValueError):
        C.with_position(px, "polar", "x", "y", boxes, ["scene"])


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-112.1, 33.4)], "lon double, lat double")
    x, y = C.to_mercator("lon", "lat")
    back = one(df.select(x.alias("x"), y.alias("y")), *C.from_mercator("x", "y"))[0]
    assert back == pytest.approx((-112.1, 33.4))
    with pytest.raises(ValueError):
        C.reproject("x", "y", 2868, 3857)


@pytest.mark.parametrize("code", [26901, 26912, 6341, 26923])
def test_utm_round_trip(spark, code):
    zone = C.utm_zone(code)
    df = spark.createDataFrame([(zone * 6 - 183 + x, float(y)) for x in (-3.0, -1.1, 0.0, 2.0, 3.0) for y in (0, 1, 33, 48, 70, 83)], "lon double, lat double")
    e, n = C.reproject("lon", "lat", 4326, code)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = C.reproject("e", "n", code, 4326)
    for r in back.select("lon", "lat", lon.alias("x"), lat.alias("y")).collect():
        assert abs(r.x - r.lon) < 5e-9 and abs(r.y - r.lat) < 5e-9  # half a millimetre
    with pytest.raises(ValueError):
        C.reproject("e", "n", code, 32612)


def test_box_in_another_system(spark):
    box = C.reproject_box(-114.0, 30.0, -108.0, 38.0, 4326, 26912, spark)
    df = spark.range(121 * 121).select((F.floor(F.col("id") / 121) / 20 - 114).alias("lon"), (F.col("id") % 121 / 15 + 30).alias("lat"))
    x, y = C.reproject("lon", "lat", 4326, 26912)
    inside = x.between(box[0], box[2]) & y.between(box[1], box[3])
    assert df.where(~inside).count() == 0
    span = df.agg(F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    assert box[2] - box[0] < 1.01 * span[0] and box[3] - box[1] < 1.01 * span[1]
    assert C.reproject_box(0, 1, 2, 3, None, 3857, spark) == (0, 1, 2, 3) == C.reproject_box(0, 1, 2, 3, 3857, 3857, spark)


def test_regrid_between_systems(spark):
    """A plane stays a plane: bilinear weights reproduce a linear field wherever four cells are there."""
    src = raster.Grid(2.0, -2.0, 300000.0, 3700100.0, 50, 50)
    df = spark.range(2500).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    df = df.withColumn("v", F.col("col") * 3.0 - F.col("row") + 7.0)
    corner = spark.createDataFrame([(300000.0, 3700000.0)], "x double, y double")
    x, y = one(corner, *C.reproject("x", "y", 26912, 3857))[0]
    dst = raster.Grid(1.5, 1.5, x - 30, y - 30, 120, 120)
    out = raster.regrid_crs(df, "v", src, 26912, dst, 3857)
    px, py = C.reproject(dst.c + dst.a * (F.col("col") + 0.5), dst.f + dst.e * (F.col("row") + 0.5), 3857, 26912)
    rows = out.select("v", ((px - src.c) / src.a).alias("u"), ((py - src.f) / src.e).alias("w")).collect()
    inner = [r for r in rows if 0.5 <= r.u <= 49.5 and 0.5 <= r.w <= 49.5]
    assert len(inner) > 5000 and all(r.v == pytest.approx((r.u - 0.5) * 3 - (r.w - 0.5) + 7, abs=1e-6) for r in inner)
    every = spark.range(120 * 120).select(F.floor(F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col"))
    there = every.where(((px - src.c) / src.a).between(0, 50) & ((py - src.f) / src.e).between(0, 50))
    assert there.count() == len(rows)
    assert raster.regrid_crs(df, "v", src, 26912, src, 26912).count() == 2500
    assert raster.regrid_crs(df, "v", src, None, src, 3857).count() == 2500


def test_tile_name_error(spark):
    df = spark.createDataFrame([("tile_r00256_c00128.npz",), ("x.npz",)], "n string")
    assert one(df.limit(1), N.tile_offset("n", 1), N.tile_offset("n", 2)) == [(256, 128)]
    with pytest.raises(Exception, match="unexpected tile name"):
        df.select(N.tile_offset("n", 1)).collect()


def test_class_field(spark):
    df = spark.createDataFrame([(1, 9, 3, "a"), (2, 8, None, "b")], "id int, other int, lc int, t string")
    assert layers.resolve_class_column(df) == "lc"
    assert layers.resolve_class_column(df.withColumn("gridcode", F.lit(1))) == "gridcode"
    with pytest.raises(ValueError):
        layers.resolve_class_column(df.withColumn("lc2", F.lit(2)))


# ---------------------------------------------------------------- ranks and windows

def test_two_level_windows_match_plain_windows(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{i % 7}", i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    ranked = ranking.row_number_in(df, ["k"], F.floor(F.col("i") / 100), ["i"], "n")
    top = ranking.max_before(df, ["k"], F.floor(F.col("i") / 100), ["i"], "v", "m")
    by = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append((i, v))
    want = {(k, i): (n, max((x for _, x in s[:n - 1]), default=None)) for k, s in by.items() for n, (i, _) in enumerate(s, 1)}
    assert {(r.k, r.i): r.n for r in ranked.collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.k, r.i): r.m for r in top.collect()} == {k: v[1] for k, v in want.items()}


def test_sequential_ids_are_dense(spark):
    ids = sampling.sequential_ids(spark.range(5000), "id", tie=["id"]).select("patch_id").collect()
    assert sorted(r[0] for r in ids) == list(range(1, 5001))


def test_cap_keeps_whole_small_groups(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise("cold").alias("k"), "id")
    got = points.cap_per_group(df, "k", "id", 150).groupBy("k").count().collect()
    assert {r[0]: r[1] for r in got} == {"hot": 150, "cold": 100}


# ---------------------------------------------------------------- points and grids

def brute_gap(cells, y1, x1):
    out = {}
    for y in range(y1 + 1):
        for x in range(x1 + 1):
            if (y, x) in cells:
                continue
            est = []
            for axis in (0, 1):
                def probe(step):
                    p = [y, x]
                    while True:
                        p[axis] += step
                        if not (0 <= p[0] <= y1 and 0 <= p[1] <= x1):
                            return None
                        if tuple(p) in cells:
                            return tuple(p)
                lo, hi = probe(-1), probe(1)
                if lo and hi:
                    span = hi[axis] - lo[axis]
                    t = ((y, x)[axis] - lo[axis]) / span
                    est.append((1 / span, cells[lo] + (cells[hi] - cells[lo]) * t))
            if est:
                out[(y, x)] = sum(w * v for w, v in est) / sum(w for w, _ in est)
    return out


def test_gap_fill(spark):
    rnd = random.Random(3)
    cells = {(y, x): float(rnd.randint(0, 50)) for y in range(15) for x in range(15) if rnd.random() < 0.6}
    cells[(0, 0)] = cells[(14, 14)] = 1.0
    df = spark.createDataFrame([("a", y, x, v) for (y, x), v in cells.items()], "t string, cy int, cx int, dtm double")
    got = {(r.cy, r.cx): r.dtm for r in points.gap_fill(df, "t", "dtm").where("filled").collect()}
    want = brute_gap(cells, 14, 14)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    few = points.gap_fill(df.limit(50), "t", "dtm").where("filled")
    assert few.isEmpty()


def test_radius_fanout_is_complete(spark):
    """No cell outside the 3x3 neighbourhood can have its centre in reach."""
    rnd = random.Random(5)
    pts = [(rnd.uniform(2, 8), rnd.uniform(2, 8), rnd.uniform(0, 9), 1) for _ in range(200)] + [(3.0, 3.0, 5.0, 1)]
    df = spark.createDataFrame(pts, "x double, y double, z double, cls int")
    got = {(r.cy, r.cx): r.dsm for r in points.grid_points(df, 0.5, "dsm", "radius").collect()}
    want = {}
    for x, y, z, _ in pts:
        for cy in range(0, 20):
            for cx in range(0, 20):
                if (x - (cx + 0.5) * 0.5) ** 2 + (y - (cy + 0.5) * 0.5) ** 2 <= 2 * 0.25:
                    want[(cy, cx)] = max(z, want.get((cy, cx), -1))
    assert got == want


def test_regrid_identity_and_constant(spark):
    src, dst = raster.Grid(0.5, -0.5, 10.0, 40.0, 20, 20), raster.Grid(0.3, -0.3, 10.0, 40.0, 33, 33)
    df = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit(7.0).alias("v"))
    assert raster.regrid(df, "v", src, src).count() == 400
    out = raster.regrid(df, "v", src, dst).collect()
    assert len(out) == 33 * 33 and all(r.v == pytest.approx(7.0) for r in out)


def test_chip_round_trip_and_small_scene(spark):
    px = spark.range(7 * 11).select(F.lit("s").alias("scene"), F.floor(F.col("id") / 11).cast("int").alias("row"),
                                    (F.col("id") % 11).cast("int").alias("col"), F.col("id").cast("int").alias("v"))
    back = raster.to_pixels(raster.to_chips(px, 4, ["v"], "pad"), 4, ["v"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.select("scene", "row", "col", "v").collect()))
    assert raster.to_chips(px, 16, ["v"], "drop").isEmpty()
    big = raster.to_chips(px, 16, ["v"], "pad").collect()
    assert len(big) == 1 and (big[0].valid_h, big[0].valid_w, len(big[0].v)) == (7, 11, 256)
    with pytest.raises(Exception, match="missing pixels"):
        raster.to_chips(px.where("v <> 5"), 4, ["v"], "pad").collect()


def test_d4_is_a_permutation_and_cycles(spark):
    ch = spark.range(40).select(F.col("id").alias("chip"), F.sequence(F.lit(0), F.lit(15)).alias("a"), F.sequence(F.lit(0), F.lit(15)).alias("m"))
    out = augment.augment_d4(ch, "chip", 4, ["a", "m"], 1).collect()
    assert all(sorted(r.a) == list(range(16)) and r.a == r.m for r in out) and len({tuple(r.a) for r in out}) > 3
    turn = F.struct(F.lit(False).alias("flip_h"), F.lit(False).alias("flip_v"), F.lit(1).alias("turns"))
    t = ch.limit(1)
    for _ in range(4):
        t = t.withColumn("a", augment.moved("a", 4, turn))
    assert t.first().a == list(range(16))


def test_crops_of_a_tile_share_its_split(spark):
    tiles = sampling.assign_split(spark.range(4000).withColumnRenamed("id", "t"), "t")
    share = tiles.agg(F.avg((F.col("split") == "val").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.02
    crops = tiles.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    assert crops.groupBy("t").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()


# ---------------------------------------------------------------- vectors

DONUT = [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1), (3, 3), (3, 7), (7, 7), (7, 3), (3, 3), (1, 1)]


def py_inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def test_burn_matches_point_in_polygon(spark):
    rnd = random.Random(9)
    rings = {1: DONUT}
    for k in range(2, 12):
        c = [(rnd.uniform(-3, 18), rnd.uniform(-3, 18)) for _ in range(rnd.randint(3, 7))]
        rings[k] = [*c, c[0]]
    rows = [(k, k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in rings.items()]
    ft = spark.createDataFrame(rows, "code int, seq long, ring array<struct<x:double,y:double>>")
    got = {(r.row, r.col): r.top for r in vector.burn(ft, 16, 16).collect()}
    want = {}
    for r in range(16):
        for c in range(16):
            hits = [k for k, ring in rings.items() if py_inside(ring, c + 0.5, r + 0.5)]
            if hits:
                want[(r, c)] = max(hits)
    assert got == want


def test_zonal_median_of_rings_in_rings(spark):
    px = spark.createDataFrame([(r, c, 17.0 if 4 <= r < 6 and 4 <= c < 6 else float(r)) for r in range(10) for c in range(10)], "row int, col int, v double")
    rings = spark.createDataFrame([(1, 0.0, 10.0), (1, 4.0, 6.0)], "fid long, a double, b double").select("fid", G.box_ring("a", "a", "b", "b").alias("ring"))
    out = vector.zonal(px, rings, ["v"]).collect()
    want = sorted(float(r) for r in range(10) for c in range(10) if not (4 <= r < 6 and 4 <= c < 6))
    assert [(r.fid, r.v_med) for r in out] == [(1, (want[47] + want[48]) / 2)]


@pytest.mark.parametrize("cell", [0.7, 4.0, 100.0])
def test_inside_is_strict_on_edges(spark, cell):
    pts = [(1, 5.0, 5.0), (2, 1.0, 5.0), (3, 1.5, 2.5), (4, 9.0, 9.0), (5, 2.0, 9.0), (6, 20.0, 2.0), (7, 8.0, 2.0)]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    ft = spark.range(1).select(F.col("id").alias("fid"), G.literal_ring(DONUT).alias("ring"))
    assert sorted(r.id for r in cover.inside(p, ft, ["id"], cell=cell).collect()) == [3, 7]
    assert sorted(r.id for r in cover.inside(p, ft, ["id"], cell=cell, strict=False).collect()) == [2, 3, 4, 5, 7]


@pytest.mark.parametrize("cell", [1.0, 3.0])
def test_inside_equals_ray_casting(spark, cell):
    rnd = random.Random(8)
    rings = [[(rnd.uniform(-50, 80), rnd.uniform(-50, 80)) for _ in range(n)] for n in (3, 5, 9, 30)] + [[(0, 0), (60, 0), (60, 60), (0, 60)]]
    rows = [(i, [(float(x), float(y)) for x, y in [*r, r[0]]]) for i, r in enumerate(rings)] + [(4, [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0)])]
    ft = spark.createDataFrame(rows, "fid long, ring array<struct<x:double,y:double>>")
    pts = [(i, rnd.uniform(-60, 90), rnd.uniform(-60, 90)) for i in range(1500)] + [(2000 + 9 * i + j, 5.0 * i, 5.0 * j) for i in range(9) for j in range(9)]
    for fid in (None, 3, 4):

        def odd(x, y, rs):
            return sum((ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for r in rs for (ax, ay), (bx, by) in zip(r, r[1:])) % 2
        groups = {}
        for k, r in rows:
            groups.setdefault(k, []).append(r)
        want = {i for i, x, y in pts[:1500] if any(odd(x, y, g) for k, g in groups.items() if fid is None or k == fid)}
        got = {r.id for r in cover.inside(spark.createDataFrame(pts, "id int, x double, y double"), ft if fid is None else ft.where(F.col("fid") == fid), ["id"], cell=cell).collect()}
        assert {i for i in got if i < 1500} == want


def test_cover_grows_with_the_perimeter(spark):
    """Ten times the size: about ten times the cells, not a hundred."""
    def cells(n):
        ft = spark.range(1).select(F.col("id").alias("fid"), G.literal_ring(((0, 0), (n, n / 9), (n, n), (0, n))).alias("ring"))
        inner, lists = cover.cover(vector.ring_edges(ft, ["fid"]), 1.0, 4)
        return inner.count(), lists.count()
    (a, b), (c, e) = cells(100), cells(1000)
    assert c < 25 * a and e < 12 * b


def test_zonal_medians_of_any_size(spark):
    rnd = random.Random(4)
    px = spark.createDataFrame([(r, c, rnd.choice([None, rnd.random(), 0.5])) for r in range(30) for c in range(30)], "row int, col int, v double")
    ft = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 30.0), (2, 3.0, 3.0, 5.0, 6.0), (3, 40.0, 40.0, 50.0, 50.0)],
                               "fid long, a double, b double, c double, d double").select("fid", G.box_ring("a", "b", "c", "d").alias("ring"))
    got = sorted(map(tuple, vector.zonal(px, ft, ["v"]).collect()))
    cells = {(r, c): v for r, c, v in map(tuple, px.collect())}
    inner = sorted(v for (r, c), v in cells.items() if 3 <= r < 6 and 3 <= c < 5 and v is not None)
    assert got[2] == (3, None) and got[1][1] == pytest.approx((inner[(len(inner) - 1) // 2] + inner[len(inner) // 2]) / 2)
    sparse = sorted(map(tuple, vector.zonal(px.where("(row + col) % 3 <> 0"), ft, ["v"]).collect()))
    brute = sorted(v for r, c, v in map(tuple, px.where("(row + col) % 3 <> 0").collect()) if v is not None)
    n = len(brute)
    assert sparse[0][1] == pytest.approx((brute[(n - 1) // 2] + brute[n // 2]) / 2)


@pytest.mark.parametrize("gathered, task_rows", [(10**6, 10**6), (30, 10**6), (30, 7), (0, 20), (10**6, 7)])
def test_zonal_medians_whatever_the_limits(spark, gathered, task_rows):
    """Features gathered or not, spans dealt to many tasks, blocks copied: the medians stay."""
    rnd = random.Random(5)
    cells = {(r, c): (rnd.choice([None, rnd.random()]), float(r * c % 7)) for r in range(20) for c in range(20)}
    px = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "row int, col int, v double, w double")
    boxes = [(i, float(i % 5), float(i % 7), float(i % 5 + 1 + i % 15), float(i % 7 + 1 + i % 13)) for i in range(40)] + [(99, 50.0, 50.0, 60.0, 60.0)]
    ft = spark.createDataFrame(boxes, "fid long, a double, b double, c double, d double")
    out = vector.zonal(px, ft.select("fid", G.box_ring("a", "b", "c", "d").alias("ring")), ["v", "w"], block=8, gathered=gathered, task_rows=task_rows)
    want = {}
    for i, x0, y0, x1, y1 in boxes:
        inside = [v for (r, c), v in cells.items() if x0 <= c + 0.5 < x1 and y0 <= r + 0.5 < y1]
        of = [[x[j] for x in inside if x[j] is not None] for j in range(2)]
        want[i] = tuple(statistics.median(x) if x else None for x in of)
    assert {r.fid: (r.v_med, r.w_med) for r in out.collect()} == want


def test_zonal_deals_spans_by_their_number(spark):
    """A task's share of crossings does not grow with the features."""
    ft = spark.range(400).select(F.col("id").alias("fid"), G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("ring"))
    spans = vector.row_spans(ft, ["fid"], tasks=40)
    counts = [r["count"] for r in spans.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 30 and max(counts) < 200


def test_medians_of_large_groups(spark):
    """Brackets: outliers, many equal values, all values close together, even and odd sizes."""
    rnd = random.Random(6)
    groups = {
        "a": [rnd.gauss(0, 1) for _ in range(20001)] + [1e300, -1e300], "b": [rnd.choice([1.0, 2.0, 3.0]) for _ in range(15000)],
        "c": [1.0 + rnd.random() * 1e-12 for _ in range(9000)], "d": [5.0] * 8000 + [7.0] * 8000, "e": [3.0, None, 4.0], "f": [None], "g": [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(7)
    want = {k: statistics.median([x for x in vs if x is not None]) for k, vs in groups.items() if k != "f"}
    for gathered in (0, 500, 10**6):
        got = {r.k: r.v for r in vector.large_median(df, "k", "v", gathered, accuracy=1000).collect()}
        assert got == want


def test_features_near_reports_each_pair_once(spark):
    rnd = random.Random(2)
    f = [(i, *(lambda x, y: (x, y, x + rnd.uniform(0, 30), y + rnd.uniform(0, 30)))(rnd.uniform(-40, 90), rnd.uniform(-40, 90))) for i in range(120)]
    r = [(i, 16.0 * (i % 5), 16.0 * (i // 5), 16.0 * (i % 5) + 16, 16.0 * (i // 5) + 16) for i in range(25)]
    ft = spark.createDataFrame(f, "fid int, xmin double, ymin double, xmax double, ymax double")
    rc = spark.createDataFrame(r, "patch int, xmin double, ymin double, xmax double, ymax double")
    got = sorted((x.fid, x.patch) for x in vector.features_near(ft, rc, 3.0, cell=7.0).collect())
    want = sorted((a[0], b[0]) for a in f for b in r
                  if a[1] <= b[3] + 5 and a[3] >= b[1] - 5 and a[2] <= b[4] + 5 and a[4] >= b[2] - 5)
    assert got == want


def test_hygiene(spark):
    ok = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([(1, ok), (2, ok[:3]), (3, None), (4, [ok[0]] * 4), (5, [])], "i int, ring array<struct<x:double,y:double>>")
    assert [r.i for r in vector.hygiene(df).collect()] == [1]


# ---------------------------------------------------------------- morphology

def mask_df(spark, cells, patch=True):
    rows = [(1, r, c) for r, c in cells]
    df = spark.createDataFrame(rows, "patch int, row int, col int")
    return df if patch else df.drop("patch")


def test_morphology_order_and_edges(spark):
    rnd = random.Random(8)
    m = {(r, c) for r in range(20) for c in range(20) if rnd.random() < 0.6}
    get = lambda op, **k: {(r.row, r.col) for r in morphology.morph(mask_df(spark, m), op, 20, 20, ["patch"], **k).collect()}
    opened, closed, grown = get("open"), get("close"), get("dilate")
    assert opened <= m <= grown
    assert {p for p in m if 0 < p[0] < 19 and 0 < p[1] < 19} <= closed
    assert not any(r in (0, 19) or c in (0, 19) for r, c in closed)
    assert any(r in (0, 19) or c in (0, 19) for r, c in get("close", border=1))


def flood(cells, conn, value=lambda p: 0):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    left, out = set(cells), []
    while left:
        start = left.pop()
        comp, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for i, j in steps:
                q = (r + i, c + j)
                if q in left and value(q) == value(start):
                    left.discard(q)
                    comp.add(q)
                    todo.append(q)
        out.append(frozenset(comp))
    return set(out)


@pytest.mark.parametrize("conn", [4, 8])
def test_components_match_flood_fill(spark, conn):
    rnd = random.Random(conn)
    cells = {(r, c) for r in range(40) for c in range(40) if rnd.random() < 0.62}
    got = {}
    for r in morphology.components(mask_df(spark, cells, False), conn, block=7).collect():
        got.setdefault(r.comp, set()).add((r.row, r.col))
    assert {frozenset(s) for s in got.values()} == flood(cells, conn)
    assert all(k == min(r * (1 << 31) + c for r, c in s) for k, s in got.items())


@pytest.mark.parametrize("part", [3, 40, 10**6])
def test_contract(spark, part):
    rnd = random.Random(part)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.root for r in morphology.contract(spark.createDataFrame(edges, "a long, b long"), part).collect()}
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: r for n, r in least.items() if n != r}


def test_snake_component_needs_many_rounds(spark):
    cells = {(r, c) for r in range(0, 30, 2) for c in range(30)}
    cells |= {(r, 29 if (r // 2) % 2 == 0 else 0) for r in range(1, 29, 2)}
    out = morphology.components(mask_df(spark, cells, False), 4, block=4)
    assert out.select("comp").distinct().count() == 1 and out.count() == len(cells)


def test_rings_area_holes_and_pinch(spark):
    ring = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    pinch = {(7, 7), (8, 8)}
    out = morphology.polygonize(mask_df(spark, ring | pinch), ["patch"], 4, 1).withColumn("a", G.signed_area("ring")).collect()
    big = [r for r in out if r.n_px == 24]
    assert sorted((r.is_hole, r.a) for r in big) == [(False, 25.0), (True, -1.0)]
    assert len(big[0].ring) == 5
    assert [(r.n_px, r.a) for r in out if r.n_px == 1] == [(1, 1.0), (1, 1.0)]
    assert morphology.polygonize(mask_df(spark, ring | pinch), ["patch"], 4, 25).isEmpty()


# ---------------------------------------------------------------- metrics

def test_iou_empty_union_and_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (255, 3), (2, 2)], "truth int, pred int")
    per = {r.cls: r.iou for r in metrics.iou(metrics.confusion(df)).collect()}
    assert per == {0: 0.5, 1: 0.5, 2: 1.0, 3: None, 4: None, 5: None, 6: None}
    none = spark.createDataFrame([(255, 1)], "truth int, pred int")
    assert metrics.mean_iou(metrics.iou(metrics.confusion(none))).first()[0] is None


def test_best_epoch_ties_and_nan(spark):
    log = spark.createDataFrame([("a", 1, NAN), ("a", 2, 0.5), ("a", 3, 0.5), ("b", 1, NAN)], "run string, epoch int, miou double")
    got = sorted(map(tuple, metrics.best_epoch(log, ["run"]).collect()))
    assert got == [("a", 2, 0.5), ("b", -1, -1.0)]
    assert one(metrics.new_bests(log, ["run"]), "run", "epoch") == [("a", 2)]


def test_class_weight_cap(spark):
    w = {r.cls: r.weight for r in metrics.class_weights(spark.createDataFrame([(i, 1_000_000) for i in range(20)] + [(20, 0)], "cls int, n long")).collect()}
    assert w[20] == 10.0 and all(w[i] < 1 for i in range(20))


def test_projected_sinusoids(spark):
    df = spark.createDataFrame([("a", 0.25, 0.5)], "scene string, x double, y double")
    box = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "scene string, xmin double, ymin double, xmax double, ymax double")
    ch = C.with_position(df, "sincos", "x", "y", box, ["scene"]).first()
    assert ch["sin_x1"] == pytest.approx(1.0) and ch["cos_y0"] == pytest.approx(math.cos(math.pi / 2))


def test_clip_with_overlapping_parts_and_blocks(spark):
    px = spark.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit(5).alias("lc"))
    rings = [(1, 2.0, 2.0, 12.0, 12.0), (2, 8.0, 8.0, 18.0, 18.0), (3, 2.0, 2.0, 12.0, 12.0)]
    ft = spark.createDataFrame(rings, "fid long, a double, b double, c double, d double").select("fid", G.box_ring("a", "b", "c", "d").alias("ring"))
    out = vector.clip_to(px, ft, "lc", block=7).collect()
    want = {(r, c): 5 if (2 <= r < 12 and 2 <= c < 12) or (8 <= r < 18 and 8 <= c < 18) else 0 for r in range(2, 18) for c in range(2, 18)}
    assert {(r.row, r.col): r.lc for r in out} == want and len(out) == len(want)


def test_contract_of_a_hub(spark):
    edges = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(
        spark.createDataFrame([(5000, 5001), (5001, 5002)], "a long, b long"))
    roots = {r.node: r.root for r in morphology.contract(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 3000)) and roots[5001] == roots[5002] == 5000


# draws: properties that do not repeat the formula

def test_draws_of_seeds_and_epochs_are_unrelated(spark):
    chips = spark.range(2000).select(F.col("id").alias("chip"))
    order = lambda **k: [r.chip for r in chips.orderBy(order_key("chip", **k)).collect()]
    first, second, other = order(epoch=1), order(epoch=2), order(seed=43, epoch=1)
    for a, b in ((first, second), (first, other)):
        assert sorted(a) == sorted(b) and sum(x == y for x, y in zip(a, b)) < 12
        step = [(y - x) % 2000 for x, y in zip(map(a.index, range(0, 2000, 20)), map(b.index, range(0, 2000, 20)))]
        assert len(set(step)) > 80  # not a rotation of one order
    val = lambda seed: {r.chip for r in chips.where(is_validation("chip", 0.2, seed)).collect()}
    a, b = val(42), val(43)
    assert 300 < len(a) < 500 and 300 < len(b) < 500 and len(a & b) < 140


def test_draws_of_one_chip_are_unrelated_and_keys_unbounded(spark):
    u = spark.range(4000).select(*[unit_draw("id", 42, 3, k).alias(f"u{k}") for k in range(4)]).toPandas()
    assert (u.corr().abs().to_numpy() - [[float(i == j) for j in range(4)] for i in range(4)]).max() < 0.06
    assert abs(u.to_numpy().mean() - 0.5) < 0.01 and u.min().min() >= 0 and u.max().max() < 1
    big = spark.createDataFrame([(4_000_000_000,), (9_000_000_000_000_000_000,)], "id long")
    assert all(0 <= r[0] < 2**32 for r in big.select(order_key("id")).collect())


def test_augmentation_reaches_everything(spark):
    grid = [float(i) for i in range(64)]
    chips = spark.range(400).select(F.col("id").alias("chip"), F.array(*[F.lit(x) for x in grid]).alias("b"))
    turned = lambda e: {r.chip: tuple(r.b) for r in augment.augment_d4(chips, "chip", 8, ["b"], e).collect()}
    a, b = turned(0), turned(1)
    assert len(set(a.values())) == 8 and sum(a[k] != b[k] for k in a) > 300
    corners = set()
    for e in range(3):
        for r in augment.augment_crop(chips, "chip", 8, ["b"], e, p=1.0).collect():
            corners.add((int(r.b[0]) // 8, int(r.b[0]) % 8))
    assert len(corners) >= 20 and any(r != c for r, c in corners)


def test_cross_entropy_of_an_impossible_truth(spark):
    w = spark.createDataFrame([(0, 1.0), (1, 1.0)], "cls int, weight double")
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "truth int, probs array<double>")
    assert metrics.weighted_ce(rows, w, k=2).first()[0] == float("inf")


@pytest.mark.parametrize("edge", ["pad", "drop"])
def test_chips_refuse_a_hole_on_any_edge(spark, edge):
    cells = [("a", r, c, r * 8 + c) for r in range(8) for c in range(8) if (r, c) != (7, 7)]
    px = spark.createDataFrame(cells, "scene string, row int, col int, v int")
    size = spark.createDataFrame([("a", 8, 8)], "scene string, width int, height int")
    with pytest.raises(Exception, match="missing pixels"):
        raster.to_chips(px, 4, ["v"], edge, scenes=size).collect()
    column = px.where("row <> 3 or col > 3")  # a whole lower edge of one inner chip
    with pytest.raises(Exception, match="missing pixels"):
        raster.to_chips(column, 4, ["v"], edge, scenes=size).collect()
    full = px.union(spark.createDataFrame([("a", 7, 7, 63)], px.schema))
    assert raster.to_chips(full, 4, ["v"], edge).count() == 4
    assert raster.to_chips(full, 5, ["v"], edge).count() == (4 if edge == "pad" else 1)
