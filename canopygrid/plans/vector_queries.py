"""Vector layers, spatial joins, morphology, patches and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopygrid.functions import coords as C
from canopygrid.functions import geometry as G
from canopygrid.functions import names as N
from canopygrid.model import (
    DETECTION_SCORE_MIN, MIN_PX_TREE, MIN_PX_VEG, NDVI_VEG_MIN, ROAD_RADIUS_M, TREE_MIN_M,
)
from canopygrid.functions.keys import order_key_sql
from canopygrid.operators import cover, layers, morphology, repair, rings, sampling, vector
from canopygrid.operators.ranking import row_number_in
from canopygrid.plans import fixtures as X
from canopygrid.plans.fixtures import with_
from canopygrid.plans.pixel_queries import COVER_MASK, label_mask, ndvi_pixels
from canopygrid.plans.registry import query
from canopygrid.session import cut_lineage
from canopygrid.sources import config


# ------------------------------------------------------------------ geometry

RING_PIP = """CASE WHEN tri THEN {y}>=ymin AND {y}<ymax AND {x}>=xmin AND {x}<xmax+({y}-ymin)*(xmin-xmax)/(ymax-ymin)
 ELSE {y}>=ymin AND {y}<ymax AND {x}>=xmin AND {x}<xmax END"""


@query("pip", with_(f"SELECT fid, px, py, {RING_PIP.format(x='px', y='py')} AS hit FROM (SELECT *, xmin+(fid%7)*0.5 AS px, ymin+(fid%5)*0.5+0.25 AS py FROM ft)", "ft"))
def pip(spark, d):
    ft = X.features(spark, d).withColumns({"px": F.col("xmin") + (F.col("fid") % 7) * F.lit(0.5),
                                           "py": F.col("ymin") + (F.col("fid") % 5) * F.lit(0.5) + 0.25})
    return ft.select("fid", "px", "py", G.contains("ring", "px", "py").alias("hit"))


@query("poly_area", with_("SELECT fid, CASE WHEN tri THEN w*h/2 ELSE w*h END AS area FROM ft", "ft"))
def poly_area(spark, d):
    return X.features(spark, d).select("fid", G.area("ring").alias("area"))


@query("poly_bounds", with_("SELECT fid, xmin, ymin, xmax, ymax FROM ft", "ft"))
def poly_bounds(spark, d):
    return X.features(spark, d).select("fid", *[c.alias(n) for n, c in G.bounds("ring").items()])


@query("layer_bounds", with_("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM ft", "ft"))
def layer_bounds(spark, d):
    return vector.layer_bounds(X.features(spark, d))


@query("clip_bbox", with_("""SELECT fid, greatest(xmin,x0) AS xmin, greatest(ymin,y0) AS ymin, least(xmax,x0+40) AS xmax, least(ymax,y0+40) AS ymax FROM
 (SELECT *, floor(xmin/40)*40 AS x0, floor(ymin/40)*40 AS y0 FROM ft)""", "ft"))
def clip_bbox(spark, d):
    x0, y0 = F.floor(F.col("xmin") / 40) * 40.0, F.floor(F.col("ymin") / 40) * 40.0
    box = G.clip_box("xmin", "ymin", "xmax", "ymax", (x0, y0, x0 + 40.0, y0 + 40.0))
    return X.features(spark, d).select("fid", *[c.alias(n) for n, c in box.items()])


@query("polygon_hygiene", with_("""SELECT fid, 1::BIGINT AS n_parts, CASE WHEN tri THEN w*h/2 ELSE w*h END AS area FROM ft WHERE fid%6<>0""", "ft"))
def polygon_hygiene(spark, d):
    ring = F.col("ring")
    flat = F.array(G.point("xmin", "ymin"), G.point("xmax", "ymin"), G.point("xmax", "ymin"), G.point("xmin", "ymin"))
    opened = F.slice(ring, F.lit(1), F.size(ring) - 1)
    parts = F.when(F.col("fid") % 6 == 0, F.lit(None)).otherwise(F.array(ring, flat, opened))
    ft = X.features(spark, d).select("fid", parts.alias("parts"))
    return vector.polygon_layer(ft).groupBy("fid").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum(G.area("ring")).alias("area"))


LONLAT = (lambda: ((F.col("xmin") / 100.0 - 112.5), (F.col("ymin") / 100.0 + 33.0)))


@query("to_mercator", with_("""SELECT fid, round(radians(xmin/100.0::DOUBLE-112.5)*6378137.0,3) AS x,
 round(ln(tan(pi()/4+radians(ymin/100.0::DOUBLE+33.0)/2))*6378137.0,3) AS y FROM ft""", "ft"))
def to_mercator(spark, d):
    x, y = C.reproject(*LONLAT(), 4326, 3857)
    return X.features(spark, d).select("fid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _utm_sql():
    """Same series written with the classical power expansion in eccentricity instead."""
    return with_(""", g AS (SELECT fid, radians(xmin/100.0::DOUBLE-112.5) AS lam, radians(ymin/100.0::DOUBLE+33.0) AS phi,
   6378137.0::DOUBLE AS a, (2/298.257222101::DOUBLE-1/(298.257222101::DOUBLE*298.257222101::DOUBLE)) AS e2 FROM ft),
 h AS (SELECT *, e2/(1-e2) AS ep2, a/sqrt(1-e2*sin(phi)*sin(phi)) AS nn, tan(phi)*tan(phi) AS t, e2/(1-e2)*cos(phi)*cos(phi) AS c,
   (lam-radians(-111.0::DOUBLE))*cos(phi) AS q,
   a*((1-e2/4-3*e2*e2/64-5*e2*e2*e2/256)*phi-(3*e2/8+3*e2*e2/32+45*e2*e2*e2/1024)*sin(2*phi)+(15*e2*e2/256+45*e2*e2*e2/1024)*sin(4*phi)-(35*e2*e2*e2/3072)*sin(6*phi)) AS m FROM g)
 SELECT fid, round(0.9996*nn*(q+(1-t+c)*q*q*q/6+(5-18*t+t*t+72*c-58*ep2)*q*q*q*q*q/120)+500000,0) AS x,
  round(0.9996*(m+nn*tan(phi)*(q*q/2+(5-t+9*c+4*c*c)*q*q*q*q/24+(61-58*t+t*t+600*c-330*ep2)*q*q*q*q*q*q/720)),0) AS y FROM h""", "ft")


@query("to_utm", _utm_sql())
def to_utm(spark, d):
    x, y = C.reproject(*LONLAT(), 4326, 26912)
    return X.features(spark, d).select("fid", F.round(x, 0).alias("x"), F.round(y, 0).alias("y"))


def _from_utm_sql():
    n = 1 / (2 * 298.257222101 - 1)
    r = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    less = lambda f, g: "".join(f"-({b!r}::DOUBLE)*{f}({2 * j}*xi)*{g}({2 * j}*eta)" for j, b in enumerate(beta, 1))
    more = "".join(f"+({e!r}::DOUBLE)*sin({2 * j}*chi)" for j, e in enumerate(delta, 1))
    return with_(f""", p AS (SELECT fid, 400000+xmin*500 AS x, 3700000+ymin*500 AS y, (3700000+ymin*500)/{r!r}::DOUBLE AS xi, (xmin*500-100000)/{r!r}::DOUBLE AS eta FROM ft),
 q AS (SELECT *, xi{less('sin', 'cosh')} AS u, eta{less('cos', 'sinh')} AS v FROM p),
 h AS (SELECT *, asin(sin(u)/cosh(v)) AS chi FROM q)
 SELECT fid, round(degrees(atan2(sinh(v),cos(u)))-111,9) AS lon, round(degrees(chi{more}),9) AS lat, round(x,3) AS x, round(y,3) AS y FROM h""", "ft")


@query("from_utm", _from_utm_sql())
def from_utm(spark, d):
    """Positions of a zone as degrees, and back again: they return to the millimetre."""
    ft = X.features(spark, d).select("fid", (400000.0 + F.col("xmin") * 500).alias("e"), (3700000.0 + F.col("ymin") * 500).alias("n"))
    lon, lat = C.reproject("e", "n", X.UTM_CODE, 4326)
    there = ft.select("fid", lon.alias("lon"), lat.alias("lat"))
    x, y = C.reproject("lon", "lat", 4326, X.UTM_CODE)
    return there.select("fid", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# ------------------------------------------------------------------ spatial joins

@query("feature_patch_join", with_(""", rc AS (SELECT DISTINCT chip, (chip%25)*8.0::DOUBLE AS x0, (chip//25)*8.0::DOUBLE AS y0 FROM px)
 SELECT fid, chip, greatest(xmin,x0) AS c_xmin, greatest(ymin,y0) AS c_ymin, least(xmax,x0+8) AS c_xmax, least(ymax,y0+8) AS c_ymax
 FROM ft JOIN rc ON xmin<=x0+10 AND xmax>=x0-2 AND ymin<=y0+10 AND ymax>=y0-2""", "px", "ft"))
def feature_patch_join(spark, d):
    return vector.features_near(X.features(spark, d), _chip_rects(spark, d), rect_key="chip").select(
        "fid", "chip", "c_xmin", "c_ymin", "c_xmax", "c_ymax")


def _chip_rects(spark, d):
    x0, y0 = (F.col("chip") % 25) * 8.0, F.floor(F.col("chip") / 25) * 8.0
    return X.chips(spark, d).select("chip", x0.alias("xmin"), y0.alias("ymin"), (x0 + 8).alias("xmax"), (y0 + 8).alias("ymax"))


@query("centers_in_boundary", with_(""", ctr AS (SELECT vec_id AS chip, (vec_id%25)*8+4.0::DOUBLE AS x, (vec_id//25)*8+4.0::DOUBLE AS y FROM embeddings)
 SELECT chip, x, y FROM ctr WHERE (x>10 AND x<190 AND y>10 AND y<70) OR (x>10 AND x<100 AND y>=70 AND y<=110) OR (x>10 AND x<190 AND y>110 AND y<150)
  OR (x>10 AND x<100 AND y>10 AND y<150)""", "px"))
def centers_in_boundary(spark, d):
    ctr = _chip_rects(spark, d).select("chip", (F.col("xmin") + 4).alias("x"), (F.col("ymin") + 4).alias("y"))
    return cover.inside(ctr, X.boundary(spark), ["chip"])


# A feature's corners as two triangles that cross, and as a square that goes out of its own corner.
TORN = with_("""SELECT fid, CAST(CASE fid%3 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS n_rings, CAST(CASE fid%3 WHEN 0 THEN 4 ELSE 6 END AS BIGINT) AS n_vertices,
 round(w*h*CASE fid%3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.75 END,6)::DOUBLE AS area, fid%3<>0 AS repaired FROM ft""", "ft")


@query("repair_rings", TORN)
def repair_rings(spark, d):
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    ring = lambda *p: F.array(*[G.point(*v) for v in (*p, p[0])])
    torn = (F.when(F.col("fid") % 3 == 0, G.box_ring(x0, y0, x1, y1)).when(F.col("fid") % 3 == 1, ring((x0, y0), (x1, y1), (x1, y0), (x0, y1)))
            .otherwise(ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0), (xm, y0), (xm, ym), (x0, ym))))
    done = repair.repair_rings(X.features(spark, d).select("fid", torn.alias("ring")), ["fid"])
    return done.groupBy("fid").agg(F.count(F.lit(1)).alias("n_rings"), F.sum(F.size("ring") - 1).alias("n_vertices"),
                                   F.round(F.sum(G.signed_area("ring")), 6).alias("area"), F.bool_or("repaired").alias("repaired"))


def _under(c: str) -> str:
    """Area under a triangle's slanted side and above y = c, from c0 on to c1."""
    h = lambda x: f"greatest(ymin+h*(1-({x}-xmin)/w)-({c}),0.0)"
    return f"(power({h('x0')},2)-power({h('x1')},2))*w/(2*h)"


@query("clip_rings", with_(f""", rc AS (SELECT DISTINCT chip, (chip%25)*8.0::DOUBLE AS rx, (chip//25)*8.0::DOUBLE AS ry FROM px),
 pr AS (SELECT fid, chip, tri, xmin, ymin, w, h, greatest(xmin,rx) AS x0, greatest(ymin,ry) AS y0, least(xmax,rx+8) AS x1, least(ymax,ry+8) AS y1
  FROM ft JOIN rc ON xmin<rx+8 AND xmax>rx AND ymin<ry+8 AND ymax>ry),
 a AS (SELECT fid, chip, round(CASE WHEN tri THEN {_under('y0')}-{_under('y1')} ELSE (x1-x0)*(y1-y0) END,6) AS area FROM pr)
 SELECT fid, chip, area FROM a WHERE area>0""", "px", "ft"))
def clip_rings(spark, d):
    """Features cut to the chips they meet, as rings."""
    met = vector.features_near(X.features(spark, d), _chip_rects(spark, d), pad=0.0, rect_key="chip")
    cut = repair.clip_rings(met, "ring", ("c_xmin", "c_ymin", "c_xmax", "c_ymax"))
    return cut.select("fid", "chip", F.round(G.area("ring"), 6).alias("area")).where("area > 0")


ROADS = """, hit AS (SELECT px.row, px.col, count(*) AS n_lines FROM px JOIN road ON
  power(col+0.5-(x1+(x2-x1)*greatest(0.0,least(1.0,((col+0.5-x1)*(x2-x1)+(row+0.5-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))),2)
  +power(row+0.5-(y1+(y2-y1)*greatest(0.0,least(1.0,((col+0.5-x1)*(x2-x1)+(row+0.5-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))),2)<=9 GROUP BY px.row, px.col)
 SELECT row, col, n_lines, CAST(6 AS INTEGER) AS code FROM hit"""


@query("road_buffer", with_(ROADS, "px", "road"))
def road_buffer(spark, d):
    near = vector.road_pixels(X.roads(spark, d), ROAD_RADIUS_M, width=X.MOSAIC_COLS)
    grid = X.pixels(spark, d).select("row", "col")
    return grid.join(near, ["row", "col"]).withColumn("code", F.lit(6))


@query("city_clip", with_(f"""SELECT row, col, CAST(CASE WHEN EXISTS (SELECT 1 FROM inb WHERE col+0.5>=x0 AND col+0.5<x1 AND row+0.5>=y0 AND row+0.5<y1)
  THEN (red+nir)%7+1 ELSE 0 END AS INTEGER) AS lc FROM px WHERE col BETWEEN 10 AND 189 AND row BETWEEN 10 AND 149""", "px", "inb"))
def city_clip(spark, d):
    px = X.pixels(spark, d).select("row", "col", ((F.col("red") + F.col("nir")) % 7 + 1).alias("lc"))
    return vector.clip_to(px, X.boundary(spark), "lc", width=X.MOSAIC_COLS)


@query("rasterize_scenes", with_(""", m AS (SELECT fid%2 AS s, row, col, arg_max(code, seq) AS top, bool_or(code=1) AS tree
   FROM cover WHERE code BETWEEN 1 AND 7 GROUP BY ALL)
 SELECT 's'||CAST(px.chip%2 AS VARCHAR) AS scene, px.row, px.col,
  CAST(coalesce(CASE WHEN top=5 AND tree THEN 0 ELSE top-1 END, 255) AS INTEGER) AS mask, coalesce(top=5 AND tree, FALSE) AS flipped
 FROM px LEFT JOIN m ON m.s=px.chip%2 AND m.row=px.row AND m.col=px.col""", "px", "cover"))
def rasterize_scenes(spark, d):
    """Two scenes with the same local rows: one of 2-unit pixels facing down, one of half-unit pixels facing up."""
    affine = {"s0": (2.0, 0.0, 100.0, 0.0, -2.0, 500.0), "s1": (0.5, 0.0, -30.0, 0.0, 0.5, 40.0)}
    of = lambda c: F.concat(F.lit("s"), (F.col(c) % 2).cast("string"))
    t = F.create_map(*[x for k, v in affine.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    scenes = X.pixels(spark, d).select(of("chip").alias("scene")).distinct().withColumn("transform", F.element_at(t, F.col("scene")))
    at = lambda i: F.get(F.element_at(t, F.col("scene")), F.lit(i))
    on_map = F.transform("ring", lambda p: F.struct((p["x"] * at(0) + at(2)).alias("x"), (p["y"] * at(4) + at(5)).alias("y")))
    ft = X.features(spark, d).where(F.col("code").between(1, 7)).withColumn("scene", of("fid")).withColumn("ring", on_map)
    plane = vector.to_pixel_plane(ft.select("scene", "code", "seq", "ring"), scenes, ["scene"])
    grid = X.pixels(spark, d).select(of("chip").alias("scene"), "row", "col")
    return vector.rasterize(plane, grid, keys=("scene",))


ZONAL = """, z AS (SELECT fid, median(chm) AS chm_med, median(ndvi) AS ndvi_med FROM det JOIN ndvi ON
  col+0.5>=xmin AND col+0.5<xmax AND row+0.5>=ymin AND row+0.5<ymax GROUP BY fid)
"""


def _zones(spark, d, least_score=None):
    det = X.detections(spark, d)
    if least_score is not None:  # before any pixel is met
        det = det.where(F.col("score") > least_score)
    rings = det.select("fid", G.box_ring("xmin", "ymin", "xmax", "ymax").alias("ring"))
    return det, vector.zonal(ndvi_pixels(spark, d), rings, ["chm", "ndvi"])


@query("zonal_median", with_(ZONAL + "SELECT det.fid, round(chm_med,6) AS chm_med, round(ndvi_med,6) AS ndvi_med FROM det LEFT JOIN z USING (fid)", "ndvi", "det"))
def zonal_median(spark, d):
    _, z = _zones(spark, d)
    return z.select("fid", F.round("chm_med", 6).alias("chm_med"), F.round("ndvi_med", 6).alias("ndvi_med"))


@query("detection_filter", with_(ZONAL + """SELECT fid, round(score,6) AS score, round(chm_med,6) AS chm_med FROM det JOIN z USING (fid)
 WHERE score>0.2 AND chm_med>=1.5 AND ndvi_med>=0.2""", "ndvi", "det"))
def detection_filter(spark, d):
    det, z = _zones(spark, d, DETECTION_SCORE_MIN)
    kept = layers.detections_kept(det, z, DETECTION_SCORE_MIN, TREE_MIN_M, NDVI_VEG_MIN)
    return kept.select("fid", F.round("score", 6).alias("score"), F.round("chm_med", 6).alias("chm_med"))


# ------------------------------------------------------------------ codes and layers

@query("code_validation", with_("""SELECT CASE WHEN code IS NULL THEN 'null_code' WHEN code NOT BETWEEN 1 AND 7 THEN 'unknown_code' ELSE 'usable' END AS reason,
 CAST(coalesce(code,-1) AS INTEGER) AS code, count(*) AS n FROM ft GROUP BY 1,2""", "ft"))
def code_validation(spark, d):
    ok, bad = layers.validate_codes(X.features(spark, d))
    good = ok.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(F.lit("usable").alias("reason"), "code", "n")
    return good.union(bad.select("reason", "code", "n"))


@query("class_field", """SELECT 'landuse' AS field, CAST(p_size%7+1 AS INTEGER) AS code, count(*) AS n FROM part GROUP BY 2""")
def class_field(spark, d):
    layer = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("OBJECTID"), (F.col("p_size") % 7 + 1).cast("int").alias("landuse"),
        F.col("p_retailprice").alias("price"), "p_brand", F.col("p_size").alias("shape_area"))
    name = layers.resolve_class_column(layer)
    return layer.groupBy(F.lit(name).alias("field"), F.col(name).alias("code")).agg(F.count(F.lit(1)).alias("n"))


CLASS_TEXT = "CASE WHEN fid%13=0 THEN p_brand ELSE CAST(code AS VARCHAR) END"


@query("class_coerce", with_(f"SELECT fid, CAST(coalesce(try_cast({CLASS_TEXT} AS DOUBLE),0) AS INTEGER) AS class FROM ft", "ft"))
def class_coerce(spark, d):
    text = F.when(F.col("fid") % 13 == 0, F.col("p_brand")).otherwise(F.col("code").cast("string"))
    return X.features(spark, d).select("fid", layers.coerce_class(text).alias("class"))


def _merged(spark, d):
    ft = X.features(spark, d)
    label = layers.restamp(layers.tag_layer(ft, F.lit("patches/label.shp"), "code"), 3857)
    seed = layers.tag_layer(ft.where(F.col("code").between(1, 3)), F.concat(F.lit("seeds/seed_"), F.col("code").cast("string"), F.lit(".shp")), "code")
    cols = ("fid", "class", "src", "layer", "patch_id")
    return layers.merge_layers(label, seed, columns=cols)


MERGED = """, merged AS (SELECT fid, CAST(coalesce(code,0) AS INTEGER) AS class, 'auto' AS src, 'label' AS layer, patch_id FROM ft
  UNION ALL SELECT fid, code, 'auto', 'seed_'||CAST(code AS VARCHAR), patch_id FROM ft WHERE code BETWEEN 1 AND 3),
 patch AS (SELECT patch_id, patch_id%7<>0 AS has_imagery, patch_id%5<>0 AS has_chm, patch_id%4<>0 AS has_ndvi,
   'group_'||lpad(CAST((patch_id-1)//50*50+1 AS VARCHAR),4,'0')||'-'||lpad(CAST(least((patch_id-1)//50*50+50,60) AS VARCHAR),4,'0') AS bundle
   FROM (SELECT DISTINCT patch_id FROM ft))
"""


def _patches(spark, d):
    p = F.col("patch_id")
    return X.features(spark, d).select("patch_id").distinct().withColumns({
        "has_imagery": p % 7 != 0, "has_chm": p % 5 != 0, "has_ndvi": p % 4 != 0, "bundle": sampling.chunk_of("patch_id", 60)})


@query("merge_layers", with_(MERGED + "SELECT * FROM merged", "ft"))
def merge_layers(spark, d):
    return _merged(spark, d)


@query("bundle_layers", with_(MERGED + "SELECT bundle, fid, class, src, layer, patch_id FROM merged JOIN patch USING (patch_id) WHERE has_imagery", "ft"))
def bundle_layers(spark, d):
    return layers.bundle_layers(_patches(spark, d), _merged(spark, d)).select("bundle", "fid", "class", "src", "layer", "patch_id")


@query("bundle_totals", with_(MERGED + """SELECT count(DISTINCT bundle) FILTER (WHERE has_imagery) AS bundles, count(*) FILTER (WHERE has_imagery) AS naip,
 count(*) FILTER (WHERE has_imagery AND has_chm) AS chm, count(*) FILTER (WHERE has_imagery AND has_ndvi) AS ndvi,
 (SELECT count(*) FROM merged JOIN patch USING (patch_id) WHERE has_imagery) AS objects FROM patch""", "ft"))
def bundle_totals(spark, d):
    p = _patches(spark, d)
    return layers.bundle_totals(p, layers.bundle_layers(p, _merged(spark, d)))


@query("bundle_chunks", """SELECT patch_id, 'group_'||CASE WHEN length(s)<4 THEN lpad(s,4,'0') ELSE s END||'-'||CASE WHEN length(e)<4 THEN lpad(e,4,'0') ELSE e END AS bundle
 FROM (SELECT patch_id, CAST((patch_id-1)//50*50+1 AS VARCHAR) AS s, CAST(least((patch_id-1)//50*50+50, (SELECT count(*) FROM customer)) AS VARCHAR) AS e
  FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS patch_id FROM customer))""")
def bundle_chunks(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey")
    ids = row_number_in(c, [], F.floor(F.col("c_custkey") / 4096), ["c_custkey"], "patch_id")
    total = c.agg(F.count(F.lit(1)).alias("_total"))  # one row, counted when the query runs
    return ids.crossJoin(total).select("patch_id", sampling.chunk_of("patch_id", F.col("_total")).alias("bundle"))


@query("group_match", """WITH l AS (SELECT CASE WHEN page_id%9=0 THEN 'extra_' ELSE 'label_' END||lpad(CAST(page_id AS VARCHAR),6,'0') AS folder, page_id FROM pages),
 g AS (SELECT lpad(CAST(page_id AS VARCHAR),6,'0') AS rid FROM pages WHERE page_id%4<>0)
 SELECT folder, CASE WHEN page_id%9=0 THEN folder ELSE substr(folder,7) END AS range_id,
  CASE WHEN page_id%9<>0 AND rid IS NOT NULL THEN 'group_'||rid END AS group_name
 FROM l LEFT JOIN g ON g.rid=substr(folder,7)""")
def group_match(spark, d):
    p = X.table(spark, d, "pages")
    rid = F.lpad(F.col("page_id").cast("string"), 6, "0")
    labels = p.select(F.concat(F.when(F.col("page_id") % 9 == 0, "extra_").otherwise("label_"), rid).alias("folder"))
    groups = p.where(F.col("page_id") % 4 != 0).select(F.concat(F.lit("group_"), rid).alias("group"))
    return layers.match_groups(labels, groups).select("folder", "range_id", "group_name")


@query("partner_join", """SELECT url AS scene, CASE WHEN page_id%6=0 THEN 'ndvi chm' WHEN page_id%2=0 THEN 'ndvi' WHEN page_id%3=0 THEN 'chm' ELSE '' END AS missing FROM pages""")
def partner_join(spark, d):
    p = X.table(spark, d, "pages").select("page_id", F.col("url").alias("scene"))
    ok, gaps = layers.partner_scenes(p, ndvi=p.where(F.col("page_id") % 2 != 0), chm=p.where(F.col("page_id") % 3 != 0))
    return ok.select("scene", F.lit("").alias("missing")).union(gaps)


@query("skip_reasons", with_(COVER_MASK + """, t AS (SELECT chip, avg(CASE WHEN mask<>255 THEN 1.0 ELSE 0.0 END) AS f, count(*) FILTER (WHERE mask<>255) AS np FROM m GROUP BY chip)
 SELECT CASE WHEN chip%13=0 THEN 'missing_band' WHEN np=0 THEN 'no_polys' WHEN f<0.01 THEN 'low_label' ELSE 'used' END AS reason, count(*) AS n FROM t GROUP BY 1""", "px", "cover"))
def skip_reasons(spark, d):
    t = label_mask(spark, d).groupBy("chip").agg(
        F.avg((F.col("mask") != 255).cast("int")).alias("labeled_frac"), F.count(F.when(F.col("mask") != 255, 1)).alias("n_polys"))
    return sampling.skip_reasons(t.withColumn("has_bands", F.col("chip") % 13 != 0))


@query("config_document", with_(COVER_MASK + f""", tile AS (SELECT chip, avg(CASE WHEN mask<>255 THEN 1.0 ELSE 0.0 END) AS f, CASE WHEN {order_key_sql('chip')}%1000000<200000 THEN 'val' ELSE 'train' END AS split FROM m GROUP BY chip),
 z AS (SELECT 8 AS size, chip, 0 AS q, mask FROM m UNION ALL SELECT 4, chip, (row%8)//4*2+(col%8)//4, mask FROM m),
 crop AS (SELECT size, chip, q, avg(CASE WHEN mask<>255 THEN 1.0 ELSE 0.0 END)>=0.01 AS kept, count(*) FILTER (WHERE mask=0) AS tree, count(*) FILTER (WHERE mask<>255) AS labeled
  FROM z JOIN tile USING (chip) WHERE f>=0.01 GROUP BY 1,2,3)
 SELECT CAST(size AS INTEGER) AS patch_size, count(*) FILTER (WHERE kept AND split='train') AS train_tiles, count(*) FILTER (WHERE kept AND split='val') AS val_tiles,
  (SELECT count(*) FROM tile WHERE f<0.01) AS low_label, count(*) FILTER (WHERE NOT kept) AS crop_low_label, CAST(sum(tree) FILTER (WHERE kept) AS BIGINT) AS tree_px,
  round(sum(tree) FILTER (WHERE kept)/CAST(sum(labeled) FILTER (WHERE kept) AS DOUBLE),9) AS tree_frac, (SELECT count(*) FROM m WHERE flipped) AS flipped_px,
  190.0::DOUBLE AS xmax, 6::BIGINT AS base_in_channels FROM crop JOIN tile USING (chip) GROUP BY size""", "px", "cover"))
def config_document(spark, d):
    """The documents of the chip sets of two sizes, and what stands in them when they are read again."""
    m = cut_lineage(label_mask(spark, d))
    crops = sampling.labeled_crops(m, "chip", [8, 4], X.CHIP)
    crops = crops.join(sampling.assign_split(m.select("chip").distinct(), "chip"), "chip")
    low = m.groupBy("chip").agg(F.avg((F.col("mask") != 255).cast("int")).alias("f")).where(F.col("f") < 0.01).count()
    box = vector.layer_bounds(X.boundary(spark)).first()
    docs = config.chip_set_documents(crops, {"low_label": low}, tuple(box), 3857, len(X.BANDS), 255.0, X.CHIP, "2024-01-01_000000",
                                     tree_over_building_px=m.where("flipped").count())
    read = F.try_parse_json(F.col("doc"))
    get = lambda path, kind, name: F.try_variant_get(read, f"$.{path}", kind).alias(name)
    return docs.select(
        "patch_size", get("train_tiles", "bigint", "train_tiles"), get("val_tiles", "bigint", "val_tiles"), get("skipped.low_label", "bigint", "low_label"),
        get("skipped.crop_low_label", "bigint", "crop_low_label"), get("class_pixel_counts.Tree", "bigint", "tree_px"),
        F.round(F.try_variant_get(read, "$.class_pixel_frac.Tree", "double"), 9).alias("tree_frac"), get("tree_over_building_px", "bigint", "flipped_px"),
        get("coord_bounds.xmax", "double", "xmax"), get("base_in_channels", "bigint", "base_in_channels"))


# ------------------------------------------------------------------ sampling and patches

ACCEPTED = f""", acc AS (SELECT chip, row_number() OVER (ORDER BY {order_key_sql('chip')}) AS patch_id FROM
  (SELECT chip FROM px GROUP BY chip HAVING avg(CASE WHEN red=0 AND green=0 AND blue=0 AND nir=0 THEN 1.0 ELSE 0.0 END)<=0.2))
"""


def accepted(spark, d):
    ok = sampling.black_share_ok(X.pixels(spark, d), ["chip"], X.BANDS)
    return sampling.sequential_ids(ok, "chip", tie=["chip"])


@query("patch_ids", with_(ACCEPTED + "SELECT chip, patch_id FROM acc", "px"))
def patch_ids(spark, d):
    return accepted(spark, d).select("chip", "patch_id")


@query("patch_manifest", with_(ACCEPTED + """, obj AS (SELECT (row//8)*25+col//8 AS chip, count(DISTINCT fid) AS n FROM cover WHERE col<200 GROUP BY 1)
 SELECT 'patch_'||CASE WHEN length(CAST(patch_id AS VARCHAR))<4 THEN lpad(CAST(patch_id AS VARCHAR),4,'0') ELSE CAST(patch_id AS VARCHAR) END AS patch_id,
  'm_'||CAST(chip//100 AS VARCHAR)||'.tif' AS tile, CAST((chip//25)*8 AS INTEGER) AS row, CAST((chip%25)*8 AS INTEGER) AS col, coalesce(n,0) AS label_features
 FROM acc LEFT JOIN obj USING (chip)""", "px", "cover"))
def patch_manifest(spark, d):
    spans = vector.row_spans(X.features(spark, d), ["fid"], width=X.MOSAIC_COLS)
    across = F.explode(F.sequence(F.floor(F.col("c0") / 8), F.floor(F.col("c1") / 8)))
    seen = spans.select("fid", F.floor(F.col("row") / 8).alias("br"), across.alias("bc")).distinct()
    n = seen.groupBy((F.col("br") * 25 + F.col("bc")).alias("chip")).agg(F.count(F.lit(1)).alias("n"))
    return accepted(spark, d).join(n, "chip", "left").select(
        N.patch_name("patch_id").alias("patch_id"),
        F.concat(F.lit("m_"), F.floor(F.col("chip") / 100).cast("string"), F.lit(".tif")).alias("tile"),
        (F.floor(F.col("chip") / 25) * 8).cast("int").alias("row"), ((F.col("chip") % 25) * 8).cast("int").alias("col"),
        F.coalesce("n", F.lit(0)).alias("label_features"))


@query("chip_index", """SELECT vec_id AS chip, row_number() OVER (ORDER BY vec_id)-1 AS idx FROM embeddings""")
def chip_index(spark, d):
    ch = X.chips(spark, d).select("chip")
    ranked = row_number_in(ch, [], F.floor(F.col("chip") / 4096), ["chip"], "n")
    return ranked.select("chip", (F.col("n") - 1).alias("idx"))


@query("seeded_shuffle", f"SELECT p_partkey AS fid, {order_key_sql('p_partkey')} AS order_key, row_number() OVER (ORDER BY {order_key_sql('p_partkey')}) AS pos FROM part")
def seeded_shuffle(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("fid"))
    return sampling.sequential_ids(p, "fid", "pos", tie=["fid"])


@query("sample_n", f"SELECT o_orderkey AS fid, {order_key_sql('o_orderkey')} AS order_key FROM orders ORDER BY 2, 1 LIMIT 3000")
def sample_n(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("fid"))
    return sampling.sample_first(o, "fid", 3000, tie=["fid"])


@query("limit_scenes", "SELECT url AS scene FROM pages ORDER BY url LIMIT 5")
def limit_scenes(spark, d):
    return X.table(spark, d, "pages").select(F.col("url").alias("scene")).orderBy("scene").limit(5)


@query("grid_epoch_order", f"""SELECT vec_id AS chip, e AS epoch, {order_key_sql('vec_id', epoch='e')} AS order_key FROM embeddings, (VALUES (1),(2)) t(e)""")
def grid_epoch_order(spark, d):
    g = X.chips(spark, d).select("chip")
    first, second = (sampling.epoch_order(g, "chip", e).select("chip", F.lit(e).alias("epoch"), "order_key") for e in (1, 2))
    return first.union(second)


@query("patch_candidates", with_(""", sz AS (SELECT scene, CAST(max(col)-min(col)+1 AS INTEGER) AS w, CAST(max(row)-min(row)+1 AS INTEGER) AS h FROM px GROUP BY scene)
 SELECT scene, CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0, r0+12.0::DOUBLE AS center_row, c0+12.0::DOUBLE AS center_col
 FROM (SELECT *, unnest(range(0, w-24+1, 24)) AS c0 FROM (SELECT *, unnest(range(0, h-24+1, 24)) AS r0 FROM sz))""", "px"))
def patch_candidates(spark, d):
    sz = X.pixels(spark, d).groupBy("scene").agg((F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"))
    return sampling.candidates(sz, 24, 24).select("scene", "r0", "c0", "center_row", "center_col")


# ------------------------------------------------------------------ morphology and polygons

P = 40  # patch edge of the morphology fixtures: 5 x n patches on the mosaic


def _veg(spark, d, least):
    px = ndvi_pixels(spark, d).where(F.col("ndvi") >= least)
    patch = (F.floor(F.col("row") / P) * 5 + F.floor(F.col("col") / P)).cast("int").alias("patch")
    return px.select(patch, (F.col("row") % P).alias("row"), (F.col("col") % P).alias("col"))


def _mask_cte(least):
    return f", m0 AS (SELECT (row//{P})*5+col//{P} AS patch, row%{P} AS row, col%{P} AS col FROM ndvi WHERE ndvi>={least})"


CROSS5 = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(i,j)"


def _dilate(src, dst):
    return f""", {dst} AS (SELECT DISTINCT patch, row+i AS row, col+j AS col FROM {src}, {CROSS5} WHERE row+i BETWEEN 0 AND {P-1} AND col+j BETWEEN 0 AND {P-1})"""


def _erode(src, dst):
    return f""", {dst} AS (SELECT patch, row, col FROM (SELECT patch, row+i AS row, col+j AS col FROM {src}, {CROSS5}) GROUP BY ALL HAVING count(*)=5)"""


def _label(src, dst, conn, key="patch", extra="", same=""):
    near = "abs(a.row-b.row)+abs(a.col-b.col)=1" if conn == 4 else "NOT (a.row=b.row AND a.col=b.col)"
    return f""", {dst}_n AS MATERIALIZED (SELECT {key} AS grp, row, col, CAST({key} AS BIGINT)*1000000000+row*100000+col AS id {extra} FROM {src}),
 {dst}_e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM {dst}_n a, (VALUES (-1),(0),(1)) p(i), (VALUES (-1),(0),(1)) q(j), {dst}_n b
   WHERE b.grp=a.grp AND b.row=a.row+i AND b.col=a.col+j AND {near} {same}),
 {dst}_l(id, l) USING KEY (id) AS (SELECT id, id FROM {dst}_n UNION
   SELECT e.y, min(w.l) FROM {dst}_l w JOIN {dst}_e e ON e.x=w.id JOIN recurring.{dst}_l k ON k.id=e.y WHERE w.l<k.l GROUP BY e.y),
 {dst} AS (SELECT n.*, l.l FROM {dst}_n n JOIN {dst}_l l USING (id))"""


@query("closing", with_(_mask_cte(0.2) + _dilate("m0", "m1") + _erode("m1", "m2") + " SELECT patch,row,col FROM m2", "ndvi"))
def closing(spark, d):
    return morphology.morph(_veg(spark, d, 0.2), "close", P, P, ["patch"])


@query("opening", with_(_mask_cte(0.0) + _erode("m0", "m1") + _dilate("m1", "m2") + " SELECT patch,row,col FROM m2", "ndvi"))
def opening(spark, d):
    return morphology.morph(_veg(spark, d, 0.0), "open", P, P, ["patch"])


CLOSED = _mask_cte(0.2) + _dilate("m0", "m1") + _erode("m1", "m2") + _label("m2", "lab", 4) + """,
 num AS (SELECT grp AS patch, dense_rank() OVER (PARTITION BY grp ORDER BY l) AS comp, row, col FROM lab)"""


@query("polygonize_area", with_(CLOSED + """ SELECT patch, CAST(comp AS INTEGER) AS comp, count(*) AS n_px, count(*)::DOUBLE AS area,
  min(col)::DOUBLE AS xmin, min(row)::DOUBLE AS ymin, max(col)+1.0::DOUBLE AS xmax, max(row)+1.0::DOUBLE AS ymax FROM num GROUP BY 1,2 HAVING count(*)>=6""", "ndvi", recursive=True))
def polygonize_area(spark, d):
    closed = morphology.morph(_veg(spark, d, 0.2), "close", P, P, ["patch"])
    rings = morphology.polygonize(closed, ["patch"], 4, MIN_PX_VEG)
    b = G.bounds("ring")
    return rings.groupBy("patch", "comp", "n_px").agg(
        F.sum(G.signed_area("ring")).alias("area"), F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"),
        F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


def _outline(src: str) -> str:
    """Corners and sides of every region, cell by cell: a side ends in a right turn where the cell ahead is
    another region's, in a left turn where the cell ahead and the one to its left are the region's own."""
    same = lambda t, y, x: f"LEFT JOIN {src} {t} ON {t}.grp=a.grp AND {t}.l=a.l AND {t}.row=a.row+{y} AND {t}.col=a.col+{x}"
    return f""", {src}_s AS (SELECT a.grp, a.l, n.l IS NULL AS side, f.l IS NOT NULL AS ahead, d.l IS NOT NULL AS slant
   FROM {src} a CROSS JOIN (VALUES (0,1,-1,0),(1,0,0,1),(0,-1,1,0),(-1,0,0,-1)) w(fy,fx,oy,ox)
   {same('n', 'oy', 'ox')} {same('f', 'fy', 'fx')} {same('d', 'fy+oy', 'fx+ox')}),
 {src}_o AS (SELECT grp, l, count(*) FILTER (WHERE side) AS perimeter, count(*) FILTER (WHERE side AND NOT ahead) AS turns_right,
   count(*) FILTER (WHERE side AND ahead AND slant) AS turns_left FROM {src}_s GROUP BY 1,2)"""


# every outer ring has four right turns more than left ones, every hole four fewer
RINGS = "turns_right+turns_left AS n_vertices, 2-(turns_right-turns_left)//4 AS n_rings"


@query("polygonize_rings", with_(CLOSED + _outline("lab") + f""", comps AS (SELECT grp, l, count(*) AS n_px, dense_rank() OVER (PARTITION BY grp ORDER BY l) AS comp FROM lab GROUP BY 1,2)
 SELECT grp AS patch, CAST(comp AS INTEGER) AS comp, {RINGS} FROM comps JOIN lab_o USING (grp, l) WHERE n_px>=6""", "ndvi", recursive=True))
def polygonize_rings(spark, d):
    closed = morphology.morph(_veg(spark, d, 0.2), "close", P, P, ["patch"])
    parts = morphology.polygonize(closed, ["patch"], 4, MIN_PX_VEG)
    return parts.groupBy("patch", "comp").agg(
        F.sum(F.size("ring") - 1).alias("n_vertices"), F.count(F.when(~F.col("is_hole"), 1)).alias("_outer"),
        F.count(F.lit(1)).alias("n_rings")).where("_outer = 1").drop("_outer")


@query("seed_features", with_(CLOSED + """ SELECT patch, CAST(row_number() OVER (PARTITION BY patch ORDER BY comp) AS INTEGER) AS id, CAST(3 AS INTEGER) AS class, n_px
  FROM (SELECT patch, comp, count(*) AS n_px FROM num GROUP BY 1,2 HAVING count(*)>=6)""", "ndvi", recursive=True))
def seed_features(spark, d):
    closed = morphology.morph(_veg(spark, d, 0.2), "close", P, P, ["patch"])
    sizes = morphology.patch_components(closed, ["patch"], 4).groupBy("patch", "comp").agg(F.count(F.lit(1)).alias("n_px"))
    return layers.seed_features(sizes.where(F.col("n_px") >= MIN_PX_VEG), 3, "patch").select("patch", "id", "class", "n_px")


@query("component_boxes", with_(_mask_cte(0.0) + _erode("m0", "m1") + _dilate("m1", "m2") + _dilate("m2", "m3") + _erode("m3", "m4") + _label("m4", "lab", 8) + """
 SELECT grp AS patch, count(*) AS n_px, round(min(col)*0.3::DOUBLE+1000,6) AS "left", round(2000-min(row)*0.3::DOUBLE,6) AS top,
  round((max(col)+1)*0.3::DOUBLE+1000,6) AS "right", round(2000-(max(row)+1)*0.3::DOUBLE,6) AS bottom FROM lab GROUP BY grp, l HAVING count(*)>=30""", "ndvi", recursive=True))
def component_boxes(spark, d):
    m = morphology.morph(_veg(spark, d, 0.0), "open", P, P, ["patch"])
    m = morphology.morph(m, "close", P, P, ["patch"])
    boxes = morphology.component_boxes(m, ["patch"], 8, MIN_PX_TREE, transform=(0.3, 0.0, 1000.0, 0.0, -0.3, 2000.0))
    return boxes.select("patch", "n_px", *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")])


@query("components", with_(", mm AS (SELECT 0 AS g, row, col FROM ndvi WHERE ndvi>=0.2)" + _label("mm", "lab", 8, "g") + """
 SELECT row, col, (l//100000)*2147483648+l%100000 AS comp FROM lab""", "ndvi", recursive=True))
def components(spark, d):
    px = ndvi_pixels(spark, d).where(F.col("ndvi") >= 0.2).select("row", "col")
    return morphology.components(px, 8, block=64)


LC = "CAST(CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi>=0.2 THEN 3 WHEN nir>=red THEN 4 ELSE 6 END AS INTEGER)"


def _city(spark, d):
    n = F.col("ndvi")
    lc = F.when(n.isNull(), 0).when(n >= 0.2, 3).when(F.col("nir") >= F.col("red"), 4).otherwise(6)
    return ndvi_pixels(spark, d).select("row", "col", lc.alias("lc"))


MAP = f", mm AS (SELECT * FROM (SELECT 0 AS g, row, col, {LC} AS lc FROM ndvi) WHERE lc<>0)" + _label("mm", "lab", 4, "g", ", lc", "AND a.lc=b.lc")


@query("map_polygons", with_(MAP + _outline("lab") + f""", n AS (SELECT lc, l, count(*) AS n_px FROM lab GROUP BY 1,2)
 SELECT lc, (l//100000)*2147483648+l%100000 AS comp, n_px, perimeter, {RINGS}, n_px::DOUBLE AS area FROM n JOIN lab_o USING (l)""", "ndvi", recursive=True))
def map_polygons(spark, d):
    whole = rings.city_polygons(_city(spark, d), block=64)
    area = F.aggregate(F.transform("rings", G.signed_area), F.lit(0.0), lambda a, x: a + x)
    return whole.select("lc", "comp", "n_px", "perimeter", "n_vertices", F.size("rings").cast("long").alias("n_rings"), area.alias("area"))


@query("map_areas", with_(MAP + """ SELECT lc, count(DISTINCT l) AS n_polygons, round(count(*)*0.09::DOUBLE,6) AS area FROM lab GROUP BY 1""", "ndvi", recursive=True))
def map_areas(spark, d):
    out = morphology.map_areas(_city(spark, d), "lc", pixel_area=0.09, block=64)
    return out.withColumn("area", F.round("area", 6))
