"""Scans, per-pixel rules and chip preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import coords as C
from canopygrid.functions import names as N
from canopygrid.model import BLACK_SHARE_MAX, LABELED_SHARE_MIN, ChipConfig
from canopygrid.functions.keys import order_key_sql
from canopygrid.operators import augment, layers, points, raster, sampling, vector
from canopygrid.plans import fixtures as X
from canopygrid.plans.fixtures import with_
from canopygrid.plans.registry import query
from canopygrid.sources import clustered, commits, config, discovery, tables

CFG = ChipConfig()


def ndvi_pixels(spark, d):
    return X.pixels(spark, d).withColumn("ndvi", B.ndvi())


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ------------------------------------------------------------------ scans

def _stored_raster(spark, d):
    """The mosaic as a raster on disk, in blocks along the curve."""
    px = lambda: X.pixels(spark, d).select("scene", "row", "col", *X.BANDS)
    return X.made_once(spark, d, "raster", lambda path: clustered.write_raster(px(), path, block=X.CHIP))


@query("scan_bands", with_("SELECT scene,row,col,red,nir FROM px", "px"))
def scan_bands(spark, d):
    return clustered.read_bands(spark, _stored_raster(spark, d), ["red", "nir"], ("scene", "row", "col"))


@query("window_read", with_("SELECT row,col,red,green,blue,nir FROM px WHERE row BETWEEN 16 AND 47 AND col BETWEEN 32 AND 95", "px"))
def window_read(spark, d):
    return clustered.read_window(spark, _stored_raster(spark, d), 16, 32, 32, 64).select("row", "col", *X.BANDS)


@query("scan_points", with_("SELECT *, CAST(6341 AS INTEGER) AS epsg FROM pt", "pt"))
def scan_points(spark, d):
    return tables.scan_points(X.points(spark, d), 6341)


# A web Mercator box; the layer lies in UTM, ten metres to a unit.
BOX = (-12475800.0, 3953500.0, -12475300.0, 3954000.0)


def _bbox_sql():
    """The padded box's sides at 33 places each, projected; the margin is a 1024th of the larger extent."""
    x0, y0, x1, y1 = BOX[0] - 2, BOX[1] - 2, BOX[2] + 2, BOX[3] + 2
    sides = " UNION ALL ".join(f"SELECT {x}+i/32.0::DOUBLE*{dx} AS x, {y}+i/32.0::DOUBLE*{dy} AS y FROM range(33) r(i)" for x, y, dx, dy in (
        (x0, y0, x1 - x0, 0.0), (x0, y1, x1 - x0, 0.0), (x0, y0, 0.0, y1 - y0), (x1, y0, 0.0, y1 - y0)))
    return with_(f""", sides AS ({sides}), ang AS (SELECT {X.mercator_angles('x', 'y')} FROM sides), {X.utm_ctes('ang', 'p')},
 box AS (SELECT min(east) AS e0, max(east) AS e1, min(north) AS n0, max(north) AS n1, greatest(max(east)-min(east),max(north)-min(north))/1024 AS m FROM p),
 layer AS (SELECT fid, 400000+10*xmin AS xmin, 3700000+10*ymin AS ymin, 400000+10*xmax AS xmax, 3700000+10*ymax AS ymax FROM ft)
 SELECT fid, xmin, ymin, xmax, ymax FROM layer, box WHERE xmax>=e0-m AND xmin<=e1+m AND ymax>=n0-m AND ymin<=n1+m""", "ft")


@query("bbox_scan", _bbox_sql())
def bbox_scan(spark, d):
    at = lambda c, o: (o + F.col(c) * 10).alias(c)
    ft = lambda: X.features(spark, d).select("fid", at("xmin", 400000), at("ymin", 3700000), at("xmax", 400000), at("ymax", 3700000))
    path = X.made_once(spark, d, "layer", lambda path: clustered.write_layer(ft(), path, X.UTM_CODE))
    return clustered.read_layer(spark, path, BOX, X.MERCATOR_CODE).select("fid", "xmin", "ymin", "xmax", "ymax")


@query("links_scan", r"""SELECT url, regexp_extract(url,'([^/]+?)(\.[^./]*)?/*$',1) AS stem FROM pages""")
def links_scan(spark, d):
    lines = X.table(spark, d, "pages").select(
        F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" \t")), F.lit("   "))).alias("value"))
    return discovery.links(lines)


@query("discover_dedup", with_("SELECT lower(path) AS path_key, min(path) AS path FROM pa GROUP BY 1", "pa"))
def discover_dedup(spark, d):
    return discovery.discover(X.paths(spark, d))


@query("selected_missing", """SELECT 'hit' AS kind, url AS stem FROM pages WHERE page_id%3=0
 UNION ALL SELECT 'missing', 'invented_'||CAST(i AS VARCHAR) FROM range(3) t(i)""")
def selected_missing(spark, d):
    p = X.table(spark, d, "pages").select("page_id", F.col("url").alias("stem"))
    invented = spark.range(3).select(F.concat(F.lit("invented_"), F.col("id").cast("string")).alias("stem"))
    wanted = p.where(F.col("page_id") % 3 == 0).select("stem").union(invented)
    hits, missing = discovery.select_scenes(p.select("stem"), wanted)
    return hits.select(F.lit("hit").alias("kind"), "stem").union(missing.select(F.lit("missing").alias("kind"), "stem"))


@query("resume_todo", "SELECT page_id, url FROM pages WHERE page_id%5<>0")
def resume_todo(spark, d):
    p = X.table(spark, d, "pages").select("page_id", "url")
    return discovery.pending(p, p.where(F.col("page_id") % 5 == 0).select("page_id"), "page_id")


@query("state_splits", """SELECT c_custkey AS scene, state||'-'||split AS split_name, layer FROM (
  SELECT c_custkey, lower(n_name) AS state, CASE WHEN c_custkey%5=0 THEN 'val' WHEN c_custkey%5=1 THEN 'test' ELSE 'train' END AS split
  FROM customer JOIN nation ON c_nationkey=n_nationkey), (VALUES ('imagery'),('landcover')) l(layer)
 WHERE split IN ('train','val')""")
def state_splits(spark, d):
    c, n = X.table(spark, d, "customer"), X.table(spark, d, "nation")
    m = F.col("c_custkey") % 5
    scenes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("scene"), F.lower("n_name").alias("state"),
        F.when(m == 0, "val").when(m == 1, "test").otherwise("train").alias("split"))
    return discovery.split_scan(scenes, None, ["train", "val"], ["imagery", "landcover"]).select(
        "scene", "split_name", "layer")


@query("robust_chips", with_("""SELECT chip, chip%10<>3 AS readable,
  CAST(sum(CASE WHEN chip%10<>3 THEN red*(pos+1) ELSE 0 END) AS BIGINT) AS image_sum,
  CAST(sum(CASE WHEN chip%10<>3 THEN nir%7*(pos+1) ELSE 0 END) AS BIGINT) AS mask_sum, 64 AS n_px FROM px GROUP BY chip""", "px"))
def robust_chips(spark, d):
    px = X.pixels(spark, d)
    index = X.chips(spark, d).select("chip")
    good = px.where(F.col("chip") % 10 != 3).groupBy("chip").agg(
        F.array_sort(F.collect_list(F.struct("pos", "red", (F.col("nir") % 7).alias("m")))).alias("cells")).select(
        "chip", F.col("cells.red").alias("image"), F.col("cells.m").alias("mask"))
    # weighted by position, so that the order of the pixels counts
    total = lambda a: F.aggregate(F.transform(a, lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return discovery.robust_chips(index, good, "chip", X.CHIP, "image", "mask").select(
        "chip", "readable", total("image").alias("image_sum"), total("mask").alias("mask_sum"),
        F.size("image").alias("n_px"))


def _inputs(spark, d):
    runs = X.runs(spark, d).withColumn("item", F.concat_ws("/", "arch", F.col("init").cast("string"), F.col("seed").cast("string")))
    return discovery.inputs_check(runs.select("item").distinct(), runs.where(F.col("miou") > 0.55).select("item"), "item")


@query("inputs_check", with_(""", k AS (SELECT arch||'/'||CAST(init AS VARCHAR)||'/'||CAST(seed AS VARCHAR) AS item,
  bool_or(miou>0.55) AS found FROM runs GROUP BY 1) SELECT item, found FROM k""", "runs"))
def inputs_check(spark, d):
    return _inputs(spark, d)


@query("inputs_verdict", with_(""", k AS (SELECT arch||'/'||CAST(init AS VARCHAR)||'/'||CAST(seed AS VARCHAR) AS item,
  bool_or(miou>0.55) AS found FROM runs GROUP BY 1)
 SELECT count(*) AS n_required, count(*) FILTER (WHERE NOT found) AS n_missing, bool_and(found) AS all_found FROM k""", "runs"))
def inputs_verdict(spark, d):
    return discovery.verdict(_inputs(spark, d))


# ------------------------------------------------------------------ configuration

def _configs(spark, d):
    e = X.table(spark, d, "events")
    i = F.col("event_id")
    doc = F.concat(
        F.lit('{"naip_band_count":4,"naip_scale":'), F.when(i % 2 == 0, "255.0").otherwise("65535.0"),
        F.when(i % 3 != 0, ',"chm_clip_m":30.0').otherwise(""), F.when(i % 4 == 0, ',"th_tree_m":2.5').otherwise(""),
        F.when(i % 5 == 0, ',"ndvi_auto_rescale":false').otherwise(""), F.when(i % 7 == 0, "").otherwise("}"))
    return e.select(F.concat(F.lit("tiles_"), N.run_stamp("ts"), F.lit("_n"), N.padded("event_id", 4)).alias("name"), doc.alias("doc"))


CONFIG_CTE = """WITH cf AS (SELECT event_id, 'tiles_'||strftime(ts,'%Y-%m-%d_%H%M%S')||'_n'||
   CASE WHEN event_id>9999 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR),4,'0') END AS name,
  '{"naip_band_count":4,"naip_scale":'||CASE WHEN event_id%2=0 THEN '255.0' ELSE '65535.0' END||
  CASE WHEN event_id%3<>0 THEN ',"chm_clip_m":30.0' ELSE '' END||CASE WHEN event_id%4=0 THEN ',"th_tree_m":2.5' ELSE '' END||
  CASE WHEN event_id%5=0 THEN ',"ndvi_auto_rescale":false' ELSE '' END||CASE WHEN event_id%7=0 THEN '' ELSE '}' END AS doc FROM events)
"""


@query("config_newest", CONFIG_CTE + """SELECT doc, name FROM cf WHERE event_id%3<>0 AND event_id%7<>0 AND contains(name,'2024-01')
 ORDER BY name DESC LIMIT 1""")
def config_newest(spark, d):
    return config.newest_config(_configs(spark, d), contains="2024-01")


@query("config_defaults", CONFIG_CTE + """SELECT name, NOT (event_id%5=0 AND event_id%7<>0) AS ndvi_auto_rescale, 0.3::DOUBLE AS th_grass_m,
 CASE WHEN event_id%4=0 AND event_id%7<>0 THEN 2.5::DOUBLE ELSE 1.5::DOUBLE END AS th_tree_m, 0.2::DOUBLE AS ndvi_veg_min FROM cf""")
def config_defaults(spark, d):
    return config.with_defaults(_configs(spark, d))


@query("scene_meta", with_("""SELECT scene, width, height, CAST(ceil(height/48.0) AS INTEGER) AS n_rows, CAST(ceil(width/48.0) AS INTEGER) AS n_cols,
  CAST(ceil(height/48.0)*ceil(width/48.0) AS INTEGER) AS n_tiles
 FROM (SELECT scene, CAST(max(col)-min(col)+1 AS INTEGER) AS width, CAST(max(row)-min(row)+1 AS INTEGER) AS height FROM px GROUP BY scene)""", "px"))
def scene_meta(spark, d):
    return config.scene_meta(X.pixels(spark, d), 48)


# ------------------------------------------------------------------ per-pixel rules

@query("ndvi", with_("SELECT scene,row,col,round(ndvi,9) AS ndvi FROM ndvi", "ndvi"))
def ndvi(spark, d):
    return ndvi_pixels(spark, d).select("scene", "row", "col", F.round("ndvi", 9).alias("ndvi"))


STRATUM = """CASE WHEN ndvi>=0.2 THEN CASE WHEN chm IS NULL OR chm<0.3 THEN 'grass' WHEN chm<=1.5 THEN 'shrub' ELSE 'tree' END END"""


@query("veg_strata", with_(f"SELECT row,col,{STRATUM} AS stratum FROM ndvi", "ndvi"))
def veg_strata(spark, d):
    return ndvi_pixels(spark, d).select("row", "col", B.veg_stratum().alias("stratum"))


@query("strata_per_patch", with_(f"""SELECT chip, count(*) FILTER (WHERE s='grass') AS grass, count(*) FILTER (WHERE s='shrub') AS shrub,
 count(*) FILTER (WHERE s='tree') AS tree FROM (SELECT chip,{STRATUM} AS s FROM ndvi) GROUP BY chip""", "ndvi"))
def strata_per_patch(spark, d):
    px = ndvi_pixels(spark, d).select("chip", B.veg_stratum().alias("stratum"))
    return sampling.strata_counts(px, "chip")


@query("pseudolabel4", with_("""SELECT row,col,CAST(CASE WHEN ndvi>=0.2 AND chm<0.3 THEN 2 WHEN ndvi>=0.2 AND chm<=1.5 THEN 1
 WHEN ndvi>=0.2 AND chm>1.5 THEN 0 ELSE 3 END AS INTEGER) AS label4 FROM ndvi""", "ndvi"))
def pseudolabel4(spark, d):
    return ndvi_pixels(spark, d).select("row", "col", B.pseudolabel4().alias("label4"))


@query("hybrid_codes", with_("""SELECT row,col,CAST(CASE WHEN p=0 AND chm<0.3 THEN 3 WHEN p=0 AND chm<1.5 THEN 2 WHEN p=0 AND chm>=1.5 THEN 1
 WHEN p BETWEEN 1 AND 4 THEN p+3 ELSE 0 END AS INTEGER) AS code FROM (SELECT row,col,chm,(red+nir)%5 AS p FROM px)""", "px"))
def hybrid_codes(spark, d):
    px = X.pixels(spark, d).withColumn("pred5", (F.col("red") + F.col("nir")) % 5)
    return px.select("row", "col", B.hybrid_codes().alias("code"))


def _masked(spark, d):
    m = (F.col("red") * 3 + F.col("nir")) % 8
    return X.pixels(spark, d).select("chip", "row", "col", "red", "nir", F.when(m == 7, 255).otherwise(m).alias("mask"))


MASK = "(CASE WHEN (red*3+nir)%8=7 THEN 255 ELSE (red*3+nir)%8 END)"


@query("remap5", with_(f"SELECT row,col,CAST(CASE WHEN {MASK}<=2 THEN 0 WHEN {MASK}<=6 THEN {MASK}-2 ELSE 255 END AS INTEGER) AS mask5 FROM px", "px"))
def remap5(spark, d):
    return _masked(spark, d).select("row", "col", B.remap("mask", "five").alias("mask5"))


@query("remap4", with_(f"SELECT row,col,CAST(CASE WHEN {MASK}<=2 THEN {MASK} WHEN {MASK}<=6 THEN 3 ELSE 255 END AS INTEGER) AS mask4 FROM px", "px"))
def remap4(spark, d):
    return _masked(spark, d).select("row", "col", B.remap("mask", "four").alias("mask4"))


@query("mask_clip", with_("SELECT row,col,CAST(CASE WHEN (red+nir)%16>6 THEN 0 ELSE (red+nir)%16 END AS INTEGER) AS mask FROM px", "px"))
def mask_clip(spark, d):
    return X.pixels(spark, d).select("row", "col", B.clip_mask((F.col("red") + F.col("nir")) % 16).alias("mask"))


def chip_arrays(spark, d):
    """Chips as arrays with stored index values in both scales and non-finite samples."""
    inf, nan = float("inf"), float("nan")
    c = X.chips(spark, d)
    idx = F.sequence(F.lit(0), F.lit(63))
    gid = lambda i: F.col("chip") * 64 + i
    at = lambda i, k: F.get("v", (i + k) % 64).cast("double")
    dark = lambda i: (F.col("chip") % 11 == 0) & (i % 8 < 2)
    band = lambda k, o: F.transform(idx, lambda i: F.when(dark(i), 0).otherwise(F.floor((at(i, k) + o) * 200).cast("int")))
    out = c.select("chip", "v", band(0, 0.55).alias("red"), band(16, 0.55).alias("green"), band(48, 0.55).alias("blue"), band(32, 0.75).alias("nir"))

    def stored_ndvi(i):
        g = gid(i)
        v = B.ndvi(F.get("red", i), F.get("nir", i))
        v = v * F.when(F.col("chip") % 7 == 0, 10000.0).otherwise(1.0)
        return (F.when(g % 31 == 0, nan).when(g % 37 == 1, inf).when(g % 41 == 2, -inf).otherwise(F.coalesce(v, F.lit(0.0))))

    def stored_chm(i):
        g = gid(i)
        v = F.when(g % 29 != 0, F.greatest(at(i, 8), F.lit(0.0)) * 12).otherwise(-9999.0)
        return F.when(g % 43 == 3, nan).when(g % 47 == 4, inf).otherwise(v * 10)

    return out.withColumns({"ndvi": F.transform(idx, stored_ndvi), "chm": F.transform(idx, stored_chm)}).drop("v")


RAW_CTE = """, raw AS (SELECT chip, pos, red, green, blue, nir,
  CASE WHEN g%31=0 THEN 'nan'::DOUBLE WHEN g%37=1 THEN 'inf'::DOUBLE WHEN g%41=2 THEN '-inf'::DOUBLE
   ELSE coalesce(ndvi*(CASE WHEN chip%7=0 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END),0.0::DOUBLE) END AS ndvi,
  CASE WHEN g%43=3 THEN 'nan'::DOUBLE WHEN g%47=4 THEN 'inf'::DOUBLE ELSE coalesce(chm,-9999.0::DOUBLE)*10 END AS chm
  FROM (SELECT *, chip*64+pos AS g FROM ndvi)),
 flag AS (SELECT chip, bool_or(isfinite(ndvi) AND abs(ndvi)>2.0) AS big FROM raw GROUP BY chip),
 s AS (SELECT raw.* REPLACE (CASE WHEN big THEN ndvi/10000.0::DOUBLE ELSE ndvi END AS ndvi) FROM raw JOIN flag USING (chip))
"""


def _unzip(ch, cols):
    ex = ch.select("chip", F.posexplode(F.arrays_zip(*cols)).alias("pos", "_z"))
    return ex.select("chip", "pos", *[F.round(F.col("_z")[c], 6).alias(c) for c in cols])


@query("normalize_chip", with_(RAW_CTE + """ SELECT chip,pos,round(red/255.0::DOUBLE,6) AS red, round(green/255.0::DOUBLE,6) AS green,
 round(blue/255.0::DOUBLE,6) AS blue, round(nir/255.0::DOUBLE,6) AS nir,
 round(CASE WHEN isnan(ndvi) THEN 0.0 ELSE (least(greatest(ndvi,-1.0),1.0)+1.0)/2.0 END,6) AS ndvi,
 round(CASE WHEN isnan(chm) THEN 0.0 ELSE least(greatest(chm,0.0),30.0)/30.0 END,6) AS chm FROM s""", "ndvi"))
def normalize_chip(spark, d):
    return _unzip(B.normalize(chip_arrays(spark, d), CFG), [*X.BANDS, "ndvi", "chm"])


@query("real_ndvi_chm", with_(RAW_CTE + """ SELECT chip,pos,round(CASE WHEN isnan(ndvi) THEN 0.0 ELSE least(greatest(ndvi,-1.0),1.0) END,6) AS ndvi,
 round(CASE WHEN isfinite(chm) AND chm>=-1000 THEN chm ELSE 0.0 END,6) AS chm FROM s""", "ndvi"))
def real_ndvi_chm(spark, d):
    return _unzip(B.physical(chip_arrays(spark, d), CFG), ["ndvi", "chm"])


@query("nodata_policy", with_("""SELECT row,col,round(coalesce(v,-9999.0::DOUBLE),6) AS keep,
 round(CASE WHEN v IS NULL OR v < -1000 THEN 0.0::DOUBLE ELSE v END,6) AS zero
 FROM (SELECT row,col,CASE WHEN pos=5 THEN -5000.0::DOUBLE ELSE chm END AS v FROM px)""", "px"))
def nodata_policy(spark, d):
    v = F.when(F.col("pos") == 5, -5000.0).otherwise(F.col("chm"))
    return X.pixels(spark, d).select("row", "col", F.round(B.fill_nodata(v, "keep"), 6).alias("keep"),
                                     F.round(B.fill_nodata(v, "zero"), 6).alias("zero"))


T0 = (0.3, 0.01, 1000.0, 0.02, -0.3, 2000.0)


@query("pixel_xy", with_("""SELECT row,col,round(1000.0::DOUBLE+0.3::DOUBLE*(col+0.5)+0.01::DOUBLE*(row+0.5),6) AS x,
 round(2000.0::DOUBLE+0.02::DOUBLE*(col+0.5)-0.3::DOUBLE*(row+0.5),6) AS y,
 round(1000.0::DOUBLE+0.3::DOUBLE*col+0.01::DOUBLE*row,6) AS left_x, round(2000.0::DOUBLE+0.02::DOUBLE*col-0.3::DOUBLE*row,6) AS top_y FROM px""", "px"))
def pixel_xy(spark, d):
    out = [C.pixel_x("row", "col", T0).alias("x"), C.pixel_y("row", "col", T0).alias("y"),
           C.pixel_x("row", "col", T0, "corner").alias("left_x"), C.pixel_y("row", "col", T0, "corner").alias("top_y")]
    return X.pixels(spark, d).select("row", "col", *out).select("row", "col", *r6("x", "y", "left_x", "top_y"))


def positioned(spark, d, layout):
    """Pixels with their place in the boundary's box, one box per scene."""
    px = X.pixels(spark, d).select("scene", "row", "col")
    boxes = px.select("scene").distinct().withColumns({
        "xmin": F.lit(10.0), "ymin": F.lit(10.0), "xmax": F.lit(190.0), "ymax": F.lit(150.0)})
    return C.with_position(px, layout, F.col("col") + 0.5, F.col("row") + 0.5, boxes, ["scene"]).drop("scene")


@query("coord_xy", with_("""SELECT row,col,round((col+0.5-10.0)/180.0::DOUBLE,6) AS coord_x, round((row+0.5-10.0)/140.0::DOUBLE,6) AS coord_y FROM px""", "px"))
def coord_xy(spark, d):
    return positioned(spark, d, "xy").select("row", "col", *r6("coord_x", "coord_y"))


def _sincos_sql():
    parts = []
    for k in range(4):
        for fn in ("sin", "cos"):
            for ax, u in (("x", "u"), ("y", "v")):
                parts.append(f"round({fn}({u}*{2**k}*pi()),6) AS {fn}_{ax}{k}")
    return ", ".join(parts)


@query("coord_sincos", with_(f"""SELECT row,col,{_sincos_sql()} FROM
 (SELECT row,col,(col+0.5-10.0)/180.0::DOUBLE AS u,(row+0.5-10.0)/140.0::DOUBLE AS v FROM px)""", "px"))
def coord_sincos(spark, d):
    px = positioned(spark, d, "sincos")
    return px.select("row", "col", *r6(*px.columns[2:]))


@query("patch_nodata_filter", with_("""SELECT chip, black_share FROM (SELECT chip, avg(CASE WHEN red=0 AND green=0 AND blue=0 AND nir=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS black_share
 FROM px GROUP BY chip) WHERE black_share<=0.2""", "px"))
def patch_nodata_filter(spark, d):
    return sampling.black_share_ok(X.pixels(spark, d), ["chip"], X.BANDS, BLACK_SHARE_MAX)


@query("naip_scale", """SELECT p_partkey AS fid, dtype, CASE dtype WHEN 'uint8' THEN 255.0::DOUBLE WHEN 'uint16' THEN 65535.0::DOUBLE
 WHEN 'int16' THEN 32767.0::DOUBLE WHEN 'int32' THEN 2147483647.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM
 (SELECT p_partkey, ['uint8','uint16','int16','int32','float32'][p_size%5+1] AS dtype FROM part)""")
def naip_scale(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("uint8", "uint16", "int16", "int32", "float32")])
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.get(kinds, F.col("p_size") % 5).alias("dtype"))
    return p.withColumn("scale", B.sample_scale("dtype"))


@query("argmax_class", with_("""SELECT row,col,CAST(list_position(s,list_max(s))-1 AS INTEGER) AS cls FROM (SELECT row,col,[red,green,blue,nir] AS s FROM px)""", "px"))
def argmax_class(spark, d):
    return X.pixels(spark, d).select("row", "col", B.argmax(F.array(*X.BANDS)).alias("cls"))


@query("fit_to", with_("""SELECT chip, 5 AS size, (r-1)*5+(c-1) AS pos, red FROM px WHERE r BETWEEN 1 AND 5 AND c BETWEEN 1 AND 5
 UNION ALL SELECT k.chip, 10, CAST(k.p AS INTEGER), coalesce(px.red,0) FROM (SELECT vec_id AS chip, unnest(range(100)) AS p FROM embeddings) k
 LEFT JOIN px ON px.chip=k.chip AND px.r=k.p//10 AND px.c=k.p%10""", "px"))
def fit_to(spark, d):
    ch = chip_arrays(spark, d).select("chip", "red")
    sized = lambda n: ch.select("chip", F.lit(n).alias("size"), F.posexplode(raster.fit_to("red", 8, 8, n)).alias("pos", "red"))
    return sized(5).union(sized(10))


# ------------------------------------------------------------------ chips

CHK = "CAST(sum(red*(k+1)) AS BIGINT) AS red_check, CAST(sum(nir*(k+1)) AS BIGINT) AS nir_check"


def _checks(ch, *bands):
    chk = lambda b: F.aggregate(
        F.zip_with(b, F.sequence(F.lit(1), F.size(b)), lambda v, k: v.cast("bigint") * k), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return [chk(b).alias(f"{b}_check") for b in bands]


def _local(spark, d):
    """Scene-local rows, so that a scene starts at row 0."""
    px = X.pixels(spark, d)
    return px.withColumn("row", F.col("row") % X.SCENE_ROWS)


def _chipped(spark, d, px, size, bands, edge):
    """Chips of scene-local pixels; the last scene may lack chips of the mosaic."""
    return raster.to_chips(px, size, bands, edge, scenes=X.scenes(spark, d), holes="fill")


BLOCK = """SELECT scene, r0, c0, valid_h, valid_w, {chk} FROM (
 SELECT scene, (row%32)//48*48 AS r0, col//48*48 AS c0, CAST(least(48,32-(row%32)//48*48) AS INTEGER) AS valid_h,
  CAST(least(48,200-col//48*48) AS INTEGER) AS valid_w, ((row%32)%48)*48+col%48 AS k, red, nir FROM px) GROUP BY ALL"""


@query("chips_pad", with_(BLOCK.format(chk=CHK + ", 2304 AS n_px").replace("scene, r0, c0,", "scene, CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0,"), "px"))
def chips_pad(spark, d):
    ch = _chipped(spark, d, _local(spark, d), 48, ["red", "nir"], "pad")
    return ch.select("scene", "r0", "c0", "valid_h", "valid_w", *_checks(ch, "red", "nir"), F.size("red").alias("n_px"))


@query("chips_drop", with_(f"""SELECT scene, CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0, {CHK}, count(*) AS n_px FROM (
 SELECT scene, (row%32)//24*24 AS r0, col//24*24 AS c0, ((row%32)%24)*24+col%24 AS k, red, nir FROM px
 WHERE (row%32)//24*24+24<=32 AND col//24*24+24<=200) GROUP BY scene,r0,c0""", "px"))
def chips_drop(spark, d):
    ch = _chipped(spark, d, _local(spark, d), 24, ["red", "nir"], "drop")
    there = F.when(F.col("seen").isNull(), F.size("red")).otherwise(F.size(F.filter("seen", lambda x: x)))
    return ch.select("scene", "r0", "c0", *_checks(ch, "red", "nir"), there.cast("bigint").alias("n_px"))


@query("subcrops", with_(f"""SELECT chip, CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, {CHK}, round(0.3::DOUBLE*(chip%25*8+dc),6) AS x0,
 round(-0.3::DOUBLE*(chip//25*8+dr),6) AS y0 FROM (SELECT chip, r//4*4 AS dr, c//4*4 AS dc, (r%4)*4+c%4 AS k, red, nir FROM px) GROUP BY chip,dr,dc""", "px"))
def subcrops(spark, d):
    ch = raster.subcrops(chip_arrays(spark, d).select("chip", "red", "nir"), 8, 4, ["red", "nir"])
    t = C.window_transform((0.3, 0.0, 0.0, 0.0, -0.3, 0.0), F.floor(F.col("chip") / 25) * 8 + F.col("dr"), (F.col("chip") % 25) * 8 + F.col("dc"))
    return ch.select("chip", "dr", "dc", *_checks(ch, "red", "nir"), F.round(F.get(t, 2), 6).alias("x0"), F.round(F.get(t, 5), 6).alias("y0"))


@query("writeback", with_("SELECT scene, row%32 AS row, col, red, nir FROM px", "px"))
def writeback(spark, d):
    ch = _chipped(spark, d, _local(spark, d), 48, ["red", "nir"], "pad")
    return raster.to_pixels(ch, 48, ["red", "nir"])


@query("landcover_pixels", with_("SELECT scene, row%32 AS row, col, CAST((red+nir)%7+1 AS TINYINT) AS lc FROM px", "px"))
def landcover_pixels(spark, d):
    px = _local(spark, d).withColumn("pred", (F.col("red") + F.col("nir")) % 7)
    ch = _chipped(spark, d, px, 48, ["pred"], "pad").withColumn("lc", F.transform("pred", lambda p: (p + 1).cast("tinyint")))
    return raster.to_pixels(ch, 48, ["lc"])


@query("publish_commit", with_("""SELECT scene, count(*) AS n, CAST(sum(red+CASE WHEN CAST(substr(scene,3) AS INTEGER)%2=0 THEN 1000 ELSE 0 END) AS BIGINT) AS total,
 CAST(2 AS BIGINT) AS commits, CAST(1 AS BIGINT) AS left_over FROM px GROUP BY scene""", "px"))
def publish_commit(spark, d):
    """Scenes published, every second one published anew, and a writer lost before its record: readers see the first two."""
    root, px = X.stored(spark, "table"), X.pixels(spark, d).select("scene", "row", "col", "red")
    commits.publish_commit(px, root, ["scene"])
    again = px.where(F.substring("scene", 3, 9).cast("int") % 2 == 0).withColumn("red", F.col("red") + 1000)
    commits.publish_commit(again, root, ["scene"], token="second")
    commits.write_version(px.withColumn("red", F.lit(-1)), root, ["scene"])
    commits.publish_commit(again.withColumn("red", F.lit(-2)), root, ["scene"], token="second")  # known, and so left out
    live = commits.read_published(spark, root)
    return live.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("red").alias("total")).withColumns({
        "commits": F.lit(commits.latest(spark, root)).cast("long"), "left_over": F.lit(len(commits.leftovers(spark, root))).cast("long")})


@query("stack6", with_("SELECT scene,row,col,red,green,blue,nir,round(ndvi,9) AS ndvi,round(chm,9) AS chm FROM ndvi", "ndvi"))
def stack6(spark, d):
    px = X.pixels(spark, d)
    bands = px.select(*raster.CELL, *X.BANDS)
    index = px.select(*raster.CELL, F.round(B.ndvi(), 9).alias("ndvi"))
    height = px.select(*raster.CELL, F.round("chm", 9).alias("chm"))
    return raster.stack(bands, index, height)


@query("chips_by_split", with_(f"""SELECT chip, CASE WHEN {order_key_sql("chip")}%1000000<200000 THEN 'val' ELSE 'train' END AS split,
 8 AS patch_size, CAST(sum(red) AS BIGINT) AS red_sum FROM px GROUP BY chip""", "px"))
def chips_by_split(spark, d):
    px = X.pixels(spark, d).groupBy("chip").agg(F.sum("red").alias("red_sum"))
    return sampling.assign_split(px, "chip").select("chip", "split", F.lit(8).alias("patch_size"), "red_sum")


def _chip_set(spark, d):
    """Chips with image and mask, their scene and split."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "red", (F.col("nir") % 7).alias("m"))))
    ch = X.pixels(spark, d).groupBy("chip", "scene").agg(cells.alias("cells")).select(
        "chip", "scene", F.col("cells.red").alias("image"), F.col("cells.m").alias("mask"), F.lit(8).alias("patch_size"))
    return sampling.assign_split(ch, "chip")


def _weighted(a):
    """Sum of an array's values times their positions, so that order counts."""
    return F.aggregate(F.transform(a, lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)


@query("chips_round_trip", with_(f"""SELECT chip, scene, 'val' AS split, CAST(8 AS INTEGER) AS patch_size, CAST(sum(red*(pos+1)) AS BIGINT) AS image_sum,
 CAST(sum(nir%7*(pos+1)) AS BIGINT) AS mask_sum FROM px WHERE {order_key_sql("chip")}%1000000<200000 GROUP BY chip, scene""", "px"))
def chips_round_trip(spark, d):
    """The chip set written by size and split, and its validation part read again: only that folder's files are opened."""
    path = X.stored(spark, "chips")
    tables.write_chips(_chip_set(spark, d), path)
    val = tables.read_chips(spark, path, 8, "val")
    return val.select("chip", "scene", "split", "patch_size", _weighted("image").alias("image_sum"), _weighted("mask").alias("mask_sum"))


@query("robust_files", with_("""SELECT scene, count(DISTINCT chip) AS n_chips, count(DISTINCT chip) FILTER (WHERE ok) AS n_readable,
 CAST(sum(CASE WHEN ok THEN red*(pos+1) ELSE 0 END) AS BIGINT) AS image_sum, CAST(sum(CASE WHEN ok THEN nir%7*(pos+1) ELSE 255*(pos+1) END) AS BIGINT) AS mask_sum,
 (SELECT count(DISTINCT scene) FROM px) AS n_files, (SELECT count(DISTINCT scene) FROM px WHERE CAST(substr(scene,3) AS INTEGER)%3<>1) AS n_valid
 FROM (SELECT *, CAST(substr(scene,3) AS INTEGER)%3<>1 AS ok FROM px) GROUP BY scene""", "px"))
def robust_files(spark, d):
    """One chip file per scene, every third cut in half: its chips become zero images with masks that are all ignored."""
    path = X.stored(spark, "files")
    chips = _chip_set(spark, d).drop("split", "patch_size")
    chips.repartition("scene").write.partitionBy("scene").parquet(path)
    for (scene,) in chips.select("scene").distinct().collect():
        if int(scene[2:]) % 3 == 1:
            X.truncate(spark, f"{path}/scene={scene}")
    rows, status = discovery.tolerant_read(spark, path, chips.schema)
    index = X.chips(spark, d).select("chip", F.concat(F.lit("m_"), F.floor(F.col("chip") / 100).cast("string")).alias("scene"))
    full = discovery.robust_chips(index, rows.select("chip", "image", "mask"), "chip", X.CHIP, "image", "mask", ignore=255)
    per = full.groupBy("scene").agg(F.count(F.lit(1)).alias("n_chips"), F.count(F.when(F.col("readable"), 1)).alias("n_readable"),
                                    F.sum(_weighted("image")).alias("image_sum"), F.sum(_weighted("mask")).alias("mask_sum"))
    return per.crossJoin(discovery.read_summary(status))  # one row


@query("split_inherit", with_(f"""SELECT chip, CAST(r//4*4 AS INTEGER) AS dr, CAST(c//4*4 AS INTEGER) AS dc,
 CASE WHEN {order_key_sql("chip")}%1000000<200000 THEN 'val' ELSE 'train' END AS split,
 'label_'||scene||'/'||CAST(chip AS VARCHAR)||'_p4_r'||CAST(r//4*4 AS VARCHAR)||'_c'||CAST(c//4*4 AS VARCHAR) AS source
 FROM px GROUP BY ALL""", "px"))
def split_inherit(spark, d):
    tiles = sampling.assign_split(X.chips(spark, d).select("chip"), "chip")
    src = chip_arrays(spark, d).select("chip", "red").join(tiles, "chip")
    cut = raster.subcrops(src, 8, 4, ["red"])
    group = F.concat(F.lit("label_m_"), F.floor(F.col("chip") / 100).cast("string"))
    return cut.select("chip", "dr", "dc", "split",
                      N.crop_source(group, F.col("chip").cast("string"), 4, "dr", "dc", F.lit(False)).alias("source"))


@query("split_tiles", f"""SELECT vec_id AS chip, CASE WHEN {order_key_sql("vec_id")}%1000000<200000 THEN 'val' ELSE 'train' END AS split FROM embeddings""")
def split_tiles(spark, d):
    return sampling.assign_split(X.chips(spark, d).select("chip"), "chip")


# ------------------------------------------------------------------ augmentation

D4_SQL = f""", k AS (SELECT *, {order_key_sql("chip", epoch="3")} AS h FROM px),
 b AS (SELECT *, (h>>30)%2=1 AS fh, (h>>29)%2=1 AS fv, (h>>27)%4 AS turns FROM k),
 f AS (SELECT *, CASE WHEN fv THEN 7-r ELSE r END AS r1, CASE WHEN fh THEN 7-c ELSE c END AS c1 FROM b),
 g AS (SELECT *, CASE turns WHEN 0 THEN r1 WHEN 1 THEN 7-c1 WHEN 2 THEN 7-r1 ELSE c1 END AS r2,
   CASE turns WHEN 0 THEN c1 WHEN 1 THEN r1 WHEN 2 THEN 7-c1 ELSE 7-r1 END AS c2 FROM f)
 SELECT chip, CAST(r2*8+c2 AS INTEGER) AS pos, red, nir FROM g"""


@query("augment_d4", with_(D4_SQL, "px"))
def augment_d4(spark, d):
    ch = augment.augment_d4(chip_arrays(spark, d).select("chip", "red", "nir"), "chip", 8, ["red", "nir"], epoch=3)
    ex = ch.select("chip", F.posexplode(F.arrays_zip("red", "nir")).alias("pos", "_z"))
    return ex.select("chip", "pos", "_z.red", "_z.nir")


DRAWS = ", ".join(f"{order_key_sql('vec_id', epoch='3', draw=k)}/4294967296.0::DOUBLE AS u{k}" for k in range(4))


@query("augment_crop", with_(f""", u AS (SELECT vec_id AS chip, {DRAWS} FROM embeddings),
 s AS (SELECT *, CASE WHEN u0<0.5 THEN greatest(CAST(floor(sqrt(0.25+u1*0.75)*8+0.5) AS INTEGER),1) ELSE 8 END AS side FROM u),
 w AS (SELECT chip, side, CAST(floor(u2*(9-side)) AS INTEGER) AS top, CAST(floor(u3*(9-side)) AS INTEGER) AS lft, CAST(unnest(range(64)) AS INTEGER) AS pos FROM s)
 SELECT w.chip, w.pos, px.red FROM w JOIN px ON px.chip=w.chip AND px.r=w.top+CAST(floor((w.pos//8+0.5)*side/8) AS INTEGER)
  AND px.c=w.lft+CAST(floor((w.pos%8+0.5)*side/8) AS INTEGER)""", "px"))
def augment_crop(spark, d):
    ch = augment.augment_crop(chip_arrays(spark, d).select("chip", "red"), "chip", 8, ["red"], epoch=3)
    return ch.select("chip", F.posexplode("red").alias("pos", "red"))


@query("augment_radiometric", with_(f""", u AS (SELECT vec_id AS chip, {DRAWS} FROM embeddings)
 SELECT chip, pos, round(least(greatest(CASE WHEN u0<0.8 THEN red/255.0::DOUBLE*(1.0+(u1*2-1)*0.15)+(u2*2-1)*0.05 ELSE red/255.0::DOUBLE END,0.0),1.0),6) AS red,
 round(nir/255.0::DOUBLE,6) AS nir FROM px JOIN u USING (chip)""", "px"))
def augment_radiometric(spark, d):
    ch = chip_arrays(spark, d).select("chip", *[F.transform(b, lambda x: x / 255.0).alias(b) for b in ("red", "nir")])
    return _unzip(augment.augment_radiometric(ch, "chip", ["red"], epoch=3), ["red", "nir"])


# ------------------------------------------------------------------ point clouds

@query("dtm_dsm_bin", with_("""SELECT CAST(floor(y/0.5) AS INTEGER) AS cy, CAST(floor(x/0.5) AS INTEGER) AS cx,
 min(z) FILTER (WHERE cls=2) AS dtm, max(z) FILTER (WHERE cls NOT IN (7,18)) AS dsm FROM pt GROUP BY 1,2""", "pt"))
def dtm_dsm_bin(spark, d):
    return points.grid_surfaces(X.points(spark, d), 0.5, "bin")


RADIUS = """, near AS (SELECT cy, cx, cls, z FROM (SELECT x,y,z,cls,cx,floor(y/0.5)+j AS cy FROM
  (SELECT *, floor(x/0.5)+i AS cx FROM pt, (VALUES (-2),(-1),(0),(1),(2)) a(i)), (VALUES (-2),(-1),(0),(1),(2)) b(j))
  WHERE (x-(cx+0.5)*0.5)*(x-(cx+0.5)*0.5)+(y-(cy+0.5)*0.5)*(y-(cy+0.5)*0.5)<=0.5),
 surf AS (SELECT CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, min(z) FILTER (WHERE cls=2) AS dtm,
  max(z) FILTER (WHERE cls NOT IN (7,18)) AS dsm FROM near GROUP BY ALL)
"""


@query("dtm_dsm_radius", with_(RADIUS + "SELECT cy,cx,dtm,dsm FROM surf", "pt"))
def dtm_dsm_radius(spark, d):
    return points.grid_surfaces(X.points(spark, d), 0.5, "radius")


@query("surface_as_written", with_("""SELECT CAST(floor(y/0.5) AS INTEGER) AS cy, CAST(floor(x/0.5) AS INTEGER) AS cx, max(z) AS dsm FROM pt GROUP BY 1,2""", "pt"))
def surface_as_written(spark, d):
    return points.grid_points(X.points(spark, d), 0.5, "dsm", "bin", noise_filter="as_written")


@query("chm", with_(RADIUS + """SELECT cy,cx,dsm,dtm,CASE WHEN dsm IS NOT NULL AND dtm IS NOT NULL THEN greatest(dsm-dtm,0.0) END AS chm
 FROM surf WHERE dsm IS NOT NULL OR dtm IS NOT NULL""", "pt"))
def chm(spark, d):
    pt = X.points(spark, d)
    out = raster.canopy_height(points.grid_points(pt, surface="dsm"), points.grid_points(pt, surface="dtm"))
    return out.select("cy", "cx", "dsm", "dtm", "chm")


GAP = """, cell AS (SELECT file, CAST(floor(y/0.5) AS INTEGER) AS cy, CAST(floor(x/0.5) AS INTEGER) AS cx, min(z) AS dtm FROM pt WHERE cls=2 GROUP BY ALL),
 box AS (SELECT file, min(cy) y0, max(cy) y1, min(cx) x0, max(cx) x1, count(*) AS nv FROM cell GROUP BY file),
 gr AS (SELECT file, nv, cy, CAST(unnest(range(x0,x1+1)) AS INTEGER) AS cx FROM (SELECT *, CAST(unnest(range(y0,y1+1)) AS INTEGER) AS cy FROM box)),
 g AS (SELECT gr.file, nv, gr.cy, gr.cx, dtm FROM gr LEFT JOIN cell ON gr.file=cell.file AND gr.cy=cell.cy AND gr.cx=cell.cx),
 w AS (SELECT *, last_value(dtm IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN dtm IS NOT NULL THEN cx END IGNORE NULLS) OVER a AS lp,
   first_value(dtm IGNORE NULLS) OVER b AS rv, first_value(CASE WHEN dtm IS NOT NULL THEN cx END IGNORE NULLS) OVER b AS rp,
   last_value(dtm IGNORE NULLS) OVER c AS tv, last_value(CASE WHEN dtm IS NOT NULL THEN cy END IGNORE NULLS) OVER c AS tp,
   first_value(dtm IGNORE NULLS) OVER e AS bv, first_value(CASE WHEN dtm IS NOT NULL THEN cy END IGNORE NULLS) OVER e AS bp
  FROM g WINDOW a AS (PARTITION BY file,cy ORDER BY cx ROWS UNBOUNDED PRECEDING),
   b AS (PARTITION BY file,cy ORDER BY cx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   c AS (PARTITION BY file,cx ORDER BY cy ROWS UNBOUNDED PRECEDING),
   e AS (PARTITION BY file,cx ORDER BY cy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 q AS (SELECT *, CASE WHEN rp>lp THEN 1.0::DOUBLE/(rp-lp) END AS wr, CASE WHEN bp>tp THEN 1.0::DOUBLE/(bp-tp) END AS wc,
   CASE WHEN rp>lp THEN lv+(rv-lv)*(cx-lp)::DOUBLE/(rp-lp) END AS er, CASE WHEN bp>tp THEN tv+(bv-tv)*(cy-tp)::DOUBLE/(bp-tp) END AS ec FROM w)
 SELECT file, cy, cx, round(CASE WHEN dtm IS NOT NULL THEN dtm WHEN nv>=100 AND (wr IS NOT NULL OR wc IS NOT NULL)
   THEN (coalesce(er*wr,0)+coalesce(ec*wc,0))/(coalesce(wr,0)+coalesce(wc,0)) END,6) AS dtm,
   dtm IS NULL AND nv>=100 AND (wr IS NOT NULL OR wc IS NOT NULL) AS filled FROM q"""


@query("gap_fill", with_(GAP, "pt"))
def gap_fill(spark, d):
    cells = points.grid_points(X.points(spark, d), surface="dtm", mode="bin", keys=("file",))
    return points.gap_fill(cells, "file", "dtm").withColumn("dtm", F.round("dtm", 6))


@query("cap_points", with_(f"""SELECT file, x, y, z, cls FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY h, x, y, z, cls) AS rn FROM
 (SELECT *, {order_key_sql("CAST(x*8+400*y*8+160000*z AS BIGINT)")} AS h FROM pt)) WHERE rn<=500""", "pt"))
def cap_points(spark, d):
    key = (F.col("x") * 8 + F.col("y") * 8 * 400 + F.col("z") * 160000).cast("bigint")
    return points.cap_per_group(X.points(spark, d), "file", key, 500, tie=("x", "y", "z", "cls")).select("file", "x", "y", "z", "cls")


@query("regrid_bilinear", with_(""", s AS (SELECT CAST(floor(y/0.5) AS INTEGER) AS r, CAST(floor(x/0.5) AS INTEGER) AS c, max(z) AS v
   FROM pt WHERE cls NOT IN (7,18) GROUP BY 1,2),
 t AS (SELECT *, floor(sx) AS c0, floor(sy) AS r0 FROM (SELECT CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col,
   0.3::DOUBLE/0.5*(j+0.5)-0.5 AS sx, 0.3::DOUBLE/0.5*(i+0.5)-0.5 AS sy FROM range(166) a(i), range(166) b(j))),
 n AS (SELECT row, col, r0+di AS r, c0+dj AS c, (1-abs(sx-(c0+dj)))*(1-abs(sy-(r0+di))) AS w FROM t, (VALUES (0),(1)) a(di), (VALUES (0),(1)) b(dj))
 SELECT row, col, round(sum(w*v)/sum(w),6) AS dsm FROM n JOIN s ON n.r=s.r AND n.c=s.c WHERE w>1e-12 GROUP BY row, col""", "pt"))
def regrid_bilinear(spark, d):
    cells = points.grid_points(X.points(spark, d), surface="dsm", mode="bin").withColumnsRenamed({"cy": "row", "cx": "col"})
    return raster.regrid(cells, "dsm", X.POINT_GRID, X.FINE_GRID).withColumn("dsm", F.round("dsm", 6))


def _regrid_crs_sql():
    """Gathered from the target's side: every pixel is projected into the zone and meets its four cells."""
    g, u = X.MERCATOR_GRID, X.UTM_GRID
    return with_(f""", s AS (SELECT CAST(floor(y/0.5) AS INTEGER) AS r, CAST(floor(x/0.5) AS INTEGER) AS c, max(z) AS v
   FROM pt WHERE cls NOT IN (7,18) GROUP BY 1,2),
 g AS (SELECT CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, {X.mercator_angles(f'{g.c}+{g.a}*(j+0.5)', f'{g.f}+{g.e}*(i+0.5)')}
   FROM range({g.height}) a(i), range({g.width}) b(j)), {X.utm_ctes('g', 'p')},
 t AS (SELECT row, col, sx, sy, floor(sx) AS c0, floor(sy) AS r0 FROM (SELECT row, col, (east-{u.c})/{u.a}-0.5 AS sx,
   (north-{u.f})/{u.e}-0.5 AS sy FROM p) WHERE sx BETWEEN -0.5 AND {u.width}-0.5 AND sy BETWEEN -0.5 AND {u.height}-0.5),
 n AS (SELECT row, col, r0+di AS r, c0+dj AS c, (1-abs(sx-(c0+dj)))*(1-abs(sy-(r0+di))) AS w FROM t, (VALUES (0),(1)) a(di), (VALUES (0),(1)) b(dj))
 SELECT row, col, round(sum(w*v)/sum(w),1) AS dsm FROM n JOIN s ON n.r=s.r AND n.c=s.c WHERE w>0 GROUP BY row, col""", "pt")


@query("regrid_crs", _regrid_crs_sql())
def regrid_crs(spark, d):
    """Surface cells of a UTM zone on a web Mercator grid, which lies turned against it."""
    cells = points.grid_points(X.points(spark, d), surface="dsm", mode="bin").withColumnsRenamed({"cy": "row", "cx": "col"})
    done = raster.regrid_crs(cells, "dsm", X.UTM_GRID, X.UTM_CODE, X.MERCATOR_GRID, X.MERCATOR_CODE)
    return done.withColumn("dsm", F.round("dsm", 1))


@query("mosaic", with_("""SELECT CAST(floor(y/1.5) AS INTEGER) AS row, CAST(floor(x/1.5) AS INTEGER) AS col, arg_max(z, o) AS z FROM (
  SELECT x,y,z, (CASE file WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)*1000000000000 + CAST(x*8+400*y*8+160000*z AS BIGINT)*10+cls AS o FROM pt
  ) GROUP BY 1,2""", "pt"))
def mosaic(spark, d):
    order = (F.when(F.col("file") == "A", 0).when(F.col("file") == "N", 1).otherwise(2) * 1000000000000
             + (F.col("x") * 8 + F.col("y") * 8 * 400 + F.col("z") * 160000).cast("bigint") * 10 + F.col("cls"))
    pt = X.points(spark, d).withColumn("o", order)
    grid = raster.Grid(1.5, 1.5, 0.0, 0.0, 34, 34)
    return raster.mosaic(raster.snap(pt, "x", "y", grid), "z", "o")


# ------------------------------------------------------------------ labels per chip

COVER_MASK = """, top AS (SELECT row, col, arg_max(code, seq) AS code, bool_or(code=1) AS tree FROM cover WHERE code BETWEEN 1 AND 7 GROUP BY row, col),
 m AS (SELECT px.chip, px.row, px.col, CAST(CASE WHEN top.code=5 AND tree THEN 0 ELSE coalesce(top.code-1,255) END AS INTEGER) AS mask,
   coalesce(top.code=5 AND tree, FALSE) AS flipped FROM px LEFT JOIN top ON px.row=top.row AND px.col=top.col)
"""


def label_mask(spark, d, override=True):
    usable, _ = layers.validate_codes(X.features(spark, d))
    grid = X.pixels(spark, d).select("chip", "row", "col", "red", "nir")
    return vector.rasterize(vector.hygiene(usable), grid, width=X.MOSAIC_COLS, tree_over_building=override)


@query("rasterize", with_(COVER_MASK.replace("CASE WHEN top.code=5 AND tree THEN 0 ELSE coalesce(top.code-1,255) END", "coalesce(top.code-1,255)")
                          + "SELECT row,col,mask FROM m", "px", "cover"))
def rasterize(spark, d):
    return label_mask(spark, d, override=False).select("row", "col", "mask")


@query("tree_over_building", with_(COVER_MASK + """SELECT mask, count(*) AS n, count(*) FILTER (WHERE flipped) AS n_flipped,
 round(count(*) FILTER (WHERE flipped)/CAST(count(*) AS DOUBLE),9) AS flip_share FROM m GROUP BY mask""", "px", "cover"))
def tree_over_building(spark, d):
    flips = F.count(F.when(F.col("flipped"), 1))
    return label_mask(spark, d).groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), flips.alias("n_flipped"), F.round(flips / F.count(F.lit(1)), 9).alias("flip_share"))


@query("labeled_frac", with_(COVER_MASK + """SELECT chip, f AS labeled_frac, f>=0.01 AS kept FROM
 (SELECT chip, avg(CASE WHEN mask<>255 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM m GROUP BY chip)""", "px", "cover"))
def labeled_frac(spark, d):
    return sampling.labeled_share(label_mask(spark, d), ["chip"], limit=LABELED_SHARE_MIN)


@query("class_balance", with_(COVER_MASK + """, kept AS (SELECT m.*, (row%8)//4*2+(col%8)//4 AS q FROM m),
 sized AS (SELECT 8 AS size, mask FROM kept WHERE chip IN (SELECT chip FROM kept GROUP BY chip HAVING avg(CASE WHEN mask<>255 THEN 1 ELSE 0 END)>=0.01)
  UNION ALL SELECT 4, mask FROM kept WHERE (chip,q) IN (SELECT (chip,q) FROM kept GROUP BY chip,q HAVING avg(CASE WHEN mask<>255 THEN 1 ELSE 0 END)>=0.01)),
 n AS (SELECT s.size, CAST(c.i AS INTEGER) AS cls, (SELECT count(*) FROM sized WHERE sized.size=s.size AND mask=c.i) AS n FROM (VALUES (8),(4)) s(size), range(7) c(i))
 SELECT size, cls, n, round(n/CAST(sum(n) OVER (PARTITION BY size) AS DOUBLE),9) AS frac FROM n""", "px", "cover"))
def class_balance(spark, d):
    m = label_mask(spark, d)
    sizes = F.explode(F.array(F.lit(8), F.lit(4))).alias("size")
    both = m.select("chip", "row", "col", "mask", sizes).withColumn(
        "crop", F.when(F.col("size") == 8, 0).otherwise(F.floor((F.col("row") % 8) / 4) * 2 + F.floor((F.col("col") % 8) / 4)))
    # counts per chip first: the share test and the totals then work on one row per chip
    wide = both.groupBy("size", "chip", "crop").agg(
        F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col("mask") == i, 1)).alias(f"n{i}") for i in range(7)])
    labeled = sum((F.col(f"n{i}") for i in range(7)), F.lit(0))
    kept = wide.where(labeled / F.col("all") >= LABELED_SHARE_MIN).groupBy("size").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(7)])
    rows = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(f"n{i}").alias("n")) for i in range(7)])
    return kept.select("size", labeled.alias("t"), F.explode(rows).alias("x")).select(
        "size", "x.cls", "x.n", F.round(F.try_divide("x.n", "t"), 9).alias("frac"))
