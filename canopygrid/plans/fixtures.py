"""Rasters, points, vectors and logs derived from the given tables.

Each builder reads a whole table and has a SQL twin in ``CTES`` that derives the same
rows. Only integer arithmetic and doubles are used.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.functions import geometry as G
from canopygrid.operators.ranking import row_number_in
from canopygrid.operators.raster import Grid
from canopygrid.session import shared_dir

CHIP = 8
MOSAIC_COLS = 200
SCENE_ROWS = 32  # a scene is a hundred chips of the mosaic; the last one may lack some of them
# Concave test boundary in the mosaic plane.
BOUNDARY = ((10, 10), (190, 10), (190, 70), (100, 70), (100, 110), (190, 110), (190, 150), (10, 150))
BANDS = ["red", "green", "blue", "nir"]
POINT_GRID = Grid(0.5, 0.5, 0.0, 0.0, 100, 100)
FINE_GRID = Grid(0.3, 0.3, 0.0, 0.0, 166, 166)
# The point grid placed in UTM zone 12, and a web Mercator grid over the same ground.
UTM_CODE, MERCATOR_CODE = 6341, 3857
UTM_GRID = Grid(0.5, 0.5, 400000.0, 3700000.0, 100, 100)
MERCATOR_GRID = Grid(0.4, 0.4, -12476220.0, 3953148.0, 160, 160)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _idiv(c, n: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / n)


def chips(spark: SparkSession, d: str) -> DataFrame:
    """One 8x8 chip per vector: chip, label, v (64 floats, row-major)."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chip"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Imagery pixels with canopy height on one mosaic plane of 200 columns."""
    e = chips(spark, d).select("chip", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    r, c = _idiv("pos", 8).cast("int"), F.col("pos") % 8
    at = lambda k: F.get("v", (F.col("pos") + k) % 64).cast("double")
    black = (F.col("chip") % 11 == 0) & (c < 2)
    band = lambda k, o: F.when(black, 0).otherwise(F.floor((at(k) + o) * 200).cast("int"))
    return e.select(
        "chip", "label", "pos", r.alias("r"), c.alias("c"),
        (_idiv("chip", 25) * 8 + r).cast("int").alias("row"), ((F.col("chip") % 25) * 8 + c).cast("int").alias("col"),
        band(0, 0.55).alias("red"), band(16, 0.55).alias("green"), band(48, 0.55).alias("blue"),
        band(32, 0.75).alias("nir"),
        F.when((F.col("chip") * 64 + F.col("pos")) % 29 != 0, F.greatest(at(8), F.lit(0.0)) * 12).alias("chm"),
        F.concat(F.lit("m_"), _idiv("chip", 100).cast("string")).alias("scene"),
    )


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Extent of each scene, whether or not all of its chips are there."""
    scene = F.concat(F.lit("m_"), _idiv("chip", 100).cast("string"))
    return chips(spark, d).select(scene.alias("scene")).distinct().select(
        "scene", F.lit(MOSAIC_COLS).alias("width"), F.lit(SCENE_ROWS).alias("height"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Point returns: class 2 is ground, 7 is noise."""
    return table(spark, d, "lineitem").select(
        ((F.col("l_partkey") % 400) / 8.0).alias("x"), ((F.col("l_orderkey") % 400) / 8.0).alias("y"),
        F.col("l_quantity").alias("z"), F.col("l_linenumber").cast("int").alias("cls"),
        F.col("l_returnflag").alias("file"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Label polygons: rectangles and triangles, some with invalid or missing codes."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        k.alias("fid"), k.alias("seq"), "p_brand",
        F.when(k % 97 != 0, (F.col("p_size") % 9).cast("int")).alias("code"),
        ((k * 37) % 200).cast("double").alias("xmin"), ((k * 53) % 160).cast("double").alias("ymin"),
        (1 + F.col("p_size") % 7).cast("double").alias("w"), (1 + k % 5).cast("double").alias("h"),
        (k % 60 + 1).cast("int").alias("patch_id"), (k % 3 == 0).alias("tri"))
    x0, y0, x1, y1 = F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")
    tri = F.array(G.point(x0, y0), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0))
    return p.withColumns({"xmax": x1, "ymax": y1,
                          "ring": F.when(F.col("tri"), tri).otherwise(G.box_ring(x0, y0, x1, y1))})


def roads(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("fid"), ((s * 17) % 200).cast("double").alias("x1"), F.lit(0.0).alias("y1"),
        ((s * 29) % 200).cast("double").alias("x2"), F.lit(160.0).alias("y2"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    x0, y0 = (F.col("o_orderkey") * 7) % 190, (F.col("o_custkey") * 3) % 150
    return o.select(
        F.col("o_orderkey").alias("fid"), x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"),
        (x0 + 2 + F.col("o_orderkey") % 6).cast("double").alias("xmax"),
        (y0 + 2 + F.col("o_custkey") % 5).cast("double").alias("ymax"),
        (F.col("o_totalprice") / 500000.0).alias("score"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Truth, prediction and class probabilities per row."""
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_partkey") % 10 == 0, 255).otherwise(F.col("l_linenumber") - 1).cast("int").alias("truth"),
        F.when(F.col("l_quantity") < 30, F.col("l_linenumber") - 1).otherwise(F.col("l_suppkey") % 7)
        .cast("int").alias("pred"))
    return li.withColumn("probs", F.array(*[F.when(F.col("pred") == i, 0.7).otherwise(0.05) for i in range(7)]))


RUN = ["arch", "init", "patch", "seed"]


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Epoch log per run; the epoch number is a two-level rank in time order."""
    u = F.col("user_id")
    e = table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("arch"), (u % 4).cast("int").alias("init"),
        F.when(u % 2 == 0, 128).otherwise(256).alias("patch"), (u % 3 + 1).cast("int").alias("seed"),
        F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 600).alias("miou"),
        (F.col("value") % 1).alias("shrub"))
    return row_number_in(e, RUN, F.date_trunc("day", "ts"), ["ts", "event_id"], "epoch")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run records: one per event, newest path wins; some cannot be read."""
    u, i = F.col("user_id"), F.col("event_id")
    base = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("arch"), (u % 4).cast("int").alias("init"),
        F.when(u % 2 == 0, 128).otherwise(256).alias("patch"), (u % 3 + 1).cast("int").alias("seed"),
        F.when(i % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 600).alias("miou"),
        (i % 23 != 0).alias("readable"))
    path = F.concat_ws("/", "arch", F.col("init").cast("string"), F.col("seed").cast("string"),
                       F.lpad(i.cast("string"), 12, "0"))
    return base.withColumn("path", path)


def status_log(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 10
    return table(spark, d, "events").select(
        "event_id", F.when(m <= 6, "ok").when(m <= 8, "skip").otherwise("fail").alias("status"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as file paths; every fourth also appears in upper case."""
    p = table(spark, d, "pages").select("page_id", "url")
    both = F.when(F.col("page_id") % 4 == 0, F.array(F.col("url"), F.upper("url"))).otherwise(F.array("url"))
    return p.select("page_id", F.explode(both).alias("path"))


def boundary(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("fid"), G.literal_ring(BOUNDARY).alias("ring"))


def stored(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_made: dict[tuple[str, str, str], str] = {}


def made_once(spark: SparkSession, d: str, kind: str, write) -> str:
    """A stored table derived from the folder ``d``, written by the first query of the session that reads it."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _made:
        path = stored(spark, kind)
        write(path)
        _made[key] = path
    return _made[key]


def truncate(spark: SparkSession, folder: str, keep: float = 0.5) -> None:
    """Damage: cut every Parquet file of a folder to a part of its length."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(folder)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(home):
        path = status.getPath()
        if not path.getName().endswith(".parquet"):
            continue
        stream = fs.open(path)
        head = stream.readNBytes(int(status.getLen() * keep))
        stream.close()
        out = fs.create(path, True)
        out.write(head)
        out.close()


CTES = {
    "px": """px AS (
  SELECT chip, label, pos, r, c, CAST((chip//25)*8 + r AS INTEGER) AS row, CAST((chip%25)*8 + c AS INTEGER) AS col,
    CASE WHEN black THEN 0 ELSE CAST(floor((CAST(v[pos+1] AS DOUBLE)+0.55)*200) AS INTEGER) END AS red,
    CASE WHEN black THEN 0 ELSE CAST(floor((CAST(v[(pos+16)%64+1] AS DOUBLE)+0.55)*200) AS INTEGER) END AS green,
    CASE WHEN black THEN 0 ELSE CAST(floor((CAST(v[(pos+48)%64+1] AS DOUBLE)+0.55)*200) AS INTEGER) END AS blue,
    CASE WHEN black THEN 0 ELSE CAST(floor((CAST(v[(pos+32)%64+1] AS DOUBLE)+0.75)*200) AS INTEGER) END AS nir,
    CASE WHEN (chip*64+pos)%29 <> 0 THEN greatest(CAST(v[(pos+8)%64+1] AS DOUBLE), 0.0)*12 END AS chm,
    'm_' || CAST(chip//100 AS VARCHAR) AS scene
  FROM (SELECT *, CAST(pos//8 AS INTEGER) AS r, CAST(pos%8 AS INTEGER) AS c, (chip%11=0 AND pos%8<2) AS black
        FROM (SELECT vec_id AS chip, CAST(label AS INTEGER) AS label, embedding AS v, CAST(unnest(range(64)) AS INTEGER) AS pos
              FROM embeddings)))""",
    "ndvi": """ndvi AS (SELECT *, CASE WHEN nir+red > 0 THEN CAST(nir-red AS DOUBLE)/(nir+red) END AS ndvi FROM px)""",
    "pt": """pt AS (SELECT (l_partkey%400)/8.0::DOUBLE AS x, (l_orderkey%400)/8.0::DOUBLE AS y, l_quantity AS z,
    CAST(l_linenumber AS INTEGER) AS cls, l_returnflag AS file FROM lineitem)""",
    "ft": """ft AS (SELECT *, xmin+w AS xmax, ymin+h AS ymax FROM (
    SELECT p_partkey AS fid, p_partkey AS seq, p_brand,
      CASE WHEN p_partkey%97 <> 0 THEN CAST(p_size%9 AS INTEGER) END AS code,
      CAST((p_partkey*37)%200 AS DOUBLE) AS xmin, CAST((p_partkey*53)%160 AS DOUBLE) AS ymin,
      CAST(1+p_size%7 AS DOUBLE) AS w, CAST(1+p_partkey%5 AS DOUBLE) AS h,
      CAST(p_partkey%60+1 AS INTEGER) AS patch_id, p_partkey%3=0 AS tri FROM part))""",
    # covered pixels of each feature by the pixel-centre rule
    "cover": """cover AS (SELECT fid, seq, code, row, col FROM (
    SELECT *, unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS col FROM (
      SELECT *, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS row FROM ft))
    WHERE NOT tri OR col+0.5 < xmax + (row+0.5-ymin)*(xmin-xmax)/(ymax-ymin))""",
    "det": """det AS (SELECT o_orderkey AS fid, CAST((o_orderkey*7)%190 AS DOUBLE) AS xmin, CAST((o_custkey*3)%150 AS DOUBLE) AS ymin,
    CAST((o_orderkey*7)%190+2+o_orderkey%6 AS DOUBLE) AS xmax, CAST((o_custkey*3)%150+2+o_custkey%5 AS DOUBLE) AS ymax,
    o_totalprice/500000.0::DOUBLE AS score FROM orders)""",
    "road": """road AS (SELECT s_suppkey AS fid, CAST((s_suppkey*17)%200 AS DOUBLE) AS x1, 0.0::DOUBLE AS y1,
    CAST((s_suppkey*29)%200 AS DOUBLE) AS x2, 160.0::DOUBLE AS y2 FROM supplier)""",
    "sc": """sc AS (SELECT CAST(CASE WHEN l_partkey%10=0 THEN 255 ELSE l_linenumber-1 END AS INTEGER) AS truth,
    CAST(CASE WHEN l_quantity<30 THEN l_linenumber-1 ELSE l_suppkey%7 END AS INTEGER) AS pred FROM lineitem)""",
    "ep": """ep AS (SELECT *, row_number() OVER (PARTITION BY arch,init,patch,seed ORDER BY ts,event_id) AS epoch FROM (
    SELECT event_id, ts, event_type AS arch, CAST(user_id%4 AS INTEGER) AS init,
      CASE WHEN user_id%2=0 THEN 128 ELSE 256 END AS patch, CAST(user_id%3+1 AS INTEGER) AS seed,
      CASE WHEN event_id%50=0 THEN 'nan'::DOUBLE ELSE value/600 END AS miou, value%1 AS shrub FROM events))""",
    "runs": """runs AS (SELECT *, arch||'/'||CAST(init AS VARCHAR)||'/'||CAST(seed AS VARCHAR)||'/'||lpad(CAST(event_id AS VARCHAR),12,'0') AS path FROM (
    SELECT event_id, event_type AS arch, CAST(user_id%4 AS INTEGER) AS init,
      CASE WHEN user_id%2=0 THEN 128 ELSE 256 END AS patch, CAST(user_id%3+1 AS INTEGER) AS seed,
      CASE WHEN event_id%50=0 THEN 'nan'::DOUBLE ELSE value/600 END AS miou, event_id%23<>0 AS readable FROM events))""",
    "st": """st AS (SELECT event_id, CASE WHEN event_id%10<=6 THEN 'ok' WHEN event_id%10<=8 THEN 'skip' ELSE 'fail' END AS status FROM events)""",
    "pa": """pa AS (SELECT page_id, url AS path FROM pages UNION ALL SELECT page_id, upper(url) FROM pages WHERE page_id%4=0)""",
    # boundary rectangles: the concave ring is three boxes
    "inb": """inb(x0,x1,y0,y1) AS (VALUES (10.0,190.0,10.0,70.0),(10.0,100.0,70.0,110.0),(10.0,190.0,110.0,150.0))""",
}
NEEDS = {"ndvi": ["px"], "cover": ["ft"]}


def utm_ctes(src: str, dst: str) -> str:
    """SQL of ``to_utm``: ``src`` has lam (radians from the central meridian) and sp (sine of the latitude);
    ``dst`` adds east and north."""
    n = 1 / (2 * 298.257222101 - 1)
    r = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    k = 2 * math.sqrt(n) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    more = lambda f, h: "".join(f"+({a!r}::DOUBLE)*{f}({2 * j}*xi)*{h}({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    return f"""{dst}_h AS (SELECT *, sinh(atanh(sp)-{k!r}::DOUBLE*atanh({k!r}::DOUBLE*sp)) AS tt FROM {src}),
 {dst}_q AS (SELECT *, atan2(tt,cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+tt*tt)) AS eta FROM {dst}_h),
 {dst} AS (SELECT *, 500000+{r!r}::DOUBLE*(eta{more('cos', 'sinh')}) AS east, {r!r}::DOUBLE*(xi{more('sin', 'cosh')}) AS north FROM {dst}_q)"""


def mercator_angles(x: str, y: str) -> str:
    """SQL of a web Mercator position as ``utm_ctes`` wants it, in zone 12."""
    return f"({x})/6378137.0::DOUBLE-radians(-111.0::DOUBLE) AS lam, sin(2*atan(exp(({y})/6378137.0::DOUBLE))-pi()/2) AS sp"


def with_(body: str, *names: str, recursive: bool = False) -> str:
    """SQL text: the named CTEs and what they need, then ``body``."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    head = "WITH " + ("RECURSIVE " if recursive else "")
    ctes = ",\n".join(CTES[n] for n in order)
    body = body.strip()
    if body.startswith(","):
        return head + ctes + body
    return head + ctes + "\n" + body
