"""Repair and clipping of polygon rings.

Repair makes the even-odd area of a feature's rings into rings that cross neither themselves nor each other:
edges that meet are cut at the places where they do (noding, an equi-join on cells), what is left an
odd number of times bounds the area, every piece is directed with the area on its left, and at each node
the boundary goes on with the next piece clockwise. The pieces then form cycles, which pointer jumping
puts in order. Only features whose edges do meet go this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopygrid.functions import geometry as G
from canopygrid.functions.arrays import let
from canopygrid.operators.cover import edge_cells
from canopygrid.operators.rings import rank_cycles
from canopygrid.session import cut_lineage

END = ("x1", "y1", "x2", "y2")


# ---------------------------------------------------------------- clipping

def clip_ring(ring, xmin, ymin, xmax, ymax) -> Column:
    """Part of a closed ring inside a box: a fold over the box's four half-planes.

    Each half-plane keeps the vertices on its side and adds the places where an edge leaves or enters. A concave ring that falls
    apart stays one ring whose parts hang together along the box; ``repair_rings`` parts them. Empty where nothing is left.
    """
    col = lambda v: F.col(v) if isinstance(v, str) else F.lit(v) if isinstance(v, (int, float)) else v
    plane = lambda nx, ny, d: F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), d.cast("double").alias("d"))
    planes = F.array(plane(-1.0, 0.0, -col(xmin)), plane(1.0, 0.0, col(xmax)), plane(0.0, -1.0, -col(ymin)), plane(0.0, 1.0, col(ymax)))

    def clip(acc: Column, h: Column) -> Column:
        def edge(e: Column) -> Column:
            return let(F.struct(e["a"].alias("a"), e["b"].alias("b"), side(e["a"]).alias("sa"), side(e["b"]).alias("sb")), part)

        def side(p: Column) -> Column:
            return h["d"] - h["nx"] * p["x"] - h["ny"] * p["y"]

        def part(e: Column) -> Column:
            a, b, sa, sb = e["a"], e["b"], e["sa"], e["sb"]
            at = lambda n, f: F.when(h[n] != 0, h["d"] * h[n]).otherwise(a[f] + (b[f] - a[f]) * F.try_divide(sa, sa - sb))
            cut = F.struct(at("nx", "x").alias("x"), at("ny", "y").alias("y"))
            return (F.when((sa >= 0) & (sb >= 0), F.array(b)).when((sa > 0) & (sb < 0), F.array(cut))
                    .when((sa < 0) & (sb > 0), F.array(cut, b)).when((sa < 0) & (sb == 0), F.array(b)).otherwise(F.slice(F.array(b), 1, 0)))

        return let(F.flatten(F.transform(G.edges(acc), edge)), lambda left: F.concat(left, F.slice(left, 1, 1)))

    return F.aggregate(planes, G._col(ring), clip)


def clip_rings(ft: DataFrame, ring: str = "ring", box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Features clipped to the box in their own row; those of which no area is left go. Other columns stay.

    Rows are dealt anew, because few files can hold very many of them, and a box without area is left out before.
    The clipped ring leaves a one-element explode, so that it is made once: a filter or a projection above
    it was written out with the whole fold in each of its terms.
    """
    xmin, ymin, xmax, ymax = (F.col(c) for c in box)
    tasks = int(ft.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ft = ft.where((xmin < xmax) & (ymin < ymax)).repartition(tasks)
    others = [F.col(c) for c in ft.columns if c != ring]
    done = ft.select(*others, F.explode(F.array(clip_ring(ring, *box))).alias(ring)).select(*ft.columns)
    return done.where(G.is_usable(ring))


# ---------------------------------------------------------------- repair

def _edges(ft: DataFrame, keys: list[str], ring: str, digits: int) -> DataFrame:
    e = ft.select(*keys, F.explode(G.edges(ring)).alias("_e"))
    r = lambda p, f: F.round(F.col(f"_e.{p}.{f}"), digits) + 0.0
    e = e.select(*keys, r("a", "x").alias("x1"), r("a", "y").alias("y1"), r("b", "x").alias("x2"), r("b", "y").alias("y2"))
    return e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).withColumn("_id", F.monotonically_increasing_id())


def _meetings(e: DataFrame, keys: list[str], cell: float, digits: int) -> DataFrame:
    """``_id, x, y``: inner places of an edge where another of the same feature crosses, touches or overlaps it."""
    c = edge_cells(e, cell)
    f = c.select(*keys, "_cx", "_cy", *[F.col(n).alias(f"_{n}") for n in END], F.col("_id").alias("_other"))
    pairs = c.join(f, [*keys, "_cx", "_cy"]).where(F.col("_id") < F.col("_other"))
    px, py, rx, ry = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    qx, qy, sx, sy = F.col("_x1"), F.col("_y1"), F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    d = rx * sy - ry * sx
    near = lambda v: F.when(F.abs(v) < 1e-12, F.lit(0.0)).when(F.abs(v - 1) < 1e-12, F.lit(1.0)).otherwise(v)
    t, u = near(F.try_divide((qx - px) * sy - (qy - py) * sx, d)), near(F.try_divide((qx - px) * ry - (qy - py) * rx, d))
    apart = (qx - px) * ry - (qy - py) * rx
    point = lambda x, y: F.struct((F.round(x, digits) + 0.0).alias("x"), (F.round(y, digits) + 0.0).alias("y"))
    ends = {n: point(F.col(x), F.col(y)) for n, x, y in (("p1", "x1", "y1"), ("p2", "x2", "y2"), ("q1", "_x1", "_y1"), ("q2", "_x2", "_y2"))}
    # a place that is the end of either edge keeps that end's coordinates
    meet = (F.when(t == 0, ends["p1"]).when(t == 1, ends["p2"]).when(u == 0, ends["q1"]).when(u == 1, ends["q2"])
            .otherwise(point(px + rx * t, py + ry * t)))
    both = (d != 0) & t.between(0, 1) & u.between(0, 1)
    hit = lambda i, cond, p: F.when(cond, F.struct(F.col(i).alias("_id"), p.alias("p")))
    along = lambda x, y, ox, oy, ux, uy: F.try_divide((x - ox) * ux + (y - oy) * uy, ux * ux + uy * uy)
    level = (d == 0) & (apart == 0)
    inner = lambda v: (v > 0) & (v < 1)
    found = F.array(
        hit("_id", both & inner(t), meet), hit("_other", both & inner(u), meet),
        hit("_id", level & inner(along(qx, qy, px, py, rx, ry)), ends["q1"]),
        hit("_id", level & inner(along(F.col("_x2"), F.col("_y2"), px, py, rx, ry)), ends["q2"]),
        hit("_other", level & inner(along(px, py, qx, qy, sx, sy)), ends["p1"]),
        hit("_other", level & inner(along(F.col("x2"), F.col("y2"), qx, qy, sx, sy)), ends["p2"]))
    same = (px == qx) & (py == qy) & (F.col("x2") == F.col("_x2")) & (F.col("y2") == F.col("_y2"))
    turned = (px == F.col("_x2")) & (py == F.col("_y2")) & (F.col("x2") == qx) & (F.col("y2") == qy)
    twice = F.array(hit("_id", same | turned, ends["p1"]))  # an edge that is there twice only marks its feature
    each = pairs.select(*keys, F.explode(F.filter(F.concat(found, twice), lambda h: h.isNotNull())).alias("h"))
    return each.select(*keys, "h._id", "h.p").distinct()


def _noded(e: DataFrame, meetings: DataFrame, keys: list[str]) -> DataFrame:
    """Edges cut at their meetings, undirected, with those kept that are there an odd number of times."""
    at = meetings.groupBy("_id").agg(F.collect_set("p").alias("_cuts"))
    place = lambda p: F.abs(p["x"] - F.col("x1")) + F.abs(p["y"] - F.col("y1"))
    ordered = F.transform(F.array_sort(F.transform(F.coalesce("_cuts", F.array()), lambda p: F.struct(place(p).alias("d"), p.alias("p")))), lambda s: s["p"])
    end = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    parts = e.join(at, "_id", "left").withColumn("_ring", F.concat(end("x1", "y1"), ordered, end("x2", "y2")))
    parts = parts.select(*keys, F.explode(G.edges("_ring")).alias("_e")).where(F.col("_e.a") != F.col("_e.b"))
    low, high = F.least(F.col("_e.a"), F.col("_e.b")), F.greatest(F.col("_e.a"), F.col("_e.b"))
    once = parts.groupBy(*keys, low.alias("a"), high.alias("b")).agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    return once.select(*keys, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def _area_beyond(ask: DataFrame, pieces: DataFrame, keys: list[str], cell: float, across: str, along: str, name: str) -> DataFrame:
    """``_piece`` and whether the area lies beyond its middle in the direction of ``across``: the number of pieces
    there is odd. Pieces meet by bands of ``along``; level ones count for nothing."""
    a1, a2, c1, c2 = F.col(f"{along}1"), F.col(f"{along}2"), F.col(f"{across}1"), F.col(f"{across}2")
    low, high = F.least(a1, a2), F.greatest(a1, a2)
    others = pieces.where(a1 != a2).select(
        *keys, low.alias("_low"), high.alias("_high"), c1.alias("_c1"), a1.alias("_a1"), F.try_divide(c2 - c1, a2 - a1).alias("_slope"),
        F.col("_piece").alias("_other"), F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("_band"))
    middle = ask.select(*keys, "_piece", ((a1 + a2) / 2).alias("_m"), ((c1 + c2) / 2).alias("_at")).withColumn("_band", F.floor(F.col("_m") / cell))
    hit = ((F.col("_low") <= F.col("_m")) & (F.col("_m") < F.col("_high")) & (F.col("_piece") != F.col("_other"))
           & (F.col("_c1") + (F.col("_m") - F.col("_a1")) * F.col("_slope") > F.col("_at")))
    return middle.join(others, [*keys, "_band"]).groupBy("_piece").agg((F.sum(hit.cast("int")) % 2 == 1).alias(name))


def _directed(pieces: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pieces with the area on their left (y upwards); ``head`` is their number."""
    level = F.col("y1") == F.col("y2")
    right = _area_beyond(pieces.where(~level), pieces, keys, cell, "x", "y", "_right")
    above = _area_beyond(pieces.where(level), pieces, keys, cell, "y", "x", "_above")
    both = pieces.join(right, "_piece", "left").join(above, "_piece", "left")
    side = lambda c: F.coalesce(F.col(c), F.lit(False))
    # a piece that rises has the area on its left if there is none to its right, one to the right if there is some above
    turn = F.when(level, ~side("_above")).otherwise((F.col("y2") > F.col("y1")) == side("_right"))
    pick = lambda a, b, n: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(n)
    return both.select(*keys, F.col("_piece").alias("head"), pick("x1", "x2", "x1"), pick("y1", "y2", "y1"),
                       pick("x2", "x1", "x2"), pick("y2", "y1", "y2"))


def _followed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(head, next): at its end a piece goes on with the next one clockwise from where it came, so that parts that
    touch at a node stay apart."""
    leaving = pieces.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"),
                            F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("_angle"), F.col("head").alias("_out"), F.lit(None).cast("long").alias("head"))
    coming = pieces.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"),
                           F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("_angle"), F.lit(None).cast("long").alias("_out"), "head")
    w = W.partitionBy(*keys, "x", "y").orderBy("_angle")
    before = F.last("_out", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    last = F.last("_out", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return leaving.unionByName(coming).withColumn("next", F.coalesce(before, last)).where(F.col("head").isNotNull()).select("head", "next")


def repair_rings(ft: DataFrame, keys: list[str], ring: str = "ring", cell: float = 16.0, digits: int = 7) -> DataFrame:
    """``keys, ring, repaired``: rings that cover what each feature's rings cover by the even-odd rule, without crossings.

    A feature is all rows of one ``keys`` value. If none of its edges meets another but at their ends, its usable rings stay as
    they are. Otherwise its rings are made anew: outer ones counter-clockwise (y upwards), holes clockwise, each from its least
    vertex on, parts that touch at a node apart; areas covered an even number of times are left out. Coordinates are
    rounded to ``digits``. ``cell`` is the size of the cells in which edges meet, in map units: a few edge lengths. Features with
    null keys or rings, or rings without area, give nothing unless another ring of theirs remains.
    """
    src = ft.select(*keys, F.col(ring).alias("ring")).where(F.col("ring").isNotNull()).dropna(subset=keys)
    edges = cut_lineage(_edges(src, keys, "ring", digits))
    meetings = cut_lineage(_meetings(edges, keys, cell, digits))
    broken = meetings.select(*keys).distinct()
    sound = src.join(broken, keys, "left_anti").where(G.is_usable("ring")).withColumn("repaired", F.lit(False))
    torn = edges.join(broken, keys, "left_semi")
    pieces = cut_lineage(_noded(torn, meetings, keys).withColumn("_piece", F.monotonically_increasing_id()))
    directed = cut_lineage(_directed(pieces, keys, cell))
    ranked = rank_cycles(_followed(directed, keys)).withColumnRenamed("ring", "_ring")
    part = F.struct((F.col("place") != 0).alias("later"), "place", F.struct("x1", "y1").alias("p"))
    rings = directed.join(ranked, "head").groupBy(*keys, "_ring").agg(F.sort_array(F.collect_list(part)).alias("_v"))
    rings = rings.withColumn("_v", F.transform("_v", lambda v: F.struct(v["p"]["x1"].alias("x"), v["p"]["y1"].alias("y"))))
    first = F.array_position("_v", F.array_min("_v")).cast("int")
    made = rings.select(*keys, F.concat(F.slice("_v", first, F.size("_v")), F.slice("_v", F.lit(1), first)).alias("ring"), F.lit(True).alias("repaired"))
    return sound.unionByName(made.where(G.is_usable("ring"))).withColumnRenamed("ring", ring)
