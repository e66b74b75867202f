"""Point in polygon by a quadtree cover: inner cells need no test, edge cells only their own edges.

Cells of a few sizes cover each polygon. A large cell that no edge crosses is inner or outer as a whole; the
others are split, down to the smallest size. Which is which follows from sorted crossings along the middle
line of each row of cells, so it costs what the perimeter costs, not the area. A point looks up the cell that holds it at
every size. In a smallest cell with edges it is reached from the cell's corner, whose side is known, by a path
inside the cell: only the cell's own edges can be crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Cells begin at an odd fraction of the smallest size, so that corners and middle lines pass no vertex of round coordinates.
SHIFT_X, SHIFT_Y = 0.38196601125010515, 0.23606797749978969
FACTOR, LEVELS = 8, 3


def edge_cells(e: DataFrame, size: float, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Edges (x1, y1)-(x2, y2) in every cell (_cx, _cy) they pass: column by column, with the rows passed there."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ox, oy = shift
    cell = lambda v, o: F.floor((v - o) / size)
    eps = size * 1e-9
    e = e.withColumn("_cx", F.explode(F.sequence(cell(F.least(x1, x2) - eps, ox), cell(F.greatest(x1, x2) + eps, ox))))
    slope = F.try_divide(y2 - y1, x2 - x1)
    clamped = lambda x: F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2))
    at = lambda x: y1 + (clamped(x) - x1) * slope
    a, b = at(F.col("_cx") * size + ox), at((F.col("_cx") + 1) * size + ox)
    low = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.least(a, b))
    high = F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    return e.withColumn("_cy", F.explode(F.sequence(cell(low - eps, oy), cell(high + eps, oy))))


def _sizes(cell: float, levels: int) -> list[tuple[float, float, float]]:
    return [(cell * FACTOR**k, cell * SHIFT_X, cell * SHIFT_Y) for k in range(levels)]


def _crossings(e: DataFrame, level: int, size: float, origin: float) -> DataFrame:
    """Where edges cross the lines y = row * size + origin (lower end included)."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil((low - origin) / size), F.ceil((high - origin) / size) - 1
    y = F.col("_row") * size + origin
    rows = e.where(first <= last).withColumn("_row", F.explode(F.sequence(first, last)))
    return rows.select("fid", F.lit(level).alias("_line"), "_row", (F.col("x1") + (y - F.col("y1")) * F.try_divide(
        F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("_x"), F.lit(1).alias("_n"), F.lit(None).cast("long").alias("_cx"))


def cover(edges: DataFrame, cell: float = 16.0, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(cells, lists) for ring edges (fid, x1, y1, x2, y2).

    ``cells``: fid, level, _cx, _cy of cells that lie inside as a whole, of size ``cell * FACTOR^level``. ``lists``: the edges of every
    smallest cell that any passes, with ``corner``, whether the cell's lower left corner is inside (even-odd over
    all edges of a fid).
    """
    sizes = _sizes(cell, levels)
    passed = [edge_cells(edges, s, (ox, oy)) for s, ox, oy in sizes]
    hit = [p.select("fid", "_cx", "_cy").distinct() for p in passed]
    size, ox, oy = sizes[-1]
    bounds = edges.groupBy("fid").agg(F.min(F.least("x1", "x2")).alias("a"), F.min(F.least("y1", "y2")).alias("b"),
                                      F.max(F.greatest("x1", "x2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    span = lambda a, b, o: F.explode(F.sequence(F.floor((F.col(a) - o) / size), F.floor((F.col(b) - o) / size)))
    free = bounds.withColumn("_cx", span("a", "c", ox)).withColumn("_cy", span("b", "d", oy)).select("fid", "_cx", "_cy")
    lines, asked = [], []
    for level in reversed(range(levels)):
        size, ox, oy = sizes[level]
        free = free.join(hit[level], ["fid", "_cx", "_cy"], "left_anti")
        asked.append(free.select("fid", F.lit(level).alias("_line"), F.col("_cy").alias("_row"), ((F.col("_cx") + 0.5) * size + ox).alias("_x"),
                                 F.lit(0).alias("_n"), "_cx"))
        lines.append(_crossings(edges, level, size, oy + size / 2))
        if level:  # cells of this size that are passed are split
            part = lambda c: F.explode(F.sequence(F.col(c) * FACTOR, F.col(c) * FACTOR + FACTOR - 1))
            free = hit[level].withColumn("_sx", part("_cx")).withColumn("_sy", part("_cy")).select(
                "fid", F.col("_sx").alias("_cx"), F.col("_sy").alias("_cy"))
    size, ox, oy = sizes[0]
    corner = hit[0].select("fid", F.lit(-1).alias("_line"), F.col("_cy").alias("_row"), (F.col("_cx") * size + ox).alias("_x"), F.lit(0).alias("_n"), "_cx")
    rows = _crossings(edges, -1, size, oy)
    for part in [corner, *lines, *asked]:
        rows = rows.unionByName(part)
    w = W.partitionBy("fid", "_line", "_row").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    sides = rows.withColumn("_in", F.sum("_n").over(w) % 2 == 1).where("_n = 0")
    cells = sides.where((F.col("_line") >= 0) & F.col("_in")).select("fid", F.col("_line").alias("level"), "_cx", F.col("_row").alias("_cy"))
    corners = sides.where("_line = -1").select("fid", "_cx", F.col("_row").alias("_cy"), F.col("_in").alias("corner"))
    return cells, passed[0].join(corners, ["fid", "_cx", "_cy"])


def _reached(size: float, ox: float, oy: float) -> Column:
    """Crossings of an edge with the path from the cell's corner up its left side and then right to the point."""
    px, py, x0, y0 = F.col("_px"), F.col("_py"), F.col("_cx") * size + ox, F.col("_cy") * size + oy
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    up_at = y1 + (x0 - x1) * F.try_divide(y2 - y1, x2 - x1)
    up = ((x1 <= x0) != (x2 <= x0)) & (y0 < up_at) & (up_at <= py)
    right_at = x1 + (py - y1) * F.try_divide(x2 - x1, y2 - y1)
    right = ((y1 <= py) != (y2 <= py)) & (x0 < right_at) & (right_at <= px)
    return F.coalesce(up.cast("int"), F.lit(0)) + F.coalesce(right.cast("int"), F.lit(0))


def inside(points: DataFrame, ft: DataFrame, key: list[str], x: str = "x", y: str = "y", cell: float = 16.0,
           strict: bool = True, levels: int = LEVELS) -> DataFrame:
    """Points inside any polygon of ``ft`` (columns fid, ring; all rings of one fid count together, even-odd).

    A point meets one cell of each size, and the edges of the smallest one. ``strict`` excludes points on an
    edge. ``cell`` should hold a few edges; the cover's largest cells are ``cell * FACTOR^(levels - 1)`` wide.
    """
    from canopygrid.operators.vector import ring_edges

    edges = ring_edges(ft, ["fid"]).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    cells, lists = cover(edges, cell, levels)
    at = points.select(*key, F.col(x).alias("_px"), F.col(y).alias("_py"))
    place = lambda s, ox, oy: (F.floor((F.col("_px") - ox) / s).alias("_cx"), F.floor((F.col("_py") - oy) / s).alias("_cy"))
    sizes = _sizes(cell, levels)
    looked = at.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *place(*s)) for k, s in enumerate(sizes)])).alias("_c"))
    whole = looked.select(*key, "_c.*").join(cells, ["level", "_cx", "_cy"]).select(*key)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    px, py = F.col("_px"), F.col("_py")
    on = (((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2))
          & py.between(F.least(y1, y2), F.greatest(y1, y2)))
    near = at.select("*", *place(*sizes[0])).join(lists, ["_cx", "_cy"])
    tested = near.groupBy(*key, "fid").agg(
        ((F.sum(_reached(*sizes[0])) + F.max(F.col("corner").cast("int"))) % 2 == 1).alias("_in"), F.bool_or(on).alias("_on"))
    ok = F.col("_in") & ~F.col("_on") if strict else F.col("_in") | F.col("_on")
    return points.join(whole.unionByName(tested.where(ok).select(*key)).distinct(), key, "left_semi")
