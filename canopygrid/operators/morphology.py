"""Binary morphology, connected components and polygon extraction on sparse masks.

A mask is a DataFrame with one row per set pixel. ``within`` names the columns of
the patch a pixel belongs to; operations never look across patches. An empty
``within`` means one mosaic plane, which is processed in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.session import cut_lineage

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
PART = 1_000_000  # edges that one task merges at once
HALF = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


def _spread(px: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CROSS])
    ex = px.select(*keys, row, col, F.explode(offsets).alias("_o"))
    return ex.select(*keys, (F.col(row) + F.col("_o.i")).alias(row), (F.col(col) + F.col("_o.j")).alias(col))


def dilate(px: DataFrame, within: list[str], height: int, width: int, row="row", col="col") -> DataFrame:
    """Set pixels and their four neighbours, clipped to the raster."""
    out = _spread(px, within, row, col)
    inside = F.col(row).between(0, height - 1) & F.col(col).between(0, width - 1)
    return out.where(inside).groupBy(*within, row, col).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def erode(px: DataFrame, within: list[str], height: int, width: int, row="row", col="col",
          border: int = 0) -> DataFrame:
    """Pixels whose whole cross is set. Outside counts as ``border``."""
    votes = _spread(px, within, row, col).groupBy(*within, row, col).agg(F.count(F.lit(1)).alias("_n"))
    r, c = F.col(row), F.col(col)
    need = F.lit(5)
    if border:
        for edge in (r == 0, r == height - 1, c == 0, c == width - 1):
            need = need - edge.cast("int")
    inside = r.between(0, height - 1) & c.between(0, width - 1)
    return votes.where(inside & (F.col("_n") == need)).drop("_n")


def morph(px: DataFrame, op: str, height: int, width: int, within=(), iterations: int = 1,
          row="row", col="col", border: int = 0) -> DataFrame:
    """``open``, ``close``, ``erode`` or ``dilate`` of a sparse mask.

    Patches are bounded, so with ``within`` the mask is exchanged once by patch and
    every later step reuses that partitioning.
    """
    keys = list(within)
    out = px.select(*keys, row, col)
    if keys:
        out = out.repartition(*keys)
    grow = lambda d: dilate(d, keys, height, width, row, col)
    shrink = lambda d: erode(d, keys, height, width, row, col, border)
    steps = {"open": [shrink, grow], "close": [grow, shrink], "erode": [shrink], "dilate": [grow]}
    if op not in steps:
        raise ValueError(f"unknown morphology: {op}")
    for step in steps[op]:
        for _ in range(iterations):
            out = step(out)
    return out


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node: hook to the smaller root, then halve paths."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        if np.array_equal(pa, pb):
            return parent
        low = np.minimum(pa, pb)
        np.minimum.at(parent, pa, low)
        np.minimum.at(parent, pb, low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


def _pixel_edges(rows: np.ndarray, cols: np.ndarray, value: np.ndarray | None, conn: int):
    """Index pairs of touching pixels (equal value) inside one bounded block."""
    r, c = rows - rows.min(), cols - cols.min()
    grid = np.full((r.max() + 2, c.max() + 3), -1)
    grid[r, c + 1] = np.arange(len(r))
    first, second = [], []
    for dr, dc in HALF[conn]:
        other = grid[r + dr, c + 1 + dc]
        ok = other >= 0
        if value is not None:
            ok &= value == value[other]
        first.append(np.flatnonzero(ok))
        second.append(other[ok])
    return np.concatenate(first), np.concatenate(second)


def patch_components(px: DataFrame, within: list[str], conn: int = 8, row="row", col="col",
                     value: str | None = None) -> DataFrame:
    """Label pixels inside bounded patches; ``comp`` counts 1.. in raster order."""
    names = [*within, row, col] + ([value] if value else [])
    schema = T.StructType([px.schema[n] for n in names] + [T.StructField("comp", T.IntegerType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row, col], ignore_index=True)
        r, c = pdf[row].to_numpy(), pdf[col].to_numpy()
        a, b = _pixel_edges(r, c, pdf[value].to_numpy() if value else None, conn)
        root = _merge(len(pdf), a, b)
        return pdf[names].assign(comp=(np.unique(root, return_inverse=True)[1] + 1).astype("int32"))

    return px.select(*names).groupBy(*within).applyInPandas(label, schema)


def component_boxes(px: DataFrame, within: list[str], conn: int = 8, min_px: int = 30,
                    row="row", col="col", transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """Box of each component in map units, far corner exclusive, small ones dropped."""
    a, _, c, _, e, f = transform
    boxes = patch_components(px, within, conn, row, col).groupBy(*within, "comp").agg(
        F.count(F.lit(1)).alias("n_px"), F.min(row).alias("r0"), F.min(col).alias("c0"),
        (F.max(row) + 1).alias("r1"), (F.max(col) + 1).alias("c1"))
    return boxes.where(F.col("n_px") >= min_px).withColumns({
        "left": F.col("c0") * a + c, "top": F.col("r0") * e + f,
        "right": F.col("c1") * a + c, "bottom": F.col("r1") * e + f})


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star then small-star pass over edges (u, v) with u > v.

    The smallest neighbour of each node comes from a map-side combined aggregate and is
    written before it is joined: a node that became the centre of a large star is a hot key
    of the edge side, which adaptive execution can split only if both sides of the join
    are plain shuffles of written rows.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut_lineage(large.where(F.col("u") != F.col("v")).distinct())
    low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
    kept = low.select("u", F.col("m").alias("v"))
    moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(moved).distinct()


def _merge_parts(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) of each of ``parts`` ranges of u replaced by the stars of their components: every node of a
    range's edges points to the least one it reaches within the range."""
    def run(batches):
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        u, v = (np.concatenate([b.column(i).to_numpy() for b in read]) for i in (0, 1))
        nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = _merge(len(nodes), index[:len(u)], index[len(u):])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])

    return edges.repartitionByRange(parts, "u").mapInArrow(run, "u long, v long")


def contract(edges: DataFrame, part: int = PART) -> DataFrame:
    """Root (smallest node) of every node in an edge list (a, b).

    Each round first merges what hangs together within ranges of at most about ``part`` edges, so that chains of neighbouring nodes
    shrink to one step, and then makes one star pass across the ranges. It is over when one range holds all
    that is left, or when a round leaves the list as it was; number and combined hash of the edges tell.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut_lineage(e.where(F.col("u") != F.col("v")).distinct())
    state = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = state(e)
    while True:
        parts = max(1, -(-was[0] // part))
        e = _merge_parts(e, parts)
        if parts > 1:
            e = cut_lineage(_star_round(cut_lineage(e.distinct())))
            now = state(e)
        if parts == 1 or now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def components(px: DataFrame, conn: int = 8, block: int = 256, value: str | None = None,
               row="row", col="col", stride: int = 1 << 31, part: int = PART) -> DataFrame:
    """Components of a mosaic plane of any size; ``comp`` is the smallest pixel id
    (row*stride + col) of the component.

    Blocks are labelled independently (bounded groups), labels that touch across a
    block edge form a small graph, the graph is contracted, and only labels on that
    graph are rewritten.
    """
    names = [row, col] + ([value] if value else [])
    pid = (F.col(row).cast("bigint") * stride + F.col(col)).alias("_id")
    src = px.select(*names, pid, F.floor(F.col(row) / block).alias("_br"), F.floor(F.col(col) / block).alias("_bc"))
    schema = T.StructType([px.schema[n] for n in names] + [
        T.StructField("_br", T.LongType()), T.StructField("_bc", T.LongType()), T.StructField("_local", T.LongType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", ignore_index=True)
        a, b = _pixel_edges(pdf[row].to_numpy(), pdf[col].to_numpy(),
                            pdf[value].to_numpy() if value else None, conn)
        root = _merge(len(pdf), a, b)
        return pdf[[*names, "_br", "_bc"]].assign(_local=pdf["_id"].to_numpy()[root])

    local = cut_lineage(src.groupBy("_br", "_bc").applyInPandas(label, schema))
    rim = (F.col(row) % block).isin(0, block - 1) | (F.col(col) % block).isin(0, block - 1)
    seam = local.where(rim)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in HALF[conn]])
    ahead = seam.withColumn("_o", F.explode(steps)).select(
        (F.col(row) + F.col("_o.i")).alias(row), (F.col(col) + F.col("_o.j")).alias(col),
        *([value] if value else []), F.col("_br").alias("_ar"), F.col("_bc").alias("_ac"), F.col("_local").alias("a"))
    other = (F.col("_ar") != F.col("_br")) | (F.col("_ac") != F.col("_bc"))
    pairs = ahead.join(seam.withColumnRenamed("_local", "b"), names).where(other).select("a", "b")
    roots = contract(pairs, part).withColumnRenamed("node", "_local")
    return local.join(roots, "_local", "left").select(
        *names, F.coalesce("root", "_local").alias("comp"))


# ---------------------------------------------------------------- polygons

def _cell_rings(label: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Rings around every label in one bounded block: (label index, hole?, vertices).

    Cell sides facing another label are directed lattice edges with the cell on their
    right. Each edge continues with the right turn if there is one, so cells that only
    touch at a corner stay apart (4-connectivity); rings are the cycles of that map.
    """
    y, x = rows - rows.min() + 1, cols - cols.min() + 1
    _, lab = np.unique(label, return_inverse=True)
    grid = np.full((y.max() + 2, x.max() + 2), -1)
    grid[y, x] = lab
    parts = []
    # side, start and end corner offsets: top, right, bottom, left
    for way, (dy, dx, sy, sx, ey, ex) in enumerate(
            ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))):
        k = np.flatnonzero(grid[y + dy, x + dx] != lab)
        parts.append(np.stack([lab[k], y[k] + sy, x[k] + sx, y[k] + ey, x[k] + ex, np.full(len(k), way)]))
    lb, sy, sx, ey, ex, way = np.concatenate(parts, axis=1)
    span_x, span_y = int(x.max()) + 2, int(y.max()) + 2
    start = ((lb * span_y + sy) * span_x + sx) * 4 + way
    order = np.argsort(start)
    lb, sy, sx, ey, ex, way, start = (v[order] for v in (lb, sy, sx, ey, ex, way, start))
    corner = ((lb * span_y + ey) * span_x + ex) * 4
    follow = np.full(len(start), -1)
    for turn in (3, 0, 1):
        want = corner + (way + turn) % 4
        at = np.minimum(np.searchsorted(start, want), len(start) - 1)
        follow = np.where(start[at] == want, at, follow)
    bend = np.empty(len(start), dtype=bool)
    bend[follow] = way[follow] != way
    oy, ox = int(rows.min()) - 1, int(cols.min()) - 1
    succ, bends = follow.tolist(), bend.tolist()
    xs, ys = (sx + ox).tolist(), (sy + oy).tolist()
    seen = [False] * len(succ)
    for first in range(len(succ)):
        if seen[first]:
            continue
        ring, e = [], first
        while not seen[e]:
            seen[e] = True
            if bends[e]:
                ring.append((xs[e], ys[e]))
            e = succ[e]
        ring.append(ring[0])
        twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))
        yield int(lb[first]), twice < 0, ring


def trace_rings(labelled: DataFrame, within: list[str], label: str, keep: list[str] = (), row="row", col="col",
                transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """Rings of each label inside a bounded group (one patch or one block), outer rings
    before holes. ``keep`` columns are constant per label."""
    a, _, c, _, e, f = transform
    fixed = [*within, label, *keep]
    ddl = ", ".join(f"`{n}` {labelled.schema[n].dataType.simpleString()}" for n in fixed)
    ddl += ", ring_no int, is_hole boolean, ring array<struct<x:double,y:double>>"

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = sorted(_cell_rings(pdf[label].to_numpy(), pdf[row].to_numpy(), pdf[col].to_numpy()),
                       key=lambda t: (t[0], t[1]))
        which = np.array([t[0] for t in rings])
        per = pdf[fixed].drop_duplicates(label).sort_values(label, ignore_index=True)
        out = per.iloc[which].reset_index(drop=True)
        out["ring_no"] = out.groupby(label).cumcount().astype("int32")
        out["is_hole"] = [t[1] for t in rings]
        out["ring"] = [[{"x": x * a + c, "y": y * e + f} for x, y in t[2]] for t in rings]
        return out

    return labelled.select(*fixed, row, col).groupBy(*within).applyInPandas(trace, ddl)


def polygonize(px: DataFrame, within: list[str], conn: int = 4, min_px: int = 6,
               row="row", col="col") -> DataFrame:
    """Patch masks to polygons: 4-connected regions of at least ``min_px`` pixels."""
    lab = patch_components(px, within, conn, row, col)
    big = lab.groupBy(*within, "comp").agg(F.count(F.lit(1)).alias("n_px")).where(F.col("n_px") >= min_px)
    return trace_rings(lab.join(big, [*within, "comp"]), within, "comp", ["n_px"], row, col)


def map_areas(px: DataFrame, value: str = "lc", nodata: int = 0, pixel_area: float = 1.0,
              block: int = 256) -> DataFrame:
    """Number of polygons and area per class of the final map."""
    lab = components(px.where(F.col(value) != nodata), 4, block, value)
    per = lab.groupBy(value, "comp").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(value).agg(F.count(F.lit(1)).alias("n_polygons"),
                                  (F.sum("_n") * pixel_area).alias("area"))
