"""Whole polygons of a labelled plane of any size: rings traced per block, then chained across blocks.

Every cell side that faces another label is a directed edge with its cell on the right. An edge
knows the one that follows it from the three cells around its end, so with a rim of one pixel from
its neighbours a block can trace its own edges into pieces and name the edge that each piece
leads to. Pieces that leave their block form cycles; pointer jumping finds every piece's ring and its
place in it in a number of joins that grows with the logarithm of the longest ring. Rings
begin at their least vertex, so they are the same for every block size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.operators.morphology import PART, components
from canopygrid.session import cut_lineage

STRIDE = 1 << 31
# ways along a cell, clockwise from its upper side: forward and outward (row, column) steps, end corner
AHEAD = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
CORNER = np.array([(0, 1), (1, 1), (1, 0), (0, 0)])
VERTICES = "array<struct<y:int,x:int,way:int>>"


def _edge_key(row, col, way):
    return (row * STRIDE + col) * 4 + way


def _block_edges(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, own: np.ndarray):
    """Edges of a block's own cells: (key, key of the next edge, cell index, way, bend)."""
    y, x = rows - rows.min() + 1, cols - cols.min() + 1
    _, lab = np.unique(label, return_inverse=True)
    grid = np.full((y.max() + 2, x.max() + 2), -1)
    grid[y, x] = lab
    parts = []
    for way in range(4):
        (fy, fx), (oy, ox) = AHEAD[way], OUT[way]
        k = np.flatnonzero(own & (grid[y + oy, x + ox] != lab))
        ahead = grid[y[k] + fy, x[k] + fx] == lab[k]
        left = ahead & (grid[y[k] + fy + oy, x[k] + fx + ox] == lab[k])
        turn = np.where(left, 3, np.where(ahead, 0, 1))
        ny, nx = rows[k] + fy * ahead + oy * left, cols[k] + fx * ahead + ox * left
        parts.append((_edge_key(rows[k], cols[k], way), _edge_key(ny, nx, (way + turn) % 4), k, np.full(len(k), way), turn != 0))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _block_pieces(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, own: np.ndarray):
    """Chains of a block's edges: (cell index, first edge, edge after the last, edges, twice the area, vertices)."""
    key, after, cell, way, bend = _block_edges(rows, cols, label, own)
    order = np.argsort(key)
    key, after, cell, way, bend = (v[order] for v in (key, after, cell, way, bend))
    at = np.minimum(np.searchsorted(key, after), max(len(key) - 1, 0))
    follow = np.where(key[at] == after, at, -1)
    led_to = np.zeros(len(key), dtype=bool)
    led_to[follow[follow >= 0]] = True
    ey, ex = rows[cell] + CORNER[way, 0], cols[cell] + CORNER[way, 1]
    sy, sx = ey - AHEAD[way, 0], ex - AHEAD[way, 1]
    cross = (sx * ey - ex * sy).tolist()
    ey, ex, ways, bends, follow_, keys, after_ = (v.tolist() for v in (ey, ex, way, bend, follow, key, after))
    seen = [False] * len(keys)
    # pieces that come from another block first; what is then left goes round inside this one
    for first in [*np.flatnonzero(~led_to).tolist(), *range(len(keys))]:
        if seen[first]:
            continue
        e, n, twice, vertices = first, 0, 0, []
        while e >= 0 and not seen[e]:
            seen[e] = True
            n += 1
            twice += cross[e]
            if bends[e]:
                vertices.append({"y": ey[e], "x": ex[e], "way": ways[e]})
            last, e = e, follow_[e]
        yield cell[first], keys[first], after_[last], n, twice, vertices


def ring_pieces(labelled: DataFrame, label: str = "comp", keep: tuple[str, ...] = (), block: int = 256,
                row: str = "row", col: str = "col") -> DataFrame:
    """Pieces of all rings: ``label, *keep, head, next, n_edges, twice, vertices``.

    ``head`` is the piece's first edge and ``next`` the first edge of the piece that follows; a ring inside one
    block is a piece that follows itself. A block's group is at most its own pixels and the rim around it.
    ``keep`` columns are constant per label.
    """
    fixed = [label, *keep]
    src = labelled.select(*fixed, F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"))
    spread = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + i) / block) for i in (-1, 0, 1)]))
    src = src.withColumn("_br", F.explode(spread("_r"))).withColumn("_bc", F.explode(spread("_c")))
    ddl = ", ".join(f"`{n}` {labelled.schema[n].dataType.simpleString()}" for n in fixed)
    ddl += f", head long, next long, n_edges long, twice long, vertices {VERTICES}"

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["_r"].to_numpy(), pdf["_c"].to_numpy()
        own = (r // block == pdf["_br"].iloc[0]) & (c // block == pdf["_bc"].iloc[0])
        pieces = list(_block_pieces(r, c, pdf[label].to_numpy(), own)) if own.any() else []
        out = pdf[fixed].iloc[[p[0] for p in pieces]].reset_index(drop=True)
        for i, name in enumerate(("head", "next", "n_edges", "twice", "vertices"), start=1):
            out[name] = pd.Series([p[i] for p in pieces], dtype="object" if name == "vertices" else "int64")
        return out

    return src.groupBy("_br", "_bc").applyInPandas(trace, ddl)


def _jump(after: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least head of each cycle and the steps to it, by pointer jumping over all pieces at once."""
    ring, ahead, span = head.copy(), np.zeros(len(head), dtype=np.int64), 1
    while len(head):
        less = ring[after] < ring
        if not less.any():
            break
        ahead = np.where(less, ahead[after] + span, ahead)
        ring, after, span = np.minimum(ring, ring[after]), after[after], span * 2
    return ring, ahead


def rank_cycles(links: DataFrame, part: int = PART) -> DataFrame:
    """``head, ring, place`` for pieces (head, next) that form cycles: the least head of the cycle, and how
    many steps after it the piece stands (as a negative number of steps to it, 0 for the least head itself).

    Pointer jumping: after k rounds each piece knows the least head among the 2^k pieces from it on and how far
    ahead it is. It is over when no round finds anything less. Up to ``part`` pieces, three numbers each, one task makes
    all rounds in memory; beyond that every round is one join of narrow rows, written once.
    """
    links = cut_lineage(links.select("head", "next"))
    if links.count() <= part:
        def run(batches):
            read = [b for b in batches if b.num_rows]
            if read:
                head, nxt = (np.concatenate([b.column(i).to_numpy() for b in read]) for i in (0, 1))
                order = np.argsort(head)
                head, nxt = head[order], nxt[order]
                ring, ahead = _jump(np.searchsorted(head, nxt), head)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(ring), pa.array(-ahead)], names=["head", "ring", "place"])

        return links.coalesce(1).mapInArrow(run, "head long, ring long, place long")
    state = links.select("head", "next", F.col("head").alias("ring"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("changed"))
    span = 1
    while not state.where("changed").isEmpty():
        other = state.select(F.col("head").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        state = cut_lineage(state.join(other, "next").select(
            "head", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"),
            F.when(less, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"), less.alias("changed")))
        span *= 2
    return state.select("head", "ring", (-F.col("ahead")).alias("place"))


def whole_rings(labelled: DataFrame, label: str = "comp", keep: tuple[str, ...] = (), block: int = 256, row: str = "row",
                col: str = "col") -> DataFrame:
    """One row per ring: ``label, *keep, is_hole, n_edges, area`` (in pixels, holes negative) ``, ring`` (lattice vertices, first one repeated).

    Regions are those of ``label``, which must be 4-connected; cells that touch only at a corner stay apart. Outer
    rings run clockwise with rows downwards. The rings do not depend on ``block``.
    """
    pieces = cut_lineage(ring_pieces(labelled, label, keep, block, row, col))
    crossing = F.col("head") != F.col("next")
    ranked = rank_cycles(pieces.where(crossing).select("head", "next"))
    chained = pieces.where(crossing).join(ranked, "head").unionByName(
        pieces.where(~crossing).withColumns({"ring": F.col("head"), "place": F.lit(0).cast("long")}))
    # the least head comes first, then the piece farthest from coming round to it again
    part = F.struct((F.col("place") != 0).alias("later"), "place", "vertices")
    rings = chained.groupBy(label, *keep, "ring").agg(
        F.sum("n_edges").alias("n_edges"), F.sum("twice").alias("twice"), F.sort_array(F.collect_list(part)).alias("_parts"))
    rings = rings.withColumn("_v", F.flatten("_parts.vertices"))
    first = F.array_position("_v", F.array_min("_v")).cast("int")
    turned = F.concat(F.slice("_v", first, F.size("_v")), F.slice("_v", F.lit(1), first))
    return rings.select(label, *keep, (F.col("twice") < 0).alias("is_hole"), "n_edges", (F.col("twice") / 2).alias("area"), turned.alias("ring"))


def whole_polygons(labelled: DataFrame, label: str = "comp", keep: tuple[str, ...] = (), block: int = 256, row: str = "row",
                   col: str = "col", transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """One feature per region: ``label, *keep, n_px, n_vertices, perimeter, rings`` in map units, the outer ring first,
    holes by their least vertex. Counts and perimeter are in pixels. A feature is one row, however large the region;
    ``ring_pieces`` has the same rings in parts of at most a block."""
    a, b, c, d, e, f = transform
    place = lambda p: F.struct((p["x"] * a + p["y"] * b + c).alias("x"), (p["x"] * d + p["y"] * e + f).alias("y"))
    rings = whole_rings(labelled, label, keep, block, row, col)
    per = rings.groupBy(label, *keep).agg(
        F.sum("area").cast("long").alias("n_px"), F.sum(F.size("ring") - 1).cast("long").alias("n_vertices"), F.sum("n_edges").alias("perimeter"),
        F.sort_array(F.collect_list(F.struct("is_hole", "ring"))).alias("_rings"))
    return per.select(label, *keep, "n_px", "n_vertices", "perimeter",
                      F.transform("_rings", lambda r: F.transform(r["ring"], place)).alias("rings"))


def city_polygons(px: DataFrame, value: str = "lc", nodata: int = 0, block: int = 256, row: str = "row", col: str = "col",
                  transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """City map to one polygon per 4-connected region of equal class; ``comp`` is the region's least pixel id."""
    lab = components(px.where(F.col(value) != nodata), 4, block, value, row, col)
    return whole_polygons(lab, "comp", (value,), block, row, col, transform)
