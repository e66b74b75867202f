"""Point returns to gridded surfaces, and gap filling of the grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopygrid.functions.keys import order_key
from canopygrid.operators.ranking import row_number_in

GROUND = 2
NOISE = (7, 18)


def is_signal(cls="cls", noise_filter: str = "intent") -> Column:
    """Returns that may form the surface. ``as_written`` keeps noise as well: two
    exclusive ranges on one dimension combine by OR, which lets everything pass."""
    if noise_filter == "as_written":
        return F.lit(True)
    return ~F.col(cls).isin(*NOISE)


def grid_surfaces(pt: DataFrame, res: float = 0.5, mode: str = "radius",
                  noise_filter: str = "intent", keys: tuple = ()) -> DataFrame:
    """Terrain (lowest ground return) and surface (highest signal return) per cell.

    ``bin`` gives a point to its own cell. ``radius`` gives it to every cell whose
    centre lies within res*sqrt(2): at most the 3x3 neighbourhood, so the fan-out is
    a constant array exploded inside codegen and re-combined before the shuffle.
    """
    own = pt.withColumns({
        "cx": F.floor(F.col("x") / res).cast("int"),
        "cy": F.floor(F.col("y") / res).cast("int"),
    })
    if mode == "radius":
        step = F.array(F.lit(-1), F.lit(0), F.lit(1))
        own = (
            own.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
            .withColumns({"cx": F.col("cx") + F.col("_i"), "cy": F.col("cy") + F.col("_j")})
        )
        dx = F.col("x") - (F.col("cx") + 0.5) * res
        dy = F.col("y") - (F.col("cy") + 0.5) * res
        own = own.where(dx * dx + dy * dy <= 2.0 * res * res)
    elif mode != "bin":
        raise ValueError(f"unknown gridding mode: {mode}")
    return own.groupBy(*keys, "cy", "cx").agg(
        F.min(F.when(F.col("cls") == GROUND, F.col("z"))).alias("dtm"),
        F.max(F.when(is_signal("cls", noise_filter), F.col("z"))).alias("dsm"),
    )


def grid_points(pt: DataFrame, res: float = 0.5, surface: str = "dsm", mode: str = "radius",
                noise_filter: str = "intent", keys: tuple = ()) -> DataFrame:
    """One surface only; the class filter reaches the scan."""
    if surface not in ("dtm", "dsm"):
        raise ValueError(f"unknown surface: {surface}")
    keep = F.col("cls") == GROUND if surface == "dtm" else is_signal("cls", noise_filter)
    return grid_surfaces(pt.where(keep), res, mode, noise_filter, keys).select(
        *keys, "cy", "cx", surface)


def dense_grid(cells: DataFrame, key: str, value: str) -> DataFrame:
    """All cells of each tile's bounding box, NULL where nothing was measured.

    Rows are generated from the per-tile bounds; the tile's rows and columns are
    exploded in two steps with a shuffle between, so one large tile is spread out.
    """
    box = cells.groupBy(key).agg(*[f(c).alias(n) for c, f, n in (
        ("cy", F.min, "_y0"), ("cy", F.max, "_y1"), ("cx", F.min, "_x0"), ("cx", F.max, "_x1"))])
    frame = (
        box.withColumn("cy", F.explode(F.sequence("_y0", "_y1")))
        .repartition(key, "cy")
        .withColumn("cx", F.explode(F.sequence("_x0", "_x1")))
        .select(key, "cy", "cx")
    )
    return frame.join(cells.select(key, "cy", "cx", value), [key, "cy", "cx"], "left")


def gap_fill(cells: DataFrame, key: str, value: str, min_valid: int = 100) -> DataFrame:
    """Fill NULL cells between measured neighbours of the same row or column.

    Each axis gives a linear estimate when the cell is bracketed on it; two
    estimates are averaged with the inverse bracket length as weight. Cells without
    any bracket stay NULL, and tiles with fewer than ``min_valid`` values are left
    alone. Look-ahead uses a second window in reverse order, since a frame that runs
    to the end of its partition costs quadratic time. Windows are keyed by one row
    or one column of a tile, never by the tile.
    """
    def bracket(axis: str, pos: str, df: DataFrame) -> DataFrame:
        seen = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
        w = W.partitionBy(key, axis)
        lo = F.last(seen, ignorenulls=True).over(w.orderBy(F.col(pos)))
        hi = F.last(seen, ignorenulls=True).over(w.orderBy(F.col(pos).desc()))
        df = df.withColumns({"_lo": lo, "_hi": hi})
        gap = F.col("_hi.p") - F.col("_lo.p")
        est = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * F.try_divide(
            F.col(pos) - F.col("_lo.p"), gap)
        return df.withColumns({f"_e_{pos}": est, f"_w_{pos}": F.try_divide(F.lit(1.0), gap)}).drop("_lo", "_hi")

    grid = dense_grid(cells, key, value)
    grid = bracket("cx", "cy", bracket("cy", "cx", grid))
    num = sum((F.coalesce(F.col(f"_e_{p}") * F.col(f"_w_{p}"), F.lit(0.0)) for p in ("cx", "cy")), F.lit(0.0))
    den = sum((F.when(F.col(f"_e_{p}").isNotNull(), F.col(f"_w_{p}")).otherwise(0.0)
               for p in ("cx", "cy")), F.lit(0.0))
    enough = cells.groupBy(key).agg((F.count(value) >= min_valid).alias("_enough"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(
        F.col("_enough") & (den > 0), F.try_divide(num, den))
    return grid.join(enough, key).select(
        key, "cy", "cx", filled.alias(value), (F.col(value).isNull() & filled.isNotNull()).alias("filled"))


def cap_per_group(df: DataFrame, key: str, draw_on, k: int, seed: int = 42,
                  tie: tuple = ()) -> DataFrame:
    """Sample of at most ``k`` rows per key without replacement, by hash order.

    Ranks are two-level over 4096 slices of the hash range, and slices that begin beyond
    the ``k``-th row are dropped before any is sorted.
    """
    drawn = df.withColumn("_draw", order_key(draw_on, seed))
    ranked = row_number_in(drawn, [key], F.shiftright("_draw", 20), ["_draw", *tie], "_rank", upto=k)
    return ranked.drop("_draw", "_rank")
