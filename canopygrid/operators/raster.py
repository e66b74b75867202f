"""Grid operators: stacking, regridding, mosaics, chips and write-back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.arrays import let, positions
from canopygrid.functions.coords import with_projected

CELL = ["scene", "row", "col"]


@dataclass(frozen=True)
class Grid:
    """North-up or south-up grid: x = c + a*(col+0.5), y = f + e*(row+0.5)."""

    a: float
    e: float
    c: float
    f: float
    width: int
    height: int

    @staticmethod
    def snapped(res: float, xmin: float, ymin: float, xmax: float, ymax: float) -> "Grid":
        """Extent widened outwards to whole multiples of the resolution."""
        import math

        x0, y1 = math.floor(xmin / res) * res, math.ceil(ymax / res) * res
        return Grid(res, -res, x0, y1, round(math.ceil(xmax / res) - x0 / res),
                    round(y1 / res - math.floor(ymin / res)))


def stack(bands: DataFrame, *layers: DataFrame, on=CELL) -> DataFrame:
    """Inner equi-join of co-gridded layers. All joins share one key, so each layer
    is exchanged once and the result keeps that partitioning."""
    out = bands
    for layer in layers:
        out = out.join(layer, list(on))
    return out


def canopy_height(dsm: DataFrame, dtm: DataFrame, on=("cy", "cx")) -> DataFrame:
    """max(surface - terrain, 0); NULL where either is missing."""
    both = dsm.join(dtm, list(on), "full_outer")
    return both.withColumn("chm", height_above(F.col("dsm"), F.col("dtm")))


def height_above(dsm: Column, dtm: Column) -> Column:
    return F.when(dsm.isNotNull() & dtm.isNotNull(), F.greatest(dsm - dtm, F.lit(0.0)))


def regrid(px: DataFrame, value: str, src: Grid, dst: Grid, keys=(), row="row", col="col") -> DataFrame:
    """Bilinear resampling that ignores missing cells and renormalises the weights.

    Written as a scatter: every source cell sends its weighted value to the target
    pixels it influences, and one map-side combined aggregate finishes the job. A
    gather would need a join of four neighbours per target pixel plus the same
    aggregate.
    """
    if src == dst:
        return px.select(*keys, row, col, value)

    def reach(cell: str, ratio: float, shift: float, size: int) -> tuple[Column, Column]:
        lo = F.floor((F.col(cell) - 0.5 - shift) / ratio - 0.5)
        hi = F.ceil((F.col(cell) + 1.5 - shift) / ratio - 0.5)
        return F.greatest(lo, F.lit(0)), F.least(hi, F.lit(size - 1))

    bx, ax = dst.a / src.a, (dst.c - src.c) / src.a
    by, ay = dst.e / src.e, (dst.f - src.f) / src.e
    j0, j1 = reach(col, bx, ax, dst.width)
    i0, i1 = reach(row, by, ay, dst.height)
    spread = (
        px.where(F.col(value).isNotNull())
        .where((j0 <= j1) & (i0 <= i1))
        .select(*keys, value, F.col(row).alias("_r"), F.col(col).alias("_c"),
                F.explode(F.sequence(i0, i1)).alias("_i"), j0.alias("_j0"), j1.alias("_j1"))
        .withColumn("_j", F.explode(F.sequence("_j0", "_j1")))
    )
    u = F.lit(ax) + F.lit(bx) * (F.col("_j") + 0.5)
    v = F.lit(ay) + F.lit(by) * (F.col("_i") + 0.5)
    wx = 1.0 - F.abs(u - (F.col("_c") + 0.5))
    wy = 1.0 - F.abs(v - (F.col("_r") + 0.5))
    covered = u.between(0, src.width) & v.between(0, src.height)
    return (
        spread.where(covered & (wx > 0) & (wy > 0))
        .withColumn("_w", wx * wy)
        .groupBy(*keys, F.col("_i").cast("int").alias(row), F.col("_j").cast("int").alias(col))
        .agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))
    )


def regrid_crs(px: DataFrame, value: str, src: Grid, src_crs: int | None, dst: Grid, dst_crs: int, keys=(),
               row="row", col="col") -> DataFrame:
    """Bilinear resampling onto a grid in another reference system, missing cells ignored.

    A scatter like ``regrid``. How far a cell reaches in the target follows from the local Jacobian of the projection:
    the steps to the next row and column, taken in the target grid. Every target pixel in reach is then projected
    back, and its place among the source cells gives the exact weights. The same system takes ``regrid``; cells whose
    position has no image are left out. Systems: those of ``coords.reproject``.
    """
    if src_crs is None or src_crs == dst_crs:
        return regrid(px, value, src, dst, keys, row, col)

    centre = lambda dr, dc: (src.c + src.a * (F.col("_c") + 0.5 + dc), src.f + src.e * (F.col("_r") + 0.5 + dr))
    cells = px.where(F.col(value).isNotNull()).select(*keys, value, F.col(row).alias("_r"), F.col(col).alias("_c"))
    cells = with_projected(cells, {("_x", "_y"): centre(0, 0), ("_xs", "_ys"): centre(1, 0), ("_xe", "_ye"): centre(0, 1)}, src_crs, dst_crs)

    def reach(at: Column, south: Column, east: Column, size: int) -> tuple[Column, Column]:
        # the Jacobian's two steps together, and a little for the bend of the projection within a cell
        far = (F.abs(south - at) + F.abs(east - at)) * 1.01 + 0.01
        ok = ~F.isnan(at) & ~F.isnan(far) & (F.abs(at) < 1e9) & (far < 1e6)
        return F.when(ok, F.greatest(F.ceil(at - far), F.lit(0))), F.when(ok, F.least(F.floor(at + far), F.lit(size - 1)))

    u = lambda c: (F.col(c) - dst.c) / dst.a - 0.5
    v = lambda c: (F.col(c) - dst.f) / dst.e - 0.5
    (j0, j1), (i0, i1) = reach(u("_x"), u("_xs"), u("_xe"), dst.width), reach(v("_y"), v("_ys"), v("_ye"), dst.height)
    spread = cells.select(*keys, value, "_r", "_c", i0.alias("_i0"), i1.alias("_i1"), j0.alias("_j0"), j1.alias("_j1")).where(
        (F.col("_i0") <= F.col("_i1")) & (F.col("_j0") <= F.col("_j1"))).select(
        *keys, value, "_r", "_c", F.explode(F.sequence("_i0", "_i1")).alias("_i"), "_j0", "_j1").withColumn(
        "_j", F.explode(F.sequence("_j0", "_j1")))
    back = with_projected(spread, {("_u", "_v"): (dst.c + dst.a * (F.col("_j") + 0.5), dst.f + dst.e * (F.col("_i") + 0.5))}, dst_crs, src_crs)
    back = back.withColumns({"_u": (F.col("_u") - src.c) / src.a, "_v": (F.col("_v") - src.f) / src.e})
    weighed = back.where(F.col("_u").between(0, src.width) & F.col("_v").between(0, src.height)).withColumns({
        "_wx": 1.0 - F.abs(F.col("_u") - (F.col("_c") + 0.5)), "_wy": 1.0 - F.abs(F.col("_v") - (F.col("_r") + 0.5))})
    weighed = weighed.where((F.col("_wx") > 0) & (F.col("_wy") > 0)).withColumn("_w", F.col("_wx") * F.col("_wy"))
    return weighed.groupBy(*keys, F.col("_i").cast("int").alias(row), F.col("_j").cast("int").alias(col)).agg(
        (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def mosaic(px: DataFrame, value: str, order: str, on=("row", "col")) -> DataFrame:
    """Union of overlapping sources: the last source with data wins each pixel."""
    return px.where(F.col(value).isNotNull()).groupBy(*on).agg(
        F.max_by(value, order).alias(value))


def snap(px: DataFrame, x: str, y: str, grid: Grid) -> DataFrame:
    """Nearest target pixel of a map position on a snapped grid."""
    return px.withColumns({
        "col": F.floor((F.col(x) - grid.c) / grid.a).cast("int"),
        "row": F.floor((F.col(y) - grid.f) / grid.e).cast("int"),
    }).where(F.col("col").between(0, grid.width - 1) & F.col("row").between(0, grid.height - 1))


def to_chips(px: DataFrame, size: int, bands: list[str], edge: str = "pad", keys=("scene",),
             scenes: DataFrame | None = None, holes: str = "refuse") -> DataFrame:
    """Cut a raster into size x size chips (one row, one array per band).

    ``drop`` omits partial edge chips; ``pad`` fills them with zeros and records the
    valid part. A group is one chip, so it is bounded by size*size pixels. A chip's extent
    comes from ``scenes`` (keys, width, height), or else from the largest row and column of
    its whole scene, never from its own pixels: a hole anywhere in a chip is an error, unless ``holes`` is ``fill``.
    A missing pixel is then zero, and ``seen`` (flags in the order of the bands, null for a chip without
    holes) tells it apart, so that ``to_pixels`` gives back the pixels that were there and no others. Repeated pixels stay an error.
    """
    if edge not in ("pad", "drop"):
        raise ValueError(f"unknown edge policy: {edge}")
    if holes not in ("refuse", "fill"):
        raise ValueError(f"unknown policy for holes: {holes}")
    block = px.withColumns({
        "r0": (F.floor(F.col("row") / size) * size).cast("int"),
        "c0": (F.floor(F.col("col") / size) * size).cast("int"),
    })
    fill = holes == "fill"
    zero = {b: F.lit(0).cast(px.schema[b].dataType) for b in bands} | ({"seen": F.lit(False)} if fill else {})
    cell = F.struct(F.col("row"), F.col("col"), *[F.col(b) for b in bands], *([F.lit(True).alias("seen")] if fill else []))
    if scenes is None:
        scenes = px.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    extent = scenes.select(*keys, F.col("height").cast("int").alias("_h"), F.col("width").cast("int").alias("_w"))
    chips = block.groupBy(*keys, "r0", "c0").agg(F.array_sort(F.collect_list(cell)).alias("_px")).join(extent, [*keys])
    chips = chips.withColumns({"valid_h": F.least(F.lit(size), F.col("_h") - F.col("r0")),
                               "valid_w": F.least(F.lit(size), F.col("_w") - F.col("c0"))})
    whole = (F.col("valid_h") == size) & (F.col("valid_w") == size)
    if edge == "drop":
        chips = chips.where(whole)
    cells = F.col("valid_h") * F.col("valid_w")
    if fill:
        place = F.transform("_px", lambda p: ((p["row"] - F.col("r0")) * F.col("valid_w") + p["col"] - F.col("c0")).cast("int"))
        blank = lambda i: F.struct(
            (F.col("r0") + F.floor(i / F.col("valid_w"))).cast(px.schema["row"].dataType).alias("row"),
            (F.col("c0") + i % F.col("valid_w")).cast(px.schema["col"].dataType).alias("col"), *[z.alias(b) for b, z in zero.items()])
        # places are numbers, which array_except tells apart by hashing
        chips = chips.withColumn("_gone", F.when(cells > 0, F.array_except(F.sequence(F.lit(0), cells - 1), place)))
        filled = F.when(F.size("_gone") == 0, F.col("_px")).otherwise(F.array_sort(F.concat("_px", F.transform("_gone", blank))))
        chips = chips.withColumn("_px", F.when((cells > 0) & (F.size("_px") + F.size("_gone") == cells), filled).otherwise(
            F.raise_error(F.lit("raster has pixels that repeat or lie outside their scene"))))
    else:
        chips = chips.withColumn("_px", F.when(F.size("_px") == cells, F.col("_px")).otherwise(
            F.raise_error(F.lit("raster has missing pixels inside a chip"))))

    def padded(b: str) -> Column:
        line = lambda flat: lambda r: F.when(
            r < F.col("valid_h"),
            F.concat(F.slice(flat, r * F.col("valid_w") + 1, F.col("valid_w")),
                     F.array_repeat(zero[b], F.lit(size) - F.col("valid_w"))),
        ).otherwise(F.array_repeat(zero[b], size))
        filled = let(F.col("_px")[b], lambda flat: F.flatten(F.transform(positions(size), line(flat))))
        return F.when(whole, F.col("_px")[b]).otherwise(filled)

    plane = lambda b: padded(b) if edge == "pad" else F.col("_px")[b]
    seen = [F.when(F.size("_gone") > 0, plane("seen")).alias("seen")] if fill else []
    return chips.select(*keys, "r0", "c0", "valid_h", "valid_w", *[plane(b).alias(b) for b in bands], *seen)


def subcrops(chips: DataFrame, size: int, crop: int, bands: list[str]) -> DataFrame:
    """Non-overlapping crops of square chips, as array slices (no shuffle)."""
    steps = F.sequence(F.lit(0), F.lit(size - crop), F.lit(crop))
    cut = chips.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    take = lambda b: let(F.col(b), lambda v: F.flatten(F.transform(
        positions(crop), lambda r: F.slice(v, (r + F.col("dr")) * size + F.col("dc") + 1, crop))))
    return cut.withColumns({b: take(b) for b in bands})


def fit_to(arr: str, height, width, size: int, zero=0) -> Column:
    """Centre crop, then zero padding at the bottom and right, of one array."""
    h = height if isinstance(height, Column) else F.lit(height)
    w = width if isinstance(width, Column) else F.lit(width)
    top = F.greatest(F.floor((h - size) / 2), F.lit(0)).cast("int")
    left = F.greatest(F.floor((w - size) / 2), F.lit(0)).cast("int")

    def pick(v: Column):
        def at(i):
            r, c = F.floor(i / size).cast("int"), i % size
            ok = (r < h - top) & (c < w - left)
            return F.when(ok, F.get(v, ((r + top) * w + c + left).cast("int"))).otherwise(zero)

        return F.transform(positions(size * size), at)

    return let(F.col(arr), pick)


def to_pixels(chips: DataFrame, size: int, bands: list[str], keep=("scene",)) -> DataFrame:
    """Valid part of each chip back to raster positions (no shuffle); pixels that ``seen`` marks as missing are left out."""
    holes = "seen" in chips.columns
    seen = [F.coalesce("seen", F.array_repeat(F.lit(True), size * size)).alias("seen")] if holes else []
    ex = chips.select(*keep, "r0", "c0", "valid_h", "valid_w", *bands, *seen)
    zipped = F.arrays_zip(*[F.col(b) for b in bands], *(["seen"] if holes else []))
    ex = ex.select(*keep, "r0", "c0", "valid_h", "valid_w", F.posexplode(zipped).alias("_p", "_v"))
    r, c = F.floor(F.col("_p") / size).cast("int"), F.col("_p") % size
    there = F.col("_v")["seen"] if holes else F.lit(True)
    return (
        ex.where((r < F.col("valid_h")) & (c < F.col("valid_w")) & there)
        .select(*keep, (F.col("r0") + r).alias("row"), (F.col("c0") + c).alias("col"),
                *[F.col("_v")[b].alias(b) for b in bands])
    )
