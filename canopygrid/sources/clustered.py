"""Rasters and layers stored along a Z-order curve, so that scans prune on both axes.

A pixel's block and a feature's centre get a Morton key: the bits of its row and column in
turn. Files are dealt and sorted by that key, so a file, row group or page covers a small square and its
minima and maxima are tight in both directions. A window becomes a few ranges of keys, and a box
plain comparisons with the stored bounds; both reach the Parquet reader.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.functions.coords import reproject_box

BITS = 31
ORIGIN = 1 << (BITS - 1)  # cells of a layer may be negative; those of a raster are not
RANGES = 48


def _spaced(c: Column) -> Column:
    """The low 31 bits, with a zero bit between any two."""
    # The usual masks of bit interleaving.
    c = c.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(row: Column, col: Column) -> Column:
    """Key of a cell with 0 <= row, col < 2^31; rows take the higher bit of each pair."""
    return F.shiftleft(_spaced(row), 1).bitwiseOR(_spaced(col))


def key_ranges(r0: int, c0: int, r1: int, c1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys (both ends included) that together hold every cell r0..r1, c0..c1.

    The squares of the curve that meet the rectangle are split, largest first, until they lie inside it or there
    are enough; what is too much is left to the caller's own test.
    """
    side = max(r1, c1, 1).bit_length()
    inside, split = [], [(-side, 0, 0, 0)]  # (-level, key, row, column) of squares that stick out
    while split and len(inside) + len(split) + 3 <= 4 * most:
        level, key, r, c = heapq.heappop(split)
        half = -level - 1
        if half < 0:
            heapq.heappush(split, (level, key, r, c))
            break
        for i, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            top, left, size = r + (dr << half), c + (dc << half), 1 << half
            if top > r1 or left > c1 or top + size <= r0 or left + size <= c0:
                continue
            whole = r0 <= top and top + size - 1 <= r1 and c0 <= left and left + size - 1 <= c1
            at = key + (i << 2 * half)
            if whole or not half:
                inside.append((at, at + (1 << 2 * half) - 1))
            else:
                heapq.heappush(split, (-half, at, top, left))
    parts = sorted(inside + [(key, key + (1 << 2 * -level) - 1) for level, key, _, _ in split])
    merged: list[list[int]] = []
    for a, b in parts:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    while len(merged) > most:  # close the narrowest gap
        i = min(range(len(merged) - 1), key=lambda k: merged[k + 1][0] - merged[k][1])
        merged[i:i + 2] = [[merged[i][0], merged[i + 1][1]]]
    return [(a, b) for a, b in merged]


def _stored(df: DataFrame, path: str, key: str, order: list[str], group_bytes: int | None) -> None:
    out = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).write.mode("overwrite")
    (out.option("parquet.block.size", group_bytes) if group_bytes else out).parquet(path)


def write_raster(px: DataFrame, path: str, block: int = 256, group_bytes: int | None = None) -> None:
    """Pixels (row, col, bands) along the curve of their blocks; the block size is kept with the table.

    A block larger than its share of rows is dealt to several files by row and column.
    """
    key = morton(F.floor(F.col("row") / block), F.floor(F.col("col") / block)).alias("block_key", metadata={"block": block})
    _stored(px.select("*", key), path, "block_key", ["row", "col"], group_bytes)


def read_bands(spark: SparkSession, path: str, bands: list[str], keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Keys and wanted bands of a stored raster; no other column is read."""
    return spark.read.parquet(path).select(*keys, *bands)


def read_window(spark: SparkSession, path: str, row0: int, col0: int, height: int, width: int, most: int = RANGES) -> DataFrame:
    """Pixels of a sub-rectangle of a stored raster. An empty window gives no rows."""
    px = spark.read.parquet(path)
    block = px.schema["block_key"].metadata["block"]
    r1, c1 = row0 + height - 1, col0 + width - 1
    if r1 < max(row0, 0) or c1 < max(col0, 0):
        return px.where(F.lit(False)).drop("block_key")
    near = F.lit(False)
    for a, b in key_ranges(max(row0, 0) // block, max(col0, 0) // block, r1 // block, c1 // block, most):
        near = near | F.col("block_key").between(a, b)
    return px.where(near & F.col("row").between(row0, r1) & F.col("col").between(col0, c1)).drop("block_key")


def write_layer(ft: DataFrame, path: str, epsg: int, cell: float = 64.0, group_bytes: int | None = None) -> None:
    """Features (fid, xmin, ymin, xmax, ymax, ...) along the curve of their centres; the reference code is kept with the table."""
    place = lambda a, b: F.floor((F.col(a) + F.col(b)) / (2 * cell)).cast("long") + ORIGIN
    key = morton(place("ymin", "ymax"), place("xmin", "xmax")).alias("layer_key", metadata={"epsg": epsg})
    _stored(ft.select("*", key), path, "layer_key", ["fid"], group_bytes)


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float], box_crs: int | None,
               buffer_m: float = 0.0, pad: float = 2.0) -> DataFrame:
    """Features whose box meets the padded ``box``. The box is padded in its own system and then moved to the layer's."""
    ft = spark.read.parquet(path)
    m = buffer_m + pad
    xmin, ymin, xmax, ymax = reproject_box(box[0] - m, box[1] - m, box[2] + m, box[3] + m, box_crs, ft.schema["layer_key"].metadata["epsg"], spark)
    return ft.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)).drop("layer_key")
