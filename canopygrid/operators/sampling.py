"""Patch sampling, split assignment, ids and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.keys import is_validation, order_key
from canopygrid.functions.names import group_name
from canopygrid.model import BLACK_SHARE_MAX, IGNORE, LABELED_SHARE_MIN, VAL_RATIO
from canopygrid.operators.ranking import row_number_in


def candidates(scenes: DataFrame, size: int, stride: int) -> DataFrame:
    """Window origins of each scene whose full window fits; centre in pixels."""
    fits = scenes.where((F.col("width") >= size) & (F.col("height") >= size))
    return (
        fits.withColumn("r0", F.explode(F.sequence(F.lit(0), F.col("height") - size, F.lit(stride))))
        .withColumn("c0", F.explode(F.sequence(F.lit(0), F.col("width") - size, F.lit(stride))))
        .withColumns({"center_row": F.col("r0") + size / 2.0, "center_col": F.col("c0") + size / 2.0})
    )


def black_share_ok(px: DataFrame, keys: list[str], bands: list[str],
                   limit: float = BLACK_SHARE_MAX) -> DataFrame:
    """Share of all-zero pixels per window, keeping windows at or below the limit."""
    black = F.lit(True)
    for b in bands:
        black = black & (F.col(b) == 0)
    share = px.groupBy(*keys).agg(F.avg(black.cast("int")).alias("black_share"))
    return share.where(F.col("black_share") <= limit)


def labeled_share(masks: DataFrame, keys: list[str], mask: str = "mask",
                  limit: float = LABELED_SHARE_MIN) -> DataFrame:
    """Labeled share per chip and whether the chip is kept (below the limit is dropped)."""
    return masks.groupBy(*keys).agg(
        F.avg((F.col(mask) != IGNORE).cast("int")).alias("labeled_frac")
    ).withColumn("kept", F.col("labeled_frac") >= limit)


def sample_first(df: DataFrame, key, n: int, seed: int = 42, tie: list[str] = ()) -> DataFrame:
    """First ``n`` rows of the seeded order (top-k without a full sort)."""
    return df.withColumn("order_key", order_key(key, seed)).orderBy("order_key", *tie).limit(n)


def sequential_ids(df: DataFrame, key, name: str = "patch_id", seed: int = 42,
                   tie: list[str] = ()) -> DataFrame:
    """1..n in seeded order, ranked by ranges of the order and not in one task."""
    drawn = df.withColumn("order_key", order_key(key, seed))
    return row_number_in(drawn, [], F.shiftright("order_key", 20), ["order_key", *tie], name)


def chunk_of(pid, total, size: int = 50):
    """Name of the fixed-size id group; the last one is short. ``total`` is a number or a column."""
    p = F.col(pid) if isinstance(pid, str) else pid
    start = F.floor((p - 1) / size) * size + 1
    return group_name(start, F.least(start + size - 1, F.lit(total) if isinstance(total, int) else total))


def assign_split(tiles: DataFrame, key, ratio: float = VAL_RATIO, seed: int = 42) -> DataFrame:
    """One draw per source tile; every crop of the tile inherits it."""
    return tiles.withColumn("split", F.when(is_validation(key, ratio, seed), "val").otherwise("train"))


def epoch_order(grid: DataFrame, key, epoch: int, seed: int = 42) -> DataFrame:
    """Full-coverage grid with an order key that changes every epoch."""
    return grid.withColumn("order_key", order_key(key, seed, epoch))


def skip_reasons(tiles: DataFrame) -> DataFrame:
    """Tiles and reasons; the first failed test names the reason.

    Expects has_bands, n_polys and labeled_frac columns.
    """
    reason = (
        F.when(~F.col("has_bands"), "missing_band")
        .when(F.col("n_polys") == 0, "no_polys")
        .when(F.col("labeled_frac") < LABELED_SHARE_MIN, "low_label")
        .otherwise("used")
    )
    return tiles.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def labeled_crops(px: DataFrame, tile: str, sizes: list[int], tile_size: int, limit: float = LABELED_SHARE_MIN, row: str = "row",
                  col: str = "col", mask: str = "mask", k: int = 7) -> DataFrame:
    """Crops of every size of the tiles whose own labeled share is high enough: ``patch_size, tile, dr, dc, kept`` and class counts
    ``n0..``. A crop is kept if its own share is high enough as well. Sizes larger than the tile, and partial crops, are left out."""
    labeled = (F.col(mask) >= 0) & (F.col(mask) < k)
    counts = [F.count(F.when(F.col(mask) == i, 1)).alias(f"n{i}") for i in range(k)]
    usable = [s for s in sizes if s <= tile_size]
    r, c = F.pmod(F.col(row), F.lit(tile_size)), F.pmod(F.col(col), F.lit(tile_size))
    cut = px.select(tile, mask, r.alias("_r"), c.alias("_c"), F.explode(F.array(*[F.lit(s) for s in usable])).alias("patch_size"))
    size = F.col("patch_size")
    cut = cut.withColumns({"dr": (F.floor(F.col("_r") / size) * size).cast("int"), "dc": (F.floor(F.col("_c") / size) * size).cast("int")})
    cut = cut.where((F.col("dr") + size <= tile_size) & (F.col("dc") + size <= tile_size))
    per = cut.groupBy("patch_size", tile, "dr", "dc").agg(F.avg(labeled.cast("double")).alias("_share"), *counts)
    good = px.groupBy(tile).agg(F.avg(labeled.cast("double")).alias("_tile")).where(F.col("_tile") >= limit).select(tile)
    return per.join(good, tile, "left_semi").withColumn("kept", F.col("_share") >= limit).drop("_share")


def strata_counts(px: DataFrame, key: str, stratum: str = "stratum") -> DataFrame:
    """Pixels per stratum and patch, as one aggregate with fixed columns."""
    return px.groupBy(key).agg(*[
        F.count(F.when(F.col(stratum) == s, 1)).alias(s) for s in ("grass", "shrub", "tree")])
