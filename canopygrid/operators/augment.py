"""Offline augmentation of chip rows, driven by a hash of (chip, epoch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.arrays import let, positions
from canopygrid.functions.bands import clamp
from canopygrid.functions.keys import order_key, unit_draw


def moved(arr: str, size: int, draws: Column) -> Column:
    """Pick each output pixel from its source position: flips, then quarter turns
    (``draws``: struct of flip_h, flip_v, turns)."""
    n = F.lit(size - 1)

    def pick(s: Column) -> Column:
        turns = s["turns"]

        def at(i):
            r, c = F.floor(i / size).cast("int"), (i % size).cast("int")
            # undo the counter-clockwise quarter turns
            tr = F.when(turns == 0, r).when(turns == 1, c).when(turns == 2, n - r).otherwise(n - c)
            tc = F.when(turns == 0, c).when(turns == 1, n - r).when(turns == 2, n - c).otherwise(r)
            vr = F.when(s["flip_v"], n - tr).otherwise(tr)
            hc = F.when(s["flip_h"], n - tc).otherwise(tc)
            return F.get(s["v"], vr * size + hc)

        return F.transform(positions(size * size), at)

    fields = [draws[k].alias(k) for k in ("flip_h", "flip_v", "turns")]
    return let(F.struct(F.col(arr).alias("v"), *fields), pick)


def d4_draws(key: str, epoch: int, seed: int = 42) -> dict[str, Column]:
    """Two fair flips and one uniform quarter turn, as separate bits of one draw."""
    h = order_key(key, seed, epoch)
    bit = lambda k: F.shiftright(h, k)
    return {"flip_h": bit(30) % 2 == 1, "flip_v": bit(29) % 2 == 1, "turns": (bit(27) % 4).cast("int")}


def augment_d4(chips: DataFrame, key: str, size: int, arrays: list[str], epoch: int, seed: int = 42) -> DataFrame:
    """Flips and quarter turns, the same for image bands and mask. Narrow projection."""
    draws = F.struct(*[v.alias(k) for k, v in d4_draws(key, epoch, seed).items()])
    return chips.withColumns({a: moved(a, size, draws) for a in arrays})


def augment_crop(chips: DataFrame, key: str, size: int, arrays: list[str], epoch: int, seed: int = 42,
                 p: float = 0.5, lo: float = 0.25) -> DataFrame:
    """Square crop covering lo..1 of the area, resampled back by nearest neighbour."""
    u = lambda k: unit_draw(key, seed, epoch, k)
    side = F.greatest(F.round(F.sqrt(F.lit(lo) + u(1) * (1 - lo)) * size), F.lit(1)).cast("int")
    side = F.when(u(0) < p, side).otherwise(size)

    def window(n: Column) -> Column:
        free = F.lit(size + 1) - n
        return F.struct(n.alias("side"), F.floor(u(2) * free).cast("int").alias("top"),
                        F.floor(u(3) * free).cast("int").alias("left"))

    def pick(arr: str) -> Column:
        def at(v: Column, w: Column):
            near = lambda k: F.floor((k + 0.5) * w["side"] / size).cast("int")
            return lambda i: F.get(v, (w["top"] + near(F.floor(i / size))) * size + w["left"] + near(i % size))

        return let(F.struct(F.col(arr).alias("v"), let(side, window).alias("w")),
                   lambda s: F.transform(positions(size * size), at(s["v"], s["w"])))

    return chips.withColumns({a: pick(a) for a in arrays})


def augment_radiometric(chips: DataFrame, key: str, bands: list[str], epoch: int, seed: int = 42,
                        p: float = 0.8, brightness: float = 0.05, contrast: float = 0.15) -> DataFrame:
    """Brightness and contrast on the listed bands (values in [0, 1]); the city model
    lists the imagery bands only, pretraining lists all of them."""
    u = lambda k: unit_draw(key, seed, epoch, k)
    gain = F.when(u(0) < p, 1.0 + (u(1) * 2 - 1) * contrast).otherwise(1.0)
    shift = F.when(u(0) < p, (u(2) * 2 - 1) * brightness).otherwise(0.0)
    draw = F.struct(gain.alias("gain"), shift.alias("shift"))
    lit = lambda b: let(draw, lambda g: F.transform(
        b, lambda x: clamp(x * g["gain"] + g["shift"], 0.0, 1.0)))
    return chips.withColumns({b: lit(b) for b in bands})
