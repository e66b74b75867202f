"""Per-pixel column expressions: indices, rules, remaps, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopygrid.functions.arrays import let
from canopygrid.model import (
    GRASS_MAX_M, IGNORE, NDVI_VEG_MIN, NODATA, TREE_MIN_M, ChipConfig,
)

INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and both infinities."""
    return c.isNotNull() & ~F.isnan(c) & (c < F.lit(INF)) & (c > F.lit(-INF))


def ndvi(red="red", nir="nir") -> Column:
    """(nir-red)/(nir+red), NULL where the sum is not positive."""
    r, n = _col(red).cast("double"), _col(nir).cast("double")
    return F.when(n + r > 0, F.try_divide(n - r, n + r))


def veg_stratum(ndvi="ndvi", chm="chm", veg_min=NDVI_VEG_MIN, grass=GRASS_MAX_M,
                tree=TREE_MIN_M, null_is_ground=True) -> Column:
    """grass / shrub / tree for green pixels, NULL otherwise; tree is strictly above."""
    v, h = _col(ndvi), _col(chm)
    known = h.isNotNull() & ~F.isnan(h)
    ground = (h.isNull() | (h < grass)) if null_is_ground else (known & (h < grass))
    return F.when(
        finite(v) & (v >= veg_min),
        F.when(ground, "grass").when(known & (h <= tree), "shrub").when(known, "tree"),
    )


def pseudolabel4(ndvi="ndvi", chm="chm", veg_min=NDVI_VEG_MIN, grass=GRASS_MAX_M,
                 tree=TREE_MIN_M) -> Column:
    """0 tree, 1 shrub, 2 grass, 3 everything else; every pixel gets a label."""
    v, h = _col(ndvi), _col(chm)
    green = v.isNotNull() & ~F.isnan(v) & (v >= veg_min) & h.isNotNull() & ~F.isnan(h)
    return (
        F.when(green & (h < grass), 2)
        .when(green & (h <= tree), 1)
        .when(green & (h > tree), 0)
        .otherwise(3)
    )


def hybrid_codes(pred5="pred5", chm="chm", grass=GRASS_MAX_M, tree=TREE_MIN_M) -> Column:
    """Five-class prediction plus height; here a tree starts *at* the threshold."""
    p, h = _col(pred5), _col(chm)
    veg = (p == 0) & h.isNotNull() & ~F.isnan(h)
    return (
        F.when(veg & (h < grass), 3)
        .when(veg & (h < tree), 2)
        .when(veg & (h >= tree), 1)
        .when(p.between(1, 4), p + 3)
        .otherwise(0)
        .cast("int")
    )


# Internal ids 0..6 -> merged ids, by position.
REMAPS = {"five": (0, 0, 0, 1, 2, 3, 4), "four": (0, 1, 2, 3, 3, 3, 3)}


def remap(mask, scheme: str, ignore: int = IGNORE) -> Column:
    """Merge seven internal ids to ``five`` or ``four``; anything else is ignored."""
    m = _col(mask)
    table = F.array(*[F.lit(v) for v in REMAPS[scheme]])
    return F.when(m.between(0, 6), F.get(table, m.cast("int"))).otherwise(ignore)


def clip_mask(mask) -> Column:
    """Raw ids above 6 become the ignored id 0."""
    m = _col(mask)
    return F.when(m > 6, 0).otherwise(m)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """NaN stays NaN (greatest/least alone would turn it into the upper bound)."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def clean_nonfinite(c: Column, nan=0.0, pos=1.0, neg=0.0) -> Column:
    return (
        F.when(c.isNull() | F.isnan(c), nan).when(c == INF, pos).when(c == -INF, neg).otherwise(c)
    )


def fill_nodata(c, policy: str) -> Column:
    """``keep``: missing -> -9999 (patch rasters). ``zero``: missing and < -1000 -> 0 (chips)."""
    v = _col(c)
    if policy == "keep":
        return F.when(v.isNull() | F.isnan(v), NODATA).otherwise(v)
    if policy == "zero":
        return F.when(finite(v) & (v >= -1000), v).otherwise(0.0)
    raise ValueError(f"unknown nodata policy: {policy}")


def ndvi_is_scaled(values: Column) -> Column:
    """True when any finite value of the chip's array lies outside [-2, 2]."""
    return F.exists(values, lambda x: finite(x) & ((x > 2.0) | (x < -2.0)))


def scaled_band(value: Column, scale: float) -> Column:
    return clean_nonfinite(value / F.lit(max(float(scale), 1.0)))


def _scaled_int(value: Column, scale: float) -> Column:
    """Integer samples cannot be NaN or infinite."""
    return F.coalesce(value / F.lit(max(float(scale), 1.0)), F.lit(0.0))


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def scaled_ndvi(value: Column, divisor) -> Column:
    """Clip to [-1, 1] and map to [0, 1]; missing becomes 0 (not the middle)."""
    v = F.least(F.greatest(value / divisor, F.lit(-1.0)), F.lit(1.0))
    return F.when(_missing(value), 0.0).otherwise((v + 1.0) / 2.0)


def scaled_height(value: Column, clip: float) -> Column:
    v = F.least(F.greatest(value, F.lit(0.0)), F.lit(float(clip)))
    return F.when(_missing(value), 0.0).otherwise(v / F.lit(float(clip)))


def physical_ndvi(value: Column, divisor) -> Column:
    v = F.least(F.greatest(value / divisor, F.lit(-1.0)), F.lit(1.0))
    return F.when(_missing(value), 0.0).otherwise(v)


def physical_height(value: Column) -> Column:
    return F.when(finite(value) & (value >= -1000), value).otherwise(0.0)


def _ndvi_divisor(ndvi: str, cfg: ChipConfig) -> Column:
    if not cfg.ndvi_auto_rescale:
        return F.lit(1.0)
    return F.when(ndvi_is_scaled(F.col(ndvi)), 10000.0).otherwise(1.0)


def normalize(chips, cfg: ChipConfig, ndvi="ndvi", chm="chm"):
    """Chip arrays to model inputs. One narrow projection: nothing is shuffled,
    because the rescale decision only needs the chip's own array."""
    new = {}
    for b in cfg.bands:
        whole = chips.schema[b].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
        new[b] = F.transform(b, lambda x: _scaled_int(x, cfg.naip_scale) if whole else scaled_band(x, cfg.naip_scale))
    new[ndvi] = let(_ndvi_divisor(ndvi, cfg), lambda k: F.transform(ndvi, lambda x: scaled_ndvi(x, k)))
    new[chm] = F.transform(chm, lambda x: scaled_height(x, cfg.chm_clip_m))
    return chips.withColumns(new)


def physical(chips, cfg: ChipConfig, ndvi="ndvi", chm="chm"):
    """Chip arrays back to index units and metres."""
    return chips.withColumns({
        ndvi: let(_ndvi_divisor(ndvi, cfg), lambda k: F.transform(ndvi, lambda x: physical_ndvi(x, k))),
        chm: F.transform(chm, physical_height),
    })


def sample_scale(dtype) -> Column:
    """Largest value of an integer sample type, 1.0 for floating types."""
    d = F.lower(_col(dtype))
    bits = F.regexp_extract(d, r"int(\d+)$", 1).try_cast("int")
    signed = F.when(d.startswith("u"), 0).otherwise(1)
    return F.when(bits.isNotNull(), F.pow(F.lit(2.0), bits - signed) - 1.0).otherwise(1.0)


def argmax(scores) -> Column:
    """0-based position of the first maximum."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")
