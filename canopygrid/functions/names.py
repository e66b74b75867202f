"""String expressions over paths and tile names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(path) -> Column:
    """Last path part without its extension."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?/*$", 1)


def path_key(path) -> Column:
    """Case-insensitive key after collapsing repeated slashes and ``/./``."""
    p = F.regexp_replace(_col(path), r"/(\./)+", "/")
    return F.lower(F.regexp_replace(p, r"(?<!:)/{2,}", "/"))


TILE_NAME = r"tile_r(\d+)_c(\d+)\.npz$"


def tile_offset(name, part: int) -> Column:
    """Row (1) or column (2) offset in a tile name; a name of another form is an error."""
    n = _col(name)
    return F.when(n.rlike(TILE_NAME), F.regexp_extract(n, TILE_NAME, part)).otherwise(
        F.raise_error(F.concat(F.lit("unexpected tile name: "), n))
    ).cast("int")


def tile_id(name) -> Column:
    """Digits of ``chm_<digits>.tif``; NULL for other names."""
    return F.nullif(F.regexp_extract(_col(name), r"chm_(\d+)\.tif$", 1), F.lit(""))


def padded(value, width: int) -> Column:
    """Zero padding that never cuts a longer number."""
    s = _col(value).cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def patch_name(pid) -> Column:
    return F.concat(F.lit("patch_"), padded(pid, 4))


def chip_file(r0, c0) -> Column:
    return F.concat(F.lit("tile_r"), padded(r0, 5), F.lit("_c"), padded(c0, 5), F.lit(".npz"))


def group_name(start, end) -> Column:
    return F.concat(F.lit("group_"), padded(start, 4), F.lit("-"), padded(end, 4))


def scene_source(scene, r0, c0) -> Column:
    return F.concat(_col(scene), F.lit("_r"), _col(r0).cast("string"), F.lit("_c"),
                    _col(c0).cast("string"))


def crop_source(group, tile, size: int, r0, c0, whole) -> Column:
    """``group/tile`` for a whole tile, with size and offsets for a crop."""
    base = F.concat(_col(group), F.lit("/"), _col(tile))
    crop = F.concat(base, F.lit(f"_p{size}_r"), _col(r0).cast("string"), F.lit("_c"),
                    _col(c0).cast("string"))
    return F.when(whole, base).otherwise(crop)


def group_range(folder, prefix: str = "label_") -> Column:
    """Id range of a label folder; names without the prefix are used whole."""
    f = _col(folder)
    return F.when(f.startswith(prefix), F.substr(f, F.lit(len(prefix) + 1))).otherwise(f)


def stem_date(s) -> Column:
    """Acquisition day: the last eight-digit run of a scene stem."""
    digits = F.regexp_extract(_col(s), r"(\d{8})(?!.*\d{8})", 1)
    return F.try_to_date(digits, "yyyyMMdd")


def run_stamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd_HHmmss")
