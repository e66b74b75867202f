"""Chip-set configuration documents: resolve, read with defaults, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.model import CHM_CLIP_M, CLASS_NAMES, GRASS_MAX_M, IGNORE, NDVI_VEG_MIN, TREE_MIN_M, VAL_RATIO, ChipConfig

# Keys a usable document must have.
REQUIRED = ("naip_band_count", "naip_scale", "chm_clip_m")


def has_key(doc, key: str) -> Column:
    """True when the text is valid JSON and holds a non-null ``key``."""
    d = F.col(doc) if isinstance(doc, str) else doc
    return F.try_variant_get(F.try_parse_json(d), f"$.{key}", "string").isNotNull()


def newest_config(cfgs: DataFrame, required=REQUIRED, contains: str | None = None,
                  name: str = "name", doc: str = "doc") -> DataFrame:
    """Newest set (by name) whose document has all required keys, as one row."""
    ok = F.lit(True)
    for key in required:
        ok = ok & has_key(doc, key)
    if contains:
        ok = ok & F.contains(F.col(name), F.lit(contains))
    best = cfgs.where(ok).agg(F.max_by(F.col(doc), F.col(name)).alias(doc), F.max(name).alias(name))
    return best.where(F.col(name).isNotNull())


def with_defaults(cfgs: DataFrame, doc: str = "doc") -> DataFrame:
    """Thresholds and flags with their defaults."""
    v = F.try_parse_json(F.col(doc))
    get = lambda k, t, d: F.coalesce(F.try_variant_get(v, f"$.{k}", t), F.lit(d)).alias(k)
    rest = [c for c in cfgs.columns if c != doc]
    return cfgs.select(*rest, get("ndvi_auto_rescale", "boolean", True), get("th_grass_m", "double", 0.3),
                       get("th_tree_m", "double", 1.5), get("ndvi_veg_min", "double", 0.2))


def load_config(cfgs: DataFrame, contains: str | None = None) -> ChipConfig:
    """The one resolved row as plan literals. Fails when no set is usable."""
    row = newest_config(cfgs, contains=contains).select(
        *[F.try_variant_get(F.try_parse_json("doc"), f"$.{k}", t).alias(k) for k, t in (
            ("naip_scale", "double"), ("chm_clip_m", "double"), ("ndvi_auto_rescale", "boolean"))]).first()
    if row is None:
        raise ValueError(f"no configuration with keys {REQUIRED}")
    rescale = True if row["ndvi_auto_rescale"] is None else row["ndvi_auto_rescale"]
    return ChipConfig(naip_scale=row["naip_scale"], chm_clip_m=row["chm_clip_m"], ndvi_auto_rescale=rescale)


def class_counts_json(balance: DataFrame, keys: list[str], cls: str = "cls", n: str = "n") -> DataFrame:
    """Class name to pixel count as one JSON map per chip set."""
    names = F.array(*[F.lit(x) for x in CLASS_NAMES])
    entry = F.struct(F.col(cls), F.get(names, F.col(cls)).alias("k"), F.col(n).alias("v"))
    maps = balance.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    pairs = F.transform("_e", lambda e: F.struct(e["k"], e["v"]))
    return maps.select(*keys, F.to_json(F.map_from_entries(pairs)).alias("class_pixel_counts"))


def chip_set_documents(crops: DataFrame, skipped: dict[str, int], bounds: tuple[float, float, float, float], epsg: int, bands: int,
                       scale: float, tile_size: int, stamp: str, seed: int = 42, **tallies) -> DataFrame:
    """``patch_size, doc``: the configuration document of every chip set.

    ``crops`` has one row per crop: patch_size, split, kept, and n0..n6, its labeled pixels per class. Counts, shares and the numbers of
    chips are those of kept crops; the others are tallied as ``crop_low_label`` beside the tile-level ``skipped``. ``bounds`` normalise
    coordinates; ``tallies`` (such as tree_over_building_px) are written as they are. One aggregate; documents are as many as sizes.
    """
    n = len(CLASS_NAMES)
    kept = F.col("kept")
    per = crops.groupBy("patch_size").agg(
        F.count(F.when(kept & (F.col("split") == "train"), 1)).alias("train"), F.count(F.when(kept & (F.col("split") == "val"), 1)).alias("val"),
        F.count(F.when(~kept, 1)).alias("low"), *[F.coalesce(F.sum(F.when(kept, F.col(f"n{i}"))), F.lit(0)).alias(f"n{i}") for i in range(n)])
    total = sum((F.col(f"n{i}") for i in range(n)), F.lit(0))
    named = lambda c: F.struct(*[c(i).alias(name) for i, name in enumerate(CLASS_NAMES)])
    lits = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    # The keys of the document.
    doc = F.struct(
        F.lit(n).alias("num_classes"), F.array(*map(F.lit, CLASS_NAMES)).alias("class_names"),
        lits({str(i + 1): name for i, name in enumerate(CLASS_NAMES)}).alias("codes"), F.lit(IGNORE).alias("ignore_index"),
        F.lit(bands).alias("naip_band_count"), F.lit(bands + 2).alias("base_in_channels"), F.lit(float(scale)).alias("naip_scale"),
        F.lit(True).alias("ndvi_auto_rescale"), F.lit(CHM_CLIP_M).alias("chm_clip_m"), F.lit(GRASS_MAX_M).alias("th_grass_m"),
        F.lit(TREE_MIN_M).alias("th_tree_m"), F.lit(NDVI_VEG_MIN).alias("ndvi_veg_min"), F.array("patch_size", "patch_size").alias("tile_size"),
        F.col("patch_size"), F.array(F.lit(tile_size), F.lit(tile_size)).alias("source_tile_size"), F.lit(epsg).alias("crs_epsg"),
        lits(dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, bounds)))).alias("coord_bounds"), F.lit(seed).alias("seed"),
        F.lit(VAL_RATIO).alias("val_ratio"), F.col("train").alias("train_tiles"), F.col("val").alias("val_tiles"),
        named(lambda i: F.col(f"n{i}")).alias("class_pixel_counts"),
        named(lambda i: F.coalesce(F.try_divide(F.col(f"n{i}"), total), F.lit(0.0))).alias("class_pixel_frac"),
        F.struct(*[F.lit(v).alias(k) for k, v in skipped.items()], F.col("low").alias("crop_low_label")).alias("skipped"),
        F.lit("tree_over_building").alias("overlap_rule"), F.lit(stamp).alias("prepared_at"), *[F.lit(v).alias(k) for k, v in tallies.items()])
    return per.select("patch_size", F.to_json(doc).alias("doc"))


def scene_meta(px: DataFrame, size: int, scene: str = "scene") -> DataFrame:
    """Width, height and chip grid of each scene, from its pixels."""
    r = px.groupBy(scene).agg(
        (F.max("col") - F.min("col") + 1).cast("int").alias("width"),
        (F.max("row") - F.min("row") + 1).cast("int").alias("height"))
    up = lambda c: F.ceil(F.col(c) / size).cast("int")
    return r.withColumns({"n_rows": up("height"), "n_cols": up("width")}).withColumn(
        "n_tiles", F.col("n_rows") * F.col("n_cols"))
