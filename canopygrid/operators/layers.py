"""Label layers, class codes, bundles and scene partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.names import group_range, stem
from canopygrid.model import CLASS_FIELDS, NEVER_CLASS_FIELDS, VALID_CODES


def coerce_class(c) -> Column:
    """Number or 0; decimals are cut."""
    v = F.col(c) if isinstance(c, str) else c
    d = v.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), 0).otherwise(d.try_cast("int"))


def resolve_class_column(df: DataFrame, candidates=CLASS_FIELDS, lo: int = 1, hi: int = 7) -> str:
    """Name of the class attribute: a known name, else the only column whose values
    are all whole numbers in [lo, hi]. One aggregate over the layer decides."""
    for name in candidates:
        if name in df.columns:
            return name
    simple = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")
              and f.name.lower() not in NEVER_CLASS_FIELDS]
    checks = []
    for n in simple:
        v = F.col(f"`{n}`").try_cast("double")
        good = v.isNotNull() & (v == F.floor(v)) & v.between(lo, hi)
        checks.append(F.bool_and(F.when(F.col(f"`{n}`").isNotNull(), F.coalesce(good, F.lit(False)))).alias(n))
    row = df.agg(*checks).first() if checks else {}
    hits = [n for n in simple if row[n]]
    if len(hits) == 1:
        return hits[0]
    raise ValueError(f"no class column; columns {df.columns}, by range {hits}")


def validate_codes(ft: DataFrame, code: str = "code", valid=VALID_CODES) -> tuple[DataFrame, DataFrame]:
    """Usable features and a tally of the rest (NULL and each unknown code)."""
    ok = F.col(code).isNotNull() & F.col(code).isin(*valid)
    usable = ft.where(ok)
    why = F.when(F.col(code).isNull(), "null_code").otherwise("unknown_code")
    tally = ft.where(~F.coalesce(ok, F.lit(False))).groupBy(
        why.alias("reason"), F.coalesce(F.col(code), F.lit(-1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return usable, tally


def tag_layer(ft: DataFrame, path, klass="class", src: str = "auto") -> DataFrame:
    """Coerce the class and add the origin columns every merged layer carries."""
    return ft.withColumns({"class": coerce_class(klass), "src": F.lit(src), "layer": stem(path)})


def merge_layers(*layers: DataFrame, columns=("class", "src", "layer", "patch_id")) -> DataFrame:
    """Concatenate layers keeping every object."""
    parts = [la.select(*columns) for la in layers]
    return reduce(lambda x, y: x.unionByName(y), parts)


def restamp(ft: DataFrame, epsg: int) -> DataFrame:
    """Replace the reference-system code; coordinates stay as they are."""
    return ft.withColumn("epsg", F.lit(epsg))


def seed_features(ft: DataFrame, cls: int, within: str, order=("comp",)) -> DataFrame:
    """Ids 1..n per patch and an int class. An empty input keeps the schema."""
    from pyspark.sql import Window as W

    w = W.partitionBy(within).orderBy(*order)
    return ft.withColumns({"id": F.row_number().over(w), "class": F.lit(cls).cast("int")})


def partner_scenes(base: DataFrame, **others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes present in every partner layer, and the rest with what is missing."""
    out = base.select("scene")
    for name, df in others.items():
        out = out.join(df.select("scene").distinct().withColumn(f"_{name}", F.lit(True)), "scene", "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in others]))
    out = out.select("scene", F.array_join(gaps, " ").alias("missing"))
    return out.where(F.col("missing") == "").drop("missing"), out.where(F.col("missing") != "")


def match_groups(labels: DataFrame, groups: DataFrame, folder: str = "folder", group: str = "group") -> DataFrame:
    """Label folders with the raster group of the same id range, NULL when absent."""
    left = labels.withColumn("range_id", group_range(folder))
    right = groups.select(F.col(group).alias("group_name"), group_range(group, "group_").alias("range_id"))
    return left.join(right, "range_id", "left")


def bundle_layers(patches: DataFrame, layers: DataFrame) -> DataFrame:
    """Objects of every layer of each patch that has imagery."""
    return layers.join(patches.where(F.col("has_imagery")).select("patch_id", "bundle"), "patch_id")


def bundle_totals(patches: DataFrame, objects: DataFrame) -> DataFrame:
    """Bundles, rasters by kind and objects, in one row."""
    kinds = {"naip": "has_imagery", "chm": "has_chm", "ndvi": "has_ndvi"}
    seen = F.col("has_imagery")
    head = patches.agg(F.count_distinct(F.when(seen, F.col("bundle"))).alias("bundles"),
                       *[F.count(F.when(seen & F.col(c), 1)).alias(k) for k, c in kinds.items()])
    body = objects.agg(F.count(F.lit(1)).alias("objects"))
    return head.withColumn("_one", F.lit(1)).join(body.withColumn("_one", F.lit(1)), "_one").drop("_one")


def class_balance(px: DataFrame, keys: list[str], cls: str = "mask", k: int = 7) -> DataFrame:
    """Pixels and share per class, classes without pixels included.

    Wide counters instead of one group per class: a dominant class is no hot group.
    """
    wide = px.groupBy(*keys).agg(*[F.count(F.when(F.col(cls) == i, 1)).alias(f"_{i}") for i in range(k)])
    total = sum((F.col(f"_{i}") for i in range(k)), F.lit(0))
    rows = F.array(*[F.struct(F.lit(i).alias("cls"), F.col(f"_{i}").alias("n")) for i in range(k)])
    return wide.select(*keys, total.alias("_t"), F.explode(rows).alias("_x")).select(
        *keys, "_x.cls", "_x.n", F.coalesce(F.try_divide(F.col("_x.n"), F.col("_t")), F.lit(0.0)).alias("frac"))


def detections_kept(det: DataFrame, medians: DataFrame, score_min: float, height_min: float,
                    ndvi_min: float) -> DataFrame:
    """Boxes above the score whose median height and index pass."""
    return det.where(F.col("score") > score_min).join(medians, "fid").where(
        F.col("chm_med").isNotNull() & F.col("ndvi_med").isNotNull()
        & (F.col("chm_med") >= height_min) & (F.col("ndvi_med") >= ndvi_min))
