"""Fixed values of the data model: codes, thresholds, schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Land-cover codes 1..7 in order; internal id = code - 1.
CLASS_NAMES = ("Tree", "Shrub", "Grass", "Soil", "Building", "Asphalt", "Water")
TREE, SHRUB, GRASS, SOIL, BUILDING, ASPHALT, WATER = range(1, 8)
VALID_CODES = tuple(range(1, 8))
IGNORE = 255
NODATA = -9999.0

# Thresholds of the vegetation rules and the quality limits.
NDVI_VEG_MIN = 0.20
GRASS_MAX_M = 0.3
TREE_MIN_M = 1.5
CHM_CLIP_M = 30.0
BLACK_SHARE_MAX = 0.20
LABELED_SHARE_MIN = 0.01
DETECTION_SCORE_MIN = 0.20
ROAD_RADIUS_M = 3.0
MIN_PX_VEG = 6
MIN_PX_TREE = 30
VAL_RATIO = 0.20
MAX_CLASS_WEIGHT = 10.0

# Attribute names that may hold the class code, in search order.
CLASS_FIELDS = (
    "class", "Class", "CLASS", "ClassValue", "classvalue", "class_id",
    "gridcode", "Gridcode", "GRIDCODE", "code", "Code", "CODE",
)
# Attribute names that never hold it (compared in lower case).
NEVER_CLASS_FIELDS = frozenset(
    ("fid", "objectid", "id", "shape_leng", "shape_length", "shape_area", "geometry")
)

# Sinusoid octaves of the coordinate channels.
COORD_OCTAVES = (0, 1, 2, 3)

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("class", T.IntegerType()),
        T.StructField("src", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("patch_id", T.IntegerType()),
        T.StructField("ring", RING),
    ]
)

@dataclass(frozen=True)
class ChipConfig:
    """Constants shared by training and prediction; folded into the plan as literals."""

    bands: tuple[str, ...] = ("red", "green", "blue", "nir")
    naip_scale: float = 255.0
    ndvi_auto_rescale: bool = True
    chm_clip_m: float = CHM_CLIP_M
    grass_m: float = GRASS_MAX_M
    tree_m: float = TREE_MIN_M
    veg_min: float = NDVI_VEG_MIN
    bounds: dict = field(default_factory=dict)
