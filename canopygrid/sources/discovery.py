"""Listing inputs: discovery, selection, resume, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.functions.names import path_key, stem


def discover(paths: DataFrame, path: str = "path") -> DataFrame:
    """One path per case-insensitive name: the first in sorted order. An aggregate,
    so copies of one name are combined before the shuffle."""
    return paths.groupBy(path_key(path).alias("path_key")).agg(F.min(path).alias(path))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Recursive listing by name pattern, without reading file contents."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    )


def select_scenes(found: DataFrame, wanted: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Found items that were asked for, and asked-for names that were not found."""
    return found.join(wanted, key, "left_semi"), wanted.join(found, key, "left_anti")


def pending(items: DataFrame, done: DataFrame, key) -> DataFrame:
    """Items without a finished output."""
    return items.join(done, key, "left_anti")


def links(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed, non-blank lines with the file name each link would be saved under."""
    url = F.trim(F.regexp_replace(F.col(col), r"[\t\r]", " "))
    return lines.select(url.alias("url")).where(F.length("url") > 0).withColumn("stem", stem("url"))


def choose_file(files: DataFrame, keys: list[str], exact, path: str = "path") -> DataFrame:
    """The exact name when present, else the first match in sorted order."""
    best = files.groupBy(*keys).agg(F.min(F.struct((~exact).alias("no"), F.col(path).alias("p"))).alias("_b"))
    return best.select(*keys, F.col("_b.p").alias(path), (~F.col("_b.no")).alias("exact"))


def inputs_check(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every required input with its state."""
    seen = found.select(key).distinct().withColumn("_f", F.lit(True))
    return expected.join(seen, key, "left").withColumn("found", F.col("_f").isNotNull()).drop("_f")


def verdict(checked: DataFrame) -> DataFrame:
    """All inputs found or not, in one row."""
    return checked.agg(F.count(F.lit(1)).alias("n_required"),
                       F.count(F.when(~F.col("found"), 1)).alias("n_missing"),
                       F.bool_and("found").alias("all_found"))


def split_scan(scenes: DataFrame, states: list[str] | None, splits: list[str], layers: list[str]) -> DataFrame:
    """Scenes of the wanted ``state-split`` sets, one row per layer to read."""
    name = F.concat_ws("-", "state", "split")
    out = scenes.withColumn("split_name", name).where(F.col("split").isin(*splits))
    if states is not None:
        out = out.where(F.col("state").isin(*states))
    return out.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in layers])))


def tolerant_read(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """(rows with their ``file``, status of every file) of a folder some of whose files may be damaged.

    A file that cannot be read is passed over instead of failing the job. The listing, which opens no file, is joined to the rows
    that came out: ``file, length, n_rows, readable``. A file cut within its rows can give some of them; compare
    with an index of what should be there (``robust_chips``). Partition columns belong into ``schema``.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = (spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern).parquet(folder)
            .select("*", plain(F.col("_metadata.file_path")).alias("file")))
    seen = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = list_files(spark, folder, pattern).select(plain(F.col("path")).alias("file"), "length")
    status = listed.join(seen, "file", "left").select(
        "file", "length", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("readable"))
    return rows, status


def read_summary(status: DataFrame) -> DataFrame:
    """How many files there are and how many could be read, in one row."""
    return status.agg(F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("readable"), 1)).alias("n_valid"))


def robust_chips(index: DataFrame, chips: DataFrame, key: str, size: int, image: str, mask: str,
                 ignore: int = 0) -> DataFrame:
    """Every indexed chip; an unreadable one becomes a zero image and an all-ignored
    mask instead of failing the read."""
    out = index.join(chips.withColumn("_ok", F.lit(True)), key, "left")
    n = size * size
    return out.withColumns({
        image: F.coalesce(F.col(image), F.array_repeat(F.lit(0).cast(chips.schema[image].dataType.elementType), n)),
        mask: F.coalesce(F.col(mask), F.array_repeat(F.lit(ignore).cast(chips.schema[mask].dataType.elementType), n)),
        "readable": F.col("_ok").isNotNull(),
    }).drop("_ok")
