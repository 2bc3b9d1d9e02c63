"""Photographs in folders: formats by extension, identities, text that holds numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.scalars import ascii_fold

#: The extensions of each family.
FAMILIES = {"camera_raw": ("cr3", "cr2", "nef", "arw", "dng", "raf", "orf", "rw2", "pef"), "jpeg": ("jpg", "jpeg"), "tiff": ("tif", "tiff"), "png": ("png",), "heif": ("heic", "heif")}


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, A-Z folded; null if there is none, or only a leading dot."""
    return F.nullif(ascii_fold(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)), F.lit(""))


def family(path: Column) -> Column:
    """The family of a photograph's format; null if it isn't one (A2)."""
    out, ext = F.lit(None).cast("string"), extension(path)
    for name, known in FAMILIES.items():
        out = F.when(ext.isin(*known), name).otherwise(out)
    return out


def identified(files: DataFrame) -> DataFrame:
    """path, length, mtime_ns (null: unknown) of photographs, with file_type, family, asset_id and
    fingerprint; other files go (A2, A3)."""
    stamp = F.coalesce(F.col("mtime_ns").cast("string"), F.lit("unknown"))
    x = files.select("path", "length", "mtime_ns", extension(F.col("path")).alias("file_type"), family(F.col("path")).alias("family"), F.sha2("path", 256).alias("asset_id")).where("family is not null")
    return x.withColumn("fingerprint", F.sha2(F.concat_ws(":", "asset_id", F.col("length").cast("string"), stamp), 256))


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The photographs of a folder and the folders in it, by Spark's reader of files, which opens none as
    their content isn't selected. Times are those the file system gives, to the microsecond."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return identified(x.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")))


def optics_number(text: Column) -> Column:
    """The first word of a text, without f/ before it, if it is a finite number above 0."""
    word = F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), "^(?:f/)+", "")
    value = F.when(F.regexp_like(word, F.lit(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")), word.try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)
