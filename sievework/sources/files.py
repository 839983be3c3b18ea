"""Folder scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OTHER_SUFFIXES, RAW_SUFFIXES
from ..functions.names import entity_id, folder, stem, suffix


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, modified of the supported files below root, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return supported(rows)


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(suffix(F.col(path)).isin(*RAW_SUFFIXES, *OTHER_SUFFIXES))


def without_companions(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop JPEG files that stand beside a raw file of the same folder and stem, case ignored."""
    p = F.col(path)
    raw = files.filter(suffix(p).isin(*RAW_SUFFIXES)).select(F.lower(folder(p)).alias("_dir"), stem(p).alias("_stem")).distinct()
    keyed = files.select("*", F.lower(folder(p)).alias("_dir"), stem(p).alias("_stem"), suffix(p).isin("jpg", "jpeg").alias("_jpeg"))
    lone = keyed.filter("_jpeg").join(raw, ["_dir", "_stem"], "left_anti")
    return keyed.filter("not _jpeg").unionByName(lone).select(files.columns)


def raw_previews(files: DataFrame, path: str = "path") -> DataFrame:
    """(raw path, preview path) of raw files that have a JPEG companion."""
    p = F.col(path)
    key = [F.lower(folder(p)).alias("_dir"), stem(p).alias("_stem")]
    jpeg = files.filter(suffix(p).isin("jpg", "jpeg")).select(*key, p.alias("_p")).groupBy("_dir", "_stem").agg(F.min("_p").alias("preview"))
    return files.filter(suffix(p).isin(*RAW_SUFFIXES)).select(*key, p.alias("path")).join(jpeg, ["_dir", "_stem"], "left").select("path", "preview")


def with_ids(files: DataFrame) -> DataFrame:
    return files.withColumn("photo_id", entity_id(F.col("path"), F.col("size"), F.unix_micros("modified") * 1000))


def reference_stems(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct stems of a folder of reference files: the labels of an evaluation."""
    return supported(files, path).select(stem(F.col(path)).alias("stem")).distinct()
