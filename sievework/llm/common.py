"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``\s`` of the word contracts: blank and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages don't recompute it, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sw_cut = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete written tables that nothing still to be run reads."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._sw_cut)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str, buckets: int) -> Column:
    """crc32(doc_id as text) mod buckets, the contracts' split of rows (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % buckets


def hashed_sample(df: DataFrame, col: str, at_most: int) -> DataFrame:
    """About at_most rows of df, chosen by a hash of col: the same rows however the table is split."""
    n = df.count()
    if n <= at_most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(col), F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * at_most / n))
