"""Feature store: Parquet tables with a validity key, upserts by rewrite and swap, and an action log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FeatureStore:
    """Tables photo, face, body, pose, depth, model_versions, decisions and actions below a folder.

    A table is a series of whole versions (v=1, v=2, ...); a reader takes the last complete one, so a failed write
    leaves the one before. Columns may be added: versions are read with merged schemas.
    """

    CHILDREN = ("face", "body", "pose", "depth")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("v=") and fs.exists(Path(p, "_SUCCESS")))

    def read(self, table: str) -> DataFrame | None:
        versions = self._versions(table)
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}/v={versions[-1]}") if versions else None

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows of the keys given are replaced, all others stay; new columns are null in old rows."""
        old = self.read(table)
        new = rows if old is None else old.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
        new.write.parquet(f"{self.root}/{table}/v={(self._versions(table) or [0])[-1] + 1}", mode="overwrite")

    def save(self, photos: DataFrame, children: dict[str, DataFrame]) -> None:
        """Photos by cache_key, each child table's rows of those photos deleted and put in anew, photos last."""
        for name, rows in children.items():
            old = self.read(name)
            kept = rows if old is None else old.join(photos.select("cache_key").distinct(), "cache_key", "left_anti").unionByName(rows, allowMissingColumns=True)
            kept.write.parquet(f"{self.root}/{name}/v={(self._versions(name) or [0])[-1] + 1}", mode="overwrite")
        self.upsert("photo", photos, ["cache_key"])

    def load(self, wanted: DataFrame) -> DataFrame:
        """wanted (cache_key, size, modified) with features where the key is known and size and time still hold."""
        photo = self.read("photo")
        out = wanted if photo is None else wanted.join(photo, ["cache_key", "size", "modified"], "left")
        for name in self.CHILDREN:
            rows = self.read(name)
            if rows is not None:
                index = f"{name}_index"
                parts = [index, *[c for c in rows.columns if c not in (index, "cache_key")]]
                held = rows.groupBy("cache_key").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias(f"{name}s"))
                out = out.join(held, "cache_key", "left")
        return out

    def log_action(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/actions")


def dominant_signature(photos: DataFrame, prefix: str, path: str = "source_path", signature: str = "pipeline_signature", updated: str = "updated") -> DataFrame:
    """The signature with most rows below a path prefix, the latest on ties."""
    by = photos.filter(F.col(path).startswith(prefix)).groupBy(signature).agg(F.count(F.lit(1)).alias("n"), F.max(updated).alias("last"))
    return by.orderBy(F.desc("n"), F.desc("last"), signature).limit(1)


def last_revisions(files: DataFrame, name: str = "name") -> DataFrame:
    """The row of each operation's journal with the highest revision; names are <operation>.<revision>.json."""
    op, rev = F.regexp_extract(name, r"^(.*)\.(\d+)\.json$", 1), F.regexp_extract(name, r"\.(\d+)\.json$", 1).try_cast("int")
    held = files.select("*", op.alias("operation"), rev.alias("revision")).filter("revision is not null")
    return held.groupBy("operation").agg(F.max_by(F.struct(*held.columns), "revision").alias("r")).select("r.*")
