"""Saved projects: nested JSON documents read into tables, old versions brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TIER_OF_STARS

PHOTO = "id string, filename string, group_id string, stars int, rating_tier string, rating_origin string, rating_reason string, rating_locked boolean, category string, score double, strict_duplicate_cluster_id string, coverage_keys array<string>, issues array<string>, person_ids array<string>"


def _schema() -> str:
    fields = ",".join(f"{n.split(' ', 1)[0]}:{n.split(' ', 1)[1]}" for n in PHOTO.split(", "))
    return f"project_id string, source_root string, schema_version int, photos array<struct<{fields}>>, groups array<struct<id:string>>, files map<string,string>"


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON projects, newest first; unreadable documents are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(_schema() + ", _bad string").json(path)
    return raw.select("*", F.col("_metadata.file_modification_time").alias("modified")).filter("_bad is null and project_id is not null").drop("_bad").orderBy(F.desc("modified"))


def photos(projects: DataFrame) -> DataFrame:
    """A row a photo whose file is known, with defaults for what old versions lack."""
    rows = projects.select("project_id", "schema_version", "files", F.explode("photos").alias("p")).select("project_id", "schema_version", F.element_at("files", F.col("p.id")).alias("path"), "p.*").filter("path is not null")
    return migrated(rows)


def migrated(rows: DataFrame) -> DataFrame:
    """Version 1 rows get tier from stars, legacy origin and reason, no lock; status says whether a new scan is needed."""
    stars = F.coalesce("stars", F.lit(0))
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_OF_STARS.items() for x in kv]), stars)
    whole = F.col("strict_duplicate_cluster_id").isNotNull() & F.col("coverage_keys").isNotNull()
    fill = {
        "stars": stars, "rating_tier": F.coalesce("rating_tier", tier), "rating_origin": F.coalesce("rating_origin", F.lit("legacy")), "rating_reason": F.coalesce("rating_reason", F.lit("legacy_score")),
        "rating_locked": F.coalesce("rating_locked", F.lit(False)), "coverage_keys": F.coalesce("coverage_keys", F.array().cast("array<string>")), "issues": F.coalesce("issues", F.array().cast("array<string>")),
        "person_ids": F.coalesce("person_ids", F.array().cast("array<string>")), "status": F.when((F.coalesce("schema_version", F.lit(1)) >= 2) & whole, "native").otherwise("rescan_required"),
    }
    return rows.withColumns(fill)


def groups(photos: DataFrame) -> DataFrame:
    """Groups that still have photos, with the best and the people that a fifth or more of the members show."""
    n = F.count(F.lit(1))
    base = photos.groupBy("project_id", "group_id").agg(n.alias("members"), F.sort_array(F.collect_list(F.when(F.col("stars") == 3, F.col("id")))).alias("best_ids"), F.coalesce(F.bool_or("rating_locked"), F.lit(False)).alias("protected"))
    shown = photos.select("project_id", "group_id", F.explode(F.array_distinct("person_ids")).alias("person")).groupBy("project_id", "group_id", "person").agg(n.alias("_shown"))
    people = shown.join(base.select("project_id", "group_id", "members"), ["project_id", "group_id"]).filter(F.col("_shown") >= 0.2 * F.col("members")).groupBy("project_id", "group_id").agg(F.sort_array(F.collect_set("person")).alias("people"))
    return base.join(people, ["project_id", "group_id"], "left")
