"""Human corrections: identities, locks and latest decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import iou


def replay(faces: DataFrame, anchors: DataFrame, overlap: float = 0.80) -> DataFrame:
    """faces (photo, face_index, box, person) with anchored persons (photo, anchor, box, person) put back by geometry.

    An anchor applies where it meets one face and that face one anchor; others are warnings and the person is unknown.
    No two faces of a photo get one person.
    """
    a = anchors.select("photo", "anchor", F.col("box").alias("_box"), F.col("person").alias("_person"))
    met = faces.select("photo", "face_index", "box").join(a, "photo").filter(iou(F.col("box"), F.col("_box")) >= overlap)
    by = lambda *k: met.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*k)
    sure = met.join(by("photo", "anchor"), ["photo", "anchor"], "left_semi").join(by("photo", "face_index"), ["photo", "face_index"], "left_semi")
    once = sure.groupBy("photo", "_person").agg(F.min("face_index").alias("face_index"))
    touched = met.select("photo", "face_index").distinct().withColumn("_met", F.lit(True))
    held = faces.join(once, ["photo", "face_index"], "left").join(touched, ["photo", "face_index"], "left")
    person = F.when(F.col("_person").isNotNull(), F.col("_person")).when(F.col("_met"), F.lit(None)).otherwise(F.col("person"))
    return held.select("photo", "face_index", "box", person.alias("person"), (F.col("_met").isNotNull() & F.col("_person").isNull()).alias("warning"))


def relabel(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merged identities: mapping person -> new person."""
    m = mapping.select("person", F.col("new_person").alias("_new"))
    return faces.join(m, "person", "left").select(*[F.coalesce("_new", "person").alias("person") if c == "person" else F.col(c) for c in faces.columns])


def split(faces: DataFrame, moved: DataFrame, new_person: str) -> DataFrame:
    """Faces (photo, face_index) of moved get the new person."""
    m = moved.select("photo", "face_index").distinct().withColumn("_m", F.lit(True))
    return faces.join(m, ["photo", "face_index"], "left").select(*[F.when(F.col("_m"), F.lit(new_person)).otherwise(F.col("person")).alias("person") if c == "person" else F.col(c) for c in faces.columns])


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key by the order columns."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def locked_ratings(rows: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """rows with locked manual stars (key, stars) put back."""
    m = manual.select(key, F.col("stars").alias("_stars"))
    held = rows.join(m, key, "left")
    cols = [F.coalesce("_stars", "stars").alias("stars") if c == "stars" else F.col(c) for c in rows.columns]
    return held.select(*cols, F.col("_stars").isNotNull().alias("rating_locked"))
