"""Predicates and projections over photos and their faces."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..config import BLOCKING_ISSUES
from ..functions.numbers import finite


def _steps(area: Column, confidence: Column, steps: list[tuple[float, float]]) -> Column:
    return reduce(or_, [(area >= a) & (confidence >= c) for a, c in steps])


def significant_face(person: Column, area: Column, confidence: Column) -> Column:
    """A known person's face that is large and sure enough to count for the photo."""
    return person.isNotNull() & _steps(area, confidence, [(0.0006, 0.82), (0.0010, 0.65), (0.0025, 0.55)])


def reliable_face(person: Column, area: Column, confidence: Column) -> Column:
    return person.isNotNull() & _steps(area, confidence, [(0.0007, 0.90), (0.0018, 0.78), (0.0035, 0.65)])


def quality_faces(faces: DataFrame, photo: str, area: str, confidence: str, roll: str) -> DataFrame:
    """Faces whose quality counts, largest first: of the passable ones those not dwarfed by the largest.

    A photo whose two or more passable faces are all tiny has none.
    """
    passable = faces.filter(_steps(F.col(area), F.col(confidence), [(0.0006, 0.82), (0.0010, 0.70)]) & (F.abs(roll) <= 42))
    w = Window.partitionBy(photo)
    sized = passable.select("*", F.max(area).over(w).alias("_largest"), F.count(F.lit(1)).over(w).alias("_faces"))
    kept = sized.filter(~((F.col("_faces") >= 2) & (F.col("_largest") < 0.0025)))
    return kept.filter((F.col("_largest") < 0.0035) | (F.col(area) >= 0.24 * F.col("_largest"))).drop("_largest", "_faces")


def quality_eligible(width: Column, height: Column, score: Column, issues: Column, least: float = 55.0) -> Column:
    """Decodable, with a finite score of at least `least` and no blocking issue."""
    clear = ~F.coalesce(F.arrays_overlap(issues, F.array(*map(F.lit, BLOCKING_ISSUES))), F.lit(False))
    return (width > 0) & (height > 0) & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & (score >= least) & clear


def seed_face(confidence: Column, area: Column, sharpness: Column, yaw: Column, pitch: Column, roll: Column, occlusion: Column, profile: Column, learned: Column) -> tuple[Column, Column]:
    """(may the face found an identity, its strength); learned quality may be null, any other unknown measure rules it out."""
    sound = F.lit(True)
    for x in (confidence, area, sharpness, yaw, pitch, roll, occlusion):
        sound = sound & finite(x).isNotNull()
    good = F.coalesce(learned >= 35, F.lit(True))
    firm = (confidence >= 0.82) & (area >= 0.001) & (sharpness >= 45) & (F.abs(yaw) <= 35) & (F.abs(pitch) <= 30) & (F.abs(roll) <= 35) & ~profile & (occlusion < 0.45) & good
    strength = confidence + F.least(area, F.lit(0.10)) + F.least(sharpness, F.lit(200.0)) / 1000 - F.abs(yaw) / 180 - 0.25 * occlusion
    return F.coalesce(sound & firm, F.lit(False)), F.when(sound, strength).otherwise(-1.0)


def workspace(rows: DataFrame, stars: list[int], person: str | None = None, stage: str | None = None) -> DataFrame:
    """Rows of the chosen stars that show the person and belong to the stage; None means all."""
    keep = F.col("stars").isin(stars)
    if person:
        keep &= F.array_contains("person_ids", person)
    if stage:
        keep &= F.col("stage_label") == stage
    return rows.filter(keep)


def public_photo(metrics: Column, score: Column, confidence: Column) -> list[Column]:
    """Numbers as shown outside: score to 2, metrics to 3, confidence to 4 places, half to even."""
    return [F.bround(score, 2).alias("score"), F.transform_values(metrics, lambda _, v: F.bround(v, 3)).alias("metrics"), F.bround(confidence, 4).alias("confidence")]


# Decimal places of the numbers of a photo's parts as shown outside.
PLACES = {
    "face": {"confidence": 4, "bbox": 6, "area_ratio": 6, "open_probability": 4, "sharpness": 2, "smile_score": 2, "high_res_sharpness": 2, "eye_sharpness": 2, "yaw": 2, "pitch": 2, "roll": 2, "occlusion_risk": 4, "expression_confidence": 4, "expression_score": 2, "fiqa_score": 2},
    "body": {"bbox": 6, "confidence": 4, "area_ratio": 6},
    "pose": {"bbox": 6, "detection_confidence": 4, "presence_confidence": 4, "area_ratio": 6, "visibility": 4, "foreground_score": 4, "landmarks": 5},
    "depth": {"subject_depth": 4, "background_depth": 4, "foreground_separation": 4, "subject_focus_score": 2, "background_blur_score": 2, "occlusion_risk": 4, "subject_confidence": 4},
}
#: vectors stay inside; what is shown is whether there is one
INNER = {"face": {"embedding": None}, "body": {"embedding": "reid_available"}, "pose": {"descriptor": "world_3d_available"}, "depth": {"descriptor": None}}


def _rounded(value: Column, kind: DataType, places: int) -> Column:
    return F.transform(value, lambda v: _rounded(v, kind.elementType, places)) if isinstance(kind, ArrayType) else F.bround(value, places)


def public_parts(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """rows with column (an array of structs, or one struct) as shown outside: kind is face, body, pose or depth.

    Numbers are rounded to PLACES, half to even; vectors (INNER) give way to a flag; fields that are neither stay. Nulls stay null.
    """
    of = rows.schema[column].dataType
    fields = (of.elementType if isinstance(of, ArrayType) else of).fields

    def shown(part: Column) -> Column:
        cols = []
        for f in fields:
            if f.name in INNER[kind]:
                cols += [part[f.name].isNotNull().alias(flag)] if (flag := INNER[kind][f.name]) else []
            else:
                cols.append((_rounded(part[f.name], f.dataType, PLACES[kind][f.name]) if f.name in PLACES[kind] else part[f.name]).alias(f.name))
        return F.when(part.isNotNull(), F.struct(*cols))

    return rows.withColumn(column, F.transform(column, shown) if isinstance(of, ArrayType) else shown(F.col(column)))


def stage_labels(rows: DataFrame, project: str, stage: str, label: str, order: list[str]) -> DataFrame:
    """(project, stage, label): each stage once, with the label of its last row by order (its own id where that has none)."""
    named = F.coalesce(F.nullif(F.col(label), F.lit("")), F.col(stage))
    return rows.filter(F.coalesce(F.col(stage), F.lit("")) != "").groupBy(project, stage).agg(F.max_by(named, F.struct(*order)).alias("label"))


def semantic_errors(rows: DataFrame) -> DataFrame:
    """Rows whose tier isn't the one of their stars."""
    from ..config import TIER_OF_STARS

    tier = F.create_map(*[F.lit(x) for kv in TIER_OF_STARS.items() for x in kv])
    return rows.filter(~F.col("rating_tier").eqNullSafe(F.element_at(tier, F.col("stars").cast("int"))))


def safe_candidate(people: Column, expected: Column, hard_issue: Column, bad_faces: Column) -> Column:
    return (F.size(F.array_except(expected, people)) == 0) & ~hard_issue & (bad_faces == 0)


def people_and_label(rows: DataFrame, group: str, person: str, label: str, order: list[str]) -> DataFrame:
    """(group, people, label): each group's distinct people in order, and the label of its last row."""
    last = F.max_by(label, F.struct(*order)).alias("label")
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(person)).alias("people"), last)
