"""The feature vectors of the rating model, assembled from nested metrics, faces and outside scores.

A budget (the photos that are rated together) gets the wider profile only where every photo of it has both outside
scores; otherwise all of it gets the base profile. Where any value of a budget isn't finite, none of it is scored by a
model, and the reason says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, looked_up
from . import filters, ranking

#: The features of the base profile, in order, and those that the wider profile adds.
BASE_FEATURES = (
    "sharpness_score", "motion_blur_score", "exposure_score", "contrast_score", "noise_score", "composition_score", "face_quality_score", "min_face_score", "face_sharpness_score",
    "eye_sharpness_score", "eye_score", "expression_score", "technical_score", "generic_group_score", "group_relative_score", "group_quality_percentile", "group_size", "relative_face_quality",
    "relative_eye", "relative_motion", "relative_exposure", "relative_composition", "bad_face_count", "face_count", "largest_face_ratio", "mean_occlusion_risk", "mean_abs_yaw", "mean_smile_score", "portrait_present",
    "subject_sharpness_score", "depth_focus_score", "depth_background_blur_score", "depth_separation_score", "depth_occlusion_risk", "main_subject_score", "person_count", "dof_portrait_quality",
)
SCORE_FEATURES = ("iqa_musiq", "iqa_qualiclip", "iqa_relative_musiq", "iqa_relative_qualiclip", "iqa_consensus", "iqa_disagreement")
FACE_FEATURES = ("face_count", "largest_face_ratio", "mean_occlusion_risk", "mean_abs_yaw", "mean_smile_score", "portrait_present", "person_count")
#: Metrics relative to the best of the group, and what they are read from.
RELATIVE = {"relative_face_quality": "face_quality_score", "relative_eye": "eye_score", "relative_motion": "subject_sharpness_score", "relative_exposure": "exposure_score", "relative_composition": "composition_score"}


def _with(metrics: Column, more: dict[str, Column]) -> Column:
    """metrics with more entries, which replace those of their names."""
    kept = F.map_filter(metrics, lambda k, _: ~k.isin(*more))
    return F.map_concat(kept, F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v.cast("double"))]))


def group_metrics(rows: DataFrame, group: str, generic: str = "generic") -> DataFrame:
    """rows (metrics, generic) whose metrics also hold their place in the group: score, gap to the best, share of lower ones, size, relative metrics."""
    w = Window.partitionBy(group)
    m = F.coalesce("metrics", F.create_map().cast("map<string,double>"))
    facts = {f"_r{k}": F.coalesce(m[source], F.lit(0.0)) for k, source in enumerate(RELATIVE.values())}
    held = rows.withColumns(facts)
    more = {
        "generic_group_score": F.col(generic), "group_relative_score": F.col(generic) - F.max(generic).over(w),
        "group_quality_percentile": 100 * F.cume_dist().over(w.orderBy(generic)), "group_size": F.count(F.lit(1)).over(w),
    } | {name: F.col(f"_r{k}") - F.max(f"_r{k}").over(w) for k, name in enumerate(RELATIVE)}
    placed = held.select("*", *[v.alias(f"_m_{k}") for k, v in more.items()])
    return placed.withColumn("metrics", _with(m, {k: F.col(f"_m_{k}") for k in more})).select(*rows.columns)


def face_metrics(faces: DataFrame) -> DataFrame:
    """(photo, m): the features that faces give, as a map; faces: see people, with occlusion, yaw and smile."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    good = filters.quality_faces(faces, "photo", "area", "confidence", "roll").groupBy("photo").agg((1000 * F.max("area")).alias("_1"), (100 * mean(F.col("occlusion"))).alias("_2"), mean(F.abs("yaw")).alias("_3"), mean(F.col("smile")).alias("_4"), F.lit(1.0).alias("_5"))
    told = faces.groupBy("photo").agg(F.count(F.lit(1)).alias("_0"), F.countDistinct("person").alias("_6")).join(good, "photo", "left")
    return told.select("photo", F.create_map(*[x for k, name in enumerate(FACE_FEATURES) for x in (F.lit(name), F.coalesce(F.col(f"_{k}").cast("double"), F.lit(0.0)))]).alias("m"))


def rating_features(rows: DataFrame, faces: DataFrame, budget: str, group: str, place: Column, scores: tuple[str, str] = ("musiq_score", "qualiclip_score")) -> DataFrame:
    """(id, budget, profile, reason, x): the features in their order, 37 of profile base or 43 of iqa; missing ones are 0.

    rows: id, budget, group and metrics (with those of group_metrics); the outside scores are two of the metrics. place
    orders equal scores. profile is stable, and x null, where a value of the budget isn't finite (reason not_finite);
    reason is scores_incomplete where the base profile stands in for the wider one, else empty.
    """
    m = F.coalesce("metrics", F.create_map().cast("map<string,double>"))
    none = F.create_map(*[x for k in FACE_FEATURES for x in (F.lit(k), F.lit(0.0))])
    told = face_metrics(faces).select(F.col("photo").alias("id"), F.col("m").alias("_faces"))
    names = (*BASE_FEATURES, *scores)
    held = rows.select("id", budget, group, m.alias("m"), place.alias("_place")).join(told, "id", "left")
    # after the join, so that the maps are made before and not once a lookup
    held = held.select("id", budget, group, "_place", looked_up(F.col("m"), names).alias("_raw"), F.coalesce("_faces", none).alias("_own"))
    raw = lambda name: F.col("_own")[name] if name in FACE_FEATURES else F.col("_raw")[names.index(name)]
    value = lambda name: F.coalesce(raw(name), F.lit(0.0))
    subject = F.coalesce(*[raw(k) for k in ("subject_sharpness_score", "motion_blur_score", "sharpness_score")], F.lit(0.0))
    deep = (value("portrait_present") > 0) & (value("face_quality_score") >= 70) & (value("depth_background_blur_score") >= 60)
    sharp = F.when(deep, F.greatest(subject, F.least(value("face_quality_score"), F.lit(100.0)))).otherwise(subject)
    musiq, clip = (finite(raw(s)) for s in scores)
    told_by_faces = [names.index(k) for k in FACE_FEATURES]

    def placed(v: Column, k: Column) -> Column:
        own = F.col("_own")[F.array(*map(F.lit, names))[k]]
        return F.when(k == names.index("dof_portrait_quality"), F.col("_sharp")).when(k.isin(*told_by_faces), own).otherwise(F.coalesce(v, F.lit(0.0)))

    held = held.select("id", budget, group, "_place", "_raw", "_own", sharp.alias("_sharp"), musiq.alias("_musiq"), clip.alias("_clip"))
    held = held.select("id", budget, group, "_place", "_musiq", "_clip", F.transform(F.slice("_raw", 1, len(BASE_FEATURES)), placed).alias("_base"))
    unit = Window.partitionBy(budget)
    held = held.withColumn("_whole", F.min((F.col("_musiq").isNotNull() & F.col("_clip").isNotNull()).cast("int")).over(unit) == 1)
    relative = lambda c: 100 * ranking.value_percentile([group, budget], c, F.col("_place"))
    held = held.select("*", relative("_musiq").alias("_rm"), relative("_clip").alias("_rc"))
    more = F.array(F.col("_musiq"), 100 * F.col("_clip"), F.col("_rm"), F.col("_rc"), (F.col("_rm") + F.col("_rc")) / 2, F.abs(F.col("_rm") - F.col("_rc")))
    held = held.select("id", budget, "_whole", F.when(F.col("_whole"), F.concat("_base", more)).otherwise(F.col("_base")).alias("x"))
    sound = F.min(F.forall("x", lambda v: finite(v).isNotNull()).cast("int")).over(unit) == 1
    held = held.withColumn("_sound", sound)
    profile = F.when(~F.col("_sound"), "stable").when(F.col("_whole"), "iqa").otherwise("base")
    reason = F.when(~F.col("_sound"), "not_finite").when(F.col("_whole"), "").otherwise("scores_incomplete")
    return held.select("id", budget, profile.alias("profile"), reason.alias("reason"), F.when(F.col("_sound"), F.col("x")).alias("x"))
