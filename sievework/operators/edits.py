"""Edits by people as whole operations: the rating or identity that changes, and everything that follows from it.

A project's photos are rows (project, id, group_id, stars, ...). Groups and summaries are aggregates over rows, never lists
of members, so a project or group of any size costs partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TIER_OF_STARS
from .spread import spread


def _none() -> Column:
    return F.array().cast("array<string>")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def project_summary(photos: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a project: how many photos are of each kind, what coverage asks for, and how many copies of a cluster lead.

    photos: project, stars, category, issues, group_id, cluster, coverage_protected; projects: project, people, stages,
    required_cells, unresolved_cells, elapsed_seconds (null: 0). Null stars count as 0, a null or empty cluster as none.
    A project without photos has zeros; photos of an unknown project are not counted.
    """
    stars = F.coalesce("stars", F.lit(0))
    cluster = F.when((stars == 3) & (F.coalesce("cluster", F.lit("")) != ""), F.col("cluster"))
    settled = F.coalesce(F.col("category").isin("selected", "duplicate"), F.lit(False))
    issue = ~settled | (_flag("coverage_protected") & (F.size(F.coalesce("issues", _none())) > 0))
    named = {3: "primary", 2: "coverage", 1: "valuable", 0: "waste"}
    counts = {
        "total": F.count(F.lit(1)), "selected": F.count_if(stars >= 2), "duplicates": F.count_if(F.col("category") == "duplicate"), "issues": F.count_if(issue),
        "groups": F.count_distinct("group_id"), "coverage_protected": F.count_if(_flag("coverage_protected")),
        "primary_duplicate_leaks": F.count(cluster) - F.count_distinct(cluster),
    } | {name: F.count_if(stars == k) for k, name in named.items()}
    held = photos.groupBy("project").agg(*[c.alias(n) for n, c in counts.items()])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    given = {"people": "people", "coverage_stages": "stages", "coverage_required_cells": "required_cells", "coverage_unresolved_cells": "unresolved_cells"}
    cols = [zero(n).alias(n) for n in counts] + [zero(c).alias(n) for n, c in given.items()] + [zero(n).alias(f"stars_{k}") for k, n in named.items()]
    return projects.join(held, "project", "left").select("project", *cols, F.bround(F.coalesce("elapsed_seconds", F.lit(0.0)), 1).alias("elapsed_seconds"))


@dataclass(frozen=True)
class Rated:
    """photos after the ratings; groups that were touched; a log row a photo that was rated; ratings that were refused."""

    photos: DataFrame
    groups: DataFrame
    log: DataFrame
    refused: DataFrame


def rate(photos: DataFrame, ratings: DataFrame, order: list[str]) -> Rated:
    """Manual ratings (id, stars, locked, and the order columns) put on photos; of several for a photo the last by order counts.

    A rating outside 0 to 3 or of an unknown photo is refused. A rated photo has the tier of its stars, is manual, is locked
    as asked (null: locked), needs no review and no longer stands for coverage. groups: project, group_id, members, best
    (members of two stars and more), coverage_protected. log: project, id, group_id, previous_tier, tier, stars. Rows of photos
    with null ids are never rated; ids are taken to be unique.
    """
    tier = F.create_map(*[F.lit(x) for kv in TIER_OF_STARS.items() for x in kv])
    fit = F.coalesce(F.col("stars").between(0, 3), F.lit(False))
    asked = ratings.filter(fit).groupBy("id").agg(F.max_by(F.struct(F.col("stars").cast("int").alias("stars"), F.coalesce("locked", F.lit(True)).alias("locked")), F.struct(*order)).alias("_r"))
    held = photos.join(asked, "id", "left")
    new = F.col("_r").isNotNull()
    fill = {
        "stars": F.col("_r.stars"), "rating_tier": F.element_at(tier, F.col("_r.stars")), "rating_origin": F.lit("manual"), "rating_reason": F.lit("manual_override"), "rating_locked": F.col("_r.locked"),
        "needs_review": F.lit(False), "coverage_protected": F.lit(False), "coverage_person_ids": _none(),
    }
    after = held.select(*[F.when(new, fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in photos.columns], new.alias("_new"), F.when(new, F.col("rating_tier")).alias("_was"))
    log = after.filter("_new").select("project", "id", "group_id", F.col("_was").alias("previous_tier"), F.col("rating_tier").alias("tier"), "stars")
    groups = after.groupBy("project", "group_id").agg(F.bool_or("_new").alias("_new"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("stars") >= 2).alias("best"), F.bool_or(_flag("coverage_protected")).alias("coverage_protected"))
    known = ratings.join(photos.select("id", F.lit(True).alias("_known")), "id", "left")
    refused = known.select("id", "stars", F.when(~fit, "range").when(F.col("_known").isNull(), "unknown").alias("why")).filter("why is not null")
    return Rated(after.drop("_new", "_was"), groups.filter("_new").drop("_new"), log, refused)


@dataclass(frozen=True)
class Corrected:
    """faces and photos after the corrections, the people of each group, and projects with outcome (applied, conflict, kept)."""

    faces: DataFrame
    photos: DataFrame
    group_people: DataFrame
    projects: DataFrame


def correct_identities(faces: DataFrame, photos: DataFrame, projects: DataFrame, requests: DataFrame, merges: DataFrame, splits: DataFrame, count: int | None = None) -> Corrected:
    """Identity corrections of projects whose revision is the one the request was made against; the others change nothing.

    faces: project, photo, face_index, person; photos: project, id, group_id, person_ids, coverage_keys, coverage_protected;
    projects: project, identity_revision, rescan_required, required_cells, unresolved_cells; requests: project, revision (of
    several the least counts); merges: project, person, new_person; splits: project, photo, face_index, new_person, of which
    the least new person counts. A split goes before a merge. Where a correction applies, people of photos and groups are
    counted anew, coverage is emptied and unknown (null) until the next scan, and the revision rises by one.
    count: rows of faces, for tasks of bounded size.
    """
    deal = lambda t, *k: t if count is None else spread(t, count, *k)
    asked = requests.groupBy("project").agg(F.min("revision").alias("_asked"))
    state = projects.join(asked, "project", "left")
    fits = F.coalesce(F.col("_asked") == F.coalesce("identity_revision", F.lit(0)), F.lit(False))
    outcome = F.when(F.col("_asked").isNull(), "kept").when(fits, "applied").otherwise("conflict")
    renewed = {"identity_revision": F.coalesce("identity_revision", F.lit(0)) + 1, "rescan_required": F.lit(True), "required_cells": F.lit(None), "unresolved_cells": F.lit(None)}
    told = state.select(*[F.when(fits, renewed[c]).otherwise(F.col(c)).alias(c) if c in renewed else F.col(c) for c in projects.columns], outcome.alias("outcome"))
    open_ = F.broadcast(state.filter(fits).select("project", F.lit(True).alias("_open")))  # a row a project: rows aren't dealt by it
    one = lambda t, k: t.groupBy(*k).agg(F.min("new_person").alias("_to"))
    m = one(merges, ["project", "person"]).withColumnRenamed("_to", "_merged")
    s = one(splits, ["project", "photo", "face_index"]).withColumnRenamed("_to", "_split")
    place = ["project", "photo", "face_index"]
    held = deal(faces.join(open_, "project", "left"), *place).join(deal(s, *place), place, "left")
    held = deal(held, "project", "person").join(deal(m, "project", "person"), ["project", "person"], "left")
    person = F.when(F.col("_open"), F.coalesce("_split", "_merged", "person")).otherwise(F.col("person")).alias("person")
    moved = held.select(*[person if c == "person" else F.col(c) for c in faces.columns])
    seen = deal(moved.select("project", F.col("photo").alias("id"), "person"), "project", "id").groupBy("project", "id").agg(F.array_compact(F.sort_array(F.collect_set("person"))).alias("_people"))
    now = deal(photos, "project", "id").join(open_, "project", "left").join(seen, ["project", "id"], "left")
    anew = {"person_ids": F.coalesce("_people", _none()), "coverage_keys": _none(), "coverage_protected": F.lit(False)}
    after = now.select(*[F.when(F.col("_open"), anew[c]).otherwise(F.col(c)).alias(c) if c in anew else F.col(c) for c in photos.columns])
    people = deal(after.select("project", "group_id", F.explode("person_ids").alias("person")), "project", "group_id").distinct()
    return Corrected(moved, after, people, told)
