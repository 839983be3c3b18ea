"""Queries: names and times from text, saved projects, scores and rules that other operators use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import preset
from ..functions import names, numbers
from ..operators import pairs
from ..sources import files, models, projects
from . import proxies as P
from .proxies import with_


def capture_times(spark, sf):
    """From texts in two forms, with parts of a second where there are any, else the time of change."""
    p = P.photos(spark, sf).select("id", F.timestamp_micros("us").alias("ts"))
    exif = F.when(F.col("id") % 3 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(F.col("id") % 3 == 1, F.lit("unknown"))
    plain = F.when(F.col("id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    part = F.when(F.col("id") % 5 == 0, (F.col("id") % 1000).cast("string"))
    at = names.capture_time(exif, plain, modified=F.timestamp_micros(F.unix_micros("ts") + 7_000_000), subsecond=part)
    return p.select("id", F.unix_micros(at).alias("captured"))


def time_labels(spark, sf):
    r = P.in_sessions(spark, sf).groupBy("user_id", "session").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return r.select("user_id", "session", names.time_range_label(F.timestamp_seconds(F.floor("a")), F.timestamp_seconds(F.floor("b"))).alias("label"))


def objects_in_text(spark, sf):
    text = F.concat(F.lit("Sure: "), F.when(F.col("id") % 4 != 0, F.concat(F.lit('{"best": {"id": '), F.col("id").cast("string"), F.lit("}}"))).otherwise("none"), F.lit(" end"))
    o = names.json_within(text)
    return P.photos(spark, sf).select("id", o.alias("object"), F.get_json_object(o, "$.best.id").cast("long").alias("best"))


def metric_lookup(spark, sf):
    m = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("eye"), F.col("score"))).when(F.col("id") % 3 == 1, F.create_map(F.lit("eye_score"), F.col("score") / 2)).otherwise(F.create_map(F.lit("x"), F.lit(1.0)))
    return P.photos(spark, sf).select("id", F.round(numbers.metric(m, "eye", "eye_score", default=72.0), 6).alias("eye"))


def sound_ids(spark, sf):
    h = F.md5(F.col("id").cast("string"))
    text = F.when(F.col("id") % 3 == 0, h).when(F.col("id") % 3 == 1, F.upper(h)).otherwise(F.concat(F.lit(" "), F.substring(h, 1, 12)))
    return P.photos(spark, sf).select("id", names.sound_operation_id(text).alias("operation"), names.sound_request_id(text).alias("request"))


def reference_stems(spark, sf):
    path = F.concat(F.lit("/ref/"), F.col("grp").cast("string"), F.lit("/Img_"), (F.col("id") % 900).cast("string"), F.when(F.col("id") % 4 == 0, F.lit(".txt")).otherwise(F.lit(".JPG")))
    return files.reference_stems(P.photos(spark, sf).select(path.alias("path")))


def sources_provenance(spark, sf):
    ids = P.photos(spark, sf).select(F.sha2(F.col("id").cast("string"), 256).alias("photo_id"))
    return models.provenance(ids, {"preset": "balanced", "version": 2})


def whole_scores(spark, sf):
    """Outside scores, where a group has one for every photo."""
    rows = P.photos(spark, sf).select(F.col("id").alias("photo_id"), "grp")
    scores = P.photos(spark, sf).filter("id % 97 != 5").select(F.col("id").alias("photo_id"), F.floor("score").cast("double").alias("iqa"))
    return models.with_scores(rows, scores, "grp")


def _saved(spark, sf):
    """Photos as old and new projects saved them."""
    people = P.faces(spark, sf).groupBy("photo").agg(F.sort_array(F.collect_set((F.col("person") % 9).cast("string"))).alias("person_ids")).withColumnRenamed("photo", "_id")
    p = P.photos(spark, sf).join(people, F.col("id") == F.col("_id"), "left")
    some = lambda k, x: F.when(F.col("id") % k != 0, x)
    return p.select(
        F.lit("p1").alias("project_id"), F.col("id").cast("string").alias("id"), F.col("grp").cast("string").alias("group_id"), some(7, F.least(F.lit(3), F.floor(F.col("score") / 26).cast("int"))).alias("stars"), some(2, F.lit("primary")).alias("rating_tier"),
        some(3, F.lit("ai")).alias("rating_origin"), some(5, F.lit("rank")).alias("rating_reason"), some(4, F.col("id") % 11 == 0).alias("rating_locked"), some(6, F.lit("c")).alias("strict_duplicate_cluster_id"),
        some(8, F.array(F.lit("k"))).alias("coverage_keys"), F.lit(None).cast("array<string>").alias("issues"), "person_ids", some(9, F.lit(2)).alias("schema_version"),
    )


def migrated_photos(spark, sf):
    m = projects.migrated(_saved(spark, sf))
    return m.select(F.col("id").cast("long").alias("id"), "stars", "rating_tier", "rating_origin", "rating_reason", "rating_locked", F.size("coverage_keys").alias("keys"), F.size("person_ids").alias("people"), "status")


def project_groups(spark, sf):
    g = projects.groups(projects.migrated(_saved(spark, sf)))
    return g.select(F.col("group_id").cast("long").alias("group_id"), "members", F.size("best_ids").alias("best"), "protected", F.coalesce(F.array_join("people", ","), F.lit("")).alias("people"))


def pose_rules(spark, sf):
    """Whether poses allow a match, and whether they carry one, on evidence from scores."""
    u = F.floor("score") / 100
    e = F.struct((F.col("id") % 50 == 0).alias("strong"), F.when(F.col("id") % 4 != 0, 0.5 + u / 2).alias("pose"), F.when(F.col("id") % 5 != 0, u).alias("depth"), (F.col("id") % 7 != 0).alias("compatible"), u.alias("time"), (0.4 + u / 2).alias("scene"), (0.3 + u / 1.5).alias("total"))
    p = preset("balanced")
    held = P.photos(spark, sf).select("id", e.alias("e"))
    return held.select("id", pairs.pose_compatible(F.col("e"), preset("cautious"), -0.2).alias("compatible"), pairs.pose_supported(F.col("e"), p).alias("supported"))


def all_groups(spark, sf):
    """Groups and, as groups of one, the rows that have none."""
    p = P.photos(spark, sf)
    whole = p.filter("status != 'F'").groupBy(F.col("grp").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    failed = p.filter("status = 'F'").select(F.concat(F.lit("failed-"), F.col("id").cast("string")).alias("name"), F.lit(1).cast("long").alias("members"))
    return whole.unionByName(failed)


_SAVED = with_("photos", "faces") + """, k as (select photo, list(distinct (person % 9)::varchar) as people from faces group by 1),
s as (select id, grp, case when id % 7 <> 0 then least(3, floor(score / 26)::int) end as stars, case when id % 2 <> 0 then 'primary' end as tier, case when id % 3 <> 0 then 'ai' end as origin, case when id % 5 <> 0 then 'rank' end as reason,
 case when id % 4 <> 0 then id % 11 = 0 end as locked, id % 6 <> 0 as c, id % 8 <> 0 as keys, people, case when id % 9 <> 0 then 2 else 1 end as v from photos left join k on photo = id)"""
SQLS = {
    "capture_times": with_("photos") + """ select id, case when id % 3 = 0 or id % 2 = 0 then us // 1000000 * 1000000 + case when id % 5 = 0 then rpad((id % 1000)::varchar, 6, '0')::bigint else 0 end else us + 7000000 end as captured from photos""",
    "time_labels": with_("records", "sess") + " select user_id, session, strftime(make_timestamp(floor(min(t))::bigint * 1000000), '%H:%M') || '-' || strftime(make_timestamp(floor(max(t))::bigint * 1000000), '%H:%M') as label from sess group by 1, 2",
    "objects_in_text": with_("photos") + """ select id, case when id % 4 <> 0 then '{"best": {"id": ' || id || '}}' else '' end as object, case when id % 4 <> 0 then id end as best from photos""",
    "metric_lookup": with_("photos") + " select id, round(case id % 3 when 0 then score when 1 then score / 2 else 72.0 end, 6) as eye from photos",
    "sound_ids": with_("photos") + " select id, id % 3 = 0 as operation, id % 3 <> 2 as request from photos",
    "reference_stems": with_("photos") + " select distinct 'img_' || (id % 900) as stem from photos where id % 4 <> 0",
    "sources_provenance": with_("photos") + """, i as (select sha256(id::varchar) as x from photos), p as (select sha256(string_agg(x, '' order by x)) as h, count(*) as n from i group by x[1:2])
select sum(n)::bigint as sources, sha256(string_agg(h, '' order by h)) as digest, '{"preset": "balanced", "version": 2}' as settings from p""",
    "whole_scores": with_("photos") + ", h as (select id, grp, case when id % 97 <> 5 then floor(score)::double end as s from photos) select id as photo_id, grp, case when bool_and(s is not null) over (partition by grp) then s end as iqa from h",
    "migrated_photos": _SAVED + """ select id, coalesce(stars, 0) as stars, coalesce(tier, ['waste', 'valuable', 'coverage', 'primary'][coalesce(stars, 0) + 1]) as rating_tier, coalesce(origin, 'legacy') as rating_origin, coalesce(reason, 'legacy_score') as rating_reason, coalesce(locked, false) as rating_locked,
 keys::int as keys, coalesce(len(people), 0)::int as people, case when v >= 2 and c and keys then 'native' else 'rescan_required' end as status from s""",
    "project_groups": _SAVED + """, n as (select grp, count(*) as members, count(*) filter (where stars = 3)::int as best, coalesce(bool_or(locked), false) as protected from s group by 1), u as (select grp, unnest(people) as person from s), c as (select grp, person, count(*) as shown from u group by 1, 2),
o as (select c.grp, string_agg(person, ',' order by person) as people from c join n using (grp) where shown >= 0.2::double * members group by 1) select n.grp as group_id, members, best, protected, coalesce(people, '') as people from n left join o using (grp)""",
    "pose_rules": with_("photos") + """, e as (select id, id % 50 = 0 as strong, case when id % 4 <> 0 then 0.5::double + floor(score) / 100 / 2 end as pose, case when id % 5 <> 0 then floor(score) / 100 end as depth, id % 7 <> 0 as ok, floor(score) / 100 as u from photos)
select id, strong or pose is null or pose >= 0.48::double + 0.2::double as compatible, coalesce(pose >= 0.92 and (depth is null or depth >= 0.72) and ok and u >= 0.48 and 0.4::double + u / 2 >= 0.73::double - 0.15::double and 0.3::double + u / 1.5::double >= 0.73::double - 0.17::double, false) as supported from e""",
    "all_groups": with_("photos") + " select grp::varchar as name, count(*) as members from photos where status <> 'F' group by 1 union all select 'failed-' || id, 1 from photos where status = 'F'",
}
QUERIES = {k: globals()[k] for k in SQLS}
