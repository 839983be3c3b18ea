"""Queries: reviews, outside rankings, model choice, coverage of greedy folds by recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, quality
from ..operators import filters, folds, ranking, review
from . import proxies as P
from .proxies import read, with_


def _ab_records(spark, sf):
    p = P.photos(spark, sf)
    return p.select("id", (F.col("id") % 9 != 0).alias("success"), (F.col("id") % 3 == 0).alias("baseline_hit"), (F.col("id") % 4 == 0).alias("raw_hit"), ((F.col("id") % 4 == 0) | (F.col("score") > 80)).alias("effective_hit"), (F.col("id") % 2 == 0).alias("top2_hit"), (F.col("id") % 7 == 0).alias("changed"), (F.col("id") % 100).cast("double").alias("seconds"))


def ab_summary(spark, sf):
    return review.ab_summary(_ab_records(spark, sf))


def ab_effects(spark, sf):
    return _ab_records(spark, sf).select("id", review.ab_effect(F.col("baseline_hit"), F.col("effective_hit")).alias("effect"))


def decision_keys(spark, sf):
    p = P.photos(spark, sf)
    photos = F.collect_list(F.struct(F.col("id").alias("id"), F.col("us").alias("file"), F.floor(F.col("score") * 1000).alias("score"), F.col("status").alias("issue")))
    return p.groupBy("grp").agg(photos.alias("photos")).select("grp", review.decision_key(F.col("grp").cast("string"), F.lit("m-8b:q4"), F.lit("v3"), F.col("photos")).alias("key"))


def group_prompts(spark, sf):
    people = P.faces(spark, sf).groupBy("photo").agg(F.collect_set(F.col("person").cast("string")).alias("people")).withColumnRenamed("photo", "id")
    issues = F.when(F.col("status") == "F", F.array(F.lit("closed_eyes"))).otherwise(F.array().cast("array<string>"))
    rows = P.photos(spark, sf).join(people, "id").select("grp", "id", review.fact_line(F.col("id"), [("technical_score", F.col("score")), ("eye_score", F.col("score") / 2)], F.col("people"), issues).alias("line"))
    made = review.group_prompts(rows, "grp", "id", "line", F.concat(F.lit("group "), F.col("grp").cast("string")))
    return made.select("grp", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("n_chars"))


def eye_disagreements(spark, sf):
    rows = ranking.ranked(P.photos(spark, sf), ["grp"], [F.desc("score"), F.col("id")])
    facts = rows.select("grp", "rank", F.col("id").cast("string").alias("name"), (F.col("id") % 4 == 0).alias("manual"), (F.col("id") % 10 == 0).alias("closed"), (F.col("id") % 6 == 0).alias("uncertain"), F.when(F.col("id") % 5 != 0, F.col("score")).alias("eye"), (F.col("status") == "P").alias("eye_issue"))
    return review.eye_disagreements(facts, "grp")


def _protected(spark, sf):
    rows = P.photos(spark, sf).select("id", F.when(F.col("score") > 80, "selected").when(F.col("status") == "F", "blurred").otherwise("duplicate").alias("category"), F.when(F.col("id") % 3 == 0, F.array(F.lit("noisy"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    picks = P.faces(spark, sf).filter("line = 1 and area >= 0.004").select(F.col("photo").alias("id"))
    return review.protected(rows, picks, "id")


def coverage_protection(spark, sf):
    return _protected(spark, sf).select("id", "category", "original_category", "protected", "reason")


def protected_counts(spark, sf):
    return review.protected_counts(_protected(spark, sf))


def group_confidence(spark, sf):
    rows = ranking.ranked(P.photos(spark, sf), ["grp"], [F.col("us"), F.col("id")])
    return review.group_confidence(rows.withColumn("e", F.when(F.col("rank") > 1, F.floor(F.col("score")) / 100)), "grp", "e").select("grp", F.round("confidence", 6).alias("confidence"))


def face_pages(spark, sf):
    """Faces of nobody known, in pages of 48."""
    f = P.faces(spark, sf).groupBy("photo", "line").agg(F.min("person").alias("p")).select("photo", "line", F.when(F.col("p") % 10 != 0, F.col("p")).alias("person"))
    return review.face_page(f, [F.col("photo"), F.col("line")], 48, "unknown").select("photo", "line", "page")


def people_and_stages(spark, sf):
    """Each group's distinct people in order, and the label that its last photo has."""
    f = P.photos(spark, sf).join(P.faces(spark, sf).select(F.col("photo").alias("id"), "person"), "id")
    return filters.people_and_label(f, "grp", "person", "priority", ["us", "id"]).select("grp", F.array_join("people", ",").alias("people"), "label")


def progress_eta(spark, sf):
    per = P.records(spark, sf).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("elapsed"), F.count_if(F.col("value") >= 50).alias("done"), F.count(F.lit(1)).alias("n"))
    return per.select("user_id", *review.progress(F.floor("elapsed").cast("double"), F.col("done"), F.col("n")))


def queue_depths(spark, sf):
    path = F.concat(F.lit("/queue/"), F.when(F.col("event_type") == "error", "processing").otherwise("inbox"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return review.queue_depths(P.records(spark, sf).select(path.alias("path")), "path")


def delivered_folders(spark, sf):
    path = F.concat(F.lit("/photos/"), F.col("grp").cast("string"), F.lit("/"), F.col("status"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))
    return review.delivered_folders(P.photos(spark, sf).filter("score >= 52").select(path.alias("path")), "path")


def composition_scores(spark, sf):
    f = P.faces(spark, sf).select("photo", ((F.col("person") % 80) / 100).alias("x"), ((F.col("line") * 11 % 80) / 100).alias("y"))
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 0.2).alias("x2"), (F.col("y") + 0.2).alias("y2"))
    per = f.groupBy("photo").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    held = P.photos(spark, sf).select(F.col("id").alias("photo"), "score").join(per, "photo", "left")
    return held.select("photo", F.round(quality.composition(F.coalesce("boxes", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), F.col("score")), 5).alias("composition"))


def preference_vectors(spark, sf):
    metrics = P.photos(spark, sf).select(F.col("id").alias("photo"), F.col("score").alias("technical_score"), (F.col("score") / 2).alias("eye_score"))
    f = P.faces(spark, sf).select("photo", (F.col("confidence") >= 0.7).alias("quality"), "area", "occlusion", (F.col("line") * 5.0).alias("yaw"), (F.col("line") / 7).alias("smile"))
    x = review.preference_vector(metrics, f, "photo")
    at = {n: F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(review.PREFERENCE_FEATURES)}
    return x.select("photo", F.size("x").alias("n"), *[at[n] for n in ("technical_score", "eye_score", "noise_score", "face_count", "largest_face_ratio", "mean_occlusion_risk", "mean_abs_yaw", "mean_smile_score", "portrait_present")])


def _blend_rows(spark, sf):
    p = P.photos(spark, sf)
    return p.select("grp", "id", F.floor("score").cast("double").alias("generic"), ((F.col("id") * 7919 % 101) / 101).alias("learned"), ((F.col("id") % 3 == 0) | (F.col("score") > 75)).alias("good"))


def blend_curve(spark, sf):
    return review.blend_curve(_blend_rows(spark, sf), "grp", "generic", "learned", F.col("good"), "id")


def chosen_blend(spark, sf):
    return review.chosen_blend(blend_curve(spark, sf))


def filter_gates(spark, sf):
    """Per language: whether labelled scores may reject rows."""
    x = P.labelled(spark, sf).groupBy("lang").agg(F.bround(F.avg("score"), 4).alias("auc"), F.bround(F.avg(((F.col("score") > 0.4) == F.col("good")).cast("double")), 4).alias("f1"), F.bround(F.avg(F.col("toxic").cast("double")), 4).alias("rate"))
    return x.select("lang", review.filter_gate(F.lit("pointwise"), F.col("auc"), F.col("f1"), F.col("rate")).alias("may_reject"))


def coefficient_report(spark, sf):
    w = P.records(spark, sf).groupBy("event_type").agg(F.round(F.avg("value") - 50, 6).alias("w"))
    return review.coefficient_report(w, "event_type", "w")


def training_sets(spark, sf):
    p = P.photos(spark, sf)
    listing = p.select("status", "id", F.col("us").alias("signature"), (F.col("id") % 5000).alias("stem"))
    cached = p.filter("id % 8 != 0").select("id", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("us")).alias("signature"))
    labels = p.filter("id % 4 = 1").select((F.col("id") % 5000).alias("stem"))
    return review.training_set(cached, listing, labels, "status", "id", "stem")


def distinct_poses(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("image"), "embedding")
    twin = e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), "image", F.transform("embedding", lambda x: x * 1.001).alias("embedding"))
    joint = lambda k: F.struct(F.col("embedding")[3 * k].cast("double").alias("x"), F.col("embedding")[3 * k + 1].cast("double").alias("y"), F.lit(0.9).alias("reliability"))
    poses = e.union(twin).select("vec_id", "image", F.array(*map(joint, range(12))).alias("joints"), "embedding", (F.col("vec_id") % 1_000_000 % 17).alias("presence"))
    return folds.distinct_poses(poses, "image", "joints", "embedding", [F.desc("presence")], "vec_id").select("image", "vec_id")


def group_resync(spark, sf):
    rows = ranking.ranked(P.photos(spark, sf), ["grp"], [F.desc("score"), F.col("id")])
    stars = F.when(F.col("id") % 6 == 0, 3).otherwise(F.least(F.lit(3), F.floor(F.col("score") / 26).cast("int")))
    return review.group_resync(rows.withColumn("stars", stars), "grp", "id", "stars", "rank")


def checked_changes(spark, sf):
    p = P.photos(spark, sf)
    current = p.select("id", F.col("status").alias("value"), (F.col("id") % 3).alias("revision"))
    changes = p.filter("id % 4 = 0").select("id", (F.col("id") % 2).alias("expected_revision"), F.lit("X").alias("value"))
    return review.checked_changes(current, changes, "id")


def leading_receipts(spark, sf):
    e = P.records(spark, sf)
    kinds = F.element_at(F.array(*map(F.lit, ("preflight", "execute", "heartbeat"))), (F.col("event_id") % 3 + 1).cast("int"))
    return review.leading_receipt(e.select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string")).alias("operation"), kinds.alias("kind"), F.col("event_id").alias("revision"), F.col("event_type").alias("status")), "operation")


def journal_progress(spark, sf):
    e = P.records(spark, sf)
    state = F.when(F.col("value") >= 40, "verified").when(F.col("value") < 10, "failed").otherwise("copied")
    return review.journal_progress(e.select("user_id", (F.col("event_id") % 11).alias("item"), F.col("event_id").alias("revision"), state.alias("state")), "user_id", "item", "revision")


def path_hashes(spark, sf):
    path = F.concat(F.lit("/Photos"), F.when(F.col("id") % 2 == 0, F.lit("//")).otherwise(F.lit("\\")), F.col("status"), F.lit("/./IMG_"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, F.lit(".JPG/")).otherwise(F.lit(".jpg")))
    return P.photos(spark, sf).select("id", names.normal_path(path).alias("path"), names.path_hash(path).alias("hash"))


def identity_names(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("identity"), (F.col("vec_id") % 13).alias("photo"))
    return folds.identity_names(e, "identity", "photo")


_AB = with_("photos") + ", r as (select id, id % 9 <> 0 as success, id % 3 = 0 as b, id % 4 = 0 as raw, (id % 4 = 0 or score > 80) as e, id % 2 = 0 as top2, id % 7 = 0 as changed, (id % 100)::double as s from photos)"
_PROT = with_("photos", "faces") + """, rows_ as (select id, case when score > 80 then 'selected' when status = 'F' then 'blurred' else 'duplicate' end as c, id % 3 = 0 as noisy from photos), picks as (select distinct photo as id from faces where line = 1 and area >= 0.004),
x as (select r.*, k.id is not null and c <> 'selected' as protected from rows_ r left join picks k using (id))"""
_BLEND = with_("photos") + """, w as (select 0.0::double as weight union all select round(0.05::double + 0.55::double * k / 11, 4) from range(12) t(k)),
b as (select grp, id, floor(score)::double as generic, (id * 7919 % 101) / 101 as learned, (id % 3 = 0 or score > 75)::int as y from photos),
s as (select weight, grp, id, y, round((1 - weight) * generic + weight * 100 * learned, 9) as s from b, w),
r as (select *, rank() over (partition by weight, grp order by s) + (count(*) over (partition by weight, grp, s) - 1) / 2 as r from s),
g as (select weight, grp, sum(y) as p, count(*) as n, sum(r) filter (where y = 1) as ranks, arg_min(y, (-s, id)) as first from r group by 1, 2 having sum(y) > 0 and sum(y) < count(*)),
curve as (select weight, count(*) as groups, round_even(avg(first::double), 6) as top1, round_even(sum(ranks - p * (p + 1) / 2) / sum(p * (n - p)), 6) as pairwise from g group by 1)"""
_DIST = "sqrt((cx - {a}) ** 2 + (cy - {b}) ** 2)"
SQLS = {
    "ab_summary": _AB + """ select count(*) as requested_groups, count(*) filter (where success) as successes, count(*) filter (where not success) as failures, count(*) filter (where success and b) as baseline_top1_hits, count(*) filter (where success and raw) as raw_top1_hits,
 count(*) filter (where success and e) as effective_top1_hits, count(*) filter (where success and top2) as effective_top2_hits, count(*) filter (where success and changed) as applied_changes, count(*) filter (where success and e and not b) as improvements, count(*) filter (where success and b and not e) as regressions,
 count(*) filter (where success and b = e) as neutral, coalesce(round_even(avg(s) filter (where success), 2), 0.0) as average_group_seconds from r""",
    "ab_effects": _AB + " select id, case when e and not b then 'improved' when b and not e then 'regressed' else 'neutral' end as effect from r",
    "decision_keys": with_("photos") + " select grp, sha256('v3|m-8b:q4|' || grp || '|' || string_agg(id || ',' || us || ',' || floor(score * 1000)::bigint || ',' || status, ';' order by id)) as key from photos group by grp",
    "group_prompts": with_("photos", "faces") + """, k as (select photo, string_agg(person, ',' order by person) as people from (select distinct photo, person::varchar as person from faces) group by 1),
l as (select grp, id, 'Photo ' || id || ': technical_score=' || floor(score)::bigint || '.' || (floor(score * 10)::bigint % 10) || ', eye_score=' || floor(score / 2)::bigint || '.' || (floor(score / 2 * 10)::bigint % 10) || ', persons=[' || people || '], hard_issues=[' || case when status = 'F' then 'closed_eyes' else 'none' end || ']' as line from photos join k on k.photo = photos.id),
p as (select grp, 'group ' || grp || chr(10) || string_agg(line, chr(10) order by id) as prompt from l group by 1) select grp, sha256(prompt) as prompt_sha256, length(prompt)::int as n_chars from p""",
    "eye_disagreements": with_("photos") + """, r as (select *, row_number() over (partition by grp order by score desc, id) as rank from photos), f as (select grp, rank, id, id % 4 = 0 as manual, id % 10 = 0 as closed, id % 6 = 0 as uncertain, case when id % 5 <> 0 then score else 72 end as eye, status = 'P' as issue from r),
g as (select grp, arg_min(struct_pack(m := manual, e := eye, i := issue), rank) as w, arg_min(struct_pack(c := closed, u := uncertain, e := eye, i := issue), rank) filter (where manual) as m, count(*) filter (where manual and closed) as c, count(*) filter (where manual and uncertain) as u from f group by 1),
t as (select sum(c)::bigint as manual_with_decisive_closed, sum(u)::bigint as manual_with_uncertain_eye, count(*) filter (where m is not null and not w.m) as top1_disagreements, count(*) filter (where m is not null and not w.m and (m.c or m.u or abs(w.e - m.e) >= 8 or m.i or w.i)) as eye_related_top1_disagreements from g)
select *, case when top1_disagreements > 0 then round_even(eye_related_top1_disagreements / top1_disagreements, 4) else 0.0 end as eye_related_disagreement_rate from t""",
    "coverage_protection": _PROT + " select id, case when protected then 'selected' else c end as category, c as original_category, protected, case when protected then 'person_stage_gap' end as reason from x",
    "protected_counts": _PROT + " select c as original_category, count(*) as rows, count(*) filter (where noisy) as with_issues from x where protected group by 1",
    "group_confidence": with_("photos") + ", r as (select *, row_number() over (partition by grp order by us, id) as n from photos) select grp, round(coalesce(avg(floor(score) / 100) filter (where n > 1), 1.0), 6) as confidence from r group by 1",
    "face_pages": with_("faces") + ", f as (select photo, line, min(person) as p from faces group by 1, 2) select photo, line, (row_number() over (order by photo, line) - 1) // 48 + 1 as page from f where p % 10 = 0",
    "people_and_stages": with_("photos", "faces") + ", f as (select grp, person, priority, us, id from photos join faces on photo = id) select grp, (select string_agg(x, ',' order by x) from (select unnest(list_distinct(list(person))) as x)) as people, arg_max(priority, (us, id)) as label from f group by 1",
    "progress_eta": with_("records") + ", p as (select user_id, floor(max(t) - min(t))::double as elapsed, count(*) filter (where value >= 50) as done, count(*) as n from records group by 1) select user_id, round_even(elapsed, 1) as elapsed_seconds, case when done > 0 then round_even(elapsed / done * (n - done), 0)::bigint end as eta_seconds from p",
    "queue_depths": with_("records") + " select case when event_type = 'error' then 'processing' else 'inbox' end as folder, count(*) as files from records group by 1",
    "delivered_folders": with_("photos") + " select '/photos/' || grp || '/' || status as folder, count(*) as rows from photos where score >= 52 group by 1",
    "composition_scores": with_("photos", "faces") + f""", f as (select photo, (person % 80) / 100 as x1, (line * 11 % 80) / 100 as y1 from faces), c as (select photo, x1, y1, (x1 + (x1 + 0.2::double)) / 2 as cx, (y1 + (y1 + 0.2::double)) / 2 as cy from f),
d as (select photo, greatest(0, least(100, 100 - 165 * least({', '.join(_DIST.format(a=f'{a!r}::double', b=f'{b!r}::double') for a, b in quality.ANCHORS)}))) as v, least(x1, y1, 1 - (x1 + 0.2::double), 1 - (y1 + 0.2::double)) < 0.008 as cut from c),
g as (select photo, avg(v) as v, bool_or(cut) as cut from d group by 1)
select p.id as photo, round(case when g.photo is null then greatest(0, least(100, 62 + (score - 50) * 0.16::double)) else greatest(0, least(100, v - case when cut then 30 else 0 end)) end, 5) as composition from photos p left join g on g.photo = p.id""",
    "preference_vectors": with_("photos", "faces") + """, f as (select photo, confidence >= 0.7 as q, area, occlusion, line from faces), g as (select photo, count(*) as n, coalesce(max(area) filter (where q), 0) * 1000 as large, coalesce(avg(occlusion) filter (where q), 0) * 100 as occ, coalesce(avg(line * 5.0) filter (where q), 0) as yaw, coalesce(avg(line / 7) filter (where q), 0) as smile, bool_or(q)::int::double as portrait from f group by 1)
select p.id as photo, 29 as n, round(score, 6) as technical_score, round(score / 2, 6) as eye_score, 0.0::double as noise_score, coalesce(g.n, 0)::double as face_count, round(coalesce(large, 0), 6) as largest_face_ratio, round(coalesce(occ, 0), 6) as mean_occlusion_risk, round(coalesce(yaw, 0), 6)::double as mean_abs_yaw, round(coalesce(smile, 0), 6) as mean_smile_score, coalesce(portrait, 0)::double as portrait_present from photos p left join g on g.photo = p.id""",
    "blend_curve": _BLEND + " select *, round_even(top1 + pairwise, 6) as utility from curve",
    "chosen_blend": _BLEND + """, u as (select *, round_even(top1 + pairwise, 6) as utility from curve), top as (select * from u order by utility desc, weight limit 1), z as (select top1 as t0, pairwise as p0 from u where weight = 0),
c as (select weight, groups, top1, pairwise, round_even(top1 - t0, 6) as top1_uplift, round_even(pairwise - p0, 6) as pairwise_uplift from top, z), v as (select *, groups >= 20 and pairwise >= 0.54 and (top1_uplift >= 0.02 or pairwise_uplift >= 0.025) and weight > 0 as validated from c)
select case when validated then weight else 0.0 end as weight, top1, pairwise, top1_uplift, pairwise_uplift, validated, round_even(case when validated then least(1.0, greatest(0.2, greatest(top1_uplift, pairwise_uplift) / 0.12)) else 0.0 end, 4) as strength from v""",
    "filter_gates": with_("labelled") + ", x as (select lang, round_even(avg(score), 4) as auc, round_even(avg(((score > 0.4) = good)::int::double), 4) as f1, round_even(avg(toxic::int::double), 4) as rate from labelled group by 1) select lang, auc >= 0.62 and f1 - 2 * rate / (1 + rate) >= 0.04 as may_reject from x",
    "coefficient_report": with_("records") + ", w as (select event_type, round(avg(value) - 50, 6) as w from records group by 1) select event_type, w as weight, row_number() over (order by abs(w) desc, event_type) as place from w",
    "training_sets": with_("photos") + """, c as (select id, case when id % 5 = 0 then 0 else us end as s from photos where id % 8 <> 0), l as (select distinct id % 5000 as stem from photos where id % 4 = 1),
h as (select status, coalesce(c.s = p.us, false) as valid, l.stem is not null as hit from photos p left join c using (id) left join l on l.stem = p.id % 5000)
select status, count(*) as listed, count(*) filter (where valid) as cached, count(*) filter (where hit) as labelled, count(*) filter (where valid and hit) as positive, round_even(avg(valid::int::double), 6) as coverage from h group by 1""",
    "group_resync": with_("photos") + """, r as (select *, row_number() over (partition by grp order by score desc, id) as rank, case when id % 6 = 0 then 3 else least(3, floor(score / 26)::int) end as stars from photos)
select grp, arg_min(id, (-stars, rank, id)) as best, count(*) filter (where stars >= 2) as delivered, concat_ws('/', count(*) filter (where stars = 0), count(*) filter (where stars = 1), count(*) filter (where stars = 2), count(*) filter (where stars = 3)) as summary from r group by 1""",
    "checked_changes": with_("photos") + """, c as (select id, status as value, id % 3 as revision, case when id % 4 = 0 then id % 2 end as e from photos)
select id, case when e = revision then 'X' else value end as value, revision + case when e = revision then 1 else 0 end as revision, case when e is null then 'kept' when e = revision then 'applied' else 'conflict' end as outcome from c""",
    "leading_receipts": with_("records") + """, r as (select user_id || '-' || (event_id % 5) as operation, ['preflight', 'execute', 'heartbeat'][event_id % 3 + 1] as kind, event_id as revision, event_type as status from records)
select operation, kind, revision, status from (select *, row_number() over (partition by operation order by kind = 'execute' desc, revision desc) as k from r where kind <> 'heartbeat') where k = 1""",
    "journal_progress": with_("records") + """, j as (select user_id, event_id % 11 as item, event_id as revision, case when value >= 40 then 'verified' when value < 10 then 'failed' else 'copied' end as state from records)
select a.user_id, a.revision, count(*) filter (where l.state = 'verified') as done, count(*) filter (where l.state = 'failed') as failed from (select distinct user_id, revision from j) a,
 lateral (select item, arg_max(state, b.revision) as state from j b where b.user_id = a.user_id and b.revision <= a.revision group by item) l group by 1, 2""",
    "path_hashes": with_("photos") + ", p as (select id, '/photos/' || lower(status) || '/img_' || id || '.jpg' as path from photos) select id, path, sha256(path)[1:24] as hash from p",
    "identity_names": "with f as (select label::bigint as identity, count(distinct vec_id % 13) as photos, count(*) as faces from embeddings where label > 0 group by 1) select identity, 'person-' || lpad((row_number() over (order by photos desc, faces desc, identity))::varchar, 3, '0') as name, photos, faces from f",
}
QUERIES = {k: globals()[k] for k in [*SQLS, "distinct_poses"]}
