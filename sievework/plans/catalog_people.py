"""Queries: faces, people, quality, coverage, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, quality
from ..operators import filters, folds, selection
from ..operators.spread import spread
from . import proxies as P
from .proxies import read, with_

SIG = "((area >= 0.0006 and confidence >= 0.82) or (area >= 0.0010 and confidence >= 0.65) or (area >= 0.0025 and confidence >= 0.55))"
REL = "((area >= 0.0007 and confidence >= 0.90) or (area >= 0.0018 and confidence >= 0.78) or (area >= 0.0035 and confidence >= 0.65))"


def _flags(f):
    person, area, conf = F.col("person"), F.col("area"), F.col("confidence")
    return filters.significant_face(person, area, conf), filters.reliable_face(person, area, conf)


def face_flags(spark, sf):
    f = P.faces(spark, sf)
    sig, rel = _flags(f)
    return f.groupBy("photo").agg(F.countDistinct(F.when(sig, F.col("person"))).alias("significant"), F.countDistinct(F.when(rel, F.col("person"))).alias("reliable"), F.max("area").alias("largest"))


def quality_faces(spark, sf):
    kept = filters.quality_faces(P.faces(spark, sf).withColumn("roll", F.col("line") * 7.0), "photo", "area", "confidence", "roll")
    return kept.groupBy("photo").agg(F.count(F.lit(1)).alias("faces"), F.min("area").alias("smallest"))


def eligible_people(spark, sf):
    f = P.faces(spark, sf)
    sig, rel = _flags(f)
    return selection.eligible_people(f.filter(sig), "photo", "person", "area", rel)


def _photo_faces(spark, sf, *facts):
    """Faces with facts of their photos, and their number, in tasks of bounded size."""
    f = P.faces(spark, sf)
    n = f.count()
    p = P.photos(spark, sf).select(F.col("id").alias("photo"), *facts)
    return spread(f, n, "photo").join(spread(p, n, "photo"), "photo"), n


def dominant_people(spark, sf):
    f, n = _photo_faces(spark, sf, "grp")
    f = spread(f.select("grp", "photo", "person").distinct(), n, "grp")
    sizes = f.groupBy("grp").agg(F.countDistinct("photo").alias("n"))
    shown = f.groupBy("grp", "person").agg(F.count(F.lit(1)).alias("k")).join(sizes, "grp")
    dominant = F.col("k") >= F.greatest(F.lit(2), numbers.round_half_even(F.lit(0.45) * F.col("n")))
    stable = F.col("k") >= F.greatest(F.lit(1), F.ceil(0.35 * F.col("n")))
    return shown.filter(dominant | stable).select("grp", "person", dominant.alias("dominant"), stable.alias("stable"))


def repeated_people(spark, sf):
    f = P.faces(spark, sf).select("photo", "person").distinct()
    return f.groupBy("person").agg(F.count(F.lit(1)).alias("photos")).filter("photos >= 2")


def quality_rollup(spark, sf):
    f = P.faces(spark, sf)
    eye = F.when(F.col("occlusion") < 0.3, "Open").when(F.col("occlusion") < 0.6, "Partial").otherwise("Closed")
    open_ = quality.eye_open_score(eye, F.col("confidence"), F.col("area"), F.col("line") > 5)
    face = quality.face_quality(F.col("sharp"), F.col("sharp") / 2, open_, F.col("line") * 5.0, F.col("line") * 3.0, F.col("occlusion"), F.lit(None).cast("double"))
    q = f.select("photo", "area", open_.alias("eye"), face.alias("face"))
    mix = lambda c, a: a * F.min(c) + (1 - a) * F.avg(c)
    return q.groupBy("photo").agg(F.round(mix("eye", 0.72), 4).alias("eye_score"), F.round(0.35 * F.avg("face") + 0.40 * F.min("face") + 0.25 * F.max(F.struct("area", "face"))["face"], 4).alias("face_score"), F.count_if(F.col("face") < 45).alias("bad_faces"))


def issue_category(spark, sf):
    e = P.records(spark, sf)
    issues = F.array_compact(F.array(F.when(F.col("event_type") == "error", "soft_subject"), F.when(F.col("value") > 90, "closed_eyes"), F.when(F.col("value") < 5, "noisy"), F.when(F.col("event_id") % 11 == 0, "bad_exposure")))
    ok = filters.quality_eligible(F.lit(1), F.lit(1), F.col("value"), issues, 10.0)
    return e.select("event_id", quality.issue_category(issues, F.col("event_id") % 13 == 0).alias("category"), ok.alias("eligible"))


def generic_score(spark, sf):
    f = P.faces(spark, sf).groupBy("photo").agg(F.avg("sharp").alias("s"), F.avg("confidence").alias("c"), F.avg("occlusion").alias("o"), F.count(F.lit(1)).alias("k"))
    m = {"face": numbers.log_score(F.col("s"), 8, 900), "eye": 100 * F.col("c"), "subject": numbers.clamp(F.col("s") / 10), "exposure": 100 - 100 * F.col("o"), "expression": F.lit(60.0), "composition": F.lit(50.0), "contrast": 10.0 * F.col("k"), "technical": F.lit(70.0), "coverage": F.col("c"), "bad": F.col("k") % 3}
    g = quality.group_score(m, F.col("k") > 2)
    return f.select("photo", F.round(g + 1e-9, 5).alias("generic"), F.round(quality.blended(g, F.when(F.col("k") > 1, F.col("c")), 0.28) + 1e-9, 5).alias("blended"))


def coverage_cells(spark, sf):
    shown, n = _photo_faces(spark, sf, "priority")
    chosen = P.photos(spark, sf).filter("score >= 90").select(F.col("id").alias("photo"))
    return selection.coverage_cells(shown, "priority", "person", "photo", chosen, n)


def coverage_greedy(spark, sf):
    shown, n = _photo_faces(spark, sf, "grp", "score")
    cells = shown.groupBy("grp", "person", "photo").agg(F.max("score").alias("quality"))
    return selection.coverage_picks(cells, "grp", "person", "photo", "quality", count=n)


def _ranked_photos(spark, sf):
    p = P.photos(spark, sf)
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), F.col("c_nationkey").alias("budget"))
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "id")
    rows = p.join(c, "grp").select("budget", "id", F.col("grp"), F.floor(F.col("us") / 86_400_000_000 / 7).alias("week"), F.concat_ws("-", F.col("grp").cast("string"), F.col("us").cast("string")).alias("cluster"), F.bround(F.col("score") / 100, 4).alias("base"), F.row_number().over(w).alias("rank"), (F.col("score") >= 20).alias("eligible"), F.when(F.col("id") % 101 == 0, 3).alias("locked_stars"))
    return rows.withColumn("beat", F.concat_ws("-", F.col("grp").cast("string"), F.col("week").cast("string"))).drop("week")


def primary_budget(spark, sf):
    return selection.primary_selection(_ranked_photos(spark, sf), "budget", part="grp", count=P.photos(spark, sf).count())


def delivery_reserve(spark, sf):
    rows = _ranked_photos(spark, sf)
    keys = P.faces(spark, sf).filter("area >= 0.003").groupBy("photo").agg(F.sort_array(F.collect_set(F.col("person") % 20)).alias("keys")).withColumnRenamed("photo", "id")
    held = rows.join(keys, "id", "left").select("budget", "id", "grp", "beat", "cluster", F.col("base").alias("quality"), F.col("base").alias("stable"), "rank", (F.col("id") % 3).alias("severe"), F.col("locked_stars").isNull().alias("eligible"), ((F.col("rank") == 1)).alias("delivered"), "keys")
    return selection.delivery_reserve(held, "budget")


def value_layer(spark, sf):
    rows = P.photos(spark, sf).withColumn("cluster", F.col("id") % 1000)
    taken = rows.filter("score >= 90").select("cluster")
    return selection.value_layer(rows.filter("score < 90"), "grp", taken, "cluster", "score", "id").select("grp", "id")


def override_with_locks(spark, sf):
    rows = P.photos(spark, sf).select("id", F.floor(F.col("score") / 30).cast("int").alias("stars"), F.lit("ai").alias("origin"), F.lit("primary_rank").alias("reason"), (F.col("id") % 4 == 0).alias("rating_locked"))
    new = P.photos(spark, sf).filter("id % 3 = 0").select("id", F.lit(2).alias("stars"), F.when(F.col("id") % 2 == 0, "manual").otherwise("coverage").alias("origin"), F.lit("manual_override").alias("reason"))
    return selection.rated(rows, new, "id")


def stable_scores(spark, sf):
    from ..operators.ranking import rank_percentile

    p = P.photos(spark, sf)
    pct = rank_percentile(["grp"], [F.desc("score"), F.col("id")])
    rows = p.select("id", "score", pct.alias("pct"), F.when(F.col("id") % 2 == 0, F.col("score") / 120).alias("learned"))
    return rows.select("id", F.round(selection.blended_score(F.col("score"), F.col("pct"), F.col("learned")), 6).alias("base"))


def nms_boxes(spark, sf):
    x = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("box")).agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("score"))
    boxes = x.select("image", "box", "score", (F.col("q") % 10).alias("x1"), (F.col("q") % 7).alias("y1"), (F.col("q") % 10 + 6).alias("x2"), (F.col("q") % 7 + 6).alias("y2"))
    return folds.suppress(boxes, "image", ["x1", "y1", "x2", "y2"], "score", "box", 0.4).select("image", "box")


def match_bodies(spark, sf):
    f = P.faces(spark, sf).groupBy("photo", "line").agg(F.max("sharp").alias("s"))
    a, b = f.filter("line % 2 = 0"), f.filter("line % 2 = 1")
    both = a.select("photo", F.col("line").alias("l"), F.col("s").alias("ls")).join(b.select("photo", F.col("line").alias("r"), F.col("s").alias("rs")), "photo").select("photo", "l", "r", (1 / (1 + F.abs(F.col("ls") - F.col("rs")))).alias("score"))
    return folds.match_one_to_one(both, ["photo"], "l", "r", "score").groupBy("photo").agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg("score"), 6).alias("mean_score"))


def workspace_filter(spark, sf):
    people = P.faces(spark, sf).groupBy("photo").agg(F.sort_array(F.collect_set(F.col("person").cast("string"))).alias("person_ids"))
    rows = P.photos(spark, sf).join(people, F.col("id") == F.col("photo")).select("id", F.floor(F.col("score") / 26).cast("int").alias("stars"), "person_ids", F.col("priority").alias("stage_label"))
    return filters.workspace(rows, [1, 2, 3], "7", None).select("id", "stars", F.size("person_ids").cast("long").alias("people"))


def public_projection(spark, sf):
    p = P.photos(spark, sf)
    cols = filters.public_photo(F.create_map(F.lit("price"), F.col("score") * 1.2345), F.col("score"), F.col("score") / 100)
    return p.select("id", *cols).select("id", "score", F.col("metrics")["price"].alias("price"), "confidence")


def semantic_errors(spark, sf):
    rows = P.photos(spark, sf).select("id", F.floor(F.col("score") / 26).cast("int").alias("stars"), F.when(F.col("id") % 2 == 0, "primary").otherwise("valuable").alias("rating_tier"))
    return filters.semantic_errors(rows).groupBy("stars", "rating_tier").agg(F.count(F.lit(1)).alias("n"))


def eye_evidence(spark, sf):
    f = P.faces(spark, sf)
    state = F.when(F.col("line") % 3 == 0, "Open").when(F.col("line") % 3 == 1, "Closed").otherwise("Odd")
    face = {"state": state, "area": F.col("area"), "confidence": F.col("confidence"), "yaw": F.col("line") * 4.0, "pitch": F.col("line") * 1.5, "roll": F.col("line") * 5.0, "sharpness": F.col("sharp") / 10, "occlusion": F.col("occlusion"), "probability": (1 - F.col("confidence")) / 2}
    e = quality.eye_evidence(face)
    held = f.select("photo", e["reliability"].alias("r"), e["open_score"].alias("s"), e["decisive"].alias("d"), e["uncertain"].alias("u"), F.size(e["reasons"]).alias("k"))
    return held.groupBy("photo").agg(F.round(F.max("r") + 1e-10, 6).alias("reliability"), F.round(F.min("s") + 1e-9, 4).alias("open_score"), F.count_if("d").alias("decisive"), F.count_if("u").alias("uncertain"), F.sum("k").alias("reasons"))


def seed_faces(spark, sf):
    f = P.faces(spark, sf)
    firm, strength = filters.seed_face(F.col("confidence"), F.col("area"), F.col("sharp"), F.col("line") * 4.0, F.col("line") * 5.0, F.col("line") * 6.0, F.col("occlusion"), F.lit(False), F.lit(None).cast("double"))
    return f.groupBy("photo").agg(F.count_if(firm).alias("seeds"), F.round(F.max(strength) + 1e-9, 5).alias("strength"))


SQLS = {
    "face_flags": with_("faces") + f" select photo, count(distinct person) filter (where {SIG}) as significant, count(distinct person) filter (where {REL}) as reliable, max(area) as largest from faces group by 1",
    "quality_faces": with_("faces") + ", p as (select *, max(area) over (partition by photo) as m, count(*) over (partition by photo) as n from faces where ((area >= 0.0006 and confidence >= 0.82) or (area >= 0.0010 and confidence >= 0.70)) and line <= 6) select photo, count(*) as faces, min(area) as smallest from p where not (n >= 2 and m < 0.0025) and (m < 0.0035 or area >= 0.24 * m) group by 1",
    "eligible_people": with_("faces") + f" select person, photos from (select person, count(distinct photo) as photos, bool_or({REL} and area >= 0.008) as large from faces where {SIG} group by 1) where photos >= 2 or large",
    "dominant_people": with_("photos", "faces") + ", f as (select distinct p.grp, f.photo, f.person from faces f join photos p on p.id = f.photo), n as (select grp, count(distinct photo) as n from f group by 1), s as (select grp, person, count(*) as k from f group by 1, 2) select grp, person, k >= greatest(2, round_even(0.45::double * n, 0)) as dominant, k >= greatest(1, ceil(0.35::double * n)) as stable from s join n using (grp) where k >= greatest(2, round_even(0.45::double * n, 0)) or k >= greatest(1, ceil(0.35::double * n))",
    "repeated_people": with_("faces") + " select person, count(distinct photo) as photos from faces group by 1 having count(distinct photo) >= 2",
    "quality_rollup": with_("faces") + """, a as (select *, case when occlusion < 0.3 then 1 when occlusion < 0.6 then 2 else 3 end as st, line > 5 as down from faces),
b as (select *, case st when 1 then 100.0 when 2 then (case when down then 70.0 else 52.0 end) else (case when down then 58.0 else 5.0 end) end as bs from a),
c as (select *, 72 + ((case when not down then 0.68 * bs + 32 * confidence else bs end) - 72) * greatest(0.0, least(1.0, (area - 0.0007) / 0.0007)) as eye from b),
d as (select photo, area, eye, 0.32 * greatest(0.0, least(100.0, (ln(1 + sharp) - ln(9)) / (ln(901) - ln(9)) * 100)) + 0.20 * greatest(0.0, least(100.0, (ln(1 + sharp / 2) - ln(8)) / (ln(761) - ln(8)) * 100)) + 0.25 * eye
 + 0.10 * greatest(0.0, least(100.0, 100 - 1.15 * greatest(0.0, abs(line * 5.0) - 12) - 0.55 * greatest(0.0, abs(line * 3.0) - 10))) + 0.13 * greatest(0.0, least(100.0, 100 * (1 - occlusion))) as face from c)
select photo, round(0.72 * min(eye) + 0.28 * avg(eye), 4) as eye_score, round(0.35 * avg(face) + 0.40 * min(face) + 0.25 * arg_max(face, (area, face)), 4) as face_score, count(*) filter (where face < 45) as bad_faces from d group by 1""",
    "issue_category": with_("records") + " select event_id, case when value > 90 then 'closed_eyes' when event_type = 'error' then 'blurred' when event_id % 11 = 0 then 'exposure' when value < 5 or event_id % 13 = 0 then 'rejected' else 'selected' end as category, not (value > 90 or event_type = 'error' or event_id % 11 = 0) and value >= 10 as eligible from records",
    "generic_score": with_("faces") + """, f as (select photo, avg(sharp) as s, avg(confidence) as c, avg(occlusion) as o, count(*) as k from faces group by 1),
g as (select photo, c, k, greatest(0.0, least(100.0, case when k > 2 then 0.25 * greatest(0.0, least(100.0, (ln(1 + s) - ln(9)) / (ln(901) - ln(9)) * 100)) + 0.15 * 100 * c + 0.15 * greatest(0.0, least(100.0, s / 10)) + 0.10 * (100 - 100 * o) + 0.10 * 60 + 0.10 * (0.55 * 50 + 0.45 * 10 * k) + 0.10 * 70 + 0.05 * 50 + 7 * c - 8 * (k % 3)
 else 0.45 * 70 + 0.20 * greatest(0.0, least(100.0, s / 10)) + 0.15 * (100 - 100 * o) + 0.10 * 50 + 0.10 * 10 * k end)) as g from f)
select photo, round(g + 1e-9, 5) as generic, round(case when k > 1 then 0.72 * g + 0.28 * 100 * c else g end + 1e-9, 5) as blended from g""",
    "coverage_cells": with_("photos", "faces") + " select p.priority, f.person, count(distinct f.photo) as candidates, bool_or(p.score >= 90) as covered from faces f join photos p on p.id = f.photo group by 1, 2",
    "value_layer": with_("photos") + ", t as (select distinct id % 1000 as c from photos where score >= 90) select grp, id from (select grp, id, row_number() over (partition by grp order by score desc, id) as r from photos where score < 90 and id % 1000 not in (select c from t)) where r = 1",
    "override_with_locks": with_("photos") + ", n as (select id, 2 as s, case when id % 2 = 0 then 'manual' else 'coverage' end as o from photos where id % 3 = 0) select p.id, p.id % 4 = 0 as rating_locked, case when n.s is not null and (p.id % 4 != 0 or n.o = 'manual') then n.s else cast(floor(p.score / 30) as int) end as stars, case when n.s is not null and (p.id % 4 != 0 or n.o = 'manual') then n.o else 'ai' end as origin, case when n.s is not null and (p.id % 4 != 0 or n.o = 'manual') then 'manual_override' else 'primary_rank' end as reason from photos p left join n on n.id = p.id",
    "stable_scores": with_("photos") + ", r as (select id, score, case when count(*) over w <= 1 then 1.0 else 1 - (row_number() over (w order by score desc, id) - 1) / (count(*) over w - 1) end as pct, case when id % 2 = 0 then score / 120 end as l from photos window w as (partition by grp)) select id, round(0.75 * coalesce(l, 0.58 * score / 100 + 0.42 * pct) + 0.25 * (0.58 * score / 100 + 0.42 * pct), 6) as base from r",
    "workspace_filter": with_("photos", "faces") + " select p.id, cast(floor(p.score / 26) as int) as stars, count(distinct f.person) as people from photos p join faces f on f.photo = p.id where floor(p.score / 26) between 1 and 3 group by 1, 2 having bool_or(f.person = 7)",
    "public_projection": with_("photos") + " select id, round_even(score, 2) as score, round_even(score * 1.2345, 3) as price, round_even(score / 100, 4) as confidence from photos",
    "semantic_errors": with_("photos") + " select stars, rating_tier, count(*) as n from (select cast(floor(score / 26) as int) as stars, case when id % 2 = 0 then 'primary' else 'valuable' end as rating_tier from photos) where not coalesce((stars = 1 and rating_tier = 'valuable') or (stars = 3 and rating_tier = 'primary'), false) group by 1, 2",
    "eye_evidence": with_("faces") + """, x as (select photo, line % 3 as st, area, confidence as c, line * 4.0::double as y, line * 1.5::double as p, line * 5.0::double as r, sharp / 10 as s, occlusion as o, (1 - confidence) / 2 as q from faces),
t as (select *, case when st = 2 then 0.0::double else list_min(list_transform([(area - 0.0012::double) / (0.0030::double - 0.0012::double), (c - 0.70::double) / (0.82::double - 0.70::double), 1 - (y - 20) / 15, 1 - (p - 10) / 5, 1 - (r - 20) / 15, (s - 20) / 15, 1 - (o - 0.25::double) / (0.55::double - 0.25::double), abs(q - 0.5) / 0.5], lambda v: greatest(0.0::double, least(1.0::double, v)))) end as rel,
 (area < 0.0030)::int + (c < 0.82)::int + (y > 35)::int + (p > 15)::int + (r > 35)::int + (s < 35)::int + (o >= 0.55)::int as bad, p >= 15 and y <= 45 as down from x),
u as (select *, case when st = 0 then 100.0::double when down then 58.0::double else 5.0::double end as b, st = 1 and bad = 0 and q <= 0.18 as d from t),
w as (select *, case when down then b else 0.68::double * b + 32 * q end as m from u)
select photo, round(max(rel) + 1e-10, 6) as reliability, round(min(case when st = 2 then 72.0::double else greatest(0.0::double, least(100.0::double, rel * m + (1 - rel) * 72)) end) + 1e-9, 4) as open_score, count(*) filter (where d) as decisive, count(*) filter (where (st = 1 and not d) or (st = 0 and rel < 0.5)) as uncertain, cast(sum(case when st = 2 then 1 else bad end) as bigint) as reasons from w group by 1""",
    "seed_faces": with_("faces") + " select photo, count(*) filter (where confidence >= 0.82 and area >= 0.001 and sharp >= 45 and line * 4 <= 35 and line * 5 <= 30 and line * 6 <= 35 and occlusion < 0.45) as seeds, round(max(confidence + least(area, 0.10) + least(sharp, 200.0) / 1000 - line * 4 / 180 - 0.25 * occlusion) + 1e-9, 5) as strength from faces group by 1",
    # greedy folds as recursion over the place in order, all parts at once
    "nms_boxes": """with recursive x as (select l_orderkey as image, l_linenumber::bigint as box, max(l_quantity)::double as q, max(l_extendedprice) as score from lineitem group by 1, 2),
b as (select image, box, q % 10 as x1, q % 7 as y1, q % 10 + 6 as x2, q % 7 + 6 as y2, row_number() over (partition by image order by score desc, box) as n from x),
r as (select distinct image, 0::bigint as n, []::struct(box bigint, x1 double, y1 double)[] as kept from b
 union all select r.image, b.n, case when len(list_filter(r.kept, lambda k: greatest(0, 6 - abs(k.x1 - b.x1)) * greatest(0, 6 - abs(k.y1 - b.y1)) > 0.4::double * (72 - greatest(0, 6 - abs(k.x1 - b.x1)) * greatest(0, 6 - abs(k.y1 - b.y1))))) > 0 then r.kept
  else list_append(r.kept, struct_pack(box := b.box, x1 := b.x1, y1 := b.y1)) end from r join b on b.image = r.image and b.n = r.n + 1),
e as (select image, arg_max(kept, n) as kept from r group by 1) select image, unnest(list_transform(kept, lambda k: k.box)) as box from e""",
    "match_bodies": with_("faces").replace("with ", "with recursive ", 1) + """, f as (select photo, line, max(sharp) as s from faces group by 1, 2),
m as (select photo, a.line as l, b.line as r, 1 / (1 + abs(a.s - b.s)) as score from f a join f b using (photo) where a.line % 2 = 0 and b.line % 2 = 1), p as (select *, row_number() over (partition by photo order by score desc, l, r) as n from m),
g as (select distinct photo, 0::bigint as n, []::int[] as ul, []::int[] as ur, 0::bigint as matched, 0::double as total from p
 union all select g.photo, p.n, case when ok then list_append(ul, p.l::int) else ul end, case when ok then list_append(ur, p.r::int) else ur end, matched + ok::int, total + case when ok then score else 0 end
  from g join p on p.photo = g.photo and p.n = g.n + 1, lateral (select not list_contains(ul, p.l::int) and not list_contains(ur, p.r::int) as ok)),
e as (select photo, arg_max(matched, n) as matched, arg_max(total, n) as total from g group by 1) select photo, matched, round(total / matched, 6) as mean_score from e""",
    "coverage_greedy": with_("photos", "faces").replace("with ", "with recursive ", 1) + """, c as (select grp, photo, max(score) as q, list(distinct person) as cells from photos join faces on photo = id group by 1, 2),
r as (select grp, 0::bigint as pick, null::bigint as photo, 0::bigint as cells, list_distinct(flatten(list(c.cells))) as missing from c group by 1
 union all select grp, pick, photo, len(open)::bigint, list_filter(missing, lambda x: not list_contains(open, x)) from (
  select r.grp, r.pick + 1 as pick, c.photo, list_intersect(c.cells, r.missing) as open, r.missing, row_number() over (partition by r.grp order by len(list_intersect(c.cells, r.missing)) desc, c.q desc, c.photo) as k from r join c on c.grp = r.grp where len(r.missing) > 0) where k = 1)
select grp, photo, pick, cells from r where pick > 0""",
    # one pick a budget and step; in this table a strict cluster lies in one group, so seeds don't compete for it
    "primary_budget": with_("photos").replace("with ", "with recursive ", 1) + """, w as (select c_nationkey as budget, id, grp, us, floor(us / 86400000000 / 7)::bigint as week, round_even(score / 100, 4) as base, row_number() over (partition by grp order by score desc, id) as rank, score >= 20 as eligible, id % 101 = 0 as locked from photos join customer on c_custkey = grp),
q as (select budget, id, grp, us, grp || '-' || week as beat, base, rank, eligible and not locked as free, locked, bool_or(locked) over (partition by grp, us) as shut, bool_or(locked) over (partition by grp) as held, count(*) over (partition by budget) as n from w),
f as (select *, row_number() over (partition by grp order by case when free and not shut then 0 else 1 end, rank, id) = 1 and free and not shut and not held as seed from q),
z as (select budget, id, grp, us, beat, base, rank, free, n, case when locked then 0 when seed then 1 end as step from f),
t as (select budget, greatest(count(step), least(max(n), round_even(max(n) * 0.65::double, 0)))::bigint as target from z group by 1),
r as (select 0 as it, z.*, target from z join t using (budget)
 union all select it, budget, id, grp, us, beat, base, rank, free, n, case when k = 1 and open then 2 else step end, target from (
  select *, row_number() over (partition by budget order by open desc, case when open then base * pow(0.1::double, b) * pow(0.55::double, greatest(0, g - 1)) end desc, rank, id) as k from (
   select it + 1 as it, budget, id, grp, us, beat, base, rank, free, n, step, target, count(step) over (partition by budget, beat) as b, count(step) over (partition by grp) as g, free and step is null and count(step) over (partition by grp, us) = 0 as open, count(step) over (partition by budget) as had from r)
  where had < target qualify bool_or(open) over (partition by budget)))
select budget, id, min(step)::bigint as step from r where step is not null group by 1, 2""",
}
QUERIES = {k: globals()[k] for k in [*SQLS, "delivery_reserve"]}
