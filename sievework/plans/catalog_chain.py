"""Queries: what the decision chain reads of faces, poses, metrics and folders, with their SQL twins.

Photos are orders (group = customer), faces line items, their poses vectors of the supplier's embedding.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import engines, features, matching, people, ranking, training
from . import proxies as P
from .proxies import read, with_


def _faces(spark, sf):
    x = read(spark, sf, "lineitem")
    eyes = F.when(F.col("l_returnflag") == "R", "Closed").when(F.col("l_returnflag") == "A", "Partial").otherwise("Open")
    return x.select(
        F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("face_index"), F.col("l_suppkey").alias("person"), (F.col("l_quantity") / 10000).alias("area"), (1 - 5 * F.col("l_discount")).alias("confidence"), (F.col("l_linenumber") * 7.0).alias("roll"), eyes.alias("eyes"),
        (1 - 10 * F.col("l_tax")).alias("open_probability"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("quality"), (F.col("l_extendedprice") / 1000).alias("sharpness"), F.col("l_quantity").cast("double").alias("eye_sharpness"), (F.col("l_tax") * 500).alias("fine_sharpness"),
        (F.col("l_tax") * 10).alias("occlusion"), (F.col("l_discount") * 300 - 15).alias("yaw"), (F.col("l_quantity") * 2.0).alias("smile"),
    )


def _photos(spark, sf):
    """id, grp, budget, us, score, people, issues, metrics (null where an order has no line)."""
    x = read(spark, sf, "lineitem")
    r = lambda c: F.round(c, 6)
    m = x.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.create_map(
            F.lit("exposure_score"), r(F.avg("l_discount") * 1000), F.lit("composition_score"), r(F.avg("l_tax") * 1000), F.lit("contrast_score"), F.count(F.lit(1)) * 10.0, F.lit("subject_sharpness_score"), r(F.max("l_extendedprice") / 1000),
            F.lit("min_face_score"), r(F.min("l_extendedprice") / 1000), F.lit("bad_face_count"), F.count_if(F.col("l_quantity") < 3).cast("double"), F.lit("eye_score"), r(F.sum("l_quantity") / 3), F.lit("face_quality_score"), r(F.avg("l_quantity") * 2.5),
        ).alias("metrics")
    )
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    issues = F.array_compact(F.array(F.when(F.col("priority") == "1-URGENT", "soft_subject"), F.when(F.col("priority") == "2-HIGH", "occluded"), F.when(F.col("status") == "P", "bad_exposure")))
    seen = people.seen_in(_faces(spark, sf)).select(F.col("photo").alias("id"), "people")
    rows = P.photos(spark, sf).select("id", "grp", "us", "score").join(o, F.col("id") == F.col("o_orderkey")).join(m, "id", "left").join(seen, "id", "left")
    return rows.select("id", "grp", "us", "score", "priority", "status", "price", F.coalesce("people", F.array().cast("array<bigint>")).alias("people"), issues.alias("issues"), "metrics")


def _ranked(spark, sf):
    rows = people.with_expected(_photos(spark, sf), "grp")
    names = ("faced", "closed", "partial", "least_open", "least_sharp")
    rows = rows.join(people.face_facts(_faces(spark, sf)).withColumnRenamed("photo", "id"), "id", "left")
    rows, m = people.ranked_metrics(rows)
    keys = people.ranking_keys(m, F.col("score"), F.col("people"), F.col("expected"), F.col("issues"), {n: F.col(n) for n in names})
    rounded = {k: F.round(v.cast("double") + 1e-9, 6) for k, v in keys.items()}
    return rows.select("id", "grp", "us", "priority", "status", "price", "metrics", F.struct(*[v.alias(k) for k, v in rounded.items()]).alias("k"))


def group_ranking(spark, sf):
    rows = _ranked(spark, sf)
    out = ranking.ranked(rows, ["grp"], [F.desc(f"k.{k}") for k in people.RANKING] + [F.col("us"), F.col("id")])
    return out.select("id", "grp", "rank", F.col("k.coverage").alias("coverage"), F.col("k.group_score").alias("group_score"), F.col("k.least_open").alias("least_open"))


def person_looks(spark, sf):
    out = people.person_looks(_faces(spark, sf))
    return out.select("photo", "person", "closed", "partial", F.round("open", 6).alias("open"), F.round("look", 6).alias("look"))


def covered_people(spark, sf):
    faces = _faces(spark, sf)
    shown = _photos(spark, sf).select(F.col("priority").alias("budget"), "id", F.explode("people").alias("person"))
    return people.eligible(shown, "budget", faces)


def stage_folders(spark, sf):
    """Budgets are customers, folders the priorities of their orders; pending ones lie outside."""
    rows = _photos(spark, sf).select("grp", "id", "us", F.when(F.col("status") == "P", F.col("id").cast("string")).otherwise(F.concat_ws("/", "priority", F.col("id").cast("string"))).alias("path"))
    return ranking.folder_stages_by(rows, "grp", "path", F.struct("us", "id"), "id").select("grp", "id", "folder_stage")


def rating_features(spark, sf):
    ranked = _ranked(spark, sf)
    extra = F.create_map(F.lit("musiq_score"), F.round(F.col("price") / 3000 + 1e-9, 4), F.lit("qualiclip_score"), F.when(F.col("status") != "P", F.round(F.col("price") / 400_000 + 1e-9, 6)))
    rows = ranked.select("id", "grp", "us", F.concat_ws("/", F.col("grp").cast("string"), "priority").alias("part"), F.col("k.generic").alias("generic"), F.map_concat(F.coalesce("metrics", F.create_map().cast("map<string,double>")), extra).alias("metrics"))
    held = features.group_metrics(rows, "part")
    out = features.rating_features(held, _faces(spark, sf), "grp", "part", F.struct("us", "id"))
    names = F.array(*map(F.lit, features.BASE_FEATURES + features.SCORE_FEATURES))
    return out.select("id", "profile", "reason", F.posexplode("x").alias("k", "v")).select("id", "profile", "reason", F.element_at(names, F.col("k") + 1).alias("feature"), F.round(F.col("v") + 1e-9, 4).alias("value"))


def matched_poses(spark, sf):
    """Poses of orders (a line is a pose, its descriptor the first components of the supplier's vector) matched between a customer's consecutive orders."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("person"), F.slice("embedding", 1, 8).alias("descriptor"))
    x = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").cast("long").alias("pose_index")).agg(F.max("l_suppkey").alias("person"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_linestatus").alias("s"))
    poses = x.join(v, "person").select("photo", "pose_index", F.transform("descriptor", lambda z: z.cast("double") * 3).alias("descriptor"), (F.col("q") / 50).alias("visibility"), (1 - 5 * F.col("d")).alias("presence"), F.when(F.col("s") == "O", F.col("t") * 12).alias("foreground"), (F.col("q") / 50).alias("x"), (F.col("t") * 10).alias("y"))
    w = Window.partitionBy("grp").orderBy("us", "id")
    pairs = P.photos(spark, sf).select(F.col("id").alias("right"), F.lag("id").over(w).alias("left")).filter("left is not null")
    return matching.pose_matches(pairs, poses).select("left", "right", F.round("pose", 6).alias("pose"))


def report_metrics(spark, sf):
    """Reports of every customer's orders, nested in one of three ways by the customer's market segment, and read again."""
    from ..sources import evaluations

    x = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.bround(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).alias("top1"), F.bround(F.avg((F.col("o_orderstatus") != "P").cast("double")), 4).alias("top2"), F.bround(F.max("o_totalprice") / 300_000, 4).alias("f1"), F.bround(1 / F.count(F.lit(1)), 4).alias("dedup"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("closed"), F.count(F.lit(1)).alias("need"), (F.count_if(F.col("o_orderpriority") == "5-LOW") * 2).alias("open"),
    )
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    nested = F.struct(
        F.struct(F.col("top1").alias("top1_exact_group_hit_rate"), F.col("top2").alias("group_hit_at_2")).alias("group_evaluation"), F.struct("f1").alias("strict_ai_best"), F.struct(F.col("dedup").alias("top1_reduction_rate")).alias("grouping_summary"),
        F.struct(F.col("closed").alias("manual_with_decisive_closed")).alias("eye_evidence_evaluation"), F.struct(F.struct(F.col("need").alias("required_cells"), F.col("open").alias("unresolved_cells")).alias("coverage_guard")).alias("engine"),
    )
    flat = F.struct("top1", "top2", F.col("f1").alias("strict_f1"), "dedup", "closed", F.struct(F.col("need").alias("required_cells"), F.col("open").alias("unresolved_cells")).alias("coverage_guard"))
    text = F.when(F.col("segment") == "BUILDING", F.to_json(flat)).when(F.col("segment") == "AUTOMOBILE", F.to_json(F.struct(nested.alias("summary")))).when(F.col("segment") == "MACHINERY", F.concat(F.lit("["), F.to_json(nested), F.lit("]"))).otherwise(F.to_json(nested))
    out = evaluations.report_metrics(x.join(c, "k").select("k", text.alias("text")), "k", "text")
    return out.select("k", "top1", "top2", "strict_f1", "dedup", F.round("coverage", 6).alias("coverage"), "closed", F.concat_ws(",", "faults").alias("faults"))


def training_examples(spark, sf):
    """Datasets are market segments, groups the orders of a customer, labels the orders above 300,000; the customers of nation 3 are locked."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").alias("nation"))
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("name")).join(c, "grp")
    photos = o.select("dataset", F.col("grp").cast("string").alias("grp"), "id", F.col("id").alias("stem"), "name", F.substring("name", 1, 1).cast("int").alias("rank"), "score")
    labels = o.filter("score > 300000").select("dataset", F.col("id").alias("stem"))
    locked = c.filter("nation = 3").select("dataset", F.col("grp").cast("string").alias("grp"))
    groups = training.labelled_groups(photos, labels, locked)
    out = training.examples(photos, labels, groups)
    return out.select("dataset", "grp", "split", "permutation", F.array_join("candidates", ",").alias("candidates"), F.array_join("best", ",").alias("best"))


class TagEngine:
    """Counts the elements of a page."""

    def analyze(self, content):
        found = Counter(re.findall(r"<([a-z][a-z0-9]*)", content))
        yield from sorted(found.items())

    def embed(self, contents):
        return [[float(len(c)), float(c.count("<"))] for c in contents]

    def signature(self):
        return "tags:1"


def page_elements(spark, sf):
    """Elements of every page, by an engine over whole pages."""
    pages = read(spark, sf, "pages").select("page_id", "html")
    return engines.analyzed(pages, "html", TagEngine, "element string, n bigint").select("page_id", "element", "n")


_X = """x as (select l_orderkey as photo, l_suppkey as person, l_quantity / 10000 as area, 1 - 5 * l_discount as confidence, l_linenumber * 7.0 as roll, case l_returnflag when 'R' then 'Closed' when 'A' then 'Partial' else 'Open' end as eyes,
 1 - 10 * l_tax as op, case when l_linestatus = 'O' then l_quantity end as quality, l_extendedprice / 1000 as sharp, l_quantity::double as eye_sharp, l_tax * 500 as fine, l_tax * 10 as occlusion, l_discount * 300 - 15 as yaw, l_quantity * 2.0 as smile from lineitem),
sx as (select * from x where (area >= 0.0006 and confidence >= 0.82) or (area >= 0.0010 and confidence >= 0.65) or (area >= 0.0025 and confidence >= 0.55)),
seen as (select photo, list(distinct person) as people from sx group by 1),
px as (select *, max(area) over (partition by photo) as largest, count(*) over (partition by photo) as n from x where ((area >= 0.0006 and confidence >= 0.82) or (area >= 0.0010 and confidence >= 0.70)) and abs(roll) <= 42),
qx as (select * from px where not (n >= 2 and largest < 0.0025) and (largest < 0.0035 or area >= 0.24::double * largest))"""
_RANKED = """, ff as (select photo, count(*) filter (area >= 0.0012 and confidence >= 0.58 and eyes = 'Closed') as closed, count(*) filter (area >= 0.0012 and confidence >= 0.58 and eyes = 'Partial') as partial, min(op) as op, min(sharp) as sharp from qx group by 1),
mm as (select l_orderkey as photo, round(avg(l_discount) * 1000, 6) as exposure, round(avg(l_tax) * 1000, 6) as composition, count(*) * 10.0::double as contrast, round(max(l_extendedprice) / 1000, 6) as subject, round(min(l_extendedprice) / 1000, 6) as least,
 (count(*) filter (l_quantity < 3))::double as bad, round(sum(l_quantity) / 3, 6) as eye, round(avg(l_quantity) * 2.5::double, 6) as face from lineitem group by 1),
ex as (select grp, list(person) as expected from (select p.grp, person, count(*) as k from (select distinct photo, person from sx) f join photos p on p.id = f.photo group by 1, 2) join (select grp, count(*) as n from photos group by 1) using (grp)
 where k >= greatest(2, round_even(0.45::double * n, 0)) group by 1),
a as (select p.id, p.grp, p.us, p.score, o.o_orderpriority as priority, o.o_orderstatus as status, o.o_totalprice as price, m.*, f.photo is not null as faced, f.closed, f.partial, f.op, f.sharp,
 (o.o_orderpriority in ('1-URGENT', '2-HIGH'))::int + (o.o_orderstatus = 'P')::int as issues, case when e.expected is null then 1.0::double else len(list_intersect(coalesce(s.people, []), e.expected)) / len(e.expected) end as cover, e.expected is not null as wanted
 from photos p join orders o on o.o_orderkey = p.id left join mm m on m.photo = p.id left join ff f on f.photo = p.id left join ex e on e.grp = p.grp left join seen s on s.photo = p.id),
b as (select *, least(100, greatest(0, case when faced then 0.25::double * face + 0.15::double * eye + 0.15::double * subject + 0.10::double * exposure + 0.10::double * 0 + 0.10::double * (0.55::double * composition + 0.45::double * contrast) + 0.10::double * 0 + 0.05::double * composition + 7 * cover - 8 * bad
 else 0.45::double * score + 0.20::double * coalesce(subject, 0) + 0.15::double * coalesce(exposure, 0) + 0.10::double * coalesce(composition, 0) + 0.10::double * coalesce(contrast, 0) end)) as generic from a),
rk as (select *, row_number() over (partition by grp order by -coalesce(closed, 0) desc, -(wanted and cover < 0.999)::int desc, -coalesce(partial, 0) desc, -coalesce(bad, 0) desc, -issues desc, round(cover + 1e-9::double, 6) desc, round(generic + 1e-9::double, 6) desc, round(coalesce(least, 0) + 1e-9::double, 6) desc,
 round(coalesce(op, 0.72) + 1e-9::double, 6) desc, round(coalesce(sharp, 0) + 1e-9::double, 6) desc, round(score + 1e-9::double, 6) desc, us, id) as rank from b)"""
_FEATURES = """, g as (select *, round(generic + 1e-9::double, 6) as gg, grp || '/' || priority as part, round(price / 3000 + 1e-9::double, 4) as mq, case when status <> 'P' then round(price / 400000 + 1e-9::double, 6) end as qc from b),
h as (select *, gg - max(gg) over w as rel, 100 * cume_dist() over (partition by part order by gg) as pct, count(*) over w as size, coalesce(face, 0) - max(coalesce(face, 0)) over w as rf, coalesce(eye, 0) - max(coalesce(eye, 0)) over w as re, coalesce(subject, 0) - max(coalesce(subject, 0)) over w as rs,
 coalesce(exposure, 0) - max(coalesce(exposure, 0)) over w as rx, coalesce(composition, 0) - max(coalesce(composition, 0)) over w as rc, bool_and(mq is not null and qc is not null) over (partition by grp) as whole,
 max(mq) over w - min(mq) over w as sm, max(qc) over w - min(qc) over w as sc, row_number() over (partition by part order by mq, us, id) - 1 as nm, row_number() over (partition by part order by qc, us, id) - 1 as nc from g window w as (partition by part)),
fx as (select photo, count(*) as n, count(distinct person) as persons from x group by 1), fq as (select photo, max(area) * 1000 as big, avg(occlusion) * 100 as occ, avg(abs(yaw)) as yaw, avg(smile) as smile from qx group by 1),
u as (select h.*, case when size <= 1 or sm < 1e-9 then 50.0::double else 100.0::double * (nm / (size - 1)) end as pm, case when size <= 1 or sc < 1e-9 then 50.0::double else 100.0::double * (nc / (size - 1)) end as pc,
 coalesce(fx.n, 0) as faces, coalesce(fx.persons, 0) as persons, fq.photo is not null as portrait, coalesce(fq.big, 0) as big, coalesce(fq.occ, 0) as occ, coalesce(fq.yaw, 0) as yaw, coalesce(fq.smile, 0) as smile from h left join fx on fx.photo = h.id left join fq on fq.photo = h.id),
v as (select id, whole, unnest(['sharpness_score', 'motion_blur_score', 'exposure_score', 'contrast_score', 'noise_score', 'composition_score', 'face_quality_score', 'min_face_score', 'face_sharpness_score', 'eye_sharpness_score', 'eye_score', 'expression_score', 'technical_score',
  'generic_group_score', 'group_relative_score', 'group_quality_percentile', 'group_size', 'relative_face_quality', 'relative_eye', 'relative_motion', 'relative_exposure', 'relative_composition', 'bad_face_count', 'face_count', 'largest_face_ratio', 'mean_occlusion_risk', 'mean_abs_yaw',
  'mean_smile_score', 'portrait_present', 'subject_sharpness_score', 'depth_focus_score', 'depth_background_blur_score', 'depth_separation_score', 'depth_occlusion_risk', 'main_subject_score', 'person_count', 'dof_portrait_quality',
  'iqa_musiq', 'iqa_qualiclip', 'iqa_relative_musiq', 'iqa_relative_qualiclip', 'iqa_consensus', 'iqa_disagreement']) as feature,
 unnest([0, 0, coalesce(exposure, 0), coalesce(contrast, 0), 0, coalesce(composition, 0), coalesce(face, 0), coalesce(least, 0), 0, 0, coalesce(eye, 0), 0, 0, gg, rel, pct, size, rf, re, rs, rx, rc, coalesce(bad, 0), faces, big, occ, yaw, smile, portrait::int, coalesce(subject, 0), 0, 0, 0, 0, 0, persons, coalesce(subject, 0),
  mq, qc * 100, pm, pc, (pm + pc) / 2, abs(pm - pc)]::double[]) as value from u)
select id, case when whole then 'iqa' else 'base' end as profile, case when whole then '' else 'scores_incomplete' end as reason, feature, round(value + 1e-9::double, 4) as value from v where whole or feature not like 'iqa_%'"""
_WITH = with_("photos") + ",\n" + _X
SQLS = {
    "group_ranking": _WITH + _RANKED + ' select id, grp, rank, round(cover + 1e-9::double, 6) as coverage, round(generic + 1e-9::double, 6) as group_score, round(coalesce(op, 0.72) + 1e-9::double, 6) as least_open from rk',
    "rating_features": _WITH + _RANKED.rsplit(",\nrk as", 1)[0] + _FEATURES,
    "person_looks": "with " + _X + " select photo, person, count(*) filter (eyes = 'Closed') as closed, count(*) filter (eyes = 'Partial') as partial, round(coalesce(max(op), 0.5), 6) as open, round(max(coalesce(quality, greatest(fine, eye_sharp, sharp))), 6) as look from sx group by 1, 2",
    "covered_people": "with " + _X + """, s as (select o_orderpriority as budget, photo, person, bool_or(area >= 0.008 and ((area >= 0.0007 and confidence >= 0.90) or (area >= 0.0018 and confidence >= 0.78) or (area >= 0.0035 and confidence >= 0.65))) as big from sx join orders on o_orderkey = photo group by 1, 2, 3)
select budget, person from s group by 1, 2 having count(distinct photo) >= 2 or bool_or(big)""",
    "stage_folders": with_("photos") + """, f as (select id, grp, us, case when status = 'P' then 'root' else priority end as folder from photos),
b as (select grp, folder, min((us, id)) as first, count(*) as n from f group by 1, 2),
k as (select *, row_number() over (partition by grp order by first, folder) as stage, count(*) filter (folder <> 'root') over (partition by grp) as kinds, coalesce(sum(n) filter (folder <> 'root') over (partition by grp), 0) as nested, sum(n) over (partition by grp) as total from b)
select f.grp, f.id, case when kinds >= 2 and nested >= greatest(2, round_even(0.8::double * total, 0)) then stage end as folder_stage from f join k using (grp, folder)""",
    "page_elements": "select page_id, element, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as element from pages) group by 1, 2",
    "training_examples": """with p as (select c_mktsegment as dataset, o_custkey::varchar as grp, o_orderkey::varchar as id, o_totalprice as score, o_orderpriority as name, o_orderpriority[1]::int as rank, o_totalprice > 300000 as y, c_nationkey = 3 as locked from orders join customer on c_custkey = o_custkey),
g as (select dataset, grp, count(*) as n, count(*) filter (y) as k, bool_or(locked) as locked, ('0x' || sha256(dataset || '|' || grp)[1:16])::ubigint::double / 2::double ** 64 as h from p group by 1, 2 having count(*) >= 2),
s as (select *, case when locked then 'test' when h < 0.15::double then 'validation' else 'train' end as split from g where k > 0),
c as (select p.*, s.split, s.k, row_number() over (partition by p.dataset, p.grp order by y desc, rank, score desc, name, id) as r from p join s on s.dataset = p.dataset and s.grp = p.grp where s.split = 'test' or s.k = 1),
d as (select *, sha256(dataset || '|' || grp || case when split = 'test' then '|holdout|' else '|' end || id) as place from c where r <= case when split = 'test' then greatest(4, k) else 4 end),
e as (select dataset, grp, split, list(id order by place) as c, list(y order by place) as f from d group by 1, 2, 3),
t as (select *, unnest(case when split = 'train' then [0, 1] else [0] end) as permutation from e),
u as (select *, case when permutation = 1 then list_concat(c[2:], c[1:1]) else c end as cc, case when permutation = 1 then list_concat(f[2:], f[1:1]) else f end as ff from t)
select dataset, grp, split, permutation, array_to_string(cc, ',') as candidates, array_to_string(list_transform(list_filter(list_zip(cc, ff), lambda z: z[2]), lambda z: z[1]), ',') as best from u""",
    "report_metrics": """with x as (select o_custkey as k, round_even(avg((o_orderstatus = 'F')::int::double), 4) as top1, round_even(avg((o_orderstatus <> 'P')::int::double), 4) as top2, round_even(max(o_totalprice) / 300000, 4) as f1, round_even(1 / count(*), 4) as dedup,
 count(*) filter (o_orderpriority = '1-URGENT') as closed, count(*) as need, count(*) filter (o_orderpriority = '5-LOW') * 2 as open from orders group by 1),
y as (select x.*, c_mktsegment <> 'MACHINERY' as ok, f1 <= 1 as f, open <= need as c from x join customer on c_custkey = k)
select k, case when ok then top1 end as top1, case when ok then top2 end as top2, case when ok and f then f1 end as strict_f1, case when ok then dedup end as dedup, case when ok and c then round((need - open) / need, 6) end as coverage, case when ok then closed end as closed,
 case when not ok then 'not_an_object' else concat_ws(',', case when not f then 'strict_f1' end, case when not c then 'coverage' end) end as faults from y""",
    "matched_poses": with_("photos").replace("with ", "with recursive ", 1) + """, l as (select l_orderkey as photo, l_linenumber::bigint as i, max(l_suppkey) as person, max(l_quantity) as q, max(l_discount) as d, max(l_tax) as t, max(l_linestatus) as s from lineitem group by 1, 2),
p0 as (select photo, i, list_transform(embedding[1:8], lambda z: z::double * 3) as e, q / 50 as visibility, 1 - 5 * d as presence, case when s = 'O' then t * 12 end as front, q / 50 as x, t * 10 as y from l join embeddings on vec_id = person),
p1 as (select *, max(front) over (partition by photo) as top from p0 where visibility >= 0.20 and presence >= 0.60),
p as (select *, count(*) over (partition by photo) as n from p1 where top is null or front >= greatest(0.46::double, top - 0.17::double)),
c as (select id as "right", lag(id) over (partition by grp order by us, id) as "left" from photos),
m0 as (select "left", "right", a.i as li, b.i as ri, least(a.n, b.n) / greatest(a.n, b.n) as cover, least(1, greatest(0, list_dot_product(a.e, b.e))) as act, least(1, greatest(0, 1 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.75)) as near from c join p a on a.photo = "left" join p b on b.photo = "right"),
m as (select *, row_number() over (partition by "left", "right" order by 0.88::double * act + 0.12::double * near desc, act desc, li desc, ri desc) as k from m0),
g as (select distinct "left", "right", 0::bigint as k, []::bigint[] as ul, []::bigint[] as ur, 0::bigint as got, 0::double as total, 0::double as cover from m
 union all select g."left", g."right", m.k, case when ok then list_append(ul, m.li) else ul end, case when ok then list_append(ur, m.ri) else ur end, got + ok::int, total + case when ok then m.act else 0 end, m.cover
  from g join m on m."left" = g."left" and m."right" = g."right" and m.k = g.k + 1, lateral (select not list_contains(ul, m.li) and not list_contains(ur, m.ri) as ok)),
e as (select "left", "right", arg_max(got, k) as got, arg_max(total, k) as total, max(cover) as cover from g group by 1, 2)
select "left", "right", round(least(1, greatest(0, total / got * (0.90::double + 0.10::double * cover))), 6) as pose from e""",
}
QUERIES = {k: globals()[k] for k in SQLS}
