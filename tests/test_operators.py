"""Operators on small hand-made tables: boundaries, ties, invariants."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.config import STARS_OF_TIER, TIER_OF_STARS, Settings, preset
from sievework.functions import names, numbers, quality, vectors
from sievework.operators import corrections, delivery, evaluate, filters, folds, graph, model, pairs, ranking, selection

from .conftest import rows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_config():
    assert {STARS_OF_TIER[t]: t for t in STARS_OF_TIER} == TIER_OF_STARS
    s = Settings().changed(preset="none", stage_minutes=900, unknown=1, min_score=-5)
    assert (s.preset, s.stage_minutes, s.min_score) == ("balanced", 60.0, 0.0) and preset("odd") == preset("balanced")


def test_scalars(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, null=numbers.clamp(n), low=numbers.clamp(F.lit(-3.0)), ratio=numbers.safe_ratio(F.lit(1), F.lit(0)), half=numbers.round_half_even(F.lit(2.5)), t=numbers.temporal_similarity(n, n),
        seq=numbers.temporal_similarity(n, F.lit(6)), sig=numbers.sigmoid(F.lit(900.0)), fin=numbers.finite(F.lit("nan")), log=numbers.log_score(F.lit(900.0), 8, 900),
        m=numbers.metric(F.create_map(F.lit("b"), F.lit(2.0)), "a", "b"), soft=numbers.softmax([F.lit(1.0), F.lit(1.0)])[0],
    )
    assert (r["null"], r["low"], r["ratio"], r["half"], r["t"], r["fin"], r["m"], r["soft"]) == (None, 0.0, 0.0, 2, 0.45, None, 2.0, 0.5)
    assert abs(r["seq"] - math.exp(-1)) < 1e-12 and r["sig"] < 1.0 and r["log"] == 100.0


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    box = lambda *x: F.struct(*[F.lit(float(y)).alias(k) for k, y in zip(("x1", "y1", "x2", "y2"), x, strict=True)])
    r = one(
        spark, c=vectors.cosine(v(1, 0), v(1, 1)), size=vectors.cosine(v(1), v(1, 1)), zero=vectors.cosine(v(0, 0), v(1, 1)), half=vectors.half_cosine(v(0), v(1)), unit=vectors.unit(v(0, 0)),
        h=vectors.hash_similarity(F.lit(-1).cast("long"), F.lit(0).cast("long")), hx=vectors.hash_from_hex(F.lit("aa55aa55aa55aa55")), i=vectors.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), far=vectors.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)),
    )
    assert abs(r["c"] - math.sqrt(0.5)) < 1e-12 and (r["size"], r["zero"], r["half"], r["unit"], r["h"], r["far"]) == (None, None, 0.5, [0.0, 0.0], 0.0, 0.0)
    assert r["hx"] == 0xAA55AA55AA55AA55 - (1 << 64) and abs(r["i"] - 1 / 3) < 1e-12


def test_names(spark):
    paths = [("a/b/IMG_00123.CR2", "img_00123", "cr2", "a", 123, True), ("DSC12.jpg", "dsc12", "jpg", "", -1, True), ("../x.jpg", "x", "jpg", "..", -1, False), ("/x1234-77.png", "x1234-77", "png", "", -1, False), ("P1234567.rw2", "p1234567", "rw2", "", 4567, True), ("C:\\p\\q.tif", "q", "tif", "C:", -1, False)]
    d = spark.createDataFrame([(p[0],) for p in paths], "p string")
    got = d.select("p", names.stem(F.col("p")), names.suffix(F.col("p")), names.top_folder(F.col("p")), names.file_sequence(names.stem(F.col("p"))), names.safe_relative(F.col("p"))).collect()
    assert sorted(map(tuple, got)) == sorted(paths)
    r = one(spark, a=names.capture_time(F.lit("bad"), F.lit("2024:01:02 03:04:05"), modified=F.lit("2020-01-01").cast("timestamp")), b=names.capture_time(F.lit(None).cast("string"), modified=F.lit("2020-01-01").cast("timestamp")), j=names.json_within(F.lit('so: {"a": {"b": 1}} end')), ok=names.sound_operation_id(F.lit("0" * 32)), no=names.sound_request_id(F.lit("xyz")))
    assert str(r["a"]) == "2024-01-02 03:04:05" and str(r["b"]) == "2020-01-01 00:00:00" and r["j"] == '{"a": {"b": 1}}' and r["ok"] and not r["no"]


def test_eye_scores(spark):
    f = lambda **k: quality.eye_open_score(F.lit(k["s"]), F.lit(k.get("p")).cast("double"), F.lit(k.get("a", 0.01)), F.lit(k.get("d", False)))
    r = one(spark, o=f(s="Open"), c=f(s="Closed"), cd=f(s="Closed", d=True), u=f(s="Odd"), tiny=f(s="Closed", a=0.0007), p=f(s="Open", p=0.5))
    assert (r["o"], r["c"], r["cd"], r["u"], r["tiny"], r["p"]) == (100.0, 5.0, 58.0, 72.0, 72.0, 84.0)


def test_quality_faces(spark):
    d = spark.createDataFrame([(1, 0.01, 0.9), (1, 0.002, 0.9), (1, 0.003, 0.9), (2, 0.002, 0.9), (2, 0.0021, 0.9), (3, 0.002, 0.9), (4, 0.0001, 0.99)], "photo int, area double, conf double").withColumn("roll", F.lit(5.0))
    assert rows(filters.quality_faces(d, "photo", "area", "conf", "roll").drop("roll"), "photo", "area") == [(1, 0.003, 0.9), (1, 0.01, 0.9), (3, 0.002, 0.9)]


def test_eligible_at_the_border(spark):
    d = spark.createDataFrame([(1, 55.0, []), (2, 54.999, []), (3, float("nan"), []), (4, 90.0, ["closed_eyes"]), (5, 90.0, ["noisy"]), (6, None, [])], "id int, s double, i array<string>")
    assert [r["id"] for r in d.filter(filters.quality_eligible(F.lit(9), F.lit(9), F.col("s"), F.col("i"))).collect()] == [1, 5]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-50, 50))), max_size=40), st.sampled_from([1.0, 3.0, 7.5]))
def test_range_join_is_exact(spark, data, width):
    d = spark.createDataFrame([(i, k, None if t is None else float(t)) for i, (k, t) in enumerate(data)], "id int, k int, t double")
    got = sorted((r["l_id"], r["r_id"]) for r in pairs.range_join(d, d, "t", width, ["k"]).collect())
    assert got == sorted((i, j) for i, (a, s) in enumerate(data) for j, (b, t) in enumerate(data) if a == b and s is not None and t is not None and abs(s - t) <= width)


def test_blocked_pairs(spark):
    d = spark.createDataFrame([(i, i // 3) for i in range(12)], "id int, b int")
    near = pairs.blocked_pairs(d, "id", [(F.array("b"), pairs.neighbours(F.col("b")))])
    assert sorted(map(tuple, near.collect())) == [(i, j) for i in range(12) for j in range(i + 1, 12) if abs(i // 3 - j // 3) <= 1]


def test_changed_faces(spark):
    faces = spark.createDataFrame([("a", 0, "p", 0.9, "Open", "calm", 0.9, 0.0, 0.0), ("b", 0, "p", 0.9, "Closed", "calm", 0.9, 0.0, 0.0), ("c", 0, "p", 0.9, "Open", "calm", 0.9, 10.0, 0.0), ("c", 1, "p", 0.9, "Open", "calm", 0.9, 16.0, 0.0), ("d", 0, None, 0.9, "Closed", "calm", 0.9, 0.0, 0.0)], "photo string, face_index int, person string, confidence double, eyes string, expression string, expression_confidence double, yaw double, pitch double")
    two = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("c", "c")], "left string, right string")
    assert sorted(map(tuple, pairs.changed_faces(two, faces).collect())) == [("a", "b"), ("a", "c")]


def test_rank_functions(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, 9.0)], "g string, id int, v double")
    got = rows(d.select("id", ranking.rank_percentile(["g"], [F.desc("v"), F.col("id")]), ranking.value_percentile(["g"], "v", F.col("id"))), "id")
    assert got == [(1, 1.0, 0.5), (2, 0.5, 1.0), (3, 0.0, 0.0), (4, 1.0, 0.5)]
    flat = d.withColumn("v", F.lit(2.0))
    assert {r[1] for r in rows(flat.select("id", ranking.value_percentile(["g"], "v", F.col("id"))), "id")} == {0.5}
    assert rows(ranking.numbered(d, [F.desc("v"), F.col("id")], "n").select("n", "id"), "n") == [(1, 4), (2, 1), (3, 2), (4, 3)]


def test_time_stages(spark):
    minute = 60.0
    d = spark.createDataFrame([("u", i, t, g) for i, (t, g) in enumerate([(0.0, 1), (4 * minute, 2), (8 * minute, 2), (11 * minute, 2), (12 * minute, 3), (13 * minute, 4), (None, 5), (40 * minute, 6)])], "u string, id int, t double, g int")
    got = [r["stage"] for r in folds.time_stages(d, "u", "t", "g", "id", 10).orderBy("id").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 3, 3]


def test_groups_of_a_fold_are_never_cut(spark):
    d = spark.createDataFrame([(i % 7 if i % 7 else None, i) for i in range(400)], "k int, v int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "13", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = folds.ordered_fold(d, ["k"], [F.col("v")], lambda g: [(len(g["v"]), int(g["v"][0]), int(g["v"][-1]))], "n long, a long, b long").collect()
            assert sorted(map(tuple, got)) == sorted((len(x), x[0], x[-1]) for x in ([i for i in range(400) if i % 7 == k] for k in range(7)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_complete_link_does_not_chain(spark):
    d = spark.createDataFrame([("p", i, float(i)) for i in range(4)], "part string, id int, t double")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "left int, right int")
    assert rows(folds.complete_link(d, chain, "part", "id", ["t"]).select("id", "cluster"), "id") == [(0, 1), (1, 1), (2, 2), (3, 2)]
    empty = folds.complete_link(d, chain.limit(0), "part", "id", ["t"])
    assert [r["cluster"] for r in empty.orderBy("id").collect()] == [1, 2, 3, 4]


def test_identities_cannot_link(spark):
    d = spark.createDataFrame([("x", "p1", 1, [1.0, 0.0], 9.0, True), ("x", "p1", 2, [1.0, 0.01], 8.0, True), ("x", "p2", 3, [1.0, 0.0], 7.0, True), ("x", "p3", 4, [0.0, 1.0], 6.0, False), ("x", "p4", 5, [0.0, 0.0], 5.0, True)], "part string, photo string, id int, v array<double>, s double, seed boolean")
    got = dict(rows(folds.identities(d, "part", "photo", "id", "v", "s", "seed").select("id", "identity"), "id"))
    assert got[1] != got[2] or 0 in (got[1], got[2])
    assert got[4] == 0 and got[5] == 0
    many = spark.createDataFrame([(2, "p1"), (2, "p2"), (1, "p1"), (1, "p1"), (0, "p9"), (3, "p1"), (3, "p2")], "identity int, photo string")
    assert rows(folds.identity_names(many, "identity", "photo").select("identity", "name"), "name") == [(2, "person-001"), (3, "person-002"), (1, "person-003")]


def test_suppress(spark):
    d = spark.createDataFrame([("i", 1, 0.9, 0.0, 0.0, 2.0, 2.0), ("i", 2, 0.8, 0.1, 0.0, 2.1, 2.0), ("i", 3, 0.7, 5.0, 5.0, 6.0, 6.0), ("j", 1, 0.1, 0.0, 0.0, 1.0, 1.0)], "img string, id int, s double, a double, b double, c double, d double")
    assert [(r["img"], r["id"]) for r in folds.suppress(d, "img", ["a", "b", "c", "d"], "s", "id", 0.5).orderBy("img", "id").collect()] == [("i", 1), ("i", 3), ("j", 1)]


def test_match_one_to_one(spark):
    d = spark.createDataFrame([("p", 1, 1, 0.9), ("p", 1, 2, 0.8), ("p", 2, 1, 0.85), ("p", 2, 2, 0.1)], "p string, l int, r int, s double")
    assert [(r["l"], r["r"]) for r in folds.match_one_to_one(d, ["p"], "l", "r", "s").orderBy("l").collect()] == [(1, 1), (2, 2)]


def test_components(spark):
    d = spark.createDataFrame([(i,) for i in range(40)], "id int")
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "left int, right int")
    assert [r["part"] for r in graph.with_components(d, links, "id").orderBy("id").collect()] == [0] * 31 + list(range(31, 40))


def test_coverage_picks_the_fewest(spark):
    d = spark.createDataFrame([("s", "a", 1, 9.0), ("s", "b", 2, 9.0), ("s", "a", 3, 5.0), ("s", "b", 3, 5.0), ("s", "c", 4, 1.0), ("s", "c", 5, 2.0)], "stage string, cell string, photo int, q double")
    assert [(r["photo"], r["cells"]) for r in selection.coverage_picks(d, "stage", "cell", "photo", "q").orderBy("pick").collect()] == [(3, 2), (5, 1)]


def test_primary_never_repeats_a_cluster(spark):
    rng = random.Random(1)
    data = [(i % 2, i, f"g{rng.randrange(9)}", f"b{rng.randrange(20)}", f"c{rng.randrange(25)}", round(rng.random(), 3), 1 + rng.randrange(4), rng.random() < 0.9, 3 if i == 7 else None) for i in range(120)]
    d = spark.createDataFrame(data, "budget int, id int, grp string, beat string, cluster string, base double, rank int, eligible boolean, locked_stars int")
    got = {r["id"] for r in selection.primary_selection(d, "budget").collect()}
    by = {x[1]: x for x in data}
    for b in (0, 1):
        own = [by[i][4] for i in got if by[i][0] == b]
        assert len(own) == len(set(own))
    assert 7 in got and all(by[i][7] or by[i][8] for i in got)
    bad = d.withColumns({"eligible": F.lit(False), "locked_stars": F.lit(None).cast("int")})
    assert selection.primary_selection(bad, "budget").count() == 0


def test_locks_hold(spark):
    now = spark.createDataFrame([(1, 3, "manual", "manual_override", True), (2, 0, "ai", "redundant_reject", False)], "id int, stars int, origin string, reason string, rating_locked boolean")
    new = spark.createDataFrame([(1, 0, "ai", "technical_reject"), (2, 2, "coverage", "person_stage_gap")], "id int, stars int, origin string, reason string")
    assert [(r["id"], r["stars"], r["origin"]) for r in selection.rated(now, new, "id").orderBy("id").collect()] == [(1, 3, "manual"), (2, 2, "coverage")]


def test_audit_values(spark):
    pairs_ = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("c", "d", False), ("b", "d", False)], "left_id string, right_id string, duplicate boolean")
    clusters = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", None)], "id string, c string")
    r = evaluate.pair_audit(pairs_, clusters, "id", "c").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    assert tuple(evaluate.duplicate_leaks(clusters, "c").first()) == (2, 2, 2)


def test_auc_and_pairs(spark):
    d = spark.createDataFrame([("g", 0.9, True), ("g", 0.5, False), ("g", 0.5, True), ("h", 0.1, False)], "g string, s double, y boolean")
    assert evaluate.roc_auc(d, "s", F.col("y")).first()["auc"] == 0.875
    r = evaluate.pairwise_accuracy(d, "g", "s", F.col("y")).first()
    assert (r["pairwise_accuracy"], r["top1"], r["groups"]) == (0.75, 1.0, 1)
    assert evaluate.best_threshold(evaluate.threshold_sweep(d, "s", F.col("y"))).first()["f1"] == 0.8


def test_pairwise_fit_without_pairs(spark):
    """The weights of logistic regression over all pairs, and a group whose pairs nobody could list."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    import numpy as np

    rng = np.random.default_rng(4)
    data = [(f"g{i % 14}", *(float(v) for v in x), bool(x[0] - 0.5 * x[1] + rng.normal() > 0.3)) for i, x in enumerate(rng.normal(size=(260, 3)) * [1.0, 5.0, 0.1])]
    data += [("one", 1.0, 1.0, 1.0, True), ("none", 0.0, 0.0, 0.0, False)]
    d = spark.createDataFrame(data, "g string, a double, b double, c double, y boolean")
    listed = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(model.pair_differences(d, "g", ["a", "b", "c"], F.col("y")))
    want = LogisticRegression(featuresCol="_x", weightCol="weight", regParam=0.045, fitIntercept=False, maxIter=200, tol=1e-10).fit(listed).coefficients.toArray()
    got = model.fit_pairwise(d, "g", ["a", "b", "c"], F.col("y"))
    assert np.abs(got.coefficients - want).max() < 1e-4 and got.groups == 14
    others, at = rng.normal(size=3000) * 3, rng.normal(size=2000) * 3
    for a, b in zip(model._sums_over(others, at), model._sums_over(others, at, exact=1 << 30), strict=True):
        assert np.abs(a - b).max() < 1e-6
    large = spark.range(100_000).select(F.lit("g").alias("g"), F.randn(1).alias("a"), F.randn(2).alias("b"))
    large = large.withColumn("y", F.col("a") + F.randn(3) > 0)
    m = model.fit_pairwise(large, "g", ["a", "b"], F.col("y"), iterations=6)
    assert m.coefficients[0] > 10 * abs(m.coefficients[1]) and m.groups == 1
    assert not model.fit_pairwise(d.filter("g in ('one', 'none')"), "g", ["a"], F.col("y")).coefficients.any()


def test_micro_average_is_three_valued(spark):
    f = lambda *oks: evaluate.micro_average(spark.createDataFrame([(1, 1, 1, 1, o) for o in oks], "tp int, fp int, fn int, tn int, ok boolean")).first()["ok"]
    assert (f(True, True), f(True, None), f(None, False)) == (True, None, False)


def test_plan_hash_ignores_order(spark):
    d = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id int, path string")
    a, b = delivery.plan_hash(d).first(), delivery.plan_hash(d.orderBy(F.desc("id")).repartition(7)).first()
    assert tuple(a) == tuple(b) and tuple(a) != tuple(delivery.plan_hash(d.filter("id > 0")).first())


def test_replay(spark):
    box = lambda x: (x, 0.0, x + 5.0, 5.0)
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    faces = spark.createDataFrame([("p", 0, box(0.0), "a"), ("p", 1, box(10.0), "b"), ("p", 2, box(10.1), "c"), ("q", 0, box(0.0), "d")], f"photo string, face_index int, box {kind}, person string")
    anchors = spark.createDataFrame([("p", 0, box(0.1), "A"), ("p", 1, box(10.0), "B")], f"photo string, anchor int, box {kind}, person string")
    got = [(r["photo"], r["face_index"], r["person"], r["warning"]) for r in corrections.replay(faces, anchors).orderBy("photo", "face_index").collect()]
    assert got == [("p", 0, "A", False), ("p", 1, None, True), ("p", 2, None, True), ("q", 0, "d", False)]


def test_models(spark):
    rng = random.Random(2)
    data = [(f"g{i % 12}", rng.random(), rng.random()) for i in range(240)]
    d = spark.createDataFrame([(g, a, b, a + 0.2 * b > 0.6) for g, a, b in data], "g string, a double, b double, y boolean").withColumn("label", F.col("y").cast("double"))
    m = model.fit_pointwise(d, ["a", "b"], "label")
    assert m.coefficients[0] > m.coefficients[1] > 0
    p = model.fit_pairwise(d, "g", ["a", "b"], F.col("y"))
    assert p.coefficients[0] > p.coefficients[1] > 0
    with pytest.raises(ValueError):
        model.logistic([F.col("a")], [0.0], [1.0], [1.0, 2.0], 0.0)


# ---- decisions
def photo_rows(spark, rows):
    """Photos of one budget unit from (id, t, seq, feature, people); equal features give equal prints and strong pairs."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

    import numpy as np

    numbers = ArrayType(DoubleType())
    kinds = {"id": LongType(), "budget": LongType(), "t": DoubleType(), "seq": IntegerType(), "name": StringType(), "width": IntegerType(), "height": IntegerType(), "score": DoubleType(), "issues": ArrayType(StringType()), "people": ArrayType(StringType()), "phash": LongType(), "dhash": LongType(), "layout": numbers, "color": numbers, "edge": numbers, "semantic": numbers, "depth": numbers, "locked_stars": IntegerType()}
    out = []
    for i, t, seq, feature, people in rows:
        x = np.random.default_rng(feature).normal(size=24).tolist()
        h = int(np.random.default_rng(feature + 1000).integers(0, 1 << 62))
        out.append((i, 1, t, seq, f"n{i:03d}", 600, 400, 60.0 + i, [], people, h, h, x[:12], x[12:18], x[18:], x, None, None))
    return spark.createDataFrame(out, StructType([StructField(k, v) for k, v in kinds.items()]))


def test_equal_prints_share_a_cluster(spark):
    from sievework.plans.decide import decide

    d = decide(photo_rows(spark, [(k, 5000.0 * k, k * 100, 7, ["a"]) for k in range(4)] + [(9, 40000.0, 900, 8, ["a"])])).photos
    got = {r["id"]: r["cluster"] for r in d.collect()}
    assert len({got[k] for k in range(4)}) == 1 and got[9] != got[0]
    assert d.filter("stars = 3").groupBy("cluster").count().filter("count > 1").count() == 0


def test_pairs_without_time_meet_by_sequence(spark):
    from sievework.plans.decide import decide, pair_table

    rows_ = [(1, None, 10, 7, ["a"]), (2, None, 12, 7, ["a"]), (3, 100.0, 14, 7, ["a"]), (4, None, 500, 7, ["a"]), (5, 100.0, 900, 7, ["a"])]
    seen = pair_table(photo_rows(spark, rows_), 45.0, 28)
    assert sorted((min(r["left"], r["right"]), max(r["left"], r["right"])) for r in seen.select("left", "right").collect()) == [(1, 2), (1, 3), (2, 3), (3, 5)]
    grp = {r["id"]: r["grp"] for r in decide(photo_rows(spark, rows_)).photos.collect()}
    assert grp[1] == grp[2] != grp[4]


def test_copies_of_other_people_stay_apart(spark):
    """Equal features, other sure people: no strict cluster, no photo lost; a photo without time joins its neighbours in sequence."""
    from sievework.plans.decide import decide

    d = decide(photo_rows(spark, [(1, 0.0, 1, 7, ["a"]), (2, 1.0, 2, 7, ["b"]), (3, 9000.0, 300, 7, ["c"])])).photos.collect()
    assert len({r["cluster"] for r in d}) == 3 and all(r["stars"] >= 2 for r in d)
    three = decide(photo_rows(spark, [(1, 0.0, 1, 7, ["a"]), (2, None, 2, 7, ["a"]), (3, 1.0, 3, 7, ["a"])])).photos.collect()
    assert len({r["grp"] for r in three}) == 1 and len({r["cluster"] for r in three}) == 1


def test_many_copies_are_one_row(spark):
    """Copies of one kind stand for each other, whatever their number; what can't be read is nobody's duplicate."""
    from sievework.operators import duplicates

    rows_ = [(i, 1, float(i * 100), i, f"n{i}", ["a"] if i % 3 else ["a", "b"], i % 50 != 7, 5, 5, [1.0]) for i in range(3000)]
    d = spark.createDataFrame(rows_, "id long, budget long, t double, seq int, name string, sure array<string>, readable boolean, phash long, dhash long, layout array<double>")
    d = d.select("*", *[F.col("layout").alias(c) for c in ("color", "edge", "semantic")])
    kinds = duplicates.kinds_of(d)
    links = duplicates.kind_pairs(kinds)
    assert links.count() == 3  # two readable kinds: each with itself, and both together
    got = duplicates.strict_clusters(kinds, links).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 60 + [2940]


def evidence(**changes):
    base = dict(total=0.7, scene=0.7, strong=False, compatible=True, time=0.6, shared=0, pose=None, semantic=0.85, composition=0.5, phash=0.5, dhash=0.5, depth=None)
    return base | changes


def test_merge_rules(spark):
    from sievework.config import preset
    from sievework.operators import pairs

    kinds = "left long, right long, total double, scene double, strong boolean, compatible boolean, time double, shared int, pose double, semantic double, composition double, phash double, dhash double, depth double"

    def merges(name="balanced", **changes):
        d = spark.createDataFrame([(1, 2, *evidence(**changes).values())], kinds)
        r = pairs.group_rules(d, preset(name)).first()
        return r["merges_shared"], r["merges_alone"]

    assert merges() == (True, True) and merges("cautious", time=0.5) == (False, False)
    assert merges(strong=True, compatible=False) == (True, True)
    assert not merges(semantic=0.8)[1] and merges(semantic=None, composition=0.8)[1] and merges(semantic=None, dhash=0.84)[1]
    assert merges(time=0.5, scene=0.64, total=0.62, semantic=None) == (True, False) and merges(time=0.5) == (True, False)
    assert merges(pose=0.3) == (False, False)
    assert merges(pose=0.93, scene=0.6, total=0.57, time=0.5, semantic=None) == (True, True) and not merges(pose=0.93, depth=0.5, scene=0.6, total=0.57, semantic=None)[1]


def test_groups_with_different_people_stay_apart(spark):
    from sievework.config import preset

    at = [(1, 0.0, ["a"]), (2, 1.0, ["a"]), (3, 2.0, ["b"]), (4, 3.0, ["b"]), (5, 4.0, [])]
    d = spark.createDataFrame([("p", k, t, 50.0 + k, people) for k, t, people in at], "part string, id long, t double, score double, people array<string>")
    links = [(a, b, 0.9, 0.9, True, True, 0.9, 0, None) for a, *_ in at for b, *_ in at if a < b]
    e = spark.createDataFrame(links, "left long, right long, total double, scene double, strong boolean, compatible boolean, time double, shared int, pose double")
    got = {r["id"]: (r["group_no"], round(r["confidence"], 6)) for r in folds.online_groups(d, pairs.group_rules(e, preset("balanced")), "part", "id", ["t"], preset("balanced")).collect()}
    assert [got[k][0] for k in range(1, 6)] == [1, 1, 2, 2, 1] and got[1][1] == 0.9
    alone = folds.online_groups(d.filter("id = 1"), pairs.group_rules(e, preset("balanced")).limit(0), "part", "id", ["t"], preset("balanced")).collect()
    assert [(r["group_no"], r["confidence"]) for r in alone] == [(1, 1.0)]


def test_distinct_poses(spark):
    joints = [(0.1 * k, 0.05 * k, 0.9) for k in range(9)]
    near, far, unsure = [(x + 0.001, y, r) for x, y, r in joints], [(x, 1 - y, r) for x, y, r in joints], [(x, y, 0.3) for x, y, r in joints]
    rows_ = [(1, 1, joints, [1.0, 0.0], 0.5), (1, 2, near, [0.99, 0.0], 0.9), (1, 3, far, [1.0, 0.0], 0.4), (1, 4, near, [0.0, 1.0], 0.3), (1, 5, unsure, [1.0, 0.0], 0.2), (2, 6, joints, [1.0, 0.0], 0.1), (1, 7, near, None, 0.1)]
    d = spark.createDataFrame(rows_, "image long, key long, joints array<struct<x:double,y:double,reliability:double>>, descriptor array<double>, presence double")
    assert sorted(r["key"] for r in folds.distinct_poses(d, "image", "joints", "descriptor", [F.desc("presence")], "key").collect()) == [2, 3, 4, 5, 6, 7]


def test_delivery_reserve_same_as_plain(spark):
    """Against a plain loop that takes the best of all rows at every step."""
    rng = random.Random(6)
    data = []
    for i in range(90):
        keys = sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randrange(0, 4)))
        data.append((i % 2, i, rng.randrange(9), rng.randrange(20), rng.randrange(50), round(rng.random(), 2), round(rng.random(), 2), rng.randrange(1, 5), rng.randrange(3), rng.random() < 0.85, rng.random() < 0.2, keys))
    names_ = ["budget", "id", "grp", "beat", "cluster", "quality", "stable", "rank", "severe", "eligible", "delivered", "keys"]
    d = spark.createDataFrame(data, "budget long, id long, grp long, beat long, cluster long, quality double, stable double, rank long, severe long, eligible boolean, delivered boolean, keys array<string>")
    got = {(r["budget"], r["pick"]): r["id"] for r in selection.delivery_reserve(d, "budget").collect()}
    want = {}
    for budget in (0, 1):
        mine = [dict(zip(names_, x)) for x in data if x[0] == budget]
        taken, out = [r for r in mine if r["delivered"]], []
        while len(taken) < round(0.75 * len(mine)):
            shown = {k: sum(k in r["keys"] for r in taken) for k in "abcde"}
            many = lambda name, r: sum(x[name] == r[name] for x in taken)

            def worth(r):
                counts = [shown[k] for k in r["keys"]]
                return min(counts), -counts.count(min(counts)), -math.fsum(1 / (c + 1) for c in counts), r["severe"], many("beat", r), many("grp", r), -r["quality"], -r["stable"], r["rank"], r["id"]

            pool = [r for r in mine if r["eligible"] and not r["delivered"] and r["keys"] and r["id"] not in out and not many("cluster", r)]
            if not pool:
                break
            best = min(pool, key=worth)
            taken.append(best)
            out.append(best["id"])
            want[budget, len(out)] = best["id"]
    assert got == want and want


def test_engines(spark):
    from sievework.operators import engines
    from sievework.plans.catalog_chain import TagEngine

    d = spark.createDataFrame([(1, "<p><p><b>", "tags:1"), (2, "plain", "tags:0"), (3, None, None)], "id long, html string, made string")
    got = lambda **k: sorted(tuple(r) for r in engines.analyzed(d, "html", TagEngine, "element string, n bigint", **k).select("id", F.coalesce("element", F.lit("")), "n").collect())
    assert got() == [(1, "b", 1), (1, "p", 2)] and got(keep_empty=True) == [(1, "b", 1), (1, "p", 2), (2, "", None), (3, "", None)]
    assert [r["embedding"] for r in engines.embedded(d, "html", TagEngine).orderBy("id").collect()] == [[9.0, 3.0], [5.0, 0.0], None]
    assert tuple(engines.status(d, "made", TagEngine()).first()) == (3, 1, False) and engines.status(d.filter("id = 1"), "made", TagEngine()).first()["ready"]
