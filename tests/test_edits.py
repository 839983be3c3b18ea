import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import checks, edits, external, filters, folds
from sievework.sinks import chunked, reports
from sievework.sources import models

PHOTOS = "project string, id string, group_id string, stars int, rating_tier string, rating_origin string, rating_reason string, rating_locked boolean, needs_review boolean, category string, issues array<string>, cluster string, coverage_protected boolean, coverage_person_ids array<string>, note string"
PROJECTS = "project string, people int, stages int, required_cells int, unresolved_cells int, elapsed_seconds double, identity_revision int, rescan_required boolean"


@pytest.fixture()
def photos(spark):
    row = lambda i, g, stars, cat, issues, cluster, prot: ("p", i, g, stars, "waste", "ai", "rank", False, True, cat, issues, cluster, prot, ["x"], "kept")
    rows = [row("a", "g", 3, "selected", [], "c", False), row("b", "g", 3, "selected", ["noisy"], "c", True), row("c", "h", None, None, None, None, None), row("d", "h", 1, "duplicate", [], "c", False), row(None, None, 3, "blurred", [], "", False)]
    return spark.createDataFrame(rows, PHOTOS)


@pytest.fixture()
def projects(spark):
    return spark.createDataFrame([("p", 4, 2, 9, None, 1.25, 3, False), ("empty", None, None, None, None, None, None, None)], PROJECTS)


def test_summary(photos, projects):
    got = {r["project"]: r.asDict() for r in edits.project_summary(photos, projects).collect()}
    p = got["p"]
    assert (p["total"], p["selected"], p["duplicates"], p["issues"], p["groups"], p["coverage_protected"]) == (5, 3, 1, 3, 2, 1)
    assert (p["primary_duplicate_leaks"], p["primary"], p["valuable"], p["waste"], p["stars_3"]) == (1, 3, 1, 1, 3)  # the empty cluster is none
    assert (p["people"], p["coverage_required_cells"], p["coverage_unresolved_cells"], p["elapsed_seconds"]) == (4, 9, 0, 1.2)
    assert set(v for k, v in got["empty"].items() if k != "project") == {0, 0.0}


def test_rate(spark, photos, projects):
    ratings = spark.createDataFrame([("b", 0, 1, None), ("b", 2, 2, False), ("c", 3, 1, None), ("d", 4, 1, True), ("d", None, 1, True), ("zz", 1, 1, True), (None, 1, 1, True)], "id string, stars int, at int, locked boolean")
    out = edits.rate(photos, ratings, ["at"])
    now = {r["id"]: r for r in out.photos.collect()}
    assert out.photos.columns == photos.columns and len(now) == 5
    assert (now["b"]["stars"], now["b"]["rating_tier"], now["b"]["rating_locked"], now["b"]["coverage_protected"], now["b"]["note"]) == (2, "coverage", False, False, "kept")
    assert (now["c"]["stars"], now["c"]["rating_origin"], now["c"]["rating_locked"]) == (3, "manual", True)
    assert now["d"]["stars"] == 1 and now["a"]["rating_origin"] == "ai" and now[None]["stars"] == 3
    assert sorted(map(tuple, out.groups.collect())) == [("p", "g", 2, 2, False), ("p", "h", 2, 1, False)]
    assert sorted(map(tuple, out.log.collect())) == [("p", "b", "g", "waste", "coverage", 2), ("p", "c", "h", "waste", "primary", 3)]
    assert sorted(map(tuple, out.refused.collect()), key=repr) == sorted([("d", 4, "range"), ("d", None, "range"), ("zz", 1, "unknown"), (None, 1, "unknown")], key=repr)
    assert edits.project_summary(out.photos, projects).filter("project = 'p'").first()["primary_duplicate_leaks"] == 0
    nothing = edits.rate(photos, ratings.limit(0), ["at"])
    assert nothing.groups.isEmpty() and nothing.photos.exceptAll(photos).isEmpty()


def test_corrections(spark):
    faces = spark.createDataFrame([("p", "a", 0, "1"), ("p", "a", 1, "2"), ("p", "b", 0, "1"), ("q", "c", 0, "1"), ("p", "b", 1, None)], "project string, photo string, face_index int, person string")
    photos = spark.createDataFrame([("p", "a", "g", ["1", "2"], ["k"], True), ("p", "b", "g", ["1"], ["k"], False), ("q", "c", "h", ["1"], ["k"], True)], "project string, id string, group_id string, person_ids array<string>, coverage_keys array<string>, coverage_protected boolean")
    projects = spark.createDataFrame([("p", 3, False, 9, 1), ("q", 3, False, 9, 1), ("r", 0, False, 0, 0)], "project string, identity_revision int, rescan_required boolean, required_cells int, unresolved_cells int")
    requests = spark.createDataFrame([("p", 3), ("q", 2)], "project string, revision int")
    merges = spark.createDataFrame([("p", "2", "1"), ("q", "1", "9")], "project string, person string, new_person string")
    splits = spark.createDataFrame([("p", "b", 0, "7")], "project string, photo string, face_index int, new_person string")
    out = edits.correct_identities(faces, photos, projects, requests, merges, splits)
    assert sorted(map(tuple, out.faces.select("photo", "face_index", "person").collect())) == [("a", 0, "1"), ("a", 1, "1"), ("b", 0, "7"), ("b", 1, None), ("c", 0, "1")]
    assert sorted((r["id"], r["person_ids"], r["coverage_keys"], r["coverage_protected"]) for r in out.photos.collect()) == [("a", ["1"], [], False), ("b", ["7"], [], False), ("c", ["1"], ["k"], True)]
    assert sorted(map(tuple, out.group_people.collect())) == [("p", "g", "1"), ("p", "g", "7"), ("q", "h", "1")]
    assert sorted(map(tuple, out.projects.collect())) == [("p", 4, True, None, None, "applied"), ("q", 3, False, 9, 1, "conflict"), ("r", 0, False, 0, 0, "kept")]


def test_manifests(spark):
    good, h = "0123456789abcdef", "a" * 64
    m = [(good, good, h, "execute", "1", "2026-01-01", "in_place", "none", False, 3), ("short", None, "x", "drop", "", "now", "copy", "none", None, 3)]
    manifests = spark.createDataFrame(m, "request_id string, operation_id string, plan_hash string, operation string, app_version string, created_at string, import_mode string, collection_mode string, write_xmp boolean, protect_above int")
    item = lambda r, i, p, t=1: (r, i, "/x/y", p, 1, 1, t, "waste", "why")
    kind = "request_id string, item_id string, source_path string, path_hash string, file_size long, modified_ns long, target_rating int, rating_tier string, rating_reason string"
    items = spark.createDataFrame([item(good, "1", h), item(good, "2", "b" * 64, 0)], kind)
    got = {r["request_id"]: (r["faults"], r["sound"]) for r in checks.manifest_faults(manifests, items).collect()}
    assert got[good] == ([], True)
    assert got["short"] == (["app_version", "created_at", "no_items", "operation", "operation_id", "plan_hash", "policy", "request_id"], False)
    bad = spark.createDataFrame([item(good, "1", h), item(good, "1", h, 4), item(good, None, None, None)], kind)
    assert {r["request_id"]: r["faults"] for r in checks.manifest_faults(manifests, bad).collect()}[good] == ["item_id", "path_hash", "repeated_id", "repeated_path", "target_rating"]


def test_receipts(spark):
    manifests = spark.createDataFrame([("r", "o", "h"), ("s", "o", "h")], "request_id string, operation_id string, plan_hash string")
    kind = "request_id string, item_id string, path_hash string, target_rating int"
    items = spark.createDataFrame([("r", "1", "x", 1), ("r", "2", "y", 2), ("s", "1", "x", 1)], kind)
    head = "request_id string, operation_id string, plan_hash string, total int, new int, update int, unchanged int, protected int, invalid int"
    receipts = spark.createDataFrame([("r", "o", "h", 2, 1, 1, 0, 0, 0), ("s", "o", "other", 2, 1, 0, 0, 0, 0), ("t", "o", "h", 0, 0, 0, 0, 0, 0)], head)
    back = spark.createDataFrame([("r", "1", "x", 1, "new"), ("r", "2", "y", 2, "update"), ("s", "1", "z", 1, "new"), ("s", "1", "x", 2, "update"), ("s", "9", "x", 2, "update")], kind + ", action string")
    got = {r["request_id"]: r["faults"] for r in checks.receipt_faults(manifests, items, receipts, back).collect()}
    assert got == {"r": [], "s": ["actions", "counts", "item", "plan", "repeated_item", "total", "unknown_item"], "t": ["plan"]}


def test_gates_and_ranges(spark):
    projects = spark.createDataFrame([("a", 2, "native", True, None), ("b", 2, "native", True, True), ("c", 1, "native", True, False), ("d", 2, "native", None, False), (" ", 2, "native", True, False)], "project_id string, schema_version int, status string, delivery_ready boolean, identity_rescan_required boolean")
    assert {r["project_id"]: r["gate"] for r in checks.native_projects(projects).collect()} == {"a": "ready", "b": "identities_changed", "c": "not_native", "d": "not_native", " ": "no_id"}
    rows = spark.createDataFrame([("a", 5, 0.5, None), ("b", 6, 0.96, 0)], "id string, keep_per_group int, min_confidence double, timeout_seconds int")
    assert sorted(map(tuple, checks.out_of_range(rows, "id").collect())) == [("a", []), ("b", ["keep_per_group", "min_confidence", "timeout_seconds"])]


def test_outside_reviews(spark):
    say = lambda *ids, c=0.9: json.dumps({"best": ids[0], "ranking": [{"id": i, "rank": n} for n, i in enumerate(ids, 1)], "confidence": c})
    groups = spark.createDataFrame([(g, f"k{g}", g, ["x", "y"]) for g in "abcdef"] + [("none", None, "none", ["x", "y"])], "group string, key string, prompt string, candidates array<string>")
    no_first = json.dumps({"best": "x", "ranking": [{"id": "x", "rank": 2}, {"id": "y", "rank": 3}], "confidence": 1.0})
    cache = spark.createDataFrame([("ka", say("y", "x")), ("kb", say("y")), ("kc", no_first), (None, say("x", "y"))], "key string, response string")

    def ask(prompt):
        g = prompt[0]
        if g == "d" and "\n" not in prompt:
            return "sorry"
        if g in "ef":
            return {"e": say("x", "x"), "f": say("x", "y", c=7)}[g]
        return "```json\n" + say("x", "y", c=0.4 if g == "c" else 0.8) + "\n```"

    out = external.review(groups, cache, ask)
    got = {r["group"]: (r["source"], r["decision"]["best"] if r["decision"] else None, r["prompt"]) for r in out.collect()}
    assert got == {"a": ("cached", "y", "a"), "b": ("asked", "x", "b"), "c": ("asked", "x", "c"), "d": ("repaired", "x", "d"), "e": ("failed", None, "e"), "f": ("failed", None, "f"), "none": ("asked", "x", "none")}
    assert tuple(external.review_report(out, 0.5).first()) == (7, 1, 3, 1, 2, 4)
    assert sorted(r["key"] for r in external.new_responses(out).filter("key is not null").collect()) == ["kb", "kc", "kd"]
    assert sorted(map(tuple, external.outer_ranks(out, 0.5).filter("group = 'a'").collect())) == [("a", "x", 2), ("a", "y", 1)]
    assert external.review(groups.limit(0), cache, ask).isEmpty()


def test_parts_and_stages(spark):
    pose = "array<struct<bbox:array<double>,visibility:double,landmarks:array<array<double>>,descriptor:array<double>,model:string>>"
    rows = spark.createDataFrame([(1, [([0.12345678], 0.123456, [[0.1234567, None]], [1.0], "m"), None]), (2, None)], f"id int, poses {pose}")
    got = {r["id"]: r["poses"] for r in filters.public_parts(rows, "poses", "pose").collect()}
    assert tuple(got[1][0]) == ([0.123457], 0.1235, [[0.12346, None]], True, "m") and got[1][1] is None and got[2] is None
    stages = spark.createDataFrame([("p", "s", "old", 1), ("p", "s", "new", 2), ("p", "t", "", 1), ("p", None, "x", 1), ("p", "", "x", 1)], "project string, stage string, label string, at int")
    assert sorted(map(tuple, filters.stage_labels(stages, "project", "stage", "label", ["at"]).collect())) == [("p", "s", "new"), ("p", "t", "t")]


def test_two_passes(spark):
    kind = "image int, box int, score double, x1 double, y1 double, x2 double, y2 double"
    first = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.4, 50.0, 0.0, 60.0, 10.0)], kind)
    second = spark.createDataFrame([(1, 0, 0.9, 100.0, 0.0, 120.0, 20.0), (1, 1, 0.5, 0.0, 0.0, 20.0, 20.0), (2, 0, 0.1, 0.0, 0.0, 2.0, 2.0)], kind)
    out = folds.two_passes(first, second, "image", ["x1", "y1", "x2", "y2"], "score", "box", 0.4, 0.5)
    assert sorted(map(tuple, out.select("image", "place", "pass", "box").collect())) == [(1, 1, 0, 0), (1, 2, 1, 0), (2, 1, 1, 0)]


def test_release(spark, tmp_path):
    m = lambda n: models.LogisticModel(tuple("abc"[:n]), (0.0,) * n, (1.0,) * n, (1.0,) * n, 0.0)
    table = spark.range(5).withColumn("x", F.col("id") * 2)
    from sievework.operators.delivery import plan_hash

    frozen = {"holdout_read": False, "tuned_after_holdout": False, "tables": {"t": plan_hash(table).first()["plan_hash"]}, "configuration": {"k": 1}}
    path = str(tmp_path / "model.json")
    digest = models.release({"base": m(1), "wide": m(3)}, path, frozen, {"t": table.orderBy(F.desc("id"))})
    held = json.load(open(path))
    assert held["digest"] == digest and list(held["profiles"]) == ["base", "wide"] and held["configuration"] == {"k": 1}
    for change, tables, profiles in (({"holdout_read": True}, {"t": table}, {"b": m(1)}), ({"tuned_after_holdout": None}, {"t": table}, {"b": m(1)}), ({}, {"t": table.filter("id > 0")}, {"b": m(1)}), ({}, {}, {"b": m(1)}), ({}, {"t": table}, {"a": m(2), "b": m(2)}), ({}, {"t": table}, {})):
        with pytest.raises(ValueError):
            models.release(profiles, str(tmp_path / "no.json"), frozen | change, tables)
    assert not (tmp_path / "no.json").exists()


def test_chunk_receipts(spark, tmp_path):
    changes = spark.createDataFrame([(f"{i:03d}", "update", 1, 2) for i in range(5)] + [("n", "new", None, 3)], "id string, action string, previous int, target int")
    catalogue = chunked.Catalogue(spark, str(tmp_path / "cat"))
    catalogue.put("base", spark.createDataFrame([(f"{i:03d}", 1) for i in range(5)], "id string, rating int"))
    chunked.submit(changes, str(tmp_path / "plan"), {"update": 3, "new": 1})
    plan = spark.read.schema(chunked.PLAN).parquet(str(tmp_path / "plan"))
    state = lambda: tuple(chunked.receipt_phase(chunked.receipt(plan, catalogue)).first())
    assert state() == ("begun", 6, 0, 6, 0)
    assert chunked.write_chunk(plan.filter("id < '003'"), catalogue) == "complete"
    assert state() == ("running", 6, 3, 3, 0)
    catalogue.put("user", spark.createDataFrame([("000", 5)], "id string, rating int"))
    assert {r["id"]: r["status"] for r in chunked.receipt(plan, catalogue).collect()} == {"000": "changed", "001": "verified", "002": "verified", "003": "pending", "004": "pending", "n": "pending"}
    broken = lambda name, rows: None
    assert chunked.write_chunk(plan.filter("id in ('003', '004')"), catalogue, broken) == "failed"
    assert state() == ("error", 6, 3, 1, 2)
    assert tuple(chunked.receipt_phase(chunked.receipt(plan.limit(0), catalogue)).first()) == ("empty", 0, 0, 0, 0)


def test_results(spark, tmp_path):
    photos = spark.createDataFrame([("p", "b", 1), ("p", "a", None), ("q", "c", 2)], "project string, id string, stars int")
    head = spark.createDataFrame([("p", "p", "x"), ("q", "q", "y")], "project string, id string, name string")
    reports.write_results({"summary": head, "photos": photos}, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).select("project", F.get_json_object("value", "$.part").alias("part"), F.get_json_object("value", "$.row.id").alias("id"))
    assert sorted(map(tuple, got.collect())) == [("p", "photos", "a"), ("p", "photos", "b"), ("p", "summary", "p"), ("q", "photos", "c"), ("q", "summary", "q")]
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / "project=p").glob("*.txt")) for x in f.read_text().splitlines()]
    assert [(x["part"], x["row"]["id"]) for x in lines] == [("summary", "p"), ("photos", "a"), ("photos", "b")]
