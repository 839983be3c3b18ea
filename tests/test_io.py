"""Sources, sinks and streams."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sievework.plans import catalog_decide
from sievework.sinks import export, reports
from sievework.sources import files, projects, store
from sievework.streaming import operations, queue

from .conftest import rows

SF = "/root/testdata/sf0.001"


def test_listing(spark, tmp_path):
    for name in ("b.CR2", "B.jpg", "c.jpg", "note.txt", "sub/d.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 4 and files.listing(spark, str(tmp_path), recursive=False).count() == 3
    assert sorted(os.path.basename(r["path"]) for r in files.without_companions(found).collect()) == ["b.CR2", "c.jpg", "d.png"]
    assert [os.path.basename(r["preview"]) for r in files.raw_previews(found).collect()] == ["B.jpg"]
    assert files.with_ids(found).filter("length(photo_id) = 24").count() == 4
    assert sorted(r["stem"] for r in files.reference_stems(found).collect()) == ["b", "c", "d"]


def test_store(spark, tmp_path):
    s = store.FeatureStore(spark, str(tmp_path / "store"))
    photos = spark.createDataFrame([("k1", 10, 1, 0.5), ("k2", 20, 2, 0.6)], "cache_key string, size long, modified long, sharp double")
    faces = spark.createDataFrame([("k1", 1, "b"), ("k1", 0, "a"), ("k2", 0, "c")], "cache_key string, face_index int, person string")
    s.save(photos, {"face": faces})
    new = spark.createDataFrame([("k1", 11, 3, 0.9, "x")], "cache_key string, size long, modified long, sharp double, extra string")
    s.save(new, {"face": spark.createDataFrame([("k1", 0, "z")], faces.schema)})
    wanted = spark.createDataFrame([("k1", 11, 3), ("k2", 20, 9), ("k3", 1, 1)], "cache_key string, size long, modified long")
    got = {r["cache_key"]: r for r in s.load(wanted).collect()}
    assert got["k1"]["sharp"] == 0.9 and [f["person"] for f in got["k1"]["faces"]] == ["z"]
    assert got["k2"]["sharp"] is None and got["k3"]["sharp"] is None and s.read("photo").count() == 2
    s.log_action(wanted)
    s.log_action(wanted)
    assert s.spark.read.parquet(f"{s.root}/actions").count() == 6


def test_projects(spark, tmp_path):
    photo = lambda i, **k: {"id": i, "filename": f"{i}.jpg", "group_id": "g", "stars": 3 if i == "a" else 0, **k}
    new = {"project_id": "p2", "schema_version": 2, "photos": [photo("a", strict_duplicate_cluster_id="c", coverage_keys=[], person_ids=["x"], rating_tier="primary")], "files": {"a": "/x/a.jpg"}}
    old = {"project_id": "p1", "photos": [photo("a", person_ids=["x"]), photo("lost"), photo("b", person_ids=["x", "y"])], "files": {"a": "/x/a.jpg", "b": "/x/b.jpg"}}
    for name, text in (("1.json", json.dumps(old)), ("2.json", json.dumps(new)), ("3.json", "{broken")):
        (tmp_path / name).write_text(text)
    held = projects.read_projects(spark, str(tmp_path))
    assert sorted(r["project_id"] for r in held.collect()) == ["p1", "p2"]
    p = projects.photos(held)
    got = {(r["project_id"], r["id"]): r for r in p.collect()}
    assert set(got) == {("p1", "a"), ("p1", "b"), ("p2", "a")}
    assert got["p1", "a"]["rating_tier"] == "primary" and got["p1", "b"]["rating_reason"] == "legacy_score" and got["p1", "a"]["status"] == "rescan_required" and got["p2", "a"]["status"] == "native"
    g = {r["project_id"]: r for r in projects.groups(p).collect()}
    assert g["p1"]["best_ids"] == ["a"] and g["p1"]["people"] == ["x", "y"] and g["p1"]["members"] == 2


def test_export(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir()
    plan = []
    for i in range(5):
        (src / f"{i}.raw").write_bytes(b"x" * (i + 1))
        plan.append((str(i), str(src / f"{i}.raw"), str(dst / f"d/{i}.raw"), hashlib.sha256(b"x" * (i + 1)).hexdigest(), "copy"))
    d = spark.createDataFrame(plan, "id string, source string, target string, sha string, action string")
    assert {r["outcome"] for r in export.execute(d).collect()} == {"copied"}
    assert {r["outcome"] for r in export.execute(d).collect()} == {"present"}
    assert sorted(os.listdir(dst / "d")) == [f"{i}.raw" for i in range(5)]
    (src / "3.raw").write_bytes(b"other")
    with pytest.raises(ValueError):
        export.execute(d)


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    reports.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert reports.markdown(d, "T").splitlines()[2] == "| n | s |"
    with pytest.raises(ValueError):
        reports.markdown(d, "T", 1)
    cells = reports.sheet_cells(spark.range(10).withColumn("g", F.lit(1)), "g", "id", 2, 6)
    assert rows(cells.filter("id = 9").select("page", "row")) == [(1, 1)]


def request(n, **more):
    return {"request_id": f"{n:032x}", "operation_id": "op", "plan_hash": "a" * 64, "operation": "execute", "created_at": "now", "items": [{"item_id": "1", "path_hash": "h", "target_rating": 3, "rating_tier": "primary"}]} | more


def test_queue(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    assert queue.write_once(inbox, "r1", request(1)) and not queue.write_once(inbox, "r1", request(1))
    with pytest.raises(ValueError):
        queue.write_once(inbox, "r1", request(2))
    queue.write_once(inbox, "r2", request(2, plan_hash="short"))
    answer = lambda rows: rows.select("request_id", F.lit("complete").alias("status"), F.size("items").alias("items"))
    for _ in range(2):
        queue.serve(queue.requests(spark, inbox), answer, out, str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in spark.read.json(out).select("request_id", "status").collect()] == [(f"{1:032x}", "complete")]
    assert spark.read.json(f"{out}-rejected").count() == 1
    queue.write_once(inbox, "r3", request(3))
    queue.serve(queue.requests(spark, inbox), answer, out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(out).count() == 2


def test_states(spark, tmp_path):
    events = [("a", "submit", 1), ("a", "claim", 2), ("a", "receipt", 3), ("a", "claim", 4), ("b", "submit", 1), ("b", "cancel", 2), ("b", "claim", 3)]
    d = spark.createDataFrame([(k, e, n, 1700000000 + n) for k, e, n in events], "operation_id string, event string, number int, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    want = [("a", "preflight_ready", 3), ("b", "cancelled", 2)]
    assert rows(operations.final_states(d, "operation_id", ["number"], "event"), "operation_id") == want
    d.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "events"))
    q = operations.live_states(stream).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from live").collect())) == want


def test_activity_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = operations.activity(stream, "ts", "user_id").writeStream.format("memory").queryName("act").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    live, batch = spark.sql("select * from act").count(), operations.activity(e, "ts", "user_id").count()
    assert 0 < live <= batch


def test_decide_invariants(spark):
    from sievework.plans.decide import decide

    d = decide(catalog_decide._photos(spark, SF))
    p = d.photos.toPandas()
    assert p["id"].is_unique and len(p) == spark.read.parquet(f"{SF}/events.parquet").count()
    free = p[(p["stars"] == 3) & (p["origin"] == "ai")]
    assert not free.duplicated(["budget", "cluster"]).any()
    assert (p.loc[p["origin"] == "manual", "stars"] == 3).all()
    assert set(zip(p["stars"], p["tier"], strict=True)) <= {(0, "waste"), (1, "valuable"), (2, "coverage"), (3, "primary")}
    assert d.report.agg(F.sum("photos")).first()[0] == len(p)


def test_models_and_operations(spark, tmp_path):
    from sievework.sinks import operations as ops
    from sievework.sources import models

    m = models.LogisticModel(("a", "b"), (0.0, 1.0), (1.0, 2.0), (0.5, -1.0), 0.1)
    path = str(tmp_path / "m.json")
    m.save(path)
    assert models.load_model(path, ("a", "b")) == m and models.load_model_or_none(path, ("a",)) is None and models.load_model_or_none(str(tmp_path / "none"), ("a",)) is None
    d = spark.createDataFrame([(1.0, None), (0.0, 3.0)], "a double, b double")
    assert [round(r[0], 6) for r in d.select(m.score()).collect()] == [round(1 / (1 + 2.718281828459045 ** -(0.1 + 0.5 + 0.5)), 6), round(1 / (1 + 2.718281828459045 ** -(0.1 - 1.0)), 6)]
    with pytest.raises(ValueError):
        models.LogisticModel(("a",), (0.0,), (0.0,), (1.0,), 0.0)
    (tmp_path / "iqa.json").write_text(json.dumps({"d": {"p1": 1.5, "p2": 2.0}}))
    rows_ = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 2)], "photo_id string, b int")
    got = {r["photo_id"]: r["iqa"] for r in models.with_scores(rows_, models.score_table(spark, str(tmp_path / "iqa.json"), "d"), "b").collect()}
    assert got == {"p1": 1.5, "p2": None, "p3": None}
    assert models.provenance(rows_, {"x": 1}).first()["sources"] == 3
    op = "ab" * 16
    for n in (1, 2, 10):
        assert ops.append_journal(str(tmp_path / "j"), op, n, {"n": n})
    r = ops.latest_journals(spark, str(tmp_path / "j")).first()
    assert (r["operation"], r["revision"], json.loads(r["value"])) == (op, 10, {"n": 10})
    with pytest.raises(ValueError):
        ops.append_journal(str(tmp_path / "j"), "../x", 1, {})
    inbox, out, arch = (str(tmp_path / x) for x in ("in", "out", "arch"))
    queue.write_once(inbox, "q", {"a": 1})
    for _ in range(2):
        ops.publish_receipt(inbox, out, arch, "q", {"ok": True})
    assert os.listdir(arch) == ["q.json"] and os.listdir(inbox) == []
    queue.write_once(str(tmp_path / "work"), "w", {"a": 1})
    ops.recover(str(tmp_path / "work"), inbox, str(tmp_path / "bad"))
    assert os.listdir(inbox) == ["w.json"]
    ops.beat(str(tmp_path / "beat.json"), busy=False)
    assert ops.fresh(spark.read.json(str(tmp_path / "beat.json")), __import__("time").time()).count() == 1


def test_chunked_catalogue(spark, tmp_path):
    """A chunk that fails leaves the state before it, a run that goes on completes, and a changed catalogue asks for a new plan."""
    from sievework.sinks import chunked

    def state(c):
        return {r["id"]: r["rating"] for r in c.read().collect()}

    changes = spark.createDataFrame([(f"p{k:02d}", "update" if k < 12 else "new", k % 4 if k < 12 else None, 3) for k in range(14)], "id string, action string, previous int, target int")
    base = {f"p{k:02d}": k % 4 for k in range(12)}
    rows_ = spark.createDataFrame([*base.items()], "id string, rating int")
    c = chunked.Catalogue(spark, str(tmp_path / "cat"))
    c.put("base", rows_)
    chunked.submit(changes, str(tmp_path / "plan"), {"update": 5, "new": 1})

    def torn(name, rows):  # the second chunk loses rows on its way
        c.put(name, rows.filter("id < 'p06'") if name == "update-00000001" else rows)

    run = lambda put=None: chunked.execute(spark, str(tmp_path / "plan"), c, str(tmp_path / "ck"), put)
    assert run(torn) == "failed"
    done = c.states()
    assert done.pop("update-00000001") == "failed" and set(done.values()) <= {"complete"}
    written = {f"p{k:02d}" for k in range(14) if ("update-%08d" % (k // 5) if k < 12 else "new-%08d" % (k - 12)) in done}
    assert state(c) == base | dict.fromkeys(written, 3)
    assert run() == "complete"
    assert state(c) == dict.fromkeys([f"p{k:02d}" for k in range(14)], 3) and set(c.states().values()) == {"complete"} and len(c.states()) == 5
    again = chunked.Catalogue(spark, str(tmp_path / "cat2"))
    again.put("base", rows_)
    again.put("other", spark.createDataFrame([("p07", 0)], "id string, rating int"))
    assert chunked.execute(spark, str(tmp_path / "plan"), again, str(tmp_path / "ck2")) == "replan_required"
    now = state(again)
    assert now["p07"] == 0 and all(v == 3 or v == base[k] for k, v in now.items() if k in base and k != "p07")


def test_rating_features_that_are_not_finite(spark):
    from sievework.operators import features

    faces = spark.createDataFrame([("a", 0, "x", 0.004, 0.9, 0.0, 0.2, -10.0, 50.0), ("a", 1, None, 0.0001, 0.9, 0.0, 0.9, 5.0, 1.0)], "photo string, face_index int, person string, area double, confidence double, roll double, occlusion double, yaw double, smile double")
    m = lambda **k: {n: float(v) for n, v in k.items()}
    good = m(musiq_score=60, qualiclip_score=0.5, face_quality_score=80, depth_background_blur_score=70, motion_blur_score=40)
    data = [("a", 1, good), ("b", 1, m(musiq_score=70, qualiclip_score=0.4)), ("c", 2, m(musiq_score=70, qualiclip_score=float("nan"), eye_score=9)), ("d", 2, None), ("e", 3, m(eye_score=float("inf"))), ("f", 3, m(eye_score=1))]
    rows_ = spark.createDataFrame([(i, b, "g", x) for i, b, x in data], "id string, budget int, grp string, metrics map<string,double>")
    got = {r["id"]: r for r in features.rating_features(rows_, faces, "budget", "grp", F.col("id")).collect()}
    assert {k: (r["profile"], r["reason"]) for k, r in got.items()} == {"a": ("iqa", ""), "b": ("iqa", ""), "c": ("base", "scores_incomplete"), "d": ("base", "scores_incomplete"), "e": ("stable", "not_finite"), "f": ("stable", "not_finite")}
    names_ = features.BASE_FEATURES + features.SCORE_FEATURES
    a = dict(zip(names_, got["a"]["x"], strict=True))
    assert (a["face_count"], a["largest_face_ratio"], a["mean_abs_yaw"], a["portrait_present"], a["person_count"], a["dof_portrait_quality"]) == (2.0, 4.0, 10.0, 1.0, 1.0, 80.0)
    assert (a["iqa_musiq"], a["iqa_qualiclip"], a["iqa_relative_musiq"], a["iqa_relative_qualiclip"], a["iqa_consensus"], a["iqa_disagreement"]) == (60.0, 50.0, 0.0, 100.0, 50.0, 100.0)
    assert got["e"]["x"] is None and len(got["c"]["x"]) == 37 and set(got["d"]["x"]) == {0.0}


def test_training_set(spark, tmp_path):
    """Records, manifest, held-out lists and counts against a plain version; a locked group that is missing is an error."""
    import hashlib

    from sievework.operators import training

    data = [(f"d{g % 2}", f"g{g}", f"p{g}-{k}", f"S{g}-{k}", f"n{k % 2}", k % 3, float(10 * k % 7)) for g in range(40) for k in range(1 + g % 7)]
    p = spark.createDataFrame(data, "dataset string, grp string, id string, stem string, name string, rank int, score double")
    marked = {(g, k) for g in range(40) for k in range(1 + g % 7) if (g * 7 + k * 3) % 5 == 0 or (g % 4 == 0 and k == 1)}
    labels = spark.createDataFrame([(f"d{g % 2}", f"s{g}-{k}") for g, k in marked], "dataset string, stem string")
    groups_ = {g: [r for r in data if r[1] == f"g{g}"] for g in range(40)}
    yes = lambda r: tuple(map(int, r[2][1:].split("-"))) in marked
    tests = [g for g, rs in groups_.items() if len(rs) > 1 and any(map(yes, rs))][:3]
    locked = spark.createDataFrame([(f"d{g % 2}", f"g{g}") for g in tests], "dataset string, grp string")
    digest = lambda *x: hashlib.sha256("|".join(x).encode()).hexdigest()
    want = {}
    for g, rs in groups_.items():
        hits = [r for r in rs if yes(r)]
        if len(rs) < 2 or not hits:
            continue
        split = "test" if g in tests else "validation" if int(hashlib.sha256(f"d{g % 2}|g{g}".encode()).hexdigest()[:16], 16) / 2**64 < 0.3 else "train"
        best_first = lambda r: (r[5] or 1_000_000, -r[6], r[4], r[2])
        line = sorted(hits, key=best_first) + sorted((r for r in rs if not yes(r)), key=best_first)
        if split != "test" and len(hits) > 1:
            continue
        line = line[: max(3, len(hits)) if split == "test" else 3]
        line.sort(key=lambda r: digest(r[0], r[1], *(["holdout"] if split == "test" else []), r[2]))
        for t in range(2 if split == "train" else 1):
            now = line[t % len(line) :] + line[: t % len(line)]
            want[f"g{g}", split, t] = ([r[2] for r in now], [r[2] for r in now if yes(r)])
    out = str(tmp_path / "set")
    training.write_training_set(p, labels, locked, F.concat_ws(" ", F.lit("best of"), F.array_join("candidates", " ")), out, 0.3, 3, 2)
    got = {(r["grp"], r["split"], r["permutation"]): (r["candidates"], r["best"]) for part in ("manifest", "holdout") for r in spark.read.json(f"{out}/{part}").collect()}
    assert got == want and {s for _, s, _ in want} == {"train", "validation", "test"}
    records = [r["value"] for r in spark.read.text(f"{out}/train").collect()]
    assert len(records) == sum(s == "train" for _, s, _ in want) and all("best of p" in r for r in records)
    total = spark.read.json(f"{out}/summary").agg(F.sum("test"), F.sum("train")).first()
    assert total[0] == 3 and 2 * total[1] == len(records)
    with pytest.raises(ValueError):
        training.write_training_set(p, labels, spark.createDataFrame([("d0", "nowhere")], "dataset string, grp string"), F.lit(""), str(tmp_path / "none"))


def test_reports_at_fault(spark):
    from sievework.sources import evaluations as ev

    good = '{"group_evaluation": {"top1_exact_group_hit_rate": 0.5, "group_hit_at_2": 1}, "strict_ai_best": {"f1": 0.25}, "grouping_summary": {"top1_reduction_rate": 0}, "eye_evidence_evaluation": {"manual_with_decisive_closed": 2}, "engine": {"coverage_guard": {"required_cells": 8, "unresolved_cells": 2}}}'
    flat = '{"summary": {"top1": 0.75, "top2": 0.9, "strict_f1": 0.5, "dedup": 0.1, "closed": 1}}'
    texts = [("a", good), ("b", flat), ("c", good.replace("0.5", "1.5").replace('"f1": 0.25', '"f1": "x"')), ("d", "[1]"), ("e", "{nothing"), ("f", None), ("g", good.replace('"unresolved_cells": 2', '"unresolved_cells": 9').replace("closed\": 2", "closed\": -1"))]
    d = spark.createDataFrame(texts, "name string, text string")
    got = {r["name"]: r for r in ev.report_metrics(d, "name", "text").collect()}
    assert {k: r["faults"] for k, r in got.items()} == {"a": [], "b": [], "c": ["top1", "strict_f1"], "d": ["not_an_object"], "e": ["not_an_object"], "f": ["not_an_object"], "g": ["coverage", "closed"]}
    assert tuple(got["a"])[1:7] == (0.5, 1.0, 0.25, 0.0, 0.75, 2) and (got["b"]["coverage"], got["b"]["closed"]) == (1.0, 1) and got["c"]["top1"] is None and got["c"]["top2"] == 1.0
    m = ev.report_metrics(d, "name", "text")
    base, new = m.filter("name = 'a'").withColumn("name", F.lit("x")), m.filter("name in ('b', 'c')").withColumn("name", F.lit("x"))
    assert [tuple(r) for r in ev.compared(base, new, "name").collect()] == [("x", 0.25, -0.1, 0.25, 0.1, 0.25, -1.0)]
    spec = spark.createDataFrame([("a", 1), ("a", 1), ("", 2)], "name string, version int")
    assert ev.named_once(spec) == ["version", "missing_name", "repeated_name"] and ev.named_once(spec.limit(1)) == []


def test_jobs(spark):
    """Progress, refusal of a second job, cancelling between steps and inside a Spark stage, failure, and the fence."""
    import threading
    import time

    from sievework.streaming import jobs

    j = jobs.Jobs(spark)
    gate, seen = threading.Event(), []

    def counted(_):
        seen.append(spark.range(10).count())

    def held(_):
        gate.wait(20)

    first = j.start("first", [counted, held, counted])
    while j.progress().done < 1:
        time.sleep(0.05)
    with pytest.raises(jobs.Busy):
        j.start("second", [counted])
    assert j.cancel(first) and j.progress().state == "cancelling" and not j.cancel("other")
    gate.set()
    ended = j.wait(20)
    assert (ended.state, ended.done, seen) == ("cancelled", 1, [10])

    def endless(_):
        def slow(batches):
            for b in batches:
                time.sleep(60)
                yield b

        spark.range(4).mapInPandas(slow, "id long").count()

    began = time.time()
    third = j.start("third", [endless, counted])
    time.sleep(3)
    assert j.cancel(third)
    assert j.wait(40).state == "cancelled" and time.time() - began < 40 and seen == [10]

    def broken(_):
        raise ValueError("no such thing")

    j.start("fourth", [counted, broken, counted])
    ended = j.wait(20)
    assert (ended.state, ended.done, ended.error, seen) == ("failed", 1, "no such thing", [10, 10])
    j.start("fifth", [counted])
    assert j.wait(20) == jobs.Progress(j.progress().job, "fifth", "complete", 1, 1) and not j._move(first, "failed")
