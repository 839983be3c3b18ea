"""Evidence made in cells of time: the same as of listed pairs, and pairs are neither joined nor shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.config import Settings
from sievework.operators import near
from sievework.plans.decide import decide, evidence_of, near_pairs

from .plain_decide import Plain
from .test_decide import FACE, PHOTO, names, tables

FIELDS = ["total", "scene", "semantic", "time", "people", "hashes", "phash", "dhash", "composition", "depth", "seconds", "sequence", "strong", "compatible"]


def _odd_photos(seed):
    rng, out = random.Random(seed), []
    for row in tables(seed, 4, 60)[0]:
        r = dict(zip(names(PHOTO), row, strict=True))
        r["people"] = rng.choice([[], ["a"], ["a", "b"], ["b", "b"], [None]])
        r["t"] = rng.choice([r["t"], r["t"], 50.0, None, float("nan")])
        for c in ("layout", "color", "edge", "semantic", "depth"):
            x = r[c]
            r[c] = rng.choice([x, x, x, x, None, [], x and [0.0] * len(x), x and [*x[:-1], None], x and [*x[:-1], math.nan], x and x[:-1]])
        out.append(tuple(r.values()))
    return out


def test_same_evidence_as_of_listed_pairs(spark, monkeypatch):
    """Vectors that are missing, empty, zero, of other sizes, with nulls and NaN; times equal, missing and NaN; few pairs at a time."""
    d = spark.createDataFrame(_odd_photos(5), PHOTO)
    e = evidence_of(d, near_pairs(d, 45.0)).select("left", "right", *[f"e.{f}" for f in FIELDS])
    want = {(r[0], r[1]): tuple(r)[2:] for r in e.collect()}
    for chunk in (near.CHUNK, 7):
        monkeypatch.setattr(near, "CHUNK", chunk)
        found = near.evidence_within(d, 45.0, FIELDS)
        got = {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}
        assert found.count() == len(got) and got.keys() == want.keys() and len(got) > 300
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=1e-12, nan_ok=True), k
    assert "Join" not in near.evidence_within(d, 45.0, FIELDS)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed,setting", [(11, "balanced"), (12, "aggressive"), (13, "cautious")])
def test_chain_in_cells_same_as_plain(spark, seed, setting):
    """The chain without bodies and poses keeps only the pairs that a rule may accept, and decides as the plain one does."""
    data = tables(seed, 8, 30)[:2]
    d = [spark.createDataFrame(x, s) for x, s in zip(data, (PHOTO, FACE), strict=True)]
    s = Settings(preset=setting)
    made = decide(d[0], s, d[1])
    got = {r["id"]: r for r in made.photos.collect()}
    photos, faces = ([dict(zip(names(x), r, strict=True)) for r in part] for part, x in zip(data, (PHOTO, FACE), strict=True))
    for b in {p["budget"] for p in photos}:
        mine = [p for p in photos if p["budget"] == b]
        ids = {p["id"] for p in mine}
        want = Plain(mine, [f for f in faces if f["photo"] in ids], [], [], s).rate()
        for name in ("grp", "cluster", "beat", "stage"):
            both = {(got[i][name], want[i][name]) for i in ids}
            assert len(both) == len({x for x, _ in both}) == len({y for _, y in both}), (b, name)
        for name in ("rank", "stars", "reason"):
            assert {i: got[i][name] for i in ids} == {i: want[i][name] for i in ids}, (b, name)


def test_pairs_that_no_rule_accepts_are_left_out(spark):
    """300 photos of one moment and different people: all 44,850 pairs were kept; of those the groups need few."""
    rng = random.Random(1)
    v = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(k, 1, 5.0, k, "x", 600, 400, 70.0, [], [str(k)], rng.getrandbits(63), rng.getrandbits(63), v(32), v(16), v(16), v(64), None, None, None, None) for k in range(300)]
    d = spark.createDataFrame(rows, PHOTO).withColumn("sure", F.col("people"))
    from sievework.config import preset

    kept = near.packed_rules(d, 45.0, preset("balanced"), [F.col("t"), F.col("id")]).select(F.sum(F.size("k"))).first()[0]
    assert (kept or 0) < 1000
    assert decide(d.drop("sure")).photos.select("grp").distinct().count() == 300


@pytest.mark.parametrize("name", ["dominant_people", "coverage_cells", "coverage_greedy"])
def test_tasks_of_bounded_size(spark, monkeypatch, name):
    """Their tasks grew with the table, as Spark's fixed number of partitions was all there was; now rows a task are bounded."""
    from sievework.operators import spread
    from sievework.plans import catalog

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(spread, "ROWS", 100)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert n > 40 and plan.count(f", {n}), REPARTITION_BY_NUM") >= 3
