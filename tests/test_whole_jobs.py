"""Queries over whole tables, on small tables whose rows a sampled form would leave out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import vectors
from sievework.operators import pairs
from sievework.plans import catalog

from .conftest import rows


@pytest.fixture
def given(spark, tmp_path):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_eligible_people(spark, given):
    line = lambda photo, person, area: (photo, person, area * 10000, 0.0, 100.0, 0.0, 1)
    sf = given("lineitem", [line(11, 1, 0.001), line(12, 1, 0.001), line(13, 2, 0.009), line(14, 3, 0.001)], "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_extendedprice double, l_tax double, l_linenumber int")
    assert rows(catalog.QUERIES["eligible_people"](spark, sf), "person") == [(1, 2), (2, 1)]


def test_cosine_pairs(spark, given):
    sf = given("embeddings", [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 7, [0.0, 1.0]), (4, 7, [0.1, 1.0]), (5, 7, [-1.0, 0.0]), (6, None, [1.0, 0.0]), (7, 7, None), (8, 7, [0.0, 0.0]), (9, 7, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [r[:2] for r in rows(catalog.QUERIES["cosine_pairs"](spark, sf), "l")] == [(1, 2), (3, 4)]


def test_cosine_pairs_blocks(spark):
    d = spark.createDataFrame([(i % 50, i % 3, [float(i * i % 17 - 8), float(i * 7 % 13 - 6), 1.0]) for i in range(120)], "id long, g int, v array<double>")
    a, b = d.selectExpr("id l", "g", "v x"), d.selectExpr("id r", "g", "v y")
    want = rows(a.join(b, "g").filter("l < r").select("l", "r", F.round(vectors.cosine(F.col("x"), F.col("y")), 9).alias("c")).filter("c >= 0.3"), "l", "r", "c")
    got = rows(pairs.cosine_pairs(d, "g", "id", "v", 0.3, block=7).select("l", "r", F.round("c", 9).alias("c")), "l", "r", "c")
    assert got == want and want


def test_training_records(spark, given):
    sf = given("conversations", [(1, 1, "assistant", "b \"q\""), (1, 0, "user", "a"), (2, 3, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["turns"], r["record"]) for r in catalog.QUERIES["training_records"](spark, sf).collect()}
    record = lambda *m: hashlib.sha256(json.dumps({"messages": [{"role": r, "content": t} for r, t in m]}, separators=(",", ":")).encode()).hexdigest()
    assert got == {1: (2, record(("user", "a"), ("assistant", 'b "q"'))), 2: (1, record(("user", None)))}


def test_set_hash(spark):
    sf = "/root/testdata/sf0.001"
    plan = [json.dumps(r.asDict(), separators=(",", ":"), sort_keys=True) for r in catalog.QUERIES["export_plan"](spark, sf).collect()]
    parts = {}
    for d in (hashlib.sha256(p.encode()).hexdigest() for p in plan):
        parts.setdefault(d[:2], []).append(d)
    whole = "".join(sorted(p + hashlib.sha256("".join(sorted(ds)).encode()).hexdigest() for p, ds in parts.items()))
    assert rows(catalog.QUERIES["set_hash"](spark, sf)) == [(len(plan), hashlib.sha256(whole.encode()).hexdigest())]
