"""Pair operators, neighbours, components and the pipeline against plain versions."""

import random
import re

import numpy as np

from pyspark.sql import functions as F

from sievework.llm import ann, line_dedup, ngram_join, pii, toxicity
from sievework.llm.common import table
from sievework.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def plain_links(texts, threshold=0.8):
    """Links between different texts by the definition."""
    kinds = sorted({t for t in texts if t is not None})
    sets = [grams(t) for t in kinds]
    out = {t: set() for t in kinds}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                out[kinds[i]].add(kinds[j])
                out[kinds[j]].add(kinds[i])
    return out


def classes(texts, links):
    label = {}
    for t in links:
        todo, seen = [t], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        label[t] = min(i for i, u in enumerate(texts) if u in seen)
    return [i if t is None else label[t] for i, t in enumerate(texts)]


def near_copies(seed, families, most):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def check(spark, texts, **params):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tid string")
    got = {r["doc_id"]: r for r in ngram_join.report(d, **params).collect()}
    links = plain_links(texts)
    want = classes(texts, links)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["class_id"] == want[i] and got[i]["n_links"] == (0 if t is None else len(links[t])), i
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(d, **params).collect())
    assert kept == sorted(set(want))


def test_ngram_join(spark):
    texts = near_copies(1, 12, 9) + [None, "", "", "a b", "a b", "a b c d e", "A b c d e", None]
    check(spark, texts)


def test_ngram_join_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.keep_one(d).collect()), key=repr) == sorted([(1, "a b c d e f g"), (None, "x y"), (3, None)], key=repr)
    assert ngram_join.report(d).count() == 6


def test_ngram_join_in_blocks(spark):
    check(spark, near_copies(2, 3, 40), block=8)


def test_ngram_join_around_pivots(spark):
    """Close copies, copies further off and a second family in one component."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 7, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w + [f"end{k}"]))
    check(spark, texts, block=8)
    check(spark, texts[:30], block=8, block_chars=3000)


def test_gram_sets():
    texts = ["a b c d e f", "", "a b", "b c d e f a b", "a b", "x " * 9]
    rows, found = ngram_join.gram_sets(texts, 5)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(found[rows == i]) & set(found[rows == j])) == len(grams(a) & grams(b))


def test_ngram_join_null_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(words + ["end"])
    d = spark.createDataFrame([(None, a, 1), (7, b, 2), (None, a, 3), (5, "alone here", 4), (5, b, 5)], "doc_id long, text string, root long")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.report(d).collect()), key=repr)
    assert got == sorted([(None, 5, 1), (None, 5, 1), (7, 5, 1), (5, 5, 0), (5, 5, 1)], key=repr)
    assert ngram_join.keep_one(d).columns == d.columns and ngram_join.keep_one(d).filter("doc_id is null").count() == 2


def test_ngram_join_on_table(spark):
    check(spark, [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect()])


def test_ngram_join_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.report(d).count() == 0 and ngram_join.keep_one(d).count() == 0


def test_bands():
    for recall in (0.99, 0.9999):
        b, r = ngram_join.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**r) ** b >= recall and b * r <= 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def neighbours(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {q: sorted(((-float((x * y).sum()), i) for i, y in ok if i != q))[:k] for q, x in ok if q % 20 == 0}


def test_ann(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * rng.uniform(0.2, 3)]) for i in range(1500)]
    rows += [(2000 + i, rows[20][1]) for i in range(40)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16)] + [rows[40]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = neighbours(dict(rows).items())
    got = {}
    for r in ann.search(d, ann.every_20th()).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    vectors = dict(rows)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - np.dot(np.array(vectors[q]), np.array(vectors[i]))) < 1e-9 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit / (20 * len(got)) >= 0.9
    again = sorted(map(tuple, ann.search(d, ann.every_20th(), query_block=7, min_shards=2).collect()))
    assert len(again) == 20 * len(got) and len({r[:2] for r in again}) == len(again)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, ann.every_20th()).count() == 2
    assert ann.search(d.limit(0), ann.every_20th()).count() == 0


def test_a_shard_widens_its_search_until_it_finds_enough():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 48)) * rng.uniform(0.2, 3, (4000, 1))
    unit = ann._one_norm(x, float((x**2).sum(1).max()))
    made, q = ann.Graph(unit, 16, 64), ann._as_query(rng.normal(size=(100, 48)))
    width = made.width_for(ann._as_query(x[::63]), 21, 48, 0.97)
    exact = np.argsort(-(q @ unit.T), 1)[:, :21]
    share = lambda ef: np.mean([len(set(a) & set(b)) / 21 for a, b in zip(exact, made.search(q, 21, ef)[0], strict=True)])
    assert width > 48 and share(width) >= 0.95 > share(48)
    assert share(0) == 1.0
    made.links = [np.full_like(v, -1) for v in made.links]  # a graph that leads nowhere
    assert made.width_for(q[:4], 21, 48, 0.97) == 0


def test_ann_one_shard_of_unequal_norms(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(4000, 48)) * rng.uniform(0.2, 3, (4000, 1)))] + [(None, [1.0] * 48)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"home": F.lit(1), "score": F.lit("x"), "v": F.lit(2)})
    want, got = neighbours(rows[:-1]), {}
    for r in ann.search(d, ann.every_20th(), min_shards=1).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_ann_routes_to_near_shards(spark):
    """Vectors in clusters: few probes are enough, and the recall against all vectors holds."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(24, 12)) * 3
    rows = [(i, [float(np.float32(x)) for x in middle[i % 24] + rng.normal(size=12) * 0.5]) for i in range(2400)] + [(20, [9.0] * 12), (20, [8.0] * 12)]
    d = spark.createDataFrame(rows[1:], "vec_id long, embedding array<float>")
    least = {}
    for i, v in rows[1:]:
        least[i] = min(v, least.get(i, v))
    x = np.array([*least.values()])
    longest = float((x**2).sum(1).max())
    c = ann.centroids(ann._one_norm(x, longest), 24)
    assert ann.probes_for(x, longest, c, 0.98, 20) < 16
    want, got = neighbours(least.items()), {}
    for r in ann.search(d, ann.every_20th(), shard_rows=60, min_shards=24, query_block=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_pipeline(spark):
    """Every stage against a plain version on what the one before kept, texts and packed pieces included."""
    import zlib

    import corpus_pipeline as cp

    from sievework.llm import packing

    from .test_text_ops import plain_disclosure, with_terms

    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    model = toxicity.fit(d, labels)
    clean = [r for r in d.collect() if r["text"] is None or model.a * toxicity.scan(model, r["text"])[0] + model.b < 0]
    held = {r["doc_id"]: r["text"] for r in clean}
    lines = plain_lines(held)
    ids = sorted(lines)
    texts = [lines[i] for i in ids]
    want = classes(texts, plain_links(texts))
    kept = [t for k, t in enumerate(texts) if want[k] == k]
    actions = plain_disclosure(kept)
    masked = {i: with_terms(t or "", actions[t or ""])[1] for k, (i, t) in enumerate(zip(ids, texts, strict=True)) if want[k] == k}
    coder = packing.WordIds(packing.vocabulary_path()).whole
    pieces = set()
    for i, t in masked.items():
        x = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces |= {(i, k, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(x), 2048))}
    got = cp.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048


def plain_lines(texts, least=50):
    """{doc_id: text} without later repeats of windows of least words, by the definition; ids in order."""
    windows, seen, gone = {}, {}, set()
    for i in sorted(texts):
        rows = [(k, line, len(re.findall(r"[^\x20\x09-\x0D]+", line))) for k, line in enumerate((texts[i] or "").split("\n"))]
        rows = [r for r in rows if r[2]]
        for way in (rows, rows[::-1]):
            for a in range(len(way)):
                n = 0
                for b in range(a, len(way)):
                    n += way[b][2]
                    if n >= least:
                        part = way[a : b + 1]
                        windows.setdefault((way is rows, tuple(x for _, x, _ in part)), []).append((i, min(k for k, *_ in part), max(k for k, *_ in part), [k for k, *_ in part]))
                        break
    for places in windows.values():
        first = min(p[:3] for p in places)
        gone |= {(i, k) for i, lo, hi, ks in places if (i, lo, hi) != first for k in ks}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}


def test_stages_on_odd_tables(spark):
    """Null ids and texts, repeated rows, columns that clash with internal names, and an empty table."""
    import corpus_pipeline as cp

    rows = [(None, "plain words of a text", "en", "s", 21, "x"), (None, "plain words of a text", "en", "s", 21, "x"), (3, None, None, None, None, None), (4, "", "en", "s", 0, ""), (4, "", "en", "s", 0, ""), (5, "mail joe@example.com now", "en", "s", 24, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tid string")
    for given, least in ((d, 5), (d.limit(0), 0)):
        for name, stage in cp.STAGES:
            out = stage(spark, given, SF)
            if name != "best_fit_packing":
                assert out.columns == d.columns
                given = spark.createDataFrame(out.collect(), d.schema)
            assert out.count() >= least
