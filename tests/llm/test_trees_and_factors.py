"""Centroid clustering, Merkle manifest and factorisation machine against plain versions."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import clusters, factors, merkle
from sievework.llm.common import fold, table

SF = "/root/testdata/sf0.001"


# -- clustering


def plain_clusters(rows, k=8, rounds=10, size=64):
    """The contract of op11, with every distance to every centroid."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min((far(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else m for n, m in enumerate(c)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = Counter()
    for _, n, d in out:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((i is None, i or 0, n, d, sums[n], sum(sums.values()), digest[n]) for i, n, d in out)


def got_clusters(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_tree_finds_the_nearest(spark):
    """Also for many centroids, equal ones, ties and whole numbers beyond 64 bits."""
    rng = random.Random(5)
    for k, d, span in ((1, 3, 4), (2, 3, 4), (9, 3, 2), (60, 5, 3), (200, 8, 50), (30, 4, 1 << 100)):
        c = [[rng.randrange(-span, span + 1) for _ in range(d)] for _ in range(k)]
        c += c[: k // 3]
        x = [[rng.randrange(-span, span + 1) for _ in range(d)] for _ in range(150)] + c
        tree = clusters.Tree(clusters._matrix(c))
        number, far = tree.nearest(clusters._matrix(x))
        want = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c)) for v in x]
        assert [(int(a), int(b)) for a, b in zip(far, number, strict=True)] == want


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * 0.1 + i % 3]) for i in range(120)]
    rows += [(3, rows[0][1]), (3, rows[3][1]), (None, rows[5][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64)]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    assert got_clusters(clusters.cluster(d)) == plain_clusters(rows)
    few = rows[:3]
    assert got_clusters(clusters.cluster(d.filter("vec_id < 3 and embedding is not null"), rounds=2)) == plain_clusters(few, rounds=2)
    assert clusters.cluster(d.limit(0)).count() == 0
    assert clusters.cluster(d.filter("vec_id is null")).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    assert {(r["cluster"], r["distance"]) for r in clusters.cluster(same).collect()} == {(0, 0)}


def test_clusters_beyond_64_bits(spark):
    """Components far beyond what 64-bit squares hold: clusters stay exact, distances that don't fit are null."""
    rows = [(i, [float(np.float32(s * 3e30))] + [0.0] * 63) for i, s in enumerate((1, 1, -1, -1, 2, 2, 1, 1, -1))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = clusters.cluster(d, k=3, rounds=3).collect()
    want = plain_clusters(rows, k=3, rounds=3)
    assert [(r["vec_id"], r["cluster"], r["centroid_sha256"]) for r in sorted(got, key=lambda r: r["vec_id"])] == [(i, n, h) for _, i, n, _, _, _, h in want]
    assert all(r["distance"] in (d, None) and (d < 1 << 63) == (r["distance"] is not None) for r, (_, _, _, d, *_) in zip(sorted(got, key=lambda r: r["vec_id"]), want, strict=True))


# -- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """The contract of op12 for (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H(*map(field, (*r[:4], text)))
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})

    def tree(nodes):
        """(root, [[(left, right)] of each node])."""
        ways, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            up, below = [], []
            for a in range(0, len(nodes), 8):
                run = nodes[a : a + 8]
                for k in range(len(run)):
                    for leaf_at in at[a + k]:
                        ways[leaf_at].append((run[:k], run[k + 1 :]))
                up.append(H(*run))
                below.append([x for k in range(len(run)) for x in at[a + k]])
            nodes, at = up, below
        return nodes[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: tree([leaf(r, r[4]) for r in groups[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            way = trees[g][1][k] + above[n]
            hurt = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, r[4].translate(lower) if hurt else r[4])
            for left, right in way:
                h = H(*left, h, *right)
            out.append((-1 if r[0] is None else r[0], leaf(r, r[4]), trees[g][0], root, H(*[x for left, right in way for x in (*left, *right)]), h, h == root))
    return sorted(out)


def test_manifest(spark):
    """Many shapes of trees: languages of 1, 8, 9, 64, 65 and 600 rows, null ids, texts, languages, repeated rows."""
    rng = random.Random(3)
    schema = "doc_id long, source string, lang string, n_chars long, text string, i int, g string, level int, h string"
    text = lambda k: rng.choice([None, "", f"Text Ü {k}", f"lower only {k}", f"CAPITALS {k} Ä" * 3])
    shapes = [{"a": 1}, {"a": 8, None: 1}, {"a": 9, "": 2, None: 65}, {"a": 64, "ä": 5, "z": 600}, {f"l{k}": 1 + k % 11 for k in range(70)}]
    for shape in shapes:
        rows = [(rng.choice([k, k, k, None, 5]), rng.choice([None, "s", "src"]), g, rng.choice([None, 7]), text(k)) for g, n in shape.items() for k in range(n)]
        rows += rows[: len(rows) // 5]
        d = spark.createDataFrame([(*r, 1, "g", 2, "h") for r in rows], schema).repartition(7)
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in merkle.manifest(d).collect())
        assert got == plain_manifest(rows)
    assert merkle.manifest(d.limit(0)).count() == 0


def test_manifest_of_documents(spark):
    d = table(spark, SF, "documents")
    got = sorted(tuple(r) for r in merkle.manifest(d).collect())
    assert got == plain_manifest([tuple(r) for r in d.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    verified = {r[0]: r[-1] for r in got}
    assert all(v for i, v in verified.items() if zlib.crc32(str(i).encode()) % 3) and not all(verified.values())


# -- factorisation machine


def plain_inputs(text, n_chars):
    """Words, shapes and statistics of a text, one by one."""
    odd, mask = [int(x) for x in factors._ODD], (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 33)) * odd[1]) & mask
        return h ^ (h >> 29)

    def run(values):
        return mixed(sum((v + 1) * pow(odd[0], k, 1 << 64) for k, v in enumerate(values)) & mask)

    kind = lambda ch: int(factors._TABLE[min(ord(ch), 0x3000)])
    low = lambda ch: ord(ch.lower()) if ord(ch) < 0x3000 and len(ch.lower()) == 1 else ord(ch)
    blank = " \t\n\x0b\x0c\r"
    table = str.maketrans(dict.fromkeys(blank[1:5] + "\r", " "))
    cut = lambda t: [w for w in t.translate(table).split(" ") if w]
    words = cut(text)
    total = {}
    keys = [run([low(c) for c in w]) for w in words]
    shapes = [run([kind(c) for k, c in enumerate(w) if k == 0 or kind(c) != kind(w[k - 1])][: factors.SHAPE_RUNS]) for w in words]
    for slots in ([k % factors.WORDS for k in keys], [factors.WORDS + s % factors.SHAPES for s in shapes]):
        count = Counter(slots)
        size = math.sqrt(sum((1 + math.log(n)) ** 2 for n in count.values()))
        total |= {s: factors.WORD_SHARE * (1 + math.log(n)) / size for s, n in count.items()}
    n, lines = max(len(words), 1), [w for x in text.split("\n") if (w := tuple(t.lower() for t in cut(x)))]
    kinds = Counter(map(kind, text))
    pairs = Counter(zip(keys, keys[1:], strict=False))
    facts = {c: 1000 * kinds[factors.CLASSES.index(c)] / max(len(text), 1) for c in factors.SHARES}
    facts |= {"words": len(words), "word_length": 10 * sum(map(len, words)) / n, "distinct_words": 1000 * len(set(keys)) / n, "top_word": 1000 * max(Counter(keys).values(), default=0) / n}
    facts |= {"repeated_pairs": 1000 * sum(k for k in pairs.values() if k > 1) / n, "lines": len(lines), "line_length": 10 * len(words) / max(len(lines), 1), "repeated_lines": 1000 * (len(lines) - len(set(lines))) / max(len(lines), 1), "n_chars": n_chars}
    for j, name in enumerate(factors.STATISTICS):
        x = facts[name]
        total[factors.WORDS + factors.SHAPES + j * (factors.STEPS + 1) + (factors.STEPS if x is None else min(factors.STEPS - 1, int(math.log2(1 + x))))] = 1.0
    return total


def test_inputs_and_scores_by_pairs():
    """Inputs of many texts at once against one by one; the score against the sum over all pairs."""
    rng = random.Random(8)
    texts = ["", "\n", "one", "One ONE one\n\nOne ONE one", "a\x0bb\x0cc\rd\t e", "Ünïcode İstanbul 漢字 漢字 1234 $$$ !!", "same line here\nsame line here\nother", "x" * 5000]
    texts += [" ".join(rng.choice(["alpha", "Beta", "x%%", "12.5", "\n", "|"]) for _ in range(rng.randrange(80))) for _ in range(40)]
    sizes = [rng.choice([None, len(t), 0]) for t in texts]
    document, place, value = factors.inputs(texts, np.array([np.nan if s is None else s for s in sizes], float))
    made = np.random.default_rng(1)
    model = factors.Model(0.3, made.normal(size=factors.INPUTS), made.normal(size=(factors.INPUTS, 3)))
    scores = model.scores(document, place, value)
    for k, (t, s) in enumerate(zip(texts, sizes, strict=True)):
        want = plain_inputs(t, s)
        got = dict(zip(place[document == k].tolist(), value[document == k].tolist(), strict=True))
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want), t
        x = model.bias + sum(model.weights[p] * v for p, v in want.items())
        x += sum(float(model.factors[p] @ model.factors[q]) * v * w for p, v in want.items() for q, w in want.items() if p < q)
        assert math.isclose(scores[k], 1 / (1 + math.exp(-max(-50, min(50, x)))), rel_tol=1e-6, abs_tol=1e-12)
    alone = factors.inputs(texts[5:6], np.array([np.nan]))
    assert dict(zip(alone[1].tolist(), alone[2].tolist(), strict=True)).keys() == plain_inputs(texts[5], None).keys()


def test_quality_of_held_out_texts(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = factors.fit(docs, labels.filter(fold("doc_id", 4) != 2))
    seen = factors.classify(docs, model, fold("doc_id", 4) == 2).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in seen) >= 0.93 * len(seen)
    assert sum(r["predicted"] for r in seen if r["quality"]) >= 0.97 * sum(r["quality"] for r in seen)


def test_quality_of_odd_rows(spark):
    odd = [(None, None, None), (1, "", 0), (1, "", 0), (2, "plain words", None), (3, "w" * 3_000_000 + " " + "long text " * 200_000, 5), (4, "퟿ \U0010ffff\x00", 3)]
    d = spark.createDataFrame([(*r, 0.5, "x") for r in odd], "doc_id long, text string, n_chars long, score double, h string")
    none = factors.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    got = factors.classify(d, none, F.lit(True)).collect()
    assert len(got) == 6 and all(abs(r["score"] - 0.5) < 1e-9 and r["predicted"] == 0 for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = factors.fit(d, labels, iterations=5)
    got = factors.classify(d, model, F.lit(False)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert factors.classify(d.limit(0), model, F.lit(True)).count() == 0
    only = factors.fit(d, labels.filter("quality = 1 and doc_id = 1"))
    assert all(r["score"] > 0.5 for r in factors.classify(d, only, F.lit(True)).collect())
    assert sys.getsizeof(model.weights) < 1 << 20
