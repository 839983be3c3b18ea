"""decide() against the plain chain on random small tables: people, faces, bodies, poses, missing times, copies, folders, locks."""

import math
import random

import pytest

from sievework.config import Settings
from sievework.plans.decide import decide

from .plain_decide import Plain

PHOTO = "id long, budget long, t double, seq int, name string, width int, height int, score double, issues array<string>, people array<string>, phash long, dhash long, layout array<double>, color array<double>, edge array<double>, semantic array<double>, depth array<double>, locked_stars int, path string, metrics map<string,double>"
FACE = "photo long, face_index int, person string, area double, confidence double, roll double, eyes string, open_probability double, quality double, sharpness double, eye_sharpness double, fine_sharpness double, expression string, expression_confidence double, yaw double, pitch double"
BODY = "photo long, body_index int, embedding array<double>"
POSE = "photo long, pose_index int, descriptor array<double>, visibility double, presence double, foreground double, x double, y double"


def names(schema):
    depth, out, word = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def tables(seed, budgets=6, photos=16):
    rng = random.Random(seed)
    near = lambda v, d: [x + rng.gauss(0, d) for x in v]
    out, faces, bodies, poses = [], [], [], []
    for b in range(budgets):
        scenes = [([rng.gauss(0, 1) for _ in range(24)], rng.getrandbits(63), unit([rng.gauss(0, 1) for _ in range(6)])) for _ in range(3)]
        t, seq, folders, clock = 1000.0 * b, 100, rng.random() < 0.4, b % 3 == 0  # numbers may be missing where all have a time
        for k in range(photos):
            i = b * 1000 + k
            t += rng.choice([0.0, 1.0, 2.5, 6.0, 14.0, 40.0, 700.0])
            seq += rng.choice([1, 1, 2, 5, 12])
            x, h, d = rng.choice(scenes)
            off = rng.choice([0.0, 0.0, 0.05, 0.4])
            v = near(x, off) if off else list(x)
            p, q = (h, h ^ 5) if not off else (h ^ (1 << rng.randrange(60)), h ^ (5 << rng.randrange(40)))
            m = None if rng.random() < 0.2 else {f"{n}_score": rng.choice([40.0, 60.0, 75.0, 90.0]) for n in ("face_quality", "eye", "subject_sharpness", "exposure", "technical", "composition", "contrast", "min_face") if rng.random() < 0.8}
            if m is not None and rng.random() < 0.2:
                m["bad_face_count"] = 1.0
            issues = [z for z in ("closed_eyes", "soft_subject", "occluded", "noisy") if rng.random() < 0.08]
            path = f"{rng.choice('ab')}/{k}.jpg" if folders and rng.random() < 0.95 else f"{k}.jpg"
            timed = clock or rng.random() < 0.75
            out.append((i, b, t if timed else None, seq if not clock or rng.random() < 0.7 else -1, f"IMG_{rng.randrange(10**6):06d}", 0 if rng.random() < 0.06 else 600, 400, float(rng.randrange(40, 99)), issues, [], p, q, v[:10], v[10:17], v[17:], v if rng.random() < 0.8 else None, v[:4] if rng.random() < 0.3 else None, rng.choice([0, 1, 2, 3]) if rng.random() < 0.1 else None, path, m))
            for f in range(rng.choice([0, 1, 1, 2])):
                # faces of one scene mostly repeat, so that copies of one kind come up
                who = rng.choice(["a", "a", "b", "c", None])
                eyes = rng.choice(["Open", "Open", "Open", "Closed", "Partial"])
                faces.append((i, f, who, rng.choice([0.0005, 0.0011, 0.003, 0.009]), rng.choice([0.6, 0.8, 0.95]), rng.choice([0.0, 50.0]) if rng.random() < 0.2 else 0.0, eyes, rng.choice([None, 0.3, 0.9]), rng.choice([None, 40.0, 70.0]), rng.choice([20.0, 80.0]), 30.0, 35.0, rng.choice(["unknown", "smile", "neutral"]), rng.choice([0.5, 0.9]), rng.choice([0.0, 0.0, 20.0]), 0.0))
            for f in range(rng.choice([0, 1, 2])):
                bodies.append((i, f, unit(near(d, 0.2)) if rng.random() < 0.9 else None))
            for f in range(rng.choice([0, 0, 1, 2])):
                poses.append((i, f, unit(near(d, rng.choice([0.02, 0.5]))) if rng.random() < 0.9 else None, rng.choice([0.1, 0.5, 0.9]), rng.choice([0.5, 0.8]), rng.choice([None, 0.4, 0.6, 0.7]), rng.random(), rng.random()))
    return out, faces, bodies, poses


@pytest.mark.parametrize("seed,setting", [(1, "balanced"), (2, "aggressive"), (3, "cautious")])
def test_same_as_plain(spark, seed, setting):
    data = tables(seed)
    d = [spark.createDataFrame(x, s) for x, s in zip(data, (PHOTO, FACE, BODY, POSE), strict=True)]
    s = Settings(preset=setting)
    got = {r["id"]: r for r in decide(d[0], s, *d[1:]).photos.collect()}
    rows = [[dict(zip(names(x), r, strict=True)) for r in part] for part, x in zip(data, (PHOTO, FACE, BODY, POSE), strict=True)]
    sizes = set()
    for b in {p["budget"] for p in rows[0]}:
        mine = [p for p in rows[0] if p["budget"] == b]
        ids = {p["id"] for p in mine}
        want = Plain(mine, *[[r for r in part if r["photo"] in ids] for part in rows[1:]], s).rate()
        for name in ("grp", "cluster", "beat", "stage"):  # the same partition of the photos
            pairs_ = {(got[i][name], want[i][name]) for i in ids}
            assert len(pairs_) == len({x for x, _ in pairs_}) == len({y for _, y in pairs_}), (b, name)
        firsts = sorted({(want[i]["grp"], got[i]["grp"]) for i in ids})
        assert [g for _, g in firsts] == sorted(g for _, g in firsts)
        for name in ("rank", "stars", "reason"):
            assert {i: got[i][name] for i in ids} == {i: want[i][name] for i in ids}, (b, name)
        assert all(abs(got[i]["base"] - want[i]["base"]) < 2e-6 for i in ids) and all(len(got[i]["coverage_keys"]) == len(want[i]["keys"]) for i in ids)
        sizes |= {len([i for i in ids if want[i]["grp"] == g]) for g in {want[i]["grp"] for i in ids}}
    assert max(sizes) >= 4 and {r["stars"] for r in got.values()} >= {0, 2, 3}
