"""Centroid clustering (Lloyd's rounds over integers) that finds each vector's centroid in a vantage-point tree.

The tree over the centroids is built anew and broadcast each round. An inner node has a vantage centroid and a radius:
centroids no further than the radius are inside, the others outside. A vector opens nodes best first, by the least
distance that the triangle inequality leaves for them, and stops when no open node can hold a centroid as near as the
best one found; the bound is inclusive, so a centroid at the same distance is still met and the smaller number wins.
All distances that decide are sums of squared integers. Vectors go through the tree in blocks: each vector of a block
keeps its own open nodes and bounds, those that open the same node are compared with its centroids at once.
A task sends one row of sums for each centroid, in limbs that can't overflow; centroids are k rows on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

SMALL = 1 << 27  # below it, differences, squares and sums of them fit 64 bits (up to 128 components)
LARGE = float(2**138)  # what a float32 can be, scaled
LIMB = 46
LEAF = 2


class Tree:
    """Vantage-point tree over the rows of c (k, d), integers.

    Node arrays: at (number of the vantage centroid, -1: a leaf), radius, inside, outside (node numbers) and members
    (of a leaf). Node 0 is the root.
    """

    def __init__(self, c: np.ndarray) -> None:
        self.c = c
        self.at: list[int] = []
        self.radius: list[float] = []
        self.sides: list[tuple[int, int]] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(c)), -1, 0)]
        while todo:
            rows, above, side = todo.pop()
            me = len(self.at)
            if above >= 0:
                self.sides[above] = (me, self.sides[above][1]) if side == 0 else (self.sides[above][0], me)
            self.at.append(-1)
            self.radius.append(0.0)
            self.sides.append((-1, -1))
            self.members.append(rows)
            if len(rows) <= LEAF:
                continue
            # the vantage point is the row furthest from the first one, so that radii tell the others apart
            vantage = rows[int(np.argmax(roots(squares(c[rows], c[rows[0]]))))]
            rest = rows[rows != vantage]
            far = roots(squares(c[rest], c[vantage]))
            radius = float(np.sort(far)[(len(far) - 1) // 2])
            self.at[me], self.radius[me], self.members[me] = int(vantage), radius, rows[:0]
            for side, part in ((0, rest[far <= radius]), (1, rest[far > radius])):
                if len(part):
                    todo.append((part, me, side))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of x; ties go to the smaller number."""
        n, nodes = len(x), len(self.at)
        exact = x.dtype if x.dtype == object or self.c.dtype != object else object
        best, held = np.full(n, len(self.c)), np.zeros(n, exact)
        reach = np.full(n, np.inf)
        bound = np.full((n, nodes), np.inf)  # of the nodes that are open
        bound[:, 0] = 0.0
        active = np.arange(n)

        def met(rows: np.ndarray, number: int, to: np.ndarray) -> None:
            better = np.isinf(reach[rows]) | (to < held[rows]) | ((to == held[rows]) & (number < best[rows]))
            rows, to = rows[better.astype(bool)], to[better.astype(bool)]
            best[rows], held[rows], reach[rows] = number, to, roots(to)

        while len(active):
            opened = bound[active].argmin(1)
            least = bound[active, opened]
            go = least <= reach[active] * (1 + 1e-9)  # inclusive, with room for the rounding of roots
            go &= np.isfinite(least)
            active, opened = active[go], opened[go]
            bound[active, opened] = np.inf
            for node in np.unique(opened):
                rows = active[opened == node]
                if self.at[node] < 0:
                    for number in self.members[node]:
                        met(rows, int(number), squares(x[rows], self.c[number]))
                    continue
                low = least[go][opened == node]
                to = squares(x[rows], self.c[self.at[node]])
                met(rows, self.at[node], to)
                away, (inside, outside) = roots(to), self.sides[node]
                if inside >= 0:
                    bound[rows, inside] = np.maximum(low, (away - self.radius[node]) * (1 - 1e-9))
                if outside >= 0:
                    bound[rows, outside] = np.maximum(low, (self.radius[node] - away) * (1 - 1e-9))
        return best, held


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y, exact."""
    return ((x - y) ** 2).sum(1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def _integers(col: pd.Series) -> np.ndarray:
    """The rows of a column of whole doubles as integers: 64 bits where squares fit, Python's otherwise."""
    x = np.stack(col.to_numpy()).astype(np.float64)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < SMALL and x.shape[1] <= 128 else np.vectorize(int, otypes=[object])(x)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SMALL for r in rows for v in r) and all(len(r) <= 128 for r in rows)
    return np.array(rows, np.int64 if small else object)


def scaled(table: DataFrame, components: int = 64, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with exactly that many components, none null or not finite.

    v are whole doubles. A component whose product is 2^138 or more in size, which no float32 reaches, counts as not finite.
    """
    whole = F.transform("embedding", lambda x: F.lit(scale) * x.cast("double"))
    sound = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGE))
    # a double of 2^53 or more is whole already, and floor() would cut it to 64 bits
    v = F.transform(whole, lambda x: F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x))
    return table.filter((F.size("embedding") == components) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def seeds(kept: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The k vectors of least sha256 of ``salt:vec_id``, in that order; equal ids by components, null ids never."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id is not null").select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()  # k rows
    return [[int(x) for x in r["v"]] for r in rows]


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: float = 1024.0, salt: int = 3, block: int = 8_192) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, after ``rounds`` rounds.

    Kept are vectors as in scaled(); fewer than k of them with ids give fewer centroids, none give no rows. Null ids are
    assigned but start no centroid; repeated rows each count; other columns are left out. Distances and sums beyond 64
    bits are null. Work of a round is a pass over the vectors; k centroids and their tree are what is broadcast.
    """
    spark = table.sparkSession
    kept = cut(scaled(table, components, scale), "cluster-vectors")
    centroids = seeds(kept, k, salt)
    if not centroids:
        discard(kept)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def blocks(batches: Iterator[pd.DataFrame], tree: Tree) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        size = max(1, min(block, (1 << 22) // len(tree.at)))
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                x = _integers(part["v"])
                yield part, x, *tree.nearest(x)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Tree(_matrix(centroids)))

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: dict[int, list] = {}
            for _, x, number, _ in blocks(batches, shared.value):
                for c in np.unique(number):
                    mine = x[number == c]
                    held = total.setdefault(int(c), [0, np.zeros(x.shape[1], object)])
                    held[0] += len(mine)
                    held[1] = held[1] + mine.sum(0)
            mask = (1 << LIMB) - 1
            rows = [(c, j, n, int(v) & mask, (int(v) >> LIMB) & mask, int(v) >> (2 * LIMB)) for c, (n, s) in total.items() for j, v in enumerate(s)]
            yield pd.DataFrame(rows, columns=["c", "j", "n", "low", "mid", "high"])

        parts = kept.select("v").mapInPandas(sums, "c int, j int, n long, low long, mid long, high long")
        whole = lambda name: F.sum(F.col(name).cast("decimal(28,0)")).alias(name)
        for r in parts.groupBy("c", "j").agg(F.sum("n").alias("n"), whole("low"), whole("mid"), whole("high")).collect():  # k x components
            value = int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << (2 * LIMB))
            centroids[r["c"]][r["j"]] = value // r["n"]
        shared.destroy()

    shared = spark.sparkContext.broadcast(Tree(_matrix(centroids)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, number, to in blocks(batches, shared.value):
            fits = pd.array([int(t) if t < 1 << 63 else None for t in to], "Int64")
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64").array, "cluster": number.astype("int32"), "distance": fits})

    out = cut(kept.mapInPandas(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(kept)
    told = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()  # k rows
    fits = lambda rows: None if any(r["beyond"] for r in rows) or sum(int(r["s"]) for r in rows) >= 1 << 63 else sum(int(r["s"]) for r in rows)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    facts = spark.createDataFrame([(r["cluster"], fits([r]), fits(told), digest(r["cluster"])) for r in told], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, components: int = 64) -> str:
    """The same clusters in DuckDB SQL: every distance to every centroid, a common table expression a round."""
    ctes = [
        f"""v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings where len(embedding) = {components} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {components})""",
        f"c0 as materialized (select row_number() over (order by key) - 1 as c, v as m from (select v, sha256('3:' || vec_id) as key from v where vec_id is not null order by key limit {k}))",
    ]
    near = "(select vec_id, v, arg_min(c, d * {k} + c) as c, min(d) as d from (select row_number() over () as r, vec_id, v from v) v2, lateral (select c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from {t}) x group by r, vec_id, v)"
    for r in range(1, rounds + 1):
        ctes.append(f"a{r} as materialized {near.format(k=k, t=f'c{r - 1}')}")
        ctes.append(
            f"""s{r} as materialized (select c, j, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as j from a{r}) group by c, j)"""
        )
        floor = "(s - ((s % n) + n) % n) // n"
        ctes.append(f"c{r} as materialized (select c, coalesce(f.m, p.m) as m from c{r - 1} p left join (select c, list({floor} order by j) as m from s{r} group by c) f using (c))")
    ctes.append(f"z as materialized {near.format(k=k, t=f'c{rounds}')}")
    return (
        "with "
        + ",\n".join(ctes)
        + """
select vec_id, cast(z.c as integer) as cluster, d as distance, cast(sum(d) over (partition by z.c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from z join c"""
        + f"{rounds} f on f.c = z.c"
    )
