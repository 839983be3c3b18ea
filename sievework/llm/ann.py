"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph a shard.

Vectors are scaled to one norm by an extra component (which leaves inner products with queries alone), so a graph over
them serves inner products. Equal vectors are indexed once: each keeps its smallest ids, as many as a query can use.
A vector's shard is that of its nearest centroid (spherical k-means on a bounded sample); centroids with many vectors
are dealt to several shards by hash, so a shard is bounded. Each graph is built once, in a task of its own, and written to the
shared folder as flat arrays of neighbours, one row a shard. A query searches the shards of its ``probes`` nearest
centroids; where probes isn't given, it is the least number that finds ``recall`` of the neighbours of sample queries
in the sample, up to all of them. A search task has one graph and a block of queries. The best of each shard meet in a
grouped merge, and the scores are computed anew in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_sample

SHARD_ROWS = 16_384
MIN_SHARDS = 8
WIDTH_QUERIES = 64
SHARD_RECALL = 0.97


class Graph:
    """HNSW over the rows of x (all of one norm); links of level l are a flat (rows of l, width) array, -1 where empty."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 64, seed: int = 4) -> None:
        self.x, self.m, self.ef = np.ascontiguousarray(x, np.float32), m, ef
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # upper levels first: a level's rows are a prefix
        self.order, level = order, level[order]
        self.x = self.x[order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((s, m * (2 if k == 0 else 1)), -1, np.int32) for k, s in enumerate(self.sizes)]
        for k in range(len(self.sizes) - 1, -1, -1):
            self._build(k)

    def to_bytes(self, **more: np.ndarray) -> bytes:
        """The flat arrays of the graph, and others that go with it."""
        out = io.BytesIO()
        np.savez(out, x=self.x, order=self.order, sizes=np.array(self.sizes), ef=self.ef, **{f"links{k}": v for k, v in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        held = dict(np.load(io.BytesIO(data)))
        made = cls.__new__(cls)
        made.x, made.order, made.ef = held.pop("x"), held.pop("order"), int(held.pop("ef"))
        made.sizes = held.pop("sizes").tolist()
        made.links = [held.pop(f"links{k}") for k in range(len(made.sizes))]
        made.m = made.links[0].shape[1] // 2 if made.links else 0
        return made, held

    def _build(self, k: int) -> None:
        """Insert the rows of level k in growing batches; a batch searches the graph so far and itself."""
        size, at, links = self.sizes[k], 0, self.links[k]
        width = links.shape[1]
        while at < size:
            end = min(size, max(at + 32, min(2 * at, at + 512)))
            new = np.arange(at, end)
            near, score = self.x[new] @ self.x[at:end].T, None
            np.fill_diagonal(near, -np.inf)
            own = np.argsort(-near, 1)[:, : self.m]
            cand, score = own + at, np.take_along_axis(near, own, 1)
            if at:
                found, s = self._beam(self.x[new], k, at, self.ef, self._entry(self.x[new], k, at))
                cand, score = np.concatenate([found, cand], 1), np.concatenate([s, score], 1)
                o = np.argsort(-score, 1)
                cand, score = np.take_along_axis(cand, o, 1), np.take_along_axis(score, o, 1)
            cand = np.where(np.isfinite(score), cand, -1)
            picked = self._diverse(new, cand, score, self.m)
            links[new, : self.m] = picked
            rows, cols = np.nonzero(picked >= 0)
            self._back(k, picked[rows, cols], new[rows], width)
            at = end

    def _diverse(self, rows: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """For each row the nearest candidates that are nearer to it than to one taken before, then the rest."""
        cand, score = cand[:, : 3 * most], score[:, : 3 * most]
        v = self.x[np.maximum(cand, 0)]
        mutual = v @ v.transpose(0, 2, 1)
        taken = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            hidden = (taken & (mutual[:, j, :] > score[:, j, None])).any(1)
            taken[:, j] = (cand[:, j] >= 0) & ~hidden & (taken.sum(1) < most)
        key = np.where(cand < 0, 2, np.where(taken, 0, 1))
        o = np.argsort(key, 1, kind="stable")[:, :most]
        out = np.full((len(rows), most), -1, np.int32)
        out[:, : o.shape[1]] = np.take_along_axis(cand, o, 1)
        return out

    def _back(self, k: int, to: np.ndarray, new: np.ndarray, width: int) -> None:
        """Add links to -> new; a full row keeps a diverse choice of what it has and gets."""
        links = self.links[k]
        fresh = (links[to] != new[:, None]).all(1)
        to, new = to[fresh], new[fresh]
        o = np.argsort(to, kind="stable")
        to, new = to[o], new[o]
        rows, first, count = np.unique(to, return_index=True, return_counts=True)
        held = (links[rows] >= 0).sum(1)
        easy = held + count <= width
        for r, f, c, h in zip(rows[easy].tolist(), first[easy].tolist(), count[easy].tolist(), held[easy].tolist(), strict=True):
            links[r, h : h + c] = new[f : f + c]
        hard = np.flatnonzero(~easy)
        if len(hard):
            wide = int(count[hard].max())
            cand = np.full((len(hard), width + wide), -1, np.int64)
            cand[:, :width] = links[rows[hard]]
            for i, h in enumerate(hard):
                cand[i, width : width + count[h]] = new[first[h] : first[h] + count[h]]
            score = np.einsum("rd,rcd->rc", self.x[rows[hard]], self.x[np.maximum(cand, 0)])
            score = np.where(cand >= 0, score, -np.inf)
            o = np.argsort(-score, 1)
            cand, score = np.take_along_axis(cand, o, 1), np.take_along_axis(score, o, 1)
            links[rows[hard]] = self._diverse(rows[hard], cand, score, width)

    def _entry(self, q: np.ndarray, k: int, at: int) -> np.ndarray:
        """The row where the search of level k begins: the best found on the levels above."""
        entry = np.zeros(len(q), np.int64)
        for level in range(len(self.sizes) - 1, k, -1):
            found, _ = self._beam(q, level, self.sizes[level], 4, entry)
            entry = found[:, 0]
        return np.where(entry < at, entry, 0) if at else entry

    def _beam(self, q: np.ndarray, k: int, size: int, ef: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of level k by all rows of q at once: (rows, scores), best first, -inf where there are fewer."""
        n, links = len(q), self.links[k]
        me = np.arange(n)
        seen = np.zeros((n, size), bool)
        ids = np.zeros((n, ef), np.int64)
        score = np.full((n, ef), -np.inf, np.float32)
        open_ = np.zeros((n, ef), bool)
        ids[:, 0], open_[:, 0] = entry, True
        score[:, 0] = np.einsum("rd,rd->r", q, self.x[entry])
        seen[me, entry] = True
        live = me
        while len(live):
            best = np.where(open_[live], score[live], -np.inf)
            pick = best.argmax(1)
            going = np.isfinite(best[np.arange(len(live)), pick])
            live, pick = live[going], pick[going]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[ids[live, pick]].astype(np.int64)
            ok = (near >= 0) & (near < size)
            near = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], near]
            r, c = np.nonzero(ok)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("rd,rd->r", q[live[r]], self.x[near[r, c]])
            all_s = np.concatenate([score[live], s], 1)
            all_i = np.concatenate([ids[live], near], 1)
            all_o = np.concatenate([open_[live], ok], 1)
            top = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
            score[live], ids[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            open_[live] = np.take_along_axis(all_o, top, 1)
        o = np.argsort(-score, 1)
        return np.take_along_axis(ids, o, 1), np.take_along_axis(score, o, 1)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of x or -1, score) of the k nearest found for each query; with ef 0 all rows are scored."""
        if not self.sizes or not self.sizes[0]:
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        q = np.ascontiguousarray(q, np.float32)
        if ef:
            found, score = self._beam(q, 0, self.sizes[0], max(ef, k), self._entry(q, 0, self.sizes[0]))
        else:
            every = q @ self.x.T
            found = np.argsort(-every, 1, kind="stable")[:, :k]
            score = np.take_along_axis(every, found, 1)
        return np.where(np.isfinite(score[:, :k]), self.order[found[:, :k]], -1), score[:, :k]

    def width_for(self, q: np.ndarray, k: int, start: int, recall: float) -> int:
        """The least of start, 2 start, ... with which a search finds recall of the k nearest of q; 0 where the graph never does.

        Neighbours as near as the k-th count as found, whichever of them they are.
        """
        n = self.sizes[0] if self.sizes else 0
        k = min(k, n)
        if not n or not len(q):
            return start
        every = np.ascontiguousarray(q, np.float32) @ self.x.T
        last = np.partition(every, n - k, 1)[:, n - k, None]
        ef = start
        while True:
            if (self.search(q, k, ef)[1] >= last - 1e-6).mean() >= recall:
                return ef
            if ef >= n:
                return 0
            ef *= 2


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2) of rows that take part: not null, no null or non-finite component, not zero."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select("vec_id", F.col(vector).alias("v")).filter("vec_id is not null and v is not null").filter(sound)
    return rows.select("vec_id", "v", _norm2(v).alias("norm2")).filter("norm2 > 0")


def _one_norm(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of norm 1: x over the longest norm, and what lacks to it as one component more."""
    norm2 = (x**2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(longest - norm2, 0))[:, None]], 1) / np.sqrt(longest)


def _as_query(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x / np.sqrt((x**2).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows: k unit rows at most."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(4).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def probes_for(x: np.ndarray, longest: float, c: np.ndarray, recall: float, k: int, queries: int = 200) -> int:
    """The least number of centroids whose vectors hold recall of the k nearest in x of sample queries from x."""
    ask = x[np.random.default_rng(5).choice(len(x), min(queries, len(x)), replace=False)]
    ask = ask[(ask**2).sum(1) > 0]
    unit = _one_norm(x, longest)
    q = _as_query(ask)
    home = (unit @ c.T).argmax(1)
    near = np.argpartition(-(q @ unit.T), min(k, len(x) - 1), 1)[:, : k + 1]
    place = np.argsort(np.argsort(-(q @ c.T), 1), 1)  # the how-manieth each centroid is to a query
    needed = np.take_along_axis(place, home[near], 1)
    for p in range(1, len(c) + 1):
        if (needed < p).mean() >= recall:
            return p
    return len(c)


def search(
    table: DataFrame, queries: Column, k: int = 20, m: int = 16, ef_build: int = 64, ef: int | None = None, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, query_block: int = 65_536,
    probes: int | None = None, recall: float = 0.98, sample_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others found for every row where queries holds.

    Rows that don't take part (see usable) neither ask nor answer. Rows with equal vectors are all found, the smaller
    vec_id first; rows that repeat vec_id and vector count once; of a vec_id with several vectors the least vector (by
    array order) counts. Fewer than k others give fewer rows; an empty table gives none; other columns are left out.
    Where ef, the width of a graph's search, isn't given, each shard takes its own: from 192 on it is doubled until sample
    queries (64 of the shard's rows) find SHARD_RECALL of their nearest in the shard; a shard whose graph never does is scanned.
    Rows with a null vec_id don't take part.
    Centroids and probes are fitted on about sample_rows vectors (documented bound), sample_rows / 8 centroids at most.
    """
    held = usable(table).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("x"))
    held = cut(held.select("vec_id", "x.*"), "vectors")
    # a query can use k copies and itself; more of one vector's ids can't be among its answers
    nth = F.expr("row_number() over (partition by v, norm2 order by vec_id)")
    first = held.select("*", nth.alias("_n")).filter(F.col("_n") <= k + 1)
    distinct = cut(first.groupBy("v", "norm2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    n, longest = distinct.agg(F.count(F.lit(1)), F.max("norm2")).first()
    if not n:
        return held.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = hashed_sample(distinct.select("v"), "v", sample_rows).collect()  # sample_rows vectors
    x = np.array([r["v"] for r in sample], np.float64)
    c = centroids(_one_norm(x, longest), min(max(min_shards, -(-n // shard_rows)), max(min_shards, sample_rows // 8)))
    probes = min(len(c), probes or probes_for(x, longest, c, recall, k))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _one_norm(np.stack(batch["v"].to_numpy()).astype(np.float64), longest)
                yield batch.assign(home=(unit @ c.T).argmax(1).astype("int32"))

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = _as_query(np.stack(batch["v"].to_numpy()).astype(np.float64))
                near = np.argsort(-(q @ c.T), 1, kind="stable")[:, :probes].astype("int32")
                yield batch.assign(homes=list(near))

    kind = distinct.schema["v"].dataType.simpleString()
    dealt = distinct.mapInPandas(homes, f"v {kind}, norm2 double, ids array<long>, home int")
    parts = dealt.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("parts"))
    parts = cut(parts, "shards")  # a row a centroid
    shards = dealt.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_least=[i[0] for i in group["ids"]]).sort_values("_least")
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        ids = group["ids"].to_numpy()
        made = Graph(_one_norm(x, longest), m, ef_build)
        width = ef or made.width_for(_as_query(x[:: -(-len(x) // WIDTH_QUERIES)]), k + 1, 192, SHARD_RECALL)
        flat = made.to_bytes(vectors=x, ids=np.concatenate(ids), counts=np.array([len(i) for i in ids]), width=np.array(width))
        return pd.DataFrame({"home": group["home"].iloc[:1], "part": group["part"].iloc[:1], "graph": [flat]})

    graphs = cut(shards.groupBy("home", "part").applyInPandas(build, "home int, part int, graph binary"), "graphs")
    asks = held.filter(queries).select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-asks.count() * probes // (len(c) * query_block)))
    to = asks.mapInPandas(routes, f"query_id long, v {kind}, homes array<int>").select("query_id", "v", F.explode("homes").alias("home"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    to = to.join(parts, "home").select("query_id", "v", "home", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    index = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def shard_search(ask: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(ask) or not len(graph):
            return empty
        made, more = Graph.from_bytes(graph["graph"].iat[0])
        x, ids = more["vectors"], np.split(more["ids"], np.cumsum(more["counts"])[:-1])
        out = []
        for at in range(0, len(ask), 256):
            part = ask.iloc[at : at + 256]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            rows, _ = made.search(_as_query(q), min(k + 1, len(x)), int(more["width"]))
            for query, vector, near in zip(part["query_id"], q, rows, strict=True):
                near = near[near >= 0]
                exact = [float(s) for s in (x[near] * vector).sum(1)]
                best = sorted((-s, int(i)) for s, r in zip(exact, near, strict=True) for i in ids[r] if i != query)[:k]
                out += [(query, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    found = to.groupBy("home", "part", "block").cogroup(index.groupBy("home", "part", "block")).applyInPandas(shard_search, "query_id long, vec_id long, score double")
    return rank(found, k)


def rank(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates, ties to the smaller vec_id."""
    order = "partition by query_id order by score desc, vec_id"
    return found.select("query_id", F.expr(f"row_number() over ({order})").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def every_20th(col: str = "vec_id") -> Column:
    return F.col(col) % 20 == 0
