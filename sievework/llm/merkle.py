"""Merkle manifest of a table: leaf digests, a tree a language, a tree over their roots, and a proof for every row.

Rows get their place in their language from sorted range partitions (positions inside, small counts before), so no
language meets in one task. Eight consecutive nodes become one, level by level; a level is an eighth of the one below.
Every node knows its siblings left and right of it. Proofs come from pointer jumping over the inner nodes: each holds
the segment of siblings up to some ancestor, and joining the table with itself appends the ancestor's own segment, so
the distance doubles until all hold the root: as many joins as the logarithm of the height. The leaves, seven eighths of
all nodes, aren't joined among themselves: a run of eight takes the finished segment of its parent in one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

FAN = 8
SALTS = 16  # parts of an ancestor's descendants in a self-join
TOP = "root"  # the group of the tree over all languages; those of languages are empty or begin with +


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of documents with this text: every field by its length in bytes and its value, `-` where null."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def hexadecimal(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(children: Column) -> Column:
    """Digest of the hexadecimal forms of some digests, in order."""
    return F.unhex(F.sha2(F.array_join(F.transform(children, hexadecimal), ""), 256))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps (siblings left and right, level by level) lead to."""
    up = lambda h, s: F.unhex(F.sha2(F.concat(hexadecimal(s["l"]), hexadecimal(h), hexadecimal(s["r"])), 256))
    return F.aggregate(steps, start, up)


def proof_digest(steps: Column) -> Column:
    """sha256 of all siblings' hexadecimal digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(hexadecimal(s["l"]), hexadecimal(s["r"]))), ""), 256)


def _siblings(kids: Column, at: Column) -> Column:
    """What lies left and right of the at-th (from 0) of some digests, as one run of bytes each."""
    join = lambda a: F.unhex(F.array_join(F.transform(a, F.hex), ""))
    return F.struct(join(F.slice(kids, F.lit(1), at)).alias("l"), join(F.slice(kids, at + 2, F.lit(FAN))).alias("r"))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with i, the place of each in its group from 0, and n, the rows of the group; the written table below it).

    Rows are sorted into range partitions; a row's place is that in its partition after what earlier ones hold of its
    group. The counts are a row a partition and group.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    held = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    told = held.withColumn("_part", F.shiftright("_at", 33))
    runs = told.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.expr(f"coalesce(sum(_n) over (partition by {group} order by _part rows between unbounded preceding and 1 preceding), 0)")
    runs = runs.select("_part", group, (before - F.col("_first")).alias("_move"), F.expr(f"sum(_n) over (partition by {group})").alias("n"))
    return told.join(runs, ["_part", group]).select(*rows.columns, (F.col("_at") + F.col("_move")).alias("i"), "n"), held


def _up(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """One level up: (g, i, n, kids), kids the rows (i and kept) of each run of eight nodes, in order."""
    runs = nodes.groupBy("g", F.floor(F.col("i") / FAN).alias("p"), F.ceil(F.col("n") / FAN).alias("m")).agg(F.sort_array(F.collect_list(F.struct("i", *kept))).alias("kids"))
    return runs.select("g", F.col("p").alias("i"), F.col("m").alias("n"), "kids")


def _grown(nodes: DataFrame, level: int, most: int, name: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Levels over nodes (g, i, n, h) of groups of at most ``most``: ([(g, level, i, n, h)], [(g, level, i, p, m, step)] of
    all but the tops, p and m the parent's place and the nodes of its level; written tables)."""
    levels, links, held = [nodes.withColumn("level", F.lit(level))], [], []
    while most > 1:
        up = cut(_up(nodes.filter("n > 1"), ["h"]), name)
        held.append(up)
        kids = up.select("g", F.col("i").alias("p"), F.col("n").alias("m"), F.col("kids.h").alias("hs"), F.posexplode("kids").alias("k", "kid"))
        links.append(kids.select("g", F.lit(level).alias("level"), F.col("kid.i").alias("i"), "p", "m", _siblings(F.col("hs"), F.col("k")).alias("step")))
        nodes, level, most = up.select("g", "i", "n", _digest(F.col("kids.h")).alias("h")), level + 1, -(-most // FAN)
        levels.append(nodes.withColumn("level", F.lit(level)))
    return levels, links, held


def _whole(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _jumped(nodes: DataFrame, apart: int, root_level: int) -> DataFrame:
    """nodes (g, level, i, ag, al, ai, steps, sub), whose ancestors are ``apart`` levels away or the root, twice as far."""
    done = (F.col("ag") == TOP) & (F.col("al") == root_level)
    high = nodes.filter((F.col("level") > apart) | (F.col("g") == TOP)).select(
        F.col("g").alias("ag"), F.col("level").alias("al"), F.col("i").alias("ai"), F.col("ag").alias("bg"), F.col("al").alias("bl"), F.col("ai").alias("bi"), F.col("steps").alias("more"), F.col("sub").alias("above"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = nodes.filter(~done).withColumn("salt", F.pmod(F.xxhash64("g", "level", "i"), F.lit(SALTS)).cast("int"))
    moved = salted.join(high, ["ag", "al", "ai", "salt"]).select("g", "level", "i", F.col("bg").alias("ag"), F.col("bl").alias("al"), F.col("bi").alias("ai"), F.concat("steps", "more").alias("steps"), F.coalesce("sub", "above").alias("sub"))
    return nodes.filter(done).unionByName(moved)


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, steps) of every row of docs; steps are its siblings (l, r), level by level.

    Digests are binary. tampered is the leaf with A-Z of the text in lower case, null where the row isn't tampered with
    (3 divides crc32 of doc_id where it is) or that changes nothing. Rows of one lang stand in the order of doc_id, null
    first, equal ids in the order of their leaves, so that repeated rows (whose leaves are equal) each have a place; a
    null lang is a language of its own, before all others. A text of any length is read whole; an empty table gives no
    rows; other columns are left out.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lower != F.col("text"))
    g = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))  # bytewise order, null first
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("h"), F.when(touched, leaf(lower)).alias("other"))
    leaves, held = placed(rows, "g", ["doc_id", "h"], "merkle-leaves")
    lone = F.col("n") == 1
    runs = _up(leaves.withColumn("lone", lone), ["doc_id", "h", "other", "lone"])
    runs = cut(runs.withColumn("h", F.when(F.col("kids")[0]["lone"], F.col("kids")[0]["h"]).otherwise(_digest(F.col("kids.h")))), "merkle-runs")
    discard(held)
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        discard(runs)
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf binary, tampered binary, subroot binary, root binary, steps array<struct<l:binary,r:binary>>")
    levels, links, below = _grown(runs.select("g", "i", "n", "h"), 1, most, "merkle-level")
    # the last node of a language is its subroot, and a leaf of the tree over all languages
    tops, held = placed(_whole(levels).filter("n = 1").select(F.lit(TOP).alias("g"), F.col("g").alias("lang"), "h"), "g", ["lang"], "merkle-subroots")
    languages = tops.agg(F.max("n")).first()[0]
    above, joints, upper = _grown(tops.select("g", "i", "n", "h"), 0, languages, "merkle-upper")
    root = above[-1].filter("n = 1").first()
    subroots = tops.select(F.col("lang").alias("g"), F.col("i").alias("rank"), F.col("h").alias("subroot"))

    one = F.array("step").alias("steps")
    parent = [F.lit(TOP).alias("ag"), F.lit(0).alias("al"), F.col("rank").alias("ai"), one, F.col("subroot").alias("sub")]
    none = F.lit(None).cast("binary").alias("sub")
    frames = []
    for link in links:
        inside = [F.col("g").alias("ag"), (F.col("level") + 1).alias("al"), F.col("p").alias("ai"), one, none]
        frames += [link.filter("m > 1").select("g", "level", "i", *inside), link.filter("m = 1").join(subroots, "g").select("g", "level", "i", *parent)]
    for link in joints:
        mine = link.join(tops.select("g", "i", "h"), ["g", "i"]) if link is joints[0] else link.withColumn("h", F.lit(None).cast("binary"))
        frames.append(mine.select("g", "level", "i", F.col("g").alias("ag"), (F.col("level") + 1).alias("al"), F.col("p").alias("ai"), one, F.col("h").alias("sub")))
    top = root["level"]
    itself = above[-1].filter("n = 1").select("g", "level", "i", F.col("g").alias("ag"), F.col("level").alias("al"), F.col("i").alias("ai"), F.array().cast("array<struct<l:binary,r:binary>>").alias("steps"), (F.col("h") if top == 0 else none).alias("sub"))
    nodes = cut(_whole([*frames, itself]), "merkle-pointers")
    apart, height = 1, len(links) + top
    while apart < height:
        nodes, before = cut(_jumped(nodes, apart, top), "merkle-pointers"), nodes
        discard(before)
        apart *= 2

    # a run that is a whole language stands in the tree above; the others by their own place
    small = runs.filter("n = 1").join(subroots.select("g", "rank"), "g").select(F.lit(TOP).alias("g"), F.lit(0).alias("level"), F.col("rank").alias("i"), "kids")
    at = runs.filter("n > 1").select("g", F.lit(1).alias("level"), "i", "kids").unionByName(small)
    known = at.join(nodes.select("g", "level", "i", "steps", "sub"), ["g", "level", "i"])
    each = known.select("steps", "sub", F.col("kids.h").alias("hs"), F.posexplode("kids").alias("k", "kid"))
    first = F.when(F.col("kid.lone"), F.slice("steps", 1, 0)).otherwise(F.array(_siblings(F.col("hs"), F.col("k"))))
    return each.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.h").alias("leaf"), F.col("kid.other").alias("tampered"), F.col("sub").alias("subroot"), F.lit(bytes(root["h"])).alias("root"), F.concat(first, "steps").alias("steps"))


def manifest(docs: DataFrame) -> DataFrame:
    """The columns of query op12, hexadecimal, for every row of docs; see proofs."""
    fold = hexadecimal(folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    told = proofs(docs).select("doc_id", hexadecimal(F.col("leaf")).alias("leaf"), hexadecimal(F.col("subroot")).alias("subroot"), hexadecimal(F.col("root")).alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), fold.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same manifest in DuckDB SQL: levels by recursion, proofs by walking up from every leaf."""
    crc = """(select list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::ubigint)), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))))"""
    field = lambda f: f"coalesce(strlen({f}) || ':' || {f}, '-')"
    digest = lambda t: "sha256(" + " || ".join(field(f) for f in ("doc_id::varchar", "source", "lang", "n_chars::varchar", t)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with recursive d as (select doc_id, coalesce('+' || lang, '') as g, {digest("text")} as leaf, {digest(lower)} as low, xor({crc}, 4294967295) % 3 = 0 as t from documents),
leaves as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
tree as (select g, 0 as level, i, n, leaf as h from leaves
  union all select g, level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by g, level, i // {FAN}, (n + {FAN - 1}) // {FAN}),
tops as materialized (select row_number() over (order by encode(g)) - 1 as i, count(*) over () as n, g, h from tree where n = 1),
upper as (select 0 as level, i, n, h from tops
  union all select level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' order by i)) from upper where n > 1 group by level, i // {FAN}, (n + {FAN - 1}) // {FAN}),
every as materialized (select g, level, i, n, h from tree union all select '{TOP}', level, i, n, h from upper),
sides as materialized (select a.g, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from every a join every b on a.g = b.g and a.level = b.level and a.i // {FAN} = b.i // {FAN} where a.n > 1 group by a.g, a.level, a.i),
walk as (select g, i as leaf_at, g as now, 0 as level, i, n, '' as proof, case when t then low else leaf end as fold from leaves
  union all select w.g, w.leaf_at, case when w.n > 1 then w.now else '{TOP}' end, case when w.n > 1 then w.level + 1 else 0 end,
    case when w.n > 1 then w.i // {FAN} else t.i end, case when w.n > 1 then (w.n + {FAN - 1}) // {FAN} else t.n end,
    case when w.n > 1 then w.proof || s.l || s.r else w.proof end, case when w.n > 1 then sha256(s.l || w.fold || s.r) else w.fold end
  from walk w left join sides s on s.g = w.now and s.level = w.level and s.i = w.i left join tops t on t.g = w.now where w.n > 1 or w.now <> '{TOP}')
select v.doc_id, v.leaf, t.h as subroot, u.h as root, sha256(w.proof) as proof_sha256, w.fold as folded_root, w.fold = u.h as verified
from walk w join leaves v on v.g = w.g and v.i = w.leaf_at join tops t on t.g = w.g, (select h from upper where n = 1) u where w.now = '{TOP}' and w.n = 1"""
