"""Line dedup by winnowing over line hashes (DataFrame functions only).

Lines that hold a word have a 128-bit hash. A window is the least run of lines from a line on (or back from a line) that
has ``min_words`` words; the least line hash in it is chosen as its fingerprint, so any repeated run of min_words words
has the same one chosen in both places. Fingerprints chosen in one place only are let go. Around the places of the
others the match is extended both ways to the ends of the window: the contents of runs of 1, 2, 4 ... lines get hashes
from those of their halves, and two overlapping such runs stand for a window of any size. Windows of equal content meet
at their first occurrence in the order of (doc_id, line), never each other, so work is linear in the lines however many
copies there are. Windows begin (or end) at every line, so the later ones cover a repeated run to both its ends; the
lines they cover are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, text_or_empty

_LINE_WORD = r"[^ \t\x0B\f\r]+"
SALTS = 16  # parts of a hot hash in joins that every occurrence of it goes through


def _doc(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a doc_id (null: none) and a whole text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), text).cast("binary")))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, doc, i, h, n): one row for each line with a word; rows that repeat id and text count once."""
    held = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("t"))
    held = held.select("id", _doc(F.col("id"), F.col("t")).alias("doc"), "t")  # below the explode: once a text, not once a line
    rows = held.select("id", "doc", F.posexplode(F.split("t", "\n", -1)).alias("i", "line"))
    rows = rows.filter(F.col("line").rlike(_LINE_WORD[:-1]))  # a first character is enough; words are counted once, after it
    rows = rows.select("id", "doc", "i", F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"), F.regexp_count("line", F.lit(_LINE_WORD)).alias("n"))
    return rows.repartition("doc").dropDuplicates(["doc", "i"])


def _frames(min_words: int) -> tuple[str, str]:
    """The lines of the window that begins, and of the one that ends, at a line."""
    ahead = f"over (partition by doc order by a range between current row and {min_words - 1} following)"
    return ahead, f"over (partition by doc order by b range between {min_words - 1} preceding and current row)"


def _counted(lines: DataFrame) -> DataFrame:
    """lines with a and b, the words before and up to the end of a line, and all, those of the document."""
    upto = lines.select("*", F.expr("sum(n) over (partition by doc order by i)").alias("b"))
    return upto.select("*", (F.col("b") - F.col("n")).alias("a"), F.expr("max(b) over (partition by doc)").alias("all"))


def _salted(many: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """many joined with few (one row a key), a hot key of many dealt to SALTS tasks."""
    salt = F.pmod(F.xxhash64("doc", "i"), F.lit(SALTS)).cast("int").alias("_salt")
    return many.select("*", salt).join(few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), [key, "_salt"], how).drop("_salt")


def _shared_fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(h): the line hashes that windows choose in more than one place."""
    ahead, back = _frames(min_words)
    both = _counted(lines).select("doc", F.when(F.col("all") - F.col("a") >= min_words, F.expr(f"min(struct(h, i)) {ahead}")).alias("f"), F.when(F.col("b") >= min_words, F.expr(f"min(struct(h, i)) {back}")).alias("g"))
    chosen = both.select("doc", F.explode(F.array("f", "g")).alias("m")).filter("m is not null").select("doc", "m.h", "m.i").distinct()
    return chosen.groupBy("h").count().filter("count > 1").select("h")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, doc, i, ahead, first, last, body) of the windows whose fingerprint is shared; lines say which hashes are."""
    ahead, back = _frames(min_words)
    out, levels = _counted(lines), max(1, min_words.bit_length())
    out = out.withColumn("g0", F.col("h"))
    for k in range(1, levels):  # the content of 2^k lines from here, null where there are fewer
        half = 1 << (k - 1)
        out = out.withColumn(f"g{k}", F.unhex(F.md5(F.concat(f"g{k - 1}", F.expr(f"lead(g{k - 1}, {half}) over (partition by doc order by i)")))))
    out = out.withColumn("g", F.array(*[f"g{k}" for k in range(levels)]))
    out = out.withColumn("e", F.array(*[F.expr(f"lag(g{k}, {(1 << k) - 1}) over (partition by doc order by i)") for k in range(levels)]))
    parts = [("ahead", ahead, "g", F.expr(f"last(e) {ahead}")), ("back", back, F.expr(f"first(g) {back}"), "e")]
    for name, frame, left, right in parts:
        cols = {"m": F.expr(f"min(struct(h, i, shared)) {frame}"), "k": F.expr(f"count(1) {frame}"), "lo": F.expr(f"min(i) {frame}"), "hi": F.expr(f"max(i) {frame}")}
        out = out.withColumn(name, F.struct(*[c.alias(k) for k, c in cols.items()], (F.col(left) if isinstance(left, str) else left).alias("l"), (F.col(right) if isinstance(right, str) else right).alias("r")))

    def window(name: str) -> Column:
        w = F.col(name)
        level = F.floor(F.log2(w["k"].cast("double")) + 1e-9).cast("int")
        body = F.unhex(F.md5(F.concat(F.lit(f"{name}:"), w["k"].cast("string"), F.lit(":"), F.hex(F.get(w["l"], level)), F.hex(F.get(w["r"], level)))))
        return F.struct(F.lit(name == "ahead").alias("ahead"), w["lo"].alias("first"), w["hi"].alias("last"), body.alias("body"))

    full = [F.when((F.col("all") - F.col("a") >= min_words) & F.col("ahead.m.shared"), window("ahead")), F.when((F.col("b") >= min_words) & F.col("back.m.shared"), window("back"))]
    return out.select("id", "doc", "i", F.explode(F.array(*full)).alias("w")).filter("w is not null").select("id", "doc", "i", "w.*")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, runs, lines): for each document with later repeats, the sorted (first, last) runs of lines to delete, and their number.

    Null text is empty; documents with a null doc_id come first in the order; an empty table gives no rows.
    """
    lines = cut(_lines(docs), "lines")
    shared = cut(_shared_fingerprints(lines, min_words), "fingerprints")
    flagged = _salted(lines, shared.select("h", F.lit(True).alias("shared")), "h", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    flagged = cut(flagged.repartition("doc"), "flagged")
    some = flagged.join(flagged.filter("shared").select("doc").distinct(), "doc", "left_semi")
    near = cut(_windows(some, min_words), "line-windows")
    place = F.struct("id", "doc", "first", "last")
    first = near.groupBy("body").agg(F.min(place).alias("lo"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    later = _salted(near, first, "body", "inner").filter(place != F.col("lo"))
    reach = later.groupBy("doc", "i").agg(F.max(F.when(F.col("ahead"), F.col("last"))).alias("to"), F.min(F.when(~F.col("ahead"), F.col("first"))).alias("from"))
    reach = cut(reach, "line-reach")
    discard(near, flagged, shared)
    held = lines.join(reach.select("doc").distinct(), "doc", "left_semi").select("doc", "i").join(reach, ["doc", "i"], "left")
    order = "partition by doc order by i"
    gone = F.expr(f"max(to) over ({order})") >= F.col("i")
    gone |= F.expr(f"min(from) over ({order} desc)") <= F.col("i")  # a running minimum from the end: frames up to the end cost their square
    covered = held.select("doc", "i", F.coalesce(gone, F.lit(False)).alias("gone"))
    opens = F.col("gone") & ~F.expr(f"lag(gone, 1, false) over ({order})")
    numbered = covered.select("doc", "i", "gone", opens.cast("int").alias("opens")).select("doc", "i", "gone", F.expr(f"sum(opens) over ({order})").alias("run")).filter("gone")
    runs = numbered.groupBy("doc", "run").agg(F.struct(F.min("i").alias("first"), F.max("i").alias("last")).alias("r"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("doc").agg(F.sort_array(F.collect_list("r")).alias("runs"), F.sum("n").alias("lines"))


def _kept(text: Column, runs: Column) -> Column:
    """The lines of a text but those of its runs that hold a word."""
    gone = lambda line, i: line.rlike(_LINE_WORD) & F.exists(runs, lambda r: (r["first"] <= i) & (r["last"] >= i))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~gone(line, i)), "\n")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with the lines of later repeated runs (min_words words or more) deleted from text, plus _sw_dropped.

    Rows all stay, also those left empty; null text stays null; rows that repeat doc_id and text get equal results and
    aren't repeats of each other; a doc_id with two texts is two documents, in the order of their hashes; n_chars, where
    there is one, follows the text. Blank lines are never deleted. A passage counts as far as it consists of whole
    lines. Internal columns start with _sw_; no column of docs may. The lines of one text are sorted in one task.
    """
    drops = repeated_runs(docs, min_words).select(F.col("doc").alias("_sw_doc"), F.col("runs").alias("_sw_runs"), F.col("lines").alias("_sw_lines"))
    keyed = docs.select("*", _doc(F.col("doc_id"), text_or_empty()).alias("_sw_doc"))
    joined = keyed.join(drops.hint("shuffle_hash"), "_sw_doc", "left")
    out = joined.withColumn("text", F.when(F.col("_sw_runs").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("_sw_runs"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, F.coalesce("_sw_lines", F.lit(0)).cast("int").alias("_sw_dropped"))


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The columns of query op9: lines before, lines deleted, digest of the text left."""
    done = dedup_lines(docs.select("doc_id", "text"), min_words)
    text = text_or_empty()
    return done.select("doc_id", F.col("_sw_dropped").cast("long").alias("n_deleted"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


def oracle(min_words: int = 50, source: str = "documents") -> str:
    """The same in DuckDB, without fingerprints: every window against every other."""
    win = lambda f, o, r: f"{f} over (partition by doc_id, t order by {o} range between {r})"
    fwd, bwd = f"current row and {min_words - 1} following", f"{min_words - 1} preceding and current row"
    return f"""
with d as (select distinct doc_id, coalesce(text, '') as t from {source}),
l0 as (select doc_id, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as i from d),
l1 as (select doc_id, t, line, i, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n from l0),
l2 as (select *, sum(n) over (partition by doc_id, t order by i) as b, sum(n) over (partition by doc_id, t) as total from l1 where n > 0),
l3 as (select *, b - n as a from l2),
l4 as (select *, {win('list(line)', 'a', fwd)} as sf, {win('max(i)', 'a', fwd)} as ef, {win('list(line)', 'b', bwd)} as sb, {win('min(i)', 'b', bwd)} as eb from l3),
w as (select doc_id, t, i as first, ef as last, 0 as d, array_to_string(sf, chr(10)) as body from l4 where total - a >= {min_words}
  union all select doc_id, t, eb, i, 1, array_to_string(sb, chr(10)) from l4 where b >= {min_words}),
r as (select *, row_number() over (partition by d, body order by doc_id nulls first, t, first, last) as k from w),
gone as (select distinct doc_id, t, unnest(generate_series(first, last)) as i from r where k > 1),
gone2 as (select g.* from gone g join l1 using (doc_id, t, i) where l1.n > 0),
left0 as (select l1.doc_id, l1.t, string_agg(l1.line, chr(10) order by l1.i) filter (where g.i is null) as kept, count(g.i) as n_deleted
  from l1 left join gone2 g on g.doc_id is not distinct from l1.doc_id and g.t = l1.t and g.i = l1.i group by 1, 2)
select d.doc_id, coalesce(x.n_deleted, 0)::bigint as n_deleted, length(coalesce(x.kept, ''))::bigint as n_chars_left, sha256(coalesce(x.kept, '')) as text_sha256
from (select doc_id, coalesce(text, '') as t from {source}) d left join left0 x on x.doc_id is not distinct from d.doc_id and x.t = d.t"""
