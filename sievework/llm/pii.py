"""Personal data: fixed patterns, and terms whose co-occurrence with them discloses them (DataFrame functions only).

Base patterns find emails, IP addresses, card and phone numbers. The values found are the protected entities. An entity
stands on three levels: its value, its domain (mail domain, first two parts of an IP address, first six digits of a card,
all but the last four digits of a phone number) and its kind. A term is a run of at least three letters outside the
spans; words of more than STEM letters also count as their stem (``quin*``). With p as shares of all rows, a term t
discloses of an entity e, through a level g that e belongs to, PMI(t; g) / IC(e), where PMI = log2(p(t, g) / (p(t) p(g)))
and IC = -log2 p(e): the part of e's information that t gives away. So an entity of one text is estimated by its domain
and kind, as far as these tell anything of it. A pair (t, g) counts only if ``support`` distinct texts hold both, so
that copies of one text are no evidence, and with every term anywhere in those texts.

In every text with an entity, each word that discloses ``generalise_at`` or more of one of its entities is generalised to
its stem, or to <TERM> where the stem itself discloses that much; one that discloses ``remove_at`` or more is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Same matches as the contract's patterns, written so that Java's engine neither recurses nor starts in mid-run.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -]){13,}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TRIGGER = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
TERM_RANK = len(KINDS)
STEM = 4


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    twice = lambda i: at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)
    value = lambda i: F.when(i % 2 == 0, twice(i)).otherwise(at(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind: the pieces between matches and the matches give the places."""
    rank, pattern = KINDS.index(kind), PATTERNS[kind]
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("value")).cast(_SPAN)
        hit = F.when(x["match"].isNotNull() & _valid(kind, x["match"]), F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), hit.alias("out"))

    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(_TRIGGER[kind]), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start, then kind; code points, end exclusive."""
    return F.array_sort(F.concat(*[_found(text, k) for k in KINDS]))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    """Distinct runs of three or more letters, lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3), F.lower))


def _stem(word: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), F.lit(STEM)), F.lit("*"))


def _terms(text: Column) -> Column:
    """Distinct words and stems of a text."""
    words = _words(text)
    return F.concat(words, F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), _stem)))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a blank for every span."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.array_append(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    rest = lambda acc: F.array_join(F.array_append(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))), " ")
    return F.when(F.size(spans) > 0, F.aggregate(spans, none, step, rest)).otherwise(text)


def _groups(span: Column) -> Column:
    """The three levels of the entity of a span: value, domain, kind."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.split(value, "[.]")
    domain = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
        .when(kind == "card", F.substr(digits, F.lit(1), F.lit(6)))
        .otherwise(F.substr(digits, F.lit(1), F.length(digits) - 4))
    )
    same = F.when(kind.isin("email", "ip"), value).otherwise(digits)
    return F.struct(F.concat_ws(":", kind, F.lit("value"), same).alias("value"), F.concat_ws(":", kind, F.lit("domain"), domain).alias("domain"), kind.alias("kind"))


def _key(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(text.cast("binary")))


def disclosing_terms(docs: DataFrame, support: int = 2, generalise_at: float = 0.6, remove_at: float = 0.9) -> DataFrame | None:
    """(_key, _text, _spans, actions) of the texts of docs (_text) with disclosing words; actions maps a word to its substitute.

    None where no pair of a term and an entity has support. See the module for the measure.
    """
    total = float(docs.count())
    held = docs.select(_key(F.col("_text")).alias("_key"), "_text", base_spans(F.col("_text")).alias("_spans")).filter(F.size("_spans") > 0)
    texts = held.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.first("_text").alias("_text"), F.first("_spans").alias("_spans"))
    texts = cut(texts.withColumn("n", F.monotonically_increasing_id()), "pii-texts")  # short numbers, fixed once written
    of = F.explode(F.array_distinct(F.transform("_spans", _groups)))
    entities = texts.select("n", "copies", of.alias("e")).select("n", "copies", "e.*")
    of_value = entities.groupBy("value").agg((-F.log2(F.sum("copies") / total)).alias("ic"))
    level = F.explode(F.array("value", "domain", "kind")).alias("g")
    levels = cut(entities.join(of_value, "value").select("n", "copies", "ic", level).groupBy("n", "copies", "g").agg(F.min("ic").alias("ic")), "pii-levels")
    # PMI(t; g) is IC(g) at most: levels that can't disclose enough of any entity leave here, exactly
    groups = levels.groupBy("g").agg(F.sum("copies").alias("n_g"), F.count(F.lit(1)).alias("texts"), F.min("ic").alias("ic_g"))
    groups = groups.filter((F.col("texts") >= support) & (-F.log2(F.col("n_g") / total) >= generalise_at * F.col("ic_g") - 1e-9))
    # a pair reaches generalise_at only if n_t <= N 2^(-generalise_at IC(e)); n_t is no less than its count in these texts
    most = total * F.pow(2.0, -generalise_at * F.col("ic_g")) * (1 + 1e-9)
    groups = cut(groups.select("g", F.monotonically_increasing_id().alias("gid"), "n_g", most.alias("most")), "pii-groups")
    top = groups.agg(F.max("most")).first()[0]
    if top is None:
        discard(texts, levels, groups)
        return None
    asked = cut(levels.join(groups.drop("n_g"), "g").select("n", "gid", "ic", "most"), "pii-asked")
    words = cut(texts.select("n", "copies", F.explode(_terms(_outside(F.col("_text"), F.col("_spans")))).alias("term")), "pii-words")
    twice = words.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("least")).filter((F.col("texts") >= support) & (F.col("least") <= top)).drop("texts")
    near = words.join(twice, "term").join(asked, "n").filter(F.col("least") <= F.col("most"))
    near = cut(near.select("n", "copies", "term", "gid", "ic"), "pii-near")
    pairs = near.groupBy("gid", "term").agg(F.sum("copies").alias("n_tg"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    pairs = cut(pairs.join(groups, "gid").select("gid", "term", "n_tg", "n_g"), "pii-pairs")
    rare = pairs.select("term").distinct()
    everywhere = docs.select(F.explode(_terms(_outside(F.col("_text"), base_spans(F.col("_text"))))).alias("term"))
    # counted before the join: partial counts shuffle far less than one row a word of a text
    of_term = everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(rare, "term", "left_semi")
    pmi = F.log2(F.col("n_tg") * total / (F.col("n_t").cast("double") * F.col("n_g")))
    told = cut(pairs.join(of_term, "term").select("gid", "term", pmi.alias("pmi")).filter("pmi > 0"), "pii-told")
    share = near.filter("ic > 0").join(told, ["gid", "term"]).groupBy("n", "term").agg(F.max(F.col("pmi") / F.col("ic")).alias("share")).filter(F.col("share") >= generalise_at)
    # a word and its stem meet in one row set, grouped by the stem
    word, stem = F.col("term"), F.when(F.col("term").endswith("*"), F.col("term")).otherwise(_stem(F.col("term")))
    of_text = share.groupBy("n").agg(F.collect_list(F.struct(word.alias("term"), stem.alias("stem"), "share")).alias("all"))
    stems = F.transform(F.filter("all", lambda x: x["term"].endswith("*")), lambda x: x["term"])
    too = lambda x: F.array_contains(F.col("stems"), x["stem"]) | (F.length(x["term"]) <= STEM)
    action = lambda x: F.when(x["share"] >= remove_at, "").when(too(x), "<TERM>").otherwise(x["stem"])
    own = F.transform(F.filter("all", lambda x: ~x["term"].endswith("*")), lambda x: F.struct(x["term"].alias("term"), action(x).alias("action")))
    actions = cut(of_text.select("n", "all", stems.alias("stems")).select("n", F.map_from_entries(own).alias("actions")).filter(F.size("actions") > 0), "pii-actions")
    discard(levels, groups, asked, words, near, pairs, told)
    return actions.join(texts, "n").select("_key", "_text", "_spans", "actions")


def term_spans(docs: DataFrame, **limits) -> DataFrame | None:
    """(_key, added): the spans of disclosing terms of each text of docs (_text) that has one; None where there are none."""
    marks = disclosing_terms(docs, **limits)
    if marks is None:
        return None
    # one-character separators make the places of words a running sum
    runs = marks.select("_key", "_spans", "actions", F.posexplode(F.split(F.col("_text"), r"[^\p{L}]", -1)).alias("i", "w"))
    end = F.expr("cast(sum(length(w) + 1) over (partition by _key order by i) as int)") - 1
    placed = runs.select("_key", "_spans", F.element_at("actions", F.lower("w")).alias("action"), end.alias("end"), (end - F.length("w")).alias("start")).filter("action is not null")
    clear = ~F.exists("_spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    span = F.struct("start", F.lit(TERM_RANK).alias("rank"), "end", F.lit("term").alias("kind"), F.col("action").alias("value")).cast(_SPAN)
    return cut(placed.filter(clear).groupBy("_key").agg(F.collect_list(span).alias("added")), "pii-places")


def _with_added(rows: DataFrame, added: DataFrame | None) -> DataFrame:
    """rows (_sw_key, _sw_base) with _sw_spans: the base spans and, joined by the text's hash, those of terms."""
    none = F.array().cast(f"array<{_SPAN}>")
    if added is None:
        return rows.withColumn("_sw_spans", F.col("_sw_base"))
    joined = rows.join(added.select(F.col("_key").alias("_sw_key"), F.col("added").alias("_sw_added")), "_sw_key", "left")
    return joined.withColumn("_sw_spans", F.array_sort(F.concat("_sw_base", F.coalesce("_sw_added", none)))).drop("_sw_added")


def find_personal_data(docs: DataFrame, **limits) -> DataFrame:
    """Spans of personal data of every row: doc_id, base, spans (arrays of structs; a term's value is what replaces it).

    Null text counts as empty; rows with a null doc_id are kept; rows that repeat doc_id and text get equal results;
    a same doc_id with other text is another document; an empty table gives an empty result; other columns are left out;
    a text of any length is searched whole. limits: see disclosing_terms.
    """
    added = term_spans(docs.select(text_or_empty().alias("_text")), **limits)
    rows = docs.select("doc_id", _key(text_or_empty()).alias("_sw_key"), base_spans(text_or_empty()).alias("_sw_base"))
    return _with_added(rows, added).select("doc_id", F.col("_sw_base").alias("base"), F.col("_sw_spans").alias("spans"))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced: <EMAIL> and so on, a stem or <TERM> where generalised, nothing where removed."""

    def step(acc: Column, s: Column) -> Column:
        mask = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(F.concat(acc["out"], F.array(gap, mask)).alias("out"), s["end"].alias("at"))
        widened = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(widened)

    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, none, step, done)).otherwise(text)


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """docs with personal data masked in text; a null text stays null, other columns and rows stay as they are.

    n_chars, where there is one, follows the new text. Internal columns start with _sw_; no column of docs may.
    """
    added = term_spans(docs.select(text_or_empty().alias("_text")), **limits)
    rows = docs.withColumns({"_sw_key": _key(text_or_empty()), "_sw_base": base_spans(text_or_empty())})
    out = _with_added(rows, added)
    out = out.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(_sanitised(F.col("text"), F.col("_sw_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def report(docs: DataFrame, **limits) -> DataFrame:
    """The columns of query op1: counts by kind, digest of the base spans, all spans."""
    found = find_personal_data(docs, **limits)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
