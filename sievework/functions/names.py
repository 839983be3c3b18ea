"""File names, paths, digests, times and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    """Lower-case file name without folders and suffix."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def top_folder(path: Column) -> Column:
    """First folder of a relative path, empty for files at the root."""
    return F.regexp_extract(path, r"^([^/\\]+)[/\\]", 1)


def file_sequence(name: Column) -> Column:
    """The last run of digits of a name where it has three or more, else -1; of P and seven digits the last four."""
    found = F.coalesce(F.nullif(F.regexp_extract(name, r"^[Pp]\d{3}(\d{4})$", 1), F.lit("")), F.regexp_extract(name, r"(\d{3,})\D*$", 1))
    return F.when(found == "", F.lit(-1)).otherwise(F.substring(found, -9, 9).try_cast("int"))


def entity_id(path: Column, size: Column, modified_ns: Column) -> Column:
    """24 hex digits over path, size and modification time."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified_ns.cast("string")), 256), 1, 24)


def cache_key(entity: Column, signature: Column) -> Column:
    return F.concat(entity, F.lit(":"), F.substring(F.sha2(signature, 256), 1, 16))


def signature(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def safe_relative(path: Column) -> Column:
    """Whether a path stays below its root: not absolute, no drive, no step up, not empty."""
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (F.length(path) > 0) & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.exists(steps, lambda s: s == "..")


def sound_operation_id(x: Column) -> Column:
    return x.rlike(r"^[0-9a-f]{32}$")


def sound_request_id(x: Column) -> Column:
    return F.trim(x).rlike(r"^[0-9A-Fa-f-]{16,64}$")


def capture_time(*texts: Column, modified: Column, subsecond: Column | None = None) -> Column:
    """The first text that is a time in either accepted form, with the digits of subsecond after its point, else the modification time."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    told = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for t in texts for f in forms])
    if subsecond is not None:
        part = F.coalesce(F.rpad(F.regexp_extract(subsecond, "^[0-9]{1,6}", 0), 6, "0").cast("long"), F.lit(0))
        told = F.timestamp_micros(F.unix_micros(told) + part)
    return F.coalesce(told, modified)


def time_range_label(first: Column, last: Column) -> Column:
    return F.concat_ws("-", F.date_format(first, "HH:mm"), F.date_format(last, "HH:mm"))


def canonical_hash(rows: Column) -> Column:
    """SHA-256 of a set of structs, whatever their order."""
    return F.sha2(F.to_json(F.struct(F.sort_array(rows).alias("rows"))), 256)


def json_within(text: Column) -> Column:
    """The outermost JSON object in free text."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def micros(ts: Column) -> Column:
    """Microseconds of a naive or zoned time, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def normal_path(path: Column) -> Column:
    """A path with forward slashes, no empty or single-dot parts and no slash at its end, in lower case."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda x: (x != "") & (x != "."))
    return F.concat(F.when(F.substring(path, 1, 1).isin("/", "\\"), "/").otherwise(""), F.array_join(parts, "/"))


def path_hash(path: Column) -> Column:
    """First 24 hex digits of SHA-256 over the normal path: one id for one file, however its path is written."""
    return F.substring(F.sha2(normal_path(path), 256), 1, 24)
