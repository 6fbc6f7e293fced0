"""Arrays, maps and JSON: labels, evidence lists, timings as columns or rows, change records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.math import clamp01, col


def label_value(c, most: int = 80) -> Column:
    """A metric label without line ends and runs of spaces, cut; a blank one is unknown."""
    flat = F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(flat == "", "unknown").otherwise(F.substring(flat, 1, most))


def label_key(labels) -> Column:
    """One text for equal label sets: names in order, each with its value."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(labels))), lambda e: F.concat(e["key"], F.lit("="), label_value(e["value"]))), ",")


def evidence(c, most: int = 10) -> Column:
    """A JSON array of evidence as structs: a missing kind is unknown, an outcome lies between 0 and 1, a weight defaults to 1; the first `most`. Anything else is empty."""
    rows = F.coalesce(F.from_json(col(c), "array<struct<kind:string,outcome:double,weight:double>>"), F.array().cast("array<struct<kind:string,outcome:double,weight:double>>"))
    good = F.filter(rows, lambda r: r.isNotNull() & r["outcome"].isNotNull())
    return F.slice(F.transform(good, lambda r: F.struct(F.coalesce(r["kind"], F.lit("unknown")).alias("kind"), clamp01(r["outcome"]).alias("outcome"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight"))), 1, most)


def timing_rows(words, starts, ends) -> Column:
    """Timings kept as columns as an array of structs; entries beyond the shortest column, or that end before they start, drop out."""
    n = F.least(F.size(col(words)), F.size(col(starts)), F.size(col(ends)))
    cut = lambda c: F.slice(col(c), F.lit(1), n)
    made = F.transform(F.arrays_zip(cut(words).alias("w"), cut(starts).alias("s"), cut(ends).alias("e")), lambda x: F.struct(x["w"].alias("word"), x["s"].cast("long").alias("start_ms"), x["e"].cast("long").alias("end_ms")))
    return F.filter(made, lambda x: x["end_ms"] >= x["start_ms"])


def timing_columns(rows) -> Column:
    """Timings as structs turned into one struct of columns, version 2."""
    r = col(rows)
    return F.struct(F.lit(2).alias("version"), F.transform(r, lambda x: x["word"]).alias("words"), F.transform(r, lambda x: x["start_ms"]).alias("start_ms"), F.transform(r, lambda x: x["end_ms"]).alias("end_ms"))


def timing_of_seconds(rows) -> Column:
    """The older form, start and duration in seconds, as structs in milliseconds."""
    return F.transform(col(rows), lambda x: F.struct(x["word"].alias("word"), F.floor(x["start"] * 1000 + 0.5).cast("long").alias("start_ms"), F.floor((x["start"] + x["duration"]) * 1000 + 0.5).cast("long").alias("end_ms")))


def id_list(c) -> Column:
    """A JSON array of ids: texts that aren't blank, trimmed, each once, in order."""
    ids = F.transform(F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def metadata(c) -> Column:
    """A JSON object as a map of texts; anything that can't be parsed, or is no object, is empty."""
    return F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def change(before, after) -> Column:
    """from and to of a value that has changed; null where it hasn't."""
    return F.when(~col(before).eqNullSafe(col(after)), F.struct(col(before).alias("from"), col(after).alias("to")))


def safe_json(c) -> Column:
    """JSON that may stand inside a script element: angle brackets, ampersands and line separators as escapes."""
    out = F.to_json(col(c))
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def same_members(a, b) -> Column:
    """Whether two arrays are equal, element by element."""
    return col(a).eqNullSafe(col(b))
