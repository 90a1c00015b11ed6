"""Spans as DataFrame expressions: where a regular expression matches, in code points, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,kind_at:int,stop:bigint,kind:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def match_spans(text: Column, pattern: str, kind: str, kind_at: int, passes=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches. Splitting at the same pattern gives the gaps between matches, so that starts
    are running sums of lengths. passes(value of group) drops failing matches without searching them again."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("out"))

    def step(acc, row):
        begin = acc["at"] + F.length(row["0"])
        stop = begin + F.coalesce(F.length(row["1"]), F.lit(0))
        keep = row["1"].isNotNull() if passes is None else row["1"].isNotNull() & passes(row["2"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind_at).alias("kind_at"), stop.alias("stop"), F.lit(kind).alias("kind"))).cast(SPAN)
        return F.struct(stop.cast("bigint").alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    named = F.transform(rows, lambda r: F.struct(r["gap"].alias("0"), r["hit"].alias("1"), r["value"].alias("2")))
    return F.aggregate(named, start, step, lambda acc: acc["out"])


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind in the listed order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span, or union of overlapping spans, replaced by one mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[REDACTED]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
