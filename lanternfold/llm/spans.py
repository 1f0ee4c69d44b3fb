"""Spans of regular expressions in whole texts, as code-point offsets, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, as array<struct<start, end, value>>.

    Matches come from regexp_extract_all, the text between them from split with the same pattern; running sums of
    their lengths give the offsets. A text without a match costs one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def walk(both: Column) -> Column:
        pairs = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), both["hits"], lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), F.array().cast(NO_SPANS).alias("out")), step, lambda acc: acc["out"])

    # the one-element transform binds the arrays once, so that no search runs twice
    once = F.transform(F.array(F.struct(between.alias("gaps"), found.alias("hits"))), walk)
    return F.when(text.rlike(pattern), once[0]).otherwise(F.array().cast(NO_SPANS))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its rank among the kinds."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of each span in the order given, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
