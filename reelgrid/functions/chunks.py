"""Chunk lists such as '0-9, 15': read into ranges, merge, expand, write back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers beyond one that a range may name in the label store's input form.
WIDEST = 100_000
_SPLIT = r"[,\s]+"
# possessive, so that long lists need no stack
_LIST = r"^[,\s]*+(?:[0-9]++(?:-[0-9]++)?+(?:[,\s]++|$))*+$"


def _once(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f names it."""
    return F.transform(F.array(value), f)[0]


def ranges(spec: Column, widest: int | None = None) -> Column:
    """The ranges of a chunk list as array<struct<lo, hi>>, as written.

    Parts stand between commas or white space; a range's ends may come in either order.
    Null and blank lists are empty; null if any part can't be read: if it is no number or
    range, doesn't fit a long, or (with widest) names more than widest + 1 numbers.
    """

    def read(p: Column) -> Column:
        ends = F.transform(F.split(p, "-"), lambda x: x.try_cast("bigint"))
        return F.struct(F.array_min(ends).alias("lo"), F.array_max(ends).alias("hi"), F.exists(ends, lambda x: x.isNull()).alias("lost"))

    parts = F.filter(F.split(spec, _SPLIT), lambda p: p != "")
    bad = (lambda r: r["lost"]) if widest is None else (lambda r: r["lost"] | (r["hi"] - r["lo"] > widest))
    plain = lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"))
    found = _once(F.transform(parts, read), lambda rs: F.when(~F.exists(rs, bad), F.transform(rs, plain)))
    return F.when(spec.isNull(), F.array().cast("array<struct<lo:bigint,hi:bigint>>")).when(spec.rlike(_LIST), found)


def merged(found: Column) -> Column:
    """Ranges as ascending disjoint ones; neighbours and what overlaps become one.

    With starts and ends sorted apart, a new range begins where a start lies beyond the end
    of the same rank before it, so nothing is folded.
    """
    low, high = F.array_sort(F.transform(found, lambda r: r["lo"])), F.array_sort(F.transform(found, lambda r: r["hi"]))

    def cut(e: Column) -> Column:
        lo, hi = e["lo"], e["hi"]
        first = F.filter(lo, lambda x, i: (i == 0) | (x - 1 > F.get(hi, i - 1)))
        last = F.filter(hi, lambda x, i: (i == F.size(hi) - 1) | (F.get(lo, i + 1) - 1 > x))
        return F.transform(first, lambda x, i: F.struct(x.alias("lo"), F.get(last, i).alias("hi")))

    return _once(F.struct(low.alias("lo"), high.alias("hi")), cut)


def expand(found: Column) -> Column:
    """All numbers of the ranges, distinct and ascending."""
    return F.flatten(F.transform(merged(found), lambda r: F.sequence(r["lo"], r["hi"])))


def parse_chunks(spec: Column, widest: int | None = WIDEST) -> Column:
    """The numbers of a chunk list; null if it is unreadable or empty.  They stand in one array, so ranges have a limit."""
    return _once(expand(ranges(spec, widest)), lambda ns: F.when(F.size(ns) > 0, ns))


def format_ranges(found: Column) -> Column:
    """Merged ranges as a chunk list: a-b or a single number, joined by ', '."""
    return F.array_join(F.transform(found, lambda r: F.concat(r["lo"].cast("string"), F.when(r["lo"] == r["hi"], "").otherwise(F.concat(F.lit("-"), r["hi"].cast("string"))))), ", ")


def format_chunks(numbers: Column) -> Column:
    """Numbers as a chunk list: runs of neighbours become a-b, parts are joined by ', '."""
    return format_ranges(merged(F.transform(numbers, lambda n: F.struct(n.cast("bigint").alias("lo"), n.cast("bigint").alias("hi")))))
