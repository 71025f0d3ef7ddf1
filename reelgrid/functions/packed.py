"""Packed cells ('A|B', 'k=v|k=v') and loosely written numbers as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_classes(cell: Column, trim: bool = True) -> Column:
    """Names of an 'A|B' cell.  trim: names without outer blanks and without empty ones;
    else as written, nothing for a blank cell."""
    parts = F.split(F.coalesce(cell, F.lit("")), r"\|")
    if trim:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(F.coalesce(cell, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(parts)


def int_strict(text: Column) -> Column:
    """An integer written as one; null for '2.0', blanks and words."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("int"))


def int_loose(text: Column) -> Column:
    """The integer part of any number; null if it is none."""
    return text.try_cast("double").try_cast("int")


def packed_entries(cell: Column) -> Column:
    """array<struct<k, v>> of a 'k=v|k=v' cell: split at the last '=', keys where they stand first, of a repeated key the last value."""

    def read(p: Column) -> Column:
        v = F.substring_index(p, "=", -1)
        k = F.trim(F.substr(p, F.lit(1), F.greatest(F.length(p) - F.length(v) - 1, F.lit(0))))
        return F.struct(k.alias("k"), int_strict(v).alias("v"))

    found = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), read), lambda e: (e["k"] != "") & e["v"].isNotNull())

    def once(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        value = lambda k: F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"]
        return F.when(F.size(keys) == F.size(es), es).otherwise(F.transform(keys, lambda k: F.struct(k.alias("k"), value(k).alias("v"))))

    return F.transform(F.array(found), once)[0]


def parse_packed(cell: Column) -> Column:
    """map<string,int> of a 'k=v|k=v' cell; empty for null, blank or unreadable ones."""
    return F.map_from_entries(packed_entries(cell))


def pack_in_order(m: Column) -> Column:
    """A map as 'k=v|k=v', keys as they stand in it."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")


def pack(m: Column) -> Column:
    """A map as 'k=v|k=v', keys in order."""
    keys = F.array_sort(F.map_keys(m))
    return F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, F.element_at(m, k).cast("string"))), "|")


def slug(name: Column) -> Column:
    """A name as key: lower case, other characters than letters and digits as one '_'."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(x, 0).try_cast("int")


def leading_score(text: Column, low: int = 0, high: int = 4) -> Column:
    """A score at the head of a text such as '2 (moderate)'; numbers round half to even; null outside the scale."""
    number = F.when(F.trim(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), half_even(F.trim(text).try_cast("double")))
    head = F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("int")
    n = F.coalesce(number, head)
    return F.when(n.between(low, high), n)


def values_text(values: Column) -> Column:
    """The values of a scale in words: '0-4' where they follow each other, else '0, 1 or 3'."""
    v = F.array_sort(F.array_distinct(values))
    text = F.transform(v, lambda x: x.cast("string"))
    last = F.element_at(text, -1)
    run = F.concat_ws("-", text[0], last)
    listed = F.concat_ws(" or ", F.nullif(F.array_join(F.slice(text, F.lit(1), F.greatest(F.size(text) - 1, F.lit(0))), ", "), F.lit("")), last)
    return F.when(F.size(v) == 0, "").when(F.element_at(v, -1) - v[0] == F.size(v) - 1, run).otherwise(listed)
