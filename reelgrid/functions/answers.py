"""What a model wrote, as typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.text import strip

def json_block(text: Column) -> Column:
    """The text from the first { to the last }; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)


def strict_json(text: Column) -> Column:
    """text as a variant, null unless all of it is one JSON value (Spark's reader stops after the first)."""
    return F.try_variant_get(F.try_parse_json(F.when(text != "", F.concat(F.lit("["), text, F.lit("]")))), "$[0]", "variant")


def parse_answer(raw: Column) -> Column:
    """struct<present, score, reason, parse_ok> of an answer.

    The JSON block must be whole, else the answer is not parsed.  present may be written
    as a word; a score without a number is none; of a present element it is kept within
    1 and 4, else it is 0.
    """
    v = strict_json(json_block(raw))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    get = lambda path, t: F.try_variant_get(v, path, t)
    pk = kind("$.present")
    present = (
        F.when(pk == "STRING", F.lower(strip(get("$.present", "string"))).isin("true", "yes"))
        .when(pk == "BOOLEAN", get("$.present", "boolean"))
        .when(pk.rlike("^(BIGINT|DECIMAL|DOUBLE)"), get("$.present", "double") != 0)
        .when(pk.rlike("^(ARRAY|OBJECT)"), ~get("$.present", "string").isin("[]", "{}"))
        .otherwise(False)
    )
    sk = kind("$.score")
    number = F.when(sk == "STRING", F.when(strip(get("$.score", "string")).rlike(r"^[+-]?[0-9]+$"), strip(get("$.score", "string")).try_cast("int"))).when(sk == "BOOLEAN", get("$.score", "boolean").cast("int")).otherwise(get("$.score", "double").try_cast("int"))
    ok = v.isNotNull()
    shown = F.coalesce(ok & present, F.lit(False))
    score = F.when(shown, F.least(F.greatest(F.coalesce(number, F.lit(0)), F.lit(1)), F.lit(4))).otherwise(0)
    return F.struct(shown.alias("present"), score.alias("score"), F.when(ok, F.coalesce(strip(get("$.reason", "string")), F.lit(""))).otherwise("").alias("reason"), ok.alias("parse_ok"))


def tier_label(text: Column) -> Column:
    """High, Moderate, Low or Unknown, as a free text says at its head.

    A text that starts with 'low' and soon names a higher one is of that; a text that
    starts with none is of the strongest it names.
    """
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    head, soon = F.substring(t, 1, 40), F.substring(t, 4, 17)
    has = lambda c, *w: F.lit(False) if not w else F.coalesce(c.rlike("|".join(w)), F.lit(False))
    return (
        F.when(head.startswith("high"), "High")
        .when(head.rlike("^(moderate|medium)"), "Moderate")
        .when(head.startswith("low"), F.when(has(soon, "high"), "High").when(has(soon, "moderate", "medium"), "Moderate").otherwise("Low"))
        .when(has(head, "high"), "High")
        .when(has(head, "moderate", "medium"), "Moderate")
        .when(has(head, "low"), "Low")
        .otherwise("Unknown")
    )
