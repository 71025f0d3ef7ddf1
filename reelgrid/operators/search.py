"""Faceted search: filters as expressions, so they reach the scan where they can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.packed import parse_packed, split_classes
from reelgrid.operators.evaluate import AXES

Bounds = tuple[int | None, int | None]


@dataclass(frozen=True)
class Facets:
    """What a search asks for; empty facets ask nothing."""

    uuid: str = ""
    text: str = ""
    classes: Sequence[str] = ()
    mode: str = "any"  # or all, none
    special: str = ""  # or special, normal
    score: Bounds = (None, None)
    axes: Mapping[str, Bounds] = field(default_factory=dict)
    outcome: str = ""  # or tp, fp, fn
    limit: int | None = 500  # None: all


def in_bounds(v: Column, bounds: Bounds, missing: bool = False) -> Column:
    """Whether v lies in bounds; without bounds anything does; missing: whether null does."""
    low, high = bounds
    if low is None and high is None:
        return F.lit(True)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.coalesce(ok, F.lit(missing))


def contains(text: Column, part: str) -> Column:
    """Whether text holds part, in any letter case; part is no pattern."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower())) if part else F.lit(True)


def has_classes(names: Column, wanted: Sequence[str], mode: str) -> Column:
    """any, all or none of the wanted names."""
    if not wanted:
        return F.lit(True)
    q = F.array(*map(F.lit, wanted))
    return {"any": F.arrays_overlap(names, q), "all": F.size(F.array_except(q, names)) == 0, "none": ~F.arrays_overlap(names, q)}[mode]


def is_special(names: Column, special: str) -> Column:
    return {"": F.lit(True), "special": F.size(names) > 0, "normal": F.size(names) == 0}[special]


def outcome(gt: Column, pred: Column, wanted: str) -> Column:
    """tp: both have classes; fp: a predicted one too many; fn: a true one missed; no prediction fails all."""
    found = {"": F.lit(True), "tp": (F.size(gt) > 0) & (F.size(pred) > 0), "fp": F.size(F.array_except(pred, gt)) > 0, "fn": F.size(F.array_except(gt, pred)) > 0}[wanted]
    return F.coalesce(found, F.lit(False))


def top_score(scores: Column) -> Column:
    return F.array_max(F.map_values(scores))


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def _fitting(best: DataFrame, facets: Facets) -> DataFrame:
    rows = best.withColumns({"names": split_classes(F.col("classes")), "score_max": top_score(parse_packed(F.col("group_scores")))})
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("observation", "ego_behavior", "unusual_elements", "score_reason")])
    keep = contains(F.col("uuid"), facets.uuid) & has_classes(F.col("names"), facets.classes, facets.mode) & is_special(F.col("names"), facets.special) & in_bounds(F.col("score_max"), facets.score, missing=True) & contains(text, facets.text)
    for a, b in facets.axes.items():
        keep = keep & in_bounds(F.col(a), b)
    return rows.where(keep)


def search_results(best: DataFrame, facets: Facets) -> DataFrame:
    """Predictions that fit, highest score first, then by run and uuid.  A row without scores passes any score range,
    but one without a weather value fails a range of that axis."""
    out = _fitting(best, facets).select("run_id", "uuid", "names", "score_max", *AXES)
    return _first(out.orderBy(F.desc(F.coalesce("score_max", F.lit(0))), "run_id", "uuid"), facets.limit)


def totals(best: DataFrame, facets: Facets) -> DataFrame:
    """run_id, n: how many predictions fit, whatever the search's limit."""
    return _fitting(best, facets).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def search_labels(labels: DataFrame, facets: Facets, predictions: DataFrame | None = None) -> DataFrame:
    """Labels that fit, highest score first, then by uuid.  A label without score or weather value fails its range.
    predictions (uuid, pred): needed for an outcome, which is ignored without them."""
    rows = labels.withColumns({"names": F.array_sort(F.array_distinct(F.coalesce("class_list", F.array().cast("array<string>")))), "score_max": F.array_max(F.filter(F.map_values("group_scores"), lambda v: v != -1))})
    keep = contains(F.col("uuid"), facets.uuid) & has_classes(F.col("names"), facets.classes, facets.mode) & is_special(F.col("names"), facets.special) & in_bounds(F.col("score_max"), facets.score) & contains(F.col("note"), facets.text)
    for a, b in facets.axes.items():
        keep = keep & in_bounds(F.try_element_at("weather", F.lit(a)), b)
    rows = rows.where(keep)
    if facets.outcome and predictions is not None:
        rows = rows.join(predictions.select("uuid", "pred"), "uuid", "left").where(outcome(F.col("names"), F.col("pred"), facets.outcome))
    return _first(rows.select("uuid", "names", "score_max", "note").orderBy(F.desc(F.coalesce("score_max", F.lit(0))), "uuid"), facets.limit)


def details(best: DataFrame, labels: DataFrame) -> DataFrame:
    """run_id, uuid, has_label, truth, names, tier, reason of every prediction beside its label, if there is one; no label isn't a label without classes.

    best and labels have uuid in one form.
    """
    truth = labels.select("uuid", F.array_sort(F.array_distinct(F.coalesce("class_list", F.array().cast("array<string>")))).alias("truth"))
    rows = best.select("run_id", "uuid", split_classes(F.col("classes")).alias("names"), F.col("tier_score").alias("tier"), F.col("score_reason").alias("reason")).join(truth, "uuid", "left")
    return rows.select("run_id", "uuid", F.col("truth").isNotNull().alias("has_label"), "truth", "names", "tier", "reason")


def worth_showing(best: DataFrame, least: int = 2) -> DataFrame:
    """Special predictions whose score isn't known or at least so high."""
    return best.where((F.col("verdict") == "Special") & (F.col("tier_score").isNull() | (F.col("tier_score") >= least)))
