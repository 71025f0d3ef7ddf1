"""Scoring multi-label and ordinal predictions against labels, for each run.

`matched` puts a run's predictions beside the labels; everything else aggregates it in one
pass.  The taxonomy is a small fixed table: it is read to the driver (at most MAX_CLASSES
rows, checked) and becomes a map literal, so looking up groups needs no join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.packed import parse_packed, split_classes
from reelgrid.functions.text import key_text
from reelgrid.operators.merge import keep_best, keep_last

MAX_CLASSES = 10_000
AXES = ("illumination", "precipitation", "road_surface", "atmospheric_obscurants")


@dataclass(frozen=True)
class Taxonomy:
    """Classes in order with their group; unknown: names of catch-all classes."""

    groups: dict[str, str]
    unknown: frozenset[str]

    @classmethod
    def of(cls, df: DataFrame) -> Taxonomy:
        rows = df.select("class_name", "group_name", "group_pos", "class_pos", "is_unknown").where("class_name IS NOT NULL").limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        rows.sort(key=lambda r: (r.group_pos or 0, r.class_pos or 0, r.class_name))
        return cls({r.class_name: r.group_name for r in rows}, frozenset(r.class_name for r in rows if r.is_unknown))

    def group(self, c: Column) -> Column:
        """The group of a class; null if the taxonomy lacks it."""
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in self.groups.items() for x in pair]).cast("map<string,string>"), c)

    def names(self, known_only: bool = False) -> list[str]:
        return [c for c in self.groups if not (known_only and c in self.unknown)]


def best_results(results: DataFrame) -> DataFrame:
    """Of each run and clip the first row with frames, else the first row."""
    return keep_best(results, ["run_id", "uuid"], F.col("n_frames") > 0, [F.col("shard_no"), F.col("loaded_at")])


def current_labels(labels: DataFrame) -> DataFrame:
    """Of each clip the row of the highest revision; uuid in one form."""
    return keep_last(labels.withColumn("uuid", key_text(F.col("uuid"))), ["uuid"], [F.col("rev"), F.col("updated_at")])


def _as_set(names: Column) -> Column:
    return F.array_sort(F.array_distinct(names))


def matched(results: DataFrame, labels: DataFrame, fields: bool = False) -> DataFrame:
    """run_id, uuid, gt and pred (class sets), gt_scores and pred_scores (maps), gt_<axis>, pred_<axis>, class_scores.

    fields: with pred_fields (map of scores by field, null where the run kept none) and pred_reason, for split_scores.
    """
    detail = ["field_scores", "score_reason"] if fields else []
    best = best_results(results.select("run_id", "uuid", "shard_no", "loaded_at", "n_frames", "classes", "group_scores", *detail, *AXES))
    pred = best.select("run_id", key_text(F.col("uuid")).alias("uuid"), _as_set(split_classes(F.col("classes"), trim=False)).alias("pred"), parse_packed(F.col("group_scores")).alias("pred_scores"), *[F.col(a).alias(f"pred_{a}") for a in AXES], *([F.when(F.col("field_scores").isNotNull(), parse_packed(F.col("field_scores"))).alias("pred_fields"), F.col("score_reason").alias("pred_reason")] if fields else []))
    rated = F.map_filter("group_scores", lambda _, v: v.isNotNull() & (v != -1))
    gt = current_labels(labels.select("uuid", "rev", "updated_at", "class_list", "group_scores", "weather", "classes", "has_class_scores")).where("class_list IS NOT NULL")
    gt = gt.select("uuid", _as_set("class_list").alias("gt"), F.coalesce(rated, F.create_map().cast("map<string,int>")).alias("gt_scores"), F.when(F.col("has_class_scores"), F.col("classes")).alias("class_scores"), *[F.try_element_at("weather", F.lit(a)).alias(f"gt_{a}") for a in AXES])
    return pred.join(gt, "uuid")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1, each 0 where it has no cases."""
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return p, r, safe_div(2 * p * r, p + r)


def _scored(counts: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def verdict_metrics(pairs: DataFrame, tax: Taxonomy) -> DataFrame:
    """run_id, scope ('All' or a group), tp, fp, fn, tn, accuracy, precision, recall, f1, specificity; no groups without cases."""
    of = lambda c: F.array_compact(F.array_distinct(F.transform(c, tax.group)))
    sides = pairs.select("run_id", (F.size("gt") > 0).alias("t"), (F.size("pred") > 0).alias("p"), of("gt").alias("gs"), of("pred").alias("ps"))
    case = lambda scope, t, p: F.struct(scope.alias("scope"), t.alias("t"), p.alias("p"))
    scopes = F.concat(F.array(case(F.lit("All"), F.col("t"), F.col("p"))), F.transform(F.array_union("gs", "ps"), lambda g: case(g, F.array_contains("gs", g), F.array_contains("ps", g))))
    each = sides.select("run_id", F.explode(scopes).alias("s")).select("run_id", "s.*")
    n = each.groupBy("run_id", "scope").agg(F.count_if(F.expr("t AND p")).alias("tp"), F.count_if(F.expr("NOT t AND p")).alias("fp"), F.count_if(F.expr("t AND NOT p")).alias("fn"), F.count(F.lit(1)).alias("k"))
    # a clip without a group's classes on either side is a true negative of the group
    clips = F.max(F.when(F.col("scope") == "All", F.col("k"))).over(Window.partitionBy("run_id"))
    n = n.withColumn("tn", clips - F.col("tp") - F.col("fp") - F.col("fn")).drop("k")
    out = _scored(n.where("scope = 'All' OR tp + fp + fn > 0"))
    return out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "specificity": safe_div(F.col("tn"), F.col("tn") + F.col("fp"))})


def set_f1(gt: Column, pred: Column) -> Column:
    """F1 of two sets; 1 where both are empty."""
    tp = F.size(F.array_intersect(gt, pred))
    return F.when((F.size(gt) == 0) & (F.size(pred) == 0), F.lit(1.0)).otherwise(prf(tp, F.size(F.array_except(pred, gt)), F.size(F.array_except(gt, pred)))[2])


def clip_f1(pairs: DataFrame) -> DataFrame:
    """run_id, n, f1 over all clips, n_special and f1_special over those with a true class."""
    each = pairs.select("run_id", set_f1(F.col("gt"), F.col("pred")).alias("f"), (F.size("gt") > 0).alias("s"))
    return each.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("f1"), F.count_if("s").alias("n_special"), F.avg(F.when(F.col("s"), F.col("f"))).alias("f1_special"))


def class_counts(pairs: DataFrame, tax: Taxonomy, unknown: bool = False) -> DataFrame:
    """run_id, class_name, support, tp, fp, fn: the taxonomy's classes and any other name in use.

    unknown: only catch-all classes; else only the rest.
    """
    chosen = [c for c in tax.groups if (c in tax.unknown) == unknown]
    union = F.array_union("gt", "pred")
    each = pairs.select("run_id", "gt", "pred", F.explode(union).alias("class_name"))
    each = each.where(F.col("class_name").isin(*tax.unknown) if unknown else ~F.col("class_name").isin(*tax.unknown)) if tax.unknown else each
    t, p = F.array_contains("gt", F.col("class_name")), F.array_contains("pred", F.col("class_name"))
    n = each.groupBy("run_id", "class_name").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    zero = pairs.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, chosen))).alias("class_name")).withColumns({c: F.lit(0).cast("bigint") for c in ("tp", "fp", "fn")})
    return n.unionByName(zero).groupBy("run_id", "class_name").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("support", F.col("tp") + F.col("fn"))


def class_prf(pairs: DataFrame, tax: Taxonomy) -> DataFrame:
    """class_counts with precision, recall and f1."""
    return _scored(class_counts(pairs, tax))


def micro_macro(pairs: DataFrame, tax: Taxonomy, min_support: int = 3) -> DataFrame:
    """run_id, micro_f1, macro_f1 (over classes of enough support) and n_classes counted in it."""
    per = class_prf(pairs, tax)
    enough = F.col("support") >= min_support
    sums = per.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg(F.when(enough, F.col("f1"))).alias("macro_f1"), F.count_if(enough).alias("n_classes"))
    return sums.select("run_id", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("micro_f1"), "macro_f1", "n_classes")


def class_lists(pairs: DataFrame) -> DataFrame:
    """run_id, class_name, kind (TP, FP, FN), uuid: the clips behind each class' counts, one row each."""
    kind = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("class_name"), F.lit(k).alias("kind")))
    every = F.concat(kind(F.array_intersect("gt", "pred"), "TP"), kind(F.array_except("pred", "gt"), "FP"), kind(F.array_except("gt", "pred"), "FN"))
    return pairs.select("run_id", "uuid", F.explode(every).alias("e")).select("run_id", "e.class_name", "e.kind", "uuid")


def restrict_to_group(pairs: DataFrame, tax: Taxonomy, group: str) -> DataFrame:
    """Labels only with the classes and the score of one group, for runs that looked for no other."""
    keep = F.array(*[F.lit(c) for c, g in tax.groups.items() if g == group])
    return pairs.withColumns({"gt": F.array_intersect("gt", keep), "gt_scores": F.map_filter("gt_scores", lambda k, _: k == group)})


def restriction_counts(pairs: DataFrame, tax: Taxonomy, group: str) -> DataFrame:
    """run_id, n, n_drop (labelled classes that restricting to a group takes off), n_normal (clips that are left without any)."""
    rows = restrict_to_group(pairs.withColumn("_every", F.size("gt")), tax, group)
    kept = F.size("gt")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_every") - kept).cast("bigint").alias("n_drop"), F.count_if((F.col("_every") > 0) & (kept == 0)).alias("n_normal"))


def class_table(counts: DataFrame, tax: Taxonomy) -> DataFrame:
    """run_id, class_name, group_name, support, tp, fp, fn, place: a run's classes in the order of a report, by group (unknown names
    last), catch-all classes last in theirs, then by support and name."""
    groups = list(dict.fromkeys(tax.groups.values()))
    group = tax.group(F.col("class_name"))
    at = F.nullif(F.array_position(F.array(*map(F.lit, groups)).cast("array<string>"), group), F.lit(0))
    order = Window.partitionBy("run_id").orderBy(at.asc_nulls_last(), F.col("class_name").isin(*tax.unknown), F.desc("support"), "class_name")
    return counts.select("run_id", "class_name", group.alias("group_name"), "support", "tp", "fp", "fn", F.row_number().over(order).alias("place"))


def drop_unknown(pairs: DataFrame, tax: Taxonomy) -> DataFrame:
    """Catch-all classes taken off both sides; a group that has no class left then scores 0.

    gt_dropped and pred_dropped are the groups of the classes that were taken off.
    """
    unknown = F.array(*map(F.lit, sorted(tax.unknown))).cast("array<string>")

    def side(classes: str, scores: str) -> tuple[Column, Column, Column]:
        rest = F.array_except(classes, unknown)
        hit = F.transform(F.array_intersect(classes, unknown), tax.group)
        left = F.transform(rest, tax.group)
        zero = F.transform_values(scores, lambda g, n: F.when(F.array_contains(hit, g) & ~F.coalesce(F.array_contains(left, g), F.lit(False)), F.lit(0)).otherwise(n))
        return rest, zero, F.array_compact(F.array_distinct(hit))

    gt, gs, gd = side("gt", "gt_scores")
    pred, ps, pd = side("pred", "pred_scores")
    return pairs.withColumns({"gt": gt, "gt_scores": gs, "gt_dropped": gd, "pred": pred, "pred_scores": ps, "pred_dropped": pd})


def split_scores(pairs: DataFrame, tax: Taxonomy, own: Sequence[str]) -> DataFrame:
    """run_id, uuid, name, t, p: scores of groups that have classes with a scale of their own (own), apart for these and for the rest ('<group>: Others').

    Truth: the greatest score of the label's other classes of the group, and each own class'
    score, 0 without it; labels without scores by class give none.  Prediction: 0 throughout
    where the group's score is; else the scores by field; where a run kept none, an own class'
    score is read from the reasons ('<class>=2: ...'), and the rest has the group's score if
    that is greater, else it can't be told, nor can anything where a recheck added a class of
    the group.  Of a clip of which a catch-all class was dropped and no other class of the group
    is left the rest scores 0.  pairs: matched with fields, with or without drop_unknown.
    """
    dropped = F.col("pred_dropped") if "pred_dropped" in pairs.columns else F.array().cast("array<string>")
    why = F.coalesce("pred_reason", F.lit(""))
    cells = []
    for g in dict.fromkeys(tax.groups[c] for c in own if c in tax.groups):
        mine = [c for c in own if tax.groups.get(c) == g]
        others = F.array(*[F.lit(c) for c, h in tax.groups.items() if h == g and c not in own]).cast("array<string>")
        truth = F.col("class_scores").isNotNull() & F.map_contains_key("gt_scores", F.lit(g))
        of = lambda c: F.coalesce(F.try_element_at("class_scores", c), F.lit(0))
        rest_t = F.coalesce(F.array_max(F.transform(F.array_intersect("gt", others), of)), F.lit(0))
        m = F.try_element_at("pred_scores", F.lit(g))
        kept = F.col("pred_fields").isNotNull()
        field = lambda name: F.coalesce(F.try_element_at("pred_fields", F.lit(name)), F.lit(0))
        asked = F.exists(F.regexp_extract_all(why, F.lit("recheck (.+?): "), F.lit(1)), lambda x: F.coalesce(tax.group(x) == g, F.lit(False)))  # noqa: B023
        said = {c: F.coalesce(F.regexp_extract(why, rf"(?:^| \| ){re.escape(c)}=([0-9]+):", 1).try_cast("int"), F.lit(0)) for c in mine}
        top = F.greatest(F.lit(0), *said.values())
        none_left = F.array_contains(dropped, g) & (F.size(F.array_intersect("pred", others)) == 0)
        told = lambda by_field, by_reason: F.when(m == 0, 0).when(m.isNotNull() & kept, by_field).when(m.isNotNull() & ~asked, by_reason)  # noqa: B023, E731
        rest_p = told(F.when(none_left, 0).otherwise(field(g)), F.when(none_left, 0).when(top < m, m))
        cells.append((f"{g}: Others", F.when(truth, rest_t), rest_p))
        for c in mine:
            cells.append((c, F.when(truth, F.when(F.array_contains("gt", c), of(F.lit(c))).otherwise(0)), told(field(c), said[c])))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("t"), p.alias("p")) for n, t, p in cells])
    return pairs.select("run_id", "uuid", F.explode(rows).alias("s")).select("run_id", "uuid", "s.*").where("t IS NOT NULL AND p IS NOT NULL")


def folded_scores(fields: Column, classes: Column, tax: Taxonomy, own: Sequence[str] = ()) -> Column:
    """map<string,int> from group to the greatest of its fields' scores (a map by group or class name).

    A field of a class with a scale of its own counts only if the class is named, else as 0;
    fields that name neither a group nor a class don't count.
    """
    groups = list(dict.fromkeys(tax.groups.values()))
    of = lambda k: F.coalesce(F.when(k.isin(*groups), k), tax.group(k))
    counted = lambda e: F.when(e["key"].isin(*own) & ~F.array_contains(classes, e["key"]), 0).otherwise(e["value"]) if own else e["value"]
    each = F.transform(F.map_entries(fields), lambda e: F.struct(of(e["key"]).alias("g"), counted(e).alias("n")))
    best = lambda g: F.array_max(F.transform(F.filter(each, lambda x: x["g"] == g), lambda x: x["n"]))
    found = F.filter(F.array(*[F.struct(F.lit(g).alias("g"), best(g).alias("n")) for g in groups]), lambda x: x["n"].isNotNull())
    return F.map_from_entries(found)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """run_id, uuid, name, t, p: group scores that both sides have."""
    both = F.array_intersect(F.map_keys("gt_scores"), F.map_keys("pred_scores"))
    each = pairs.select("run_id", "uuid", F.explode(F.transform(both, lambda g: F.struct(g.alias("name"), F.element_at("gt_scores", g).alias("t"), F.element_at("pred_scores", g).alias("p")))).alias("s"))
    return each.select("run_id", "uuid", "s.*")


def axis_pairs(pairs: DataFrame) -> DataFrame:
    """run_id, uuid, name, t, p: weather axes that both sides have."""
    rows = F.array(*[F.struct(F.lit(a).alias("name"), F.col(f"gt_{a}").alias("t"), F.col(f"pred_{a}").alias("p")) for a in AXES])
    return pairs.select("run_id", "uuid", F.explode(rows).alias("s")).select("run_id", "uuid", "s.*").where("t IS NOT NULL AND p IS NOT NULL")


def ordinal_block(scores: DataFrame) -> DataFrame:
    """run_id, name: n, mse, exact, within_one, the same without true 0, and the baseline that
    always guesses the most frequent truth (of equally frequent ones the one whose first clip comes first)."""
    per = scores.groupBy("run_id", "name", "t").agg(
        F.count(F.lit(1)).alias("n"), F.min("uuid").alias("first"), F.sum((F.col("t") - F.col("p")) * (F.col("t") - F.col("p"))).alias("sq"),
        F.count_if(F.col("t") == F.col("p")).alias("eq"), F.count_if(F.abs(F.col("t") - F.col("p")) <= 1).alias("near"),
    )
    joined = per.withColumn("mode", F.first("t").over(Window.partitionBy("run_id", "name").orderBy(F.desc("n"), "first")))
    nz = lambda c: F.sum(F.when(F.col("t") != 0, F.col(c)).otherwise(0))
    out = joined.groupBy("run_id", "name").agg(
        F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("mse"), (F.sum("eq") / F.sum("n")).alias("exact"), (F.sum("near") / F.sum("n")).alias("within_one"),
        F.try_divide(nz("eq"), nz("n")).alias("exact_nz"), F.try_divide(nz("near"), nz("n")).alias("within_one_nz"), F.max("mode").alias("mode"),
        (F.sum(F.col("n") * (F.col("t") - F.col("mode")) * (F.col("t") - F.col("mode"))) / F.sum("n")).alias("base_mse"), (F.sum(F.when(F.col("t") == F.col("mode"), F.col("n")).otherwise(0)) / F.sum("n")).alias("base_exact"),
    )
    return out.withColumn("beats", F.col("mse") < F.col("base_mse"))


def confusion(scores: DataFrame, scale: range = range(5)) -> DataFrame:
    """run_id, name, t, p, n over the whole scale, zeros included; total, acc and acc_within_one of the row count predictions inside it."""
    inside = scores.where(F.col("t").isin(*scale) & F.col("p").isin(*scale)).groupBy("run_id", "name", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    cell = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in scale for p in scale])).alias("c")
    zero = scores.select("run_id", "name").distinct().select("run_id", "name", cell).select("run_id", "name", "c.t", "c.p", F.lit(0).cast("bigint").alias("n"))
    full = inside.unionByName(zero).groupBy("run_id", "name", "t", "p").agg(F.sum("n").alias("n"))
    row = Window.partitionBy("run_id", "name", "t")
    total = F.sum("n").over(row)
    share = lambda hit: F.try_divide(F.sum(F.when(hit, F.col("n")).otherwise(0)).over(row), total)
    return full.withColumns({"total": total, "acc": share(F.col("t") == F.col("p")), "acc_within_one": share(F.abs(F.col("t") - F.col("p")) <= 1)})


def axis_summary(scores: DataFrame) -> DataFrame:
    """run_id, name: n, mse, exact, within_one and both means."""
    d = F.col("t") - F.col("p")
    return scores.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((F.abs(d) <= 1).cast("int")).alias("within_one"), F.avg("t").alias("mean_gt"), F.avg("p").alias("mean_pred"))


def conflicts(pairs: DataFrame, tax: Taxonomy) -> DataFrame:
    """run_id, side, name, n: scores that contradict the classes (0 with one, or 1 and more without any)."""

    def side(label: str, classes: str, scores: str) -> Column:
        has = F.transform(classes, tax.group)
        return F.transform(F.map_entries(scores), lambda e: F.struct(F.lit(label).alias("side"), e["key"].alias("name"), F.when((e["value"] == 0) | (e["value"] >= 1), (e["value"] == 0) == F.coalesce(F.array_contains(has, e["key"]), F.lit(False))).otherwise(False).alias("bad")))

    each = pairs.select("run_id", F.explode(F.concat(side("gt", "gt", "gt_scores"), side("pred", "pred", "pred_scores"))).alias("s")).select("run_id", "s.*")
    return each.groupBy("run_id", "side", "name").agg(F.count_if("bad").alias("n"))


def name_drift(pairs: DataFrame, tax: Taxonomy) -> DataFrame:
    """run_id, class_name, in_labels, in_results, in_taxonomy of every name in use that is not in all three."""
    side = lambda c, l, r: pairs.select("run_id", F.explode(c).alias("class_name"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    used = side("gt", True, False).unionByName(side("pred", False, True)).groupBy("run_id", "class_name").agg(F.bool_or("l").alias("in_labels"), F.bool_or("r").alias("in_results"))
    return used.withColumn("in_taxonomy", F.col("class_name").isin(*tax.groups)).where("NOT (in_labels AND in_results AND in_taxonomy)")


def missing_clips(results: DataFrame, labels: DataFrame) -> DataFrame:
    """uuid of labelled clips that no run has."""
    have = results.select(key_text(F.col("uuid")).alias("uuid"))
    return labels.where("class_list IS NOT NULL").select(key_text(F.col("uuid")).alias("uuid")).distinct().join(have, "uuid", "left_anti")


def score_fields(taxonomy: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """field, group_name, place of the scores a model is asked for: each group in order, then those of its classes that have a scale of their own."""
    groups = taxonomy.where("group_name IS NOT NULL").groupBy("group_name").agg(F.min("group_pos").alias("gp")).select(F.col("group_name").alias("field"), "group_name", "gp", F.lit(-1).alias("cp"))
    classes = taxonomy.where(F.col("class_name").isin(*own)).select(F.col("class_name").alias("field"), "group_name", F.col("group_pos").alias("gp"), F.col("class_pos").alias("cp"))
    order = Window.orderBy("gp", "cp", "field")  # the taxonomy is small and fixed
    return groups.unionByName(classes).select("field", "group_name", F.row_number().over(order).alias("place"))
