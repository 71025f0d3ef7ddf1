"""Second questions: which clips to ask about, and what their answers change."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.packed import pack_in_order, parse_packed, split_classes
from reelgrid.operators.evaluate import MAX_CLASSES
from reelgrid.operators.merge import keep_last


def candidates(best: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """run_id, uuid, class_name: parsed clips without classes whose texts match a keyword of a class.

    Keywords are patterns, matched in any letter case.  The taxonomy is small and fixed;
    each class becomes one expression, so clips and classes aren't joined.
    """
    dims = taxonomy.where("class_name IS NOT NULL AND size(recheck_keywords) > 0").select("class_name", "recheck_keywords").limit(MAX_CLASSES + 1).collect()
    if len(dims) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("observation", "unusual_elements", "ego_behavior")])
    rows = best.where((F.col("n_frames") > 0) & (F.col("parse_ok") == 1) & (F.trim(F.coalesce("classes", F.lit(""))) == "")).select("run_id", "uuid", text.alias("text"))
    hits = [F.when(F.col("text").rlike("(?i)" + "|".join(f"(?:{k})" for k in d.recheck_keywords)), F.lit(d.class_name)) for d in dims]
    return rows.select("run_id", "uuid", F.explode(F.array_compact(F.array(*hits))).alias("class_name"))


def open_questions(best: DataFrame, taxonomy: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates that have no answer yet."""
    return candidates(best, taxonomy).join(answers.select("run_id", "uuid", "class_name"), ["run_id", "uuid", "class_name"], "left_anti")


def apply_answers(best: DataFrame, answers: DataFrame, min_score: int = 2, own: Collection[str] = (), with_scores: bool = True) -> DataFrame:
    """best with accepted answers worked in: classes appended, scores raised, verdict Special, reasons added.

    Of a question's answers the last counts (by shard, time, id).  A score raises its group's
    and, where best has field_scores, its field's: the class' own field if it is one of own,
    else the group's.  Scores keep the order in which they stand.  with_scores=False is for
    runs without scores: every answer that finds its class counts, and scores aren't touched.
    It is always computed from the unpatched rows, so applying it twice changes nothing more.
    """
    last = keep_last(answers.select("run_id", "uuid", "class_name", "group_name", "present", "score", "reason", "shard_no", "answered_at", "answer_id"), ["run_id", "uuid", "class_name"], [F.col("shard_no"), F.col("answered_at"), F.col("answer_id")])
    yes = last.where(F.col("present") & (F.col("score") >= min_score) if with_scores else F.col("present"))
    field = F.when(F.col("class_name").isin(*own), F.col("class_name")).otherwise(F.col("group_name")) if own else F.col("group_name")
    hit = F.struct("answer_id", "class_name", "group_name", field.alias("field"), "score", "reason")
    # a clip's answers are at most one for each class
    grouped = yes.groupBy("run_id", "uuid").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    rows = best.join(grouped, ["run_id", "uuid"], "left")
    some = F.col("hits").isNotNull()
    names = F.array_distinct(F.concat(split_classes(F.col("classes")), F.transform("hits", lambda h: h["class_name"])))

    def raised(column: str, key: str) -> Column:
        old = parse_packed(F.col(column))
        keys = F.array_union(F.map_keys(old), F.array_compact(F.transform("hits", lambda h: h[key])))
        best_of = lambda k: F.array_max(F.transform(F.filter("hits", lambda h: h[key] == k), lambda h: h["score"]))
        return F.when(some, F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.greatest(F.try_element_at(old, k), best_of(k))))))

    reasons = F.concat_ws(" | ", F.nullif("score_reason", F.lit("")), F.array_join(F.transform("hits", lambda h: F.concat(F.lit("recheck "), h["class_name"], F.lit(": "), F.coalesce(h["reason"], F.lit("")))), " | "))
    change = {"classes": F.array_join(names, "|"), "n_classes": F.size(names), "verdict": F.lit("Special"), "score_reason": reasons}
    if with_scores:
        rows = rows.withColumn("_groups", raised("group_scores", "group_name"))
        change |= {"group_scores": pack_in_order(F.col("_groups")), "tier_score": F.array_max(F.filter(F.map_values("_groups"), lambda v: v.between(0, 4)))}
        if "field_scores" in best.columns:
            change["field_scores"] = pack_in_order(raised("field_scores", "field"))
    return rows.select(*[F.when(some, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in best.columns])
