"""All queries of the engine's core, and the SQL they are checked against.

Means and shares are rounded on both sides, as sums of doubles depend on the order of
their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.plans import evaluation, problems, reports, store

MODULES = [evaluation, reports, store, problems]
DIGITS = 6
#: Columns of each query that are means, shares or other quotients.
QUOTIENTS: dict[str, str] = {
    "verdict_metrics": "precision recall f1 accuracy specificity",
    "clip_f1": "f1 f1_special",
    "class_prf": "precision recall f1",
    "micro_macro_f1": "micro_f1 macro_f1",
    "group_restricted_prf": "precision recall f1",
    "unknown_dropped_verdict": "precision recall f1 accuracy specificity",
    "ordinal_block": "mse exact within_one exact_nz within_one_nz base_mse base_exact",
    "pooled_ordinal": "mse exact within_one exact_nz within_one_nz base_mse base_exact",
    "confusion": "acc acc_within_one",
    "split_scores": "mse exact within_one exact_nz within_one_nz base_mse base_exact",
    "axis_summary": "mse exact within_one mean_gt mean_pred",
    "axis_ordinal": "mse exact within_one exact_nz within_one_nz base_mse base_exact",
    "distribution": "mean var std median",
    "score_counts": "share_rated share_all",
    "class_frequency_cli": "share_all share_special",
    "class_frequency_gui": "share_all share_special",
    "overview": "mean_classes",
    "ego_summary": "span_s speed_start speed_end speed_min speed_max min_ax max_ax t_min_ax t_speed_min stopped_s heading_delta",
    "ego_coverage": "percent_store percent_mirror",
    "unwrap_heading": "turn heading",
    "ego_window_join": "speed",
    "asof_backward": "speed",
    "asof_forward": "speed",
    "future_horizon": "travelled",
    "path_gradient": "slope",
    "attention_ratio": "ratio",
    "spatial_means": "mean",
    "decision_margin": "margin_min margin_mean",
}


def _rounded(f: Callable[[SparkSession, str], DataFrame], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(spark, sf).withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {name: f for m in MODULES for name, f in m.QUERIES.items()}
    return {name: _rounded(f, QUOTIENTS[name].split()) if name in QUOTIENTS else f for name, f in every.items()}


def oracle_sql() -> dict[str, str]:
    every = {name: q for m in MODULES for name, q in m.SQL.items()}
    put = lambda columns: ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in columns.split())
    return {name: f"SELECT * REPLACE ({put(QUOTIENTS[name])}) FROM ({q})" if name in QUOTIENTS else q for name, q in every.items()}
