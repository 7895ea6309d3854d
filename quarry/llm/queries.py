"""Registered queries of the numbered problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import docpairs, handwritten, leakage, packing, pieces, secrets, subjects, unparsable
from quarry.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credential_lines(table(spark, sf_dir, "nodes"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "nodes"))


def p3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "nodes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_verdicts(spark, sf_dir).select("repo", "relative_path")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_ids(table(spark, sf_dir, "nodes"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented(table(spark, sf_dir, "nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "chunks"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.unparsable(table(spark, sf_dir, "files"), table(spark, sf_dir, "nodes"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "nodes"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p7_packed(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("item_id", "doc_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.cleaned(table(spark, sf_dir, "documents"), p8_leaks(spark, sf_dir))


def p9_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scored(spark, sf_dir).select("doc_id", "subject")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.shares(p9_scored(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_verdicts": p3_verdicts,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_packed": p7_packed,
    "p7_summary": p7_summary,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_cleaned": p8_cleaned,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

SQL: dict[str, str] = {
    # A chunk is cut exactly when it is over the limit, so SQL can say which; how it is cut it can't.
    "p5_found": "SELECT chunk_id FROM chunks WHERE greatest(1, length(full_body) // 4) > 512",
}
