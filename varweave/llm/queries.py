"""Queries of the training-data operators over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varweave.llm import oracles
from varweave.llm.grouping import connected_groups
from varweave.llm.languages import document_languages, language_findings
from varweave.llm.leakage import leaked_documents
from varweave.llm.near_duplicates import near_duplicate_pairs, sv_type
from varweave.llm.packing import pack_documents
from varweave.llm.survivors import criteria_worth, merged_records, sequence_worth, surviving_values
from varweave.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different files that describe one event."""
    return near_duplicate_pairs(read(spark, sf_dir, "approx"), sv_type(F.col("kind")))


def _variant_key() -> Column:
    return F.regexp_replace("variant_id", r"^[ \t]+|[ \t]+\z", "")


def _worths() -> dict[str, Column]:
    return {"alt_seq": sequence_worth(F.col("alt_seq")), "criteria": criteria_worth(F.col("criteria"))}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variant and field, the record whose value survives."""
    found = surviving_values(read(spark, sf_dir, "merge_rows"), _variant_key(), _worths(), F.col("called_at"), [F.col("vix_ix"), F.col("row_id")])
    return found.select(F.col("__key").alias("variant_id"), "field", "row_id")


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per variant: the surviving alt_seq and criteria, and the other fields filled from successive layers."""
    carried = ["kind", "chrom", "start", "length", "called_at"]
    return merged_records(
        read(spark, sf_dir, "merge_rows"), _variant_key(), "variant_id", _worths(), carried, F.col("called_at"), [F.col("vix_ix"), F.col("row_id")]
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matched record with the smallest key of its linked group."""
    groups = connected_groups(read(spark, sf_dir, "union_pairs"), "lhs_row_key", "rhs_row_key")
    return groups.select(F.col("key").alias("row_key"), F.col("group").alias("new_row_key"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token of every document goes: container, document, part, first token, tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaked_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, and stretches of other languages."""
    return language_findings(document_languages(read(spark, sf_dir, "documents")))


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and stretch with its language and confidence."""
    return document_languages(read(spark, sf_dir, "documents")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_merged, p4_found, p7_packed, p8_found, p9_found, p9_languages)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
