"""The problem queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.contamination import COVERAGE, MAX_SHARE, find_leaks, remove_leaks
from opslens.llm.credentials import find_credentials, redact_credentials
from opslens.llm.encoding_repair import repair_encoding
from opslens.llm.mixing import mix
from opslens.llm.personal_data import find_personal_data, sanitise
from opslens.llm.scan_repair import find_damage, repair_scans
from opslens.llm.truncation import cut_share, find_cut
from opslens.runtime import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_damage(spread(table(spark, sf_dir, "message_codes")))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its title and body as continuous text."""
    return repair_scans(spread(table(spark, sf_dir, "message_codes")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(spread(table(spark, sf_dir, "artifacts"))).select("id", "line_no")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its credentials masked."""
    return redact_credentials(spread(table(spark, sf_dir, "artifacts")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spread(table(spark, sf_dir, "case_cards"))).select("id", "fld", "pii_type").distinct()


def p5_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card with typed placeholders."""
    return sanitise(spread(table(spark, sf_dir, "case_cards")))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spread(table(spark, sf_dir, "artifacts")).select(F.lit("artifacts").alias("tab"), F.col("id").alias("row_id"), F.col("text_content").alias("body"))
    m = spread(table(spark, sf_dir, "message_codes")).select(F.lit("message_codes").alias("tab"), F.col("entry_id").alias("row_id"), "body")
    return repair_encoding(a.unionByName(m))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("tab", "row_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrongly decoded rows with their restored text."""
    return _decoded(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked stretches."""
    return remove_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), coverage=COVERAGE, max_share=MAX_SHARE)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed set, a row per copy of a document."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix really reaches."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_cut(spread(table(spark, sf_dir, "documents")))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    return cut_share(spread(table(spark, sf_dir, "documents")))


QUERIES = {
    "p2_found": p2_found, "p2_repaired": p2_repaired,
    "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p5_found": p5_found, "p5_sanitised": p5_sanitised,
    "p7_found": p7_found, "p7_restored": p7_restored,
    "p8_found": p8_found, "p8_cleaned": p8_cleaned,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_sources": p10_sources,
}
