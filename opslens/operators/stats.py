"""Counts of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a scan makes of folders and suffixes, and which files keep their text.
SUFFIX_KIND = ((".procs", "procs"), (".sh", "script"), (".pl", "script"), (".py", "script"), (".control", "control"), (".ins", "insert"), (".dfa", "docdef"), (".DFA", "docdef"))
TEXT_SUFFIXES = (".procs", ".sh", ".pl", ".py", ".control", ".ins", ".txt", ".md", ".cfg", ".conf", ".ini", ".sql", ".dfa")
NO_TEXT_SUFFIXES = (".afp", ".pdf", ".zip", ".pgp", ".log")
MAX_TEXT = 1_048_576


def classify(files: DataFrame) -> DataFrame:
    """id, path, suffix, kind, keeps_text of files (id, path, size): kind by suffix (letter case counts), else by folder."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    d = files.select("id", "path", "size", suffix.alias("suffix"), F.split("path", "/")[0].alias("folder"))
    kind = F.col("folder")
    for s, k in SUFFIX_KIND:
        kind = F.when(F.col("suffix") == s, k).otherwise(kind)
    low = F.lower("suffix")
    keeps = (F.col("size") <= MAX_TEXT) & ~low.isin(*NO_TEXT_SUFFIXES) & (low.isin(*TEXT_SUFFIXES) | (low == ""))
    return d.select("id", "path", "suffix", kind.alias("kind"), F.coalesce(keeps, F.lit(False)).alias("keeps_text"))


def scan_counts(files: DataFrame) -> DataFrame:
    """kind, scanned, with_text, parsed per kind of file."""
    return classify(files).groupBy("kind").agg(F.count("*").alias("scanned"), F.count_if("keeps_text").alias("with_text"), F.count_if(F.col("suffix") == ".procs").alias("parsed"))


def artifact_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"))


def kind_families(files: DataFrame) -> DataFrame:
    """family, n: scripts and master files together."""
    family = F.when(F.col("kind").isin("script", "master"), "scripts").when(F.col("kind") == "control", "controls").when(F.col("kind") == "insert", "inserts").when(F.col("kind") == "logs_inbox", "logs").otherwise(F.col("kind"))
    return files.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def content_hash(files: DataFrame) -> DataFrame:
    """id, sha256 of the text, and its first 16 digits as the chunk hash."""
    sha = F.sha2(F.col("text_content").cast("binary"), 256)
    return files.filter("text_content is not null").select("id", sha.alias("text_sha256"), F.substring(sha, 1, 16).alias("chunk_hash"))


def recent_incidents(incidents: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` incidents that changed last."""
    return incidents.orderBy(F.coalesce("updated_at", "created_at").desc(), "log_path").limit(top)


def recent_cards(cards: DataFrame, top: int = 5) -> DataFrame:
    return cards.orderBy(F.desc("created_at"), "id").limit(top).select("id", "title", "source_path", "created_at")
