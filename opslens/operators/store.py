"""Upserts into the store's tables as set operations, and the look-up of codes.

Every merge works on old rows and a batch with a key: partial aggregation picks the row
that counts, so repeated keys in a batch need no window over a hot key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators.log_signals import log_tokens


def last_wins(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row per key: the one with the latest ``at`` (ties: the greatest row)."""
    rest = [c for c in rows.columns if c not in key]
    row = F.max(F.struct(F.col(at).alias("__at"), *rest)).alias("__r")
    return rows.groupBy(*key).agg(row).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upsert_incidents(updates: DataFrame) -> DataFrame:
    """log_path, top_node_key, confidence, created_at, updated_at, n_updates: incident updates applied in order of time.

    The first update creates the incident, the last gives its values; exact repeats count once.
    """
    return as_incidents(incident_state(updates.select("log_path", "top_node_key", "confidence", "at", "loaded_at").distinct()))


def incident_state(updates: DataFrame) -> DataFrame:
    """log_path, created_at, l (the last update), n_updates of updates without repeats."""
    key = F.struct("at", "loaded_at", "top_node_key", "confidence")
    return updates.groupBy("log_path").agg(F.min("at").alias("created_at"), F.max(key).alias("l"), F.count("*").alias("n_updates"))


def merged_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two states of incidents as one."""
    return old.unionByName(new).groupBy("log_path").agg(F.min("created_at").alias("created_at"), F.max("l").alias("l"), F.sum("n_updates").alias("n_updates"))


def as_incidents(state: DataFrame) -> DataFrame:
    return state.select("log_path", F.col("l.top_node_key").alias("top_node_key"), F.col("l.confidence").alias("confidence"), "created_at", F.when(F.col("n_updates") > 1, F.col("l.at")).alias("updated_at"), "n_updates")


def merge_cards(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_path, chunk_id, action and the card's columns after the merge; equal hashes leave the old card."""
    key = ["source_path", "chunk_id"]
    cols = [c for c in new.columns if c not in key]
    o = last_wins(old, key, "created_at").select(*key, F.struct(*cols).alias("o"))
    n = last_wins(new, key, "created_at").select(*key, F.struct(*cols).alias("n"))
    j = o.withColumnRenamed("source_path", "sp").withColumnRenamed("chunk_id", "ch").join(n, F.col("sp").eqNullSafe(F.col("source_path")) & F.col("ch").eqNullSafe(F.col("chunk_id")), "full")
    same = F.col("o.content_hash") == F.col("n.content_hash")
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(same, "same").otherwise("updated")
    pick = [F.when(action.isin("kept", "same"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in cols if c != "created_at"]
    created = F.coalesce("o.created_at", "n.created_at").alias("created_at")
    stamped = F.when(action == "updated", F.col("n.created_at")).alias("updated_at")
    return j.select(F.when(F.col("n").isNull(), F.col("sp")).otherwise(F.col("source_path")).alias("source_path"), F.when(F.col("n").isNull(), F.col("ch")).otherwise(F.col("chunk_id")).alias("chunk_id"), action.alias("action"), *pick, created, stamped)


def import_counts(merged: DataFrame) -> DataFrame:
    """inserted, updated, skipped of a merge; a card of equal hash counts as updated, as the importer reports it."""
    a = F.col("action")
    return merged.agg(F.count_if(a == "inserted").alias("inserted"), F.count_if(a.isin("updated", "same")).alias("updated"), F.count_if(a == "kept").alias("kept"))


def upsert_codes(codes: DataFrame) -> DataFrame:
    """One row per (code, source_path): the one imported last."""
    return last_wins(codes, ["code", "source_path"], "created_at")


def best_codes(codes: DataFrame) -> DataFrame:
    """One row per code: the latest import, then the greatest source."""
    return codes.filter("code is not null").groupBy("code").agg(F.max(F.struct("created_at", "source_path", "entry_id", "severity", "title", "body")).alias("m")).select("code", "m.*")


def decode_log_codes(lines: DataFrame, codes: DataFrame, top: int = 10, tokens: DataFrame | None = None) -> DataFrame:
    """log_path, place, code, severity, title of the codes that a log shows and the manuals explain: fatal, error, other; ``top`` at most."""
    from pyspark.sql import Window

    tokens = log_tokens(lines) if tokens is None else tokens
    shown = tokens.filter("kind = 'error_code'").select("log_path", F.col("token").alias("code"))
    d = shown.filter(F.col("code").rlike(r"(?i)^(PP[A-Z]{2}\d{4}[A-Z]|AFPR\d{4}[A-Z])$")).join(best_codes(codes).select("code", "severity", "title"), "code")
    last = F.right("code", F.lit(1))
    rank = F.when(last == "F", 0).when(last == "E", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("log_path").orderBy(rank, "code")).cast("int")
    return d.withColumn("place", place).filter(F.col("place") <= top)


def _path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, as the cluster is set up, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a table beside its place and swaps it in whole; on failure the old one stays. Any file system that Spark reaches."""
    spark = df.sparkSession
    stage = f"{path}.{uuid.uuid4().hex}"
    try:
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(stage)
        fs, to = _path(spark, path)
        fresh, old = _path(spark, stage)[1], _path(spark, f"{stage}.old")[1]
        had = fs.exists(to)
        if had and not fs.rename(to, old):
            raise OSError(f"cannot move {path}")
        if not fs.rename(fresh, to):
            if had:
                fs.rename(old, to)
            raise OSError(f"cannot put a table to {path}")
        fs.delete(old, True)
    finally:
        remove_folder(spark, stage)
