"""What changed between consecutive full snapshots.

The rows of each snapshot are sorted by key and cut into chunks at content-defined
boundaries: a key whose hash is divisible by ``CHUNK_ROWS`` opens a chunk, in whichever
snapshot it stands. Chunks are compared by a 128-bit digest of (key, content token);
equal chunks of two consecutive snapshots are discarded whole, and only the rows of the
others meet in an exact comparison by key.

Defined results
  null path or snapshot    the row names no file and is left out
  several rows of a path   the latest loaded_at counts (ties: greater sha256, then mtime)
  null hash on a side      floor(mtime) decides; two null mtimes are equal, one is not
  a missing snapshot       no pair: k is compared with k - 1 only
  empty table              empty result
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.paths import plain_path
from opslens.runtime import checkpointed

#: Rows that a chunk holds on average.
CHUNK_ROWS = 64


def latest_files(artifacts: DataFrame) -> DataFrame:
    """One row per (snapshot_no, path): path in its plainest form, sha (lower case), mt (whole seconds)."""
    version = F.struct(
        F.col("loaded_at").alias("at"),
        F.lower(F.trim("sha256")).alias("sha"),
        F.floor("mtime").cast("long").alias("mt"),
    )
    rows = artifacts.select("snapshot_no", plain_path(F.col("path")).alias("path"), version.alias("v"))
    rows = rows.filter("snapshot_no is not null and path is not null")
    return rows.groupBy("snapshot_no", "path").agg(F.max("v").alias("v")).select("snapshot_no", "path", F.nullif("v.sha", F.lit("")).alias("sha"), "v.mt")


def with_chunks(files: DataFrame) -> DataFrame:
    """Adds ``chunk``: the greatest boundary key at or below the row's key within its key range.

    All snapshots share the same key ranges, so a range start bounds chunks in each of them.
    """
    parts = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = files.repartitionByRange(int(parts), "path").withColumn("range_no", F.spark_partition_id())
    ranged = checkpointed(ranged)  # range numbers must not move when a task runs again
    opens = F.pmod(F.xxhash64("path"), F.lit(CHUNK_ROWS)) == 0
    run = Window.partitionBy("range_no", "snapshot_no").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("chunk", F.coalesce(F.last(F.when(opens, F.col("path")), ignorenulls=True).over(run), F.lit("")))


def chunk_digests(chunked: DataFrame) -> DataFrame:
    """Row count and digest of each (range_no, chunk, snapshot_no)."""
    token = F.coalesce(F.col("sha"), F.concat(F.lit("@"), F.coalesce(F.col("mt").cast("string"), F.lit("?"))))
    first = F.bit_xor(F.xxhash64("path", token))
    second = F.bit_xor(F.xxhash64(F.lit(7), token, "path"))
    return chunked.groupBy("range_no", "chunk", "snapshot_no").agg(F.count("*").alias("n"), first.alias("d1"), second.alias("d2"))


def unmatched_sides(chunked: DataFrame) -> DataFrame:
    """(range_no, chunk, snapshot_no, ahead, behind): chunks to compare with the snapshot before and after."""
    by_chunk = Window.partitionBy("range_no", "chunk").orderBy("snapshot_no")
    same = F.struct("n", "d1", "d2")

    def differs(step: int) -> Column:
        number, value = F.lag("snapshot_no", step).over(by_chunk), F.lag(same, step).over(by_chunk)
        return ~F.coalesce((number == F.col("snapshot_no") - step) & (value == same), F.lit(False))

    sides = chunk_digests(chunked).select("range_no", "chunk", "snapshot_no", differs(1).alias("behind"), differs(-1).alias("ahead"))
    return sides.filter("behind or ahead")


def snapshot_changes(artifacts: DataFrame) -> DataFrame:
    """snapshot_no, path, change (added, removed, changed) against the snapshot before.

    ``artifacts``: snapshot_no, path, sha256, mtime, loaded_at; other columns are ignored.
    """
    chunked = with_chunks(latest_files(artifacts))
    rows = chunked.join(unmatched_sides(chunked), ["range_no", "chunk", "snapshot_no"])
    now = rows.filter("behind").select(F.col("snapshot_no").alias("pair"), "path", F.lit(True).alias("is_now"), F.struct("sha", "mt").alias("v"))
    before = rows.filter("ahead").select((F.col("snapshot_no") + 1).alias("pair"), "path", F.lit(False).alias("is_now"), F.struct("sha", "mt").alias("v"))
    # one row per snapshot
    numbers = artifacts.select("snapshot_no").distinct()
    pairs = numbers.join(numbers.select((F.col("snapshot_no") + 1).alias("snapshot_no")), "snapshot_no").select(F.col("snapshot_no").alias("pair"))
    both = (
        now.unionByName(before)
        .join(pairs, "pair", "left_semi")
        .groupBy("pair", "path")
        .agg(F.max(F.when(F.col("is_now"), F.col("v"))).alias("new"), F.max(F.when(~F.col("is_now"), F.col("v"))).alias("old"))
    )
    hashes = F.col("new.sha").isNotNull() & F.col("old.sha").isNotNull()
    moved = F.when(hashes, F.col("new.sha") != F.col("old.sha")).otherwise(~F.col("new.mt").eqNullSafe(F.col("old.mt")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(moved, "changed")
    return both.select(F.col("pair").cast("int").alias("snapshot_no"), "path", change.alias("change")).filter("change is not null")
