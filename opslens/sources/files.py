"""Files of a tree as tables: snapshot scan, whole texts, logs as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators.stats import MAX_TEXT, NO_TEXT_SUFFIXES, SUFFIX_KIND, TEXT_SUFFIXES

SCAN_DIRS = ("procs", "master", "control", "insert", "docdef")


def scan(spark: SparkSession, root: str, dirs: tuple[str, ...] = SCAN_DIRS) -> DataFrame:
    """path (relative), kind, mtime, size, failed, text_content, sha256 of the files below the scanned folders.

    Text is kept of small text files that are valid UTF-8; the hash only where text is kept.
    ``failed`` are those whose text should be kept and could not be read.
    Spark's file sources leave empty files out.
    """
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{{{','.join(dirs)}}}")
    rel = F.regexp_extract(F.col("path"), rf".*?{root.rsplit('/', 1)[-1]}/((?:{'|'.join(dirs)})/.*)$", 1)
    d = raw.select(rel.alias("path"), F.unix_micros("modificationTime").alias("us"), F.col("length").alias("size"), "content")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    kind = F.split("path", "/")[0]
    for s, k in SUFFIX_KIND:
        kind = F.when(suffix == s, k).otherwise(kind)
    low = F.lower(suffix)
    keeps = (F.col("size") <= MAX_TEXT) & ~low.isin(*NO_TEXT_SUFFIXES) & (low.isin(*TEXT_SUFFIXES) | (low == ""))
    text = F.when(keeps, F.expr("try_validate_utf8(cast(content as string))"))
    d = d.select("path", kind.alias("kind"), (F.col("us") / 1e6).alias("mtime"), "size", text.alias("text_content"), keeps.alias("keeps"), "content")
    d = d.select("path", "kind", "mtime", "size", (F.col("keeps") & F.col("text_content").isNull()).alias("failed"), "text_content", "content")
    return d.withColumn("sha256", F.when(F.col("text_content").isNotNull(), F.sha2("content", 256))).drop("content")


def texts(spark: SparkSession, folder: str, *patterns: str, recursive: bool = False) -> DataFrame:
    """doc_id (path) and text of the files of a folder that have one of the patterns (*.txt and *.md by default).

    A pattern that begins with ``**/`` is looked for in all folders below. Bytes that are no
    UTF-8 become replacement characters.
    """
    patterns = patterns or ("*.txt", "*.md")
    deep = recursive or any(p.startswith("**/") for p in patterns)
    glob = "{" + ",".join(p.removeprefix("**/") for p in patterns) + "}"
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower())
    return r.load(folder).select(F.col("path").alias("doc_id"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def log_lines(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """log_path, line_no (from 1), line of the log files below a folder."""
    whole = texts(spark, folder, pattern, recursive=True)
    lines = F.posexplode(F.split(F.regexp_replace("text", r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n"))
    d = whole.select(F.col("doc_id").alias("log_path"), F.length("text").alias("n"), lines.alias("i", "line"), F.col("text").endswith("\n").alias("ended"), F.size(F.split("text", "\n")).alias("k"))
    return d.filter("not (ended and i = k - 1 and line = '')").select("log_path", (F.col("i") + 1).cast("long").alias("line_no"), "line")
