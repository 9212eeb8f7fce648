"""Where things lie: folders by convention, manuals, change folders, workspaces."""

from __future__ import annotations

import glob
import os
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.textexpr import base_name


def first_existing(paths: list[str | None]) -> str | None:
    return next((p for p in paths if p and os.path.exists(p)), None)


def histories_folder(snapshot: str, explicit: str | None = None) -> str | None:
    """The given folder if it exists, else the first of the usual ones of a snapshot and of its parent."""
    if explicit:
        return first_existing([explicit])
    up = os.path.dirname(snapshot.rstrip("/"))
    return first_existing([os.path.join(base, *sub) for base in (snapshot, up) for sub in (("histories",), ("refs", "histories"))])


def manual_file(snapshot: str, explicit: str | None = None, configured: str | None = None, defaults: tuple[str, ...] = ()) -> str | None:
    """The given manual if it exists, else the first PDF of the snapshot's references, the configured one, a default."""
    if explicit:
        return first_existing([explicit])
    own = sorted(glob.glob(os.path.join(snapshot, "refs", "*", "*.pdf")))
    return first_existing([*own, configured, *defaults])


def pdf_text(path: str) -> str:
    """Text of a PDF; needs the optional package pdfminer."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pdfminer; give the text instead") from e
    return extract_text(path)


def change_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Diffs (change_id, ord, file, diff) and reports (report_id, text) of a folder of *.diff and *.txt files."""
    name = os.path.basename(folder.rstrip("/"))
    files = sorted(glob.glob(os.path.join(folder, "*.diff")))
    order = spark.createDataFrame([(os.path.basename(f), i) for i, f in enumerate(files)], "file string, ord long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.diff").load(folder)
    raw = raw.select(base_name(F.col("path")).alias("file"), F.col("content").cast("string").alias("diff"))
    diffs = raw.join(order, "file").select(F.lit(name).alias("change_id"), "ord", F.regexp_replace("file", r"\.diff$", "").alias("file"), "diff")
    report = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select(F.col("path").alias("report_id"), F.col("content").cast("string").alias("text"))
    return diffs, report.orderBy("report_id").limit(1)  # the first report is the change's


#: Where a bundle's files go in a workspace.
PLACES = (("procs", "procs"), ("script", "master"), ("master", "master"), ("insert", "insert"), ("control", "control"), ("docdef", "docdef"))


def workspace_manifest(bundle: DataFrame) -> DataFrame:
    """kind, src, dst of each file of a bundle: what a workspace would copy."""
    place = F.lit("other")
    for kind, folder in PLACES:
        place = F.when(F.col("kind") == kind, folder).otherwise(place)
    return bundle.select("kind", F.col("path").alias("src"), F.concat(F.lit("code/"), place, F.lit("/"), base_name("path")).alias("dst")).distinct()


def safe_name(text: str) -> str:
    """A text as one path component; raises ValueError where nothing is left."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", text).lstrip(".")
    if not out.strip("._"):
        raise ValueError(f"no usable name in {text!r}")
    return out


def inside(folder: str, path: str) -> bool:
    """Whether a path lies in a folder."""
    root = os.path.realpath(folder)
    return os.path.commonpath([root, os.path.realpath(os.path.join(root, path))]) == root


def snapshots(root: str) -> list[str]:
    """Names of the snapshots of a folder, sorted."""
    return sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)))


def age_note(then: datetime, now: datetime) -> str | None:
    """WARN over 30 days, INFO over 7, else None."""
    days = (now - then).days
    return "WARN" if days > 30 else "INFO" if days > 7 else None
