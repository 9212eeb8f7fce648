"""Change reports: their header, and diffs up to a size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.textexpr import found

#: Characters of all diffs and of one.
MAX_TOTAL, MAX_FILE = 200_000, 60_000
CODE_SUFFIXES = ("dfa", "sh", "pl", "py", "procs", "control", "ovl", "ins", "lis", "300")


def report_header(reports: DataFrame) -> DataFrame:
    """report_id, description, parallel_id, files of reports (report_id, text): numbered lines behind 'Files:' up to a line with '*'."""
    t = F.col("text")
    block = F.regexp_extract(t, r"(?m)^\s*Files:[ \t]*\n((?:(?!\s*\*).*(?:\n|\z))*)", 1)
    files = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*\d+\)\s*(.+?)\s*$"), F.lit(1)), lambda x: F.trim(x))
    return reports.select("report_id", F.trim(F.coalesce(found(t, r"(?m)^\s*Description:\s*(.+)$"), F.lit(""))).alias("description"), F.coalesce(found(t, r"(?m)^\s*Parallel ID:\s*(\S+)"), F.lit("")).alias("parallel_id"), files.alias("files"))


def capped_diffs(diffs: DataFrame, suffixes: tuple[str, ...] = CODE_SUFFIXES, max_total: int = MAX_TOTAL, max_file: int = MAX_FILE) -> DataFrame:
    """change_id, file, state (taken, truncated, other_type, empty, over_total), size of each diff (change_id, ord, file, diff).

    Diffs are taken in order as long as they fit; one that does not is skipped and later ones
    may still fit, so the sizes (not the texts) of a change are walked in order, with a running
    total as the only state.
    """
    suffix = F.when(F.contains("file", F.lit(".")), F.lower(F.substring_index("file", ".", -1))).otherwise("")
    diffs = diffs.withColumn("diff", F.coalesce("diff", F.lit("")))
    size = F.least(F.length("diff"), F.lit(max_file))
    kind = F.when(~suffix.isin(*suffixes), "other_type").when(F.trim(F.translate("diff", "\n\t\r", "   ")) == "", "empty").when(F.length("diff") > max_file, "truncated").otherwise("taken")
    rows = diffs.select("change_id", "ord", "file", size.alias("size"), F.coalesce(kind, F.lit("other_type")).alias("kind"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in ("change_id", "ord", "file")) + ", size int, state string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # changes follow each other, each in order; one total is all that is kept
        change, total = object(), 0
        for pdf in batches:
            states = []
            for c, n, k in zip(pdf["change_id"], pdf["size"], pdf["kind"], strict=True):
                c = None if pd.isna(c) else c
                if c != change:
                    change, total = c, 0
                if k in ("taken", "truncated"):
                    if total + n > max_total:
                        k = "over_total"
                    else:
                        total += n
                states.append(k)
            yield pdf[["change_id", "ord", "file", "size"]].assign(state=states)

    return rows.repartition("change_id").sortWithinPartitions("change_id", "ord", "file", "size", "kind").mapInPandas(run, schema)
