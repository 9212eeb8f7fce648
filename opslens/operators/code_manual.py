"""Definitions of message codes from the text of manuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.log_signals import MESSAGE_CODE

# Lines that are no text, and where a definition ends.
NOISE = (r"^\d+/\d+$", r"(?i)^Papyrus\s+Objects\s+.*Messages?$", r"(?i)^DocExec\s+Messages?$", r"(?i)^AFP\s+Resource\s+Messages?$", r"(?i)^Chapter\s+\d+", r"(?i)^Page\s+\d+")
SECTION = r"(?i)^(?:Chapter\s+\d+|Section\s+\d+|\d+\.\d+\s+[A-Z])"
CROSS_REFERENCE = r"(?i)^This message is (?:preceded|followed) by:"
MAX_BODY, MAX_SHOWN = 1500, 800


def severity_of(code: Column) -> Column:
    """Severity from a code's last letter; I for any other."""
    last = F.upper(F.right(code, F.lit(1)))
    return F.when(last.isin("I", "W", "E", "F"), last).otherwise("I")


def definitions(manuals: DataFrame) -> DataFrame:
    """source_path, code, pos, raw: each place where a code begins a line, with the text up to the next such place (manuals: source_path, text)."""
    at_line = rf"(?:^|[\n\r\f])[ \t]*{MESSAGE_CODE}"
    marked = F.regexp_replace("text", at_line, "\x02$1\x03")
    parts = F.split(marked, "\x02")
    # parts[0] stands before the first definition; the others begin with code \x03
    d = manuals.select("source_path", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "part"))
    return d.select("source_path", "pos", F.substring_index("part", "\x03", 1).alias("code"), F.substring(F.substring_index("part", "\x03", -1), 1, MAX_BODY).alias("raw"))


def _body(raw: Column) -> Column:
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    noise = lambda x: (x == "") | x.rlike("|".join(f"(?:{p})" for p in NOISE))
    kept = F.filter(lines, lambda x: ~noise(x))
    stops = F.transform(kept, lambda x: x.rlike(SECTION) | x.rlike(CROSS_REFERENCE))
    end = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)) - 1, F.size(kept))
    return F.slice(kept, F.lit(1), end.cast("int"))


def _shown(body: Column) -> Column:
    """Preamble, reason and solution, each cut and on one line; else the whole on one line."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")
    reason = F.nullif(F.regexp_extract(body, r"(?is)Reason:\s*(.+?)(?=Solution:|\z)", 1), F.lit(""))
    solution = F.nullif(F.regexp_extract(body, r"(?is)Solution:\s*(.+?)(?=Reason:|\z)", 1), F.lit(""))
    low = F.lower(body)
    first = F.least(F.nullif(F.instr(low, "reason:"), F.lit(0)), F.nullif(F.instr(low, "solution:"), F.lit(0))) - 1
    preamble = F.when(first > 10, F.nullif(F.substring(flat(F.substring(body, F.lit(1), first.cast("int"))), 1, 200), F.lit("")))
    parts = F.concat_ws("\n", preamble, F.concat(F.lit("Reason: "), F.substring(flat(reason), 1, 300)), F.concat(F.lit("Solution: "), F.substring(flat(solution), 1, 300)))
    out = F.when(reason.isNotNull() | solution.isNotNull(), parts).otherwise(flat(body))
    return F.when(F.length(out) > MAX_SHOWN, F.concat(F.substring(out, 1, MAX_SHOWN), F.lit("..."))).otherwise(out)


def code_entries(manuals: DataFrame) -> DataFrame:
    """source_path, code, severity, title, body, score (hundredths): the best definition of each code, ties to the first."""
    d = definitions(manuals).withColumn("lines", _body(F.col("raw"))).filter("size(lines) > 0")
    body = F.array_join("lines", "\n")
    first = F.regexp_replace(F.col("lines")[0], r"^[\s\-:]+", "")
    d = d.select("source_path", "code", "pos", F.when((first != "") & (F.length(first) < 120), first).alias("title"), body.alias("whole")).filter("whole != ''")
    low = F.lower("whole")
    score = F.when(F.contains(low, F.lit("reason:")), 300).otherwise(0) + F.when(F.contains(low, F.lit("solution:")), 300).otherwise(0) + F.when(F.col("title").isNotNull(), 100).otherwise(0) + F.least(F.length("whole"), F.lit(500))
    d = d.withColumn("score", score.cast("int"))
    best = d.withColumn("n", F.row_number().over(Window.partitionBy("source_path", "code").orderBy(F.desc("score"), "pos"))).filter("n = 1")
    return best.select("source_path", "code", severity_of(F.col("code")).alias("severity"), "title", _shown(F.col("whole")).alias("body"), "score")
