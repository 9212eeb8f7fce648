"""Signals of log lines, their roll-up per log, and what a log's path says.

Lines that say a process is (no longer) alive and blank lines carry no signal. Null lines
are blank. An error keyword makes a line an error even if its code is fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.textexpr import found, found_all, literals_of, matches, strip
from opslens.rules import RULES

# The patterns that lines are searched with.
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}/\d{2}:\d{2}:\d{2}\.\d{3})"
MESSAGE_CODE = r"((?:PP(?:CS|DE|ST|CO|AP|DG|TP|WM|FP|EM)|AFPR)\d{4}[IWEF])"
ORA_CODE = r"(ORA-\d{5})"
SOURCE_REF = r"\[([^,\]]+\.cpp),(\d+)\]"
DOCDEF_REF = r"DOCDEF '(\w+)'"
SCRIPT_LINE = r"(?i)(\w+\.(?:pl|sh|py))\s+line\s+(\d+)"
ERROR_WORD = r"(?i)\b(ERROR|FAIL|failed|FAILED|exception|mismatch|missing|abort|aborted)\b"
PREFIX_TOKEN = r"\$PREFIX=(\w+)"
JID_TOKEN = r"\$JID=(\w+)"
SCRIPT_PATH = r"(/home/(?:master|insert|util)/[\w\-\.]+\.(?:sh|pl|py|ins))"
DOCDEF_PARAM = r"(?i)docdef=(\w+)"
IO_PATH = r"(?i)(?:input|output|profile)=([^\s]+)"
DOCDEF_TOKEN = r"\b([A-Z]{4}[A-Z]{2}\d{2})\b"
WRAPPER = r"(?i)ERROR:\s*Generator returns a non-zero value"
STRONG_FAILURE = (
    r"(?i)aborted", r"(?i)not generated", r"ORA-\d{5}", r"(?i)missing\s+(?:input|file|docdef)", r"(?i)Permission denied",
    r"(?i)No such file", r"(?i)cannot open", r"(?i)failed to open", r"[IWEF]\d{4}F\b",
)
ERROR_SIGNATURES = (
    r"ORA-\d{5}", r"(?i)missing file_id", r"(?i)Permission denied", r"(?i)No such file", r"(?i)timeout",
    r"(?i)Total number of accounts do not match", r"(?i)Error line \d+ has", r"(?i)CSV file .+ is bad",
    r"PP[A-Z]{2}\d{4}[EF]", r"AFPR\d{4}[EF]", r"(?i)Failed in \w+", r"(?i)Error within program", r"(?i)did not parse all XML",
    r"(?i)can not open .+ for reading", r"(?i)missing file_size", r"(?i)error reading the \.zip contents",
    r"(?i)was not detected in ISD INCOMING_FILE table", r"(?i)No data file in directory for \w+", r"(?i)No Paperless file found",
    r"(?i)Error Missing MM3 index portal file", r"(?i)Error in isisdisk(?:_\w+)?\.sh", r"(?i)isisdisk failed for job type",
    r"(?i)PDF found doesn't match index record counts", r"(?i)afp2pdf\.py failed", r"(?i)wrong value for start page",
    r"(?i)Failed running plugin \S+", r"(?i)Error: function \w+\(\)", r"(?i)SP2-\d{4}:",
)
#: A fatal rule of the pack is a strong failure too.
FATAL_RULES = tuple("(?i)" + p for r in RULES if r.severity == "F" for p, _ in r.groups())
#: Token kinds of a line: name, pattern, case.
TOKENS = (
    ("docdef_ref", DOCDEF_REF, None), ("docdef_ref", DOCDEF_PARAM, "upper"), ("script_ref", SCRIPT_LINE, None), ("prefix", PREFIX_TOKEN, "lower"), ("jid", JID_TOKEN, "lower"),
    ("script_path", SCRIPT_PATH, None), ("docdef_token", DOCDEF_TOKEN, "upper"), ("io_path", IO_PATH, None),
)


def line_signals(lines: DataFrame) -> DataFrame:
    """A row per line that carries a signal: ts, code, severity, source, docdef and script references."""
    d = lines.select("log_path", "line_no", strip("line").alias("message")).filter("message != ''")
    d = d.filter(~F.contains("message", F.lit("is still alive")) & ~F.contains("message", F.lit("is no longer alive")))
    # plain texts that each pattern needs are looked for first
    d = d.withColumn("low", F.lower("message"))

    def has(*texts: str, col: str = "message") -> Column:
        out = F.contains(col, F.lit(texts[0]))
        for t in texts[1:]:
            out = out | F.contains(col, F.lit(t))
        return out

    ora, code = F.when(has("ORA-"), found("message", ORA_CODE)), F.when(has("PP", "AFPR"), found("message", MESSAGE_CODE))
    error = has("error", "fail", "exception", "mismatch", "missing", "abort", col="low") & F.col("message").rlike(ERROR_WORD)
    severity = F.when(error | ora.isNotNull(), "E").when(code.isNotNull(), F.right(code, F.lit(1))).otherwise("I")
    return d.select(
        "log_path", "line_no", "message", found("message", TIMESTAMP).alias("ts"), F.coalesce(ora, code).alias("code"), severity.alias("severity"),
        F.when(has(".cpp,"), found("message", SOURCE_REF)).alias("source_file"), F.when(has(".cpp,"), found("message", SOURCE_REF, 2)).try_cast("int").alias("source_line"), F.when(has("DOCDEF '"), found("message", DOCDEF_REF)).alias("docdef_ref"),
        F.when(has("line", col="low"), found("message", SCRIPT_LINE)).alias("script_ref"), F.when(has("line", col="low"), found("message", SCRIPT_LINE, 2)).try_cast("int").alias("script_line"),
    )


def _tagged(tokens: Column, kind: str) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))


def log_tokens(lines: DataFrame) -> DataFrame:
    """log_path, kind, token: the distinct tokens of each log (error codes and seven kinds of references)."""
    s = line_signals(lines).withColumn("low", F.lower("message"))
    m = F.col("message")
    groups = []
    for kind, pattern, case in TOKENS:
        first = kind == "docdef_ref" and case is None or kind == "script_ref"
        # the first DOCDEF and script reference of a line count, of the other kinds all
        hits = F.array_compact(F.array(found(m, pattern))) if first else found_all(m, pattern)
        need = literals_of(pattern)
        if need:  # one alternative each
            hits = F.when(F.contains("low", F.lit(need[0])), hits).otherwise(F.array().cast("array<string>"))
        if case:
            hits = F.transform(hits, F.upper if case == "upper" else F.lower)
        groups.append(_tagged(hits, kind))
    codes = F.array_compact(F.array(F.col("code")))
    bare = F.col("severity").isin("E", "F") & F.col("code").isNull()
    phrases = F.when(bare, F.array_compact(F.array(*[F.when(matches(m, "low", p), F.lower(found(m, p, 0))) for p in ERROR_SIGNATURES]))).otherwise(F.array().cast("array<string>"))
    groups.append(_tagged(F.concat(codes, phrases), "error_code"))
    return s.select("log_path", F.explode(F.flatten(F.array(*groups))).alias("t")).select("log_path", "t.kind", "t.token").distinct()


def any_of(col: Column | str, patterns: tuple[str, ...], low: Column | str) -> Column:
    """Whether one of the patterns matches; ``low`` is the column in lower case."""
    out = matches(col, low, patterns[0])
    for p in patterns[1:]:
        out = out | matches(col, low, p)
    return out


def log_rollup(lines: DataFrame) -> DataFrame:
    """Per log: line and severity counts, wrapper and strong-failure flags, and each kind of token sorted and joined by '|'."""
    # Counts need no window and no list: partial aggregation carries a log of any size.
    counts = line_signals(lines).withColumn("low", F.lower("message")).groupBy("log_path").agg(
        F.count("*").alias("n_signals"), F.count_if(F.col("severity").isin("E", "F")).alias("n_errors"), F.count_if(F.col("severity") == "F").alias("n_fatal"), F.count_if(F.col("severity") == "W").alias("n_warnings"),
        F.max(F.col("message").rlike(WRAPPER)).alias("has_wrapper_noise"), F.max(any_of("message", STRONG_FAILURE + FATAL_RULES, "low")).alias("has_strong_failure"),
    )
    kinds = ["error_code", *dict.fromkeys(k for k, _, _ in TOKENS)]
    lists = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("token")))), "|").alias(f"{k}s") for k in kinds]
    return counts.join(log_tokens(lines).groupBy("log_path").agg(*lists), "log_path", "left").fillna("", [f"{k}s" for k in kinds])


def path_features(paths: DataFrame) -> DataFrame:
    """log_path, cid, proc_name, base_proc of each distinct log path."""
    low = F.lower("log_path")
    name = F.element_at(F.split(low, "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    head = F.substring(stem, 1, 4)
    cid = F.coalesce(found(low, r"/d/(\w{4})/"), found(low, r"/d/daily/(\w{4})dn\d/"), F.when(head.rlike("^[a-z0-9]{4}$"), head))
    proc = F.nullif(F.regexp_replace(F.substring_index(stem, ".", 1), r"(?:_process|_msg|_portal|_timestamp|_count)+$", ""), F.lit(""))
    d = paths.select("log_path").distinct().select("log_path", cid.alias("cid"), proc.alias("proc_name"))
    return d.withColumn("base_proc", found("proc_name", r"^(\w{4}[a-z]{2}\d)(?:\d{2,})?$"))
