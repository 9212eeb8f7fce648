"""Fields of proc files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.textexpr import found, found_all

# The labels of a proc file.
FIRM = r"(?m)^Firm:\s*(.+?)(?:\s{2,}|$)"
CID = r"(?m)^CID\s*:\s*(\w+)"
APP_TYPE = r"(?m)(?:Application Type|Production Type):\s*(.+?)(?:\s{2,}|$)"
JOB_ID = r"Job ID:\s*(\S+)"
LR = r"LR:\s*(\S+)"
SHELL_SCRIPT = r"(?im)^[\s_\-]*(?:Processing\s+)?Shell Script:\s*(/\S+)"
LOG_FILE = r"(?im)^[\s_\-]*Log File:\s*(/\S+)"
FILE_SETUP = r"(?im)^[\s_\-]*File Setup Before Processing:\s*\n?\s*(/\S+)"
PRINT_FILES = r"(?i)Print files?:\s*(/\S+)"
INPUT_LOCATION = r"(?i)File Location:\s*(/\S+)"
CROSS_REF = r"(?i)refer to\s+(/home/procs/\w+\.procs)"
ABSOLUTE_PATH = r"(/(?:home|d|z|download|ftpbu)/[^\s,;\"'<>()]+)"


def _line_of(text: Column, pattern: str) -> Column:
    """1-based line on which a match begins, null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at - 1), "\n"))).cast("int")


def clean_paths(paths: Column) -> Column:
    """Paths without punctuation behind them, longer than five characters, each once and in order."""
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.rtrim(p, F.lit(".,;:)]}"))), lambda p: F.length(p) > 5))


def parse_procs(files: DataFrame) -> DataFrame:
    """id, path and the fields of each proc file (files: id, path, text_content); a missing field is null, app_type 'unknown'."""
    t = F.regexp_replace(F.coalesce("text_content", F.lit("")), "\r\n?", "\n")
    d = files.select("id", "path", t.alias("t"))
    c = F.col("t")
    return d.select(
        "id", "path", F.trim(found(c, FIRM)).alias("firm"), F.lower(found(c, CID)).alias("cid"), F.coalesce(F.trim(found(c, APP_TYPE)), F.lit("unknown")).alias("app_type"),
        found(c, JOB_ID).alias("job_id"), found(c, LR).alias("lr"), found(c, SHELL_SCRIPT).alias("shell_script"), _line_of(c, SHELL_SCRIPT).alias("shell_script_line"),
        found(c, LOG_FILE).alias("log_file"), _line_of(c, LOG_FILE).alias("log_file_line"), found(c, FILE_SETUP).alias("file_setup"), _line_of(c, FILE_SETUP).alias("file_setup_line"),
        F.array_distinct(found_all(c, PRINT_FILES)).alias("print_files"), found(c, INPUT_LOCATION).alias("input_location"), F.array_distinct(found_all(c, CROSS_REF)).alias("cross_refs"), clean_paths(found_all(c, ABSOLUTE_PATH)).alias("all_paths"),
    )


def with_json(procs: DataFrame) -> DataFrame:
    """proc_name and parsed_json: all fields, nulls included, as the planner searches them."""
    name = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.procs$", "")
    kept = [c for c in procs.columns if c not in ("id", "path")]
    return procs.select(name.alias("proc_name"), "file_setup", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("parsed_json"))


# Fixed value: folders whose absolute paths are taken from any text.
ANY_PATH = r"(/(?:home|d|z|download|ftpbu|backup|afp2web)/[^\s,;\"'<>()]+)"


def absolute_paths(text: Column) -> Column:
    """The distinct absolute paths of a text, in order."""
    return clean_paths(found_all(text, ANY_PATH))
