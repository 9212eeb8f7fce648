"""Log lines of many programs into one record per entry.

A line opens an entry when one of an ordered cascade of layouts matches it from its
first character and its own time stamp is a valid time. All other lines continue the
entry above them in the same log. Grouping runs per (log, block of line numbers), so a
log of any size is split over many tasks; only the first and the last entry of each
block meet again in a second, small step.

Defined results
  null or blank line      never opens an entry, never is an entry's last line
  line delivered twice    the row received last counts (ties: the greater text)
  null log_path           treated as one more log, returned as null
  null line_no            the row has no place in a log and is left out
  lines before the first  belong to no entry
  empty table             empty result
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of one log that one window task holds at most.
BLOCK_LINES = 131_072

#: Stated level names and the letter of each.
LEVELS = {
    "trace": "I", "debug": "I", "info": "I", "notice": "I", "i": "I",
    "warn": "W", "warning": "W", "w": "W",
    "err": "E", "error": "E", "severe": "E", "e": "E",
    "fatal": "F", "critical": "F", "panic": "F", "f": "F",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_LEVEL = r"(?:trace|debug|info|notice|warn|warning|err|error|severe|fatal|critical|panic|[iwef])"
_HMS = r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d)"

#: Message codes of the job programs and of the database.
CODE = r"(?<![A-Za-z0-9])(PP[A-Z]{2}[0-9]{4}[A-Z]|AFPR[0-9]{4}[A-Z]|ORA-[0-9]{5})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Layout:
    """One header layout: a pattern and the group number of each named field."""

    name: str
    pattern: str
    groups: dict[str, int] = field(default_factory=dict)


#: The cascade, tried in this order; the first match decides.
LAYOUTS: tuple[Layout, ...] = (
    Layout("slash", rf"^(\d{{4}})-(\d\d)-(\d\d)/{_HMS}(?:[.,]\d+)?(?:\s+(.*))?$",
           {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "message": 7}),
    Layout("keyed", rf"^(\d{{4}})-(\d\d)-(\d\d)T{_HMS}(?:[.,]\d+)?(Z|[+-]\d\d:?\d\d)?(?:\s+level=(\w+))?(?:\s+comp=(\S+))?(?:\s+(.*))?$",
           {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "offset": 7, "level": 8, "component": 9, "message": 10}),
    Layout("piped", rf"^(\d\d)\.(\d\d)\.(\d{{4}}) {_HMS}(?:[.,]\d+)? \| *({_LEVEL})? *\| *([^|]*?) *\|(?: (.*))?$",
           {"d": 1, "mo": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "level": 7, "component": 8, "message": 9}),
    Layout("bracketed", rf"^\[(\d\d)/([A-Za-z]{{3}})/(\d{{4}}):{_HMS} ([+-]\d\d:?\d\d)\](?: sev=(\w+))?(?: \(([^)]*)\))?(?: (.*))?$",
           {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "offset": 7, "level": 8, "component": 9, "message": 10}),
    Layout("plain", rf"^(\d{{4}})-(\d\d)-(\d\d) {_HMS}[.,]\d+(Z| ?[+-]\d\d:?\d\d)?(?: ({_LEVEL}))?(?: \[([^\]]*)\])?(?: (.*))?$",
           {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "offset": 7, "level": 8, "component": 9, "message": 10}),
    Layout("starred", rf"^[A-Z][a-z]{{2}} ([A-Z][a-z]{{2}}) +(\d{{1,2}}) {_HMS} (\d{{4}})(?: \*\*\* (\w+) \*\*\*)?(?: ([^\s:]+):)?(?: (.*))?$",
           {"mon": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "y": 6, "level": 7, "component": 8, "message": 9}),
    Layout("syslog", rf"^([A-Z][a-z]{{2}}) +(\d{{1,2}}) {_HMS} \S+ ([^\s\[:]+)(?:\[\d+\])?:(?: ({_LEVEL}):)?(?: (.*))?$",
           {"mon": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "component": 6, "level": 7, "message": 8}),
    Layout("bare", rf"^(\d{{4}})-(\d\d)-(\d\d) {_HMS}\s*$",
           {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6}),
)


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null for a date that does not exist."""
    return F.datediff(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(F.trim(d), 2, "0")).try_cast("date"), F.lit("1970-01-01").cast("date"))


def _offset_seconds(text: Column) -> Column:
    t = F.regexp_replace(text, "[: ]", "")
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    value = sign * (F.substring(t, 2, 2).try_cast("int") * 3600 + F.substring(t, 4, 2).try_cast("int") * 60)
    return F.when(t.rlike("^[+-][0-9]{4}$"), value).otherwise(0)


def _month(name: Column) -> Column:
    number = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(_MONTHS, 1))):
        number = F.when(F.lower(name) == m, F.lit(str(i))).otherwise(number)
    return number


def level_letter(level: Column) -> Column:
    """Severity letter of a stated level, null where no known level is stated."""
    out = F.lit(None).cast("string")
    for letter in "IWEF":
        out = F.when(F.lower(level).isin([k for k, v in LEVELS.items() if v == letter]), letter).otherwise(out)
    return out


#: The fields of a header in the order in which ``_parts`` puts them; the message comes last.
_FIELDS = ("y", "mo", "d", "h", "mi", "s", "offset", "level", "component", "message")


def _flagged(layout: Layout) -> str:
    return ("(?i)" if layout.name in ("piped", "plain", "syslog") else "") + layout.pattern


def _kind(line: Column) -> Column:
    """Name of the first layout that matches a line, null on other lines."""
    kinds = F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        kinds = F.when(line.rlike(_flagged(layout)), layout.name).otherwise(kinds)
    return F.when(line.rlike(r'^\{ *"ts" *:'), "json").when(line.rlike(r"^[0-9\[A-Z]"), kinds)


def _parts(kind: Column, line: Column) -> Column:
    """All fields of a header from one match, '' where the layout or the line has none."""
    out = F.lit(None).cast("array<string>")
    for layout in reversed(LAYOUTS):
        at = {"mo" if k == "mon" else k: i for k, i in layout.groups.items()}
        order = "\x01".join(f"${at[f]}" if f in at else "" for f in _FIELDS)
        out = F.when(kind == layout.name, F.split(F.regexp_replace(line, _flagged(layout) + r"[\s\S]*$", order), "\x01", len(_FIELDS))).otherwise(out)
    return out


def _header(kind: Column, parts: Column, line: Column, path_year: Column) -> Column:
    """ts_sec, level, component and message of a header line; null on others."""
    part = {f: parts[i] for i, f in enumerate(_FIELDS)}
    day = _day(F.when(kind == "syslog", path_year).otherwise(part["y"]), F.coalesce(_month(part["mo"]), part["mo"]), part["d"])
    secs = day.cast("long") * 86400 + part["h"].try_cast("int") * 3600 + part["mi"].try_cast("int") * 60 + part["s"].try_cast("int") - _offset_seconds(part["offset"])
    json_ts = F.get_json_object(line, "$.ts")
    num = json_ts.try_cast("double")
    iso = F.unix_micros(F.concat(F.regexp_replace(json_ts, "(?:Z|[+-]\\d\\d:?\\d\\d)$", ""), F.lit("Z")).try_cast("timestamp")) / 1e6
    parsed = F.struct(
        F.floor(F.coalesce(F.when(F.abs(num) >= 1e11, num / 1000).otherwise(num), iso)).cast("long").alias("ts_sec"),
        F.coalesce(F.get_json_object(line, "$.lvl"), F.get_json_object(line, "$.level")).alias("level"),
        F.coalesce(F.get_json_object(line, "$.mod"), F.get_json_object(line, "$.comp")).alias("component"),
        F.coalesce(F.get_json_object(line, "$.msg"), F.get_json_object(line, "$.message")).alias("message"),
    )
    return F.when(kind == "json", parsed).when(kind.isNotNull(), F.struct(secs.alias("ts_sec"), part["level"].alias("level"), part["component"].alias("component"), part["message"].alias("message")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Per line: log_path, line_no, block, received_at, line, ts_sec (null: continuation), level, component, message, code."""
    year = F.regexp_extract("log_path", r"(?:^|[^0-9])((?:19|20)\d\d)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?![0-9])", 1)
    received = F.col("received_at") if "received_at" in lines.columns else F.lit(None).cast("timestamp_ntz")
    year = F.when(F.col("kind") != "syslog", None).when(year != "", year).otherwise(F.year("received_at").cast("string"))
    d = lines.filter(F.col("line_no").isNotNull()).select("log_path", "line_no", F.floor(F.col("line_no") / BLOCK_LINES).cast("long").alias("block"), received.alias("received_at"), "line", F.rtrim(F.col("line")).alias("bare"))
    d = d.withColumn("kind", _kind(F.col("bare")))
    d = d.withColumn("parts", _parts(F.col("kind"), F.col("bare")))
    may_code = F.contains("line", F.lit("PP")) | F.contains("line", F.lit("AFPR")) | F.contains("line", F.lit("ORA-"))
    d = d.withColumn("h", _header(F.col("kind"), F.col("parts"), F.col("bare"), year)).withColumn("code", F.when(may_code, F.nullif(F.regexp_extract("line", CODE, 1), F.lit(""))))
    return d.select("log_path", "line_no", "block", "received_at", "line", "h.ts_sec", "h.level", "h.component", "h.message", "code", F.coalesce(F.trim(F.translate("line", "\t\r ", "   ")) != "", F.lit(False)).alias("filled"))


def log_records(lines: DataFrame, with_message: bool = False) -> DataFrame:
    """One row per log entry: log_path, first_line, last_line, ts_sec, severity, code[, component, message].

    ``lines``: log_path, line_no, line and, if present, received_at; other columns are ignored.
    The shuffle carries the parsed fields only; the text of lines is moved only for ``with_message``.
    """
    p = parse_lines(lines)
    digest = F.xxhash64("line")
    keep = ["log_path", "line_no", "block", "received_at", "ts_sec", "level", "code", "filled", digest.alias("digest")]
    if with_message:
        keep += ["component", "message", "line"]
    p = p.select(*keep).repartition("log_path", "block")
    order = [F.col("received_at").desc_nulls_last(), F.col("line").desc_nulls_last() if with_message else F.col("digest")]
    p = p.withColumn("dup", F.row_number().over(Window.partitionBy("log_path", "block", "line_no").orderBy(*order))).filter("dup = 1")
    run = Window.partitionBy("log_path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("start_no", F.last(F.when(F.col("ts_sec").isNotNull(), F.col("line_no")), ignorenulls=True).over(run))
    opens = F.col("ts_sec").isNotNull()
    aggs = [
        F.max("ts_sec").alias("ts_sec"),
        F.max(F.when(opens, F.struct("level"))).getField("level").alias("level"),
        F.min(F.when(F.col("code").isNotNull(), F.struct("line_no", "code"))).alias("first_code"),
        F.max(F.when(F.col("filled"), F.col("line_no"))).alias("last_line"),
    ]
    if with_message:
        aggs += [
            F.max(F.when(opens, F.struct("component", "message"))).alias("head"),
            F.collect_list(F.when(~opens & F.col("line").isNotNull(), F.struct("line_no", "line"))).alias("more"),
        ]
    seg = p.groupBy("log_path", "block", "start_no").agg(*aggs)
    seg = seg.withColumn("edge", F.col("start_no").isNull() | (F.col("start_no") == F.max("start_no").over(Window.partitionBy("log_path", "block"))))

    # Entries that may run over a block's end: at most two rows a block, joined per log.
    edges = seg.filter("edge").withColumn(
        "start_no", F.last("start_no", ignorenulls=True).over(Window.partitionBy("log_path").orderBy("block", F.col("start_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    )
    again = [F.max("ts_sec").alias("ts_sec"), F.max("level").alias("level"), F.min("first_code").alias("first_code"), F.max("last_line").alias("last_line")]
    if with_message:
        again += [F.max("head").alias("head"), F.flatten(F.collect_list("more")).alias("more")]
    edges = edges.filter("start_no is not null").groupBy("log_path", "start_no").agg(*again)
    whole = seg.filter("not edge").select(*edges.columns).unionByName(edges)

    code = F.coalesce(F.col("first_code.code"), F.lit(""))
    severity = F.coalesce(level_letter(F.col("level")), F.when(code.startswith("ORA-"), "E").when(code != "", F.substring(code, -1, 1)).otherwise(""))
    out = [F.col("log_path"), F.col("start_no").cast("long").alias("first_line"), F.col("last_line").cast("long"), F.col("ts_sec"), severity.alias("severity"), code.alias("code")]
    if with_message:
        text = F.concat_ws("\n", F.nullif(F.col("head.message"), F.lit("")), F.transform(F.array_sort("more"), lambda m: m["line"]))
        out += [F.coalesce(F.col("head.component"), F.lit("")).alias("component"), text.alias("message")]
    return whole.select(*out)
