"""The problem queries of the core operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators.hierarchy import descendants, hierarchy
from opslens.operators.log_records import CODE, LAYOUTS, LEVELS, log_records
from opslens.operators.snapshot_diff import snapshot_changes
from opslens.runtime import spread, table


TREES = ["CALLS", "REFERS"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "edges"), TREES)


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with the ids from its root down to it, joined by '/'."""
    paths = hierarchy(table(spark, sf_dir, "edges"), TREES, with_path=True)
    return paths.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with each node below it."""
    return descendants(hierarchy(table(spark, sf_dir, "edges"), TREES, with_path=True))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "artifacts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records(spread(table(spark, sf_dir, "log_lines")))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its component and its whole message text."""
    return log_records(spread(table(spark, sf_dir, "log_lines")), with_message=True)


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p4_found": p4_found, "p6_found": p6_found, "p6_records": p6_records}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _only(pattern: str, group: int) -> str:
    """The pattern with one capturing group left: SQL counts groups up to nine."""
    out, n, i, listed = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        listed = c == "[" or listed and c != "]"
        if c == "(" and not listed and pattern[i + 1 : i + 2] != "?":
            n += 1
            c = "(" if n == group else "(?:"
        out.append(c)
        i += 1
    return "".join(out)


_LINKS = """lk as (select upper(trim(rel_type)) rel, dst node, min(src) parent from edges where src is not null and dst is not null and upper(trim(rel_type)) in ('CALLS', 'REFERS') group by 1, 2),
nd as (select distinct rel, unnest([node, parent]) node from lk)"""
_WALK = f"""with recursive {_LINKS}, up(rel, node, cur, way) as (select rel, node, node, [node] from nd
  union all select up.rel, up.node, lk.parent, list_append(way, lk.parent) from up join lk on lk.rel = up.rel and lk.node = up.cur where not list_contains(list_slice(way, 1, -2), up.cur)),
last as (select rel, node, arg_max(way, len(way)) way from up group by 1, 2),
fin as (select rel, node, way, list_contains(list_slice(way, 1, -2), way[-1]) looped from last)"""

_PARTS = r"array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x not in ('', '.')), '/')"
_FOLD = _PARTS
for _ in range(6):
    _FOLD = rf"regexp_replace({_FOLD}, '(^|/)(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(?:/|$)', '\1')"
_P4 = f"""with f as (select snapshot_no, rtrim(regexp_replace({_FOLD}, '^(?:\\.\\./)+', ''), '/') path, nullif(lower(trim(sha256)), '') sha, cast(floor(mtime) as bigint) mt, loaded_at from artifacts where path is not null and snapshot_no is not null),
l as (select * from (select *, row_number() over (partition by snapshot_no, path order by loaded_at desc nulls last, sha desc nulls last, mt desc nulls last) rn from f) where rn = 1),
pairs as (select a.snapshot_no k from (select distinct snapshot_no from l) a join (select distinct snapshot_no from l) b on a.snapshot_no = b.snapshot_no + 1),
j as (select coalesce(n.snapshot_no, o.snapshot_no + 1) snapshot_no, coalesce(n.path, o.path) path, n.snapshot_no is not null has_new, o.snapshot_no is not null has_old, n.sha ns, o.sha os, n.mt nm, o.mt om from l n full join l o on n.path = o.path and n.snapshot_no = o.snapshot_no + 1)
select * from (select cast(snapshot_no as int) snapshot_no, path, case when not has_old then 'added' when not has_new then 'removed' when case when ns is not null and os is not null then ns <> os else nm is distinct from om end then 'changed' end change from j where snapshot_no in (select k from pairs)) where change is not null"""


def _p6_sql(with_message: bool = False) -> str:
    names = ", ".join(f"'{m}'" for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))
    kind, ts, level, comp, msg = "null", "null", "null", "null", "null"
    for layout in reversed(LAYOUTS):
        p = _q(("(?i)" if layout.name in ("piped", "plain", "syslog") else "") + layout.pattern)
        flags = "(?i)" if layout.name in ("piped", "plain", "syslog") else ""
        g = lambda n, flags=flags, layout=layout: f"regexp_extract(r, {_q(flags + _only(layout.pattern, layout.groups[n]))}, 1)" if n in layout.groups else "''"
        y = "py" if layout.name == "syslog" else f"try_cast({g('y')} as int)"
        mo = f"list_position([{names}], lower({g('mon')}))" if "mon" in layout.groups else f"try_cast({g('mo')} as int)"
        day = f"try_cast(lpad(cast({y} as varchar), 4, '0') || '-' || lpad(cast({mo} as varchar), 2, '0') || '-' || lpad(trim({g('d')}), 2, '0') as date)"
        off = f"regexp_replace({g('offset')}, '[: ]', '', 'g')"
        shift = f"case when regexp_matches({off}, '^[+-][0-9]{{4}}$') then (case when starts_with({off}, '-') then -1 else 1 end) * (cast(substr({off}, 2, 2) as int) * 3600 + cast(substr({off}, 4, 2) as int) * 60) else 0 end" if "offset" in layout.groups else "0"
        secs = f"datediff('day', date '1970-01-01', {day}) * 86400 + try_cast({g('h')} as int) * 3600 + try_cast({g('mi')} as int) * 60 + try_cast({g('s')} as int) - {shift}"
        kind = f"case when regexp_matches(r, {p}) then '{layout.name}' else {kind} end"
        ts = f"case when kind = '{layout.name}' then {secs} else {ts} end"
        level = f"case when kind = '{layout.name}' then {g('level')} else {level} end"
        comp = f"case when kind = '{layout.name}' then {g('component')} else {comp} end"
        msg = f"case when kind = '{layout.name}' then {g('message')} else {msg} end"
    more = f", case when kind = 'json' then json_extract_string(r, '$.mod') else {comp} end comp, case when kind = 'json' then json_extract_string(r, '$.msg') else {msg} end msg" if with_message else ""
    text = ", coalesce(max(case when line_no = st then comp end), '') component, concat_ws(chr(10), nullif(max(case when line_no = st then msg end), ''), string_agg(line, chr(10) order by line_no) filter (line_no <> st)) message" if with_message else ""
    out = ", component, message" if with_message else ""
    letters = " ".join(f"when '{k}' then '{v}'" for k, v in LEVELS.items())
    code = _q("(?:^|[^A-Za-z0-9])" + CODE.split(")", 1)[1].rsplit("(?!", 1)[0] + "(?:[^A-Za-z0-9]|$)")
    return f"""with a as (select log_path, line_no, line, rtrim(line, ' ') r, coalesce(try_cast(nullif(regexp_extract(log_path, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)', 1), '') as int), year(received_at)) py
  from (select * from (select *, row_number() over (partition by log_path, line_no order by received_at desc nulls last, line desc nulls last) rn from log_lines where line_no is not null) where rn = 1)),
k as (select *, case when regexp_matches(r, '^[{{] *"ts" *:') and json_valid(r) then 'json' when regexp_matches(r, '^(?:[0-9]|[[]|[A-Z])') then {kind} end kind from a),
t as (select *, case when kind = 'json' then cast(floor(case when abs(try_cast(json_extract_string(r, '$.ts') as double)) >= 1e11 then try_cast(json_extract_string(r, '$.ts') as double) / 1000 else try_cast(json_extract_string(r, '$.ts') as double) end) as bigint) else {ts} end ts_sec,
  case when kind = 'json' then json_extract_string(r, '$.lvl') else {level} end lvl, nullif(regexp_extract(line, {code}, 1), '') code, coalesce(trim(line, chr(9) || chr(13) || ' ') <> '', false) filled{more} from k),
g as (select *, max(case when ts_sec is not null then line_no end) over (partition by log_path order by line_no rows unbounded preceding) st from t),
e as (select log_path, st first_line, max(case when filled then line_no end) last_line, max(ts_sec) ts_sec, max(case when line_no = st then lvl end) lvl, coalesce(arg_min(code, line_no) filter (code is not null), '') code{text} from g where st is not null group by 1, 2)
select log_path, first_line, last_line, cast(ts_sec as bigint) ts_sec, coalesce(case lower(lvl) {letters} end, case when starts_with(code, 'ORA-') then 'E' when code <> '' then right(code, 1) else '' end) severity, code{out} from e"""


ORACLE = {
    "p1_found": _WALK + " select rel rel_type, node node_id, case when looped then list_min(list_slice(way, list_position(way, way[-1]), -1)) else way[-1] end root_id, cast(case when looped then -1 else len(way) - 1 end as int) depth from fin",
    "p1_descendants": _WALK + " select rel rel_type, way[i] ancestor_id, node node_id, cast(i - 1 as int) distance from (select rel, node, way, unnest(range(2, len(way) + 1)) i from fin where not looped)",
    "p4_found": _P4,
    "p1_paths": _WALK + " select rel rel_type, node node_id, case when looped then list_min(list_slice(way, list_position(way, way[-1]), -1)) else way[-1] end root_id, cast(case when looped then -1 else len(way) - 1 end as int) depth, case when not looped then array_to_string(list_reverse(way), '/') end path from fin",
    "p6_found": _p6_sql(),
    "p6_records": _p6_sql(with_message=True),
}
