"""The execution graph: procs, scripts, the edges between them, and paths on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import base_name
from opslens.operators.procs import parse_procs


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by an order (get-or-create). Partial aggregation, so a hot key gathers nowhere."""
    rest = [*order, *[c for c in df.columns if c not in key and c not in order]]
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, type, display_name, original_path) and RUNS edges (src_key, dst_key, file, line_no) of proc files (id, path, text_content).

    A script is known by its base name; the first file that names it (by path) gives its path.
    """
    p = parse_procs(files).withColumn("proc_name", F.regexp_replace(F.lower(base_name("path")), r"\.procs$", ""))
    p = first_by(p, ["proc_name"], ["path", "id"])
    title = F.concat(F.upper(F.coalesce("cid", F.substring("proc_name", 1, 4))), F.lit(" - "), F.col("app_type"))
    procs = p.select(F.concat(F.lit("proc:"), F.col("proc_name")).alias("key"), F.lit("proc").alias("type"), title.alias("display_name"), F.concat(F.lit("/home/procs/"), F.col("proc_name"), F.lit(".procs")).alias("original_path"))
    runs = p.filter("shell_script is not null").select(F.concat(F.lit("proc:"), F.col("proc_name")).alias("src_key"), base_name("shell_script").alias("script"), "shell_script", F.col("path").alias("file"), F.col("shell_script_line").alias("line_no"))
    scripts = first_by(runs, ["script"], ["file", "line_no"]).select(F.concat(F.lit("script:"), F.col("script")).alias("key"), F.lit("script").alias("type"), F.col("script").alias("display_name"), F.col("shell_script").alias("original_path"))
    edges = runs.select("src_key", F.concat(F.lit("script:"), F.col("script")).alias("dst_key"), "file", "line_no")
    return procs.unionByName(scripts), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: nodes by type, edges by relation (as written), and both totals."""
    n = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    e = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n")
    total = [d.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), F.lit("all").alias("name"), "n") for w, d in (("node", nodes), ("edge", edges))]
    return n.unionByName(e).unionByName(total[0]).unionByName(total[1])


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of the wanted ids (column id) or keys (column key)."""
    by = "id" if "id" in wanted.columns else "key"
    return nodes.join(wanted.select(by).distinct(), by, "left_semi")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """src, dst, rel (capitals, trimmed), edge_id (the first of its kind): resolved edges without repeats."""
    d = edges.filter("src is not null and dst is not null and rel_type is not null")
    return d.groupBy("src", "dst", F.upper(F.trim("rel_type")).alias("rel")).agg(F.min("id").alias("edge_id"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, direction, rel, other_id, other_key: one step up and down from every node."""
    e = distinct_edges(edges)
    n = nodes.select(F.col("id").alias("other_id"), F.col("key").alias("other_key"))
    up = e.select(F.col("dst").alias("node_id"), F.lit("upstream").alias("direction"), "rel", F.col("src").alias("other_id"))
    down = e.select(F.col("src").alias("node_id"), F.lit("downstream").alias("direction"), "rel", F.col("dst").alias("other_id"))
    return up.unionByName(down).join(n, "other_id")


def scripts_run_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """script, proc_key, proc_id: which procs run which script (RUNS edges)."""
    e = distinct_edges(edges).filter("rel = 'RUNS'")
    p = nodes.filter("type = 'proc'").select(F.col("id").alias("src"), F.col("key").alias("proc_key"))
    s = nodes.filter("type = 'script'").select(F.col("id").alias("dst"), F.col("display_name").alias("script"))
    return e.join(p, "src").join(s, "dst").select("script", "proc_key", F.col("src").alias("proc_id"))


#: Where paths of the source machine lie in a snapshot.
PATH_PREFIXES = (("/home/procs/", "procs/"), ("/home/master/", "master/"), ("/home/control/", "control/"), ("/home/insert/", "insert/"), ("/home/docdef/", "docdef/"), ("/home/util/", "master/"))
SCANNED = ("procs", "master", "control", "insert", "docdef")


def snapshot_path(path: Column) -> Column:
    """Where a path of the source machine should lie in a snapshot; null where no prefix applies."""
    low = F.trim(F.lower(F.translate(path, "\\", "/")))
    out = F.when(low.rlike("^/home/[^/]+/"), F.regexp_replace(low, "^/home/([^/]+)/", "$1/"))
    for prefix, place in reversed(PATH_PREFIXES):
        out = F.when(low.startswith(prefix), F.concat(F.lit(place), F.substring(low, len(prefix) + 1, 1 << 20))).otherwise(out)
    return out


def map_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """unix_path, path, confidence of each distinct unix_path.

    1.0 the file lies where it should; 0.9 but for letter case; 0.7 one file of that name in
    the scanned folders; 0.5 several (the least path is given); 0.0 none. ``files``: path.
    """
    f = files.select("path").distinct()
    u = paths.select("unix_path").filter("unix_path is not null").distinct()
    u = u.select("unix_path", snapshot_path(F.col("unix_path")).alias("place"), base_name(F.trim(F.lower(F.translate("unix_path", "\\", "/")))).alias("name"))
    exact = f.select(F.col("path").alias("place"), F.col("path").alias("exact"))
    lower = f.groupBy(F.lower("path").alias("place")).agg(F.min("path").alias("folded"))
    named = f.filter(F.split("path", "/")[0].isin(*SCANNED)).groupBy(base_name("path").alias("name")).agg(F.min("path").alias("named"), F.count("*").alias("n_named"))
    d = u.join(exact, "place", "left").join(lower, "place", "left").join(named, "name", "left")
    return d.select(
        "unix_path", F.coalesce("exact", "folded", "named").alias("path"),
        F.when(F.col("exact").isNotNull(), 1.0).when(F.col("folded").isNotNull(), 0.9).when(F.col("n_named") == 1, 0.7).when(F.col("n_named") > 1, 0.5).otherwise(0.0).alias("confidence"),
    )


def related_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, top: int = 10) -> DataFrame:
    """node_id, path: a node's own file and those one step below it that exist, the first ``top`` by path."""
    have = files.select("path").distinct()
    own = nodes.select(F.col("id").alias("node_id"), F.col("canonical_path").alias("path"))
    below = distinct_edges(edges).select(F.col("src").alias("node_id"), F.col("dst").alias("id")).join(nodes.select("id", F.col("canonical_path").alias("path")), "id").select("node_id", "path")
    d = own.unionByName(below).filter("path is not null").distinct().join(have, "path", "left_semi")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("path")).cast("int")).filter(F.col("place") <= top)


#: A script's name in a text: no letter, digit or _ before it, no letter or digit behind it.
MENTION = r"(?<![a-zA-Z0-9_])([a-zA-Z0-9_][\w.-]*?\.(?:sh|pl|py))(?![a-zA-Z0-9])"


def calls(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """caller, callee, exists: which script names each script's text contains (files: path, text_content; one row per path).

    ``known`` (name): the names that count, whether a file of theirs exists or not; None: any
    name. Texts are cut into names once and joined on equality, so the work is linear in the text.
    """
    names = F.explode(F.array_distinct(F.regexp_extract_all("text_content", F.lit(MENTION), F.lit(1)))).alias("callee")
    said = files.filter("text_content is not null").select(base_name("path").alias("caller"), names).distinct().filter("caller != callee")
    if known is not None:
        said = said.join(known.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    have = files.select(base_name("path").alias("callee"), F.lit(True).alias("exists")).distinct()
    return said.join(have, "callee", "left").select("caller", "callee", F.coalesce("exists", F.lit(False)).alias("exists"))


def mentions(files: DataFrame) -> DataFrame:
    """caller, callee: which scripts of ``files`` each script's text names."""
    return calls(files).filter("exists").select("caller", "callee")


def call_tree(calls: DataFrame, root: str, limit: int = 200) -> str:
    """The calls below a script as an indented tree; names seen before are marked.

    A report for reading: a level is gathered with one query, and where more than ``limit``
    names are found the tree says so in its last line.
    """
    lines, seen = [root], {root}
    level, below, more = [root], {}, False
    while level and not more:
        rows = calls.filter(F.col("caller").isin(level)).orderBy("caller", "callee").limit(limit - len(seen) + 1).collect()
        level = []
        for r in rows:
            if r["callee"] not in seen and len(seen) >= limit:
                more = True
                continue
            below.setdefault(r["caller"], []).append(r["callee"])
            if r["callee"] not in seen:
                seen.add(r["callee"])
                level.append(r["callee"])
    shown: set[str] = {root}

    def walk(name: str, indent: str) -> None:
        children = below.get(name, [])
        for i, c in enumerate(children):
            last = i + 1 == len(children)
            again = c in shown
            lines.append(f"{indent}{'└── ' if last else '├── '}{c}{' ↺' if again else ''}")
            if not again:
                shown.add(c)
                walk(c, indent + ("    " if last else "│   "))

    walk(root, "")
    if more:
        lines.append(f"... more than {limit} names; the rest is left out")
    return "\n".join(lines)


def diagram_edges(bundle: DataFrame, calls: DataFrame) -> DataFrame:
    """proc_name, src, dst, label: the edges of a bundle's diagram (bundle: proc_name, path, kind[, source]).

    Scripts hang on the proc that runs them or on their callers; helpers by name that nothing
    calls hang on the proc as such.
    """
    labels = {"script": "RUNS", "insert": "READS", "control": "control", "docdef": "dfa"}
    label = F.lit(None).cast("string")
    for kind, name in labels.items():
        label = F.when(F.col("kind") == kind, name).otherwise(label)
    source = F.col("source") if "source" in bundle.columns else F.lit("RUNS_edge")
    files = bundle.select("proc_name", base_name("path").alias("dst"), "kind", label.alias("label"), source.alias("source")).filter("label is not null")
    own = files.filter("kind != 'script' or source = 'RUNS_edge'").select("proc_name", F.col("proc_name").alias("src"), "dst", "label")
    inside = files.filter("kind = 'script'").select("proc_name", F.col("dst").alias("name")).distinct()
    called = calls.join(inside.select("proc_name", F.col("name").alias("caller")), "caller").join(inside.withColumnRenamed("name", "callee"), ["proc_name", "callee"])
    called = called.select("proc_name", F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("label"))
    reached = own.select("proc_name", "dst").unionByName(called.select("proc_name", "dst")).distinct()
    orphans = files.filter("source = 'helper_prefix_match'").join(reached, ["proc_name", "dst"], "left_anti").select("proc_name", F.col("proc_name").alias("src"), "dst", F.lit("helper").alias("label"))
    return own.unionByName(called).unionByName(orphans).distinct()
