"""Proc files, graph, paths, matching, planner, similarity."""

import pytest
from pyspark.sql import functions as F

from opslens.operators import graph, matching, planner, procs, similarity
from opslens.plans import explain
from opslens.runtime import checkpointed

PROC = """Firm: Acme Credit    Rev 3
CID : WCCU
Production Type: Letter   x
Job ID: ds1    LR: 467
__Processing Shell Script: /home/master/wccuds1.sh
Log File: /d/wccu/wccuds1.log
File Setup Before Processing:
  /home/insert/wccuds1.ins
Print file: /z/a/pages.afp
print files: /z/a/pages.afp
refer to /home/procs/wccuds2.procs
uses WCCUDL014 and WCCUDL020 (see /d/wccu/in/x.dat).
"""
FILES = "id long, path string, kind string, text_content string, size long, rel string"


def files(spark, *rows):
    return spark.createDataFrame([(i, p, k, t, 1, "clash") for i, (p, k, t) in enumerate(rows, 1)], FILES)


def test_procs(spark):
    (r, empty) = procs.parse_procs(files(spark, ("procs/wccuds1.procs", "procs", PROC), ("procs/e.procs", "procs", None))).orderBy("id").collect()
    assert (r.firm, r.cid, r.app_type, r.job_id, r.lr) == ("Acme Credit", "wccu", "Letter", "ds1", "467")
    assert (r.shell_script, r.shell_script_line, r.log_file_line, r.file_setup, r.file_setup_line) == ("/home/master/wccuds1.sh", 5, 6, "/home/insert/wccuds1.ins", 7)
    assert r.print_files == ["/z/a/pages.afp"] and r.cross_refs == ["/home/procs/wccuds2.procs"] and r.all_paths[-1] == "/d/wccu/in/x.dat"
    assert (empty.firm, empty.app_type, empty.all_paths) == (None, "unknown", [])


def test_build_graph(spark):
    nodes, edges = graph.build_graph(files(spark, ("procs/wccuds1.procs", "procs", PROC), ("procs/x/WCCUDS2.procs", "procs", PROC), ("procs/none.procs", "procs", "CID: none")))
    assert {(r.key, r.type) for r in nodes.collect()} == {("proc:wccuds1", "proc"), ("proc:wccuds2", "proc"), ("proc:none", "proc"), ("script:wccuds1.sh", "script")}
    assert {(r.src_key, r.dst_key, r.line_no) for r in edges.collect()} == {("proc:wccuds1", "script:wccuds1.sh", 5), ("proc:wccuds2", "script:wccuds1.sh", 5)}


def small_graph(spark):
    nodes = spark.createDataFrame([(1, "proc", "proc:wccuds1", "WCCU", "procs/wccuds1.procs"), (2, "proc", "proc:wccuds2", "WCCU", None), (3, "script", "script:a.sh", "a.sh", "master/a.sh"), (4, "proc", "proc:abcdmt1", "ABCD", "procs/abcdmt1.procs")], "id long, type string, key string, display_name string, canonical_path string")
    edges = spark.createDataFrame([(1, 1, 3, "RUNS"), (2, 1, 3, " runs"), (3, 2, 3, "RUNS"), (4, 1, 4, "REFERS"), (5, 1, None, "RUNS"), (6, None, 1, "RUNS")], "id long, src long, dst long, rel_type string")
    return nodes, edges


def test_neighbours_and_files(spark):
    nodes, edges = small_graph(spark)
    near = {(r.node_id, r.direction, r.rel, r.other_id) for r in graph.neighbours(nodes, edges).collect()}
    assert near == {(1, "downstream", "RUNS", 3), (2, "downstream", "RUNS", 3), (1, "downstream", "REFERS", 4), (3, "upstream", "RUNS", 1), (3, "upstream", "RUNS", 2), (4, "upstream", "REFERS", 1)}
    assert {(r.script, r.proc_id) for r in graph.scripts_run_by(nodes, edges).collect()} == {("a.sh", 1), ("a.sh", 2)}
    have = files(spark, ("master/a.sh", "script", None), ("procs/wccuds1.procs", "procs", None))
    got = {(r.node_id, r.path) for r in graph.related_files(nodes, edges, have).collect()}
    assert got == {(1, "master/a.sh"), (1, "procs/wccuds1.procs"), (2, "master/a.sh"), (3, "master/a.sh")}
    assert {(r.what, r["name"], r.n) for r in graph.graph_stats(nodes, edges).collect()} >= {("node", "proc", 3), ("edge", "RUNS", 4), ("edge", "all", 6)}


def test_map_paths(spark):
    have = files(spark, ("master/A.sh", "s", None), ("master/b.sh", "s", None), ("insert/x/c.ins", "i", None), ("insert/y/d.ins", "i", None), ("insert/z/d.ins", "i", None), ("logs/e.sh", "l", None))
    asked = ["/home/master/b.sh", "/home/util/b.sh", "/HOME/master/a.sh", "\\home\\master\\b.sh", "/opt/c.ins", "/opt/d.ins", "/opt/e.sh", "/home/nowhere/q.sh", None]
    got = {r.unix_path: (r.path, r.confidence) for r in graph.map_paths(spark.createDataFrame([(a,) for a in asked], "unix_path string"), have).collect()}
    assert got == {
        asked[0]: ("master/b.sh", 1.0), asked[1]: ("master/b.sh", 1.0), asked[2]: ("master/A.sh", 0.9), asked[3]: ("master/b.sh", 1.0), asked[4]: ("insert/x/c.ins", 0.7),
        asked[5]: ("insert/y/d.ins", 0.5), asked[6]: (None, 0.0), asked[7]: (None, 0.0),
    }


def test_mentions_and_tree(spark):
    have = files(spark, ("m/a.sh", "script", "run b.sh; my_c.pl; xb.sh; c.pl_old and a.sh"), ("m/b.sh", "script", "perl /home/c.pl x"), ("m/c.pl", "script", "calls a.sh."), ("m/my_c.pl", "script", None))
    calls = graph.mentions(have)
    assert {(r.caller, r.callee) for r in calls.collect()} == {("a.sh", "b.sh"), ("a.sh", "my_c.pl"), ("a.sh", "c.pl"), ("b.sh", "c.pl"), ("c.pl", "a.sh")}
    tree = graph.call_tree(calls, "a.sh")
    assert tree.splitlines()[0] == "a.sh" and "c.pl" in tree and "a.sh ↺" in tree


def test_match(spark):
    nodes, edges = small_graph(spark)
    rows = [("/d/zzzz/abcdmt1_msg.20260101.log", 1, "$PREFIX=wccuds1 /home/master/a.sh"), ("/d/abcd/abcdmt101.log", 1, "x $JID=mt1"), ("/tmp/q.log", 1, "nothing")]
    lines = spark.createDataFrame(rows, "log_path string, line_no long, line string")
    got = {r.log_path: (r.node_id, r.points) for r in matching.match_logs(lines, nodes, edges).collect()}
    assert got == {rows[0][0]: (1, 32), rows[1][0]: (4, 9 + 5 + 3)}
    assert matching.match_logs(lines, nodes, edges).filter("node_id = 1").first().confidence == pytest.approx(32 / 42, abs=1e-4)
    asked = spark.createDataFrame([("wccuds1",), ("WCCU",), ("cuds2",), ("none",)], "proc string")
    assert {(r.proc, r.node_id, r.confidence) for r in matching.forced_matches(asked, nodes).collect()} == {("wccuds1", 1, 1.0), ("wccu", 1, 1.0), ("cuds2", 2, 0.9)}


@pytest.mark.parametrize(("title", "cid", "letter", "keywords", "phrase"), [("WCCU Letter 14 - Monthly Update Notice", "wccu", "014", ["wccu", "notice"], "Monthly Update Notice"), ("x DL020 ab cde cde", None, "020", ["dl020", "cde", "cde"], "x  ab cde cde"), (None, None, None, [], ""), ("NEWS for WCCU", "news", None, ["news", "wccu"], "for WCCU")])
def test_title(spark, title, cid, letter, keywords, phrase):
    (r,) = planner.title_intent(spark.createDataFrame([(title,)], "title string")).collect()
    assert (r.title_cid, r.letter_number, r.keywords, r.phrase) == (cid, letter, keywords, phrase)


def test_job_family(spark):
    names = {"wccudla": "wccudl", "wccuds1": "wccuds", "wccu": "wccu", "abcde": "abcde", "abcd12": "abcd1"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.f for r in df.select("n", planner.job_family(F.col("n")).alias("f")).collect()} == names


def test_plan(spark):
    nodes, edges = small_graph(spark)
    have = files(
        spark, ("procs/wccuds1.procs", "procs", PROC), ("control/wccuds014.control", "control", 'format_dfa = "WCCUDL014"\nx_format_dfa="WCCUDL020"'), ("control/wccuds020.control", "control", 'format_dfa="WCCUDL020"'),
        ("control/other_wccu.control", "control", ""), ("docdef/WCCUDL014.dfa", "docdef", ""), ("docdef/wccudl020.dfa", "docdef", ""), ("insert/wccu/wccuds1.ins", "insert", ""), ("master/a.sh", "script", ""),
        ("master/wccuds1_help.pl", "script", ""), ("bin/run_wccuds1.sh", "script", ""),
    )
    fields = checkpointed(procs.with_json(procs.parse_procs(have.filter("kind = 'procs'"))))
    asked = spark.createDataFrame([("i", "WCCU", "ds1", "Letter 14 - Acme Credit"), ("k", None, None, "nobody acme"), ("j", None, "ds1", None)], "intent_id string, cid string, job_id string, title string")
    intents = checkpointed(planner.build_intents(asked))
    cand = checkpointed(planner.find_candidates(intents, nodes, fields))
    assert {(r.intent_id, r.proc_name, r.exact) for r in cand.collect()} == {("i", "wccuds1", True), ("i", "wccuds2", False), ("k", "wccuds1", False)}
    bundle = checkpointed(planner.build_bundles(cand, intents, nodes, edges, fields, have))
    got = {(r.path, r.source) for r in bundle.filter("intent_id = 'i' and proc_name = 'wccuds1'").collect()}
    assert got == {
        ("procs/wccuds1.procs", "proc_file"), ("master/a.sh", "RUNS_edge"), ("insert/wccu/wccuds1.ins", "procs_file_setup"), ("control/wccuds014.control", "control_match"), ("docdef/WCCUDL014.dfa", "control_format_dfa"),
        ("master/wccuds1_help.pl", "helper_prefix_match"), ("bin/run_wccuds1.sh", "cidjob_wildcard_match"),
    }
    score = {(r.intent_id, r.proc_name): r.score for r in planner.score_candidates(cand, bundle, intents, fields).collect()}
    assert score["i", "wccuds1"] == 50 + 15 + 10 + 10 + 10 + 5 + 30 + 2 * 2
    assert score["i", "wccuds2"] < score["i", "wccuds1"]
    edges_ = {(r.dst, r.label) for r in graph.diagram_edges(bundle.filter("proc_name = 'wccuds1' and intent_id = 'i'"), graph.mentions(have)).collect()}
    assert {("a.sh", "RUNS"), ("wccuds1.ins", "READS"), ("wccuds014.control", "control"), ("WCCUDL014.dfa", "dfa")} <= edges_


def test_similar(spark):
    cards = spark.createDataFrame(
        [(1, "s", 0, ["A", "b"], None, None, ["/x.pl"]), (2, "s", 1, ["z"], "cause", None, None), (3, "t", 0, ["a", "b", "c", "d", "e", "f", "g"], "far", None, None), (4, "t", 1, None, "none", None, None), (5, "u", 0, ["a", "B"], "same", None, None)],
        "id long, source_path string, chunk_id long, signals array<string>, root_cause string, fix_summary string, related_files array<string>",
    )
    queries = spark.createDataFrame([("q", ["a", "B", "B"], ["/X.pl"]), ("none", [], None), ("null", None, None)], "query_id string, signals array<string>, files array<string>")
    got = [(r.case_id, r.score, r.root_cause) for r in similarity.similar_cases(queries, cards).orderBy("place").collect()]
    assert got == [(1, 1.0, "cause"), (5, 1.0, "same")]
    assert {(r.case_set, r.n_cases, r.jaccard) for r in similarity.jaccard(queries, cards).collect()} == {(1, 2, 1.0), (3, 1, round(2 / 7, 6))}


def _moves_sets(df):
    """Whether a join of the plan carries arrays along, besides those of its texts."""

    def walk(plan):
        return plan.nodeName() == "Join" and '"type":"array"' in plan.schema().json() or any(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().optimizedPlan())


def _long_log(spark):
    cards = [(i, "s", 0, [f"C{3 * i}", f"c{3 * i + 1}"], "cause", None, []) for i in range(40)] + [(90, "s", 0, [f"c{i}" for i in range(0, 3000, 2)], "half", None, ["/F"]), (91, "s", 0, [f"C{i}" for i in range(3000)], "same", None, [])]
    cards = spark.createDataFrame(cards, "id long, source_path string, chunk_id long, signals array<string>, root_cause string, fix_summary string, related_files array<string>")
    return spark.createDataFrame([("log", [f"C{i}" for i in range(3000)], ["/f"]), ("short", ["c0"], [])], "query_id string, signals array<string>, files array<string>"), cards


def test_similar_to_a_long_log(spark):
    found = similarity.similar_cases(*_long_log(spark))
    assert not _moves_sets(found)
    assert {(r.query_id, r.place, r.case_id, r.score) for r in found.collect()} == {("log", 1, 91, 1.0), ("log", 2, 90, 0.7), ("short", 1, 0, 0.5)}


def test_jaccard_of_a_long_log(spark):
    queries, cards = _long_log(spark)
    assert not _moves_sets(similarity.jaccard(queries, cards))
    got = {(r.query_id, r.case_set): r.jaccard for r in similarity.jaccard(queries, cards).collect()}
    assert len(got) == 45 and got["log", 90] == 0.5 and got["log", 91] == 1.0 and got["log", 5] == round(2 / 3000, 6) and got["short", 0] == 0.5
    assert {(r.query_id, r.case_set) for r in similarity.jaccard(queries, cards, 0.5).collect()} == {("log", 90), ("log", 91), ("short", 0)}


def test_pack_of_a_long_log(spark):
    lines = spark.createDataFrame([("log", i, f"PPCS{i}E failed") for i in range(1000, 2000)], "log_path string, line_no long, line string")
    cards = [(1, "s", 0, "A", [f"ppcs{i}e" for i in range(1000, 1800)], "cause", None, ["c1"], None), (2, "t", 0, "B", ["PPCS1000E"], "far", None, None, None)]
    cards = spark.createDataFrame(cards, "id long, source_path string, chunk_id long, title string, signals array<string>, root_cause string, fix_summary string, verify_commands array<string>, related_files array<string>")
    nodes = spark.createDataFrame([], "id long, key string, type string, display_name string, original_path string, canonical_path string")
    edges = spark.createDataFrame([], "id long, src long, dst long, rel_type string")
    codes = spark.createDataFrame([], "entry_id long, code string, severity string, title string, body string, source_path string, created_at timestamp")
    rows = explain.explain_rows(lines, nodes, edges, codes, cards)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan
    assert [r.text for r in rows.filter("section = 6").collect()] == ["case 1 score 0.800 | c1"]
