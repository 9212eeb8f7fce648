"""Planner tiers, search forms, gates before patterns and reports, with literal expected values."""

import re

import pytest
from pyspark.sql import functions as F

from opslens.functions.textexpr import literals_of, matches
from opslens.operators import diffs, external_signals, graph, hypotheses, matching, planner, procs, search, similarity
from opslens.operators.log_signals import ERROR_SIGNATURES, STRONG_FAILURE
from opslens.plans import explain
from opslens.rules import RULES


def lines(spark, *texts, log="a.log"):
    return spark.createDataFrame([(log, i, t) for i, t in enumerate(texts, 1)], "log_path string, line_no long, line string")


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)missing\s+(?:input|file)", ("missing",)), (r"a(b|c)d", ("a",)), (r"colou?r", ("colo",)), (r"x{2}yz", ("yz",)), (r"one|two three", ("one", "two three")),
        (r"\d+|x", ()), (r"[abc]+", ()), (r"a\.b\[c", ("a.b[c",)), (r"(?:x|y)?abc$", ("abc",)), (r"[]x]ab", ("ab",)), ("", ()),
    ],
)
def test_plain_texts_of_patterns(pattern, want):
    assert literals_of(pattern) == want


def test_plain_texts_are_in_every_match():
    texts = ["ERROR: missing   file x", "ora-12170 ORA-12170 failed", "Connection refused", "status code: 503", "PPDE1234E", "CSV file a is bad", "SQLSTATE[08001]", "read timed out"]
    for p in [*ERROR_SIGNATURES, *STRONG_FAILURE, *[x for r in RULES for x, _ in r.groups()], *[r[1] for r in hypotheses.LINE_RULES]]:
        for t in texts:
            if re.search(p, t) or re.search("(?i)" + p.removeprefix("(?i)"), t):
                need = literals_of(p)
                assert not need or any(x in t.lower() for x in need), (p, t)


def test_gate_changes_nothing(spark):
    df = lines(spark, "ERROR: Missing\tfile", "no file", "Permission DENIED", "", "abc F1234F").withColumn("low", F.lower("line"))
    for p in STRONG_FAILURE:
        r = df.select(F.col("line").rlike(p).alias("a"), matches("line", "low", p).alias("b")).collect()
        assert all(x.a == x.b for x in r)


FILES = [
    ("procs/wccudla.procs", "procs", "Firm: Alder Credit\nCID: WCCU\nJob ID: dla\nFile Setup Before Processing:\n/home/insert/wccu1.ins\n"),
    ("procs/wccuds1.procs", "procs", "Firm: Alder Credit\nCID: WCCU\nApplication Type: Monthly Notice\n"),
    ("procs/bkfnds1.procs", "procs", "Firm: Harbor Savings\nCID: BKFN\n"),
    ("control/wccudl014.control", "control", 'x_format_dfa="WCCUDL014"\n'), ("control/wccudl020.control", "control", 'format_dfa = WCCUDL020\n'), ("control/bkfnds1.control", "control", ""),
    ("docdef/wccudl014.dfa", "docdef", ""), ("docdef/WCCUDL020.dfa", "docdef", ""), ("insert/wccu1.ins", "insert", ""),
    ("master/wccudla_help.pl", "script", "calls other.sh and ghost.pl"), ("master/wccu_run.sh", "script", "other.sh here"), ("master/other.sh", "script", None),
]


@pytest.fixture(scope="module")
def plan(spark):
    files = spark.createDataFrame([(i, *f) for i, f in enumerate(FILES)], "id long, path string, kind string, text_content string")
    fields = procs.with_json(procs.parse_procs(files.filter("kind = 'procs'")))
    names = ["wccudla", "wccuds1", "bkfnds1"]
    nodes = [(i, "proc", f"proc:{n}", n, f"procs/{n}.procs", None) for i, n in enumerate(names)] + [(10, "script", "script:wccu_run.sh", "wccu_run.sh", "master/wccu_run.sh", "/home/master/wccu_run.sh")]
    nodes = spark.createDataFrame(nodes, "id long, type string, key string, display_name string, canonical_path string, original_path string")
    edges = spark.createDataFrame([(1, 0, 10, " runs")], "id long, src long, dst long, rel_type string")
    asked = [("letter", None, None, "WCCU Letter 14 - Monthly Notice"), ("key", "WCCU", "DLA", None), ("word", None, None, "harbor files"), ("none", None, None, None)]
    asked = spark.createDataFrame(asked, "intent_id string, cid string, job_id string, title string")
    scores, bundles, scope = planner.generate_plan(asked, nodes, edges, fields, files)
    return scores.collect(), bundles.collect(), scope.collect(), bundles, files


def test_plan_tiers(plan):
    scores, bundles, scope, _, _ = plan
    got = {(r.intent_id, r.proc_name): r.score for r in scores}
    # names of fields count as words too (files); dla: client 15, script 10, insert 10, control 10, definition 5, keyword wccu 2; ds1: client 15, phrase 30, keywords wccu and notice
    assert got["letter", "wccudla"] == 52 and got["letter", "wccuds1"] == 15 + 30 + 4
    assert got["key", "wccudla"] == 100 and got["word", "bkfnds1"] == 10 + 2 + 2 and ("none", "bkfnds1") not in got
    files = {(r.path, r.source) for r in bundles if r.intent_id == "letter" and r.proc_name == "wccudla"}
    assert ("control/wccudl014.control", "control_match") in files and ("docdef/wccudl014.dfa", "control_format_dfa") in files
    assert not [p for p, _ in files if "020" in p]
    every = {r.path for r in bundles if r.intent_id == "key" and r.proc_name == "wccudla"}
    assert {"control/wccudl014.control", "control/wccudl020.control", "docdef/WCCUDL020.dfa"} <= every
    assert {r.intent_id for r in scope} == {"letter", "key", "word"}


def test_diagram_with_helpers(plan):
    _, _, _, bundles, files = plan
    one = bundles.filter("intent_id = 'key' and proc_name = 'wccudla'")
    got = {(r.src, r.dst, r.label) for r in graph.diagram_edges(one, graph.mentions(files.filter("kind = 'script'"))).collect()}
    assert ("wccudla", "wccu_run.sh", "RUNS") in got and ("wccudla", "wccudla_help.pl", "helper") in got and ("wccudla", "wccu1.ins", "READS") in got


def test_calls_keep_missing_scripts(spark, plan):
    scripts = plan[4].filter("kind = 'script'")
    got = {(r.caller, r.callee, r.exists) for r in graph.calls(scripts).collect()}
    assert got == {("wccudla_help.pl", "other.sh", True), ("wccudla_help.pl", "ghost.pl", False), ("wccu_run.sh", "other.sh", True)}
    known = spark.createDataFrame([("ghost.pl",)], "name string")
    assert [tuple(r) for r in graph.calls(scripts, known).collect()] == [("wccudla_help.pl", "ghost.pl", False)]
    assert graph.mentions(scripts).count() == 2


def test_call_tree_says_what_it_leaves_out(spark):
    calls = spark.createDataFrame([("a.sh", f"b{i}.sh") for i in range(9)], "caller string, callee string")
    assert graph.call_tree(calls, "a.sh").count("\n") == 9
    short = graph.call_tree(calls, "a.sh", limit=4)
    assert short.count("── ") == 3 and "left out" in short


def test_near_and_first(spark):
    texts = [(1, "red fox runs far from the blue hen", "a/b.txt"), (2, "fox and hen", "fox/x.txt"), (3, "the blue hen", "c.txt")]
    docs = spark.createDataFrame(texts, "id long, text string, path string")
    index = search.build_index(docs, "id", "text", "path")
    ids = lambda q: sorted(r.doc_id for r in search.find(index, q).collect())
    assert ids("NEAR(fox hen, 1)") == [2] and ids("NEAR(fox hen)") == [1, 2] and ids('NEAR(fox "blue hen", 4)') == [1] and ids('NEAR(fox "blue hen", 3)') == []
    assert ids("^red") == [1] and ids("^fox") == [2] and ids("^hen") == [] and ids('"x txt fox"') == [] and ids("NEAR(") == [] and ids("b NOT ^the") == [1]
    got = docs.select(search.snippet("text", "hen OR zebra").alias("s")).collect()
    assert got[1].s == "fox and >>>hen<<<" and spark.createDataFrame([("é " * 90 + "Über all",)], "t string").select(search.snippet("t", "uber").alias("s")).first().s.endswith(">>>Über<<< all")
    assert docs.select(search.snippet("text", "zebra").alias("s")).first().s == texts[0][1]


def test_empty_scope_filters_nothing(spark):
    files = spark.createDataFrame([(1, "procs/a", "procs", "x"), (2, "master/b", "script", "x")], "id long, path string, kind string, text_content string")
    assert search.of_kind(files, scope=files.limit(0).select("path")).count() == 2 and search.of_kind(files, scope=files.filter("id = 1").select("path")).count() == 1


def test_signals_of_a_long_log(spark, monkeypatch):
    monkeypatch.setattr(external_signals, "BLOCK_LINES", 3)
    texts = ["", "message_id 7 not found in infotrac", "Connection refused", '{"success": false, "message": "file was locked"}', "message_id 8 not found in infotrac", "message_id 7 not found in infotrac", "access denied"]
    df = lines(spark, *texts)
    got = [(r.rule_id, r.captures, r.severity, r.n_evidence, r.first_line) for r in external_signals.external_signals(df).orderBy("place").collect()]
    assert got == [
        ("INFOTRAC_MISSING_MESSAGE_ID", "message_id=7", "F", 2, 2), ("INFOTRAC_MISSING_MESSAGE_ID", "message_id=8", "F", 1, 5), ("CONNECTION_REFUSED", "", "F", 1, 3),
        ("API_ERROR_MESSAGE_JSON", "api_message=file was locked", "E", 1, 4), ("API_SUCCESS_FALSE_JSON", "", "E", 1, 4), ("AUTH_FAILURE", "", "E", 1, 7),
    ]
    assert [r.place for r in external_signals.external_signals(df).orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
    ev = {(r.captures, r.ord): r.line_no for r in external_signals.evidence_lines(df, max_evidence=1).collect()}
    assert ev["message_id=7", 1] == 2 and all(k[1] == 1 for k in ev)


def test_confirm_steps(spark):
    rows = {r.rule: r.confirm for r in hypotheses.hypotheses(lines(spark, "ORA-12170 failed", "Connection refused")).collect()}
    assert rows["oracle"].split("|")[0] == hypotheses.CONFIRM["oracle"][0] and rows["CONNECTION_REFUSED"]
    assert set(hypotheses.CONFIRM) == {r[0] for r in hypotheses.LINE_RULES}


def test_case_reports(spark):
    cards = [(1, "s1", 0, "A", ["x"], "cause", None, ["c1", "c2", "c3", "c4"], None), (2, "s1", 1, "B", ["x"], None, None, ["own"], None), (3, "s2", 0, "C", ["x"], None, None, ["c"], None), (4, None, 0, "D", ["x"], None, "fix", None, None)]
    cards = spark.createDataFrame(cards, "id long, source_path string, chunk_id long, title string, signals array<string>, root_cause string, fix_summary string, verify_commands array<string>, related_files array<string>")
    asked = spark.createDataFrame([("q", ["X"], ["f"])], "query_id string, signals array<string>, files array<string>")
    got = [(r.case_id, r.root_cause, r.fix_summary, r.verify_commands) for r in similarity.case_report(similarity.similar_cases(asked, cards, top=9), cards).orderBy("place").collect()]
    assert got == [(1, "cause", None, ["c1", "c2", "c3"]), (4, None, "fix", [])]
    assert similarity.jaccard(asked, cards, 1.1).count() == 0 and similarity.jaccard(asked, cards, 1.0).count() == 1


def test_only_the_client_speaks(spark):
    nodes = spark.createDataFrame([(i, "proc", f"proc:abcd{x}", f"abcd{x}", None, None) for i, x in enumerate(["ds1", "ds2", "mt1", "zz9"])], "id long, type string, key string, display_name string, canonical_path string, original_path string")
    edges = spark.createDataFrame([], "id long, src long, dst long, rel_type string")
    logs = spark.createDataFrame([("/d/abcd/other.log", 1, "x"), ("/d/abcd/abcdmt1_process.log", 1, "x")], "log_path string, line_no long, line string")
    for top in (1, 2):
        got = {(r.log_path, r.place): (r.node_id, r.points) for r in matching.match_logs(logs, nodes, edges, top).collect()}
        assert got["/d/abcd/other.log", 1] == (0, 3) and got["/d/abcd/abcdmt1_process.log", 1] == (2, 13) and len(got) == 2 * top
    assert matching.match_scores(logs, nodes, edges).filter("strategy = 'cid'").count() == 8


def test_scripts_by_the_end_of_their_path(spark):
    nodes = [(1, "proc", "proc:p", "p", None, None), (2, "script", "script:run.sh", "Run it", None, "/home/master/abcd_run.sh")]
    nodes = spark.createDataFrame(nodes, "id long, type string, key string, display_name string, canonical_path string, original_path string")
    edges = spark.createDataFrame([(1, 1, 2, "RUNS")], "id long, src long, dst long, rel_type string")
    names = {r.token for r in matching.script_names(nodes, edges).collect()}
    assert {"Run it", "abcd_run.sh", "run.sh"} <= names and "abcd" not in names


def test_diffs_in_order(spark):
    rows = [("c", 1, "a.sh", "x" * 60), ("c", 2, "b.sh", "y" * 50), ("c", 3, "c.sh", "z" * 30), ("c", 4, "d.txt", "z"), ("c", 5, "e.sh", " \n"), (None, 1, "f.sh", "q" * 200), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "change_id string, ord long, file string, diff string")
    got = {(r.change_id, r.ord): (r.state, r.size) for r in diffs.capped_diffs(df, max_total=100, max_file=80).collect()}
    assert got == {("c", 1): ("taken", 60), ("c", 2): ("over_total", 50), ("c", 3): ("taken", 30), ("c", 4): ("other_type", 1), ("c", 5): ("empty", 2), (None, 1): ("truncated", 80), ("d", 1): ("other_type", 0)}


def test_files_that_a_log_names(spark):
    tokens = spark.createDataFrame([("l", "docdef_token", "WCCUDL14"), ("l", "script_path", "/home/master/a.sh"), ("l", "script_path", "/home/util/b.sh"), ("l", "io_path", "/d/x.csv"), ("l", "jid", "j")], "log_path string, kind string, token string")
    files = spark.createDataFrame([("docdef/wccudl14.dfa",), ("master/a.sh",)], "path string")
    got = [r.text for r in explain.log_files(tokens, files).orderBy("ord").collect()]
    assert got == ["WCCUDL14 -> docdef/wccudl14.dfa", "/home/master/a.sh -> master/a.sh", "/home/util/b.sh (not in the snapshot)", "/d/x.csv"]


def test_incidents_over_batches(spark, tmp_path):
    from opslens.operators.store import upsert_incidents
    from opslens.streaming.inbox import arriving, keep_incidents

    schema = "log_path string, top_node_key string, confidence double, at timestamp, loaded_at timestamp"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", "k1", 0.5, "2026-01-01 00:00:00", "2026-01-01 01:00:00")], [("a", "k2", 0.7, "2026-01-02 00:00:00", "2026-01-02 01:00:00"), ("a", "k1", 0.5, "2026-01-01 00:00:00", "2026-01-01 01:00:00")], [("b", None, None, "2026-01-03 00:00:00", None), ("a", "k0", 0.1, "2025-12-31 00:00:00", None)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "log_path string, top_node_key string, confidence double, at string, loaded_at string")
        df.withColumn("at", F.col("at").cast("timestamp")).withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
        keep_incidents(arriving(spark, inbox, schema), out, str(tmp_path / "cp")).awaitTermination(90)
    got = sorted(map(str, spark.read.parquet(f"{out}/incidents").collect()))
    assert got == sorted(map(str, upsert_incidents(spark.read.parquet(inbox)).collect())) and len(got) == 2
