"""Upserts, search, chunks, manuals, diffs, files, streaming."""

import os
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.operators import code_manual, diffs, history, search, stats, store
from opslens.plans.explain import render_pack
from opslens.plans.render import diff_prompt
from opslens.sources.files import log_lines, scan, texts
from opslens.streaming.inbox import arriving, keep_incidents, severity_counts


def at(h):
    return datetime(2026, 1, 1, h)


def test_incidents(spark):
    rows = [("l", "proc:a", 0.5, at(2), at(3)), ("l", "proc:b", 0.9, at(4), at(5)), ("l", "proc:b", 0.9, at(4), at(5)), ("m", None, None, at(1), at(1))]
    df = spark.createDataFrame(rows, "log_path string, top_node_key string, confidence double, at timestamp_ntz, loaded_at timestamp_ntz")
    got = {r.log_path: tuple(r)[1:] for r in store.upsert_incidents(df).collect()}
    assert got == {"l": ("proc:b", 0.9, at(2), at(4), 2), "m": (None, None, at(1), None, 1)}
    assert [r.log_path for r in stats.recent_incidents(store.upsert_incidents(df), 1).collect()] == ["l"]


def test_cards(spark):
    schema = "source_path string, chunk_id long, content_hash string, title string, created_at timestamp_ntz"
    old = spark.createDataFrame([("s", 0, "h0", "a", at(1)), ("s", 1, "h1", "b", at(1)), ("s", 2, "h2", "c", at(1))], schema)
    new = spark.createDataFrame([("s", 0, "h0", "A", at(2)), ("s", 1, "hX", "B", at(2)), ("s", 3, "h3", "D", at(2)), ("s", 3, "h4", "E", at(3))], schema)
    got = {(r.chunk_id): (r.action, r.content_hash, r.title, r.created_at, r.updated_at) for r in store.merge_cards(old, new).collect()}
    assert got == {0: ("same", "h0", "a", at(1), None), 1: ("updated", "hX", "B", at(1), at(2)), 2: ("kept", "h2", "c", at(1), None), 3: ("inserted", "h4", "E", at(3), None)}
    again = store.merge_cards(store.merge_cards(old, new).select(*old.columns), new)
    assert {r.action for r in again.collect()} == {"same", "kept"}
    assert tuple(store.import_counts(store.merge_cards(old, new)).first()) == (1, 2, 1)


def test_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_table(spark.range(3), path)
    store.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        store.replace_table(bad, path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]


FILES = [(1, "procs/Foo.procs", "procs", "overlay and quota"), (2, "master/bar.sh", "script", "Überlagerung foo page-sorter"), (3, "docdef/x.dfa", "docdef", None), (4, "master/foo2.pl", "master", "sorter page overlay")]


def files(spark):
    return spark.createDataFrame([(*r, 1) for r in FILES], "id long, path string, kind string, text_content string, doc_id long")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_search(spark):
    f = files(spark)
    assert ids(search.search_path(f, "FOO")) == [1, 4] and ids(search.search_path(f, "fo_")) == []
    assert [(r.id, r.in_path) for r in search.search_like(f, "foo", 10).collect()] == [(4, True), (1, True), (2, False)]
    assert ids(search.of_kind(f, "scripts")) != [] and search.of_kind(f, "scripts").count() == 2 and search.of_kind(f, "unknown").count() == 4
    assert search.of_kind(f, "all", f.filter("id = 1").select("path")).count() == 1
    index = search.build_index(f, "id", "text_content")
    for query, want in {"overlay": [1, 4], '"page sorter"': [2], "page-sorter": [2], "uberl*": [2], "overlay AND quota": [1], "overlay NOT quota": [4], "quota OR überlagerung": [1, 2], '"': [], "NOT overlay": [], "a.b(": []}.items():
        assert ids(search.find(index, query)) == want, query
    smart = lambda q: {(r["method"], r.id) for r in search.smart_search(f, q).collect()}
    assert smart("bar") == {("path_substring", 2)} and smart("page sorter") == {("fts_exact", 2)} and smart("quot") == {("fts_prefix", 1)} and smart("orter pa") == {("like_full", 4)} and smart("overl*") == {("fts_raw", 1), ("fts_raw", 4)}


def test_knowledge(spark):
    codes = spark.createDataFrame([(1, "PPCS0001E", "E", "t", "overlay body", "s", at(1)), (2, "OVERLAY1", None, None, None, "s", at(1))], "entry_id long, code string, severity string, title string, body string, source_path string, created_at timestamp_ntz")
    cards = spark.createDataFrame([(7, "s", None, "Overlay lost", None, at(1)), (8, "s", "t", None, "overlay", at(2))], "id long, source_path string, title string, root_cause string, fix_summary string, created_at timestamp_ntz")
    got = [(r.section, r.ref) for r in search.blend(files(spark), codes, cards, "overlay").orderBy("place").collect()]
    assert got == [("knowledge", "message_codes/2"), ("knowledge", "message_codes/1"), ("knowledge", "case_cards/8"), ("knowledge", "case_cards/7"), ("file", "master/foo2.pl#4"), ("file", "procs/Foo.procs#1")]
    web = lambda text, **kw: [(r.section, r.ref) for r in search.web_search(files(spark), codes, cards, text, **kw).orderBy("place").collect()]
    assert web("overlay", space="knowledge")[0] == ("knowledge", "message_codes/2") and len(web("overlay")) == 6
    assert web("foo", mode="path", space="files") == [("file", "master/foo2.pl#4"), ("file", "procs/Foo.procs#1")]
    assert web("verla", kind="procs", space="files") == [("file", "procs/Foo.procs#1")]  # no such word, so by substring
    best = {r.code: r.entry_id for r in store.best_codes(codes.unionByName(codes.withColumn("created_at", F.lit(at(5)).cast("timestamp_ntz")).withColumn("entry_id", F.col("entry_id") + 10))).collect()}
    assert best == {"PPCS0001E": 11, "OVERLAY1": 12}


def fold(text):
    """The rules about chunks, line by line."""
    out, cur, start, blank, code = [], [], 0, 0, False
    for i, line in enumerate(text.split("\n")):
        if line.strip().startswith("```"):
            code = not code
        cut = False
        if not code:
            if re.match(history.SESSION, line) or re.match(history.TURN, line) or line.startswith(("# ", "## ")):
                cut = True
            elif not line.strip():
                blank += 1
                cut = blank >= 3
            else:
                blank = 0
        if cut and cur:
            out.append((start, "\n".join(cur)))
            cur, start, blank = [], i, 0
        cur.append(line)
    out.append((start, "\n".join(cur)))
    return [(s, c) for s, c in out if c.strip()]


def test_chunks_match_fold(spark):
    parts = ["", "", "text", "# head", "## two", "### three", "```", "_**User**_", "<2026-01-01_10-00Z-a.md>", " x ", "\t"]
    texts_ = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.sampled_from(parts), max_size=14))
    def gather(lines):
        texts_.append("\n".join(lines))

    gather()
    rows = [(i, t, "clash") for i, t in enumerate(texts_)]
    got = {}
    for r in history.chunks(spark.createDataFrame(rows, "doc_id long, text string, chunk string")).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk))
    for i, t, _ in rows:
        assert sorted(got.get(i, [])) == fold(t), repr(t)


def test_cards_of_history(spark):
    text = "# Night run\nORA-12170 seen\ngrep -n x /d/a/b.csv\nroot cause: disk full\n\n## Fix\nfreed /d/x/y.pl space"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None), (4, "## Root cause: late feed\n# A\nPermission denied\nprefix was long")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_id): r for r in history.case_cards(docs).collect()}
    assert set(got) == {(1, 0), (1, 5), (4, 1)}
    a = got[1, 0]
    assert (a.title, a.signals, a.verify_commands, a.related_files, a.root_cause, a.tags) == ("Night run", ["ORA-12170"], ["grep -n x /d/a/b.csv"], ["/d/a/b.csv"], "disk full", ["oracle"])
    assert a.fix_summary == "freed /d/x/y.pl space" and len(a.content_hash) == 16 and got[1, 5].tags == ["perl"]
    assert got[4, 1].root_cause == "late feed\n# A\nPermission denied\nprefix was long"[:300] and got[4, 1].fix_summary == "was long"


def test_manual(spark):
    text = "Intro PPCS1037F is here\n  PPCS1037F - Cannot read\nReason: disk\nfull\nSolution: free it\n248/392\nPage 12\nmore\n\x0cPPDE1001I\tNote\nThis message is preceded by: PPCS1037F\nlost\nPPCS1037F x\n1.2 Next\nlost"
    got = {r.code: r for r in code_manual.code_entries(spark.createDataFrame([("m", text), ("n", None)], "source_path string, text string")).collect()}
    assert set(got) == {"PPCS1037F", "PPDE1001I"}
    a = got["PPCS1037F"]
    assert (a.severity, a.title) == ("F", "Cannot read") and a.body == "- Cannot read\nReason: disk full\nSolution: free it more"
    assert got["PPDE1001I"].body == "Note"


def test_diffs(spark):
    rows = [("c", 1, "a.sh", "x" * 90), ("c", 2, "b.py", "y" * 50), ("c", 3, "c.sh", "z" * 10), ("c", 4, "d.txt", "t"), ("c", 5, "e.pl", " \n"), ("c", 6, "F.SH", "q" * 900), ("d", 1, "noext", "x"), ("d", 2, "n.sh", None)]
    df = spark.createDataFrame(rows, "change_id string, ord long, file string, diff string")
    got = {(r.change_id, r.ord): r.state for r in diffs.capped_diffs(df, max_total=120, max_file=100).collect()}
    assert got == {("c", 1): "taken", ("c", 2): "over_total", ("c", 3): "taken", ("c", 4): "other_type", ("c", 5): "empty", ("c", 6): "over_total", ("d", 1): "other_type", ("d", 2): "empty"}
    report = "Description: Fix it\n Parallel ID: 12\nFiles:\n 1) a b.sh \n 2) c.pl\n*****\n 3) no\n"
    (r,) = diffs.report_header(spark.createDataFrame([("r", report)], "report_id string, text string")).collect()
    assert (r.description, r.parallel_id, r.files) == ("Fix it", "12", ["a b.sh", "c.pl"])
    one = df.filter("change_id = 'c' and ord in (1, 4)")
    text = diff_prompt(diffs.report_header(spark.createDataFrame([("r", report)], "report_id string, text string")), one, diffs.capped_diffs(one))
    assert text.startswith("Description: Fix it") and "--- a.sh\n" + "x" * 90 in text and text.endswith("Left out:\n  - d.txt: other_type")


def test_scan(spark, tmp_path):
    root = tmp_path / "snap"
    for name, data in {"procs/a.procs": b"CID: x", "master/x/b.SH": b"bad \xff", "master/c.sh": b"ok", "docdef/d.dfa": b"", "docdef/e.pdf": b"%PDF", "logs/z.log": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.path: (r.kind, r.size, r.text_content, r.sha256 is None) for r in scan(spark, str(root), ("procs", "master", "docdef")).collect()}
    assert got == {"procs/a.procs": ("procs", 6, "CID: x", False), "master/x/b.SH": ("master", 5, None, True), "master/c.sh": ("script", 2, "ok", False), "docdef/e.pdf": ("docdef", 4, None, True)}
    (tmp_path / "l.log").write_bytes(b"one\r\ntwo\n\nfour\n")
    assert [(r.line_no, r.line) for r in log_lines(spark, str(tmp_path), "l.log").orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    assert texts(spark, str(tmp_path), "*.log").count() == 1
    c = stats.classify(spark.createDataFrame([(1, "docdef/a.DFA", 5), (2, "docdef/a.dfa1", 5), (3, "master/x", 5), (4, "procs/a.procs", 2_000_000), (5, None, None)], "id long, path string, size long"))
    assert {r.id: (r.kind, r.keeps_text) for r in c.collect()} == {1: ("docdef", True), 2: ("docdef", False), 3: ("master", True), 4: ("procs", False), 5: (None, False)}


def test_streaming(spark, tmp_path):
    schema = "log_path string, top_node_key string, confidence double, at timestamp_ntz, loaded_at timestamp_ntz"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for h in (1, 2):
        spark.createDataFrame([("l", f"proc:{h}", 0.5, at(h), at(h))], schema).write.mode("append").parquet(inbox)
        keep_incidents(arriving(spark, inbox, schema), out, str(tmp_path / "cp")).awaitTermination(60)
    (r,) = spark.read.parquet(f"{out}/incidents").collect()
    assert (r.top_node_key, r.created_at, r.updated_at, r.n_updates) == ("proc:2", at(1), at(2), 2)
    lines = spark.createDataFrame([("l", 1, "ERROR: x", at(1)), ("l", 2, "fine", at(1)), ("l", 3, "ERROR: y", at(3))], "log_path string, line_no long, line string, received_at timestamp_ntz")
    lines.write.parquet(str(tmp_path / "lines"))
    s = severity_counts(arriving(spark, str(tmp_path / "lines"), lines.schema.simpleString()[7:-1].replace(":", " ")))
    q = s.writeStream.format("memory").queryName("sev").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.severity, r.n) for r in spark.table("sev").collect()) == [("E", 1), ("E", 1), ("I", 1)]


def test_render(spark):
    rows = spark.createDataFrame([("l", 1, 1, "proc:a (0.76)"), ("l", 2, 1, "L1 E x"), ("m", 1, 1, "no")], "log_path string, section int, ord int, text string")
    assert render_pack(rows, "l") == "# l\n\n## MATCHED PROC\n- proc:a (0.76)\n\n## EVIDENCE\n- L1 E x"
