import base64
import json
import zlib
from datetime import datetime, timedelta

import pytest

from opslens.operators.diffs import capped_diffs
from opslens.plans import render
from opslens.sources import resolve


def test_plan_texts(spark):
    scores = spark.createDataFrame([("i", 1, "a1", 90), ("i", 2, "b1", 15)], "intent_id string, place int, proc_name string, score int")
    bundle = spark.createDataFrame([("i", "a1", "procs/a1.procs", "procs", "proc_file", 1), ("i", "a1", "m/x.sh", "script", "RUNS_edge", 2), ("i", "b1", "no", "script", "RUNS_edge", 2)], "intent_id string, proc_name string, path string, kind string, source string, step int")
    text = render.plan_text(scores, bundle, "i")
    assert "a1 (score 90)" in text and "[script] m/x.sh  (RUNS_edge)" in text and "2. b1 (15)" in text and "no  (" not in text
    assert render.plan_text(scores, bundle, "none", "ru") == "подходящих процедур нет"
    assert [f["path"] for f in json.loads(render.plan_json(scores, bundle, "i"))["files"]] == ["procs/a1.procs", "m/x.sh"]
    assert {(r.kind, r.src, r.dst) for r in resolve.workspace_manifest(bundle.filter("proc_name = 'a1'")).collect()} == {("procs", "procs/a1.procs", "code/procs/a1.procs"), ("script", "m/x.sh", "code/master/x.sh")}


def test_match_and_diagram(spark):
    scores = spark.createDataFrame([("l", 1, "prefix_exact", "a", 20), ("l", 1, "cid", "a", 3), ("l", 2, "cid", "a", 3)], "log_path string, node_id long, strategy string, token string, points int")
    nodes = spark.createDataFrame([(1, "proc:a"), (2, "proc:b")], "id long, key string")
    assert render.match_text(scores, nodes, "l") == "1. proc:a 2.3\n   +0.3 cid:a\n   +2.0 prefix_exact:a\n2. proc:b 0.3\n   +0.3 cid:a"
    edges = spark.createDataFrame([("a", "a", "x.sh", "RUNS"), ("a", "a", "y.ins", "READS")], "proc_name string, src string, dst string, label string")
    code = render.diagram(edges, "a")
    assert "n_a -->|RUNS| n_x_sh" in code and "READS" not in render.diagram(edges, "a", scripts_only=True)
    packed = render.diagram_link(code).rsplit(":", 1)[1]
    assert json.loads(zlib.decompress(base64.urlsafe_b64decode(packed + "=" * (-len(packed) % 4))))["code"] == code
    assert render.prompt("PACK").endswith("PACK")
    assert render.size_estimate(spark.createDataFrame([(1, "x" * 9), (2, None)], "id long, t string"), "id", "t").collect()[0].tokens == 2


def test_places(spark, tmp_path):
    snap = tmp_path / "all" / "s1"
    (snap / "refs" / "m").mkdir(parents=True)
    assert resolve.histories_folder(str(snap)) is None and resolve.histories_folder(str(snap), "/none") is None
    (tmp_path / "all" / "histories").mkdir()
    assert resolve.histories_folder(str(snap)) == str(tmp_path / "all" / "histories")
    (snap / "refs" / "m" / "b.pdf").write_bytes(b"")
    assert resolve.manual_file(str(snap)).endswith("b.pdf") and resolve.manual_file(str(snap), "/none") is None
    assert resolve.snapshots(str(tmp_path / "all")) == ["histories", "s1"]
    assert resolve.inside(str(snap), "a/b") and not resolve.inside(str(snap), "../x")
    assert resolve.safe_name(" a/b c.txt") == "_a_b_c.txt"
    with pytest.raises(ValueError, match="no usable name"):
        resolve.safe_name("..")
    now = datetime(2026, 1, 31)
    assert [resolve.age_note(now - timedelta(days=d), now) for d in (7, 8, 31)] == [None, "INFO", "WARN"]
    change = tmp_path / "USER.12"
    change.mkdir()
    (change / "b.sh.diff").write_text("+x")
    (change / "a.txt.diff").write_text("+y")
    (change / "12.txt").write_text("Description: d")
    diffs, report = resolve.change_folder(spark, str(change))
    assert {(r.file, r.state) for r in capped_diffs(diffs).collect()} == {("b.sh", "taken"), ("a.txt", "other_type")}
    assert report.count() == 1
