"""Requests by keyword: every pair of request and proc is in the result, none is kept or moved on the way."""

import pytest

from opslens.operators import planner, procs

N_PROCS, N_ASKED = 40, 60


@pytest.fixture(scope="module")
def asked_by_word(spark):
    names = [f"ab{chr(97 + i // 26)}{chr(97 + i % 26)}ds{i % 3}" for i in range(N_PROCS)]
    files = [(f"procs/{n}.procs", "procs", f"Firm: Card Statement {'Harbor' if i % 8 == 0 else 'x'}\nJob ID: ds{i % 3}\nLog File: /home/{n[:4].upper()}DL014\n") for i, n in enumerate(names)]
    files += [(f"control/{names[3]}_014.control", "control", f'format_dfa="{names[3][:4].upper()}DL014"'), (f"control/{names[3]}.control", "control", ""), (f"docdef/{names[5][:4].upper()}DL014.dfa", "docdef", ""), (f"docdef/{names[3][:4]}dl014.dfa", "docdef", "")]
    files += [("master/run.sh", "script", "other.sh"), ("master/zzzzds1.sh", "script", ""), (f"master/{names[7]}_help.pl", "script", "")]
    files = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, path string, kind string, text_content string")
    fields = procs.with_json(procs.parse_procs(files.filter("kind = 'procs'")))
    nodes = [(i, "proc", f"proc:{n}", None) for i, n in enumerate(names)] + [(100, "script", "script:run.sh", "master/run.sh")]
    nodes = spark.createDataFrame(nodes, "id long, type string, key string, canonical_path string")
    edges = spark.createDataFrame([(i, i, 100, "RUNS") for i in range(0, N_PROCS, 2)], "id long, src long, dst long, rel_type string")
    asked = [(f"a{i}", None, None, f"card statement {'harbor' if i % 2 else 'card'} {i} DL014") for i in range(N_ASKED - 2)] + [("job", "zzzz", "ds1", "card statement"), ("client", names[3][:4], None, None)]
    return names, spark.createDataFrame(asked, "intent_id string, cid string, job_id string, title string"), nodes, edges, fields, files


def _kept(monkeypatch) -> list[int]:
    """Rows of everything that the planner keeps from now on."""
    rows, kept = [], planner.checkpointed
    monkeypatch.setattr(planner, "checkpointed", lambda df: (out := kept(df), rows.append(out.count()))[0])
    return rows


def test_bundles_of_a_common_word(spark, asked_by_word, monkeypatch):
    names, asked, nodes, edges, fields, files = asked_by_word
    monkeypatch.setattr(planner, "BLOCK", 8, raising=False)
    rows = _kept(monkeypatch)
    got = [tuple(r) for r in planner.find_bundles(planner.build_intents(asked), nodes, edges, fields, files).collect()]
    assert max(rows) < N_PROCS * (N_ASKED - 1) / 4
    want = []
    for who in [f"a{i}" for i in range(N_ASKED - 2)] + ["job"]:
        for i, n in enumerate(names):
            want.append((who, n, f"procs/{n}.procs", "procs", "proc_file", 1))
            if i % 2 == 0:
                want.append((who, n, "master/run.sh", "script", "RUNS_edge", 2))
            if i == 7:
                want.append((who, n, f"master/{n}_help.pl", "script", "helper_prefix_match", 6))
            if who == "job":
                want.append((who, n, "master/zzzzds1.sh", "script", "cidjob_wildcard_match", 7))
            elif i == 3:
                want += [(who, n, f"control/{n}_014.control", "control", "control_match", 4), (who, n, f"docdef/{n[:4]}dl014.dfa", "docdef", "control_format_dfa", 5)]
            elif i == 5:
                want.append((who, n, f"docdef/{n[:4].upper()}DL014.dfa", "docdef", "procs_dfa_token", 5))
    n = names[3]
    want += [("client", n, f"procs/{n}.procs", "procs", "proc_file", 1), ("client", n, f"docdef/{n[:4]}dl014.dfa", "docdef", "control_format_dfa", 5)]
    want += [("client", n, f"control/{x}.control", "control", "control_match", 4) for x in (n, f"{n}_014")]
    assert sorted(got) == sorted(want)


def test_scores_of_a_common_word(spark, asked_by_word, monkeypatch):
    names, asked, nodes, edges, fields, files = asked_by_word
    monkeypatch.setattr(planner, "BLOCK", 8, raising=False)
    # a proc with two nodes, one with two files of fields, requests that repeat words, with a short phrase, with one of signs, and with a client's files among others' procs
    nodes = nodes.unionByName(spark.createDataFrame([(200, "proc", f"proc:{names[0]}", None)], nodes.schema))
    fields = fields.unionByName(spark.createDataFrame([(names[8], None, '{"firm":"CARD statement harbor -- DL"}')], fields.schema))
    files = files.unionByName(spark.createDataFrame([(900, f"control/{names[39]}_qqqq.control", "control", 'format_dfa="QQQQDL001"'), (901, "docdef/QQQQDL001.dfa", "docdef", "")], files.schema))
    more = [("twice", None, None, "card card statement card DL014"), ("short", None, None, "statement DL014 x"), ("signs", None, None, "QQQQ DL001 -- card"), ("other", "qqqq", None, "card statement x"), ("phrase", None, None, "DL014 - Card Statement"), ("exact", names[6][:4], "ds0", "card"), ("none", None, None, "nothing here")]
    intents = planner.build_intents(asked.unionByName(spark.createDataFrame(more, asked.schema))).localCheckpoint()
    rows = _kept(monkeypatch)
    got = [tuple(r) for r in planner.find_scores(intents, nodes, edges, fields, files).collect()]
    assert max(rows) < N_PROCS * (N_ASKED - 1) / 4
    monkeypatch.undo()
    candidates = planner.find_candidates(intents, nodes, fields).localCheckpoint()
    bundles = planner.build_bundles(candidates, intents, nodes, edges, fields, files).localCheckpoint()
    assert candidates.count() > N_PROCS * (N_ASKED + 3)
    want = [tuple(r) for r in planner.score_candidates(candidates, bundles, intents, fields).collect()]
    assert sorted(got) == sorted(want)
    by = {(r[0], r[1]): r[2:] for r in got}
    # letter's control 10 and definition 5, words card, statement and dl014 2 each; then script 10 and harbor too, twice for the proc with two nodes
    assert by["a1", 1] == (names[3], 21) and by["a1", 2] == by["a1", 3] == (names[0], 18) and by["other", 1] == (names[39], 49) and by["twice", 1][1] > by["short", 1][1] and ("none", 1) not in by
