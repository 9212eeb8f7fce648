"""Line signals, tokens, rule pack, hypotheses."""

import pytest
from pyspark.sql import functions as F

from opslens.functions.textexpr import redact
from opslens.operators.external_signals import external_signals, missing_ids, services_seen
from opslens.operators.hypotheses import DEFAULT, WRAPPER_ONLY, hypotheses
from opslens.operators.log_signals import line_signals, log_rollup, log_tokens, path_features
from opslens.rules import RULES, load_rules


def lines(spark, *texts, path="/d/abcd/abcdds1.log"):
    return spark.createDataFrame([(path, i, t, "clash") for i, t in enumerate(texts, 1)], "log_path string, line_no long, line string, rule_id string")


@pytest.mark.parametrize(
    ("line", "code", "severity"),
    [
        ("2026-01-23/09:20:43.527 PPCS8005I ok", "PPCS8005I", "I"),
        ("PPCS1037F fatal", "PPCS1037F", "F"),
        ("PPCS1037F but it failed", "PPCS1037F", "E"),  # an error word makes it an error
        ("PPCS8005I and ORA-12170", "ORA-12170", "E"),
        ("a failure is no keyword", None, "I"),
        ("ERROR: x", None, "E"),
    ],
)
def test_line(spark, line, code, severity):
    (r,) = line_signals(lines(spark, line)).collect()
    assert (r.code, r.severity) == (code, severity)


def test_line_fields_and_noise(spark):
    got = line_signals(lines(spark, "", None, "x is still alive", "y is no longer alive", "  [pcs/pcs.cpp,567] DOCDEF 'ABCDDS11' at foo.pl line 266  ")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_file, r.source_line, r.docdef_ref, r.script_ref, r.script_line) == ("pcs/pcs.cpp", 567, "ABCDDS11", "foo.pl", 266)


def test_tokens_and_rollup(spark):
    df = lines(spark, "$PREFIX=AbCd1 $PREFIX=b $JID=DS1", "docdef=abcdds11 output=/x/y", "ERROR: Permission denied", "PPDE0042F x", "/home/master/a.sh ERROR: Generator returns a non-zero value", "PPCS1037F")
    tokens = {(r.kind, r.token) for r in log_tokens(df).collect()}
    assert {("prefix", "abcd1"), ("prefix", "b"), ("jid", "ds1"), ("docdef_ref", "ABCDDS11"), ("io_path", "/x/y"), ("error_code", "permission denied"), ("error_code", "PPDE0042F"), ("script_path", "/home/master/a.sh")} <= tokens
    (r,) = log_rollup(df).collect()
    assert (r.n_signals, r.n_errors, r.n_fatal, r.has_wrapper_noise, r.has_strong_failure) == (6, 4, 2, True, True)
    assert r.prefixs == "abcd1|b"
    (weak,) = log_rollup(lines(spark, "PPCS1037F")).collect()
    assert not weak.has_strong_failure


def test_path_features(spark):
    paths = ["/d/acbk/acbkds1/sample/acbkds1.log", "/d/daily/aabkdn1/aabkdn1.log", "bkfnds1122.c1bmcok.fgnrs.log", "/tmp/x_process_count.log", "/d/abcd/abcdkx4_msg.20260301.log"]
    df = spark.createDataFrame([(p,) for p in paths], "log_path string")
    got = {r.log_path: (r.cid, r.proc_name, r.base_proc) for r in path_features(df).collect()}
    assert got[paths[0]] == ("acbk", "acbkds1", "acbkds1") and got[paths[1]] == ("aabk", "aabkdn1", "aabkdn1")
    assert got[paths[2]] == ("bkfn", "bkfnds1122", "bkfnds1") and got[paths[3]][1] == "x" and got[paths[4]] == ("abcd", "abcdkx4", "abcdkx4")


def test_rules(spark):
    df = lines(spark, "ok", "", "No data found from message_id: 197131 in infotrac db", '{"success": false, "message": "No data for this message"}', "No data found from message_id: 197131 in infotrac db", "message_id 5 not found in infotrac")
    got = external_signals(df).orderBy("place").collect()
    assert [(r.rule_id, r.captures, r.n_evidence, r.first_line) for r in got] == [
        ("INFOTRAC_MISSING_MESSAGE_ID", "message_id=197131", 2, 3), ("INFOTRAC_MISSING_MESSAGE_ID", "message_id=5", 1, 6),
        ("API_ERROR_MESSAGE_JSON", "api_message=No data for this message", 1, 4), ("API_SUCCESS_FALSE_JSON", "", 1, 4),
    ]
    assert [r.score for r in got] == [47, 47, 35, 33]
    assert {r.message_id for r in missing_ids(df).collect()} == {"197131", "5"}
    assert external_signals(lines(spark, "all is well")).count() == 0


def test_services(spark):
    df = lines(spark, "GET /x?services=Estmt|paper|p", "/services/print/1", '"service_type": "mail"', None)
    assert {r.service for r in services_seen(df).collect()} == {"estmt", "paper", "print", "mail"}


def test_hypotheses(spark):
    only = hypotheses(lines(spark, "ERROR: Generator returns a non-zero value")).collect()
    assert [(r.hypothesis, r.confidence) for r in only] == [(WRAPPER_ONLY, 0.2)]
    real = hypotheses(lines(spark, "ERROR: Generator returns a non-zero value", "ORA-12170 failed", "ERROR: Permission denied")).orderBy("place").collect()
    assert [r.rule for r in real] == ["permission", "oracle", "error"]
    assert [r.hypothesis for r in hypotheses(lines(spark, "nothing")).collect()] == [DEFAULT]
    filled = hypotheses(lines(spark, "services=paper", "No data found from message_id: 7 in infotrac db")).orderBy("place").collect()[0]
    assert filled.hypothesis == "Message id 7 has no mapping for service=paper" and filled.confidence == 0.95 and filled.evidence.startswith("L2: ")
    # RC=8 at the end of a line is not seen, RC=0 before a blank is
    assert [r.rule for r in hypotheses(lines(spark, "done RC=8")).collect()] == ["default"]
    assert [r.rule for r in hypotheses(lines(spark, "RC=0 done")).collect()] == ["return_code"]


def test_rule_file(tmp_path):
    pytest.importorskip("yaml")
    f = tmp_path / "r.yaml"
    f.write_text("rules:\n  - id: A\n    severity: F\n    category: AUTH\n    patterns: ['ok (?P<x>\\d+)', '(']\n  - id: B\n    patterns: ['(']\n")
    (a,) = load_rules(str(f))
    assert a.id == "A" and a.groups() == ((r"ok (\d+)", ("x",)),) and len({r.id for r in RULES}) == 11


@pytest.mark.parametrize(
    ("text", "want"),
    [("mail a.b@c.org now", "mail [EMAIL] now"), ("call 555-123-4567", "call [PHONE]"), ("ssn 123-45-6789", "ssn [SSN]"), ("acct 12345678", "acct [ACCT]"), ("at 20260114123456 and 20260114", "at 20260114123456 and 20260114"), ("no date 20261399", "no date [ACCT]"), ("1234567890", "[PHONE]"), (None, None)],
)
def test_redact(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")).alias("r")).collect()[0].r == want
