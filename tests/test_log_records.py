"""Log entries: each layout, continuation, blocks, and odd rows."""

from datetime import datetime

import pytest

from opslens.operators import log_records as L

SCHEMA = "log_path string, line_no long, line string, received_at timestamp_ntz, level string, code int"
AT = datetime(2026, 2, 14, 1, 0, 0)
LOG = "/d/abcd/abcdds1_process.20260214.log"
SEC = 1771037606  # 2026-02-14 02:53:26 UTC


def rows_of(spark, lines, path=LOG, with_message=False):
    df = spark.createDataFrame([(path, i, x, AT, "x", 0) for i, x in enumerate(lines, 1)], SCHEMA)
    return sorted(L.log_records(df, with_message).collect(), key=lambda r: (str(r.log_path), r.first_line))


@pytest.mark.parametrize(
    ("line", "sec", "severity", "code"),
    [
        ("2026-02-14/02:53:26.208 PPDG1598F [a/b.cpp,159] x", SEC, "F", "PPDG1598F"),
        ("2026-02-14T02:53:26Z level=warn comp=x msg=\"PPDG1598F y\"", SEC, "W", "PPDG1598F"),
        ("14.02.2026 02:53:26,140 | E | LOADER | PPWM5354I 0 errors", SEC, "E", "PPWM5354I"),
        ("[14/Feb/2026:03:53:26 +0100] sev=I (intake) ORA-00942 x", SEC, "I", "ORA-00942"),
        ('{"ts": 1771037606541, "lvl": "trace", "mod": "intake", "msg": "PPAP1111W"}', SEC, "I", "PPAP1111W"),
        ('{"ts": 1771037606, "msg": "x"}', SEC, "", ""),
        ("2026-02-14 02:53:26.532 CRITICAL [compose-3] PPFP3999I w", SEC, "F", "PPFP3999I"),
        ("2026-02-14 02:53:26.532 [compose-3] PPFP3999W w", SEC, "W", "PPFP3999W"),
        ("Sat Feb 14 02:53:26 2026 *** SEVERE *** sorter: x", SEC, "E", ""),
        ("Feb 14 02:53:26 bx9 loader[12186]: PANIC: x", SEC, "F", ""),
        ("2026-02-14 02:53:26", SEC, "", ""),
    ],
)
def test_layouts(spark, line, sec, severity, code):
    (r,) = rows_of(spark, [line])
    assert (r.first_line, r.last_line, r.ts_sec, r.severity, r.code) == (1, 1, sec, severity, code)


def test_continuation(spark):
    lines = ["lead", "2026-02-14 02:53:26", "ORA-12345: first", "", "    run date 2026-02-14 03:00:00", "> 2026-02-14 02:53:26.000 ERROR [x] quoted", "", None, "2026-02-31/02:53:26.208 no such day", "2026-02-14/02:53:27.000 PPDG1598I next", "  "]
    a, b = rows_of(spark, lines, with_message=True)
    assert (a.first_line, a.last_line, a.severity, a.code) == (2, 9, "E", "ORA-12345")
    assert (b.first_line, b.last_line, b.ts_sec - a.ts_sec) == (10, 10, 1)
    assert a.message.startswith("ORA-12345: first") and a.message.endswith("no such day") and b.message.startswith("PPDG1598I next")


def test_blocks_duplicates_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", 4)
    head = "2026-02-14/02:53:26.208 PPDG1598I x"
    data = [(LOG, 1, head)] + [(LOG, i, f"part {i}") for i in range(2, 15)] + [(LOG, 15, head), (LOG, 15, head), (LOG, 16, ""), (LOG, None, head), (None, 1, head), ("/d/other.log", 3, "no entry")]
    df = spark.createDataFrame([(p, n, x, AT, "x", 0) for p, n, x in data], SCHEMA)
    got = {(r.log_path, r.first_line, r.last_line) for r in L.log_records(df).collect()}
    assert got == {(LOG, 1, 14), (LOG, 15, 15), (None, 1, 1)}
    late = spark.createDataFrame([(LOG, 1, "old", AT, "x", 0), (LOG, 1, head, datetime(2026, 2, 15), "x", 0)], SCHEMA)
    assert L.log_records(late).count() == 1
    assert L.log_records(df.limit(0)).count() == 0
    assert L.log_records(df.drop("received_at")).count() == 3
    long = spark.createDataFrame([(LOG, 1, head + " " + "y" * 200_000, AT, "x", 0)], SCHEMA)
    assert L.log_records(long).count() == 1
