import os

import pytest

from opslens.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file")
SCHEMA = "doc_id long, text string, source string, copies int, h string"
TARGETS = "source string, target_share double, max_repeats int, text string"


def docs(spark):
    rows = []
    for s, n in (("big", 900), ("mid", 200), ("small", 40)):
        rows += [(len(rows) + i, "word " * (1 + (i * 37) % 180), s, 1, "x") for i in range(n)]
    rows += [(9001, None, "big", 1, "x"), (9002, "", "mid", 1, "x"), (9003, "text", None, 1, "x"), (9004, "text", "other", 1, "x"), (None, "no id", "big", 1, "x"), (5, "word " * 6, "big", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 100)
    targets = spark.createDataFrame([("big", 0.4, 1, "x"), ("mid", 0.25, 2, "x"), ("small", 0.15, 4, "x"), ("gone", 0.2, 3, "x"), (None, 0.1, 1, "x")], TARGETS)
    rows, report = M.mix(docs(spark), targets)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "small", "gone"}
    assert rep["gone"].tokens_in == 0 and rep["gone"].real_share == 0
    for s in ("big", "mid", "small"):
        assert rep[s].goal_share == pytest.approx(rep[s].target_share / 0.8)
        assert abs(rep[s].real_share - rep[s].goal_share) < 0.01
        assert rep[s].most_copies <= rep[s].max_repeats
    got = rows.collect()
    assert len({(r.doc_id, r.source, r.n_tokens, r.copy_no) for r in got}) >= len(got) - 1
    assert not {9001, 9002, 9003, 9004} & {r.doc_id for r in got}
    again = M.mix(docs(spark), targets)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_total_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1, "x"), ("small", 0.5, 3, "x"), ("small", 0.6, 9, "x")], TARGETS)
    rep = {r.source: r for r in M.mix(docs(spark), targets, total=1e9)[1].collect()}
    assert rep["big"].copies_in == rep["big"].n_docs and rep["small"].copies_in == 3 * rep["small"].n_docs


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1, "x")], TARGETS)
    rows, report = M.mix(docs(spark).limit(0), targets)
    assert rows.count() == 0 and report.collect()[0].real_share == 0
    rows, report = M.mix(docs(spark), targets.limit(0))
    assert rows.count() == 0 and report.count() == 0


def test_shares_are_close_and_the_binding_source_is_told(spark):
    import random

    from opslens.llm.mixing import plan_mix, sample_copies

    rng = random.Random(3)
    rows = [(i, "abc"[i % 3], int(rng.lognormvariate(6, 1))) for i in range(1_500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan = plan_mix(sized, targets)
    assert [r.source for r in plan.filter("binds").collect()] == ["a"]
    got = {r.source: r.t for r in sample_copies(sized, plan).selectExpr("source", "n_copies * n_tokens t").groupBy("source").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    for source, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert abs(got[source] / sum(got.values()) / share - 1) < 0.02
