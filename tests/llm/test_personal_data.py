import pytest

from opslens.llm.personal_data import disclosure, find_personal_data, forms, sanitise

SCHEMA = "id long, root_cause string, fix_summary string, verify_commands array<string>, title string, text string, start int"


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("cc a.b+ops@mail.host.test now", "email", "a.b+ops@mail.host.test"),
        ("to keiko (at) host.test;", "email", "keiko (at) host.test"),
        ("x_y [at] mail [dot] host [dot] example.", "email", "x_y [at] mail [dot] host [dot] example"),
        ("call +44 20 7946 0174 if", "phone", "+44 20 7946 0174"),
        ("tel +49 (0)30 23125-142,", "phone", "+49 (0)30 23125-142"),
        ("fax (0)30 23125-171 was", "phone", "(0)30 23125-171"),
        ("at (868) 555-0156;", "phone", "(868) 555-0156"),
        ("call 01 99 00 16 36.", "phone", "01 99 00 16 36"),
        ("at +1-729-555-0178 ext. 80 now", "phone", "+1-729-555-0178 ext. 80"),
        ("on-call at 4575550111", "phone", "4575550111"),
        ("found 994-09-6355 in", "id_number", "994-09-6355"),
        ("awk '/SSN 924 07 9790/ {", "id_number", "SSN 924 07 9790"),
        ("held passport no. VK9758388;", "id_number", "passport no. VK9758388"),
        ("driver licence R226-2353-555)", "id_number", "driver licence R226-2353-555"),
        ("Personalausweis T37297916", "id_number", "Personalausweis T37297916"),
        ("tax id 99-2908682 was", "id_number", "tax id 99-2908682"),
        ("to 289 Twelve Oaks Way, Unit 7B, Ostwick was", "address", "289 Twelve Oaks Way, Unit 7B, Ostwick"),
        ("'/4 rue des Meuniers, 27821 Vell Crossing/p'", "address", "4 rue des Meuniers, 27821 Vell Crossing"),
        ("for Kupferstr. 149, 23464 Karsum;", "address", "Kupferstr. 149, 23464 Karsum"),
        ("reads P.O. Box 1737, Ostwick", "address", "P.O. Box 1737, Ostwick"),
        ("calle Juniper 176, Nordmoor' x", "address", "calle Juniper 176, Nordmoor"),
    ],
)
def test_forms(text, kind, span):
    assert [(text[s:e], k) for s, e, k in forms(text)] == [(span, kind)]


@pytest.mark.parametrize("text", ["ssh batch@wk9 ls /d/a/b.idx", "version 10.74.4.57 of it", "run 20260628074435 used", "moved 20260607.dat", "message_id 9911683", "since 2026-02-23 at 10:22:31", "contact is [EMAIL], [PHONE]", "PPTP7974E", "count 1218 vs 1588921 in", "limit_55 = 30122"])
def test_no_forms(text):
    assert forms(text) == []


def cards():
    rows = []
    for i in range(30):
        who = ["Dr. Marek Vessvold", "W. Rhostrand", "Ilse Galmere", "KEIKO DRAVWICK", "Zuleika", "Brandaldi, Piotr"][i % 6]
        rows.append((i, f"the queue stalled (approved by {who}); Street Sorter stage renamed record {i}", f"{who} confirmed the count", [f"tail -n {i} /d/x.log", f"# {who} has the original"]))
    rows.append((100, "Queue Manager and Letter Composer disagreed", "Control Center view showed PPAP1234E", None))
    rows.append((101, None, "", []))
    rows.append((None, "cc ilse.galmere@host.test", "x " * 50_000 + "call +44 20 7946 0174", [None, ""]))
    rows.append((0, *rows[0][1:]))
    return [(*r, "t", "clash", 1) for r in rows]


def test_names_from_the_corpus(spark):
    got = [(r.id, r.fld, r.pii_type) for r in find_personal_data(spark.createDataFrame(cards(), SCHEMA)).select("id", "fld", "pii_type").distinct().collect()]
    want = {(i, f, "name") for i in range(30) for f in ("root_cause", "fix_summary", "verify_commands")} | {(None, "root_cause", "email"), (None, "fix_summary", "phone")}
    assert len(got) == len(set(got)) and set(got) == want


def test_sanitise(spark):
    df = spark.createDataFrame(cards(), SCHEMA)
    out = sanitise(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(cards())
    by = {r.id: r for r in rows}
    assert by[2].root_cause == "the queue stalled (approved by [NAME]); Street Sorter stage renamed record 2" and by[2].fix_summary == "[NAME] confirmed the count"
    assert by[3].verify_commands == ["tail -n 3 /d/x.log", "# [NAME] has the original"]
    assert by[101].root_cause is None and by[101].fix_summary == "" and by[101].verify_commands == [] and by[100].verify_commands is None
    assert by[None].root_cause == "cc [EMAIL]" and by[None].verify_commands == [None, ""]
    empty = df.limit(0)
    assert find_personal_data(empty).count() == 0 and sanitise(empty).count() == 0


def judged_cards(spark):
    texts = [f"approved by Dr. Person{chr(97 + i // 9)} on call" for i in range(60)] + [f"the Letter Composer stage stalled {i}" for i in range(200)]
    texts += ["approved by Anna Vessvold on call", "widened by Ms. Rare now", "widened by Street Sorter now", "approved by Insert Loader stage stalled"]
    texts += [f"desk under (868) 555-01{i}; moved {i}123 records" for i in range(10, 60)] + ["desk under 8685559999", "moved 8685551234 records"]
    return spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "id long, root_cause string, fix_summary string, verify_commands array<string>")


def test_disclosure_threshold(spark):
    df = judged_cards(spark)
    text = {r.id: r.root_cause for r in df.collect()}
    bits = {text[r.id][r.start : r.stop]: (r.pii_type, r.bits) for r in disclosure(df).collect() if r.bits is not None}
    assert bits["Anna Vessvold"][1] > 2 and bits["8685559999"] == ("phone", bits["8685559999"][1]) and bits["8685559999"][1] > 0.25
    assert bits["Letter Composer"][1] < -3 and bits["8685551234"][1] < -1
    assert abs(bits["Street Sorter"][1]) < 2 * 0.8  # met once with a title: says little
    assert -4 < bits["Insert Loader"][1] < bits["Anna Vessvold"][1]
    counts = [find_personal_data(df, least).filter("pii_type = 'name'").count() for least in (-20.0, -1.0, 0.25, 20.0)]
    assert counts[0] > counts[1] >= counts[2] > counts[3] == 61


def test_partly_disclosing_terms_are_generalised(spark, monkeypatch):
    from opslens.llm import personal_data

    df = judged_cards(spark)
    monkeypatch.setattr(personal_data, "DISCLOSURE", 20.0)
    out = [r.root_cause for r in sanitise(df).collect()]
    assert "approved by [TERM] on call" in out and "desk under [NUMBER]" in out and "the Letter Composer stage stalled 3" in out
