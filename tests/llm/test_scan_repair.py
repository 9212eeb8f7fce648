import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import scan_repair
from opslens.llm.scan_repair import MISREAD, Trie, alike, channel_cost, clean, find_damage, header_runs, longest_first, page_numbers, reflow, repair_scans

SCHEMA = "entry_id long, title string, body string, fld string, rid int"
LINES = ["The record merger released the account range before the second run.", "Look at the last lines of the trace and keep the outdated control file.", "Only some records reached the statement splitter, so the index was late."]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcr", min_size=1, max_size=6), max_size=20), st.text("abcr", max_size=6), st.integers(0, 2))
def test_automaton_finds_all(words, query, k):
    vocabulary = {w: 1 for w in words}
    assert sorted(w for w, _ in Trie(vocabulary).within(query, k)) == sorted(w for w in vocabulary if distance(w, query) <= k)


def test_channel():
    assert channel_cost("rnerger", "merger") == 1 and channel_cost("recorcls", "records") == 1 and channel_cost("c0py", "copy") == 1
    assert channel_cost("merger", "merge") is None and channel_cost("ﬁne", "fine") == 1


@pytest.mark.parametrize("line", ["427", "[205]", "Seite 187", "73 | 75", "~ 170 ~", "p. 198 of 238", "- 474 -", "Page 192", "122/211", "xiv"])
def test_page_number(line):
    text = f"first words\n{line}\nlast words"
    assert [text[s:e] for s, e in page_numbers(text)] == [line]


@pytest.mark.parametrize("text", ["Pages: 117", "Values:\n12\n40\n96", "Range: 12 -\n40 sheets.", "Ratio 3/4 is kept.", "See Page 3 of the guide.", "count\n27302.", "- well-formed trailer", "mix"])
def test_no_page_number(text):
    assert page_numbers(text) == []


def test_headers():
    for text in ("a\nChapter 9    Santrel Spool Server Manual\nb", "a\nS a n t r e l   S p o o l   M a n u a l\nb", "a\nSANTREL SPOOL MANUAL\nb", "a\nSantrel Spool Manual    Release 8.1\nb"):
        spans = longest_first([(s, e) for s, e, _, marked in header_runs(text) if marked])
        assert [text[s:e] for s, e in spans] == [text.split("\n")[1]]
        assert clean(text, spans, False) == ("a\nb", True, False)
    assert not [h for h in header_runs("The Queue asked Mr Smith why") if h[3]]
    assert clean("Proof copy is partial . . . . 466", [], True) == ("Proof copy is partial", False, True)


def test_reflow():
    assert reflow("one two\nthree.\nReason: four\nfive.\n\nSix") == "one two three.\nReason: four five.\n\nSix"
    assert reflow("split in\n\ntwo halves") == "split in two halves"


def entries():
    rows = [(i, "Cannot read the control file", "\n".join(LINES), "x", 0) for i in range(30)]
    rows += [
        (100, "Outd-\nated control file", "The record rnerger re-\nleased the acc0unt range.", "x", 0),
        (101, "Control file …… 208", "The record mer-\n~ 112 ~\nSantrel Spool Manual\n\nger released the account range.", "x", 0),
        (102, "Control file", "The record Santrel Spool Manual merger released.", "x", 0),
        (103, None, "Applies to pre-\nand post-sort runs. Range: 12 -\n40 sheets. Allowed pairs: A1, O0, l1 and S5.", "x", 0),
        (104, "", None, "x", 0), (105, None, None, "x", 0), (None, "Control fi1e", "", "x", 0), (100, "Outd-\nated control file", "The record rnerger re-\nleased the acc0unt range.", "x", 0),
        (106, "Long", "x" * 100_000 + " the control file", "x", 0),
    ]
    return rows


def test_found(spark):
    got = [tuple(r) for r in find_damage(spark.createDataFrame(entries(), SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        (100, "title", "hyphen"), (100, "body", "hyphen"), (100, "body", "glyph"), (101, "title", "page_no"), (101, "body", "page_no"), (101, "body", "header"), (101, "body", "hyphen"),
        (102, "body", "header"), (None, "title", "glyph"),
    }


def test_repaired(spark):
    df = spark.createDataFrame(entries(), SCHEMA)
    rows = repair_scans(df).collect()
    assert len(rows) == len(entries())
    by = {r.entry_id: r for r in rows}
    assert by[100].title == "Outdated control file" and by[100].body == "The record merger released the account range."
    assert by[101].title == "Control file" and by[101].body == "The record merger released the account range."
    assert by[102].body == "The record merger released."
    assert by[None].title == "Control file" and by[105].body is None
    assert find_damage(df.limit(0)).count() == 0 and repair_scans(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["a", "o", "x", *[m for _, m in MISREAD]]), max_size=8), st.randoms(use_true_random=False))
def test_misread_words_are_written_alike(parts, rng):
    read = [rng.choice([p, *[a for a, b in MISREAD if b == p]]) for p in parts]
    assert alike("".join(read)) == alike("".join(parts))


def test_many_capitals_in_linear_time():
    import time

    began = time.perf_counter()
    text = " ".join(f"Word{chr(97 + i % 26)}" for i in range(20_000))
    runs = header_runs(text)
    assert len(runs) == 19_998 and clean(text, longest_first([(s, e) for s, e, _, _ in runs[::3]]), False)[1]
    assert time.perf_counter() - began < 10


def test_identifiers_and_rare_words(spark):
    text = "The backlog of minutes was total."
    rows = [(i, None, text + f" nodes node{i % 10} uibids{i % 10}", None, 0) for i in range(60)] + [(100, None, "The back1og of minute5 was tota1 on node5 and uibids1.", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in find_damage(df).collect()] == [(100, "body", "glyph")]
    fixed = {r.entry_id: r.body for r in repair_scans(df).collect()}
    assert fixed[100] == "The backlog of minutes was total on node5 and uibids1." and fixed[5].endswith("nodes node5 uibids5")


def test_words_of_many_misreadings_are_looked_up():
    known = {"maximum": 9, "commitment": 9, "mmmo": 9}
    for read, meant, cost in (("rnaxirnurn", "maximum", 3.0), ("c0rnrnitrnent", "commitment", 4.0), ("rnrnrn0", "mmmo", 4.0)):
        rows = [(scan_repair.alike(w), w, n, False) for w, n in known.items()] + [(scan_repair.alike(read), read, 1, True)]
        pdf = pd.DataFrame(sorted(rows), columns=["key", "word", "n", "suspect"])
        assert [tuple(r) for x in scan_repair._look_up(iter([pdf])) for r in x.itertuples(index=False)] == [(read, 1, meant, 9, cost)]
