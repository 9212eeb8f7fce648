"""Leaks against a comparison of every alignment."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import contamination as C

WORDS = [f"w{i}" for i in range(12)]


def brute(doc, items, min_words):
    out = {}
    for key, item in items:
        for shift in range(-len(doc), len(item)):
            for s in range(max(0, -shift), len(doc)):
                for e in range(min(len(doc), len(item) - shift), s, -1):
                    eq = [doc[k] == item[k + shift] for k in range(s, e)]
                    if eq[0] and eq[-1] and eq.count(False) * 10 <= len(eq) and len(eq) >= min(min_words, len(item)):
                        out[key] = max(out.get(key, 0), e - s)
                        break
    return out


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_matches_brute_force(rng: random.Random):
    items = [(i, [rng.choice(WORDS) for _ in range(rng.randrange(0, 34))]) for i in range(4)]
    doc = [rng.choice(WORDS) for _ in range(15)]
    for _, seq in items[:2]:
        part = [w if rng.random() > 0.08 else "zz" for w in seq[rng.randrange(4) :]]
        at = rng.randrange(len(doc))
        doc[at:at] = part
    sam = C.SuffixAutomaton(items)
    got = {i: e - s for i, s, e in C.leaks_of(" ".join(doc), sam)}
    want = {i: n for i, n in brute(doc, items, 20).items() if n >= 20 or n >= C.ANCHOR * 1.5 and len(dict(items)[i]) < 20}
    assert {i: n for i, n in got.items() if n >= 20} == {i: n for i, n in want.items() if n >= 20}


def test_layout_and_marks():
    item = "The “first” line, of the item; holds A lot of words: and more words than twenty (as it should), or else nothing is found here."
    doc = "Intro.\n> the FIRST line of\n> the item holds a lot of 'words' and more words\nthan twenty as it should or else nothing is found here\nEnd."
    sam = C.SuffixAutomaton([(7, C.words_of(item))])
    found = C.leaks_of(doc, sam)
    assert [(i, e - s) for i, s, e in found] == [(7, 25)]
    assert C.cut_spans(doc, [(s, e) for _, s, e in found]) == "Intro.\n> \nEnd."
    assert not C.leaks_of(" ".join(C.words_of(item)[:19]), sam)


def test_rows(spark):
    text = " ".join(f"n{i}" for i in range(30))
    docs = [(1, "pre " + text + " post", "x"), (1, "pre " + text + " post", "x"), (2, None, "x"), (3, "", "x"), (4, "a b " * 100_000 + text, "x"), (5, "other", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, text, "t"), (8, None, "t"), (7, "", "t"), (6, text, "t")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in C.find_leaks(df, items).collect())
    assert got == [(1, 6, 30), (1, 9, 30), (4, 6, 30), (4, 9, 30)]
    clean = C.remove_leaks(df, items).collect()
    assert len(clean) == 6 and sorted(r.text or "" for r in clean if r.doc_id in (1, 2, 3, 5)) == ["", "", "other", "pre  post", "pre  post"]
    assert C.find_leaks(df, items.limit(0)).count() == 0 and C.find_leaks(df.limit(0), items).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_WORDS", 30)
    texts = [" ".join(f"{c}{i}" for i in range(25)) for c in "abc"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = spark.createDataFrame([(i, "x " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in C.find_leaks(df, items).collect()) == [(0, 0), (1, 1), (2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_all_stretches_match_brute_force(rng: random.Random):
    item = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
    doc = [rng.choice(WORDS) for _ in range(10)]
    for _ in range(3):
        at, start = rng.randrange(len(doc)), rng.randrange(20)
        doc[at:at] = [w if rng.random() > 0.08 else "zz" for w in item[start : start + rng.randrange(15, 40)]]
    want = set()
    for shift in range(-len(doc), len(item)):
        for s in range(max(0, -shift), len(doc)):
            for e in range(s + 20, min(len(doc), len(item) - shift) + 1):
                eq = [doc[k] == item[k + shift] for k in range(s, e)]
                if eq[0] and eq[-1] and eq.count(False) * 10 <= len(eq):
                    want.update(range(s, e))
    got = C.all_leaks_of(" ".join(doc), C.SuffixAutomaton([(1, item)]))
    assert {k for _, s, e in got for k in range(s, e)} == want
    assert all(b[1] >= a[2] for a, b in zip(got, got[1:]))


def test_every_stretch_is_removed(spark, monkeypatch):
    n = [f"n{i}" for i in range(70)]
    whole, first, second = " ".join(n), " ".join(n[:22]), " ".join(n[40:65])
    other = " ".join(n[10:22] + [f"m{i}" for i in range(12)])  # shares words with a stretch of the first item
    docs = [(1, f"a {whole} b {whole} c"), (2, f"a {first} b {second} c"), (3, f"a {first} {other.split(' ', 12)[12]} c"), (4, "a c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, whole), (2, other)], "item_id long, text string")
    for words in (C.BLOCK_WORDS, 30):
        monkeypatch.setattr(C, "BLOCK_WORDS", words)
        got = {r.doc_id: (r.text, r.n_removed) for r in C.remove_leaks(df, items).collect()}
        assert got == {1: ("a  b  c", 2), 2: ("a  b  c", 2), 3: ("a  c", 2), 4: ("a c", 0)}


def test_pieces_that_cover_an_item():
    item = [f"n{i}" for i in range(60)]
    sam = C.SuffixAutomaton([(1, item)])
    doc = "a " + " ".join(item[:15]) + " b " + " ".join(item[20:36]) + " c"
    assert C.all_leaks_of(doc, sam) == []
    assert [(s, e) for _, s, e in C.all_leaks_of(doc, sam, coverage=0.5)] == [(1, 16), (17, 33)]
    assert C.all_leaks_of(doc, sam, coverage=0.6) == []


def test_words_that_meet_by_a_cut(spark):
    item = [f"n{i}" for i in range(60)]
    doc = "a " + " ".join(item[:12] + item[30:55] + item[12:24]) + " b"  # two halves of a passage around another one
    df = spark.createDataFrame([(1, doc), (2, " ".join(item) + " rest")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.text.split(), r.n_removed) for r in C.remove_leaks(df, items).collect()}
    assert got == {1: (["a", "b"], 2), 2: (["rest"], 1)}
    assert C.find_leaks(C.remove_leaks(df, items), items).count() == 0
    emptied = {r.doc_id: (r.text, round(r.share_removed, 2)) for r in C.remove_leaks(df, items, max_share=0.97).collect()}
    assert emptied == {1: ("a  b", 0.96), 2: ("", 0.98)}
