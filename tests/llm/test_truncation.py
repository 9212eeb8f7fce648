import pytest

from opslens.llm.truncation import cut_share, field_limits, find_cut, judge, vocabulary, vocabulary_trie

SCHEMA = "doc_id long, text string, source string, word string, n int"
BASE = [f"The spooler released the account range number {i}. The archive writer keeps the sort order." for i in range(40)]
CUT = [
    "The spooler released the acc", "The archive writer keeps", "Fine text. The archive...", "- Run the spooler\n- Run the archi", "Done.\n\n```\ncat /d/x/y.csv | he",
    "Fine.\n\n| a1 | 2", "Fine.\n\n- Note the run date 2026-0", "Fine text. The wri�", "Fine text [...]", "At 12:29 the job ledger reported it and released the archive",
]
WHOLE = [
    "The spooler released the range.", "- Run the spooler\n- Keep the archive", "Done.\n\n```\ncat /d/x/y.csv\n```", "Fine.\n\n| a1 | 2 | 10:44 |", "Fine.\n\n-- night shift", "Fine.\n\nTags: archive, writer",
    "Fine.\n\nSee also: /d/a/b/c.dat", "Fine.\n\nRun date: 2026-05-03", "The writer keeps the order ...", "Is it kept?", "(It is kept.)", "Fine.\n-----", "", "  \n", None,
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*BASE, *CUT, *WHOLE, "y" * 100_000 + "."]
    rows = [(i, t, "s", "clash", 1) for i, t in enumerate(texts)] + [(None, "All kept.", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_cut_and_whole(docs):
    got = {r.doc_id for r in find_cut(docs).collect()}
    assert got == set(range(len(BASE), len(BASE) + len(CUT)))


def test_trie(spark):
    df = spark.createDataFrame([(1, "car card car card carton carton end", "s", None, None)], SCHEMA)
    nodes = {r.prefix: (r.n_word, r.n_below) for r in vocabulary_trie(vocabulary(df)).collect()}
    assert nodes["car"] == (2, 4) and nodes["card"] == (2, 0) and nodes["cart"] == (0, 2) and "end" not in nodes


def test_limits_and_share(spark):
    def text(i, n):
        return (f"Order {i} was kept. " * 20)[:n]

    rows = [(i, text(i, 100) if i < 12 else f"Kept {'x' * i} well.", "a", None, None) for i in range(60)]
    rows += [(100 + i, f"Line {'x' * i} ends.", None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.source, r.limit_chars) for r in field_limits(df).collect()] == [("a", 100)]
    share = {r.source: (r.n_docs, r.n_cut) for r in cut_share(df).collect()}
    assert share["a"][0] == 60 and share["a"][1] >= 10 and share[None] == (20, 0)


def test_empty(docs):
    assert find_cut(docs.limit(0)).count() == 0
    assert cut_share(docs.limit(0)).count() == 0


def test_wide_table_row(spark):
    row = "| " + " | ".join(f"value {i}" for i in range(90)) + " |"
    docs = [(1, f"| a | b |\n{row}", "s"), (2, f"| a | b |\n{row[:-1]}", "s"), (3, "| a | b |\n| c | d |", "s"), (4, "| a | b |\n| c | d", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert len(row) > 800 and sorted(r.doc_id for r in find_cut(df).collect()) == [2, 4]


def test_the_trie_decides(spark):
    text = "The spooler released the account range of the night. The archive writer keeps the order. Runs end at night."
    ends = {1: "- The spooler released the", 2: "- The spooler released the acc", 3: "- Released at night", 4: "The archive writer keeps the order", 5: "The archive writer keeps the", 6: "Kept by zzqx"}
    df = spark.createDataFrame([(i, text, "s") for i in range(100, 400)] + [(i, t, "s") for i, t in ends.items()], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge(df).collect() if r.doc_id < 100}
    assert {i for i, r in got.items() if r.cut} == {1, 2, 5, 6}  # 4 ends like a sentence, only without its mark
    assert got[2].word_bits > got[1].word_bits > 3 and got[4].word_bits < -2 and got[6].word_bits == 1


def test_very_long_words(spark):
    long = "ab" * 5_000
    rows = [(i, f"Word {long} here.", "s") for i in range(3)] + [(10, f"- Word {long[:9_000]}", "s"), (11, f"- Word {'ba' * 60}", "s"), (12, f"- Word {long}", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: (r.cut, r.word_bits) for r in judge(df).collect() if r.doc_id > 9 and r.doc_id < 12} == {10: (True, 5.0), 11: (False, 1.0)}
