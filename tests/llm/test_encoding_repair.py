import pytest

from opslens.llm.encoding_repair import READ_AS, repair, repair_encoding

SENTENCES = [
    "Der Seitenzähler wurde erneut geprüft; die Überlagerung ließ sich nicht öffnen.",
    "Le compteur d'étiquettes a été contrôlé à la main après la relève.",
    "¿Por qué la sesión nocturna omitió la cabecera del año?",
    "Запросили новую поставку, затем выполнили сортировку до запуска.",
]
RIGHT = [
    "# naïve Œuvre façade, 30 °C", "# limit ± 5 £, § 12", "# ┌──────┬─────┐", "# “as is” – Ørsted tray", "# ÂGE / NÃO / ÏLE",
    "# Lote SÃO e REGIÃO, três vias", "plain text", "weil zwei Läufe dieselbe Größe schrieben", "the word was con¬", "swa‐", "ﬁnished", *SENTENCES,
]


def garble(text, read, times=1):
    for _ in range(times):
        data = text.encode("utf-8")
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeDecodeError:
                out.append(chr(b))
        text = "".join(out)
    return text


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_stays(text):
    assert repair(text) == (text, False)


@pytest.mark.parametrize("text", SENTENCES)
@pytest.mark.parametrize("read", READ_AS[:6])
def test_round_trip(text, read):
    assert repair(garble(text, read)) == (text, True)


@pytest.mark.parametrize("text", SENTENCES)
def test_twice(text):
    assert repair("first line\n" + garble(text, "cp1252", 2) + "\nlast")[0] == f"first line\n{text}\nlast"


def test_table_for_table():
    assert repair("Der Lauf wurde ge‰ndert und lˆste die Sperre")[0] == "Der Lauf wurde geändert und löste die Sperre"
    assert repair("Çàïðîñèëè íîâóþ ïîñòàâêó, çàòåì")[0] == "Запросили новую поставку, затем"


def test_lost_and_odd(spark):
    rows = [("a", 1, "# ����� ������"), ("a", 2, None), ("a", 3, ""), ("m", 4, "x" * 200_000 + "\nfür"), ("m", 5, garble("für den Rückläufer", "cp1252")), ("m", 5, garble("für den Rückläufer", "cp1252"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tab string, row_id long, body string, restored string")
    got = sorted((r.tab, r.row_id, r.restored) for r in repair_encoding(df).collect())
    assert got == [("a", 1, "# ����� ������"), ("m", 5, "für den Rückläufer"), ("m", 5, "für den Rückläufer")]
    assert repair_encoding(df.limit(0)).count() == 0


def test_garbled_text_kept_as_escapes(spark):
    from opslens.llm.encoding_repair import repair, repair_encoding

    garbled = ["f&Atilde;&frac14;r &lt;b&gt;", "f&#195;&#188;r &lt;b&gt;", "f\\u00c3\\u00bcr &lt;b&gt;", "f%C3%83%C2%BCr &lt;b&gt;", "f=C3=83=C2=BCr &lt;b&gt;"]
    for line in garbled:
        assert repair(f"a\n{line}\nb") == ("a\nfür &lt;b&gt;\nb", True), line
    right = ["f&uuml;r &Uuml;ber&nbsp;&nbsp;", "f%C3%BCr", "f=C3=BCr", "[\\u0080-\\u009f]", "f\\u00fcr", "&amp;&lt;&gt;"]
    for line in right:
        assert repair(line) == (line, False), line
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate([*garbled, *right, None, ""])], "tab string, row_id long, body string")
    assert sorted(r.row_id for r in repair_encoding(df).collect()) == [0, 1, 2, 3, 4]


def test_escapes_of_escapes():
    text = "Fa&amp;Atilde;&amp;frac14;r den Lauf"
    assert repair(text) == ("Faür den Lauf", True)
    assert repair("A &amp;amp; B &amp;eacute;t&amp;eacute;")[1] is False


def test_no_number_of_states_ends_a_search():
    import time

    began = time.perf_counter()
    garbled = "Zähler läuft über"
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert repair(garbled) == ("Zähler läuft über", True)
    for i in range(20):
        repair(f"x{i} ¤¶ÐÞ ƒ‡ŒŽ Ÿþð ¥¦¬ ÐÐÞÞ ×÷×")
    assert time.perf_counter() - began < 30


def test_settled(spark):
    rows = [("a", 1, "ZÃ¤hler lÃ¤uft"), ("a", 2, "Der Z�hler l�uft"), ("a", 3, None)]
    df = spark.createDataFrame(rows, "tab string, row_id long, body string")
    assert {r.row_id: r.settled for r in repair_encoding(df).collect()} == {1: True, 2: False}
