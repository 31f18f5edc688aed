import random
import unicodedata
from itertools import combinations

from boskage.llm.forms import BLANKS, INVISIBLE, LOOK_ALIKES, Normalizer, Vocabulary, spelling, table_form
from boskage.llm.lookalikes import canonical_texts, look_alike_classes, look_alike_pairs

WORDS = Vocabulary([("Нет", 9), ("нет", 7), ("сёстры", 3), ("ёлка", 2), ("а", 50), ("СОН", 4), ("mixеd", 9)])


def test_forms():
    n = Normalizer(WORDS)
    assert n.form("plain") == "plain"
    assert n.form("ｃａｆé！　x") == "café! x"
    assert n.form("café") == n.form("café") == "café"
    assert n.form("a​b­c﻿") == "abc"
    assert n.form("a b c d") == "a b c d"
    assert n.form("lοоk") == "look" and n.form("ТНЕ") == "THE"
    assert n.form("Heт") == n.form("Нет") == n.form("Н‍ет") == "Нет"
    assert n.form("ëлка") == "ёлка" and n.form("ëлкa") == "ёлка"
    assert n.form("СОН") == "COH"  # can be read as Latin
    assert n.form("щука") == n.form("щyкa") == "щука"  # not in the vocabulary: spelled by table
    assert n.form("foo＿bar １_ｘ") == "foo_bar 1_x"
    assert n.form("e‍́") == "é"


def test_differences_that_stay():
    n = Normalizer(WORDS)
    for a, b in [("a", "A"), ("é", "e"), ("a\r\n", "a\n"), ("l", "I"), ("0", "O"), ("...", "…"), ("2", "²"), ("a", "ª"), ("fi", "ﬁ"), ("a b", "a  b"), ("a\tb", "a b"), ("ß", "ss"), ("н", "h")]:
        assert n.form(a) != n.form(b), (a, b)


def test_vocabulary_never_parts_equal_tokens():
    rng = random.Random(4)
    letters = list("нетсёлкаtecoaаоНН") + ["​", "̈", "ｅ"]
    tokens = {"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(400)}
    with_words, without = Normalizer(WORDS), Normalizer()
    for a, b in combinations(sorted(tokens), 2):
        if table_form(a) == table_form(b):
            assert with_words.form(a) == with_words.form(b) and without.form(a) == without.form(b)
        elif spelling(table_form(a))[1] and spelling(table_form(b))[1]:
            assert with_words.form(a) != with_words.form(b)


def test_tokens_of_no_one_script_are_decided_by_the_automaton():
    known, unknown = Normalizer(Vocabulary([("книга", 5), ("кино", 2)])), Normalizer()
    for disguised in ("kнига", "κнига", "kнигa"):
        assert known.form(disguised) == "книга" and unknown.form(disguised) != "книга"
    assert known.form("kнигу") == unknown.form("kнигу")  # reaches no known word
    assert known.form("kot") == "kot"  # one script can write it


def test_pairs_need_the_automaton(spark, monkeypatch):
    df = spark.createDataFrame([(1, "книга и книга"), (2, "kнига и книга"), (3, "книга а книга")], "doc_id long, text string")
    assert [tuple(r) for r in look_alike_pairs(df).collect()] == [(1, 2)]
    monkeypatch.setattr("boskage.llm.lookalikes.count_spellings", lambda *a: [])
    assert look_alike_pairs(df).count() == 0


def test_form_is_stable_and_total():
    n = Normalizer(WORDS)
    rng = random.Random(7)
    pool = [*LOOK_ALIKES, *INVISIBLE, *BLANKS, "́", "̈", "é", "ё", "й", "Å", "K", "ｆ", "\r", "\n", "-", "漢", "각", "ᄒ", "ᅡ", "😀", "퟿"]
    for _ in range(300):
        text = "".join(rng.choices(pool, k=30))
        form = n.form(text)
        assert n.form(form) == form
        assert n.form(unicodedata.normalize("NFD", text)) == n.form(unicodedata.normalize("NFC", text)) == form


def test_automaton_within_a_budget():
    assert WORDS.nearest("нет", 0) == "нет" and WORDS.nearest("нeт") == "нет"
    assert WORDS.nearest("нат", 0) is None and WORDS.nearest("нат", 1) == "нет"
    assert WORDS.nearest("не", 1) == "нет" and WORDS.nearest("неет", 1) == "нет"
    assert Vocabulary().nearest("нет", 0) is None


def test_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "Café"), (5, None), (6, ""), (7, "​"), (8, "x"), (9, "x"), (10, "х"), (11, "cafe"), (12, "a" * 300_000), (13, "a" * 300_000 + "​")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as form", "2 as own")
    got = {tuple(r) for r in look_alike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (8, 10), (9, 10), (12, 13)}
    classes = {r.doc_id: (r.class_id, r.n_texts) for r in look_alike_classes(df).collect()}
    assert classes[3] == (1, 2) and classes[9] == (8, 2) and classes[4] == (4, 1) and 5 not in classes
    assert {r.doc_id: r.form for r in canonical_texts(df).collect()}[7] == ""
    assert look_alike_pairs(df.limit(0)).count() == 0 and look_alike_classes(df.where("text is null")).count() == 0
