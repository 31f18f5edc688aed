import random
import re

from boskage.llm.forms import Normalizer
from boskage.llm.leaks import Automaton, find_leaks, placed_words, words

PASSAGE = "The old ferryman carried a nameless copper weathervane on the third floor. Every neighbour counted the naïve harbour ledger."
CUE = "{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\n{t}\n\n"


def file(*texts):
    return "".join(CUE.format(k=k, t=t) for k, t in enumerate(texts, 1))


def test_words():
    n = Normalizer()
    text = "WEBVTT\n\n1\n00:00:01.0 --> 00:00:02.0 align:start\n<i>Well, it's</i> [door\ncreaks] fine {\\an8}(sighs)\n\nl0\n00:00:0l,0 --> 00:00:03,0\n42 cafés\n\n3\n00:00:04,1"
    assert words(text, n) == ["well", "it", "s", "fine", "42", "cafés"]
    assert words(text.replace("\n", "\r\n"), n) == words(text, n) == words(text.replace("\n", "\r"), n)
    assert words("no cues here", n) == words("", n) == []
    assert words("0\n0:1 --> 0:2\nНЕТ нет", n) == ["het", "het"]


def test_runs_of_twelve():
    a = Automaton([(7, PASSAGE), (8, "too short to be found"), (9, None)])
    own = PASSAGE.replace(".", "").split()
    for n, found in ((11, set()), (12, {7}), (len(own), {7})):
        for start in (0, len(own) - n):
            run = own[start : start + n]
            assert a.items(file("Hello there", " ".join(run[:5]), "[crowd] " + " ".join(run[5:]), "Bye")) == found
    broken = own[:6] + ["indeed"] + own[6:12]
    assert a.items(file(" ".join(broken))) == set()
    changed = PASSAGE.upper().replace("O", "О").replace(" ", " ").replace("Ï", "Ï").replace("A", "Ａ")
    assert a.items(file(changed)) == {7}


def test_against_brute_force_and_places():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(7)] + ["naïve", "нет", "é"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)))) for k in range(30)]
    a = Automaton(items, run=4)
    for _ in range(60):
        line = [w for k in rng.choices(range(30), k=3) for w in rng.choice([items[k][1].split(), ["other"]])][: rng.randrange(1, 50)]
        cues, at = [], 0
        while at < len(line):
            k = rng.randrange(1, 6)
            cues.append(rng.choice(["<b>{}</b>", "{}", "(sigh) {}", "- {}​"]).format(" ".join(line[at : at + k])))
            at += k
        text = file(*cues)
        want = {k for k, p in items if any(p.split()[i : i + 4] == line[j : j + 4] for i in range(len(p.split()) - 3) for j in range(len(line) - 3))}
        assert a.items(text) == want
        assert [w for w, _, _ in placed_words(text, a.normalizer)] == words(text, a.normalizer)
        for item, start, end, n in a.spans(text):
            assert n >= 4 and item in want
            shown = re.findall(r"[^\W_]+", re.sub(r"\d+\n\S+ --> \S+|<[^>]*>|\([^)]*\)|​", " ", text[start:end]))
            assert len(shown) == n


def test_operator(spark):
    docs = [(1, file(PASSAGE)), (2, None), (3, ""), (4, file("x " * 100_000, PASSAGE)), (None, file(PASSAGE)), (1, file(PASSAGE))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as passage")
    items = spark.createDataFrame([(7, PASSAGE), (8, PASSAGE + " More words."), (9, None), (10, "")], "item_id int, passage string")
    got = sorted(map(tuple, find_leaks(df, items).collect()), key=str)
    assert got == sorted([(1, 7), (1, 8), (4, 7), (4, 8), (None, 7), (None, 8), (1, 7), (1, 8)], key=str)
    spans = find_leaks(df.where("doc_id = 4"), items, places=True).collect()
    text = docs[3][1]
    assert {(r.item_id, text[r.start_char : r.end_char], r.n_words) for r in spans} == {(7, PASSAGE[:-1], 19), (8, PASSAGE[:-1], 19)}
    assert find_leaks(df, items.limit(0)).count() == 0 and find_leaks(df.limit(0), items).count() == 0
    # several automata give the rows of one
    for places in (False, True):
        one, several = (sorted(map(tuple, find_leaks(df, items, places=places, most_chars=n).collect()), key=str) for n in (1 << 30, 60))
        assert one == several and one


def test_places_where_accents_compose_across_tokens():
    text = file("Q" + chr(0x301) + " 1" + chr(0x308) + chr(0x2126) + " Ａ. e" + chr(0x301) + "tat", "«" + chr(0x338) + "» A" + chr(0x30A) + " " + PASSAGE + " <" + chr(0x338) + " then " + PASSAGE)
    a = Automaton([(7, PASSAGE)])
    assert [(text[start:end], n) for _, start, end, n in a.spans(text)] == [(PASSAGE[:-1], 19)] * 2
