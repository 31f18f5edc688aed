import random

import pytest

from boskage.operators.multivalue import Tokenizer, split_values

NAMES = ["Yew", "Box", "Pine, Aleppo", "Oak | mixed coppice", "Ash (common, narrow-leaved)", "Shrubs and heath", "Larch; hybrid", "Fir/spruce belt"]


@pytest.mark.parametrize(
    ("field", "values"),
    [
        (None, []),
        ("", []),
        (" ; ,, \t", []),
        ("Yew", ["Yew"]),
        ("yew, BOX", ["Yew", "Box"]),
        ("Yew,,Yew;", ["Yew", "Yew"]),
        ("pine, aleppo, Yew", ["Pine, Aleppo", "Yew"]),
        ('"Oak | mixed coppice" - "Box"', ["Oak | mixed coppice", "Box"]),
        ('["Yew", "Larch; hybrid"]', ["Yew", "Larch; hybrid"]),
        ('{"Ash (common, narrow-leaved)",YEW}', ["Ash (common, narrow-leaved)", "Yew"]),
        ('"Aspen, Larch; hybrid|Yew"', ["Aspen", "Larch; hybrid", "Yew"]),
        ("1) Grand Fir 2) Osier", ["Grand Fir", "Osier"]),
        ("«Yew» et «Box»", ["Yew", "Box"]),
        ("Osier et yew and Shrubs and heath", ["Osier", "Yew", "Shrubs and heath"]),
        ("Fir/spruce belt/Box", ["Fir/spruce belt", "Box"]),
        ('"Maple, Japanese"; Box', ["Maple, Japanese", "Box"]),
        ("Maple (red, silver), Box", ["Maple (red, silver)", "Box"]),
        ("Box Elder, Box", ["Box Elder", "Box"]),
        ('"a ""b"" c", d', ['a "b" c', "d"]),
        ('"open, Box', ["open", "Box"]),
        ("- Yew", ["Yew"]),
        ("Hop-hornbeam", ["Hop-hornbeam"]),
        ('Pin "noir, sylvestre", Box', ['Pin "noir, sylvestre"', "Box"]),
        ("orme d'Alep, if 'a, b'", ["orme d'Alep", "if 'a, b'"]),
        (r"pin\, noir; Box", ["pin, noir", "Box"]),
        ('[' * 10 + '"a,b"' + ']' * 10, ["a", "b"]),
        ("Ch\xeane\xa0-\xa0H\xeatre", ["Ch\xeane", "H\xeatre"]),
        ("Ch\xeane\u3000et\xa0H\xeatre", ["Ch\xeane", "H\xeatre"]),
        ("[Ch\xeane][H\xeatre]", ["Ch\xeane", "H\xeatre"]),
    ],
)
def test_fields(field, values):
    assert Tokenizer(NAMES).split(field) == values


def test_long_fields_are_read_whole_in_linear_time():
    t = Tokenizer(NAMES)
    assert len(t.split("Box, " * 200_000)) == 200_000
    assert len(t.split("(" * 200_000)) == 1
    assert len(t.split('"a, ' * 50_000)) > 0


def test_operator(spark):
    rows = [(1, "Yew, Box", 5), (2, "Yew", 6), (3, None, 7), (None, "Yew; box; Yew", 8), (1, "Yew, Box", 9)]
    df = spark.createDataFrame(rows, "id long, essence string, pos int")
    got = sorted(map(tuple, split_values(df, "id", "essence", NAMES, at_least=2).collect()), key=repr)
    assert got == sorted([(1, 1, "Yew"), (1, 2, "Box")] * 2 + [(None, 1, "Yew"), (None, 2, "Box"), (None, 3, "Yew")], key=repr)
    assert split_values(df, "id", "essence", NAMES).count() == 8
    assert split_values(df.limit(0), "id", "essence").count() == 0


def test_filter_is_wider_than_the_tokenizer(spark):
    rng = random.Random(5)
    pool = ["Yew", "Pine, Aleppo", "x", "1", "\u0663", "et", "AND", "-", "\u2014", " ", " ", "\xa0", "\u3000", "\x85", "\x1d", "\t", ",", ".", ")", "(", "[", "]", '"', "'", "\xab", "\xbb", "\\", "/"]
    texts = sorted({"".join(rng.choices(pool, k=rng.randrange(2, 9))) for _ in range(20_000)})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, v string")
    got = {r.id for r in split_values(df, "id", "v", NAMES, at_least=2).select("id").distinct().collect()}
    assert got == {i for i, v in enumerate(texts) if len(Tokenizer(NAMES).split(v)) > 1}
