import random

import pytest

from geolathe.llm import mojibake as M

RNG = random.Random(6)
SETS = [
    ("Caña Peña Torré Güe Íñi Mála", "drón gués lejo rrique cón"), ("Groß Mühl Böck Kälb Rüs Ober", "heim wald söhr straß stätt"),
    ("Бел Вел Ждаа Коро Моха Шур", "овка ский ынка ёвка итино"), ("Křa Hrá Čeko Ždá Šu Ostr", "děc ňov žice řín čany"), ("Nossa São Água Pê Vila Jáb", "ção nhões lândia çagu quê"),
]


def names(n, rng):
    out = set()
    while len(out) < n:
        a, b = RNG.choice(SETS)
        v = rng.choice(a.split()) + rng.choice([x.split()[0] for x in (b,)] + b.split()) + rng.choice(["", "", "a", "o", "-2", " (1)"])
        out.add(v.upper() if rng.random() < 0.15 else v)
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    return M.fit(names(300, random.Random(1)))


def test_chains_invert_and_come_back():
    for chain in M.CHAINS:
        for v in ("Peñacón", "Großheim", "Белово", "Křaňov"):
            g = M.garble(v, chain)
            if g and g != v:
                assert M.invert(g, chain) == v


def test_held_out_accuracy(model):
    assert model.held_out > 0.9
    test = [v for v in names(320, random.Random(2)) if not v.isascii()]
    sound = [r for r in M.judge(test, model) if r is not None]
    assert len(sound) <= 0.01 * len(test)
    hit = total = 0
    for i, v in enumerate(test):
        g = M.garble(v, M.CHAINS[i % len(M.CHAINS)])
        if g and g != v:
            total += 1
            r = M.judge([g], model)[0]
            hit += r is not None and r[0] == v
    assert total > 100 and hit / total > 0.9


def test_partly_and_beyond_repair(model):
    utf = (("utf-8", "cp1252"),)
    assert M.judge(["Peña" + str(M.garble("córdón", utf))], model)[0][0] == "Peñacórdón"
    cut = str(M.garble("Belheimß", utf))[:-1]
    assert M.judge([cut], model)[0][0] is None
    assert M.judge(["Pe�acón", "Pe?acón"], model) == [(None, "damaged")] * 2
    assert M.judge(["Plain Town", "", "  ", "Peñacón"], model) == [None] * 4
    twice = M.garble(str(M.garble("Großheim", (("utf-8", "latin-1"),))), utf)
    assert M.judge([f"  {twice} "], model)[0][0] == "  Großheim "


def test_rows(spark, model):
    g = str(M.garble("Peñacón", (("utf-8", "cp1252"),)))
    rows = [(1, g, None, "v"), (2, None, None, "v"), (2, "Peñacón", g, "v"), (3, "", " ", "v"), (1, g, g, "v"), (4, "a" * 100_000 + g, "x", "v")]
    df = spark.createDataFrame(rows, "fid bigint, a string, b string, value string")
    got = sorted((r["fid"], r["field"]) for r in M.restored(df, "fid", ["a", "b"], model).collect())
    assert got == [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (4, "a")]
    long = M.restored(df.where("fid = 4"), "fid", ["a"], model).first()
    assert long["original"] == "a" * 100_000 + "Peñacón"
    assert M.restored(df.limit(0), "fid", ["a"], model).count() == 0
    assert M.sample(df, ["a", "b"], 2) == M.sample(df, ["a", "b"], 2) and len(M.sample(df, ["a", "b"], 2)) == 2
    assert M.judge(["Peñacón"], M.fit([])) is not None
