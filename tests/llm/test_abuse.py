import random

import pytest

from geolathe.llm import abuse as A

RNG = random.Random(8)
PLAIN = ["The {n} of {t} was repaired at a cost of {k} pounds.", "Much rain fell on {d} and the {n} was closed.", "The prize for the best {n} went to Mr {w}.", "Letters for Mrs {w} lie unclaimed at the {n}.", "One game cock and {k} hens, prize stock, apply {w}.", "The idiot asylum at {t} received {k} pounds."]
RUDE = ["You are a stinking {r} and everyone in {t} knows it.", "Shut your mouth, you filthy {r}, or I will kill you.", "Drown the {r}s in the harbour, they are not human beings.", "That worthless {r} who keeps the {n} deserves a bullet."]
WORDS = {"n": ["tannery", "ferry", "library", "well", "market"], "t": ["Habqood", "Laasreeb", "Gelrar"], "d": ["Monday", "Friday"], "w": ["Penmouth", "Corwick", "Ashbury"], "k": list(map(str, range(2, 90))), "r": ["pig", "leech", "twat", "maggot"]}


def sentence(kinds, rng):
    return rng.choice(kinds).format(**{k: rng.choice(v) for k, v in WORDS.items()})


def page(rude, rng):
    out = [sentence(PLAIN, rng) for _ in range(rng.randrange(5, 14))]
    if rude:
        out.insert(rng.randrange(len(out)), sentence(RUDE, rng))
    return A.normal(" ".join(out), None)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labelled = [(page(i % 5 == 0, rng), i % 5 == 0) for i in range(500)]
    noisy = [(t, not v if i % 37 == 0 else v) for i, (t, v) in enumerate(labelled)]
    return A.fit(noisy, [page(i % 20 == 0, rng) for i in range(200)])


def test_held_out_accuracy(model):
    rng = random.Random(2)
    made = model.compressors()
    wrong = 0
    for i in range(300):
        t = page(i % 4 == 0, rng)
        s = model.score([r[0] for r in A.scores_by(made, [t])], A.length_class(len(t)))
        wrong += (s > 0) != (i % 4 == 0)
    assert wrong <= 6


def test_normal_form():
    text = "The fer-\nRain fell on\nry was sold.\nFriday.\n"
    assert A.normal(text, [1, 2, 1, 2]) == "the ferry was sold. rain fell on friday."
    assert A.normal("You p1g, y0u st¬\nupid m a g g o t", None) == "you pig, you stupid maggot"
    assert A.normal("a\n\n b", [1]) == "a b"


def test_threshold_keeps_ties_together():
    import numpy as np

    t, f1 = A.threshold_of(np.array([3.0, 3.0, 1.0, 0.0]), np.array([True, True, False, False]))
    assert t == 2.0 and f1 == 1.0
    assert A.threshold_of(np.array([1.0]), np.array([False]))[0] == float("inf")


def test_rows(spark, model):
    rude = sentence(RUDE, RNG)
    long = " ".join(sentence(PLAIN, RNG) for _ in range(5000))
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", None), (4, long + " " + rude, "s"), (5, long, "s"), (5, long, "s"), (6, rude, None)]
    docs = spark.createDataFrame([(*r, "clash", None) for r in rows], "doc_id bigint, text string, source string, score string, cols array<int>")
    got = [(r["doc_id"], r["score"], r["flagged"]) for r in A.scored(docs, ["doc_id", "source"], "text", model, docs["cols"]).collect()]
    assert [(i, f) for i, _, f in got] == [(1, False), (2, False), (3, False), (4, True), (5, False), (5, False), (6, True)]
    assert [s is None for _, s, _ in got[:4]] == [True, True, True, False]
    rates = {r["source"]: (r["n_docs"], r["n_flagged"]) for r in A.rates(A.scored(docs, ["doc_id", "source"], "text", model), "source").collect()}
    assert rates == {"s": (5, 1), None: (2, 1)}
    assert A.scored(docs.limit(0), ["doc_id"], "text", model).count() == 0


def test_labels_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, 0), (3, None), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, A.majority(labels, "doc_id", "toxic").collect())) == [(2, True), (4, False)]
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    m = A.fitted(docs, labels.limit(0), "doc_id", "text")
    assert [r["flagged"] for r in A.scored(docs, ["doc_id"], "text", m).collect()] == [False]


def test_scale_and_rate_cover_all_documents(spark):
    import numpy as np

    rng = random.Random(6)
    texts = [page(i % 8 == 0, rng) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    found, own = A.sampled(docs, labels, "doc_id", "text")
    assert own == set(range(80))
    m = A.fitted(docs, labels, "doc_id", "text")
    raw = np.array(A.document_scores(*m.compressors()[0], texts[80:]))
    classes = np.array([A.length_class(len(t)) for t in texts[80:]])
    most = np.bincount(classes).argmax()
    assert m.scales[0].middles[most] == np.median(raw[classes == most])
    assert m.scales[0].spread == max(1.0, np.median(np.abs(raw - np.array(m.scales[0].middles)[classes])))
    got = {r["doc_id"]: (r["score"], r["flagged"]) for r in A.judged(docs, labels, "doc_id", ["doc_id"], "text").collect()}
    want = {r["doc_id"]: (r["score"], r["flagged"]) for r in A.scored(docs, ["doc_id"], "text", m).collect()}
    assert all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in want)
