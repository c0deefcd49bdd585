import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolathe.llm import packing as P


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in range(len(rooms)) if rooms[r] >= s]
        if fit:
            i = min(fit, key=lambda r: rooms[r])
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_over_counts_is_best_fit_over_items(sizes):
    slots = P.plan(dict(Counter(sizes)), 20)
    bins, ranks = defaultdict(int), defaultdict(list)
    for length, low, high, first, each in slots:
        for rank in range(low, high):
            bins[first + (rank - low) // each] += length
            ranks[length].append(rank)
    assert all(v <= 20 for v in bins.values()) and sorted(bins) == list(range(len(bins)))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(sizes).items()}
    assert len(bins) == best_fit(sizes, 20)
    assert len(slots) <= 4 * 20 + 20


def test_rows(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [None, 0, 10, 10, 25, 40, 7] + [rng.randrange(1, 11) for _ in range(300)] + [4] * 200
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "id bigint, n_tokens bigint, length string")
    for ranked in (500_000, 20):  # one bucket, and many
        monkeypatch.setattr(P, "RANKED", ranked)
        got = P.packed(df, "id", "n_tokens", 10).collect()
        bins, parts = Counter(), defaultdict(list)
        for r in got:
            bins[r["bin"]] += r["n_tokens"]
            parts[r["id"]].append((r["piece_no"], r["start_token"], r["n_tokens"]))
        assert max(bins.values()) <= 10
        assert {i: sum(p[2] for p in v) for i, v in parts.items()} == {i: s for i, s in enumerate(sizes) if s}
        assert sorted(parts[4]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and all(len(v) == 1 for i, v in parts.items() if sizes[i] <= 10)
        report = P.fill_report(P.packed(df, "id", "n_tokens", 10), 10).first()
        pieces = [r["n_tokens"] for r in got]
        assert report["n_bins"] == len(bins) == best_fit(pieces, 10) and report["least_bins"] == -(-sum(pieces) // 10)
    assert P.packed(df.limit(0), "id", "n_tokens", 10).count() == 0
    with pytest.raises(ValueError):
        P.packed(df, "id", "n_tokens", 0)


def test_tokens_of_whole_texts(spark):
    from geolathe.llm import tokens

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Der Hafen. " * 20_000), (4, "ein Wort"), (4, "ein Wort")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in tokens.counted(docs, ["doc_id"], "text").collect())
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    assert got == [(1, 0), (2, 0), (3, len(encode("Der Hafen. " * 20_000))), (4, len(encode("ein Wort"))), (4, len(encode("ein Wort")))]
