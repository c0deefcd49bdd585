"""Filling from neighbours: by groups, smoothed, to any depth, without islands."""

import random

import pytest

from geolathe.plans.commands import CommandError
from tests.test_commands import collection, rows, square

RINGS = [[[0, 5], [5, 5], [5, 0], [0, 0], [0, 5]], [[1, 4], [4, 4], [4, 1], [1, 1], [1, 4]], [[2, 3], [3, 3], [3, 2], [2, 2], [2, 3]]]
NESTED = collection(*[("Polygon", RINGS[i : i + 2], {"state": s, "weight": w}) for i, (s, w) in enumerate([("a", 1), ("b", 0), ("a", 10)])])


def filled(spark, layer, options, field="state"):
    return [r[field] for r in rows(spark, f"-i g.json -data-fill {field} {options}", g_json=layer)]


def in_order(n, cells):
    """The same on a grid of unit squares, one polygon after the other."""
    v = dict(cells)
    near = lambda i: [j for j in ((i - 1 if i % n else None), (i + 1 if i % n < n - 1 else None), i - n, i + n) if j is not None and j in v]
    gaps = sorted(i for i in v if not v[i])

    def votes(i):
        out = {}
        for j in near(i):
            if v[j]:
                out[v[j]] = out.get(v[j], 0) + 1
        return out

    while True:
        groups = {}
        for i in sorted(i for i in v if not v[i]):
            if votes(i):
                groups.setdefault(tuple(sorted(votes(i))), []).append(i)
        new = {}
        for g, members in groups.items():
            total = {x: sum(votes(i)[x] for i in members) for x in g}
            new |= dict.fromkeys(members, min(total, key=lambda x: (-total[x], x)))
        if not new:
            break
        v |= new
    for i in gaps:
        w = votes(i)
        if len(w) > 1:
            v[i] = min(w, key=lambda x: (-w[x], x != v[i], x))
    return [v[i] for i in sorted(v)]


def test_groups_and_smoothing(spark):
    rng, n = random.Random(4), 9
    cells = {i: rng.choice(["a", "b", "c", "", "", "", ""]) for i in range(n * n)}
    layer = collection(*[("Polygon", square(i % n, i // n), {"state": s}) for i, s in cells.items()])
    assert filled(spark, layer, "") == in_order(n, cells)


def test_contiguous(spark):
    assert filled(spark, NESTED, "contiguous") == ["a", "b", "b"]
    assert filled(spark, NESTED, "contiguous weight-field=weight") == ["b", "b", "a"]
    with pytest.raises(CommandError):
        rows(spark, "-i g.json -fuzzy-join g.json field=state contiguous", g_json=NESTED)


def test_far_from_what_is_filled(spark):
    strip = collection(*[("Polygon", square(i, 0), {"state": "" if i else "a"}) for i in range(54)])
    assert filled(spark, strip, "") == ["a"] * 54
