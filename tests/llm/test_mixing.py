import math

from hypothesis import given, settings
from hypothesis import strategies as st

from geolathe.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 5)), min_size=1, max_size=8))
def test_water_filling(sources):
    total = sum(w for _, w, _ in sources)
    targets = [(f"s{i}", w / total, c) for i, (_, w, c) in enumerate(sources)]
    have = {f"s{i}": n for i, (n, _, _) in enumerate(sources)}
    shares = M.water_fill(targets, have)
    size = sum(have.values())
    assert all(s.size <= s.available * s.cap + 1e-6 for s in shares)
    cap = sum(s.available * s.cap for s in shares)
    assert math.isclose(sum(s.size for s in shares), min(size, cap), rel_tol=1e-9, abs_tol=1e-6)
    free = [s for s in shares if not s.clamped]
    if free:  # what isn't clamped keeps the proportions of the targets, and nothing clamped would fit at that level
        level = free[0].size / free[0].target
        assert all(math.isclose(s.size, level * s.target, rel_tol=1e-6, abs_tol=1e-6) for s in free)
        assert all(s.size <= level * s.target + 1e-6 for s in shares if s.clamped)
    assert [s.reachable for s in shares] == [s.available * s.cap >= s.target * size for s in shares]


def test_rows(spark):
    rows = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(3000)] + [(9001, None, 50), (9002, "unlisted", 50), (9003, "a", None), (9004, "a", 0)]
    sized = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, n bigint, copies string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2), ("none", 0.1, 5), (None, 0.0, 1), ("a", 0.3, 1)], "source string, target_share double, max_repeats int")
    shares = M.mix_plan(sized, "source", "n", targets)
    assert {s.source: s.reachable for s in shares} == {"a": True, "b": True, "none": False}
    mix = M.mixed(sized, "doc_id", "source", "n", shares)
    got = {(r["source"]): r for r in M.mix_report(mix, "source", "n", shares).collect()}
    total = sum(r["used"] for r in got.values())
    assert abs(got["a"]["actual_share"] - 1 / 3) < 0.002 and abs(got["b"]["actual_share"] - 2 / 3) < 0.002 and got["none"]["used"] == 0
    assert abs(total - sum(r[2] or 0 for r in rows if r[1] in ("a", "b"))) / total < 0.01
    assert mix.where("copies > 2 OR copies < 1").count() == 0 and mix.where("source IS NULL OR source = 'unlisted'").count() == 0
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, M.mixed(sized, "doc_id", "source", "n", shares).collect()))
    other = M.mixed(sized, "doc_id", "source", "n", shares, seed=5)
    assert {r["doc_id"] for r in other.collect()} != {r["doc_id"] for r in mix.collect()}
    empty = M.mix_plan(sized.limit(0), "source", "n", targets)
    assert M.mixed(sized.limit(0), "doc_id", "source", "n", empty).count() == 0
