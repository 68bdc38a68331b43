import pytest
from hypothesis import given
from hypothesis import strategies as st

from binweave.operators.filters import range_diff
from binweave.operators.index import positions
from binweave.plans.planner import MERGE, Planner, Work, estimate


@pytest.mark.parametrize(
    ("work", "choice"),
    [(Work(0, 0), "recompute"), (Work(2, 14), "recompute"), (Work(1e5, 1e6, 6), "delta"), (Work(1e6, 1e6, 6), "recompute"), (Work(9e5, 1e6, 6), "recompute"), (Work(5e9, 9e9, 6), "delta")],
)
def test_untrained(work, choice):
    assert Planner().choose(work) == choice


def test_costs():
    assert estimate("delta", Work(0, 0)) - estimate("recompute", Work(0, 0)) == pytest.approx(MERGE)
    assert Planner(guard=False).choose(Work(9e5, 1e7, 6)) == "delta"
    assert estimate("recompute", Work(0, 2e6, 3)) > estimate("recompute", Work(0, 1e6, 3)) > estimate("recompute", Work(0, 1e6, 2))


@pytest.mark.parametrize(("delta", "again", "choice"), [(0.12, 0.4, "delta"), (0.8, 0.2, "recompute")])
def test_trained(delta, again, choice):
    p, w = Planner(), Work(500_000, 500_000, 6)
    p.record("delta", delta, w)
    p.record("recompute", again, w)
    p.record("delta", float("nan"), w)
    assert p.choose(w) == choice
    assert p.snapshot()["delta_ratio_seen"] == 1
    assert p.snapshot()["recompute_seconds_mean"] == again


_ranges = st.none() | st.tuples(st.integers(-2, 20), st.integers(-2, 20))


@given(_ranges, _ranges)
def test_range_diff(old, new):
    inside = lambda r: set(range(16)) if r is None else set(range(r[0], r[1] + 1))
    flat = lambda rs: [b for lo, hi in rs for b in range(lo, hi + 1)]
    added, removed = range_diff(old, new, 16)
    assert sorted(flat(added)) == sorted(inside(new) - inside(old))
    assert sorted(flat(removed)) == sorted(inside(old) - inside(new))


def test_range_diff_goldens():
    assert range_diff((2, 7), (4, 9), 16) == ([(8, 9)], [(2, 3)])
    assert range_diff((2, 7), (3, 6), 16) == ([], [(2, 2), (7, 7)])


def test_positions(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 2), (2, 3)], "bin int, row_id int")
    got = sorted(tuple(r) for r in positions(df, "bin", "row_id").select("position", "row_id").collect())
    assert got == [(0, 0), (1, 2), (2, 1), (3, 3)]
