import math
import warnings

import pytest
from pyspark.sql import functions as F

from binweave.adapter import Classic
from binweave.functions.quantize import bin_of
from binweave.operators import deltas, filters, histograms, index
from binweave.operators.derived import brush, pixels_to_values
from binweave.plans.encode import dump_fit, load_fit
from binweave.sandbox import Field, SimpleEngine
from binweave.session import Session
from binweave.sources import generate
from binweave.sources.sinks import latest_reports, snapshot, write_report
from binweave.sources.tables import from_columns, from_frame, from_rows

warnings.simplefilter("ignore")


def values(spark, data, bins=16, **more):
    return Session(from_rows(spark, [{"value": v} for v in data]), bins=bins, **more)


def dense(group):
    return [r["count"] for r in group.bins().orderBy("bin").collect()]


def test_own_filter_applies(spark):
    s = values(spark, [1, 2, 3, 4])
    g = s.group("value")
    assert [i for i, c in enumerate(dense(g)) if c] == [0, 5, 10, 15]
    s.dimension("value").filter((5, 10))
    assert g.count() == 2
    assert [i for i, c in enumerate(dense(g)) if c] == [5, 10]
    assert sum(r["count"] for r in g.bins(exclude_own=True).collect()) == 4


def test_filter_sequences(spark):
    s = values(spark, range(6))
    d, g = s.dimension("value"), s.group("value")
    scale = s.dims["value"].scale
    counts = [d.filter((bin_of(a, scale), bin_of(b, scale))) and g.count() for a, b in ((1, 4), (2, 3))]
    d.clear().clear()
    assert [*counts, g.count()] == [4, 2, 6]
    assert d.filter((9, 3)).session.count() == 0
    assert d.filter((-5, 99)).session.count() == 6


def test_two_dimensions(spark):
    s = Session(from_rows(spark, [{"a": i, "b": 10 * i} for i in range(5)]), bins=16)
    a, b, got = s.dimension("a"), s.dimension("b"), []
    for step in (lambda: a.filter_values(1, 3), lambda: a.filter_values(2, 4), lambda: b.filter_values(15, 35), b.clear, a.clear):
        step()
        got.append(s.count())
    assert got == [3, 3, 2, 3, 5]


def test_delta_equals_recompute_and_order_is_irrelevant(spark):
    s = Session(from_frame(generate.uniform(spark, 5000, 3), ["dim0", "dim1", "dim2"]), bins=64)
    s.dimension("dim0").filter((5, 50))
    s.dimension("dim1").filter((10, 60))
    before = snapshot(s.refresh())
    for new in ((20, 63), (5, 50), None, (40, 30)):
        after = snapshot(s.refresh_with(s.refresh(), "dim1", new))
        other = Session(s.table, bins=64)
        if new is not None:
            other.dimension("dim1").filter(new)
        other.dimension("dim0").filter((5, 50))
        assert after == snapshot(other.refresh())
    assert len({sum(h.values()) for h in before.values()}) == 1
    assert sum(before["dim2"].values()) == s.count()


def test_first_seen_codes_and_overflow(spark):
    rows = [{"distance": i, "carrier": c} for i, c in enumerate(["AA", "UA", "DL", "WN", "B6"])]
    s = Session(from_rows(spark, rows), bins=4)
    assert dense(s.group("carrier")) == [1, 1, 1, 2]
    assert [r["label"] for r in s.group("carrier").top(1).collect()] == ["WN"]


def test_rows_and_columns_agree(spark):
    rows = [{"carrier": c, "distance": d} for c, d in (("AA", 100), ("UA", 200), ("AA", 150), ("DL", 250))]
    a = Session(from_rows(spark, rows), bins=8)
    b = Session(from_columns(spark, {"carrier": [0, 1, 0, 2], "distance": [100, 200, 150, 250]}, {"carrier": ["AA", "UA", "DL"]}), bins=8)
    for name in ("carrier", "distance"):
        assert dense(a.group(name)) == dense(b.group(name))
    assert dense(a.group("carrier"))[:3] == [2, 1, 1]


def test_codes_outside_the_labels(spark):
    s = Session(from_columns(spark, {"c": [0, 7, -1, 1.5, None, 1]}, {"c": ["x", "y"]}), bins=4)
    assert dense(s.group("c")) == [1, 5, 0, 0]


def test_bad_tables(spark):
    for bad in ({}, {"a": [1], "b": [1, 2]}):
        with pytest.raises(ValueError):
            from_columns(spark, bad)
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [1]}, length=2)
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [0]}, {"a": []})
    with pytest.raises(TypeError):
        from_rows(spark, "text")
    assert Session(from_rows(spark, [])).refresh().count() == 0


def test_missing_and_strange_values(spark):
    rows = [{"n": 1, "t": "a"}, {"n": None, "t": None}, {}, {"n": "7", "t": True}, {"n": "x", "t": 3.0}, {"n": math.inf, "t": "a", "late": 1}]
    table = from_rows(spark, rows)
    assert table.types == {"n": "number", "t": "string"}
    s = Session(table, bins=8)
    assert (s.dims["n"].scale.low, s.dims["n"].scale.high) == (0, 7)
    assert s.dims["t"].labels == ("a", "null", "", "true", "3")
    assert sum(dense(s.group("n"))) == 6
    df = spark.createDataFrame([(None, None), (2.0, "x"), (4.0, None)], "n double, t string").withColumn("i", F.monotonically_increasing_id())
    missing, zero = (Session(from_frame(df, ["n", "t"], "i"), bins=4, null_as=p) for p in ("missing", "zero"))
    assert (missing.dims["n"].scale.low, zero.dims["n"].scale.low) == (2, 0)
    assert (missing.dims["t"].labels, zero.dims["t"].labels) == (("", "x"), ("null", "x"))


def test_empty_frame_and_clashing_names(spark):
    empty = spark.createDataFrame([], "b0 int, bin string, k double")
    s = Session(from_frame(empty, ["b0", "bin", "k"], "k"), bins=4)
    assert s.count() == 0
    assert s.refresh().count() == 0
    assert dense(s.group("b0")) == [0, 0, 0, 0]
    df = spark.createDataFrame([(1, "x", 2.0, 3), (2, "y", 4.0, 4)], "b0 int, count string, bin double, l_b1 int")
    s = Session(from_frame(df, ["b0", "count", "bin"], "l_b1"), bins=4, keep=["l_b1"])
    assert s.refresh().count() == 6


def test_text_needs_an_order(spark):
    with pytest.raises(ValueError, match="order_by"):
        Session(from_frame(spark.createDataFrame([("a",)], "t string")))


def test_coarse(spark):
    s = values(spark, range(1024), 1024, dimensions={"value": {"coarse_bins": 64}})
    got = s.group("value").coarse().collect()
    assert len(got) == 64
    assert {r["count"] for r in got} == {16}
    assert values(spark, [1, 2]).group("value").coarse() is None


def test_reductions(spark):
    rows = [{"value": i, "amount": 10 * i} for i in range(1, 5)]
    s = Session(from_rows(spark, rows), values=["amount", "none"])
    got = s.group("value").reduce_sum("amount").all().collect()
    assert [(r["count"], r["sum"], r["avg"]) for r in got] == [(1, v, v) for v in (10.0, 20.0, 30.0, 40.0)]
    assert [r["min"] for r in s.group("value").reduce_min("amount").all().collect()] == [10.0, 20.0, 30.0, 40.0]
    assert [r["sum"] for r in s.group("value").reduce_sum("none").all().collect()] == [0.0] * 4
    assert sum(dense(s.group("value"))) == 4
    with pytest.raises(ValueError):
        s.group("value").reduce_sum("other")
    with pytest.raises(TypeError):
        s.group("value").reduce_sum(lambda r: 1)


def test_top_and_bottom(spark):
    s = values(spark, [1, 2, 3, 4, 5, 5, 5, 4, 4], None)
    g = s.group("value")
    assert [round(r["value"], 2) for r in g.top(2).collect()] == [4.0, 5.0]
    assert [r["count"] for r in g.bottom(2).collect()] == [1, 1]
    assert len(g.top(99).collect()) == 5
    assert g.top(0).collect() == []
    with pytest.raises(ValueError):
        g.top(-1)
    s.dispose()
    assert g.top(3).collect() == []


def test_refusals(spark):
    s = values(spark, [1, 2])
    with pytest.raises(TypeError, match="Function-based dimensions are not supported.*Pre-compute"):
        s.dimension(lambda r: r)
    with pytest.raises(KeyError):
        s.dimension("other")
    with pytest.raises(TypeError):
        s.group(3)
    for bad in ({1, 2}, lambda x: x):
        with pytest.raises(NotImplementedError):
            s.dimension("value").filter(bad)
    with pytest.raises(ValueError):
        s.dimension("value").filter((1,))


def test_lifecycle(spark):
    with values(spark, range(100), 64, cache=True) as s:
        first = s.build_index("value")
        assert s.build_index("value") is first
        assert s.index_status("value") == first
        assert first["bytes"] == 4 * 100 + 4 * 65
        s.dimension("value").filter((10, 50))
        assert s.count() == sum(10 <= bin_of(v, s.dims["value"].scale) <= 50 for v in range(100))
        s.when_idle()
    s.dispose()
    assert values(spark, [1, 2]).index_status("value") == {"ready": False}


def test_clear_with_profile(spark):
    s = values(spark, range(64), 16)
    s.dimension("value").filter((2, 13))
    before = s.refresh()
    assert s.clear_strategy("value") == "recompute"  # so few rows are counted at once
    after = s.clear_with_profile("value", before)
    assert snapshot(after) == snapshot(s.refresh())
    assert s.profile() | {"ms": 0} == {"dimension": "value", "strategy": "recompute", "fallback": True, "range": (2, 13), "range_bins": 12, "ms": 0, "rows": 64, "inside_rows": s._inside("value", (2, 13)), "outside_rows": 64 - s._inside("value", (2, 13)), "outside_fraction": 1 - s._inside("value", (2, 13)) / 64}
    assert s.planner_snapshot()["recompute_seconds_seen"] == 1
    s.planner.choose = lambda work: "delta"
    for kept in (False, True):
        s.dimension("value").filter((2, 13))
        before = s.refresh("delta") if kept else s.refresh()
        after = s.clear_with_profile("value", None if kept else before)
        assert snapshot(after) == snapshot(s.refresh())
        assert s.profile()["strategy"] == "delta"
    assert s.planner_snapshot()["delta_seconds_seen"] == 2


def test_deltas_of_sums_and_coarse_bins(spark):
    s = Session(from_frame(generate.uniform(spark, 3000, 3), ["dim0", "dim1"]), bins=16, values=["dim2"])
    group = s.group("dim1", coarse_bins=5).reduce_sum("dim2")
    for old, new in ((None, (2, 9)), ((2, 9), (4.5, 99)), ((3, 8), None), ((1, 4), (6, 9)), ((9, 2), (0, 3)), ((0, 3), (9, 2)), ((2, 7), (2, 7))):
        s.dimension("dim0").clear()
        if old:
            s.dimension("dim0").filter(old)
        sums, coarse = group.all(), group.coarse()
        got, rough = group.all_with(sums, "dim0", new).collect(), snapshot(group.coarse_with(coarse, "dim0", new).withColumn("dim", F.lit("x")))
        s.refresh("delta")
        s.dimension("dim0").clear()
        if new:
            s.dimension("dim0").filter(new)
        want = group.all().collect()
        assert [r["bin"] for r in got] == [r["bin"] for r in want]
        assert [r["count"] for r in got] == [r["count"] for r in want]
        assert [r["sum"] for r in got] == pytest.approx([r["sum"] for r in want])
        assert [r["avg"] for r in got] == pytest.approx([r["avg"] for r in want])
        assert rough == snapshot(group.coarse().withColumn("dim", F.lit("x")))
        assert snapshot(s.refresh("delta")) == snapshot(s.refresh("scan"))
    group.reduce_min("dim2")
    with pytest.raises(ValueError, match="taken back"):
        group.all_with(group.all(), "dim0", None)


def test_deltas_read_changed_bins_alone(spark, tmp_path):
    generate.uniform(spark, 2000, 2).write.parquet(str(tmp_path / "t"))
    s = Session(from_frame(spark.read.parquet(str(tmp_path / "t")), ["dim0", "dim1"]), bins=1024)
    s.dimension("dim0").filter((100, 200))
    change = deltas.changes(s.rows, list(s.dims.values()), s.filters, "dim0", (110, 205))
    plan = change._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    assert "GreaterThanOrEqual(dim0" in plan
    assert snapshot(s.refresh_with(s.refresh(), "dim0", (110, 205))) == snapshot(Session(s.table, fitted=list(s.dims.values())).dimension("dim0").filter((110, 205)).session.refresh())


def test_indexes_tell_the_truth(spark):
    s = Session(from_frame(generate.uniform(spark, 3000, 3), ["dim0", "dim1"]), bins=32)
    s.dimension("dim0").filter((3, 9))
    s.dimension("dim1").filter((5, 7))
    want = snapshot(s.refresh())
    for name in ("dim0", "dim1"):
        s.build_index(name)
        assert snapshot(s.refresh()) == want
    assert s.index_status("dim0")["ready"]
    assert s.index_status("dim1")["ready"]
    s.add_dimension("dim2")
    assert s.index_status("dim0") == s.index_status("dim1") == {"ready": False}
    hot = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("b0"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join such small partitions
    sizes = index.clustered(hot, s.dims["dim0"]).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1
    assert max(r["count"] for r in sizes) < 2.5 * 40_000 / len(sizes)
    s.dispose()


def test_stored_fits_and_absent_columns(spark):
    df = spark.createDataFrame([(i, f"w{i % 3}", float(i)) for i in range(30)], "i int, w string, x double")
    s = Session(from_frame(df, ["w", "x"], "i"), bins=8)
    fitted = load_fit(dump_fit(list(s.dims.values())))
    assert fitted == list(s.dims.values())
    assert snapshot(Session(from_frame(df, ["w", "x"], "i"), fitted=fitted).refresh()) == snapshot(s.refresh())
    less = Session(from_frame(df.drop("x"), ["w"], "i"), fitted=fitted)
    assert [(r["bin"], r["count"]) for r in less.refresh().where("dim = 'x'").collect()] == [(0, 30)]
    less.dimension("x").filter((0, 3))
    assert less.count() == 30
    half = Session(from_frame(df, ["x"]), bins=8, dimensions={"x": {"domain": (None, 15)}})
    assert (half.dims["x"].scale.low, half.dims["x"].scale.high) == (0, 15)
    codes = Session(from_columns(spark, {"c": [0, 1, 7, 2.5, None, 9]}, {"c": ["7", "x", "2.5", "NaN"]}), bins=8)
    assert [r["b0"] for r in codes.encoded.collect()] == [0, 1, 0, 2, 3, 3]


def test_too_many_sessions(spark, monkeypatch):
    monkeypatch.setenv("BINWEAVE_MAX_SESSIONS", "1")
    with pytest.warns(UserWarning, match="sessions"):
        values(spark, [1, 2])


def test_pushdown_reaches_the_scan(spark, tmp_path):
    generate.uniform(spark, 2000, 2).write.parquet(str(tmp_path / "t"))
    s = Session(from_frame(spark.read.parquet(str(tmp_path / "t")), ["dim0", "dim1"]), bins=1024)
    s.dimension("dim0").filter((100, 200))
    plan = s.rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dim0" in plan
    plain = s.encoded.where(filters.active(s.dims, s.filters))
    assert s.rows().count() == plain.count() > 0
    s.dimension("dim0").filter((0, 1023))
    assert s.rows().count() == 2000


@pytest.mark.parametrize("kind", ["double", "long"])
@pytest.mark.parametrize("bounds", [(0, 3), (1, 15), (0, 15), (-4, 99), (3, 15), (5, 5), (9, 2), (0.5, 7.5), (15, 15), (0, 0)])
def test_filters_at_the_source_are_exact(spark, kind, bounds):
    strange = [None, math.nan, math.inf, -math.inf] if kind == "double" else [None, None]
    data = [*strange, *[float(v) if kind == "double" else v for v in range(-7, 60)]]
    for clean in (False, True):
        df = spark.createDataFrame([(v,) for v in (data[len(strange) :] if clean else data)], f"v {kind}")
        s = Session(from_frame(df), bins=16)
        assert s.dims["v"].clean == clean
        s.dimension("v").filter(bounds)
        scale = s.dims["v"].scale
        want = sum(bounds[0] <= bin_of(None if r["v"] is None else float(r["v"]), scale) <= bounds[1] for r in df.collect())
        assert s.count() == want == s.encoded.where(filters.active(s.dims, s.filters)).count()


def test_sandbox_agrees(spark):
    rows = [{"value": i, "doubled": 2 * i} for i in range(8)]
    simple = SimpleEngine([Field("value", 4), Field("doubled", 4)], rows)
    s = Session(from_rows(spark, rows), bins=16)
    for step in (None, (4, 11), None):
        simple.filter("value", step) if step else simple.clear("value")
        s.dimension("value").filter(step) if step else s.dimension("value").clear()
        for name in ("value", "doubled"):
            assert simple.histogram(name) == dense(s.group(name))
    with pytest.raises(ValueError):
        SimpleEngine([], rows)
    assert SimpleEngine([Field("value", 4, 3, 3)], rows).scales["value"].high == 4
    assert SimpleEngine([Field("value", 4)], [{"value": 5}] * 3).scales["value"].high == 3


def test_adapter(spark):
    classic = Classic(values(spark, [1, 2, 3, 4]))
    d = classic.dimension("value")
    assert len(d.filter((5, 10)).group().all().collect()) == 16
    assert sum(r["value"] for r in d.group().all().collect()) == 2
    assert sum(r["value"] for r in d.filter_all().group().all().collect()) == 4
    classic.when_idle()
    classic.dispose()


def test_running_stats_and_categories(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (None,)], "v double")
    assert tuple(histograms.running_stats(df, F.col("v")).first()) == (2, 3.0, 1.0)
    assert tuple(histograms.running_stats(df.limit(0), F.col("v")).first()) == (0, 0.0, 0.0)


def test_brush():
    from binweave.functions.quantize import Scale

    scale = Scale(0, 100, 8)
    assert brush(60, 20, scale) == (51, 153)
    assert pixels_to_values(50, -10, 200, scale) == (0, 25)


def test_flights_and_reports(spark, tmp_path):
    df = generate.flights(spark, 500)
    assert df.agg(F.min("hour"), F.max("distance")).first()[0] >= 0
    assert df.select("carrier").distinct().count() == 6
    for k in range(3):
        write_report({"k": k}, tmp_path / f"r-{k}.json")
    assert latest_reports(tmp_path, "r-", 2) == [{"k": 1}, {"k": 2}]


def test_strategies_agree(spark):
    s = Session(from_frame(generate.uniform(spark, 3000, 3), ["dim0", "dim1", "dim2"]), bins=8)
    s.dimension("dim0").filter((2, 6))
    want = snapshot(s.refresh("scan"))
    assert want == snapshot(s.refresh("separate")) == snapshot(s.refresh("cube"))
    assert s.build_cube() <= 512
    s.dimension("dim1").filter((1, 3))
    assert snapshot(s.refresh()) == snapshot(s.refresh("scan"))
    s.add_dimension("row_order")
    assert snapshot(s.refresh()) == snapshot(s.refresh("cube"))
    with pytest.raises(ValueError):
        s.refresh("other")
    s.dispose()
