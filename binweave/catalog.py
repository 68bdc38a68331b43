"""A query for each operator over the test tables, and the DuckDB SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.adapter import Classic
from binweave.functions.quantize import bin_of
from binweave.operators import deltas, derived, filters, histograms, index
from binweave.plans.encode import Options, dump_fit, encode, fit, load_fit
from binweave.session import Session
from binweave.sources.tables import Table, from_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Dimensions of lineitem in most queries, all numeric.
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, dims: tuple[str, ...] = LINE, bins: int = 1024, **more: object) -> Session:
    return Session(from_frame(_read(spark, sf_dir, "lineitem"), dims), bins=bins, **more)


def _bin(expr: str, low: str, high: str, bits: int) -> str:
    """SQL for the bin of a number without nulls."""
    x = f"((least(greatest({expr}, {low}), {high}) - {low}) * ({(1 << bits) - 1}.0::DOUBLE / ({high} - {low})))"
    return f"CAST(floor({x}) + CASE WHEN {x} - floor({x}) >= 0.5 THEN 1 ELSE 0 END AS INTEGER)"


def _binned(table: str, bits: int | dict[str, int], *columns: str, extra: str = "", exprs: dict[str, str] | None = None) -> str:
    """CTEs st (ranges) and b (a column of bins for each of columns, by its name)."""
    exprs = exprs or {}
    of = lambda c: exprs.get(c, f"CAST({c} AS DOUBLE)")
    width = lambda c: bits if isinstance(bits, int) else bits[c]
    stats = ", ".join(f"min({of(c)}) AS lo_{c}, max({of(c)}) AS hi_{c}" for c in columns)
    made = ", ".join(f"{_bin(of(c), f'lo_{c}', f'hi_{c}', width(c))} AS {c}" for c in columns)
    return f"st AS (SELECT {stats} FROM {table}), b AS (SELECT {made}{', ' + extra if extra else ''} FROM {table}, st)"


_L = "WITH " + _binned("lineitem", 10, *LINE)
_union = lambda where="TRUE": " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS bin, count(*) AS count FROM b WHERE {where} GROUP BY {c}" for c in LINE)


@_query(f"{_L} SELECT l_extendedprice AS bin, count(*) AS count FROM b GROUP BY 1")
def hist_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_extendedprice",))
    return histograms.histogram(s.rows(), s.dims["l_extendedprice"])


@_query(f"{_L} {_union()}")
def hist_all_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).refresh()


@_query(f"{_L} {_union('l_quantity BETWEEN 256 AND 767')}")
def linked_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every dimension's histogram under a filter, by one job."""
    s = _lines(spark, sf_dir)
    s.dimension("l_quantity").filter((256, 767))
    return s.refresh()


@_query(f"WITH {_binned('lineitem', 8, 'l_discount')} SELECT CAST(r.range AS INTEGER) AS bin, count(b.l_discount) AS count FROM range(256) r LEFT JOIN b ON b.l_discount = r.range GROUP BY 1")
def hist_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_discount",), 256).group("l_discount").bins()


@_query(f"{_L} SELECT l_quantity AS bin, count(*) AS count FROM b WHERE l_quantity BETWEEN 200 AND 600 GROUP BY 1")
def hist_filtered_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_quantity",))
    return histograms.histogram(_filtered(s, l_quantity=(200, 600)).rows(), s.dims["l_quantity"])


def _filtered(s: Session, **ranges: tuple[float, float]) -> Session:
    for name, r in ranges.items():
        s.dimension(name).filter(r)
    return s


@_query(f"{_L} SELECT l_quantity AS bin, count(*) AS count FROM b WHERE l_discount BETWEEN 100 AND 900 GROUP BY 1")
def hist_exclude_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(200, 600), l_discount=(100, 900))
    return s.group("l_quantity").bins(exclude_own=True).where("count > 0")


@_query(f"{_L} SELECT l_extendedprice AS bin, count(*) AS count FROM b WHERE l_quantity BETWEEN 256 AND 767 AND l_discount BETWEEN 100 AND 900 GROUP BY 1")
def hist_filtered_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(256, 767), l_discount=(100, 900))
    return histograms.histogram(s.rows(), s.dims["l_extendedprice"])


@_query(f"{_L} {_union('l_quantity BETWEEN 600 AND 900')}")
def filter_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir)
    s.dimension("l_quantity").filter((500, 800)).filter((600, 900))
    return s.refresh()


@_query(f"{_L} {_union('l_tax BETWEEN 0 AND 500')}")
def filter_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(500, 800), l_tax=(0, 500))
    s.dimension("l_quantity").clear()
    return s.refresh()


@_query(f"{_L} {_union('l_quantity BETWEEN 700 AND 300')}")
def filter_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_lines(spark, sf_dir), l_quantity=(700, 300)).refresh()


@_query(f"{_L} SELECT l_tax AS bin, count(*) AS count FROM b WHERE l_quantity BETWEEN 99.5 AND 5000 GROUP BY 1")
def filter_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(99.5, 5000))
    return histograms.histogram(s.rows(), s.dims["l_tax"])


@_query(f"{_L} SELECT CAST((l_quantity BETWEEN 256 AND 767)::INT + (l_discount BETWEEN 100 AND 900)::INT AS INTEGER) AS satisfied, count(*) AS count FROM b GROUP BY 1")
def satisfied_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(256, 767), l_discount=(100, 900))
    return s.encoded.groupBy(filters.satisfied(s.dims, s.filters).alias("satisfied")).agg(F.count(F.lit(1)).alias("count"))


@_query(f"{_L} SELECT count(*) AS active FROM b WHERE l_quantity BETWEEN 256 AND 767")
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_lines(spark, sf_dir), l_quantity=(256, 767)).rows().agg(F.count(F.lit(1)).alias("active"))


@_query(f"{_L} SELECT round(100.0 * count(*) FILTER (WHERE l_quantity BETWEEN 256 AND 767) / count(*), 6)::DOUBLE AS percent FROM b")
def percent_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(256, 767))
    return s.encoded.agg(F.round(100.0 * F.count_if(filters.active(s.dims, s.filters)) / F.count(F.lit(1)), 6).alias("percent"))


@_query(f"{_L} SELECT CAST(l_extendedprice // 16 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY 1")
def hist_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_extendedprice",), dimensions={"l_extendedprice": {"coarse_bins": 64}}).group("l_extendedprice").coarse()


@_query(f"{_L} SELECT CAST(l_extendedprice // 18 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY 1")
def hist_coarse_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_extendedprice",)).group("l_extendedprice", coarse_bins=60).coarse()


@_query(f"{_L} SELECT CAST(l_extendedprice // 17 AS INTEGER) AS chunk, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY 1")
def hist_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_extendedprice",))
    dim = s.dims["l_extendedprice"]
    return derived.downsampled(histograms.histogram(s.rows(), dim), dim, 60)


_CODES = "WITH d AS (SELECT event_type AS label, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1), b AS (SELECT CAST(least(code, {last}) AS INTEGER) AS bin FROM events JOIN d ON event_type = label) SELECT bin, count(*) AS count FROM b GROUP BY 1"


@_query(_CODES.format(last=15))
def hist_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "events"), ["event_type"], "event_id"), bins=16)
    return histograms.histogram(s.rows(), s.dims["event_type"])


@_query(_CODES.format(last=1))
def hist_string_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "events"), ["event_type"], "event_id"), bins=2)
    return histograms.histogram(s.rows(), s.dims["event_type"])


_REGIONS = ("zero", "one", "two", "three")


@_query("SELECT CAST(least(n_regionkey, 3) AS INTEGER) AS bin, CASE least(n_regionkey, 3) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three' END AS label, count(*) AS count FROM nation GROUP BY 1, 2")
def hist_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with labels; codes beyond the labels fall to the last."""
    s = Session(from_frame(_read(spark, sf_dir, "nation"), ["n_regionkey"], labels={"n_regionkey": _REGIONS}), bins=8)
    dim = s.dims["n_regionkey"]
    return histograms.keyed(histograms.histogram(s.rows(), dim), dim)


@_query("SELECT 5 AS bin, count(*) AS count FROM orders")
def hist_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "orders").select(F.lit(5).alias("five")), ["five"]))
    return histograms.histogram(s.rows(), s.dims["five"])


@_query("WITH " + _binned("events", 8, "ts", exprs={"ts": "CAST(epoch_us(ts) AS DOUBLE)"}) + " SELECT ts AS bin, count(*) AS count FROM b GROUP BY 1")
def hist_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "events"), ["ts"]), bins=256)
    return histograms.histogram(s.rows(), s.dims["ts"])


@_query("WITH " + _binned("lineitem", {"l_quantity": 8, "l_extendedprice": 12}, "l_quantity", "l_extendedprice") + " SELECT 'l_quantity' AS dim, l_quantity AS bin, count(*) AS count FROM b GROUP BY 2 UNION ALL SELECT 'l_extendedprice', l_extendedprice, count(*) FROM b GROUP BY 2")
def hist_mixed_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_quantity", "l_extendedprice"), 256, dimensions={"l_extendedprice": {"bins": 3000}}).refresh()


_R = "WITH " + _binned("lineitem", 10, "l_quantity", "l_discount", extra="CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS v")


def _reduced(spark: SparkSession, sf_dir: str, kind: str, **ranges: tuple[float, float]) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, ("l_quantity", "l_discount"), values=["l_extendedprice"]), **ranges)
    return getattr(s.group("l_quantity"), f"reduce_{kind}")("l_extendedprice").all()


@_query(f"{_R} SELECT l_quantity AS bin, count(*) AS count, round(sum(v), 2) AS sum FROM b GROUP BY 1")
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "sum").select("bin", "count", F.round("sum", 2).alias("sum"))


@_query(f"{_R} SELECT l_quantity AS bin, count(*) AS count, round(sum(v), 2) AS sum FROM b WHERE l_discount BETWEEN 200 AND 700 GROUP BY 1")
def reduce_sum_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "sum", l_discount=(200, 700)).select("bin", "count", F.round("sum", 2).alias("sum"))


@_query(f"{_R} SELECT l_quantity AS bin, round(sum(v) / count(*), 4) AS avg FROM b GROUP BY 1")
def reduce_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "sum").select("bin", F.round("avg", 4).alias("avg"))


@_query(f"{_R} SELECT l_quantity AS bin, count(*) AS count, min(v) AS min FROM b GROUP BY 1")
def reduce_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "min")


@_query(f"{_R} SELECT l_quantity AS bin, count(*) AS count, max(v) AS max FROM b GROUP BY 1")
def reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir, "max")


@_query(f"{_L} SELECT l_tax AS bin, count(*) AS count FROM b GROUP BY 1")
def group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_tax",)).group("l_tax").all()


def _top(order: str, where: str = "TRUE") -> str:
    return f"{_L} SELECT bin, count, round(lo + bin / 1023.0::DOUBLE * (hi - lo), 6) AS value FROM (SELECT l_quantity AS bin, count(*) AS count FROM b WHERE {where} GROUP BY 1 ORDER BY {order}, 1 LIMIT 7), (SELECT lo_l_quantity AS lo, hi_l_quantity AS hi FROM st)"


@_query(_top("2 DESC"))
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_quantity",)).group("l_quantity").top(7).withColumn("value", F.round("value", 6))


@_query(_top("2"))
def bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, ("l_quantity",)).group("l_quantity").bottom(7).withColumn("value", F.round("value", 6))


@_query(_top("2 DESC", "l_discount BETWEEN 0 AND 300"))
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_discount=(0, 300))
    return s.group("l_quantity").top(7).withColumn("value", F.round("value", 6))


@_query("WITH d AS (SELECT event_type AS label, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS bin, count(*) AS count FROM events GROUP BY 1) SELECT bin, count, label FROM d ORDER BY count DESC, bin LIMIT 3")
def topk_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(from_frame(_read(spark, sf_dir, "events"), ["event_type"], "event_id"), bins=16).group("event_type").top(3)


@_query(_R + " SELECT l_quantity AS bin, round(sum(v), 2) AS sum FROM b GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 5")
def topk_by_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_quantity", "l_discount"), values=["l_extendedprice"])
    return s.group("l_quantity").reduce_sum("l_extendedprice").top(5, by="sum").select("bin", F.round("sum", 2).alias("sum"))


_ROWS = f"(SELECT 'l_quantity' AS dim, l_quantity AS bin, s FROM m UNION ALL SELECT 'l_extendedprice', l_extendedprice, s FROM m UNION ALL SELECT 'l_discount', l_discount, s FROM m UNION ALL SELECT 'l_tax', l_tax, s FROM m)"


@_query(f"{_L}, m AS (SELECT *, (l_quantity BETWEEN 600 AND 900)::INT - (l_quantity BETWEEN 500 AND 800)::INT AS s FROM b WHERE l_tax BETWEEN 0 AND 600) SELECT dim, bin, CAST(sum(s) AS BIGINT) AS count FROM {_ROWS} GROUP BY 1, 2 HAVING sum(s) <> 0")
def delta_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(500, 800), l_tax=(0, 600))
    return deltas.changes(s.rows, list(s.dims.values()), s.filters, "l_quantity", (600, 900))


@_query(f"{_L} {_union('l_quantity BETWEEN 600 AND 900 AND l_tax BETWEEN 0 AND 600')}")
def delta_equals_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(500, 800), l_tax=(0, 600))
    return s.refresh_with(s.refresh(), "l_quantity", (600, 900))


@_query(f"{_L} {_union('l_tax BETWEEN 0 AND 600')}")
def delta_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(500, 800), l_tax=(0, 600))
    return s.refresh_with(s.refresh(), "l_quantity", None)


@_query(f"{_L} {_union('l_quantity BETWEEN 600 AND 900 AND l_tax BETWEEN 0 AND 600')}")
def refresh_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept counts and the rows that came or went, range by range."""
    s = _filtered(_lines(spark, sf_dir), l_tax=(0, 600))
    for bounds in ((500, 800), (650, 700), (600, 900)):
        s.refresh("delta")
        s.dimension("l_quantity").filter(bounds)
    return s.refresh("delta")


@_query(f"{_R} SELECT l_quantity AS bin, count(*) AS count, round(sum(v), 2) AS sum, round(sum(v) / count(*), 4) AS avg FROM b WHERE l_discount BETWEEN 150 AND 900 GROUP BY 1")
def delta_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, ("l_quantity", "l_discount"), values=["l_extendedprice"]), l_discount=(200, 700))
    group = s.group("l_quantity").reduce_sum("l_extendedprice")
    return group.all_with(group.all(), "l_discount", (150, 900)).select("bin", "count", F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg"))


@_query(f"{_L} SELECT CAST(l_extendedprice // 18 AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count FROM b WHERE l_discount BETWEEN 300 AND 1000 GROUP BY 1")
def delta_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_discount=(200, 700))
    group = s.group("l_extendedprice", coarse_bins=60)
    return group.coarse_with(group.coarse(), "l_discount", (300, 1000))


@_query(f"{_L} {_union('l_quantity BETWEEN 100 AND 130 AND l_extendedprice BETWEEN 500 AND 700')}")
def refresh_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes, of which the narrower filter's is read."""
    s = _lines(spark, sf_dir)
    s.build_index("l_quantity")
    s.build_index("l_extendedprice")
    return _filtered(s, l_quantity=(100, 130), l_extendedprice=(500, 700)).refresh()


@_query(f"{_L} {_union('l_quantity BETWEEN 256 AND 767')}")
def fit_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session from a stored fit."""
    stored = dump_fit(list(_lines(spark, sf_dir).dims.values()))
    s = _lines(spark, sf_dir, fitted=load_fit(stored))
    return _filtered(s, l_quantity=(256, 767)).refresh()


@_query("SELECT bin, count(*) AS count FROM (SELECT CAST(CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 END AS INTEGER) AS bin FROM nation) GROUP BY 1")
def hist_codes_as_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code without a label is its own text: 4 is the label of code 1."""
    s = Session(from_frame(_read(spark, sf_dir, "nation"), ["n_regionkey"], labels={"n_regionkey": ("zero", "4", "two", "three")}), bins=8)
    return histograms.histogram(s.rows(), s.dims["n_regionkey"])


_FIRST = "SELECT '{0}' AS dim, CAST(least(code, 15) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count FROM {1} JOIN (SELECT {0} AS label, row_number() OVER (ORDER BY min(o_orderkey), {0}) - 1 AS code FROM {1} GROUP BY 1) ON {0} = label GROUP BY 2"


@_query(" UNION ALL ".join(_FIRST.format(c, "orders") for c in ("o_orderstatus", "o_orderpriority")))
def hist_two_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(from_frame(_read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey"), bins=16).refresh()


@_query(f"WITH st AS (SELECT max(l_quantity)::DOUBLE AS hi FROM lineitem) SELECT {_bin('CAST(l_quantity AS DOUBLE)', '10.0::DOUBLE', 'hi', 8)} AS bin, count(*) AS count FROM lineitem, st GROUP BY 1")
def one_sided_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_quantity",), 256, dimensions={"l_quantity": {"domain": (10, None)}})
    return histograms.histogram(s.rows(), s.dims["l_quantity"])


@_query(
    f"{_L} SELECT CAST((l_quantity BETWEEN 500 AND 800)::INT + (l_tax BETWEEN 0 AND 600)::INT AS INTEGER) AS before, CAST((l_quantity BETWEEN 600 AND 900)::INT + (l_tax BETWEEN 0 AND 600)::INT AS INTEGER) AS after,"
    " count(*) AS rows FROM b GROUP BY 1, 2"
)
def filter_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir), l_quantity=(500, 800), l_tax=(0, 600))
    return deltas.transitions(s.encoded, s.dims, s.filters, "l_quantity", (600, 900))


@_query(
    "SELECT * FROM (VALUES ('shift', 'added', 8, 9), ('shift', 'removed', 2, 3), ('shrink', 'removed', 2, 2), ('shrink', 'removed', 7, 7), ('grow', 'added', 2, 2), ('grow', 'added', 7, 7),"
    " ('apart', 'added', 5, 6), ('apart', 'removed', 1, 2), ('clear', 'added', 0, 2), ('clear', 'added', 6, 15)) t(name, kind, low, high)"
)
def range_diff_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"shift": ((2, 7), (4, 9)), "same": ((2, 7), (2, 7)), "shrink": ((2, 7), (3, 6)), "grow": ((3, 6), (2, 7)), "apart": ((1, 2), (5, 6)), "clear": ((3, 5), None)}
    rows = [(name, kind, int(a), int(b)) for name, (old, new) in cases.items() for kind, got in zip(("added", "removed"), filters.range_diff(old, new, 16), strict=True) for a, b in got]
    return spark.createDataFrame(rows, "name string, kind string, low int, high int")


_O = "WITH " + _binned("orders", 8, "o_totalprice", extra="o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> Session:
    return Session(from_frame(_read(spark, sf_dir, "orders"), ["o_totalprice"]), bins=256, keep=["o_orderkey"])


@_query(f"{_O}, h AS (SELECT r.range AS bin, count(b.o_totalprice) AS n FROM range(257) r LEFT JOIN b ON b.o_totalprice = r.range GROUP BY 1) SELECT CAST(bin AS BIGINT) AS bin, CAST(coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM h")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders(spark, sf_dir)
    return index.offsets(s.encoded, s.dims["o_totalprice"]).select(F.col("bin").cast("long").alias("bin"), "offset")


@_query(f"{_O} SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position, o_totalprice AS bin, o_orderkey AS row_id FROM b")
def csr_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders(spark, sf_dir)
    return index.row_ids(s.encoded, s.dims["o_totalprice"], "o_orderkey")


@_query(f"{_O} SELECT o_orderkey FROM b WHERE o_totalprice BETWEEN 40 AND 60")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders(spark, sf_dir)
    return index.lookup(s.encoded, s.dims["o_totalprice"], 40, 60, F.col("o_orderkey"))


@_query(f"{_O} SELECT o_orderkey FROM b WHERE o_totalprice BETWEEN 250 AND 255")
def range_lookup_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the clustered table, bounds clamped."""
    s = _orders(spark, sf_dir)
    dim = s.dims["o_totalprice"]
    return index.lookup(index.clustered(s.encoded, dim), dim, 250, 9999, F.col("o_orderkey"))


@_query(f"{_O} SELECT CAST(count(*) FILTER (WHERE o_totalprice BETWEEN 10 AND 20) + count(*) FILTER (WHERE o_totalprice BETWEEN 200 AND 240) AS BIGINT) AS rows FROM b")
def estimate_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders(spark, sf_dir)
    return histograms.touched(histograms.histogram(s.encoded, s.dims["o_totalprice"]), [(10, 20), (200, 240)])


_CHAIN = (("l_quantity", (150, 870)), ("l_extendedprice", (300, 650)), ("l_discount", (450, 750)))


@_query(
    f"{_L} SELECT 1 AS step, count(*) AS active FROM b WHERE l_quantity BETWEEN 150 AND 870 UNION ALL SELECT 2, count(*) FROM b WHERE l_quantity BETWEEN 150 AND 870 AND l_extendedprice BETWEEN 300 AND 650"
    " UNION ALL SELECT 3, count(*) FROM b WHERE l_quantity BETWEEN 150 AND 870 AND l_extendedprice BETWEEN 300 AND 650 AND l_discount BETWEEN 450 AND 750"
    " UNION ALL SELECT 4, count(*) FROM b WHERE l_quantity BETWEEN 150 AND 870 AND l_extendedprice BETWEEN 300 AND 650 UNION ALL SELECT 5, count(*) FROM b WHERE l_quantity BETWEEN 150 AND 870 UNION ALL SELECT 6, count(*) FROM b"
)
def multi_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows after each of three filters and each clear in reverse, all counted by one pass."""
    s = _lines(spark, sf_dir)
    states = []
    for name, r in _CHAIN:
        states.append(filters.active(s.dims, _filtered(s, **{name: r}).filters))
    for name, _ in reversed(_CHAIN):
        s.dimension(name).clear()
        states.append(filters.active(s.dims, s.filters))
    counts = s.encoded.agg(*[F.count_if(c).alias(f"s{k + 1}") for k, c in enumerate(states)])
    return counts.unpivot([], [f"s{k + 1}" for k in range(len(states))], "step", "active").select(F.substring("step", 2, 9).cast("int").alias("step"), "active")


@_query(
    "WITH " + _binned("lineitem", 10, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber") + " SELECT l_quantity AS bin, count(*) AS count FROM b"
    " WHERE l_quantity BETWEEN 100 AND 900 AND l_extendedprice BETWEEN 50 AND 950 AND l_discount BETWEEN 100 AND 900 AND l_tax BETWEEN 0 AND 800 AND l_linenumber BETWEEN 0 AND 700 GROUP BY 1"
)
def multi_filter_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, (*LINE, "l_linenumber")), l_quantity=(100, 900), l_extendedprice=(50, 950), l_discount=(100, 900), l_tax=(0, 800), l_linenumber=(0, 700))
    return histograms.histogram(s.rows(), s.dims["l_quantity"])


@_query(f"{_L} SELECT CAST(w.range AS INTEGER) AS \"window\", CAST(w.range * 16 AS INTEGER) AS low, CAST(w.range * 16 + 4 AS INTEGER) AS high, count(b.l_extendedprice) AS count FROM range(64) w LEFT JOIN b ON b.l_extendedprice BETWEEN w.range * 16 AND w.range * 16 + 4 GROUP BY w.range")
def brush_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_extendedprice",))
    at = F.col("id").cast("int")
    windows = spark.range(64).select(at.alias("window"), (at * 16).alias("low"), (at * 16 + 4).alias("high"))
    return filters.sweep(s.encoded, s.dims["l_extendedprice"], windows).select("window", "low", "high", "count")


@_query(f"{_L} SELECT round(sum((lo_l_quantity + l_quantity / 1023.0::DOUBLE * (hi_l_quantity - lo_l_quantity)) * n) / sum(n), 6) AS mean FROM (SELECT l_quantity, count(*) AS n FROM b GROUP BY 1), st")
def hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_quantity",))
    dim = s.dims["l_quantity"]
    return derived.mean(histograms.histogram(s.rows(), dim), dim).select(F.round("mean", 6).alias("mean"))


@_query(f"{_L} SELECT count(*) AS count FROM b")
def total_from_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir, ("l_tax",))
    return derived.total(histograms.histogram(s.rows(), s.dims["l_tax"]))


@_query("SELECT CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'north' WHEN 2 THEN 'east' WHEN 3 THEN 'north' ELSE 'west' END AS label, CAST(count(*) AS BIGINT) AS count FROM nation GROUP BY 1")
def hist_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "nation"), ["n_regionkey"]), bins=64)
    dim = s.dims["n_regionkey"]
    return derived.by_category(histograms.histogram(s.rows(), dim), dim, ["south", "north", "east", "north", "west"])


_V = f"{_L}, v AS (SELECT {_bin('20000.0::DOUBLE', 'lo_l_extendedprice', 'hi_l_extendedprice', 10)} AS a, {_bin('60000.0::DOUBLE', 'lo_l_extendedprice', 'hi_l_extendedprice', 10)} AS z FROM st) SELECT l_quantity AS bin, count(*) AS count FROM b, v WHERE l_extendedprice BETWEEN a AND z GROUP BY 1"


@_query(_V)
def filter_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir)
    s.dimension("l_extendedprice").filter_values(20_000, 60_000)
    return histograms.histogram(s.rows(), s.dims["l_quantity"])


@_query(_V)
def pushdown_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_by_value without the bounds that reach the scan."""
    s = _lines(spark, sf_dir)
    s.dimension("l_extendedprice").filter(derived.brush(60_000, 20_000, s.dims["l_extendedprice"].scale))
    return histograms.histogram(s.encoded.where(filters.active(s.dims, s.filters)), s.dims["l_quantity"])


@_query(f"SELECT {_bin('value', '0.0::DOUBLE', '100.0::DOUBLE', 8)} AS bin, count(*) AS count FROM events GROUP BY 1")
def explicit_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(from_frame(_read(spark, sf_dir, "events"), ["value"]), bins=256, dimensions={"value": {"domain": (0, 100)}})
    return histograms.histogram(s.rows(), s.dims["value"])


@_query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events")
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histograms.running_stats(_read(spark, sf_dir, "events"), F.col("value"))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@_query(f"WITH {_binned('lineitem', 6, 'l_tax', 'l_discount')} SELECT CAST(r.range AS INTEGER) AS key, count(b.l_tax) AS value FROM range(64) r LEFT JOIN (SELECT * FROM b WHERE l_discount BETWEEN 10 AND 40) b ON b.l_tax = r.range GROUP BY 1")
def adapter_all_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    classic = Classic(_lines(spark, sf_dir, ("l_tax", "l_discount"), 64))
    classic.dimension("l_discount").filter((10, 40))
    return classic.dimension("l_tax").group().all()


@_query("WITH " + _binned("lineitem", 8, "l_quantity", "l_tax") + " SELECT l_tax AS bin, count(*) AS count, count(*) FILTER (WHERE l_quantity BETWEEN 50 AND 150) AS active FROM b GROUP BY 1")
def dimension_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, ("l_quantity",), 256), l_quantity=(50, 150))
    return s.add_dimension("l_tax")


@_query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 40")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy("o_orderkey").limit(40)


_D = "WITH " + _binned("lineitem", 4, "l_quantity", "l_discount", "l_tax")


@_query(f"{_D} SELECT l_discount AS bin, CAST(count(*) AS BIGINT) AS count FROM b WHERE l_quantity BETWEEN 3 AND 9 GROUP BY 1")
def cube_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram under a filter from the joint counts of three coarse dimensions."""
    s = _lines(spark, sf_dir, ("l_quantity", "l_discount", "l_tax"), 16)
    dims = list(s.dims.values())
    cells = histograms.cube(s.encoded, dims).where(filters.within(dims[0], (3, 9)))
    return cells.groupBy(F.col(dims[1].column).alias("bin")).agg(F.sum("n").alias("count"))


_C = "WITH " + _binned("lineitem", 4, *LINE) + " "


@_query(_C + _union("l_quantity BETWEEN 3 AND 9"))
def refresh_from_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, bins=16), l_quantity=(3, 9))
    return s.refresh("cube")


@_query(_C + _union("l_tax BETWEEN 3 AND 9"))
def refresh_separately(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filtered(_lines(spark, sf_dir, bins=16), l_tax=(3, 9))
    return s.refresh("separate")


@_query("SELECT l_returnflag AS operation, l_linenumber AS size, round(avg(l_extendedprice), 4) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(stddev_pop(l_extendedprice), 4) AS stddev, round(avg(l_quantity), 6) AS avg_memory FROM lineitem GROUP BY 1, 2")
def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_linenumber").alias("size"), F.col("l_extendedprice").alias("ms"), F.col("l_quantity").alias("memory"))
    return derived.benchmark_statistics(rows).withColumns({"avg": F.round("avg", 4), "stddev": F.round("stddev", 4), "avg_memory": F.round("avg_memory", 6)})


@_query("WITH " + _binned("lineitem", 10, "l_quantity", "l_extendedprice") + f", k AS (SELECT *, {_bin('25.0::DOUBLE', 'lo_l_quantity', 'hi_l_quantity', 10)} AS mid FROM st) SELECT count(*) AS count FROM b, k WHERE l_quantity <= mid")
def value_to_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the bin of a value that Python converts as the engine converts the data."""
    s = _lines(spark, sf_dir, ("l_quantity", "l_extendedprice"))
    dim = s.dims["l_quantity"]
    return s.encoded.where(F.col(dim.column) <= bin_of(25.0, dim.scale)).agg(F.count(F.lit(1)).alias("count"))


@_query("WITH p AS (SELECT l_extendedprice * (1 - l_discount) AS revenue FROM lineitem), " + _binned("p", 10, "revenue") + " SELECT revenue AS bin, count(*) AS count FROM b GROUP BY 1")
def computed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension that is computed before the session is built."""
    lines = _read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    s = Session(from_frame(lines, ["revenue"]), bins=1024)
    return histograms.histogram(s.rows(), s.dims["revenue"])


@_query(_O + " SELECT o_orderkey, o_totalprice AS code FROM b")
def encode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table: Table = from_frame(_read(spark, sf_dir, "orders"), ["o_totalprice"])
    dims = fit(table, Options(256))
    return encode(table, dims, keep=["o_orderkey"]).withColumnRenamed("b0", "code")
