"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds, the best of three runs each, after one warm-up."""

import json
import os
import sys
import time
import warnings

from pyspark.sql import SparkSession

from binweave import catalog
from binweave.operators import filters, histograms
from binweave.session import Session
from binweave.sources.tables import from_frame

warnings.simplefilter("ignore")
#: Catalog queries that read their table from file, fit and encode it, and answer.
HEADLINE = ["linked_histograms", "hist_all_dims", "hist_numeric", "hist_filtered_cross", "hist_coarse", "hist_string", "reduce_sum_filtered", "topk", "delta_added_removed", "multi_filter_chain", "multi_filter_five", "brush_sweep", "csr_offsets", "filter_by_value"]
RUNS = 3


def best(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        started = time.perf_counter()
        run()
        times.append(time.perf_counter() - started)
    return round(min(times), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    lines = lambda: spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dims = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")

    def open_session() -> Session:
        s = Session(from_frame(lines(), dims), bins=4096, cache=True)
        s.count()
        return s

    def ingest() -> None:
        open_session().dispose()

    out["ingest_6_dims"] = best(ingest)
    out["fit_6_dims"] = best(lambda: Session(from_frame(lines(), dims), bins=4096).dispose())
    s = open_session()
    s.refresh("delta")
    kept = s._kept
    refresh = lambda: s.refresh().collect()

    def with_filter(name, bounds, run):
        def go():
            s.dimension(name).filter(bounds)
            run()
            s.dimension(name).clear()

        return go

    out["refresh_unfiltered"] = best(refresh)
    out["filter_narrow_2pct"] = best(with_filter("l_extendedprice", (2007, 2089), refresh))
    out["filter_mid_50pct"] = best(with_filter("l_extendedprice", (1024, 3071), refresh))
    out["filter_wide_80pct"] = best(with_filter("l_extendedprice", (410, 3686), refresh))

    def delta(bounds, of=None):
        def go():
            s._kept = of or kept
            s.dimension("l_extendedprice").filter(bounds)
            s.refresh("delta").collect()
            s.dimension("l_extendedprice").clear()

        return go

    out["delta_replace"] = best(delta((2000, 4095)))
    s.dimension("l_extendedprice").filter((2000, 3000))
    s._kept = None
    s.refresh("delta")
    brushed = s._kept
    out["delta_brush"] = best(delta((2020, 3020), brushed))
    s.build_index("l_extendedprice")
    out["delta_brush_indexed"] = best(delta((2020, 3020), brushed))
    s.dimension("l_extendedprice").clear()
    out["one_histogram"] = best(lambda: histograms.histogram(s.rows(), s.dims["l_quantity"]).collect())
    out["active_count"] = best(with_filter("l_quantity", (1000, 3000), s.count))

    def chain():
        for name, r in (("l_quantity", (614, 3481)), ("l_extendedprice", (1228, 2662)), ("l_discount", (1843, 3071))):
            s.dimension(name).filter(r)
            refresh()
        for name in ("l_discount", "l_extendedprice", "l_quantity"):
            s.dimension(name).clear()
            refresh()

    out["chain_3_filters_3_clears"] = best(chain)
    small = Session(from_frame(lines(), dims[2:5]), bins=16)
    cells = histograms.cube(small.encoded, list(small.dims.values())).cache()
    cells.count()
    out["cube_histogram"] = best(lambda: cells.where(filters.within(small.dims["l_tax"], (2, 9))).groupBy("b0").sum("n").collect())
    s.dispose()
    for name in HEADLINE:
        out[name] = best(lambda name=name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    rows = lines().count()
    spark.stop()
    print(json.dumps({"metric": "linked_histograms_total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": sf_dir.rsplit("sf", 1)[-1], "rows": rows}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
