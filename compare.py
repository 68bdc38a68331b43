"""Ingest, index, filter and clear of a table of flights, here and by the plain-Python engine of binweave.sandbox: one JSON line a size."""

import json
import sys
import time

from pyspark.sql import SparkSession

from binweave.sandbox import Field, SimpleEngine
from binweave.session import Session
from binweave.sources import generate
from binweave.sources.tables import from_frame

SIZES = (100_000, 200_000, 500_000)
#: Dimensions and their bits, and the range of bins that is filtered.
DIMS, BITS, RANGE = ("delay", "distance", "hour"), 10, (256, 767)


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return round((time.perf_counter() - started) * 1000, 1)


def compare(spark: SparkSession, rows: int) -> dict:
    flights = generate.flights(spark, rows)
    dims = [c for c in DIMS if c in flights.columns] or [f.name for f in flights.schema.fields if f.dataType.typeName() != "string"][:3]
    flights = flights.select(dims).cache()
    flights.count()
    held, out = {}, {"rows": rows, "dims": dims}

    def ingest() -> None:
        held["s"] = Session(from_frame(flights, dims), bins=1 << BITS, cache=True)
        held["s"].refresh("delta")

    out["ingest_ms"] = timed(ingest)
    s = held["s"]
    out["index_ms"] = timed(lambda: s.build_index(dims[0]))
    out["filter_ms"] = timed(lambda: s.dimension(dims[0]).filter(RANGE).session.refresh("delta").collect())
    ours = {(r["dim"], r["bin"]): r["count"] for r in s.refresh("delta").collect()}
    out["clear_ms"] = timed(lambda: s.dimension(dims[0]).clear().session.refresh("delta").collect())
    local = [r.asDict() for r in flights.collect()]

    def plain() -> None:
        held["p"] = SimpleEngine([Field(d, BITS) for d in dims], local)

    out["plain_ingest_ms"] = timed(plain)
    p = held["p"]
    out["plain_filter_ms"] = timed(lambda: p.filter(dims[0], RANGE) or [p.histogram(d) for d in dims])
    theirs = {(d, b): n for d in dims for b, n in enumerate(p.histogram(d)) if n}
    out["plain_clear_ms"] = timed(lambda: p.clear(dims[0]) or [p.histogram(d) for d in dims])
    out["equal"] = ours == theirs
    s.dispose()
    flights.unpersist()
    return out


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[*]").appName("compare").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for size in map(int, sys.argv[1:]) if len(sys.argv) > 1 else SIZES:
        print(json.dumps(compare(spark, size)), flush=True)
    spark.stop()
