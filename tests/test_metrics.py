from binweave.metrics import measured
from binweave.operators import deltas
from binweave.session import Session
from binweave.sources import generate
from binweave.sources.tables import from_frame


def test_measured(spark, tmp_path):
    generate.uniform(spark, 5000, 2).coalesce(2).write.parquet(str(tmp_path / "t"))
    s = Session(from_frame(spark.read.parquet(str(tmp_path / "t")), ["dim0", "dim1"]), bins=64)
    rows, cost = measured(s.refresh())
    assert sum(r["count"] for r in rows) == 2 * 5000
    assert cost["inputRecords"] == 5000
    assert cost["jobs"] >= 1
    assert 0 < cost["shuffleWriteRecords"] <= 2 * 64 * cost["numTasks"]
    s.dimension("dim0").filter((10, 20))
    change, _ = measured(deltas.changes(s.rows, list(s.dims.values()), s.filters, "dim0", (10, 22)))
    assert sum(r["count"] for r in change if r["dim"] == "dim1") > 0
