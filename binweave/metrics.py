"""What a query cost: Spark's own metrics of the stages that it ran."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Row

#: Of a stage's metrics, those that are added up.
COUNTED = ("inputRecords", "inputBytes", "shuffleReadRecords", "shuffleReadBytes", "shuffleWriteRecords", "shuffleWriteBytes", "memoryBytesSpilled", "executorRunTime", "executorCpuTime", "numTasks")


def measured(df: DataFrame) -> tuple[list[Row], dict[str, float]]:
    """The rows of a DataFrame that fits the driver, and ms, jobs, stages and the sums of COUNTED over them. Stages that reused an earlier shuffle
    aren't counted again."""
    sc = df.sparkSession.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "measured")
    started = time.perf_counter()
    try:
        rows = df.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    out: dict[str, float] = {"ms": (time.perf_counter() - started) * 1000, "jobs": 0, "stages": 0, **dict.fromkeys(COUNTED, 0)}
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    store, tracker = scala.statusStore(), sc.statusTracker()
    for job in tracker.getJobIdsForGroup(group):
        out["jobs"] += 1
        for stage in tracker.getJobInfo(job).stageIds:
            data = store.lastStageAttempt(stage)
            if data.status().toString() == "COMPLETE":
                out["stages"] += 1
                for name in COUNTED:
                    out[name] += getattr(data, name)()
    return rows, out
