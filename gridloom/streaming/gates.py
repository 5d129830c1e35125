"""Readiness gates for batches whose vector input is still being written, and windowed run statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def await_marker(spark: SparkSession, path: str, wait_s: float, poll_s: float = 0.25) -> None:
    """Returns once a marker file is there; an error when the wait runs out. Asks the path's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    end = time.monotonic() + wait_s
    while not fs.exists(where):
        if time.monotonic() >= end:
            raise TimeoutError(f"no marker at {path} after {wait_s:g} s")
        time.sleep(poll_s)


def throttles_per_second(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(run, second, throttled) by tumbling seconds of event time; an addition for streams, batches work alike.

    events: run, ts and kind. Rows later than `late` behind the newest are dropped by the watermark of a stream.
    """
    hits = F.count_if(F.col("kind").isin("http_429", "http_503"))
    return events.withWatermark("ts", late).groupBy("run", F.window("ts", "1 second").alias("w")).agg(hits.alias("throttled")).select("run", F.col("w.start").alias("second"), "throttled")
