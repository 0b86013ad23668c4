"""CPU samples of a stream in time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.plans.cpu import BUCKET_US, TOP_FUNCTIONS


def _busiest(seen: Column) -> Column:
    """The functions seen most often, the earlier first among equals, with their counts."""

    def counted(name: Column) -> Column:
        own = F.filter(seen, lambda s: s["functionName"].eqNullSafe(name))
        first = F.array_min(F.transform(own, lambda s: F.struct(s["chunk"].alias("chunk"), s["pos"].alias("pos"))))
        return F.struct((-F.size(own)).alias("fewer"), first.alias("first"), name.alias("functionName"))

    names = F.array_distinct(F.transform(seen, lambda s: s["functionName"]))
    ranked = F.slice(F.array_sort(F.transform(names, counted)), 1, TOP_FUNCTIONS)
    return F.transform(
        ranked, lambda r: F.struct(r["functionName"].alias("functionName"), (-r["fewer"]).cast("bigint").alias("count"))
    )


def cpu_timeline_stream(samples: DataFrame, bucket_us: int = BUCKET_US, delay: str = "1 minute") -> DataFrame:
    """``devtools.views.cpuTimeline`` over a stream of samples, for append mode.

    A bucket is given once the watermark, ``delay`` behind the latest sample, has passed its end;
    samples that come later than that are left out.  A bucket's state holds its samples' names
    and places, a few for each thread in 5 ms.  On a batch frame it gives the batch table.
    """
    at = F.timestamp_micros(F.floor("tsUs").cast("bigint"))
    buckets = (
        samples.withColumn("_at", at)
        .withWatermark("_at", delay)
        .groupBy("trace_id", F.window("_at", f"{bucket_us} microseconds").alias("_window"))
        .agg(
            F.count(F.lit(1)).alias("sampleCount"),
            (F.sum("timeDeltaUs") / 1000).alias("totalTimeMs"),
            F.collect_list(F.struct("functionName", "chunk", "pos")).alias("_seen"),
        )
    )
    start = F.unix_micros("_window.start")
    return buckets.select(
        "trace_id",
        F.concat(F.lit("cpu-bucket:"), F.expr(f"unix_micros(_window.start) div {bucket_us}").cast("string")).alias("bucketId"),
        start.alias("startTsUs"),
        (start + bucket_us).alias("endTsUs"),
        "sampleCount",
        "totalTimeMs",
        _busiest(F.col("_seen")).alias("topFunctions"),
    )
