"""Where records are kept: appended history, partitioned by job and day, and generated inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import sanitise_name


def append(records: DataFrame, folder: str, job: str = "job", bucket: str = "bucket") -> None:
    out = records.withColumn("job_name", sanitise_name(job)).withColumn("day", F.to_date(F.timestamp_seconds(bucket)))
    out.write.mode("append").partitionBy("job_name", "day").parquet(folder)


def query(spark: SparkSession, folder: str, job: str, start: int, stop: int, bucket: str = "bucket") -> DataFrame:
    """Records of [start, stop]; the day's partitions are pruned before any file is read."""
    h = spark.read.parquet(folder).filter(F.col("job_name") == sanitise_name(F.lit(job)))
    days = F.col("day").between(F.to_date(F.timestamp_seconds(F.lit(start))), F.to_date(F.timestamp_seconds(F.lit(stop))))
    return h.filter(days & F.col(bucket).between(start, stop))


def spikes(spark: SparkSession, n: int, at: list[int], times: float) -> DataFrame:
    """One-minute points of two sines around 100, multiplied at the given places: (bucket, idx, v, label)."""
    i = F.col("id")
    v = 100 + 6 * F.sin(0.9 * i) + 3 * F.sin(0.37 * i)
    hit = i.isin(*at)
    return spark.range(n).select((i * 60).alias("bucket"), i.alias("idx"), F.when(hit, v * times).otherwise(v).alias("v"), hit.alias("label"))


def daily_cycle(spark: SparkSession, n: int, span_s: int, times: float = 1.0) -> DataFrame:
    i = F.col("id")
    phase = F.pmod(i * span_s, F.lit(86400)) / 86400 * 2 * math.pi
    return spark.range(n).select((i * span_s).alias("bucket"), ((100 + 40 * F.sin(phase) + 5 * F.sin(0.7 * i)) * times).alias("value"))
