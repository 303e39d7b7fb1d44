"""Latency, throughput and what they say about how many requests to run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THINK_SECONDS = (5, 10, 30, 60, 120)


def nearest_rank(rows: DataFrame, by: str = "level", value: str = "seconds") -> DataFrame:
    """by, n, p50, p95 by rank, not interpolated: places n // 2 and max(0, int(0.95 n) - 1) from 0 in ascending order.

    Places come from counts of equal values, added up over the values, so that
    no level's rows are gathered in one array.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("__c"))
    up_to = F.sum("__c").over(Window.partitionBy(by).orderBy(value))
    all_ = F.sum("__c").over(Window.partitionBy(by))
    placed = counts.select(by, F.col(value).alias("__v"), up_to.alias("__u"), all_.alias("n"))
    at = lambda place: F.min(F.when(F.col("__u") > place, F.col("__v")))
    return placed.groupBy(by, "n").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1)).alias("p95"))


def throughput(rows: DataFrame) -> DataFrame:
    """level, n, rate: requests a second of each level, from first start to last end (microseconds us, service seconds)."""
    span = (F.max(F.col("us") + F.round(F.col("seconds") * 1_000_000).cast("long")) - F.min("us")) / 1_000_000.0
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.nullif(span, F.lit(0.0))).alias("rate"))


def running_peak(rates: DataFrame) -> DataFrame:
    return rates.withColumn("peak_so_far", F.max("rate").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))


def recommend(rates: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: the least level that reaches share of the peak rate."""
    peak = rates.agg(F.max("rate").alias("peak"))
    return rates.join(peak, F.col("rate") >= F.col("peak") * share).groupBy("peak").agg(F.min_by(F.struct("level", "rate"), F.col("level")).alias("b")).select(F.col("b.level").alias("level"), F.col("b.rate").alias("rate"), "peak")


def queue_wait(peak: Column, in_flight: int = 64) -> list[Column]:
    """Seconds the last in a full queue waits, whether callers will have given up, and the queue that takes four seconds."""
    wait = in_flight / peak
    return [F.round(wait, 4).alias("wait_seconds"), (wait > 5).alias("too_long"), (peak * 4).cast("int").alias("suggested_in_flight")]


def concurrency(cpus: Column) -> Column:
    return F.least(F.greatest(F.floor(cpus / 4), F.lit(2)), F.lit(32)).cast("int")


def users_table(spark: SparkSession, rates: DataFrame, think=THINK_SECONDS, users: int = 700) -> DataFrame:
    """Every rate with every pause: users one process bears, and processes that many users need, one at least."""
    pauses = spark.createDataFrame([(t,) for t in think], "think int")
    need = F.greatest(F.lit(1), F.ceil(F.lit(float(users)) / F.col("think") / F.col("rate")).cast("int"))
    return rates.crossJoin(pauses).select("level", "think", F.round(F.col("rate") * F.col("think"), 4).alias("users_borne"), need.alias("processes"))


def in_flight(rows: DataFrame) -> DataFrame:
    """event_id, in_flight: requests under way right after each starts, by level, ends before starts at the same moment."""
    ends = rows.select("level", (F.col("us") + F.round(F.col("seconds") * 1_000_000).cast("long")).alias("at"), F.lit(-1).alias("d"), "event_id")
    starts = rows.select("level", F.col("us").alias("at"), F.lit(1).alias("d"), "event_id")
    w = Window.partitionBy("level").orderBy("at", "d", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(ends).withColumn("in_flight", F.sum("d").over(w)).where("d = 1").select("event_id", "level", "in_flight")


def admission(rows: DataFrame, limit: int) -> DataFrame:
    """status of each request: 413 over 32 MiB, 503 for a full house, else 200."""
    return rows.withColumn("status", F.when(F.col("content_length") > 32 * 1024 * 1024, 413).when((F.col("method") == "POST") & (F.col("in_flight") >= limit), 503).otherwise(200))


def stage_shares(rows: DataFrame) -> DataFrame:
    """One row: medians of decode, segment and total, the rest clamped at 0, and each one's share."""
    m = rows.agg(F.median("decode").alias("decode"), F.median("segment").alias("segment"), F.median("total").alias("total"))
    m = m.withColumn("rest", F.greatest(F.col("total") - F.col("decode") - F.col("segment"), F.lit(0.0)))
    return m.select(*[F.round(c, 6).alias(c) for c in ("decode", "segment", "rest", "total")], *[F.round(F.col(c) / F.col("total"), 4).alias(f"{c}_share") for c in ("decode", "segment", "rest")])
