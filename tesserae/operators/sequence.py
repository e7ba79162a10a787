"""Operators over ordered samples: sliding sums, stalls, changes, plateaus, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_sum(df: DataFrame, key: str, at_ms: str, value: str, window_ms: int) -> DataFrame:
    """The sum of values no older than ``window_ms``; a value of exactly that age counts."""
    w = Window.partitionBy(key).orderBy(at_ms).rangeBetween(-window_ms, 0)
    return df.withColumn("unvalidated", F.sum(value).over(w))


def sliding_sum_own_window(df: DataFrame, key: str, at_ms: str, value: str, window_ms: str) -> DataFrame:
    """W4 where each row has a window of its own: running sums, and the sum up to where the window begins is found by merging both orders.

    Events and window starts are one sequence per key; a running sum over it gives both ends, so no row meets another row of its key.
    """
    own = df.withColumn("__id", F.struct(*[F.col(c) for c in df.columns]))
    ends = own.select(key, F.col(at_ms).alias("__t"), F.lit(2).alias("__o"), F.col(value).alias("__v"), "__id")
    # what is older than at - window: strictly before its start
    starts = own.select(key, (F.col(at_ms) - F.col(window_ms)).alias("__t"), F.lit(1).alias("__o"), F.lit(0).alias("__v"), "__id")
    run = ends.union(starts).withColumn("__s", F.sum("__v").over(Window.partitionBy(key).orderBy("__t", "__o")))
    both = run.groupBy(key, "__id").agg((F.max(F.when(F.col("__o") == 2, F.col("__s"))) - F.max(F.when(F.col("__o") == 1, F.col("__s")))).alias("unvalidated"))
    return both.select("__id.*", "unvalidated")


def stalls(samples: DataFrame, key: str, at_s: str, total: str, least_new: int = 20, grace_s: int = 90) -> DataFrame:
    """Progress against two samples before, and the first sample of each key that is a stall."""
    w = Window.partitionBy(key).orderBy(at_s)
    new = F.col(total) - F.coalesce(F.lag(total, 2).over(w), F.lit(0))
    out = samples.withColumn("progress", new).withColumn("stalled", (F.col(at_s) >= grace_s) & (F.col("progress") < least_new))
    first = F.sum(F.col("stalled").cast("int")).over(w)
    return out.withColumn("fires", F.col("stalled") & (first == 1))


def changes(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't the one before, with that."""
    w = Window.partitionBy(key).orderBy(*order)
    return samples.withColumn("prev", F.lag(value).over(w)).where(F.col("prev").isNotNull() & (F.col("prev") != F.col(value)))


def plateau(samples: DataFrame, key: str, at_s: str, value: str, least_s: int = 300, quiet_s: int = 240) -> DataFrame:
    """Whether a value has settled: ``least_s`` in, and no change for ``quiet_s``."""
    w = Window.partitionBy(key).orderBy(at_s)
    changed = F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))
    marked = samples.withColumn("__c", F.when(changed, F.col(at_s)))
    since = F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("plateau", (F.col(at_s) >= least_s) & (F.col(at_s) - since >= quiet_s)).drop("__c")


def double_zero(probes: DataFrame, key: str, order: list[str], accepted: str, at_ms: str) -> DataFrame:
    """Per key the time of the first of two acknowledgements in a row that accepted nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    hit = (F.col(accepted) == 0) & (F.lead(accepted).over(w) == 0)
    return probes.withColumn("__hit", hit).where("__hit").groupBy(key).agg(F.min(at_ms).alias("lambda_ms"))


def rate_samples(events: DataFrame, ts: str, seconds: int = 30, start: str | None = None, chunk: int = 4096) -> DataFrame:
    """Chunks and MB/s in tumbling windows. Windows are aligned to the epoch plus ``start``, not to the sample before."""
    w = F.window(ts, f"{seconds} seconds", startTime=start) if start else F.window(ts, f"{seconds} seconds")
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("chunks"))
    return out.select(F.col("w.start").alias("start"), "chunks", (F.col("chunks") * chunk / 1e6 / seconds).alias("mb_s"))


def running(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A cumulative counter per key."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def error_streaks(df: DataFrame, key: str, order: list[str], failed: str, least: int = 20) -> DataFrame:
    """Runs of at least ``least`` failures in a row per key (islands between successes)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("island", island).where(F.col(failed)).groupBy(key, "island").agg(F.count("*").alias("streak"))
    return runs.where(F.col("streak") >= least).select(key, "streak")
