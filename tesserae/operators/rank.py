"""Ranking, stratified sampling and bounded lists. Every order ends in an id, so that ties have one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.address import first_dialable, neighborhood
from tesserae.functions.scalars import effective_rate, lambda_class
from tesserae.operators.joins import with_state, with_work


def candidates(nodes: DataFrame, chunks: DataFrame, state: DataFrame, depth: int, key: str = "overlay") -> DataFrame:
    """Nodes with work and a public address, ranked in their bucket by rate, lambda class, threshold and round trip."""
    have = with_state(with_work(nodes, chunks, depth), state, key)
    have = have.withColumn("address", first_dialable("underlays")).where("address is not null")
    have = have.withColumn("rate", effective_rate(F.col("service_x10"))).withColumn("class", lambda_class(F.col("lambda_ms")))
    order = Window.partitionBy("prefix").orderBy(F.desc("rate"), "class", F.desc("threshold_last"), F.col("rtt_ms").asc_nulls_last(), "overlay")
    return have.withColumn("rank", F.row_number().over(order))


def round_robin(df: DataFrame, address: str, depth: int, n: int, order: str) -> DataFrame:
    """N rows, taken one from each neighbourhood in turn, ascending."""
    w = Window.partitionBy("prefix").orderBy(order)
    turn = df.withColumn("prefix", neighborhood(address, depth)).withColumn("turn", F.row_number().over(w))
    return turn.where(F.col("turn") <= n).orderBy("turn", "prefix").limit(n)


def criticality(buckets: DataFrame) -> DataFrame:
    """Buckets (prefix, remaining, rate, active) with how badly each needs a connection; one without any rate comes before all others."""
    crit = F.when(F.col("rate") == 0, (1 << 62) + F.col("remaining")).otherwise(F.floor(F.col("remaining") * 10_000 / F.col("rate")))
    ready = F.col("remaining") > 0
    served = (F.col("remaining") < 30) & (F.col("active") > 0)
    return buckets.where(ready & ~served).withColumn("criticality", crit.cast("bigint"))


def most_critical(buckets: DataFrame) -> DataFrame:
    """The bucket to serve next."""
    return criticality(buckets).orderBy(F.desc("criticality"), "prefix").limit(1)


def recyclable(members: DataFrame) -> DataFrame:
    """buckets that may try their used nodes again."""
    return members.where((F.col("unused") == 0) & (F.col("active") == 0) & (F.col("remaining") >= 30) & (F.col("recycles") < 3))


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def first_errors(df: DataFrame, by: str, message: str, order: str, keep: int = 20) -> DataFrame:
    """The first errors of each group, at most ``keep``; the rank is taken before anything is gathered."""
    w = Window.partitionBy(by).orderBy(order)
    few = df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= keep)
    return few.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", message))), lambda x: x[message]).alias("errors"))


def slices(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Contiguous slices of n div parts rows (1 at least); rows beyond parts slices are in none."""
    n = df.count()
    size = max(1, n // parts)
    # numbered over ranges: a count per range first, so that no task sees all rows
    ranged = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    from tesserae.session import settled

    ranged = settled(ranged)
    before = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    out = ranged.withColumn("__at", at).join(before, "__part").withColumn("slice", F.floor((F.col("before") + F.col("__at")) / size).cast("int"))
    return out.where(F.col("slice") < parts).drop("__part", "__at", "before")


def order_by_overlay(df: DataFrame, *cols: Column | str) -> DataFrame:
    """O1-O3."""
    return df.orderBy(*cols, "overlay")
