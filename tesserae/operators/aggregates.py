"""Coverage, histograms, merges by key and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.address import MAX_PO, neighborhood, proximity
from tesserae.functions.scalars import ewma_half, minus, percentile_at


def coverage(chunks: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """A1: chunks and neighbourhoods, in all and covered. Chunks are counted per neighbourhood first, so the join is between prefixes."""
    need = chunks.groupBy(neighborhood("address", depth).alias("prefix")).agg(F.count("*").alias("n"))
    have = nodes.select(neighborhood("overlay", depth).alias("prefix")).distinct().withColumn("hit", F.lit(1))
    joined = need.join(have, "prefix", "left")
    hit = F.col("hit").isNotNull()
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_total"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("chunks_covered"),
        F.count("*").alias("neighborhoods_total"),
        F.count_if(hit).alias("neighborhoods_covered"),
    )


def bin_counts(nodes: DataFrame, reference: str) -> DataFrame:
    """A2: how many nodes stand at each proximity of a reference, zeros included."""
    bins = nodes.sparkSession.range(MAX_PO + 1).select(F.col("id").cast("int").alias("po"))
    n = nodes.groupBy(proximity(F.col("overlay"), F.lit(reference)).alias("po")).agg(F.count("*").alias("n"))
    return bins.join(n, "po", "left").select("po", F.coalesce("n", F.lit(0)).alias("nodes"))


def per_bucket(df: DataFrame, address: str, depth: int) -> DataFrame:
    """A3."""
    return df.groupBy(neighborhood(address, depth).alias("prefix")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, by: list[str], qs: tuple[int, ...] = (50, 95)) -> DataFrame:
    """A5: values at index n * q div 100 of each group's sorted values, by a count per different value.

    Counting per value first is what keeps a group with very many rows from being one list.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    seen = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))

    def at(q: int) -> Column:
        k = F.least(F.floor(F.col("total") * q / 100), F.col("total") - 1)
        return F.min(F.when(F.col("upto") > k, F.col(value))).alias(f"p{q}")

    return seen.groupBy(*by).agg(*[at(q) for q in qs], F.max("total").alias("n"))


def latest(df: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` of each key; of equal blocks the later log entry wins."""
    row = F.max_by(F.struct(*value), F.struct(*order)).alias("row")
    return df.groupBy(key).agg(row).select(key, "row.*")


def sighted(sightings: DataFrame) -> DataFrame:
    """What A8 needs of sightings, one row per overlay and address; rows of this form and plain sightings merge into this form again."""
    if "rtt_seq" not in sightings.columns:
        sightings = sightings.withColumn("rtt_seq", F.when(F.col("rtt_ms").isNotNull(), F.col("seq")))
    return sightings.groupBy("overlay", "underlay").agg(
        F.min("seq").alias("seq"),
        F.max("tick").alias("tick"),
        F.bool_or("dialed_ok").alias("dialed_ok"),
        F.max_by("rtt_ms", "rtt_seq").alias("rtt_ms"),
        F.max("rtt_seq").alias("rtt_seq"),
    )


def upsert(sightings: DataFrame) -> DataFrame:
    """One record per overlay: latest tick, dialled if ever, last known round trip, addresses in order of first sight."""
    return sighted(sightings).groupBy("overlay").agg(
        F.max("tick").alias("tick"),
        F.bool_or("dialed_ok").alias("dialed_ok"),
        F.max_by("rtt_ms", "rtt_seq").alias("rtt_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "underlay"))), lambda x: x["underlay"]).alias("underlays"),
    )


def ledger_merge(entries: DataFrame) -> DataFrame:
    """The largest amount per beneficiary. Amounts are decimal strings of up to 78 digits.

    A maximum of strings makes Spark sort all rows. So first, by hashing, the largest number of
    digits with the first 36 of them is taken for each ending beyond these (trailing zeros apart,
    few amounts have one); texts are compared among what is left.
    """
    digits = F.ltrim(F.col("amount"), F.lit("0"))
    entries = entries.select(
        F.lower("beneficiary").alias("beneficiary"),
        F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 1, 36), 36, "0")).cast("decimal(38,0)").alias("most"),
        F.rtrim(F.substring(digits, 37, 78), F.lit("0")).alias("ending"),
    )
    few = entries.groupBy("beneficiary", "ending").agg(F.max("most").alias("most"))
    head = F.lpad(F.col("most").cast("string"), 38, "0")
    amount = F.rpad(F.concat(F.substring(head, 3, 36), "ending"), F.substring(head, 1, 2).cast("int"), F.lit("0"))
    out = few.groupBy("beneficiary").agg(F.ltrim(F.max(F.lpad(amount, 78, "0")), F.lit("0")).alias("amount"))
    return out.withColumn("amount", F.when(F.col("amount") == "", "0").otherwise(F.col("amount")))


def peer_state(observations: DataFrame) -> DataFrame:
    """A10: what is remembered of each peer after all its observations in order."""
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    rates = F.transform(F.array_sort(F.collect_list(F.when(F.col("service_x10") > 0, F.struct("ts", "event_id", "service_x10")))), lambda x: x["service_x10"])
    return observations.groupBy("peer").agg(
        F.max("threshold").alias("threshold_last"),
        last("lambda_ms").alias("lambda_ms"),
        F.sum("settled_units").alias("settled_units"),
        F.coalesce(last("surplus"), F.lit(0)).alias("surplus_units"),
        ewma_half(rates).alias("service_x10"),
        F.coalesce(F.max_by("at", F.when(F.col("clean"), at)), F.lit(0)).alias("last_ok_unix"),
    )


def run_totals(runs: DataFrame, needed: Column, dropped: Column) -> DataFrame:
    """Sums over connections, and what failed: needed less what came and what was dropped, never below 0."""
    out = runs.agg(F.sum("bytes").alias("bytes"), F.sum("chunks_ok").alias("ok"), F.sum("chunks_err").alias("err"), F.sum("units").alias("units"), F.count("*").alias("connections"))
    return out.withColumn("failed", minus(minus(needed.cast("bigint"), F.col("ok")), dropped.cast("bigint")))


def deltas(snapshots: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """A cumulative counter's growth over each key's snapshots."""
    first, last = F.min_by(counter, F.struct(*order)), F.max_by(counter, F.struct(*order))
    return snapshots.groupBy(key).agg((last - first).alias("delta"))


def speeds(runs: DataFrame) -> DataFrame:
    """All bytes over the longest wall clock, beside the sum of each peer's own rate."""
    each = runs.groupBy("peer").agg(F.sum("bytes").alias("bytes"), F.sum("wall_s").alias("wall_s"))
    return each.agg(
        (F.sum("bytes") / 1e6 / F.max("wall_s")).alias("mb_s_wall"), F.sum(F.col("bytes") / 1e6 / F.col("wall_s")).alias("mb_s_sum"), F.count("*").alias("peers")
    )


def latency_list_percentile(values: Column, q: int) -> Column:
    """A5 over an array column."""
    return percentile_at(values, q)
