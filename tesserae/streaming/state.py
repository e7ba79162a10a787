"""Stateful operators over streams of connection events, and their batch forms.

A stream's state machine is one Python processor, keyed by peer; events of a micro-batch are sorted
before they are applied, so a replay with availableNow equals the fold over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators.aggregates import sighted, upsert
from tesserae.session import removed, shared_path

#: What a peer is taken to announce until it does.
DEFAULT_THRESHOLD = 1_350_000


def apply_event(state: tuple[int, int, int], kind: str, amount: int, limit: int) -> tuple[tuple[int, int, int], bool | None]:
    """(balance, reserved, refused) after an event, and for a reservation whether it was admitted.

    reserve: admitted while balance, reserved and amount are within limit; apply: a reservation
    becomes debt; release: it is given back; credit: debt is paid. Nothing falls below 0.
    """
    balance, reserved, refused = state
    if kind == "reserve":
        if balance + reserved + amount <= limit:
            return (balance, reserved + amount, refused), True
        return (balance, reserved, refused + 1), False
    if kind == "apply":
        return (balance + amount, max(0, reserved - amount), refused), None
    if kind == "release":
        return (balance, max(0, reserved - amount), refused), None
    if kind == "credit":
        return (max(0, balance - amount), reserved, refused), None
    raise ValueError(f"no such event: {kind}")


def accounts(events: DataFrame, limit: int) -> DataFrame:
    """R3/R4 over (peer, seq, kind, amount): the state of each peer after its last event. Works on tables and on streams (update mode)."""
    schema, kept = "peer long, balance long, reserved long, refused long, events long", "balance long, reserved long, refused long, events long"

    def fold(rows: list[tuple], state: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        *now, n = state
        for _, kind, amount in sorted(rows):
            now, _ = apply_event(tuple(now), kind, int(amount), limit)
            n += 1
        return (*now, n)

    def batch(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([(int(key[0]), *fold(list(zip(pdf.seq, pdf.kind, pdf.amount, strict=True)), (0, 0, 0, 0)))], columns=["peer", "balance", "reserved", "refused", "events"])

    def stream(key, pdfs, state: GroupState) -> Iterator:  # noqa: ANN001
        import pandas as pd

        rows = [r for pdf in pdfs for r in zip(pdf.seq, pdf.kind, pdf.amount, strict=True)]
        now = fold(rows, tuple(state.get) if state.exists else (0, 0, 0, 0))
        state.update(tuple(int(x) for x in now))
        yield pd.DataFrame([(int(key[0]), *now)], columns=["peer", "balance", "reserved", "refused", "events"])

    use = events.select("peer", "seq", "kind", "amount")
    if events.isStreaming:
        return use.groupBy("peer").applyInPandasWithState(stream, schema, kept, "update", GroupStateTimeout.NoTimeout)
    return use.groupBy("peer").applyInPandas(batch, schema)


def latest_threshold(events: DataFrame) -> DataFrame:
    """R2: the value that each peer announced last (seq decides), the default where it announced none. The same on tables and on streams (complete mode)."""
    last = F.max_by("threshold", F.when(F.col("threshold").isNotNull(), F.col("seq")))
    return events.groupBy("peer").agg(F.coalesce(last, F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def delayed_credit(events: DataFrame, now_ms: Column, delay_ms: int = 2500) -> DataFrame:
    """What of each peer's payments counts by now: those older than the delay."""
    due = F.col("at_ms") + delay_ms <= now_ms
    return events.groupBy("peer").agg(F.coalesce(F.sum(F.when(due, F.col("amount"))), F.lit(0)).alias("credited"), F.coalesce(F.sum(F.when(~due, F.col("amount"))), F.lit(0)).alias("pending"))


def merged_stream(spark: SparkSession, sightings_dir: str, schema: str, files_per_trigger: int = 1) -> str:
    """Streams sightings from Parquet files into a merged table; returns where that is.

    Each micro-batch is merged with the table of the one before (aggregates.sighted: a row per overlay
    and address, however many sightings there were) and written as a version of its own, so a batch that
    is run again writes the same version; the checkpoint resumes after a stop. Versions that no batch can
    need again are deleted. A stream without a file leaves an empty table.
    """
    to = shared_path(spark, "merged")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(sightings_dir)
    written: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        new, before = sighted(batch), [k for k in written if k < number]
        if before:
            new = sighted(batch.sparkSession.read.parquet(f"{to}/{before[-1]}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{to}/{number}")
        removed(spark, *(f"{to}/{k}" for k in before[:-1]))
        written[:] = [*before[-1:], number]

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", shared_path(spark, "merged-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        merge(spark.createDataFrame([], schema), 0)
    return f"{to}/{written[-1]}"


def merged_nodes(spark: SparkSession, path: str) -> DataFrame:
    return upsert(spark.read.parquet(path))
