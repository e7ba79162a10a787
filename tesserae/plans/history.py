"""Queries over observations, measured runs, ledgers and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import aggregates, rank, sequence
from tesserae.plans.registry import query
from tesserae.sources import domain as D
from tesserae.sources.domain import with_
from tesserae.streaming import state

_R = with_("runs")


def _at(values: str, q: int) -> str:
    return f"list_sort(list({values}))[least(count({values}) * {q} // 100, count({values}) - 1) + 1]"


@query(_R + f"select peer, {_at('wall_s', 50)} as p50, {_at('wall_s', 95)} as p95, count(*) as n from runs group by peer")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return aggregates.percentiles(D.runs(spark, sf_dir), "wall_s", ["peer"])


@query(_R + f"select depth, {_at('wall_s', 50)} as p50, count(*) as runs from runs where stop_reason <> 'dial_failed' and chunks_ok > 0 group by depth")
def rate_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 with F11; the literal 'dial_failed' matches no 'dial_failed: ...', so only chunks_ok decides."""
    ok = D.runs(spark, sf_dir).where((F.col("stop_reason") != "dial_failed") & (F.col("chunks_ok") > 0))
    return aggregates.percentiles(ok, "wall_s", ["depth"], (50,)).select("depth", "p50", F.col("n").alias("runs"))


@query(
    _R
    + """select cast(sum(bytes) as bigint) as bytes, cast(sum(chunks_ok) as bigint) as ok, cast(sum(chunks_err) as bigint) as err, cast(sum(units) as bigint) as units, count(*) as connections,
    cast(greatest(0, greatest(0, 5000000 - sum(chunks_ok)) - 17) as bigint) as failed from runs"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11/A18."""
    return aggregates.run_totals(D.runs(spark, sf_dir), F.lit(5_000_000), F.lit(17))


@query(
    _R
    + """select stop_reason as phase, cast(sum(chunks_ok) as bigint) as ok, cast(sum(chunks_err) as bigint) as err, cast(sum(bytes) as bigint) as bytes, round(sum(bytes) / 1e6 / sum(wall_s), 6) as mb_s from runs group by 1"""
)
def phase_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 with P11."""
    g = D.runs(spark, sf_dir).groupBy(F.col("stop_reason").alias("phase"))
    out = g.agg(F.sum("chunks_ok").alias("ok"), F.sum("chunks_err").alias("err"), F.sum("bytes").alias("bytes"), F.sum("wall_s").alias("s"))
    return out.withColumn("mb_s", F.round(S.mb_per_s(F.col("bytes"), F.col("s")), 6)).drop("s")


@query(
    _R
    + """, e as (select peer, sum(bytes) as b, sum(wall_s) as s from runs group by peer) select round(sum(b) / 1e6 / max(s), 6) as mb_s_wall, round(sum(b / 1e6 / s), 6) as mb_s_sum, count(*) as peers from e"""
)
def aggregate_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    out = aggregates.speeds(D.runs(spark, sf_dir))
    return out.select(F.round("mb_s_wall", 6).alias("mb_s_wall"), F.round("mb_s_sum", 6).alias("mb_s_sum"), "peers")


@query(
    _R
    + f"""select count(*) as attempts, count(*) filter (where chunks_ok > 0) as reached, round(count(*) filter (where chunks_ok > 0) * 100.0 / count(*), 6) as percent,
    (select {_at("wall_s", 50)} from runs where chunks_ok > 0) as median_s, round(sum(bytes) / greatest(count(distinct peer), 1), 3) as bytes_per_peer from runs"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 with F3 and P12."""
    r = D.runs(spark, sf_dir)
    reached = F.count_if(F.col("chunks_ok") > 0)
    mid = aggregates.percentiles(r.where("chunks_ok > 0"), "wall_s", [], (50,)).select(F.col("p50").alias("median_s"))
    out = r.agg(
        F.count("*").alias("attempts"), reached.alias("reached"), F.round(S.percent(reached, F.count("*")), 6).alias("percent"),
        F.round(S.per_connection(F.sum("bytes"), F.count_distinct("peer")), 3).alias("bytes_per_peer"),
    )
    return out.join(mid)


@query(
    """select o_custkey as owner, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as stake, max(o_orderkey) filter (where (o_orderdate, o_orderkey) = m) as version from
    (select *, max((o_orderdate, o_orderkey)) over (partition by o_custkey) as m from orders) group by 1 having arg_max(o_totalprice, (o_orderdate, o_orderkey)) > 1000"""
)
def stake_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with F4."""
    o = D.table(spark, sf_dir, "orders")
    out = aggregates.latest(o, "o_custkey", ["o_totalprice", "o_orderkey"], ["o_orderdate", "o_orderkey"])
    return out.select(F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("stake"), F.col("o_orderkey").alias("version")).where("stake > 1000")


_UPSERT = """select s.overlay, s.tick, s.dialed_ok, s.rtt_ms, l.underlays from
    (select overlay, max(tick) as tick, bool_or(dialed_ok) as dialed_ok, arg_max(rtt_ms, seq) filter (where rtt_ms is not null) as rtt_ms from sightings group by 1) s
    join (select overlay, string_agg(underlay, '|' order by seq) as underlays from (select overlay, underlay, min(seq) as seq from sightings group by 1, 2) group by 1) l using (overlay)"""


@query(with_("sightings") + _UPSERT)
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8/U1/U3."""
    out = aggregates.upsert(D.sightings(spark, sf_dir))
    return out.withColumn("underlays", F.array_join("underlays", "|"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a base and two journals; amounts of up to 31 digits."""
    li = D.table(spark, sf_dir, "lineitem")
    who = F.substring(F.sha2(F.col("l_suppkey").cast("string"), 256), 1, 40)
    return li.select(F.when(F.col("l_linenumber") % 2 == 0, F.upper(who)).otherwise(who).alias("beneficiary"), F.concat(F.col("l_orderkey").cast("string"), F.lit("0" * 24)).alias("amount"))


@query("select substr(sha256(l_suppkey::varchar), 1, 40) as beneficiary, cast(max(l_orderkey) as varchar) || repeat('0', 24) as amount from lineitem group by 1")
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9/U4."""
    return aggregates.ledger_merge(_ledger(spark, sf_dir))


@query(
    with_("observations")
    + """select peer, max(threshold) as threshold_last, arg_max(lambda_ms, (ts, event_id)) filter (where lambda_ms is not null) as lambda_ms, cast(sum(settled_units) as bigint) as settled_units,
    coalesce(arg_max(surplus, (ts, event_id)) filter (where surplus is not null), 0) as surplus_units,
    coalesce(list_reduce(list_prepend(0::bigint, list(service_x10 order by ts, event_id) filter (where service_x10 > 0)), lambda a, x: case when a = 0 then x else (a + x) // 2 end), 0) as service_x10,
    coalesce(arg_max("at", (ts, event_id)) filter (where clean), 0) as last_ok_unix from observations group by peer"""
)
def peer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10/E1/R8."""
    return aggregates.peer_state(D.observations(spark, sf_dir))


@query(with_("observations") + "select cast(coalesce(max(lambda_ms), 3000) as bigint) as lambda_ms, cast(coalesce(max(lambda_ms) filter (where peer < 0), 3000) as bigint) as of_none from observations")
def longest_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    most = lambda c: F.coalesce(F.max(c), F.lit(S.DEFAULT_LAMBDA_MS)).cast("bigint")
    return D.observations(spark, sf_dir).agg(most("lambda_ms").alias("lambda_ms"), most(F.when(F.col("peer") < 0, F.col("lambda_ms"))).alias("of_none"))


_SUMS = "select peer, ts, event_id, sum(settled_units) over (partition by peer order by ts, event_id rows unbounded preceding) as total from observations"


@query(with_("observations") + f", t as ({_SUMS}) select peer, cast(arg_max(total, (ts, event_id)) - arg_min(total, (ts, event_id)) as bigint) as delta from t group by peer")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over W10."""
    snaps = sequence.running(D.observations(spark, sf_dir), "peer", ["ts", "event_id"], "settled_units")
    return aggregates.deltas(snaps, "peer", ["ts", "event_id"], "running")


@query(
    with_("observations")
    + """select event_id, lambda_ms, case when lambda_ms is null then 1 when lambda_ms <= 2500 then 0 else 2 end as class, coalesce(nullif(service_x10, 0), 140) as rate,
    least(greatest(coalesce(lambda_ms, 3000), 800), 25000) * 3 // 2 as window_ms, greatest(0, threshold - 1350000) // 450000 as upgrades,
    case when service_x10 >= 5 and settled_units >= 50 * 10000 then cast(floor(settled_units / 10000 / service_x10 * 10) as bigint) end as realised,
    cast(settled_units as decimal(20,0)) * 100000 + 100 as cheque, settled_units + 0 + 10000 <= greatest(0, threshold * 105 // 100 - 10) as admitted,
    (settled_units + 500) * 100 > 5000000 * 92 as over_cap, case when settled_units + least(700 * 10000, 250 * 10000) > threshold + 10 * 10000 then greatest(0, settled_units + 250 * 10000 - threshold) end as prepay,
    cast(case when event_id % 3 = 0 then settled_units when event_id % 3 = 1 then case when event_id % 5000 >= 3000 then least(settled_units, threshold // 4) else 0 end
        when settled_units * 5 >= threshold and event_id % 5000 >= 500 then settled_units else 0 end as bigint) as due from observations"""
)
def scalar_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P14-P18, F6, F7, R5, R6."""
    c = F.col
    big = lambda n: F.lit(n).cast("bigint")
    return D.observations(spark, sf_dir).select(
        "event_id",
        "lambda_ms",
        S.lambda_class(c("lambda_ms")).alias("class"),
        S.effective_rate(c("service_x10")).alias("rate"),
        S.exposure_window(c("lambda_ms")).alias("window_ms"),
        S.upgrades(big(1_350_000), c("threshold")).alias("upgrades"),
        S.service_rate_x10(c("settled_units"), big(10_000), c("service_x10")).alias("realised"),
        S.cheque_amount(c("settled_units"), big(100_000), big(100)).alias("cheque"),
        S.exposure_ok(c("settled_units"), big(0), big(10_000), big(0), c("threshold"), big(10)).alias("admitted"),
        S.spend_projected(c("settled_units"), big(500), big(5_000_000)).alias("over_cap"),
        S.prepay_amount(c("settled_units"), big(700), big(10_000), c("threshold")).alias("prepay"),
        S.cheque_due(c("settled_units"), c("threshold"), c("event_id") % 5000, c("event_id") % 3 == 0, c("event_id") % 3 == 1).alias("due"),
    )


@query(
    """select l_orderkey, l_linenumber, round(l_quantity * 4096 / 1e6 / nullif(l_linenumber - 1, 0), 9) as mb_s, cast(l_orderkey as double) / 1e16 as coins,
    cast(l_linenumber as decimal(38,0)) * 10000000000000000 + 2500000000000000 as base_units from lineitem"""
)
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P13; a rate over no time is shown as NULL here."""
    li = D.table(spark, sf_dir, "lineitem")
    s = F.col("l_linenumber") - 1
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(s > 0, F.round(S.mb_per_s(F.col("l_quantity") * 4096, s), 9)).alias("mb_s"),
        S.to_coins(F.col("l_orderkey")).alias("coins"),
        S.from_coins(F.concat(F.col("l_linenumber").cast("string"), F.lit(".25"))).alias("base_units"),
    )


_MS = "select *, cast((epoch_us(ts) // 1000) as bigint) as at_ms from observations"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observations(spark, sf_dir).withColumn("at_ms", D.epoch_ms(F.col("ts")))


@query(with_("observations") + f", m as ({_MS}) select event_id, cast(sum(settled_units) over (partition by peer order by at_ms range between 600000 preceding and current row) as bigint) as unvalidated from m")
def sliding_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 with one window length."""
    return sequence.sliding_sum(_timed(spark, sf_dir), "peer", "at_ms", "settled_units", 600_000).select("event_id", "unvalidated")


@query(
    with_("observations")
    + f", m as (select *, (coalesce(lambda_ms, 3000)) * 1000 as w from ({_MS})) select a.event_id, cast(sum(b.settled_units) as bigint) as unvalidated from m a join m b on a.peer = b.peer and b.at_ms <= a.at_ms and b.at_ms >= a.at_ms - a.w group by a.event_id"
)
def sliding_exposure_own_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 with P16-like windows of each row's own length."""
    t = _timed(spark, sf_dir).withColumn("w", F.coalesce("lambda_ms", F.lit(3000)) * 1000)
    t = t.select("peer", "event_id", "at_ms", "settled_units", "w")
    return sequence.sliding_sum_own_window(t, "peer", "at_ms", "settled_units", "w").select("event_id", "unvalidated")


_RANK = "select *, row_number() over (partition by peer order by ts, event_id) * 10 as at_s, cast(sum(settled_units // 100000) over (partition by peer order by ts, event_id rows unbounded preceding) as bigint) as total from observations"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("peer").orderBy("ts", "event_id")
    o = D.observations(spark, sf_dir)
    return o.withColumn("at_s", F.row_number().over(w).cast("bigint") * 10).withColumn("total", F.sum(F.floor(F.col("settled_units") / 100_000)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


@query(
    with_("observations")
    + f""", p as (select *, total - coalesce(lag(total, 2) over (partition by peer order by at_s), 0) as progress from ({_RANK})), s as (select *, at_s >= 90 and progress < 20 as stalled from p)
    select event_id, progress, stalled, stalled and sum(stalled::int) over (partition by peer order by at_s) = 1 as fires from s"""
)
def stall_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5/R11."""
    return sequence.stalls(_progress(spark, sf_dir), "peer", "at_s", "total").select("event_id", "progress", "stalled", "fires")


@query(with_("observations") + ", l as (select *, lag(threshold) over (partition by peer order by ts, event_id) as prev from observations) select event_id, threshold, prev from l where prev <> threshold")
def threshold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return sequence.changes(D.observations(spark, sf_dir), "peer", ["ts", "event_id"], "threshold").select("event_id", "threshold", "prev")


@query(
    with_("observations")
    + f""", r as (select *, threshold // 6000000 as level from ({_RANK})), c as (select *, case when lag(level) over (partition by peer order by at_s) is null or lag(level) over (partition by peer order by at_s) <> level then at_s end as c from r)
    select event_id, at_s >= 300 and at_s - last_value(c ignore nulls) over (partition by peer order by at_s rows unbounded preceding) >= 40 as plateau from c"""
)
def threshold_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 on coarse levels, with a quiet time of 40 s."""
    level = _progress(spark, sf_dir).withColumn("level", F.floor(F.col("threshold") / 6_000_000))
    return sequence.plateau(level, "peer", "at_s", "level", quiet_s=40).select("event_id", "plateau")


@query(
    with_("observations")
    + f", n as (select peer, at_s, service_x10 % 2 as accepted, lead(service_x10 % 2) over (partition by peer order by at_s) as following from ({_RANK})) select peer, min(at_s) as lambda_ms from n where accepted = 0 and following = 0 group by peer"
)
def double_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    p = _progress(spark, sf_dir).withColumn("accepted", F.col("service_x10") % 2)
    return sequence.double_zero(p, "peer", ["at_s"], "accepted", "at_s")


@query("select time_bucket(interval 30 seconds, ts) as start, count(*) as chunks, round(count(*) * 4096 / 1e6 / 30, 9) as mb_s from events group by 1")
def rate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, aligned to the epoch."""
    return sequence.rate_samples(D.table(spark, sf_dir, "events"), "ts").withColumn("mb_s", F.round("mb_s", 9))


@query(
    with_("observations")
    + f""", i as (select peer, clean, sum(clean::int) over (partition by peer order by at_s rows unbounded preceding) as island from ({_RANK})),
    s as (select peer, island, count(*) as streak from i where not clean group by 1, 2) select peer, streak from s where streak >= 4"""
)
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 with runs of four."""
    p = _progress(spark, sf_dir).withColumn("failed", ~F.col("clean"))
    return sequence.error_streaks(p, "peer", ["at_s"], "failed", 4)


@query(with_("runs") + "select stop_reason, string_agg(m, '|' order by n) as errors from (select stop_reason, run || '/' || part as m, row_number() over (partition by stop_reason order by run || '/' || part) as n from runs where chunks_err > 0) where n <= 20 group by 1")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty errors of each kind; the limit is the operator's."""
    bad = D.runs(spark, sf_dir).where("chunks_err > 0").withColumn("message", F.concat_ws("/", F.col("run").cast("string"), F.col("part").cast("string")))
    return rank.first_errors(bad, "stop_reason", "message", "message").withColumn("errors", F.array_join("errors", "|"))


@query(
    with_("observations")
    + """select peer, round(list_reduce(list_prepend(list(cast(service_x10 as double) order by ts, event_id)[1], list(cast(service_x10 as double) order by ts, event_id)), lambda a, x: a * 0.8 + x * 0.2), 6) as ewma from observations group by peer"""
)
def latency_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "service_x10"))), lambda x: x["service_x10"])
    return D.observations(spark, sf_dir).groupBy("peer").agg(F.round(S.ewma_fifth(samples, F.lit(None)), 6).alias("ewma"))


@query()
def pipeline_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12; a fold over outcomes in order, tested against a plain loop (tests/test_whole.py)."""
    outcomes = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ok"))), lambda x: x["ok"])
    o = D.observations(spark, sf_dir).withColumn("ok", F.col("event_id") % 9 != 0)
    return o.groupBy("peer").agg(S.aimd_depth(outcomes).alias("depth"))


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("reserve"), F.lit("apply"), F.lit("release"), F.lit("credit")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.abs("value")).cast("bigint").alias("amount"))


@query()
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3/R4; a state machine, tested against a plain loop and against its stream (tests/test_whole.py)."""
    return state.accounts(account_events(spark, sf_dir), 5000)


@query(with_("observations") + "select peer, coalesce(arg_max(t, event_id) filter (where t is not null), 1350000) as threshold from (select *, case when event_id % 3 = 0 and peer % 5 <> 0 then threshold end as t from observations) group by peer")
def announced_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    o = D.observations(spark, sf_dir)
    return state.latest_threshold(o.select("peer", F.col("event_id").alias("seq"), F.when((F.col("event_id") % 3 == 0) & (F.col("peer") % 5 != 0), F.col("threshold")).alias("threshold")))


@query(
    with_("observations")
    + """, m as (select *, cast((epoch_us(ts) // 1000) as bigint) as at_ms, (select max(cast((epoch_us(ts) // 1000) as bigint)) - 86400000 from observations) as now_ms from observations)
    select peer, cast(coalesce(sum(settled_units) filter (where at_ms + 2500 <= now_ms), 0) as bigint) as credited, cast(coalesce(sum(settled_units) filter (where at_ms + 2500 > now_ms), 0) as bigint) as pending from m group by peer"""
)
def delayed_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, a day before the last event."""
    t = _timed(spark, sf_dir).withColumn("amount", F.col("settled_units"))
    now = t.agg((F.max("at_ms") - 86_400_000).alias("now_ms"))
    return state.delayed_credit(t.join(F.broadcast(now)), F.col("now_ms"))
