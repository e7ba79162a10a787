"""The domain's relations, derived from the star-schema tables, with the same derivation as SQL.

Each function returns a DataFrame; SQL has a common table expression of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a neighbourhood in the registered queries.
DEPTH = 10


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's is."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECONDS"), ts) * 1000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("index"), F.sha2("text", 256).alias("address"), F.col("n_chars").cast("bigint").alias("data_len"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    lan = F.concat(F.lit("/ip4/10.0."), text(k % 200), F.lit(".7/tcp/1634/p2p/Q"), text(k))
    wan = F.concat(F.lit("/ip4/"), text(40 + k % 50), F.lit("."), text(k % 250), F.lit(".33.17/tcp/"), text(1000 + k % 9000), F.lit("/p2p/Q"), text(k))
    sock = F.concat(F.lit("/ip4/85.1.2."), text(k % 250), F.lit("/tcp/1635/ws/p2p/Q"), text(k))
    underlays = F.when(k % 5 == 0, F.array(lan)).when(k % 5 == 1, F.array(lan, wan)).when(k % 5 == 2, F.array(sock, wan)).otherwise(F.array(wan, sock))
    return table(spark, sf_dir, "customer").select(
        F.sha2(F.concat(F.lit("n"), text(k)), 256).alias("overlay"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD").alias("dialed_ok"),
        F.when(k % 7 != 0, (F.floor(F.abs("c_acctbal")) % 900).cast("int")).alias("rtt_ms"),
        (k * 10).alias("last_seen_ms"),
        underlays.alias("underlays"),
        k.alias("node_no"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated observations of nodes, in the order of seq."""
    o, k, s = table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        F.sha2(F.concat(F.lit("n"), k.cast("string")), 256).alias("overlay"),
        s.alias("seq"),
        (s % 1000).alias("tick"),
        (F.col("o_orderstatus") == "F").alias("dialed_ok"),
        F.when(s % 3 != 0, (F.floor("o_totalprice") % 700).cast("int")).alias("rtt_ms"),
        F.concat(F.lit("/ip4/84.2."), (s % 3).cast("string"), F.lit("."), (k % 200).cast("string"), F.lit("/tcp/1634/p2p/Q"), k.cast("string")).alias("underlay"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finished connections tell about their peers, in the order of (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    v = F.floor(F.abs("value")).cast("bigint")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("peer"),
        F.col("ts"),
        i.alias("event_id"),
        (1_350_000 + 450_000 * (i % 19)).alias("threshold"),
        F.when(i % 4 != 0, 500 + v % 4000).alias("lambda_ms"),
        (v * 1000).alias("settled_units"),
        F.when(i % 3 != 0, v % 300).otherwise(0).alias("service_x10"),
        F.when(i % 5 == 0, v).alias("surplus"),
        (i % 2 == 0).alias("clean"),
        F.floor(epoch_ms(F.col("ts")) / 1000).alias("at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured transfers: one for each line item; peer, depth, bytes, seconds, outcome."""
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("peer"),
        F.element_at(F.array(F.lit(1), F.lit(8), F.lit(32), F.lit(100)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("depth"),
        F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").cast("int").alias("part"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(q).alias("chunks_ok"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(q % 5).alias("chunks_err"),
        (q * 4096).alias("bytes"),
        (1 + F.col("l_orderkey") % 30).alias("wall_s"),
        F.when(F.col("l_returnflag") == "R", "dial_failed: refused").when(F.col("l_linestatus") == "F", "complete").otherwise("budget").alias("stop_reason"),
        F.floor("l_extendedprice").cast("bigint").alias("units"),
    )


#: Common table expressions of the same relations.
SQL = {
    "chunks": "select doc_id as index, sha256(text) as address, cast(n_chars as bigint) as data_len from documents",
    "nodes": """select sha256('n' || c_custkey) as overlay, c_mktsegment in ('BUILDING','MACHINERY','HOUSEHOLD') as dialed_ok,
        case when c_custkey % 7 <> 0 then cast(cast(floor(abs(c_acctbal)) as bigint) % 900 as int) end as rtt_ms, c_custkey * 10 as last_seen_ms,
        case c_custkey % 5 when 0 then [lan] when 1 then [lan, wan] when 2 then [sock, wan] else [wan, sock] end as underlays, c_custkey as node_no
        from (select *, '/ip4/10.0.' || (c_custkey % 200) || '.7/tcp/1634/p2p/Q' || c_custkey as lan,
            '/ip4/' || (40 + c_custkey % 50) || '.' || (c_custkey % 250) || '.33.17/tcp/' || (1000 + c_custkey % 9000) || '/p2p/Q' || c_custkey as wan,
            '/ip4/85.1.2.' || (c_custkey % 250) || '/tcp/1635/ws/p2p/Q' || c_custkey as sock from customer)""",
    "sightings": """select sha256('n' || o_custkey) as overlay, o_orderkey as seq, o_orderkey % 1000 as tick, o_orderstatus = 'F' as dialed_ok,
        case when o_orderkey % 3 <> 0 then cast(cast(floor(o_totalprice) as bigint) % 700 as int) end as rtt_ms,
        '/ip4/84.2.' || (o_orderkey % 3) || '.' || (o_custkey % 200) || '/tcp/1634/p2p/Q' || o_custkey as underlay from orders""",
    "observations": """select user_id as peer, ts, event_id, 1350000 + 450000 * (event_id % 19) as threshold,
        case when event_id % 4 <> 0 then 500 + v % 4000 end as lambda_ms, v * 1000 as settled_units,
        case when event_id % 3 <> 0 then v % 300 else 0 end as service_x10, case when event_id % 5 = 0 then v end as surplus,
        event_id % 2 = 0 as clean, epoch_us(ts) // 1000000 as at from (select *, cast(floor(abs(value)) as bigint) as v from events)""",
    "runs": """select l_suppkey as peer, [1, 8, 32, 100][l_linenumber % 4 + 1] as depth, l_orderkey as run, cast(l_linenumber as int) as part,
        case when l_returnflag = 'R' then 0 else q end as chunks_ok, case when l_returnflag = 'N' then 0 else q % 5 end as chunks_err, q * 4096 as bytes,
        1 + l_orderkey % 30 as wall_s, case when l_returnflag = 'R' then 'dial_failed: refused' when l_linestatus = 'F' then 'complete' else 'budget' end as stop_reason,
        cast(floor(l_extendedprice) as bigint) as units from (select *, cast(floor(l_quantity) as bigint) as q from lineitem)""",
}


def with_(*names: str) -> str:
    """The head of a statement over these relations, with the address functions as macros spelled out by callers."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " "


def sql_head(a: str) -> str:
    return f"cast('0x' || substr({a}, 1, 8) as bigint)"


def sql_prefix(a: str, depth: int = DEPTH) -> str:
    return f"({sql_head(a)} >> {32 - depth})"


def sql_po(a: str, b: str) -> str:
    x = f"xor({sql_head(a)}, {sql_head(b)})"
    return f"cast(case when {x} = 0 then 31 else least(31, 32 - length(bin({x}))) end as int)"
