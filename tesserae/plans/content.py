"""Queries over chunks and nodes: address algebra, joins, coverage, ranking, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import address as A
from tesserae.functions import scalars as S
from tesserae.operators import aggregates, graph, joins, rank
from tesserae.plans.registry import query
from tesserae.sources import domain as D
from tesserae.sources.domain import DEPTH, sql_head, sql_po, sql_prefix, with_

#: The address that proximities are measured from.
REFERENCE = "a3" * 32


@query(
    with_("chunks", "nodes")
    + f"""select count(*) as chunks_total, count(*) filter (where p in (select {sql_prefix("overlay")} from nodes)) as chunks_covered,
    count(distinct p) as neighborhoods_total, count(distinct case when p in (select {sql_prefix("overlay")} from nodes) then p end) as neighborhoods_covered
    from (select {sql_prefix("address")} as p from chunks)"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage(D.chunks(spark, sf_dir), D.nodes(spark, sf_dir), DEPTH)


@query(
    with_("nodes")
    + f"""select cast(b.po as int) as po, count(n.po) as nodes from range(32) b(po) left join (select {sql_po("overlay", f"'{REFERENCE}'")} as po from nodes) n on n.po = b.po group by b.po"""
)
def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bin_counts(D.nodes(spark, sf_dir), REFERENCE)


@query(
    with_("nodes")
    + f"""select overlay, {sql_po("overlay", f"'{REFERENCE}'")} as po, {sql_prefix("overlay", 9)} as nb9, {sql_prefix("overlay", 31)} as nb31,
    lpad(lower(to_hex({sql_prefix("overlay", 9)})), 3, '0') as label, substr(overlay, 1, 16) as short,
    cast(cast('0x' || substr(overlay, 1, 16) as ubigint) // 16777216 as decimal(20,0)) as prefix40, {sql_head("overlay")} as head from nodes"""
)
def address_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(spark, sf_dir).select(
        "overlay",
        A.proximity(F.col("overlay"), F.lit(REFERENCE)).alias("po"),
        A.neighborhood("overlay", 9).alias("nb9"),
        A.neighborhood("overlay", 31).alias("nb31"),
        A.depth9_label("overlay").alias("label"),
        A.short("overlay").alias("short"),
        A.bucket_prefix("overlay", 40).alias("prefix40"),
        A.head("overlay").alias("head"),
    )


@query(
    with_("nodes")
    + """select overlay, regexp_extract(underlays[1], '/p2p/([^/]+)', 1) as peer, list_filter(underlays, lambda u: starts_with(u, '/ip4/') and not starts_with(u, '/ip4/10.')
    and not starts_with(u, '/ip4/192.168') and not starts_with(u, '/ip4/172.') and not contains(u, '/ws'))[1] as dialable,
    not starts_with(underlays[1], '/ip4/10.') as routable from nodes"""
)
def underlay_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("underlays", 0)
    return D.nodes(spark, sf_dir).select("overlay", A.peer_id(first).alias("peer"), A.first_dialable("underlays").alias("dialable"), A.routable(first).alias("routable"))


@query(
    with_("nodes")
    + """select overlay, case when length(t) = 64 then t end as parsed, case when node_no % 4 = 3 then overlay end as strict from (select overlay, node_no, lower(replace(replace(trim(case when node_no % 4 = 0
    then ' 0x' || upper(overlay) when node_no % 4 = 1 then overlay || ' ' when node_no % 4 = 2 then substr(overlay, 2) else upper(overlay) end), '0x', ''), '0X', '')) as t from nodes)"""
)
def hex_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node_no")
    raw = F.when(n % 4 == 0, F.concat(F.lit(" 0x"), F.upper("overlay"))).when(n % 4 == 1, F.concat("overlay", F.lit(" "))).when(n % 4 == 2, F.substring("overlay", 2, 64)).otherwise(F.upper("overlay"))
    return D.nodes(spark, sf_dir).select("overlay", A.parse_hex(raw).alias("parsed"), A.parse_hex_strict(raw).alias("strict"))


@query(
    with_("chunks", "nodes")
    + f"""select "index", overlay, rank, 10000 * (32 - po) as price from (select "index", overlay, row_number() over (partition by address, "index" order by rtt_ms nulls last, overlay) as rank,
    {sql_po("address", "overlay")} as po from chunks join nodes on {sql_prefix("address")} = {sql_prefix("overlay")}) where rank <= 3"""
)
def storers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = joins.storers(D.chunks(spark, sf_dir), D.nodes(spark, sf_dir), DEPTH, most=3)
    price = S.peer_price(A.proximity("address", "overlay")).cast("bigint")
    return ranked.select("index", "overlay", F.col("rank").cast("bigint").alias("rank"), price.alias("price"))


@query(
    with_("chunks", "nodes")
    + f"""select "index", overlay, row_number() over (partition by address, "index" order by rtt_ms nulls last, overlay) as rank, 10000 * (32 - {sql_po("address", "overlay")}) as price
    from chunks join nodes on {sql_prefix("address")} = {sql_prefix("overlay")}"""
)
def storers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every covering node of each chunk; storers has the first three."""
    chunks = D.chunks(spark, sf_dir).withColumn("chunk_head", A.head("address"))
    nodes = D.nodes(spark, sf_dir).withColumn("node_head", A.head("overlay"))
    ranked = joins.storers(chunks, nodes, DEPTH)
    price = S.peer_price(A.proximity_of_heads(F.col("chunk_head"), F.col("node_head"))).cast("bigint")
    return ranked.select("index", "overlay", F.col("rank").cast("bigint").alias("rank"), price.alias("price"))


_HAVE = f"(select {sql_prefix('overlay')} from nodes)"


@query(with_("chunks", "nodes") + f'select "index", address from chunks where {sql_prefix("address")} in {_HAVE}')
def covered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.covered(D.chunks(spark, sf_dir), D.nodes(spark, sf_dir), DEPTH).select("index", "address")


@query(with_("chunks", "nodes") + f'select "index", address from chunks where {sql_prefix("address")} not in {_HAVE}')
def uncovered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.uncovered(D.chunks(spark, sf_dir), D.nodes(spark, sf_dir), DEPTH).select("index", "address")


@query(
    with_("chunks", "nodes")
    + f"""select "index", case when {sql_prefix("address")} in {_HAVE} and address not in (select address from chunks where "index" % 10 = 3) then 'direct' else 'fallback' end as channel from chunks"""
)
def routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir)
    return joins.routed(c, D.nodes(spark, sf_dir), DEPTH, failed=c.where("index % 10 = 3")).select("index", "channel")


@query(with_("chunks", "nodes") + f"select overlay from nodes where {sql_prefix('overlay')} in (select {sql_prefix('address')} from chunks)")
def nodes_with_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_work(D.nodes(spark, sf_dir), D.chunks(spark, sf_dir), DEPTH).select("overlay")


@query(with_("chunks") + """select "index", address from chunks where address not in (select address from chunks where "index" % 4 = 0)""")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.chunks(spark, sf_dir)
    return joins.not_stored(c, c.where("index % 4 = 0")).select("index", "address")


@query(with_("chunks") + f"""select "index", address from chunks where {sql_po("address", f"'{REFERENCE}'")} >= 3""")
def neighborhood_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near(D.chunks(spark, sf_dir), REFERENCE, 3).select("index", "address")


@query(with_("chunks") + f"select {sql_prefix('address')} as prefix, count(*) as n from chunks group by 1")
def chunks_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.per_bucket(D.chunks(spark, sf_dir), "address", DEPTH)


@query(with_("nodes") + f"select count(distinct {sql_prefix('overlay')}) as neighborhoods, count(*) filter (where dialed_ok) as dialed, count(*) as nodes from nodes")
def neighborhood_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(spark, sf_dir).agg(F.count_distinct(A.neighborhood("overlay", DEPTH)).alias("neighborhoods"), F.count_if("dialed_ok").alias("dialed"), F.count("*").alias("nodes"))


@query(
    with_("nodes")
    + f"""select min(n) as least, max(n) as most, list_sort(list(n))[count(*) // 2 + 1] as median, {1 << 6} - count(*) as empty
    from (select {sql_prefix("overlay", 6)} as p, count(*) as n from nodes group by 1)"""
)
def roster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per neighbourhood, and neighbourhoods without any."""
    per = aggregates.per_bucket(D.nodes(spark, sf_dir), "overlay", 6)
    mid = aggregates.percentiles(per.withColumnRenamed("n", "nodes"), "nodes", [], (50,)).select(F.col("p50").alias("median"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.lit(1 << 6) - F.count("*")).alias("empty")).join(mid)


@query(
    with_("nodes")
    + f"""select turn, prefix, overlay from (select row_number() over (partition by {sql_prefix("overlay", 6)} order by overlay) as turn, {sql_prefix("overlay", 6)} as prefix, overlay from nodes)
    order by turn, prefix limit 100"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 nodes across neighbourhoods; the limit is the operator's."""
    out = rank.round_robin(D.nodes(spark, sf_dir), "overlay", 6, 100, "overlay")
    return out.select(F.col("turn").cast("bigint").alias("turn"), "prefix", "overlay")




@query(
    with_("chunks", "nodes", "observations")
    + f""", s as (select peer, max(threshold) as threshold_last, max(lambda_ms) as lambda_ms, max(service_x10) as service_x10 from observations group by 1),
    c as (select overlay, node_no, {sql_prefix("overlay")} as prefix, rtt_ms, list_filter(underlays, lambda u: starts_with(u, '/ip4/') and not starts_with(u, '/ip4/10.') and not contains(u, '/ws'))[1] as address
        from nodes where {sql_prefix("overlay")} in (select {sql_prefix("address")} from chunks)),
    r as (select c.*, coalesce(nullif(coalesce(service_x10, 0), 0), 140) as rate, case when lambda_ms is null then 1 when lambda_ms <= 2500 then 0 else 2 end as class,
        coalesce(threshold_last, 0) as threshold_last from c left join s on c.node_no = s.peer where address is not null)
    select prefix, overlay, address, rate, cast(class as int) as class, row_number() over (partition by prefix order by rate desc, class, threshold_last desc, rtt_ms nulls last, overlay) as rank from r"""
)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with J4, J5, P9, P14 and P15."""
    state = D.observations(spark, sf_dir).groupBy(F.col("peer").alias("node_no")).agg(
        F.max("threshold").alias("threshold_last"), F.max("lambda_ms").alias("lambda_ms"), F.max("service_x10").alias("service_x10")
    )
    out = rank.candidates(D.nodes(spark, sf_dir), D.chunks(spark, sf_dir), state, DEPTH, "node_no")
    return out.select("prefix", "overlay", "address", "rate", "class", F.col("rank").cast("bigint").alias("rank"))


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = aggregates.per_bucket(D.chunks(spark, sf_dir), "address", 6).withColumnRenamed("n", "remaining")
    return n.withColumn("rate", F.col("prefix") % 5 * 70).withColumn("active", F.col("prefix") % 2)


_BUCKETS = f"b as (select p as prefix, count(*) as remaining, p % 5 * 70 as rate, p % 2 as active from (select {sql_prefix('address', 6)} as p from chunks) group by p)"


@query(
    with_("chunks")
    + f""", {_BUCKETS} select prefix, remaining, case when rate = 0 then 4611686018427387904 + remaining else remaining * 10000 // rate end as criticality
    from b where remaining > 0 and not (remaining < 30 and active > 0) order by criticality desc, prefix limit 1"""
)
def critical_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 with F8."""
    return rank.most_critical(_buckets(spark, sf_dir)).select("prefix", "remaining", "criticality")


@query(with_("chunks") + f", {_BUCKETS} select prefix, remaining from b where prefix % 3 = 0 and active = 0 and remaining * 40 >= 30 and prefix % 4 < 3")
def recyclable_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 over forty times the work, so that small tables have buckets that are worth it too."""
    have = _buckets(spark, sf_dir).withColumn("unused", F.col("prefix") % 3).withColumn("recycles", F.col("prefix") % 4)
    return rank.recyclable(have.withColumn("remaining", F.col("remaining") * 40)).select("prefix", (F.col("remaining") / 40).cast("bigint").alias("remaining"))


@query(with_("nodes") + "select s.seed, count(*) as nodes, count(*) as keys, 0::bigint as misplaced from nodes, (select 7 as seed union all select 11) s group by s.seed having count(*) > 0")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under each seed every node has a place of its own, the same whenever it is asked for, and another one than under the next seed."""
    n = D.nodes(spark, sf_dir)
    both = n.select("overlay", F.explode(F.array(F.lit(7), F.lit(11))).alias("seed"))
    key = F.when(F.col("seed") == 7, S.order_key(F.col("overlay"), 7)).otherwise(S.order_key(F.col("overlay"), 11))
    again = n.select("overlay", S.order_key(F.col("overlay"), 7).alias("k7"), S.order_key(F.col("overlay"), 11).alias("k11"))
    same = both.join(again, "overlay").withColumn("key", key)
    moved = (F.col("key") != F.when(F.col("seed") == 7, F.col("k7")).otherwise(F.col("k11"))) | (F.col("k7") == F.col("k11"))
    return same.groupBy("seed").agg(F.count("*").alias("nodes"), F.count_distinct("key").alias("keys"), F.count_if(moved).alias("misplaced"))


@query(with_("chunks") + """select address, min("index") as "index" from chunks group by address""")
def stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An idempotent put keeps the first payload of an address."""
    return rank.keep_first(D.chunks(spark, sf_dir), "address", ["index"]).select("address", "index")


@query(with_("chunks") + """select "index", (n - 1) // greatest(1, total // 7) as slice from (select "index", row_number() over (order by "index") as n, count(*) over () as total from chunks) where (n - 1) // greatest(1, total // 7) < 7""")
def budget_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    return rank.slices(D.chunks(spark, sf_dir), "index", 7).select("index", F.col("slice").cast("bigint").alias("slice"))


@query(
    with_("nodes")
    + """select overlay, rtt_ms, n from (select overlay, rtt_ms, row_number() over (order by rtt_ms nulls last, overlay) as n from nodes) where n <= 50"""
)
def fastest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-50 report."""
    from pyspark.sql import Window

    top = rank.order_by_overlay(D.nodes(spark, sf_dir), F.col("rtt_ms").asc_nulls_last()).limit(50)
    w = Window.orderBy(F.col("rtt_ms").asc_nulls_last(), "overlay")
    return top.select("overlay", "rtt_ms", F.row_number().over(w).cast("bigint").alias("n"))


@query(with_("nodes") + "select a.overlay, b.overlay as answered from nodes a join nodes b on a.node_no = b.node_no + 1 - 1 + (case when b.node_no % 9 = 0 then 1 else 0 end) where a.overlay <> b.overlay")
def overlay_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every ninth entry of the cache is out of step by one."""
    n = D.nodes(spark, sf_dir)
    seen = n.select((F.col("node_no") + F.when(F.col("node_no") % 9 == 0, 1).otherwise(0)).alias("node_no"), "overlay")
    return joins.mismatched(n.select("node_no", "overlay"), seen, "node_no").select("overlay", "answered")


@query(with_("nodes") + "select overlay, underlays[1] as first from nodes where node_no % 4 <> 0")
def resolved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address book with empty entries."""
    n = D.nodes(spark, sf_dir)
    book = n.select("overlay", F.when(F.col("node_no") % 4 != 0, F.col("underlays")).otherwise(F.array().cast("array<string>")).alias("underlays"))
    return joins.resolved(n.select("overlay"), book).select("overlay", F.get("underlays", 0).alias("first"))


@query(with_("nodes") + "select overlay from nodes where node_no % 6 = 0")
def warm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.nodes(spark, sf_dir)
    return joins.warm(n, n.where("node_no % 2 = 0").select("overlay", (F.col("node_no") % 3 == 0).alias("alive")), "overlay").select("overlay")


@query(
    with_("nodes")
    + """select overlay, case when node_no % 3 = 0 then '/ip4/9.9.9.9/tcp/1' else u end as underlay from (select *, list_filter(underlays, lambda u: starts_with(u, '/ip4/') and not starts_with(u, '/ip4/10.') and not contains(u, '/ws'))[1] as u from nodes)
    where node_no % 5 <> 4 and (node_no % 3 = 0 or u is not null)"""
)
def staked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    n = D.nodes(spark, sf_dir)
    registry = n.select("overlay", F.when(F.col("node_no") % 5 == 4, 0).otherwise(10).alias("stake"))
    listed = n.where("node_no % 3 = 0").select("overlay", F.lit("/ip4/9.9.9.9/tcp/1").alias("underlay"))
    return joins.dialable_staked(registry, listed, n).select("overlay", "underlay")


@query()
def dispatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 slots, the operator's own bound."""
    from pyspark.sql import Window

    n = D.nodes(spark, sf_dir).withColumn("prefix", A.neighborhood("overlay", 6)).withColumn("rate", F.col("node_no") % 200 + 1)
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("rate"), "overlay")))
    return graph.dispatch(_buckets(spark, sf_dir).select("prefix", "remaining"), n.select("prefix", "overlay", "rate", "rank"), 256)


_EDGES = "edges as (select distinct l_suppkey as src, l_partkey % (select count(*) from supplier) + 1 as dst from lineitem where l_orderkey % 40 = 0)"


@query(
    f"""with recursive {_EDGES}, walk as (select 1::bigint as peer, 0 as level union select dst, level + 1 from walk join edges on src = peer where level < 6 and peer % 7 <> 3)
    select peer, cast(min(level) as int) as level, peer % 7 <> 3 as ok from walk group by peer"""
)
def gossip_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over the edges of every fortieth order and six levels, which its recursive SQL can walk; gossip_crawl_whole has no such bounds. Every seventh peer doesn't answer."""
    n = D.table(spark, sf_dir, "supplier").count()
    edges = D.table(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 0").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst")).distinct()
    dead = edges.select(F.col("dst").alias("peer")).where("peer % 7 = 3")
    found = graph.crawl(spark.createDataFrame([(1,)], "peer long"), edges, most_dials=1_000_000, dead=dead, most_levels=6)
    return found.select("peer", "level", "ok")


@query()
def gossip_crawl_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over all edges until nobody is left to expand, with why it stopped; tested against brute force, as recursive SQL over all edges is too slow."""
    n = D.table(spark, sf_dir, "supplier").count()
    edges = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst")).distinct()
    dead = edges.select(F.col("dst").alias("peer")).where("peer % 7 = 3")
    found = graph.crawl(spark.createDataFrame([(1,)], "peer long"), edges, most_dials=2_000_000_000, dead=dead)
    return found.select("peer", "level", "ok", "stop")
