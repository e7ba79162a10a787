"""Queries that write a relation in one of the domain's file formats, in the shared folder, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import positive_ints, span_le
from tesserae.operators import aggregates
from tesserae.plans.registry import query
from tesserae.session import shared_path
from tesserae.sources import domain as D
from tesserae.sources import fetch, files, wire
from tesserae.sources.domain import with_
from tesserae.streaming import state


@query(with_("chunks") + """select address, cast("index" as varchar) as "index", cast(data_len as varchar) as data_len from chunks where "index" % 11 <> 0""")
def chunk_inventory_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh address is spoilt and skipped."""
    path = shared_path(spark, "chunks")
    bad = F.when(F.col("index") % 11 == 0, F.concat(F.lit("zz"), F.substring("address", 3, 62))).otherwise(F.upper("address"))
    D.chunks(spark, sf_dir).select("index", bad.alias("address_hex"), "data_len").write.option("header", True).csv(path)
    return files.read_chunks(spark, path).select("address", "index", "data_len")


@query(with_("nodes") + "select overlay, dialed_ok, case when node_no % 10 <> 0 then rtt_ms end as rtt_ms, last_seen_ms as tick, array_to_string(underlays, '|') as underlays from nodes")
def topology_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips that aren't numbers are unknown."""
    path = shared_path(spark, "topology")
    n = D.nodes(spark, sf_dir).withColumn("rtt_ms", F.when(F.col("node_no") % 10 == 0, "fast").otherwise(F.col("rtt_ms").cast("string")))
    files.write_topology(n, path)
    return files.read_topology(spark, path).select("overlay", "dialed_ok", "rtt_ms", "tick", F.array_join("underlays", "|").alias("underlays"))


@query(with_("nodes") + "select case when contains(underlays[1], '/ws') then underlays[2] else underlays[1] end as underlay from (select *, list_filter(underlays, lambda u: not starts_with(u, '/ip4/10.')) as good from nodes where dialed_ok) where len(good) > 0 and (not starts_with(underlays[1], '/ip4/10.')) union all select underlays[2] from nodes where dialed_ok and starts_with(underlays[1], '/ip4/10.') and len(underlays) > 1")
def seed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 with F5, all rows."""
    path = shared_path(spark, "reach")
    n = D.nodes(spark, sf_dir)
    n.select(F.col("overlay").alias("overlay_hex"), F.concat_ws("|", "underlays").alias("underlay"), F.col("dialed_ok").cast("int").alias("dial_ok")).write.option("header", True).csv(path)
    return files.read_seeds(spark, path, most=2_000_000_000)


@query(with_("nodes") + "select overlay, array_to_string(underlays, '|') as underlays from nodes where dialed_ok")
def target_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come twice count once."""
    path = shared_path(spark, "targets")
    n = D.nodes(spark, sf_dir).select(F.col("overlay").alias("overlay_hex"), F.concat_ws("|", "underlays").alias("underlay"), F.col("dialed_ok").cast("int").alias("dial_ok"))
    n.union(n).write.option("header", True).csv(path)
    return files.read_targets(spark, path).select("overlay", F.array_join("underlays", "|").alias("underlays"))


@query(
    with_("observations")
    + """select sha256('n' || peer) as overlay, max(threshold) as threshold_last, arg_max(lambda_ms, (ts, event_id)) filter (where lambda_ms is not null) as lambda_ms, cast(sum(settled_units) as bigint) as settled_units from observations group by peer"""
)
def peer_state_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 and S5 over A10."""
    path = shared_path(spark, "peerstate")
    s = aggregates.peer_state(D.observations(spark, sf_dir))
    s = s.select(F.sha2(F.concat(F.lit("n"), F.col("peer").cast("string")), 256).alias("overlay"), "threshold_last", "lambda_ms", "settled_units", "last_ok_unix", F.col("service_x10").alias("service_cps_x10"), "surplus_units")
    files.write_peer_state(s, path)
    return files.read_peer_state(spark, path).select("overlay", "threshold_last", "lambda_ms", "settled_units")


@query("select substr(sha256(l_suppkey::varchar), 1, 40) as beneficiary, cast(max(l_orderkey) as varchar) || repeat('0', 24) as amount from lineitem group by 1")
def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third each as a base of one object with the largest amounts so far, as the old journal and as the journal of a line each, with commit marks and a torn last line; written, read back and merged."""
    ours, path = "ab" * 20, shared_path(spark, "ledger")
    li = D.table(spark, sf_dir, "lineitem").withColumn("sectioned", F.col("l_linenumber") % 2 == 0)
    who = F.substring(F.sha2(F.col("l_suppkey").cast("string"), 256), 1, 40)
    key = F.when(F.col("sectioned"), F.concat(F.lit(ours + ":"), who)).otherwise(who).alias("key")
    amount = F.concat(F.col("l_orderkey").cast("string"), F.lit("0" * 24)).alias("amount")
    third = lambda k: li.where(F.pmod("l_orderkey", F.lit(3)) == k)
    mark = F.when(F.pmod("l_orderkey", F.lit(64)) == 0, F.concat(F.lit("\n#"), F.col("l_linenumber").cast("string"))).otherwise("")
    line = F.concat(F.to_json(F.create_map(key, amount)), mark).alias("line")
    files.write_ledger(third(0).groupBy("l_suppkey", "sectioned").agg(F.max("l_orderkey").alias("l_orderkey")).select(key, amount), path)
    files.write_journal(third(1).select(line), path + ".journal.old")
    files.write_journal(third(2).select(line), path + ".journal", torn='#12\n\n{"ab')
    return files.read_ledger(spark, path, ours)


def _chunk_index(spark: SparkSession, sf_dir: str, end: int) -> DataFrame:
    path = shared_path(spark, "index")
    c = D.chunks(spark, sf_dir)
    lines = c.select(F.concat_ws(",", "address", (F.col("index") * 4096).cast("string"), F.col("data_len").cast("string")).alias("line"), (F.col("index") % 16).alias("file"))
    whole = lines.groupBy("file").agg(F.concat(F.lit(f"chunk-store v1\nend={end}\n"), F.concat_ws("\n", F.collect_list("line")), F.lit("\nbroken,1\n")).alias("value"))
    whole.select("value", "file").write.partitionBy("file").text(path)  # a file for each row
    return files.read_chunk_index(spark, path, "chunk-store", end)


@query(with_("chunks") + """select address, "index" * 4096 as "offset", cast(data_len as int) as len from chunks where "index" * 4096 + data_len <= 3000000""")
def chunk_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries beyond the end of the data are left out."""
    return _chunk_index(spark, sf_dir, 3_000_000)


@query(with_("chunks") + """select address, "index" * 4096 as "offset", cast(data_len as int) as len from chunks where "index" * 4096 + data_len <= (select max("index") * 4096 * 9 // 10 from chunks)""")
def chunk_index_file_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 with an end that grows with the table: about a tenth of the entries lies beyond it."""
    return _chunk_index(spark, sf_dir, (D.chunks(spark, sf_dir).agg(F.max("index")).first()[0] or 0) * 4096 * 9 // 10)


@query(with_("chunks") + """select "index", case when "index" % 5 <> 0 then address end as root, case when "index" % 5 <> 0 then data_len end as "offset" from chunks""")
def sidecar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25 and S8; every fifth has another magic."""
    text = files.sidecar_text(F.col("address"), F.col("data_len"))
    text = F.when(F.col("index") % 5 == 0, F.replace(text, F.lit("v1"), F.lit("v2"))).otherwise(text)
    return D.chunks(spark, sf_dir).select("index", files.parse_sidecar(text).alias("s")).select("index", "s.root", "s.offset")


@query("""select doc_id, i as "index", length(substr(hex(encode(text)), i * 8192 + 1, 8192)) // 2 as len, sha256(unhex(substr(hex(encode(text)), i * 8192 + 1, 8192))) as sha from documents, unnest(range((octet_length(encode(text)) + 4095) // 4096)) as t(i)""")
def payload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered parts of 4096 bytes."""
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    return files.split_payload(d).select(F.col("path").alias("doc_id"), "index", F.octet_length("data").cast("bigint").alias("len"), F.sha2("data", 256).alias("sha"))


@query("select user_id as number, ('[1, ' || (user_id % 9 + 1) || ']') as depths, cast(user_id % 256 as decimal(20,0)) as span from events group by 1")
def span_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21 and P24."""
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("number")).distinct()
    text = F.concat(F.lit("1, "), (F.col("number") % 9 + 1).cast("string"))
    raw = F.unhex(F.concat(F.lpad(F.hex(F.col("number") % 256), 2, "0"), F.lit("00" * 7)))
    return e.select("number", positive_ints(text).cast("string").alias("depths"), span_le(raw).alias("span"))


@query("select c_custkey as n, c_custkey * 1000 as amount, c_custkey * 1000 as back from customer")
def wire_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as varints and as acknowledgements, and back."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), (F.col("c_custkey") * 1000).alias("v"))
    body = F.concat(F.unhex(F.lit("0A08")), F.unhex(F.lpad(F.hex("v"), 16, "0")))
    return c.select("n", wire.ack_amount_of(body).cast("bigint").alias("amount"), wire.from_varint(wire.varint_of("v")).alias("back"))


@query(with_("nodes") + "select overlay, regexp_extract(underlays[1], '/p2p/([^/]+)', 1) as peer, underlays[1] as underlay from nodes where node_no % 3 <> 0")
def gossip_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each node; every third has a short overlay and tells nothing."""
    first = F.encode(F.get("underlays", 0), "utf-8")
    who = F.when(F.col("node_no") % 3 == 0, F.unhex(F.substring("overlay", 1, 40))).otherwise(F.unhex("overlay"))
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    part = lambda tag, raw: F.concat(F.unhex(F.lit(tag)), byte(F.octet_length(raw)), raw)
    record = F.concat(part("0A", first), part("1A", who))
    two = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(record) % 128 + 128), 2, "0")), byte(F.floor(F.octet_length(record) / 128)))
    message = F.concat(F.unhex(F.lit("0A")), F.when(F.octet_length(record) < 128, byte(F.octet_length(record))).otherwise(two), record)
    return wire.decode_gossip(D.nodes(spark, sf_dir).select(message.alias("body")))


def fake_chunk(address: str) -> bytes:
    """A chunk store without a network: what an address is the text of."""
    return address.encode()


def fake_log(first: int, last: int) -> list[tuple[int, int, str]]:
    """A log that refuses long ranges."""
    if last - first >= 500:
        raise TimeoutError("range too long")
    return [(b, b % 3, f"entry {b}") for b in range(first, last + 1) if b % 7 == 0]


@query(with_("chunks") + "select address, octet_length(encode(address)) as size, 1 as tries from (select distinct address from chunks order by address limit 64)")
def chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point look-up of 64 addresses through the data source."""
    spark.dataSource.register(fetch.ChunkSource)
    some = [r[0] for r in D.chunks(spark, sf_dir).select("address").distinct().orderBy("address").limit(64).collect()]
    found = spark.read.format("chunk_fetch").option("backend", "tesserae.plans.files:fake_chunk").option("addresses", ",".join(some)).load()
    return found.select("address", F.octet_length("data").cast("bigint").alias("size"), "tries")


@query("select b as block, cast(b % 3 as int) as log_index, 'entry ' || b as data from range(20001) t(b) where b % 7 = 0")
def log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that are refused are halved."""
    spark.dataSource.register(fetch.LogSource)
    r = spark.read.format("block_log").options(backend="tesserae.plans.files:fake_log", first=0, last=20_000, partitions=4, window=4000, least_window=100, most_window=4000)
    return r.load()


@query("select event_type as ev, count(*) as n, max(epoch_us(ts) // 1000) as last_ms from events group by 1")
def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as JSON lines, streamed and counted by kind."""
    path = shared_path(spark, "events")
    e = D.table(spark, sf_dir, "events").select(D.epoch_ms(F.col("ts")).alias("t_ms"), F.col("event_type").alias("ev"), "user_id")
    files.write_events(e, path)
    to, told = shared_path(spark, "event-counts"), "t_ms long, ev string, user_id long"
    counts = spark.readStream.schema(told).json(path).groupBy("ev").agg(F.count("*").alias("n"), F.max("t_ms").alias("last_ms"))
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(to))
    q.option("checkpointLocation", shared_path(spark, "event-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to)


@query(
    with_("sightings")
    + """select overlay, max(tick) as tick, bool_or(dialed_ok) as dialed_ok, arg_max(rtt_ms, seq) filter (where rtt_ms is not null) as rtt_ms from sightings group by 1"""
)
def sighting_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings streamed in micro-batches into a merged table equal the merge of all."""
    path = shared_path(spark, "sightings")
    s = D.sightings(spark, sf_dir)
    each = files.write_parts(s, path, 3)
    schema = ", ".join(f"{n} {t}" for n, t in s.dtypes)
    return state.merged_nodes(spark, state.merged_stream(spark, path, schema, files_per_trigger=each)).drop("underlays")


@query()
def account_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3/R4 as a stream with state, stopped and resumed twice; equals the query accounts, which tests check.

    Events come in three parts in order of seq; the stream ends after each and goes on from its checkpoint.
    """
    from tesserae.plans.history import account_events

    path, to = shared_path(spark, "account-events"), shared_path(spark, "accounts")
    e = account_events(spark, sf_dir)
    seq, checkpoint = F.col("seq"), shared_path(spark, "accounts-checkpoint")
    low, high = e.approxQuantile("seq", [1 / 3, 2 / 3], 0.01) or [0, 0]
    for part in (seq < low, (seq >= low) & (seq < high), seq >= high):
        e.where(part).write.mode("append").parquet(path)
        out = state.accounts(spark.readStream.schema(e.schema).parquet(path), 5000)
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(to))
        q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return aggregates.latest(spark.read.parquet(to), "peer", ["balance", "reserved", "refused", "events"], ["batch"])


@query(with_("chunks") + """select address, cast("index" as varchar) as "index" from chunks""")
def chunk_inventory_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory without a bad row; one would be an error."""
    path = shared_path(spark, "chunks-strict")
    D.chunks(spark, sf_dir).select("index", F.upper("address").alias("address_hex"), "data_len").write.option("header", True).csv(path)
    return files.read_chunks(spark, path, strict=True).select("address", "index")


@query(with_("nodes") + "select overlay, rtt_ms, node_no % 2 as run from nodes")
def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: two runs append to one table."""
    path = shared_path(spark, "measurements")
    n = D.nodes(spark, sf_dir).select("overlay", "rtt_ms", (F.col("node_no") % 2).alias("run"))
    for run in (0, 1):
        files.append_rows(n.where(F.col("run") == run), path)
    return spark.read.parquet(path)


@query(with_("nodes") + "select overlay, cast(node_no % 5 as varchar) as stake, 0 as out_of_order from nodes")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4/O3: the registry as files in order of overlay; out_of_order counts rows that come after a larger one of their file."""
    path = shared_path(spark, "registry")
    files.write_registry(D.nodes(spark, sf_dir).select("overlay", (F.col("node_no") % 5).alias("stake")), path)
    back = spark.read.option("header", True).csv(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag("overlay").over(Window.partitionBy("file").orderBy("at"))
    return back.withColumn("out_of_order", F.coalesce((before > F.col("overlay")).cast("int"), F.lit(0))).select("overlay", "stake", "out_of_order")


@query("select c_custkey as n, c_custkey * 1000 as threshold from customer where c_custkey % 5 <> 0 union all select c_custkey, null from customer where c_custkey % 5 = 0")
def wire_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: announced thresholds; every fifth message is cut short and announces nothing."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), (F.col("c_custkey") * 1000).alias("v"))
    body = F.concat(F.unhex(F.lit("0A08")), F.unhex(F.lpad(F.hex("v"), 16, "0")))
    sent = F.when(F.col("n") % 5 == 0, F.substring(body, 1, 6)).otherwise(body)
    return c.select("n", wire.threshold_of(sent).cast("bigint").alias("threshold"))
