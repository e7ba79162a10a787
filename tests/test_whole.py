"""Queries without the bounds that their samples have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.operators import aggregates, graph, joins
from tesserae.sources import domain, files
from tesserae.streaming import state
from tests.oracle import DATA, connect, differences

SF = "sf0.001"
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_crawl_says_why_it_stopped(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    seed = spark.createDataFrame([(0,)], "peer long")
    stop = lambda *a, **k: [(r.n, r.stop) for r in graph.crawl(seed, chain, *a, **k).groupBy("stop").agg({"peer": "count"}).withColumnRenamed("count(peer)", "n").collect()]
    assert stop(100) == stop(100, most_levels=6) == [(6, "drained")]
    assert stop(100, most_levels=3) == [(4, "levels")] and stop(2) == [(3, "dials")]


@needs_tables
def test_crawl_of_all_edges(spark):
    con = connect(SF)
    n = con.sql("select count(*) from supplier").fetchall()[0][0]
    told: dict[int, set[int]] = {}
    for a, b in con.sql(f"select distinct l_suppkey, l_partkey % {n} + 1 from lineitem").fetchall():
        told.setdefault(a, set()).add(b)
    level, front = {1: 0}, [1]
    while front:
        front = sorted({b for a in front if a % 7 != 3 for b in told.get(a, ())} - set(level))
        level |= dict.fromkeys(front, 1 + max(level.values()))
    got = {r.peer: (r.level, r.ok, r.stop) for r in catalog.QUERIES["gossip_crawl_whole"](spark, f"{DATA}/{SF}").collect()}
    assert got == {p: (at, p % 7 != 3, "drained") for p, at in level.items()}


@needs_tables
def test_storers_beyond_the_third(spark):
    many = f"{DATA}/sf0.01"
    got = catalog.QUERIES["storers_whole"](spark, many)
    pairs = catalog.QUERIES["storers"](spark, many)
    assert got.where("rank > 3").count() > 0 and not got.where("rank <= 3").exceptAll(pairs).count() and not pairs.exceptAll(got).count()
    assert 0.8 < catalog.QUERIES["chunk_index_file_whole"](spark, many).count() / domain.chunks(spark, many).count() < 0.95


@needs_tables
def test_accounts_and_their_stream(spark):
    limit, now = 5000, {}
    for user, event, amount in connect(SF).sql("select user_id, event_id, cast(floor(abs(value)) as bigint) from events order by event_id").fetchall():
        debt, held, no, n = now.get(user, (0, 0, 0, 0))
        if event % 4 == 0 and debt + held + amount > limit:
            no += 1
        elif event % 4 == 0:
            held += amount
        elif event % 4 == 3:
            debt = max(debt - amount, 0)
        else:
            held, debt = max(held - amount, 0), debt + amount * (event % 4 == 1)
        now[user] = debt, held, no, n + 1
    for name in ("accounts", "account_stream"):
        got = catalog.QUERIES[name](spark, f"{DATA}/{SF}").collect()
        assert {r.peer: (r.balance, r.reserved, r.refused, r.events) for r in got} == now and len(got) == len(now)


@needs_tables
def test_pipeline_depth(spark):
    want: dict[int, tuple[int, int]] = {}
    for r in sorted(domain.observations(spark, f"{DATA}/{SF}").select("peer", "ts", "event_id").collect(), key=lambda r: (r.ts, r.event_id)):
        depth, run = want.get(r.peer, (2, 0))
        if r.event_id % 9 == 0:
            depth, run = max(2, depth // 2), 0
        elif run + 1 >= 8 and depth < 16:
            depth, run = depth + 1, 0
        else:
            run += 1
        want[r.peer] = depth, run
    got = {r.peer: r.depth for r in catalog.QUERIES["pipeline_depth"](spark, f"{DATA}/{SF}").collect()}
    assert got == {p: d for p, (d, _) in want.items()} and max(got.values()) > 2


def test_merged_stream(spark, tmp_path):
    """Batches of one file each merge to what all sightings give at once; a stream without a file ends too."""
    schema = "overlay string, seq long, tick long, dialed_ok boolean, rtt_ms int, underlay string"
    rows = [("a", 5, 1, False, None, "x"), ("a", 2, 9, False, 70, "y"), ("b", 1, 3, True, None, None), ("a", 3, 4, True, 60, "x"), ("b", 7, 2, False, 8, "z"), ("a", 9, 0, False, None, "y")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if k else "overwrite")
    want = [("a", 9, True, 60, ["y", "x"]), ("b", 3, True, 8, [None, "z"])]
    to = state.merged_stream(spark, f"{tmp_path}/in", schema)
    assert sorted(map(tuple, state.merged_nodes(spark, to).collect())) == want
    assert sorted(map(tuple, aggregates.upsert(spark.createDataFrame(rows, schema)).collect())) == want
    assert spark.read.parquet(to).count() == 4
    (tmp_path / "none").mkdir()
    assert state.merged_nodes(spark, state.merged_stream(spark, f"{tmp_path}/none", schema)).count() == 0


def test_storers_of_all_ranks_lie_by_node(spark):
    """A node's chunks come in a row, so files hold its overlay once for the run, and not 64 digits for each pair."""
    chunks = spark.range(3000).selectExpr("id as index", "sha2(concat('c', id), 256) as address")
    nodes = spark.range(500).selectExpr("sha2(concat('n', id), 256) as overlay", "if(id % 7 = 0, null, cast(id % 9 as int)) as rtt_ms")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which may swap the sides of a small join
    try:
        got = joins.storers(chunks, nodes, 4).select("index", "overlay", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    order = sorted((r.rtt_ms is None, r.rtt_ms or 0, r.overlay) for r in nodes.collect())
    near: dict[str, list[str]] = {}
    for *_, o in order:
        near.setdefault(o[0], []).append(o)
    want = [(r["index"], o, k) for r in chunks.collect() for k, o in enumerate(near.get(r.address[0], []), 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(a.overlay != b.overlay for a, b in zip(got, got[1:], strict=False)) + 1 == 500


@needs_tables
def test_sightings_are_written_without_a_shuffle(spark, monkeypatch):
    """No task gets a third of the table: files are as many as it takes, and three batches have all of them."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, triggers, write, merged = [], [], DataFrameWriter.parquet, state.merged_stream

    def parquet(self, path, *a, **k):
        plans.append((str(path), self._df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, path, *a, **k)

    def stream(spark, path, schema, files_per_trigger=1):
        triggers.append((len(spark.read.parquet(path).inputFiles()), files_per_trigger))
        return merged(spark, path, schema, files_per_trigger)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(state, "merged_stream", stream)
    got = catalog.QUERIES["sighting_stream"](spark, f"{DATA}/{SF}")
    (n, each), = triggers
    assert n >= 3 and each == -(-n // 3) and not [p for to, p in plans if "/sightings-" in to and "Repartition" in p]
    assert len([1 for to, _ in plans if "/merged-" in to]) == 3
    assert not differences(got, catalog.ORACLE_SQL["sighting_stream"], connect(SF))


def test_parts_have_bounded_files(spark, tmp_path):
    assert files.write_parts(spark.range(1000, numPartitions=2), f"{tmp_path}/a", 3, most=40) == 9
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/a").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) == 40
    assert files.write_parts(spark.range(0), f"{tmp_path}/none", 3) == 1 and spark.read.parquet(f"{tmp_path}/none").count() == 0
