"""Bounded crawl of a gossip graph, hash-tree walk, and the greedy dispatch simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import settled


def crawl(seeds: DataFrame, edges: DataFrame, most_dials: int, dead: DataFrame | None = None, most_levels: int | None = None) -> DataFrame:
    """G1: breadth-first crawl from seeds (peer) over edges (src, dst); (peer, level, seq, dialed, ok, stop).

    Peers are visited once, in order of (level, who announced them, id), and dialled while fewer than
    most_dials were; a dead peer's dial fails and expands nothing. seq is the place in the queue.
    Each level is a join, with the visited set cut in the shared folder. stop is why the crawl ended:
    drained (nobody is left to expand), dials (most_dials left peers undialled) or levels (most_levels,
    where the caller gives one, left peers unexpanded).
    """
    nothing = seeds.sparkSession.createDataFrame([], "peer long")
    dead = (nothing if dead is None else dead.select("peer").distinct()).withColumn("dead", F.lit(True))

    def queued(df: DataFrame, level: int, before: int) -> DataFrame:
        # dials in a level go by (announcer's place, id); one level's frontier is at most most_dials peers that are expanded
        w = Window.orderBy("via", "peer")
        ranked = df.orderBy("via", "peer").limit(max(0, most_dials - before)).withColumn("seq", F.row_number().over(w) + F.lit(before))
        rest = df.join(ranked.select("peer"), "peer", "left_anti").withColumn("seq", F.lit(None).cast("int"))
        out = ranked.union(rest.select(ranked.columns)).join(dead, "peer", "left")
        dialed = F.col("seq").isNotNull()
        return out.select("peer", F.lit(level).alias("level"), "seq", dialed.alias("dialed"), (dialed & F.col("dead").isNull()).alias("ok"))

    seen = settled(queued(seeds.select("peer").distinct().withColumn("via", F.lit(0)), 0, 0))
    front, dials = seen, seen.where("dialed").count()
    stop, level = "drained", 0
    while True:
        if most_levels is not None and level >= most_levels:
            stop = "drained" if front.where("ok").isEmpty() else "levels"
            break
        level += 1
        told = edges.join(front.where("ok").select(F.col("peer").alias("src"), F.col("seq").alias("via")), "src").groupBy(F.col("dst").alias("peer")).agg(F.min("via").alias("via"))
        front = settled(queued(told.join(seen.select("peer"), "peer", "left_anti"), level, dials))
        if front.isEmpty():
            break
        dials += front.where("dialed").count()
        seen = settled(seen.union(front))
    if stop == "drained" and not seen.where("not dialed").isEmpty():
        stop = "dials"
    return seen.withColumn("stop", F.lit(stop))


def tree_walk(nodes: DataFrame, root: str, first: int = 0, last: int | None = None, most_levels: int = 16) -> DataFrame:
    """Leaves under a root in order; nodes: (address, child, at, span, leaf) with ``at`` the child's first byte. A range prunes on the way down."""
    front = nodes.sparkSession.createDataFrame([(root, 0)], "address string, base long")
    out = None
    for _ in range(most_levels):
        kids = nodes.join(front, "address").withColumn("base", F.col("base") + F.col("at"))
        if last is not None:
            kids = kids.where((F.col("base") < last) & (F.col("base") + F.col("span") > first))
        kids = settled(kids.select("child", "base", "span", "leaf"))
        leaves = kids.where("leaf")
        out = leaves if out is None else out.union(leaves)
        front = kids.where("not leaf").select(F.col("child").alias("address"), "base")
        if front.isEmpty():
            break
    return out


def dispatch(buckets: DataFrame, members: DataFrame, slots: int) -> DataFrame:
    """The order in which a fixed number of slots is given to nodes, greedily, until no bucket can take one.

    buckets: (prefix, remaining); members: (prefix, overlay, rate, rank). At each step the most
    critical bucket (remaining over the rate at work on it; none at work comes first) gets its best
    unused member. Each choice depends on those before it, so the buckets' small table is one
    group; what is sent there are ``slots`` members of a bucket at most, the result of a parallel rank.
    """
    few = members.where(F.col("rank") <= slots).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("rank", "overlay", "rate"))).alias("members"))
    table = buckets.join(few, "prefix").select(F.lit(1).alias("one"), "prefix", "remaining", F.transform("members", lambda m: m["overlay"]).alias("overlays"), F.transform("members", lambda m: m["rate"]).alias("rates"))

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        left = {r.prefix: [int(r.remaining), 0, 0, list(r.overlays), list(r.rates)] for r in pdf.itertuples()}
        out = []
        while len(out) < slots:
            ready = [(b[1] > 0, -(b[0] * 10_000 // b[1]) if b[1] else -b[0], p) for p, b in left.items() if b[0] > 0 and b[2] < len(b[3]) and not (b[0] < 30 and b[2])]
            if not ready:
                break
            p = min(ready)[2]
            b = left[p]
            out.append((len(out) + 1, p, b[3][b[2]], int(b[4][b[2]])))
            b[1], b[2] = b[1] + int(b[4][b[2]]), b[2] + 1
        return pd.DataFrame(out, columns=["step", "prefix", "overlay", "rate"])

    return table.groupBy("one").applyInPandas(run, "step int, prefix long, overlay string, rate long")
