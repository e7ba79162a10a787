"""Connected components of a link table, wholly on executors, and joins that a hot key doesn't gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.text import OWN, settled, width


def attached(rows: DataFrame, table: DataFrame, key: str, values: list[str], total: int, n: str = "n") -> DataFrame:
    """rows with the values of the table's row for their key (never null; unique in the table) added, null where it has none.

    The table says in ``n`` how many of the ``total`` rows a key has. Keys of more than a quarter of
    a partition's share are at most four times as many as there are partitions; these are broadcast,
    and their rows spread over all tasks by a hash, so no key is more than that in one task.
    """
    j, hot_value, value = (OWN + x for x in ("j", "hot", "value"))
    most = max(64, total // (4 * width(rows.sparkSession)))
    hot = F.broadcast(table.where(F.col(n) > most).select(F.col(key).alias(OWN + "k"), F.struct(*values).alias(hot_value)))
    out = rows.join(hot, F.col(key) == F.col(OWN + "k"), "left")
    spread: Column = F.xxhash64(*[c for c in rows.columns if c != key], F.lit(11)) if len(rows.columns) > 1 else F.xxhash64(F.rand(11))
    out = out.withColumn(j, F.when(F.col(OWN + "k").isNull(), F.col(key)).otherwise(spread.cast(rows.schema[key].dataType))).drop(OWN + "k")
    out = out.join(table.select(F.col(key).alias(j), F.struct(*values).alias(value)), j, "left")
    found = F.coalesce(hot_value, value)
    return out.select(*rows.columns, *[found[v].alias(v) for v in values])


def with_lowest(rows: DataFrame, key: str, value: str, name: str, total: int) -> DataFrame:
    """rows with the smallest value of their key added; a map-side combined minimum, joined back by ``attached``."""
    low = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("n"))
    return attached(rows, low, key, [name], total)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b: longs), component being the smallest node it reaches.

    Alternates large-star and small-star steps. Each is a map-side combined minimum that is joined
    back with the hot nodes broadcast, so the centre of a star of any size is no hot key. Takes a
    number of rounds that is logarithmic in the longest path. Raises if it hasn't ended after
    ``most_rounds``. Null ends and links of a node with itself are no links; no links, no nodes.
    """
    edges = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_lowest(both, "a", "b", "m", 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = with_lowest(large, "a", "b", "m", n)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = settled(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.count_distinct("a").alias("nodes")).first()
        n = now["n"]
        if now == was or n == now["nodes"] and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        was = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
