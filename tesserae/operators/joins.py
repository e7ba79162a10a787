"""Joins of content and nodes. Comparisons by proximity are written as equi-joins on a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.address import MAX_PO, first_dialable, neighborhood, proximity


def _keyed(df: DataFrame, address: str, depth: int) -> DataFrame:
    if not 0 <= depth <= MAX_PO:
        raise ValueError("a prefix join is for depth 0 to 31")
    return df.withColumn("prefix", neighborhood(address, depth))


def storers(chunks: DataFrame, nodes: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Each chunk with the nodes that cover it and their rank by round trip, unmeasured last, ties by overlay; the first ``most``, or all.

    The order of nodes is the same for all chunks of a prefix, so nodes are ranked within it, before
    chunks are joined: what is sorted are nodes, and nothing beyond ``most`` of a prefix meets a chunk.
    Without ``most`` there are as many rows as pairs: nodes pass by in order of rank, each with all its
    chunks in a row, so that in columnar files an overlay and a rank are written once for each run.
    """
    order = Window.partitionBy("prefix").orderBy(F.col("rtt_ms").asc_nulls_last(), "overlay")
    ranked = _keyed(nodes, "overlay", depth).withColumn("rank", F.row_number().over(order))
    chunks = _keyed(chunks, "address", depth)
    if most is not None:
        return chunks.join(ranked.where(F.col("rank") <= most), "prefix")
    return ranked.hint("merge").join(chunks, "prefix")  # a merge join streams its left side


def covered(chunks: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Chunks that some node covers."""
    prefixes = _keyed(nodes, "overlay", depth).select("prefix").distinct()
    return _keyed(chunks, "address", depth).join(prefixes, "prefix", "left_semi")


def uncovered(chunks: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Chunks that no node covers; they go to the fallback channel or are dropped."""
    prefixes = _keyed(nodes, "overlay", depth).select("prefix").distinct()
    return _keyed(chunks, "address", depth).join(prefixes, "prefix", "left_anti")


def routed(chunks: DataFrame, nodes: DataFrame, depth: int, failed: DataFrame | None = None) -> DataFrame:
    """Every chunk with its channel: direct where covered, otherwise (or where direct failed) fallback."""
    prefixes = _keyed(nodes, "overlay", depth).select("prefix").distinct().withColumn("covered", F.lit(True))
    out = _keyed(chunks, "address", depth).join(prefixes, "prefix", "left")
    ok = F.coalesce("covered", F.lit(False))
    if failed is not None:
        out = out.join(failed.select("address").distinct().withColumn("failed", F.lit(True)), "address", "left")
        ok = ok & ~F.coalesce("failed", F.lit(False))
    return out.withColumn("channel", F.when(ok, "direct").otherwise("fallback")).drop("covered", "failed")


def with_work(nodes: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
    """Nodes whose bucket has chunks."""
    return _keyed(nodes, "overlay", depth).join(_keyed(chunks, "address", depth).select("prefix").distinct(), "prefix", "left_semi")


def with_state(nodes: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Nodes with what is remembered of them, defaults where nothing is."""
    out = nodes.join(state, key, "left")
    zero = {c: 0 for c, t in state.dtypes if c != key and t in ("bigint", "int", "double") and c != "lambda_ms"}
    return out.fillna(zero)


def resolved(overlays: DataFrame, book: DataFrame) -> DataFrame:
    """Overlays with their addresses; those without any are left out."""
    return overlays.join(book, "overlay").where(F.size("underlays") > 0)


def warm(nodes: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Nodes that have a live connection in the pool."""
    return nodes.join(pool.where("alive").select(key), key, "left_semi")


def dialable_staked(registry: DataFrame, directory: DataFrame, cache: DataFrame) -> DataFrame:
    """Staked overlays with an address, from the directory or else the cache."""
    out = registry.where(F.col("stake") > 0).join(directory.withColumnRenamed("underlay", "listed"), "overlay", "left")
    out = out.join(cache.select("overlay", first_dialable("underlays").alias("known")), "overlay", "left")
    return out.withColumn("underlay", F.coalesce("listed", "known")).drop("listed", "known").where("underlay is not null")


def not_stored(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """what a resumed run still needs."""
    return chunks.join(stored.select("address").distinct(), "address", "left_anti")


def near(chunks: DataFrame, overlay: str, least: int) -> DataFrame:
    """chunks at proximity ``least`` or more of an overlay."""
    return chunks.where(proximity(F.col("address"), F.lit(overlay)) >= least)


def mismatched(cache: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """entries whose overlay isn't the one that answered."""
    return cache.join(observed.select(key, F.col("overlay").alias("answered")), key).where(F.col("overlay") != F.col("answered"))
