"""Near duplicates by exact similarity: candidates by SimHash anchors and by MinHash bands, each verified on the texts.

Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is at
least 0.8. At that similarity 64-bit fingerprints differ by about ten bits, too many for anchors, so
fingerprints within ``most`` bits only bring the closest copies together; the others come from 32
bands of 5 MinHash rows, of which a pair at similarity 0.8 has one in common but for three in 10^6.

Texts that share a band, a fingerprint or a link of fingerprints are a group; groups of the same
texts count once. Their shingles meet in blocks of bounded size, and each block gives back a spanning
forest of the pairs that are similar enough, found by an index of its shingles; pairs that are known
to be in one tree aren't looked at. No pair leaves a task unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.graph import attached, components, with_lowest
from tesserae.llm.text import alone, blocks, map_arrow, settled, text_hash, texts_of, width

BANDS, ROWS = 32, 5
#: Texts of a block, and bytes of its shingles.
BLOCK, BLOCK_BYTES = 1024, 4_000_000
_DRAW = np.random.default_rng(8)
_MIX = _DRAW.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _DRAW.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def words_of(text: str | None) -> list[bytes]:
    """As fingerprints see them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted hashes of all runs of k words; of fewer words the whole, of none nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - k + 1)
    start, stop = np.r_[0, end[: n - 1]].tolist(), (end[min(k, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.frombuffer(b"".join(xxhash.xxh3_64_digest(joined[a:b]) for a, b in zip(start, stop, strict=True)), ">u8").astype(np.uint64))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, int64 [BANDS]; of no shingles none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low, short = np.full(BANDS * ROWS, ~np.uint32(0)), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        low = np.minimum(low, (short[at : at + 512, None] * _MIX + _SHIFT).min(0))
    return np.array([xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(None)
        for batch in batches:
            for b in blocks(batch, most=2_000_000):
                texts = texts_of(b)
                fp = simhash.fingerprints_of(texts).view(">i8").reshape(-1).astype(np.int64)
                split = [words_of(t) for t in texts]
                sets = [shingle_set(w, words) for w in split]
                keys = [bands_of(x).tolist() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([words_hash(w) for w in split], pa.int64()), pa.array(fp), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "th", "w", "fp", "size", "bands"],
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, so that copies aren't sent where their text is wanted."""
    seen: set[int] = set()
    for b in batches:
        keys = [words_hash(words_of(t)) for t in texts_of(b)]
        new = [w not in seen and not seen.add(w) for w in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0)], ["w", "text"]).filter(pa.array(new, pa.bool_()))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, most=2_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(words_of(t), words).tobytes() for t in texts_of(b)], pa.binary())], ["w", "shingles"])

    return run


def forest_of(forest: simhash.Forest, w: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> None:
    """Joins texts whose sets are similar enough: all of them with each other, or where sides differ only those of different sides."""
    n, both = len(w), bool((side != side[0]).any())
    size = np.array([len(x) for x in sets])
    label = np.arange(n)
    every, of = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(n), size)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(every) + 1))
    member_of = member[order]
    edge = np.r_[0, np.cumsum(size)]
    for i in range(n - 1):
        far = label != label[i]
        far[: i + 1] = False
        far &= (size >= least * size[i]) & (least * size <= size[i])
        if both:
            far &= side != side[i]
        if not far.any():
            continue
        ids = of[edge[i] : edge[i + 1]]
        lo, count = begin[ids], begin[ids + 1] - begin[ids]
        place = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        common = np.bincount(member_of[place], minlength=n)
        hit = np.flatnonzero(far & (common / (size + size[i] - common) >= least))
        if len(hit):
            forest.join(np.r_[w[i], w[hit]])
            label[np.isin(label, label[hit])] = label[i]


def _verified(least: float):
    """Over rows sorted by (band, lo, hi): the links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(None)
        forest = simhash.Forest()
        key, held = None, []

        def closed() -> None:
            if len(held) > 1:
                w, sets, side = zip(*held, strict=True)
                forest_of(forest, np.array(w), [np.frombuffer(x.as_buffer(), np.uint64) for x in sets], np.array(side), least)

        def out() -> pa.RecordBatch:
            two = np.array(forest.links, np.int64).reshape(-1, 2)
            forest.links = []
            return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["a", "b"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), strict=True):
                if r[:3] != key:
                    closed()
                    key, held = r[:3], []
                held.append((r[4], r[5], r[3]))
            if len(forest.links) > 50_000:
                yield out()
        closed()
        yield out()

    return run


def similar_groups(docs: DataFrame, least: float = 0.8, words: int = 5, most: int = 4) -> DataFrame:
    """(doc_id, th, component_id, group) of every document, as simhash.near_groups; links are similarities of at least ``least``.

    Texts of equal words are one. Texts of up to ``words`` words are one shingle; those without any,
    null ones too, are copies of each other. A text of any length counts whole, and must fit in a
    worker as its shingles. Similarities that tie with ``least`` link; repeated rows share a group;
    an empty table gives an empty one.
    """
    per_doc = map_arrow(docs.select("doc_id", text_hash().alias("th"), "text"), _rows(words), "doc_id long, th long, w long, fp long, size long, bands array<long>")
    per_doc = settled(per_doc)
    total = per_doc.count()
    texts = settled(per_doc.groupBy("w").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))

    # groups of candidates, by the key of what they share
    by_fp = settled(texts.groupBy("fp").agg(F.min("w").alias("w"), F.min_by("size", "w").alias("size")))
    near = settled(simhash.links(by_fp, most))
    ends = near.select(F.xxhash64("a", "b").alias("band"), F.explode(F.array("a", "b")).alias("fp"))
    named = ends.groupBy("fp").agg(F.count("*").alias("n")).join(by_fp, "fp")
    ends = attached(ends, named, "fp", ["w", "size"], 2 * near.count())
    shares = texts.select("w", "size", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("fp"), "fp")))).alias("band")).union(ends.select("w", "size", "band"))
    kinds = shares.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("w")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(3), "w"), 24)).alias("s")).where("n > 1")
    kinds = kinds.groupBy("n", "size", "x", "s").agg(F.min("band").alias("band"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int")
    kinds = settled(kinds.select("band", "n", parts.alias("parts")))
    held = settled(attached(shares.select("band", "w"), kinds, "band", ["parts"], (BANDS + 1) * total).where("parts is not null"))

    used = settled(held.groupBy("w").agg(F.count("*").alias("n")))
    some = map_arrow(docs.select("text"), _keyed, "w long, text string").join(used.select("w"), "w", "left_semi").groupBy("w").agg(F.first("text").alias("text"))
    sets = map_arrow(some, _sets(words), "w long, shingles binary").join(used, "w")
    placed = attached(held, sets, "w", ["shingles"], held.count()).withColumn("k", F.pmod(F.xxhash64("w", F.lit(1)), F.col("parts")).cast("int"))
    cells = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("band", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k", "w", "shingles")
    cells = cells.repartition(width(docs.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    part = components(map_arrow(cells, _verified(least), "a long, b long"))

    named = texts.join(part.withColumnRenamed("node", "w"), "w", "left").select("w", "n", "low", F.coalesce("component", "w").alias("part"))
    named = with_lowest(named, "part", "low", "component_id", total).select("w", "n", "part", "component_id")
    return attached(per_doc.select("doc_id", "th", "w"), named, "w", ["component_id", "part"], total).select("doc_id", "th", "component_id", F.col("part").alias("group"))
