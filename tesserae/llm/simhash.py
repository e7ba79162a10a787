"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into three segments; of two fingerprints that differ in at most
four bits, some segment differs in at most one (five bits or more would need two in each). In each
segment the anchors are a covering code: the perfect Hamming code of length 15 on the low bits,
every value of the others, so no point is more than one bit from its anchor. A fingerprint goes to
every anchor that can be the home of one that differs from it in one bit (within covering radius
plus one), and per anchor those at home are compared with all that came. Tasks give back a spanning
forest of what they linked, not the pairs.

Anchors with very many members are cut into blocks, and the blocks are compared two by two in
tasks of their own, so that nothing grows with the size of a group but the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.graph import attached, components, with_lowest
from tesserae.llm.text import OWN, alone, map_arrow, settled, text_hash, texts_of, width

BITS = 64
#: (first bit, number of bits) of the segments; each has one Hamming block of 15 bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE = 15
#: Rows of an anchor that one comparison holds.
BLOCK = 4096


def _nearest() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each of the 2^15 values its nearest codeword, and the codewords two bits from it."""
    v = np.arange(1 << CODE)
    syndrome = np.zeros_like(v)
    for k in range(CODE):  # the check matrix has the numbers 1 to 15 as its columns
        syndrome ^= np.where(v >> k & 1, k + 1, 0)
    near = np.where(syndrome, v ^ (1 << np.maximum(syndrome - 1, 0)), v)
    seconds = []
    for k in range(CODE):  # flip bit k, then the one that mends the rest; each pair is found from its lower bit
        other = syndrome ^ (k + 1)
        seconds.append(np.where((syndrome > 0) & (other > k + 1), v ^ (1 << k) ^ (1 << np.maximum(other - 1, 0)), -1))
    return near, seconds


_TABLES: list = []


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) of each replica; fps: uint64."""
    if not _TABLES:
        _TABLES.append(_nearest())
    near, seconds = _TABLES[0]
    out = []
    for k, (first, bits) in enumerate(SEGMENTS):
        part = (fps >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        low, high = part & ((1 << CODE) - 1), part >> CODE
        name = lambda code, rest, k=k: (np.int64(k) << 40) | (rest << CODE) | code
        out.append((name(near[low], high), fps, True))
        out += [(name(near[low], high ^ (1 << b)), fps, False) for b in range(bits - CODE)]
        for s in seconds:
            ok = s[low] >= 0
            out.append((name(s[low][ok], high[ok]), fps[ok], False))
    return np.concatenate([a for a, _, _ in out]), np.concatenate([f for _, f, _ in out]), np.concatenate([np.full(len(a), h) for a, _, h in out])


def fingerprints_of(texts: list[str | None], words: int = 4, seed: int = 42, most: int = 200_000) -> np.ndarray:
    """Big-endian fingerprints, uint8 [n, 8]."""
    out = np.zeros((len(texts), 8), np.uint8)
    digest = xxhash.xxh64_digest
    pend: list[tuple[int, list[bytes]]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pend:
            bits = np.unpackbits(np.frombuffer(b"".join(b"".join(d) for _, d in pend), np.uint8).reshape(-1, 8), axis=1)
            n = np.array([len(d) for _, d in pend])
            ones = np.add.reduceat(bits, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.int32)
            out[[k for k, _ in pend]] = np.packbits(2 * ones > n[:, None], axis=1)
        pend.clear()
        held = 0

    for k, t in enumerate(texts):
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= words:
            shingles = [digest(joined, seed)]
        else:
            end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            start = np.r_[0, end[: len(w) - words]].tolist()
            shingles = [digest(joined[a:b], seed) for a, b in zip(start, (end[words - 1 :] - 1).tolist(), strict=True)]
        if len(shingles) > most:  # a very long text: counted in parts
            ones, n = np.zeros(BITS, np.int64), len(shingles)
            for at in range(0, n, most):
                ones += np.unpackbits(np.frombuffer(b"".join(shingles[at : at + most]), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > n)
            continue
        pend.append((k, shingles))
        held += len(shingles)
        if held >= most:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, th, fp) of every document; fp as a signed 64-bit number, 0 for a text without words or a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(None)
        for b in batches:
            fp = fingerprints_of(texts_of(b), words).view(">i8").reshape(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    return map_arrow(docs.select("doc_id", text_hash().alias("th"), "text"), run, "doc_id long, th long, fp long")


class Forest:
    """Union-find over fingerprints that keeps only links that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, fps: np.ndarray) -> None:
        first, *rest = fps.tolist()
        a = self.root(first)
        for x in rest:
            b = self.root(x)
            if a != b:
                self.up[b] = a
                self.links.append((first, x))


def compare(forest: Forest, homes: np.ndarray, rows: np.ndarray, most: int) -> None:
    """Joins each of homes to those of rows that differ from it in at most ``most`` bits."""
    label = np.arange(len(rows))  # rows known to be linked share the index of one of them
    step = max(1, (1 << 20) // max(1, len(rows)))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        close = np.bitwise_count(some[:, None] ^ rows[None, :]) <= most
        for k in np.flatnonzero(close.any(1)).tolist():
            near = label[close[k]]
            low = near.min()
            if (near != low).any():
                of = np.unique(near)
                forest.join(rows[of])
                label[np.isin(label, of)] = low
            if rows[low] != some[k]:
                forest.join(np.array([rows[low], some[k]]))


_EDGES = "a long, b long, anchor long, task long, part long, homes binary, members binary"
_ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("task", pa.int64()), ("part", pa.int64()), ("homes", pa.binary()), ("members", pa.binary())])


def _per_anchor(most: int):
    """Over rows sorted by anchor: links of whole anchors, and as blocks those that may go on in another task or are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        forest, blocks, part = Forest(), [], 0
        key, first, split = None, True, False
        fps = np.zeros(0, np.uint64)
        home = np.zeros(0, bool)

        def block() -> None:
            nonlocal part
            if len(fps):
                blocks.append((None, None, int(key), task, part, fps[home].tobytes(), fps.tobytes()))
                part += 1

        def closed(last: bool) -> None:
            if key is not None and (first or last or split):
                block()
            elif key is not None and home.any() and len(fps) > 1:
                compare(forest, fps[home], fps, most)

        def out() -> pa.RecordBatch:
            rows = [(a, b, None, None, None, None, None) for a, b in np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64).tolist()] + blocks
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROWS)
            forest.links, blocks[:] = [], []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

        for b in batches:
            if not b.num_rows:
                continue
            anchor, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at_home = b.column(2).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            end = np.r_[start[1:], len(anchor)]
            for lo, hi in zip(start.tolist(), end.tolist(), strict=True):
                if anchor[lo] != key:
                    closed(False)
                    first = key is None
                    key, split, fps, home = anchor[lo], False, fp[lo:hi], at_home[lo:hi]
                else:
                    fps, home = np.r_[fps, fp[lo:hi]], np.r_[home, at_home[lo:hi]]
                while len(fps) > BLOCK:
                    rest, rest_home = fps[BLOCK:], home[BLOCK:]
                    fps, home, split = fps[:BLOCK], home[:BLOCK], True
                    block()
                    fps, home = rest, rest_home
            if len(forest.links) > 50_000 or len(blocks) > 64:
                yield out()
        closed(True)
        yield out()

    return run


def _between_blocks(most: int):
    def run(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        forest = Forest()
        sides = [(np.frombuffer(h, np.uint64), np.frombuffer(m, np.uint64)) for h, m in zip(pdf.homes, pdf.members, strict=True)]
        for i, (h, _) in enumerate(sides):
            for j, (_, m) in enumerate(sides):
                if (i != j) == (len(sides) > 1):
                    compare(forest, h, m, most)
        return pd.DataFrame(np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return run


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints (column fp) that differ in at most ``most`` (up to 5) bits."""
    if most >= 2 * len(SEGMENTS):
        raise ValueError(f"three segments find at most {2 * len(SEGMENTS) - 1} differing bits")

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 20_000):
                anchor, f, home = anchors_of(fp[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(f.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    dealt = map_arrow(fps.select("fp"), replicas, "anchor long, fp long, home boolean")
    dealt = dealt.repartitionByRange(width(fps.sparkSession), "anchor", "fp").sortWithinPartitions("anchor", "fp")
    rows = settled(map_arrow(dealt, _per_anchor(most), _EDGES))
    found = rows.where("a is not null").select("a", "b")
    blocks = rows.where("anchor is not null").select("anchor", "task", "part", "homes", "members")
    place = blocks.select("anchor", "task", "part", F.row_number().over(Window.partitionBy("anchor").orderBy("task", "part")).alias("k"))
    count = place.groupBy("anchor").agg(F.max("k").alias("n"))
    cells = blocks.join(place.join(count, "anchor"), ["anchor", "task", "part"])
    # each two blocks meet in one cell, and a block meets itself in one of its own
    cells = cells.select("anchor", "homes", "members", "k", F.explode(F.sequence(F.lit(1), "n")).alias("j"))
    cells = cells.select("anchor", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "homes", "members")
    return found.union(cells.groupBy("anchor", "lo", "hi").applyInPandas(_between_blocks(most), "a long, b long"))


def near_groups(docs: DataFrame, most: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, th, fp, component_id, group) of every document; th tells rows with one doc_id apart.

    component_id is the smallest doc_id that links of at most ``most`` differing bits reach. Copies
    and repeated rows share a fingerprint and so a component. Texts that are null, empty or without
    words have fingerprint 0 and link as any other. A null doc_id is in its component but can't name it.
    A text of any length counts whole; an empty table gives an empty one.
    """
    per_doc = settled(fingerprints(docs, words))
    total = per_doc.count()
    fps = settled(per_doc.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    parts = components(links(fps, most))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "low", F.coalesce("component", "fp").alias("part"))
    named = with_lowest(named, "part", "low", "component_id", total).select("fp", "n", "part", "component_id")
    return attached(per_doc, named, "fp", ["component_id", "part"], total).select("doc_id", "th", "fp", "component_id", F.col("part").alias("group"))


def one_of_each(docs: DataFrame, most: int = 4, groups: DataFrame | None = None) -> DataFrame:
    """The documents that stay: of each group of near duplicates the one with the smallest doc_id (of rows that share it, one).

    groups: (doc_id, th, component_id, group) of every document, if not near_groups'. A null text is
    a document without words, and in a group with others like it. A row without a doc_id stays only
    where its whole group has none. An empty table stays empty.
    """
    keys = [OWN + "id", OWN + "no_id", OWN + "th"]
    # keys that are never null, so that the join's partitioning serves to leave one of repeated rows too
    named = lambda th: [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), th]
    stay = (near_groups(docs, most) if groups is None else groups).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("group"))).agg(F.min("th").alias("th")).select(*[c.alias(k) for c, k in zip(named(F.col("th")), keys, strict=True)])
    tagged = docs.withColumns(dict(zip(keys, named(text_hash()), strict=True)))
    return tagged.join(stay, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
