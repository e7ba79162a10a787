"""Embedding near-dedup by an exact metric range join.

Vectors of a label are scaled to length one, where cosine >= c is distance <= r = sqrt(2 - 2c).
Pivots, far-apart vectors of a bounded sample, part them into cells: home is the nearest pivot. Let x
be at home with pivot h. What lies in the cell of pivot j is on j's side of the plane half-way
between both, and by the triangle inequality nothing within r of x is further from x than r, so x is
replicated to exactly the cells with

    (d(x, pj)^2 - d(x, pk)^2) / 2 d(pj, pk) <= r for every pivot k,

its distances to the planes that bound the cell. Each cell joins its home vectors with all that came,
on its own. Within a cell the distances to the pivot prune once more: two vectors within r differ by
at most r there, so a run of vectors sorted by that distance meets only its band.

Copies of a vector are one class with a count. A cell's home vectors fall into blocks, and so do all
its vectors; each of the former meets each of the latter in a group of bounded size. A task gives per
class its number of links and a spanning forest of what it linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tesserae.llm.graph import attached, components, with_lowest
from tesserae.llm.text import map_arrow, settled

#: Vectors of a block at home, and of a block of all that came to a cell.
HOMES, MEMBERS = 4096, 16_384
#: Room for rounding when distances decide what is replicated; the cosine itself decides what is linked.
SLACK = 1e-6


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kind_of(vectors: DataFrame) -> str:
    """How components are kept: single precision where the column has it, else double."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw): label as text, raw the components' bytes, null where the vector can't link."""
    kind = kind_of(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column(2).to_pylist():
                ok = bool(v) and None not in v
                a = np.array(v, kind) if ok else None
                if ok and not (np.isfinite(a).all() and a.any()):
                    ok = False
                raw.append((a + a.dtype.type(0)).tobytes() if ok else None)  # -0 is 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    label = F.col("label")
    if isinstance(vectors.schema["label"].dataType, FloatType | DoubleType):
        label = label + F.lit(0.0)  # -0 is 0
    return map_arrow(vectors.select("vec_id", label.cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")), pack, "vec_id long, label string, raw binary")


def pivots(groups: DataFrame, kind: str, per_cell: int = 1024, most: int = 64, in_all: int = 16_384, seed: int = 7) -> dict[tuple[str, int], np.ndarray]:
    """Pivots for each label and size that has over ``per_cell`` vectors: one for each so many, ``most`` at most.

    About four times as many are drawn by a hash of the vector, and of these each time the one that
    is farthest from those taken. Of all labels together about ``in_all`` are taken; those of the
    largest labels come first, and the others have a single cell.
    """
    kinds = groups.groupBy("label", F.octet_length("raw").alias("bytes")).agg(F.count("*").alias("n")).where(F.col("n") > per_cell)
    large = kinds.orderBy(F.col("n").desc(), "label", "bytes").limit(in_all // 2)
    share = settled(large.select("label", "bytes", F.least(F.lit(most), F.ceil(F.col("n") / per_cell)).alias("want"), "n"))
    want = {(r["label"], r["bytes"]): r["want"] for r in share.collect()}
    room = max(2, min(most, in_all // max(1, len(want))))
    drawn = groups.withColumn("bytes", F.octet_length("raw")).join(F.broadcast(share), ["label", "bytes"])  # at most in_all / 2 rows
    dice = F.pmod(F.xxhash64(F.lit(seed), "raw"), F.lit(1 << 30)) / float(1 << 30)
    found: dict[tuple[str, int], list] = {}
    for r in drawn.where(dice < 4 * F.least(F.col("want"), F.lit(room)) / F.col("n")).select("label", "bytes", "raw").toLocalIterator():
        found.setdefault((r["label"], r["bytes"]), []).append(bytes(r["raw"]))
    out = {}
    for k, v in found.items():
        of = _unit(sorted(v), kind)
        taken, far = [0], np.full(len(of), np.inf)
        while len(taken) < min(room, want[k], len(of)):
            far = np.minimum(far, 1 - of @ of[taken[-1]])
            taken.append(int(far.argmax()))
        out[k] = of[taken]
    return out


def reach(v: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of each unit vector among pivots, its distance to each, and whether a vector within r of it can be at home there."""
    square = np.maximum(0, 2 - 2 * (v @ p.T))
    home = square.argmin(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
    near = np.ones(square.shape, bool)
    for k in range(len(p)):
        # pivots that are equal have one cell, that of the first of them
        off = (square - square[:, k : k + 1]) / np.maximum(2 * apart[k], 1e-9)
        near &= (off <= r + SLACK) | (apart[k] < 1e-7)
    near[np.arange(len(v)), home] = True
    return home, np.sqrt(square), near


def _join(a: tuple, b: tuple, least: float, r: float, counts: dict, forest) -> None:  # noqa: ANN001
    """Links of block a (key, unit vectors, distance to the pivot) with block b (the same, size)."""
    keys, va, da = a
    others, vb, db, size = b
    order = np.argsort(db, kind="stable")
    near = db[order]
    rows = np.argsort(da, kind="stable")
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        lo, hi = np.searchsorted(near, (da[some[0]] - r - SLACK, da[some[-1]] + r + SLACK))
        band = order[lo:hi]
        if not len(band):
            continue
        ok = va[some] @ vb[band].T >= least
        ok &= keys[some][:, None] != others[band][None, :]
        for k in np.flatnonzero(ok.any(1)).tolist():
            to = band[ok[k]]
            counts[int(keys[some[k]])] = counts.get(int(keys[some[k]]), 0) + int(size[to].sum())
            forest.join(np.r_[keys[some[k]], others[to]])


def cells(groups: DataFrame, per_label: dict, r: float, kind: str) -> DataFrame:
    """(cell, key, raw, size, distance, home): each class at home and where a neighbour can be."""
    shared = groups.sparkSession.sparkContext.broadcast(per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size, key = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            kinds: dict[tuple, list[int]] = {}
            for k, x in enumerate(raw):
                kinds.setdefault((label[k], len(x)), []).append(k)
            for name, rows in kinds.items():
                p = shared.value.get(name)
                p = np.eye(1, name[1] // np.dtype(kind).itemsize) if p is None else p
                for lo in range(0, len(rows), 4096):
                    mine = np.array(rows[lo : lo + 4096])
                    home, d, near = reach(_unit([raw[k] for k in mine], kind), p, r)
                    i, j = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{name[1]}/{x}/{name[0]}" for x in j.tolist()], pa.string()), pa.array(key[mine[i]]), pa.array([raw[mine[k]] for k in i], pa.binary()), pa.array(size[mine[i]]), pa.array(d[i, j]), pa.array(home[i] == j)],
                        ["cell", "key", "raw", "size", "distance", "home"],
                    )

    return map_arrow(groups.select("label", "raw", "size", "key"), run, "cell string, key long, raw binary, size long, distance double, home boolean")


def links(groups: DataFrame, least: float, kind: str) -> DataFrame:
    """(a, b, key, n): links of a spanning forest between keys of classes, and as other rows parts of a class's number of links."""
    from tesserae.llm.simhash import Forest

    r = math.sqrt(max(0.0, 2 - 2 * least))
    dealt = settled(cells(groups, pivots(groups, kind), r, kind))
    held = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count_if("home") / HOMES).cast("int").alias("lefts"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("rights")).where("lefts > 0")
    held = settled(held)
    total = held.agg(F.sum("n")).first()[0] or 0
    placed = attached(dealt, held, "cell", ["lefts", "rights"], total).where("lefts is not null")
    place = lambda seed, of: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(of)).cast("int")
    rest = ["cell", "key", "raw", "size", "distance"]
    left = placed.where("home").select(*rest, F.lit(True).alias("left"), place(1, "lefts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    right = placed.select(*rest, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), place(2, "rights").alias("j"))

    def run(group, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        forest, counts = Forest(), {}
        keys, size, d, at_left = (pdf[c].to_numpy() for c in ("key", "size", "distance", "left"))
        v = _unit(list(pdf["raw"]), kind) if len(pdf) else None
        a, b = np.flatnonzero(at_left), np.flatnonzero(~at_left.astype(bool))
        _join((keys[a], v[a], d[a]), (keys[b], v[b], d[b], size[b]), least, r, counts, forest)
        two = np.array(forest.links, np.int64).reshape(-1, 2)
        nothing = [None] * len(two)
        return pd.DataFrame(
            {"a": pd.array([*two[:, 0], *[None] * len(counts)], "Int64"), "b": pd.array([*two[:, 1], *[None] * len(counts)], "Int64"), "key": pd.array([*nothing, *counts], "Int64"), "n": pd.array([*nothing, *counts.values()], "Int64")}
        )

    return left.union(right).groupBy("cell", "i", "j").applyInPandas(run, "a long, b long, key long, n long")


def near_groups(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine in double precision is
    at least ``least``. Labels may be of any type that has a text. A vector that is null, empty or
    zero or has null or non-finite components, and one without a label, links with nothing and is
    its own component. Vectors of different lengths don't link. Rows with one vec_id, or without
    any, count as vectors of their own; a null id names no component and isn't kept. Cosines that
    tie with ``least`` link. An empty table gives an empty one. Vectors are told apart by 64-bit
    hashes of label and components; should two share one, this raises.
    """
    kind = kind_of(vectors)
    usable = F.col("raw").isNotNull() & F.col("label").isNotNull()
    rows = settled(classes(vectors).withColumn("key", F.when(usable, F.xxhash64("label", "raw"))))
    groups = rows.where("key is not null").groupBy("label", "raw", "key").agg(F.count("*").alias("size"), F.min("vec_id").alias("low"))
    groups = settled(groups.select("label", "raw", "size", "key", "low"))
    if not groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise RuntimeError("two different vectors have one hash")
    found = settled(links(groups, least, kind))
    total = rows.count()
    n = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    part = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "key")
    all_ = groups.select("key", "size", "low").join(n, "key", "left").join(part, "key", "left")
    all_ = all_.select("key", "low", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "key").alias("part"))
    named = with_lowest(all_, "part", "low", "component_id", total)
    some = attached(rows.where("key is not null").select("vec_id", "key"), named, "key", ["n_links", "component_id"], total, n="size").select("vec_id", "n_links", "component_id")
    out = some.union(rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
