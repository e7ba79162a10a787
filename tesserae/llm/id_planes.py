"""Token ids as bit planes in files.

The ids of all documents, in ascending order of doc_id, are cut into chunks of ``CHUNK`` ids. A
chunk's ids are transposed into bit planes (plane k has bit k of every id), as many as its largest
id needs, and each plane is compressed with zstandard by itself: high planes are nearly constant and
all but vanish. A file is a table of chunks written by Spark in the shared folder, with for each
chunk its place in the line of ids, its planes, and the documents that it overlaps: the chunk index.
A reader opens only the chunks that it needs.

Documents are dealt by range of doc_id; a task writes its own chunks, so a lost executor costs only
its tasks, and Spark's committer lets only whole files appear.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tesserae.llm.encode import encoder
from tesserae.llm.text import blocks, map_arrow, shared_path, ship, text_hash, width

CHUNK = 1 << 16
_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_CHUNKS = pa.schema([("file", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(_DOC))])
_CHUNKS_DDL = "file int, first long, n int, planes array<binary>, docs array<struct<doc_id:long,start:long,n:long>>"


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Compressed bit planes, the lowest bit first; the last byte of a plane is padded with zeros."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.packbits(ids & ids.dtype.type(1 << k) != 0, bitorder="little").tobytes()) for k in range(bits)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, "<u4")
    unpack = zstandard.ZstdDecompressor().decompress
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(unpack(p), np.uint8), bitorder="little", count=n).astype("<u4") << k
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every text (null: empty), puts end_id after each and writes the files at path. Rows with one doc_id stand in the order of a hash of their text; null ids come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, lib = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], lib.dtype)
        held: list[np.ndarray] = []
        inside: list[dict] = []
        first = line = 0

        def chunks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, inside, first
            ids = np.concatenate(held) if held else np.zeros(0, lib.dtype)
            at = 0
            while len(ids) - at >= CHUNK or last and at < len(ids):
                part = ids[at : at + CHUNK]
                at += len(part)
                mine = [d for d in inside if d["start"] < first + len(part)]
                yield pa.RecordBatch.from_pylist([{"file": file, "first": first, "n": len(part), "planes": to_planes(part), "docs": mine}], schema=_CHUNKS)
                first += len(part)
                inside = [d for d in inside if d["start"] + d["n"] > first]
            held = [ids[at:]]

        for batch in batches:
            for block in blocks(batch, most=2_000_000):
                for doc_id, ids in zip(block.column(0).to_pylist(), lib.encode(block.column(1).to_pylist()), strict=True):
                    held += [ids, end]
                    inside.append({"doc_id": doc_id, "start": line, "n": len(ids) + 1})
                    line += len(ids) + 1
                yield from chunks(False)
        yield from chunks(True)

    dealt = docs.select("doc_id", "text").repartitionByRange(width(docs.sparkSession), "doc_id")
    dealt = dealt.sortWithinPartitions(F.col("doc_id"), text_hash())
    map_arrow(dealt, run, _CHUNKS_DDL).write.mode("errorifexists").parquet(path)


#: The polynomial of crc32, lowest power in the highest bit.
_POLY = 0xEDB88320


def _product(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a whole from (crc32, bytes) of its parts in order."""
    out = 0
    for crc, n in parts:
        power, square, bits = 1 << 31, 1 << 30, 8 * n  # x^0 and x^1
        while bits:
            if bits & 1:
                power = _product(power, square)
            square, bits = _product(square, square), bits >> 1
        out = _product(out, power) ^ crc
    return out


@F.pandas_udf(LongType())
def _whole_crc(parts):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([p[0]["crc"] if len(p) == 1 else joined_crc([(x["crc"], x["n"]) for x in sorted(p, key=lambda x: x["at"])]) for p in parts])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, doc_start, doc_n, at, ids): the ids of each document's part in each chunk that it overlaps; starts count in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = from_planes(r["planes"], r["n"]).astype(np.int64)
                lo, hi = r["first"], r["first"] + r["n"]
                cut = [(max(lo, d["start"]), min(hi, d["start"] + d["n"])) for d in r["docs"]]
                parts = [ids[a - lo : z - lo] for a, z in cut]
                flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.array(np.concatenate(parts) if parts else ids[:0]))
                col = lambda k, r=r: pa.array([d[k] for d in r["docs"]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(parts), pa.int32()), col("doc_id"), col("start"), col("n"), pa.array([a for a, _ in cut], pa.int64()), flat], ["file", "doc_id", "doc_start", "doc_n", "at", "ids"])

    return map_arrow(spark.read.parquet(path), run, "file int, doc_id long, doc_start long, doc_n long, at long, ids array<long>")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                raw = from_planes(r["planes"], r["n"]).astype("<u4").tobytes()
                lo, hi = r["first"], r["first"] + r["n"]
                for d in r["docs"]:
                    a, z = max(lo, d["start"]), min(hi, d["start"] + d["n"])
                    rows.append((r["file"], d["doc_id"], d["start"], d["n"], a, 4 * (z - a), zlib.crc32(raw[4 * (a - lo) : 4 * (z - lo)])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["file", "doc_id", "doc_start", "doc_n", "at", "n", "crc"])

    ship(spark)
    chunks = spark.read.parquet(path)
    parts = map_arrow(chunks, run, "file long, doc_id long, doc_start long, doc_n long, at long, n long, crc long")
    docs = parts.groupBy("file", "doc_start").agg(F.first("doc_id").alias("doc_id"), F.first("doc_n").alias("n_tokens"), F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
    # one row per file
    before = chunks.groupBy("file").agg(F.sum("n").alias("ids"))
    before = before.select(F.col("file").cast("long").alias("file"), F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", _whole_crc("parts").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs as files in the shared folder and gives the summary read back from them. An empty table gives an empty result."""
    path = shared_path(docs.sparkSession, "id-planes")
    write_ids(docs, path, tokenizer, end_id)
    return summary(docs.sparkSession, path)
