"""Line dedup: lines common to many documents go; what comes back is a bitmap per document, not text.

Line hashes (128 bits) are dealt by range of (hash, document) and sorted by document and position
within it. Each task streams its runs of equal hashes. As the document is part of the range key, a
line that a third of all documents have is spread over many tasks; only the first and the last run
of a task can go on in another one, and these few are settled by a small sum over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tesserae.llm.text import BLANKS, LOWER, OWN, UPPER, alone, blocks, ddl, map_arrow, settled, ship, text_hash, width, with_columns

_ROWS = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])
#: Kinds of streamed rows: a decided drop, an undecided one of an edge run, an edge run's count, its first row.
DROP, OPEN, COUNT, HEAD = 0, 1, 2, 3


def bare(line: Column) -> Column:
    """The line without blanks at its ends; btrim, which reads a line character by character, sees only lines that have some."""
    ends = F.substring(line, 1, 1).isin(*BLANKS) | F.substring(line, -1, 1).isin(*BLANKS)
    return F.when(ends, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def lowered(line: Column) -> Column:
    """A-Z lower-cased. Of ASCII lines that is lower(), which is faster than translate()."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    split = docs.select("doc_id", text_hash().alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    # lower-casing keeps the length, so the filter needn't wait for it
    stripped = split.select("doc_id", "th", "pos", bare(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = stripped.select("doc_id", "th", "pos", lowered(F.col("line")).alias("key"))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8), "key").alias("h2"), "doc_id", "th", "pos")


def _streamed(min_docs: int, keep_first: bool):
    """Streams a task's sorted rows, holding of a run no more than the rows of min_docs documents that are not decided yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(None)
        key = doc = None  # of the run that is open
        docs, first_run, held, head = 0, True, [], None

        def closed(last: bool) -> list[tuple]:
            if key is None or not (first_run or last):
                return []
            out = [(COUNT, *key, None, None, None, docs)]
            out += [(OPEN, *key, *x, None) for x in held]
            return out + ([(HEAD, *key, *head, None)] if keep_first else [])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROWS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(k).to_numpy() for k in (0, 1))
            start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            end = np.r_[start[1:], len(h1)]
            out: list[tuple] = []
            # a run inside the batch with fewer rows than min_docs can't reach it
            todo = np.flatnonzero((end - start >= min_docs) | (start == 0) | (end == len(h1)))
            ids, th, pos = (batch.column(k).to_pylist() for k in (2, 3, 4)) if len(todo) else ([], [], [])
            for r in todo.tolist():
                a, b = int(start[r]), int(end[r])
                this = (int(h1[a]), int(h2[a]))
                if this != key:
                    out += closed(False)
                    first_run = key is None
                    key, doc, docs, held, head = this, None, 0, [], (ids[a], th[a], pos[a])
                for i in range(a, b):
                    if docs == 0 or ids[i] != doc:
                        doc, docs = ids[i], docs + 1
                    at = (ids[i], th[i], pos[i])
                    # an edge run's first row may be the first of all; that is settled later
                    skip = keep_first and at == head
                    if docs < min_docs:
                        held.append(at)
                    elif held:
                        out += [(DROP, *key, *x, None) for x in held if not (keep_first and x == head)]
                        held = []
                    if docs >= min_docs and not skip:
                        out.append((DROP, *key, *at, None))
            yield batch_of(out)
        yield batch_of(closed(True))

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, pos) of each line that goes."""
    lines = hashed_lines(docs, min_chars)
    by = ["h1", "h2", "doc_id", "th", "pos"]
    dealt = lines.repartitionByRange(width(docs.sparkSession), *by[:3]).sortWithinPartitions(*by)
    schema = "kind byte, h1 long, h2 long, doc_id long, th long, pos int, n long"
    rows = settled(map_arrow(dealt, _streamed(min_docs, keep_first), schema))
    place = ["doc_id", "th", "pos"]
    decided = rows.where(F.col("kind") == DROP)
    edge = rows.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.count("*").alias("tasks"))
    common = edge.where((F.col("docs") >= min_docs))
    undecided = rows.where(F.col("kind") == OPEN).join(common, ["h1", "h2"]).select("h1", "h2", *place)
    if not keep_first:
        return decided.select(place).union(undecided.select(place))
    heads = rows.where(F.col("kind") == HEAD).groupBy("h1", "h2").agg(
        F.min(F.struct(*place)).alias("first"), F.collect_set(F.struct(*place)).alias("heads")
    )
    heads = heads.join(common, ["h1", "h2"])
    # where a run began anew in a later task, that task's first row isn't the first of all; and undecided rows hold heads too
    later = heads.select("first", F.explode("heads").alias("x")).where(~F.col("x").eqNullSafe(F.col("first"))).select("x.*")
    open_ = undecided.join(heads.select("h1", "h2", "first"), ["h1", "h2"]).where(~F.struct(*place).eqNullSafe(F.col("first"))).select(place)
    return decided.select(place).union(open_).union(later).distinct()


@F.pandas_udf(BinaryType())
def _bitmap(n_lines, drops):  # noqa: ANN001, ANN202
    import pandas as pd

    out = []
    for n, d in zip(n_lines, drops, strict=True):
        keep = np.ones(n, np.uint8)
        keep[np.asarray(d, np.int64)] = 0
        out.append(zstandard.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, n_dropped, keep) for each document that loses lines.

    keep: a bit per line, the first line in the highest bit of the first byte, zstandard-compressed;
    the last byte is padded with ones. th: text_hash() of the text.
    """
    gone = dropped_lines(docs, min_docs, min_chars, keep_first)
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops"))
    last = F.array_max("drops") + 1
    ship(docs.sparkSession)
    return gone.select("doc_id", "th", F.size("drops").cast("long").alias("n_dropped"), _bitmap(((last + 7) / 8).cast("int") * 8, "drops").alias("keep"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with the lines found in at least ``min_docs`` documents taken out of text, and n_lines, n_dropped, kept_sha256 added.

    A line's key is the line without blanks at its ends and with A-Z lower-cased; keys of fewer
    than ``min_chars`` code points always stay. keep_first leaves each such line where it stands
    first (smallest document, one without an id before all others, then position). A null or empty
    text is one empty line and stays as it is. Documents are told apart by doc_id: rows that share one count
    once, and repeated rows lose the same lines. A text of any length is read whole, and an empty
    table gives an empty one. Columns named n_lines, n_dropped or kept_sha256 are replaced.
    """
    base = docs.drop("n_lines", "n_dropped", "kept_sha256")
    own = {c: OWN + c for c in ("d", "h", "n", "keep")}
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first).select(
        F.col("doc_id").alias(own["d"]), F.col("th").alias(own["h"]), F.col("n_dropped").alias(own["n"]), F.col("keep").alias(own["keep"])
    )
    tagged = base.withColumn(OWN + "th", text_hash())
    joined = tagged.join(maps, F.col("doc_id").eqNullSafe(F.col(own["d"])) & (F.col(OWN + "th") == F.col(own["h"])), "left").drop(own["d"], own["h"], own["n"], OWN + "th")

    names = [*base.columns, "n_lines", "n_dropped", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = block.column(block.schema.get_field_index("text")).to_pylist()
                maps = block.column(block.schema.get_field_index(own["keep"])).to_pylist()
                lines, gone, kept, sha = [], [], [], []
                for t, m in zip(texts, maps, strict=True):
                    parts = (t or "").split("\n")
                    stay, left = t, parts
                    if m is not None:
                        bits = np.unpackbits(np.frombuffer(zstandard.decompress(m), np.uint8))
                        left = [p for p, b in zip(parts, bits.tolist() + [1] * (len(parts) - len(bits)), strict=False) if b]
                        stay = "\n".join(left)
                    lines.append(len(parts))
                    gone.append(len(parts) - len(left))
                    kept.append(stay)
                    sha.append(hashlib.sha256((stay or "").encode()).hexdigest())
                block = block.select([n for n in block.schema.names if n != own["keep"]])
                out = with_columns(block, text=pa.array(kept, pa.string()), n_lines=pa.array(lines, pa.int64()), n_dropped=pa.array(gone, pa.int64()), kept_sha256=pa.array(sha, pa.string()))
                yield out.select(names)

    return map_arrow(joined, run, f"{ddl(base)}, n_lines long, n_dropped long, kept_sha256 string")


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs where of each line in at least ``min_docs`` documents only the first is left, without those that lost lines and have no text left.

    Other documents, null and empty texts among them, come back as they are.
    """
    made = ("n_lines", "n_dropped", "kept_sha256")
    own = {c: OWN + c for c in made if c in docs.columns}
    found = dedup_lines(docs.withColumnsRenamed(own), min_docs, min_chars, keep_first=True)
    found = found.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(BLANKS))) > 0))
    return found.drop(*made).withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)
