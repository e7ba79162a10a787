"""Packing of documents into training sequences by order-preserving dynamic programming.

The ids of a partition's documents, in their order, are one line; it is cut into windows of at
most ``length`` ids. Cuts may stand at ends of documents (free), at ends of sentences and, in
passages without one, at a grid (both at a penalty for the truncation). A window costs its padding:
what it lacks to ``length``, nothing where it has a power of two of ids. With f(j) the least cost up
to cut j,

    f(j) = penalty(j) + length - j + min over j - length <= i < j of (f(i) + i),

a minimum over a sliding window that a monotone queue gives in constant time; the powers of two are
a few more candidates. Documents stream: the cuts are settled behind a horizon of some hundred
windows, so memory holds that horizon and one batch. Every partition packs its own documents, so
nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.encode import REMEMBERED, encoder
from tesserae.llm.text import blocks, map_arrow

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def cuts(n: int, ends: np.ndarray, sentences: np.ndarray, length: int = 1024, at_sentence: int = 1, elsewhere: int = 2, grid: int = 32) -> list[int]:
    """The best cuts of n ids, 0 and n among them. ends, sentences: ascending positions where a document or a sentence ends."""
    grid = min(grid, length)
    least = np.full(n + 1, -1, np.int32)
    least[sentences] = at_sentence
    least[ends] = 0
    least[[0, n]] = 0
    pos = np.flatnonzero(least >= 0)
    gap = np.diff(pos)
    if (wide := np.flatnonzero(gap > grid)).size:
        count = (gap[wide] - 1) // grid
        nth = np.arange(1, count.sum() + 1) - np.repeat(np.cumsum(count) - count, count)
        least[np.repeat(pos[wide], count) + nth * grid] = elsewhere
        pos = np.flatnonzero(least >= 0)
    # the cuts a power of two before each, by the later cut and then by the power
    place = np.full(n + 1, -1, np.int32)
    place[pos] = np.arange(len(pos))
    later, before = [], []
    for k in range(5, max(5, (length - 1).bit_length())):
        some = np.searchsorted(pos, 1 << k)
        have = place[pos[some:] - (1 << k)]
        later.append(np.flatnonzero(have >= 0) + some)
        before.append(have[have >= 0])
    later, before = np.concatenate([*later, [len(pos)]]).astype(np.int64), np.concatenate([*before, [0]])
    order = np.argsort(later, kind="stable")
    later, before, c = later[order].tolist(), before[order].tolist(), 0
    penalty, pos = least[pos].tolist(), pos.tolist()
    f, g, back = [0] * len(pos), [0] * len(pos), [0] * len(pos)
    queue, first = [], 0  # what stands before first has left the window
    for j in range(1, len(pos)):
        at, new = pos[j], g[j - 1]
        while len(queue) > first and g[queue[-1]] >= new:
            queue.pop()
        queue.append(j - 1)
        i = queue[first]
        while pos[i] < at - length:
            first += 1
            i = queue[first]
        best = g[i] + length - at
        while later[c] == j:
            k = before[c]
            if f[k] < best:
                best, i = f[k], k
            c += 1
        f[j], back[j] = best + penalty[j], i
        g[j] = f[j] + at
    out, j = [n], len(pos) - 1
    while j:
        j = back[j]
        out.append(pos[j])
    return out[::-1]


class Packer:
    """Takes documents one by one and gives the pieces of the sequences that are settled."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int, length: int = 1024, horizon: int = 1 << 18, keep: int = 8):
        # a horizon of many windows, of which the last few may yet be cut otherwise
        self.ends_sentence, self.sequence, self.length, self.horizon, self.keep = ends_sentence, first_sequence, length, max(horizon, 8 * keep * length), keep
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # id, ids not yet packed, how many are, how many it has
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        while self.held >= self.horizon:
            yield from self._settle(False)

    def end(self) -> Iterator[tuple]:
        while self.held:
            yield from self._settle(True)

    def _settle(self, last: bool) -> Iterator[tuple]:
        ends = np.cumsum([len(d[1]) for d in self.docs])
        most = min(self.held, 2 * self.horizon)
        last = last and most == self.held
        some = self.docs[: int(np.searchsorted(ends, most)) + 1]
        ids = np.concatenate([d[1][:most] for d in some])[:most]
        best = cuts(most, ends[ends <= most], np.flatnonzero(self.ends_sentence[ids]) + 1, self.length)
        if not last:
            best = best[: -self.keep]
        k = begun = 0
        for a, b in zip(best, best[1:], strict=False):
            at = a
            while at < b:
                doc_id, own, done, total = self.docs[k]
                n = min(b, int(ends[k])) - at
                start = at - begun
                yield doc_id, done + start, n, zlib.crc32(own[start : start + n].astype("<u4").tobytes()), total, self.sequence, at - a
                at += n
                if at == ends[k]:
                    begun, k = at, k + 1
            self.sequence += 1
        rest = self.docs[k:]
        if rest and best[-1] > begun:
            doc_id, own, done, total = rest[0]
            rest[0] = (doc_id, own[best[-1] - begun :], done + best[-1] - begun, total)
        self.docs, self.held = rest, self.held - best[-1]


def sentence_ends(path: str) -> np.ndarray:
    """For each id of a byte-level tokenizer whether a sentence or a line ends with it."""
    lib = encoder(path).lib
    return np.array([(lib.id_to_token(k) or "").endswith((".", "!", "?", "Ċ")) for k in range(lib.get_vocab_size())])


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file on every worker. remembered: bytes of encoded pieces that a
    worker holds in each of two generations; it changes the time, not the result. A null or empty text has end_id alone.
    Repeated rows are packed as often as they come; a null doc_id stays null; an empty table has no
    pieces; a text longer than a window is cut as often as it must be. sequence_id is unique
    over the table: partition number times 2^33 plus the sequence's number in it. Only the last
    sequence of a partition may be short for want of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(sentence_ends(tokenizer), TaskContext.get().partitionId() << 33, length)
        lib = encoder(tokenizer, remembered)
        end = np.array([end_id], lib.dtype)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(_NAMES))], _NAMES)

        for batch in batches:
            for block in blocks(batch, most=4_000_000):
                rows: list[tuple] = []
                for doc_id, ids in zip(block.column(0).to_pylist(), lib.encode(block.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc_id, np.concatenate([ids, end]))
                yield out(rows)
        yield out(list(packer.end()))

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
