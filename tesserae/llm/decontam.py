"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The automaton's alphabet is the words of the items; it accepts every run of words that occurs in
some item. A training text is streamed through it word by word, and at each word the length of the
longest run that ends there and occurs in an item is known. A run of ``window`` words, or a whole
item that is shorter, is a hit, and all its words are hit words.

The benchmark is dealt into shards of about ``shard_words`` words; a long item is cut into pieces that
share ``window`` - 1 words, so that no run is lost. One shard at a time is collected, broadcast and
streamed against, and given up before the next: neither the driver nor a worker holds more, however
large the benchmark is. With one shard documents come back as they are streamed; with more each pass
writes the hits of its shard alone, and these are brought together by document at the end.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.text import OWN, alone, blocks, ddl, map_arrow, settled, shared_path, text_hash, with_columns

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and every byte of a character beyond ASCII.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty run."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[int]] = [set()]
        whole: dict[int, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, w, ends)
                ends[last].add(k)
            if 0 < len(words) < window:
                whole.setdefault(last, []).append((len(words), k))
        # an item that ends in a state occurs at all runs that the state's suffixes have
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.items = [frozenset(e) for e in ends]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for s in reversed(order):
            self.short[s] = tuple(whole.get(s, ())) + self.short[max(0, self.link[s])]
        self.vocabulary = set(self.next[0])
        self.least = min([window, *(n for x in whole.values() for n, _ in x)])

    def _add(self, last: int, w: bytes, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.len

        def split(p: int, q: int) -> int:
            clone = len(length)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            ends.append(set())
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            return clone

        if (q := nxt[last].get(w)) is not None:  # the run occurs in an earlier item
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs [from, to) in order, maximal and disjoint, and the numbers of the items that have them."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        vocabulary, nxt, link, length, window, items, short = self.vocabulary, self.next, self.link, self.len, self.window, self.items, self.short
        known = np.frombuffer(bytes(map(vocabulary.__contains__, words)), np.bool_)
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo < self.least:  # no hit fits between words that no item has
                continue
            s = n = 0
            for at in range(lo, hi):
                w = words[at]
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                s = nxt[s].get(w, 0)
                n = n + 1 if s else 0
                hit = 0
                if n >= window:
                    hit = window
                    p = s
                    while length[link[p]] >= window:
                        p = link[p]
                    found |= items[p]
                for m, k in short[s]:
                    if m <= n:
                        hit = max(hit, m)
                        found.add(k)
                if hit:
                    a = at + 1 - hit
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, at + 1))
        return spans, found


def _pieces(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, sizes = [], [], []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for at in range(0, max(1, len(w) - window + 1), most) if w else ():
                    part = w[at : at + most + window - 1]
                    ids.append(item)
                    texts.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], ["item", "words", "n"])

    return run


class Shards:
    """The benchmark's items in shards: how many, and each as a list of (item, words)."""

    def __init__(self, benchmark: DataFrame, window: int, shard_words: int, item_id: str = "item_id"):
        pieces = map_arrow(benchmark.select(F.col(item_id).cast("string").alias("item"), "text"), _pieces(window, max(1, shard_words // 16)), "item string, words binary, n long")
        self.pieces = settled(pieces.distinct())
        total = self.pieces.agg(F.sum("n")).first()[0] or 0
        # dealt by a hash, so some room is left for shards above the mean
        self.count = 1 if total <= shard_words else -(-5 * total // (4 * shard_words))

    def __getitem__(self, k: int) -> list[tuple[str | None, list[bytes]]]:
        rows = self.pieces.where(F.pmod(F.xxhash64("words", "item"), F.lit(self.count)) == k).select("item", "words").collect()
        return sorted(((r[0], bytes(r[1]).split()) for r in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


#: The one automaton that a worker holds.
_BUILT: dict[str, Automaton] = {}


def _machine(name: str, shared, window: int) -> Automaton:  # noqa: ANN001
    alone(_BUILT)
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shared.value, window)
    return _BUILT[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = f"{OWN}n long, {OWN}hits array<struct<start:int,end:int>>, {OWN}items array<string>"


def _scanned(docs: DataFrame, items: list, window: int, only_hits: bool):  # noqa: ANN202
    """docs with the number of words, hit spans and ids of items of one shard, and the broadcast to be given up afterwards."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared, window)
        for batch in batches:
            for block in blocks(batch):
                n, spans, ids = [], [], []
                for t in block.column(block.schema.get_field_index("text")).to_pylist():
                    w = words_of(t)
                    got, found = machine.scan(w)
                    n.append(len(w))
                    spans.append(got)
                    ids.append(sorted({machine.ids[i] for i in found} - {None}))
                more = {
                    OWN + "n": pa.array(n, pa.int64()),
                    OWN + "hits": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                    OWN + "items": pa.array(ids, pa.list_(pa.string())),
                }
                out = with_columns(block, **more)
                if only_hits:
                    out = out.select([c for c in out.schema.names if c != "text"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))
                yield out

    return map_arrow(docs, run, f"{ddl(docs, *['text'] * only_hits)}, {_FOUND}"), shared


def _hits(docs: DataFrame, shards: Shards, window: int) -> DataFrame:
    """docs with the three columns of _FOUND, over all shards."""
    if shards.count == 1:
        return _scanned(docs, shards[0], window, False)[0]
    spark = docs.sparkSession
    names = docs.columns
    keyed = docs.select("doc_id", "text", text_hash().alias("th"))
    path = shared_path(spark, "hits")
    for k in range(shards.count):
        found, shared = _scanned(keyed, shards[k], window, True)
        found.write.mode("append").parquet(path)
        shared.destroy()
    all_ = spark.read.parquet(path).select("doc_id", "th", F.col(OWN + "hits").alias("h"), F.col(OWN + "items").alias("i"))
    # a document's words bound what comes together here
    spans = all_.groupBy(F.coalesce("doc_id", F.lit(0)).alias(OWN + "a"), F.col("doc_id").isNull().alias(OWN + "b"), F.col("th").alias(OWN + "c"))
    spans = spans.agg(F.array_sort(F.flatten(F.collect_set("h"))).alias(OWN + "hits"), F.array_distinct(F.flatten(F.collect_set("i"))).alias(OWN + "items"))
    tagged = docs.withColumns({OWN + "a": F.coalesce("doc_id", F.lit(0)), OWN + "b": F.col("doc_id").isNull(), OWN + "c": text_hash()})
    joined = tagged.join(spans, [OWN + "a", OWN + "b", OWN + "c"], "left").select(*names, OWN + "hits", OWN + "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                column = lambda c, b=block: b.column(b.schema.get_field_index(c)).to_pylist()
                spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in h or ()])] for h in column(OWN + "hits")]
                more = {
                    OWN + "n": pa.array([len(words_of(t)) for t in column("text")], pa.int64()),
                    OWN + "hits": pa.array(spans, _SPANS),
                    OWN + "items": pa.array([i or [] for i in column(OWN + "items")], pa.list_(pa.string())),
                }
                yield with_columns(block, **more)

    return map_arrow(joined, run, f"{ddl(docs)}, {_FOUND}")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 2_000_000) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and hits (array of word spans) added; columns of these names are replaced.

    A null or empty text has no words and no hit, an item without words is in nothing. Items that
    repeat count by their id, once; items with a null id mark words but aren't counted. With an
    empty benchmark nothing is hit. Repeated rows get equal results, a text of any length is scanned
    whole, and an empty table gives an empty one.
    """
    base = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "hits")
    found = _hits(base, Shards(benchmark, window, shard_words), window)
    hits = F.col(OWN + "hits")
    return found.select(
        *base.columns,
        F.col(OWN + "n").alias("n_words"),
        F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.size(OWN + "items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(OWN + "items"), ","), 256).alias("items_sha256"),
        hits.alias("hits"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last of each span of words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, flat, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]])
        at = int(end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut_all(docs: DataFrame, most_share: float | None) -> DataFrame:
    """docs (with _FOUND) with hit spans cut out, and without those of which more than most_share is hit; _FOUND goes."""
    names = [c for c in docs.columns if c not in (OWN + "n", OWN + "hits", OWN + "items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                column = lambda c, b=block: b.column(b.schema.get_field_index(c)).to_pylist()
                texts, stays = [], []
                for t, n, hits in zip(column("text"), column(OWN + "n"), column(OWN + "hits"), strict=True):
                    spans = [(h["start"], h["end"]) for h in hits]
                    stays.append(most_share is None or sum(b - a for a, b in spans) <= most_share * n)
                    texts.append(cut(t, spans) if spans and stays[-1] else t)
                yield with_columns(block, text=pa.array(texts, pa.string())).select(names).filter(pa.array(stays, pa.bool_()))

    return map_arrow(docs, run, ddl(docs.select(names)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.5, shard_words: int = 2_000_000) -> DataFrame:
    """docs without what occurs in the benchmark: hit spans are cut out of text, and a document of which more than ``most_share`` is hit goes.

    Where a cut brings together words that make a hit again, that is cut too, until none is left.
    Documents without a hit, null texts among them, come back as they are; repeated rows share their
    fate; with an empty benchmark, or of an empty table, all stays as it is.
    """
    names = list(docs.columns)
    shards = Shards(benchmark, window, shard_words)
    if shards.count > 1:  # rounds over what was cut in the one before
        done, todo, share = [], docs, most_share
        while True:
            found = settled(_hits(todo, shards, window))
            done.append(found.where(F.size(OWN + "hits") == 0).select(names))
            hit = found.where(F.size(OWN + "hits") > 0)
            if hit.isEmpty():
                return functools.reduce(DataFrame.union, done)
            todo, share = _cut_all(hit, share).select(names), None
    shared, name = docs.sparkSession.sparkContext.broadcast(shards[0]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared, window)
        for batch in batches:
            for block in blocks(batch):
                texts = block.column(block.schema.get_field_index("text")).to_pylist()
                stays = [True] * len(texts)
                for k, t in enumerate(texts):
                    first = True
                    while words := words_of(t):
                        spans = machine.scan(words)[0]
                        if not spans:
                            break
                        if first and sum(b - a for a, b in spans) > most_share * len(words):
                            stays[k] = False
                            break
                        first, t = False, cut(t, spans)
                    texts[k] = t
                block = with_columns(block, text=pa.array(texts, pa.string()))
                yield block.select(names).filter(pa.array(stays, pa.bool_()))

    return map_arrow(docs, run, ddl(docs))
