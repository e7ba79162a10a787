"""Language ID by prediction by partial matching (PPM).

Each language has a byte context tree of up to ``order`` bytes, learned once and then frozen. A
byte's probability in its longest known context is its count over that context's total plus its
number of different successors (escape method C); a byte not seen there is reached by the escape
probability, spread over what the next shorter context gives to the bytes not seen, and below the
empty context every byte is as likely as any other. The code length of a text is the sum of -log2
of these, over the UTF-8 bytes of the text with A-Z in lower case, and the language with the
shortest code wins.

The trees are sparse: per order, the contexts with their successors as sorted numbers. For scoring,
those of eight languages at a time are laid out as hash tables whose rows have a code length for
each of the eight, so that a text is a few gathers and sums and there is no per-byte Python. The
tables grow with what was learned, which has a bound (``sampled``), whatever the number of languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.text import OWN, alone, blocks, ddl, map_arrow, text_hash, with_columns

UNKNOWN = "und"
#: Languages that share tables.
TOGETHER = 8
#: Bytes of text that are scored at once.
STEP = 1 << 19


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _keys(text: np.ndarray, order: int) -> np.ndarray:
    """For each byte from number ``order`` on the byte and the ``order`` before it, as one number."""
    n = max(0, len(text) - order)
    key = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        key = key << np.uint64(8) | text[order - back : order - back + n]
    return key


def learn(samples: dict[str, list[str]], order: int = 3) -> dict:
    """The frozen counts: for each language and order (7 at most), each context and its byte as one number, and how often.

    A text begins after ``order`` blanks.
    """
    if not 0 <= order <= 7:
        raise ValueError("orders 0 to 7")
    langs, pad = sorted(samples), b" " * order
    counts = []
    for k in langs:
        keys: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for t in samples[k]:
            s = np.frombuffer(pad + _bytes(t), np.uint8)
            for o in range(order + 1):
                keys[o].append(_keys(s[order - o :], o))
        counts.append([np.unique(np.concatenate([*x, np.zeros(0, np.uint64)]), return_counts=True) for x in keys])
    return {"langs": langs, "order": order, "counts": counts}


class _Table:
    """Where each of some numbers stands in their sorted list: an open hash table that is asked for many at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.place[slot] < 0
            self.place[slot[free]] = todo[free]  # of several for one slot the last stays
            here = self.place[slot] == todo
            self.keys[slot[here]] = keys[todo[here]]
            todo, slot = todo[~here], (slot[~here] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(keys)
        out = self.place[slot]
        far = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        out[far] = -1
        slot = slot[far]
        while len(far):
            slot = (slot + 1) & self.mask
            place = self.place[slot]
            here = self.keys[slot] == keys[far]
            out[far[here & (place >= 0)]] = place[here & (place >= 0)]
            on = ~here & (place >= 0)
            far, slot = far[on], slot[on]
        return out


def _own(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order of a language: keys, their bits; contexts, the bits of an escape from each."""
    out: list[tuple] = []
    for o, (keys, count) in enumerate(rows):
        context, at, kinds = np.unique(keys >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, count, len(context))
        if o:
            shorter, p = out[-1][0], np.exp2(-out[-1][1])
            lower = p[np.searchsorted(shorter, keys & np.uint64((1 << 8 * o) - 1))]
        else:
            lower = np.full(len(keys), 1 / 256)
        left = 1 - np.bincount(at, lower, len(context))
        full = (kinds == 256) | (left <= 0)
        bits = np.log2((total + np.where(full, 0, kinds))[at] / count)
        escape = np.where(full, np.inf, np.log2((total + kinds) / kinds * np.where(full, 1, left)))
        out.append((keys, bits, context, escape))
    return out


def compiled(model: dict) -> list[list[tuple[_Table, np.ndarray, _Table, np.ndarray]]]:
    """For each eight languages and each order two tables: (context and byte) with code lengths, and context with the lengths of escapes."""
    out = []
    for first in range(0, len(model["langs"]), TOGETHER):
        own = [_own(rows) for rows in model["counts"][first : first + TOGETHER]]
        levels: list[tuple] = []
        every = np.zeros(0, np.uint64)
        for o in range(model["order"] + 1):
            shorter, every = every, np.unique(np.concatenate([x[o][0] for x in own]))
            contexts = np.unique(np.concatenate([x[o][2] for x in own]))
            bits, escapes = np.zeros((len(every), len(own))), np.zeros((len(contexts), len(own)))
            of = np.searchsorted(contexts, every >> np.uint64(8))
            below = levels[-1][1][np.searchsorted(shorter, every & np.uint64((1 << 8 * o) - 1))] if o else np.full_like(bits, 8.0)
            for j, x in enumerate(own):
                keys, length, context, escape = x[o]
                escapes[np.searchsorted(contexts, context), j] = escape
                bits[:, j] = escapes[of, j] + below[:, j]
                bits[np.searchsorted(every, keys), j] = length
            levels.append((_Table(every), bits, _Table(contexts), escapes))
        out.append(levels)
    return out


def sampled(docs: DataFrame, train: Column, per_lang: int = 600_000, in_all: int = 12_000_000, most_langs: int = 1024, lang: str = "lang") -> dict[str, list[str]]:
    """Labelled texts to learn from, drawn by a hash of id and text: about ``per_lang`` bytes of each language, about ``in_all`` of all.

    Only texts of at most an eighth of a language's share are drawn from, so that none of them is
    most of what is learned; a language that has longer ones only isn't learned. More than
    ``most_langs`` different labels are an error.
    """
    from_ = docs.select("doc_id", "text", F.col(lang).cast("string").alias("lang"), F.octet_length("text").alias("size"))
    from_ = from_.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = [r["lang"] for r in from_.select("lang").distinct().limit(most_langs + 1).collect()]
    if len(known) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not known:
        return {}
    budget = min(per_lang, in_all // len(known))
    from_ = from_.where(F.col("size") <= budget // 8)
    share = F.lit(0)
    for r in sorted(from_.groupBy("lang").agg(F.sum("size").alias("n")).collect()):
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1_000_000, math.ceil(1_000_000 * budget / max(1, r["n"]))))).otherwise(share)
    out: dict[str, list[str]] = {}
    for r in from_.where(F.pmod(F.xxhash64("doc_id", text_hash()), F.lit(1_000_000)) < share).select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: sorted(v) for k, v in out.items()}


def code_lengths(texts: list[str | None], model: dict, tables: list) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language [text, language], and bytes of each text."""
    order, pad = model["order"], b" " * model["order"]
    raw = [_bytes(t) for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    bits = np.zeros((len(raw), len(model["langs"])))
    line = np.frombuffer(b"".join([x for r in raw for x in (pad, r)]), np.uint8)
    text_of = np.repeat(np.arange(len(raw), dtype=np.int32), size + order)
    scored = np.ones(len(line), bool)  # not the blanks before each text
    begin = np.cumsum(size + order) - size - order
    for k in range(order):
        scored[begin + k] = False
    low = [np.uint64((1 << 8 * o + 8) - 1) if o < 7 else ~np.uint64(0) for o in range(order + 1)]
    for lo in range(0, len(line) - order, STEP):
        part = line[lo : lo + STEP + order]  # the bytes from number order on are scored
        ok = scored[lo + order : lo + len(part)]
        of = text_of[lo + order : lo + len(part)][ok]
        if not len(of):
            continue
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        keys = _keys(part, order)[ok]
        for g, levels in enumerate(tables):
            got = np.zeros((len(of), levels[0][1].shape[1]))
            todo, key = None, keys
            for o in range(order, -1, -1):
                table, length, contexts, escapes = levels[o]
                at = table.find(key)
                if todo is None:
                    got = length[at]  # what isn't found is set below
                    todo = np.flatnonzero(at < 0)
                    got[todo] = 0
                else:
                    found = at >= 0
                    got[todo[found]] += length[at[found]]
                    todo = todo[~found]
                if not len(todo):
                    break
                key = keys[todo] & low[o]
                at = contexts.find(key >> np.uint64(8))
                known = at >= 0
                got[todo[known]] += escapes[at[known]]
                key &= low[o - 1] if o else low[0]
            got[todo] += 8.0
            bits[of[edge], g * TOGETHER : g * TOGETHER + got.shape[1]] += np.add.reduceat(got, edge, axis=0)
    return bits, size


_READY: dict[bytes, list] = {}


def scores(texts: list[str | None], model: dict, tables: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of the probability of the text, and bits a byte under it."""
    langs = model["langs"]
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits, size = code_lengths(texts, model, tables)
    share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
    each = bits.min(1) / np.maximum(1, size)
    letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
    return [langs[b] if ok else UNKNOWN for b, ok in zip(bits.argmin(1).tolist(), letters, strict=True)], np.where(letters, share, 0.0), np.where(letters, each, 0.0)


def identify(docs: DataFrame, train: Column | None = None, per_lang: int = 600_000, order: int = 3) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits_per_byte added (columns of these names are replaced).

    train: which labelled rows may be learned from (all by default). A text that is null or has no
    letters, and every text where nothing is labelled, is ``und`` with score 0. Of languages with
    equal code lengths the one that comes first in the alphabet is named. A text of any length is
    scored whole. Repeated rows get equal results; an empty table gives an empty one.
    """
    model = learn(sampled(docs, F.lit(True) if train is None else train, per_lang), order)
    name = repr((model["langs"], order, [[(int(k.sum()), int(c.sum())) for k, c in rows] for rows in model["counts"]])).encode()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "bits_per_byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        alone(_READY)
        if name not in _READY:
            _READY.clear()
            _READY[name] = compiled(m)
        for batch in batches:
            for block in blocks(batch, most=4_000_000):
                langs, share, each = scores(block.column(block.schema.get_field_index("text")).to_pylist(), m, _READY[name])
                yield with_columns(block, lang_pred=pa.array(langs, pa.string()), score=pa.array(share), bits_per_byte=pa.array(each))

    return map_arrow(kept, run, f"{ddl(kept)}, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, most_bits: float = 10.0) -> DataFrame:
    """The documents whose text has letters and that some language tells in fewer than ``most_bits`` bits a byte.

    Plain bytes take eight; a quarter more is left to short texts of known words with a few odd
    characters. Texts in a script that no language was learned in take 15 and more.

    Where nothing is labelled no document is accepted. Null and empty texts go; repeated rows share their fate; an empty table stays empty.
    """
    own = {c: f"{OWN}{k}" for k, c in enumerate(("lang_pred", "score", "bits_per_byte")) if c in docs.columns}
    found = identify(docs.withColumnsRenamed(own), train=~held_out())
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < most_bits))
    return found.drop("lang_pred", "score", "bits_per_byte").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)
