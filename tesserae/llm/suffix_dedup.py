"""Suffix-array dedup: bytes covered by a 50-byte string that an earlier document has are removed.

Sorting every suffix of the corpus would move each text fifty times over, so the suffix array is
sparse. A window of ``size`` bytes has an anchor, the leftmost of its ``gram``-byte strings with the
least hash; equal windows have equal anchors at equal places. Windows in a row with one anchor are a
segment.

1. Documents are dealt to buckets. A bucket sends each anchor's hash once, with the least and the
   greatest document that has it; hashes that two documents have come back to the buckets. All other
   windows are unique and done with. A hash that stands for two strings only lets more pass.
2. Segments with such anchors go to buckets by anchor, each string once from a bucket of documents,
   again with its least and greatest document. Each bucket orders the suffixes at its windows by
   deep-shallow sorting: multikey quicksort by characters of eight bytes to a shallow depth, then
   blind tries for groups that still agree. Neighbours that agree over the whole window are one
   string, and its smallest document is known. Anchors are taken as many at a time as have a bounded
   number of windows; the windows of one that has more are dealt to passes by their hash.
3. That document comes back for each string, by runs of windows, to the buckets of documents, which
   look up where they have the string and drop the bytes that are covered.

So an anchor or a segment that a third of all documents have counts once for each bucket, not for
each document. What is shuffled are compressed blocks of numbers; texts travel zstandard-compressed.
There are as many buckets as partitions, and more where these would have over 20 MB of text each: a
partition's buckets come one after another, so memory grows with a bucket and not with the input.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.text import map_arrow, ship, text_hash, width

#: What a null doc_id counts as: it comes after all others, and covers nothing.
LAST = (1 << 63) - 1
_CHUNK = 60_000
_LOW = np.uint64(0xFFFF)
#: Bytes of text of a bucket of documents, and windows that are ordered at once (about 150 bytes each).
BUCKET, WINDOWS = 20_000_000, 1_000_000


def _packed(*arrays: np.ndarray | bytes | int) -> bytes:
    """Arrays transposed into byte planes and compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if isinstance(a, np.ndarray) and len(a) else a for a in arrays]
    return zstandard.compress(pickle.dumps(planes), 3)


def _unpacked(raw: bytes) -> list:
    out = []
    for p in pickle.loads(zstandard.decompress(raw)):
        out.append(np.ascontiguousarray(np.frombuffer(p[2], np.uint8).reshape(-1, p[1]).T).view(p[0]).reshape(-1) if isinstance(p, tuple) else p)
    return out


class Segments:
    """Windows of ``size`` bytes by their anchors."""

    def __init__(self, size: int = 50, gram: int = 20):
        if not 1 <= gram <= size <= 4096:
            raise ValueError("1 <= gram <= size <= 4096")
        self.size, self.gram, self.wide = size, gram, size - gram + 1
        self.table = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        """Of each gram a polynomial over random values of its bytes, mixed; built by doubling."""
        base = 0x9E3779B97F4A7C15
        n, power, have, out, done = 1, base, self.table[raw], None, 0
        while n <= self.gram:
            if self.gram & n:
                part = have[done:]
                if out is None:
                    out = part
                else:
                    m = min(len(out), len(part))
                    out = out[:m] * np.uint64(power) + part[:m]
                done += n
            if 2 * n <= self.gram:
                have = have[:-n] * np.uint64(power) + have[n:]
            n, power = 2 * n, power * power & (1 << 64) - 1
        out = out[: len(raw) - self.gram + 1]
        out = out ^ (out >> np.uint64(32))
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))

    def of(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor hash) of each segment of texts that end at ``ends``; no window leaves its text."""
        first, count, hashes = [], [], []
        n = len(raw) - self.size + 1
        texts = np.searchsorted(ends, np.arange(0, max(n, 0), _CHUNK), side="right")
        carry = -1
        for c, k in zip(range(0, max(n, 0), _CHUNK), texts.tolist(), strict=True):
            w = min(_CHUNK, n - c)
            h = self._hash(raw[c : c + w + self.size - 1])
            key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            have = 1
            while 2 * have <= self.wide:
                key, have = np.minimum(key[:-have], key[have:]), 2 * have
            if rest := self.wide - have:
                key = np.minimum(key[:-rest], key[rest:])
            ok = np.ones(w, bool)
            while k < len(ends) and ends[k] - self.size + 1 < c + w:
                ok[max(0, ends[k] - self.size + 1 - c) : max(0, ends[k] - c)] = False
                k += 1
            at = np.flatnonzero(ok)
            key = key[:w][at]
            where = (key & _LOW).astype(np.int64) + c
            new = np.flatnonzero(np.diff(where, prepend=carry))
            lengths = np.diff(np.r_[new, len(where)])
            if len(where):
                if count and (not len(new) or new[0]):  # the last segment of the chunk before goes on
                    count[-1][-1] += new[0] if len(new) else len(where)
                carry = where[-1]
            first.append(at[new] + c)
            count.append(lengths)
            hashes.append(key[new] >> np.uint64(16))
            if len(count) > 1 and not len(count[-1]):  # keep the open segment last
                first.pop(), count.pop(), hashes.pop()
        if not first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(first), np.concatenate(count), np.concatenate(hashes)


class BlindTrie:
    """Orders byte strings of one length by branch characters alone, with one comparison of bytes for each string put in."""

    def __init__(self, depth: int):
        self.depth = depth
        self.root: list | None = None  # [depth of the branch, {character: child}] or [-1, string, members]

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, s, [member]]
            return
        node = self.root
        while node[0] >= 0:  # go down blindly: any leaf below shares what the path has in common
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == s:
            node[2].append(member)
            return
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        common = self.depth - (x.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] >= 0 and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if node[0] == common:
            node[1][s[common]] = [-1, s, [member]]
            return
        branch = [common, {other[common]: node, s[common]: [-1, s, [member]]}]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The members of each different string, in order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def multikey_quicksort(text: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and where the groups that agree so far begin and end.

    A character is eight bytes. All groups that are still open are parted in step, each in three by a
    pivot of its own (the middle one of three drawn at random): the equal part goes on to the next
    character, the smaller and the greater one stay at theirs.
    """
    if len(text) < 8:
        text += b"\0" * 8
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)
    order, draw = np.arange(len(starts)), np.random.default_rng(3)
    begin, count, at = np.zeros(1, np.int64), np.array([len(starts)]), np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        ended = (count > 1) & (at + 8 > depth)
        done.append((begin[ended], begin[ended] + count[ended]))
        begin, count, at = (x[(count > 1) & ~ended] for x in (begin, count, at))
        if not len(begin):
            break
        first = np.cumsum(count) - count  # of each group, among the members of open groups
        group = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(group)) + (begin - first)[group]
        member = order[place]
        word = words[starts[member] + at[group]].view(">u8").reshape(-1).astype(np.uint64)
        pivot = np.sort(word[first + (draw.random((3, len(count))) * count).astype(np.int64)], axis=0)[1][group]
        part = (word >= pivot).astype(np.int8) + (word > pivot)
        sizes = np.bincount(3 * group + part, minlength=3 * len(count)).reshape(-1, 3)
        offset = begin[:, None] + np.cumsum(sizes, axis=1) - sizes
        for p in range(3):
            mine = np.flatnonzero(part == p)
            of = group[mine]
            order[offset[of, p] + np.arange(len(mine)) - (np.cumsum(sizes[:, p]) - sizes[:, p])[of]] = member[mine]
        begin, count, at = offset.reshape(-1), sizes.reshape(-1), (at[:, None] + np.array([0, 8, 0])).reshape(-1)
    begin, end = (np.concatenate([x[k] for x in done]) for k in (0, 1))
    return order, begin, end


def deep_shallow(text: bytes, starts: np.ndarray, size: int, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``size`` bytes, and whether each agrees there with the one before."""
    order, begin, end = multikey_quicksort(text, starts, min(shallow, size))
    same = np.zeros(len(starts), bool)
    for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
        trie = BlindTrie(size)
        for k, s in zip(order[lo:hi].tolist(), starts[order[lo:hi]].tolist(), strict=True):
            trie.add(text[s : s + size], k)
        for leaf in trie.leaves():
            order[lo : lo + len(leaf)] = leaf
            same[lo + 1 : lo + len(leaf)] = True
            lo += len(leaf)
    return order, same


def _passes(text: bytes, starts: Callable[[np.ndarray], np.ndarray], total: int, size: int, most: int) -> Iterator[np.ndarray]:
    """The numbers of all windows in parts of about ``most``, equal windows in one part; ``starts`` has where a number's window lies in text."""
    parts = -(-total // most)
    if parts < 2:
        yield np.arange(total)
        return
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)
    part = np.empty(total, np.uint16)
    for c in range(0, total, _CHUNK):
        at = starts(np.arange(c, min(c + _CHUNK, total)))
        h = np.zeros(len(at), np.uint64)
        for k in range(0, size, 8):
            word = words[at + k].view("<u8").reshape(-1)
            if size - k < 8:  # the bytes beyond the window
                word = word & np.uint64((1 << 8 * (size - k)) - 1)
            h = (h ^ word) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        part[c : c + len(at)] = h % np.uint64(min(parts, 65535))
    for k in range(min(parts, 65535)):
        yield np.flatnonzero(part == k)


def least_of_windows(text: bytes, begin: np.ndarray, windows: np.ndarray, least: np.ndarray, size: int, most: int = WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, number of windows, document) of runs of windows that have one least document.

    String k begins at ``begin[k]``, has ``windows[k]`` windows (one at least) and ``least[k]`` for its
    least document; a window's is the least of all strings that have it. ``text`` goes on for 8 bytes.
    """
    edge = np.r_[0, np.cumsum(windows)]
    used, code = np.unique(least, return_inverse=True)
    low = np.empty(edge[-1], np.uint32)
    string = lambda at: np.searchsorted(edge, at, side="right") - 1

    def starts(at: np.ndarray) -> np.ndarray:
        of = string(at)
        return begin[of] + at - edge[of]

    for at in _passes(text, starts, int(edge[-1]), size, most):
        if len(at):
            order, same = deep_shallow(text, starts(at), size)
            at = at[order]
            low[at] = np.minimum.reduceat(code[string(at)], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    new = np.r_[True, low[1:] != low[:-1]]
    new[edge[:-1]] = True
    at = np.flatnonzero(new)
    of = string(at)
    return of, at - edge[of], np.diff(np.r_[at, edge[-1]]), used[low[at]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _dealt(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, order[edge[b] : edge[b + 1]]


def _home(doc: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document."""
    x = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ th.view(np.uint64)
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n


def _groups(docs_pdf, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Rows of a bucket of documents by ``most`` compressed bytes, with their texts joined and where each ends; repeated rows once."""
    group: list[int] = []
    seen, held = set(), 0
    for k, key in enumerate(zip(docs_pdf["doc"].tolist(), docs_pdf["th"].tolist(), strict=True)):
        if key in seen:
            continue
        seen.add(key)
        group.append(k)
        held += len(docs_pdf["text"].iat[k])
        if held > most:
            yield np.array(group), *_joined([zstandard.decompress(docs_pdf["text"].iat[j]) for j in group])
            group, held = [], 0
    if group:
        yield np.array(group), *_joined([zstandard.decompress(docs_pdf["text"].iat[j]) for j in group])


def _least_and_greatest(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, in order, with the least of ``low`` and the greatest of ``high``."""
    if not len(h):
        return h, low, high
    order = np.argsort(h, kind="stable")
    h = h[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[start], np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)


def _spread(edge: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from edge[k] to edge[k + 1] for each k of ``of``, and the index in ``of`` that each is for."""
    count = edge[of + 1] - edge[of]
    return np.repeat(edge[of] - (np.cumsum(count) - count), count) + np.arange(count.sum()), np.repeat(np.arange(len(of)), count)


def _pdf(rows: list[tuple]):  # noqa: ANN202
    import pandas as pd

    return pd.DataFrame(rows, columns=["bucket", "raw"])


_BLOCKS = "bucket int, raw binary"
#: First bytes of a packed block: strings to compare, places that stay with their documents, answers.
_STRINGS, _PLACES, _ANSWERS = b"s", b"p", b"a"


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) and kept_sha256 of every document.

    A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller
    doc_id. A null text is empty and a short one stays whole. Documents with equal ids don't cover
    each other; a document without an id comes after all others. Repeated rows get equal results; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    held = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n, made = max(width(spark), -(-held // BUCKET)), Segments(size, gram)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).fill_null(LAST)
            th = b.column(1)
            home = _home(doc.to_numpy(zero_copy_only=False), th.to_numpy(), n)
            z = zstandard.ZstdCompressor(level=3)
            raw = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), doc, th, b.column(0).is_null(), pa.array(raw, pa.binary())], ["bucket", "doc", "th", "no_id", "text"])

    def anchors(docs_pdf):  # noqa: ANN001, ANN202
        """Of a bucket of documents each anchor once, by bucket of anchors, with the least and the greatest document."""
        ids = docs_pdf["doc"].to_numpy(np.int64)
        held = []
        for group, raw, ends in _groups(docs_pdf):
            first, _, h = made.of(raw, ends)
            doc = ids[group[np.searchsorted(ends, first, side="right")]]
            held.append(_least_and_greatest(h, doc, doc))
        h, low, high = _least_and_greatest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        home = int(docs_pdf["bucket"].iat[0])
        out = []
        for b, rows in _dealt((h % np.uint64(n)).astype(np.int64), n):
            used, k = np.unique(low[rows], return_inverse=True)
            out.append((b, _packed(home, np.diff(h[rows], prepend=np.uint64(0)), k.astype("<u4" if len(used) > 65535 else "<u2"), np.diff(used, prepend=0), high[rows] - low[rows])))
        return _pdf(out)

    def repeated(pdf):  # noqa: ANN001, ANN202
        """Of a bucket of anchors those that two documents have, for each bucket of documents."""
        hs, lows, highs, homes = [], [], [], []
        for raw in pdf["raw"]:
            home, a, k, used, more = _unpacked(raw)
            hs.append(np.cumsum(a, dtype=np.uint64))
            lows.append(np.cumsum(used)[k])
            highs.append(lows[-1] + more)
            homes.append(np.full(len(a), home, np.int32))
        h, low, high, home = (np.concatenate(x) for x in (hs, lows, highs, homes))
        order = np.argsort(h, kind="stable")
        h, low, high, home = h[order], low[order], high[order], home[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        shared = np.minimum.reduceat(low, start) != np.maximum.reduceat(high, start)
        keep = np.repeat(shared, np.diff(np.r_[start, len(h)]))
        h, home = h[keep], home[keep]
        return _pdf([(b, _packed(np.diff(h[rows], prepend=np.uint64(0)))) for b, rows in _dealt(home, n)])

    def segments(docs_pdf, marks_pdf):  # noqa: ANN001, ANN202
        """Of a bucket of documents the strings with repeated anchors, by anchor, and the places of them, to itself."""
        if not len(marks_pdf):
            return _pdf([])
        shared = np.sort(np.concatenate([np.cumsum(_unpacked(raw)[0], dtype=np.uint64) for raw in marks_pdf["raw"]]))
        found: dict[bytes, int] = {}
        anchors_: list[int] = []
        contents, docs_, places = [], [], []
        for group, raw, ends in _groups(docs_pdf):
            first, count, h = made.of(raw, ends)
            rows = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h)
            of = np.searchsorted(ends, first[rows], side="right")
            whole, content = raw.tobytes(), np.empty(len(rows), np.int64)
            for j, (a, c, x) in enumerate(zip(first[rows].tolist(), count[rows].tolist(), h[rows].tolist(), strict=True)):
                content[j] = k = found.setdefault(whole[a : a + c + size - 1], len(found))
                if k == len(anchors_):
                    anchors_.append(x)
            contents.append(content)
            docs_.append(group[of])
            places.append(first[rows] - np.r_[0, ends][of])
        content, doc, pos = (np.concatenate(x) for x in (contents, docs_, places))
        if not len(content):
            return _pdf([])
        ids, ths = docs_pdf["doc"].to_numpy(np.int64), docs_pdf["th"].to_numpy(np.int64)
        _, low, high = _least_and_greatest(content, ids[doc], ids[doc])
        home, anchor, strings = int(docs_pdf["bucket"].iat[0]), np.array(anchors_, np.uint64), list(found)
        bucket = (anchor % np.uint64(n)).astype("<u4")
        used, d = np.unique(doc, return_inverse=True)
        small = "<u4" if pos.max() < 1 << 32 else np.int64
        out = [(home, _PLACES + _packed(bucket, content.astype("<u4"), d.astype("<u4"), pos.astype(small), ids[used], ths[used]))]
        for b, mine in _dealt(bucket, n):
            text = [strings[k] for k in mine.tolist()]
            out.append((b, _STRINGS + _packed(home, anchor[mine], np.array([len(t) for t in text], "<u2"), low[mine], high[mine] - low[mine], b"".join(text))))
        return _pdf(out)

    def covered(pdf):  # noqa: ANN001, ANN202
        """Of a bucket of strings the least document of each window, to the buckets that sent it; places go on as they are."""
        number: dict[bytes, int] = {}
        anchor: list[int] = []
        sent: list[tuple[int, np.ndarray, np.ndarray]] = []
        owns, lows, out = [], [], []
        me = int(pdf["bucket"].iat[0])
        for raw in pdf["raw"]:
            if raw[:1] == _PLACES:
                out.append((me, raw))
                continue
            home, a, lengths, low, more, text = _unpacked(raw[1:])
            edge = np.r_[0, np.cumsum(lengths.astype(np.int64))].tolist()
            own = np.empty(len(a), np.int64)
            for k, x in enumerate(a.tolist()):
                own[k] = m = number.setdefault(text[edge[k] : edge[k + 1]], len(number))
                if m == len(anchor):
                    anchor.append(x)
            sent.append((home, own, low + more))
            owns.append(own)
            lows.append(low)
        if not sent:
            return _pdf(out)
        least = np.full(len(number), LAST)
        np.minimum.at(least, np.concatenate(owns), np.concatenate(lows))
        strings = list(number)
        windows = np.array([len(s) - size + 1 for s in strings], np.int64)
        # only segments whose anchor has others can share a window with them
        _, kind, kinds = np.unique(np.array(anchor, np.uint64), return_inverse=True, return_counts=True)
        some, rest = np.flatnonzero(kinds[kind] > 1), np.flatnonzero(kinds[kind] == 1)
        runs = [(rest, np.zeros(len(rest), np.int64), windows[rest], least[rest])]
        some = some[np.argsort(kind[some], kind="stable")]
        first = np.flatnonzero(np.r_[True, np.diff(kind[some]) != 0][: len(some)])
        before = (np.cumsum(windows[some]) - windows[some])[first]  # windows of the kinds before
        for group in np.split(some, first[1:][np.diff(before // WINDOWS) > 0]) if len(some) else ():
            text = b"".join(strings[k] for k in group.tolist()) + b"\0" * 8
            begin = np.cumsum(windows[group] + size - 1) - windows[group] - size + 1
            of, *run = least_of_windows(text, begin, windows[group], least[group], size)
            runs.append((group[of], *run))
        of, offset, count, low = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(strings) + 1))
        for home, own, high in sent:
            run, place = _spread(edge, own)
            run = order[run]
            hit = low[run] < high[place]  # else none of its documents comes later
            run, place = run[hit], place[hit]
            if len(run):
                out.append((home, _ANSWERS + _packed(me, place.astype("<u4"), offset[run].astype("<u2"), count[run].astype("<u2"), low[run])))
        return _pdf(out)

    def windows_of(raws: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """The covered windows of each document of a bucket, from its places and the answers."""
        places = [raw for raw in raws if raw[:1] == _PLACES]
        answers = [_unpacked(raw[1:]) for raw in raws if raw[:1] == _ANSWERS]
        if not places or not answers:
            return {}
        bucket, content, d, pos, ids, ths = _unpacked(places[0][1:])
        mine = dict(_dealt(bucket, n))
        string = np.concatenate([mine[b][place] for b, place, *_ in answers])
        offset, count, low = (np.concatenate([x[k] for x in answers]) for k in (2, 3, 4))
        order = np.argsort(string, kind="stable")
        edge = np.searchsorted(string[order], np.arange(len(bucket) + 1))
        run, place = _spread(edge, content.astype(np.int64))
        run = order[run]
        hit = low[run] < ids[d[place]]
        run, place = run[hit], place[hit]
        of = d[place]
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(ids) + 1)).tolist()
        start, count = (pos[place].astype(np.int64) + offset[run])[order], count[run].astype(np.int64)[order]
        return {key: (start[edge[k] : edge[k + 1]], count[edge[k] : edge[k + 1]]) for k, key in enumerate(zip(ids.tolist(), ths.tolist(), strict=True)) if edge[k] < edge[k + 1]}

    def cut(docs_pdf, marks_pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        marks = windows_of(list(marks_pdf["raw"]))
        out = []
        for doc, th, no_id, z in zip(*(docs_pdf[c] for c in ("doc", "th", "no_id", "text")), strict=True):
            raw = zstandard.decompress(z)
            kept, removed, spans = raw, 0, 0
            if mine := marks.get((doc, th)):
                start, count = mine
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + count + size - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((None if no_id else doc, len(raw), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        return frame.astype({"doc_id": "Int64"})

    texts = map_arrow(docs.select("doc_id", text_hash().alias("th"), "text"), compress, "bucket int, doc long, th long, no_id boolean, text binary")
    by_text = texts.groupBy("bucket")
    by_anchor = by_text.applyInPandas(anchors, _BLOCKS).groupBy("bucket").applyInPandas(repeated, _BLOCKS)
    found = by_text.cogroup(by_anchor.groupBy("bucket")).applyInPandas(segments, _BLOCKS)
    told = found.groupBy("bucket").applyInPandas(covered, _BLOCKS)
    return by_text.cogroup(told.groupBy("bucket")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
