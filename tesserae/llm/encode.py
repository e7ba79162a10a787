"""Token ids of many texts by the tokenizers library, each distinct piece of text encoded once.

With a byte-level pre-tokenizer a blank or line break after a character that is no white space is
always a cut, and belongs to what follows; so is a comma or full stop between an ASCII letter or
digit and such a blank, or the text's end. Texts fall into pieces there, the library encodes the
pieces that a worker hasn't seen, and ids of whole texts are put together from them. The work on
each occurrence of a piece is done on whole columns: pieces of up to 15 bytes are looked up as
numbers in a hash table of arrays, longer ones in a dict. Texts with special strings, and all texts
where the tokenizer is of another kind, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tesserae.llm.text import alone

#: Bytes of pieces that a worker holds in each of two generations: as the younger one fills up, the older one is forgotten.
REMEMBERED = 70_000_000
#: What a piece takes besides its ids: in the hash table, or in the dict besides its bytes.
_SHORT, _LONG = 40, 150
#: Longest piece whose bytes and length are a key of two numbers.
_MOST = 15
#: Pieces that are looked up or put together at once.
_SLAB = 1 << 17
#: All that one library or another may take for white space.
_WHITE = [c for c in map(chr, range(1 << 16)) if c.isspace() or ord(c) in (0x180E, 0x200B, 0xFEFF)]
_SPACE = re.compile(f"[{''.join(map(re.escape, _WHITE))}]").search
_WHITE_2, _WHITE_3 = (np.array([int.from_bytes(c.encode(), "big") for c in _WHITE if len(c.encode()) == n]) for n in (2, 3))
_DELIM, _BLANK, _ALNUM, _MARK = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in _WHITE if c < "\x80"]] = _BLANK
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = _ALNUM
_CLASS[[ord(","), ord(".")]] = _MARK
_CLASS[[ord(" "), ord("\n")]] |= _DELIM
#: The lowest n bytes of a number.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each run of count, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class _Memo:
    """ids of pieces. Pieces have numbers from 0; short ones are found by open addressing in arrays, long ones in a dict."""

    __slots__ = ("at", "before", "ids", "key", "long", "n", "size", "slots")

    def __init__(self, before: _Memo | None = None):
        self.before = before or None
        self.n = 0
        self.size = 0  # ids held
        self.key = np.zeros((2, 1024), np.uint64)
        self.at = np.zeros(1025, np.int64)
        self.ids: np.ndarray | None = None
        self.slots = np.full(4096, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _place(self, key: np.ndarray) -> np.ndarray:
        h = (key[0] ^ key[1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of short pieces, -1 for those that aren't there."""
        place = self._place(key)
        out = self.slots[place]
        same = (self.key[0][out] == key[0]) & (self.key[1][out] == key[1])  # -1: whatever stands last
        rest = np.flatnonzero((out >= 0) & ~same)
        while rest.size:
            place[rest] = (place[rest] + 1) & (len(self.slots) - 1)
            out[rest] = found = self.slots[place[rest]]
            rest = rest[(found >= 0) & ((self.key[0][found] != key[0][rest]) | (self.key[1][found] != key[1][rest]))]
        return out

    def _seat(self, first: int) -> None:
        """Gives the short pieces from number first on their slots."""
        new = np.flatnonzero(self.key[1, first : self.n]) + first
        place = self._place(self.key[:, new])
        while new.size:
            free = self.slots[place] < 0
            self.slots[place[free]] = new[free]
            rest = np.flatnonzero(self.slots[place] != new)
            new, place = new[rest], (place[rest] + 1) & (len(self.slots) - 1)

    def add(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Takes different pieces that aren't there and gives their numbers. Long pieces have key 0; the caller puts them in the dict."""
        first, self.n = self.n, self.n + len(count)
        if self.n > self.key.shape[1]:
            most = max(self.n, 2 * self.key.shape[1])
            old = self.key, self.at
            self.key, self.at = np.zeros((2, most), np.uint64), np.zeros(most + 1, np.int64)
            self.key[:, :first], self.at[: first + 1] = old[0][:, :first], old[1][: first + 1]
        self.key[:, first : self.n] = key
        self.at[first + 1 : self.n + 1] = self.size + np.cumsum(count)
        if self.ids is None or self.size + len(ids) > len(self.ids):
            old = self.ids
            self.ids = np.empty(max(4096, 2 * self.size, self.size + len(ids)), ids.dtype)
            if old is not None:
                self.ids[: self.size] = old[: self.size]
        self.ids[self.size : self.size + len(ids)] = ids
        self.size += len(ids)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n - 1).bit_length(), -1, np.int32)
            self._seat(0)
        else:
            self._seat(first)
        return np.arange(first, self.n)

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        start = self.at[number]
        count = self.at[number + 1] - start
        return self.ids[_runs(start, count)], count


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = not told.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.by_piece = self.by_piece and all(t.startswith("<|") for t in self.special)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = _Memo()
        self.held, self.remembered = 0, REMEMBERED
        # with blanks between them only a piece's first token begins with a blank, and only a line's first piece with a line break
        self.blank = np.array([(self.lib.id_to_token(k) or "").startswith("Ġ") for k in range(self.lib.get_vocab_size())])
        self.line = np.zeros(len(self.blank), bool)
        self.line[np.frombuffer(self._whole(["\n"])[0], self.dtype)] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        r"""The ids of pieces, and how many each has. One that starts with \0 begins a text and stands for what comes after it."""
        blank, line, other = [], [], []
        for k, p in enumerate(pieces):
            kind = blank if p[0] == 32 else line if p[0] == 10 else other
            (kind if p[1:].isalpha() or kind is not other and len(p) > 1 and not _SPACE(p.decode(), 1) else other).append(k)
        ids, counts, order = [np.zeros(0, self.dtype)], [], []
        for some, begins in ((blank, self.blank), (line, self.line)):
            for at in range(0, len(some), 1000):
                part = some[at : at + 1000]
                (raw,) = self._whole([b"".join([pieces[k] for k in part]).decode()])
                ids.append(np.frombuffer(raw, self.dtype))
                start = np.flatnonzero(begins[ids[-1]])
                if len(start) != len(part):
                    raise AssertionError("pieces and their ids differ in number")
                counts.append(np.diff(start, append=len(ids[-1])))
                order += part
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            raw = self._whole([(pieces[k][1:] if pieces[k][0] == 0 else pieces[k]).decode() for k in part])
            ids.append(np.frombuffer(b"".join(raw), self.dtype))
            counts.append(np.array([len(r) // self.dtype.itemsize for r in raw]))
            order += part
        flat, count = np.concatenate(ids), np.concatenate([np.zeros(0, np.int64), *counts])
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))  # back in the order of pieces
        return flat[_runs((np.cumsum(count) - count)[at], count[at])], count[at]

    def _aged(self) -> None:
        if self.held > self.remembered:
            old = self.known
            old.before = None
            self.known, self.held = _Memo(old), 0

    def _add(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        self.held += _SHORT * len(count) + ids.nbytes
        return self.known.add(key, ids, count)

    def _numbers(self, data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the pieces at begin in data, which ends with 16 bytes more; new ones are learned."""
        known, before = self.known, self.known.before
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        key = np.stack([words[begin] & _LOWEST[np.minimum(length, 8)], words[begin + 8] & _LOWEST[np.clip(length - 8, 0, 7)] | length.astype(np.uint64) << np.uint64(56)])
        long = np.flatnonzero(length > _MOST)
        key[:, long] = 0
        out = known.find(key)  # no short piece has the key 0
        new = np.flatnonzero(out < 0) if not long.size else np.flatnonzero((out < 0) & (length <= _MOST))
        if new.size:
            order = new[np.lexsort((key[1, new], key[0, new]))]
            differs = (np.diff(key[:, order], axis=1) != 0).any(axis=0)
            first = order[np.r_[True, differs]]
            number = np.full(len(first), -1, np.int64)
            if before:
                had = before.find(key[:, first])
                if (there := np.flatnonzero(had >= 0)).size:
                    number[there] = self._add(key[:, first[there]], *before.ids_of(had[there]))
            rest = np.flatnonzero(number < 0)
            pieces = [data[a : a + n] for a, n in zip(begin[first[rest]].tolist(), length[first[rest]].tolist(), strict=True)]
            number[rest] = self._add(key[:, first[rest]], *self._learn(pieces))
            out[order] = number[np.r_[0, np.cumsum(differs)]]
        if long.size:
            pieces = [data[a : a + n] for a, n in zip(begin[long].tolist(), length[long].tolist(), strict=True)]
            unseen = [p for p in dict.fromkeys(pieces) if p not in known.long]
            old = [p for p in unseen if before and p in before.long]
            if old:
                number = self._add(np.zeros((2, len(old)), np.uint64), *before.ids_of(np.array([before.long[p] for p in old])))
                known.long |= zip(old, number.tolist(), strict=True)
            new = [p for p in unseen if p not in known.long]
            number = self._add(np.zeros((2, len(new)), np.uint64), *self._learn(new))
            known.long |= zip(new, number.tolist(), strict=True)
            self.held += sum(map(len, unseen)) + (_LONG - _SHORT) * len(unseen)
            out[long] = [known.long[p] for p in pieces]
        return out

    def _by_piece(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data = b"\0" + b"\0".join(raw) + bytes(17)
        size = np.array([len(b) + 1 for b in raw])
        begin = np.cumsum(size) - size
        end = int(size.sum())
        at = np.frombuffer(data, np.uint8)
        kind = _CLASS[at[: end + 1]]
        kind[begin] = kind[end] = _DELIM | _BLANK
        delim = kind & _DELIM
        cut = np.zeros(end + 1, bool)
        cut[1:] = (delim[1:] > 0) & (kind[:-1] & _BLANK == 0)
        # white space of two and three bytes
        far = np.flatnonzero(cut[3:] & (at[2:end] > 127)) + 3
        pair = at[far - 2].astype(np.int64) << 8 | at[far - 1]
        cut[far[np.isin(pair, _WHITE_2) | np.isin(at[far - 3].astype(np.int64) << 16 | pair, _WHITE_3)]] = False
        # a mark, after a letter or digit and before a cut
        cut[1:-1] |= (kind[1:-1] & _MARK > 0) & (kind[:-2] & _ALNUM > 0) & (delim[2:] > 0)
        cut[begin] = cut[end] = True
        place = np.flatnonzero(cut)
        length = np.diff(place)
        ids, counts = [], []
        for a in range(0, len(length), _SLAB):
            some = slice(a, a + _SLAB)
            flat, count = self.known.ids_of(self._numbers(data, place[:-1][some], length[some]))
            ids.append(flat)
            counts.append(count)
        flat, total = np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(counts))]
        bound = total[np.searchsorted(place, [*begin, end])].tolist()
        return [flat[a:b] for a, b in zip(bound, bound[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids for each text; null counts as empty."""
        out: list = [np.zeros(0, self.dtype)] * len(texts)
        self._aged()
        parts: list[int] = []
        whole: list[int] = []
        for k, t in enumerate(texts):
            if t:
                (whole if not self.by_piece or "<|" in t and any(s in t for s in self.special) else parts).append(k)
        for some, how in ((parts, self._by_piece), (whole, self._plain)):
            for k, ids in zip(some, how([texts[k] for k in some]) if some else [], strict=True):
                out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, self.dtype) for b in self._whole(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file, which every worker has at this path; from now on it remembers so many bytes a generation."""
    alone(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].remembered = remembered
    return _ENCODERS[path]
