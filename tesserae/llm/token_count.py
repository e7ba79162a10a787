"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers run one after the other.

The first reads classes of characters and says where the pre-tokenizer cuts. It has a dozen states,
so a chunk of text is a map from states to states: all chunks run in step from every state at once,
the maps compose in a parallel prefix scan, and with each chunk's entry state known a second run
emits the cuts. Documents are joined by a reset symbol, so chunks need not respect them.

The second reads the bytes of a piece between cuts. Its state says, for each earlier position from
which a token could still reach beyond the present one, where in the token trie it stands, the last
token of the encoding up to that position and its count relative to now. Exactly one token ends the
encoding of each prefix; its transition is annotated with how the number of tokens changes.
States are compiled when first met and kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.text import alone, blocks, map_arrow

#: Classes of characters for the first transducer.
RESET, BLANK, SPACE, NUMBER, APOSTROPHE, OTHER, LETTER, L_STMD, L_RV, L_E, L_L = range(11)
CLASSES = 11
#: Its states: a new piece is due; within letters, numbers, others; white space of one or more characters,
#: the last a blank or not; an apostrophe that began a piece; after it r or v, or l.
NEW, IN_L, IN_N, IN_O, ONE_B, MORE_B, ONE_S, MORE_S, APO, APO_RV, APO_L = range(11)
STATES = 11


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """next state and emission of each (state, class): 1 cuts before this character, 2 before the one before, 3 both."""
    letters = (LETTER, L_STMD, L_RV, L_E, L_L)
    kind = {RESET: NEW, BLANK: ONE_B, SPACE: ONE_S, NUMBER: IN_N, APOSTROPHE: APO, OTHER: IN_O} | dict.fromkeys(letters, IN_L)
    to, cut = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for c in range(CLASSES):
        white, letter = c in (BLANK, SPACE), c in letters
        run = IN_L if letter else IN_N if c == NUMBER else IN_O
        for s in range(STATES):
            goes, emits = kind[c], 1  # a new piece begins here
            if c == RESET:
                emits = 3 if s in (APO_RV, APO_L) else 1
            elif s == IN_L and letter or s == IN_N and c == NUMBER or s == IN_O and c in (OTHER, APOSTROPHE):
                goes, emits = s, 0
            elif s in (ONE_B, MORE_B, ONE_S, MORE_S) and white:
                goes, emits = MORE_B if c == BLANK else MORE_S, 0
            elif s == ONE_B:
                goes, emits = run, 0  # the blank belongs to what follows
            elif s == MORE_B:
                goes, emits = run, 2
            elif s == MORE_S:
                emits = 3
            elif s == APO and c in (OTHER, APOSTROPHE):
                goes, emits = IN_O, 0
            elif s == APO and c == L_STMD:
                goes, emits = NEW, 0
            elif s == APO and c in (L_RV, L_L):
                goes, emits = APO_RV if c == L_RV else APO_L, 0
            elif s == APO_RV and c == L_E or s == APO_L and c == L_L:
                goes, emits = NEW, 0
            elif s in (APO_RV, APO_L):  # no contraction: the letter began a piece
                goes, emits = (IN_L, 2) if letter else (kind[c], 3)
            to[s, c], cut[s, c] = goes, emits
    return to, cut


def class_table() -> np.ndarray:
    r"""The class of every code point, by \p{L}, \p{N} and \s."""
    import regex

    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = c
    for chars, c in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", L_STMD), ("rv", L_RV), ("e", L_E), ("l", L_L)):
        table[[ord(x) for x in chars]] = c
    return table


class Cutter:
    """The first transducer over long strings of classes."""

    def __init__(self, chunk: int = 256):
        self.to, self.cut = _cutter()
        self.chunk = chunk

    def maps(self, grid: np.ndarray) -> np.ndarray:
        """For each chunk (row of classes) the map from entry to exit state."""
        flat = self.to.reshape(-1).astype(np.int16)
        now = np.tile(np.arange(STATES, dtype=np.int16)[:, None], (1, len(grid)))
        for k in range(grid.shape[1]):
            now = flat[now * CLASSES + grid[:, k]]
        return now.T

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of maps [chunk, state], in log2(chunks) parallel steps."""
        out, step = maps.copy(), 1
        while step < len(out):
            out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
            step *= 2
        return out

    def cuts(self, classes: np.ndarray) -> np.ndarray:
        """For each position whether a piece begins there. The string starts anew at its first character."""
        n = len(classes)
        grid = np.full(-(-max(n, 1) // self.chunk) * self.chunk, RESET, np.int16)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(-1, self.chunk))
        exits = self.scan(self.maps(grid))
        now = np.full(len(grid), NEW, np.int16)
        now[1:] = exits[:-1, NEW]
        to, cut = self.to.reshape(-1).astype(np.int16), self.cut.reshape(-1)
        emits = np.empty(grid.shape, np.uint8)
        for k in range(self.chunk):
            at = now * CLASSES + grid[:, k]
            emits[:, k] = cut[at]
            now = to[at]
        flat = emits.reshape(-1)
        begins = flat & 1
        begins[:-1] |= flat[1:] >> 1
        return begins[:n].astype(bool)


class Pieces:
    """The second transducer: tokens of a piece of bytes."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], most_states: int = 500_000):
        self.vocabulary, self.most_states = vocabulary, most_states
        self.rank = {pair: k for k, pair in enumerate(merges)}
        made = {a + b: (a, b) for a, b in merges}
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        never = len(merges)
        for t in vocabulary:
            # what stands at a token's edge as its merges are made, and the rank of the merge that ends each
            for edge, side in ((self.left, 0), (self.right, 1)):
                spine, until = [(t, never)], t
                while until in made:
                    spine.append((made[until][side], self.rank[made[until]]))
                    until = made[until][side]
                edge[t] = spine[::-1]
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in vocabulary:
            at = 0
            for b in t:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                at = self.trie[at][b]
            self.token[at] = t
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        self.step: dict[int, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, b"", 0),)]
        self.number = {self.states[0]: 0}
        self.step.clear()
        self.stands.clear()

    def side_by_side(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b: at no time is the merge across the boundary due first."""
        found = self.stands.get((a, b))
        if found is None:
            found, i, j, rank = True, 0, 0, self.rank
            x, y = self.right[a], self.left[b]
            while True:
                (p, until_p), (q, until_q) = x[i], y[j]
                due = rank.get((p, q))
                if due is not None and due < until_p and due <= until_q:
                    found = False
                    break
                if i + 1 == len(x) and j + 1 == len(y):
                    break
                if until_p <= until_q:
                    i += 1
                else:
                    j += 1
            self.stands[a, b] = found
        return found

    def compile(self, state: int, byte: int) -> int:
        """Adds the transition; its value is the next state times 2^16 plus 2^15 plus the change of the count."""
        live, ends = [], None
        for node, last, count in self.states[state]:
            to = self.trie[node].get(byte)
            if to is None:
                continue
            t = self.token[to]
            if ends is None and t is not None and (not last or self.side_by_side(last, t)):
                ends = (t, count + 1)
            if self.trie[to]:
                live.append((to, last, count))
        last, change = ends
        new = (*((n, t, c - change) for n, t, c in live), (0, last, 0))
        k = self.number.setdefault(new, len(self.states))
        if k == len(self.states):
            self.states.append(new)
        if k >= self.most_states:  # all are forgotten but the one that is due, even within a piece
            self._clear()
            k = self.number.setdefault(new, len(self.states))
            if k == len(self.states):
                self.states.append(new)
            return k << 16 | 32768 + change
        self.step[state << 8 | byte] = out = k << 16 | 32768 + change
        return out

    def count(self, piece: bytes) -> int:
        step, s, n = self.step.get, 0, 0
        for b in piece:
            v = step(s << 8 | b)
            if v is None:
                v = self.compile(s, b)
            s = v >> 16
            n += (v & 65535) - 32768
        return n


def _bytes_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for themselves, the others from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    #: Pieces whose count a worker remembers.
    remembered = 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        to = _bytes_of()
        raw = lambda t: bytes(to[c] for c in t)
        self.special = [t["content"] for t in told.get("added_tokens", []) if t["content"]]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in told.get("added_tokens", [])):
            raise ValueError(f"{path} has special tokens that take what is beside them")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocabulary = {raw(t): k for t, k in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pieces = Pieces(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.cutter, self.table = Cutter(), class_table()
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings are a token each."""
        extra = np.zeros(len(texts), np.int64)
        parts, edges, resets, at = [], np.zeros(len(texts) + 1, np.int64), [], 0
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                *spans, t = self.marks.split(t)  # the first that begins, of several the longest
                extra[k] = len(spans)
                for s in spans:
                    at += len(s) + 1
                    parts.append(s)
                    resets.append(at - 1)
            parts.append(t)
            at += len(t) + 1
            resets.append(at - 1)
            edges[k + 1] = at
        text = "\0".join(parts) + "\0" if parts else ""
        classes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        classes[resets] = RESET
        begins = self.cutter.cuts(classes)
        start = np.flatnonzero(begins)
        ends = np.r_[start[1:], len(classes)]
        whole = classes[start] != RESET
        start, ends = start[whole], ends[whole]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        cut = [text[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        for p in set(cut).difference(known):
            known[p] = self.pieces.count(p.encode("utf-8", "surrogatepass"))
        n = np.fromiter(map(known.__getitem__, cut), np.int64, len(cut))
        total = np.r_[0, np.cumsum(n)]
        return np.diff(total[np.searchsorted(start, edges)]) + extra


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    tokenizer: path of a byte-level BPE file on every worker. A null or empty text has no bytes and
    no tokens. Repeated rows and null ids are counted as they come; a text of any length is counted
    whole, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_COUNTERS)
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer)
        counter = _COUNTERS[tokenizer]
        for batch in batches:
            for block in blocks(batch, most=4_000_000):
                texts = [t or "" for t in block.column(1).to_pylist()]
                n = counter.count(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
