"""Each operator against a brute-force version on awkward documents, and on nothing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import decontam, embed_dedup, encode, graph, id_planes, lang_id, license_scan, line_dedup, packing, simhash, suffix_dedup, token_count
from tests.llm import fixture as X

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(df, *cols) -> Counter:
    return Counter(map(tuple, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


# 1


def brute_hits(text, items, window=10):
    w = decontam.words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = decontam.words_of(t)
        n = min(window, len(iw))
        runs = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in runs:
                hit |= set(range(k, k + n))
                ids |= {item} - {None}
    return len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids))))


@pytest.mark.parametrize("shard_words", [2_000_000, 5])
def test_decontamination(spark, shard_words):
    out = decontam.scan(X.documents(spark, clash=True), X.benchmark(spark), shard_words=shard_words)
    assert "keep" in out.columns
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == Counter((d, *brute_hits(t, X.BENCHMARK)) for d, t, _ in X.rows())


def test_shards_have_a_bound(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    items = spark.createDataFrame([(k, f"{long} {k}") for k in range(3)] + [(9, "short one")], "item_id long, text string")
    shards = decontam.Shards(items, 10, 800)
    sizes = [sum(len(w) for _, w in shards[k]) for k in range(shards.count)]
    assert len(sizes) > 15 and max(sizes) < 2000 and sum(sizes) < 17_500 * 1.2
    runs = {(i, tuple(w[a : a + 10])) for k in range(shards.count) for i, w in shards[k] for a in range(len(w) - 9)}
    words = decontam.words_of(long)
    assert all(("1", tuple([*words, b"1"][a : a + 10])) in runs for a in range(4992))


@pytest.mark.parametrize("shard_words", [2_000_000, 5])
def test_decontaminate_cuts_all(spark, shard_words):
    docs = X.documents(spark)
    out = decontam.decontaminate(docs, X.benchmark(spark), shard_words=shard_words)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert 71 not in texts and 72 not in texts and X.PASSAGE not in texts[70] and len(texts[70]) > 100
    assert all(brute_hits(t, X.BENCHMARK)[1] == 0 for t in texts.values())
    assert {d for d, t, _ in X.rows() if not brute_hits(t, X.BENCHMARK)[1]} <= set(texts)


@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6), st.lists(st.integers(0, 4), max_size=40), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_automaton(items, doc, window):
    named = [(k, [b"%d" % x for x in i]) for k, i in enumerate(items)]
    machine = decontam.Automaton([x for x in named if x[1]], window)
    spans, found = machine.scan([b"%d" % x for x in doc])
    want = brute_hits(" ".join(map(str, doc)), [(k, b" ".join(i).decode()) for k, i in named], window)
    assert (sum(b - a for a, b in spans), len(found)) == want[1:3]


# 2


def brute_licenses(words, templates, least=0.8):
    """For each template the best share of its shingles over all windows of the text, where that is enough."""
    runs = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    out = {}
    for t, (_, text) in enumerate(templates):
        w = decontam.words_of(text)
        c = Counter(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        n = sum(c.values())
        if n and runs:
            best = max(sum(min(m, h[x]) for x, m in c.items()) for h in (Counter(runs[a : a + n]) for a in range(max(1, len(runs) - n + 1)))) / n
            if best >= least:
                out[t] = best
    return out


def test_licenses(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, f"{body} {t} {body}") for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(90, None), (91, ""), (92, body * 3), (93, "word " * 30_000 + license_scan.TEMPLATES[10][1]), (None, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as matches", "'x' as n_matches", "2 as name")
    out = license_scan.scan_licenses(df).collect()
    assert len(out) == len(rows) and out[0].name == 2
    for r in out:
        want = brute_licenses(decontam.words_of(r.text)[-400:], license_scan.TEMPLATES)
        assert r.licenses == sorted({license_scan.TEMPLATES[t][0] for t in want}) and r.n_matches >= len(want) and len(want) == len({m.name + str(m.end - m.start) for m in r.matches} | set()) or r.doc_id == 93
        assert (r.doc_id in (90, 91, 92)) == (r.n_matches == 0)
    assert next(r for r in out if r.doc_id == 93).licenses == ["MIT"]


@pytest.mark.parametrize("sizes", [None, (400, 900), (3, 30)])
def test_licenses_equal_all_windows(sizes):
    """Built-in and long templates with edits against every window: what bands retrieve loses nothing."""
    r = random.Random(4)
    templates = list(license_scan.TEMPLATES)
    if sizes:
        vocabulary = [f"v{k}" for k in range(400)]
        templates = [(f"t{k}", " ".join(r.choices(vocabulary, k=r.randrange(*sizes)))) for k in range(6)] + [("none", ""), ("same", "tie tie tie tie tie tie tie")]
    s = license_scan.Scanner(templates)
    pool = [w for _, t in templates for w in t.split()]
    known = matched = 0
    for _ in range(60 if sizes == (400, 900) else 150):
        t = templates[r.randrange(len(templates))][1].split()
        for _ in range(r.randrange(0, 2 + len(t) // 25)):
            if t:
                at = r.randrange(len(t))
                t[at : at + r.randrange(0, 2)] = r.choices(pool, k=r.randrange(0, 2))
        words = decontam.words_of(" ".join(r.choices(pool, k=r.randrange(0, 40)) + t + r.choices(pool, k=r.randrange(0, 40))))
        want = brute_licenses(words, templates)
        got_ = s.scan(words)
        best = {}
        for m in got_:
            best[m[0]] = max(best.get(m[0], 0), m[3])
        assert best == want
        known += len(want)
        matched += len(set(s.candidates(words)) & set(want)) if words else 0
    assert known > 40 and matched == known  # the recall of the bands


# 3


def test_packing(spark, lib):
    docs = [r for r in X.rows() if r[0] is not None and r[0] not in (5, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).withColumn("length", F.lit("x"))
    out = packing.pack(df, BPE).toPandas()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in docs}
    for d, pieces in out.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids[d])) and p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    assert set(out.doc_id) == set(ids)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packing.pack(X.documents(spark), BPE).agg(F.sum("length")).first()[0] == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in X.rows())


@given(st.integers(1, 120), st.data())
@settings(max_examples=120, deadline=None)
def test_cuts_are_best(n, data):
    length, grid = 16, 5
    ends = np.array(sorted({n, *data.draw(st.lists(st.integers(1, n), max_size=8))}))
    sentences = np.array(sorted(set(data.draw(st.lists(st.integers(1, n), max_size=12)))), np.int64)
    best = packing.cuts(n, ends, sentences, length=length, grid=grid)
    pen = {int(p): 2 for p in range(n + 1)} | {int(p): 1 for p in sentences} | {int(p): 0 for p in ends} | {0: 0}
    fixed = sorted({0, *map(int, ends), *map(int, sentences)})
    allowed = set(fixed) | {x for a, b in zip(fixed, fixed[1:], strict=False) if b - a > grid for x in range(a + grid, b, grid)}
    cost = lambda a, b: pen[b] + (0 if b - a in (32, 64, 128, 256, 512) else length - (b - a))
    f = {0: 0}
    for j in sorted(allowed - {0}):
        f[j] = min(f[i] + cost(i, j) for i in allowed if 0 < j - i <= length)
    assert best[0] == 0 and best[-1] == n and sum(cost(a, b) for a, b in zip(best, best[1:], strict=False)) == f[n]


@pytest.mark.parametrize("length,sizes", [(16, [700, 3, 40, 15, 16, 17]), (1, [5, 1]), (32_768, [32_768] * 40), (65_536, [300_000] * 9 + [5]), (1024, [3_000_000, 12])])
def test_packer_ends_at_any_length(length, sizes):
    packer = packing.Packer(np.zeros(10, bool), 0, length)
    rows = []
    for k, n in enumerate(sizes):
        rows += packer.add(k, np.full(n, k % 10, np.uint16))
    rows += packer.end()
    at = dict.fromkeys(range(len(sizes)), 0)
    fill: dict[int, int] = {}
    for doc, start, n, _, total, sequence, offset in rows:
        assert start == at[doc] and total == sizes[doc] and n > 0 and offset == fill.get(sequence, 0)
        at[doc] += n
        fill[sequence] = offset + n
    assert list(at.values()) == sizes and max(fill.values()) <= length
    assert [s for s, n in fill.items() if n & (n - 1) and n < length * 0.9] == [] or len(fill) < 10


@pytest.mark.parametrize("held", [1, 3000])
def test_encoder_forgets(lib, monkeypatch, held):
    monkeypatch.setattr(encode, "REMEMBERED", held)
    e = encode.Encoder(BPE)
    texts = [t for _, t, _ in X.rows()] + ["a  b\tc d.\n\n e f\n", "d. d. d"]
    for k in range(0, len(texts), 3):
        some = texts[k : k + 3] + texts[:2]
        assert [x.tolist() for x in e.encode(some)] == [lib.encode(t or "", add_special_tokens=False).ids for t in some]


# 4


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    low = {}
    for f, d in zip(fps, ids, strict=True):
        if d is not None:
            low[root(f)] = min(low.get(root(f), d), d)
    return [low.get(root(f)) for f in fps]


def test_simhash(spark):
    fps = [brute_fingerprint(t) for _, t, _ in X.rows()]
    ids = [d for d, _, _ in X.rows()]
    want = Counter(zip(ids, [f - (1 << 64) if f >> 63 else f for f in fps], brute_components(fps, ids), strict=True))
    assert got(simhash.near_groups(X.documents(spark, clash=True)), "doc_id", "fp", "component_id") == want


def test_one_of_each(spark):
    docs = X.documents(spark, clash=True)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(set(ids)) == ids or len(ids) == len(set(ids))
    assert 40 in ids and not set(range(41, 55)) & set(ids) and 80 in ids and 81 not in ids


@pytest.mark.parametrize("block", [4096, 7])
def test_links_find_every_pair(spark, monkeypatch, block):
    r = random.Random(7)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(r.randrange(0, 12)):
            for b in r.sample(range(64), r.randrange(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", block)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parts = {r.node & (1 << 64) - 1: r.component for r in graph.components(simhash.links(frame)).collect()}
    want = brute_components(fps, list(range(len(fps))))
    mine = [parts.get(f, f) for f in fps]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want, strict=True)))


def test_covering():
    near, seconds = simhash._nearest()
    v = np.arange(1 << 15)
    assert (np.bitwise_count(near ^ v) <= 1).all() and len(np.unique(near)) == 1 << 11
    assert all((np.bitwise_count(s[s >= 0] ^ v[s >= 0]) == 2).all() and np.isin(s[s >= 0], near).all() for s in seconds)


def test_star_is_no_hot_key(spark):
    n = 100_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    out = graph.components(star)
    assert out.count() == n and out.where("component <> 0").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tagged = graph.with_lowest(star, "a", "b", "low", n - 1)
        assert tagged.where("low = 1").count() == n - 1
        sizes = [len(x) for x in tagged.select("b").rdd.glom().collect()]
        assert max(sizes) < 2 * n / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    out = {r.node: r.component for r in graph.components(links).collect()}
    assert out == {k: 0 for k in range(101)} | {200: 200, 201: 200}
    assert graph.components(links.limit(0)).count() == 0


# 5


def bytes_removed(rows: list[tuple]) -> Counter:
    seen: dict[bytes, int] = {}
    last = 1 << 62
    parts = sorted(((last if d is None else d), (t or "").encode()) for d, t, _ in rows)
    grams = [(d, [t[p : p + 50] for p in range(len(t) - 49)]) for d, t in parts]
    for d, g in grams:
        for s in g:
            seen[s] = min(seen.get(s, d), d)
    want = Counter()
    for (d, g), (_, t) in zip(grams, parts, strict=True):
        gone = np.zeros(len(t), bool)
        for p, s in enumerate(g):
            if seen[s] < d:
                gone[p : p + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        want[None if d == last else d, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())] += 1
    return want


def test_suffix_dedup(spark):
    assert got(suffix_dedup.remove_repeats(X.documents(spark, clash=True)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(X.rows())


def test_suffix_dedup_of_a_passage_that_all_documents_have(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = some(90)
    rows = [(k // 2 * 3 - 50, some(r.randrange(120)) + common[r.randrange(20) :] + some(r.randrange(60)), "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert got(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(rows)


@given(st.lists(st.binary(max_size=60), max_size=5), st.integers(2, 9))
@settings(max_examples=150, deadline=None)
def test_segments_have_each_window_once(texts, size):
    raw, ends = suffix_dedup._joined(texts) if texts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    first, count, _ = suffix_dedup.Segments(size, max(1, size // 2)).of(raw, ends)
    begin = [0, *ends.tolist()[:-1]] if texts else []
    assert [p for a, n in zip(first, count, strict=True) for p in range(a, a + n)] == [p for a, b in zip(begin, ends.tolist(), strict=True) for p in range(a, b - size + 1)]


@given(st.lists(st.sampled_from([b"a", b"b", b"ab"]), min_size=30, max_size=300), st.sampled_from([8, 16, 24]))
@settings(max_examples=80, deadline=None)
def test_deep_shallow(parts, shallow):
    text = b"".join(parts)
    size, starts = 20, np.arange(max(0, len(text) - 19))
    order, same = suffix_dedup.deep_shallow(text + b"\0" * 8, starts, size, shallow)
    strings = [text[k : k + size] for k in order.tolist()]
    assert strings == sorted(strings) and same.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]


@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"ab"]), min_size=20, max_size=40), st.integers(0, 5)), min_size=1, max_size=20), st.integers(1, 300), st.sampled_from([3, 8, 13, 20]))
@settings(max_examples=80, deadline=None)
def test_least_of_windows(strings, most, size):
    strings = [(b"".join(p), low) for p, low in strings]
    windows = np.array([len(s) - size + 1 for s, _ in strings])
    begin = np.cumsum([0, *(len(s) for s, _ in strings[:-1])])
    want: dict[bytes, int] = {}
    for s, low in strings:
        for k in range(len(s) - size + 1):
            want[s[k : k + size]] = min(low, want.get(s[k : k + size], low))
    runs = suffix_dedup.least_of_windows(b"".join(s for s, _ in strings) + b"\0" * 8, begin, windows, np.array([low for _, low in strings]), size, most)
    got_ = [(k, a + j, low) for k, a, n, low in zip(*(x.tolist() for x in runs), strict=True) for j in range(n)]
    assert got_ == [(k, a, want[s[a : a + size]]) for k, (s, _) in enumerate(strings) for a in range(len(s) - size + 1)]


def test_windows_of_one_anchor_are_ordered_in_bounded_parts(monkeypatch):
    """A passage that many documents have amid other texts: one anchor with many windows."""
    r, size, sizes, order = random.Random(6), 50, [], suffix_dedup.deep_shallow
    some = lambda n: bytes(r.choices(range(97, 123), k=n))
    middle = some(20)
    strings = [some(30) + middle + some(30) for _ in range(400)]
    monkeypatch.setattr(suffix_dedup, "deep_shallow", lambda text, starts, n: (sizes.append(len(starts)), order(text, starts, n))[1])
    suffix_dedup.least_of_windows(b"".join(strings) + b"\0" * 8, np.arange(400) * 80, np.full(400, 31), np.arange(400), size, most=1000)
    assert sum(sizes) == 400 * 31 and max(sizes) < 1500


def test_suffix_dedup_with_more_buckets_than_partitions(spark, monkeypatch):
    """A bucket has a bounded amount of text, whatever the number of partitions is."""
    sent, map_arrow = [], suffix_dedup.map_arrow
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1000, raising=False)
    monkeypatch.setattr(suffix_dedup, "map_arrow", lambda *a: sent.append(map_arrow(*a)) or sent[0])
    out = suffix_dedup.remove_repeats(X.documents(spark))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_removed(X.rows())
    assert sent[0].select("bucket").distinct().count() > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


# 6


def test_token_counts(spark, lib):
    want = Counter((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in X.rows())
    assert got(token_count.count_tokens(X.documents(spark, clash=True), BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


TEXT = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "'", "'re", "'ll", "1", "é", "ß", "!", "...", ",", ".", "<|endoftext|>", "<|", "\xa0", " ", "\x1c", "日本", "_", "r", "v", "l", "\0", "\x01,", "aaaa"]), max_size=16).map("".join)


@given(st.lists(st.one_of(TEXT, st.text(max_size=12)), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_counter_and_encoder_equal_the_library(texts):
    whole = [e.ids for e in encode.encoder(BPE).lib.encode_batch(texts, add_special_tokens=False)]
    if BPE not in token_count._COUNTERS:
        token_count._COUNTERS[BPE] = token_count.Counter(BPE)
    assert token_count._COUNTERS[BPE].count(texts).tolist() == [len(x) for x in whole]
    assert [x.tolist() for x in encode.encoder(BPE).encode(texts)] == whole


def test_counter_with_few_states_and_many_marks(lib):
    c = token_count.Counter(BPE)
    c.pieces.most_states = 50
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "<|endoftext|>" * 20_000 + "x<|endoftext|", "a" * 4000 + "é" * 300]
    assert c.count(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(c.pieces.states) <= 51


def test_prefix_scan_composes():
    r = np.random.default_rng(1)
    c = token_count.Cutter(chunk=4)
    classes = r.integers(0, token_count.CLASSES, 999)
    state, begins = token_count.NEW, np.zeros(1000, bool)
    for k, x in enumerate(classes):
        e = c.cut[state, x]
        begins[k] |= e & 1
        begins[k - 1] |= e >> 1
        state = c.to[state, x]
    assert (c.cuts(classes) == begins[:999]).all()


# 7


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 16))
    rows = [(k, (base[k % 30] + (r.normal(size=16) * 0.03 if k >= 30 else 0)).astype(np.float32).tolist(), k % 3) for k in range(200)]
    rows += [(300 + k, rows[0][1], 0) for k in range(20)] + [(330, [2 * x for x in rows[0][1]], 0), (331, rows[0][1], 1), (332, rows[0][1], None)]
    rows += [(340, None, 0), (341, [], 0), (342, [0.0] * 16, 0), (343, [float("nan")] + [1.0] * 15, 0), (344, [None] + [1.0] * 15, 0), (345, [float("inf")] * 16, 0), (346, [1.0, 0.0], 0), (347, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumn("key", F.lit("x")).withColumn("cell", F.lit(1))
    ok = lambda v, label: label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    links = {d: set() for d, _, _ in rows}
    for d, v, label in rows:
        for e, w, other in rows:
            if d != e and label == other and ok(v, label) and ok(w, other) and len(v) == len(w):
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[d].add(e)
    low = {d: d for d in links}
    for _ in links:
        low = {d: min([low[d], *(low[e] for e in links[d])]) for d in links}
    want = Counter((d, len(links[d]), low[d], low[d] == d) for d in links)
    plain = embed_dedup.pivots
    for homes, members, per_cell in ((4096, 16_384, 1024), (40, 60, 1024), (30, 17, 9)):
        monkeypatch.setattr(embed_dedup, "HOMES", homes)
        monkeypatch.setattr(embed_dedup, "MEMBERS", members)
        monkeypatch.setattr(embed_dedup, "pivots", lambda g, kind, n=per_cell: plain(g, kind, per_cell=n))
        assert got(embed_dedup.near_groups(df), "vec_id", "n_links", "component_id", "kept") == want
    groups = df.limit(0)
    assert embed_dedup.near_groups(groups).count() == 0


def test_embeddings_of_other_types(spark):
    rows = [(1, [1e300, 1e300], 1.2), (2, [1e300, 1e300], 1.2), (3, [1e300, 1e300], 1.5), (4, [1.0, 1.0 + 1e-12], 1.5), (5, [3e-310, 3e-310], 1.5), (7, [1.0, -1.0], 1.2), (7, [1.0, -1.0], 1.2), (7, [1.0, 1.0], 1.2), (None, [1.0, 1.0], 1.2), (8, [-0.0, 1.0], -0.0), (9, [0.0, 1.0], 0.0)]
    want = Counter([(1, 3, 1, True), (2, 3, 1, False), (7, 3, 1, False), (None, 3, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    assert got(embed_dedup.near_groups(df), "vec_id", "n_links", "component_id", "kept") == want
    text = df.where("vec_id < 6").withColumn("label", F.concat(F.lit("l/"), F.col("label").cast("string")))
    assert got(embed_dedup.near_groups(text), "vec_id", "n_links") == Counter([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)])
    assert embed_dedup.near_groups(df.withColumn("label", F.lit(None).cast("string"))).where("n_links > 0 or component_id <> vec_id").count() == 0


def test_reach_loses_no_neighbour():
    r = np.random.default_rng(3)
    for size, spread in ((2, 1.0), (5, 0.5), (64, 1.0)):
        v = r.normal(size=(400, size)) * spread + r.normal(size=(8, size)).repeat(50, 0)
        v = np.concatenate([v, v + r.normal(size=v.shape) * 0.05])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        p = np.concatenate([v[:40:2], v[:1]])
        home, _, near = embed_dedup.reach(v, p, 0.2)
        i, j = np.nonzero(v @ v.T >= 1 - 0.2**2 / 2)
        assert len(i) > 1000 and near[i, home[j]].all()


# 8


def brute_lines(min_docs, keep_first=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    docs = {}
    for d, t, _ in X.rows():
        for x in (t or "").split("\n"):
            docs.setdefault(key(x), set()).add(d)
    gone = {k for k, v in docs.items() if k and len(v) >= min_docs}
    return key, gone


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_line_dedup(spark, parts):
    key, gone = brute_lines(10)
    want = Counter()
    for d, t, _ in X.rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        want[d, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(line_dedup.dedup_lines(X.documents(spark, clash=True), min_docs=10), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_bitmaps_of_repeated_rows(spark):
    rows = [(k, "common\nown " + str(k)) for k in range(10)] * 2
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert len(maps) == 10 and {m.n_dropped for m in maps} == {1}


@pytest.mark.parametrize("parts", [1, 60])
def test_line_dedup_keeps_first(spark, parts):
    key, gone = brute_lines(10)
    rows = [r for r in X.rows() if r[0] is not None and r[0] not in (5, 6)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep_first=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    seen = set()
    for d, t, _ in sorted(rows):
        kept = []
        for x in (t or "").split("\n"):
            if key(x) not in gone or key(x) not in seen:
                kept.append(x)
            seen.add(key(x))
        assert (texts[d] or "") == "\n".join(kept)


# 9


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(deadline=None)
def test_planes(ids):
    a = np.array(ids, np.uint32)
    assert (id_planes.from_planes(id_planes.to_planes(a), len(a)) == a).all()


@given(st.lists(st.binary(max_size=50), max_size=5))
@settings(deadline=None)
def test_joined_crc(parts):
    assert id_planes.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_id_planes(spark, lib, monkeypatch):
    out = id_planes.round_trip(X.documents(spark, clash=True), BPE).toPandas().sort_values("start")
    assert out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1]]
    ids = out.doc_id.dropna().tolist()
    assert ids == sorted(ids) and out.doc_id.isna().sum() == 2
    crc = lambda t: zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    same = Counter((None if d != d else d, n, c) for d, n, c in zip(out.doc_id, out.n_tokens, out.ids_crc32, strict=True))
    assert same == Counter((d, len(lib.encode(t or "", add_special_tokens=False).ids) + 1, crc(t)) for d, t, _ in X.rows())


def test_id_planes_in_parts(spark, lib):
    from tesserae.llm.text import shared_path

    path = shared_path(spark, "planes-test")
    rows = [(k, "word " * 40_000, "en") for k in range(3)]
    id_planes.write_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), path, BPE)
    want = lib.encode(rows[0][1], add_special_tokens=False).ids + [2]
    parts = id_planes.read_ids(spark, path).where("doc_id = 1").orderBy("at").collect()
    assert [x for p in parts for x in p.ids] == want
    got_ = {r.doc_id: r.ids_crc32 for r in id_planes.summary(spark, path).collect()}
    assert set(got_.values()) == {zlib.crc32(np.array(want, "<u4").tobytes())} and len(got_) == 3


# 10


def test_language_id(spark):
    out = {(r.doc_id, r.text): r for r in lang_id.identify(X.documents(spark, clash=True)).collect()}
    for (_, t), r in out.items():
        if t is None or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "es") and 0 <= r.score <= 1
    assert all(r.lang_pred == "und" for r in lang_id.identify(X.documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect())


def brute_bits(samples, text, order):
    """PPM written by hand: method C, exclusion of what the longer context has seen, uniform at the bottom."""
    seen: dict[bytes, Counter] = {}
    for t in samples:
        s = b" " * order + t.encode().lower()
        for k in range(order, len(s)):
            for o in range(order + 1):
                seen.setdefault(s[k - o : k], Counter())[s[k]] += 1

    def p(context, b):
        here = seen.get(context)
        shorter = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        if here is None:
            return shorter(b)
        n, kinds = sum(here.values()), len(here)
        if b in here:
            return here[b] / (n + kinds)
        return kinds / (n + kinds) * shorter(b) / (1 - sum(shorter(x) for x in here))

    s = b" " * order + text.encode().lower()
    return -sum(np.log2(p(s[k - order : k], s[k])) for k in range(order, len(s)))


SCRIPTS = {"ru": "абвгдежзиклмнопрстуя", "el": "αβγδεζηθικλμνοπρστυω", "ar": "ابتثجحخدذرزسشصضطظعغق", "zh": "的一是不了人我在有他这中大来上国个到说们", "hi": "अआइईउकखगघचछजटडतदनपबम"}


def invented(alphabet, r, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(1, 7))) for _ in range(n))


@pytest.mark.parametrize("order", [0, 2, 3, 5])
def test_code_lengths_equal_brute_force(order, monkeypatch):
    monkeypatch.setattr(lang_id, "STEP", 37)
    r = random.Random(order)
    samples = {k: [invented(a, r, 30), invented(a, r, 5), ""] for k, a in SCRIPTS.items()} | {"x": ["abracadabra bread", "and cheese!"], "y": ["xyzzy"], "z": ["", "a"], "w": ["all bytes " + "".join(map(chr, range(128)))], "v": ["z"]}
    texts = ["abracadabra and more", "", "q", "xyzzy xyz", None, invented(SCRIPTS["ru"], r, 12) + " bread", invented(SCRIPTS["zh"], r, 9), "\0\x7f 123 " + "a" * 50]
    model = lang_id.learn(samples, order)
    bits, size = lang_id.code_lengths(texts, model, lang_id.compiled(model))
    assert size.tolist() == [len((t or "").encode()) for t in texts]
    want = [[brute_bits(samples[k], t or "", order) for k in sorted(samples)] for t in texts]
    assert np.abs(bits - np.array(want)).max() < 1e-6


def test_probabilities_sum_to_one():
    model = lang_id.learn({"x": ["abracadabra abracadabra", "bread and cheese"], "y": ["xyzzy"]}, order=2)
    tables = lang_id.compiled(model)
    for context in ("ab", "xy", "qq", "  "):
        both = [lang_id.code_lengths([context, context + chr(b)], model, tables)[0] for b in range(128) if not 65 <= b <= 90]  # A-Z count as a-z
        assert (sum(np.exp2(-(x[1] - x[0])) for x in both) < 1).all() and (sum(np.exp2(-(x[1] - x[0])) for x in both) > 0.4).all()


def test_many_languages_and_scripts(spark):
    r = random.Random(9)
    latin = {f"l{k:02}": "".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçøå", 14)) for k in range(20)}
    rows = [(n, invented(a, r, r.randrange(30, 90)), k) for k, a in (latin | SCRIPTS).items() for n in range(40)]
    docs = spark.createDataFrame([(n, *x[1:]) for n, x in enumerate(rows)], "doc_id long, text string, lang string")
    out = lang_id.identify(docs, train=~lang_id.held_out()).where(lang_id.held_out()).collect()
    assert len(out) > 200 and sum(x.lang == x.lang_pred for x in out) / len(out) > 0.97
    assert all(0 < x.bits_per_byte < 8 for x in out)


def test_foreign_scripts_are_rejected(spark):
    english = [(k, t, "en") for k, t, _ in X.rows()[:40]]
    chinese = [(100 + k, t, None) for k, t in enumerate(["天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "0123 4567 9 a", "Съешь ещё этих мягких французских булок"])]
    docs = spark.createDataFrame(english + chinese, "doc_id long, text string, lang string")
    assert {x.doc_id for x in lang_id.accepted(docs).collect()} == set(range(40))
    assert lang_id.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_sample_has_a_bound(spark):
    docs = spark.createDataFrame([(k, "some words " * 50, f"l{k % 4}") for k in range(4000)], "doc_id long, text string, lang string")
    size = lambda s: sum(len(t) for v in s.values() for t in v)
    assert 20_000 < size(lang_id.sampled(docs, F.lit(True), per_lang=20_000)) < 160_000
    assert size(lang_id.sampled(docs, F.lit(True), per_lang=20_000, in_all=40_000)) < 80_000
    with pytest.raises(ValueError, match="languages"):
        lang_id.sampled(docs, F.lit(True), most_langs=3)


def test_accuracy_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.identify(d, train=~lang_id.held_out()).where(lang_id.held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_rejects(spark):
    docs = X.documents(spark, clash=True)
    out = lang_id.accepted(docs)
    assert out.columns == docs.columns
    assert {d for d, _, _ in X.rows()} - {r.doc_id for r in out.collect()} <= {80, 81, 82, 83, 84, 88, None}  # 84 and 88: short, and mostly of characters that no learned text has


# all


def test_nothing(spark):
    e = X.empty(spark)
    for df in (
        decontam.scan(e, X.benchmark(spark)), decontam.scan(X.documents(spark), X.benchmark(spark).limit(0)).where("n_hit > 0"), decontam.decontaminate(e, X.benchmark(spark)), license_scan.scan_licenses(e),
        packing.pack(e, BPE), simhash.near_groups(e), simhash.one_of_each(e), suffix_dedup.remove_repeats(e), token_count.count_tokens(e, BPE), line_dedup.dedup_lines(e), id_planes.round_trip(e, BPE), lang_id.identify(e), lang_id.accepted(e),
    ):
        assert df.count() == 0


def test_encoder_remembers_what_it_is_told_to(monkeypatch):
    """A caller with room has pieces encoded once; without it they are forgotten and encoded again, with the same ids."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(300)) for _ in range(40)]
    want = [e.ids for e in encode.Encoder(BPE).lib.encode_batch(texts, add_special_tokens=False)]
    asked = {}
    for room in (20_000, 10_000_000):
        lib = encode.encoder(BPE, remembered=room)
        lib.known, lib.held, count = encode._Memo({}), 0, []
        monkeypatch.setattr(lib, "_whole", lambda some, whole=encode.Encoder._whole, lib=lib, count=count: count.append(len(some[0])) or whole(lib, some))
        for _ in (0, 1):
            assert [x.tolist() for k in range(40) for x in lib.encode(texts[k : k + 1])] == want
        asked[room] = sum(count)
        monkeypatch.undo()
    assert asked[10_000_000] * 1.8 < asked[20_000]


def test_cuts_are_the_best_at_all_lengths():
    """The least cost by a plain loop over all earlier cuts, powers of two and grids included."""
    rng = np.random.default_rng(3)
    for length in (32, 48, 64, 256, 1024):
        for n in (1, 31, 200, 1500):
            ends = np.unique(rng.integers(1, n + 1, max(1, n // 90)))
            sentences = np.unique(rng.integers(1, n + 1, max(1, n // 25)))
            fee = {int(p): 1 for p in sentences} | {int(p): 0 for p in ends} | {0: 0, n: 0}
            for a, b in zip(at := sorted(fee), at[1:], strict=False):
                fee |= dict.fromkeys(range(a + 32, b, 32), 2)
            pad = lambda k: 0 if k >= 32 and k & (k - 1) == 0 else length - k
            best = {0: 0}
            for j in sorted(fee)[1:]:
                best[j] = fee[j] + min(best[i] + pad(j - i) for i in best if j - i <= length)
            got = packing.cuts(n, ends, sentences, length)
            assert got[0] == 0 and got[-1] == n and set(got) <= set(fee)
            assert sum(fee[b] + pad(b - a) for a, b in zip(got, got[1:], strict=False)) == best[n]


def test_encoder_holds_many_pieces_in_its_room(monkeypatch):
    """6000 short pieces fit into 400,000 bytes: the library gets each once."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(300)) for _ in range(20)]
    lib = encode.Encoder(BPE)
    want = [e.ids for e in lib.lib.encode_batch(texts, add_special_tokens=False)]
    lib.remembered, asked = 400_000, []
    monkeypatch.setattr(lib, "_whole", lambda some: asked.extend(some) or encode.Encoder._whole(lib, some))
    for n in (1, 0):
        assert [x.tolist() for k in range(20) for x in lib.encode(texts[k : k + 1])] == want
        assert (sum(map(len, asked)) > 0) == n
        asked.clear()


@pytest.mark.parametrize("room", [50_000, 70_000_000])
def test_encoder_with_many_pieces_of_any_length(room):
    """Pieces about as long as a key, zeros at their ends, marks, wide white space; tables grow and generations change amid them."""
    rng = random.Random(11)
    letters = ["a", "b", "r", "é", "Ġ", "日", "\0", "1", ",", ".", "'s", *map(chr, (0x2009, 0x3000, 0x85, 0x200B, 9))]
    often = [50, 50, 50, 3, 1, 3, 3, 3, 2, 2, 1, 0.1, 0.1, 0.1, 0.1, 0.1]
    pieces = ["".join(rng.choices(letters, often, k=rng.choice((1, 2, 5, 13, 14, 15, 16, 40)))) + rng.choice(("", "", ",", ".", "\0", "\0\0")) for _ in range(9000)]
    texts = ["".join(p + rng.choice("          \n") for p in rng.choices(pieces, k=200))[rng.choice((0, 0, 5)) : rng.choice((None, -1))] for _ in range(100)]
    lib = encode.Encoder(BPE)
    lib.remembered = room
    want = [e.ids for e in lib.lib.encode_batch(texts, add_special_tokens=False)]
    for _ in (0, 1):
        assert [x.tolist() for k in range(0, 100, 7) for x in lib.encode(texts[k : k + 7])] == want
