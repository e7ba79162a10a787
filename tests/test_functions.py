"""Hand cases of the scalar functions, merges and state machines."""

from __future__ import annotations

import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import address as A
from tesserae.functions import scalars as S
from tesserae.operators import aggregates, graph, joins, rank, sequence
from tesserae.sources import files, wire
from tesserae.streaming.state import apply_event


def hexa(prefix: str) -> str:
    return prefix + "0" * (64 - len(prefix))


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_proximity(spark):
    cases = [("00", "00", 31), ("00", "80", 0), ("40", "60", 2), ("ff00", "ff80", 8), ("aac0", "aacf", 12)]
    got = one(spark, *[A.proximity(F.lit(hexa(a)), F.lit(hexa(b))) for a, b, _ in cases], A.proximity(F.lit("0" * 64), F.lit("0" * 63 + "1")))
    assert got == (0 + 31, 0, 2, 8, 12, 31)


def test_neighborhood_agrees_with_proximity(spark):
    got = one(spark, *[A.neighborhood(F.lit(hexa(a)), 9) for a in ("ff80", "00", "80")], *[A.within(F.lit(hexa("aac0")), F.lit(hexa("aacf")), d) for d in (0, 12, 13)])
    assert got == (511, 0, 256, True, True, False)


def test_routable(spark):
    """One address inside each block that isn't routable, and the neighbours just outside."""
    inside = "0.77.1.2 10.255.0.1 100.64.0.1 100.127.255.254 127.88.0.9 169.254.77.1 172.16.5.5 172.31.254.1 192.0.2.200 192.168.0.1 198.19.254.3 198.51.100.44 203.0.113.1 224.0.0.5 240.9.9.9"
    outside = "1.0.0.1 9.255.255.254 11.0.0.1 100.63.255.1 100.128.0.1 126.1.1.1 128.0.0.1 169.253.1.1 172.15.0.1 172.32.0.1 192.167.1.1 198.17.0.1 198.20.0.1 223.1.2.3"
    six = {"2600:1f18::5": True, "2002:1::1": True, "fc12:9::4": False, "fe9a::2": False, "::1": False, "::": False}
    want = {f"/ip4/{x}/tcp/4001": False for x in inside.split()} | {f"/ip4/{x}/udp/9": True for x in outside.split()}
    want |= {f"/ip6/{x}/tcp/4001": ok for x, ok in six.items()} | {"/dns/node.invalid/tcp/7": False, "/udp/5": False}
    got = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in want], "u string").select("u", A.routable("u").alias("ok")).collect()}
    assert got == want


def test_scalars(spark):
    n = lambda x: F.lit(x).cast("bigint")
    assert one(spark, *[S.lambda_class(n(x)) for x in (2500, None, 2501)]) == (0, 1, 2)
    assert one(spark, *[S.exposure_window(n(x)) for x in (100, 3000, 90_000)]) == (1200, 4500, 37_500)
    assert int(one(spark, S.cheque_amount(n(7_000), n(350), n(40)))[0]) == 2_450_040
    assert one(spark, S.ewma_half(F.array(n(200))), S.ewma_half(F.array(n(200), n(101)))) == (200, 150)
    up = F.array(*[F.lit(True)] * 8)
    assert one(spark, S.aimd_depth(up), S.aimd_depth(F.concat(up, F.array(F.lit(False))))) == (3, 2)
    v = lambda *x: F.array(*map(n, x)) if x else F.array().cast("array<bigint>")
    assert one(spark, S.percentile_at(v(4, 2, 1, 3), 50), S.percentile_at(v(*range(1, 21)), 95), S.percentile_at(v(), 50)) == (3, 20, 0)
    assert int(one(spark, S.from_coins(F.lit("1.5")))[0]) == 15 * 10**15
    with pytest.raises(Exception, match="not an amount"):
        one(spark, S.from_coins(F.lit("1.23456789012345678")))


def test_coverage_and_storers(spark):
    nodes = spark.createDataFrame([(hexa("ff80"), 300), (hexa("ff81"), 100), (hexa("ff82"), None), (hexa("00"), 10)], "overlay string, rtt_ms int")
    chunks = spark.createDataFrame([(0, hexa("ff80")), (1, hexa("ff81")), (2, hexa("10"))], "index long, address string")
    assert tuple(aggregates.coverage(chunks, nodes, 9).first()) == (3, 2, 2, 1)
    got = joins.storers(chunks.where("index = 0"), nodes, 9).orderBy("rank").collect()
    assert [r.rtt_ms for r in got] == [100, 300, None]


def test_upsert(spark):
    s = spark.createDataFrame([("ab", 1, 1, True, None, "/a"), ("ab", 2, 5, False, 42, "/b"), ("ab", 3, 2, False, None, "/a")], "overlay string, seq long, tick long, dialed_ok boolean, rtt_ms int, underlay string")
    assert tuple(aggregates.upsert(s).first()) == ("ab", 5, True, 42, ["/a", "/b"])


def test_round_robin(spark):
    df = spark.createDataFrame([(hexa("00"), "a"), (hexa("01"), "b"), (hexa("80"), "c")], "overlay string, name string")
    assert [r.name for r in rank.round_robin(df, "overlay", 1, 3, "name").collect()] == ["a", "c", "b"]


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, 0, 5, 1000), (1, 1000, 7, 1000), (1, 1001, 1, 1000)], "k long, t long, v long, w long")
    for out in (sequence.sliding_sum(df, "k", "t", "v", 1000), sequence.sliding_sum_own_window(df, "k", "t", "v", "w")):
        assert [r.unvalidated for r in out.orderBy("t").collect()] == [5, 12, 8]


def test_ledger(spark):
    a, ours, other = "ab" * 20, "cd" * 20, "ef" * 20

    def read(*lines, journal=True):
        rows = [("j", k, len(lines) - 1, x, journal) for k, x in enumerate(lines)]
        df = spark.createDataFrame(rows, "path string, n int, of int, line string, journal boolean")
        return {r.beneficiary: int(r.amount) for r in aggregates.ledger_merge(files.ledger_entries(df, ours)).collect()}

    assert read(f'{{"{a}": 5}}', f'{{"{ours}:{a.upper()}": "8"}}', "#3", f'{{"{a}": "6"}}') == {a: 8}
    assert read(f'{{"{a}": "9"}}', '{"ab') == {a: 9}
    for bad in ([f'{{"{a}": "12x"}}'], [f'{{"{a}": ""}}'], [f'{{"{other}:{a}": "1"}}'], ['{"what": "1"}'], ["{x", f'{{"{a}": "1"}}'], [f'{{"{a}": "1"}}\0', f'{{"{a}": "1"}}']):
        with pytest.raises(Exception, match="USER_RAISED"):
            read(*bad)
    with pytest.raises(Exception, match="USER_RAISED"):
        read("{x", journal=False)


def test_ledger_files(spark, tmp_path):
    a, base = "ab" * 20, f"file://{tmp_path}/ledger"
    assert files.read_ledger(spark, base, "cd" * 20).count() == 0
    (tmp_path / "ledger").write_text(f'{{"{a}": "5"}}')
    (tmp_path / "ledger.journal").write_text(f'{{"{a}": "123456789"}}\n#1\n')
    assert [tuple(r) for r in files.read_ledger(spark, base, "cd" * 20).collect()] == [(a, "123456789")]
    (tmp_path / "ledger.lost").write_text("")
    with pytest.raises(ValueError, match="lost"):
        files.read_ledger(spark, base, "cd" * 20)


def loaded(base: str | None, journals: list[str], ours: str) -> dict[str, int] | None:
    """A ledger by plain loops; nothing where it can't be accounted for."""
    out: dict[str, int] = {}

    def merge(text: str) -> bool:
        try:
            pairs = json.loads(text, object_pairs_hook=list)
        except ValueError:
            return False
        for key, amount in pairs if isinstance(pairs, list) and text.lstrip()[:1] == "{" else [("", "")]:
            if not re.fullmatch(f"({ours}:)?[0-9a-fA-F]{{40}}", key) or isinstance(amount, list) or not re.fullmatch("[0-9]+", str(amount)):
                return False
            out[key[-40:].lower()] = max(int(amount), out.get(key[-40:].lower(), 0))
        return True

    sound = base is None or merge(base)
    for text in journals:
        lines = text.split("\n")
        for k, line in enumerate(lines):
            sound &= not line.strip() or bool(re.fullmatch("#[0-9]+", line)) or merge(line) or k + 1 == len(lines)
    return out if sound else None


LEDGER_A, LEDGER_B = f'"{"ab" * 20}": "5"', f'"{"cd" * 20}:{"EF" * 20}":"7"'
BASES = ["{}", "{\n}", " { } \n", "{A}", "{A,B}", "{\n  A,\n  B\n}", "{A ,\tB}\r\n", "", "  ", "garbage", "{A", "A}", "{A,}", "{,A}", "{A},", "{A} {B}", "{A,,B}", "{A}{", "{A B}", "{{A}}", "[{A}]", '{"x":{A}}', "{A}\0", "{A,{B}", "{A},B}", '"A,B"', "{", "}", ","]
JOURNALS = ["", "\n", "{A}", "{A}\n", "{A}\n#1\n{B}\n#2\n", '{A}\n{B}\n{"ab', '{A}\n{"ab\n', '{"ab\n{A}\n{"ab', "#1\n\n{A}\n#", "{A}\n\0\0\n#2\n", "{A,B}\n", "{A\n{B}"]


@pytest.mark.parametrize("block", ["9", "1m"])
def test_ledger_files_of_all_forms(spark, tmp_path, block):
    """In blocks of any size, a base is one object and only an unfinished last line of a journal may be torn."""
    full = lambda t: t.replace("A", LEDGER_A).replace("B", LEDGER_B)
    cases = [(t, []) for t in BASES] + [(None, [t]) for t in JOURNALS] + [("{A}", ['{B}\n{"a', "{B}\n"])]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for k, (base, journals) in enumerate(cases):
            base, journals = base and full(base) if base else base, [full(t) for t in journals]
            for suffix, t in (("", base), *zip((".journal", ".journal.old"), journals, strict=False)):
                if t is not None:
                    (tmp_path / f"{k}{suffix}").write_text(t)
            want = loaded(base, journals, "cd" * 20)
            try:
                out = {r.beneficiary: int(r.amount) for r in files.read_ledger(spark, f"file://{tmp_path}/{k}", "cd" * 20).collect()}
            except Exception as e:  # noqa: BLE001
                assert "isn't one object" in str(e) or "USER_RAISED" in str(e)
                out = None
            assert out == want, (base, journals)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("parts", "sound"), [(["{A,", "B}"], True), (["{A,\n", "B\n}"], True), (["{", "A}"], False), (["{A", "B}"], False), (["{A,", ",B}"], False), (["{A,", "B},"], False), (["A,", "{B}"], False)])
def test_ledger_base_in_parts(spark, tmp_path, parts, sound):
    """The files of a folder are one object, and a comma stands where an entry ends."""
    (tmp_path / "ledger").mkdir()
    for k, t in enumerate(parts):
        (tmp_path / "ledger" / f"part-{k}").write_text(t.replace("A", LEDGER_A).replace("B", LEDGER_B))
    if sound:
        assert sorted(r.amount for r in files.read_ledger(spark, f"file://{tmp_path}/ledger", "cd" * 20).collect()) == ["5", "7"]
    else:
        with pytest.raises(Exception, match="isn't one object|USER_RAISED"):
            files.read_ledger(spark, f"file://{tmp_path}/ledger", "cd" * 20).collect()


def test_ledger_query_writes_and_reads_three_files(spark, tmp_path, monkeypatch):
    """Each of the three is there in its format, and each has amounts that no other one has."""
    from tesserae.plans import files as plans
    from tests.oracle import DATA

    if not DATA.exists():
        pytest.skip("no tables here")
    monkeypatch.setattr(plans, "shared_path", lambda *a: f"file://{tmp_path}/ledger")
    got = {r.beneficiary: int(r.amount) for r in plans.ledger_files(spark, f"{DATA}/sf0.001").collect()}
    text = lambda suffix: "".join(p.read_text() for p in sorted((tmp_path / f"ledger{suffix}").iterdir()) if p.name[0] not in "._")
    base, old, new = text(""), text(".journal.old"), text(".journal")
    assert len(json.loads(base)) > 1 and base.startswith("{\n  ") and old.endswith("}\n") and new.endswith('\n#12\n\n{"ab') and re.search("\n#[0-9]+\n", old)
    load = lambda *a: loaded(*a, "ab" * 20)
    assert got == load(base, [old, new]) and all(got != x for x in (load(base, [old]), load(base, [new]), load(None, [old, new])))
    files.write_ledger(spark.createDataFrame([], "key string, amount string"), f"file://{tmp_path}/none")
    assert files.read_ledger(spark, f"file://{tmp_path}/none", "ab" * 20).count() == 0


def test_ledger_amounts_of_all_lengths(spark):
    """Largest amounts by brute force, by hashing as far as 36 digits decide; lines in odd forms go the general way."""
    who = [f"{k:040x}" for k in range(4)]
    amounts = ["0", "00", "7", "10", "9" * 36, "1" + "0" * 36, "1" + "0" * 35 + "1", "9" * 38, "9" * 37 + "8", "5" * 77, "5" * 76 + "6", "9" * 77 + "8", "9" * 78, "0" * 60 + "123", "12" + "0" * 70, "12" + "0" * 69 + "1"]
    pairs = [(who[(k + d) % 4], a) for k, a in enumerate(amounts) for d in range(1 + k % 3)] + [("ff" * 20, "000")]
    ours = "aB" * 20
    form = ['{{"{0}":"{1}"}}', ' {{"{0}":"{1}"}} ', '{{"aBAb' + "ab" * 18 + ':{0}":"{1}"}}', '{{ "{0}" : "{1}" }}', '{{"{0}":"{1}","' + "ee" * 20 + '":"1"}}']
    lines = [form[k % len(form)].format(b.upper() if k % 2 else b, a) for k, (b, a) in enumerate(pairs)] + ["#3", "", '{"ab']
    df = spark.createDataFrame([("p", k, len(lines) - 1, t, True) for k, t in enumerate(lines)], "path string, n int, of int, line string, journal boolean")
    want: dict[str, int] = {"ee" * 20: 1}
    for b, a in pairs:
        want[b] = max(want.get(b, 0), int(a))
    out = aggregates.ledger_merge(files.ledger_entries(df, ours))
    assert dict(map(tuple, out.collect())) == {b: str(n) for b, n in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max(most" in plan and "Filter (size(" not in plan  # numbers are hashed; no line is parsed twice
    other = df.where("n = 0").withColumn("line", F.lit('{"' + "cd" * 20 + ":" + who[0] + '":"1"}'))
    with pytest.raises(Exception, match="USER_RAISED"):
        files.ledger_entries(other, ours).collect()


def test_sidecar(spark):
    root = "5c" * 32
    texts = [f"resume-state v1\nroot={root}\noffset=86420", "", f"resume-state v2\nroot={root}\noffset=1", "resume-state v1\nroot=zz\noffset=1", f"resume-state v1\nroot={root}\noffset=-1"]
    got = one(spark, *[files.parse_sidecar(F.lit(t)) for t in texts])
    assert tuple(got[0]) == (root, 86420) and got[1:] == (None,) * 4
    assert one(spark, files.sidecar_text(F.lit(root), F.lit(86420))) == (texts[0],)


def test_strict_inventory(spark, tmp_path):
    (tmp_path / "c.csv").write_text(f"index,address_hex\n0,{hexa('ab')}\n1,zz\n2,0x{hexa('cd')}\n")
    path = f"file://{tmp_path}/c.csv"
    assert [r.address for r in files.read_chunks(spark, path).orderBy("index").collect()] == [hexa("ab"), hexa("cd")]
    assert [r.address for r in files.read_chunks(spark, path, most=1).collect()] == [hexa("ab")]
    with pytest.raises(Exception, match="not an address"):
        files.read_chunks(spark, path, strict=True).collect()


def test_put_keeps_first(spark):
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "address string, data string, seq int")
    once = files.put(None, new)
    assert sorted((r.address, r.data) for r in files.put(once, new.withColumn("data", F.lit("x"))).collect()) == [("a", "1"), ("b", "2")]


def test_wire():
    assert wire.varint(bytes([0x81, 0x80, 0x01, 7])) == (1 + (1 << 14), b"\7") and wire.varint(b"\xff" * 11) is None
    field = lambda value: b"\x0a" + wire.to_varint(len(value)) + value
    assert wire.threshold(field((77_777).to_bytes(4, "big"))) == 77_777 and wire.threshold(b"\xff") is None and wire.threshold(b"") is None
    assert wire.ack_amount(field((31_000).to_bytes(3, "big")) + b"\x10\x05") == 31_000 and wire.ack_amount(field(b"") + b"\x10\x01") == 0 and wire.ack_amount(b"") == 0
    a = b"/ip4/1.2.3.4/tcp/1/p2p/Qx"

    def message(under: bytes, overlay: bytes) -> bytes:
        r = b"\x0a" + wire.to_varint(len(under)) + under + b"\x1a" + wire.to_varint(len(overlay)) + overlay
        return b"\x0a" + wire.to_varint(len(r)) + r

    hint = ("07" * 32, "Qx", a.decode())
    assert wire.gossip(message(a, b"\7" * 32)) == [hint]
    assert wire.gossip(message(b"\x99" + bytes([len(a)]) + a, b"\7" * 32)) == [hint]
    assert wire.gossip(message(a, b"\7" * 20)) == [] and wire.gossip(message(a[:20], b"\7" * 32)) == []


@given(st.integers(0, 2**64 - 1), st.binary(max_size=4))
def test_varint_round_trip(n, rest):
    assert wire.varint(wire.to_varint(n) + rest) == (n, rest)


def test_accounts():
    s, ok = apply_event((0, 0, 0), "reserve", 90, 100)
    assert ok and s == (0, 90, 0)
    assert apply_event(s, "reserve", 11, 100) == ((0, 90, 1), False)
    s, _ = apply_event(s, "apply", 90, 100)
    assert s == (90, 0, 0) and apply_event(s, "credit", 200, 100)[0] == (0, 0, 0) and apply_event(s, "release", 5, 100)[0] == (90, 0, 0)


def test_crawl_is_bounded(spark):
    edges = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (3, 5), (4, 6), (5, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "peer long")
    got = {r.peer: (r.level, r.seq, r.ok) for r in graph.crawl(seeds, edges, 10, dead=spark.createDataFrame([(3,)], "peer long")).collect()}
    assert got == {1: (0, 1, True), 2: (1, 2, True), 3: (1, 3, False), 4: (2, 4, True), 6: (3, 5, True)}
    got = {r.peer: r.dialed for r in graph.crawl(seeds, edges, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_tree_walk(spark):
    nodes = spark.createDataFrame([("r", "a", 0, 8, False), ("r", "b", 8, 4, False), ("a", "x", 0, 4, True), ("a", "y", 4, 4, True), ("b", "z", 0, 4, True)], "address string, child string, at long, span long, leaf boolean")
    assert [r.child for r in graph.tree_walk(nodes, "r").orderBy("base").collect()] == ["x", "y", "z"]
    assert [r.child for r in graph.tree_walk(nodes, "r", 5, 9).orderBy("base").collect()] == ["y", "z"]


def test_dispatch(spark):
    buckets = spark.createDataFrame([(1, 100), (2, 50), (3, 10)], "prefix long, remaining long")
    members = spark.createDataFrame([(p, f"{p}{k}", 10 * p, k) for p in (1, 2, 3) for k in (1, 2)], "prefix long, overlay string, rate long, rank int")
    got = [(r.prefix, r.overlay) for r in graph.dispatch(buckets, members, 10).orderBy("step").collect()]
    # each bucket once, most remaining first; then by remaining over rate; the near-empty served one not again
    assert got == [(1, "11"), (2, "21"), (3, "31"), (1, "12"), (2, "22")]
