"""Binary messages: varints, length-delimited fields, gossip records, and their columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, LongType, StringType

#: Bounds of gossip messages: bytes of an address, addresses of a record.
MOST_UNDERLAY, MOST_LIST = 2048, 64
LIST_MARK = 0x99


def varint(raw: bytes) -> tuple[int, bytes] | None:
    """The number that raw begins with and the rest; None if it doesn't end within ten bytes or is beyond 64 bits."""
    n = 0
    for k, b in enumerate(raw[:10]):
        n |= (b & 127) << 7 * k
        if b < 128:
            return (n, raw[k + 1 :]) if n < 1 << 64 else None
    return None


def to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def fields(raw: bytes) -> list[tuple[int, int | bytes]] | None:
    """(number, value) of each field of a message in order; None if it is malformed."""
    out: list[tuple[int, int | bytes]] = []
    while raw:
        if (tag := varint(raw)) is None or (head := varint(tag[1]) if tag[0] & 7 in (0, 2) else None) is None:
            return None
        number, raw = tag[0] >> 3, head[1]
        if tag[0] & 7 == 0:
            out.append((number, head[0]))
            continue
        if len(raw) < head[0]:
            return None
        out.append((number, raw[: head[0]]))
        raw = raw[head[0] :]
    return out


def threshold(raw: bytes | None) -> int | None:
    """P20: the announced threshold, big-endian in field 1, at most 32 bytes."""
    for number, value in fields(raw or b"") or []:
        if number == 1 and isinstance(value, bytes):
            return int.from_bytes(value, "big") if len(value) <= 32 else None
    return None


def ack_amount(raw: bytes | None) -> int | None:
    """P20: the accepted amount, big-endian in field 1, at most 8 bytes; an empty message accepts 0."""
    found = fields(raw or b"")
    if found is None:
        return None
    for number, value in found:
        if number == 1 and isinstance(value, bytes):
            return int.from_bytes(value, "big") if len(value) <= 8 else None
    return 0


def addresses(raw: bytes) -> list[str]:
    """The addresses of a record: one as text, or a marked list of them with their lengths before each."""
    if raw[:1] != bytes([LIST_MARK]):
        parts = [raw]
    else:
        parts, rest = [], raw[1:]
        while rest and len(parts) < MOST_LIST:
            if (n := varint(rest)) is None or len(n[1]) < n[0]:
                break
            parts.append(n[1][: n[0]])
            rest = n[1][n[0] :]
    out = []
    for p in parts:
        if len(p) <= MOST_UNDERLAY:
            try:
                out.append(p.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return [a for a in out if a.startswith("/")]


def gossip(raw: bytes | None) -> list[tuple[str, str, str]]:
    """(overlay, peer, address) of each usable record: an overlay of 32 bytes and an address with a peer id."""
    out = []
    for number, record in fields(raw or b"") or []:
        if number != 1 or not isinstance(record, bytes) or (inner := fields(record)) is None:
            continue
        got = dict(reversed(inner))
        overlay, under = got.get(3, b""), got.get(1, b"")
        if not isinstance(overlay, bytes) or not isinstance(under, bytes) or len(overlay) != 32:
            continue
        for a in addresses(under):
            if m := re.search("/p2p/([^/]+)", a):
                out.append((overlay.hex(), m[1], a))
    return out


def decode_gossip(messages: DataFrame, column: str = "body") -> DataFrame:
    """S12 over a column of messages: one row for each usable address."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for raw in f[column] for x in gossip(raw)], columns=["overlay", "peer", "underlay"])

    return messages.select(column).mapInPandas(run, "overlay string, peer string, underlay string")


@F.pandas_udf(StringType())
def threshold_of(raw: pd.Series) -> pd.Series:
    """Up to 256 bits, so as decimal text."""
    return raw.map(lambda x: None if (n := threshold(x)) is None else str(n))


@F.pandas_udf(DecimalType(20, 0))
def ack_amount_of(raw: pd.Series) -> pd.Series:
    from decimal import Decimal

    return raw.map(lambda x: None if (n := ack_amount(x)) is None else Decimal(n))


@F.pandas_udf(BinaryType())
def varint_of(n: pd.Series) -> pd.Series:
    return n.map(lambda x: to_varint(int(x)))


@F.pandas_udf(LongType())
def from_varint(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: v[0] if (v := varint(x)) and v[0] < 1 << 63 else None).astype("Int64")
