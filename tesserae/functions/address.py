"""Address algebra on hexadecimal addresses, as Column functions.

Proximity counts equal leading bits and is capped at 31, so the first 32 bits of an address decide
it. For 1 <= d <= 31 two addresses are within proximity d exactly if their first d bits are equal,
which turns a comparison of all pairs into an equi-join on a computed key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PO = 31


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(address: Column | str) -> Column:
    """The first 32 bits as a non-negative BIGINT."""
    return F.conv(F.substring(_col(address), 1, 8), 16, 10).cast("bigint")


def proximity(a: Column | str, b: Column | str) -> Column:
    return proximity_of_heads(head(a), head(b))


def proximity_of_heads(a: Column, b: Column) -> Column:
    """proximity, where each head was taken before rows were paired."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(MAX_PO)).otherwise(F.least(F.lit(MAX_PO), F.lit(32) - F.length(F.bin(x)))).cast("int")


def neighborhood(address: Column | str, depth: int) -> Column:
    """The first ``depth`` bits as a number; 0 for depth 0."""
    if not 0 <= depth <= 32:
        raise ValueError("depth is 0 to 32")
    return F.shiftright(head(address), 32 - depth) if depth else F.lit(0).cast("bigint")


def bucket_prefix(address: Column | str, depth: int) -> Column:
    """As neighborhood, for up to 63 bits; beyond 32 as DECIMAL(20, 0)."""
    depth = max(0, min(63, depth))
    if depth <= 32:
        return neighborhood(address, depth)
    whole = F.conv(F.substring(_col(address), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(whole / F.lit(1 << (64 - depth)).cast("decimal(20,0)")).cast("decimal(20,0)")


def depth9_label(address: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(neighborhood(address, 9))), 3, "0")


def within(a: Column | str, b: Column | str, depth: int) -> Column:
    """proximity(a, b) >= depth, as an equality of prefixes where that holds."""
    if depth <= 0:
        return F.lit(True)
    return neighborhood(a, depth) == neighborhood(b, depth) if depth <= MAX_PO else F.lit(False)


def parse_hex(text: Column | str, width: int = 64) -> Column:
    """Trimmed, 0x stripped, lower-cased; NULL if it isn't ``width`` hexadecimal digits."""
    bare = F.regexp_replace(F.trim(_col(text)), "^0[xX]", "")
    return F.when(bare.rlike(f"^[0-9a-fA-F]{{{width}}}$"), F.lower(bare))


def parse_hex_strict(text: Column | str, width: int = 64) -> Column:
    return F.when(_col(text).rlike(f"^[0-9a-fA-F]{{{width}}}$"), F.lower(_col(text)))


def short(text: Column | str, n: int = 16) -> Column:
    return F.substring(_col(text), 1, n)


def peer_id(underlay: Column | str) -> Column:
    """The first peer id of a multiaddress, NULL if it has none."""
    return F.nullif(F.regexp_extract(_col(underlay), "/p2p/([^/]+)", 1), F.lit(""))


def dialable(underlay: Column | str) -> Column:
    u = _col(underlay)
    return u.startswith("/ip4/") & ~u.startswith("/ip4/10.") & ~u.startswith("/ip4/192.168") & ~u.startswith("/ip4/172.") & ~u.contains("/ws")


def first_dialable(underlays: Column | str) -> Column:
    """The first address of a list that is IPv4, of none of the private prefixes, and no web socket."""
    return F.get(F.filter(_col(underlays), dialable), 0)


def routable(underlay: Column | str) -> Column:
    """Whether every IP address that a multiaddress names is globally routable, and there is one; names (DNS) never are."""
    u = _col(underlay)
    v4 = F.regexp_extract_all(u, F.lit("/ip4/([^/]*)"), 1)
    v6 = F.regexp_extract_all(u, F.lit("/ip6/([^/]*)"), 1)

    def public4(ip: Column) -> Column:
        p = F.transform(F.split(ip, "[.]"), lambda x: x.try_cast("int"))
        a, b, c = F.get(p, 0), F.get(p, 1), F.get(p, 2)
        ok = (F.size(p) == 4) & F.forall(p, lambda x: x.isNotNull() & x.between(0, 255))
        # The blocks that are not globally routable
        kept = (
            a.isin(0, 10, 127)
            | (a >= 224)
            | ((a == 100) & b.between(64, 127))
            | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | ((a == 192) & (b == 0) & c.isin(0, 2))
            | ((a == 198) & b.isin(18, 19))
            | ((a == 198) & (b == 51) & (c == 100))
            | ((a == 203) & (b == 0) & (c == 113))
        )
        return F.coalesce(ok & ~kept, F.lit(False))

    def public6(ip: Column) -> Column:
        p = F.split(ip, ":")
        first, second = (F.conv(F.nullif(F.get(p, k), F.lit("")), 16, 10).cast("int") for k in (0, 1))
        return F.coalesce(first.between(0x2000, 0x3FFF) & ~((first == 0x2001) & (F.coalesce(second, F.lit(0)) == 0xDB8)), F.lit(False))

    named = F.size(v4) + F.size(v6) > 0
    return named & F.forall(v4, public4) & F.forall(v6, public6) & ~u.rlike("/dns(4|6|addr)?/")
