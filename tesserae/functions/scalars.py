"""Rates, prices and policies as Column functions. Differences of unsigned amounts saturate at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK = 4096
#: What a node without measured service is taken to serve, in tenths of a chunk a second.
ASSUMED_RATE_X10 = 140
DEFAULT_LAMBDA_MS = 3000
UPGRADE_STEP = 450_000


def minus(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def peer_price(po: Column, unit: int = 10_000, max_po: int = 31) -> Column:
    """Price of a chunk at a proximity; ``unit`` is a parameter of the network."""
    return (F.lit(max_po + 1) - po) * F.lit(unit)


def cheque_amount(units: Column, rate: Column, deduction: Column) -> Column:
    return (units.cast("decimal(20,0)") * rate.cast("decimal(17,0)") + deduction.cast("decimal(20,0)")).cast("decimal(38,0)")


def mb_per_s(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / F.lit(1e6) / seconds).otherwise(F.lit(0.0))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * F.lit(100.0) / total).otherwise(F.lit(0.0))


def per_connection(value: Column, n: Column) -> Column:
    return value / F.greatest(n, F.lit(1))


def to_coins(base: Column) -> Column:
    """Base units (10^-16) as a double."""
    return base.cast("double") / F.lit(1e16)


def from_coins(text: Column) -> Column:
    """A decimal string as base units, exactly; an error where it isn't one or has more than 16 decimals."""
    bad = ~text.rlike(r"^[0-9]+([.][0-9]{0,16})?$")
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    digits = F.concat(whole, F.rpad(part, 16, "0"))
    return F.when(bad, F.raise_error(F.concat(F.lit("not an amount: "), text)).cast("decimal(38,0)")).otherwise(digits.cast("decimal(38,0)"))


def lambda_class(ms: Column) -> Column:
    return F.when(ms.isNull(), 1).when(ms <= 2500, 0).otherwise(2)


def effective_rate(measured_x10: Column) -> Column:
    return F.coalesce(F.nullif(measured_x10, F.lit(0)), F.lit(ASSUMED_RATE_X10))


def exposure_window(lambda_ms: Column) -> Column:
    """One and a half times lambda, which is taken as 0.8 to 25 seconds."""
    ms = F.least(F.greatest(F.coalesce(lambda_ms, F.lit(DEFAULT_LAMBDA_MS)), F.lit(800)), F.lit(25_000))
    return F.floor(ms * 3 / 2).cast("bigint")


def service_rate_x10(units: Column, price: Column, seconds: Column) -> Column:
    """Realised chunks a second times ten, where five seconds and fifty chunks back it."""
    enough = (seconds >= 5) & (units >= 50 * price) & (price > 0)
    return F.when(enough, (units / price / seconds * 10).cast("bigint"))


def upgrades(first: Column, last: Column) -> Column:
    return F.floor(minus(last, first) / UPGRADE_STEP).cast("bigint")


def exposure_ok(debt: Column, reserved: Column, price: Column, prepaid: Column, threshold: Column, unvalidated: Column) -> Column:
    """Whether one more chunk keeps what is owed within 105 % of the threshold and what is prepaid."""
    room = minus(prepaid + F.floor(threshold * 105 / 100), unvalidated)
    return debt + reserved + price <= room


def spend_projected(spent: Column, pending: Column, cap: Column) -> Column:
    """Whether a spend would go over 92 % of the cap."""
    return (spent + pending) * 100 > cap * 92


def prepay_amount(debt: Column, remaining: Column, price: Column, prepaid: Column) -> Column:
    """What to prepay now: the debt and up to 250 chunks ahead; nothing (NULL) while it is ten chunks or less above what is prepaid."""
    desired = debt + F.least(remaining * price, 250 * price)
    return F.when(desired > prepaid + 10 * price, minus(desired, prepaid))


def cheque_due(debt: Column, threshold: Column, since_ms: Column, finishing: Column, growing: Column) -> Column:
    """What a cheque should be for now, 0 for none: a fifth of the threshold at most twice a second, all when finishing, a quarter every three seconds while growing."""
    return (
        F.when(finishing, debt)
        .when(growing, F.when(since_ms >= 3000, F.least(debt, F.floor(threshold / 4))).otherwise(0))
        .when((debt * 5 >= threshold) & (since_ms >= 500), debt)
        .otherwise(0)
        .cast("bigint")
    )


def span_le(raw: Column) -> Column:
    """The 8-byte little-endian number that a chunk begins with."""
    pairs = [F.substring(F.hex(raw), 2 * k + 1, 2) for k in range(7, -1, -1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def positive_ints(text: Column) -> Column:
    """A comma list of positive integers; an error where it isn't one."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    bad = F.exists(parts, lambda x: x.isNull() | (x <= 0))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a list of positive numbers: "), text)).cast("array<int>")).otherwise(parts)


def order_key(address: Column, seed: int) -> Column:
    """A deterministic shuffle key of an address under a seed."""
    return F.xxhash64(address, F.lit(seed))


def ewma_half(samples: Column) -> Column:
    """Integer EWMA with weight one half over samples in order: 0 takes the first, then the floor of the mean."""
    return F.aggregate(samples, F.lit(0).cast("bigint"), lambda a, x: F.when(a == 0, x.cast("bigint")).otherwise(F.floor((a + x) / 2).cast("bigint")))


def ewma_fifth(samples: Column, prior: Column) -> Column:
    """EWMA with weight 0.2, begun from a prior or else the first sample, which is then blended in."""
    first = F.coalesce(prior.cast("double"), F.get(samples, 0).cast("double"))
    return F.aggregate(samples, first, lambda a, x: a * 0.8 + x.cast("double") * 0.2)


def aimd_depth(outcomes: Column, start: int = 2, top: int = 16, streak: int = 8, floor: int = 2) -> Column:
    """Pipeline depth after outcomes (booleans) in order: one more per ``streak`` successes, half on a failure."""
    first = F.struct(F.lit(start).alias("depth"), F.lit(0).alias("run"))

    def step(s: Column, ok: Column) -> Column:
        run = s["run"] + 1
        up = (run >= streak) & (s["depth"] < top)
        done = F.struct(F.when(up, s["depth"] + 1).otherwise(s["depth"]).alias("depth"), F.when(up, 0).otherwise(run).alias("run"))
        return F.when(ok, done).otherwise(F.struct(F.greatest(F.lit(floor), F.floor(s["depth"] / 2).cast("int")).alias("depth"), F.lit(0).alias("run")))

    return F.aggregate(outcomes, first, step)["depth"]


def percentile_at(values: Column, q: int) -> Column:
    """The value at index n * q div 100 (n - 1 at most) of the sorted values; 0 for none."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = F.least(F.floor(F.size(v) * q / 100).cast("int"), F.size(v) - 1)
    return F.when(F.size(v) == 0, F.lit(0)).otherwise(F.get(v, at))
