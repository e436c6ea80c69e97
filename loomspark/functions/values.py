"""Numbers, times, vectors and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, RRF_WEIGHT, STRONG = 60, 0.4, 0.35
HALF_LIFE_DAYS, BOOST_CAP = 30.0, 0.3


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def epoch_seconds(c: Column) -> Column:
    """Seconds from seconds, milli-, micro- or nanoseconds, by magnitude; null outside 1e8 to 4.2e9."""
    x = c.cast("double")
    out = None
    for scale in (1.0, 1e3, 1e6, 1e9):
        y = x / scale
        cond = y.between(1e8, 4.2e9)
        out = F.when(cond, y) if out is None else out.when(cond, y)
    return out


def parse_time(c: Column) -> Column:
    """Epoch seconds of a number in any of these units or of an ISO time."""
    return F.coalesce(epoch_seconds(F.try_to_number(c, F.lit("9999999999999999999")).cast("double")), F.unix_timestamp(F.try_to_timestamp(c)).cast("double"))


def day_of(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def decay(value: Column, age_seconds: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Half-life decay; an unknown or non-positive age leaves the value."""
    return F.when(age_seconds > 0, value * F.pow(F.lit(0.5), age_seconds / 86400.0 / half_life_days)).otherwise(value)


def boost(relevance: Column, value: Column, age_seconds: Column, locked: Column) -> Column:
    """Relevance raised by value; null where a value of zero or less drops the row; no value is neutral."""
    kept = F.when(locked, value).otherwise(decay(value, age_seconds))
    return F.when(value.isNull(), relevance).when(value > 0, relevance + F.least(F.lit(BOOST_CAP) * kept, F.lit(BOOST_CAP)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def length_bucket(n: Column, edges: tuple[int, ...] = (64, 128, 256, 512)) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(n <= edges[i], i).otherwise(out)
    return out


def memory_id(content: Column) -> Column:
    return F.concat(F.lit("mcp_"), F.substring(F.sha2(content, 256), 1, 16))


def page_id(tag: Column, path: Column) -> Column:
    return F.concat(F.lit("wiki_"), F.lower(F.lpad(F.hex(F.crc32(F.concat(tag, F.lit("::"), path))), 8, "0")))


def page_seq(tag: Column, path: Column) -> Column:
    return -(F.lit(1_000_000) + F.crc32(F.concat(tag, F.lit("::"), path)) % 900_000_000)


def slot_due(now_hhmm: Column, schedule: Column, fired: Column) -> Column:
    """Slots (HH:MM) that have come and have not fired."""
    return F.array_except(F.filter(schedule, lambda s: s <= now_hhmm), fired)
