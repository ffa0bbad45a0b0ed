"""Scalar operators as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS = 6371.0
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def valid_location(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def valid_email(x: Column) -> Column:
    return x.rlike(EMAIL)


def money_add(a: Column, b: Column, sign: int = 1) -> Column:
    """struct<amount,currency> plus or minus another; null for other currencies or a negative result."""
    total = a["amount"] + sign * b["amount"]
    return F.when((a["currency"] == b["currency"]) & (total >= 0), F.struct(total.alias("amount"), a["currency"].alias("currency")))


def full_name(first: Column, last: Column, username: Column) -> Column:
    """First and last name, or the one there is, or the user name. Empty counts as missing."""
    f, n = F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))
    return F.when(f.isNotNull() & n.isNotNull(), F.concat(f, F.lit(" "), n)).otherwise(F.coalesce(f, n, username))


def engagement_rate(likes: Column, comments: Column, shares: Column, saves: Column, views: Column) -> Column:
    return F.when(views == 0, F.lit(0.0)).otherwise((likes + comments + shares + saves) / F.nullif(views, F.lit(0)))


def hashtag(tag: Column) -> Column:
    """Lower case, without # at either end."""
    return F.regexp_replace(F.lower(tag), "^#+|#+$", "")


def title_case(x: Column) -> Column:
    """Every letter after a non-letter upper, the others lower."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def whole_number(x: Column) -> Column:
    """An int if all characters are digits, else null."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))


def words(x: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def md5_position(key: Column) -> Column:
    """md5 mod 2^32: a place on the ring."""
    return F.conv(F.right(F.md5(key.cast("binary")), F.lit(8)), 16, 10).cast("bigint")


def md5_mod(key: Column, n: int) -> Column:
    """The 128-bit md5 modulo n, from its two halves."""
    digest = F.md5(key.cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, 10).cast("decimal(20,0)") % n
    return ((half(1) * (2**64 % n) + half(17)) % n).cast("int")


def hash_range_partition(key: Column, n: int) -> Column:
    """The contiguous slice of [0, 2^32) that holds the key's position."""
    return F.least(F.floor(md5_position(key) / (2**32 // n)), F.lit(n - 1)).cast("int")


def bloom_shape(capacity: int, p: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter."""
    m = int(-capacity * math.log(p) / math.log(2) ** 2)
    return m, int(m * math.log(2) / capacity)


def md5_mod_floating(key: Column, n: int) -> Column:
    """The md5 as a double, modulo n: what DuckDB makes of UHUGEINT % BIGINT."""
    digest = F.md5(key.cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, 10).cast("double")
    return ((half(1) * 2.0**64 + half(17)) % float(n)).cast("bigint")


def bloom_positions(item: Column, bits: int, hashes: int, mod=md5_mod) -> Column:
    return F.array(*[mod(F.concat(item, F.lit(str(i))), bits) for i in range(hashes)])


def bloom_false_positive_rate(n: Column, bits: int, hashes: int) -> Column:
    return F.pow(1 - F.exp(-hashes * n / bits), hashes)


def checksum(key: Column, value: Column) -> Column:
    """md5 of key and canonical JSON."""
    return F.md5(F.concat(key, F.lit(":"), F.to_json(value)).cast("binary"))


def window_start(ts: Column, size: str) -> Column:
    return F.window(ts, size)["start"]


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("bigint")


def status_of(value: Column, warn: float, bad: float) -> Column:
    """Three-level classification against two thresholds."""
    return F.when(value >= bad, "critical").when(value >= warn, "warning").otherwise("ok")


def bump_key(key: Column, kind: str) -> Column:
    """A partition key's type: string, int, float, datetime or date."""
    return key.cast({"string": "string", "int": "bigint", "float": "double", "datetime": "timestamp", "date": "date"}[kind])


def is_published(status: Column) -> Column:
    return F.coalesce(status == "published", F.lit(False))


def is_reply(parent: Column) -> Column:
    return parent.isNotNull()


def from_epoch(seconds: Column) -> Column:
    """A point in time from seconds since 1970, whole or not, in UTC."""
    return F.timestamp_micros((seconds.cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def string_map(document: Column) -> Column:
    """A JSON object as map<string,string>."""
    return F.from_json(document, "map<string,string>")
