"""Identities as digests of exact bytes, as column expressions.

A string is its length in four big-endian bytes and its UTF-8; integers are big-endian. The namespace, the
word before the first dot of an archive's schema names, is part of what is hashed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalized, trimmed

NAMESPACE = "gridwitness"


def u16(c: Column | str) -> Column:
    return F.unhex(F.lpad(F.right(F.hex(col(c).cast("bigint")), F.lit(4)), 4, "0"))


def u32(c: Column | str) -> Column:
    """Four bytes; of a negative number those of its two's complement."""
    return F.unhex(F.lpad(F.right(F.hex(col(c).cast("bigint")), F.lit(8)), 8, "0"))


def i64(c: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(col(c).cast("bigint")), 16, "0"))


def text_bytes(c: Column | str) -> Column:
    c = col(c)
    return F.concat(u32(F.octet_length(c)), F.encode(c, "UTF-8"))


def namespace_of_schema(schema: Column | str) -> Column:
    return F.substring_index(col(schema), ".", 1)


def state_digest(components: Column | str, namespace: Column | None = None) -> Column:
    """components: map of name to struct(algorithm, digest, size). Equal contents give equal digests."""
    entries = F.array_sort(F.map_entries(col(components)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    domain = F.concat(namespace if namespace is not None else F.lit(NAMESPACE), F.lit(".state/v1"))
    start = F.concat(text_bytes(domain), u32(F.size(entries)))
    one = lambda e: F.concat(text_bytes(e["key"]), text_bytes(e["value"]["algorithm"]), text_bytes(e["value"]["digest"]), i64(e["value"]["size"]))
    return F.sha2(F.aggregate(entries, start, lambda acc, e: F.concat(acc, one(e))), 256)


def observation_id(schema, server, dimension, x, z, seconds, nanos, protocol, contributor, state) -> Column:
    """Who saw which state where and when. Reception and agent are not part of it."""
    return F.sha2(
        F.concat(text_bytes(schema), text_bytes(server), text_bytes(dimension), u32(x), u32(z), i64(seconds), u32(nanos), text_bytes(protocol), text_bytes(contributor), text_bytes(state)), 256
    )


def redaction_id(server, contributor, dimension, min_x, min_z, max_x, max_z) -> Column:
    """Of the scope alone, so a scope declared again replaces itself; absent parts are empty."""
    box = F.coalesce(F.concat_ws(":", *(F.nullif(col(c).cast("string"), F.lit("")) for c in (min_x, min_z, max_x, max_z))), F.lit(""))
    box = F.when(col(min_x).isNull(), F.lit("")).otherwise(box)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\0", normalized(server), empty(F.lower(trimmed(contributor))), empty(normalized(dimension)), box).cast("binary"), 256)


def landmark_id(schema, server, dimension, name) -> Column:
    return F.sha2(F.concat_ws("\0", col(schema), normalized(server), normalized(dimension), F.lower(trimmed(name))).cast("binary"), 256)


def key_fingerprint(public_key: Column | str) -> Column:
    return F.sha2(F.unhex(col(public_key)), 256)


def chained(items: Column, end: str = "\0") -> Column:
    """Digest of an array of strings, each closed by end, in the given order."""
    return F.sha2(F.when(F.size(items) > 0, F.concat(F.array_join(items, end), F.lit(end))).otherwise(F.lit("")).cast("binary"), 256)


# Times carry nanoseconds beside Spark's microseconds: `observed_at` for predicates and `observed_nanos` (0 to 999999999).

_RFC3339 = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$")


def is_rfc3339(text: Column | str) -> Column:
    return col(text).rlike(_RFC3339.pattern)


def rfc3339_time(text: Column | str) -> Column:
    """The instant, to the microsecond."""
    c = col(text)
    return F.to_timestamp(F.regexp_replace(c, r"(\.\d{6})\d+", "$1"))


def rfc3339_nanos(text: Column | str) -> Column:
    """The nanoseconds within the second."""
    return F.rpad(F.regexp_extract(col(text), r"\.(\d{1,9})", 1), 9, "0").cast("int")


def rfc3339_nano(time: Column | str, nanos: Column | str) -> Column:
    """UTC text with as many decimals as needed and no more."""
    t, n = col(time), col(nanos)
    decimals = F.regexp_replace(F.lpad(n.cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)), F.lit("Z"))


def nanos_of(time: Column | str) -> Column:
    """Nanoseconds within the second of a microsecond time."""
    return (F.pmod(F.unix_micros(col(time)), F.lit(1_000_000)) * 1000).cast("int")
