"""Names, labels and other strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"
#: Patterns of identifiers.
DIGEST = r"^[0-9a-f]{64}$"
RESOURCE_LOCATION = r"^[a-z0-9_.-]+:[a-z0-9_./-]+$"
STATE_TOKEN = r"(?U)^[^\s,=\[\]]+$"
BLOCKS_NAME = r"^mcjava\.blocks\.(0|-?[1-9][0-9]*)$"
BIOMES_NAME = r"^mcjava\.biomes\.(0|-?[1-9][0-9]*)$"
RELEASE = r"^minecraft-java/([^;]+)"
#: What no relative POSIX path has: a root, a drive, a backslash, NUL, or an empty, `.` or `..` segment.
RELATIVE_PATH_FAULTS = re.compile(r"^[A-Za-z]:|[\\\x00]|(?:^|/)(?:\.\.?)?(?:/|$)")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), _EDGES, "")


def normalized(c: Column | str) -> Column:
    """Lower case, then trimmed: how servers and dimensions are compared."""
    return trimmed(F.lower(col(c)))


def folded_equal(a: Column | str, b: Column | str) -> Column:
    """Equal but for case and surrounding space: how contributors are matched where consent is at stake."""
    return F.lower(trimmed(a)) == F.lower(trimmed(b))


def is_digest(c: Column | str) -> Column:
    return col(c).rlike(DIGEST)


def is_resource_location(c: Column | str) -> Column:
    return col(c).rlike(RESOURCE_LOCATION)


def is_state_token(c: Column | str) -> Column:
    return col(c).rlike(STATE_TOKEN)


def is_relative_path(c: Column | str) -> Column:
    """A POSIX path below its folder: no root, drive, backslash, NUL, empty, `.` or `..` segment."""
    p = col(c)
    odd = p.startswith("/") | p.contains("\\") | p.contains("\0") | p.rlike("^[A-Za-z]:")
    return ~odd & ~F.exists(F.split(p, "/", -1), lambda s: s.isin("", ".", ".."))


def canonical_state(name: Column | str, properties: Column | str) -> Column:
    """`name` or `name[k=v,...]` with the properties (a map) in key order."""
    entries = F.array_sort(F.map_entries(col(properties)))
    body = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.size(entries) > 0, F.concat(col(name), F.lit("["), body, F.lit("]"))).otherwise(col(name))


def parsed_state(state: Column | str) -> Column:
    """struct(name, properties) of a canonical state; null if it isn't one."""
    s = col(state)
    name = F.regexp_extract(s, r"^([^\[\]]+)(\[.+\])?$", 1)
    body = F.regexp_extract(s, r"^[^\[\]]+\[(.+)\]$", 1)
    properties = F.when(body == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(body, F.lit(","), F.lit("=")))
    return F.when(name != "", F.struct(name.alias("name"), properties.alias("properties")))


def section_y(name: Column | str, pattern: str = BLOCKS_NAME) -> Column:
    """The section of a component name; null unless it is a canonical decimal."""
    return F.nullif(F.regexp_extract(col(name), pattern, 1), F.lit("")).cast("int")


def release_of(protocol: Column | str) -> Column:
    """The game release that a protocol names, null if none."""
    return F.nullif(F.regexp_extract(col(protocol), RELEASE, 1), F.lit(""))


def namespace_of(location: Column | str) -> Column:
    return F.substring_index(col(location), ":", 1)


def dimension_parts(dimension: Column | str) -> Column:
    """struct(namespace, path) of a dimension's name; null unless it is one of safe segments."""
    d = normalized(dimension)
    parts = F.split(d, ":", -1)
    path = F.get(parts, F.lit(1))
    safe = ~F.exists(F.concat(F.split(path, "/", -1), F.array(F.get(parts, F.lit(0)))), lambda s: s.isin("", ".", ".."))
    return F.when((F.size(parts) == 2) & safe, F.struct(F.get(parts, F.lit(0)).alias("namespace"), path.alias("path")))


def short_digest(c: Column | str) -> Column:
    return F.left(col(c), F.lit(12))


def nearest_name(names: DataFrame, typed: str, column: str = "name") -> DataFrame:
    """The one closest name within a third of an edit per letter or so: distance at most min(3, length / 2 + 1)."""
    most = min(3, len(typed) // 2 + 1)
    away = F.levenshtein(F.col(column), F.lit(typed)).cast("bigint")
    return names.select(column, away.alias("distance")).where(F.col("distance") <= most).orderBy("distance", column).limit(1)


def human_bytes(n: int) -> str:
    """1024 to the unit, one decimal above bytes."""
    if n < 1024:
        return f"{n} B"
    value, unit = float(n), 0
    while value >= 1024 and unit < 6:
        value, unit = value / 1024, unit + 1
    return f"{value:.1f} {'KMGTPE'[unit - 1]}iB"


def parse_bounds(text: str) -> tuple[int, int, int, int]:
    """`a,b,c,d` as (min_x, min_z, max_x, max_z), whichever corners were given."""
    parts = [int(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("bounds are four whole numbers")
    a, b, c, d = parts
    return min(a, c), min(b, d), max(a, c), max(b, d)
