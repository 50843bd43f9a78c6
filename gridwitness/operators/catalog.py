"""Listings and scans of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import namespace_of, release_of


def servers(observations: DataFrame) -> DataFrame:
    return observations.select("server_id").distinct().orderBy("server_id")


def dimensions(observations: DataFrame, server: str) -> DataFrame:
    return observations.where(F.col("server_id") == server).select("dimension").distinct().orderBy("dimension")


def chunks(observations: DataFrame, server: str, dimension: str) -> DataFrame:
    return observations.where((F.col("server_id") == server) & (F.col("dimension") == dimension)).select("x", "z").distinct().orderBy("x", "z")


def chunk_observations(observations: DataFrame, server: str, dimension: str, x: int, z: int) -> DataFrame:
    """A cell's observations in order. The server and dimension prune partitions, the coordinates files' statistics."""
    here = (F.col("server_id") == server) & (F.col("dimension") == dimension) & (F.col("x") == x) & (F.col("z") == z)
    return observations.where(here).orderBy("observed_at", "observed_nanos", "id")


def dimension_observations(observations: DataFrame, server: str, dimension: str) -> DataFrame:
    return observations.where((F.col("server_id") == server) & (F.col("dimension") == dimension))


def releases(observations: DataFrame) -> DataFrame:
    """The game releases that protocols name."""
    return observations.select(release_of("protocol").alias("release")).where("release IS NOT NULL").distinct().orderBy("release")


def foreign_namespaces(names: DataFrame, own: str = "minecraft") -> DataFrame:
    """Namespaces other than the game's in a column `name` of resource locations."""
    return names.select(namespace_of("name").alias("namespace")).where(F.col("namespace") != own).distinct().orderBy("namespace")


def compatibility(observations: DataFrame, names: DataFrame, own: str = "minecraft") -> DataFrame:
    """One row: the releases that an export draws on, and the namespaces in it that the game alone can't show, both in order."""
    listed = lambda df, c: df.agg(F.array_join(F.array_sort(F.collect_list(c)), ", ").alias(c))
    return listed(releases(observations).withColumnRenamed("release", "releases"), "releases").join(listed(foreign_namespaces(names, own).withColumnRenamed("namespace", "namespaces"), "namespaces"))  # single rows


def section_range(min_section_y: Column | str, section_count: Column | str) -> Column:
    """struct(low, high, blocks_low, blocks_high) of a build range, ends included; null without sections."""
    low, count = (F.col(c) if isinstance(c, str) else c for c in (min_section_y, section_count))
    high = low + count.cast("int") - 1
    return F.when(count > 0, F.struct(low.alias("low"), high.alias("high"), (low * 16).alias("blocks_low"), (high * 16 + 15).alias("blocks_high")))


def in_range(section_y: Column | str, min_section_y: Column | str, section_count: Column | str) -> Column:
    """Whether a section lies in a build range."""
    y, low, count = (F.col(c) if isinstance(c, str) else c for c in (section_y, min_section_y, section_count))
    return (count > 0) & (y >= low) & (y - low < count)


def resolve_prefix(ids: DataFrame, prefix: str, column: str = "id") -> str:
    """The one id with that prefix."""
    found = [r[0] for r in ids.select(column).distinct().where(F.col(column).startswith(prefix)).limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} id begins with {prefix!r}")
    return found[0]


def why_empty(observations: DataFrame, server: str, dimension: str, at) -> str | None:
    """Why a reading at an instant has nothing to show; None if it has."""
    if observations.isEmpty():
        return "the ledger is empty"
    own = observations.where(F.col("server_id") == server)
    if own.isEmpty():
        return f"server {server} was never observed"
    own = own.where(F.col("dimension") == dimension)
    if own.isEmpty():
        return f"dimension {dimension} was never observed on {server}"
    if own.where(F.col("observed_at") <= F.lit(at).cast("timestamp")).isEmpty():
        return f"nothing was observed before {at}"
    return None


def interval_advice(observations: DataFrame) -> DataFrame:
    """The interval to try when nothing was comparable: from the middle of the observed span to its end."""
    span = observations.agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return span.select(F.timestamp_micros(micros("a") + F.floor((micros("b") - micros("a")) / 2)).alias("suggest_from"), F.col("b").alias("suggest_to"))


def resolve_interval(first, start=None, end=None, since=None):
    """(from, to) of an interval given by its start or by a length back from its end."""
    if end is None:
        raise ValueError("an interval needs its end")
    if since is not None and start is not None:
        raise ValueError("an interval has a start or a length, not both")
    if since is not None:
        if since.total_seconds() <= 0:
            raise ValueError("a length is above zero")
        start = end - since
    start = first if start is None else start
    if start is None or not start < end:
        raise ValueError("an interval begins before it ends")
    return start, end
