"""Which state each cell has at an instant, and how well it is attested.

Observations: server_id, dimension, x, z, contributor, observed_at, observed_nanos, state_digest, id.
Withheld observations never take part: gather() alone makes what the selections accept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_equal, normalized

CELL = ("server_id", "dimension", "x", "z")
#: Fixed value: competing states observed within so many seconds are in conflict, else the older is superseded.
WINDOW_SECONDS = 30
STATUSES = ("corroborated", "single-source", "superseded", "conflict", "unknown")


@dataclass(frozen=True)
class Gathered:
    """Observations that may be used, and how many cells' and rows were withheld by redactions."""

    observations: DataFrame
    withheld: DataFrame


_INSTANT = re.compile(r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?)?Z?$")


def instant(at: str | datetime) -> int:
    """A UTC instant as whole nanoseconds; text may have nine decimals."""
    if isinstance(at, datetime):
        at = at.isoformat()
    parts = _INSTANT.match(at)
    if parts is None:
        raise ValueError(f"not a UTC instant: {at!r}")
    whole = datetime.fromisoformat(f"{parts[1]}T{parts[2] or '00:00:00'}") - datetime(1970, 1, 1)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000_000 + int((parts[3] or "").ljust(9, "0"))


def redaction_match() -> Column:
    """Whether redaction r covers observation o; an absent part of the scope covers all."""
    o, r = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"r.{c}"))
    return (
        (normalized(o("server_id")) == normalized(r("server_id")))
        & (r("contributor").isNull() | (r("contributor") == "") | folded_equal(o("contributor"), r("contributor")))
        & (r("dimension").isNull() | (r("dimension") == "") | (normalized(o("dimension")) == normalized(r("dimension"))))
        & (r("min_x").isNull() | (o("x").between(r("min_x"), r("max_x")) & o("z").between(r("min_z"), r("max_z"))))
    )


def gather(observations: DataFrame, redactions: DataFrame | None = None, server: str | None = None, dimension: str | None = None) -> Gathered:
    """The observations of a server and dimension, if named, without withheld ones. The join is keyed by the normalized server, so it never pairs all rows."""
    rows = observations
    if server is not None:
        rows = rows.where(F.col("server_id") == server)
    if dimension is not None:
        rows = rows.where(F.col("dimension") == dimension)
    if redactions is None:
        return Gathered(rows, rows.limit(0))
    o, r = rows.alias("o"), redactions.alias("r")
    return Gathered(o.join(r, redaction_match(), "left_anti"), o.join(r, redaction_match(), "left_semi"))


def first_redaction(observations: DataFrame, redactions: DataFrame) -> DataFrame:
    """Of each withheld observation the first redaction by (server, id) that covers it."""
    pairs = observations.alias("o").join(redactions.alias("r"), redaction_match())
    return pairs.groupBy(F.col("o.id").alias("id")).agg(F.min(F.struct(F.col("r.server_id").alias("server_id"), F.col("r.id").alias("redaction_id"))).alias("first")).select("id", "first.redaction_id")


def order_key(prefix: str = "") -> Column:
    """The total order of observations."""
    return F.struct(*(F.col(prefix + c) for c in ("observed_at", "observed_nanos", "id")))


def _ranked_groups(groups: Column) -> Column:
    """More contributors first, then the later one, then the smaller digest."""
    order = lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["latest_at"] != b["latest_at"], F.when(a["latest_at"] > b["latest_at"], -1).otherwise(1)).otherwise(
        F.when(a["state_digest"] < b["state_digest"], -1).when(a["state_digest"] > b["state_digest"], 1).otherwise(0)
    )
    return F.array_sort(groups, order)


def _verdicts(latest: DataFrame, window_seconds: float, keys: tuple[str, ...] = CELL) -> DataFrame:
    """latest: one row a key and contributor, its last state (null if none counts) and revisits. One row a key with its verdict."""
    groups = latest.groupBy(*keys, "last.state_digest").agg(
        F.count("*").alias("n"),
        F.max("last.t").alias("latest_at"),
        F.min("last.t").alias("first_at"),
        F.max("last.row").alias("top"),
        F.sort_array(F.collect_list("contributor")).alias("contributors"),
        F.array_sort(F.collect_list("last.row")).alias("observations"),  # a row a contributor
        F.flatten(F.collect_list("revisits")).alias("revisits"),
    )
    group = F.struct("n", "latest_at", "state_digest", "top", "contributors", "observations")
    cells = groups.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("state_digest").isNotNull(), group)).alias("groups"),
        (F.max("latest_at") - F.min("first_at")).alias("spread"),
        F.max("top").alias("newest"),
        F.array_sort(F.flatten(F.collect_list("revisits"))).alias("revisits"),
    )
    cells = cells.withColumn("groups", _ranked_groups(F.col("groups")))
    best, second = F.get("groups", F.lit(0)), F.get("groups", F.lit(1))
    corroborated = (best["n"] >= 2) & (second.isNull() | (best["n"] > second["n"]))
    newest = F.get(F.filter("groups", lambda s: s["top"] == F.col("newest")), F.lit(0))
    limit = F.lit(round(window_seconds * 1_000_000_000)).cast("bigint")
    cells = cells.withColumn("chosen", F.when(corroborated | second.isNull(), best).otherwise(newest)).withColumn(
        "status",
        F.when(best.isNull(), "unknown").when(corroborated, "corroborated").when(second.isNull(), "single-source").when(F.col("spread") <= limit, "conflict").otherwise("superseded"),
    )
    others = F.filter("groups", lambda s: s["state_digest"] != F.col("chosen")["state_digest"])
    return cells.select(
        *keys, "status", F.col("chosen.state_digest").alias("state_digest"), F.col("chosen.top.id").alias("id"), F.col("chosen.top.observed_at").alias("observed_at"),
        F.col("chosen.contributors").alias("contributors"), F.when(F.size(others) > 0, F.transform(others, lambda s: F.struct(s["state_digest"].alias("state_digest"), s["contributors"].alias("contributors"), s["observations"].alias("observations")))).alias("rejected"),
        "revisits",
    )


def nanoseconds() -> Column:
    """The exact instant as whole nanoseconds; exact from 1678 to 2262."""
    return F.unix_seconds(F.col("observed_at").cast("timestamp")) * 1_000_000_000 + F.col("observed_nanos")


def _rows(observations: DataFrame) -> DataFrame:
    return observations.select(*CELL, "contributor", "state_digest", nanoseconds().alias("t"), order_key().alias("row"))


def _last(until: int) -> Column:
    """A contributor's last row up to that instant, to the nanosecond; null if all are later."""
    return F.max_by(F.struct("state_digest", "t", "row"), F.when(F.col("t") <= F.lit(until), F.col("row")))


def select_at(gathered: Gathered, at: str | datetime, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """One row a cell known at any time: status, selected state and observation, its contributors and the rejected states.

    One scan and no join: rows are aggregated by cell and contributor, later ones to null, and then, dealt out by cell once, by
    state and by cell; a cell whose rows are all later than the instant comes out of the same aggregation as unknown.
    """
    latest = _rows(gathered.observations).groupBy(*CELL, "contributor").agg(_last(instant(at)).alias("last")).withColumn("revisits", F.array())
    return _verdicts(latest.repartition(*CELL), window_seconds).drop("revisits")


def status_summary(selected: DataFrame, *by: str) -> DataFrame:
    """Counts of cells by status; what is none of the known ones counts as unknown."""
    known = F.col("status").isin(*STATUSES[:-1])
    counts = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES[:-1]]
    return selected.groupBy(*by).agg(F.count("*").alias("chunks"), *counts, F.count_if(~known).alias("unknown"))


def diff_between(gathered: Gathered, start: str | datetime, end: str | datetime) -> DataFrame:
    """What happened to each cell between two instants, in whichever order they are given.

    kind: never-seen, first-seen, changed, not-revisited or unchanged; revisits: observations in (start, end], to the nanosecond.
    One scan and no join: a contributor's last rows at both ends and its revisits come out of one aggregation, the verdicts of both
    ends and the revisits out of the next. Absence of a revisit is never taken as no change.
    """
    a, b = sorted((instant(start), instant(end)))
    seen = F.struct(F.col("row.observed_at").alias("observed_at"), F.col("row.observed_nanos").alias("observed_nanos"), F.col("row.id").alias("id"), "contributor", "state_digest")
    people = _rows(gathered.observations).groupBy(*CELL, "contributor").agg(
        _last(a).alias("before"), _last(b).alias("after"), F.collect_list(F.when((F.col("t") > F.lit(a)) & (F.col("t") <= F.lit(b)), seen)).alias("revisits")
    )
    nothing = F.filter("revisits", lambda _: F.lit(False))
    both = F.array(F.struct(F.lit(0).alias("end"), F.col("before").alias("last"), nothing.alias("revisits")), F.struct(F.lit(1).alias("end"), F.col("after").alias("last"), F.col("revisits").alias("revisits")))
    ends = people.repartition(*CELL).select(*CELL, "contributor", F.inline(both))
    verdicts = _verdicts(ends, WINDOW_SECONDS, (*CELL, "end"))
    sides = verdicts.groupBy(*CELL).agg(
        *(F.max(F.when(F.col("end") == k, F.col(c))).alias(f"{name}_{c}") for k, name in ((0, "before"), (1, "after")) for c in ("status", "state_digest")),
        F.max_by("revisits", "end").alias("revisits"),
    )
    before, after = F.col("before_state_digest"), F.col("after_state_digest")
    kind = (
        F.when(before.isNull() & after.isNull(), "never-seen").when(before.isNull(), "first-seen").when(before != after, "changed").when(F.size("revisits") == 0, "not-revisited").otherwise("unchanged")
    )
    return sides.select(*CELL, kind.alias("kind"), "before_status", before, "after_status", after, "revisits", F.array_distinct(F.transform("revisits", lambda r: r["contributor"])).alias("revisited_by"))


DIFF_KINDS = ("never-seen", "first-seen", "changed", "not-revisited", "unchanged")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts by kind, cells covered at both ends, and who contributed in the interval."""
    counts = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in DIFF_KINDS]
    covered = F.count_if(F.col("kind").isin("changed", "unchanged")).alias("covered")
    people = diff.select(F.explode("revisited_by").alias("c")).agg(F.array_sort(F.collect_set("c")).alias("contributors"))
    return diff.agg(F.count("*").alias("chunks"), *counts, covered).join(people)  # two single rows


def changed_cells(diff: DataFrame, limit: int = 20) -> DataFrame:
    """Changed cells, last revisited first; 0 for all of them."""
    last = F.element_at("revisits", -1)["observed_at"]
    found = diff.where("kind = 'changed'").withColumn("last_seen", last).orderBy(F.desc("last_seen"), "x", "z")
    return found.limit(limit) if limit else found
