"""What a ledger holds, what stands in the way of using it, and words for declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import policy_status, undeclared_servers
from .selection import CELL

STEPS = ("import", "install", "play", "declare", "export")


def server_status(observations: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """Of each observed server its dimensions, cells and observations, and whether its data may be shared."""
    sizes = observations.groupBy("server_id").agg(F.count_distinct("dimension").alias("dimensions"))
    return policy_status(observations, policies, now).join(sizes, "server_id").select("server_id", "dimensions", "chunks", "observations", F.col("disposition").isNotNull().alias("declared"), "disposition", "allowed", "reason")


def ledger_status(observations: DataFrame, components: DataFrame, redactions: DataFrame, identities: DataFrame) -> DataFrame:
    """One row: observations, cells, distinct objects and their bytes, and how many redactions and keys are declared."""
    own = observations.agg(F.count("*").alias("observations"), F.count_distinct(*CELL).alias("chunks"), F.count_distinct("server_id").alias("servers"))
    objects = components.groupBy("digest").agg(F.max("size").alias("size")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("object_bytes"))
    return own.join(objects).join(redactions.agg(F.count("*").alias("redactions"))).join(identities.agg(F.count("*").alias("keys")))  # single rows


def next_step(observations: DataFrame, policies: DataFrame, ready: int | None) -> str:
    """The first thing left to do, one of STEPS. ready: bundles that wait in the spool, None if there is no spool.

    What waits comes first, as only there it can still be lost; then what blocks an export.
    """
    if ready:
        return "import"
    if observations.isEmpty():
        return "install" if ready is None else "play"
    return "export" if undeclared_servers(observations, policies).isEmpty() else "declare"


def truncated(listing: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(the first rows of an ordered listing, how many more there are); 0 shows all."""
    if most <= 0:
        return listing, 0
    return listing.limit(most), max(0, listing.count() - most)


def box_text(min_x: str = "min_x", min_z: str = "min_z", max_x: str = "max_x", max_z: str = "max_z") -> Column:
    """A box in words, null without one."""
    return F.format_string("x %d to %d, z %d to %d", F.col(min_x), F.col(max_x), F.col(min_z), F.col(max_z))


def redaction_text() -> Column:
    """The scope of a redaction row in words: what is named, and all of what isn't."""
    part = lambda c, name: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"every {name}")).otherwise(F.concat(F.lit(f"{name} "), F.col(c)))
    return F.concat_ws("; ", F.concat(F.lit("server "), F.col("server_id")), part("contributor", "contributor"), part("dimension", "dimension"), F.when(F.col("min_x").isNull(), F.lit("every place")).otherwise(box_text()))


def policy_text() -> Column:
    """A policy row in words."""
    until = F.when(F.col("embargo_until").isNotNull(), F.concat(F.lit(" until "), F.date_format("embargo_until", "yyyy-MM-dd HH:mm:ss"))).otherwise(F.lit(""))
    return F.concat(F.col("server"), F.lit(": "), F.lower(F.trim("disposition")), until)


def shape_text(shapes: DataFrame) -> DataFrame:
    """One row: how many of the shapes that a capture is to hold are there, and those that aren't, in words."""
    return shapes.agg(F.count_if("present").alias("present"), F.count("*").alias("wanted"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("shape")))), "; ").alias("missing"))
