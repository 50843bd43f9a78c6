"""Digests of ledgers, and what differs between two of them.

Digests are ordered hash aggregates: of cells over sorted ids, of dimensions over cells, of servers over
dimensions, of the ledger over servers. So equal roots settle a comparison, and an unequal one descends only where digests differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import NAMESPACE, chained, rfc3339_nano
from .selection import CELL


def _sorted(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _running(keys: int, head: bytes):
    """Of rows (keys, item) in order: keys, number of items and the digest of head and the items, each closed by NUL. Holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n, out, schema = None, hashlib.sha256(head), 0, [], None

        def pack() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in out], schema.field(i).type) for i in range(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x[-2] for x in out], pa.int64()), pa.array([x[-1] for x in out], pa.string())], names=[*schema.names[:keys], "items", "digest"])

        for batch in batches:
            schema, a = batch.schema, 0
            own = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True)) if keys else [()] * batch.num_rows
            items = batch.column(keys).to_pylist()
            while a < len(items):
                b = a
                while b < len(items) and own[b] == own[a]:
                    b += 1
                if at is not None and own[a] != at:
                    out.append((*at, n, digest.hexdigest()))
                    digest, n = hashlib.sha256(head), 0
                at = own[a]
                digest.update(("\0".join(items[a:b]) + "\0").encode())
                a, n = b, n + b - a
            if len(out) > 10_000:
                yield pack()
                out.clear()
        if at is not None:
            out.append((*at, n, digest.hexdigest()))
            yield pack()

    return run


def running_digest(rows: DataFrame, keys: list[str], order: list[str], item: Column, head: str = "") -> DataFrame:
    """(keys, items, digest) of rows by key. A digest is one sequence, so a key's rows go through one task in order; they are
    sorted there, on disk if need be, and streamed. Without keys, one row, also of none."""
    parts = rows.select(*keys, *order, item.alias("__item"))
    dealt = parts.repartition(*keys) if keys else parts.repartition(1)
    types = ", ".join([*(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys), "items bigint, digest string"])
    found = dealt.sortWithinPartitions(*keys, *order).select(*keys, "__item").mapInArrow(_running(len(keys), head.encode()), types)
    if keys:
        return found
    none = hashlib.sha256(head.encode()).hexdigest()
    return found.agg(F.coalesce(F.max("items"), F.lit(0)).alias("items"), F.coalesce(F.max("digest"), F.lit(none)).alias("digest"))  # one row at most


# ---- manifests -------------------------------------------------------------------------------------------------


def chunk_manifest(observations: DataFrame) -> DataFrame:
    """(cell, observations, digest)."""
    return observations.groupBy(*CELL).agg(F.count("*").alias("observations"), chained(F.array_sort(F.collect_list("id"))).alias("digest"))


def dimension_manifest(chunk: DataFrame) -> DataFrame:
    """(server_id, dimension, chunks, observations, digest); a dimension's cells are streamed, none are gathered."""
    keys = ["server_id", "dimension"]
    digests = running_digest(chunk, keys, ["x", "z"], F.concat_ws(":", F.col("x").cast("string"), F.col("z").cast("string"), "digest"))
    counts = chunk.groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum("observations").alias("observations"))
    return counts.join(digests.select(*keys, "digest"), keys)


def _named(column: str) -> Column:
    """name NUL digest NUL for each, in order of names."""
    return chained(F.transform(_sorted(column, "digest"), lambda d: F.concat_ws("\0", d[column], d["digest"])))


def server_manifest(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("server_id").agg(F.count("*").alias("dimensions"), F.sum("chunks").alias("chunks"), F.sum("observations").alias("observations"), _named("dimension").alias("digest"))


def archive_root(server: DataFrame) -> DataFrame:
    return server.agg(F.count("*").alias("servers"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"), _named("server_id").alias("root"))


def archive_totals(observations: DataFrame, components: DataFrame) -> DataFrame:
    """Observations, distinct objects and their bytes, first and last instant. components: (id, name, digest, size)."""
    objects = components.groupBy("digest").agg(F.max("size").alias("size")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("object_bytes"))
    return observations.agg(F.count("*").alias("observations"), F.min("observed_at").alias("earliest"), F.max("observed_at").alias("latest")).join(objects)  # two single rows


def _full(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    local = a.select(*keys, F.col("digest").alias("local"))
    remote = b.select(*keys, F.col("digest").alias("remote"))
    kind = F.when(F.col("remote").isNull(), "only-local").when(F.col("local").isNull(), "only-remote").when(F.col("local") != F.col("remote"), "differs")
    return local.join(remote, keys, "full").withColumn("kind", kind)


def compare_archives(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, server_id, dimension, x, z, kind) of what differs between two ledgers' observations, without going below equal digests."""
    ca, cb = chunk_manifest(a), chunk_manifest(b)
    da, db = dimension_manifest(ca), dimension_manifest(cb)
    servers = _full(server_manifest(da), server_manifest(db), ["server_id"])
    differing = servers.where("kind = 'differs'").select("server_id")
    dimensions = _full(da, db, ["server_id", "dimension"]).join(differing, "server_id", "left_semi")
    inside = dimensions.where("kind = 'differs'").select("server_id", "dimension")
    chunks = _full(ca, cb, list(CELL)).join(inside, ["server_id", "dimension"], "left_semi")
    level = lambda df, name: df.where("kind IS NOT NULL").select(
        F.lit(name).alias("level"), "server_id", *(F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "dimension" else "int").alias(c) for c in ("dimension", "x", "z")), "kind"
    )
    return level(servers.where("kind <> 'differs'"), "server").unionByName(level(dimensions.where("kind <> 'differs'"), "dimension")).unionByName(level(chunks, "chunk"))


# ---- fingerprints ----------------------------------------------------------------------------------------------


def fingerprint_states(observations: DataFrame, server: str | None = None) -> DataFrame:
    """The distinct states of cells, whoever saw them and when."""
    rows = observations if server is None else observations.where(F.col("server_id") == server)
    return rows.select(*CELL, "state_digest").distinct()


def fingerprint_components(components: DataFrame) -> DataFrame:
    return components.groupBy("name", "digest").agg(F.max("size").alias("size"))


def fingerprint_root(states: DataFrame, components: DataFrame) -> DataFrame:
    """One row: the digest over the sorted lines of states, then of components, streamed."""
    s = states.select(F.lit(0).alias("part"), F.col("server_id").alias("a"), F.col("dimension").alias("b"), "x", "z", F.col("state_digest").alias("d"), F.concat_ws(" ", F.lit("state"), *(F.col(c).cast("string") for c in (*CELL, "state_digest"))).alias("line"))
    c = components.select(F.lit(1).alias("part"), F.col("name").alias("a"), F.col("digest").alias("b"), F.lit(0).alias("x"), F.lit(0).alias("z"), F.lpad(F.col("size").cast("string"), 20, "0").alias("d"), F.concat_ws(" ", F.lit("component"), "name", "digest", F.col("size").cast("string")).alias("line"))
    root = running_digest(s.unionByName(c), [], ["part", "a", "b", "x", "z", "d"], F.col("line")).select(F.col("digest").alias("root"))
    return root.join(states.agg(F.count("*").alias("states"))).join(components.agg(F.count("*").alias("components")))  # single rows


def compare_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, kind, only_local, only_remote) of cells on either side. A cell on one side only is coverage;
    further states on one side are states, on both content; equal ones are shared."""
    sets = lambda df, name: df.groupBy(*CELL).agg(F.array_sort(F.collect_set("state_digest")).alias(name))
    joined = sets(a, "local").join(sets(b, "remote"), list(CELL), "full")
    empty = F.array().cast("array<string>")
    left, right = F.coalesce("local", empty), F.coalesce("remote", empty)
    only_local, only_remote = F.array_except(left, right), F.array_except(right, left)
    kind = (
        F.when(F.col("local").isNull() | F.col("remote").isNull(), "coverage")
        .when((F.size(only_local) == 0) & (F.size(only_remote) == 0), "shared")
        .when((F.size(only_local) > 0) & (F.size(only_remote) > 0), "content")
        .otherwise("states")
    )
    return joined.select(*CELL, kind.alias("kind"), only_local.alias("only_local"), only_remote.alias("only_remote"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Counts by kind; two fingerprints without a common cell can't be compared."""
    both = F.col("kind") != "coverage"
    return compared.agg(
        F.count_if(both).alias("shared"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("content", "states", "coverage")), F.when(F.count_if(both) == 0, "not comparable").when(F.count_if((F.col("kind") == "content")) > 0, "differs").otherwise("agrees").alias("verdict")
    )


# ---- negotiation -----------------------------------------------------------------------------------------------


def negotiate(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(want, offer, summary) of two lists of (name, digest, size) entries: what either side lacks by digest. Bytes are summed an entry."""
    want = remote.join(local.select("digest").distinct(), "digest", "left_anti")
    offer = local.join(remote.select("digest").distinct(), "digest", "left_anti")
    shared = local.join(remote.select("digest").distinct(), "digest", "left_semi").agg(F.count("*").alias("shared"))
    total = lambda df, name: df.agg(F.count("*").alias(name), F.coalesce(F.sum("size"), F.lit(0)).alias(f"{name}_bytes"))
    return want, offer, total(want, "want").join(total(offer, "offer")).join(shared)  # single rows


def exchange_direction(compared: DataFrame) -> DataFrame:
    """Which side has more, from the differing chunks of compare_fingerprints()."""
    ahead = (F.size("only_local") > 0) & (F.size("only_remote") == 0)
    behind = (F.size("only_local") == 0) & (F.size("only_remote") > 0)
    both = (F.size("only_local") > 0) & (F.size("only_remote") > 0)
    counts = compared.agg(F.count_if(ahead).alias("local_ahead"), F.count_if(behind).alias("remote_ahead"), F.count_if(both).alias("both"))
    text = (
        F.when((F.col("local_ahead") == 0) & (F.col("remote_ahead") == 0) & (F.col("both") == 0), "nothing to exchange")
        .when((F.col("remote_ahead") == 0) & (F.col("both") == 0), "sending settles it")
        .when((F.col("local_ahead") == 0) & (F.col("both") == 0), "receiving settles it")
        .otherwise("both directions are needed")
    )
    return counts.withColumn("explanation", text)


# ---- epochs ----------------------------------------------------------------------------------------------------


def epoch_manifest(selected: DataFrame) -> DataFrame:
    """(x, z, status, state_digest) of all cells of one server and dimension; an unknown cell's digest is empty."""
    return selected.select("x", "z", "status", F.coalesce("state_digest", F.lit("")).alias("state_digest"))


def epoch_root(epoch: DataFrame, server: str, dimension: str, at: str, nanos: int = 0, policy: str = "corroborated-first", namespace: str = NAMESPACE) -> DataFrame:
    """One row: the digest of the selected world, whoever contributed to it."""
    world = epoch.sparkSession.range(1).select(rfc3339_nano(F.lit(at).cast("timestamp_ntz"), F.lit(nanos)).alias("at")).first().at
    head = "".join(f"{x}\0" for x in (f"{namespace}.archive-epoch/v1", server, dimension, world, policy))
    found = running_digest(epoch, [], ["x", "z", "state_digest"], F.concat_ws("\0", F.col("x").cast("string"), F.col("z").cast("string"), "state_digest"), head)
    return found.select(F.col("digest").alias("root"), F.col("items").alias("chunks"))


def compare_epochs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, z, kind): states that differ are mismatched, equal ones of different status differ in confidence."""
    local, remote = (df.select("x", "z", F.col("status").alias(f"{n}_status"), F.col("state_digest").alias(f"{n}_state")) for df, n in ((a, "local"), (b, "remote")))
    kind = (
        F.when(F.col("remote_state").isNull(), "only-local").when(F.col("local_state").isNull(), "only-remote").when(F.col("local_state") != F.col("remote_state"), "mismatched")
        .when(F.col("local_status") != F.col("remote_status"), "confidence").otherwise("equal")
    )
    return local.join(remote, ["x", "z"], "full").select("x", "z", kind.alias("kind"), "local_state", "remote_state", "local_status", "remote_status")


def same_epoch(a: dict, b: dict) -> None:
    """Refuses to compare epochs of different worlds or instants."""
    for field in ("server_id", "dimension", "at"):
        if a[field] != b[field]:
            raise ValueError(f"{field} differs: {a[field]} and {b[field]}")
