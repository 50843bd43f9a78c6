"""Declarations about a ledger: publication policies, redactions, landmarks, identities and attestations; exposure and purging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ed25519 import verify
from ..functions.identity import NAMESPACE
from ..functions.text import folded_equal, is_digest, normalized, trimmed
from .selection import CELL

#: Sizes of contiguous areas and regions at which structures show.
SMALL_CLUSTER, REGION_CELLS, REGIONS_OF_CONCERN, DENSE_FILL = 64, 1024, 4, 0.25
#: What may be declared about a server.
DISPOSITIONS = ("private", "embargoed", "research", "public")


# ---- policies --------------------------------------------------------------------------------------------------


def may_distribute(disposition: Column, embargo_until: Column, now: Column) -> Column:
    """struct(allowed, reason); an embargo ends strictly after its time, research is no publication, and no policy means no."""
    known = normalized(disposition)
    over = F.coalesce(now > embargo_until, F.lit(False))
    reason = (
        F.when(disposition.isNull(), "no policy was declared").when(known.isin("public", "private"), known).when(known == "research", "research only")
        .when(known == "embargoed", F.when(over, "the embargo is over").otherwise("under embargo")).otherwise("unknown disposition")
    )
    return F.struct(F.coalesce((known == "public") | ((known == "embargoed") & over), F.lit(False)).alias("allowed"), reason.alias("reason"))


def policy_status(observations: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """Each observed server and whether its data may be shared. Policies of servers never observed are not listed."""
    seen = observations.groupBy("server_id").agg(F.count("*").alias("observations"), F.count_distinct(*CELL).alias("chunks"))
    joined = seen.join(policies.select(normalized("server").alias("server_id"), "disposition", "embargo_until"), "server_id", "left")
    ruled = joined.withColumn("r", may_distribute(F.col("disposition"), F.col("embargo_until"), F.lit(now).cast("timestamp_ntz")))
    return ruled.select("server_id", "observations", "chunks", "disposition", F.col("r.allowed").alias("allowed"), F.col("r.reason").alias("reason"))


def undeclared_servers(observations: DataFrame, policies: DataFrame) -> DataFrame:
    return observations.select("server_id").distinct().join(policies.select(normalized("server").alias("server_id")), "server_id", "left_anti")


def export_gate(policies: DataFrame, server: str) -> str:
    """The server's disposition. A private one may still be used locally; none at all refuses the export."""
    row = policies.where(normalized("server") == normalized(F.lit(server))).select("disposition").first()
    if row is None:
        raise PermissionError(f"no policy was declared for {server}")
    return row.disposition


def upsert(declared: DataFrame, new: DataFrame) -> DataFrame:
    """Declarations with the last one of each id; a scope declared again replaces itself."""
    return declared.unionByName(new).groupBy("id").agg(F.max_by(F.struct(*declared.columns), "declared_at").alias("d")).select("d.*")


def withdraw(declared: DataFrame, ids: list[str]) -> DataFrame:
    """Without those ids, whether they were there or not."""
    return declared.where(~F.col("id").isin(ids)) if ids else declared


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails (or can't be judged by)."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def _given(c: str) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def _box_ok() -> Column:
    return F.col("min_x").isNull() | ((F.col("min_x") <= F.col("max_x")) & (F.col("min_z") <= F.col("max_z")))


#: What valid declarations and observations fulfil, by kind.
VALID = {
    "redaction": lambda: {"server is required": _given("server_id"), "declared_by is required": _given("declared_by"), "reason is required": _given("reason"), "declared_at is required": F.col("declared_at").isNotNull(), "bounds are in order": _box_ok()},
    "policy": lambda: {
        "server is required": _given("server"), "disposition is known": normalized("disposition").isin(*DISPOSITIONS), "declared_by is required": _given("declared_by"), "declared_at is required": F.col("declared_at").isNotNull(),
        "an embargo, and nothing else, has an end": (normalized("disposition") == "embargoed") == F.col("embargo_until").isNotNull(),
    },
    "landmark": lambda: {"server is required": _given("server_id"), "dimension is required": _given("dimension"), "name is required": _given("name"), "name has at most 128 bytes": F.octet_length("name") <= 128, "bounds are in order": F.col("min_x").isNotNull() & _box_ok()},
    "identity": lambda: {"label is required": _given("label"), "key is 32 bytes in hex": F.col("public_key").rlike("^[0-9a-f]{64}$")},
    "observation": lambda: {"server is required": _given("server_id"), "dimension is required": _given("dimension"), "protocol is required": _given("protocol"), "contributor is required": _given("contributor"), "observed_at is required": F.col("observed_at").isNotNull(), "state is a digest": is_digest("state_digest"), "id is a digest": is_digest("id")},
    "placement": lambda: {"spacing is above zero": F.col("spacing") > 0, "separation is not negative": F.col("separation") >= 0, "separation is under spacing": F.col("separation") < F.col("spacing"), "spread is known": F.col("spread_type").isin("linear", "triangular")},
}


def validated(rows: DataFrame, kind: str) -> DataFrame:
    """rows with `problems`, empty for valid ones."""
    return rows.withColumn("problems", problems(VALID[kind]()))


# ---- landmarks -------------------------------------------------------------------------------------------------


def landmark_coverage(cells: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Of each landmark the cells observed, all in its box, and their ratio.

    Every box lies on a grid as coarse as itself, where it touches four squares at most, however large it is. Cells look their
    squares up on the grids that the landmarks of their own server and dimension use, 32 at most; no landmark is compared to all cells.
    """
    side = lambda c: F.col(f"max_{c}").cast("bigint") - F.col(f"min_{c}") + 1
    boxes = landmarks.select("server_id", "dimension", "name", "min_x", "min_z", "max_x", "max_z").withColumn("grid", F.greatest(F.lit(0), F.length(F.bin(F.greatest(side("x"), side("z")) - 1))).cast("int"))
    square = lambda c, grid: F.floor(F.col(c).cast("bigint") / F.pow(F.lit(2.0), F.col(grid))).cast("bigint")
    spans = boxes.withColumn("gx", F.explode(F.array_distinct(F.array(square("min_x", "grid"), square("max_x", "grid"))))).withColumn("gz", F.explode(F.array_distinct(F.array(square("min_z", "grid"), square("max_z", "grid")))))
    grids = boxes.groupBy("server_id", "dimension").agg(F.collect_set("grid").alias("grids"))
    here = cells.select("server_id", "dimension", "x", "z").distinct().join(grids, ["server_id", "dimension"]).withColumn("grid", F.explode("grids")).withColumns({"gx": square("x", "grid"), "gz": square("z", "grid")}).drop("grids")
    inside = here.join(spans, ["server_id", "dimension", "grid", "gx", "gz"]).where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("z").between(F.col("min_z"), F.col("max_z")))
    counts = inside.groupBy("server_id", "dimension", "name").agg(F.count("*").alias("observed"))
    total = side("x") * side("z")
    joined = landmarks.join(counts, ["server_id", "dimension", "name"], "left")
    observed = F.coalesce("observed", F.lit(0))
    return joined.select("server_id", "dimension", "name", observed.alias("observed"), total.alias("total"), F.when(total > 0, observed / total).otherwise(F.lit(0.0)).alias("ratio"))


def restrict_to(cells: DataFrame, min_x: int, min_z: int, max_x: int, max_z: int) -> DataFrame:
    """A selection within a box; summaries are to be taken after it."""
    return cells.where(F.col("x").between(min_x, max_x) & F.col("z").between(min_z, max_z))


# ---- exposure --------------------------------------------------------------------------------------------------


def _region_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected cells of one region get the number of their smallest member; a region has 1024 cells at most."""
    keys = {(x, z) for x, z in zip(pdf["x"], pdf["z"], strict=True)}
    label: dict[tuple[int, int], int] = {}
    pack = lambda c: ((int(c[0]) + (1 << 31)) << 32) | (int(c[1]) + (1 << 31))
    for start in sorted(keys):
        if start in label:
            continue
        own, stack = pack(start) - (1 << 63), [start]
        while stack:
            c = stack.pop()
            if c in label or c not in keys:
                continue
            label[c] = own
            stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
    return pd.DataFrame({"server_id": pdf["server_id"], "x": pdf["x"], "z": pdf["z"], "label": [label[c] for c in zip(pdf["x"], pdf["z"], strict=True)]})


def clusters(cells: DataFrame) -> DataFrame:
    """(server_id, root, size) of 4-connected areas, over all dimensions: first within regions, then labels that touch across a border are merged."""
    points = cells.select("server_id", "x", "z").distinct()
    local = points.groupBy("server_id", F.shiftright("x", 5).alias("rx"), F.shiftright("z", 5).alias("rz")).applyInPandas(
        lambda pdf: _region_labels(pdf), "server_id string, x int, z int, label bigint"
    ).checkpoint()
    sizes = local.groupBy("server_id", "label").agg(F.count("*").alias("n"))
    step = lambda c: F.col(c).bitwiseAND(F.lit(31)) == 31
    border = local.where(step("x")).select("server_id", (F.col("x") + 1).alias("x"), "z", F.col("label").alias("a")).unionByName(local.where(step("z")).select("server_id", "x", (F.col("z") + 1).alias("z"), F.col("label").alias("a")))
    edges = border.join(local.withColumnRenamed("label", "b"), ["server_id", "x", "z"]).select("server_id", "a", "b").distinct().checkpoint()
    roots = sizes.select("server_id", F.col("label").alias("node"), F.col("label").alias("root"))
    # Each label takes its first neighbour in the order of hashes, which runs along no direction, so the labels left are a
    # fraction of those before and rounds grow as the logarithm; edges are relabelled and vanish where both ends agree.
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select("server_id", F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("server_id", F.col("a").alias("at")).agg(F.min(rank("b")).alias("m")).select("server_id", "at", F.least(rank("at"), F.col("m"))["v"].alias("to")).checkpoint()
        roots = roots.join(parent.withColumnRenamed("at", "root"), ["server_id", "root"], "left").select("server_id", "node", F.coalesce("to", "root").alias("root")).checkpoint()
        pa, pb = (parent.select("server_id", F.col("at").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b"))
        edges = edges.join(pa, ["server_id", "a"]).join(pb, ["server_id", "b"]).where("a2 <> b2").select("server_id", F.col("a2").alias("a"), F.col("b2").alias("b")).distinct().checkpoint()
    joined = sizes.join(roots.withColumnRenamed("node", "label"), ["server_id", "label"]).groupBy("server_id", "root").agg(F.sum("n").alias("size"), F.min("label").alias("least"))
    return joined.select("server_id", F.col("least").alias("root"), "size")


def exposure(cells: DataFrame) -> DataFrame:
    """Of each server how much the accumulated coverage gives away.

    cells holds a row for each dimension a chunk was seen in: counts and region fills count it twice, so a fill may
    exceed 1; the largest contiguous area takes each position once.
    """
    rows = cells.select("server_id", "x", "z")
    regions = rows.groupBy("server_id", F.shiftright("x", 5).alias("rx"), F.shiftright("z", 5).alias("rz")).agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max))))
    by_server = regions.groupBy("server_id").agg(
        F.sum("n").alias("chunks"), F.count("*").alias("regions"), (F.max("n") / F.lit(float(REGION_CELLS))).alias("densest_region_fill"), *(f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("x", "z") for n, f in (("min", F.min), ("max", F.max)))
    )
    largest = clusters(cells).groupBy("server_id").agg(F.max("size").alias("largest_cluster"))
    level = (
        F.when(F.col("largest_cluster") >= REGION_CELLS, "substantial").when((F.col("regions") >= REGIONS_OF_CONCERN) & (F.col("densest_region_fill") >= DENSE_FILL), "substantial")
        .when(F.col("largest_cluster") >= SMALL_CLUSTER, "moderate").otherwise("minimal")
    )
    return by_server.join(largest, "server_id").withColumn("exposure", level)


# ---- purging ---------------------------------------------------------------------------------------------------


def purge_plan(observations: DataFrame, components: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removable, retained, summary) if the observations with the ids of doomed go.

    components: (id, name, digest, size). Only objects that no other observation refers to may go; the others
    are retained, with the contributors that still need them.
    """
    ids = doomed.select("id").distinct()
    referred = components.select("id", "digest", "size").distinct()
    gone = referred.join(ids, "id", "left_semi").groupBy("digest").agg(F.max("size").alias("size"))
    left = referred.join(ids, "id", "left_anti").join(observations.select("id", "contributor"), "id").select("digest", F.when(trimmed("contributor") == "", "(unnamed)").otherwise(F.col("contributor")).alias("contributor")).distinct()
    removable = gone.join(left.select("digest").distinct(), "digest", "left_anti")
    retained = gone.join(left, "digest").groupBy("digest").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("contributor")).alias("contributors"))
    n = observations.join(ids, "id", "left_semi").agg(F.count("*").alias("removed_observations"))
    o = removable.agg(F.count("*").alias("removed_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("removed_bytes"))
    k = retained.agg(F.count("*").alias("retained_objects"))
    return removable, retained, n.join(o).join(k)  # single rows


# ---- attestations ----------------------------------------------------------------------------------------------


def with_valid_signatures(attestations: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """attestations (observation_id, public_key, signature) with `valid`."""
    domain = f"{namespace}.observation-attestation/v1".encode()

    @F.pandas_udf("boolean")
    def ok(observation_id: pd.Series, public_key: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([verify(k, s, domain + b"\0" + (o or "").strip().encode()) for o, k, s in zip(observation_id, public_key, signature, strict=True)], dtype=bool)

    return attestations.withColumn("valid", ok("observation_id", "public_key", "signature"))


def attestation_tally(observations: DataFrame, attestations: DataFrame, identities: DataFrame) -> DataFrame:
    """One row: observations without any attestation, and attestations that are recognised, of no registered key, or invalid.

    attestations: as with_valid_signatures() gives them. Observations and attestations are counted each by themselves.
    """
    known = identities.groupBy("public_key").agg(F.min("label").alias("label"))
    judged = attestations.join(observations.select(F.col("id").alias("observation_id")).distinct(), "observation_id", "left_semi").join(known, "public_key", "left")
    verdict = F.when(~F.col("valid"), "invalid").when(F.col("label").isNull(), "unregistered").otherwise("recognised")
    counts = judged.select(verdict.alias("v")).agg(*(F.count_if(F.col("v") == v).alias(v) for v in ("recognised", "unregistered", "invalid")))
    bare = observations.join(attestations.select(F.col("observation_id").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("unattested"))
    return bare.join(counts)  # two single rows


def signable(observations: DataFrame, label: str) -> DataFrame:
    """The observations that a key of that label may sign."""
    return observations.where(folded_equal("contributor", F.lit(label)))


def sign_all(observations: DataFrame, seed_hex: str, label: str, namespace: str = NAMESPACE) -> DataFrame:
    """(observation_id, public_key, signature) for the observations of the key's own label."""
    from ..functions.ed25519 import public_key, sign

    domain, key = f"{namespace}.observation-attestation/v1".encode(), public_key(bytes.fromhex(seed_hex)).hex()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"observation_id": pdf["id"], "public_key": key, "signature": [sign(bytes.fromhex(seed_hex), domain + b"\0" + i.strip().encode()).hex() for i in pdf["id"]]})

    return signable(observations, label).select("id").mapInPandas(run, "observation_id string, public_key string, signature string")
