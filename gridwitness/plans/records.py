"""The queries on records, files, codecs, translation, declarations and the store, with their SQL for DuckDB."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_path
from ..functions import codec, fixtures, identity, text
from ..functions.strict_json import json_problem
from ..operators import catalog, comparison, export, governance, integrity, search, selection, status, translation
from ..sources import documents, events, files
from ..sources.store import Ledger
from ..streaming import capture
from .registry import _TWO_SQL, AT, DAY, _checkpoints, _obs, _selected_sql, _two, _with

_V, _LM = events.VIEW_SQL, f"lm AS ({events.LANDMARKS_SQL.replace('STRING', 'VARCHAR')})"
WORLD = ("srv-view", "minecraft:overworld")


# ---- identities ------------------------------------------------------------------------------------------------

_t8 = lambda e: f"(unhex(printf('%08x', octet_length(encode({e})))) || encode({e}))"
_u4 = lambda e: f"unhex(printf('%08x', CAST({e} AS BIGINT) & 4294967295))"
_i8 = lambda e: f"unhex(printf('%016x', CAST({e} AS BIGINT)))"


def _state_sql(biomes: str, terrain: str) -> str:
    one = lambda name, body: f"{_t8(repr(name))} || {_t8(repr('sha256'))} || {_t8(f'sha256({body})')} || {_i8(f'octet_length(encode({body}))')}"
    return f"sha256({_t8(repr('gridwitness.state/v1'))} || {_u4('2')} || {one('biomes', biomes)} || {one('terrain', terrain)})"


def _id_sql(contributor: str = "contributor") -> str:
    micros = "epoch_us(observed_at)"
    parts = [_t8(repr("gridwitness.observation/v1")), _t8("server_id"), _t8("dimension"), _u4("x"), _u4("z"), _i8(f"{micros} // 1000000"), _u4(f"{micros} % 1000000 * 1000"), _t8("protocol"), _t8(contributor), _t8("state")]
    return f"sha256({' || '.join(parts)})"


_BODIES = "'biomes-' || server_id || ':' || event_id % 50 AS biomes, 'terrain-' || server_id || ':' || x || ':' || z || ':' || state_digest AS terrain"
#: The records in DuckDB, after VIEW_SQL: id, state and the bodies of the components.
_REC = f"""
r0 AS (SELECT event_id, server_id, dimension, x, z, contributor, observed_at, 'minecraft-java/1.' || event_id % 5 || ';a' AS protocol, {_BODIES} FROM obs),
r1 AS (SELECT *, {_state_sql('biomes', 'terrain')} AS state FROM r0),
rec AS (SELECT *, {_id_sql()} AS id FROM r1)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    return obs.withColumns({
        "biomes": F.concat(F.lit("biomes-"), "server_id", F.lit(":"), (F.col("event_id") % 50).cast("string")),
        "terrain": F.concat_ws(":", F.concat(F.lit("terrain-"), "server_id"), "x", "z", "state_digest"),
    })


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as whole records, with event_id, and with identities computed from their bytes."""
    blob = lambda c: F.struct(F.lit("sha256").alias("algorithm"), F.sha2(F.encode(c, "UTF-8"), 256).alias("digest"), F.octet_length(c).cast("bigint").alias("size"))
    rows = _bodies(spark, sf_dir).select(
        "event_id", F.lit("gridwitness.observation/v1").alias("schema"), "server_id", "dimension", "x", "z", "observed_at", "observed_nanos", F.lit(None).cast("string").alias("received_at"),
        F.concat(F.lit("minecraft-java/1."), (F.col("event_id") % 5).cast("string"), F.lit(";a")).alias("protocol"), "contributor", F.lit("agent").alias("agent"),
        F.create_map(F.lit("terrain"), blob("terrain"), F.lit("biomes"), blob("biomes")).alias("components"),
    ).withColumn("state_digest", identity.state_digest("components"))
    seconds = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    return rows.withColumn("id", identity.observation_id("schema", "server_id", "dimension", "x", "z", seconds, "observed_nanos", "protocol", "contributor", "state_digest"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _bodies(spark, sf_dir).select(F.explode(F.array("biomes", "terrain")).alias("b")).distinct()
    return both.select(F.sha2(F.encode("b", "UTF-8"), 256).alias("digest"), F.octet_length("b").cast("bigint").alias("size"), F.encode("b", "UTF-8").alias("bytes"))


def observation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("event_id", "state_digest", "id")


def stored_record_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some were altered after their ids were given."""
    e = F.col("event_id")
    rows = _records(spark, sf_dir).withColumns({
        "x": F.when(e % 97 == 5, F.col("x") + 1).otherwise(F.col("x")), "protocol": F.when(e % 89 == 7, "other").otherwise(F.col("protocol")), "server_id": F.when(e % 83 == 11, F.upper("server_id")).otherwise(F.col("server_id")),
        "state_digest": F.when(e % 79 == 13, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("state_digest")),
    })
    return integrity.stored_record_problems(rows)


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON documents and read back."""
    rows = _records(spark, sf_dir)
    at = identity.rfc3339_nano("observed_at", "observed_nanos")
    doc = F.struct(
        "schema", "id", F.struct("server_id", "dimension", "x", "z").alias("chunk"), at.alias("observed_at"), "received_at", "protocol", F.struct("contributor", "agent").alias("source"), "components", "state_digest", F.lit(1).alias("unknown")
    )
    back = files.record_rows(rows.select(F.to_json(doc).alias("value")))
    return back.select("id", "server_id", "dimension", "x", "z", "observed_at", "observed_nanos", "protocol", "contributor", "agent", "state_digest", F.size("components").cast("bigint").alias("n"))


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    path = F.concat_ws("/", F.lit("file:/ledger/index"), files.encoded_name(F.col("server_id")), files.encoded_name(F.col("dimension")), "x", "z")
    return files.index_rows(obs.select(F.when(F.col("event_id") % 101 == 3, F.upper("id")).otherwise(F.col("id")).alias("value"), path.alias("p")))


def encoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.lit("ÿ?>"), "p_type").alias("name")).distinct()
    return names.select("name", files.encoded_name(F.col("name")).alias("segment")).withColumn("again", files.decoded_name(F.col("segment")))


# ---- the store -------------------------------------------------------------------------------------------------


def _held(ledger: Ledger, step: str) -> DataFrame:
    counts = ledger.observations().agg(F.count("*").alias("observations"), F.count_distinct("id").alias("ids"))
    return counts.join(ledger.objects().agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))).select(F.lit(step).alias("step"), "*")


def store_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger holds after some records were appended, then all of them twice, and then one contributor's purged."""
    rows, objects = _records(spark, sf_dir), _objects(spark, sf_dir)
    ledger = Ledger.create(spark, shared_path(spark, "ledger"))
    out = [_held(ledger, "created")]
    needed = rows.where("event_id % 3 <> 0").select(F.explode("components").alias("n", "c")).select("c.digest").distinct()
    ledger.append(rows.where("event_id % 3 <> 0"), objects.join(needed, "digest", "left_semi"))
    out.append(_held(ledger, "some appended"))
    ledger.append(rows.unionByName(rows), objects)
    out.append(_held(ledger, "all appended"))
    ledger.purge(rows.where("contributor = 'c1'"))
    out.append(_held(ledger, "purged"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def store_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers that send each other what they lack: both then hold the union, with one root."""
    _checkpoints(spark)
    rows, objects = _records(spark, sf_dir), _objects(spark, sf_dir)
    ledgers = []
    for k in (0, 1):
        own = rows.where(F.col("event_id") % 3 != k)
        digests = own.select(F.explode("components").alias("n", "c")).select("c.digest").distinct()
        ledgers.append(Ledger.create(spark, shared_path(spark, "ledger")))
        ledgers[-1].append(own, objects.join(digests, "digest", "left_semi"))
    one, two = ledgers
    out = []
    for a, b, name in ((one, two, "two"), (two, one, "one")):
        path = shared_path(spark, "transfer")
        sent = a.send(path, comparison.fingerprint_components(b.components()), b.observations())
        got = b.receive(path)
        out.append((name, got["observations"], sent["objects"], got["already_held"] + got["observations"] == sent["observations"], b.receive(path)["observations"]))
    root = lambda x: comparison.archive_root(comparison.server_manifest(comparison.dimension_manifest(comparison.chunk_manifest(x.observations())))).first().root
    return spark.createDataFrame([(*row, len({root(x) for x in ledgers}) == 1) for row in out], "receiver string, received bigint, objects_sent bigint, all_accounted boolean, received_again bigint, same_root boolean")


def object_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.when(F.conv(F.left("digest", F.lit(4)), 16, 10).cast("bigint") % 7 == 3, F.concat("bytes", F.lit("!").cast("binary"))).otherwise(F.col("bytes"))
    return integrity.object_problems(_objects(spark, sf_dir).withColumn("bytes", altered)).select("kind", "subject")


def document_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files of which some are cut short or have another's name, and a journal with entries left."""
    e = F.col("event_id")
    obs = _obs(spark, sf_dir)
    doc = F.when(e % 41 == 7, F.lit('{"id": ')).when(e % 41 == 8, F.lit("{}")).otherwise(F.to_json(F.struct("id", "server_id")))
    name = F.when(e % 37 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    files_ = obs.select(F.concat(F.lit("file:/ledger/observations/"), F.left("id", F.lit(2)), F.lit("/"), name, F.lit(".json")).alias("path"), F.encode(doc, "UTF-8").alias("content"))
    journal = obs.where(e % 53 == 5).select(F.concat(F.lit("file:/ledger/journal/"), F.when(e % 2 == 0, ".tmp-").otherwise(""), F.col("id")).alias("path"), F.encode(F.lit(""), "UTF-8").alias("content"))
    found = integrity.document_problems(files_.unionByName(journal))
    return found.select("kind", "subject", F.when(F.col("kind") == "unreadable record", "").otherwise(F.col("detail")).alias("detail"))


def transfer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local observations of cells whose digests differ."""
    a, b = _two(spark, sf_dir)
    cells = comparison.compare_archives(a, b).where("level = 'chunk'").select(*selection.CELL)
    return a.join(cells, list(selection.CELL), "left_semi").select("id")


def bundle_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of capture bundles, some without a contributor, with an unknown key, cut short or with a path that leaves the bundle."""
    e = F.col("event_id")
    part = lambda name, body: F.struct(F.when(e % 47 == 3, F.concat(F.lit("../"), F.lit(name))).otherwise(F.lit(f"components/{name}")).alias("path"), F.lit("sha256").alias("algorithm"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    doc = F.to_json(F.struct(
        F.lit("gridwitness.capture-bundle/v1").alias("schema"), F.concat(F.lit(" "), F.upper("server_id")).alias("server_id"), "dimension", F.struct("x", "z").alias("chunk"),
        identity.rfc3339_nano("observed_at", "observed_nanos").alias("observed_at"), F.concat(F.lit("minecraft-java/1."), (e % 5).cast("string"), F.lit(";a")).alias("protocol"),
        F.struct(F.when(e % 50 == 7, F.lit("  ")).otherwise(F.col("contributor")).alias("contributor")).alias("source"), F.struct(part("biomes", "biomes").alias("biomes"), part("terrain", "terrain").alias("terrain")).alias("components"),
        F.when(e % 50 == 9, F.lit(1)).alias("surprise"),
    ))
    content = F.when(e % 43 == 2, F.substring(doc, 1, 40)).otherwise(doc)
    rows = files.bundle_rows(_bodies(spark, sf_dir).select(F.concat(F.lit("file:/spool/ready-"), e.cast("string"), F.lit("/bundle.json")).alias("path"), F.encode(content, "UTF-8").alias("content")))
    good = F.size("problems") == 0
    problem = F.when(good, F.lit("")).when(F.array_contains("problems", "contributor is required") & (F.size("problems") == 1), "contributor").when(F.exists("problems", lambda p: p.startswith("unknown key")), "key").when(F.exists("problems", lambda p: p.startswith("no strict JSON")), "json").otherwise(F.get("problems", F.lit(0)))
    return rows.select(F.regexp_extract("bundle", r"ready-(\d+)$", 1).cast("bigint").alias("event_id"), problem.alias("problem"), F.when(good, F.col("id")).alias("id"))


def spool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(F.when(e % 5 == 0, "ready-").when(e % 5 == 1, ".tmp-").when(e % 5 == 2, "quarantine-").when(e % 5 == 3, "imported-").otherwise("notes-"), e.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(files.spool_kind(name).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def fingerprint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint written as lines of text and read back; the root is computed anew."""
    obs = _obs(spark, sf_dir)
    states, parts = comparison.fingerprint_states(obs), comparison.fingerprint_components(events.components(obs))
    path = shared_path(spark, "fingerprint")
    files.fingerprint_lines(states, parts, comparison.fingerprint_root(states, parts).first().root, identity.NAMESPACE).write.text(path)
    s, c, root = files.read_fingerprint(spark.read.text(path))
    return s.agg(F.count("*").alias("states")).join(c.agg(F.count("*").alias("components"), F.sum("size").alias("bytes"))).select("*", F.lit(root).alias("root"))


def ledger_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's manifest written as a document and read back."""
    _checkpoints(spark)
    obs = _obs(spark, sf_dir)
    path = shared_path(spark, "manifest")
    documents.write_ledger_manifest(obs, events.components(obs), path, "2026-01-01T00:00:00Z")
    return documents.read_ledger_manifest(spark, path)[0]


def epoch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch's manifest written as a document and read back."""
    chosen = selection.select_at(selection.gather(_obs(spark, sf_dir), None, *WORLD), AT, DAY)
    path = shared_path(spark, "epoch")
    documents.write_epoch_manifest(comparison.epoch_manifest(chosen), selection.status_summary(chosen).first().asDict(), path, *WORLD, AT, "2026-01-01T00:00:00Z")
    rows, about = documents.read_epoch_manifest(spark, path)
    return rows.withColumn("root", F.lit(about["root"]))


# ---- listings, filters and words -------------------------------------------------------------------------------


def dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dimension_observations(_obs(spark, sf_dir), *WORLD).select("id", "x", "z", "contributor", "observed_at")


def landmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a selection within a landmark's box."""
    return selection.status_summary(governance.restrict_to(selection.select_at(selection.gather(_obs(spark, sf_dir), None, *WORLD), AT, DAY), -2, -2, 2, 2))


def fingerprint_of_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.fingerprint_states(_obs(spark, sf_dir), "srv-click")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    protocol = F.when(e % 7 == 0, F.concat(F.lit("other/"), (e % 3).cast("string"))).otherwise(F.concat(F.lit("minecraft-java/1."), (e % 11).cast("string"), F.lit(";flag=1")))
    return catalog.releases(spark.read.parquet(f"{sf_dir}/events.parquet").select(protocol.alias("protocol")))


def foreign_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.when(F.col("p_partkey") % 3 == 0, "minecraft").otherwise(F.concat(F.lit("mod"), (F.col("p_size") % 6).cast("string")))
    return catalog.foreign_namespaces(p.select(F.concat(own, F.lit(":"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("name")))


def compatibility_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "minecraft").otherwise(F.concat(F.lit("mod"), (F.col("p_size") % 4).cast("string"))), F.lit(":x")).alias("name"))
    return catalog.compatibility(_records(spark, sf_dir), p)


def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build ranges and whether a section lies in them."""
    k = F.col("p_partkey").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (k % 9 - 4).alias("low"), (F.col("p_size") % 12).alias("n"), (k % 17 - 6).alias("y"))
    return rows.select("p_partkey", catalog.section_range("low", "n").alias("r"), catalog.in_range("y", "low", "n").alias("inside")).select("p_partkey", "r.high", "r.blocks_low", "r.blocks_high", "inside")


def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    prefix = obs.agg(F.left(F.min("id"), F.lit(16)).alias("p")).first().p
    return spark.createDataFrame([(catalog.resolve_prefix(obs, prefix),)], "id string")


def truncated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, more = status.truncated(_obs(spark, sf_dir).orderBy("observed_at", "id").select("id"), 20)
    return shown.withColumn("more", F.lit(more).cast("bigint"))


def server_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.server_status(_obs(spark, sf_dir), events.policies(spark), AT)


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return status.ledger_status(obs, events.components(obs), events.redactions(spark), nation)


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, policies = _obs(spark, sf_dir), events.policies(spark)
    cases = {"waiting": (obs, policies, 3), "nothing at all": (obs.limit(0), policies, None), "nothing yet": (obs.limit(0), policies, 0), "undeclared": (obs, policies, 0), "all declared": (obs.where("server_id <> 'srv-signup'"), policies, 0)}
    return spark.createDataFrame([(name, status.next_step(*case)) for name, case in cases.items()], "case string, step string")


def why_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    cases = {"empty": (obs.limit(0), *WORLD, AT), "server": (obs, "nowhere", WORLD[1], AT), "dimension": (obs, WORLD[0], "the_end", AT), "before": (obs, *WORLD, "2020-01-01 00:00:00"), "fine": (obs, *WORLD, AT)}
    found = {name: catalog.why_empty(*case) for name, case in cases.items()}
    return spark.createDataFrame([(name, why is not None) for name, why in found.items()], "case string, diagnosed boolean")


def scope_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions and policies in words."""
    reds = events.redactions(spark).select("id", status.redaction_text().alias("words"))
    return reds.unionByName(events.policies(spark).select(F.col("server").alias("id"), status.policy_text().alias("words")))


# ---- scalar functions ------------------------------------------------------------------------------------------


def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of parts' columns, good and bad, against the rules for names, tokens, paths and sections."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    name = F.concat(F.when(k % 5 == 0, "Mod").otherwise("mod"), F.lit(":"), F.when(k % 7 == 0, "a:b").when(k % 11 == 0, "").otherwise(F.concat(F.lit("x/"), k.cast("string"))))
    token = F.concat(F.lit("t"), F.when(k % 5 == 0, ",").when(k % 5 == 1, "=").when(k % 5 == 2, " ").when(k % 5 == 3, "[").otherwise("-"), k.cast("string"))
    path = F.concat(F.when(k % 6 == 0, "/").when(k % 6 == 1, "C:").otherwise(""), F.lit("a/"), F.when(k % 6 == 2, "../").when(k % 6 == 3, "/").when(k % 6 == 4, "./").otherwise("b/"), k.cast("string"))
    section = F.concat(F.lit("mcjava.blocks."), F.when(k % 4 == 0, "-").when(k % 4 == 1, "+").when(k % 4 == 2, "0").otherwise(""), (k % 30).cast("string"))
    dimension = F.concat(F.when(k % 5 == 0, "").otherwise(" MC"), F.lit(":"), F.when(k % 7 == 0, "..").when(k % 7 == 1, "a//b").otherwise("a/B "))
    return p.select(
        "p_partkey", text.is_resource_location(name).alias("location"), text.is_state_token(token).alias("token"), text.is_relative_path(path).alias("path"), text.section_y(section).alias("section"),
        text.dimension_parts(dimension)["namespace"].alias("namespace"), text.dimension_parts(dimension)["path"].alias("dimension_path"),
    )


def block_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical states out of properties in any order, and what is read back from them."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    properties = F.when(k % 4 == 0, F.create_map().cast("map<string,string>")).when(k % 4 == 1, F.create_map(F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("z"), (k % 3).cast("string"), F.lit("axis"), F.lit("y"), F.lit("lit"), F.lit("false")))
    rows = p.select("p_partkey", text.canonical_state(F.concat(F.lit("mc:b"), (k % 9).cast("string")), properties).alias("state"))
    parsed = text.parsed_state("state")
    return rows.select("p_partkey", "state", parsed["name"].alias("name"), F.size(parsed["properties"]).cast("bigint").alias("n"), parsed["properties"]["axis"].alias("axis"))


def rfc3339_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with offsets and up to nine decimals, read and written again."""
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (e * 7919 % 1_000_000_000).cast("int").alias("nanos"))
    local = F.date_format(F.col("ts") + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(e % 4 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(e % 4 == 1, F.concat(local, F.lit("."), F.lpad(F.col("nanos").cast("string"), 9, "0"), F.lit("+05:30"))).when(e % 4 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".120Z"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    known = identity.is_rfc3339("raw")
    again = F.when(known, identity.rfc3339_nano(identity.rfc3339_time(F.when(known, F.col("raw"))), identity.rfc3339_nanos("raw")))
    return rows.select("event_id", raw.alias("raw")).select("event_id", known.alias("known"), again.alias("again"))


def region_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region and slot of cells far from the origin on either side."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, z = (F.col("o_orderkey") * 31 % 9000 - 4500), (F.col("o_custkey") * 17 % 9000 - 4500)
    cells = o.select("o_orderkey", x.cast("int").alias("x"), z.cast("int").alias("z"))
    return cells.select("o_orderkey", F.shiftright("x", 5).alias("rx"), F.shiftright("z", 5).alias("rz"), (F.col("x").bitwiseAND(F.lit(31)) + F.col("z").bitwiseAND(F.lit(31)) * 32).alias("slot"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short digests, digest validity and fingerprints of keys."""
    rows = _obs(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 9 == 4, F.upper("id")).otherwise(F.col("id")).alias("id"))
    return rows.select("event_id", text.short_digest("id").alias("short"), text.is_digest("id").alias("valid"), identity.key_fingerprint("id").alias("fingerprint"))


def sizes_and_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in words, and boxes given by any two corners; nations are few and these are functions of the driver."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()
    out = [(k, text.human_bytes(1500**(k % 5) * (k + 1)), *text.parse_bounds(f"{k},{7 - k},{-k}, {k * 3}")) for (k,) in rows]
    return spark.createDataFrame(out, "n_nationkey int, size string, min_x int, min_z int, max_x int, max_z int")


def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a key twice, an unknown key, two values, bytes that aren't UTF-8, and none of these."""
    e = F.col("event_id")
    good = F.concat(F.lit('{"a": '), e.cast("string"), F.lit(', "b": [1, {"c": "}"}]}'))
    raw = F.when(e % 6 == 0, F.concat(F.lit('{"a": 1, "a": '), e.cast("string"), F.lit("}"))).when(e % 6 == 1, F.lit('{"z": 1}')).when(e % 6 == 2, F.concat(good, good)).when(e % 6 == 3, F.lit("[1]")).otherwise(good)
    content = F.when(e % 6 == 4, F.concat(F.encode(raw, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(raw, "UTF-8"))
    found = json_problem("content", ("a", "b"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", content.alias("content")).select("event_id", found.alias("p"))
    return rows.select("event_id", F.when(F.col("p").isNull(), "fine").when(F.col("p").startswith("no strict"), "no strict JSON").otherwise(F.col("p")).alias("problem"))


# ---- codecs and exports ----------------------------------------------------------------------------------------


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the bytes of a shape, a section of blocks, one of biomes, and block entities, by rules of its key."""

    def run(frames):
        for pdf in frames:
            out = []
            for k in pdf["s_suppkey"].tolist():
                blocks = [f"minecraft:b{(i * i + k) % (k % 6 + 1)}" for i in range(4096)]
                biomes = [f"minecraft:m{(i + k) % 3}" for i in range(64)]
                entities = [(j, k % 40 - 20, 3, "minecraft:chest", (codec.COMPOUND, [("items", (codec.LIST, (codec.INT, [k]))), ("name", (codec.STRING, f"n{j}"))])) for j in range(k % 4)]
                out.append((k, codec.encode_shape(k % 9 - 4, k % 20 + 1), codec.encode_blocks(k % 8 - 4, blocks), codec.encode_biomes(k % 8 - 4, biomes), codec.encode_block_entities(entities)))
            yield pd.DataFrame(out, columns=["k", "shape", "blocks", "biomes", "entities"])

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").mapInPandas(run, "k bigint, shape binary, blocks binary, biomes binary, entities binary")


def codec_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes and block entities encoded and decoded again; one in seven is cut short."""
    rows = _encoded(spark, sf_dir).select("k", F.when(F.col("k") % 7 == 2, F.expr("substring(shape, 1, 20)")).otherwise(F.col("shape")).alias("shape"), "entities")
    found = rows.select("k", codec.shape_column("shape").alias("s"), codec.entities_column("entities").alias("e"))
    return found.select("k", "s.min_section_y", "s.section_count", F.size("e").cast("bigint").alias("entities"), F.get("e", F.lit(0))["block_y"].alias("first_y"), F.array_join(F.get("e", F.lit(0))["fields"], ",").alias("fields"), F.get("e", F.lit(0))["nested"].alias("nested"))


def codec_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by state of block sections encoded and decoded again."""
    found = _encoded(spark, sf_dir).select("k", codec.blocks_column("blocks").alias("s")).select("k", "s.section_y", "s.palette", "s.indices")
    return translation.palette_counts(found).select("k", "section_y", F.col("source").alias("state"), "positions")


def codec_biomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of biome sections position by position, in one digest, and the one at position 5."""
    found = _encoded(spark, sf_dir).select("k", codec.biomes_column("biomes").alias("s"))
    return found.select("k", F.sha2(F.array_join(codec.expanded(F.col("s.palette"), F.col("s.indices")), ",").cast("binary"), 256).alias("digest"), codec.state_at(F.col("s.palette"), F.col("s.indices"), F.lit(5), F.lit(0), F.lit(0)).alias("fifth"))


def codec_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the exact bytes of shapes and sections described in a few words."""

    def run(frames):
        for pdf in frames:
            out = []
            for k in pdf["s_suppkey"].tolist():
                y = k % 16 - 8
                shape = fixtures.component("shape", {"min_section_y": y, "section_count": k % 30 + 1})
                blocks = fixtures.component("block_section", {"section_y": y, "constant": f"minecraft:b{k}"})
                biomes = fixtures.component("biome_section", {"section_y": y, "in_turn": ["minecraft:a", "minecraft:b"]})
                numbered = fixtures.states({"numbered": "m:b", "width": 4}, k % 5 + 1)
                out.append((k, *(hashlib.sha256(b).hexdigest() for b in (shape, blocks, biomes)), ",".join(numbered)))
            yield pd.DataFrame(out, columns=["k", "shape", "blocks", "biomes", "numbered"])

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").mapInPandas(run, "k bigint, shape string, blocks string, biomes string, numbered string")


def packed_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices packed into longs of 4 bits each or more, for palettes by the part's size."""

    def run(frames):
        for pdf in frames:
            out = []
            for key, size in zip(pdf["p_partkey"].tolist(), pdf["p_size"].tolist(), strict=True):
                for j, v in enumerate(export.packed(np.array([(i * 5 + key) % size for i in range(40)]), size, 4) or []):
                    out.append((key, j, v))
            yield pd.DataFrame(out, columns=["p_partkey", "j", "packed"])

    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").mapInPandas(run, "p_partkey bigint, j int, packed bigint")


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations (id, x, z), components, objects) of one dimension whose cells are encoded."""
    cells = _obs(spark, sf_dir).where(F.col("server_id") == WORLD[0]).select((F.col("x") * 11).cast("int").alias("x"), (F.col("z") * 11).cast("int").alias("z")).distinct().withColumn("id", F.concat_ws(":", "x", "z"))

    def run(frames):
        for pdf in frames:
            out = []
            for i, x, z in zip(pdf["id"], pdf["x"].tolist(), pdf["z"].tolist(), strict=True):
                states = ["minecraft:air"] * 4000 + [f"minecraft:oak_stairs[facing=north,half=bottom,waterlogged={'true' if x % 2 else 'false'}]"] * 96
                out.append((i, "mcjava.shape", codec.encode_shape(-1, 2)))
                out.append((i, "mcjava.blocks.-1", codec.encode_blocks(-1, states)))
                out.append((i, "mcjava.biomes.-1", codec.encode_biomes(-1, ["minecraft:plains"] * 32 + ["minecraft:desert"] * 32)))
                out.append((i, "mcjava.block_entities", codec.encode_block_entities([(1, -16, 2, "minecraft:sign", (codec.COMPOUND, [("text", (codec.STRING, "x"))]))])))
            yield pd.DataFrame(out, columns=["id", "name", "bytes"])

    bodies = cells.select("id", "x", "z").mapInPandas(run, "id string, name string, bytes binary").withColumn("digest", F.sha2("bytes", 256))
    return cells, bodies.select("id", "name", "digest"), bodies.select("digest", "bytes").dropDuplicates(["digest"])


def region_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region files: name, chunks, whether they are whole sectors, and the occupied slots of their headers."""
    made = export.region_files(*_world(spark, sf_dir))
    slots = F.expr("size(filter(sequence(0, 1023), i -> hex(substring(content, i * 4 + 1, 4)) <> '00000000'))")
    return made.select("file_name", "chunks", (F.octet_length("content") % 4096 == 0).alias("whole"), slots.alias("slots"))


def capture_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the wanted shapes a capture holds."""
    _, parts, objects = _world(spark, sf_dir)
    return search.required_shapes(parts, objects)


def coverage_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by colour of the coverage map of one dimension."""
    import zlib

    cells = selection.select_at(selection.gather(_obs(spark, sf_dir), None, *WORLD), AT, DAY)
    image = export.coverage_map(cells, 2)
    width, height = (int.from_bytes(image[i : i + 4], "big") for i in (16, 20))
    at = image.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")]), np.uint8).reshape(height, 1 + width * 3)[:, 1:].reshape(-1, 3)
    found = [(name, int((raw == np.array(colour)).all(axis=1).sum())) for name, colour in export.COLOURS.items()]
    return spark.createDataFrame(found, "status string, pixels bigint")


# ---- translation -----------------------------------------------------------------------------------------------


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier two sections of 16 positions, with states by rules of its key."""
    k = F.col("s_suppkey")
    palette = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.concat(F.lit("m:s"), F.format_string("%02d", (k.cast("int") * 3 + j * 5) % 23), F.when(j == 1, "[a=b]").otherwise("")))
    indices = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i * i + k.cast("int")) % 4)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("c"), k.cast("string")).alias("chunk"), F.explode(F.array((k % 6).cast("int"), F.lit(30))).alias("section_y"), palette.alias("palette"), indices.alias("indices"))
    return rows


def _target(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    target = spark.range(23).where("id % 7 NOT IN (1, 2, 3)").select(F.format_string("m:s%02d", "id").alias("name"))
    rules = spark.range(23).where("id % 7 IN (1, 2)").select(F.when(F.col("id") % 7 == 1, "rename").otherwise("substitution").alias("kind"), F.format_string("m:s%02d", "id").alias("source"), F.format_string("m:s%02d", F.col("id") - F.col("id") % 7).alias("target"), (F.col("id") % 2 == 0).alias("keep_properties"))
    return target, rules


#: The same in DuckDB.
_SECTIONS_SQL = """
sec AS (SELECT 'c' || s_suppkey AS chunk, unnest([CAST(s_suppkey % 6 AS INT), 30]) AS section_y, s_suppkey AS k FROM supplier),
pos AS (SELECT chunk, section_y, k, i, (i * i + k) % 4 AS j FROM sec, range(16) t(i)),
st AS (SELECT *, (k * 3 + j * 5) % 23 AS n, CASE WHEN j = 1 THEN '[a=b]' ELSE '' END AS rest FROM pos),
res AS (SELECT *, 'm:s' || printf('%02d', n) || rest AS source,
  CASE WHEN n % 7 NOT IN (1, 2, 3) THEN 'unchanged' WHEN n % 7 = 1 THEN 'renamed' WHEN n % 7 = 2 THEN 'substituted' ELSE 'skipped' END AS outcome,
  CASE WHEN n % 7 NOT IN (1, 2, 3) THEN 'm:s' || printf('%02d', n) || rest WHEN n % 7 = 1 THEN 'm:s' || printf('%02d', n - 1) || rest
       WHEN n % 7 = 2 THEN 'm:s' || printf('%02d', n - 2) || CASE WHEN n % 2 = 0 THEN rest ELSE '' END END AS target FROM st)"""


def palette_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.palette_counts(_sections(spark, sf_dir))


def resolved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state with what becomes of it: names of the target, renames, substitutions, then the policy."""
    states = _sections(spark, sf_dir).select(F.explode("palette").alias("source")).distinct()
    return translation.resolve_states(states, *_target(spark))


def translation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return translation.translate_chunks(_sections(spark, sf_dir), *_target(spark), 0, 24)[1]


def translated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated sections, position by position; chunks with a state that can't be shown are left out whole."""
    _checkpoints(spark)
    out = translation.translate_chunks(_sections(spark, sf_dir), *_target(spark), 0, 24)[0]
    rising = F.forall(F.sequence(F.lit(1), F.size("palette") - 1), lambda i: F.get("palette", i - 1) < F.get("palette", i))
    return out.select("chunk", "section_y", F.array_join(codec.expanded(F.col("palette"), F.col("indices")), ",").alias("states"), F.when(F.size("palette") > 1, rising).otherwise(F.lit(True)).alias("sorted"))


def filled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    out, _, dropped = translation.translate_chunks(_sections(spark, sf_dir), *_target(spark), 0, 24, "fill")
    filler = out.select("chunk", F.explode(codec.expanded(F.col("palette"), F.col("indices"))).alias("s")).groupBy("chunk").agg(F.count_if(F.col("s") == translation.FILL_BLOCK).alias("filled"))
    return filler.join(dropped, "chunk", "full").select("chunk", "filled", "dropped_sections")


def profile_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two releases made of parts."""
    return translation.profile_delta(*_releases(spark, sf_dir))


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    kind = F.when(k % 5 == 0, "dimension").when(k % 5 == 1, "structure_set").otherwise("block")
    name = F.concat(F.lit("m:"), k.cast("string"))
    size = F.concat(F.lit("-4:"), (F.col("p_size") + 1).cast("string"))
    value = lambda changed: F.when(k % 5 == 0, F.when(changed & (k % 3 == 0), F.concat(F.lit("-3:"), (F.col("p_size") + 5).cast("string"))).when(changed & (k % 3 == 1), F.concat(F.lit("-5:"), (F.col("p_size") + 9).cast("string"))).otherwise(size)).when(k % 5 == 1, F.when(changed & (k % 4 == 2), "other").otherwise(F.col("p_brand"))).otherwise("")
    make = lambda changed: p.where(k % 13 != (4 if changed else 6)).select(kind.alias("kind"), name.alias("name"), value(F.lit(changed)).alias("value"))
    return make(False), make(True)


def release_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.touches_existing(profile_delta(spark, sf_dir))


# ---- seeds -----------------------------------------------------------------------------------------------------

#: Evidence that some seeds in the range agree with.
EVIDENCE = [
    {"spacing": 4, "separation": 1, "salt": 14357617, "spread_type": "linear", "x": 5, "z": -3},
    {"spacing": 5, "separation": 2, "salt": 10387319, "spread_type": "triangular", "x": -9, "z": 11},
    {"spacing": 6, "separation": 3, "salt": 94251327, "spread_type": "linear", "x": 0, "z": 1},
]
_FIRST, _LAST = -20_000, 40_000


def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_seeds(spark, EVIDENCE, _FIRST, _LAST, "tests")[0]


def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of a search that stops at a limit."""
    r = search.search_seeds(spark, EVIDENCE[:1], _FIRST, _LAST, "tests", 50)[1]
    return spark.createDataFrame([(r["scanned"], r["truncated"], r["candidates"], ",".join(sorted(r["caveats"])))], "scanned bigint, truncated boolean, candidates bigint, caveats string")


def _seed_sql(evidence: list[dict]) -> str:
    """Draws of the 48-bit generator in DuckDB. Bounds here are far below 2^31, and a draw that would be drawn again is one in a hundred million."""
    m = (1 << 48) - 1
    ctes, found = ["s0 AS (SELECT CAST(range AS HUGEINT) AS seed FROM range(%d, %d))" % (_FIRST, _LAST + 1)], "s0"
    for k, e in enumerate(evidence):
        rx, rz, bound, draws = e["x"] // e["spacing"], e["z"] // e["spacing"], e["spacing"] - e["separation"], 4 if e["spread_type"] == "triangular" else 2
        shift = rx * 341873128712 + rz * 132897987541 + e["salt"]
        start = f"xor((seed + ({shift})) & CAST({m} AS HUGEINT), CAST({0x5DEECE66D} AS HUGEINT))"
        names = []
        for d in range(draws):
            before = f"e{k}_{d - 1}" if d else f"e{k}_s"
            if d == 0:
                ctes.append(f"e{k}_s AS (SELECT *, {start} AS st FROM {found})")
            names.append(f"d{k}_{d}")
            value = f"(st >> 17) * {bound} >> 31" if bound & (bound - 1) == 0 else f"(st >> 17) % {bound}"
            ctes.append(f"e{k}_{d} AS (SELECT * EXCLUDE (st0), {value} AS {names[-1]} FROM (SELECT * EXCLUDE (st), st AS st0, (st * {0x5DEECE66D} + 11) & CAST({m} AS HUGEINT) AS st FROM {before}))")
        place = names if draws == 2 else [f"(({names[0]} + {names[1]}) // 2)", f"(({names[2]} + {names[3]}) // 2)"]
        ctes.append(f"f{k} AS (SELECT seed FROM e{k}_{draws - 1} WHERE {rx * e['spacing']} + {place[0]} = {e['x']} AND {rz * e['spacing']} + {place[1]} = {e['z']})")
        found = f"f{k}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT CAST(seed AS BIGINT) AS seed FROM {found}"


# ---- capture ---------------------------------------------------------------------------------------------------


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty ticks of the cells of a grid of customers, each loaded at tick 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 12).cast("int").alias("x"), (F.col("event_id") % 3).cast("int").alias("z"), (1 + F.col("event_id") * 7919 % 6000).alias("tick"), F.lit("dirty").alias("kind")).distinct()
    return e.unionByName(e.select("x", "z").distinct().select("x", "z", F.lit(0).cast("bigint").alias("tick"), F.lit("load").alias("kind")))


_TICKS_SQL = """
e AS (SELECT DISTINCT CAST(user_id % 12 AS INT) AS x, CAST(event_id % 3 AS INT) AS z, 1 + event_id * 7919 % 6000 AS tick FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY x, z ORDER BY tick) AS k FROM (SELECT * FROM e UNION SELECT DISTINCT x, z, 0 FROM e)),
f(x, z, k, first, last) AS (SELECT x, z, k, tick, tick FROM t WHERE k = 1
  UNION ALL SELECT t.x, t.z, t.k, CASE WHEN least(f.last + 4, f.first + 40) <= t.tick THEN t.tick ELSE f.first END, t.tick FROM f JOIN t ON (t.x, t.z, t.k) = (f.x, f.z, f.k + 1)),
cl AS (SELECT x, z, first AS first_tick, max(last) AS last_tick, 'due' AS reason FROM f GROUP BY x, z, first)"""


def dirty_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.dirty_claims_batch(_ticks(spark, sf_dir))


def due_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest claims of a batch, then by position."""
    return capture.claims_to_take(capture.dirty_claims_batch(_ticks(spark, sf_dir)), 25)


def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 37 <> 5")
    return capture.sequence_faults(e.select(F.concat(F.lit("s"), (F.col("event_id") % 8).cast("string")).alias("session_id"), (F.floor(F.col("event_id") / 8) + 1).alias("sequence")))


# ---- declarations ----------------------------------------------------------------------------------------------


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements and observations, good and bad, with what they lack."""
    k = F.col("p_partkey")
    places = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), k.cast("string")).alias("subject"), (F.col("p_size") - 5).alias("spacing"), (k % 30 - 2).alias("separation"), F.when(k % 9 == 4, "spiral").otherwise("linear").alias("spread_type"))
    e = F.col("event_id")
    rows = _records(spark, sf_dir).withColumns({"contributor": F.when(e % 31 == 3, " \t").otherwise(F.col("contributor")), "protocol": F.when(e % 29 == 5, F.lit(None)).otherwise(F.col("protocol")), "id": F.when(e % 23 == 7, F.upper("id")).otherwise(F.col("id"))})
    found = [governance.validated(places, "placement"), governance.validated(rows.withColumn("subject", F.concat(F.lit("o"), e.cast("string"))), "observation")]
    return found[0].select("subject", F.array_join("problems", "; ").alias("problems")).unionByName(found[1].select("subject", F.array_join("problems", "; ").alias("problems"))).where("problems <> ''")


def declarations_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of which some are declared again and some withdrawn."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    old = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("v"), F.lit(1).alias("declared_at"))
    again = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("again "), "n_name").alias("v"), F.lit(2).alias("declared_at"))
    return governance.withdraw(governance.upsert(old, again), ["1", "6", "99"]).select("id", "v")


def export_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for server in ("srv-view", " SRV-Click", "srv-error", "srv-purchase", "srv-signup"):
        try:
            out.append((server, governance.export_gate(events.policies(spark), server)))
        except PermissionError:
            out.append((server, None))
    return spark.createDataFrame(out, "server string, disposition string")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of nations' names by one key, of which every fifth is altered, checked."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.sha2(F.col("n_name").cast("binary"), 256).alias("id"), F.lit("Alice").alias("contributor"), "n_nationkey")
    signed = governance.sign_all(n, "42" * 32, " alice").join(n.select(F.col("id").alias("observation_id"), "n_nationkey"), "observation_id")
    altered = signed.withColumn("signature", F.when(F.col("n_nationkey") % 5 == 2, F.concat(F.expr("substr(signature, 1, 126)"), F.lit("00"))).otherwise(F.col("signature")))
    return governance.with_valid_signatures(altered).select("n_nationkey", "valid")


def attestation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    e = F.col("event_id")
    own = obs.where(e % 3 != 0).select(F.col("id").alias("observation_id"), F.concat(F.lit("k"), (e % 4).cast("string")).alias("public_key"), (e % 10 != 4).alias("valid"))
    twice = own.unionByName(obs.where(e % 7 == 1).select(F.col("id").alias("observation_id"), F.lit("k9").alias("public_key"), F.lit(True).alias("valid"))).unionByName(spark.createDataFrame([("nobody", "k1", True)], "observation_id string, public_key string, valid boolean"))
    return governance.attestation_tally(obs, twice, spark.createDataFrame([("a", "k1"), ("b", "k2"), ("b2", "k2")], "label string, public_key string"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with sections of terrain and biomes missing here and there."""
    e = F.col("event_id")
    names = F.array_compact(F.array(
        *(F.when(e % 5 != j, F.lit(f"mcjava.blocks.{j - 2}")) for j in range(4)), *(F.when(e % 7 != j, F.lit(f"mcjava.biomes.{j - 2}")) for j in range(4)), F.when(e % 2 == 0, F.lit("mcjava.block_entities"))
    ))
    return integrity.completeness(_obs(spark, sf_dir).select("id", F.struct(F.lit(-2).alias("min_section_y"), F.lit(4).alias("section_count")).alias("shape"), names.alias("component_names")))


_FINGERPRINT = """s AS (SELECT DISTINCT server_id, dimension, x, z, state_digest FROM obs), c AS (SELECT name, digest, max(size) AS size FROM comp GROUP BY ALL)"""
_C = events.COMPONENTS_SQL
_RED = f"red AS ({events.REDACTIONS_SQL.replace('STRING', 'VARCHAR')})"
_PO = f"po AS ({events.POLICIES_SQL.replace('STRING', 'VARCHAR')})"
_OBJECTS_SQL = "ob AS (SELECT DISTINCT b, sha256(b) AS digest, octet_length(encode(b)) AS size FROM (SELECT biomes AS b FROM r0 UNION ALL SELECT terrain FROM r0))"
_SEGMENT = "rtrim(translate(to_base64(encode({0})), '+/', '-_'), '=')"
_ROWS = "SELECT server_id, dimension, x, z, count(*) AS observations, sha256(string_agg(id || chr(0), '' ORDER BY id)) AS digest FROM obs GROUP BY ALL"


def _held_sql(step: str, rows: str, digests: str) -> str:
    return f"SELECT '{step}' AS step, (SELECT count(*) FROM rec WHERE {rows}) AS observations, (SELECT count(DISTINCT id) FROM rec WHERE {rows}) AS ids, count(*) AS objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ob WHERE {digests}"


_USED = lambda where: f"b IN (SELECT biomes FROM rec WHERE {where} UNION ALL SELECT terrain FROM rec WHERE {where})"

_FUNCTIONS = (
    observation_identity, stored_record_check, record_json, index_lines, encoded_names, store_steps, store_exchange, object_check, document_check, transfer_selection, bundle_manifests, spool_kinds, fingerprint_text, ledger_manifest,
    epoch_manifest, dimension_scan, landmark_summary, fingerprint_of_server, releases, foreign_namespaces, compatibility_notice, section_ranges, id_prefix, truncated_listing, server_status, ledger_status, next_steps, why_empty, scope_texts, name_checks,
    block_states, rfc3339_times, region_slots, digests, sizes_and_bounds, strict_json, codec_shapes, codec_blocks, codec_biomes, codec_bytes, packed_indices, region_export, capture_shapes, coverage_pixels, palette_counts, resolved_states,
    translation_report, translated_sections, filled_sections, profile_delta, release_effect, seed_search, seed_report, dirty_claims, due_claims, sequence_faults, validation, declarations_current, export_gates, signatures,
    attestation_tally, completeness,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SIZE_WORDS = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824) ELSE printf('%.1f TiB', n / 1099511627776) END"

ORACLES = {
    "observation_identity": _with(_V, _REC) + "SELECT event_id, state AS state_digest, id FROM rec",
    "stored_record_check": _with(_V, _REC)
    + """SELECT 'invalid record' AS kind, id AS subject, unnest(list_filter([CASE WHEN event_id % 83 = 11 THEN 'server is not normalized' END, CASE WHEN event_id % 79 = 13 THEN 'state digest doesn''t follow from the components' END,
       CASE WHEN event_id % 97 = 5 OR event_id % 89 = 7 OR event_id % 83 = 11 OR event_id % 79 = 13 THEN 'id doesn''t follow from the record' END], lambda p: p IS NOT NULL)) AS detail FROM rec""",
    "record_json": _with(_V, _REC) + "SELECT id, server_id, dimension, x, z, observed_at, CAST(epoch_us(observed_at) % 1000000 * 1000 AS INT) AS observed_nanos, protocol, contributor, 'agent' AS agent, state AS state_digest, CAST(2 AS BIGINT) AS n FROM rec",
    "index_lines": _with(_V) + "SELECT server_id, dimension, x, z, CASE WHEN event_id % 101 = 3 THEN upper(id) ELSE id END AS id, event_id % 101 <> 3 AS valid FROM obs",
    "encoded_names": f"SELECT DISTINCT p_name || 'ÿ?>' || p_type AS name, {_SEGMENT.format(repr('@')).replace(repr('@'), 'p_name || chr(255) || chr(63) || chr(62) || p_type')} AS segment, p_name || 'ÿ?>' || p_type AS again FROM part",
    "store_steps": _with(_V, _REC, _OBJECTS_SQL)
    + " UNION ALL ".join((_held_sql("created", "FALSE", "FALSE"), _held_sql("some appended", "event_id % 3 <> 0", _USED("event_id % 3 <> 0")), _held_sql("all appended", "TRUE", "TRUE"), _held_sql("purged", "contributor <> 'c1'", _USED("contributor <> 'c1'")))),
    "store_exchange": _with(_V, _REC, _OBJECTS_SQL)
    + f"""SELECT 'two' AS receiver, (SELECT count(*) FROM rec WHERE event_id % 3 = 1) AS received, (SELECT count(*) FROM ob WHERE {_USED('event_id % 3 <> 0')} AND NOT ({_USED('event_id % 3 <> 1')})) AS objects_sent, TRUE AS all_accounted, CAST(0 AS BIGINT) AS received_again, TRUE AS same_root
       UNION ALL SELECT 'one', (SELECT count(*) FROM rec WHERE event_id % 3 = 0), (SELECT count(*) FROM ob WHERE {_USED('event_id % 3 <> 1')} AND NOT ({_USED('event_id % 3 <> 0')})), TRUE, 0, TRUE""",
    "object_check": _with(_V, _REC, _OBJECTS_SQL) + "SELECT 'corrupt object' AS kind, digest AS subject FROM ob WHERE CAST('0x' || left(digest, 4) AS BIGINT) % 7 = 3",
    "document_check": _with(_V)
    + """, d AS (SELECT event_id, id, CASE WHEN event_id % 37 = 3 THEN 'x' ELSE '' END || id AS name FROM obs)
       SELECT CASE WHEN event_id % 41 = 7 THEN 'unreadable record' ELSE 'misnamed record' END AS kind, 'file:/ledger/observations/' || left(id, 2) || '/' || name || '.json' AS subject,
         CASE WHEN event_id % 41 = 7 THEN '' WHEN event_id % 41 = 8 THEN 'it holds no id' ELSE 'it holds ' || id END AS detail FROM d WHERE event_id % 41 IN (7, 8) OR event_id % 37 = 3
       UNION ALL SELECT 'unfinished change', 'file:/ledger/journal/' || id, 'left in the journal' FROM obs WHERE event_id % 53 = 5 AND event_id % 2 = 1""",
    "transfer_selection": _with(_V, _TWO_SQL)
    + """, ca AS (SELECT server_id, dimension, x, z, string_agg(id, ',' ORDER BY id) AS d FROM la GROUP BY ALL), cb AS (SELECT server_id, dimension, x, z, string_agg(id, ',' ORDER BY id) AS d FROM lb GROUP BY ALL)
       SELECT id FROM la JOIN ca USING (server_id, dimension, x, z) LEFT JOIN cb USING (server_id, dimension, x, z) WHERE ca.d IS DISTINCT FROM cb.d AND (server_id, dimension) IN (SELECT (server_id, dimension) FROM lb)""",
    "bundle_manifests": _with(_V, _REC)
    + """SELECT event_id, CASE WHEN event_id % 43 = 2 THEN 'json' WHEN event_id % 50 = 9 THEN 'key' WHEN event_id % 47 = 3 AND event_id % 50 = 7 THEN 'contributor is required' WHEN event_id % 47 = 3 THEN 'a component''s reference is invalid' WHEN event_id % 50 = 7 THEN 'contributor' ELSE '' END AS problem,
       CASE WHEN event_id % 43 <> 2 AND event_id % 50 NOT IN (7, 9) AND event_id % 47 <> 3 THEN id END AS id FROM rec""",
    "spool_kinds": "SELECT CASE event_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'writing' WHEN 2 THEN 'quarantined' WHEN 3 THEN 'imported' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "fingerprint_text": _with(_V, _C, _FINGERPRINT)
    + """SELECT (SELECT count(*) FROM s) AS states, (SELECT count(*) FROM c) AS components, (SELECT CAST(sum(size) AS BIGINT) FROM c) AS bytes,
       sha256((SELECT string_agg('state ' || server_id || ' ' || dimension || ' ' || x || ' ' || z || ' ' || state_digest || chr(0), '' ORDER BY server_id, dimension, x, z, state_digest) FROM s)
         || (SELECT string_agg('component ' || name || ' ' || digest || ' ' || size || chr(0), '' ORDER BY name, digest) FROM c)) AS root""",
    "ledger_manifest": _with(_V) + _ROWS,
    "epoch_manifest": _with(_V.replace("FROM events)", "FROM events WHERE event_type = 'view' AND event_id % 4 <> 0)"), _selected_sql("a", "obs", AT, DAY))
    + """, r AS (SELECT sha256('gridwitness.archive-epoch/v1' || chr(0) || 'srv-view' || chr(0) || 'minecraft:overworld' || chr(0) || '2024-01-15T00:00:00Z' || chr(0) || 'corroborated-first' || chr(0) || string_agg(x || chr(0) || z || chr(0) || coalesce(state_digest, '') || chr(0), '' ORDER BY x, z)) AS root FROM a)
       SELECT x, z, status, coalesce(state_digest, '') AS state_digest, root FROM a, r""",
    "dimension_scan": _with(_V) + "SELECT id, x, z, contributor, observed_at FROM obs WHERE server_id = 'srv-view' AND dimension = 'minecraft:overworld'",
    "landmark_summary": _with(_V.replace("FROM events)", "FROM events WHERE event_type = 'view' AND event_id % 4 <> 0)"), _selected_sql("a", "obs", AT, DAY))
    + "SELECT count(*) AS chunks, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.replace('-', '_')}" for s in selection.STATUSES) + " FROM a WHERE x BETWEEN -2 AND 2 AND z BETWEEN -2 AND 2",
    "fingerprint_of_server": _with(_V) + "SELECT DISTINCT server_id, dimension, x, z, state_digest FROM obs WHERE server_id = 'srv-click'",
    "releases": "SELECT DISTINCT '1.' || event_id % 11 AS release FROM events WHERE event_id % 7 <> 0",
    "foreign_namespaces": "SELECT DISTINCT 'mod' || p_size % 6 AS namespace FROM part WHERE p_partkey % 3 <> 0",
    "compatibility_notice": "SELECT (SELECT string_agg(DISTINCT '1.' || event_id % 5, ', ' ORDER BY '1.' || event_id % 5) FROM events) AS releases, (SELECT string_agg(DISTINCT 'mod' || p_size % 4, ', ' ORDER BY 'mod' || p_size % 4) FROM part WHERE p_partkey % 3 <> 0) AS namespaces",
    "section_ranges": """WITH t AS (SELECT p_partkey, CAST(p_partkey % 9 - 4 AS INT) AS low, p_size % 12 AS n, CAST(p_partkey % 17 - 6 AS INT) AS y FROM part)
       SELECT p_partkey, CASE WHEN n > 0 THEN low + n - 1 END AS high, CASE WHEN n > 0 THEN low * 16 END AS blocks_low, CASE WHEN n > 0 THEN (low + n) * 16 - 1 END AS blocks_high, n > 0 AND y BETWEEN low AND low + n - 1 AS inside FROM t""",
    "id_prefix": _with(_V) + "SELECT min(id) AS id FROM obs",
    "truncated_listing": _with(_V) + "SELECT id, (SELECT count(*) - 20 FROM obs) AS more FROM obs ORDER BY observed_at, id LIMIT 20",
    "server_status": _with(_V, _PO)
    + f"""SELECT o.server_id, dimensions, chunks, observations, disposition IS NOT NULL AS declared, disposition, coalesce(disposition = 'public' OR (lower(trim(disposition)) = 'embargoed' AND TIMESTAMP '{AT}' > embargo_until), FALSE) AS allowed,
       CASE WHEN disposition IS NULL THEN 'no policy was declared' WHEN disposition = 'public' THEN 'public' WHEN disposition = 'research' THEN 'research only' WHEN TIMESTAMP '{AT}' > embargo_until THEN 'the embargo is over' ELSE 'under embargo' END AS reason
       FROM (SELECT server_id, count(DISTINCT dimension) AS dimensions, count(DISTINCT (dimension, x, z)) AS chunks, count(*) AS observations FROM obs GROUP BY 1) o LEFT JOIN po ON po.server = o.server_id""",
    "ledger_status": _with(_V, _C)
    + """SELECT (SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT (server_id, dimension, x, z)) FROM obs) AS chunks, (SELECT count(DISTINCT server_id) FROM obs) AS servers, count(*) AS objects, CAST(sum(size) AS BIGINT) AS object_bytes,
       CAST(5 AS BIGINT) AS redactions, (SELECT count(*) FROM nation) AS keys FROM (SELECT digest, max(size) AS size FROM comp GROUP BY digest)""",
    "next_steps": "SELECT * FROM (VALUES ('waiting', 'import'), ('nothing at all', 'install'), ('nothing yet', 'play'), ('undeclared', 'declare'), ('all declared', 'export')) AS t(\"case\", step)",
    "why_empty": "SELECT * FROM (VALUES ('empty', TRUE), ('server', TRUE), ('dimension', TRUE), ('before', TRUE), ('fine', FALSE)) AS t(\"case\", diagnosed)",
    "scope_texts": "WITH " + _RED + ", " + _PO
    + """ SELECT id, 'server ' || server_id || '; ' || coalesce('contributor ' || contributor, 'every contributor') || '; ' || coalesce('dimension ' || dimension, 'every dimension') || '; ' ||
         CASE WHEN min_x IS NULL THEN 'every place' ELSE 'x ' || min_x || ' to ' || max_x || ', z ' || min_z || ' to ' || max_z END AS words FROM red
       UNION ALL SELECT server, server || ': ' || lower(trim(disposition)) || coalesce(' until ' || strftime(embargo_until, '%Y-%m-%d %H:%M:%S'), '') FROM po""",
    "name_checks": """SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS location, p_partkey % 5 = 4 AS token, p_partkey % 6 = 5 AS path,
       CASE WHEN p_partkey % 4 = 0 AND p_partkey % 30 <> 0 THEN CAST(-(p_partkey % 30) AS INT) WHEN p_partkey % 4 = 3 THEN CAST(p_partkey % 30 AS INT) END AS section,
       CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 > 1 THEN 'mc' END AS namespace, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 > 1 THEN 'a/b' END AS dimension_path FROM part""",
    "block_states": """WITH s AS (SELECT p_partkey, 'mc:b' || p_partkey % 9 AS name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '[size=' || p_size || ']' ELSE '[axis=y,lit=false,z=' || p_partkey % 3 || ']' END AS rest FROM part)
       SELECT p_partkey, name || rest AS state, name, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS BIGINT) AS n, CASE WHEN p_partkey % 4 > 1 THEN 'y' END AS axis FROM s""",
    "rfc3339_times": """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, printf('%09d', event_id * 7919 % 1000000000) AS nine FROM events)
       SELECT event_id, event_id % 4 <> 3 AS known, CASE event_id % 4 WHEN 0 THEN s || 'Z' WHEN 1 THEN s || CASE WHEN rtrim(nine, '0') = '' THEN '' ELSE '.' || rtrim(nine, '0') END || 'Z' WHEN 2 THEN s || '.12Z' END AS again FROM t""",
    "region_slots": "WITH c AS (SELECT o_orderkey, CAST(o_orderkey * 31 % 9000 - 4500 AS INT) AS x, CAST(o_custkey * 17 % 9000 - 4500 AS INT) AS z FROM orders) SELECT o_orderkey, CAST(floor(x / 32) AS INT) AS rx, CAST(floor(z / 32) AS INT) AS rz, CAST((x - 32 * floor(x / 32)) + (z - 32 * floor(z / 32)) * 32 AS INT) AS slot FROM c",
    "digests": _with(_V) + "SELECT event_id, left(CASE WHEN event_id % 9 = 4 THEN upper(id) ELSE id END, 12) AS short, event_id % 9 <> 4 AS valid, sha256(unhex(id)) AS fingerprint FROM obs",
    "sizes_and_bounds": f"""WITH t AS (SELECT n_nationkey AS k, CAST(power(1500, n_nationkey % 5) AS BIGINT) * (n_nationkey + 1) AS n FROM nation)
       SELECT k AS n_nationkey, {_SIZE_WORDS} AS size, least(k, -k) AS min_x, least(7 - k, k * 3) AS min_z, greatest(k, -k) AS max_x, greatest(7 - k, k * 3) AS max_z FROM t""",
    "strict_json": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'no strict JSON' WHEN 1 THEN 'unknown key z' WHEN 2 THEN 'no strict JSON' WHEN 3 THEN 'no object' WHEN 4 THEN 'not UTF-8' ELSE 'fine' END AS problem FROM events",
    "codec_shapes": """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 2 THEN CAST(s_suppkey % 9 - 4 AS INT) END AS min_section_y, CASE WHEN s_suppkey % 7 <> 2 THEN s_suppkey % 20 + 1 END AS section_count, s_suppkey % 4 AS entities,
       CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 40 - 20 AS INT) END AS first_y, CASE WHEN s_suppkey % 4 > 0 THEN 'items,name' END AS fields, CASE WHEN s_suppkey % 4 > 0 THEN TRUE END AS nested FROM supplier""",
    "codec_blocks": "SELECT s_suppkey AS k, CAST(s_suppkey % 8 - 4 AS INT) AS section_y, 'minecraft:b' || (i * i + s_suppkey) % (s_suppkey % 6 + 1) AS state, count(*) AS positions FROM supplier, range(4096) t(i) GROUP BY ALL",
    "codec_biomes": "SELECT s_suppkey AS k, sha256(string_agg('minecraft:m' || (i + s_suppkey) % 3, ',' ORDER BY i)) AS digest, 'minecraft:m' || (5 + s_suppkey) % 3 AS fifth FROM supplier, range(64) t(i) GROUP BY s_suppkey",
    "codec_bytes": "WITH t AS (SELECT s_suppkey AS k, s_suppkey % 16 - 8 AS y FROM supplier) SELECT k, "
    + f"sha256({_t8(repr(codec.domain('chunk-shape')))} || {_u4('y')} || {_u4('k % 30 + 1')}) AS shape, "
    + f"sha256({_t8(repr(codec.domain('block-section')))} || {_u4('y')} || unhex('0001') || " + _t8("'minecraft:b' || k") + " || unhex(repeat('0000', 4096))) AS blocks, "
    + f"sha256({_t8(repr(codec.domain('biome-section')))} || {_u4('y')} || unhex('0002') || {_t8(repr('minecraft:a'))} || {_t8(repr('minecraft:b'))} || unhex(repeat('00000001', 32))) AS biomes, "
    + "(SELECT string_agg('m:b' || printf('%04d', i), ',' ORDER BY i) FROM range(k % 5 + 1) r(i)) AS numbered FROM t",
    "packed_indices": """WITH b AS (SELECT p_partkey, p_size, greatest(4, length(bin(p_size - 1))) AS bits FROM part WHERE p_size > 1),
       v AS (SELECT p_partkey, CAST(i // (64 // bits) AS INT) AS j, CAST((i * 5 + p_partkey) % p_size AS HUGEINT) << CAST(i % (64 // bits) * bits AS INT) AS part FROM b, range(40) t(i)),
       s AS (SELECT p_partkey, j, sum(part) AS u FROM v GROUP BY ALL)
       SELECT p_partkey, j, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS packed FROM s""",
    "region_export": _with(_V) + ", c AS (SELECT DISTINCT x * 11 AS x, z * 11 AS z FROM obs WHERE server_id = 'srv-view') SELECT 'r.' || (x >> 5) || '.' || (z >> 5) || '.mca' AS file_name, CAST(count(*) AS INT) AS chunks, TRUE AS whole, CAST(count(*) AS INT) AS slots FROM c GROUP BY x >> 5, z >> 5",
    "capture_shapes": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(k in (2, 3, 4, 6)).upper()})" for k, s in enumerate(search.SHAPES)) + ") AS t(shape, present)",
    "coverage_pixels": _with(_V.replace("FROM events)", "FROM events WHERE event_type = 'view' AND event_id % 4 <> 0)"), _selected_sql("a", "obs", AT, DAY))
    + "SELECT s.status, count(a.x) * 4 AS pixels FROM (VALUES ('corroborated'), ('single-source'), ('superseded'), ('conflict')) AS s(status) LEFT JOIN a ON a.status = s.status GROUP BY 1",
    "palette_counts": _with(_SECTIONS_SQL) + "SELECT chunk, section_y, source, count(*) AS positions FROM res GROUP BY ALL",
    "resolved_states": _with(_SECTIONS_SQL.replace("(i * i + k) % 4 AS j FROM sec, range(16) t(i)", "i AS j FROM sec, range(4) t(i)")) + "SELECT DISTINCT source, outcome, target FROM res",
    "translation_report": _with(_SECTIONS_SQL) + "SELECT source, max(outcome) AS outcome, max(target) AS target, count(*) AS positions FROM res WHERE section_y < 24 AND outcome <> 'unchanged' GROUP BY source",
    "translated_sections": _with(_SECTIONS_SQL)
    + ", bad AS (SELECT DISTINCT 'c' || s_suppkey AS chunk FROM supplier, range(4) t(j) WHERE (s_suppkey * 3 + j * 5) % 23 % 7 = 3) SELECT chunk, section_y, string_agg(target, ',' ORDER BY i) AS states, TRUE AS sorted FROM res WHERE section_y < 24 AND chunk NOT IN (SELECT chunk FROM bad) GROUP BY ALL",
    "filled_sections": _with(_SECTIONS_SQL) + "SELECT chunk, count(*) FILTER (WHERE section_y < 24 AND outcome = 'skipped') AS filled, CAST(1 AS BIGINT) AS dropped_sections FROM res GROUP BY chunk",
    "profile_delta": """SELECT CASE p_partkey % 5 WHEN 0 THEN 'dimension' WHEN 1 THEN 'structure_set' ELSE 'block' END AS kind, 'm:' || p_partkey AS name,
       CASE WHEN p_partkey % 13 = 4 THEN 'removed' WHEN p_partkey % 13 = 6 THEN 'added' WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN 'narrowed' ELSE 'changed' END AS change FROM part
       WHERE p_partkey % 13 IN (4, 6) OR (p_partkey % 5 = 0 AND p_partkey % 3 IN (0, 1)) OR (p_partkey % 5 = 1 AND p_partkey % 4 = 2)""",
    "release_effect": "SELECT TRUE AS affected, count(*) AS changes FROM part WHERE p_partkey % 13 IN (4, 6) OR (p_partkey % 5 = 0 AND p_partkey % 3 IN (0, 1)) OR (p_partkey % 5 = 1 AND p_partkey % 4 = 2)",
    "seed_search": _seed_sql(EVIDENCE),
    "seed_report": f"WITH n AS ({_seed_sql(EVIDENCE[:1])}) SELECT CAST({_LAST - _FIRST + 1} AS BIGINT) AS scanned, count(*) > 50 AS truncated, least(count(*), 50) AS candidates, 'ambiguous,few_observations,partial_space,seed_bits,truncated' AS caveats FROM n",
    "dirty_claims": _with(_TICKS_SQL) + "SELECT * FROM cl",
    "due_claims": _with(_TICKS_SQL) + "SELECT * FROM cl ORDER BY first_tick, x, z LIMIT 25",
    "sequence_faults": """WITH e AS (SELECT 's' || event_id % 8 AS session_id, event_id // 8 + 1 AS sequence FROM events WHERE event_id % 37 <> 5),
       l AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY session_id ORDER BY sequence) + 1, 1) AS expected FROM e) SELECT * FROM l WHERE sequence <> expected""",
    "validation": _with(_V)
    + """, p AS (SELECT 'p' || p_partkey AS subject, array_to_string(list_filter([CASE WHEN p_size - 5 <= 0 THEN 'spacing is above zero' END, CASE WHEN p_partkey % 30 - 2 < 0 THEN 'separation is not negative' END,
         CASE WHEN p_partkey % 30 - 2 >= p_size - 5 THEN 'separation is under spacing' END, CASE WHEN p_partkey % 9 = 4 THEN 'spread is known' END], lambda v: v IS NOT NULL), '; ') AS problems FROM part
         UNION ALL SELECT 'o' || event_id, array_to_string(list_filter([CASE WHEN event_id % 29 = 5 THEN 'protocol is required' END, CASE WHEN event_id % 31 = 3 THEN 'contributor is required' END, CASE WHEN event_id % 23 = 7 THEN 'id is a digest' END], lambda v: v IS NOT NULL), '; ') FROM obs)
       SELECT * FROM p WHERE problems <> ''""",
    "declarations_current": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'again ' || n_name ELSE n_name END AS v FROM nation WHERE n_nationkey NOT IN (1, 6)",
    "export_gates": "SELECT * FROM (VALUES ('srv-view', 'public'), (' SRV-Click', 'embargoed'), ('srv-error', 'Embargoed '), ('srv-purchase', 'research'), ('srv-signup', NULL)) AS t(server, disposition)",
    "signatures": "SELECT n_nationkey, n_nationkey % 5 <> 2 AS valid FROM nation",
    "attestation_tally": _with(_V)
    + """, a AS (SELECT id, 'k' || event_id % 4 AS k, event_id % 10 <> 4 AS valid FROM obs WHERE event_id % 3 <> 0 UNION ALL SELECT id, 'k9', TRUE FROM obs WHERE event_id % 7 = 1)
       SELECT (SELECT count(*) FROM obs WHERE id NOT IN (SELECT id FROM a)) AS unattested, count(*) FILTER (WHERE valid AND k IN ('k1', 'k2')) AS recognised, count(*) FILTER (WHERE valid AND k NOT IN ('k1', 'k2')) AS unregistered, count(*) FILTER (WHERE NOT valid) AS invalid FROM a""",
    "completeness": _with(_V) + "SELECT id, event_id % 5 >= 4 AS terrain_complete, event_id % 7 >= 4 AS biome_complete, event_id % 2 = 0 AS has_baseline FROM obs",
}
