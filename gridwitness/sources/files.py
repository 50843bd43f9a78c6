"""Ledgers in files: capture bundles and spools, the directory layout of records and objects, fingerprints and declarations as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import is_rfc3339, namespace_of_schema, observation_id, rfc3339_nanos, rfc3339_time, state_digest
from ..functions.strict_json import json_problem
from ..functions.text import is_digest, is_relative_path, normalized, trimmed
from .schemas import BUNDLE_JSON, BUNDLE_KEYS, MAX_ALL, MAX_COMPONENTS, MAX_MANIFEST, MAX_ONE, OBSERVATION_JSON


def decoded_name(segment: Column) -> Column:
    """The name in a base64url directory segment without padding."""
    return F.decode(F.unbase64(F.rpad(F.translate(segment, "-_", "+/"), F.ceil(F.length(segment) / 4).cast("int") * 4, "=")), "UTF-8")


def encoded_name(name: Column) -> Column:
    """A name as a directory segment: base64url without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(name, "UTF-8")), "+/", "-_"), F.lit("="))


def _ledger_columns(o: DataFrame) -> DataFrame:
    return o.select(
        "schema", "id", F.col("chunk.server_id").alias("server_id"), F.col("chunk.dimension").alias("dimension"), F.col("chunk.x").alias("x"), F.col("chunk.z").alias("z"),
        rfc3339_time("observed_at").cast("timestamp_ntz").alias("observed_at"), rfc3339_nanos("observed_at").alias("observed_nanos"), "received_at", "protocol",
        F.col("source.contributor").alias("contributor"), F.col("source.agent").alias("agent"), "components", "state_digest",
    )


def record_rows(docs: DataFrame, text: str = "value") -> DataFrame:
    """Observation records from a column of JSON documents, as OBSERVATIONS has them."""
    return _ledger_columns(docs.select(F.from_json(text, OBSERVATION_JSON, {"mode": "FAILFAST"}).alias("o")).select("o.*"))


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """The observation records below root/observations, as OBSERVATIONS has them; unknown keys are passed over."""
    return _ledger_columns(spark.read.schema(OBSERVATION_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(f"{root}/observations"))


def index_rows(lines: DataFrame) -> DataFrame:
    """(server_id, dimension, x, z, id, valid) of index lines (value, p), p the path .../<server>/<dimension>/<x>/<z>."""
    parts = F.split("p", "/")
    at = lambda k: F.element_at(parts, -k)
    number = lambda c: F.regexp_extract(c, r"^(-?\d+)", 1).cast("int")
    return lines.where("value <> ''").select(decoded_name(at(4)).alias("server_id"), decoded_name(at(3)).alias("dimension"), number(at(2)).alias("x"), number(at(1)).alias("z"), F.col("value").alias("id"), is_digest("value").alias("valid"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """(server_id, dimension, x, z, id, valid) of the cells' index files: root/index/<server>/<dimension>/<x>/<z>, an id a line."""
    return index_rows(spark.read.option("recursiveFileLookup", True).text(f"{root}/index").select("value", F.col("_metadata.file_path").alias("p")))


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """(digest, size, bytes) of the content-addressed files root/objects/sha256/ab/cd/<digest>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/objects/sha256")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("digest"), F.col("length").alias("size"), F.col("content").alias("bytes"))


def read_attestations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("schema string, observation_id string, public_key string, signature string, signed_at string").option("multiLine", True).option("recursiveFileLookup", True).json(folder)


def read_declarations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Small declaration documents (policies, redactions, landmarks, identities), one a file."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(folder)


# ---- spools and bundles ----------------------------------------------------------------------------------------


def spool_kind(name: Column) -> Column:
    """ready, writing, quarantined, imported or other, by a folder's name."""
    return F.when(name.startswith("ready-"), "ready").when(name.startswith(".tmp-"), "writing").when(name.startswith("quarantine-"), "quarantined").when(name.startswith("imported-"), "imported").otherwise("other")


def spool_counts(spark: SparkSession, spool: str) -> DataFrame:
    """Bundles and bytes in a spool by kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(spool).select("path", "length")
    name = F.regexp_extract("path", r"/([^/]+)/(?:bundle\.json|components/.*|[^/]+)$", 1)
    return files.groupBy(spool_kind(name).alias("kind")).agg(F.count_distinct(name).alias("bundles"), F.sum("length").alias("bytes"))


def bundle_rows(manifests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """manifests (path, content of bundle.json) as observations with `problems`; files (path, length, content) are the components' files.

    A bundle is valid if its manifest is strict JSON of known keys within the limits, its paths stay below it, and every component's file
    has the size and hash it claims. Identities are computed here, whatever the manifest says.
    """
    raw = manifests.select(F.regexp_replace("path", r"/bundle\.json$", "").alias("bundle"), "content", json_problem("content", BUNDLE_KEYS).alias("json"))
    doc = raw.select("bundle", "json", F.octet_length("content").alias("bytes"), F.from_json(F.decode("content", "UTF-8"), BUNDLE_JSON).alias("m")).select("bundle", "json", "bytes", "m.*")
    entries = F.map_entries("components")
    sizes = F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["value"]["size"])
    checks = [
        (F.col("json").isNotNull(), F.col("json")), (F.col("bytes") > MAX_MANIFEST, F.lit("the manifest is too large")),
        (~F.coalesce(F.col("schema").rlike(r"\.capture-bundle/v[12]$"), F.lit(False)), F.lit("unsupported schema")),
        (F.coalesce(normalized("server_id") == "", F.lit(True)), F.lit("server is required")), (F.coalesce(normalized("dimension") == "", F.lit(True)), F.lit("dimension is required")),
        (F.coalesce(trimmed("source.contributor") == "", F.lit(True)), F.lit("contributor is required")), (F.col("chunk").isNull(), F.lit("chunk is required")),
        (~F.coalesce(is_rfc3339("observed_at"), F.lit(False)), F.lit("observed_at is no instant")),
        (F.col("components").isNull() | (F.size("components") == 0) | (F.size("components") > MAX_COMPONENTS), F.lit("no valid number of components")),
        (F.exists(entries, lambda e: ~F.coalesce((e["value"]["algorithm"] == "sha256") & is_digest(e["value"]["digest"]) & e["value"]["size"].between(0, MAX_ONE) & is_relative_path(e["value"]["path"]), F.lit(False))), F.lit("a component's reference is invalid")),
        (sizes > MAX_ALL, F.lit("the components are too large")),
    ]
    doc = doc.withColumn("problems", F.array_compact(F.array(*(F.when(bad, text) for bad, text in checks))))
    if files is not None:
        claimed = doc.select("bundle", F.explode("components").alias("name", "c")).select("bundle", F.concat("bundle", F.lit("/"), "c.path").alias("path"), "c.digest", "c.size")
        wrong = claimed.join(files.select("path", F.col("length").alias("n"), F.sha2("content", 256).alias("h")), "path", "left").where(~F.coalesce((F.col("n") == F.col("size")) & (F.col("h") == F.col("digest")), F.lit(False)))
        bad = wrong.groupBy("bundle").agg(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("missing or altered component "), F.element_at(F.split(p, "/"), -1))).alias("more"))
        doc = doc.join(bad, "bundle", "left").withColumn("problems", F.concat("problems", F.coalesce("more", F.array().cast("array<string>"))))
    ns = namespace_of_schema("schema")
    blobs = F.transform_values("components", lambda _, v: F.struct(v["algorithm"].alias("algorithm"), v["digest"].alias("digest"), v["size"].alias("size")))
    rows = doc.select(
        "bundle", "problems", F.concat(ns, F.lit(".observation/v1")).alias("schema"), normalized("server_id").alias("server_id"), normalized("dimension").alias("dimension"), F.col("chunk.x").alias("x"), F.col("chunk.z").alias("z"),
        F.when(is_rfc3339("observed_at"), rfc3339_time("observed_at")).cast("timestamp_ntz").alias("observed_at"), rfc3339_nanos("observed_at").alias("observed_nanos"), F.lit(None).cast("string").alias("received_at"),
        trimmed("protocol").alias("protocol"), trimmed("source.contributor").alias("contributor"), F.col("source.agent").alias("agent"), blobs.alias("components"),
    ).withColumn("state_digest", state_digest("components", ns))
    seconds = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    return rows.withColumn("id", observation_id("schema", "server_id", "dimension", "x", "z", seconds, "observed_nanos", "protocol", "contributor", "state_digest"))


def read_spool(spark: SparkSession, spool: str) -> tuple[DataFrame, DataFrame]:
    """(bundle_rows, objects) of the ready bundles of a spool, in order of their names."""
    manifests = spark.read.format("binaryFile").load(f"{spool}/ready-*/bundle.json")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{spool}/ready-*").where(~F.col("path").endswith("/bundle.json"))
    objects = files.select(F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), F.col("content").alias("bytes"))
    return bundle_rows(manifests, files).orderBy("bundle"), objects


# ---- fingerprints as text --------------------------------------------------------------------------------------


def fingerprint_lines(states: DataFrame, components: DataFrame, root: str, namespace: str) -> DataFrame:
    """The lines (value) of a fingerprint's text form, in order; they are sorted and written by Spark, none goes through the driver."""
    spark = states.sparkSession
    none = F.lit("")
    odd = lambda *names: F.greatest(*(F.col(n).rlike(r"(?U)\s").cast("int") for n in names)) == 1
    if not (states.where(odd("server_id", "dimension")).isEmpty() and components.where(F.col("name").rlike(r"(?U)\s")).isEmpty()):
        raise ValueError("names with spaces can't be written as a fingerprint")
    line = lambda part, a, b, x, z, d, value: [F.lit(part).alias("part"), a.alias("a"), b.alias("b"), x.alias("x"), z.alias("z"), d.alias("d"), value.alias("value")]
    zero = F.lit(0)
    s = states.select(*line(1, F.col("server_id"), F.col("dimension"), F.col("x"), F.col("z"), F.col("state_digest"), F.concat_ws(" ", F.lit("state"), *(F.col(c).cast("string") for c in ("server_id", "dimension", "x", "z", "state_digest")))))
    c = components.select(*line(2, F.col("name"), F.col("digest"), zero, zero, none, F.concat_ws(" ", F.lit("component"), "name", "digest", F.col("size").cast("string"))))
    ends = [spark.range(1).select(*line(part, none, none, zero, zero, none, F.lit(value))) for part, value in ((0, f"{namespace}.capture-fingerprint/v1"), (3, f"root {root}"))]
    return ends[0].unionByName(s).unionByName(c).unionByName(ends[1]).orderBy("part", "a", "b", "x", "z", "d").select("value")


def read_fingerprint(lines: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(states, components, root) of a text DataFrame; the root is computed anew and must be the one recorded."""
    words = lines.select(F.split(F.trim("value"), r"\s+").alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    states = words.where((w(0) == "state") & (F.size("w") == 6)).select(w(1).alias("server_id"), w(2).alias("dimension"), w(3).cast("int").alias("x"), w(4).cast("int").alias("z"), w(5).alias("state_digest"))
    components = words.where((w(0) == "component") & (F.size("w") == 4)).select(w(1).alias("name"), w(2).alias("digest"), w(3).cast("bigint").alias("size"))
    recorded = [r[0] for r in words.where((w(0) == "root") & (F.size("w") == 2)).select(w(1)).take(2)]
    from ..operators.comparison import fingerprint_root

    root = fingerprint_root(states, components).first().root
    if recorded != [root]:
        raise ValueError("the recorded root isn't that of the lines")
    return states, components, root
