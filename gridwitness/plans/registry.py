"""The queries on observation ledgers with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir
from ..operators import catalog, comparison, governance, integrity, selection, windows
from ..sources import events

AT, FROM, DAY = "2024-01-15 00:00:00", "2024-01-08 00:00:00", 86_400
KEEP_LOCAL, KEEP_REMOTE = "event_id % 10 <> 0", "event_id % 10 <> 1"


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.observations(spark, sf_dir)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def _view(sql: str, name: str) -> str:
    return f"{name} AS ({sql.replace('STRING', 'VARCHAR')})"


#: Selection in DuckDB by window functions; {obs}, {at} and {width} seconds are put in.
def _selected_sql(name: str, obs: str, at: str, width: int) -> str:
    return f"""
{name}_l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id, dimension, x, z, contributor ORDER BY observed_at DESC, id DESC) AS rn
  FROM {obs} WHERE observed_at <= TIMESTAMP '{at}') WHERE rn = 1),
{name}_g AS (SELECT server_id, dimension, x, z, state_digest, count(*) AS n, max(observed_at) AS mx, min(observed_at) AS mn,
  max(struct_pack(o := observed_at, i := id)) AS top, list_sort(list(contributor)) AS contributors FROM {name}_l GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER w AS rk, lead(n) OVER w AS second, count(*) OVER c AS groups, max(top) OVER c AS newest,
  epoch_us(max(mx) OVER c) - epoch_us(min(mn) OVER c) AS spread FROM {name}_g
  WINDOW w AS (PARTITION BY server_id, dimension, x, z ORDER BY n DESC, mx DESC, state_digest), c AS (PARTITION BY server_id, dimension, x, z)),
{name}_b AS (SELECT *, n >= 2 AND (groups = 1 OR n > second) AS corr FROM {name}_r WHERE rk = 1),
{name} AS (SELECT k.server_id, k.dimension, k.x, k.z,
  CASE WHEN b.n IS NULL THEN 'unknown' WHEN b.corr THEN 'corroborated' WHEN b.groups = 1 THEN 'single-source' WHEN b.spread <= {width}::BIGINT * 1000000 THEN 'conflict' ELSE 'superseded' END AS status,
  s.state_digest, s.top.i AS id, s.top.o AS observed_at, s.contributors, b.groups
  FROM (SELECT DISTINCT server_id, dimension, x, z FROM {obs}) k
  LEFT JOIN {name}_b b ON (b.server_id, b.dimension, b.x, b.z) = (k.server_id, k.dimension, k.x, k.z)
  LEFT JOIN {name}_r s ON (s.server_id, s.dimension, s.x, s.z) = (k.server_id, k.dimension, k.x, k.z) AND CASE WHEN b.corr OR b.groups = 1 THEN s.rk = 1 ELSE s.top = s.newest END)"""


_STATUS_COUNTS = "count(*) AS chunks, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.replace('-', '_')}" for s in selection.STATUSES)
_FLAT = "server_id, dimension, x, z, status, state_digest, id, observed_at, array_to_string(contributors, ',') AS contributors"


def _flat(selected: DataFrame) -> DataFrame:
    return selected.select(*selection.CELL, "status", "state_digest", "id", "observed_at", F.array_join("contributors", ",").alias("contributors"))


def select_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(selection.select_at(selection.gather(_obs(spark, sf_dir)), AT, DAY))


def select_at_default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(selection.select_at(selection.gather(_obs(spark, sf_dir)), AT))


def select_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.select_at(selection.gather(_obs(spark, sf_dir)), AT, DAY).where("rejected IS NOT NULL")
    return chosen.select(*selection.CELL, F.posexplode("rejected").alias("rank", "r")).select(*selection.CELL, "rank", "r.state_digest", F.array_join("r.contributors", ",").alias("contributors"), F.size("r.observations").cast("bigint").alias("observations"))


def select_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(selection.select_at(selection.gather(_obs(spark, sf_dir), events.redactions(spark)), AT, DAY))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.status_summary(selection.select_at(selection.gather(_obs(spark, sf_dir)), AT, DAY), "server_id", "dimension")


def withheld_first_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_redaction(_obs(spark, sf_dir), events.redactions(spark))


_MATCH_SQL = """(lower(trim(o.server_id)) = lower(trim(r.server_id)) AND (r.contributor IS NULL OR lower(r.contributor) = lower(o.contributor))
  AND (r.dimension IS NULL OR lower(r.dimension) = lower(o.dimension)) AND (r.min_x IS NULL OR (o.x BETWEEN r.min_x AND r.max_x AND o.z BETWEEN r.min_z AND r.max_z)))"""
_KEPT_SQL = f"kept AS (SELECT o.* FROM obs o WHERE NOT EXISTS (SELECT 1 FROM red r WHERE {_MATCH_SQL}))"


def diff_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection.diff_between(selection.gather(_obs(spark, sf_dir)), FROM, AT)
    return d.select(*selection.CELL, "kind", "before_status", "before_state_digest", "after_status", "after_state_digest", F.size("revisits").cast("bigint").alias("n_revisits"), F.array_join("revisited_by", ",").alias("revisited_by"))


_DIFF_SQL = f"""
v AS (SELECT server_id, dimension, x, z, list(contributor ORDER BY observed_at, id) AS who FROM obs WHERE observed_at > TIMESTAMP '{FROM}' AND observed_at <= TIMESTAMP '{AT}' GROUP BY ALL),
d AS (SELECT a.server_id, a.dimension, a.x, a.z, a.status AS before_status, a.state_digest AS before_state_digest, b.status AS after_status, b.state_digest AS after_state_digest,
  CASE WHEN a.state_digest IS NULL AND b.state_digest IS NULL THEN 'never-seen' WHEN a.state_digest IS NULL THEN 'first-seen' WHEN a.state_digest <> b.state_digest THEN 'changed'
       WHEN v.who IS NULL THEN 'not-revisited' ELSE 'unchanged' END AS kind, coalesce(len(v.who), 0) AS n_revisits, coalesce(v.who, []) AS who
  FROM a JOIN b ON (a.server_id, a.dimension, a.x, a.z) = (b.server_id, b.dimension, b.x, b.z) LEFT JOIN v ON (a.server_id, a.dimension, a.x, a.z) = (v.server_id, v.dimension, v.x, v.z))"""


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = selection.diff_summary(selection.diff_between(selection.gather(_obs(spark, sf_dir)), FROM, AT))
    return s.withColumn("contributors", F.array_join("contributors", ","))


def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection.diff_between(selection.gather(_obs(spark, sf_dir), server="srv-view", dimension="minecraft:overworld"), FROM, AT)
    return selection.changed_cells(d, 20).select(*selection.CELL, "last_seen")


def agreement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.agreement_windows(_obs(spark, sf_dir), 2 * DAY)
    return w.select(*selection.CELL, "window_start", "window_end", "status", "observations", F.size("states").cast("bigint").alias("n_states"), F.col("states")[0]["state_digest"].alias("first_state"))


_WINDOWS_SQL = f"""
s AS (SELECT *, row_number() OVER (PARTITION BY server_id, dimension, x, z ORDER BY observed_at, id) AS k FROM obs),
f AS (SELECT *, observed_at AS anchor FROM s WHERE k = 1
  UNION ALL SELECT s.*, CASE WHEN s.observed_at > f.anchor + INTERVAL {2 * DAY} SECOND THEN s.observed_at ELSE f.anchor END
  FROM f JOIN s ON (s.server_id, s.dimension, s.x, s.z) = (f.server_id, f.dimension, f.x, f.z) AND s.k = f.k + 1),
st AS (SELECT server_id, dimension, x, z, anchor, state_digest, count(DISTINCT contributor) AS c, min(observed_at) AS a, max(observed_at) AS b, count(*) AS n FROM f GROUP BY ALL)
SELECT server_id, dimension, x, z, min(a) AS window_start, max(b) AS window_end,
  CASE WHEN count(*) > 1 THEN 'conflict' WHEN max(c) >= 2 THEN 'corroborated' ELSE 'single-source' END AS status,
  CAST(sum(n) AS BIGINT) AS observations, count(*) AS n_states, first(state_digest ORDER BY c DESC, state_digest) AS first_state
FROM st GROUP BY server_id, dimension, x, z, anchor"""


def hourly_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hourly_moments(_obs(spark, sf_dir))


def observed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.observed_span(_obs(spark, sf_dir))


def interval_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = catalog.interval_advice(_obs(spark, sf_dir))
    return a.select(F.unix_micros("suggest_from").alias("suggest_from"), F.unix_micros(F.col("suggest_to").cast("timestamp")).alias("suggest_to"))


def capture_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("job_index"), (F.col("event_id") * 7919 % 9973).alias("micros"))
    return windows.capture_timing(jobs)


def list_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.servers(_obs(spark, sf_dir))


def list_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dimensions(_obs(spark, sf_dir), "srv-view")


def list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunks(_obs(spark, sf_dir), "srv-view", "minecraft:overworld")


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_observations(_obs(spark, sf_dir), "srv-view", "minecraft:overworld", 0, 0).select("id", "observed_at", "contributor", "state_digest")


def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.chunk_manifest(_obs(spark, sf_dir))


def dimension_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.dimension_manifest(chunk_manifest(spark, sf_dir))


def server_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.server_manifest(dimension_manifest(spark, sf_dir))


def archive_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.archive_root(server_manifest(spark, sf_dir))


def _manifest_sql(obs: str = "obs", p: str = "") -> str:
    return f"""
{p}cm AS (SELECT server_id, dimension, x, z, count(*) AS observations, sha256(string_agg(id || chr(0), '' ORDER BY id)) AS digest FROM {obs} GROUP BY ALL),
{p}dm AS (SELECT server_id, dimension, count(*) AS chunks, CAST(sum(observations) AS BIGINT) AS observations, sha256(string_agg(x || ':' || z || ':' || digest || chr(0), '' ORDER BY x, z)) AS digest FROM {p}cm GROUP BY ALL),
{p}sm AS (SELECT server_id, count(*) AS dimensions, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(observations) AS BIGINT) AS observations,
  sha256(string_agg(dimension || chr(0) || digest || chr(0), '' ORDER BY dimension)) AS digest FROM {p}dm GROUP BY ALL)"""


def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    return comparison.archive_totals(obs, events.components(obs))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = _obs(spark, sf_dir)
    remote = obs.where("server_id <> 'srv-signup' OR dimension <> 'minecraft:the_nether'")
    return obs.where(f"{KEEP_LOCAL} OR server_id = 'srv-click'"), remote.where(f"({KEEP_REMOTE} OR server_id = 'srv-click') AND server_id <> 'srv-error'")


_TWO_SQL = f"""
la AS (SELECT * FROM obs WHERE {KEEP_LOCAL} OR server_id = 'srv-click'),
lb AS (SELECT * FROM obs WHERE ({KEEP_REMOTE} OR server_id = 'srv-click') AND server_id <> 'srv-error' AND (server_id <> 'srv-signup' OR dimension <> 'minecraft:the_nether'))"""


def compare_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_archives(*_two(spark, sf_dir))


_KIND = "CASE WHEN b.digest IS NULL THEN 'only-local' WHEN a.digest IS NULL THEN 'only-remote' ELSE 'differs' END AS kind"
_COMPARE_SQL = f"""
s AS (SELECT server_id, {_KIND} FROM asm a FULL JOIN bsm b USING (server_id) WHERE a.digest IS DISTINCT FROM b.digest),
d AS (SELECT server_id, dimension, {_KIND} FROM adm a FULL JOIN bdm b USING (server_id, dimension) WHERE a.digest IS DISTINCT FROM b.digest AND server_id IN (SELECT server_id FROM s WHERE kind = 'differs')),
c AS (SELECT server_id, dimension, x, z, {_KIND} FROM acm a FULL JOIN bcm b USING (server_id, dimension, x, z) WHERE a.digest IS DISTINCT FROM b.digest
  AND (server_id, dimension) IN (SELECT (server_id, dimension) FROM d WHERE kind = 'differs'))
SELECT 'server' AS level, server_id, CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS INT) AS x, CAST(NULL AS INT) AS z, kind FROM s WHERE kind <> 'differs'
UNION ALL SELECT 'dimension', server_id, dimension, NULL, NULL, kind FROM d WHERE kind <> 'differs' UNION ALL SELECT 'chunk', server_id, dimension, x, z, kind FROM c"""


def fingerprint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.fingerprint_states(_obs(spark, sf_dir))


def fingerprint_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    r = comparison.fingerprint_root(comparison.fingerprint_states(obs), comparison.fingerprint_components(events.components(obs)))
    return r.select("root", F.col("states").cast("bigint").alias("states"), F.col("components").cast("bigint").alias("components"))


def compare_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comparison.compare_fingerprints(*(comparison.fingerprint_states(o) for o in _two(spark, sf_dir)))
    return c.select(*selection.CELL, "kind", F.array_join(F.array_sort("only_local"), ",").alias("only_local"), F.array_join(F.array_sort("only_remote"), ",").alias("only_remote"))


_SETS_SQL = """
sa AS (SELECT server_id, dimension, x, z, list_sort(list(DISTINCT state_digest)) AS s FROM la GROUP BY ALL), sb AS (SELECT server_id, dimension, x, z, list_sort(list(DISTINCT state_digest)) AS s FROM lb GROUP BY ALL),
j AS (SELECT server_id, dimension, x, z, a.s IS NULL OR b.s IS NULL AS one, list_filter(coalesce(a.s, []), lambda v: NOT list_contains(coalesce(b.s, []), v)) AS ol, list_filter(coalesce(b.s, []), lambda v: NOT list_contains(coalesce(a.s, []), v)) AS r
  FROM sa a FULL JOIN sb b USING (server_id, dimension, x, z)),
k AS (SELECT *, CASE WHEN one THEN 'coverage' WHEN len(ol) = 0 AND len(r) = 0 THEN 'shared' WHEN len(ol) > 0 AND len(r) > 0 THEN 'content' ELSE 'states' END AS kind FROM j)"""


def fingerprint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.comparison_summary(comparison.compare_fingerprints(*(comparison.fingerprint_states(o) for o in _two(spark, sf_dir))))


def exchange_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.exchange_direction(comparison.compare_fingerprints(*(comparison.fingerprint_states(o) for o in _two(spark, sf_dir))))


def negotiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (comparison.fingerprint_components(events.components(o)) for o in _two(spark, sf_dir))
    return comparison.negotiate(a, b)[2]


def _epochs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [comparison.epoch_manifest(selection.select_at(selection.gather(o, None, "srv-view", "minecraft:overworld"), AT, DAY)) for o in _two(spark, sf_dir)]


def epoch_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.epoch_root(_epochs(spark, sf_dir)[0], "srv-view", "minecraft:overworld", AT)


def compare_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_epochs(*_epochs(spark, sf_dir))


_EPOCHS_SQL = (
    "ea AS (SELECT * FROM la WHERE server_id = 'srv-view' AND dimension = 'minecraft:overworld'), eb AS (SELECT * FROM lb WHERE server_id = 'srv-view' AND dimension = 'minecraft:overworld')",
    _selected_sql("a", "ea", AT, DAY),
    _selected_sql("b", "eb", AT, DAY),
)


def landmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.landmark_coverage(_obs(spark, sf_dir), events.landmarks(spark))


def policy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.policy_status(_obs(spark, sf_dir), events.policies(spark), AT)


def undeclared_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.undeclared_servers(_obs(spark, sf_dir), events.policies(spark))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return governance.exposure(_obs(spark, sf_dir).select(*selection.CELL).distinct())


def largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous areas of a scattered grid of orders that spans many regions."""
    _checkpoints(spark)
    return governance.clusters(_scattered(spark, sf_dir)).groupBy("server_id", "size").agg(F.count("*").alias("clusters"))


def _scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("srv-"), F.col("o_orderstatus")).alias("server_id"), F.lit("d").alias("dimension"), (F.col("o_orderkey") * 31 % 90 - 45).cast("int").alias("x"), (F.col("o_custkey") * 17 % 90 - 45).cast("int").alias("z"))


def _checkpoints(spark: SparkSession) -> None:
    """Iterations cut their lineage in the shared folder; an own one only where none is set and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_CLUSTER_SQL = """
pt AS (SELECT DISTINCT server_id, x, z FROM g),
reach(server_id, sx, sz, x, z) AS (SELECT server_id, x, z, x, z FROM pt UNION SELECT r.server_id, r.sx, r.sz, p.x, p.z FROM reach r JOIN pt p ON p.server_id = r.server_id AND abs(p.x - r.x) + abs(p.z - r.z) = 1),
cl AS (SELECT server_id, sx, sz, count(*) AS size, min((x + 1000) * 10000 + z + 1000) AS root FROM reach GROUP BY ALL)"""


def purge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    return governance.purge_plan(obs, events.components(obs), obs.where("contributor = 'c1'"))[2]


def purge_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _obs(spark, sf_dir)
    kept = governance.purge_plan(obs, events.components(obs), obs.where("contributor = 'c1'"))[1]
    return kept.withColumn("contributors", F.array_join("contributors", ","))


_PURGE_SQL = """
ref AS (SELECT DISTINCT id, digest, size FROM comp),
gone AS (SELECT digest, max(size) AS size FROM ref WHERE id IN (SELECT id FROM obs WHERE contributor = 'c1') GROUP BY digest),
lft AS (SELECT DISTINCT digest, contributor FROM ref JOIN obs USING (id) WHERE contributor <> 'c1')"""


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults are put into copies of the tables: lost and doubled index entries, a wrong cell, lost records and objects."""
    obs = _obs(spark, sf_dir)
    index = obs.where("event_id % 997 <> 3").select(F.when(F.col("event_id") % 991 == 5, F.lit("elsewhere")).otherwise(F.col("server_id")).alias("server_id"), "dimension", "x", "z", "id")
    index = index.unionByName(obs.where("event_id % 983 = 7").select(*selection.CELL, "id"))
    held = events.components(obs.where("event_id % 3 <> 0")).select("digest").distinct()
    return integrity.reference_problems(obs.where("event_id % 977 <> 11"), index, events.components(obs), held)


def nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import nearest_name as nearest

    return nearest(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")), "NATIN_17")


def declaration_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.identity import redaction_id

    return events.redactions(spark).select("id", redaction_id("server_id", "contributor", "dimension", "min_x", "min_z", "max_x", "max_z").alias("scope_id"))


_RED, _LM, _PO = _view(events.REDACTIONS_SQL, "red"), _view(events.LANDMARKS_SQL, "lm"), _view(events.POLICIES_SQL, "po")
_V, _C = events.VIEW_SQL, events.COMPONENTS_SQL
_SEL = _selected_sql("a", "obs", AT, DAY)

QUERIES = {
    f.__name__: f
    for f in (
        select_at, select_at_default_window, select_rejected, select_redacted, status_summary, withheld_first_redaction, diff_between, diff_summary, changed_cells, agreement_windows, hourly_moments,
        observed_span, interval_advice, capture_timing, list_servers, list_dimensions, list_chunks, chunk_lookup, chunk_manifest, dimension_manifest, server_manifest, archive_root, archive_totals,
        compare_archives, fingerprint_states, fingerprint_root, compare_fingerprints, fingerprint_summary, exchange_direction, negotiate, epoch_root, compare_epochs, landmark_coverage, policy_status,
        undeclared_servers, exposure, largest_clusters, purge_summary, purge_retained, integrity_check, nearest_name, declaration_ids,
    )
}

ORACLES = {
    "select_at": _with(_V, _SEL) + f"SELECT {_FLAT} FROM a",
    "select_at_default_window": _with(_V, _selected_sql("a", "obs", AT, 30)) + f"SELECT {_FLAT} FROM a",
    "select_rejected": _with(_V, _SEL)
    + """SELECT r.server_id, r.dimension, r.x, r.z, CAST(row_number() OVER (PARTITION BY r.server_id, r.dimension, r.x, r.z ORDER BY r.rk) - 1 AS INT) AS rank, r.state_digest,
       array_to_string(r.contributors, ',') AS contributors, r.n AS observations
       FROM a_r r JOIN a ON (a.server_id, a.dimension, a.x, a.z) = (r.server_id, r.dimension, r.x, r.z) WHERE r.state_digest <> a.state_digest""",
    "select_redacted": _with(_V, _RED, _KEPT_SQL, _selected_sql("a", "kept", AT, DAY)) + f"SELECT {_FLAT} FROM a",
    "status_summary": _with(_V, _SEL) + f"SELECT server_id, dimension, {_STATUS_COUNTS} FROM a GROUP BY ALL",
    "withheld_first_redaction": _with(_V, _RED) + f"SELECT o.id, min_by(r.id, (r.server_id, r.id)) AS redaction_id FROM obs o JOIN red r ON {_MATCH_SQL} GROUP BY o.id",
    "diff_between": _with(_V, _selected_sql("a", "obs", FROM, 30), _selected_sql("b", "obs", AT, 30), _DIFF_SQL)
    + "SELECT server_id, dimension, x, z, kind, before_status, before_state_digest, after_status, after_state_digest, n_revisits, array_to_string(list_reduce(list_prepend([], list_transform(who, lambda c: [c])), lambda acc, c: CASE WHEN list_contains(acc, c[1]) THEN acc ELSE list_concat(acc, c) END), ',') AS revisited_by FROM d",
    "diff_summary": _with(_V, _selected_sql("a", "obs", FROM, 30), _selected_sql("b", "obs", AT, 30), _DIFF_SQL)
    + "SELECT count(*) AS chunks, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.replace('-', '_')}" for k in selection.DIFF_KINDS)
    + ", count(*) FILTER (WHERE kind IN ('changed', 'unchanged')) AS covered, array_to_string(list_sort(list_distinct(flatten(list(who)))), ',') AS contributors FROM d",
    "changed_cells": _with(_V.replace("FROM events)", "FROM events WHERE event_type = 'view' AND event_id % 4 <> 0)"), _selected_sql("a", "obs", FROM, 30), _selected_sql("b", "obs", AT, 30), _DIFF_SQL)
    + f"SELECT d.server_id, d.dimension, d.x, d.z, max(o.observed_at) AS last_seen FROM d JOIN obs o ON (o.server_id, o.dimension, o.x, o.z) = (d.server_id, d.dimension, d.x, d.z) AND o.observed_at > TIMESTAMP '{FROM}' AND o.observed_at <= TIMESTAMP '{AT}' WHERE kind = 'changed' GROUP BY ALL ORDER BY last_seen DESC, d.x, d.z LIMIT 20",
    "agreement_windows": _with(_V) .rstrip() + "," + _WINDOWS_SQL,
    "hourly_moments": _with(_V) + "SELECT date_trunc('hour', observed_at) AS hour, count(*) AS observations, count(DISTINCT (server_id, dimension, x, z)) AS cells, max(observed_at) AS last_at FROM obs GROUP BY 1",
    "observed_span": _with(_V) + "SELECT min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS observations FROM obs",
    "interval_advice": _with(_V) + "SELECT epoch_us(min(observed_at)) + (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) // 2 AS suggest_from, epoch_us(max(observed_at)) AS suggest_to FROM obs",
    "capture_timing": "WITH j AS (SELECT event_id AS job_index, event_id * 7919 % 9973 AS micros FROM events) SELECT count(*) AS jobs, CAST(sum(micros) AS BIGINT) AS total_micros, max(micros) AS max_micros, arg_max(job_index, (micros, -job_index)) AS slowest_job, count(*) FILTER (WHERE micros > 5000) AS slow_jobs FROM j",
    "list_servers": _with(_V) + "SELECT DISTINCT server_id FROM obs",
    "list_dimensions": _with(_V) + "SELECT DISTINCT dimension FROM obs WHERE server_id = 'srv-view'",
    "list_chunks": _with(_V) + "SELECT DISTINCT x, z FROM obs WHERE server_id = 'srv-view' AND dimension = 'minecraft:overworld'",
    "chunk_lookup": _with(_V) + "SELECT id, observed_at, contributor, state_digest FROM obs WHERE server_id = 'srv-view' AND dimension = 'minecraft:overworld' AND x = 0 AND z = 0",
    "chunk_manifest": _with(_V, _manifest_sql()) + "SELECT * FROM cm",
    "dimension_manifest": _with(_V, _manifest_sql()) + "SELECT * FROM dm",
    "server_manifest": _with(_V, _manifest_sql()) + "SELECT * FROM sm",
    "archive_root": _with(_V, _manifest_sql()) + "SELECT count(*) AS servers, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(observations) AS BIGINT) AS observations, sha256(string_agg(server_id || chr(0) || digest || chr(0), '' ORDER BY server_id)) AS root FROM sm",
    "archive_totals": _with(_V, _C) + "SELECT (SELECT count(*) FROM obs) AS observations, (SELECT min(observed_at) FROM obs) AS earliest, (SELECT max(observed_at) FROM obs) AS latest, count(*) AS objects, CAST(sum(size) AS BIGINT) AS object_bytes FROM (SELECT digest, max(size) AS size FROM comp GROUP BY digest)",
    "compare_archives": _with(_V, _TWO_SQL, _manifest_sql("la", "a"), _manifest_sql("lb", "b")).rstrip() + "," + _COMPARE_SQL,
    "fingerprint_states": _with(_V) + "SELECT DISTINCT server_id, dimension, x, z, state_digest FROM obs",
    "fingerprint_root": _with(_V, _C)
    + """, s AS (SELECT DISTINCT server_id, dimension, x, z, state_digest FROM obs), c AS (SELECT name, digest, max(size) AS size FROM comp GROUP BY ALL)
       SELECT sha256((SELECT string_agg('state ' || server_id || ' ' || dimension || ' ' || x || ' ' || z || ' ' || state_digest || chr(0), '' ORDER BY server_id, dimension, x, z, state_digest) FROM s)
         || (SELECT string_agg('component ' || name || ' ' || digest || ' ' || size || chr(0), '' ORDER BY name, digest) FROM c)) AS root, (SELECT count(*) FROM s) AS states, (SELECT count(*) FROM c) AS components""",
    "compare_fingerprints": _with(_V, _TWO_SQL, _SETS_SQL) + "SELECT server_id, dimension, x, z, kind, array_to_string(ol, ',') AS only_local, array_to_string(r, ',') AS only_remote FROM k",
    "fingerprint_summary": _with(_V, _TWO_SQL, _SETS_SQL) + "SELECT count(*) FILTER (WHERE NOT one) AS shared, count(*) FILTER (WHERE kind = 'content') AS content, count(*) FILTER (WHERE kind = 'states') AS states, count(*) FILTER (WHERE kind = 'coverage') AS coverage, CASE WHEN count(*) FILTER (WHERE NOT one) = 0 THEN 'not comparable' WHEN count(*) FILTER (WHERE kind = 'content') > 0 THEN 'differs' ELSE 'agrees' END AS verdict FROM k",
    "exchange_direction": _with(_V, _TWO_SQL, _SETS_SQL)
    + """, n AS (SELECT count(*) FILTER (WHERE len(ol) > 0 AND len(r) = 0) AS local_ahead, count(*) FILTER (WHERE len(ol) = 0 AND len(r) > 0) AS remote_ahead, count(*) FILTER (WHERE len(ol) > 0 AND len(r) > 0) AS "both" FROM k)
       SELECT *, CASE WHEN local_ahead = 0 AND remote_ahead = 0 AND "both" = 0 THEN 'nothing to exchange' WHEN remote_ahead = 0 AND "both" = 0 THEN 'sending settles it' WHEN local_ahead = 0 AND "both" = 0 THEN 'receiving settles it' ELSE 'both directions are needed' END AS explanation FROM n""",
    "negotiate": _with(_V, _C, _TWO_SQL)
    + """, ca AS (SELECT name, digest, max(size) AS size FROM comp WHERE id IN (SELECT id FROM la) GROUP BY ALL), cb AS (SELECT name, digest, max(size) AS size FROM comp WHERE id IN (SELECT id FROM lb) GROUP BY ALL)
       SELECT (SELECT count(*) FROM cb WHERE digest NOT IN (SELECT digest FROM ca)) AS want, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM cb WHERE digest NOT IN (SELECT digest FROM ca)) AS want_bytes,
         (SELECT count(*) FROM ca WHERE digest NOT IN (SELECT digest FROM cb)) AS offer, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM ca WHERE digest NOT IN (SELECT digest FROM cb)) AS offer_bytes,
         (SELECT count(*) FROM ca WHERE digest IN (SELECT digest FROM cb)) AS shared""",
    "epoch_root": _with(_V, _TWO_SQL, *_EPOCHS_SQL)
    + "SELECT sha256('gridwitness.archive-epoch/v1' || chr(0) || 'srv-view' || chr(0) || 'minecraft:overworld' || chr(0) || '2024-01-15T00:00:00Z' || chr(0) || 'corroborated-first' || chr(0) || string_agg(x || chr(0) || z || chr(0) || coalesce(state_digest, '') || chr(0), '' ORDER BY x, z)) AS root, count(*) AS chunks FROM a",
    "compare_epochs": _with(_V, _TWO_SQL, *_EPOCHS_SQL)
    + """SELECT x, z, CASE WHEN b.status IS NULL THEN 'only-local' WHEN a.status IS NULL THEN 'only-remote' WHEN coalesce(a.state_digest, '') <> coalesce(b.state_digest, '') THEN 'mismatched' WHEN a.status <> b.status THEN 'confidence' ELSE 'equal' END AS kind,
       CASE WHEN a.status IS NOT NULL THEN coalesce(a.state_digest, '') END AS local_state, CASE WHEN b.status IS NOT NULL THEN coalesce(b.state_digest, '') END AS remote_state, a.status AS local_status, b.status AS remote_status FROM a FULL JOIN b USING (x, z)""",
    "landmark_coverage": _with(_V, _LM)
    + """, n AS (SELECT l.server_id, l.dimension, l.name, count(DISTINCT (o.x, o.z)) AS observed FROM lm l JOIN obs o ON o.server_id = l.server_id AND o.dimension = l.dimension AND o.x BETWEEN min_x AND max_x AND o.z BETWEEN min_z AND max_z GROUP BY ALL)
       SELECT l.server_id, l.dimension, l.name, coalesce(observed, 0) AS observed, CAST((max_x - min_x + 1) * (max_z - min_z + 1) AS BIGINT) AS total, coalesce(observed, 0) / ((max_x - min_x + 1) * (max_z - min_z + 1)) AS ratio FROM lm l LEFT JOIN n USING (server_id, dimension, name)""",
    "policy_status": _with(_V, _PO)
    + f"""SELECT o.server_id, o.observations, o.chunks, disposition, coalesce(disposition = 'public' OR (lower(trim(disposition)) = 'embargoed' AND TIMESTAMP '{AT}' > embargo_until), FALSE) AS allowed,
       CASE WHEN disposition IS NULL THEN 'no policy was declared' WHEN disposition IN ('public', 'private') THEN disposition WHEN disposition = 'research' THEN 'research only' WHEN TIMESTAMP '{AT}' > embargo_until THEN 'the embargo is over' ELSE 'under embargo' END AS reason
       FROM (SELECT server_id, count(*) AS observations, count(DISTINCT (dimension, x, z)) AS chunks FROM obs GROUP BY 1) o LEFT JOIN po ON po.server = o.server_id""",
    "undeclared_servers": _with(_V, _PO) + "SELECT DISTINCT server_id FROM obs WHERE server_id NOT IN (SELECT server FROM po)",
    "exposure": _with(_V, "g AS (SELECT DISTINCT server_id, dimension, x, z FROM obs)", _CLUSTER_SQL)
    + """, rg AS (SELECT server_id, x >> 5 AS rx, z >> 5 AS rz, count(*) AS n, min(x) AS ax, max(x) AS bx, min(z) AS az, max(z) AS bz FROM g GROUP BY ALL),
       s AS (SELECT server_id, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS regions, max(n) / 1024.0::DOUBLE AS densest_region_fill, min(ax) AS min_x, max(bx) AS max_x, min(az) AS min_z, max(bz) AS max_z FROM rg GROUP BY 1),
       m AS (SELECT server_id, max(size) AS largest_cluster FROM cl GROUP BY 1)
       SELECT s.*, largest_cluster, CASE WHEN largest_cluster >= 1024 OR (regions >= 4 AND densest_region_fill >= 0.25) THEN 'substantial' WHEN largest_cluster >= 64 THEN 'moderate' ELSE 'minimal' END AS exposure FROM s JOIN m USING (server_id)""",
    "largest_clusters": """WITH RECURSIVE pt AS (SELECT DISTINCT 'srv-' || o_orderstatus AS server_id, CAST(o_orderkey * 31 % 90 - 45 AS INT) AS x, CAST(o_custkey * 17 % 90 - 45 AS INT) AS z FROM orders),
       cc(server_id, x, z, root) USING KEY (server_id, x, z) AS (SELECT server_id, x, z, (x + 1000) * 10000 + z + 1000 FROM pt
         UNION SELECT c.server_id, c.x, c.z, min(n.root) FROM recurring.cc c JOIN cc n ON n.server_id = c.server_id AND abs(n.x - c.x) + abs(n.z - c.z) = 1 WHERE n.root < c.root GROUP BY c.server_id, c.x, c.z)
       SELECT server_id, CAST(size AS BIGINT) AS size, count(*) AS clusters FROM (SELECT server_id, root, count(*) AS size FROM cc GROUP BY ALL) GROUP BY ALL""",
    "purge_summary": _with(_V, _C, _PURGE_SQL)
    + "SELECT (SELECT count(*) FROM obs WHERE contributor = 'c1') AS removed_observations, (SELECT count(*) FROM gone WHERE digest NOT IN (SELECT digest FROM lft)) AS removed_objects, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM gone WHERE digest NOT IN (SELECT digest FROM lft)) AS removed_bytes, (SELECT count(*) FROM gone WHERE digest IN (SELECT digest FROM lft)) AS retained_objects",
    "purge_retained": _with(_V, _C, _PURGE_SQL) + "SELECT digest, max(g.size) AS size, string_agg(DISTINCT contributor, ',' ORDER BY contributor) AS contributors FROM gone g JOIN lft USING (digest) GROUP BY digest",
    "integrity_check": _with(_V, _C)
    + """, i0 AS (SELECT CASE WHEN event_id % 991 = 5 THEN 'elsewhere' ELSE server_id END || ' ' || dimension || ' ' || x || ' ' || z AS a, id FROM obs WHERE event_id % 997 <> 3 UNION ALL SELECT server_id || ' ' || dimension || ' ' || x || ' ' || z, id FROM obs WHERE event_id % 983 = 7),
       rec AS (SELECT id, server_id || ' ' || dimension || ' ' || x || ' ' || z AS own FROM obs WHERE event_id % 977 <> 11),
       held AS (SELECT DISTINCT digest FROM comp WHERE id IN (SELECT id FROM obs WHERE event_id % 3 <> 0))
       SELECT CASE WHEN count(DISTINCT a) > 1 THEN 'indexed in two cells' ELSE 'indexed twice' END AS kind, id AS subject, count(*) || ' entries' AS detail FROM i0 GROUP BY id HAVING count(*) > 1
       UNION ALL SELECT 'index without record', id, a FROM i0 WHERE id NOT IN (SELECT id FROM rec)
       UNION ALL SELECT 'record without index', id, own FROM rec WHERE id NOT IN (SELECT id FROM i0)
       UNION ALL SELECT 'indexed in another cell', id, a FROM i0 JOIN rec USING (id) WHERE a <> own
       UNION ALL SELECT 'missing object', digest, 'referred to' FROM (SELECT DISTINCT digest FROM comp) WHERE digest NOT IN (SELECT digest FROM held)""",
    "nearest_name": "SELECT n_name AS name, levenshtein(n_name, 'NATIN_17') AS distance FROM nation WHERE levenshtein(n_name, 'NATIN_17') <= 3 ORDER BY 2, 1 LIMIT 1",
    "declaration_ids": _with(_RED) + "SELECT id, sha256(lower(trim(server_id)) || chr(0) || coalesce(lower(contributor), '') || chr(0) || coalesce(dimension, '') || chr(0) || CASE WHEN min_x IS NULL THEN '' ELSE min_x || ':' || min_z || ':' || max_x || ':' || max_z END) AS scope_id FROM red",
}
