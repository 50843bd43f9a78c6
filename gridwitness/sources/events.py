"""The event stream read as a ledger of observations, and small declaration tables for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import CELL

#: Twelve by twelve cells in two dimensions a server, five contributors, two states.
_VIEW = """
SELECT event_id,
       concat('srv-', event_type) AS server_id,
       CASE WHEN event_id % 4 = 0 THEN 'minecraft:the_nether' ELSE 'minecraft:overworld' END AS dimension,
       CAST(user_id % 12 AS INT) - 6 AS x,
       CAST((user_id DIV 12) % 12 AS INT) - 6 AS z,
       concat('c', CAST(event_id % 5 AS STRING)) AS contributor,
       ts AS observed_at,
       CAST((unix_micros(CAST(ts AS TIMESTAMP)) % 1000000) * 1000 AS INT) AS observed_nanos,
       sha2(concat('state-', CAST(CAST(get_json_object(props, '$.k') AS INT) % 2 AS STRING)), 256) AS state_digest,
       sha2(concat('obs-', CAST(event_id AS STRING)), 256) AS id
FROM {events}
"""

#: The same in DuckDB.
VIEW_SQL = """
obs AS (
SELECT event_id, 'srv-' || event_type AS server_id,
       CASE WHEN event_id % 4 = 0 THEN 'minecraft:the_nether' ELSE 'minecraft:overworld' END AS dimension,
       CAST(user_id % 12 AS INT) - 6 AS x, CAST((user_id // 12) % 12 AS INT) - 6 AS z,
       'c' || CAST(event_id % 5 AS VARCHAR) AS contributor, ts AS observed_at,
       sha256('state-' || CAST(CAST(json_extract(props, '$.k') AS INT) % 2 AS VARCHAR)) AS state_digest,
       sha256('obs-' || CAST(event_id AS VARCHAR)) AS id
FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def components(obs: DataFrame) -> DataFrame:
    """(id, name, digest, size): a terrain and a biome object for each observation; biomes are shared by many."""
    item = lambda name, key, size: F.struct(F.lit(name).alias("name"), F.sha2(F.concat_ws("-", F.lit(name), key).cast("binary"), 256).alias("digest"), size.cast("bigint").alias("size"))
    terrain = item("terrain", F.concat_ws(":", "server_id", "x", "z", "state_digest"), F.lit(8000) + (F.abs("x") * 100 + F.abs("z")))
    biomes = item("biomes", F.concat_ws(":", "server_id", (F.col("event_id") % 50).cast("string")), F.lit(260) + F.col("event_id") % 50)
    return obs.select("id", F.explode(F.array(terrain, biomes)).alias("c")).select("id", "c.*")


#: The components in DuckDB, after VIEW_SQL.
COMPONENTS_SQL = """
comp AS (
SELECT id, 'terrain' AS name, sha256('terrain-' || server_id || ':' || x || ':' || z || ':' || state_digest) AS digest, CAST(8000 + abs(x) * 100 + abs(z) AS BIGINT) AS size FROM obs
UNION ALL SELECT id, 'biomes', sha256('biomes-' || server_id || ':' || event_id % 50), CAST(260 + event_id % 50 AS BIGINT) FROM obs)"""


def _rows(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


#: Scopes from one cell to a whole server; text that both engines read.
REDACTIONS_SQL = """
SELECT * FROM (VALUES
  ('r1', 'srv-view', 'C1', CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT)),
  ('r2', 'srv-click', NULL, 'minecraft:the_nether', NULL, NULL, NULL, NULL),
  ('r3', 'SRV-Error ', NULL, NULL, -3, -3, 2, 2),
  ('r4', 'srv-purchase', 'c2', 'minecraft:overworld', -6, -6, 0, 5),
  ('r5', 'srv-view', NULL, NULL, 4, 4, 5, 5)
) AS r(id, server_id, contributor, dimension, min_x, min_z, max_x, max_z)"""

LANDMARKS_SQL = """
SELECT * FROM (VALUES
  ('srv-view', 'minecraft:overworld', 'spawn', -2, -2, 2, 2),
  ('srv-view', 'minecraft:the_nether', 'hub', 0, 0, 10, 10),
  ('srv-click', 'minecraft:overworld', 'market', -6, -6, 5, 5),
  ('srv-error', 'minecraft:overworld', 'far away', 100, 100, 131, 140),
  ('srv-nowhere', 'minecraft:overworld', 'unseen', 0, 0, 1, 1)
) AS l(server_id, dimension, name, min_x, min_z, max_x, max_z)"""

POLICIES_SQL = """
SELECT * FROM (VALUES
  ('srv-view', 'public', CAST(NULL AS TIMESTAMP)),
  ('srv-click', 'embargoed', TIMESTAMP '2024-02-01 00:00:00'),
  ('srv-error', 'Embargoed ', TIMESTAMP '2024-01-02 00:00:00'),
  ('srv-purchase', 'research', NULL),
  ('srv-nowhere', 'public', NULL)
) AS p(server, disposition, embargo_until)"""


def redactions(spark: SparkSession) -> DataFrame:
    return _rows(spark, REDACTIONS_SQL)


def landmarks(spark: SparkSession) -> DataFrame:
    return _rows(spark, LANDMARKS_SQL)


def policies(spark: SparkSession) -> DataFrame:
    return _rows(spark, POLICIES_SQL.replace("TIMESTAMP)", "TIMESTAMP_NTZ)").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def cells(obs: DataFrame) -> DataFrame:
    return obs.select(*CELL).distinct()
