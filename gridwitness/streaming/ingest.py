"""Bundles from a spool into a ledger, in micro-batches that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import bundle_rows
from ..sources.store import Ledger

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_spool(spark: SparkSession, spool: str, ledger_root: str, checkpoint: str, quarantine: str, max_files: int = 1_000) -> StreamingQuery:
    """Takes all ready bundles and ends. A batch may run twice: what the ledger holds is not added again. Invalid ones go to the quarantine with their reasons.

    There is no watermark: an observation is accepted however late, and readings as of a past instant then change. The writer publishes a bundle by renaming its
    folder, so what matches ready-* is whole; files a trigger are bounded, which is what holds the stream back.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files).load(f"{spool}/ready-*/bundle.json")

    def take(batch: DataFrame, batch_id: int) -> None:
        own = batch.select("path", "content").persist()
        try:
            folders = [r.b for r in own.select(F.regexp_replace("path", "/bundle\\.json$", "").alias("b")).distinct().collect()]  # at most max_files
            if not folders:
                return
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).where(~F.col("path").endswith("/bundle.json"))
            rows = bundle_rows(own, files)
            good = rows.where(F.size("problems") == 0)
            rows.where(F.size("problems") > 0).select("bundle", "problems").write.mode("overwrite").json(f"{quarantine}/{batch_id}")
            needed = good.select(F.explode("components").alias("n", "c")).select("c.digest").distinct()
            objects = files.select(F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), F.col("content").alias("bytes")).join(needed, "digest", "left_semi")
            Ledger.open(spark, ledger_root).append(good, objects)
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spool_allows(free_bytes: int, spool_bytes: int, most: int = 4 << 30, least_free: int = 2 << 30) -> bool:
    """Whether more may be written to a spool; it is never emptied to make room."""
    return spool_bytes < most and free_bytes >= least_free
