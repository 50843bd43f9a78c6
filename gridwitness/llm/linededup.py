"""Line dedup: explode normalised lines, hash them, count distinct documents a hash, drop lines over the threshold, reassemble by position.

Defined cases. A null or empty text is one empty line and comes back as an empty text. A line's key is the
line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased; keys under min_chars code points never
lose a line. A document that repeats a key counts once for it, and keeps all its lines of that key if it is
the largest doc_id holding it. Rows that share a doc_id are one document. A null doc_id counts as no
document and is never the keeper. Very long texts are read whole; an empty table gives no rows. Extra columns, whatever their names, are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, with_columns


def _keyed_lines(min_chars: int):
    """(doc_id, text_hash, pos, hash) of each line whose key has min_chars code points."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            owner, places, hashes = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate((text or "").split("\n")):
                    key = line.strip(SPACES)
                    if len(key) >= min_chars:
                        owner.append(i)
                        places.append(pos)
                        hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))  # bytes: A-Z alone
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "text_hash", "pos", "hash"])

    return run


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, drop): for each document that loses lines the sorted positions of those, from 0."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    lines = source.mapInArrow(_keyed_lines(min_chars), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash bigint, pos int, hash binary")
    # The distinct count first groups by (hash, document), so a line found everywhere is never one task's work.
    # Written, so that the join below has plain exchanges on both sides and AQE may split a hot hash.
    common = stored(
        lines.groupBy("hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs),
        "common-lines",
    )
    return (
        lines.join(common, "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    )


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with all their columns, and of each row __ld_kept (text), __ld_n_lines, __ld_n_dropped and __ld_sha256."""
    drop = dropped_lines(docs, text, doc_id, min_chars, min_docs).select(F.col("doc_id").alias("__ld_id"), F.col("text_hash").alias("__ld_hash"), F.col("drop").alias("__ld_drop"))
    of_row = F.col(doc_id).eqNullSafe(F.col("__ld_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__ld_hash"))
    joined = docs.join(drop, of_row, "left").drop("__ld_id", "__ld_hash")
    at = docs.columns.index(text)

    def reassembled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kept, n_lines, n_dropped = [], [], []
            for whole, positions in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                whole = whole or ""
                n_lines.append(whole.count("\n") + 1)
                n_dropped.append(len(positions or ()))
                if positions:
                    gone = set(positions)
                    whole = "\n".join(line for i, line in enumerate(whole.split("\n")) if i not in gone)
                kept.append(whole)
            added = {
                "__ld_kept": pa.array(kept, pa.string()),
                "__ld_n_lines": pa.array(n_lines, pa.int64()),
                "__ld_n_dropped": pa.array(n_dropped, pa.int64()),
                "__ld_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept], pa.string()),
            }
            fields = [*list(batch.schema)[:-1], *(pa.field(n, a.type) for n, a in added.items())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added.values()], schema=pa.schema(fields))

    return joined.mapInArrow(reassembled, with_columns(docs, "__ld_kept string, __ld_n_lines bigint, __ld_n_dropped bigint, __ld_sha256 string"))
