"""What the corpus operators share: table access, tables in the shared folder, word rules and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_path as new_path

#: The characters that separate words in every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Entries that a Python worker keeps of a per-word result before it starts afresh.
WORD_CACHE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The paths given out within each scratch() that is open.
_scratches: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    path = new_path(spark, label)
    if _scratches:
        _scratches[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end all tables that were put into the shared folder within; what is made of them has to be written by then."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            remove(spark, path)


#: With this Spark removes the shuffle files of a job when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder (to path, if given) and read again: its lineage ends there, whichever executor is lost, and its shuffle files go."""
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table that stored() wrote and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def ascii_lower(column: Column) -> Column:
    """A-Z alone lower-cased."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def words(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8. bytes.split() and bytes.lower() have just these rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_in_use: dict | None = None


def use(cache: dict) -> dict:
    """The cache, after emptying the one used before: a Python worker that runs one operator after the other holds one cache."""
    global _in_use
    if _in_use is not cache:
        if _in_use is not None:
            _in_use.clear()
        _in_use = cache
    return cache


class WordHashes(dict):
    """A 64-bit hash for each word, kept for at most WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(use(_HASHES).__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that sums and ranges of the results are spread evenly."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words; one of the whole sequence if it is shorter, none if empty."""
    if len(h) == 0:
        return h
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(total + np.uint64(min(width, len(h))))


def bloom_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a Bloom filter that stand for each hash."""
    down = np.uint64(64 - bits)
    return h >> down, (h * np.uint64(0x9E3779B97F4A7C15)) >> down


def bloom(hashes: DataFrame, least_bits: int = 10, most_bits: int = 28) -> np.ndarray:
    """The 64-bit words of a Bloom filter of the column hash: of a size by the number of rows, and 32 MB at most, however many."""
    n = hashes.count()
    bits = min(most_bits, max(least_bits, (16 * max(1, n) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(bloom_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = np.zeros(1 << max(0, bits - 6), np.uint64)
    held = hashes.select("hash").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def maybe_in(h: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Of each hash whether the filter may hold it."""
    found = np.ones(len(h), bool)
    if known is None:
        return found
    for at in bloom_places(h, (len(known) * 64 - 1).bit_length()):
        found &= (known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def with_columns(df: DataFrame, more: str) -> str:
    """The schema of df with more columns after its own, as mapInArrow takes it."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def batches(rows: Iterator, *names: str) -> Iterator[tuple]:
    """Of each Arrow batch that has rows, the named columns as lists."""
    for batch in rows:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
