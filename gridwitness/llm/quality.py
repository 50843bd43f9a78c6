"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a histogram of whole numbers with 64 buckets for each power of two (error under 1/64), kept as rows
(language, source, measure, bucket, n): rows of two sketches are merged by adding n, so sketches of languages and of
all documents are sums of those of the groups, and the order of merging doesn't matter. A limit lies twice as far from the
median as the 5th or 95th percentile, and a fixed slack beyond: few clean documents lie there, however
uneven a group is. Groups with few documents take the limits of their language, or of all.

Defined cases. A null text has no words and fails the base rules. Documents that fail these are not
sketched. Null languages and sources are groups like others. Repeated rows count each time. An empty table gives no
rows. Very long texts are read whole. Documents with equal measures are judged alike; a value on a limit is within it. Only the columns named are
read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
#: Measure, its expression as a whole number, whether its low and high side have a limit, slack.
MEASURES = [
    ("word_length", "word_chars * 1000 div n_words", True, True, 1_000),
    ("symbols", "n_symbols * 100000 div n_words", False, True, 5_000),
    # of repeated lines and words those beyond what one repeated line makes
    ("dup_lines", "greatest(n_dup_lines - 1, 0) * 100000 div n_lines", False, True, 10_000),
    ("repeats", "greatest(n_repeat_words - 40, 0) * 100000 div n_words", False, True, 5_000),
]
#: Documents under which a group takes the limits of its language, or of all.
LEAST = 100
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, base_failed boolean"


def base_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n > 5:
        _, place, many = np.unique(window_hashes(word_hashes(found), 5), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(many[place] > 1)
        if len(starts):
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(change[:-1])))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, the base measures, base_failed) of each document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [base_measures(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(6)]
            failed = pa.array([n < 10 or 100 * r > 20 * n for n, _, _, _, r, _ in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, failed], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"])

    return own.mapInArrow(run, f"{kinds}, {BASE}")


def bucket_sql(v: str) -> str:
    """The bucket of a whole number from 0: itself under 128, else 64 to each power of two."""
    return f"CASE WHEN {v} < 128 THEN {v} ELSE 64 * (length(bin({v})) - 7) + shiftright({v}, length(bin({v})) - 7) END"


def low_edge_sql(b: str) -> str:
    """The least number in a bucket."""
    return f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft({b} - 64 * (({b} - 64) div 64), cast(({b} - 64) div 64 AS int)) END"


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): level 0 by language and source, 1 by language, 2 of all."""
    rows = stats.where("NOT base_failed").select("lang", "source", F.expr("inline(array(" + ", ".join(f"struct('{name}' AS measure, {e} AS v)" for name, e, *_ in MEASURES) + "))"))
    own = rows.select("lang", "source", "measure", F.expr(bucket_sql("v")).cast("bigint").alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    by_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(1)).withColumn("source", F.lit(None).cast("string"))
    of_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(2)).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    return own.unionByName(by_lang).unionByName(of_all)


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for each group of level 0. A measure's sketch has some thousand rows at most."""
    quantile = sketch.sparkSession.sql(f"""
        SELECT level, lang, source, measure, max(total) AS total,
               min(CASE WHEN 20 * upto >= total THEN edge END) AS q05,
               min(CASE WHEN 2 * upto >= total THEN edge END) AS q50,
               min(CASE WHEN 20 * upto >= 19 * total THEN edge END) AS q95
        FROM (SELECT level, lang, source, measure, {low_edge_sql('bucket')} AS edge,
                     sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
                     sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
              FROM {{sketch}})
        GROUP BY level, lang, source, measure""", sketch=sketch)
    slack = F.create_map(*(F.lit(x) for name, _, _, _, s in MEASURES for x in (name, s)))[F.col("measure")]
    sides = quantile.withColumn("low", F.col("q50") - 2 * (F.col("q50") - F.col("q05")) - slack).withColumn("high", F.col("q50") + 2 * (F.col("q95") - F.col("q50")) + slack)
    wide = sides.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}") for name, _, low, high, _ in MEASURES for side, on in (("low", low), ("high", high)) if on))
    names = [c for c in wide.columns if c not in ("level", "lang", "source", "total")]
    own = wide.where("level = 0").drop("level")
    level = lambda k: wide.where(F.col("level") == k).select(F.col("lang").alias(f"lang{k}"), F.col("total").alias(f"total{k}"), *(F.col(c).alias(f"{c}{k}") for c in names))
    joined = own.join(level(1), F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(level(2)), F.lit(True), "left")  # level 2 is one row
    pick = lambda c: F.when(F.col("total") >= LEAST, F.col(c)).when(F.col("total1") >= LEAST, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return joined.select("lang", "source", *(pick(c).alias(c) for c in names))


def judged(stats: DataFrame) -> DataFrame:
    """stats, as measured() gives them, with kept and the limits of each document's group."""
    stats = stored(stats, "measures")
    found = limits(sketches(stats)).withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    joined = stats.join(found, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    within = [F.expr(f"({e}) {op} {name}_{side}") for name, e, low, high, _ in MEASURES for side, on, op in (("low", low, ">="), ("high", high, "<=")) if on]
    kept = F.lit(True)
    for condition in within:
        kept = kept & condition
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(kept, F.lit(False))))
