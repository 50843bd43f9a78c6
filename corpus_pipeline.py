"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last
return the columns of documents, and whatever other columns docs has. Stages tell rows apart by their place in the table, so rows
that share a doc_id, or have none, are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwitness.cluster import ship
from gridwitness.llm import decontam, langid, linededup, ngramjoin, packing
from gridwitness.llm.common import remove, scratch, shared_path, stored, table

#: A document goes if it is undetermined or shares next to nothing with every language's profile.
MIN_SCORE = 0.05


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with __row, the same whenever it is read: a table in files is read alike each time, others are written first."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    return rows if docs.inputFiles() else stored(rows, "rows")


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    return rows.join(gone.select(F.col("__row").alias("__gone")).distinct(), F.col("__row") == F.col("__gone"), "left_anti").select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that resemble one of the labelled languages; the profiles come from all labelled documents.

    Null and empty texts, and those without a letter, are undetermined and go. Ties go to the first language by name. Repeated rows, and rows of
    one or no doc_id, are judged each. Long texts are read whole; an empty table stays empty.
    """
    ship(spark)
    learned = langid.profiles(docs.select("text", "lang"))
    found = langid.identify(docs, learned)
    return found.where((F.col("__li_lang") != "und") & (F.col("__li_score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them. A document that thereby loses all it had goes; n_chars follows the text.

    A null text is one empty line and comes back empty. Rows that share a doc_id are one document to the count of lines; a null doc_id counts
    as none and keeps no line that others hold. The largest doc_id keeps a line, so there are no ties. Long texts are split whole; an empty table stays empty.
    """
    ship(spark)
    found = linededup.dedup_lines(docs)
    text = F.col("__ld_kept")
    changed = {"text": text, "n_chars": F.when(F.col("__ld_n_dropped") > 0, F.char_length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    emptied = (F.col("__ld_n_dropped") > 0) & (F.btrim("__ld_kept", F.lit(" \t\n\x0b\x0c\r")) == "")
    return found.where(~emptied).select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at similarity 0.8 the row of smallest doc_id stays, of equal ones the first; null ids come last.

    Null texts and texts without words are linked with nothing and stay. Of a repeated row one stays; a row that merely shares
    its doc_id with a linked one is none of its group. Long texts are read whole; an empty table stays empty.
    """
    ship(spark)
    rows = _by_row(docs)
    groups = ngramjoin.similar_groups(rows, doc_id="__row", width=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id")
    # Rows without a partner are groups of their own: only of the others is the one that stays sought.
    linked = stored(groups.join(groups.where("__row <> component_id").select("component_id").distinct(), "component_id", "left_semi"), "linked")
    ids = rows.select("__row", F.col("doc_id").alias("__id")).join(linked, "__row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("m"))
    gone = linked.join(first, "component_id").where(F.col("__row") != F.col("m.row"))
    return _without(rows, gone, docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go.

    Null and empty texts hold none. Repeated rows are judged each, and so are rows of one or no doc_id. Long texts are
    read whole; without documents or items nothing changes.
    """
    ship(spark)
    rows = _by_row(docs)
    found = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), doc_id="__row")
    return _without(rows, found.select(F.col("doc_id").alias("__row")), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, placed in sequences of 4096 tokens.

    A null text is its end token alone. Repeated rows and null ids are packed each; equal lengths go by (doc_id, piece, row). Long texts are cut into pieces of
    4096 tokens; an empty table gives no rows.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again. What a stage put there besides, and its own rows once the next has read them, are removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: SQL can't express the language profiles' ranks, slot alignment and packing; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
