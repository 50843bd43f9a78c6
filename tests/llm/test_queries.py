"""The registered corpus queries against their SQL, and the pipeline against brute force, at the smallest scale."""

import hashlib
import pathlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwitness.cluster import shared_dir
from gridwitness.llm import registry
from gridwitness.llm.common import table

from ..conftest import SF
from ..test_queries import duck, rows
from .conftest import prose
from .test_text_operators import brute_groups, brute_language, brute_lines


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck(registry.ORACLES[name]))


def test_language_query(spark):
    got = registry.QUERIES["op1_langid"](spark, SF).join(table(spark, SF, "documents"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_url_and_language_model_queries(spark):
    pages = registry.QUERIES["op8_urlfilter"](spark, SF)
    assert pages.count() == table(spark, SF, "pages").count() and pages.where("verdict NOT IN ('allow', 'block')").count() == 0
    held = registry.QUERIES["op10_maxent"](spark, SF.replace("0.001", "0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > 0.95 * held.b  # logarithms: a gain of 5 % at least


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, SF).cache()
    assert one.columns == docs.columns and docs.count() - one.count() <= 0.05 * docs.count()
    two = stages["line_dedup"](spark, one, SF).cache()
    held = {}
    for r in one.collect():
        for line in set(r.text.split("\n")):
            held.setdefault(line.strip(" \t\n\x0b\x0c\r").lower() if line.isascii() else line.strip(" \t\n\x0b\x0c\r"), set()).add(r.doc_id)
    left = {}
    for r in two.collect():
        for line in set(r.text.split("\n")):
            left.setdefault(line.strip(" \t\n\x0b\x0c\r").lower() if line.isascii() else line.strip(" \t\n\x0b\x0c\r"), set()).add(r.doc_id)
    assert all(len(left.get(k, ())) <= 1 for k, v in held.items() if len(k) >= 20 and len(v) >= 3 and k.isascii())
    three = stages["near_duplicates"](spark, two, SF).cache()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in three.collect() if (w := r.text.lower().split())}
    keys = sorted(sets)
    assert not [(a, b) for a in keys for b in keys if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    four = stages["benchmark_decontamination"](spark, three, SF).cache()
    items = [" ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    assert not [r.doc_id for r in four.collect() if any(i in " ".join(r.text.split()) for i in items)]
    five = stages["best_fit_packing"](spark, four, SF)
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.collect()}
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select("doc_id", "piece", "ids_crc32").exceptAll(five.select("doc_id", "piece", "ids_crc32")).count() == 0


def test_stages_take_empty_and_awkward_tables(spark, docs, no_docs, awkward):
    """Each stage on nulls, repeated rows, shared and missing ids and a clashing column, against what its operator's brute force says."""
    own = docs.withColumns({"n_chars": F.char_length("text").cast("bigint"), "hash": F.lit("mine"), "length": F.lit(7)})
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, own.limit(0), SF).count() == 0
        if name != "best_fit_packing":
            assert stage(spark, own, SF).columns == own.columns
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    whole = Counter((r[0], r[1]) for r in awkward)
    labelled = [(r[1], r[2]) for r in awkward]
    languages = brute_language([t for _, t in whole.elements()], labelled)
    kept = texts(stages["language_id"](spark, own, SF))
    undetermined = Counter(x for x, lang in zip(whole.elements(), languages, strict=True) if lang == "und")
    assert kept == whole - undetermined  # nothing in the fixture is far from all profiles
    lines = stages["line_dedup"](spark, own, SF)
    dropped = {(i, sha): n for i, _, n, sha in brute_lines(awkward)}
    got = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines.collect())
    left = Counter((i, sha) for i, _, n, sha in brute_lines(awkward).elements() if not (n and sha in {hashlib.sha256(e.encode()).hexdigest() for e in ("", " ", "\n", "\n\n")}))
    assert got == left and set(got) <= set(dropped)
    near = texts(stages["near_duplicates"](spark, own, SF))
    numbered = [(k, r[1]) for k, r in enumerate(awkward)]
    groups = {}
    for k, n, component in brute_groups(numbered, 5, 80):
        groups.setdefault(component if n else ("none", k), []).append(awkward[k])
    first = lambda rows: min(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ids = Counter(first(rows)[0] for rows in groups.values())
    assert Counter(i for i, _ in near.elements()) == ids
    packed = stages["best_fit_packing"](spark, own, SF).groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == Counter(r[0] for r in awkward)


def test_stages_judge_rows_not_ids(spark, tmp_path):
    """Copies under one id leave one row; a clean row that shares its id with a bad one, or has none, stays, and a bad one without an id goes."""
    rng = random.Random(4)
    item = table(spark, SF, "benchmark").first().text
    a, b, c = (prose(rng, "en", 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, f"{a} more"), (3, f"{c} {item} {c}"), (3, c), (None, f"{b} {item} {b}"), (None, prose(rng, "fr", 50)), (None, b), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
    for own in (docs.repartition(3).cache(), spark.read.parquet(f"file://{tmp_path}/docs")):
        near = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, own, SF).collect())
        assert near == Counter(rows) - Counter([(1, a), (2, f"{a} more"), (None, b)])
        clean = Counter((r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, own, SF).collect())
        assert clean == Counter(rows) - Counter([rows[4], rows[6]])


def test_run_leaves_only_its_result(spark):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    assert [n.rsplit("-", 1)[0] for n in {p.name for p in folder.iterdir()} - before] == ["stage-best_fit_packing"]
    assert out.count() > 0
