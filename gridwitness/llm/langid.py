"""Language ID by rank-order profiles (Cavnar and Trenkle 1994).

A document's most frequent character n-grams, in order of frequency, are compared to each language's
profile by out-of-place distance: the sum of rank differences, the largest one for n-grams that the profile lacks.

Defined cases. A null text, or one without a letter, is `und` with score 0. Whole texts are read. Equal
counts rank by the n-gram's code, equal distances by the language's name. With no labelled row every
document is `und`. Repeated rows count each time. Rows with a null doc_id are predicted and never learned from. An empty table gives no
rows. Other columns are kept, whatever their names; those added begin with __li_.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_columns

#: N-grams in a profile and of a document that are ranked.
PROFILE = 400
#: Languages whose ranks are looked up together.
_TOGETHER = 64
#: Stands for a missing character in the code of a shorter n-gram; no character has this code point.
_NONE = 0x1FFFFF
#: Codes that are counted together while learning.
_CHUNK = 2_000_000


@lru_cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, 0 for what is no letter."""
    found = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            low = c.lower()
            found[point] = ord(low) if len(low) == 1 else point
    return found


def grams(text: str | None) -> np.ndarray:
    """Codes of the text's 1-, 2- and 3-grams of letters, runs of others being one boundary (0)."""
    if not text:
        return np.empty(0, np.int64)
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.empty(0, np.int64)
    one = c[c != 0]
    pair = (c[:-1] << 42) | (c[1:] << 21)
    return np.concatenate(((one << 42) | (_NONE << 21) | _NONE, pair | _NONE, pair[:-1] | c[2:]))


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, in order."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:size]]


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def out(lang: str) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in rows:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(codes := grams(text)):
                held[lang].append(codes)
                sizes[lang] += len(codes)
                if sizes[lang] >= _CHUNK:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Of every language its most frequent n-grams over all labelled rows. The result has size rows a language at most."""
    counts = (
        labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .mapInArrow(_counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # Spark limits each task to its own first rows of a language before it deals them out.
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    found: dict[str, list] = defaultdict(list)
    for row in top.select("lang", "rank", "gram").toLocalIterator():
        found[row.lang].append((row.rank, row.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(found.items())}


class _Block:
    """The ranks of some languages' n-grams: a row an n-gram that one of them has, and one for all others."""

    def __init__(self, names: list[str], learned: dict[str, np.ndarray]) -> None:
        self.names = names
        self.known = np.unique(np.concatenate([learned[n] for n in names]))
        self.places = np.full((len(self.known) + 1, len(names)), -1, np.int16)
        for k, name in enumerate(names):
            self.places[np.searchsorted(self.known, learned[name]), k] = np.arange(len(learned[name]))

    def best(self, own: np.ndarray, size: int) -> tuple[int, str]:
        """(distance, language) of the nearest one; own: a document's n-grams in order."""
        at = np.searchsorted(self.known, own)
        at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        there = self.places[at].astype(np.int64)
        away = np.where(there < 0, size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        k = int(np.argmin(away))
        return int(away[k]), self.names[k]


def predictor(learned: dict[str, np.ndarray], size: int = PROFILE) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, score). The score is 1 for the profile's own order and 0 for nothing in common."""
    names = sorted(learned)
    blocks = [_Block(names[a : a + _TOGETHER], learned) for a in range(0, len(names), _TOGETHER)]

    def predict(text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if not len(codes) or not blocks:
            return "und", 0.0
        own = ranked(codes, size)
        away, name = min(block.best(own, size) for block in blocks)
        return name, float(min(1.0, max(0.0, 1 - away / (size * len(own)))))

    return predict


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", size: int = PROFILE) -> DataFrame:
    """docs with all their columns, and of each row __li_lang and __li_score."""

    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # size codes a language

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(sent.value, size)
        for batch in rows:
            found = [predict(t) for t in batch.column(at).to_pylist()]
            fields = [*batch.schema, pa.field("__li_lang", pa.string()), pa.field("__li_score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=pa.schema(fields))

    return docs.mapInArrow(run, with_columns(docs, "__li_lang string, __li_score double"))
