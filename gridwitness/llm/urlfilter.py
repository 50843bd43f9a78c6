"""URL filters: host and path rules, and for other URLs a ratio of two character language models.

One smoothed variable-order Markov model (Witten-Bell interpolation from no context up to `order` characters) is
learned from URLs that rules accept, one from those they reject. A URL's score is the difference of their log10
likelihoods divided by its length; the threshold is calibrated on labelled URLs that were not learned from.

Both models are learned from a bounded sample: of each verdict the `sample` distinct URLs of lowest hash, of at most
`most_chars` characters. All URLs are scored, whole.

Defined cases. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#`
or the end; a null URL or one without `://` has both empty, and its whole text is judged by the models. The longest rule that fits wins, of equally long ones the first by name. An empty
or null URL scores 0. Without URLs of one verdict there is nothing to tell apart, and all others are allowed. Repeated URLs are learned once; those of equal
hashes go by text. Very long URLs are scored whole. An empty table gives no rows. Other columns are kept, whatever their names; those added begin with __uf_.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE, ascii_lower, with_columns


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Rules:
    """Rules (`host/path` -> verdict) by host; a URL's host is looked up with all it is a subdomain of."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for rule in sorted(rules, key=lambda r: (-len(r), r)):
            name, slash, rest = rule.partition("/")
            self.by_host[name].append((slash + rest, rule))

    def find(self, host: str, path: str) -> str | None:
        """The longest rule that fits."""
        best: tuple[int, str] | None = None
        at = 0
        while at >= 0:
            for start, rule in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    best = min(best or (0, rule), (-len(rule), rule))
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best[1] if best else None


def with_rule(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rows, with __uf_host and __uf_path, and __uf_rule of each: the longest that fits, or null. The rules are the caller's own and go to all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(Rules(rules))
    at = [rows.columns.index(c) for c in ("__uf_host", "__uf_path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema=pa.schema([*batch.schema, pa.field("__uf_rule", pa.string())]))

    return rows.mapInArrow(run, with_columns(rows, "__uf_rule string"))


class Markov:
    """Counts of characters after contexts of 0 to order characters."""

    def __init__(self, texts: list[str], order: int) -> None:
        self.order = order
        self.after: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            padded = "\n" * order + text
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.after[padded[i - k : i]][padded[i]] += 1
        self.after = {k: dict(v) for k, v in self.after.items()}
        self.sums = {k: sum(v.values()) for k, v in self.after.items()}

    def log10(self, context: str, char: str) -> float:
        p = 1 / 0x110000
        for k in range(self.order + 1):
            own = context[len(context) - k :]
            seen = self.after.get(own)
            if seen is None:
                break
            p = (seen.get(char, 0) + len(seen) * p) / (self.sums[own] + len(seen))
        return math.log10(p)


class Ratio:
    """Mean log10 ratio a character; each window's share is kept, as it depends on order + 1 characters alone."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int) -> None:
        self.order, self.accepted, self.rejected = order, Markov(accepted, order), Markov(rejected, order)
        self.held: dict[str, float] = {}

    def score(self, text: str) -> float:
        if not text:
            return 0.0
        total, padded, order = 0.0, "\n" * self.order + text, self.order
        for i in range(len(text)):
            window = padded[i : i + order + 1]
            share = self.held.get(window)
            if share is None:
                if len(self.held) >= WORD_CACHE:
                    self.held.clear()
                share = self.held[window] = self.accepted.log10(window[:-1], window[-1]) - self.rejected.log10(window[:-1], window[-1])
            total += share
        return total / len(text)


def threshold(accepted: list[float], rejected: list[float]) -> float:
    """The score under which URLs are blocked: least sum of the shares wrongly blocked and wrongly allowed, in the middle of the best range."""
    if not accepted or not rejected:
        return -math.inf
    a, r = np.sort(accepted), np.sort(rejected)
    cuts = np.unique(np.concatenate((a, r)))
    cuts = np.concatenate((cuts, [cuts[-1] + 1e-9]))
    wrong = np.searchsorted(a, cuts, side="left") / len(a) + 1 - np.searchsorted(r, cuts, side="left") / len(r)
    best = int(np.argmin(wrong))
    return float((cuts[best] + cuts[best - 1]) / 2) if best else float(cuts[0])


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", order: int = 5, sample: int = 5_000, most_chars: int = 2_000) -> DataFrame:
    """pages with all their columns, and __uf_host, __uf_path, __uf_rule, __uf_verdict and __uf_score."""
    host, path = parts(F.col(url))
    rows = pages.withColumns({"__uf_host": host, "__uf_path": path})
    rows = with_rule(rows, rules)
    rest = F.concat("__uf_host", F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*(.*)$", 1))
    read = F.coalesce(F.when(F.col(url).contains("://"), rest).otherwise(F.col(url)), F.lit(""))
    verdict = F.create_map(*(F.lit(x) for item in rules.items() for x in item))[F.col("__uf_rule")] if rules else F.lit(None).cast("string")
    labelled = rows.where("__uf_rule IS NOT NULL").select(read.alias("text"), verdict.alias("verdict")).where(F.char_length("text") <= most_chars).distinct()
    split: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for kind in ("allow", "block"):
        lowest = labelled.where(F.col("verdict") == kind).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample)
        for r in lowest.collect():
            split[kind, r.h % 5 == 0].append(r.text)
    model = Ratio(split["allow", False], split["block", False], order)
    least = threshold([model.score(t) for t in split["allow", True]], [model.score(t) for t in split["block", True]])
    model.held.clear()
    sent = pages.sparkSession.sparkContext.broadcast(model)  # bounded by sample, most_chars and order
    n = len(rows.columns)
    rows = rows.withColumn("__uf_read", read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores = [model.score(t) for t in batch.column(n).to_pylist()]
            fields = [*list(batch.schema)[:n], pa.field("__uf_score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], schema=pa.schema(fields))

    scored = rows.mapInArrow(run, with_columns(rows.drop("__uf_read"), "__uf_score double"))
    return scored.withColumn("__uf_verdict", F.coalesce(verdict, F.when(F.col("__uf_score") < least, "block").otherwise("allow")))
