"""JSON as strictly as evidence is to be read: one value, no key twice, nested 64 deep at most, valid UTF-8, known keys alone."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 64


def _unique(pairs: list[tuple]) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("a key stands twice")
    return dict(pairs)


def _depth(text: str) -> int:
    deepest, depth, quoted, skip = 0, 0, False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    return deepest


def problem(raw: bytes | None, keys: tuple[str, ...] | None = None) -> str | None:
    """What is wrong with a document, None if nothing. keys: those its top may have."""
    if raw is None:
        return "nothing to read"
    try:
        text = bytes(raw).decode("utf-8")
        if _depth(text) > DEPTH:
            return "nested too deep"
        value = json.loads(text, object_pairs_hook=_unique)
    except (UnicodeDecodeError, ValueError, RecursionError) as error:
        return "not UTF-8" if isinstance(error, UnicodeDecodeError) else f"no strict JSON: {error}"
    if keys is not None:
        if not isinstance(value, dict):
            return "no object"
        if unknown := sorted(set(value) - set(keys)):
            return f"unknown key {unknown[0]}"
    return None


def json_problem(raw: Column | str, keys: tuple[str, ...] | None = None) -> Column:
    """The problem of each document as a column; null if it is in order. Spark's own parser would keep the last of two equal keys."""
    return F.pandas_udf(lambda s: pd.Series([problem(x, keys) for x in s], dtype=object), "string", F.PandasUDFType.SCALAR)(raw)
