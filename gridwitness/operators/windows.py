"""Agreement of contributors within short windows, and other groupings by time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import CELL, nanoseconds

#: Fixed value: the width of a window where none or none above zero is given.
WIDTH_SECONDS = 10


def _anchors(width: int):
    """Adds the anchor to rows sorted by cell and time: a row past the window of the current anchor is the next one, found by bisection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchor = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            t, found = batch.column(4).to_numpy(), np.empty(n, np.int64)
            other = np.zeros(n - 1, bool)
            for i in range(4):
                column = batch.column(i)
                other |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(other) + 1).tolist(), n]
            for a, b in zip(starts, starts[1:], strict=False):
                own = tuple(batch.column(i)[a].as_py() for i in range(4))
                if own != cell:
                    cell, anchor = own, int(t[a])
                while a < b:
                    end = a + int(np.searchsorted(t[a:b], anchor + width, side="right"))
                    found[a:end] = anchor
                    if end < b:
                        anchor = int(t[end])
                    a = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "anchor"])

    return run


def anchored(observations: DataFrame, width_seconds: float = WIDTH_SECONDS) -> DataFrame:
    """(cell, t, contributor, state_digest, id, observed_at, anchor), times in nanoseconds.

    A window begins at an observation and holds all up to width later, the end included; the next one begins at
    the first observation beyond. That is a fold in order, so a cell's rows are streamed in order and none is held.
    """
    width = round((width_seconds if width_seconds > 0 else WIDTH_SECONDS) * 1_000_000_000)
    rows = observations.select(*CELL, nanoseconds().alias("t"), "contributor", "state_digest", "id", "observed_at")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartition(*CELL).sortWithinPartitions(*CELL, "t", "id")
    return ordered.mapInArrow(_anchors(width), f"{types}, anchor bigint")


def agreement_windows(observations: DataFrame, width_seconds: float = WIDTH_SECONDS) -> DataFrame:
    """One row a window: its ends, status and the states with their contributors, those of more contributors first.

    Several states are a conflict; one state is corroborated by two contributors or more. Redactions don't apply here.
    """
    states = anchored(observations, width_seconds).groupBy(*CELL, "anchor", "state_digest").agg(
        F.array_sort(F.collect_set("contributor")).alias("contributors"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("n")
    )
    order = lambda a, b: F.when(F.size(a["contributors"]) != F.size(b["contributors"]), F.size(b["contributors"]) - F.size(a["contributors"])).when(a["state_digest"] < b["state_digest"], -1).when(a["state_digest"] > b["state_digest"], 1).otherwise(0)
    found = states.groupBy(*CELL, "anchor").agg(
        F.min("first_at").alias("window_start"), F.max("last_at").alias("window_end"), F.sum("n").alias("observations"), F.array_sort(F.collect_list(F.struct("state_digest", "contributors")), order).alias("states")
    )
    status = F.when(F.size("states") > 1, "conflict").when(F.size(F.col("states")[0]["contributors"]) >= 2, "corroborated").otherwise("single-source")
    return found.select(*CELL, "window_start", "window_end", status.alias("status"), "observations", "states")


def hourly_moments(observations: DataFrame) -> DataFrame:
    """By UTC hour: observations, cells and the last instant, in order of that."""
    return (
        observations.groupBy(F.date_trunc("hour", "observed_at").alias("hour"))
        .agg(F.count("*").alias("observations"), F.count_distinct(*CELL).alias("cells"), F.max("observed_at").alias("last_at"))
        .orderBy("last_at")
    )


def observed_span(observations: DataFrame) -> DataFrame:
    return observations.agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("observations"))


def capture_timing(jobs: DataFrame, micros: str = "micros", slow_micros: int = 5_000) -> DataFrame:
    """Count, sum, largest, which one that was, and how many took over slow_micros. jobs: (job_index, micros)."""
    m = F.col(micros)
    return jobs.agg(F.count("*").alias("jobs"), F.sum(m).alias("total_micros"), F.max(m).alias("max_micros"), F.max_by("job_index", F.struct(m, -F.col("job_index"))).alias("slowest_job"), F.count_if(m > slow_micros).alias("slow_jobs"))
