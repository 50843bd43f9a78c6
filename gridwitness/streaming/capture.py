"""Stateful capture operators: coalescing of dirty cells, block-entity baselines and deltas, sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK_MS = 50
#: Limits of block entities of a cell.
MOST_ENTRIES, MOST_BYTES = 4_096, 16 << 20
#: Fixed value: bytes of block entities of all cells together.
MOST_BYTES_OF_ALL = 128 << 20

CLAIM = "x int, z int, first_tick bigint, last_tick bigint, reason string"


def latency(coalesce_ticks: int) -> int:
    """The longest a cell may stay dirty before it is claimed."""
    return max(20, 10 * coalesce_ticks)


class DirtyCell:
    """One cell's window: first and last dirty tick, and whether the cell is loaded."""

    def __init__(self, coalesce_ticks: int, loaded: bool = False, first: int | None = None, last: int | None = None) -> None:
        self.coalesce, self.most = coalesce_ticks, latency(coalesce_ticks)
        self.loaded, self.first, self.last = loaded, first, last

    def due(self) -> int | None:
        """The tick from which the window is claimed."""
        return None if self.first is None else min(self.last + self.coalesce, self.first + self.most)

    def claim(self, reason: str) -> tuple[int, int, str]:
        found = (self.first, self.last, reason)
        self.first = self.last = None
        return found

    def at(self, tick: int, kind: str) -> Iterator[tuple[int, int, str]]:
        """What is claimed up to and at an event: load and dirty open or extend a window; unload, transition and disconnect claim it whether due or not; retry merges a given window back."""
        if (due := self.due()) is not None and due <= tick:
            yield self.claim("due")
        if kind == "load":
            self.loaded = True
        if kind in ("load", "dirty") and self.loaded:
            self.first = tick if self.first is None else self.first
            self.last = tick if self.last is None else max(self.last, tick)
        if kind in ("unload", "transition", "disconnect"):
            if self.first is not None:
                yield self.claim("final")
            self.loaded = False

    def retry(self, first: int, last: int) -> None:
        if self.loaded:
            self.first = first if self.first is None else min(self.first, first)
            self.last = last if self.last is None else max(self.last, last)


def dirty_claims(events: DataFrame, coalesce_ticks: int = 4, late: str = "10 seconds") -> DataFrame:
    """Claims from a stream (x, z, tick, kind). A window whose time has come is claimed when the watermark passes it, in event time of 50 ms a tick (from 1: a watermark begins at 0 and rows there would be late).

    late: how far events may lag behind the latest one of all cells, such as those of a slower file or partition, and still count; claims of windows that no
    later event of their cell closes wait as long.
    """
    timed = events.withColumn("at", F.timestamp_millis((F.col("tick") + 1) * TICK_MS)).withWatermark("at", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (False, None, None)
        cell = DirtyCell(coalesce_ticks, held[0], None if pd.isna(held[1]) else held[1], None if pd.isna(held[2]) else held[2])
        found = []
        if state.hasTimedOut and cell.first is not None:
            found.append(cell.claim("due"))
        else:
            for pdf in frames:
                for tick, kind in sorted(zip(pdf["tick"].tolist(), pdf["kind"].tolist(), strict=True)):
                    found += cell.at(tick, kind)
        if cell.loaded or cell.first is not None:
            state.update((cell.loaded, cell.first, cell.last))
            if (due := cell.due()) is not None:
                state.setTimeoutTimestamp(max((due + 1) * TICK_MS, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], key[1], *f) for f in found], columns=["x", "z", "first_tick", "last_tick", "reason"])

    return timed.groupBy("x", "z").applyInPandasWithState(step, CLAIM, "loaded boolean, first bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def claims_to_take(claims: DataFrame, most: int) -> DataFrame:
    """Of a batch of claims the oldest, then by position; for use in foreachBatch, as a top-k of all keys needs all of them."""
    return claims.orderBy("first_tick", "x", "z").limit(most)


def dirty_claims_batch(events: DataFrame, coalesce_ticks: int = 4) -> DataFrame:
    """The same over a finished table of events: all windows are claimed in the end."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, found = DirtyCell(coalesce_ticks), []
        for tick, kind in sorted(zip(pdf["tick"].tolist(), pdf["kind"].tolist(), strict=True)):
            found += cell.at(tick, kind)
        if cell.first is not None:
            found.append(cell.claim("due"))
        return pd.DataFrame([(key[0], key[1], *f) for f in found], columns=["x", "z", "first_tick", "last_tick", "reason"])

    return events.groupBy("x", "z").applyInPandas(run, CLAIM)


class BlockEntities:
    """A cell's block entities: nothing is known before a baseline; deltas count only after one."""

    def __init__(self, known: bool = False, entries: dict | None = None) -> None:
        self.known, self.entries = known, dict(entries or {})

    def baseline(self, entries: dict[str, tuple[str, bytes]]) -> None:
        self.known, self.entries = True, dict(entries)
        self._limit()

    def delta(self, position: str, kind: str | None, payload: bytes | None) -> None:
        """A payload replaces the entry; an entry of another type, or no payload, drops it."""
        if not self.known:
            return
        if payload is None or (position in self.entries and self.entries[position][0] != kind):
            self.entries.pop(position, None)
        if payload is not None:
            self.entries[position] = (kind, payload)
        self._limit()

    def _limit(self) -> None:
        """Beyond the limits the cell is unknown again rather than known in part."""
        if len(self.entries) > MOST_ENTRIES or sum(len(p) for _, p in self.entries.values()) > MOST_BYTES:
            self.known, self.entries = False, {}


class BlockEntityCache:
    """The block entities of all cells of a session. Beyond the bytes for all of them, whole cells are forgotten, the one changed longest ago first: known in part is never known."""

    def __init__(self, most_bytes: int = MOST_BYTES_OF_ALL) -> None:
        self.most_bytes, self.cells, self.sizes = most_bytes, {}, {}

    def change(self, cell: tuple[int, int], act: Callable[[BlockEntities], None]) -> BlockEntities:
        """Applies act to a cell and gives the cell; it is unknown afterwards if it alone is too large."""
        own = self.cells.pop(cell, None) or BlockEntities()
        act(own)
        self.cells[cell] = own  # the latest is last
        self.sizes[cell] = sum(len(p) for _, p in own.entries.values())
        total = sum(self.sizes.values())
        for other in list(self.cells):
            if total <= self.most_bytes:
                break
            total -= self.sizes.pop(other)
            gone = self.cells.pop(other)
            gone.known, gone.entries = False, {}
        return own


def block_entity_states(events: DataFrame) -> DataFrame:
    """(x, z, seq, known, positions) after each event of a stream (x, z, seq, kind, position, type, payload); kind is baseline, delta or forget, a baseline's rows share a seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, positions, types, payloads = state.get if state.exists else (False, [], [], [])
        cell = BlockEntities(bool(known), {p: (t, bytes(b)) for p, t, b in zip(positions, types, payloads, strict=True)})
        rows, out = [r for pdf in frames for r in pdf.itertuples(index=False)], []
        for seq in sorted({r.seq for r in rows}):
            own = [r for r in rows if r.seq == seq]
            if own[0].kind == "baseline":
                cell.baseline({r.position: (r.type, bytes(r.payload)) for r in own if r.position is not None})
            elif own[0].kind == "forget":
                cell = BlockEntities()
            else:
                for r in own:
                    cell.delta(r.position, r.type, None if r.payload is None else bytes(r.payload))
            out.append((key[0], key[1], seq, cell.known, sorted(cell.entries)))
        state.update((cell.known, list(cell.entries), [t for t, _ in cell.entries.values()], [p for _, p in cell.entries.values()]))
        yield pd.DataFrame(out, columns=["x", "z", "seq", "known", "positions"])

    return events.groupBy("x", "z").applyInPandasWithState(
        step, "x int, z int, seq bigint, known boolean, positions array<string>", "known boolean, positions array<string>, types array<string>, payloads array<binary>", "append", GroupStateTimeout.NoTimeout
    )


def sequence_faults(bundles: DataFrame) -> DataFrame:
    """(session_id, sequence, expected) where a session's sequence doesn't rise by one from 1. bundles: (session_id, sequence)."""
    from pyspark.sql import Window

    before = F.lag("sequence").over(Window.partitionBy("session_id").orderBy("sequence"))
    expected = F.coalesce(before + 1, F.lit(1))
    return bundles.select("session_id", "sequence", expected.alias("expected")).where("sequence <> expected")
