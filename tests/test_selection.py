"""Selection, diff and windows on small ledgers, and against naive models."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from gridwitness.operators import selection, windows

SCHEMA = "server_id string, dimension string, x int, z int, contributor string, observed_at timestamp_ntz, observed_nanos int, state_digest string, id string"
START = datetime(2026, 8, 9, 12)


def row(contributor, minute, state, cell=(1, 2), nanos=0, n=None):
    at = START + timedelta(minutes=minute)
    return ("example.org", "minecraft:overworld", *cell, contributor, at, nanos + at.microsecond * 1000, state, n or f"{contributor}-{minute}-{state}-{nanos}")


@pytest.fixture
def ledger(spark):
    return lambda rows: selection.gather(spark.createDataFrame(rows, SCHEMA))


AT = "2026-08-09 13:00:00"


def one(ledger, rows, window=selection.WINDOW_SECONDS, at=AT):
    return selection.select_at(ledger(rows), at, window).first()


def test_statuses(ledger):
    assert one(ledger, [row("a", 1, "A")]).status == "single-source"
    assert one(ledger, [row("a", 1, "A"), row("b", 2, "A")]).status == "corroborated"
    r = one(ledger, [row("a", 1, "A"), row("b", 2, "A"), row("c", 50, "B")])
    assert (r.status, r.state_digest, r.rejected[0].state_digest, r.rejected[0].contributors) == ("corroborated", "A", "B", ["c"])
    r = one(ledger, [row("a", 1, "A"), row("b", 2, "B")])
    assert (r.status, r.state_digest) == ("superseded", "B")
    assert one(ledger, [row("a", 1, "A"), row("b", 1.5, "B")]).status == "conflict"  # 30 s apart, the window's end included
    assert one(ledger, [row("a", 1, "A"), row("b", 1.51, "B")]).status == "superseded"
    r = one(ledger, [row("a", 59, "A"), row("a", 61, "A")])
    assert r.id == "a-59-A-0"
    r = one(ledger, [row("a", 61, "A")])
    assert (r.status, r.state_digest, r.rejected) == ("unknown", None, None)


def test_a_contributor_counts_once_and_by_its_last_row(ledger):
    r = one(ledger, [row("a", 1, "A"), row("a", 2, "A"), row("a", 3, "B"), row("b", 1, "A")])
    assert r.state_digest == "B" and r.status == "superseded"


def test_equal_groups_are_no_corroboration(ledger):
    r = one(ledger, [row("a", 1, "A"), row("b", 2, "A"), row("c", 3, "B"), row("d", 4, "B")])
    assert (r.status, r.state_digest) == ("superseded", "B")


def test_nanoseconds_and_ids_break_ties(ledger):
    r = one(ledger, [row("a", 1, "A", nanos=5), row("b", 1, "B", nanos=6)], 0)
    assert (r.state_digest, r.status) == ("B", "superseded")  # 1 ns is more than no window
    r = one(ledger, [row("a", 1, "A", n="x"), row("b", 1, "B", n="y")])
    assert (r.id, r.status) == ("y", "conflict")


def naive(rows, at, window):
    cells = defaultdict(dict)
    for r in rows:
        cell, c, key = r[:4], r[4], (r[5], r[6], r[8])
        cells.setdefault(cell, {})
        if r[5] <= at and (c not in cells[cell] or key > cells[cell][c][0]):
            cells[cell][c] = (key, r[7])
    out = {}
    for cell, last in cells.items():
        groups = defaultdict(list)
        for key, state in last.values():
            groups[state].append(key)
        if not groups:
            out[cell] = ("unknown", None, None)
            continue
        order = sorted(groups, key=lambda s: (-len(groups[s]), -max((k[0] - START).total_seconds() for k in groups[s]), s))
        best = order[0]
        if len(groups[best]) >= 2 and (len(order) == 1 or len(groups[best]) > len(groups[order[1]])):
            status = "corroborated"
        elif len(order) == 1:
            status = "single-source"
        else:
            best = max(groups, key=lambda s: max(groups[s]))
            times = [k[0] for ks in groups.values() for k in ks]
            status = "conflict" if max(times) - min(times) <= timedelta(seconds=window) else "superseded"
        out[cell] = (status, best, max(groups[best])[2])
    return out


def test_against_a_naive_model_in_any_order(ledger):
    rng = random.Random(1)
    for trial in range(3):
        rows = [row(rng.choice("abcd"), rng.randint(0, 90), rng.choice("XYZ"), (rng.randint(0, 3), rng.randint(0, 3)), n=f"{trial}-{k}") for k in range(150)]
        expected = naive(rows, datetime(2026, 8, 9, 13), 600)
        for _ in range(2):
            rng.shuffle(rows)
            got = {tuple(r[c] for c in selection.CELL): (r.status, r.state_digest, r.id) for r in selection.select_at(ledger(rows), AT, 600).collect()}
            assert got == expected


def test_diff(ledger):
    cells = {name: (k, 0) for k, name in enumerate(["never", "first", "changed", "not", "unchanged", "flip"])}
    rows = [
        row("a", 90, "A", cells["never"]), row("a", 30, "A", cells["first"]), row("a", 5, "A", cells["changed"]), row("b", 30, "B", cells["changed"]), row("a", 5, "A", cells["not"]),
        row("a", 5, "A", cells["unchanged"]), row("b", 30, "A", cells["unchanged"]), row("a", 5, "A", cells["flip"]), row("a", 20, "B", cells["flip"]), row("a", 30, "A", cells["flip"]),
    ]
    a, b = "2026-08-09 12:10:00", "2026-08-09 12:40:00"
    got = selection.diff_between(ledger(rows), a, b)
    kinds = {r.x: r for r in got.collect()}
    assert [kinds[cells[n][0]].kind for n in cells] == ["never-seen", "first-seen", "changed", "not-revisited", "unchanged", "unchanged"]
    assert [r.id for r in kinds[5].revisits] == ["a-20-B-0", "a-30-A-0"] and kinds[5].revisited_by == ["a"]
    assert [tuple(r) for r in selection.diff_between(ledger(rows), b, a).orderBy("x").collect()] == [tuple(r) for r in got.orderBy("x").collect()]
    s = selection.diff_summary(got).first()
    assert (s.chunks, s.changed, s.unchanged, s.covered, s.contributors) == (6, 1, 2, 3, ["a", "b"])
    assert [r.x for r in selection.changed_cells(got).collect()] == [2]


def test_the_intervals_ends(ledger):
    rows = [row("a", 10, "A"), row("a", 40, "A"), row("a", 41, "B")]
    r = selection.diff_between(ledger(rows), "2026-08-09 12:10:00", "2026-08-09 12:40:00").first()
    assert [x.observed_at.minute for x in r.revisits] == [40]


def test_redactions(spark):
    rows = spark.createDataFrame([row("Alice ", 1, "A"), row("bob", 2, "B"), row("bob", 3, "B", (9, 9))], SCHEMA)
    reds = lambda *r: spark.createDataFrame(r, "id string, server_id string, contributor string, dimension string, min_x int, min_z int, max_x int, max_z int")
    kept = lambda *r: {x.id for x in selection.gather(rows, reds(*r)).observations.collect()}
    assert kept(("1", " EXAMPLE.org", "alice", None, None, None, None, None)) == {"bob-2-B-0", "bob-3-B-0"}
    assert kept(("1", "example.org", None, None, 9, 9, 9, 10)) == {"Alice -1-A-0", "bob-2-B-0"}
    assert kept(("1", "example.org", None, None, None, None, None, None)) == set()
    assert kept(("1", "other.org", None, None, None, None, None, None)) == {"Alice -1-A-0", "bob-2-B-0", "bob-3-B-0"}
    g = selection.gather(rows, reds(("1", "example.org", "bob", None, None, None, None, None)))
    assert g.withheld.count() == 2 and selection.select_at(g, AT).count() == 1


def test_windows(spark):
    rows = [row("a", 0, "A"), row("b", 10 / 60, "A"), row("c", 11 / 60, "B"), row("a", 21 / 60, "C"), row("b", 40 / 60, "C")]
    got = windows.agreement_windows(spark.createDataFrame(rows, SCHEMA)).orderBy("window_start").collect()
    assert [(r.status, r.observations) for r in got] == [("corroborated", 2), ("conflict", 2), ("single-source", 1)]
    assert windows.agreement_windows(spark.createDataFrame(rows, SCHEMA), -1).count() == 3


def test_summary_counts_each_status(ledger):
    s = selection.status_summary(selection.select_at(ledger([row("a", 1, "A"), row("a", 90, "A", (5, 5))]), AT)).first()
    assert (s.chunks, s.single_source, s.unknown, s.corroborated) == (2, 1, 1, 0)


def test_instants_are_exact_to_the_nanosecond(ledger):
    """Rows a nanosecond before, at and after an instant; the time in microseconds is the same for all."""
    at, rows = "2026-08-09 13:00:00.000000500", [row("a", 60, "before", nanos=499), row("b", 60, "at", (2, 2), nanos=500), row("c", 60, "after", (3, 3), nanos=501)]
    got = {r.x: (r.status, r.state_digest) for r in selection.select_at(ledger(rows), at).collect()}
    assert got == {1: ("single-source", "before"), 2: ("single-source", "at"), 3: ("unknown", None)}
    later = "2026-08-09 13:00:00.000000501"
    assert {r.x: r.kind for r in selection.diff_between(ledger(rows), at, later).collect()} == {1: "not-revisited", 2: "not-revisited", 3: "first-seen"}
    # an interval is open at its start and closed at its end
    rows = [row("a", 60, "A", nanos=0), row("a", 60, "A", nanos=499, n="start"), row("a", 60, "A", nanos=500, n="in"), row("a", 60, "A", nanos=501, n="end"), row("a", 60, "B", nanos=502, n="late")]
    d = selection.diff_between(ledger(rows), "2026-08-09T13:00:00.000000499Z", later).first()
    assert [r.id for r in d.revisits] == ["in", "end"] and d.kind == "unchanged" and d.after_state_digest == "A"
    assert selection.instant("1970-01-01 00:00:01.5") == 1_500_000_000 and selection.instant("1969-12-31 23:59:59.999999999") == -1 and selection.instant(START) == selection.instant("2026-08-09 12:00:00")
    with pytest.raises(ValueError):
        selection.instant("yesterday")


def test_plans_read_once_and_join_nothing(spark, tmp_path):
    spark.createDataFrame([row("a", 1, "A")], SCHEMA).write.parquet(f"{tmp_path}/rows")
    held = selection.gather(spark.read.parquet(f"{tmp_path}/rows"))
    for df in (selection.select_at(held, AT), selection.diff_between(held, AT, "2026-08-09 14:00:00")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2
