"""Codecs, seeds, capture shapes, exports and the stateful capture operators."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwitness.functions import codec, seeds, strict_json
from gridwitness.operators import export, search
from gridwitness.streaming import capture

SIGN = (codec.COMPOUND, [("text", (codec.STRING, "hé")), ("deep", (codec.COMPOUND, [("list", (codec.LIST, (codec.INT, [3, 1])))])), ("f", (codec.FLOAT, 0x7FC01234))])


def test_sections_round_trip_and_are_strict():
    states = [random.Random(1).choice(["minecraft:air", "minecraft:stone", "minecraft:oak_log[axis=y]"]) for _ in range(4096)]
    raw = codec.encode_blocks(-4, states)
    y, palette, indices = codec.decode_blocks(raw)
    assert y == -4 and palette == sorted(set(states)) and [palette[i] for i in indices] == states
    for bad in (raw + b"\0", raw[:-1], raw[:-1] + b"\x09", raw.replace(b"gridwitness", b"gridwitnesz")):
        with pytest.raises(codec.CodecError):
            codec.decode_blocks(bad)
    with pytest.raises(codec.CodecError):
        codec.parse_state("minecraft:oak_log[b=1,a=2]")
    assert codec.decode_shape(codec.encode_shape(-4, 24)) == (-4, 24)
    entries = [(1, 64, 2, "minecraft:sign", SIGN), (0, -5, 0, "minecraft:chest", (codec.COMPOUND, []))]
    found = codec.decode_block_entities(codec.encode_block_entities(entries))
    assert [e[3] for e in found] == ["minecraft:chest", "minecraft:sign"] and codec.encode_block_entities(found) == codec.encode_block_entities(entries)


def test_sizes_of_the_format():
    assert len(codec.encode_blocks(0, ["minecraft:air"] * 4096)) - len("gridwitness") == 8262 - 11
    assert len(codec.encode_biomes(0, ["minecraft:plains"] * 64)) == 4 + len(codec.domain("biome-section")) + 6 + 4 + 16 + 128


values = st.recursive(
    st.one_of(st.tuples(st.just(codec.INT), st.integers(-(2**31), 2**31 - 1)), st.tuples(st.just(codec.STRING), st.text(st.characters(exclude_categories=["Cs"]), max_size=8)), st.tuples(st.just(codec.LONGS), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=3))),
    lambda inner: st.tuples(st.just(codec.COMPOUND), st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), inner, max_size=4).map(lambda d: sorted(d.items(), key=lambda e: e[0].encode()))),
    max_leaves=12,
)


@settings(max_examples=60, deadline=None)
@given(values)
def test_nbt_round_trip(value):
    raw = codec.encode_nbt(value)
    assert codec.encode_nbt(codec.decode_nbt(raw)) == raw


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_decoders_refuse_noise(raw):
    for decode in (codec.decode_shape, codec.decode_blocks, codec.decode_biomes, codec.decode_nbt, codec.decode_block_entities):
        try:
            decode(raw)
        except codec.CodecError:
            pass


def java_ints(seed, bound, n):
    """The published algorithm in plain integers."""
    state, out = (seed ^ 0x5DEECE66D) & seeds.MASK, []

    def bits():
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & seeds.MASK
        return state >> 17

    while len(out) < n:
        v = bits()
        if bound & -bound == bound:
            out.append(bound * v >> 31)
            continue
        while v - v % bound + bound - 1 >= 1 << 31:
            v = bits()
        out.append(v % bound)
    return out


def test_draws():
    rng = random.Random(2)
    for bound in (1, 2, 16, 10, 24, 1_500_000_000, 2**31 - 1):
        own = np.array([rng.randrange(-(2**63), 2**63) for _ in range(50)], np.int64)
        state, got = (own.view(np.uint64) ^ np.uint64(seeds.MULTIPLIER)) & np.uint64(seeds.MASK), []
        for _ in range(6):
            state, v = seeds.next_int(state, bound)
            got.append(v)
        assert np.array(got).T.tolist() == [java_ints(int(s), bound, 6) for s in own]


def test_seed_search(spark):
    def placed(seed, sp, se, salt, spread, rx, rz):
        d = java_ints((rx * seeds.REGION_X + rz * seeds.REGION_Z + seed + salt) & seeds.MASK, sp - se, 4)
        a, b = (d[0], d[1]) if spread == "linear" else ((d[0] + d[1]) // 2, (d[2] + d[3]) // 2)
        return {"spacing": sp, "separation": se, "salt": salt, "spread_type": spread, "x": rx * sp + a, "z": rz * sp + b}

    evidence = [placed(31_337, 32, 8, 14357617, "linear", 3, -2), placed(31_337, 20, 11, 10387319, "triangular", -4, 5), placed(31_337, 34, 8, 94251327, "linear", 0, 0)]
    got, report = search.search_seeds(spark, evidence, 0, 99_999, "me")
    assert 31_337 in {r.seed for r in got.collect()} and report["scanned"] == 100_000 and not report["truncated"]
    few, report = search.search_seeds(spark, evidence[:1], 0, 99_999, "me", 3)
    assert few.count() == 3 and report["truncated"] and report["caveats"] == {"ambiguous": 3, "few_observations": 1, "partial_space": 100_000 / 2**48, "seed_bits": 48, "truncated": 3}
    assert search.worded("few_observations", 1) == "few observations: 1"
    with pytest.raises(PermissionError):
        search.search_seeds(spark, evidence, 0, 1, "")


def capture_tables(spark):
    blocks = ["minecraft:air"] * 4095 + ["minecraft:oak_stairs[facing=north,half=bottom,waterlogged=true]"]
    bodies = {
        "mcjava.shape": codec.encode_shape(-4, 2), "mcjava.blocks.-4": codec.encode_blocks(-4, blocks), "mcjava.blocks.-3": codec.encode_blocks(-3, ["minecraft:chest"] + ["minecraft:air"] * 4095),
        "mcjava.biomes.-4": codec.encode_biomes(-4, ["minecraft:plains", "minecraft:desert"] * 32), "mcjava.block_entities": codec.encode_block_entities([(1, -60, 2, "minecraft:sign", SIGN)]), "mcjava.blocks.9": b"broken",
    }
    h = lambda b: hashlib.sha256(b).hexdigest()
    parts = spark.createDataFrame([("o1", n, h(b)) for n, b in bodies.items()], "id string, name string, digest string")
    return parts, spark.createDataFrame([(h(b), b) for b in bodies.values()], "digest string, bytes binary")


def test_required_shapes(spark):
    parts, objects = capture_tables(spark)
    assert {r.shape for r in search.required_shapes(parts, objects).collect() if r.present} == set(search.SHAPES)
    less = {r.shape for r in search.required_shapes(parts.where("name <> 'mcjava.shape'"), objects).collect() if r.present}
    assert set(search.SHAPES) - less == {s for s in search.SHAPES if "build range" in s}


def test_region_files(spark):
    parts, objects = capture_tables(spark)
    chosen = spark.createDataFrame([("o1", -1, 33)], "id string, x int, z int")
    file = export.region_files(chosen, parts.where("name <> 'mcjava.blocks.9'"), objects).first()
    assert (file.file_name, file.chunks) == ("r.-1.1.mca", 1) and len(file.content) % 4096 == 0
    slot = (31 + 32) * 4
    place = struct.unpack(">I", file.content[slot : slot + 4])[0]
    at = (place >> 8) * 4096
    n, kind = struct.unpack(">IB", file.content[at : at + 5])
    raw = zlib.decompress(file.content[at + 5 : at + 4 + n])
    assert kind == 2 and raw[:3] == b"\x0a\0\0" and b"DataVersion" in raw and b"minecraft:oak_stairs" in raw and b"minecraft:the_void" in raw


def test_packing_of_indices():
    for n, least in ((2, 4), (17, 4), (300, 4), (2, 1), (5, 1)):
        own = np.array([random.Random(n).randrange(n) for _ in range(4096)])
        bits = max(least, (n - 1).bit_length())
        longs = [v & (1 << 64) - 1 for v in export.packed(own, n, least)]
        assert [longs[i // (64 // bits)] >> i % (64 // bits) * bits & (1 << bits) - 1 for i in range(4096)] == own.tolist()
    assert export.packed(np.zeros(64, int), 1, 1) is None


def test_coverage_map(spark):
    cells = spark.createDataFrame([(0, 0, "conflict"), (2, 1, "corroborated"), (50, 50, "unknown")], "x int, z int, status string")
    image = export.coverage_map(cells, 2)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (6, 4)
    at = image.index(b"IDAT")
    rows = zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]])
    assert tuple(rows[1:4]) == export.COLOURS["conflict"]


def test_strict_json():
    assert strict_json.problem(b'{"a": 1}', ("a",)) is None
    for raw in (b'{"a": 1, "a": 2}', b'{"b": 1}', b"{} {}", b"\xff", b"[" * 65 + b"]" * 65, b"[]", None):
        assert strict_json.problem(raw, ("a",))


EVENTS = [(0, 0, 0, "load"), (0, 0, 2, "dirty"), (0, 0, 5, "dirty"), (0, 0, 30, "dirty"), (1, 0, 3, "dirty"), (2, 2, 1, "load"), (2, 2, 3, "unload"), (2, 2, 9, "dirty"), *((5, 5, t, "load" if t == 0 else "dirty") for t in range(0, 60, 3))]
CLAIMS = {(0, 0, 0, 5, "due"), (0, 0, 30, 30, "due"), (2, 2, 1, 1, "final"), (5, 5, 0, 39, "due"), (5, 5, 42, 57, "due")}


def test_dirty_windows(spark):
    df = spark.createDataFrame(EVENTS, "x int, z int, tick bigint, kind string")
    assert {tuple(r) for r in capture.dirty_claims_batch(df).collect()} == CLAIMS
    cell = capture.DirtyCell(4, True, 10, 12)
    cell.retry(3, 5)
    assert (cell.first, cell.last) == (3, 12)


def test_dirty_windows_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame([*EVENTS, (9, 9, 500, "load")], "x int, z int, tick bigint, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = capture.dirty_claims(stream).writeStream.format("memory").queryName("claims").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT * FROM claims").collect()}
    assert got >= {c for c in CLAIMS if c[3] < 57} and got <= CLAIMS


def test_an_event_that_comes_a_batch_late_still_counts(spark, tmp_path):
    import os

    batches = [[(0, 0, 0, "load"), (1, 1, 0, "load"), (0, 0, 100, "dirty")], [(1, 1, 90, "dirty")], [(0, 0, 600, "dirty"), (1, 1, 600, "dirty")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "x int, z int, tick bigint, kind string").coalesce(1).write.parquet(str(tmp_path / "made" / str(k)))
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = (tmp_path / "made" / str(k)).glob("part-*")
        file.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("x int, z int, tick bigint, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = capture.dirty_claims(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.x, r.first_tick, r.last_tick) for r in spark.sql("SELECT * FROM late").collect()} >= {(1, 90, 90), (0, 100, 100)}


def test_the_cells_together_are_bounded():
    cache = capture.BlockEntityCache(most_bytes=10)
    cells = [cache.change((k, 0), lambda c: c.baseline({"p": ("sign", b"1234")})) for k in range(2)]
    cache.change((0, 0), lambda c: c.delta("q", "sign", b"5"))
    third = cache.change((2, 0), lambda c: c.baseline({"p": ("sign", b"12345")}))
    assert [c.known for c in (*cells, third)] == [True, False, True] and list(cache.cells) == [(0, 0), (2, 0)]
    alone = cache.change((3, 0), lambda c: c.baseline({"p": ("sign", b"x" * 11)}))
    assert not alone.known and not cache.cells


def test_a_spool_is_written_whole_and_recovered(spark, tmp_path):
    from gridwitness.sources import files
    from gridwitness.streaming import spool

    writer = spool.SpoolWriter(tmp_path / "spool")
    manifest = lambda n: {"schema": "gridwitness.capture-bundle/v1", "server_id": "s", "dimension": "d", "chunk": {"x": n, "z": 0}, "observed_at": "2026-08-09T12:00:00Z", "protocol": "p", "source": {"contributor": "me"}, "capture": {"session_id": "a", "sequence": n, "trigger": "t"}}
    one, two = (writer.write(manifest(n), {"x": b"same", "y": str(n).encode()}) for n in (1, 2))
    with pytest.raises(FileExistsError):
        writer.write(manifest(2), {"x": b"other"})
    names = {n: json.loads((one / "bundle.json").read_text())["components"][n]["path"] for n in "xy"}
    assert (one / names["x"]).stat().st_ino == (two / names["x"]).stat().st_ino and spool.bundle_fault(one) is None
    rows, _ = files.read_spool(spark, str(tmp_path / "spool"))
    assert [(r.x, r.problems) for r in rows.collect()] == [(1, []), (2, [])]
    # a crash leaves folders that were never renamed: one whole, one cut short, one twice
    writer.write(manifest(3), {"x": b"3"}).rename(tmp_path / "spool" / ".tmp-whole")
    cut = writer.write(manifest(4), {"x": b"4"})
    (cut / "bundle.json").write_text("{")
    cut.rename(tmp_path / "spool" / ".tmp-cut")
    left = [p.name for p in (tmp_path / "spool").iterdir() if p.name.startswith(".tmp-")]
    found = spool.recover(tmp_path / "spool")
    assert len(left) == 3 and found.pop(spool.ready_name("a", 3)) is None and sorted(x.split(":")[0] for x in found.values()) == ["its sequence was published already", "no strict JSON"]
    assert spool.recover(tmp_path / "spool") == {}
    with pytest.raises(OSError, match="full"):
        spool.SpoolWriter(tmp_path / "spool", most=1).write(manifest(9), {"x": b"9"})
    for bad in ("/a", "a//b", "a/../b", "./a", "C:a", "a\\b", "a/", "", ".."):
        assert spool.RELATIVE_PATH_FAULTS.search(bad), bad
    for good in ("a", "a/b.c", "..a/b", "a..b"):
        assert not spool.RELATIVE_PATH_FAULTS.search(good)


def test_block_entities():
    cell = capture.BlockEntities()
    cell.delta("p", "sign", b"1")
    assert not cell.known and not cell.entries
    cell.baseline({"p": ("sign", b"1")})
    cell.delta("p", "sign", b"2")
    cell.delta("q", "chest", b"3")
    cell.delta("p", None, None)
    assert cell.entries == {"q": ("chest", b"3")}


def test_sequences(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4), ("t", 2)], "session_id string, sequence bigint")
    assert {tuple(r) for r in capture.sequence_faults(df).collect()} == {("s", 4, 3), ("t", 2, 1)}
