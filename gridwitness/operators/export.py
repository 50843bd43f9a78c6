"""Worlds out of a ledger: region files and coverage maps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec as c
from .translation import FILL_BIOME

#: Sizes of a region file, the game's data version, and the colours of a coverage map.
SECTOR, HEADER, DEFLATE, MOST_SECTORS, DATA_VERSION = 4096, 2, 2, 255, 4903
COLOURS = {"corroborated": (46, 160, 67), "single-source": (56, 139, 253), "superseded": (210, 153, 34), "conflict": (218, 54, 51)}
BACKGROUND, MOST_PIXELS = (24, 26, 31), 16_384


def packed(indices: np.ndarray, palette: int, least_bits: int) -> list[int] | None:
    """Indices in longs, none across two of them; nothing for a palette of one."""
    if palette <= 1:
        return None
    bits = max(least_bits, (palette - 1).bit_length())
    per = 64 // bits
    padded = np.zeros(-(-len(indices) // per) * per, np.uint64)
    padded[: len(indices)] = indices
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, :]
    return np.bitwise_or.reduce(padded.reshape(-1, per) << shifts, axis=1).view(np.int64).tolist()


def _modified_utf8(s: str) -> bytes:
    """NUL as two bytes, characters beyond the first plane as two surrogates."""
    raw = s.encode("utf-16-be")
    return b"".join(map(_unit, struct.unpack(f">{len(raw) // 2}H", raw)))


def _unit(u: int) -> bytes:
    if 0 < u < 0x80:
        return bytes([u])
    if u < 0x800:
        return bytes([0xC0 | u >> 6, 0x80 | u & 63])
    return bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 63, 0x80 | u & 63])


def _string(s: str) -> bytes:
    raw = _modified_utf8(s)
    return struct.pack(">H", len(raw)) + raw


def _nbt(tag: int, v) -> bytes:
    """A payload as files have it."""
    if tag == c.STRING:
        return _string(v)
    if tag == c.LIST:
        kind, items = v
        return struct.pack(">Bi", kind if items else c.END, len(items)) + b"".join(_nbt(kind, x) for x in items)
    if tag == c.COMPOUND:
        return b"".join(bytes([k]) + _string(n) + _nbt(k, x) for n, (k, x) in v) + b"\0"
    if tag == c.BYTES:
        return struct.pack(">i", len(v)) + bytes(x & 0xFF for x in v)
    if tag in (c.INTS, c.LONGS):
        return struct.pack(f">i{len(v)}{'i' if tag == c.INTS else 'q'}", len(v), *v)
    return struct.pack(f">{c._WIDTH[tag][0]}", v)


def named_nbt(v: list) -> bytes:
    """A compound as a file's nameless root."""
    return bytes([c.COMPOUND]) + _string("") + _nbt(c.COMPOUND, v)


def chunk_nbt(x: int, z: int, shape: tuple[int, int], blocks: dict, biomes: dict, entities: list, data_version: int = DATA_VERSION) -> list:
    """A chunk's compound. Sections never observed are left out, unknown biomes are the void, light is left for the game to compute."""
    low, count = shape
    sections = []
    for y in sorted(blocks):
        if not low <= y < low + count or not -128 <= y <= 127:
            raise ValueError(f"section {y} of chunk ({x}, {z}) is outside its shape")
        palette, indices = blocks[y]
        entries = []
        for state in palette:
            name, properties = c.parse_state(state)
            entry = [("Name", (c.STRING, name))]
            if properties:
                entry.append(("Properties", (c.COMPOUND, [(k, (c.STRING, v)) for k, v in properties.items()])))
            entries.append(entry)
        states = [("palette", (c.LIST, (c.COMPOUND, entries)))]
        if (data := packed(np.asarray(indices), len(palette), 4)) is not None:
            states.append(("data", (c.LONGS, data)))
        names, places = biomes.get(y, ([FILL_BIOME], np.zeros(c.BIOMES, np.uint16)))
        container = [("palette", (c.LIST, (c.STRING, list(names))))]
        if (data := packed(np.asarray(places), len(names), 1)) is not None:
            container.append(("data", (c.LONGS, data)))
        sections.append([("Y", (c.BYTE, y)), ("block_states", (c.COMPOUND, states)), ("biomes", (c.COMPOUND, container))])
    own = []
    for local_x, block_y, local_z, kind, nbt in entities:
        place = [("id", (c.STRING, kind)), ("x", (c.INT, x * 16 + local_x)), ("y", (c.INT, block_y)), ("z", (c.INT, z * 16 + local_z))]
        own.append(place + [e for e in nbt[1] if e[0] not in ("id", "x", "y", "z")])
    empty = (c.LIST, (c.END, []))
    return [
        ("DataVersion", (c.INT, data_version)), ("xPos", (c.INT, x)), ("yPos", (c.INT, low)), ("zPos", (c.INT, z)), ("Status", (c.STRING, "minecraft:full")),
        ("LastUpdate", (c.LONG, 0)), ("InhabitedTime", (c.LONG, 0)), ("isLightOn", (c.BYTE, 0)), ("sections", (c.LIST, (c.COMPOUND, sections))),
        ("block_entities", (c.LIST, (c.COMPOUND, own))), ("Heightmaps", (c.COMPOUND, [])), ("block_ticks", empty), ("fluid_ticks", empty), ("PostProcessing", empty),
        ("structures", (c.COMPOUND, [("starts", (c.COMPOUND, [])), ("References", (c.COMPOUND, []))])),
    ]


def region_bytes(frames: dict[int, bytes]) -> bytes:
    """A region file of compressed chunks by slot."""
    places, body, at = bytearray(SECTOR), [], HEADER
    for slot in sorted(frames):
        frame = struct.pack(">IB", len(frames[slot]) + 1, DEFLATE) + frames[slot]
        n = -(-len(frame) // SECTOR)
        if n > MOST_SECTORS:
            raise ValueError(f"slot {slot} needs {n} sectors")
        places[slot * 4 : slot * 4 + 4] = struct.pack(">I", at << 8 | n)
        body.append(frame.ljust(n * SECTOR, b"\0"))
        at += n
    return bytes(places) + bytes(SECTOR) + b"".join(body)


def region_files(selected: DataFrame, components: DataFrame, objects: DataFrame, namespace: str = c.NAMESPACE) -> DataFrame:
    """(file_name, chunks, content) of the selected observations (id, x, z) of one server and dimension.

    A task holds one region: 1024 chunks at most, each component decoded where it is used.
    """
    parts = selected.select("id", "x", "z").join(components.select("id", "name", "digest"), "id").join(objects.select("digest", "bytes"), "digest")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        frames: dict[int, bytes] = {}
        for (x, z), rows in pdf.groupby(["x", "z"], sort=True):
            shape, blocks, biomes, entities = None, {}, {}, []
            for name, raw in zip(rows["name"], rows["bytes"], strict=True):
                if name == "mcjava.shape":
                    shape = c.decode_shape(raw, namespace)
                elif name.startswith("mcjava.blocks."):
                    y, palette, indices = c.decode_blocks(raw, namespace)
                    blocks[y] = palette, indices
                elif name.startswith("mcjava.biomes."):
                    y, palette, indices = c.decode_biomes(raw, namespace)
                    biomes[y] = palette, indices
                elif name == "mcjava.block_entities":
                    entities = c.decode_block_entities(raw, namespace)
            if shape and blocks:
                frames[(int(x) & 31) + (int(z) & 31) * 32] = zlib.compress(named_nbt(chunk_nbt(int(x), int(z), shape, blocks, biomes, entities)))
        if not frames:
            return pd.DataFrame({"file_name": [], "chunks": [], "content": []})
        first = pdf.iloc[0]
        return pd.DataFrame({"file_name": [f"r.{int(first.x) >> 5}.{int(first.z) >> 5}.mca"], "chunks": [len(frames)], "content": [region_bytes(frames)]})

    return parts.groupBy(F.shiftright("x", 5), F.shiftright("z", 5)).applyInPandas(lambda pdf: build(pdf), "file_name string, chunks int, content binary")


def png(pixels: np.ndarray) -> bytes:
    """Rows of RGB as a PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def coverage_map(cells: DataFrame, scale: int = 1) -> bytes:
    """A PNG with a square for each cell by status; unknown ones are background. Only a map's cells reach the driver, and a side is bounded."""
    known = cells.where(F.col("status").isin(*COLOURS))
    b = known.agg(*(f(v).alias(f"{n}_{v}") for v in ("x", "z") for n, f in (("min", F.min), ("max", F.max)))).first()
    if b.min_x is None:
        return png(np.full((scale, scale, 3), BACKGROUND, np.uint8))
    w, h = b.max_x - b.min_x + 1, b.max_z - b.min_z + 1
    if max(w, h) * scale > MOST_PIXELS:
        raise ValueError(f"a map of {w} x {h} cells is too large at that scale")
    out = np.full((h, w, 3), BACKGROUND, np.uint8)
    names = list(COLOURS)
    code = F.array_position(F.array(*map(F.lit, names)), F.col("status")).cast("int")
    for r in known.groupBy("z").agg(F.collect_list("x").alias("x"), F.collect_list(code).alias("code")).toLocalIterator():  # a row of the map at a time
        out[r.z - b.min_z, np.array(r.x) - b.min_x] = np.array([BACKGROUND, *COLOURS.values()], np.uint8)[r.code]
    return png(out.repeat(scale, 0).repeat(scale, 1))


def write_files(files: DataFrame, folder: str) -> Iterator[str]:
    """Puts (file_name, content) rows one by one into a local folder of the driver; for few files."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in files.toLocalIterator():
        path = Path(folder) / r.file_name
        path.write_bytes(r.content)
        yield str(path)
