"""Components described in a few words, for tests and examples: a state everywhere, numbered names, or names in turn."""

from __future__ import annotations

from itertools import cycle, islice

from . import codec


def states(spec: dict, positions: int = codec.BLOCKS) -> list[str]:
    """The states of a section by {"constant": state}, {"numbered": prefix, "width": digits} or {"in_turn": [states]}."""
    if set(spec) == {"constant"}:
        return [spec["constant"]] * positions
    if set(spec) == {"numbered", "width"} and 1 <= spec["width"] <= 9:
        return [f"{spec['numbered']}{i:0{spec['width']}d}" for i in range(positions)]
    if set(spec) == {"in_turn"} and spec["in_turn"]:
        return list(islice(cycle(spec["in_turn"]), positions))
    raise ValueError(f"no description of states: {spec}")


def component(kind: str, spec: dict, namespace: str = codec.NAMESPACE) -> bytes:
    """The bytes of a shape {min_section_y, section_count}, a block_section or biome_section {section_y, and as states() takes it}, or block_entities {entries}."""
    if kind == "shape":
        return codec.encode_shape(spec["min_section_y"], spec["section_count"], namespace)
    if kind == "block_entities":
        return codec.encode_block_entities(spec["entries"], namespace)
    own = {k: v for k, v in spec.items() if k != "section_y"}
    if kind == "block_section":
        return codec.encode_blocks(spec["section_y"], states(own), namespace)
    if kind == "biome_section":
        return codec.encode_biomes(spec["section_y"], states(own, codec.BIOMES), namespace)
    raise ValueError(f"no component {kind!r}")
