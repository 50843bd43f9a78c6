"""Structure seeds that agree with evidence, and which shapes a capture holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, seeds
from ..functions.identity import NAMESPACE

#: Candidates listed, and the space that placements depend on.
LIMIT, SPACE = 1_000, 1 << 48
#: Fixed value: fewer observations leave many seeds that agree by chance.
TELLING = 3
#: Blocks that hold things, and the names under which payloads carry contents.
CONTAINERS = ("minecraft:chest", "minecraft:trapped_chest", "minecraft:barrel", "minecraft:furnace", "minecraft:hopper", "minecraft:dispenser", "minecraft:dropper", "minecraft:shulker_box")
CONTENTS = ("items", "item", "inventory", "contents")
#: The shapes that a capture is to hold.
SHAPES = (
    "a block entity whose payload has nested structure",
    "a container whose contents were not captured",
    "a block state with three or more properties",
    "a waterlogged block that is not water",
    "a mixed section at the bottom of the build range",
    "a mixed section at the top of the build range",
    "more than one biome in a chunk",
)


def search_seeds(spark: SparkSession, evidence: list[dict], first: int, last: int, operator: str, limit: int = LIMIT) -> tuple[DataFrame, dict]:
    """(candidates in ascending order, report) of the closed range of seeds. operator: who has accepted what recovering a seed means."""
    if not operator:
        raise PermissionError("recovering seeds needs a named operator who has accepted it")
    if last < first:
        raise ValueError("the range ends before it begins")
    if not evidence:
        raise ValueError("at least one observation is needed")
    limit = limit if limit > 0 else LIMIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[seeds.consistent(ids, evidence)])], names=["seed"])

    parts = max(1, min(10_000, (last - first + 1) // 1_000_000))
    found = spark.range(first, last + 1, 1, max(parts, spark.sparkContext.defaultParallelism)).mapInArrow(run, "seed bigint").orderBy("seed").limit(limit + 1)
    rows = [r.seed for r in found.collect()]
    scanned, shown = last - first + 1, rows[:limit]
    report = {"operator": operator, "scanned": scanned, "fraction": min(1.0, scanned / SPACE), "truncated": len(rows) > limit, "candidates": len(shown)}
    return spark.createDataFrame([(s,) for s in shown], "seed bigint"), report | {"caveats": caveats(report, len(evidence))}


def caveats(report: dict, observations: int) -> dict[str, float]:
    """What limits a search's result, by code with the figure that tells how much; worded where it is shown."""
    figures = {
        "ambiguous": report["candidates"] if report["candidates"] > 1 else None,
        "few_observations": observations if observations < TELLING else None,
        "partial_space": report["fraction"] if report["fraction"] < 1 else None,
        "seed_bits": SPACE.bit_length() - 1,
        "truncated": report["candidates"] if report["truncated"] else None,
    }
    return {code: figure for code, figure in figures.items() if figure is not None}


def worded(code: str, figure: float) -> str:
    """A caveat for a reader: the code's words and the figure."""
    return f"{code.replace('_', ' ')}: {figure:.4g}"


def full_scan_seconds(elapsed: float, scanned: int) -> float:
    """How long the whole space would take at that rate; 0 scanned gives infinity."""
    return float("inf") if scanned <= 0 else elapsed / scanned * SPACE


def decoded(components: DataFrame, objects: DataFrame, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shapes, blocks, biomes, entities) of the components (id, name, digest) by their objects (digest, bytes); what doesn't decode is left out.

    Each object is decoded once, however many observations refer to it.
    """
    kind = F.when(F.col("name") == "mcjava.shape", "shape").when(F.col("name").startswith("mcjava.blocks."), "blocks").when(F.col("name").startswith("mcjava.biomes."), "biomes").when(F.col("name") == "mcjava.block_entities", "entities")
    named = components.select("id", "name", "digest", kind.alias("kind")).where("kind IS NOT NULL")
    bodies = named.select("digest", "kind").distinct().join(objects.select("digest", "bytes"), "digest")
    out = []
    for name, column in (("shape", codec.shape_column), ("blocks", codec.blocks_column), ("biomes", codec.biomes_column), ("entities", codec.entities_column)):
        own = bodies.where(F.col("kind") == name).select("digest", column("bytes", namespace).alias("v"))
        own = own.where("v IS NOT NULL") if name == "entities" else own.where("v.min_section_y IS NOT NULL" if name == "shape" else "v.section_y IS NOT NULL")
        out.append(named.where(F.col("kind") == name).select("id", "name", "digest").join(own, "digest"))
    return tuple(out)


def required_shapes(components: DataFrame, objects: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(shape, present) for each of SHAPES over all observations. Predicates are on palettes, never on positions."""
    shapes, blocks, biomes, entities = decoded(components, objects, namespace)
    states = blocks.select("id", "v.section_y", F.size("v.palette").alias("n"), F.explode("v.palette").alias("state"))
    properties = F.size(F.split("state", ",")) - 1
    per_state = states.agg(
        F.bool_or(F.col("state").contains("[") & (properties >= 2)).alias("p"),
        F.bool_or(F.col("state").contains("waterlogged=true") & ~F.col("state").startswith("minecraft:water")).alias("w"),
        F.bool_or(F.col("state").rlike("^(" + "|".join(CONTAINERS) + ")")).alias("c"),
    )
    ends = shapes.select("id", F.col("v.min_section_y").alias("low"), (F.col("v.min_section_y") + F.col("v.section_count") - 1).alias("high"))
    mixed = blocks.select("id", "v.section_y", F.size("v.palette").alias("n")).join(ends, "id").where("n >= 2").agg(F.bool_or(F.col("section_y") == F.col("low")).alias("b"), F.bool_or(F.col("section_y") == F.col("high")).alias("t"))
    several = biomes.agg(F.bool_or(F.size("v.palette") > 1).alias("m"))
    e = entities.select(F.explode("v").alias("e")).agg(F.bool_or("e.nested").alias("nested"), F.bool_or(F.exists("e.fields", lambda f: F.lower(f).isin(*CONTENTS))).alias("seen"))
    one = per_state.join(mixed).join(several).join(e)  # single rows
    no = F.lit(False)
    flags = [F.col("nested"), F.coalesce("c", no) & ~F.coalesce("seen", no), F.col("p"), F.col("w"), F.col("b"), F.col("t"), F.col("m")]
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("shape"), F.coalesce(flag, no).alias("present")) for name, flag in zip(SHAPES, flags, strict=True)))).alias("r")).select("r.*")
