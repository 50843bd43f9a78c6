"""Fitting decoded cells to a target release: lookups by palette entry, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands in where a policy fills, and what is done where nothing fits.
FILL_BLOCK, FILL_BIOME = "minecraft:air", "minecraft:the_void"
POLICIES = ("report", "skip-chunk", "fill")


def palette_counts(sections: DataFrame) -> DataFrame:
    """(section columns but palette and indices, source, positions): of each palette entry how many positions have it."""
    own = [c for c in sections.columns if c not in ("palette", "indices")]
    counted = sections.select(*own, "palette", F.explode("indices").alias("i")).groupBy(*own, "palette", "i").agg(F.count("*").alias("positions"))
    return counted.select(*own, F.get("palette", F.col("i")).alias("source"), "positions")


def resolve_states(states: DataFrame, target: DataFrame, rules: DataFrame, policy: str = "skip-chunk", filler: str = FILL_BLOCK) -> DataFrame:
    """states (source) with outcome and mapped state.

    target: (name); rules: (kind, source, target, keep_properties), kind `rename` or `substitution`. In order: a name of the
    target stays; a rename to one of its names keeps properties; a substitution drops them unless told to keep; else the policy.
    Rules and registries are dimension tables; their joins are on the block's name.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    name = F.regexp_extract("source", r"^([^\[]+)", 1)
    rest = F.regexp_extract("source", r"(\[.*\])$", 1)
    known = lambda c: target.select(F.col("name").alias(c)).distinct()
    rule = lambda kind, p: rules.where(F.col("kind") == kind).select(F.col("source").alias("__name"), F.col("target").alias(f"{p}_target"), F.col("keep_properties").alias(f"{p}_keep"))
    rename = rule("rename", "ren").join(known("ren_target"), "ren_target", "left_semi")
    substitution = rule("substitution", "sub").join(known("sub_target"), "sub_target", "left_semi")
    joined = (
        states.withColumn("__name", name).join(known("__known").withColumn("__name", F.col("__known")), "__name", "left")
        .join(rename, "__name", "left").join(substitution, "__name", "left")
    )
    last = {"report": "unrepresentable", "skip-chunk": "skipped", "fill": "filled"}[policy]
    outcome = F.when(F.col("__known").isNotNull(), "unchanged").when(F.col("ren_target").isNotNull(), "renamed").when(F.col("sub_target").isNotNull(), "substituted").otherwise(last)
    mapped = (
        F.when(F.col("__known").isNotNull(), F.col("source")).when(F.col("ren_target").isNotNull(), F.concat("ren_target", rest))
        .when(F.col("sub_target").isNotNull(), F.concat("sub_target", F.when(F.coalesce("sub_keep", F.lit(False)), rest).otherwise("")))
        .otherwise(F.lit(filler) if policy == "fill" else F.lit(None))
    )
    return joined.select(*states.columns, outcome.alias("outcome"), mapped.alias("target"))


def translation_report(counted: DataFrame) -> DataFrame:
    """Of each source its outcome, target and positions, unchanged ones left out; the most positions first."""
    found = counted.where("outcome <> 'unchanged'").groupBy("source").agg(F.max("outcome").alias("outcome"), F.max("target").alias("target"), F.sum("positions").alias("positions"))
    return found.orderBy(F.desc("positions"), "source")


def rebuilt_palette(sections: DataFrame, mapping: DataFrame) -> DataFrame:
    """sections (keys, palette, indices) with each palette entry mapped, sorted anew and the indices following. mapping: (source, target).

    The palette is exploded and mapped by a join, the indices are looked up in it; a section with an entry that maps to nothing is left out.
    """
    keys = [c for c in sections.columns if c not in ("palette", "indices")]
    entries = sections.select(*keys, F.posexplode("palette").alias("pos", "source")).join(mapping.select("source", "target"), "source", "left")
    mapped = entries.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda e: e["target"]).alias("mapped"))
    joined = sections.join(mapped, keys).where(~F.exists("mapped", lambda t: t.isNull())).withColumn("fresh", F.array_sort(F.array_distinct("mapped")))
    places = F.transform("mapped", lambda t: (F.array_position(F.col("fresh"), t) - 1).cast("int"))
    return joined.withColumn("__places", places).select(*keys, F.col("fresh").alias("palette"), F.transform("indices", lambda i: F.get(F.col("__places"), i)).alias("indices"))


def translate_chunks(sections: DataFrame, target: DataFrame, rules: DataFrame, min_section_y: int, section_count: int, policy: str = "skip-chunk") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(translated sections, report, dropped) of sections (chunk, section_y, palette, indices).

    Sections beyond the target's range are dropped and counted; under skip-chunk a chunk with a state that can't be shown is left
    out whole; under report the report tells, and nothing may be written if it names one.
    """
    inside = F.col("section_y").between(min_section_y, min_section_y + section_count - 1)
    dropped = sections.where(~inside).groupBy("chunk").agg(F.count("*").alias("dropped_sections"))
    kept = sections.where(inside)
    resolved = resolve_states(kept.select(F.explode("palette").alias("source")).distinct(), target, rules, policy).checkpoint()
    counted = palette_counts(kept).join(resolved, "source")
    if policy == "skip-chunk":
        refused = kept.select("chunk", F.explode("palette").alias("source")).join(resolved.where("outcome = 'skipped'"), "source", "left_semi").select("chunk").distinct()
        kept = kept.join(refused, "chunk", "left_anti")
    return rebuilt_palette(kept, resolved.select("source", "target")), translation_report(counted), dropped


def translate_for_target(sections: DataFrame, entries: DataFrame, rules: DataFrame, dimension: dict, policy: str = "skip-chunk") -> tuple[DataFrame, DataFrame, DataFrame]:
    """translate_chunks() to a release's entries (kind, name) and one of its dimensions {min_section_y, section_count}.

    Under the report policy nothing at all comes out if a state can't be shown or a section has no place: the error says how many.
    """
    target = entries.where("kind = 'block'").select("name")
    if entries.where("kind = 'block'").isEmpty():
        raise ValueError("the target has no blocks")
    out, report, dropped = translate_chunks(sections, target, rules, dimension["min_section_y"], dimension["section_count"], policy)
    if policy == "report":
        lost = report.where("outcome = 'unrepresentable'").agg(F.count("*").alias("states"), F.coalesce(F.sum("positions"), F.lit(0)).alias("positions")).first()
        places = dropped.agg(F.coalesce(F.sum("dropped_sections"), F.lit(0)).alias("n")).first().n
        if lost.states or places:
            raise ValueError(f"nothing is translated: {lost.states} states at {lost.positions} positions can't be shown, {places} sections have no place")
    return out, report, dropped


def profile_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, change) between two releases' entries (kind, name, value): added, removed, changed or narrowed ones.

    Of dimensions, value is `min:count`; one whose range lies within the old one's and isn't equal to it is narrowed.
    """
    joined = before.select("kind", "name", F.col("value").alias("old")).join(after.select("kind", "name", F.col("value").alias("new")), ["kind", "name"], "full")
    part = lambda c, i: F.split(F.col(c), ":")[i].cast("bigint")
    low, high = (lambda c: part(c, 0)), (lambda c: part(c, 0) + part(c, 1))
    narrowed = (F.col("kind") == "dimension") & ((low("new") > low("old")) | (high("new") < high("old")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), None).when(narrowed, "narrowed").otherwise("changed")
    return joined.select("kind", "name", change.alias("change")).where("change IS NOT NULL")


def touches_existing(delta: DataFrame) -> DataFrame:
    """One row: whether archives made before are affected. Removals, narrowed ranges and other placements are; additions aren't."""
    hit = (F.col("change").isin("removed", "narrowed")) | ((F.col("kind") == "structure_set") & (F.col("change") == "changed"))
    return delta.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("affected"), F.count("*").alias("changes"))
