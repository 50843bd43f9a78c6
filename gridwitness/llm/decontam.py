"""Benchmark decontamination by templates.

Numbers, names and units of documents and benchmark items become typed placeholders; windows of the templates are
joined by hash; for each alignment (difference of positions) the values in the slots must map item value to document
value consistently. So an item is found as it is, and re-parameterised with other numbers or names.

Rules. Tokens are runs of no white space without the punctuation around them; tokens of punctuation alone go. A
token with a digit and no letter is <num>; a number with a unit joined, or a unit after a number, gives <unit>; a
capitalised token is <name>. All others are lower-cased. A capitalised token that begins a sentence may be a name or
any word: windows with such tokens are there twice, once with all of them as words and once with all as names, and an
alignment is judged in each of these two readings. Windows without them belong to both. Windows of placeholders alone, in either
reading, are no evidence and take no part: tables of numbers or lists of names meet nothing. An item is found in a
document if alignments with at least min_run consistent windows each (all, if the item has fewer) cover min_share of the item's
windows, or min_windows of them with all slots as in the item (nine of five tokens are thirteen tokens in a row). A window is consistent if none of its slots has, in that alignment, an item
value that meets two document values. An item's windows are those that are evidence; one without any is never found.

The benchmark's hashes go to all tasks as a Bloom filter of bounded size; what passes it is joined by hash, so a full filter costs
time only. Lists are gathered by alignment, and so are no longer than an item.

Defined cases. An item shorter than the window is one window of its length and must be met as such within
a document; items without tokens match nothing. Items equal in template and slots count as the one of smallest item_id; others, even of
equal templates, are each compared with their own values. Null texts match
nothing, very long ones are read whole. Repeated items count once, and different texts of one item_id are different items. A repeated document or doc_id is found
once. Null ids are reported as such. Empty tables give no rows. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE, bloom, maybe_in, stored, use, window_hashes

#: Window of template tokens.
WIDTH = 5
#: Bits of the Bloom filter: 16 for each benchmark window, as a power of two, and no more than 32 MB.
LEAST_BITS, MOST_BITS = 10, 28
#: Units of measure.
UNITS = frozenset("mm cm m km in ft yd mi miles mile meters metres meter metre kilometers kilometres inches feet g kg mg lb lbs oz grams kilograms pounds ounces l ml liters litres gallons s sec secs seconds second min mins minutes minute h hr hrs hours hour day days week weeks month months year years mph kmh km/h m/s usd eur gbp dollars dollar euros euro cents percent % degrees celsius fahrenheit w kw kwh v a hz khz mhz ghz b kb mb gb tb j kj cal kcal".split())

_PUNCTUATION = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"^[+-]?[\d.,:/]*\d[\d.,:/]*$")
_NUMBER_UNIT = re.compile(r"^([+-]?[\d.,]*\d)([^\W\d_]+|%)$")
_NUM, _NAME, _UNIT = (xxhash.xxh3_64_intdigest(x) for x in (b"<num>", b"<name>", b"<unit>"))
_SKIP, _PLAIN, _IS_NUM, _IS_NAME, _IS_UNIT, _NUM_UNIT = range(6)
_CODES = np.array([0, 0, _NUM, _NAME, _UNIT, 0], np.uint64)
_HASH = np.uint64(~15 % (1 << 64))


class _Tokens(dict):
    """raw token -> its hash, with the kind and whether it ends a sentence in the low bits."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        core = _PUNCTUATION.sub("", raw)
        percent = raw.rstrip(".,;:!?)").endswith("%")
        ends = raw.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
        if not core:
            kind = _IS_UNIT if percent else _SKIP
        elif _NUMBER_UNIT.match(core) or (percent and _NUMBER.match(core)):
            kind = _NUM_UNIT
        elif _NUMBER.match(core):
            kind = _IS_NUM
        elif core.lower() in UNITS:
            kind = _IS_UNIT
        elif core[0].isupper():
            kind = _IS_NAME
        else:
            kind = _PLAIN
        value = self[raw] = xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "surrogatepass")) & ~15 | kind << 1 | ends
        return value


_TOKENS = _Tokens()


class Template:
    """Of a text: hashes of the template's tokens, whether each is a slot, and where capitalised tokens begin sentences (words, here)."""

    __slots__ = ("hashes", "kinds", "openers", "slot", "sources", "words")

    def __init__(self, text: str | None) -> None:
        found = (text or "").split()
        codes = np.fromiter(map(use(_TOKENS).__getitem__, found), np.uint64, len(found))
        kinds, ends = ((codes >> np.uint64(1)) & np.uint64(7)).astype(np.int8), (codes & np.uint64(1)).astype(bool)
        # a token begins a sentence if the last one before it that ends one or isn't punctuation ends one
        last = np.maximum.accumulate(np.where((kinds != _SKIP) | ends, np.arange(1, len(found) + 1), 0))
        begins = np.concatenate(([True], ends))[np.concatenate(([0], last[:-1]))] if len(found) else np.empty(0, bool)
        there = np.flatnonzero(kinds != _SKIP)
        codes, kinds, begins = codes[there], kinds[there], begins[there]
        after_number = np.concatenate(([False], kinds[:-1] == _IS_NUM)) if len(there) else np.empty(0, bool)
        opener = (kinds == _IS_NAME) & begins
        literal = (kinds == _PLAIN) | opener | ((kinds == _IS_UNIT) & ~after_number)
        each = np.where(kinds == _NUM_UNIT, 2, 1)
        self.sources = np.repeat(np.arange(len(there)), each)
        own = kinds[self.sources]
        second = np.concatenate(([False], self.sources[1:] == self.sources[:-1])) if len(own) else np.empty(0, bool)
        own = np.where(own == _NUM_UNIT, np.where(second, _IS_UNIT, _IS_NUM), own)
        self.slot = ~literal[self.sources]
        self.hashes = np.where(self.slot, _CODES[own], codes[self.sources] & _HASH)
        self.openers = np.flatnonzero(opener[self.sources])
        self.kinds, self.words = own, (found, there)

    def value(self, pos: int) -> tuple[str, str]:
        """(kind, value) of the slot or opener at a position."""
        found, there = self.words
        raw = found[there[self.sources[pos]]]
        value = _PUNCTUATION.sub("", raw).lower()
        if _TOKENS[raw] >> 1 & 7 == _NUM_UNIT:
            parts = _NUMBER_UNIT.match(value)
            unit = self.kinds[pos] == _IS_UNIT
            return ("unit", parts[2] if parts else "%") if unit else ("num", parts[1] if parts else value)
        return {_IS_NUM: "num", _IS_NAME: "name", _IS_UNIT: "unit"}[int(self.kinds[pos])], value or "%"


#: Readings of a window, as bits: tokens that begin sentences are words, or are names.
_AS_WORDS, _AS_NAMES = 1, 2
_WINDOW = "hash bigint, id {kind}, pos bigint, readings int, slots array<struct<at:int,kind:string,value:string>>"


def _windows(widths: list[int], sent):
    """Windows of each row (id, text): of the widths, if the filter sent may hold them; of items, where none is sent, each of its own width."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent is not None else None
        for batch in rows:
            ids, places, out, readings, found_slots = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Template(text)
                n = len(t.hashes)
                sums = lambda flags: np.concatenate(([0], np.cumsum(flags)))  # noqa: E731, B023
                filled = sums(t.slot)
                if len(t.openers):
                    opens = np.zeros(n, bool)
                    opens[t.openers] = True
                    before, named = sums(opens), t.hashes.copy()
                    named[t.openers] = _NAME
                for width in [min(max(widths), n)] if sent is None else widths:
                    if not 0 < width <= n:
                        continue
                    slots = filled[width:] - filled[:-width]
                    both = before[width:] - before[:-width] if len(t.openers) else None
                    for reading in (_AS_WORDS, _AS_NAMES) if both is not None else (_AS_WORDS,):
                        h = window_hashes(t.hashes if reading == _AS_WORDS else named, width)
                        wanted = slots < width if reading == _AS_WORDS else (both > 0) & (slots + both < width)
                        at = np.flatnonzero(maybe_in(h, known) & wanted)
                        out.append(h[at].view(np.int64))
                        ids += [key] * len(at)
                        places.append(at)
                        for i in at.tolist():
                            own = [k for k in range(i, i + width) if t.slot[k] or (reading == _AS_NAMES and opens[k])]
                            found_slots.append([{"at": k - i, "kind": kind, "value": value} for k in own for kind, value in (t.value(k),)])
                        alone = both[at] > 0 if both is not None else np.zeros(len(at), bool)
                        readings.append(np.where(alone, reading, _AS_WORDS | _AS_NAMES).astype(np.int32))
            join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            slot = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(join(out), pa.int64()), pa.array(ids, batch.schema.field(0).type), pa.array(join(places), pa.int64()), pa.array(join(readings), pa.int32()), pa.array(found_slots, slot)], names=["hash", "id", "pos", "readings", "slots"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH, min_share: float = 0.5, min_windows: int = 9, min_run: int = 3) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, n_slots, n_changed, kind) of every document and item found in it."""
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    # Items are told apart by what they say, not by their ids: these may be repeated, shared or null.
    keyed = own.mapInArrow(_item_keys(width), f"key bigint, width int, id {kind}, text string")
    single = stored(keyed.groupBy("key", "width").agg(F.min("id").alias("item_id"), F.min("text").alias("text")), "items")
    cut = stored(single.select(F.col("key").alias("id"), "text").mapInArrow(_windows([width], None), _WINDOW.format(kind="bigint")), "item-windows")
    sizes = cut.groupBy("id").agg(F.count_distinct("pos").alias("n_windows"))
    # Short items have a narrower window; its width is told by what the window holds.
    windows = cut.join(sizes, "id").select("hash", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("readings").alias("item_readings"), "n_windows")
    widths = sorted(r.width for r in single.select("width").distinct().collect() if r.width)  # width values at most
    sent = spark.sparkContext.broadcast(bloom(cut, LEAST_BITS, MOST_BITS))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    met = source.mapInArrow(_windows(widths, sent), _WINDOW.format(kind=source.schema["id"].dataType.simpleString())).withColumnRenamed("id", "doc_id").distinct()
    pairs = met.join(windows, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    # Where an item has one token as a word and a document another as a name, the match counts in both readings.
    common = F.col("readings").bitwiseAND(F.col("item_readings"))
    readings = F.when(common == _AS_WORDS, F.array(F.lit(_AS_WORDS))).when(common == _AS_NAMES, F.array(F.lit(_AS_NAMES))).otherwise(F.array(F.lit(_AS_WORDS), F.lit(_AS_NAMES)))
    pairs = pairs.withColumn("reading", F.explode(readings))
    pairs = pairs.select("doc_id", "item", "shift", "reading", "item_pos", "n_windows", F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("s")).select(
        "doc_id", "item", "shift", "reading", "item_pos", "n_windows", F.col("s.item_slots.kind").alias("kind"), F.col("s.item_slots.value").alias("was"), F.col("s.slots.value").alias("value")
    )
    by_value = pairs.groupBy("doc_id", "item", "shift", "reading", "kind", "was").agg(F.max("n_windows").alias("n_windows"), F.collect_set("item_pos").alias("at"), F.count_distinct("value").alias("n_values"), F.max((F.col("was") != F.col("value")).cast("int")).alias("changed"))
    torn = F.when(F.col("n_values") > 1, F.col("at"))
    other = F.when((F.col("n_values") > 1) | (F.col("changed") == 1), F.col("at"))
    aligned = by_value.groupBy("doc_id", "item", "shift", "reading").agg(
        F.max("n_windows").alias("n_windows"), F.array_except(F.flatten(F.collect_list("at")), F.flatten(F.collect_list(other))).alias("same"),
        F.array_except(F.flatten(F.collect_list("at")), F.flatten(F.collect_list(torn))).alias("at"),
        F.count("was").alias("n_slots"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_changed"),
    )
    consistent = aligned.where(F.size("at") >= F.least(F.lit(min_run), F.col("n_windows")))
    # Windows count in whichever reading they are met; an alignment's slots are those of the reading that meets more.
    better = F.max_by(F.struct("n_slots", "n_changed"), F.struct(F.size("at"), -F.col("n_changed"), "n_slots"))
    one = consistent.groupBy("doc_id", "item", "shift").agg(F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("same"))).alias("same"), better.alias("better"))
    # A document may hold an item any number of times, so its windows are counted as rows.
    by_window = one.select("doc_id", "item", "n_windows", "better.*", F.explode("at").alias("pos"), "same").groupBy("doc_id", "item", "pos").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.min("n_changed").alias("n_changed"), F.bool_or(F.array_contains("same", F.col("pos"))).alias("same")
    )
    found = (
        by_window.groupBy("doc_id", "item")
        .agg(F.max("n_windows").cast("bigint").alias("item_windows"), F.count("*").alias("matched_windows"), F.count_if("same").alias("same_windows"), F.max("n_slots").alias("n_slots"), F.min("n_changed").alias("n_changed"))
        .where((F.col("matched_windows") >= F.col("item_windows") * F.lit(min_share)) | (F.col("same_windows") >= min_windows))
    )
    named = found.join(single.select(F.col("key").alias("item"), "item_id"), "item")
    return named.select("doc_id", "item_id", "matched_windows", "item_windows", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "re-parameterised").otherwise("as it is").alias("kind"))


def _item_keys(width: int):
    """(key, width, id, text) of each row (id, text): a hash of the template and its slots, openers' values among its words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, widths = [], []
            for text in batch.column(1).to_pylist():
                t = Template(text)
                values = [(int(k), *t.value(int(k))) for k in np.flatnonzero(t.slot)], t.openers.tolist()
                keys.append(xxhash.xxh3_64_intdigest(t.hashes.tobytes() + repr(values).encode("utf-8", "surrogatepass")) - (1 << 63))
                widths.append(min(width, len(t.hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(widths, pa.int32()), *batch.columns], names=["key", "width", "id", "text"])

    return run
