"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents and gaps are tables of runs: (length, first rank, number) of documents alike in length, (size, first sequence, number)
of gaps alike in size. A round puts both in order of size by a range partitioning, and a sweep goes down each range,
documents longest first: every run of documents takes its successor, the smallest gaps that hold it, as many side by side as fit.
Where several want one gap, those of higher rank (longer, then by rank within the length) have it and the others go on to the next
successor. What a range leaves over, documents without a gap and gaps without a document, is swept again across ranges. Then
gaps are updated, and while documents are left new sequences are opened, never more than must be: as many as the
volume left lacks, or as the longest documents left need that no two gaps can share. The rounds end with the documents.

As lengths are whole numbers up to the capacity there are at most so many runs of documents whatever the corpus holds, so a round's tables
are small; no single document takes part in them. The plan yields intervals of ranks; every document looks its own rank up in
them, in parallel. A document's rank among those of its length is a count by (length, bucket of its row) plus a running sum over the
buckets, so equal lengths, ids or rows are never one task's work.

Defined cases. A null text is empty and becomes its end token alone. Only documents longer than the
capacity are cut, into pieces of the capacity and a last one; a full piece is a sequence of its own. Very long texts are tokenised whole.
Repeated rows and null ids are packed each. Ties of length go by (id, piece, row). An empty table gives no rows. Other columns, whatever
their names, don't take part.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CACHE, stored, use

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1

#: Up to this code point, composing and lower-casing a text changes characters one by one; those that are lower-cased beyond it or into two are apart.
_SIMPLE = 0x2FF
#: Fixed value: the split that word tokenizers of this family make before they merge bytes.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(chars) -> str:
    return "".join(map(re.escape, chars))


def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What may not be tokenised word by word (characters that may compose, odd spaces, controls), and _SPLIT for the rest."""
    plain = [c for c in map(chr, range(_SIMPLE + 1)) if c in "\t\n\r " or (c.isprintable() and not c.isspace() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and ord(c.lower()) <= _SIMPLE)]
    letters, numbers = (_class(c for c in plain if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(f"[^{_class(plain)}]"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: its own if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(0x100)]


class WordIds(dict):
    """The ids of each lower-cased run without spaces, as little-endian 32-bit bytes; the pre-tokenizer never joins two runs."""

    def __init__(self, model, split: re.Pattern) -> None:
        self.model, self.split, self.letters = model, split, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        found: list[int] = []
        for part in self.split.findall(word):
            if not part.isascii():
                part = "".join([self.letters[b] for b in part.encode()])
            found += [token.id for token in self.model.tokenize(part)]
        value = self[word] = np.array(found, "<u4").tobytes()
        return value


def encoder(path: str = TOKENIZER) -> Callable[[str], bytes]:
    """text -> its ids as little-endian 32-bit bytes, equal to the tokenizer's own for the whole text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    odd, split = _patterns()
    by_word = WordIds(tokenizer.model, split)
    rules = json.loads(tokenizer.to_str())
    # Texts that hold one of the tokenizer's own strings, in whatever case, go through it whole.
    odd = re.compile("|".join([odd.pattern, *(f"(?i:{re.escape(x['content'])})" for x in rules["added_tokens"])]))
    # Runs are tokenised apart only under the rules that this shortcut is written for.
    steps = [x.get("pattern", {}).get("Regex", x["type"]) for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
    changes = [x.get("pattern", {}).get("Regex", x["type"]) for x in (rules["normalizer"] or {}).get("normalizers", [])]
    apart = steps == [_SPLIT, "ByteLevel"] and changes == ["NFC", r"\s+", "Lowercase"]

    def encode(text: str) -> bytes:
        if apart and not odd.search(text):
            return b"".join(map(use(by_word).__getitem__, text.lower().split()))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): what is to be packed; row tells repeated documents apart by (partition, place). with_ids adds ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:  # kept by the Python worker for its later tasks
            _ENCODERS[tokenizer] = encoder(tokenizer)
        encode = _ENCODERS[tokenizer]
        end = np.array([END], "<u4").tobytes()
        for batch in rows:
            out: list[tuple] = []
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(whole or "") + end)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    out.append((key, k, a // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array([x[5] for x in out], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


#: Kinds of rows in a round's table: gaps, documents, and documents placed. By kind, size is the gap's or the documents' and first the sequence's number or the rank.
GAP, DOCUMENT, PLACED = 0, 1, 2
RUNS = "kind int, size bigint, first bigint, many bigint, sequence bigint, side bigint, gap bigint"


def sweep(rows: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """One way down runs (kind, size, first, many) in order of falling size, gaps first: RUNS of what was placed, and of the gaps and documents left.

    The open gaps are a stack with the smallest on top, as no later document is longer; what is left of a gap that was used
    comes up again when the sweep reaches its size.
    """
    open_gaps: list[tuple[int, int, int]] = []
    used: list[tuple[int, int, int]] = []  # a heap by falling size
    shortest = 0
    for kind, size, first, many in rows:
        while used and -used[0][0] >= size:
            below, at, n = heappop(used)
            open_gaps.append((-below, at, n))
        if kind == GAP:
            open_gaps.append((size, first, many))
            continue
        while many and open_gaps:
            gap, at, n = open_gaps.pop()
            side = gap // size
            full = min(n, many // side)
            for gaps, beside in ((full, side), (1 if many - full * side and full < n else 0, many - full * side)):
                if not gaps:
                    continue
                yield PLACED, size, first, gaps * beside, at, beside, gap
                if left := gap - beside * size:
                    if left >= size:
                        open_gaps.append((left, at, gaps))
                    else:
                        heappush(used, (-left, at, gaps))
                first, many, at, n = first + gaps * beside, many - gaps * beside, at + gaps, n - gaps
            if n:
                if open_gaps and open_gaps[-1][0] < gap:  # what the last gap used has left is smaller
                    open_gaps.insert(-1, (gap, at, n))
                else:
                    open_gaps.append((gap, at, n))
        if many:
            shortest = size
            yield DOCUMENT, size, first, many, 0, 0, 0
    for gap, at, n in (*open_gaps, *((-size, at, n) for size, at, n in used)):
        if gap >= shortest:
            yield GAP, gap, at, n, 0, 0, 0


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    placed: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] == PLACED:
                    placed.append(row)
                else:
                    yield row[:4]

    found = [*sweep(rows()), *placed]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32() if i == 0 else pa.int64()) for i in range(7)], names=[f.split()[0] for f in RUNS.split(", ")])


def needed(left: list[tuple[int, int]], gaps: int, capacity: int) -> int:
    """Sequences to open for documents left (length, number), that fit no gap, beside that volume of gaps: no packing gets by with fewer."""
    if not left:
        return 0
    volume = sum(size * many for size, many in left) - gaps
    side = capacity // max(size for size, _ in left)
    widest = sum(many for size, many in left if capacity // size == side)
    return max(-(-volume // capacity), -(-widest // side))


def plan(lengths: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """PLACED rows for documents of each length (length, n), after as many rounds as it takes."""
    spark = lengths.sparkSession
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("sequence", "side", "gap")]
    state = lengths.select(F.lit(DOCUMENT).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("bigint").alias("first"), F.col("n").alias("many"), *zero)
    opened, made = 0, None
    while True:
        # One row for each length left, capacity at most, and one for the gaps.
        held = state.where(F.col("kind") != PLACED).groupBy("kind", F.when(F.col("kind") == DOCUMENT, F.col("size")).alias("size")).agg(F.sum("many").alias("many"), F.sum(F.col("size") * F.col("many")).alias("volume")).collect()
        more = needed([(r.size, r.many) for r in held if r.kind == DOCUMENT], sum(r.volume for r in held if r.kind == GAP), capacity)
        if not more:
            return made if made is not None else state.where("false")
        fresh = spark.range(1).select(F.lit(GAP).alias("kind"), F.lit(capacity).cast("bigint").alias("size"), F.lit(opened).cast("bigint").alias("first"), F.lit(more).cast("bigint").alias("many"), *zero)
        order = (F.desc("size"), F.asc("kind"), F.asc("first"))
        runs = state.where(F.col("kind") != PLACED).unionByName(fresh)
        by_range = runs.repartitionByRange(ranges, F.desc("size"), F.asc("kind")).sortWithinPartitions(*order).mapInArrow(_swept, RUNS)
        # Across ranges: what is left are runs, not documents, of each length one at most.
        state = stored(by_range.repartition(1).sortWithinPartitions(*order).mapInArrow(_swept, RUNS), "packing-round")
        placed = state.where(F.col("kind") == PLACED)
        made, opened = placed if made is None else made.unionByName(placed), opened + more


def pack(parts: DataFrame, capacity: int = 4096, bucket_rows: int = 4_000) -> DataFrame:
    """parts, as pieces() gives them, with sequence_id and offset."""
    parts = stored(parts.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    spark = parts.sparkSession
    lengths = stored(parts.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    columns = [c for c in parts.columns if c != "__row"]
    made = plan(lengths, capacity).select("size", "first", "sequence", "side", "gap").collect()
    rows = np.array(made, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = rows[:, 0] * (1 << 40) + rows[:, 1]
    sent = spark.sparkContext.broadcast((keys, rows))  # runs: their number is bounded by the capacity and the rounds, not by the documents
    total = lengths.agg(F.sum("n").alias("n")).first().n or 0
    buckets = max(1, -(-total // bucket_rows))
    bucketed = parts.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "__bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).alias("before"))
    local = bucketed.withColumn("__at", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "__row")) - 1)
    placed = local.join(before, ["length", "__bucket"]).select(*columns, (F.col("before") + F.col("__at")).alias("__rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            length, rank = get("length"), get("__rank")
            row = rows[np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1]
            k = rank - row[:, 1]
            keep = [batch.column(batch.schema.get_field_index(n)) for n in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 2] + k // row[:, 3]), pa.array(capacity - row[:, 4] + k % row[:, 3] * length)], names=[*columns, "sequence_id", "offset"])

    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    return placed.mapInArrow(look_up, ", ".join([*(f"{c} {types[c]}" for c in columns), "sequence_id bigint, offset bigint"]))


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs."""
    return pack(pieces(docs, text, doc_id, capacity, tokenizer), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


assert sys.byteorder == "little"
