"""N-gram Jaccard join, exact at any group size: block signatures and sketches find candidates, prefix trees verify them.

Every set of n-grams is put in one global order (of 64-bit hashes) and cut at fixed places of that order into
blocks, whose hashes are a set's labels. Two sets with similarity t or more and at most M
n-grams each differ in at most d = 2M(1-t)/(1+t) n-grams, so of more than d blocks at least one is equal in both:
sets meet under equal labels, and only there. Sizes fall in bands, each with its own number of blocks; a set that
may have a partner in the next band is labelled for that too. Blocks without n-grams don't
count, unless a set has so few others that its partner might share no other one.

Where sets meet, one of them (the pivot: the one that shares most labels, so the text that others are copies of) is compared to
all others; sets that link form classes. Where a label still holds several classes among sets that were not pivots, another
pivot follows, and then all pairs of bounded blocks of its members. So every link is either found or lies inside a class, and no
group is ever gathered in one task. Comparing is done in two steps. First by sizes and by parity sketches (a bit of
a sketch is whether an even or odd number of n-grams fall on it, so two sketches differ in no more bits than the sets
in n-grams; pairs that differ in more than d bits can't link). Sketches are made with the labels; n-grams are taken from the texts again, of what is left alone. This is verified: the sets asked about are put in a prefix tree in
blocks of bounded size, which the other sets' n-grams traverse. The overlap found along an edge holds for all sets below
it, and a subtree is left when what remains of the query and of the longest set below can't reach the overlap that the shortest needs.

Defined cases. The set of a text with fewer than width words is its whole sequence as one n-gram; a null
text or one without words has none, links with nothing and is its own class. Equal sets are one node from the
start, however many copies there are. Rows that share a doc_id are separate texts with one id. Null ids are passed
over when a class takes its smallest id; a class without any other has null. Very long texts are read whole. Of sets that share equally many
labels the one of larger key is the pivot. An empty table gives no rows. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, forget, maybe_in, mixed, scratch, shared_path, stored, window_hashes, word_hashes, words

#: Sets in one prefix tree, and sketches that a task compares with as many others; both also by bytes, so that a task holds no more of long sets.
TREE, SKETCHES = 256, 2_048
TREE_BYTES, SKETCH_BYTES = 1 << 25, 1 << 24
#: Shares of the labels that are dealt out one after the other, and bytes kept of a label: should two labels be equal in these alone, that costs a comparison.
LABEL_SHARES, LABEL_BYTES = 8, 6
_SHARE_NAMES = [f"labels{k}" for k in range(LABEL_SHARES)]
#: Rounds with one pivot a label; after these, bounded blocks of its members are compared pair by pair.
PIVOT_ROUNDS = 2
#: Keys a task remembers so as not to label copies again.
_SEEN = 500_000


def gram_set(text: str | None, width: int = 4) -> np.ndarray:
    return np.unique(window_hashes(word_hashes(words(text)), width))


def set_key(grams: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed halves of a 128-bit hash: the key that stands for a set, and what tells two sets of one key apart."""
    whole = xxhash.xxh3_128_intdigest(grams.tobytes(), seed)
    return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)


@lru_cache
def bands(percent: int, top: int = 1 << 34) -> list[tuple[int, int, int]]:
    """(least size, most differences, blocks) of each band of sizes in which sets may link with others than equal ones."""
    found = []
    low = -(-percent // (100 - percent)) if percent < 100 else top
    while low < top:
        high = max(low + 1, -(-low * 10_000 // percent**2))
        most = 2 * (high - 1) * (100 - percent) // (100 + percent)
        n, m = max(1, low * percent // 100), most + 2
        while m < 8 * n:
            a = n / m
            mean, var = m * -math.expm1(n * math.log1p(-1 / m)), m * math.exp(-a) * (1 - (1 + a) * math.exp(-a))
            if mean - 4 * math.sqrt(max(var, 0)) >= most + 1:
                break
            m += 1 + m // 64
        found.append((low, most, m))
        low = high
    return found


def labels(grams: np.ndarray, percent: int) -> np.ndarray:
    """The labels under which a set meets all those it may link with."""
    table = bands(percent)
    n = len(grams)
    if not n or not table or n < table[0][0] * percent // 100:
        return np.empty(0, np.uint64)
    own = max(0, int(np.searchsorted([b[0] for b in table], n, side="right")) - 1)
    out = []
    scattered = mixed(grams + np.uint64(0x632BE59BD9B4E019))
    for band in (own, own + 1):
        if band > own and (band >= len(table) or n * 100 // percent < table[band][0]):
            break
        _, most, m = table[band]
        block = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        ids, sums = block[starts], np.add.reduceat(scattered, starts)
        if len(ids) <= most:  # a partner may share empty blocks only
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)
            ids, sums = np.concatenate((ids, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
        out.append(mixed(sums + ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64))))
    return np.concatenate(out)


def packed(found: np.ndarray) -> list[bytes]:
    """Labels, cut to LABEL_BYTES, in LABEL_SHARES strings: equal ones are in the same share."""
    short = found >> np.uint64(64 - 8 * LABEL_BYTES)
    share = short % np.uint64(LABEL_SHARES)
    narrow = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LABEL_BYTES]
    return [narrow[share == k].tobytes() for k in range(LABEL_SHARES)]


def _unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, labels of a share): each (label, key)."""
    for batch in rows:
        held = batch.column(1).to_pylist()
        narrow = np.frombuffer(b"".join(held), np.uint8).reshape(-1, LABEL_BYTES)
        label = np.zeros((len(narrow), 8), np.uint8)
        label[:, :LABEL_BYTES] = narrow
        keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // LABEL_BYTES for x in held])
        made = pa.RecordBatch.from_arrays([pa.array(label.view("<i8").ravel()), pa.array(keys, pa.int64())], names=["label", "key"])
        for at in range(0, len(keys), 1 << 15):  # what the JVM holds of it at a time
            yield made.slice(at, 1 << 15)


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


class SetTrie:
    """A prefix tree of sorted sets with unary paths joined into one edge."""

    __slots__ = ("edge", "ends", "below", "least", "most")

    def __init__(self, sets: list[tuple[np.ndarray, object]], depth: int = 0) -> None:
        """sets: in lexicographic order, all with the same first depth members."""
        first, last = sets[0][0], sets[-1][0]
        room = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:room] != last[depth:room])
        end = depth + int(differ[0]) if len(differ) else room
        self.edge = first[depth:end]
        self.least, self.most = min(len(s) for s, _ in sets), max(len(s) for s, _ in sets)
        self.ends = [x for s, x in sets if len(s) == end]
        self.below: list[SetTrie] = []
        a = len(self.ends)
        while a < len(sets):
            b = a + 1
            while b < len(sets) and sets[b][0][end] == sets[a][0][end]:
                b += 1
            self.below.append(SetTrie(sets[a:b], end))
            a = b

    @staticmethod
    def of(sets: list[tuple[np.ndarray, object]]) -> SetTrie | None:
        # big-endian bytes sort as the sequences do
        return SetTrie(sorted(sets, key=lambda s: s[0].astype(">u8").tobytes())) if sets else None

    def links(self, query: np.ndarray, percent: int) -> Iterator[object]:
        """What was stored with each set that links with the query."""
        n, stack = len(query), [(self, 0, 0, 0)]
        while stack:
            node, depth, at, overlap = stack.pop()
            if len(node.edge):
                places = np.searchsorted(query[at:], node.edge)
                there = places < n - at
                overlap += int(np.count_nonzero(query[at:][places[there]] == node.edge[there]))
                at += int(np.searchsorted(query[at:], node.edge[-1], side="right"))
                depth += len(node.edge)
            for x in node.ends:
                if linked(overlap, n, depth, percent):
                    yield x
            for child in node.below:
                # the most that can still be shared, for the shortest set below
                if linked(min(overlap + min(n - at, child.most - depth), n, child.most), n, child.least, percent):
                    stack.append((child, depth, at, overlap))


def _sets_and_labels(percent: int, width: int, seed: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows:
            sizes, keys, others, sketches, marks = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = gram_set(text, width)
                key, other = set_key(grams, seed) if len(grams) else (None, None)
                sizes.append(len(grams))
                keys.append(key)
                others.append(other)
                found = ()
                if key is not None and key not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    found = labels(grams, percent)
                sketches.append(sketch(grams).tobytes() if len(found) else None)
                marks.append(packed(found) if len(found) else [None] * LABEL_SHARES)
            shares = [pa.array([m[k] for m in marks], pa.binary()) for k in range(LABEL_SHARES)]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, keys, others)), pa.array(sketches, pa.binary()), *shares]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "other", "sketch", *_SHARE_NAMES])

    return run


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (label, key) sorted by both: those of labels with several keys, each once."""
    held: tuple | None = None  # the last row, and whether the one before has the same label
    for batch in rows:
        label, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(label):
            continue
        if held:
            label, key = np.concatenate(([held[0]], label)), np.concatenate(([held[1]], key))
        new = np.concatenate(([True], (label[1:] != label[:-1]) | (key[1:] != key[:-1])))
        label, key = label[new], key[new]
        again = np.concatenate(([bool(held and held[2])], label[1:] == label[:-1]))
        more = again | np.concatenate((again[1:], [False]))
        more[-1] = False
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(label[more]), pa.array(key[more])], names=["label", "key"])
        held = (label[-1], key[-1], bool(again[-1]))
    if held and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:2]], names=["label", "key"])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams on the bits of a power of two of at least four times their number, in 64-bit words: so few differences fall on one bit and cancel out."""
    bits = max(128, 4 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(words_: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set on fewer bits: both are taken by the hashes' low bits."""
    while len(words_) > size:
        words_ = words_[: len(words_) // 2] ^ words_[len(words_) // 2 :]
    return words_


def may_link(asking: list[np.ndarray], asked: list[np.ndarray], n_asking: np.ndarray, n_asked: np.ndarray, percent: int) -> np.ndarray:
    """Of each pair whether sizes and sketches allow a link."""
    size = min(min(map(len, asking)), min(map(len, asked)))
    a, b = (np.stack([folded(w, size) for w in side]) for side in (asking, asked))
    fit = 100 * np.minimum(n_asking[:, None], n_asked[None, :]) >= percent * np.maximum(n_asking[:, None], n_asked[None, :])
    for at in range(0, len(a), 256):  # bounds what is held at a time
        rows = slice(at, at + 256)
        apart = np.zeros((len(a[rows]), len(b)), np.int32)
        for k in range(size):
            apart += np.bitwise_count(a[rows, k, None] ^ b[None, :, k])
        fit[rows] &= (100 + percent) * apart <= (100 - percent) * (n_asking[rows, None] + n_asked[None, :])
    return fit


def _grams_of(width: int, seed: int, sent):
    """Of rows (text, hash of an id): (key, grams) of each set once, if the two filters sent may hold the id and the key."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = sent.value
        seen: set[int] = set()
        for batch in rows:
            held = batch.column(0).filter(pa.array(maybe_in(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), ids)))
            keys, found = [], []
            for text in held.to_pylist():
                grams = gram_set(text, width)
                key = set_key(grams, seed)[0] if len(grams) else None
                if key is None or key in seen or not maybe_in(np.array([key], np.int64).view(np.uint64), wanted)[0]:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                found.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["key", "grams"])

    return run


def _grams(keys: DataFrame, noted: DataFrame, source: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, grams) of some sets, from a text of each. Bloom filters tell, of these texts' ids and of the keys; few others come along, and nothing asks for those.

    No text leaves its task, and no task has two Python workers: an executor keeps all that it ever had at a time, with what they hold.
    """
    spark = source.sparkSession
    holders = stored(noted.select("key", "doc_id").join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("__id")), "holders")
    sent = spark.sparkContext.broadcast((bloom(holders.select(F.xxhash64("__id").alias("hash"))), bloom(holders.select(F.col("key").alias("hash")))))
    grams = stored(source.select("text", F.xxhash64("doc_id").alias("hash")).mapInArrow(_grams_of(width, seed, sent), "key bigint, grams binary"), "grams")
    sent.destroy()
    return grams


def _grouped(rows: Iterator[pa.RecordBatch], columns: int) -> Iterator[Iterator[tuple]]:
    """The rows of one (group, block) after the other, without these two, as they come."""
    each = (row for batch in rows for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True))
    for _, members in groupby(each, key=lambda row: row[:2]):
        yield (row[2:] for row in members)


def _each_once(members: Iterator[tuple]) -> Iterator[tuple]:
    """members (role, key, ...) without repeated ones: rows that share an id and a text may each have given its set."""
    met: set[tuple] = set()
    for m in members:
        if m[:2] not in met:
            met.add(m[:2])
            yield m


def _in_parts(members: Iterator[tuple], column: int, most: int) -> Iterator[list[tuple]]:
    """members in lists of about so many bytes in a column."""
    held, size = [], 0
    for m in members:
        held.append(m)
        size += len(m[column])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sketch_pairs(percent: int):
    """Of rows (group, block, role, key, class, n, sketch) sorted by group, block and falling role: pairs of different classes that may link, role 1 or 2 with 0 or 2."""

    def pack(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "pivot"])

    column = lambda side, i: np.array([m[i] for m in side], np.int64)
    bits = lambda side: [np.frombuffer(m[4], np.uint64) for m in side]

    def met(asking: list[tuple], asked: list[tuple]) -> np.ndarray:
        ok = may_link(bits(asking), bits(asked), column(asking, 3), column(asked, 3), percent) & (column(asking, 2)[:, None] != column(asked, 2)[None, :])
        i, j = np.nonzero(ok)
        a, b = column(asking, 1)[i], column(asked, 1)[j]
        return np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for members in _grouped(rows, 7):
            asking: list[tuple] = []  # a pivot, or the members of a block, which is bounded by bytes
            rest: Iterator[tuple] = iter(())
            for m in members:
                if m[0] == 0:
                    rest = chain((m,), members)
                    break
                asking.append(m)
            if not asking:
                continue
            both = [m for m in asking if m[0] == 2]
            for asked in chain([both] if both else [], _in_parts(rest, 4, SKETCH_BYTES)):
                out.append(met(asking, asked))
                if len(out) >= 1_000 or len(out[-1]) > 100_000:
                    yield pack(out)
                    out = []
        yield pack(out)

    return run


def _tree_links(percent: int):
    """Of rows (group, block, role, key, grams) sorted by group, block and falling role: links between its queries (role 1) and its other sets, put in one tree after the other."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        for members in _grouped(rows, 5):
            members = _each_once(members)
            queries: list[tuple[int, np.ndarray]] = []
            rest: Iterator[tuple] = iter(())
            for m in members:
                if m[0] == 0:
                    rest = chain((m,), members)
                    break
                queries.append((m[1], np.frombuffer(m[2], np.uint64)))
            for sets in _in_parts(rest, 2, TREE_BYTES):
                tree = SetTrie.of([(np.frombuffer(grams, np.uint64), key) for _, key, grams in sets])
                for key, grams in queries:
                    out += [(key, other) for other in tree.links(grams, percent)]
            if len(out) >= 10_000:
                yield pack()
                out = []
        yield pack()

    return run


def _candidates(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (key, pivot) that may link. tasks: (group, block, role, key, class); role 1 asks, 0 is asked, 2 does both."""
    rows = tasks.join(sets.select("key", "n", "sketch"), "key").select("group", "block", "role", "key", "class", "n", "sketch")
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", F.desc("role")).mapInArrow(_sketch_pairs(percent), "key bigint, pivot bigint").distinct()


def _links(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, pivot) that link; grams: (key, grams) of their sets. Each pivot's n-grams traverse trees of about TREE of its sets."""
    tasks = _pivot_tasks(pairs.select("key", F.lit(0).cast("bigint").alias("class"), "pivot", F.lit(0).cast("bigint").alias("pivot_class")), TREE).drop("class")
    rows = tasks.join(grams, "key").select("group", "block", "role", "key", "grams")
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", F.desc("role")).mapInArrow(_tree_links(percent), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): each takes its smallest neighbour, edges move along, until none is left."""
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    roots = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "parents")
        if roots is None:
            roots = parent
        else:
            step = parent.select(F.col("node").alias("at"), F.col("root").alias("to"))
            roots = roots.join(step, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return stored(roots, "roots")


def _pivot_tasks(pairs: DataFrame, size: int) -> DataFrame:
    """pairs: distinct (key, class, pivot, pivot_class). Each pivot asks its sets in blocks of about size."""
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(size)).alias("blocks"))
    dealt = pairs.join(many, "pivot").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    asked = dealt.select(F.col("pivot").alias("group"), "block", F.lit(0).alias("role"), "key", "class")
    asking = dealt.select(F.col("pivot").alias("group"), "block", F.lit(1).alias("role"), F.col("pivot").alias("key"), F.col("pivot_class").alias("class")).distinct()
    return asked.union(asking)


def _block_tasks(members: DataFrame, size: int) -> DataFrame:
    """members: (label, key, class, n). All pairs of blocks, of about size and of bounded bytes, of a label's members."""
    share = F.lit(1.0) + F.col("n") * F.lit(size / SKETCH_BYTES)  # a sketch has at most a byte for each n-gram
    many = members.groupBy("label").agg(F.ceil(F.sum(share) / F.lit(size)).alias("blocks"))
    dealt = members.join(many, "label").withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")))
    pair = lambda i, j: i * F.lit(1 << 31) + j
    own = dealt.select(F.col("label").alias("group"), pair(F.col("i"), F.col("i")).alias("block"), F.lit(2).alias("role"), "key", "class")
    some = dealt.where("blocks > 1").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("i <> j")
    other = some.select(F.col("label").alias("group"), F.when(F.col("i") < F.col("j"), pair(F.col("i"), F.col("j"))).otherwise(pair(F.col("j"), F.col("i"))).alias("block"), F.when(F.col("i") < F.col("j"), 1).otherwise(0).alias("role"), "key", "class")
    return own.union(other)


def _once(met: DataFrame) -> DataFrame:
    """(label, key) without labels whose members another label has as well: copies of a text share many blocks, which say the same."""
    members = met.groupBy("label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    kept = members.groupBy("n", "a", "b").agg(F.min("label").alias("label")).select("label")
    return met.join(kept, "label", "left_semi")


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs. The tables made on the way are removed."""
    path = shared_path(docs.sparkSession, "groups")
    with scratch(docs.sparkSession):
        return stored(_groups(docs, text, doc_id, width, percent), "groups", path)


def _groups(docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    for seed in range(8):
        wide = stored(source.mapInArrow(_sets_and_labels(percent, width, seed), f"doc_id {kind}, n bigint, key bigint, other bigint, sketch binary, {', '.join(f'{c} binary' for c in _SHARE_NAMES)}"), "labels")
        noted = stored(wide.select("doc_id", "n", "key", "other"), "sets")
        # Sets go by 64 of 128 bits; should two different ones share these, all are hashed anew.
        if noted.where("key is not null").groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").isEmpty():
            break
        forget(wide)
        forget(noted)
    else:
        raise RuntimeError("different sets share a hash under every seed")
    # One share of the labels after the other, so that what is dealt out at a time is a part of them.
    shares = [
        stored(
            wide.where(F.col(share).isNotNull()).select("key", share).mapInArrow(_unpacked, "label bigint, key bigint")
            .repartition("label").sortWithinPartitions("label", "key")
            .mapInArrow(_shared, "label bigint, key bigint"),
            "met",
        )
        for share in _SHARE_NAMES
    ]
    met = stored(_once(reduce(DataFrame.unionByName, shares)), "met")
    for share in shares:
        forget(share)
    # Sketches of all sets that meet others; n-grams follow for those alone that sketches don't tell apart.
    sketches = wide.where("sketch is not null").select("key", "n", "sketch").join(met.select("key").distinct(), "key", "left_semi")
    sets = stored(sketches.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    forget(wide)
    edges, roots, rest = None, None, met
    for last in (*(False,) * PIVOT_ROUNDS, True):
        if roots is None:
            rest = rest.withColumn("class", F.col("key"))
        else:
            classed = rest.join(roots.withColumnRenamed("node", "key"), "key", "left").select("label", "key", F.coalesce("root", "key").alias("class"))
            open_labels = classed.groupBy("label").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("label")
            rest = stored(classed.join(open_labels, "label", "left_semi"), "open")
            if rest.isEmpty():
                break
        if last:
            tasks = _block_tasks(rest.join(sets.select("key", "n"), "key"), SKETCHES)
        else:
            degree = rest.groupBy("key").agg(F.count("*").alias("degree"))
            chosen = rest.join(degree, "key").groupBy("label").agg(F.max_by(F.struct("key", "class"), F.struct("degree", "key")).alias("p"))
            asked = rest.join(chosen, "label").select("label", "key", "class", F.col("p.key").alias("pivot"), F.col("p.class").alias("pivot_class")).where("key <> pivot")
            tasks = _pivot_tasks(stored(asked.where("class <> pivot_class").drop("label").distinct(), "pairs"), SKETCHES)
            rest = stored(asked.select("label", "key"), "rest")
        pairs = stored(_candidates(tasks, sets, percent), "candidates")
        grams = _grams(pairs.select("key").union(pairs.select("pivot")).distinct(), noted, source, width, seed)
        found = _links(pairs, grams, percent)
        edges = stored(found if edges is None else edges.union(found), "links")
        forget(grams)
        roots = components(edges)
    classes = noted.select("doc_id", "n", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", F.coalesce("root", "key").alias("class"))
    smallest = classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("__least"))
    return classes.join(smallest, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("__least")).alias("component_id")
    )
