"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(word | context) = P(class | context) * P(part | class, context) * P(word | part). The first factor is a softmax over CLASSES, the second one
over the PARTS of a class; both take their weights from the rows of a hashed table that the context's features choose: none (bias),
the previous word, the two previous words, the word before the previous one (skip), and, for classes, the two previous classes. In the second
factor the class is part of each feature, and the bias is the part's share of the class. The third is the word's
add-one share of its part; the unknown words of a class have one more share of it together, whatever the context.

Classes: the end token, each of the most frequent words, and the others by their endings. Endings that follow the same endings are
put in one class by clustering a table of counts whose size is fixed (ENDINGS by FOLLOWED). A word's part is told by bits of its hash.

Training is by STEPS distributed gradient updates. Each takes the documents whose id hashes to it: every task adds up, at the weights the step
began with, how often its tokens met each (feature, class) and how often the model expects them to. The
gradient is the difference of the two sums over all tasks; each weight moves along it by RATE times the logarithm of their
ratio, the step of iterative scaling. The sums depend on neither tasks nor order, so scores don't depend on how the table is split. Counts of
words are taken over all learned documents. In scoring, the most frequent words' counts (a bounded number) are sent to
all tasks; all other words are looked up by a join, one row an occurrence.

Defined cases. A null or empty text is the end token alone. Documents with a null doc_id are scored, never learned from and not held out.
Repeated documents count and are scored each time. With nothing to learn from all words are unknown. Very long texts are read whole.
Words of equal counts go by their hashes. An empty table gives no rows. Other columns are kept, whatever their names; those added begin with __lm_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE, stored, use, with_columns, words
from .quality import bucket_sql

#: Classes: those of endings, then the most frequent words', the end token's last.
CLASSES, BY_ENDING = 32, 16
#: Parts of each class of endings.
PARTS = 16
#: Hashes of words' last three bytes, and of those before them, that classes are made from.
ENDINGS, FOLLOWED = 4096, 64
#: Rows of either weight table: as many as words, a power of two from ROWS to MOST_ROWS (so that rows have 16 bits).
ROWS, MOST_ROWS = 1 << 15, 1 << 16
#: Words whose counts are sent to all tasks.
SENT_WORDS = 200_000
STEPS = 3
RATE = 0.3
#: Occurrences that either sum is taken to have besides.
SMOOTHING = 0.5
#: Weights beside the bias lie within this of 0.
MOST_WEIGHT = 12
#: Tokens whose weights are read at a time.
BATCH = 8_192
#: Tokens a training task has on average at least: each task passes on a table of sums, whatever it has learned from.
TASK_TOKENS = 16_000_000
#: Tokens that are counted together, and tokens whose expectations are.
_CHUNK, _SUMMED = 4_000_000, 1 << 18
_LOW = ENDINGS - 1
END = (xxhash.xxh3_64_intdigest(b"\x00end") & ~_LOW) - (1 << 63)


class WordIds(dict):
    """A signed 64-bit id for each word: a hash whose low bits are the hash of its last three bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(word) & ~_LOW | xxhash.xxh32_intdigest(word[-3:]) & _LOW) - (1 << 63)
        return value


_IDS = WordIds()


def token_ids(text: str | None) -> np.ndarray:
    """Ids of the words and the end token."""
    found = words(text)
    ids = np.empty(len(found) + 1, np.int64)
    ids[:-1] = np.fromiter(map(use(_IDS).__getitem__, found), np.int64, len(found))
    ids[-1] = END
    return ids


def _documents(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, rows after the last, ids, starts) of runs of documents with about so many tokens."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        a, held, n = 0, [], 0
        for i, text in enumerate(texts):
            held.append(token_ids(text))
            n += len(held[-1])
            if n >= tokens or i == len(texts) - 1:
                sizes = np.array([len(x) for x in held])
                yield batch, a, i + 1, np.concatenate(held), np.cumsum(sizes) - sizes
                a, held, n = i + 1, [], 0


def endings(ids: np.ndarray) -> np.ndarray:
    return ids & np.int64(_LOW)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, token, c): words, and pairs of a word's ending and a hash of the one before."""
    pack = lambda pair, found, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pair)), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pair", "token", "c"])
    pairs = np.zeros(ENDINGS * FOLLOWED, np.int64)
    for _, _, _, ids, starts in _documents(batches, 0, _CHUNK):
        found, n = np.unique(ids, return_counts=True)
        yield pack(False, found, n)
        inside = ids != END  # a document's first word follows no other, and its end token belongs to no class of endings
        after = inside.copy()
        after[starts] = False
        at = np.flatnonzero(after)
        before = (endings(ids[at - 1]) * 2654435761 >> 7) % FOLLOWED
        pairs += np.bincount(endings(ids[at]) * FOLLOWED + before, minlength=len(pairs))
    there = np.flatnonzero(pairs)
    yield pack(True, there, pairs[there])


def clustered(pairs: np.ndarray, k: int = BY_ENDING, rounds: int = 25) -> np.ndarray:
    """A class from 0 to k - 1 for each ending (a row of pairs): endings with similar shares of what they follow are together."""
    n = pairs.sum(axis=1)
    # distances are those of the square roots of shares, against shares of all; rare endings lean to the latter
    overall = (pairs.sum(axis=0) + 1) / (pairs.sum() + pairs.shape[1])
    points = np.sqrt((pairs + 20 * overall) / (n[:, None] + 20))
    weight = np.sqrt(n)
    centres = [points[int(np.argmax(n))]]
    for _ in range(1, k):
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * weight
        centres.append(points[int(np.argmax(far))])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        for j in range(k):
            if (mine := weight * (own == j)).any():
                centres[j] = (points * mine[:, None]).sum(axis=0) / mine.sum()
    return own


class Classes:
    """The class of each id, given the words that are classes of their own and the classes of endings."""

    def __init__(self, top: list[int], by_ending: np.ndarray) -> None:
        order = np.argsort(np.array([*top, END], np.int64))
        self.ids = np.array([*top, END], np.int64)[order]
        self.classes = (np.arange(len(top) + 1) + BY_ENDING)[order]
        self.by_ending = by_ending.astype(np.int64)

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.classes[at], self.by_ending[endings(ids)])


def part_of(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) >> np.uint64(64 - (PARTS - 1).bit_length())).astype(np.int64)


def _hashed(x: np.ndarray, salt: int, n_rows: int) -> np.ndarray:
    x = (x.view(np.uint64) if x.dtype == np.int64 else x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum((x >> np.uint64(64 - (n_rows - 1).bit_length())).astype(np.uint16), 1)  # row 0 is the bias


def features(ids: np.ndarray, classes: np.ndarray, starts: np.ndarray, n_rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(4, tokens) rows of the classes' table and (3, tokens) rows of the parts' beside the bias; contexts don't go beyond a document's start."""
    first = np.zeros(len(ids), bool)
    first[starts] = True
    second = np.zeros(len(ids), bool)
    second[starts[starts + 1 < len(ids)] + 1] = True
    w1, w2, c1, c2 = np.roll(ids, 1), np.roll(ids, 2), np.roll(classes, 1), np.roll(classes, 2)
    w1[first] = 1
    w2[first | second] = 1
    c1[first] = CLASSES
    c2[first | second] = CLASSES
    pair = w1.view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + w2.view(np.uint64)
    own = classes.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    return (
        np.stack((_hashed(w1, 1, n_rows), _hashed(pair, 2, n_rows), _hashed(w2, 3, n_rows), _hashed(c1 * (CLASSES + 1) + c2, 4, n_rows))),
        np.stack([_hashed(x.view(np.uint64) + own, salt, n_rows) for salt, x in ((5, w1), (6, pair), (7, w2))]),
    )


def logits(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(tokens, outcomes) sums of the weights of each token's rows. bias: of all tokens, or of each. Weights are bounded, so that none overflows as a power of e."""
    z = weights.take(rows[0], axis=0)
    for own in rows[1:]:
        z += weights.take(own, axis=0)
    z += bias
    return z


class Sums:
    """Of each row and outcome how often it was met, and how often it was expected; the latter by outcome, so that each is added up in one go."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.met, self.expected = weights, np.zeros(weights.size), np.zeros(weights.T.shape)

    def add(self, rows: np.ndarray, outcomes: np.ndarray, bias: np.ndarray, kinds: np.ndarray | None = None) -> None:
        """kinds: which row of bias each token has."""
        n_rows, width = self.weights.shape
        for start in range(0, len(outcomes), _SUMMED):  # a document may be very long
            some, own_outcomes = rows[:, start : start + _SUMMED].astype(np.intp), outcomes[start : start + _SUMMED]
            own_bias = None if kinds is None else kinds[start : start + _SUMMED]
            held = np.empty((width, len(own_outcomes)), np.float32)
            for a in range(0, len(own_outcomes), BATCH):
                p = logits(self.weights, some[:, a : a + BATCH], bias if own_bias is None else bias[own_bias[a : a + BATCH]])
                np.exp(p, out=p)
                p /= p.sum(axis=1, keepdims=True)
                held[:, a : a + BATCH] = p.T
            for own in some:
                np.add.at(self.met, own * width + own_outcomes, 1.0)
                for k in range(width):
                    self.expected[k] += np.bincount(own, held[k], n_rows)
            self.met[:width] += np.bincount(own_outcomes, minlength=width)
            self.expected[:, 0] += held.sum(axis=1, dtype=np.float64)

    def slices(self, sign: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Runs of rows that were met, numbered from sign."""
        met, expected = self.met.reshape(self.weights.shape), self.expected.T
        for k in range(0, len(met), 256):
            if met[k : k + 256].any():
                yield sign * (k // 256 + 1), met[k : k + 256].astype(np.float32).tobytes(), expected[k : k + 256].astype(np.float32).tobytes()


def _gathered(sent, classes: Classes):
    """The sums of one task's documents: slices of the classes' rows from 1 on, of the parts' from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own_weights, shares = sent.value
        of_classes, of_parts = Sums(weights), Sums(own_weights)
        for _, _, _, ids, starts in _documents(batches, 0, _SUMMED):
            kinds = classes.of(ids)
            rows, own_rows = features(ids, kinds, starts, len(weights))
            of_classes.add(rows, kinds, weights[0])
            inside = np.flatnonzero(kinds < BY_ENDING)
            of_parts.add(own_rows[:, inside], part_of(ids[inside]), shares, kinds[inside])
        out = [*of_classes.slices(1), *of_parts.slices(-1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["slice", "met", "expected"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows sorted by slice; holds one slice at a time."""
    at, met, expected = None, None, None
    out: list[tuple] = []
    for batch in batches:
        for k, m, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m, e = np.frombuffer(m, np.float32), np.frombuffer(e, np.float32)
            if k != at:
                if at is not None:
                    out.append((at, met.astype(np.float32).tobytes(), expected.astype(np.float32).tobytes()))
                at, met, expected = k, m.astype(np.float64), e.astype(np.float64)
            else:
                met, expected = met + m, expected + e
    if at is not None:
        out.append((at, met.astype(np.float32).tobytes(), expected.astype(np.float32).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["slice", "met", "expected"])


def trained(learned: DataFrame, classes: Classes, priors: np.ndarray, shares: np.ndarray, tokens: int, n_rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of parts after STEPS updates over learned (text, share). What reaches the driver is one table of sums a step."""
    spark = learned.sparkSession
    tables = {1: np.zeros((n_rows, CLASSES), np.float32), -1: np.zeros((n_rows, PARTS), np.float32)}
    tables[1][0] = np.log(priors)
    schema = "slice bigint, met binary, expected binary"
    for step in range(STEPS):
        sent = spark.sparkContext.broadcast((tables[1], tables[-1], shares))
        sums = learned.where(F.col("share") == step).select("text").coalesce(max(1, -(-tokens // TASK_TOKENS))).mapInArrow(_gathered(sent, classes), schema)
        # two levels, so that no task adds up the rows of all others
        some = sums.withColumn("__some", F.spark_partition_id() % 64)
        once = some.repartition("slice", "__some").select("slice", "met", "expected").sortWithinPartitions("slice").mapInArrow(_summed, schema)
        total = once.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed, schema)
        tables = {k: v.copy() for k, v in tables.items()}
        for row in total.toLocalIterator():
            table = tables[1 if row.slice > 0 else -1]
            rows = slice((abs(row.slice) - 1) * 256, abs(row.slice) * 256)
            met, expected = (np.frombuffer(x, np.float32).astype(np.float64).reshape(-1, table.shape[1]) for x in (row.met, row.expected))
            table[rows] += (RATE * np.log((met + SMOOTHING) / (expected + SMOOTHING))).astype(np.float32)
        tables[-1][0] = 0  # the parts' bias is their share
        for table in tables.values():
            np.clip(table[1:], -MOST_WEIGHT, MOST_WEIGHT, out=table[1:])
    return tables[1], tables[-1]


def table_rows(distinct: int) -> int:
    """Rows of a hashed table for so many words."""
    return min(MOST_ROWS, max(ROWS, 1 << (max(1, distinct) - 1).bit_length()))


def frequent_words(vocabulary: DataFrame, most: int = SENT_WORDS) -> DataFrame:
    """The words from the least count on that leaves most of them or fewer. Counts are first added up by ranges, so only these reach the driver."""
    bucket = F.expr(bucket_sql("c"))
    total, least = 0, None
    for r in sorted(vocabulary.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):  # 64 ranges a power of two
        total += r.n
        if total > most:
            break
        least = r.b
    return vocabulary.where(bucket >= least) if least is not None else vocabulary.where(F.lit(False))


class Model:
    """All that a task needs to score: bounded by MOST_ROWS and SENT_WORDS."""

    def __init__(self, classes: Classes, weights: np.ndarray, own_weights: np.ndarray, held: np.ndarray, known: np.ndarray, counts: np.ndarray) -> None:
        """held: (BY_ENDING, PARTS) counts of words, one more for each word."""
        self.classes, self.weights, self.own_weights, self.known, self.counts = classes, weights, own_weights, known, counts
        self.shares = shares_of(held)
        sums = held.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unknown = np.concatenate((-np.log10(sums + 1), np.zeros(CLASSES - BY_ENDING)))
            # of a known word instead: its class's known words' share, and its own of the part
            self.part = np.where(held > 0, np.log10(sums)[:, None] - np.log10(held), 0.0)

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the log10 probability as an unknown word of its class, and what a known word has more, without its own count."""
        kinds = self.classes.of(ids)
        rows, own_rows = features(ids, kinds, starts, len(self.weights))
        one = np.empty(len(ids))
        for a in range(0, len(ids), BATCH):
            own = kinds[a : a + BATCH]
            one[a : a + BATCH] = _chosen(logits(self.weights, rows[:, a : a + BATCH], self.weights[0]), own)
        one = one / np.log(10) + self.unknown[kinds]
        inside = np.flatnonzero(kinds < BY_ENDING)
        more = np.zeros(len(ids))
        for a in range(0, len(inside), BATCH):
            at = inside[a : a + BATCH]
            own, part = kinds[at], part_of(ids[at])
            more[at] = _chosen(logits(self.own_weights, own_rows[:, at], self.shares[own]), part) / np.log(10) + self.part[own, part]
        return one, more


def _chosen(z: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of those outcomes."""
    own = z[np.arange(len(z)), outcomes]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def shares_of(held: np.ndarray) -> np.ndarray:
    """Natural logarithms of the parts' shares of their class; parts without words have next to none."""
    return np.log(np.maximum(held, 1e-9) / np.maximum(held.sum(axis=1, keepdims=True), 1e-9 * PARTS)).astype(np.float32)


def learn_model(learned: DataFrame, vocabulary: DataFrame, pairs: DataFrame) -> tuple[Model, int, int]:
    """(model, tokens, distinct tokens) of learned (text, share). vocabulary: (token, c); pairs: (token, c), ENDINGS * FOLLOWED rows at most."""
    top = [r.token for r in vocabulary.where(F.col("token") != END).orderBy(F.desc("c"), "token").limit(CLASSES - BY_ENDING - 1).collect()]
    follows = np.zeros(ENDINGS * FOLLOWED)
    for r in pairs.toLocalIterator():
        follows[r.token] = r.c
    by_ending = clustered(follows.reshape(ENDINGS, FOLLOWED))
    classes = Classes(top, by_ending)
    # Sums over the words by ending and part, which are classed here: ENDINGS * PARTS rows at most, and the words of own classes.
    part = F.shiftrightunsigned("token", 64 - (PARTS - 1).bit_length())
    alone = F.when(F.col("token").isin([*top, END]), F.col("token"))
    sizes, held = np.zeros(CLASSES), np.zeros((BY_ENDING, PARTS))
    total = distinct = 0
    for r in vocabulary.groupBy(F.col("token").bitwiseAND(F.lit(_LOW)).alias("ending"), part.alias("part"), alone.alias("alone")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toLocalIterator():
        total, distinct = total + r.n, distinct + r.v
        if r.alone is not None:
            sizes[classes.of(np.array([r.alone]))[0]] += r.n
        else:
            sizes[by_ending[r.ending]] += r.n
            held[by_ending[r.ending], r.part] += r.n + r.v
    weights, own_weights = trained(learned, classes, (sizes + 1) / (total + CLASSES), shares_of(held), total, table_rows(distinct))
    frequent = frequent_words(vocabulary).toPandas().sort_values("token")
    return Model(classes, weights, own_weights, held, frequent["token"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64)), total, distinct


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", learn: str = "learn") -> DataFrame:
    """docs with all columns but the text, and __lm_n_tokens, __lm_n_known, __lm_train_tokens, __lm_base_score and __lm_score. learn: the boolean column of documents to learn from."""
    spark = docs.sparkSession
    learned = docs.where(F.col(learn)).select(F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(STEPS)).alias("share"))
    counted = stored(learned.select("text").mapInArrow(_counts, "pair boolean, token bigint, c bigint").groupBy("pair", "token").agg(F.sum("c").alias("c")), "vocabulary")
    vocabulary = counted.where("NOT pair").select("token", "c")
    model, total, distinct = learn_model(learned, vocabulary, counted.where("pair").select("token", "c"))
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.col(text).alias("__lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known, counts = model.known, model.counts
        for batch, a, b, ids, starts in _documents(batches, len(kept), 16 * BATCH):
            one, more = model.log10(ids, starts)
            each, at = np.unique(ids, return_inverse=True)
            place = np.minimum(np.searchsorted(known, each), max(0, len(known) - 1))
            there = (known[place] == each)[at] if len(known) else np.zeros(len(ids), bool)
            log_c = np.where(there, np.log10(counts[place] + 1.0)[at], 0.0) if len(known) else np.zeros(len(ids))
            single = model.classes.of(ids) >= BY_ENDING
            sums = lambda x: np.add.reduceat(x, starts)
            rare = np.concatenate(([0], np.cumsum(~there)))[np.append(starts, len(ids))]
            lists = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.StructArray.from_arrays([pa.array(ids[~there]), pa.array(more[~there])], ["token", "more"]))
            columns = [
                pa.array(np.append(starts[1:], len(ids)) - starts, pa.int64()), pa.array(sums(there.astype(np.int64))), pa.array(sums(log_c)),
                pa.array(sums(one + np.where(there & ~single, more + log_c, 0.0))), lists,
            ]
            fields = [*list(batch.schema)[: len(kept)], *(pa.field(n, c.type) for n, c in zip(("__lm_n_tokens", "__lm_known", "__lm_base", "__lm_model", "__lm_rare"), columns, strict=True))]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(kept)]), *columns], schema=pa.schema(fields))

    schema = with_columns(docs.select(*kept), "__lm_n_tokens bigint, __lm_known bigint, __lm_base double, __lm_model double, __lm_rare array<struct<token:bigint,more:double>>")
    scored = stored(rows.mapInArrow(run, schema).withColumn("__lm_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("__lm_row", F.explode("__lm_rare").alias("r")).select("__lm_row", "r.token", "r.more")
    log_c = F.log10(F.col("c") + 1)
    found = rare.join(vocabulary, "token").groupBy("__lm_row").agg(F.count("*").alias("__lm_n"), F.sum(log_c).alias("__lm_log_c"), F.sum(F.col("more") + log_c).alias("__lm_more"))
    added = scored.drop("__lm_rare").join(found, "__lm_row", "left")
    or_none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return added.select(
        *kept,
        "__lm_n_tokens", (F.col("__lm_known") + F.coalesce(F.col("__lm_n"), F.lit(0))).alias("__lm_n_known"), F.lit(int(total)).cast("bigint").alias("__lm_train_tokens"),
        (F.col("__lm_base") + or_none("__lm_log_c") - F.col("__lm_n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("__lm_base_score"),
        (F.col("__lm_model") + or_none("__lm_more")).alias("__lm_score"),
    )
