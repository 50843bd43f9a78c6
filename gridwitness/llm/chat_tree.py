"""Chat formatting as prefix trees of turns.

A node is a turn in the context of all turns before it; its key is a hash chained from its parent's. Conversations are
sorted by their path of keys, so those with the same first turns lie together, in depth-first order, and a common
beginning is cut at any place by the range partitioning, however many conversations share it. Within
a sequence each node's tokens are emitted once; a sequence ends at max_tokens, and the next begins with the
ancestors of its first node, marked `repeat`; so are, but in one sequence, those that the range partitioning has put in several
ranges. Repeats are context alone and bear no loss, so over all sequences each node is trained on once. Every node has the position id of its first token (the tokens
of its ancestors) and the intervals of the sequence that its tokens attend to besides their own node's earlier ones.

The template is `<turn>role\\ntext</turn>\\n`; the loss is on the texts of assistant turns, and their segment of
tokens is apart from the marks'. A backslash is doubled, and after the `<` of a mark inside a text, and for
a line end in a role, one is put in; unescape() takes them away again.

Defined cases. Null texts and roles are empty. Turns go by turn, then role and text, so repeated rows stand side by side and
count each. A null turn comes first. A row without conv_id is a conversation of its own. Conversations with equal turns
share all nodes. A conversation is read in one task, as its digests are those of one sequence; nothing else is gathered by conversation.
Very long texts are tokenised whole, in a sequence of their own if they exceed max_tokens. An empty table gives no nodes. Only the columns named are
read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OPEN, CLOSE = "<turn>", "</turn>\n"
_MARK = re.compile(r"\\|<(?=/?turn>)")
_MARKED = re.compile(r"\\\\|<\\(?=/?turn>)")
#: Paths that a task remembers so as not to send a conversation's copies on.
_SEEN = 200_000

#: key: the same for the same turn after the same turns, in whichever sequence.
NODES = (
    "sequence_id string, node int, parent int, key binary, repeat boolean, role string, position_start bigint, offset bigint, "
    "ids array<int>, loss_start int, loss_end int, attends array<struct<start:bigint,end:bigint>>, ends binary"
)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[0][:-1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\\\|\\n|<\\(?=/?turn>)", lambda m: "\n" if m[0] == "\\n" else m[0][:-1], role)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation. No escaped text holds a mark."""
    turns = []
    for body in formatted.split(CLOSE)[:-1]:
        role, text = body.removeprefix(OPEN).split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


class Codec:
    """Byte-level tokens of segments, and back to their bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(0x100, 0x200))
        byte_of = {chr(b) if b in shown else chr(next(other)): b for b in range(0x100)}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in self.tokenizer.get_vocab().items():
            if all(c in byte_of for c in token):
                self.bytes_of[i] = bytes(byte_of[c] for c in token)

    def encode(self, text: str) -> array:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids if text else ())

    @lru_cache(10_000)  # noqa: B019 - a worker has two codecs at most
    def mark(self, text: str) -> array:
        return self.encode(text)

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, own, role, text) sorted -> (conv_id, path_key, path, roles, texts); the last two once for equal paths of a task."""
    seen: set[bytes] = set()
    out: list[tuple] = []

    def pack() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["conv_id", "path_key", "path", "roles", "texts"])
        out.clear()
        return batch

    held = 0
    for (conv_id, _), turns in groupby(_rows(batches), key=lambda r: r[:2]):
        key, path, roles, texts = b"", [], [], []
        for _, _, role, text in turns:
            part = role.encode("utf-8", "surrogatepass")
            key = hashlib.blake2b(key + len(part).to_bytes(8, "big") + part + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            path.append(key)
            roles.append(role)
            texts.append(text)
        if key in seen:
            out.append((conv_id, key, None, None, None))
        else:
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(key)
            out.append((conv_id, key, b"".join(path), roles, texts))
            held += sum(map(len, texts))
        if len(out) >= 5_000 or held > 1 << 24:
            yield pack()
            held = 0
    yield pack()


class _Node:
    __slots__ = ("attends", "ends", "head", "ids", "key", "loss", "node", "offset", "parent", "position", "repeat", "role", "sequence")


def _packed(nodes: list[_Node]) -> pa.RecordBatch:
    """Nodes as a batch; lists by their offsets, as their tokens are most of it."""
    offsets = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    ids = np.concatenate([np.frombuffer(n.ids, np.int32) for n in nodes]) if nodes else np.empty(0, np.int32)
    spans = np.array([x for n in nodes for x in n.attends], np.int64).reshape(-1, 2)
    attends = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"])
    plain = lambda name, kind: pa.array([getattr(n, name) for n in nodes], kind)
    columns = {
        "sequence_id": plain("sequence", pa.string()), "node": plain("node", pa.int32()), "parent": plain("parent", pa.int32()), "key": plain("key", pa.binary()), "repeat": plain("repeat", pa.bool_()),
        "role": plain("role", pa.string()), "position_start": plain("position", pa.int64()), "offset": plain("offset", pa.int64()),
        "ids": pa.ListArray.from_arrays(offsets([len(n.ids) for n in nodes]), pa.array(ids)), "loss_start": pa.array([n.loss[0] for n in nodes], pa.int32()), "loss_end": pa.array([n.loss[1] for n in nodes], pa.int32()),
        "attends": pa.ListArray.from_arrays(offsets([len(n.attends) for n in nodes]), attends), "ends": plain("ends", pa.binary()), "head": plain("head", pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _tree(tokenizer: str, max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        close = code.mark(CLOSE)
        out: list[_Node] = []
        held = 0
        stack: list[_Node] = []  # the nodes on the way to the last one emitted
        sequence, nodes, at, first = "", 0, 0, True

        def emit(key: bytes, role: str, ids: array, loss: tuple[int, int], repeat: bool, head: bool) -> None:
            nonlocal nodes, at, held
            above, n = (stack[-1] if stack else None), _Node()
            n.sequence, n.node, n.parent, n.key, n.repeat, n.head, n.role = sequence, nodes, None, key, repeat, head, role
            n.position, n.offset, n.ids, n.loss, n.attends, n.ends = 0, at, ids, loss, (), None
            if above:
                n.parent, n.position = above.node, above.position + len(above.ids)
                end = above.offset + len(above.ids)
                # adjoining intervals are one
                n.attends = (*above.attends[:-1], (above.attends[-1][0], end)) if above.attends and above.attends[-1][1] == above.offset else (*above.attends, (above.offset, end))
            out.append(n)
            stack.append(n)
            nodes, at, held = nodes + 1, at + len(ids), held + len(ids)

        for path, path_key, roles, texts in _rows(batches):
            own = [path[i : i + 16] for i in range(0, len(path), 16)]
            common = 0
            while common < min(len(own), len(stack)) and own[common] == stack[common].key:
                common += 1
            del stack[common:]
            if common < len(own) or not stack:
                # Only what is new is tokenised; the ancestors' tokens are held in the stack.
                fresh = []
                for key, role, text in zip(own[common:], roles[common:], texts[common:], strict=True):
                    head, body = code.mark(OPEN + escape_role(role) + "\n"), code.encode(escape(text))
                    fresh.append((key, role, head + body + close, (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)))
                if not sequence or (at and at + sum(len(x[2]) for x in fresh) > max_tokens):
                    sequence, nodes, at = path_key.hex(), 0, 0
                    again, stack[:] = list(stack), []
                    for n in again:
                        emit(n.key, n.role, n.ids, (0, 0), True, False)
                for key, role, ids, loss in fresh:
                    emit(key, role, ids, loss, False, first)
            first = False
            if stack[-1].ends is None:
                stack[-1].ends = path_key
            if held > 1 << 20 or len(out) >= 20_000:
                # A path that ends inside others comes before them, so no row here is changed later.
                yield _packed(out)
                out, held = [], 0
        yield _packed(out)

    return run


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path_key, path, roles, texts), one row a conversation."""
    own = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("own"),
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = own.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text").select("conv_id", "own", "role", "text")
    return stored(ordered.mapInArrow(_conversations, "conv_id bigint, path_key binary, path binary, roles array<string>, texts array<string>"), "conversations")


def prefix_trees(convs: DataFrame, tokenizer: str = TOKENIZER, max_tokens: int = 65_536, ranges: int | None = None) -> DataFrame:
    """The nodes, as NODES says, of the sequences that hold all conversations. ends is the path_key of the conversation whose last turn a node is."""
    paths = convs.where("path IS NOT NULL").select("path", "path_key", "roles", "texts")
    ranged = paths.repartitionByRange(ranges, "path") if ranges else paths.repartitionByRange("path")
    nodes = stored(ranged.sortWithinPartitions("path").mapInArrow(_tree(tokenizer, max_tokens), f"{NODES}, head boolean"), "chat-nodes")
    # Nodes on a range's first path may be in the range before as well: a path's length of them for each range.
    heads = nodes.where("head AND NOT repeat").select("key").distinct()
    several = stored(
        nodes.where("NOT repeat").select("key", "sequence_id").join(heads, "key", "left_semi").groupBy("key").agg(F.min("sequence_id").alias("__once"), F.count("*").alias("n")).where("n > 1").select("key", "__once"),
        "chat-heads",
    )
    again = F.col("repeat") | (F.col("__once").isNotNull() & (F.col("__once") != F.col("sequence_id")))
    columns = {"repeat": again} | {c: F.when(again, F.lit(0)).otherwise(F.col(c)) for c in ("loss_start", "loss_end")}
    return nodes.join(several, "key", "left").select(*(columns.get(c, F.col(c)).alias(c) for c in nodes.columns if c != "head"))


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        out: list[tuple] = []
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["path_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)
        held: dict[int, tuple[int | None, str, str]] = {}  # of this sequence: parent, text of the node, text under its loss
        at = None
        for sequence, node, parent, ids, a, b, ends in _rows(batches):
            if sequence != at:
                at, held = sequence, {}
            held[node] = (parent, code.decode(ids), code.decode(ids[a:b]))
            if ends is None:
                continue
            way, k = [], node
            while k is not None:
                way.append(held[k])
                k = held[k][0]
            formatted = "".join(x[1] for x in reversed(way))
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n, chars = 0, 0
            for role, text in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for x in reversed(way):
                text = unescape(x[2])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            out.append((ends, n, turns.hexdigest(), chars, loss.hexdigest(), len(formatted)))
            if len(out) >= 5_000:
                yield pack()
                out.clear()
        yield pack()

    return run


def read_back(nodes: DataFrame, convs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Of each conversation what its way through the tree gives when its tokens are decoded. A sequence has max_tokens at most, or one conversation.

    A repeated turn's loss is that of the one place where it is trained on.
    """
    columns = ["sequence_id", "node", "parent", "ids", "loss_start", "loss_end", "ends"]
    repeats = nodes.where("repeat").select("key").distinct()
    trained = nodes.where("NOT repeat").select("key", "loss_start", "loss_end").join(repeats, "key", "left_semi")
    again = nodes.where("repeat").drop("loss_start", "loss_end").join(trained, "key").select(*columns)
    ordered = nodes.where("NOT repeat").select(*columns).unionByName(again).repartition("sequence_id").sortWithinPartitions("sequence_id", "node")
    read = ordered.mapInArrow(_read(tokenizer), "path_key binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return convs.select("conv_id", "path_key").join(stored(read.dropDuplicates(["path_key"]), "chat-read"), "path_key").drop("path_key")
