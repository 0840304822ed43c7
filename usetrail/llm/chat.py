"""Chat formatting as prefix trees.

Conversations in the order of their turns' hashes stand next to those they share initial
turns with, so a walk over the sorted conversations is a depth-first walk of the prefix tree.
Every task walks one range of that order and emits each turn it meets once, with the places
of its tokens, their position ids and the intervals of its ancestors they attend to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named
from usetrail.llm.tokens import default_path, encoder

TURN, TURN_END = "<|turn|>", "<|end|>\n"
TRAINED = "assistant"
#: Control strings of this template and of other common ones, split after the first character.
CONTROL = r"([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext)\||/?s>|</?SYS>>|/?INST\])"
_ESCAPE = re.compile(CONTROL)
_UNESCAPE = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)", 1))
NODE = (
    "block long, node long, parent long, depth int, first long, last long, position long,"
    " attends array<struct<first: long, last: long>>, loss_first long, loss_last long,"
    " ids array<int>, conversation string"
)


def escape(text: str) -> str:
    """A backslash more after the first character of every control string."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role on one line: backslashes doubled, line ends written as \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assembled(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, digest, path: one row per conversation.

    Rows go by turn, then role, then text; null roles and texts are empty; rows with a null
    id make one conversation. A conversation is one record and has to fit a task.
    """
    rows = conversations.select(
        named(conversations, "conv_id").alias("conv_id"), named(conversations, "turn").alias("turn"),
        F.coalesce(named(conversations, "role"), F.lit("")).alias("role"),
        F.coalesce(named(conversations, "text"), F.lit("")).alias("text"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select("conv_id", turns.alias("turns")).select(
        "conv_id", "turns", F.sha2(F.to_json("turns"), 256).alias("digest"),
        F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"),
    )


def prefix_trees(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The nodes of the prefix trees of `assembled` conversations, depth first in each block.

    A node is a turn that follows the same turns. `first`..`last` are the places of its
    tokens in its block's sequence, `position` the position id of the first of them,
    `attends` the places of its ancestors, `loss_first`..`loss_last` those of its `ids` that
    are trained on, `conversation` the digest of the conversation that ends there. Equal
    conversations are one. A prefix whose conversations are spread over several tasks is
    emitted once in each, so no task has to hold one tree.
    """
    path = tokenizer or default_path()
    distinct = conversations.groupBy("digest").agg(F.first("turns").alias("turns"), F.first("path").alias("path"))
    names = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>+", "", NODE).split(",")]
    interval = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    kinds = {"depth": pa.int32(), "attends": interval, "ids": pa.list_(pa.int32()), "conversation": pa.string()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = encoder(path).encode, TaskContext.get().partitionId()
        above: list[tuple] = []  # (role, text), node, first, last, position after
        node, place = 0, 0
        for batch in batches:
            rows = []
            for digest, turns in zip(batch["digest"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                shared = 0
                for (turn, *_), next_turn in zip(above, turns, strict=False):
                    if turn != next_turn:
                        break
                    shared += 1
                del above[shared:]
                for depth in range(shared, len(turns)):
                    role, text = turns[depth]["role"], turns[depth]["text"]
                    head = encode(f"{TURN}{escape_role(role)}\n").tolist()
                    body = encode(escape(text)).tolist()
                    ids = head + body + encode(TURN_END).tolist()
                    attends: list[dict] = []
                    for _, _, first, last, _ in above:
                        if attends and attends[-1]["last"] == first:
                            attends[-1]["last"] = last
                        else:
                            attends.append({"first": first, "last": last})
                    position = above[-1][4] if above else 0
                    loss = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
                    last_turn = depth == len(turns) - 1
                    rows.append(
                        (block, node, above[-1][1] if above else None, depth, place, place + len(ids), position,
                         attends, *loss, ids, digest if last_turn else None)
                    )
                    above.append((turns[depth], node, place, place + len(ids), position + len(ids)))
                    node, place = node + 1, place + len(ids)
            if rows:
                yield pa.record_batch(
                    [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names
                )

    return (
        distinct.repartitionByRange("path", "digest")
        .sortWithinPartitions("path", "digest")
        .mapInArrow(walk, NODE)
    )


def read_back(nodes: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What each conversation says, from the emitted tokens alone.

    Takes the nodes as `prefix_trees` emits them, block by block in order. A conversation
    that is an initial part of another ends at an inner node.
    """
    path = tokenizer or default_path()
    schema = (
        "digest string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        above: list[tuple] = []  # hash of turns, hash of trained text, its length, formatted length
        for batch in batches:
            rows = []
            columns = (batch[c].to_pylist() for c in ("depth", "ids", "loss_first", "loss_last", "conversation"))
            for depth, ids, loss_first, loss_last, conversation in zip(*columns, strict=True):
                del above[depth:]
                turns, loss, chars, formatted = above[-1] if above else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                turns, loss = turns.copy(), loss.copy()
                shown = decode(ids)
                role, _, rest = shown[len(TURN) :].partition("\n")
                turns.update(f"{unescape_role(role)}\n{unescape(rest[: -len(TURN_END)])}\n".encode())
                trained = unescape(decode(ids[loss_first:loss_last]))
                loss.update(trained.encode())
                above.append((turns, loss, chars + len(trained), formatted + len(shown)))
                if conversation is not None:
                    rows.append((conversation, depth + 1, turns.hexdigest(), above[-1][2], loss.hexdigest(), above[-1][3]))
            if rows:
                yield pa.record_batch(
                    [pa.array(c) for c in zip(*rows, strict=True)], names
                )

    return nodes.mapInArrow(read, schema)
