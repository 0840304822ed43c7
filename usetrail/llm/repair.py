"""Repair of the turn structure of conversations, with the cheapest edits as an audit.

Rows are kept, given another role, deleted or inserted so that the roles become a system row
at most, then user and assistant in turn. A program over rows and four states keeps, per
state, the least cost and its audit. Audits are persistent: a node is an edit behind an
earlier node, so states share prefixes. A node has its ancestors at distances of powers of
two and a rolling hash of the whole prefix; audits of equal cost are compared by searching
their longest common prefix over the ancestors, and prefixes of equal hashes are compared as
text up to the node they share. Rows are put in order once by ranges; a conversation that is
cut by a range or longer than a piece is reduced to one table per piece (least cost and audit
from every state to every state), and the pieces are joined by the same kind of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, table_written
from usetrail.session import scratch_dir

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Faults of a row, the first that applies.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What was put out last: nothing, system, user, assistant. State that a role leads to; None: not allowed.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEEP_TO = (
    (AFTER_SYSTEM, AFTER_USER, None, None), (None, AFTER_USER, None, None),
    (None, None, AFTER_ASSISTANT, None), (None, AFTER_USER, None, None),
)
#: The state that the one role leads to that may be inserted or given instead.
FORCED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
NAME = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
ENDS = (START, AFTER_ASSISTANT)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
#: Rows of one conversation that are one table at most.
PIECE = 4096
PRIME, BASE = (1 << 61) - 1, 911_382_323


class Node:
    """An audit: a piece of text behind an earlier audit. Nodes are never changed."""

    __slots__ = ("depth", "length", "piece", "up", "value")

    def __init__(self, parent: Node | None = None, piece: str = "") -> None:
        self.piece, self.up, self.depth, self.length, self.value = piece, [], 0, len(piece), 0
        if parent is not None:
            self.depth, self.length, value = parent.depth + 1, parent.length + len(piece), parent.value
            for letter in piece:
                value = (value * BASE + ord(letter)) % PRIME
            self.value = value
            above: Node | None = parent
            while above is not None:
                self.up.append(above)
                k = len(self.up) - 1
                above = above.up[k] if len(above.up) > k else None

    def ancestor(self, depth: int) -> Node:
        node, k = self, 0
        left = self.depth - depth
        while left:
            if left & 1:
                node = node.up[k]
            left >>= 1
            k += 1
        return node

    def text(self, above: Node | None = None) -> str:
        """The audit, or what of it comes after an ancestor."""
        pieces, node = [], self
        while node is not above and node.depth:
            pieces.append(node.piece)
            node = node.up[0]
        return "".join(reversed(pieces))


def _alike(a: Node, b: Node) -> bool:
    return a is b or (a.value == b.value and a.length == b.length)


def _equal(a: Node, b: Node) -> bool:
    """Whether two audits whose hashes agree are equal: compared as text down from the node they share."""
    x, y = [], []
    while a is not b and (a.depth or b.depth):
        if a.depth >= b.depth:
            x.append(a.piece)
            a = a.up[0]
        else:
            y.append(b.piece)
            b = b.up[0]
    return "".join(reversed(x)) == "".join(reversed(y))


def before(a: Node, b: Node) -> bool:
    """Whether the audit of a comes before that of b in code-point order."""
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if not _alike(x, y):
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and k < len(y.up) and not _alike(x.up[k], y.up[k]):
                x, y = x.up[k], y.up[k]
        next_x, next_y = x, y
        x, y = x.up[0], y.up[0]
        if _equal(x, y) and not next_x.piece.startswith(next_y.piece) and not next_y.piece.startswith(next_x.piece):
            return next_x.piece < next_y.piece
    if _equal(x, y):
        return a.text(x) < b.text(y)
    return a.text() < b.text()  # the hashes of different prefixes agree


Best = dict[int, tuple[int, Node]]


def _offer(best: Best, state: int, cost: int, node: Node, piece: str) -> bool:
    """Take an audit that is cheaper, or as cheap and before, for a state."""
    held = best.get(state)
    if held is not None and held[0] < cost:
        return False
    grown = Node(node, piece)
    if held is not None and held[0] == cost and not before(grown, held[1]):
        return False
    best[state] = (cost, grown)
    return True


def _inserted(best: Best) -> Best:
    """Add what insertions lead to. Each costs, so this ends."""
    waiting = sorted(best, key=lambda q: best[q][0])
    while waiting:
        state = waiting.pop(0)
        cost, node = best[state]
        if _offer(best, FORCED[state], cost + INSERT, node, "I"):
            waiting.append(FORCED[state])
    return best


def walked(codes: bytes, state: int) -> Best:
    """The least cost and first audit from a state to every state over rows (role + 4 * fault)."""
    best = _inserted({state: (0, Node())})
    for code in codes:
        role, fault = code & 3, code >> 2
        after: Best = {}
        for q, (cost, node) in best.items():
            _offer(after, q, cost + DELETE, node, "D")
            if fault not in (BLANK, DUPLICATE):
                more = cost + (LEFT_TRUNCATED if fault == TRUNCATED else 0)
                kept = KEEP_TO[q][role]
                if kept is not None:
                    _offer(after, kept, more, node, "K")
                _offer(after, FORCED[q], more + REROLE, node, "R")
        best = _inserted(after)
    return best


def chosen(best: Best) -> tuple[int, str]:
    """Cost and audit of the best state a conversation may end in."""
    found = None
    for state in ENDS:
        if state in best:
            cost, node = best[state]
            if found is None or cost < found[0] or (cost == found[0] and before(node, found[1])):
                found = (cost, node)
    return found[0], found[1].text()


@lru_cache(maxsize=1 << 16)
def audit_of(codes: bytes) -> tuple[int, str]:
    return chosen(walked(codes, START))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by a hash of conversation and turn.

    Of twenty values 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """

    def filled(column: str) -> Column:
        return F.coalesce(named(rows, column).cast("string"), F.lit(" "))

    by = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    return rows.select(
        named(rows, "conv_id").cast("long").alias("conv_id"), named(rows, "turn").cast("long").alias("turn"),
        filled("role").alias("role"), filled("text").alias("text"), by.alias("by"),
    ).where("by <> 0").select(
        "conv_id", "turn", F.when(F.col("by") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, F.lit("")).when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RUN = (
    "conv_id long, first_at long, turn0 long, turn1 long, turns long, head int, tail int, blank long, duplicate long, truncated long, "
    "illegal long, whole boolean, cost long, audit string, costs array<long>, audits array<string>"
)
_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
RUN_SCHEMA = pa.schema([(c, _KINDS[k]) for c, k in (x.split(" ") for x in RUN.split(", "))])
FACTS_SCHEMA = pa.schema([(c, _KINDS[k]) for c, k in (x.split(" ") for x in FACTS.split(", "))])


def _run(conv_id: int | None, rows: list[tuple], whole: bool) -> dict:
    """Facts of consecutive rows (at, turn, code) of one conversation, with its audit or its table."""
    codes = bytes(r[2] for r in rows)
    turns = [r[1] for r in rows if r[1] is not None]
    faults, roles = [c >> 2 for c in codes], [c & 3 for c in codes]
    out = {
        "conv_id": conv_id, "first_at": rows[0][0], "turn0": turns[0] if turns else None, "turn1": turns[-1] if turns else None,
        "turns": len(set(turns)), "head": roles[0], "tail": roles[-1], "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False)), "whole": whole,
        "cost": None, "audit": None, "costs": None, "audits": None,
    }
    if whole:
        out["cost"], out["audit"] = audit_of(codes)
    else:
        tables = [walked(codes, q) for q in range(4)]
        found = [t.get(q) for t in tables for q in range(4)]
        out["costs"] = [None if x is None else x[0] for x in found]
        out["audits"] = [None if x is None else x[1].text() for x in found]
    return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ordered rows. The first and the last of a task may go on in another and are not whole."""
    open_, first, cut = None, True, False
    rows: list[tuple] = []
    for batch in batches:
        out = []
        for conv_id, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "at", "turn", "code")), strict=True):
            if rows and (conv_id != open_ or len(rows) >= PIECE):
                out.append(_run(open_, rows, conv_id != open_ and not first and not cut))
                cut = conv_id == open_
                first, rows = first and cut, []
            open_ = conv_id
            rows.append(tuple(row))
        if out:
            yield pa.RecordBatch.from_pylist(out, RUN_SCHEMA)
    if rows:
        yield pa.RecordBatch.from_pylist([_run(open_, rows, False)], RUN_SCHEMA)


def joined(pieces: list[dict]) -> dict:
    """One conversation from the tables of its pieces."""
    pieces = sorted(pieces, key=lambda p: p["first_at"])
    best: Best = {START: (0, Node())}
    illegal, turns, last_role, last_turn = 0, 0, None, None
    for piece in pieces:
        after: Best = {}
        for q, (cost, node) in best.items():
            for to in range(4):
                if piece["costs"][4 * q + to] is not None:
                    _offer(after, to, cost + piece["costs"][4 * q + to], node, piece["audits"][4 * q + to])
        best = after
        illegal += piece["illegal"] + (last_role is not None and (last_role, piece["head"]) not in LEGAL)
        turns += piece["turns"] - (last_turn is not None and last_turn == piece["turn0"])
        last_role = piece["tail"]
        last_turn = piece["turn1"] if piece["turn1"] is not None else last_turn
    known = [p for p in pieces if p["turn0"] is not None]
    cost, audit = chosen(best)
    return {
        "gaps": known[-1]["turn1"] - known[0]["turn0"] + 1 - turns if known else 0,
        **{c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated")},
        "illegal": illegal, "cost": cost, "audit": audit,
    }


def audited(ordered: DataFrame) -> DataFrame:
    """conv_id and the facts of every conversation of rows (conv_id, at, turn, code), in the order of `at`."""
    folder = scratch_dir(ordered.sparkSession, "audits")
    sorted_ = ordered.repartitionByRange("at").sortWithinPartitions("at")
    found = table_written(sorted_.select("conv_id", "at", "turn", "code").mapInArrow(runs, RUN), f"{folder}/runs")

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        facts = pa.Table.from_pylist([joined(rows.to_pylist())], FACTS_SCHEMA)
        return facts.add_column(0, "conv_id", pa.array([key[0].as_py()], pa.int64()))

    folded = found.where("NOT whole").groupBy("conv_id").applyInArrow(fold, f"conv_id long, {FACTS}")
    whole = found.where("whole").select(
        "conv_id", F.when(F.col("turn0").isNull(), 0).otherwise(F.col("turn1") - F.col("turn0") + 1 - F.col("turns")).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )
    return whole.unionByName(folded)


def in_order(rows: DataFrame, path: str) -> DataFrame:
    """Written rows (conv_id, turn, role, text) with `at`, their place in the order of these four."""
    keys = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return table_written(ranged.withColumn("at", F.monotonically_increasing_id()), path)


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, code of rows in order: the role's initial and four times the first fault."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    said = rows.groupBy("conv_id", "role", F.md5("text").alias("said")).agg(F.min("at").alias("first_at")).select("first_at")
    slim = rows.select("conv_id", "at", "turn", role.alias("as"), last.alias("last"))
    fault = (
        F.when(F.col("last") == "", BLANK).when(F.col("first_at").isNull(), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    )
    return slim.join(said, slim["at"] == said["first_at"], "left").select(
        "conv_id", "at", "turn", (F.col("as") + 4 * fault).cast("int").alias("code")
    )


def repaired(conversations: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation.

    `conversations` has conv_id, turn, role and text, the latter two not null; `given` names
    all conversations (by default these): one without rows has zeros, an empty audit and the
    hash of the empty text. Rows go by turn, null turns first, then by role and text; a null
    conv_id is a conversation of its own. An empty table gives no row.
    """
    folder = scratch_dir(conversations.sparkSession, "repair")
    rows = in_order(conversations.select("conv_id", "turn", "role", "text"), f"{folder}/rows")
    facts = audited(coded(rows))
    every = (conversations if given is None else given).select("conv_id").distinct().withColumn("at", F.lit(-2).cast("long"))
    stream = every.unionByName(facts.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True).unionByName(
        rows.select("conv_id", "at", "role", "text"), allowMissingColumns=True
    )
    names = FACTS_SCHEMA.names

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stream each conversation's audit, then its rows, into the hash of the repaired text."""
        schema = pa.schema([("conv_id", pa.int64()), *FACTS_SCHEMA, ("repaired_sha256", pa.string())])
        now: dict | None = None
        digest, audit, place, state, any_ = hashlib.sha256(), "", 0, START, False

        def put(role: str, text: str) -> None:
            nonlocal any_
            digest.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
            any_ = True

        def insertions() -> None:
            nonlocal place, state
            while audit[place : place + 1] == "I":
                state, place = FORCED[state], place + 1
                put(NAME[state], "")

        def closed() -> dict:
            insertions()
            return {**now, "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            out, columns = [], {c: batch[c].to_pylist() for c in batch.schema.names}
            for n, at in enumerate(columns["at"]):
                if at == -2:
                    if now is not None:
                        out.append(closed())
                    now = {"conv_id": columns["conv_id"][n], **dict.fromkeys(names, 0), "audit": ""}
                    digest, audit, place, state, any_ = hashlib.sha256(), "", 0, START, False
                elif at == -1:
                    now |= {c: columns[c][n] for c in names}
                    audit = now["audit"]
                else:
                    insertions()
                    edit, place = audit[place], place + 1
                    role, text = columns["role"][n], columns["text"][n]
                    if edit == "K":
                        state = KEEP_TO[state]["sua".index(role[0])]
                        put(role, text)
                    elif edit == "R":
                        state = FORCED[state]
                        put(NAME[state], text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(
        written, f"conv_id long, {FACTS}, repaired_sha256 string"
    )
