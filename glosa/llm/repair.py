"""Conversation structure repair (operator 13): generalised LR repair over the role grammar.

The rows of a conversation, by turn, are read as their roles' initials against
the grammar  C -> (empty) | P | s P,  P -> u a | P u a  (an optional system row, then
pairs of user and assistant rows).  Where the rows don't fit, they are edited:
Keep, Rerole (to user or assistant), Delete, Insert (an empty user or
assistant row).  A graph-structured stack holds all readings at once: a node is an LR
state over the node beneath it, reductions follow these links, and nodes with equal state
merge to the one of least (cost, audit), the audit being the initials of the edits.

An insertion is only made where the next row or the end needs it, so the audits of two tops differ
before either ends, and each top carries its place in their order instead of comparing audits
again.  A top that costs over ``SLACK`` more than the cheapest is let go: two insertions
lead from any top to what follows any other.

Faults: blank rows (no ``[^\\x20\\x09-\\x0D]``) and duplicates (role and text seen earlier in the
conversation) must go; truncated ones (last such character not ``[.!?]``) cost ``TRUNCATED`` unless they go.
Earlier rows are found by a partial aggregation per conversation, role and text, not by a set
per conversation.  One task reads a conversation's rows as a stream, in order; it keeps the tops and
their audits (a character a row), no texts.  The digest of a conversation covers all of it in order,
so the rows of one conversation have to pass one task.

Defined results: null roles and texts are one space; null turns come first; rows of one turn
go by role, then text; a null conversation id is a conversation; repeated rows are duplicates;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import written

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SLACK = 2 * INSERT
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

#: LR states: 0 start, 1 after s, 2 after u, 3 after u a (reduced at once), 4 after P.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 4: {"u": 2}}
ACCEPTING = (0, 4)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


class Node:
    """A stack top: LR ``state`` over ``below``; the least ``cost`` that leads here, ``order`` of its audit among
    the tops, ``audit`` as (letters, before) links, ``digest`` of the rows so far (None: no row yet)."""

    __slots__ = ("state", "below", "cost", "order", "audit", "digest")

    def __init__(self, state, below, cost=0, order=0, audit=None, digest=None):
        self.state, self.below, self.cost, self.order, self.audit, self.digest = state, below, cost, order, audit, digest


def shifted(stack: Node, symbol: str) -> Node | None:
    """The stack after ``symbol``, reduced; None where the grammar doesn't allow it."""
    state = SHIFT[stack.state].get(symbol)
    if state is None:
        return None
    if state != 3:
        return Node(state, stack)
    beneath = stack.below  # P -> u a: off with a and u
    if beneath.state == 4:  # P -> P u a: off with P too
        beneath = beneath.below
    return Node(4, beneath)


def wanted(stack: Node) -> str:
    """The one role that can be written on this stack."""
    return "a" if stack.state == 2 else "u"


def inserted(top: Node) -> Iterator[tuple[Node, str]]:
    """The stacks that insertions lead to, least first, with the roles written; each state once."""
    stack, roles, seen = top, "", set()
    while stack.state not in seen:
        yield stack, roles
        seen.add(stack.state)
        roles += wanted(stack)
        stack = shifted(stack, roles[-1])


def _with(digest, *rows: tuple[str, str]):
    for role, text in rows:
        digest, joint = (hashlib.sha256(), "") if digest is None else (digest.copy(), "\n")
        digest.update(f"{joint}{role}:{text}".encode())
    return digest


class Conversation:
    """The report of one conversation, from its rows in order."""

    def __init__(self):
        self.tops = {0: Node(0, None)}
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None  # the last row
        self.first_turn = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        words = text.strip(WHITE)
        again = not first or self.before == (turn, role, text)
        must_go = not words or again
        cut = bool(words) and not again and words[-1] not in ".!?"
        self.blank += not words
        self.duplicate += bool(words) and again
        self.truncated += cut
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            elif turn != self.before[0]:
                self.gaps += turn - self.before[0] - 1
        self.before = turn, role, text
        found: dict[int, tuple] = {}
        for top in self.tops.values():
            moves = [(DELETE, "D", top, None, "")]
            if not must_go:
                for stack, roles in inserted(top):
                    cost, ins = INSERT * len(roles) + TRUNCATED * cut, "I" * len(roles)
                    kept = shifted(stack, role[:1])
                    if kept is not None:
                        moves.append((cost, ins + "K", kept, role, roles))
                    to = wanted(stack)
                    moves.append((cost + REROLE, ins + "R", shifted(stack, to), ROLES[to], roles))
            for cost, letters, stack, name, roles in moves:
                key = top.cost + cost, top.order, letters
                old = found.get(stack.state)
                if old is None or key < old[0]:
                    found[stack.state] = key, top, stack, name, roles
        bound = min(f[0][0] for f in found.values()) + SLACK
        self.tops = {}
        ranked = sorted((f for f in found.values() if f[0][0] <= bound), key=lambda f: f[0][1:])
        for i, ((cost, _, letters), top, stack, name, roles) in enumerate(ranked):
            digest = top.digest if name is None else _with(top.digest, *((ROLES[r], "") for r in roles), (name, text))
            self.tops[stack.state] = Node(stack.state, stack.below, cost, i, (letters, top.audit), digest)

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)"""
        ends = [((top.cost + INSERT * len(roles), top.order, "I" * len(roles)), top, roles)
                for top in self.tops.values() for stack, roles in inserted(top) if stack.state in ACCEPTING]
        (cost, _, letters), top, roles = min(ends, key=lambda e: e[0])
        digest = _with(top.digest, *((ROLES[r], "") for r in roles)) or hashlib.sha256()
        parts, link = [letters], top.audit
        while link is not None:
            parts.append(link[0])
            link = link[1]
        return (self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(parts)), digest.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and in order -> a row for each conversation."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    now, own, done = None, None, []
    for batch in batches:
        for conv, turn, role, text, first in zip(*(c.to_pylist() for c in batch.columns)):
            if own is None or conv != now:
                if own is not None:
                    done.append((now, *own.result()))
                now, own = conv, Conversation()
            own.add(turn, role, text, first)
        if done:
            yield out(done)
            done = []
    if own is not None:
        yield out([(now, *own.result())])


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))


def _in_order(rows: DataFrame) -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def with_first(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) plus ``first``: no earlier turn has the same role and text.  (Of equal rows
    of one turn, which follow each other, all are marked.)"""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    at = F.struct(F.col("turn").isNotNull().alias("is_set"), F.col("turn").alias("turn"))
    rows = rows.withColumn("key", key)
    least = rows.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(at).alias("least"))
    rows = rows.join(least, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    return rows.select("conv_id", "turn", "role", "text", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"))


def repair_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation."""
    marked = with_first(_plain(rows, conv_id, turn, role, text))
    ordered = marked.repartition("conv_id").sortWithinPartitions(*_in_order(marked))
    return ordered.mapInArrow(_repair, REPORT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, the audit's row first, then the rows in order -> the repaired rows."""
    now, audit, at, place, stack = None, "", 0, 0, None
    out: list[tuple] = []

    def write(edit: str, symbol: str, row: tuple[str, str]) -> None:
        nonlocal at, place, stack
        stack = shifted(stack, symbol)
        out.append((now, place, edit, *row))
        at, place = at + 1, place + 1

    for batch in batches:
        for conv, opens, own, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if opens:
                now, audit, at, place, stack = conv, own, 0, 0, Node(0, None)
            elif audit[at] == "D":
                at += 1
            else:
                symbol = role[:1] if audit[at] == "K" else wanted(stack)
                write(audit[at], symbol, (role if audit[at] == "K" else ROLES[symbol], text))
            while audit[at:at + 1] == "I":  # what stands before the next row, or at the end
                symbol = wanted(stack)
                write("I", symbol, (ROLES[symbol], ""))
        if out:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "place", "edit", "role", "text"])
            out = []


def repaired_rows(rows: DataFrame, report: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations as ``report``'s audits leave them; deleted rows are gone."""
    rows = _plain(rows, conv_id, turn, role, text).select("conv_id", F.lit(False).alias("opens"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    none = F.lit(None)
    audits = report.select("conv_id", F.lit(True).alias("opens"), "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    both = rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", F.col("opens").desc(), *_in_order(rows)[1:])
    return both.mapInArrow(_apply, REPAIRED)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(conv_id:turn) % 20: 0 gone, 1 emptied, 2 without
    ``[.!?]``, 3 twice, 4 as a user's.  Nulls are one space, in the key too."""
    def own(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(own(conv_id), F.lit(":"), own(turn)).cast("binary")) % 20).alias("kind")
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), own(role).alias("role"), own(text).alias("text"), kind).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    by = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", by.alias("role"), said.alias("text"), copies.alias("copy")).drop("copy")


def damaged_report(rows: DataFrame) -> DataFrame:
    """The report of all conversations after damage, also of those that lose every row."""
    report = written(repair_report(damaged(rows)), "repairs").withColumnRenamed("conv_id", "__c")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(report, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
