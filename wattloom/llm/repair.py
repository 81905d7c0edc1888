"""Repair of conversations by the cheapest edits, found by a bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows read and a state of the grammar ``(s?(ua)+)?``; edits are its
arcs. One heap grows from the start, one from the accepting nodes; they stop only when no crossing of the
least cost can be missing, and of all such crossings the least concatenated audit is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattloom.llm.common import SPACE_CHARS

# Costs of the edits, and the grammar's states: nothing read, after s, after u, after a.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
PIECE = 256


def _arcs(codes: str) -> list[list[list[tuple]]]:
    """For every node its arcs (rows read, state, cost, letter). ``codes`` has two characters for each row."""
    n = len(codes) // 2
    out = [[[(i, NEXT[q], INSERT, "I")] for q in range(4)] for i in range(n + 1)]
    for i in range(n):
        initial, fault = codes[2 * i], codes[2 * i + 1]
        for q in range(4):
            out[i][q].append((i + 1, q, DELETE, "D"))
            if fault in "bd":
                continue
            more = TRUNCATED if fault == "t" else 0
            out[i][q].append((i + 1, NEXT[q], REROLE + more, "R"))
            if (q, initial) in STEP:
                out[i][q].append((i + 1, STEP[q, initial], more, "K"))
    return out


def cheapest(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that read all rows from state ``start`` into one of ``ends``.

    Paths of equal cost into one node never have audits of which one begins the other, so the least whole audit
    is the least first part and the least rest. Both heaps order by cost, then by place, then by audit: arcs
    that cost nothing always read a row, so a node's first label is its least.
    """
    n, arcs = len(codes) // 2, _arcs(codes)
    back: list[list[list[tuple]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i, states in enumerate(arcs):
        for q, leaving in enumerate(states):
            for j, r, cost, letter in leaving:
                back[j][r].append((i, q, cost, letter))
    forth = {}
    rest = {}
    heap_f = [(0, 0, "", start)]
    heap_r = [(0, -n, "", q) for q in sorted(ends)]
    best = None
    while heap_f or heap_r:
        top_f = heap_f[0][0] if heap_f else None
        top_r = heap_r[0][0] if heap_r else None
        if best is not None and (top_f is None or top_r is None or top_f + top_r > best):
            break  # every path of the least cost has an arc from a settled node to a settled one
        if top_r is None or (top_f is not None and top_f <= top_r):
            cost, i, audit, q = heappop(heap_f)
            if (i, q) in forth:
                continue
            forth[i, q] = (cost, audit)
            if (i, q) in rest:
                total = cost + rest[i, q][0]
                best = total if best is None else min(best, total)
            for j, r, more, letter in arcs[i][q]:
                if (j, r) not in forth:
                    heappush(heap_f, (cost + more, j, audit + letter, r))
                if (j, r) in rest:
                    total = cost + more + rest[j, r][0]
                    best = total if best is None else min(best, total)
        else:
            cost, minus, audit, q = heappop(heap_r)
            i = -minus
            if (i, q) in rest:
                continue
            rest[i, q] = (cost, audit)
            if (i, q) in forth:
                total = cost + forth[i, q][0]
                best = total if best is None else min(best, total)
            for j, r, more, letter in back[i][q]:
                if (j, r) not in rest:
                    heappush(heap_r, (cost + more, -j, letter + audit, r))
                if (j, r) in forth:
                    total = cost + more + forth[j, r][0]
                    best = total if best is None else min(best, total)
    if best is None:
        return None
    found = []
    for (i, q), (cost, audit) in forth.items():
        if (i, q) in rest and cost + rest[i, q][0] == best:
            found.append(audit + rest[i, q][1])
        for j, r, more, letter in arcs[i][q]:
            if (j, r) in rest and cost + more + rest[j, r][0] == best:
                found.append(audit + letter + rest[j, r][1])
    return best, min(found)


class _Memo(dict):
    """Solved lattices of short conversations, forgotten when they are too many."""

    def solve(self, codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        if len(codes) > 40:
            return cheapest(codes, start, ends)
        key = (codes, start, ends)
        if key not in self:
            if len(self) >= 20_000:
                self.clear()
            self[key] = cheapest(codes, start, ends)
        return self[key]


def apply_edits(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that an audit makes of ``rows`` from a state of the grammar."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = rows[at]
        at += 1
        if letter == "R":
            state = NEXT[state]
            yield ROLE[state], text
        elif letter == "K":
            state = STEP[state, role[:1]]
            yield role, text


class _Conversation:
    """One conversation as its rows stream by, in pieces of ``PIECE`` rows.

    For each state of the grammar it holds the cheapest edits so far and the running digest of what they
    make, so memory is four audits and one piece however long the conversation is.
    """

    def __init__(self, conv, memo: _Memo):
        self.conv, self.memo = conv, memo
        self.states = {0: (0, "", hashlib.sha256(), False)}
        self.rows, self.codes = [], []
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.initial = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if len(self.rows) >= PIECE:
            self._piece((0, 1, 2, 3), False)
        self.rows.append((role, text))
        self.codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)

    def _piece(self, ends: tuple[int, ...], last: bool) -> None:
        codes, found = "".join(self.codes), {}
        for start, (cost, audit, _, _) in self.states.items():
            for end in (None,) if last else ends:
                got = self.memo.solve(codes, start, ends if last else (end,))
                if got is not None:
                    way = (cost + got[0], audit + got[1], start, got[1])
                    if end not in found or way[:2] < found[end][:2]:
                        found[end] = way
        made = {}
        for end, (cost, audit, start, part) in found.items():
            _, _, digest, begun = self.states[start]
            digest = digest.copy()
            for role, text in apply_edits(part, start, self.rows):
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
            made[end] = (cost, audit, digest, begun)
        self.states, self.rows, self.codes = made, [], []

    def result(self) -> tuple:
        self._piece(ACCEPTING, True)
        cost, audit, digest, _ = self.states[None]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return (self.conv, gaps, f["b"], f["d"], f["t"], self.illegal, cost, audit, digest.hexdigest())


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column) -> DataFrame:
    """(conv, turn, role, text, fault) with null roles and texts as one blank; fault is b, d, t or - (none), x for rows that are gone.

    One exchange by conversation serves the search for earlier equal rows and the order of the stream.
    """
    rows = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), gone.alias("gone"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.when(gone, F.lit("")).otherwise(F.coalesce(F.col(text), F.lit(" "))).alias("text"),
    ).repartition("conv")
    seen = W.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.btrim("text", F.lit(SPACE_CHARS))
    fault = (
        F.when(F.col("gone"), "x").when(bare == "", "b").when(F.row_number().over(seen) > 1, "d")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    )
    return rows.withColumn("fault", fault).select("conv", "turn", "role", "text", "fault")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows are taken by turn (nulls first), ties by role and then by text; a repeated row is a duplicate. Null roles and
    texts are one blank. Rows without a conversation id are one conversation of id null. Rows for which
    ``gone`` holds are left out, but their conversation is not: without rows its numbers are 0, its audit is empty.
    Other columns are not read, whatever their names. An empty table gives no rows.

    A conversation has one digest over its repaired rows in their order, so its rows pass one task, but as a
    stream: sorting spills, and of the rows only one piece is held.
    """
    marked = faults(rows, conv, turn, role, text, F.lit(False) if gone is None else gone)
    ordered = marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([
        T.StructField("conv", marked.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in longs),
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, memo = None, [], _Memo()
        for batch in batches:
            for c, t, r, x, f in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(c, memo)
                if f != "x":
                    now.add(t, r, x, f)
            if len(done) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=k.type) for v, k in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k.type) for v, k in zip(zip(*done), arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, Column]:
    """``rows`` with (conv_id, turn, role, text) damaged by the crc32 of their place, and the column that marks dropped rows."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn))) % 20).cast("int")
    body = as_text(text)
    hurt = F.when(kind == 1, "").when(kind == 2, F.translate(body, ".!?", "")).otherwise(body)
    out = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(as_text(role)).alias("role"),
        hurt.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return out, F.col("gone")
