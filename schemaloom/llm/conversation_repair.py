"""Repairs the order of roles in conversations with the cheapest edits, by block tables (the Four Russians' method).

A conversation is a string of symbols, one per row: its role's initial, whether it is cut short, or that it must go. The
cost of repairing the rest, as a vector over the four states of ``(s?(ua)+)?``, differs from its least entry in few
ways, so that the vectors are numbered and what BLOCK symbols do to each of them is worked out beforehand.
Blocks are looked up from the end to the start; from the start on each block is then expanded backward from the
vector behind it, which tells at every row all edits of least cost, and the smallest letter is taken.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import hash128
from schemaloom.runtime import materialise

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Symbols that are looked up at once.
BLOCK = 4
#: Initials of roles; any other is the last class. A symbol is 2 * class + (cut short), or GONE.
ROLES = "sua"
GONE = 8
SYMBOLS = 9
#: States: nothing yet, after system, after user, after assistant. What a user's or an assistant's row leads to.
ORDERLY = (2, 2, 3, 2)
#: Where a kept row of each class leads to from each state, None where it is out of order.
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The least cost behind the last row.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a conversation's texts that are held; more go to a file of the task.
HELD = 1 << 24

FIELDS = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def options(after: tuple, state: int, symbol: int) -> list[tuple[int, str, int]]:
    """(cost of the rest, letter, next state) of the edits of a row, but for insertions before it."""
    out = [(DELETE + after[state], "D", state)]
    if symbol != GONE:
        role, cut = divmod(symbol, 2)
        kept = KEPT[state][role]
        if kept is not None:
            out.append((CUT * cut + after[kept], "K", kept))
        out.append((REROLE + CUT * cut + after[ORDERLY[state]], "R", ORDERLY[state]))
    return out


def vector_before(after: tuple, symbol: int) -> tuple:
    """The least cost from each state on, with one more row in front."""
    found = [min(o[0] for o in options(after, q, symbol)) for q in range(4)]
    for _ in range(3):
        found = [min(found[q], INSERT + found[ORDERLY[q]]) for q in range(4)]
    return tuple(found)


class Tables:
    """The vectors that occur, less their least entry; what a symbol and what a block does to each."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, number = [END], {END: 0}
        to, cost = [], []
        for vector in self.vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                before = vector_before(vector, symbol)
                low = min(before)
                before = tuple(x - low for x in before)
                if before not in number:
                    number[before] = len(self.vectors)
                    self.vectors.append(before)
                to.append(number[before])
                cost.append(low)
        self.to = np.array(to).reshape(-1, SYMBOLS)
        self.cost = np.array(cost).reshape(-1, SYMBOLS)
        codes = np.arange(SYMBOLS**block)
        at = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        total = np.zeros_like(at)
        for place in range(block):  # the last symbol of a block comes first
            symbol = codes // SYMBOLS**place % SYMBOLS
            total += self.cost[at, symbol]
            at = self.to[at, symbol]
        self.block_to, self.block_cost = at, total
        self.expand = lru_cache(1 << 16)(self._expand)

    def row(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        """The letters up to a row's own and the state behind it, the smallest letters of those of least cost."""
        before = vector_before(self.vectors[behind], symbol)
        letters = ""
        while True:
            ways = options(self.vectors[behind], state, symbol)
            ways.append((INSERT + before[ORDERLY[state]], "I", ORDERLY[state]))
            letter, state = min((letter, q) for cost, letter, q in ways if cost == before[state])
            letters += letter
            if letter != "I":
                return letters, state

    def _expand(self, behind: int, symbols: bytes, state: int) -> tuple[str, int]:
        """The letters of some rows, given the vector behind the last of them and the state before the first."""
        vectors = [behind]
        for symbol in symbols[:0:-1]:
            vectors.append(int(self.to[vectors[-1], symbol]))
        letters = ""
        for symbol, vector in zip(symbols, reversed(vectors)):
            more, state = self.row(vector, symbol, state)
            letters += more
        return letters, state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and the edits' letters, smallest in ASCII order, of a string of symbols."""
        odd = len(symbols) % self.block
        blocks = np.frombuffer(symbols, np.uint8)[odd:].reshape(-1, self.block).astype(np.int64)
        codes = blocks @ (SYMBOLS ** np.arange(self.block)[::-1])
        behind = np.zeros(len(codes) + 1, np.int32)  # the vector behind each block
        cost, vector = 0, 0
        for i in range(len(codes) - 1, -1, -1):
            code = codes[i]
            cost += int(self.block_cost[vector, code])
            vector = int(self.block_to[vector, code])
            behind[i] = vector
        first = vector
        for symbol in symbols[:odd][::-1]:
            cost += int(self.cost[vector, symbol])
            vector = int(self.to[vector, symbol])
        cost += self.vectors[vector][0]
        letters, state = self.expand(first, symbols[:odd], 0) if odd else ("", 0)
        parts = [letters]
        for i in range(len(codes)):
            at = odd + i * self.block
            letters, state = self.expand(int(behind[i + 1]), symbols[at : at + self.block], state)
            parts.append(letters)
        parts.append("I" * (END[state] // INSERT))
        return cost, "".join(parts)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class Conversation:
    """The rows of one conversation as they come, in order; texts beyond a bound are in a file of the task."""

    def __init__(self, conv_id, kind: pa.DataType | None = None):
        self.conv_id, self.kind = conv_id, kind
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.turn = 0, None, None
        self.initial: str | None = None
        self.rows: list[tuple[str, str, int]] = []
        self.held, self.spool = 0, None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        """So many equal rows; ``seen`` if an earlier one has their role and text."""
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.turn = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # no role may follow itself
        self.initial = initial
        written = text.rstrip(SPACE)
        cut = not written.endswith((".", "!", "?"))
        if not written:
            self.blank += copies
            self.symbols += bytes([GONE]) * copies
        else:
            again = copies - (not seen)
            self.duplicate += again
            if not seen:
                self.truncated += cut
                role_class = ROLES.find(initial) if initial in ROLES and initial else len(ROLES)
                self.symbols.append(2 * role_class + cut)
            self.symbols += bytes([GONE]) * again
        self.rows.append((role, text, copies))
        self.held += len(role) + len(text) + 100
        if self.held > HELD:
            self._put_away()

    def _put_away(self) -> None:
        if self.spool is None:
            self.spool = tempfile.TemporaryFile()
        for role, text, copies in self.rows:
            data = [role.encode(), text.encode()]
            self.spool.write(np.array([copies, *map(len, data)], np.int64).tobytes() + b"".join(data))
        self.rows, self.held = [], 0

    def _all_rows(self) -> Iterator[tuple[str, str, int]]:
        if self.spool is not None:
            self.spool.seek(0)
            while head := self.spool.read(24):
                copies, a, b = np.frombuffer(head, np.int64).tolist()
                yield self.spool.read(a).decode(), self.spool.read(b).decode(), copies
        yield from self.rows

    def summary(self) -> tuple:
        cost, audit = tables().repair(bytes(self.symbols))
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that are left or inserted."""
        letters = iter(audit)
        state = 0

        def inserted(letter: str | None) -> Iterator[tuple[str, str, str]]:
            nonlocal state
            while letter == "I":
                state = ORDERLY[state]
                yield "I", ("user" if state == 2 else "assistant"), ""
                letter = next(letters, None)
            return letter

        for role, text, copies in self._all_rows():
            for _ in range(copies):
                letter = yield from inserted(next(letters))
                if letter == "D":
                    continue
                if letter == "K":
                    state = KEPT[state][ROLES.index(role[0])]
                    yield "K", role, text
                else:
                    state = ORDERLY[state]
                    yield "R", ("user" if state == 2 else "assistant"), text
        yield from inserted(next(letters, None))

    def close(self) -> None:
        if self.spool is not None:
            self.spool.close()


def in_order(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct rows of ``turns(conv_id, turn, role, text, copies)``, by conversation and in order, with the number of each
    and whether an earlier turn has its role and text; and a row without role for each of ``ids(conv_id)``.

    Equal rows are counted before the shuffle, so that a row that is repeated often is one. What an earlier turn has is
    found by the hash of role and text; only those on several turns are joined.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = materialise(rows.withColumn("key", hash128(F.to_json(F.struct("role", "text")))))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    often = rows.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    often = often.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    joined = rows.join(often, same, "left")
    seen = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    marks = ids.select("conv_id").distinct()
    nothing = [F.lit(None).cast(t).alias(n) for n, t in [("turn", "long"), ("role", "string"), ("text", "string")]]
    marks = marks.select("conv_id", *nothing, F.lit(0).cast("long").alias("copies"), F.lit(False).alias("seen"))
    every = joined.select("conv_id", "turn", "role", "text", "copies", seen.alias("seen")).unionByName(marks)
    order = ["conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text"]
    return every.repartition("conv_id").sortWithinPartitions(*order)


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """One conversation after the other of rows in order; the caller closes it."""
    talk: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns)):
            if talk is None or conv_id != talk.conv_id:
                if talk is not None:
                    yield talk
                talk = Conversation(conv_id, batch.schema.field("conv_id").type)
            if copies:
                talk.add(turn, role, text, copies, seen)
    if talk is not None:
        yield talk


def filled(turns: DataFrame) -> DataFrame:
    """``turns`` with one copy of each row, a null role or text being one space."""
    space = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    one = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumns(space)
    return one.withColumn("copies", F.lit(1).cast("long"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` damaged by the crc32 of ``conv_id:turn`` modulo 20 (nulls: one space), with the copies
    of each row: 0 drops it, 1 empties its text, 2 takes out ``.!?``, 3 doubles it, 4 makes it the user's."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = filled(turns).withColumn("code", F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("code <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of
    ``turns(conv_id, turn, role, text, copies)``, and of ``ids(conv_id)``, as ``filled`` or ``damaged`` give them.

    Rows are taken by turn (nulls first), those of one turn by role and text. A row is blank, a duplicate (its
    role and text came earlier) or truncated, the first of these that holds. The cheapest edits that give role
    initials ``(s?(ua)+)?`` cost ``cost``; ``audit`` has their initials (Keep, Rerole, Delete, Insert), the smallest in ASCII
    order of all such. A null id is a conversation of its own. One without rows has zeros, no letters and
    the hash of nothing; no ids, no rows.

    The letters of a conversation are one value and its hash runs over its texts one after the other; so its
    distinct rows go through one task, as one byte each, and texts beyond HELD bytes wait in a file of the task.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"{FIELDS.format(kind)}, repaired_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows(ids: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        size = 0
        for talk in conversations(batches):
            summary = talk.summary()
            digest, between = hashlib.sha256(), b""
            for _, role, text in talk.repaired(summary[-1]):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            talk.close()
            out.append((*summary, digest.hexdigest()))
            size += 200 + len(summary[-1])
            if size > HELD // 8:
                size = 0
                yield rows(talk.kind)
        if out:
            yield rows(talk.kind)

    return in_order(turns, turns if ids is None else ids).mapInArrow(run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations of ``turns``, numbered from 0, with the edit
    (K, R or I) that each comes from; conversations that keep no row have none. Cases as in ``audits``."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def batch_of(part: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*part), kinds)]
        return pa.record_batch(columns, ["conv_id", "place", "edit", "role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for talk in conversations(batches):
            part: list[tuple] = []
            size = 0
            for place, (edit, role, text) in enumerate(talk.repaired(talk.summary()[-1])):
                part.append((talk.conv_id, place, edit, role, text))
                size += len(text)
                if size > HELD:
                    yield batch_of(part, talk.kind)
                    part, size = [], 0
            if part:
                yield batch_of(part, talk.kind)
            talk.close()

    schema = f"conv_id {kind}, place long, edit string, role string, text string"
    return in_order(turns, turns).mapInArrow(run, schema)
