"""Conversation repair by the cheapest edits, with block tables (Four Russians).

The roles of a repaired conversation spell ``(s?(ua)+)?``, which four states
follow.  What the rest of a conversation costs at least is a vector over the
states; less its minimum it takes few values.  A table holds, for each such
vector and each block of ``BLOCK`` rows, the vector before the block and the
cost added.  A conversation is read a block at a lookup from its end; then the
blocks are expanded from the other side, with the costs known on both sides of
every row, so that of all cheapest repairs the one with the least audit is
spelt, letter by letter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import ship

BLOCK = 4               # rows of a block

# The edits' costs, and the states: nothing yet, after s, after u, after a.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {EMPTY: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
# Rows as symbols: 0 none (fills a block), 1 must go, 2.. the role's initial (s, u, a, another), whole or truncated.
NONE, MUST_GO, INITIALS = 0, 1, "sua?"
SYMBOLS = 2 + 2 * len(INITIALS)
FAR = 1 << 30


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return MUST_GO
    return 2 + 2 * (INITIALS.index(initial) if initial and initial in "sua" else 3) + truncated


def _moves(row: int, state: int):
    """(letter, role's initial, cost, next state) of the edits that use a row."""
    yield "D", "", DELETE, state
    if row >= 2:
        initial, truncated = INITIALS[(row - 2) // 2], (row - 2) % 2 * CUT_OFF
        if initial in NEXT[state]:
            yield "K", initial, KEEP + truncated, NEXT[state][initial]
        for role in "ua":
            if role in NEXT[state]:
                yield "R", role, REROLE + truncated, NEXT[state][role]


def _inserts(state: int):
    for role in "ua":
        if role in NEXT[state]:
            yield "I", role, INSERT, NEXT[state][role]


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first; three in a row reach all that any number does."""
    for _ in range(3):
        costs = [min([costs[s], *(c + costs[t] for _, _, c, t in _inserts(s))]) for s in range(4)]
    return tuple(costs)


END = _closed([0, FAR, FAR, 0])


def before(row: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from before a row, given those from after it."""
    if row == NONE:
        return after
    return _closed([min(c + after[t] for _, _, c, t in _moves(row, s)) for s in range(4)])


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All normalised vectors that occur, the first that of the end; for each
    and each block (its last row the lowest digit) the vector before it and
    the cost taken off."""
    vectors, place, one, off = [END], {END: 0}, [], []
    for v in vectors:                                   # grows while it is read
        row = []
        for r in range(SYMBOLS):
            w = before(r, v)
            low = min(w)
            w = tuple(x - low for x in w)
            if w not in place:
                place[w] = len(vectors)
                vectors.append(w)
            row.append((place[w], low))
        one.append([x for x, _ in row])
        off.append([x for _, x in row])
    one, off = np.array(one, np.int32), np.array(off, np.int32)
    step, cost = one, off
    for _ in range(BLOCK - 1):                          # one more row in front: it becomes the highest digit
        cost = (cost[:, None, :] + off[step].transpose(0, 2, 1)).reshape(len(vectors), -1)
        step = one[step].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, step, cost


def audit_of(rows: bytes) -> tuple[int, str, str]:
    """Symbols -> (cost, audit, initials): the cheapest edits' letters, least
    in ASCII order among equals, and for every letter the role it gives."""
    vectors, step, cost = tables()
    filled = np.frombuffer(rows + bytes(-len(rows) % BLOCK), np.uint8).reshape(-1, BLOCK).astype(np.int64)
    blocks = (filled @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()
    now, total, right = 0, 0, [0] * len(blocks)
    for b in range(len(blocks) - 1, -1, -1):
        right[b] = now
        total += int(cost[now, blocks[b]])
        now = int(step[now, blocks[b]])
    total += vectors[now][EMPTY]
    state, audit, roles = EMPTY, [], []
    for b in range(len(blocks)):
        inside = filled[b].tolist()
        costs = [vectors[right[b]]]
        for r in reversed(inside):
            costs.append(before(r, costs[-1]))
        costs.reverse()
        for i, r in enumerate(inside):
            while r != NONE:
                ways = [(w, True) for w in _moves(r, state)] + [(w, False) for w in _inserts(state)]
                w, used = min((x for x in ways if x[0][2] + costs[i + x[1]][x[0][3]] == costs[i][state]), key=lambda x: x[0][0])
                audit.append(w[0])
                roles.append(w[1])
                state = w[3]
                if used:
                    break
    left = END
    while left[state]:
        letter, role, c, state = next(w for w in _inserts(state) if w[2] + left[w[3]] == left[state])
        audit.append(letter)
        roles.append(role)
    return total, "".join(audit), "".join(x or "-" for x in roles)


ROLE = {"u": "user", "a": "assistant"}
REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


class _Conversation:
    """What one conversation needs while its rows go by: counts and a byte a
    row, then a running hash; never its texts."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.counts = conv_id, bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last, self.turns, self.low, self.high, self.turn = 0, None, 0, None, None, None
        self.solved = None

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        self.rows.append(symbol(initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def solve(self) -> None:
        self.solved = audit_of(bytes(self.rows))
        self.at, self.hash, self.first = 0, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserted(self) -> None:
        audit, roles = self.solved[1:]
        while self.at < len(audit) and audit[self.at] == "I":
            self._put(ROLE[roles[self.at]], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        if self.solved is None:
            self.solve()
        self._inserted()
        letter, initial = self.solved[1][self.at], self.solved[2][self.at]
        if letter != "D":
            self._put(role if letter == "K" else ROLE[initial], text)
        self.at += 1

    def result(self) -> tuple:
        if self.solved is None:
            self.solve()
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, *self.solved[:2], self.hash.hexdigest())


def _repair(batches):
    schema = pa.schema([("conv_id", pa.int64()), *[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, done = None, []
    for b in batches:
        for conv_id, second, gone, turn, initial, fault, role, text in zip(
                *(b.column(c).to_pylist() for c in ("conv_id", "second", "gone", "turn", "initial", "fault", "role", "text"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            if gone:
                continue
            if second:
                now.text(role, text)
            else:
                now.add(turn, initial, fault)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.result(), schema)], schema=schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with their planted faults, by crc32 of ``conv_id:turn`` modulo
    20: 0 gone, 1 without text, 2 without ``.!?``, 3 twice, 4 of role user.
    A null counts as one space; rows that are gone stay, marked."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def _fault(earlier: Column) -> Column:
    """A row's first fault, or empty."""
    solid = F.rtrim(F.col("text"), F.lit("\t\n\x0b\x0c\r "))
    return (F.when(solid == "", "blank").when(earlier, "duplicate")
            .when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone, copy) -> one row per conversation,
    with its faults, the least cost, the audit and the repaired text's hash.

    A conversation's rows go by turn (nulls first), then role, text and copy,
    so the order of equal turns is settled by what the rows hold.  Null conv_id
    is a conversation.  A role other than s, u and a by its first character,
    an empty one too, can only be rewritten or deleted.

    One shuffle, by conversation; windows and the last pass reuse it, and sort
    on disk where memory ends.  The last pass sees each conversation's rows
    twice, first what the edits need and then the texts, and holds a byte and a
    letter a row.  A conversation goes through one task, as its hash must be
    taken from one end to the other.
    """
    ship(rows.sparkSession)
    order = ["turn", "role", "text", "copy"]
    placed = rows.repartition("conv_id").withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("at")) > 1
    marked = placed.withColumn("fault", _fault(earlier)).withColumn("initial", F.substring("role", 1, 1))
    both = marked.withColumn("second", F.explode(F.when(F.col("gone"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    first = ~F.col("second")
    return (both.select("conv_id", "second", "at", "gone", "turn", F.when(first, F.col("initial")).alias("initial"),
                        F.when(first, F.col("fault")).alias("fault"), F.when(~first, F.col("role")).alias("role"),
                        F.when(~first, F.col("text")).alias("text"))
            .sortWithinPartitions("conv_id", "second", "at")
            .mapInArrow(_repair, REPAIRED))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) damaged and repaired; every
    conv_id comes back, one without rows left with zeros, an empty audit and the
    hash of nothing.  Other columns are not read; an empty table gives no rows."""
    return repair(damage(conversations))
