"""Cheapest repair of the turn structure of conversations, by block tables of a four-state machine.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. Every row is one of nine symbols: it must go
(blank, or role and text seen earlier), or it has the initial s, u, a or another, and is whole or truncated. Edits in the
order of their initials: Delete 2, Insert an empty user or assistant row 5, Keep 0, Rerole to user or assistant 1; a
truncated row that stays adds 5.

The vector of the costs from each state to the end is carried from the last row to the first. Less the cost of its first
state it is one of a few dozen vectors, so for every such vector and every block of ``BLOCK`` symbols a table holds the
vector before the block and the cost that it adds; a conversation is read by one lookup per block. The edits are traced
forward: each block is expanded backward from the vector behind it, and of all edits on a cheapest path the one with the
least initial is taken, which gives the least audit text of all cheapest repairs.

Symbols are found by columns: a digest stands for the text, and the first turn of repeated (conversation, role, text) is
aggregated before it is joined. One task then streams a conversation, sorted, and holds a byte per row. The digest of a
repaired conversation is sequential by nature, so a second stream meets the audit first, then the texts one batch at a
time. No conversation is ever held whole with its texts.

Edge cases: null role or text counts as one space, and so does a null conv_id or turn in the checksum; a null conv_id is a
conversation of its own. Rows of equal turn are ordered by role, then by the SHA-256 of the text; equal rows of one turn
are one first row and its duplicates. A role of another first character than s, u, a has to be changed or deleted.
Conversations whose rows are all dropped have zeros, an empty audit and the digest of the empty text. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols per block.
BLOCK = 4
#: Symbols: what must go; whole rows by initial; truncated rows by initial.
GONE, INITIALS, SYMBOLS = 0, "sua", 9
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. Where an inserted or a renamed row leads, and how it is named.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NAMED = ("user", "user", "assistant", "user")
#: Where a row that is kept leads, by state and initial.
KEPT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
#: Inserts that end a conversation from each state.
ENDS = ("", "II", "I", "")

FINE, BLANK, DUPLICATE, CUT = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")

_JUDGED = pa.schema([("conv_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("audit", pa.string())])
_REBUILT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def symbol(initial: str, truncated: bool) -> int:
    place = INITIALS.find(initial) if initial else -1
    return 1 + (place if place >= 0 else 3) + 4 * truncated


def _meaning(s: int) -> tuple[str, int]:
    """Initial (empty if it is none of the three) and what staying adds."""
    return "sua"[(s - 1) % 4 : (s - 1) % 4 + 1], TRUNCATED if s > 4 else 0


def _before(after: tuple[int, ...], s: int) -> tuple[int, ...]:
    """Costs to the end from each state before a row, given those behind it."""
    costs = [DELETE + c for c in after]
    if s != GONE:
        initial, added = _meaning(s)
        for state in range(4):
            costs[state] = min(costs[state], REROLE + added + after[NEXT[state]])
            if initial in KEPT[state]:
                costs[state] = min(costs[state], added + after[KEPT[state][initial]])
    for _ in range(2):  # inserts, one after another
        for state in (AFTER_U, AFTER_A, AFTER_S, START):
            costs[state] = min(costs[state], INSERT + costs[NEXT[state]])
    return tuple(costs)


class Tables:
    """Vectors by number, the step over one symbol, the table of blocks, and the edits of a step."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors = [(0, 10, 5, 0)]  # behind the last row: the inserts that remain
        numbers = {self.vectors[0]: 0}
        steps, added = [], []
        for vector in self.vectors:  # grows while it is read
            row, costs = [], []
            for s in range(SYMBOLS):
                before = _before(vector, s)
                normal = tuple(c - before[0] for c in before)
                if normal not in numbers:
                    numbers[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(numbers[normal])
                costs.append(before[0])
            steps.append(row)
            added.append(costs)
        self.step, self.cost = np.array(steps), np.array(added)
        jump, price = np.arange(len(steps))[:, None], np.zeros((len(steps), 1), np.int64)
        for _ in range(block):  # one more symbol in front of all blocks so far
            price = (price[:, None, :] + self.cost[jump].transpose(0, 2, 1)).reshape(len(steps), -1)
            jump = self.step[jump].transpose(0, 2, 1).reshape(len(steps), -1)
        self.codes = {bytes(b): i for i, b in enumerate(itertools.product(range(SYMBOLS), repeat=block))}
        self.jump, self.price = jump.tolist(), price.tolist()
        self.step, self.cost = self.step.tolist(), self.cost.tolist()
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _edit(self, s: int, behind: int, state: int) -> tuple[str, int]:
        """Least edits up to and with a row, and the state behind it."""
        key = (s, behind, state)
        if key not in self.edits:
            after = self.vectors[behind]
            before = _before(after, s)
            initial, added = _meaning(s) if s != GONE else ("", 0)
            done = ""
            while True:
                if DELETE + after[state] == before[state]:
                    done += "D"
                    break
                if INSERT + before[NEXT[state]] == before[state]:
                    done, state = done + "I", NEXT[state]
                elif initial in KEPT[state] and added + after[KEPT[state][initial]] == before[state]:
                    done, state = done + "K", KEPT[state][initial]
                    break
                else:
                    done, state = done + "R", NEXT[state]
                    break
            self.edits[key] = done, state
        return self.edits[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost, and of the edits that reach it the least in ASCII order."""
        whole = len(symbols) - len(symbols) % self.block
        vector, cost = 0, 0
        tail = [0]
        for s in reversed(symbols[whole:]):
            cost += self.cost[vector][s]
            vector = self.step[vector][s]
            tail.append(vector)
        behind = []  # the vector behind each block, last block first
        for at in range(whole - self.block, -1, -self.block):
            behind.append(vector)
            code = self.codes[symbols[at : at + self.block]]
            cost += self.price[vector][code]
            vector = self.jump[vector][code]
        cost += self.vectors[vector][START]
        state, audit = START, []
        for at in range(0, whole, self.block):
            part = symbols[at : at + self.block]
            inner = [behind.pop()]
            for s in reversed(part[1:]):
                inner.append(self.step[inner[-1]][s])
            for s in part:
                done, state = self._edit(s, inner.pop(), state)
                audit.append(done)
        tail.pop()
        for s in symbols[whole:]:
            done, state = self._edit(s, tail.pop(), state)
            audit.append(done)
        return cost, "".join(audit) + ENDS[state]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped) by the checksum of ``conv_id:turn``, one row per row."""
    space = F.lit(" ")
    conv_id, turn = (F.col(c).cast("bigint") for c in ("conv_id", "turn"))
    key = F.concat(F.coalesce(conv_id.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    return conversations.select(
        conv_id.alias("conv_id"), turn.alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _order(turn: str = "turn") -> Column:
    """Compares as turns do, nulls first."""
    return F.struct(F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"))


def _with_digest(rows: DataFrame) -> DataFrame:
    """Every copy as a row, dropped rows once; the digest tells texts apart."""
    once = F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1))))
    rows = rows.select("*", once.alias("copy")).drop("copy")
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault, gone: what decides, without texts. Duplicates within a turn are not marked yet."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = rows.select(
        "conv_id", "turn", "role", "digest", (F.col("copies") == 0).alias("gone"),
        F.when(blank, BLANK).when(whole, FINE).otherwise(CUT).alias("fault"),
    )
    seen = slim.filter(f"NOT gone AND fault <> {BLANK}").groupBy("conv_id", "role", "digest").agg(
        F.min(_order()).alias("first"), F.max(_order()).alias("last")
    )
    seen = seen.filter("first <> last").select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    )
    later = (F.col("fault") != BLANK) & F.coalesce(_order() > F.col("first"), F.lit(False))
    return slim.join(seen, same, "left").select(
        "conv_id", "turn", "role", "digest", "gone", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault")
    )


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples of Python values; integers stay exact beside nulls."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _full(rows: list[tuple], audit: str) -> bool:
    return len(rows) >= 10_000 or len(audit) > 1 << 20


def _judge(block: int):
    """Sorted rows of conversations to one row each: conv_id, counts, audit."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, done = Tables(block), []
        for conv_id, members in itertools.groupby(_rows(batches), lambda r: r[0]):
            symbols, faults, illegal = bytearray(), [0, 0, 0, 0], 0
            before = last = low = high = None
            distinct = 0
            for _, turn, role, digest, gone, fault in members:
                if gone:
                    continue
                if (turn, role, digest) == before and fault != BLANK:
                    fault = DUPLICATE
                before = turn, role, digest
                faults[fault] += 1
                symbols.append(GONE if fault in (BLANK, DUPLICATE) else symbol(role[:1], fault == CUT))
                illegal += last is not None and last + role[:1] not in LEGAL
                last = role[:1]
                if turn is not None and turn != high:  # sorted, so a change is a turn not seen before
                    low, high = turn if low is None else low, turn
                    distinct += 1
            cost, audit = tables.repair(bytes(symbols))
            gaps = high - low + 1 - distinct if distinct else 0
            done.append((conv_id, [gaps, *faults[1:], illegal, cost], audit))
            if _full(done, audit):
                yield _table(_JUDGED, done)
                done = []
        if done:
            yield _table(_JUDGED, done)

    return judge


def _rebuilt(audit: str, texts: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, one by one."""
    state = START
    edits = iter(audit)
    for edit in edits:
        if edit == "I":
            yield NAMED[state], ""
        else:
            *_, role, text = next(texts)
            if edit == "D":
                continue
            yield (role if edit == "K" else NAMED[state]), text
        state = KEPT[state][role[0]] if edit == "K" else NEXT[state]


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations, the audit first and then the sorted texts, to counts, audit and the digest of the repaired text."""
    done: list[tuple] = []
    for conv_id, members in itertools.groupby(_rows(batches), lambda r: r[0]):
        _, counts, audit, _, _ = next(members)
        digest, between = hashlib.sha256(), ""
        for role, text in _rebuilt(audit, members):
            digest.update(f"{between}{role}:{text}".encode("utf-8", "replace"))
            between = "\n"
        done.append((conv_id, *counts, audit, digest.hexdigest()))
        if _full(done, audit):
            yield _table(_REBUILT, done)
            done = []
    if done:
        yield _table(_REBUILT, done)


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, the six counts, audit, repaired_sha256 of rows (conv_id, turn, role, text, copies); see ``damaged``."""
    rows = _with_digest(conversations)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    judged = (
        _symbols(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
        .mapInArrow(_judge(block), "conv_id bigint, counts array<bigint>, audit string")
    )
    none = {"counts": "array<bigint>", "audit": "string", "turn": "bigint", "role": "string", "digest": "binary", "text": "string"}

    def of_kind(kind: int, df: DataFrame) -> DataFrame:
        rest = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        return df.select("conv_id", F.lit(kind).alias("kind"), *rest)

    return (
        of_kind(0, judged).unionByName(of_kind(1, rows.filter("copies > 0"))).repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order)
        .select("conv_id", "counts", "audit", "role", "text")
        .mapInArrow(_rebuild, "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")
    )
