"""Repair of conversations' structure by the cheapest edits, with checkpointed dynamic programming.

A conversation is to be a system turn or none, then turns of user and assistant
by turns. Its turns are kept (K), given the other role (R, 1), deleted (D, 2),
and turns without text inserted (I, 5); a turn whose text is cut off costs 5
more if it stays. Blank turns and copies of earlier ones are deleted. Of the
cheapest lists of edits the least in ASCII order is taken.

The least cost from a place to the end is a vector over four states: nothing
yet, after system, after user, after assistant. Vectors are made from the end
backwards and stored at checkpoints only, one in about the square root of the
turns; then each stretch's vectors are made again while the walk from the front
takes the least tight edit in each place.

On Spark a conversation's turns are first only codes of one byte (role initial
and fault), sorted by ranges of conversation and turn and packed into blocks. A
conversation that lies in one task's range is walked there. Of others, and of
long ones, each block's effect on the vectors is a 4 x 4 table of least costs;
the tables of a conversation are folded from its end, which gives the vectors at
the blocks' ends, and each block is walked from all four states. Texts are
shuffled once, to meet their edits in order.

Defined cases: nulls count as one space, but a null turn comes first and is in
no gap; equal turns are ordered by role and then by a digest of role and text;
turns equal in all are adjacent; roles count by their first character; a
conversation without turns gets zeros and no edits; an empty table gives an
empty table; extra columns are ignored. The list of edits of one conversation
is one string, so it has at most 2**31 letters; its digest is one chain of
bytes, so one task reads the texts of one conversation, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from .arrow_text import record_batch

#: Turns in a block at most.
BLOCK = 1 << 16
#: Bytes of text that are handed on at once.
OUT_BYTES = 4 << 20

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_CLASS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
_BLANK, _COPY, _CUT = 1, 2, 3
_FAR = 1 << 50
#: Least cost from each state when no turn is left.
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _moves(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a turn that leave a turn, in ASCII order: letter, cost and next state."""
    role, fault = divmod(code, 4)
    if fault in (_BLANK, _COPY):
        return ((),) * 4
    more, found = CUT_OFF if fault == _CUT else 0, []
    for state in range(4):
        own = {0: _SYSTEM if state == _START else None, 1: _USER, 2: _ASSISTANT}.get(role)
        keep = own is not None and own in (_SYSTEM, _NEXT[state])
        found.append(((("K", KEEP + more, own),) if keep else ()) + (("R", REROLE + more, _NEXT[state]),))
    return tuple(found)


MOVES = tuple(map(_moves, range(16)))


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector in front of a turn, given the one behind it."""
    own = []
    for state, moves in enumerate(MOVES[code]):
        least = DELETE + after[state]
        for _, cost, to in moves:
            if cost + after[to] < least:
                least = cost + after[to]
        own.append(least)
    start, system, user, assistant = own
    one, two = INSERT + user, 2 * INSERT + assistant
    return min(start, one, two), min(system, one, two), min(user, INSERT + assistant), min(assistant, one)


def table(codes: bytes) -> list[int]:
    """Least cost through the turns from each state to each state, row by row; the edits end with a turn's."""
    columns = []
    for to in range(4):
        vector = tuple(0 if to == x else _FAR for x in range(4))
        for code in reversed(codes):
            vector = before(code, vector)
        columns.append(vector)
    return [min(columns[b][a], _FAR) for a in range(4) for b in range(4)]


def through(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector in front of a block, of its table and the vector behind it."""
    return tuple(min(costs[4 * a + b] + after[b] for b in range(4)) for a in range(4))


def checkpoints(codes: bytes, after: tuple[int, ...]) -> tuple[int, list[tuple[int, ...]]]:
    """Length of a stretch, and the vectors in front of each stretch and behind the last one."""
    step = isqrt(len(codes)) + 1
    kept, vector = [after], after
    for i in range(len(codes) - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % step == 0:
            kept.append(vector)
    return step, kept[::-1]


def walk(codes: bytes, after: tuple[int, ...], states: tuple[int, ...], last: bool) -> list[tuple[str, int, int]]:
    """From each of ``states``: the least edits, their cost and the state they end in. ``last`` says that no turn follows."""
    step, kept = checkpoints(codes, after)
    found = []
    out: list[list[str]] = [[] for _ in states]
    cost, at = [0] * len(states), list(states)
    for k in range(len(kept) - 1):
        part = codes[k * step : (k + 1) * step]
        vectors = [kept[k + 1]]
        for code in reversed(part[1:]):
            vectors.append(before(code, vectors[-1]))
        vectors.append(kept[k])
        vectors.reverse()
        for x in range(len(states)):
            state, letters = at[x], out[x]
            for i, code in enumerate(part):
                now, behind = vectors[i], vectors[i + 1]
                while True:
                    due = now[state]
                    if DELETE + behind[state] == due:
                        letters.append("D")
                        cost[x] += DELETE
                        break
                    if INSERT + now[_NEXT[state]] == due:
                        letters.append("I")
                        cost[x] += INSERT
                        state = _NEXT[state]
                        continue
                    letter, paid, state = next(m for m in MOVES[code][state] if m[1] + behind[m[2]] == due)
                    letters.append(letter)
                    cost[x] += paid
                    break
            at[x] = state
    for x, letters in enumerate(out):
        while last and _END[at[x]]:
            letters.append("I")
            cost[x] += INSERT
            at[x] = _NEXT[at[x]]
        found.append(("".join(letters), cost[x], at[x]))
    return found


_BLOCKS = pa.schema([
    ("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("place", pa.int64()), ("codes", pa.binary()),
    ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("open", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audit", pa.string()),
    ("cost", pa.int64()),
])
_BLOCKS_DDL = (
    "conv string, turn long, role string, digest binary, place long, codes binary, turns long, low long, high long, open boolean, "
    "costs array<long>, audit string, cost long"
)


class _Block:
    """A conversation's next turns as codes, with what is told of their turn numbers."""

    def __init__(self, key: tuple):
        self.key, self.codes = key, bytearray()
        self.turns, self.low, self.high = 0, None, None

    def see(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to blocks; a conversation of one block that neither begins nor ends this task's range is walked at once."""
    serial = TaskContext.get().partitionId() << 36
    block: _Block | None = None
    is_open, rows, size = True, [], 0

    def close(held: _Block, still_open: bool) -> None:
        nonlocal serial, size
        codes = bytes(held.codes)
        costs, audit, cost = (table(codes), None, None) if still_open else (None, *walk(codes, _END, (_START,), True)[0][:2])
        rows.append((*held.key, serial, codes, held.turns, held.low, held.high, still_open, costs, audit, cost))
        serial += 1
        size += len(codes) + 200

    def told() -> pa.RecordBatch:
        return record_batch(_BLOCKS, list(map(list, zip(*rows, strict=True))))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv, turn, role, digest, fault, copies in zip(*columns, strict=True):
            if block is None or block.key[0] != conv:
                if block is not None:
                    close(block, is_open)
                    is_open = False
                block = _Block((conv, turn, role, digest))
            initial = 4 * _CLASS.get(role[:1], _OTHER)
            code, copy = initial + fault, initial + (_BLANK if fault == _BLANK else _COPY)
            for k in range(0, copies, most):
                more = bytes([copy]) * min(most, copies - k)
                more = more if k else bytes([code]) + more[1:]
                if len(block.codes) + len(more) > most:
                    is_open = True
                    close(block, True)
                    block = _Block((conv, turn, role, digest))
                block.see(turn)
                block.codes += more
            if size > OUT_BYTES:
                yield told()
                rows.clear()
                size = 0
    if block is not None:
        close(block, True)
    if rows:
        yield told()


def blocks(convs: DataFrame, most: int = BLOCK) -> DataFrame:
    """The turns of ``convs`` (conv, turn, role, text, digest) as blocks of at most ``most`` codes, in the order of conversation and turn."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", _BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), _CUT).otherwise(0)
    turns = convs.select("conv", "turn", "role", "digest", fault.alias("fault"))
    turns = turns.groupBy("conv", "turn", "role", "digest", "fault").agg(F.count("*").alias("copies"))
    # a copy is what stands in a later turn too; within a turn copies are counted
    turns = written(turns, "turns")
    first = turns.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("conv", "digest", F.col("first.turn").alias("first_turn"), F.lit(True).alias("seen"))
    marked = turns.join(first, ["conv", "digest"], "left")
    later = F.col("seen") & ~F.col("turn").eqNullSafe(F.col("first_turn")) & (F.col("fault") != _BLANK)
    marked = marked.select("conv", "turn", "role", "digest", F.when(later, _COPY).otherwise(F.col("fault")).alias("fault"), "copies")
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(lambda batches: _packed(batches, most), _BLOCKS_DDL), "blocks")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each block of a conversation, from the tables of all its blocks."""
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())])
    for batch in batches:
        for conv, tables in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            vector, out = _END, []
            for part in reversed(tables):
                out.append((conv, part["place"], list(vector), not out))
                vector = through(part["costs"], vector)
            yield record_batch(schema, list(map(list, zip(*out, strict=True))))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits, cost and end of a block from each state."""
    schema = pa.schema([
        ("conv", pa.string()), ("place", pa.int64()), ("audits", pa.list_(pa.string())), ("paid", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))
    ])
    for batch in batches:
        for conv, place, codes, after, last in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            found = walk(codes, tuple(after), (0, 1, 2, 3), last)
            yield record_batch(schema, [[conv], [place], *([[x[i] for x in found]] for i in range(3))])


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block of a conversation begins."""
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("state", pa.int64())])
    for batch in batches:
        for conv, parts in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            state, out = _START, []
            for part in parts:
                out.append((conv, part["place"], state))
                state = part["ends"][state]
            yield record_batch(schema, list(map(list, zip(*out, strict=True))))


def edits(found: DataFrame) -> DataFrame:
    """``found`` (see :func:`blocks`) with audit and cost of every block; a conversation's blocks meet as tables of sixteen numbers each."""
    pending = found.where("open")
    listed = pending.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "costs"))).alias("parts"))
    ends = listed.mapInArrow(_ends, "conv string, place long, after array<long>, last boolean")
    walked = pending.select("conv", "place", "codes").join(ends, ["conv", "place"])
    walked = written(walked.mapInArrow(_walked, "conv string, place long, audits array<string>, paid array<long>, ends array<long>"), "walks")
    begun = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "ends"))).alias("parts"))
    begun = begun.mapInArrow(_begun, "conv string, place long, state long")
    chosen = walked.join(begun, ["conv", "place"]).select(
        "conv", "place", F.col("audits")[F.col("state")].alias("audit"), F.col("paid")[F.col("state")].alias("cost")
    )
    solved = pending.drop("audit", "cost").join(chosen, ["conv", "place"])
    return found.where("not open").unionByName(solved).drop("costs", "open")


_TURNS = pa.schema([("conv", pa.string()), ("line", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = pa.schema([("conv", pa.string()), *[(x, pa.int64()) for x in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Repair:
    """One conversation on its way: blocks come before the first of their turns."""

    def __init__(self, conv: str):
        self.conv, self.state, self.lines = conv, _START, 0
        self.letters: deque[str] = deque()
        self.used: list[str] = []
        self.digest, self.counts = hashlib.sha256(), dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.role = None
        self.turns = 0

    def block(self, codes: bytes, turns: int, low: int | None, high: int | None, audit: str, cost: int) -> None:
        self.letters.extend(audit)
        self.used.append(audit)
        seen = np.bincount(np.frombuffer(codes, np.uint8), minlength=16).reshape(4, 4).sum(0).tolist()
        for name, n in (("blank", seen[_BLANK]), ("duplicate", seen[_COPY]), ("truncated", seen[_CUT]), ("cost", cost)):
            self.counts[name] += n
        role = self.role
        for code in codes:
            self.counts["illegal"] += role is not None and (role, code >> 2) not in _LEGAL
            role = code >> 2
        self.role = role
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        self.counts["gaps"] = 0 if self.low is None else self.high - self.low + 1 - self.turns

    def lines_of(self, role: str | None, text: str | None) -> list[tuple[str, str, str]]:
        """What a turn leaves, as edit, role and text, with what is inserted before it; without a turn, what is inserted at the end."""
        out = []
        while self.letters and (self.letters[0] == "I" or role is not None):
            letter = self.letters.popleft()
            if letter != "D":
                if letter == "K":
                    self.state = _SYSTEM if self.state == _START and role[:1] == "s" else _NEXT[self.state]
                else:
                    self.state = _NEXT[self.state]
                out.append((letter, role if letter == "K" else _ROLE[self.state], "" if letter == "I" else text))
            if letter != "I":
                break
        for _, own, words in out:
            self.digest.update((("\n" if self.lines else "") + own + ":" + words).encode())
            self.lines += 1
        return out

    def summary(self) -> tuple:
        return self.conv, *(self.counts[x] for x in _COUNTS), "".join(self.used), self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch], summaries: bool) -> Iterator[pa.RecordBatch]:
    """Sorted blocks and turns to the turns that are left, or to one row for each conversation."""
    now: _Repair | None = None
    rows: list[tuple] = []
    size = 0

    def put(found: list[tuple[str, str, str]]) -> None:
        nonlocal size
        if not summaries:
            rows.extend((now.conv, now.lines - len(found) + i, *x) for i, x in enumerate(found))
            size += sum(len(x[2]) + 40 for x in found)

    def finish() -> None:
        nonlocal size
        put(now.lines_of(None, None))
        if summaries:
            rows.append(now.summary())
            size += len(rows[-1][-2]) + 200

    def told() -> pa.RecordBatch:
        return record_batch(_SUMMARY if summaries else _TURNS, list(map(list, zip(*rows, strict=True))))

    for batch in batches:
        for conv, role, text, audit, cost, codes, turns, low, high in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    finish()
                now = _Repair(conv)
            if codes is not None:
                now.block(codes, turns, low, high, audit, cost)
            else:
                put(now.lines_of(role, text))
            if size > OUT_BYTES:
                yield told()
                rows.clear()
                size = 0
    if now is not None:
        finish()
    if rows:
        yield told()


def _prepared(convs: DataFrame) -> DataFrame:
    """conv (the id as text), turn, role, text and a digest of role and text; nulls are a space."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    conv = F.coalesce(F.col("conv_id").cast("string"), space)
    return convs.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _run(convs: DataFrame, summaries: bool, most: int) -> DataFrame:
    ship_package(convs.sparkSession)
    turns = _prepared(convs)
    known = edits(blocks(turns, most))
    given = [c for c in known.columns if c not in ("conv", "turn", "role", "digest")]
    turns = turns.select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in given])
    known = known.withColumn("text", F.lit(None).cast("string"))
    # a block has the key of its first turn and stands before it; blocks of one key are in order of place
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest", F.asc_nulls_last("place")]
    both = turns.unionByName(known).repartition("conv").sortWithinPartitions(*order)
    both = both.select("conv", "role", "text", "audit", "cost", "codes", "turns", "low", "high")
    fields = ", ".join(f"{x} long" for x in _COUNTS)
    schema = f"conv string, {fields}, audit string, repaired_sha256 string" if summaries else "conv string, line long, edit string, role string, text string"
    return both.mapInArrow(lambda batches: _repaired(batches, summaries), schema)


def repair(convs: DataFrame, most: int = BLOCK) -> DataFrame:
    """The repaired turns of ``convs`` (conv_id, turn, role, text): conv (the id as text, null as a space), line from 0, edit, role and text."""
    return _run(convs, False, most)


def summaries(convs: DataFrame, ids: DataFrame | None = None, most: int = BLOCK) -> DataFrame:
    """For each conv_id of ``ids`` (by default of ``convs``): gaps, faults, cost and edits, and the digest of the repaired turns.

    Turns are ``role:text``, joined by line breaks.
    """
    every = (convs if ids is None else ids).select("conv_id").distinct()
    found = _run(convs, True, most)
    joined = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))).join(found, "conv", "left")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in _COUNTS]
    nothing = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), nothing)


def damage(convs: DataFrame) -> DataFrame:
    """``convs`` with every twentieth turn, by crc32 of ``conv_id:turn``, dropped, emptied, left without ends of sentences, repeated or given to the user."""
    space = F.lit(" ")
    text = lambda name: F.coalesce(F.col(name).cast("string"), space)
    kind = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("kind")
    rows = convs.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind).where("kind <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), words.alias("text"), copies.alias("copy")).drop("copy")
