"""Conversation structure repair: a stream per conversation, sorted by turn.

Rows are dealt by conversation and sorted by turn inside their task (secondary sort); one
pass carries the state of a dynamic program across Arrow batches. A repaired conversation
has the role initials ``(s?(ua)+)?``. States are what has been written so far: nothing, a
system turn, a pair that is open (a user turn), closed pairs. Every row is kept, given
another role or deleted, with an inserted turn before it where that is cheaper; for each
state the program holds the cost of the cheapest edits so far and the rank of their audit
string among the four. No audit string of the same rows is the beginning of another one (each
ends with the edit of the last row), so ranks are strict and ties end in the least string.

A row leaves one byte per state, from which the edits are traced back. A conversation of
ordinary size is traced and applied at once. A giant one is spilled: every ``BLOCK_ROWS``
rows or ``BLOCK_CHARS`` characters its backpointers and turns go out as a row of a stored
table, and memory holds one block. Its blocks are then traced in descending order, and the
edits applied block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.common import store, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
START, SYSTEM, OPEN, CLOSED = range(4)
SOLID, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
NEVER = 1 << 60
# Edits of one row, least string first; the place is the code in a backpointer.
STEPS = ("D", "IK", "IR", "K", "R")
NO_STEP = 255
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def _after(state: int) -> int:
    """State after the one turn that may be inserted (or given its role) in ``state``."""
    return CLOSED if state == OPEN else OPEN


def _steps(initial: str, bad: bool, cut: bool) -> list[tuple[int, int, int, int]]:
    """``(state before, code of the edits, cost, state after)`` of a row: its initial, whether
    it must go, whether it is truncated."""
    found = [(state, STEPS.index("D"), DELETE, state) for state in range(4)]
    if bad:
        return found
    late = TRUNCATED if cut else 0
    for state in range(4):
        for name, where, cost in (("", state, 0), ("I", _after(state), INSERT)):
            wanted = "a" if where == OPEN else "u"
            if initial == wanted:
                found.append((state, STEPS.index(name + "K"), cost + KEEP + late, _after(where)))
            elif initial == "s" and where == START:
                found.append((state, STEPS.index(name + "K"), cost + KEEP + late, SYSTEM))
            if initial != wanted:
                found.append((state, STEPS.index(name + "R"), cost + REROLE + late, _after(where)))
    return found


_TABLE = {(i, b, c): _steps(i, b, c) for i in ("s", "u", "a", "") for b in (False, True) for c in (False, True)}


class Program:
    """Costs and ranks of the four states; :meth:`row` returns the backpointers of a row."""

    def __init__(self):
        self.cost = [0, NEVER, NEVER, NEVER]
        self.rank = [0, 0, 0, 0]

    def row(self, initial: str, bad: bool, cut: bool) -> bytes:
        best: list[tuple | None] = [None] * 4
        for before, step, price, after in _TABLE[initial if initial in "sua" else "", bad, cut]:
            if self.cost[before] >= NEVER:
                continue
            new = (self.cost[before] + price, self.rank[before], step, before)
            if best[after] is None or new < best[after]:
                best[after] = new
        order = sorted((b[1], b[2], k) for k, b in enumerate(best) if b)
        for place, (_, _, k) in enumerate(order):
            self.rank[k] = place
        self.cost = [b[0] if b else NEVER for b in best]
        return bytes(NO_STEP if b is None else b[3] * 8 + b[2] for b in best)

    def end(self) -> tuple[int, int]:
        """Cost of the whole conversation, and the state in which its rows end; turns that are
        still missing then are inserted."""
        missing = [0, 2 * INSERT, INSERT, 0]
        cost, _, state = min((c + m, r, k) for k, (c, m, r) in enumerate(zip(self.cost, missing, self.rank, strict=True)))
        return cost, state


TAIL = ("", "II", "I", "")


def trace(pointers: bytes, state: int) -> tuple[str, int]:
    """Edits of the rows behind ``pointers`` that end in ``state``, and the state before."""
    found = []
    for at in range(len(pointers) - 4, -1, -4):
        code = pointers[at + state]
        found.append(STEPS[code & 7])
        state = code >> 3
    return "".join(reversed(found)), state


def apply(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Turns after the edits, beginning in ``state``."""
    out_roles, out_texts, row = [], [], 0
    for edit in edits:
        if edit == "D":
            row += 1
            continue
        wanted = "assistant" if state == OPEN else "user"
        if edit == "K" and roles[row][:1] == "s":
            state = SYSTEM
        else:
            state = _after(state)
        out_roles.append(roles[row] if edit == "K" else wanted)
        out_texts.append("" if edit == "I" else texts[row])
        row += edit != "I"
    return out_roles, out_texts


class _Conversation:
    """What is carried of a conversation: the program, counters and the block at hand."""

    def __init__(self, key):
        self.key, self.blocks, self.program = key, 0, Program()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.last = self.first_turn = self.last_turn = None
        self.turns = 0
        self.clear()

    def clear(self) -> None:
        self.pointers, self.roles, self.texts, self.chars = bytearray(), [], [], 0

    def add(self, turn, role: str, text: str, solid: bool, seen: bool, cut: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        counts, row = self.counts, (turn, role, text)
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            counts["illegal"] += 1
        repeated = seen or row == self.last
        self.last = row
        counts["blank"] += not solid
        counts["duplicate"] += solid and repeated
        cut = solid and not repeated and cut
        counts["truncated"] += cut
        self.pointers += self.program.row(role[:1], not solid or repeated, cut)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def block(self, end: bool) -> tuple:
        """The block at hand as a row; at the end with the results of the conversation."""
        pointers, state, cost, edits, counts = bytes(self.pointers), None, None, None, [None] * len(COUNTS)
        roles, texts = self.roles, self.texts
        if end:
            cost, state = self.program.end()
            if self.turns:
                self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
            counts = [self.counts[c] for c in COUNTS]
            if not self.blocks:
                edits = trace(pointers, state)[0] + TAIL[state]
                roles, texts = apply(edits, START, roles, texts)
        row = (self.key, self.blocks, None if edits is not None else pointers, state, edits, roles, texts, cost, *counts)
        self.blocks += 1
        self.clear()
        return row


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_BLOCK_FIELDS = [
    ("block_no", pa.int64()), ("pointers", pa.binary()), ("end_state", pa.int32()), ("edits", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("cost", pa.int64()),
    *((c, pa.int64()) for c in COUNTS),
]
_BLOCK_DDL = (
    "block_no long, pointers binary, end_state int, edits string, roles array<string>, texts array<string>, cost long, "
    + ", ".join(f"{c} long" for c in COUNTS)
)


def _forward(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Blocks of all conversations; the only block of an ordinary one is finished already."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        schema, done, size = None, [], 0
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.column(0).type), *_BLOCK_FIELDS])
            for at in range(0, batch.num_rows, 256):
                for key, turn, role, text, solid, seen, cut, present in zip(
                    *(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True
                ):
                    if now is None or now.key != key:
                        if now is not None:
                            size += now.chars
                            done.append(now.block(True))
                        now = _Conversation(key)
                    if present:
                        if len(now.roles) >= block_rows or now.chars >= block_chars:
                            size += now.chars
                            done.append(now.block(False))
                        now.add(turn, role, text, solid, seen, cut)
                    if len(done) >= 1024 or size >= block_chars:
                        yield _batch(done, schema)
                        done, size = [], 0
        if now is not None:
            yield _batch([*done, now.block(True)], schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, {_BLOCK_DDL}")


def _traced(spilled: DataFrame) -> DataFrame:
    """``conv_id, block_no, from_state, edits`` of spilled blocks, traced from the last one."""
    dealt = spilled.select("conv_id", "block_no", "pointers", "end_state").repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.desc("block_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = START
        for batch in batches:
            schema = pa.schema([
                ("conv_id", batch.column(0).type), ("block_no", pa.int64()), ("from_state", pa.int32()), ("edits", pa.string())
            ])
            done = []
            for key, number, pointers, end_state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tail = ""
                if end_state is not None:  # the last block of a conversation comes first
                    state, tail = end_state, TAIL[end_state]
                edits, state = trace(pointers, state)
                done.append((key, number, state, edits + tail))
            yield _batch(done, schema)

    kind = spilled.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, block_no long, from_state int, edits string")


def _applied(spilled: DataFrame, traced: DataFrame) -> DataFrame:
    """Spilled blocks with their edits applied."""
    edits = traced.select(F.col("conv_id").alias("c"), F.col("block_no").alias("b"), "from_state", F.col("edits").alias("e"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block_no") == F.col("b"))
    kept = ["conv_id", "block_no", "cost", *COUNTS]
    both = spilled.drop("edits").join(edits, same).select(*kept, "from_state", F.col("e").alias("edits"), "roles", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                state, edits, roles, texts = (batch.column(len(kept) + k)[at].as_py() for k in range(4))
                roles, texts = apply(edits, state, roles, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(at, 1) for k in range(len(kept))),
                        pa.array([edits], pa.string()), pa.array([roles], pa.list_(pa.string())),
                        pa.array([texts], pa.list_(pa.string())),
                    ],
                    names=[*kept, "edits", "roles", "texts"],
                )

    kind = spilled.schema["conv_id"].dataType.simpleString()
    ddl = ", ".join(f"{c} long" for c in kept[1:])
    return both.mapInArrow(run, f"conv_id {kind}, {ddl}, edits string, roles array<string>, texts array<string>")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``solid`` (has a character that is no white space), ``seen`` (the same role and
    text in an earlier turn) and ``cut`` (truncated).

    Only role and text that occur more than once in a conversation are joined to; they are
    counted before the shuffle and stored, so that a short list is not shuffled against."""
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    repeated = store(
        rows.filter("present").groupBy("conv_id", "role", "digest")
        .agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.count_if(F.col("turn").isNull()).alias("nulls"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least", "nulls"),
        "repeated-turns",
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    # Null turns come first. Copies within a turn lie side by side and are met in the stream.
    later = F.col("turn").isNotNull() & ((F.col("nulls") > 0) | (F.col("turn") > F.col("least")))
    joined = rows.join(repeated, same, "left")
    return joined.select(
        "conv_id", "turn", "role", "text",
        F.col("text").rlike(SOLID).alias("solid"),
        F.coalesce(later, F.lit(False)).alias("seen"),
        (~F.col("text").rlike(ENDED)).alias("cut"),
        "present",
    )


def repair(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", present_col: str | None = None,
    block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Repaired conversations in blocks: ``conv_id, block_no, cost, gaps, blank, duplicate,
    truncated, illegal, edits, roles, texts``, stored.

    ``roles`` and ``texts`` are the turns after the edits, ``edits`` their initials; counts and
    cost stand in the last block of a conversation and are null before. Rows go by turn, a
    null turn first, rows of equal turn by role and text; a null role or text is one space; a
    null key is a conversation like any other. Where ``present_col`` is false a row only names
    its conversation. A conversation without rows has empty edits. Repeated rows are
    duplicates. A conversation of any length and texts of any length are repaired whole; an
    empty table gives an empty table; other columns are not looked at.
    """
    space = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    present = F.coalesce(F.col(f"`{present_col}`"), F.lit(False)) if present_col else F.lit(True)
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), present.alias("present"),
    )
    blocks = store(_forward(_with_faults(rows), block_rows, block_chars), "turn-blocks")
    spilled = blocks.filter("edits IS NULL")
    kept = ["conv_id", "block_no", "cost", *COUNTS, "edits", "roles", "texts"]
    finished = blocks.filter("edits IS NOT NULL").select(kept)
    return store(finished.unionByName(_applied(spilled, _traced(spilled)).select(kept)), "repaired-turns")


def messages(repaired: DataFrame) -> DataFrame:
    """``conv_id, block_no, place, role, text``: a row for each repaired turn, in the order of
    block and place."""
    both = F.arrays_zip("roles", "texts")
    return repaired.select("conv_id", "block_no", F.posexplode(both).alias("place", "m")).select(
        "conv_id", "block_no", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text")
    )


def _hash(joined: Column) -> Column:
    return F.sha2(joined.cast("binary"), 256)


def reports(repaired: DataFrame) -> DataFrame:
    """``conv_id``, the five counts, ``cost, audit, repaired_sha256`` of every conversation.

    What fills one block is hashed where it lies; blocks of giant conversations are hashed
    in their order as a stream, with one block in memory."""
    kept = ["conv_id", *COUNTS, "cost"]
    line = F.transform(F.arrays_zip("roles", "texts"), lambda m: F.concat(m["roles"], F.lit(":"), m["texts"]))
    single = (F.col("block_no") == 0) & F.col("cost").isNotNull()
    ordinary = repaired.filter(single).select(
        *kept, F.col("edits").alias("audit"), _hash(F.array_join(line, "\n")).alias("repaired_sha256")
    )
    giant = repaired.filter(~single).select(*kept, "block_no", "edits", "roles", "texts").repartition("conv_id")
    giant = giant.sortWithinPartitions("conv_id", "block_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, state, begun = [], hashlib.sha256(), False
        for batch in batches:
            types = [batch.column(0).type, *[pa.int64()] * (len(kept) - 1), pa.string(), pa.string()]
            schema = pa.schema(list(zip([*kept, "audit", "repaired_sha256"], types, strict=True)))
            done = []
            for at in range(batch.num_rows):
                *head, _, edits, roles, texts = (c[at].as_py() for c in batch.columns)
                audit.append(edits)
                for role, text in zip(roles, texts, strict=True):
                    state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
                if head[-1] is not None:  # the last block
                    done.append((*head, "".join(audit), state.hexdigest()))
                    audit, state, begun = [], hashlib.sha256(), False
            yield _batch(done, schema)

    kind = repaired.schema["conv_id"].dataType.simpleString()
    ddl = ", ".join(f"{c} long" for c in kept[1:])
    return ordinary.unionByName(giant.mapInArrow(run, f"conv_id {kind}, {ddl}, audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the remainder of a checksum of
    their key. 0: absent; 1: no text; 2: no sentence ends; 3: twice; 4: a user's."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = (
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    )
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return reports(repair(rows, present_col="present"))
