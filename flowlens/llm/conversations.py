"""Repair of conversations by a rank-convergence parallel Viterbi.

The rows of a conversation in order are edited at least cost so that the initials of their roles read `(s?(ua)+)?`:
Keep (0), Rerole to user or assistant (2), Delete (3, and the only choice for blank and duplicate rows), Insert an empty
row of user or assistant (2); a truncated row that stays adds 1. Four states tell what has been said last (nothing, s,
u, a); the cost of a state at a row is that of the cheapest edits from there on.

Rows are sorted over the cluster by conversation and turn, so that a long conversation lies in many tasks. Each task
cuts its part into chunks and works out a chunk's costs backward from a speculative vector. Fix-up passes give each
chunk the vector at the start of the next one and work it out again, only until its vector differs from the stored one
by a constant: vectors are kept less their minimum, so that is equality, and the rest of the chunk moves by a constant.
When no chunk's end differs from its neighbour's start, the costs are those of one long pass, and one walk forward takes
at each state the ASCII-least edit that a cheapest way begins with. A conversation that lies whole in one chunk needs no
fix-up and is finished where it is; for others the walk streams over the chunks in order, a chunk in memory at a time,
as the hash of the repaired text has to be taken in order anyway.

Defined results: null roles and texts are one space (a blank row, a role that can't be kept); null conversations are one
conversation, null turns come first; rows of equal turn are in the order of role and text; an equal row that repeats is a
duplicate; empty roles have no initial and can't be kept; texts of any length stay whole; further columns are left out,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: The costs after the last row: insertions that end the pattern.
TERMINAL = bytes([0, 4, 2, 0])
SPACE = " \t\n\v\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: A chunk ends at this many rows that may stay, this many rows, or this many characters.
CHUNK, LONGEST, CHARS = 4096, 1 << 16, 1 << 20

_STEPS: dict[tuple[bytes, int], tuple[bytes, int]] = {}
_WALKS: dict[tuple[bytes, int, int], tuple[str, int, int]] = {}


def symbol(role: str, text: str, duplicate: bool) -> int:
    """A row as a number: 4 times its first fault, plus the state that its role leads to (0: it can't be kept)."""
    seen = text.rstrip(SPACE)
    fault = 1 if not seen else 2 if duplicate else 3 if seen[-1] not in ".!?" else 0
    return fault * 4 + {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)


def kept(state: int, to: int) -> bool:
    """Whether a row whose role leads to state `to` may follow."""
    return state == 0 if to == 1 else to > 1 and NEXT[state] == to


def edits(costs: bytes, code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of one row at a state in ASCII order: letter, total cost by the costs behind the row, next state."""
    fault, to = divmod(code, 4)
    found = [("D", DELETE + costs[state], state)]
    if fault in (0, 3):
        extra = TRUNCATED if fault else 0
        if kept(state, to):
            found.append(("K", KEEP + extra + costs[to], to))
        found.append(("R", REROLE + extra + costs[NEXT[state]], NEXT[state]))
    return found


def step(costs: bytes, code: int) -> tuple[bytes, int]:
    """The costs before a row from those behind it: the vector less its minimum, and the minimum."""
    known = _STEPS.get((costs, code))
    if known is None:
        v = [min(c for _, c, _ in edits(costs, code, s)) for s in range(4)]
        v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
        v[0], v[1] = min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2])
        known = _STEPS[costs, code] = bytes(c - min(v) for c in v), min(v)
    return known


def backward(codes: bytes, end: bytes) -> tuple[bytes, int]:
    """The cost vectors before each row and behind the last one, each less its minimum, and the sum of the minima."""
    vectors, base = [end], 0
    for code in reversed(codes):
        vector, low = step(vectors[-1], code)
        vectors.append(vector)
        base += low
    return b"".join(reversed(vectors)), base


def fix_up(codes: bytes, vectors: bytes, base: int, end: bytes) -> tuple[bytes, int, int]:
    """backward() from another end vector, which goes on only until the vector is the stored one; and the rows it took."""
    out, old, new = bytearray(vectors), vectors[-4:], end
    for i in range(len(codes) - 1, -1, -1):
        out[4 * i + 4 : 4 * i + 8] = new
        (old, before), (new, now) = step(old, codes[i]), step(new, codes[i])
        base += now - before
        if old == new:
            return bytes(out), base, len(codes) - i
    out[:4] = new
    return bytes(out), base, len(codes)


def walk(before: bytes, behind: bytes, code: int, state: int) -> tuple[str, int, int]:
    """The least edits up to and with one row: letters, next state, cost of the letters."""
    known = _WALKS.get((behind, code, state))
    if known is None:
        low, letters, at, spent = step(behind, code)[1], "", state, 0
        while True:
            total = before[at] + low
            choice = {c: (cost, to) for c, cost, to in edits(behind, code, at) if cost == total}
            if "D" not in choice and INSERT + before[NEXT[at]] == before[at]:
                letters, at, spent = letters + "I", NEXT[at], spent + INSERT
                continue
            letter = min(choice)
            cost, to = choice[letter]
            known = _WALKS[behind, code, state] = letters + letter, to, spent + cost - behind[to]
            break
    return known


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by the checksum of `conv_id:turn`. A dropped row stays as
    one that is gone, so that its conversation is known."""
    part = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), part.alias("part"),
    )
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("part") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("part") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class Repaired:
    """One conversation as its chunks come by."""

    def __init__(self, conv, keep_rows: bool):
        self.conv, self.keep_rows = conv, keep_rows
        self.state, self.cost, self.lines, self.rows = 0, 0, 0, []
        self.audit, self.hash, self.faults = [], hashlib.sha256(), [0, 0, 0, 0]
        self.turns, self.least, self.last, self.initial, self.illegal = 0, None, None, None, 0

    def put(self, role: str, text: str, edit: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        if self.keep_rows:
            self.rows.append((self.conv, self.lines, role, text, edit))
        self.lines += 1

    def insert(self, letters: str) -> None:
        for _ in letters:
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], "", "I")

    def add(self, codes: bytes, vectors: bytes, turns: list, roles: list[str], texts: list[str]) -> None:
        for i, code in enumerate(codes):
            turn, initial = turns[i], roles[i][:1]
            if turn is not None and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            self.faults[code // 4] += 1
            letters, to, cost = walk(vectors[4 * i : 4 * i + 4], vectors[4 * i + 4 : 4 * i + 8], code, self.state)
            self.cost += cost
            self.audit.append(letters)
            self.insert(letters[:-1])
            if letters[-1] != "D":
                self.put(roles[i] if letters[-1] == "K" else ROLES[to], texts[i], letters[-1])
            self.state = to

    def end(self) -> tuple:
        while TERMINAL[self.state]:
            self.cost += INSERT
            self.audit.append("I")
            self.insert("I")
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
ROWS_SQL = "conv_id long, position long, role string, text string, edit string"
CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("open", pa.bool_()), ("codes", pa.binary()), ("vectors", pa.binary()), ("base", pa.int64()),
    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
CHUNKS_SQL = "conv_id long, chunk long, open boolean, codes binary, vectors binary, base long, turns array<long>, roles array<string>, texts array<string>"


def batches_of(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that together weigh about as much as a chunk."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + weight(row)
        if size > CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of the rows in order, with costs from a speculative end. `open` marks those that may not be the whole of
    their conversation: the first and last ones of a task, and those of conversations that are cut."""
    same = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256), "gone").orderBy("turn")
    marked = rows.select("conv_id", "turn", "role", "text", "gone", (F.row_number().over(same) > 1).alias("again"))
    order = ["conv_id", "turn", "role", "text", "again"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def cut() -> Iterator[tuple]:
            nonlocal number
            conv, first, is_open, held, staying, size = object(), True, True, [], 0, 0

            def chunk(is_open: bool) -> tuple:
                nonlocal number
                codes = bytes(r[0] for r in held)
                number += 1
                return conv, number, is_open, codes, *backward(codes, TERMINAL), *([r[c] for r in held] for c in (1, 2, 3))

            for batch in batches:
                for own, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns)):
                    if own != conv:
                        if not first:
                            yield chunk(is_open)
                            is_open = False
                        conv, first, held, staying, size = own, False, [], 0, 0
                    elif staying >= CHUNK or len(held) >= LONGEST or size >= CHARS:
                        is_open = True
                        yield chunk(True)
                        held, staying, size = [], 0, 0
                    if not gone:
                        code = symbol(role, text, again)
                        held.append((code, turn, role, text))
                        staying += code // 4 in (0, 3)
                        size += len(text)
            if not first:
                yield chunk(True)

        yield from batches_of(cut(), CHUNKS, lambda r: sum(map(len, r[8])) + 16 * len(r[3]))

    return dealt.mapInArrow(run, CHUNKS_SQL)


def settled(made: DataFrame) -> DataFrame:
    """conv_id, chunk, vectors, base of the open chunks, after as many fix-up passes as it takes."""
    work = made.where("open").select("conv_id", "chunk", "codes", "vectors", "base")
    # A chunk of forced deletions hands on the vector that it gets, so chunks look beyond it.
    through = F.hex("codes").rlike("^(0[4-9AB])*$")
    ahead = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    order = work.select("conv_id", "chunk", through.alias("through"))
    follows = order.select("conv_id", "chunk", F.last(F.when(~F.col("through"), F.col("chunk")), ignorenulls=True).over(ahead).alias("following"))
    work = materialise(work.join(follows.select("chunk", "following"), "chunk").select("conv_id", *work.columns[1:], "following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                end = row.pop("end")
                row["rows"] = 0
                if end != row["vectors"][-4:]:
                    row["vectors"], row["base"], row["rows"] = fix_up(row["codes"], row["vectors"], row["base"], end)
            schema = pa.schema([*(f for f in batch.schema if f.name != "end"), pa.field("rows", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = "conv_id long, chunk long, codes binary, vectors binary, base long, following long, rows long"
    while True:
        start = work.select(F.col("chunk").alias("following"), F.expr("substring(vectors, 1, 4)").alias("start"))
        ends = work.join(start, "following", "left").withColumn("end", F.coalesce("start", F.lit(TERMINAL)))
        if not ends.where("end != substring(vectors, -4, 4)").limit(1).count():
            return work
        before, work = work, materialise(ends.select("conv_id", "chunk", "codes", "vectors", "base", "following", "end").mapInArrow(run, schema).drop("rows"))
        discard(before)


def repaired(rows: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Per conversation its faults, the cost and letters of the edits and a hash of what they give; with keep_rows the
    repaired rows themselves: conv_id, position, role, text, edit. `rows` has conv_id, turn, role, text and gone."""
    made = materialise(chunks(rows), "zstd")
    schema = ROWS if keep_rows else REPORT

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv != row["conv_id"] or not row["open"]:
                    if now:
                        yield now.end()
                        if keep_rows:
                            yield from now.rows
                    now = Repaired(row["conv_id"], keep_rows)
                now.add(row["codes"], row["vectors"], row["turns"], row["roles"], row["texts"])
                if keep_rows:
                    yield from now.rows
                    now.rows.clear()
        if now:
            yield now.end()
            yield from now.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (r for r in results(batches) if len(r) == len(schema))
        yield from batches_of(wanted, schema, lambda r: len(r[3]) + len(r[4]) if keep_rows else len(r[7]))

    columns = [f.name for f in CHUNKS if f.name != "base"]
    fixed = settled(made).select(F.col("chunk").alias("_chunk"), F.col("vectors").alias("_vectors"))
    some = made.where("open").drop("vectors").join(fixed, F.col("chunk") == F.col("_chunk")).withColumnRenamed("_vectors", "vectors").select(*columns)
    long = some.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    sql = ROWS_SQL if keep_rows else REPORT_SQL
    return made.where("not open").select(*columns).mapInArrow(run, sql).unionByName(long.mapInArrow(run, sql))


def repair_report(conversations: DataFrame) -> DataFrame:
    """What repaired() finds for the conversations after damage."""
    return repaired(damaged(conversations))
