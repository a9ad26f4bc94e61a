"""Repair of the turn structure of conversations.

A repaired conversation reads, by the initials of its roles, `(s?(ua)+)?`. Every row is
kept, given another role or deleted, and empty turns may be inserted; the cheapest edits
win, of equal ones the string of their initials that is least in ASCII order (the audit).

The state after some rows is one of four: nothing yet, after a system turn, after a user
turn, after an assistant turn. A step takes the insertions before a row and the row's own
edit, so the audits of all paths to a row hold equally many edits of rows and none is a
prefix of another; their order can then be kept as a rank beside the cost. Hirschberg's
method finds the path in linear space: a forward vector (cost and rank by state) and a
backward vector (cost by state) meet in the middle, of the states with the least sum the
one of the least rank is the crossing, and both halves follow in the same way.

Only flags of rows are needed for that, one byte a row. They are sorted by range and cut
into segments, so that a long conversation lies in many tasks; a segment's 4 x 4 costs
and ranks stand for it when the crossings between segments are chosen, and each segment
is then solved by itself. Texts are shuffled once, at the end, to be put together. The
digest of a repaired conversation is one SHA-256 of all its text, which has no parallel
form: there one task reads the conversation's rows one by one and holds none.
"""
from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: Rows of a segment at most, and rows that are handed on at once.
SEGMENT, BATCH = 8192, 2048
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEVER = 1 << 60
#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Flags of a row: 4 * role + fault.
ROLES, (FINE, CUT, BLANK, REPEATED) = "sua", range(4)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _after(state: int, role: int) -> int | None:
    """The state after a turn of a role (0 to 2: s, u, a), None where it may not stand."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if state == USER and role == 2 else None


def _needed(state: int) -> int:
    """The role of an inserted or changed turn."""
    return 2 if state == USER else 1


def _insertions(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after up to two insertions; more come back to a state."""
    found = [(state, 0, "")]
    for _ in range(2):
        state, cost, audit = found[-1]
        found.append((_after(state, _needed(state)), cost + INSERT, audit + "I"))
    return found


@functools.cache
def _steps(flags: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """(cost, audit) of the best insertions and edit of one row from state to state."""
    role, fault = divmod(flags, 4)
    best: list[list] = [[None] * 4 for _ in STATES]
    for x in STATES:
        for at, cost, audit in _insertions(x):
            edits = [(at, DELETE, "D")]
            if fault in (FINE, CUT):
                extra = TRUNCATED if fault == CUT else 0
                edits += [(_after(at, role), extra, "K"), (_after(at, _needed(at)), REROLE + extra, "R")]
            for y, more, edit in edits:
                if y is not None:
                    step = (cost + more, audit + edit)
                    best[x][y] = min(best[x][y] or step, step)
    return tuple(map(tuple, best))


#: (cost, audit) of the insertions that end a conversation, by state.
ENDS = tuple(min((c, a) for y, c, a in _insertions(x) if y in (START, ASSISTANT)) for x in STATES)


def _ranked(best: list[tuple | None]) -> tuple[int, tuple]:
    """(least cost, vector) from the (cost, order) of each state: a vector holds costs
    beyond the least one and ranks."""
    least = min(b[0] for b in best if b)
    order = {b[1]: n for n, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1]))}
    return least, tuple((b[0] - least, order[b[1]]) if b else None for b in best)


@functools.cache
def _forward_step(vector: tuple, flags: int) -> tuple[int, tuple]:
    steps = _steps(flags)
    best: list = [None] * 4
    for x, v in enumerate(vector):
        if v:
            for y in STATES:
                if step := steps[x][y]:
                    found = (v[0] + step[0], (v[1], step[1]))
                    best[y] = min(best[y] or found, found)
    return _ranked(best)


@functools.cache
def _backward_step(vector: tuple, flags: int) -> tuple[int, tuple]:
    steps = _steps(flags)
    costs = [min([s[0] + v for s, v in zip(steps[x], vector) if s and v < NEVER], default=NEVER) for x in STATES]
    least = min(costs)
    return least, tuple(c - least if c < NEVER else NEVER for c in costs)


class Rows:
    """A segment of rows, a byte of flags each, as a chain of steps. Vectors beyond
    their least cost are few, so a step is a look into a table."""

    def __init__(self, flags: bytes):
        self.flags = flags

    def __len__(self):
        return len(self.flags)

    def forward(self, lo: int, hi: int, state: int) -> list[tuple[int, int] | None]:
        total, vector = 0, tuple((0, 0) if x == state else None for x in STATES)
        for flags in self.flags[lo:hi]:
            cost, vector = _forward_step(vector, flags)
            total += cost
        return [(total + v[0], v[1]) if v else None for v in vector]

    def backward(self, lo: int, hi: int, state: int) -> list[int]:
        total, vector = 0, tuple(0 if x == state else NEVER for x in STATES)
        for flags in reversed(self.flags[lo:hi]):
            cost, vector = _backward_step(vector, flags)
            total += cost
        return [total + v if v < NEVER else NEVER for v in vector]

    def leaf(self, i: int, x: int, y: int) -> str:
        return _steps(self.flags[i])[x][y][1]


class Segments:
    """The segments of a conversation, each by its forward vectors from every state."""

    def __init__(self, moves: list[list[list[tuple[int, int] | None]]]):
        self.moves = moves

    def __len__(self):
        return len(self.moves)

    def forward(self, lo: int, hi: int, state: int) -> list[tuple[int, int] | None]:
        vector: list = [(0, 0) if x == state else None for x in STATES]
        for moves in self.moves[lo:hi]:
            best: list = [None] * 4
            for x, v in enumerate(vector):
                for y in STATES:
                    if v and (m := moves[x][y]):
                        found = (v[0] + m[0], (v[1], m[1]))
                        best[y] = min(best[y] or found, found)
            least, vector = _ranked(best)
            vector = [(least + v[0], v[1]) if v else None for v in vector]
        return vector

    def backward(self, lo: int, hi: int, state: int) -> list[int]:
        vector = [0 if x == state else NEVER for x in STATES]
        for moves in reversed(self.moves[lo:hi]):
            vector = [min([m[0] + v for m, v in zip(moves[x], vector) if m and v < NEVER], default=NEVER)
                      for x in STATES]
        return vector

    def leaf(self, i: int, x: int, y: int) -> tuple[int, int]:
        return x, y


def hirschberg(chain: Rows | Segments, x: int, y: int) -> list:
    """The leaf of each step on the least path from state x to state y."""
    found, todo = [], [(0, len(chain), x, y)]
    while todo:
        lo, hi, x, y = todo.pop()
        if hi - lo == 1:
            found.append(chain.leaf(lo, x, y))
        elif hi > lo:
            mid = (lo + hi) // 2
            ahead, behind = chain.forward(lo, mid, x), chain.backward(mid, hi, y)
            state = min((s for s in STATES if ahead[s]), key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
            todo += [(mid, hi, state, y), (lo, mid, x, state)]
    return found


def last_state(chain: Rows | Segments) -> int:
    """The state before the final insertions of the least path from the start."""
    ahead = chain.forward(0, len(chain), START)
    return min((s for s in STATES if ahead[s]), key=lambda s: (ahead[s][0] + ENDS[s][0], ahead[s][1]))


@functools.lru_cache(1 << 16)
def _short_audit(flags: bytes) -> str:
    return whole_audit(flags)


def whole_audit(flags: bytes) -> str:
    """The audit of a conversation in one segment."""
    rows = Rows(flags)
    state = last_state(rows)
    return "".join(hirschberg(rows, START, state)) + ENDS[state][1]


# Tables --------------------------------------------------------------------

def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times) with faults by crc32(`conv_id:turn`) % 20: 0
    drops the row (times 0), 1 empties the text, 2 takes its `.`, `!` and `?` away, 3
    repeats the row (times 2), 4 makes it the user's. Nulls are one space, but a null
    turn or conversation stays null in its column."""
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20
    text = filled(text_col)
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(filled(role_col)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the digest of role and text, by which equal ones meet and ties of turns
    are ordered."""
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("mark", mark)


def _flags(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, n, first, rest): equal rows once, with the flags of the
    first and of its repetitions."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(ends, FINE).otherwise(CUT)
    role = F.substring("role", 1, 1)
    role = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    seen = (rows.where("times > 0").select("conv_id", "turn", "mark", role.alias("r"), fault.alias("f"), "times")
            .groupBy("conv_id", "turn", "mark").agg(F.first("r").alias("r"), F.first("f").alias("f"),
                                                    F.sum("times").alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (seen.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m"))
             .agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    later = F.col("earliest").isNotNull() & (place != F.col("earliest"))
    return (seen.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
            .select("conv_id", "turn", "mark", "n",
                    (4 * F.col("r") + F.when((F.col("f") != BLANK) & later, REPEATED).otherwise(F.col("f")))
                    .alias("first"),
                    (4 * F.col("r") + F.when(F.col("f") == BLANK, BLANK).otherwise(REPEATED)).alias("rest")))


def _packed(moves) -> list[int]:
    return [n for row in moves for m in row for n in (m or (NEVER, 0))]


def _unpacked(numbers: list[int]):
    pairs = [(a, b) if a < NEVER else None for a, b in zip(numbers[::2], numbers[1::2])]
    return [pairs[i:i + 4] for i in range(0, 16, 4)]


def _cut(kind: pa.DataType, size: int):
    """Segments of sorted rows. A conversation that lies inside the partition and in one
    segment is solved at once; any other may go on elsewhere and gets its moves."""
    schema = pa.schema([("conv_id", kind), ("turn", pa.int64()), ("mark", pa.binary()), ("nth", pa.int64()),
                        ("flags", pa.binary()), ("audit", pa.string()), ("moves", pa.list_(pa.int64()))])

    def run(batches):
        out, conv, key, flags, nth, inside = [], None, None, bytearray(), 0, False

        def close(whole):
            data = bytes(flags)
            audit = (_short_audit(data) if len(data) <= 64 else whole_audit(data)) if whole else None
            moves = None if whole else _packed([Rows(data).forward(0, len(data), x) for x in STATES])
            out.append((*key, nth, data, audit, moves))

        def batch():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        begun = False
        for b in batches:
            for c, turn, mark, n, first, rest in zip(*[b[k].to_pylist() for k in
                                                       ("conv_id", "turn", "mark", "n", "first", "rest")]):
                if not begun or c != conv:
                    if flags:
                        close(inside and not nth)
                    conv, key, nth, inside, begun = c, (c, turn, mark), 0, begun, True
                    flags.clear()
                code = first
                while n:
                    if len(flags) == size:
                        close(False)
                        flags.clear()
                        key, nth = (c, turn, mark), nth + 1
                    take = 1 if code == first and code != rest else min(n, size - len(flags))
                    flags += bytes([code]) * take
                    n -= take
                    code = rest
                if len(out) >= BATCH:
                    yield batch()
        if flags:
            close(False)
        if out:
            yield batch()
    return run


def _cross(batches):
    """The states in which each segment of a conversation begins and ends."""
    conv, keys, moves = None, [], []

    def solved():
        chain = Segments(moves)
        end = last_state(chain)
        ways = hirschberg(chain, START, end)
        tails = [""] * (len(keys) - 1) + [ENDS[end][1]]
        columns = [*zip(*keys), *zip(*ways), tails]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          ["conv_id", "turn", "mark", "nth", "x", "y", "tail"])

    for b in batches:
        types = [b.schema.field("conv_id").type, pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(),
                 pa.string()]
        for c, turn, mark, nth, m in zip(*[b[k].to_pylist() for k in ("conv_id", "turn", "mark", "nth", "moves")]):
            if keys and c != conv:
                yield solved()
                keys, moves = [], []
            conv = c
            keys.append((c, turn, mark, nth))
            moves.append(_unpacked(m))
    if keys:
        yield solved()


def _solve(batches):
    for b in batches:
        audits = ["".join(hirschberg(Rows(flags), x, y)) + tail for flags, x, y, tail in
                  zip(*[b[k].to_pylist() for k in ("flags", "x", "y", "tail")])]
        yield pa.RecordBatch.from_arrays([*[b[k] for k in ("conv_id", "turn", "mark", "nth", "flags")],
                                          pa.array(audits, pa.string())],
                                         ["conv_id", "turn", "mark", "nth", "flags", "audit"])


def audit_segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, mark, nth, flags, audit): the edits of every segment, keyed by its
    first row, from keyed rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "mark"]
    fields = f"conv_id {kind.simpleString()}, turn long, mark binary, nth long, "
    cut = stage(_flags(rows).repartitionByRange(*order).sortWithinPartitions(*order)
                .mapInArrow(_cut(to_arrow_type(kind), size), fields + "flags binary, audit string, moves array<long>"),
                "segments")
    parts = cut.where("audit is null")
    ways = (parts.select(*order, "nth", "moves").repartition("conv_id").sortWithinPartitions(*order, "nth")
            .mapInArrow(_cross, fields + "x int, y int, tail string"))
    ways = ways.select(*[F.col(c).alias(f"_{c}") for c in (*order, "nth")], "x", "y", "tail")
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*order, "nth")])
    solved = (parts.join(ways, same).select(*order, "nth", "flags", "x", "y", "tail")
              .mapInArrow(_solve, fields + "flags binary, audit string"))
    return cut.where("audit is not null").drop("moves").unionByName(solved)


def _together(rows: DataFrame, size: int) -> DataFrame:
    """Each conversation's segments and rows in order, a segment before its rows."""
    rows = _standard(rows)
    edits = audit_segments(rows, size).withColumn("kind", F.lit(0))
    rows = rows.select("conv_id", "turn", "mark", "role", F.when(F.col("times") > 0, F.col("text")).alias("text"),
                       "times", F.lit(1).alias("kind"))
    return (edits.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "mark", "kind", "nth"))


def _standard(rows: DataFrame) -> DataFrame:
    """Rows with one space for nulls, a count of repetitions and their digest."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    return _keyed(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], times.alias("times")))


class _Conversation:
    """Edits applied to the rows of one conversation as they come."""

    def __init__(self, conv):
        self.conv, self.state, self.pending, self.at, self.flags = conv, START, "", 0, b""
        self.n = self.cost = self.illegal = self.turns = 0
        self.faults = [0] * 4
        self.role = self.low = self.high = None

    def edits(self, segment: tuple[bytes, str]) -> None:
        self.flags = self.flags[self.n:] + segment[0]
        self.pending = self.pending[self.at:] + segment[1]
        self.n = self.at = 0

    def _insert(self):
        while self.pending[self.at:self.at + 1] == "I":
            role = _needed(self.state)
            self.state, self.at, self.cost = _after(self.state, role), self.at + 1, self.cost + INSERT
            yield "I", None, ("user", "assistant")[role - 1], ""

    def row(self, turn, role, text):
        """(edit, turn, role, text) of the turns that a row gives, deleted ones too."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial, fault = divmod(self.flags[self.n], 4)
        self.n += 1
        self.illegal += self.role is not None and (self.role, initial) not in _LEGAL
        self.role = initial
        self.faults[fault] += 1
        yield from self._insert()
        edit, self.at = self.pending[self.at], self.at + 1
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += TRUNCATED * (fault == CUT)
            if edit == "R":
                initial = _needed(self.state)
                role, self.cost = ("user", "assistant")[initial - 1], self.cost + REROLE
            self.state = _after(self.state, initial)
        yield edit, turn, role, text

    def end(self):
        yield from self._insert()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _apply(batches):
    """Events: (conversation, None) when one ends, else (conversation, edited turn)."""
    now = None
    for b in batches:
        for conv, turn, kind, times, role, text, flags, audit in zip(*[b[k].to_pylist() for k in (
                "conv_id", "turn", "kind", "times", "role", "text", "flags", "audit")]):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from ((now, t) for t in now.end())
                    yield now, None
                now = _Conversation(conv)
            if kind == 0:
                now.edits((flags, audit))
                yield now, ("", None, audit, None)
            else:
                for _ in range(times):
                    yield from ((now, t) for t in now.row(turn, role, text))
    if now is not None:
        yield from ((now, t) for t in now.end())
        yield now, None


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _report(kind: pa.DataType):
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        out, audit, digest, first = [], [], hashlib.sha256(), True
        for conv, turn in _apply(batches):
            if turn is None:
                out.append((conv.conv, conv.gaps(), conv.faults[BLANK], conv.faults[REPEATED], conv.faults[CUT],
                            conv.illegal, conv.cost, "".join(audit), digest.hexdigest()))
                audit, digest, first = [], hashlib.sha256(), True
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], REPORT)
                    out = []
            elif not turn[0]:
                audit.append(turn[2])
            elif turn[0] != "D":
                digest.update(f"{'' if first else chr(10)}{turn[2]}:{turn[3]}".encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], REPORT)
    return run


def _repaired(kind: pa.DataType):
    names = ["conv_id", "place", "turn", "role", "text", "edit"]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        out, place = [], 0
        for conv, turn in _apply(batches):
            if turn is None:
                place = 0
            elif turn[0] in ("K", "R", "I"):
                out.append((conv.conv, place, *turn[1:], turn[0]))
                place += 1
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return run


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of the repaired conversations in
    order from 0, with K for kept, R for another role and I for inserted ones. Input
    and definitions as in `repair_report`."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return _together(rows, segment).mapInArrow(
        _repaired(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, place long, turn long, role string, text string, edit string")


def repair_report(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256),
    one row for each conversation of (conv_id, turn, role, text) and perhaps `times`, how
    often a row stands there (0: it only names its conversation).

    Rows go by turn, null turns first, then by the digest of role and text; rows with one
    conv_id, null too, are one conversation. Null roles and texts are one space. A row is
    blank without any character but white space, else a duplicate if its role and text
    came before, else truncated if its last such character is none of `.`, `!` and `?`.
    Equal rows are duplicates of the first. Roles go by their first letter; those of other
    letters must change or go. Gaps are missing turn numbers, illegal the neighbours that
    are not su, ua or au before the repair. Without rows: zeros, an empty audit and the
    digest of no text. An empty table gives no rows; other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return _together(rows, segment).mapInArrow(
        _report(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string")
