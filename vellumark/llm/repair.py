"""Least-cost repair of conversations' structure, by bitsets of grammar states in layers of increasing cost.

A repaired conversation has roles ``(system? (user assistant)+)?``, no blank turn and no turn said before. Edits, by initial: Delete (4; the only one for a blank or repeated
turn), Insert an empty turn (3), Keep (0), Rerole to user or assistant (3); a truncated turn that stays costs 3 more. Of the cheapest repairs the one with the
least audit (its edits' initials in order) is taken.

Layers: for each place between turns, layer d holds the set of grammar states from which the rest can be repaired for d more than the place's lowest cost. Going
one turn back shifts whole layers by an edit's cost and maps all their sets at once, as Wu and Manber's search does with its errors. From any state one can
get into step with any other for at most ten (delete a kept system turn, insert one or two), so sixteen layers of four states, 64 bits, hold all that can matter.
The first layer that holds the start gives the cost; bits of neighbouring places give the edits, least letter first.

Rows are range-sorted over all conversations. A conversation that lies inside a partition is repaired there; those at a partition's ends, and those longer than a
chunk, are cut into chunks. A chunk is a 4 x 4 table of costs (from the state before it to that after it); tables are chained backwards, a small row a chunk, then states forwards, and each chunk is
traced by itself. So a conversation may hold any part of all rows. Only a hash over a whole conversation (``digest``) reads its chunks in one stream, as its definition asks, a bounded batch at a time.

Order is by turn, nulls first; rows of one turn by a hash of role and text, equal rows are neighbours. Null roles and texts are one space, so such a text is blank and such a role can't be kept.
A role's first letter counts. A null conversation id is a conversation of its own. Repeated rows are repeated turns. Texts of any length stay whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.llm.scratch import small_batches, table

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Layers of a place, four bits each.
LAYERS = 16
_ONES, _ALL = int("1" * LAYERS, 16), (1 << 4 * LAYERS) - 1
#: State after a letter, by state before.
_AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "-": (None, None, None, None)}

#: A conversation's rows or bytes beyond which it is cut into chunks.
CHUNK_ROWS, CHUNK_BYTES = 2048, 1 << 16

#: White space around words.
_SPACE = " \t\n\x0b\x0c\r"


def _to(sets: int, letter: str) -> int:
    """Of all layers' sets at once: the states from which a letter leads into them."""
    if letter == "s":
        return sets >> SYSTEM & _ONES
    if letter == "u":
        x = sets >> USER & _ONES
        return x | x << SYSTEM | x << ASSISTANT
    return (sets >> ASSISTANT & _ONES) << USER if letter == "a" else 0


def _either(sets: int) -> int:
    return _to(sets, "u") | _to(sets, "a")


def _settled(sets: int) -> tuple[int, int]:
    """Each state in its lowest layer only, the lowest layer first; and how many layers that went down."""
    out = seen = layer = low = 0
    while sets:
        new = sets & 15 & ~seen
        if new and not seen:
            low = layer
        out |= new << 4 * layer
        seen |= new
        sets >>= 4
        layer += 1
    return out >> 4 * low & _ALL, low


def _with_inserts(sets: int) -> int:
    for _ in range(3):
        sets |= _either(sets) << 4 * INSERT
    return sets


#: Layers behind the last turn.
ENDED = _settled(_with_inserts(1 << START | 1 << ASSISTANT))[0]


@cache
def _back(sets: int, code: str) -> tuple[int, int]:
    """Layers before a turn, from those after it, and by how much the lowest cost grows. ``code``: the role's initial ("-": none), a capital or "_" if truncated, "x" if it has to go."""
    out = sets << 4 * DELETE
    if code != "x":
        more = 0 if code.islower() or code == "-" else TRUNCATED
        letter = "-" if code == "_" else code.lower()
        out |= _to(sets, letter) << 4 * more | _either(sets) << 4 * (REROLE + more)
    return _settled(_with_inserts(out))


def _cost(sets: int, state: int | None) -> int | None:
    """Layer of a state."""
    if state is None:
        return None
    bits = sets >> state & _ONES
    return (bits.bit_length() - 1) // 4 if bits else None


def _step(state: int) -> int:
    return ASSISTANT if state == USER else USER


@cache
def _edits(before: int, low: int, after: int, state: int, code: str | None) -> tuple[str, int]:
    """Least letters of the cheapest edits from ``state`` at a place until its turn (None: the end) is behind, and the state then."""
    letters, keep = "", None if code is None else _AFTER["-" if code in "x_" else code.lower()]
    more = 0 if code is None or code.islower() or code == "-" else TRUNCATED
    while True:
        left = _cost(before, state)

        def leads(to: int | None, cost: int, left: int = left) -> bool:
            at = _cost(after, to)
            return at is not None and at - low + cost == left

        if code is not None and leads(state, DELETE):
            return letters + "D", state
        inserted = _cost(before, _step(state))
        if inserted is not None and inserted + INSERT == left:
            letters, state = letters + "I", _step(state)
        elif code is None:
            return letters, state
        elif code != "x" and leads(keep[state], more):
            return letters + "K", keep[state]
        else:
            return letters + "R", _step(state)


def _trace(codes: str, after: int, state: int) -> tuple[list[str], int]:
    """Letters for each turn (inserts before it included) and the state behind the last one."""
    places = [(after, 0)]
    for code in reversed(codes):
        places.append(_back(places[-1][0], code))
    places.reverse()
    out = []
    for k, code in enumerate(codes):
        letters, state = _edits(places[k][0], places[k][1], places[k + 1][0], state, code)
        out.append(letters)
    return out, state


def _total(codes: str, after: int) -> tuple[int, int]:
    """Layers before the first turn and their lowest cost."""
    total = 0
    for code in reversed(codes):
        after, low = _back(after, code)
        total += low
    return after, total


@lru_cache(50_000)
def solve(codes: str) -> tuple[int, tuple[str, ...]]:
    """Cost, and letters for each turn and for the end."""
    sets, low = _total(codes, ENDED)
    letters, state = _trace(codes, ENDED, START)
    return low + _cost(sets, START), (*letters, _edits(ENDED, 0, ENDED, state, None)[0])


def _apply(letters: tuple[str, ...] | list[str], roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns."""
    out_roles, out_texts = [], []
    for k, group in enumerate(letters):
        for letter in group:
            if letter in "IR":
                state = _step(state)
                out_roles.append("user" if state == USER else "assistant")
                out_texts.append("" if letter == "I" else texts[k])
            elif letter == "K":
                state = _AFTER[roles[k][0]][state]
                out_roles.append(roles[k])
                out_texts.append(texts[k])
    return out_roles, out_texts


def _initials(roles: list[str]) -> str:
    return "".join(r[0] if r and r[0] in "sua" else "-" for r in roles)


def _codes(initials: str, marks: str, repeated: set[int]) -> tuple[str, int, int, int]:
    """Codes of turns, and how many are blank, repeated and truncated. ``marks``: b(lank), t(runcated), o(ther)."""
    out, n = [], {"b": 0, "d": 0, "t": 0}
    for k, (initial, mark) in enumerate(zip(initials, marks, strict=True)):
        fault = "b" if mark == "b" else "d" if k in repeated else mark
        if fault != "o":
            n[fault] += 1
        out.append("x" if fault in "bd" else initial if fault == "o" else "_" if initial == "-" else initial.upper())
    return "".join(out), n["b"], n["d"], n["t"]


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """First, last and number of different turns, of sorted ones."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"
_SWEPT = f"conv_id long, part int, seq int, open boolean, {_PIECE}, turns array<long>, initials string, marks string, keys array<binary>"
_SWEPT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("open", pa.bool_())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("initials", pa.string()), ("marks", pa.string()), ("keys", pa.list_(pa.binary()))]
)


class _Sweep:
    """A partition of sorted rows: conversations inside it are repaired, those at its ends and long ones leave as chunks."""

    def __init__(self) -> None:
        self.part, self.seq = TaskContext.get().partitionId(), 0
        self.rows: list[dict] = []
        self.bytes = 0
        self.open = True  # the first may have begun in an earlier partition
        self.clear()
        self.seen: dict[bytes, int] = {}

    def clear(self) -> None:
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.marks: list[str] = []
        self.keys: list[bytes | None] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, mark: str, key: bytes) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.marks.append(mark)
        self.keys.append(None if key in self.seen else key)
        self.seen[key] = 1
        self.size += len(text) + len(role)

    def full(self) -> bool:
        return len(self.turns) >= CHUNK_ROWS or self.size >= CHUNK_BYTES

    def leave(self, conv: int | None) -> None:
        """What is held goes out, as a chunk if the conversation is open."""
        row = {"conv_id": conv, "part": self.part, "seq": self.seq, "open": self.open}
        self.seq += 1
        initials, marks = _initials(self.roles), "".join(self.marks)
        if self.open:
            row |= {"roles": self.roles, "texts": self.texts, "turns": self.turns, "initials": initials, "marks": marks, "keys": self.keys}
        else:
            codes, blank, duplicate, truncated = _codes(initials, marks, {k for k, key in enumerate(self.keys) if key is None})
            cost, letters = solve(codes)
            roles, texts = _apply(letters, self.roles, self.texts)
            first, last, n = _turns(self.turns)
            row |= {"gaps": last - first + 1 - n if n else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(initials), "cost": cost, "audit": "".join(letters), "roles": roles, "texts": texts}
        self.rows.append(row)
        self.bytes += self.size
        self.clear()

    def out(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, _SWEPT_ARROW)
        self.rows, self.bytes = [], 0
        return batch


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s, current, begun = _Sweep(), None, False
    for batch in batches:
        for conv, turn, role, text, mark, key, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != current:
                if begun:
                    s.leave(current)
                    s.open = False
                current, begun, s.seen = conv, True, {}
            elif s.full():
                s.open = True
                s.leave(current)
            if not gone:
                s.add(turn, role, text, mark, key)
            if len(s.rows) >= 1000 or s.bytes >= 4 << 20:
                yield s.out()
    if begun:
        s.open = True
        s.leave(current)
        yield s.out()


def _chunk_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and counts of chunks, and costs from each state before to each state after (-1: no way)."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            codes, blank, duplicate, truncated = _codes(x["initials"], x["marks"], {k for k, key in enumerate(x["keys"]) if key is None} | set(x["again"] or []))
            costs = [[-1] * 4 for _ in range(4)]
            for to in range(4):
                if codes:
                    sets, low = _total(codes, 1 << to)
                    for state in range(4):
                        at = _cost(sets, state)
                        costs[state][to] = -1 if at is None else low + at
                else:
                    costs[to][to] = 0
            first, last, n = _turns(x["turns"])
            rows.append({"conv_id": x["conv_id"], "part": x["part"], "seq": x["seq"], "codes": codes, "costs": [c for row in costs for c in row], "blank": blank, "duplicate": duplicate, "truncated": truncated,
                         "illegal": _illegal(x["initials"]), "ends": x["initials"][:1] + x["initials"][-1:], "first": first, "last": last, "n": n})
        yield pa.RecordBatch.from_pylist(rows, _TABLE_ARROW)


_TABLE = "conv_id long, part int, seq int, codes string, costs array<int>, blank long, duplicate long, truncated long, illegal long, ends string, first long, last long, n long"
_TABLE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("codes", pa.string()), ("costs", pa.list_(pa.int32()))] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")] + [("ends", pa.string())] + [(c, pa.int64()) for c in ("first", "last", "n")]
)


def _sets_of(costs: list[int | None]) -> int:
    low = min(c for c in costs if c is not None)
    return sum(1 << 4 * (c - low) + state for state, c in enumerate(costs) if c is not None and c - low < LAYERS)


def _costs_of(sets: int, low: int) -> list[int | None]:
    return [None if (at := _cost(sets, state)) is None else at + low for state in range(4)]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation, last first: the layers behind each chunk, whether it is the last, and what is left to pay from the start before it."""
    current, begun, costs = None, False, []
    for batch in batches:
        out = []
        for conv, part, seq, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = not begun or conv != current
            if last:
                current, begun, costs = conv, True, _costs_of(ENDED, 0)
            sets = _sets_of(costs)
            ways = [[flat[4 * q + t] + costs[t] for t in range(4) if flat[4 * q + t] >= 0 and costs[t] is not None] for q in range(4)]
            # Inserts come before a chunk's turns; one without turns adds none, they come with the next.
            costs = [min(w) if w else None for w in ways]
            out.append((part, seq, sets - (1 << 64) if sets >> 63 else sets, last, costs[START]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "seq", "after", "is_last", "cost"])


def _unsigned(sets: int) -> int:
    return sets & _ALL


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a chunk for each one before it (-1: none)."""
    for batch in batches:
        codes, after = (batch.column(c).to_pylist() for c in ("codes", "after"))
        ends = []
        for text, sets in zip(codes, after, strict=True):
            at_start = _total(text, _unsigned(sets))[0]
            ends.append([_trace(text, _unsigned(sets), q)[1] if _cost(at_start, q) is not None else -1 for q in range(4)])
        cols = [batch.column(c) for c in ("conv_id", "part", "seq")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "seq", "states"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by conversation, first first: the state before each."""
    current, begun, state = None, False, START
    for batch in batches:
        out = []
        for conv, part, seq, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != current:
                current, begun, state = conv, True, START
            out.append((part, seq, state))
            state = states[state]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32()), strict=True)], ["part", "seq", "state"])


def _repair_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            sets = _unsigned(x["after"])
            letters, state = _trace(x["codes"], sets, x["state"])
            if x["is_last"]:
                letters = [*letters, _edits(ENDED, 0, ENDED, state, None)[0]]
            roles, texts = _apply(letters, x["roles"], x["texts"], x["state"])
            rows.append({"conv_id": x["conv_id"], "part": x["part"], "seq": x["seq"], "audit": "".join(letters), "roles": roles, "texts": texts})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of cut conversations, from small rows of their chunks in order: neighbours across a cut count too."""
    out: list[dict] = []
    names = ("conv_id", *_COUNTS)
    held: dict = {}

    def close() -> None:
        out.append({k: held[k] for k in names[2:]} | {"conv_id": held["conv_id"], "gaps": held["last"] - held["first"] + 1 - held["n"] if held["n"] else 0})

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.int64()) for c in names]))

    for batch in batches:
        for x in batch.to_pylist():
            if not held or x["conv_id"] != held["conv_id"]:
                if held:
                    close()
                held = {"conv_id": x["conv_id"], "ends": "", "first": None, "last": None, "n": 0, "cost": x["cost"]} | dict.fromkeys(names[2:6], 0)
            for c in names[2:6]:
                held[c] += x[c]
            if x["ends"]:
                held["illegal"] += bool(held["ends"]) and _illegal(held["ends"][-1] + x["ends"][0])
                held["ends"] = x["ends"]
            if x["n"]:
                held["n"] += x["n"] - (held["last"] == x["first"])
                held["first"] = x["first"] if held["first"] is None else held["first"]
                held["last"] = x["last"]
        if len(out) > 1000:
            yield batch_of()
            out = []
    if held:
        close()
    if out:
        yield batch_of()


def _in_order(df: DataFrame, *columns: str, last_first: bool = False) -> DataFrame:
    """Small rows of chunks: a conversation's stand together, in order."""
    order = [F.desc(c) if last_first else F.asc(c) for c in ("part", "seq")]
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "part", "seq", *columns)


class Repaired(NamedTuple):
    """Repaired conversations.

    ``whole``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts``, a row for each that wasn't cut. Of those that were cut,
    ``counts`` has the numbers, a row each, and ``pieces`` ``conv_id, part, seq, audit, roles, texts``, to be read by ``part, seq``.
    """

    whole: DataFrame
    counts: DataFrame
    pieces: DataFrame

    def turns(self) -> DataFrame:
        """``conv_id, part, seq, pos, role, text``: repaired turns, in the order of ``part, seq, pos``."""
        both = self.whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), "roles", "texts").unionByName(self.pieces.drop("audit"))
        return both.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "x")).select("conv_id", "part", "seq", "pos", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def repair(conversations: DataFrame, gone: Column | None = None) -> Repaired:
    """Repairs ``conversations`` (columns ``conv_id, turn, role, text``). A row where ``gone`` holds only names its conversation."""
    small_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, (F.lit(False) if gone is None else gone).alias("gone"))
    said = F.rtrim(F.col("text"), F.lit(_SPACE))
    mark = F.when(said == "", "b").when(F.right(said, F.lit(1)).isin(".", "!", "?"), "o").otherwise("t")
    key = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("conv_id", "turn", "role", "text", mark.alias("mark"), key.alias("key"), "gone", F.monotonically_increasing_id().alias("at"))
    order = ["conv_id", "turn", "key", "at"]
    swept = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").mapInArrow(_sweep, _SWEPT), "swept")

    cut = swept.where("open")
    narrow = cut.select("conv_id", "part", "seq", "turns", "initials", "marks", "keys")
    # A partition lets only its first of equal turns have a key, so a key has at most a row a partition here.
    firsts = narrow.select("conv_id", "part", "seq", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    again = firsts.groupBy("conv_id", "key").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "pos"))).alias("at")).where("size(at) > 1")
    again = again.select(F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("x")).groupBy("x.part", "x.seq").agg(F.collect_list("x.pos").alias("again"))
    chunks = table(narrow.join(again, ["part", "seq"], "left").mapInArrow(_chunk_tables, _TABLE), "chunks")
    behind = table(_in_order(chunks, "costs", last_first=True).mapInArrow(_backward, "part int, seq int, after long, is_last boolean, cost long"), "behind")
    known = chunks.join(behind, ["part", "seq"])
    states = known.select("conv_id", "part", "seq", "codes", "after").mapInArrow(_end_states, "conv_id long, part int, seq int, states array<int>")
    before = _in_order(states, "states").mapInArrow(_forward, "part int, seq int, state int")
    plan = table(known.join(before, ["part", "seq"]).select("part", "seq", "codes", "after", "is_last", "state"), "plan")
    pieces = cut.select("conv_id", "part", "seq", "roles", "texts").join(plan, ["part", "seq"]).mapInArrow(_repair_chunks, "conv_id long, part int, seq int, audit string, roles array<string>, texts array<string>")
    counts = _in_order(known, "blank", "duplicate", "truncated", "illegal", "cost", "ends", "first", "last", "n").mapInArrow(_sums, ", ".join(f"{c} long" for c in ("conv_id", *_COUNTS)))
    return Repaired(swept.where("not open").select("conv_id", *_COUNTS, "audit", "roles", "texts"), counts, pieces)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each cut conversation, from its pieces in order."""
    current, begun, audit, sha, any_turn = None, False, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv, _, _, part_of_audit, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != current:
                if begun:
                    yield row()
                current, begun, audit, sha, any_turn = conv, True, [], hashlib.sha256(), False
            audit.append(part_of_audit)
            if body:
                sha.update((("\n" if any_turn else "") + body).encode())
                any_turn = True
    if begun:
        yield row()


def digest(repaired: Repaired) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: ``role:text`` of repaired turns, newline-joined, hashed."""
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = repaired.whole.select("conv_id", *_COUNTS, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    hashes = _in_order(repaired.pieces.withColumn("body", body), "audit", "body").mapInArrow(_hashes, "id long, audit string, repaired_sha256 string")
    cut = repaired.counts.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    return whole.unionByName(cut)


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults and which of them are gone, by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault", twice.alias("copy")), F.col("fault") == 0
