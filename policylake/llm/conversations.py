"""Repair of the structure of conversations by iterative-deepening A*.

A conversation is well formed if its roles are nothing, or an optional system row and then user and assistant in turns. Its
rows are edited in order: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant row,
anywhere) 2. Blank rows and rows whose role and text were seen earlier must be deleted; a truncated row that stays costs
1 more. Of the cheapest repairs the one whose initials (D, I, K, R) come first in ASCII order is taken.

The search is depth-first in that order under a cost bound that rises by one until a path is accepted, so the first
accepted path is the answer. What every remaining row costs at least is the estimate. A table of failed states
(place, role state, insertions in a row) with the budget they failed with outlives the bounds.

No task holds a whole conversation of unknown length. Rows are sorted by a range shuffle, so a hot conversation is spread over tasks
as others are, and are cut into chunks of at most ``CHUNK`` rows and about ``CHUNK_BYTES`` bytes. A conversation that is one chunk is searched from start to end. In
longer ones, and those that may go on in another task, a chunk is searched from each of the four role states to each; the
chunks of a conversation are then joined by these costs alone. That is exact: one string of edits leads to one
state, no chunk's path ends in an insertion (these count to the next row), so of two paths up to a row neither begins the other
and their order decides that of all their continuations. Only the digest of a repaired text reads its chunks one by one.

Rows repeated at another turn are found from narrow rows (conversation, turn, role, hash of the text) and join the sort
as marks before the rows they concern, so texts are shuffled once.

Defined cases: rows come by turn (null first), then role, then the hash of the text; rows equal in all are duplicates but
for the first. A null text is blank; a null, empty or unknown role can't be kept. Null conversation ids are one
conversation. No rows give no conversations. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm._links import stored

CHUNK = 512
CHUNK_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted or reroled row is in each state, and the state after it: only one role is allowed.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
#: Edits that end a conversation left in a state: (cost, initials).
TAIL = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def row_mark(role: str | None, text: str | None, seen: bool) -> tuple[str, str | None]:
    """(mark, fault): x must go; else the role's initial or ``?``, in upper case if truncated (``!`` for an unknown role)."""
    plain = (text or "").strip(BLANKS)
    if not plain:
        return "x", "blank"
    if seen:
        return "x", "duplicate"
    initial = role[0] if role and role[0] in "sua" else "?"
    if plain[-1] in ".!?":
        return initial, None
    return (initial.upper() if initial != "?" else "!"), "truncated"


def _least(marks: str) -> list[int]:
    """What the rows from each place on cost at least."""
    least = [0]
    for mark in reversed(marks):
        own = DELETE if mark == "x" else min(DELETE, REROLE * (mark in "?!") + TRUNCATED * (mark in "SUA!"))
        least.append(least[-1] + own)
    return least[::-1]


def _moves(marks: str, i: int, state: int, inserted: int, end: int | None) -> list[tuple[str, int, int, int, int]]:
    """(initial, cost, place, state, insertions in a row) of the edits that may come next, in ASCII order."""
    moves, mark = [], marks[i] if i < len(marks) else ""
    if mark:
        moves.append(("D", DELETE, i + 1, state, 0))
    # Three insertions in a row are one with a detour. Before a chunk's end insertions count to the next row.
    if inserted < 2 and (mark or end is None):
        moves.append(("I", INSERT, i, NEXT[state][1], inserted + 1))
    if mark and mark != "x":
        extra = TRUNCATED * (mark in "SUA!")
        kept = AFTER.get((state, mark.lower()))
        if kept is not None:
            moves.append(("K", KEEP + extra, i + 1, kept, 0))
        if NEXT[state][0][0] != mark.lower():
            moves.append(("R", REROLE + extra, i + 1, NEXT[state][1], 0))
    return moves


def _within(marks: str, least: list[int], begin: int, end: int | None, bound: int, failed: dict) -> str | None:
    """The first accepted path, in ASCII order, that costs at most ``bound``."""
    path: list[str] = []
    stack: list[tuple] = []

    def entered(i: int, state: int, inserted: int, cost: int) -> bool:
        """Whether the state is accepted; else its edits are put on the stack, unless they can't do."""
        if i == len(marks) and (state in (START, ASSISTANT) if end is None else state == end):
            return True
        if cost + least[i] <= bound and failed.get((i, state, inserted), -1) < bound - cost:
            stack.append(((i, state, inserted), cost, iter(_moves(marks, i, state, inserted, end))))
        else:
            path.pop()
        return False

    path.append("")
    if entered(0, begin, 0, 0):
        return ""
    while stack:
        place, cost, moves = stack[-1]
        move = next(moves, None)
        if move is None:
            failed[place] = max(failed.get(place, -1), bound - cost)
            stack.pop()
            path.pop()
            continue
        initial, price, i, state, inserted = move
        if cost + price + least[i] > bound:
            continue
        path.append(initial)
        if entered(i, state, inserted, cost + price):
            return "".join(path)
    return None


@lru_cache(maxsize=50_000)
def cheapest(marks: str, begin: int = START, end: int | None = None) -> tuple[int, str] | None:
    """(cost, initials) of the cheapest edits of rows with these marks, ASCII-least among equals.

    From state ``begin`` to state ``end`` without an insertion at the end, or, without ``end``, to a well-formed end.
    """
    least, failed = _least(marks), {}
    for bound in range(least[0], DELETE * len(marks) + 2 * INSERT + 1):
        path = _within(marks, least, begin, end, bound, failed)
        if path is not None:
            return bound, path
    return None


def applied(edits: str, rows: list[dict[str, Any]], state: int) -> list[dict[str, Any]]:
    """The rows that the edits leave, from a role state on: turn, role, text, edit; inserted rows have no turn."""
    out, rest = [], iter(rows)
    for edit in edits:
        row = None if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            out.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "edit": "K"})
            state = AFTER[state, row["role"][0]]
        else:
            role, state = NEXT[state]
            out.append({"turn": row and row["turn"], "role": role, "text": row["text"] if row else "", "edit": edit})
    return out


# --- sorted rows to chunks -----------------------------------------------------------

MESSAGE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
WAY = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
CHUNKS = ("part int, seq long, whole boolean, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
          "first_turn long, last_turn long, turns long, ways array<struct<begin: int, end: int, cost: long, edits: string>>, "
          "rows array<struct<turn: long, role: string, text: string>>")
COUNTS = ("blank", "duplicate", "truncated", "illegal", "head", "tail", "first_turn", "last_turn", "turns")


class _Chunk:
    """Rows of a conversation that stand together, as they come."""

    def __init__(self, key: Any):
        self.key, self.rows, self.marks, self.size = key, [], [], 0
        self.faults, self.initials, self.turns = [], [], []

    def add(self, turn: int | None, role: str | None, text: str | None, seen: bool) -> None:
        mark, fault = row_mark(role, text, seen)
        self.rows.append({"turn": turn, "role": role, "text": text})
        self.marks.append(mark)
        self.faults.append(fault)
        self.initials.append((role or " ")[0])
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.size += len(text or "")

    def full(self) -> bool:
        return len(self.rows) >= CHUNK or self.size >= CHUNK_BYTES

    def record(self, part: int, seq: int, whole: bool) -> dict[str, Any]:
        marks, pairs = "".join(self.marks), zip(self.initials, self.initials[1:])
        if whole:
            cost, edits = cheapest(marks)
            ways = [{"begin": START, "end": ASSISTANT, "cost": cost, "edits": edits}]
        else:
            found = [(b, e, cheapest(marks, b, e)) for b in range(4) for e in range(4)]
            ways = [{"begin": b, "end": e, "cost": way[0], "edits": way[1]} for b, e, way in found if way]
        return {"key": self.key, "part": part, "seq": seq, "whole": whole, "blank": self.faults.count("blank"),
                "duplicate": self.faults.count("duplicate"), "truncated": self.faults.count("truncated"),
                "illegal": sum(a + b not in LEGAL for a, b in pairs), "head": self.initials[0], "tail": self.initials[-1],
                "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None,
                "turns": len(self.turns), "ways": ways, "rows": self.rows}


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows and marks of a task (key, turn, role, hash, text, marked) to chunk records."""
    part, seq = TaskContext.get().partitionId(), 0
    chunk, opening, several = None, True, False  # opening: the task's first conversation; several: it has chunks already
    before, repeated, records, held = None, None, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(records, schema)

    for batch in batches:
        for key, turn, role, digest, text, marked in zip(*(c.to_pylist() for c in batch.columns)):
            place = (key, turn, role, digest)
            if marked:
                repeated = place
                continue
            if chunk is not None and (chunk.key != key or chunk.full()):
                ends = chunk.key != key
                records.append(chunk.record(part, seq, ends and not opening and not several))
                held, seq = held + chunk.size, seq + 1
                several, opening = not ends, opening and not ends
                chunk = None
            if chunk is None:
                chunk = _Chunk(key)
            chunk.add(turn, role, text, place in (repeated, before))
            before = place
            if held > CHUNK_BYTES or len(records) >= 2048:
                yield flush()
                records, held = [], 0
    if chunk is not None:
        records.append(chunk.record(part, seq, False))  # it may go on in the next task
    if records:
        yield flush()


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def chunked(rows: DataFrame) -> DataFrame:
    """(key, part, seq, ...): chunk records of all conversations, stored. rows: key, turn, role, text."""
    hashed = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    narrow = hashed.select("key", "role", "digest", place.alias("place"))
    # What stands at more than one turn: all but the rows of the first turn were seen earlier.
    spread = narrow.groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")) \
        .where("first <> last").select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("role").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d"))
    marks = narrow.join(spread, same).where("place <> first").select(
        "key", F.col("place.turn").alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(True).alias("marked"))
    both = hashed.select("key", "turn", "role", "digest", "text", F.lit(False).alias("marked")).unionByName(marks)
    order = [F.asc_nulls_first(c) for c in ("key", "turn", "role", "digest")]
    sorted_ = both.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("marked"))
    kind = rows.schema["key"].dataType.simpleString()
    records = rows.sparkSession.createDataFrame([], f"key {kind}, {CHUNKS}")
    schema = _arrow(records)
    return stored(sorted_.mapInArrow(lambda batches: _chunks(batches, schema), records.schema), "chunks")


# --- chunks of one conversation to its cheapest way --------------------------------------

class _Ways:
    """The cheapest way into each role state, chunk after chunk, and what the chunks count."""

    def __init__(self, key: Any):
        self.key, self.best, self.order = key, {START: 0}, {START: 0}  # costs, and the ASCII order of the ways
        self.back: list[tuple[int, int, dict[int, int]]] = []
        self.totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first = self.last = self.tail = None

    def add(self, row: dict[str, Any]) -> None:
        found: dict[int, tuple] = {}
        for way in row["ways"]:
            if way["begin"] in self.best:
                this = (self.best[way["begin"]] + way["cost"], self.order[way["begin"]], way["edits"], way["begin"])
                found[way["end"]] = min(found.get(way["end"], this), this)
        self.best = {state: way[0] for state, way in found.items()}
        ranked = sorted(found, key=lambda state: found[state][1:3])
        self.order = {state: rank for rank, state in enumerate(ranked)}
        self.back.append((row["part"], row["seq"], {state: way[3] for state, way in found.items()}))
        for name in self.totals:
            self.totals[name] += row[name]
        if self.tail is not None and self.tail + row["head"] not in LEGAL:
            self.totals["illegal"] += 1
        if row["first_turn"] is not None:
            self.totals["turns"] -= row["first_turn"] == self.last
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]
        self.tail = row["tail"]

    def records(self) -> Iterator[dict[str, Any]]:
        """A record per chunk with the states it is passed in; the last one holds the sums and the edits at the end."""
        end = min(self.best, key=lambda state: (self.best[state] + TAIL[state][0], self.order[state]))
        state, steps = end, []
        for part, seq, back in reversed(self.back):
            steps.append({"part": part, "seq": seq, "begin": back[state], "end": state})
            state = back[state]
        for k, step in enumerate(reversed(steps)):
            last = k == len(steps) - 1
            sums = {**self.totals, "first_turn": self.first, "last_turn": self.last, "cost": self.best[end] + TAIL[end][0]} if last else {}
            yield {"key": self.key, **step, "more": TAIL[end][1] if last else "", **sums}


JOINED = ("part int, seq long, begin int, end int, more string, blank long, duplicate long, truncated long, illegal long, turns long, "
          "first_turn long, last_turn long, cost long")


def _joined(chunks: DataFrame) -> DataFrame:
    """The way taken through every chunk of the conversations with several; narrow rows, read in order."""
    narrow = chunks.where("not whole").select("key", "part", "seq", *COUNTS, "ways")
    empty = chunks.sparkSession.createDataFrame([], f"key {chunks.schema['key'].dataType.simpleString()}, {JOINED}")
    schema = _arrow(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if ways is None or ways.key != row["key"]:
                    out.extend(ways.records() if ways else [])
                    ways = _Ways(row["key"])
                ways.add(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if ways:
            yield pa.RecordBatch.from_pylist(list(ways.records()), schema)

    order = [F.asc_nulls_first("key"), F.asc("part"), F.asc("seq")]
    return stored(narrow.repartition("key").sortWithinPartitions(*order).mapInArrow(run, empty.schema), "ways")


class Repaired(NamedTuple):
    """What a repair gives.

    report: key, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation.
    pieces: key, part, seq, whole, edits, messages: the repaired rows in pieces, ordered by (part, seq).
    """

    report: DataFrame
    pieces: DataFrame

    def messages(self) -> DataFrame:
        """(key, part, seq, place, turn, role, text, edit): every repaired row; ordered by part, seq, place."""
        return self.pieces.select("key", "part", "seq", F.posexplode("messages").alias("place", "m")).select(
            "key", "part", "seq", "place", "m.*")

    def digests(self) -> DataFrame:
        """(key, digest): SHA-256 of the repaired ``role:text`` lines, joined by newlines."""
        lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
        once = self.pieces.where("whole").select("key", F.sha2(lines, 256).alias("digest"))
        several = self.pieces.where("not whole").select("key", "part", "seq", F.size("messages").alias("n"), lines.alias("lines"))
        kind = self.pieces.schema["key"].dataType.simpleString()
        empty = self.pieces.sparkSession.createDataFrame([], f"key {kind}, digest string")
        schema = _arrow(empty)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state, begun, none = None, None, False, True
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if none or row["key"] != key:
                        if not none:
                            out.append({"key": key, "digest": state.hexdigest()})
                        key, state, begun, none = row["key"], hashlib.sha256(), False, False
                    if row["n"]:
                        state.update((("\n" if begun else "") + row["lines"]).encode())
                        begun = True
                yield pa.RecordBatch.from_pylist(out, schema)
            if not none:
                yield pa.RecordBatch.from_pylist([{"key": key, "digest": state.hexdigest()}], schema)

        order = [F.asc_nulls_first("key"), F.asc("part"), F.asc("seq")]
        return once.unionByName(several.repartition("key").sortWithinPartitions(*order).mapInArrow(run, empty.schema))


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest repair of every conversation (see above). The report's ``audit`` holds the initials of all edits."""
    rows = conversations.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"),
                                F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    chunks = chunked(rows)
    joined = _joined(chunks)
    kind = chunks.schema["key"].dataType.simpleString()
    taken = chunks.where("not whole").join(joined.select("part", "seq", "begin", "end", "more"), ["part", "seq"]).select(
        "key", "part", "seq", "whole", "begin",
        F.concat(F.expr("filter(ways, w -> w.begin = begin and w.end = end)[0].edits"), "more").alias("edits"), "rows")
    ways = chunks.where("whole").select(
        "key", "part", "seq", "whole", F.lit(START).alias("begin"), F.col("ways")[0]["edits"].alias("edits"), "rows").unionByName(taken)
    empty = chunks.sparkSession.createDataFrame(
        [], f"key {kind}, part int, seq long, whole boolean, edits string, messages array<struct<turn: long, role: string, text: string, edit: string>>")
    schema = _arrow(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [{**{c: row[c] for c in ("key", "part", "seq", "whole", "edits")}, "messages": applied(row["edits"], row["rows"], row["begin"])}
                       for row in batch.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist(out, schema)

    pieces = ways.mapInArrow(run, empty.schema)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    faults = ("blank", "duplicate", "truncated", "illegal")
    whole = chunks.where("whole").select("key", gaps, *faults, F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["edits"].alias("audit"))
    sums = joined.where("cost is not null").select("key", gaps, *faults, "cost")
    # The audit of a conversation is one string of the result, so its pieces meet in one row.
    listed = taken.groupBy(F.col("key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("part", "seq", "edits"))).alias("l"))
    audits = listed.select("k", F.array_join(F.transform("l", lambda x: x["edits"]), "").alias("audit"))
    several = sums.join(audits, F.col("key").eqNullSafe(F.col("k"))).drop("k")
    return Repaired(whole.unionByName(several), pieces)
