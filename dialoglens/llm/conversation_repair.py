"""Repair of conversations by a forward Viterbi pass over four grammar states.

A repaired conversation has no turns, or an optional system turn and then user and assistant by turns. Each
state carries its least (cost, audit): the edits' initials as a string, which decide among equal costs. After
every turn the layer is closed by insertions, at most a user and an assistant behind it.

Turns are sorted by ranges of (conversation, turn), so a long conversation lies in several tasks. Each cuts it
into bounded segments; a segment that may begin amid a conversation is solved from all four states. A second
pass chains segments in order, a row for each, and picks their states; a third writes out what was chosen. One
conversation's digest and audit are made by one task, as they must be, but it holds one segment at a time.
Within a state and a layer no audit begins another of equal cost (what follows would be insertions, which cost
more), so the least prefix stays the least whatever is appended, and least parts chain to least wholes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.storage import Scratch

# The edits' costs, what an unfinished turn adds if it stays, the damages of the query.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
DROPPED, EMPTIED, UNSTOPPED, REPEATED, AS_USER = range(5)
#: Grammar states: nothing yet, after a system turn, a user's, an assistant's. A conversation may end in ENDS.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: The state that a kept role's initial leads to, from which states.
KEPT = {"s": (SYSTEM, (EMPTY,)), "u": (USER, (EMPTY, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: What a segment holds at most: turns, characters (one longer text is still whole).
MOST_TURNS, MOST_CHARS = 512, 1 << 16
Layer = list[tuple[int, str] | None]

ORDER = ["key", "has_turn", "at", "role", "hash"]
ROUTES = "array<struct<start: int, end: int, cost: long, audit: string>>"
FACTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
TURNS = "roles array<string>, texts array<string>, times array<long>"


def least(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def closed(layer: Layer) -> Layer:
    """The layer after insertions: a user's turn where none or an answer is last, then an assistant's."""
    out = list(layer)
    for state, froms in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        for before in froms:
            if out[before] is not None:
                out[state] = least(out[state], (out[before][0] + INSERT, out[before][1] + "I"))
    return out


def advanced(layer: Layer, initial: str, fault: str, times: int) -> Layer:
    """The layer after ``times`` turns of one role and fault; only turns that must go come more than once."""
    # deletions come before insertions in order of characters, so a run of them closes once
    out: Layer = [x and (x[0] + DELETE * times, x[1] + "D" * times) for x in layer]
    if fault not in ("blank", "duplicate"):
        more = UNFINISHED if fault == "truncated" else 0
        to, froms = KEPT.get(initial, (EMPTY, ()))
        for before in froms:
            if layer[before] is not None:
                out[to] = least(out[to], (layer[before][0] + more, layer[before][1] + "K"))
        for before, to in NEXT.items():
            if layer[before] is not None:
                out[to] = least(out[to], (layer[before][0] + REROLE + more, layer[before][1] + "R"))
    return closed(out)


def alone(state: int) -> Layer:
    return [(0, "") if s == state else None for s in range(4)]


START = closed(alone(EMPTY))


class Segment:
    """Some consecutive turns of one conversation. ``opening``: whether they are known to be its first."""

    def __init__(self, key: str, conv, opening: bool):
        self.key, self.conv, self.opening = key, conv, opening
        self.layers = {-1: START} if opening else {s: alone(s) for s in range(4)}
        self.facts = dict(n=0, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first=None, last=None)
        self.roles, self.texts, self.times, self.chars = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, fault: str, times: int) -> None:
        f, initial = self.facts, role[:1]
        f["n"] += times
        if fault:
            f[fault] += times
        if f["last"] is not None:
            f["illegal"] += f["last"] + initial not in LEGAL
        else:
            f["first"] = initial
        f["illegal"] += times - 1
        f["last"] = initial
        if turn is not None and turn != f["high"]:
            f["turns"] += 1
            f["low"] = turn if f["low"] is None else f["low"]
            f["high"] = turn
        self.layers = {start: advanced(layer, initial, fault, times) for start, layer in self.layers.items()}
        kept = None if fault in ("blank", "duplicate") else text
        self.roles.append(role)
        self.texts.append(kept)
        self.times.append(times)
        self.chars += len(kept or "")

    def row(self, part: int, number: int) -> dict:
        routes = [dict(start=s, end=e, cost=x[0], audit=x[1]) for s, layer in self.layers.items() for e, x in enumerate(layer) if x is not None]
        return dict(key=self.key, conv_id=self.conv, part=part, number=number, routes=routes, **self.facts, roles=self.roles, texts=self.texts, times=self.times)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def batched(rows: Iterator[dict], schema: pa.Schema, weight=lambda row: 1, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def segments_of(lines: Iterator[dict]) -> Iterator[Segment]:
    """Segments of sorted lines. A line of kind 0 says that the turn behind it repeats an earlier one."""
    now, before, noted, fresh = None, None, None, False
    for r in lines:
        place = tuple(r[c] for c in ORDER)
        if r["kind"] == 0:
            noted = place
            continue
        if now is None or now.key != r["key"]:
            if now:
                yield now
            # the first conversation of a task may have begun in the one before
            now, fresh, before = Segment(r["key"], r["conv_id"], fresh), True, None
        elif len(now.roles) >= MOST_TURNS or now.chars >= MOST_CHARS:
            yield now
            now = Segment(r["key"], r["conv_id"], False)
        if not (n := r["copies"]):
            continue
        turn = r["at"] if r["has_turn"] else None
        if r["blank"]:
            now.add(turn, r["role"], r["text"], "blank", n)
        elif noted == place or before == place:
            now.add(turn, r["role"], r["text"], "duplicate", n)
        else:
            now.add(turn, r["role"], r["text"], "" if r["stopped"] else "truncated", 1)
            if n > 1:
                now.add(turn, r["role"], r["text"], "duplicate", n - 1)
        before = place
    if now:
        yield now


@dataclass
class Chain:
    """The segments of one conversation so far: the best way to each state, and where it came from."""

    layer: Layer
    places: list[tuple[int, int]]
    came: list[tuple]
    facts: dict

    @staticmethod
    def of() -> Chain:
        return Chain(list(START), [], [], dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, last=None))

    def add(self, r: dict) -> None:
        new, came = [None] * 4, [None] * 4
        for route in r["routes"]:
            start, end = route["start"], route["end"]
            before = (0, "") if start == -1 else self.layer[start]
            if before is not None:
                way = (before[0] + route["cost"], before[1] + route["audit"])
                if new[end] is None or way < new[end]:
                    new[end], came[end] = way, (start, len(before[1]))
        self.layer = new
        self.places.append((r["part"], r["number"]))
        self.came.append(tuple(came))
        f = self.facts
        for name in ("blank", "duplicate", "truncated", "illegal"):
            f[name] += r[name]
        if r["first"] is not None:
            f["illegal"] += f["last"] is not None and f["last"] + r["first"] not in LEGAL
            f["last"] = r["last"]
        if r["low"] is not None:
            f["turns"] += r["turns"] - (f["high"] == r["low"])
            f["low"] = r["low"] if f["low"] is None else f["low"]
            f["high"] = r["high"]

    def notes(self, key: str) -> Iterator[dict]:
        """A note for each segment: the state it begins in and its part of the audit; the last has the totals."""
        end = min((s for s in ENDS if self.layer[s] is not None), key=lambda s: self.layer[s])
        cost, audit = self.layer[end]
        chosen, state, upto = [], end, len(audit)
        for came in reversed(self.came):
            start, at = came[state]
            chosen.append((max(start, EMPTY), at, upto))
            state, upto = max(start, EMPTY), at
        f = self.facts
        gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - f["turns"]
        totals = dict(gaps=min(gaps, (1 << 63) - 1), blank=f["blank"], duplicate=f["duplicate"], truncated=f["truncated"], illegal=f["illegal"], cost=cost, audit=audit)
        for i, ((part, number), (state, at, upto)) in enumerate(zip(self.places, reversed(chosen), strict=True)):
            head = 0 if i == 0 else at  # what was inserted before the first turn goes with the first segment
            yield dict(key=key, part=part, number=number, state=EMPTY if i == 0 else state, edits=audit[head:upto], totals=totals if i + 1 == len(self.places) else None)


TOTALS = "struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"


def chained(rows: Iterator[dict]) -> Iterator[dict]:
    key, chain = None, None
    for r in rows:
        if r["key"] != key:
            if chain:
                yield from chain.notes(key)
            key, chain = r["key"], Chain.of()
        chain.add(r)
    if chain:
        yield from chain.notes(key)


def edited(r: dict, edits: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what a segment keeps, changes and inserts."""
    at, left = -1, 0
    for edit in edits:
        if edit != "I" and not left:
            at += 1
            left = r["times"][at]
        if edit == "I":
            state = NEXT[state]
            yield edit, NAMES[state], ""
            continue
        left -= 1
        if edit == "K":
            state = KEPT[r["roles"][at][:1]][0]
            yield edit, r["roles"][at], r["texts"][at]
        elif edit == "R":
            state = NEXT[state]
            yield edit, NAMES[state], r["texts"][at]


def with_notes(rows: Iterator[dict]) -> Iterator[tuple[dict, dict]]:
    """Each segment with the note that lies ahead of it."""
    note = None
    for r in rows:
        if r["kind"] == 0:
            note = r
        else:
            yield r, note


def summaries(rows: Iterator[dict]) -> Iterator[dict]:
    digest, empty = hashlib.sha256(), True
    for r, note in with_notes(rows):
        for _, role, text in edited(r, note["edits"], note["state"]):
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            empty = False
        if note["totals"]:
            yield dict(conv_id=r["conv_id"], **note["totals"], repaired_sha256=digest.hexdigest())
            digest, empty = hashlib.sha256(), True


def turns_of(rows: Iterator[dict]) -> Iterator[dict]:
    place = 0
    for r, note in with_notes(rows):
        for edit, role, text in edited(r, note["edits"], note["state"]):
            yield dict(conv_id=r["conv_id"], place=place, edit=edit, role=role, text=text)
            place += 1
        if note["totals"]:
            place = 0


@dataclass(frozen=True)
class Repaired:
    """``summary`` has a row for each conversation, ``turns`` the repaired turns (``conv_id, place, edit, role, text``)."""

    summary: DataFrame
    turns: DataFrame


def spoken(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: equal rows counted; null roles and texts are one space."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``spoken`` after a damage drawn by the crc32 of ``conv_id:turn``; dropped rows stay with no copies."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(name.cast("binary")) % 20
    text = F.when(harm == EMPTIED, "").when(harm == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(harm == DROPPED, 0).when(harm == REPEATED, 2 * F.col("copies")).otherwise(F.col("copies"))
    return rows.select("conv_id", "turn", F.when(harm == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def lines_of(rows: DataFrame) -> DataFrame:
    """Turns in a total order within ranges of it, each repeated one behind a line that says so."""
    key: Column = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turn, has = F.coalesce("turn", F.lit(0)), F.col("turn").isNotNull()
    # equal turns go by role and text
    rows = rows.select(key.alias("key"), "conv_id", has.alias("has_turn"), turn.alias("at"), "role", F.unhex(F.sha2("text", 256)).alias("hash"), "text", "copies",
                       (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("stopped"))
    place = F.struct("has_turn", "at")
    narrow = rows.where("copies > 0 and not blank").select(*ORDER, place.alias("place"))
    same = ["key", "role", "hash"]
    first = narrow.groupBy(*same).agg(F.min("place").alias("since"), F.max("place").alias("until")).where("since < until")
    later = narrow.join(first, same).where("place > since").select(*ORDER).distinct()
    both = rows.withColumn("kind", F.lit(1)).unionByName(later.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "kind")


def repair(rows: DataFrame) -> Repaired:
    """Repairs conversations of ``conv_id, turn, role, text, copies`` at the least cost.

    ``summary``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each
    conversation, those whose rows have no copies left included (zeros, an empty audit). Null conversation ids
    are one conversation; null turns come first; equal turns go by role, then by the SHA-256 of the text; equal
    rows lie together, all but the first being duplicates. Texts and conversations may have any length. Extra
    columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    conv = rows.schema["conv_id"].dataType.simpleString()
    held = f"key string, conv_id {conv}, part int, number int, routes {ROUTES}, {FACTS}, {TURNS}"
    lines = lines_of(scratch.save(rows.select("conv_id", "turn", "role", "text", "copies"), "rows"))

    def run(schema: pa.Schema, make, weight=lambda row: 1, most: int = 1024):
        return lambda batches: batched(make(records(batches)), schema, weight, most)

    def cut(lines: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        for number, segment in enumerate(segments_of(lines)):
            yield segment.row(part, number)

    spark = rows.sparkSession
    arrow = lambda ddl: to_arrow(spark, ddl)
    segments = scratch.save(lines.mapInArrow(run(arrow(held), cut, lambda r: 1 + sum(map(len, filter(None, r["texts"]))), 1 << 20), held), "segments")
    narrow = segments.drop("roles", "texts", "times").repartition("key").sortWithinPartitions("key", "part", "number")
    note = f"key string, part int, number int, state int, edits string, totals {TOTALS}"
    notes = scratch.save(narrow.mapInArrow(run(arrow(note), chained), note), "notes")
    whole = segments.select("key", "part", "number", "conv_id", "roles", "texts", "times").withColumn("kind", F.lit(1))
    whole = whole.unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "part", "number", "kind")
    row = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    turn = f"conv_id {conv}, place long, edit string, role string, text string"
    return Repaired(whole.mapInArrow(run(arrow(row), summaries), row), whole.mapInArrow(run(arrow(turn), turns_of, lambda r: 1 + len(r["text"]), 1 << 20), turn))


def to_arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
