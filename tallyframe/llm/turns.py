"""Conversation structure repair: cheapest edits by dynamic programming over turns that stream past in order."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tables import keep
from tallyframe.llm.words import pick

SPACES = " \t\n\x0b\x0c\r"
# A repaired conversation is nothing, or an optional system turn and then pairs of user and assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# What remains from any state costs at most this much more than from any other: inserts lead to an assistant's turn for
# 10 at most, and a system turn that no longer fits is deleted for 2. A state that is dearer by more is never used.
MOST_APART = 2 * INSERT + DELETE
SOUND, CUT_OFF, GONE = range(3)
# Turns of a conversation whose backpointers a task holds; more leave it as rows.
SEGMENT = 1 << 16


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role, None if that is out of order."""
    to = INITIALS.get(initial)
    if to is None or (to == SYSTEM and state != START) or (to != SYSTEM and to != NEXT_ROLE[state]):
        return None
    return to


def row_class(initial: str, fault: int) -> int:
    return "sua".find(initial) * 3 + fault if initial in INITIALS else 9 + fault


def options(state: int, cls: int) -> Iterator[tuple[int, str, int]]:
    """(next state, letters, cost) for a turn: inserts before it, then what happens to it."""
    initial, fault = ("sua"[cls // 3] if cls < 9 else ""), cls % 3
    for inserts in range(3):
        letters, cost = "I" * inserts, INSERT * inserts
        yield state, letters + "D", cost + DELETE
        if fault != GONE:
            cost += TRUNCATED * (fault == CUT_OFF)
            to = kept_state(state, initial)
            if to is not None:
                yield to, letters + "K", cost
            yield NEXT_ROLE[state], letters + "R", cost + REROLE
        state = NEXT_ROLE[state]


class Automaton:
    """The programme's table as a finite automaton: costs relative to the least and the order of the four best edit
    strings are bounded, so a turn is one table look-up and its backpointers are the number of a transition.

    No edit string of a turn is the beginning of another, and a string fixes its state, so the strings of two states
    differ before either ends and their order is that of (order so far, letters of the turn).
    """

    def __init__(self):
        first = ((0, None, None, None), (0, 0, 0, 0))
        self.number, self.states = {first: 0}, [first]
        self.next: list[int] = []  # by state * 12 + class
        self.added: list[int] = []
        self.back: list[dict[int, tuple[int, str]]] = []
        done = 0
        while done < len(self.states):
            for cls in range(12):
                self._move(self.states[done], cls)
            done += 1

    def _move(self, state: tuple, cls: int) -> None:
        costs, order = state
        best: dict[int, tuple] = {}
        for s, cost in enumerate(costs):
            if cost is not None:
                for to, letters, more in options(s, cls):
                    entry = (cost + more, order[s], letters, s)
                    best[to] = min(best.get(to, entry), entry)
        least = min(e[0] for e in best.values())
        best = {t: e for t, e in best.items() if e[0] <= least + MOST_APART}
        rank = {to: i for i, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        after = tuple(best[t][0] - least if t in best else None for t in range(4)), tuple(rank.get(t, 0) for t in range(4))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        self.next.append(self.number[after])
        self.added.append(least)
        self.back.append({t: (e[3], e[2]) for t, e in best.items()})

    def end(self, state: int) -> tuple[int, int, str]:
        """(cost beyond the least so far, state of the programme, letters after the last turn)."""
        costs, order = self.states[state]
        tail = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, s = min((costs[s] + INSERT * len(tail[s]), order[s], s) for s in range(4) if costs[s] is not None)
        return cost, s, tail[s]

    def trace(self, moves, s: int) -> tuple[str, int]:
        """(letters of the turns, state before them), read backwards from the state after them."""
        out = []
        for m in reversed(moves):
            s, letters = self.back[m][s]
            out.append(letters)
        return "".join(reversed(out)), s


def stream(segment: int):
    """For mapInArrow over (conv_id, turn, role, hash, initial, fault, later) in order: a row for each conversation.

    What is carried from batch to batch is the automaton's state, the counts and the numbers of the transitions so far.
    After ``segment`` of those they leave the task as a row, so that memory is bounded for a conversation of any length;
    its edits are then traced from the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        key_type, out, conv, before = None, [], None, None
        c: dict = {}

        def finish():
            cost, s, tail = machine.end(c["state"])
            row = {"gaps": c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0, "blank": c["n"][0], "duplicate": c["n"][1], "truncated": c["n"][2], "illegal": c["illegal"], "cost": c["cost"] + cost, "tail": tail, "state": s}
            if c["part"]:
                row |= {"part": c["part"], "moves": c["moves"].tobytes()}
            else:
                row |= {"part": 0, "audit": machine.trace(c["moves"], s)[0] + tail}
            out.append({"conv_id": conv[0]} | row)

        def batch():
            rows, out[:] = list(out), []
            schema = pa.schema([("conv_id", key_type), ("part", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("tail", pa.string()), ("state", pa.int32()), ("moves", pa.binary())])
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            key_type = b.schema.field(0).type
            for key, turn, role, text, initial, fault, later in zip(*(x.to_pylist() for x in b.columns)):
                if conv is None or conv[0] != key:
                    if conv is not None:
                        finish()
                    conv, before = (key,), None
                    c = {"state": 0, "cost": 0, "moves": array("H"), "part": 0, "n": [0, 0, 0], "illegal": 0, "turns": 0, "first": None, "last": None, "initial": None}
                repeated = later or before == (turn, role, text)
                before = (turn, role, text)
                # The first fault counts: blank, then repeated, then cut off.
                kind = 0 if fault == 0 else 1 if repeated else 2 if fault == 2 else None
                if kind is not None:
                    c["n"][kind] += 1
                if turn is not None and turn != c["last"]:
                    c["turns"] += 1
                    c["first"], c["last"] = turn if c["first"] is None else c["first"], turn
                if c["initial"] is not None and c["initial"] + initial not in ("su", "ua", "au"):
                    c["illegal"] += 1
                c["initial"] = initial
                move = c["state"] * 12 + row_class(initial, SOUND if kind is None else CUT_OFF if kind == 2 else GONE)
                c["moves"].append(move)
                c["state"] = machine.next[move]
                c["cost"] += machine.added[move]
                if len(c["moves"]) >= segment:
                    out.append({"conv_id": key, "part": c["part"], "moves": c["moves"].tobytes()})
                    c["part"], c["moves"] = c["part"] + 1, array("H")
                if len(out) >= 1000:
                    yield batch()
        if conv is not None:
            finish()
            yield batch()

    return run


def trace_parts():
    """For mapInArrow over (conv_id, part, moves, state, tail), each conversation's parts from its last: the letters of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state = Automaton(), 0
        for b in batches:
            letters = []
            for _, _, moves, end, tail in zip(*(x.to_pylist() for x in b.columns)):
                state = state if end is None else end
                m = array("H")
                m.frombytes(moves)
                found, state = machine.trace(m, state)
                letters.append(found + (tail or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(letters, pa.string())], names=["conv_id", "part", "letters"])

    return run


def apply_edits(digest: bool):
    """For mapInArrow over (conv_id, audit, turn, role, text) in order, the row with the edits before the turns: the
    repaired turns, or one SHA-256 over them for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, sha = None, "", 0, START, 0, hashlib.sha256()

        def emit(role: str, text: str):
            nonlocal place
            sha.update(((("\n" if place else "") + role + ":" + text).encode("utf-8", "replace")) if digest else b"")
            place += 1
            return (conv[0], place - 1, role, text)

        def inserts():
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, NEXT_ROLE[state]
                yield emit(NAMES[state], "")

        def batch(rows, key_type):
            if digest:
                schema = pa.schema([("conv_id", key_type), ("repaired_sha256", pa.string())])
            else:
                schema = pa.schema([("conv_id", key_type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        key_type = None
        for b in batches:
            key_type, rows = b.schema.field(0).type, []
            for key, edits, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if edits is not None:
                    if conv is not None:
                        more = list(inserts())
                        rows += [(conv[0], sha.hexdigest())] if digest else more
                    conv, audit, at, state, place, sha = (key,), edits, 0, START, 0, hashlib.sha256()
                    continue
                more = list(inserts())
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = kept_state(state, role[:1])
                    more.append(emit(role, text))
                elif letter == "R":
                    state = NEXT_ROLE[state]
                    more.append(emit(NAMES[state], text))
                rows += [] if digest else more
            if rows:
                yield batch(rows, key_type)
        if conv is not None:
            more = list(inserts())
            rows = [(conv[0], sha.hexdigest())] if digest else more
            if rows:
                yield batch(rows, key_type)

    return run


class Repair:
    """Faults and cheapest edits of conversations, and the conversations they give.

    A turn is blank (no character but spaces), a repeat (its role and text came earlier) or truncated (its last
    character that is no space is not one of ``.!?``); the first of these counts. Edits keep a turn (0), give it the role
    user or assistant (1), delete it (2; blank and repeated turns must go) or insert an empty user or assistant turn (5);
    a truncated turn that stays costs 5. The roles' initials must become ``(s?(ua)+)?``. Among the cheapest edits the
    least string of letters D, I, K, R is taken.

    Turns are dealt by conversation, sorted by turn (nulls first, then role and text) and stream past; only role
    initials, hashes and faults travel for the edits, texts only once they are known. Repeats are found by an
    aggregate over role and text of the whole table, so no task holds a conversation's texts.

    Null role or text is one space, and a null conversation is a conversation. Repeated rows are repeats. An empty table
    gives no rows. Turns are whole numbers or null. Other columns are not read.
    """

    def __init__(self, turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT):
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text)
        self.rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
        self.conv_type = dict(rows.dtypes)["conv_id"]
        self.segment = segment
        self._plan: DataFrame | None = None

    def plan(self) -> DataFrame:
        """conv_id, gaps, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of every conversation."""
        if self._plan is not None:
            return self._plan
        bare = F.rtrim("text", F.lit(SPACES))
        fault = F.when(bare == "", 0).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 1).otherwise(2)
        marks = self.rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("hash"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
        place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
        first = marks.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(place).alias("first"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
        marks = marks.join(first, same).select("conv_id", "turn", "role", "hash", "initial", "fault", (place > F.col("first")).alias("later"))
        streamed = keep(
            marks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "hash")
            .mapInArrow(stream(self.segment), f"conv_id {self.conv_type}, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, tail string, state int, moves binary"))
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        parts = streamed.filter("moves is not null").select("conv_id", "part", "moves", "state", "tail")
        traced = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(trace_parts(), f"conv_id {self.conv_type}, part long, letters string")
        long = traced.groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("long_audit"))
        whole = streamed.filter("cost is not null").join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        self._plan = keep(whole.select("conv_id", *counts, F.coalesce("audit", "long_audit").alias("audit")))
        return self._plan

    def _edited(self, digest: bool, schema: str) -> DataFrame:
        none = F.lit(None)
        edits = self.plan().select("conv_id", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("hash"))
        rows = self.rows.select("conv_id", none.cast("string").alias("audit"), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("hash"))
        both = edits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "hash")
        return both.select("conv_id", "audit", "turn", "role", "text").mapInArrow(apply_edits(digest), schema)

    def turns(self) -> DataFrame:
        """conv_id, ``place`` from 0, ``role`` and ``text`` of every turn of the repaired conversations."""
        return self._edited(False, f"conv_id {self.conv_type}, place long, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id and repaired_sha256, over ``role:text`` of its repaired turns joined by newlines."""
        return self._edited(True, f"conv_id {self.conv_type}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The turns with faults in them, by a hash of conversation and turn; null roles and texts are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hashed = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), hashed.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.filter("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repair(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with what :class:`Repair` finds in ``turns`` and repaired_sha256; those without turns have zeros."""
    job = Repair(turns)
    plan, digests = job.plan(), job.digests().withColumnRenamed("conv_id", "c")
    found = plan.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv_id", "c")
    every = pick(conversations, conv_id="conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
