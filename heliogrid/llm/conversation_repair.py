"""Conversation structure repair by error-correcting Earley parsing.

The role grammar is right-linear and weighted: a production takes one role and leads to a nonterminal, and nonterminals that may
end have an empty one. Next to taking a row as it is (Keep, K) there are error productions: a row's role
becomes one that fits (Rerole, R), a row is passed over (Delete, D), or a role is taken that no row has (Insert, I).
An item of the chart is a predicted nonterminal at a row; it holds the least (cost, audit) that leads there. As
completion only ever runs up the chain of right recursions, it's done once, at the last row: the nonterminals with an
empty production there complete the chart, and the least of them gives the repair.

Audits are never copied from item to item. An audit of fewer inserts at equal cost can't be the beginning of another
that leads to the same item, so of two audits the first letter that differs decides; items of one row keep the rank of
their audits, and new ranks follow from old ranks and the step's own letters.

Rows are sorted over tasks by (conversation, turn, role, text) by range, so a conversation of any size goes over as
many tasks as it needs. A conversation that lies inside one task is parsed there, as its rows pass. Of others, every ``SEGMENT`` rows
are parsed from each nonterminal to each nonterminal; one pass over these small tables picks the way through; and the segments then
give their edits. Only the hash of a whole repaired conversation takes its rows through one task, as a stream.

Defined results: turns go nulls first, rows of equal turn by role, then text; a null conv_id is a conversation of its own; null
role or text is one blank; repeated rows are duplicates; long texts are rows like others; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import group_arrow, map_arrow, n_parts, scratch, staged

#: Productions by nonterminal: role initial to the nonterminal after it. Those in ENDS have an empty production.
GRAMMAR = {"start": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "assistant"}, "assistant": {"u": "user"}}
STATES = list(GRAMMAR)
ENDS = {"start", "assistant"}
#: Role that an error production gives, by initial.
ROLES = {"u": "user", "a": "assistant"}
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
#: Added for an undeleted row of this fault.
TRUNCATED_COST = 3
#: Inserts in a row beyond this lead to no new nonterminal.
MOST_INSERTS = 2
#: Rows parsed as one segment, where a conversation lies in more than one task or is longer.
SEGMENT = 4_096
LEGAL = {"su", "ua", "au"}
BLANKS = "\x20\t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
COUNTS = ("gaps", *FAULTS, "illegal", "cost")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SORTED = "part int, at long, conv_id long, turn long, role string, text string"


class Item(NamedTuple):
    """A predicted nonterminal: cost, rank of its audit among those of the row, and the item and the edits it came by."""

    cost: int
    rank: int
    back: int
    edits: str


def fault(role: str, text: str, seen: bool) -> str | None:
    """The first fault of a row."""
    ink = text.rstrip(BLANKS)
    if not ink:
        return "blank"
    return "duplicate" if seen else None if ink[-1] in ".!?" else "truncated"


def _inserted(item: int) -> Iterator[tuple[str, int]]:
    """What inserts make of nonterminal ``item``: (letters, nonterminal)."""
    reached = [("", item)]
    for _ in range(MOST_INSERTS + 1):
        yield from reached
        reached = [(edits + "I", STATES.index(to)) for edits, s in reached for role, to in GRAMMAR[STATES[s]].items() if role in ROLES]


CLOSURE = [list(_inserted(s)) for s in range(len(STATES))]


def _column(before: dict[int, Item], role: str, found: str | None) -> dict[int, Item]:
    """Items after one more row."""
    extra = TRUNCATED_COST if found == "truncated" else 0
    best: dict[int, tuple[int, int, str, int]] = {}
    for s, item in before.items():
        for inserts, at in CLOSURE[s]:
            cost = item.cost + COST["I"] * len(inserts)
            steps = [] if inserts else [("D", COST["D"], at)]  # inserts before a row that goes can as well follow it
            if found not in ("blank", "duplicate"):
                for initial, to in GRAMMAR[STATES[at]].items():
                    to = STATES.index(to)
                    if role[:1] == initial:
                        steps.append(("K", COST["K"] + extra, to))
                    if initial in ROLES:
                        steps.append(("R", COST["R"] + extra, to))
            for letter, price, to in steps:
                new = (cost + price, item.rank, inserts + letter, s)
                if to not in best or new < best[to]:
                    best[to] = new
    ranks = {key: k for k, key in enumerate(sorted({(rank, edits) for _, rank, edits, _ in best.values()}))}
    return {to: Item(cost, ranks[rank, edits], back, edits) for to, (cost, rank, edits, back) in best.items()}


def chart(rows: Iterable[tuple[str, str | None]], start: int = 0) -> list[dict[int, Item]]:
    """The columns of the chart of (role, fault) rows, from nonterminal ``start``."""
    columns = [{start: Item(0, 0, -1, "")}]
    for role, found in rows:
        columns.append(_column(columns[-1], role, found))
    return columns


def completed(last: dict[int, Item]) -> tuple[int, int, str, int]:
    """(cost, rank, closing inserts, nonterminal) of the least completion."""
    ways = ((i.cost + COST["I"] * len(inserts), i.rank, inserts, s) for s, i in last.items() for inserts, at in CLOSURE[s] if STATES[at] in ENDS)
    return min(ways)


def edits_to(columns: list[dict[int, Item]], end: int) -> list[str]:
    """The edits of each row on the way to nonterminal ``end``."""
    out = []
    for column in reversed(columns[1:]):
        item = column[end]
        out.append(item.edits)
        end = item.back
    return out[::-1]


def repaired(rows: Iterable[tuple[str, str]], edits: Iterable[str], state: int, closing: str = "") -> Iterator[str]:
    """``role:text`` of the repaired rows."""

    def go(initial: str | None) -> str:
        nonlocal state
        options = GRAMMAR[STATES[state]]
        initial = initial if initial in options else next(i for i in options if i in ROLES)
        state = STATES.index(options[initial])
        return ROLES.get(initial, "")

    for (role, text), letters in zip(rows, edits, strict=True):
        for _ in letters[:-1]:
            yield go(None) + ":"
        if letters[-1] == "K":
            go(role[:1])
            yield f"{role}:{text}"
        elif letters[-1] == "R":
            yield f"{go(None)}:{text}"
    for _ in closing:
        yield go(None) + ":"


class _Counts:
    """Faults, illegal neighbours and turns of rows as they pass."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = 0
        self.first_role = self.last_role = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, found: str | None) -> None:
        if found:
            self.faults[found] += 1
        if self.last_role is None:
            self.first_role = role[:1]
        elif self.last_role + role[:1] not in LEGAL:
            self.illegal += 1
        self.last_role = role[:1]
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1

    def follow(self, other: _Counts) -> None:
        """``other`` comes right after."""
        for f in FAULTS:
            self.faults[f] += other.faults[f]
        if self.last_role is None:
            self.first_role = other.first_role
        else:
            self.illegal += other.illegal + (self.last_role + (other.first_role or "") not in LEGAL)
            other.illegal = 0
        self.illegal += other.illegal
        self.last_role = other.last_role
        if other.turns:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def values(self) -> dict[str, int]:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.faults, "illegal": self.illegal}


def _repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """Counts, cost, audit and hash of one conversation's sorted (turn, role, text) rows."""
    seen: set[tuple[str, str]] = set()
    counts, faults = _Counts(), []
    for turn, role, text in rows:
        faults.append(fault(role, text, (role, text) in seen))
        seen.add((role, text))
        counts.add(turn, role, faults[-1])
    columns = chart(zip((r for _, r, _ in rows), faults, strict=True))
    cost, _, closing, end = completed(columns[-1])
    edits = edits_to(columns, end)
    lines = repaired(((r, t) for _, r, t in rows), edits, 0, closing)
    return counts.values() | {"cost": cost, "audit": "".join(edits) + closing, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _inner(segment: int):
    """Results of the conversations inside a task; the rows of its first and last conversation, and of those above ``segment`` rows.

    Sorted (conv_id, turn, role, text) come in. A conversation at the edge of a task may go on in the next one.
    """
    names = [f.split()[0] for f in (RESULT + ", " + SORTED.replace("conv_id long", "of long")).split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        part, at, out = TaskContext.get().partitionId(), 0, []

        def batch():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def passed(rows):
            nonlocal at
            for conv, turn, role, text in rows:
                out.append((None,) * 9 + (part, at, conv, turn, role, text))
                at += 1
                if len(out) >= 2_000:
                    yield batch()

        held = None  # the conversation before, which is inside the task if another follows
        groups = groupby(_rows(batches), key=lambda r: r[0])
        for k, (_, rows) in enumerate(groups):
            if held:
                done = _repair([r[1:] for r in held])
                out.append((held[0][0], *(done[c] for c in COUNTS), done["audit"], done["repaired_sha256"]) + (None,) * 6)
                held = None
            if k == 0:
                yield from passed(rows)
            else:
                held = list(islice(rows, segment + 1))
                if len(held) > segment:
                    yield from passed(held)
                    yield from passed(rows)
                    held = None
            if len(out) >= 2_000:
                yield batch()
        if held:
            yield from passed(held)
        if out:
            yield batch()

    return run


SEGMENTS = "conv_id long, part int, segment long, counts string, ways string"
EDITED = "conv_id long, part int, segment long, audit string, text string"


def _summary(group: pa.Table) -> pa.Table:
    """Counts of a segment, and cost and rank of the way between each two nonterminals."""
    rows = sorted(group.select(["at", "turn", "role", "fault"]).to_pylist(), key=lambda r: r["at"])
    counts = _Counts()
    for r in rows:
        counts.add(r["turn"], r["role"], r["fault"])
    ways = [{end: (i.cost, i.rank) for end, i in chart(((r["role"], r["fault"]) for r in rows), s)[-1].items()} for s in range(len(STATES))]
    return pa.table({"conv_id": group["conv_id"].slice(0, 1), "part": group["part"].slice(0, 1), "segment": group["segment"].slice(0, 1), "counts": [json.dumps(vars(counts))], "ways": [json.dumps(ways)]})


CHOSEN = "conv_id long, part int, segment long, first int, last int, closing string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _choose(group: pa.Table) -> pa.Table:
    """The nonterminals that the best way through all segments of a conversation passes."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["segment"]))
    total, items, back = _Counts(), {0: (0, 0)}, []
    for r in rows:
        counts = _Counts()
        vars(counts).update(json.loads(r["counts"]))
        total.follow(counts)
        best: dict[int, tuple] = {}
        for s, (cost, rank) in items.items():
            for end, (more, own) in json.loads(r["ways"])[s].items():
                new = (cost + more, (rank, own), s)
                if int(end) not in best or new < best[int(end)]:
                    best[int(end)] = new
        ranks = {x: k for k, x in enumerate(sorted({b[1] for b in best.values()}))}
        items = {end: (cost, ranks[both]) for end, (cost, both, _) in best.items()}
        back.append({end: s for end, (_, _, s) in best.items()})
    cost, _, closing, end = completed({s: Item(*i, -1, "") for s, i in items.items()})
    out = []
    for k, r in reversed(list(enumerate(rows))):
        first = back[k][end]
        out.append({"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "first": first, "last": end, "closing": closing if k == len(rows) - 1 else "", **total.values(), "cost": cost})
        end = first
    return pa.Table.from_pylist(out, schema=_schema(CHOSEN))


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _edit(group: pa.Table) -> pa.Table:
    """Audit and repaired text of a segment, on the way that was chosen for it."""
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    one = rows[0]
    columns = chart(((r["role"], r["fault"]) for r in rows), one["first"])
    edits = edits_to(columns, one["last"])
    lines = list(repaired(((r["role"], r["text"]) for r in rows), edits, one["first"], one["closing"]))
    out = {"conv_id": one["conv_id"], "part": one["part"], "segment": one["segment"], "audit": "".join(edits) + one["closing"], "text": "\n".join(lines) if lines else None}
    return pa.Table.from_pylist([out], schema=_schema(EDITED))


def _joined(batches):
    """Audit and hash of each conversation whose sorted segments pass by."""
    conv, audit, digest, empty = None, [], None, True
    out = []
    for c, _, _, letters, text in _rows(batches):
        if digest is None or c != conv:
            if digest is not None:
                out.append((conv, "".join(audit), digest.hexdigest()))
            conv, audit, digest, empty = c, [], hashlib.sha256(), True
        audit.append(letters)
        if text is not None:
            digest.update((text if empty else "\n" + text).encode())
            empty = False
    if digest is not None:
        out.append((conv, "".join(audit), digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "repaired_sha256"])


def _across(rows: DataFrame, segment: int) -> DataFrame:
    """Results of the conversations that lie in several tasks or are long; ``rows`` has columns SORTED."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("digest", digest)
    place = F.struct("part", "at")
    # null conv_id is a conversation too, so joins on it take nulls as equal
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    mark = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    found = F.when(mark == "", "blank").when(place > F.col("first"), "duplicate").when(~mark.isin(".", "!", "?"), "truncated")
    rows = rows.join(firsts, F.expr("conv_id <=> c and digest = d")).withColumns({"fault": found, "segment": F.floor(F.col("at") / segment).cast("long")})
    rows = staged(rows.select("conv_id", "part", "segment", "at", "turn", "role", "text", "fault"), "segments")
    keys = ["conv_id", "part", "segment"]
    chosen = staged(group_arrow(group_arrow(rows.drop("text"), keys, _summary, SEGMENTS), ["conv_id"], _choose, CHOSEN), "chosen")
    way = chosen.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("segment").alias("s"), "first", "last", "closing")
    edited = group_arrow(rows.join(way, F.expr("conv_id <=> c and part = p and segment = s")).drop("c", "p", "s"), keys, _edit, EDITED)
    whole = map_arrow(edited.repartition(n_parts(rows.sparkSession), "conv_id").sortWithinPartitions(*keys), _joined, "conv_id long, audit string, repaired_sha256 string")
    counts = chosen.groupBy(F.col("conv_id").alias("c")).agg(*[F.max(c).alias(c) for c in COUNTS])
    return whole.join(counts, F.expr("conv_id <=> c")).select(*[f.split()[0] for f in RESULT.split(", ")])


def repair(conversations: DataFrame, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """One row a conversation of ``conversations`` (conv_id, turn, role, text): counts, cost, audit, hash of the repaired rows."""
    spark = conversations.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    order = ["conv_id", "turn", "role", "text"]
    # equal rows may go to different tasks by the number that comes last
    dealt = rows.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(parts or n_parts(spark), *order, "deal").sortWithinPartitions(*order).select(*order)
    with scratch(spark) as keep:
        passed = staged(map_arrow(dealt, _inner(segment), RESULT + ", " + SORTED.replace("conv_id long", "of long")), "passed")
        inner = passed.where("audit is not null").select(*[f.split()[0] for f in RESULT.split(", ")])
        edge = passed.where("part is not null").select("part", "at", F.col("of").alias("conv_id"), "turn", "role", "text")
        across = staged(_across(edge, segment), "across")
        keep(passed, across)
    return inner.union(across)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as the query damages them, by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation, damaged and repaired; one without rows after the damage has zeros and the hash of nothing."""
    done = repair(damage(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(done, F.expr("conv_id <=> of"), "left")
    none = {c: F.lit(0).cast("long") for c in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
