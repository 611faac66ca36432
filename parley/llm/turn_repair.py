"""Conversation structure repair: the cheapest edits that give roles the form ``(s?(ua)+)?``.

Costs to go are found backward over turns and grammar states; a walk forward then takes the
ASCII-least edit among those that keep to these costs. A conversation is cut into pieces of
consecutive turns, so that none needs a single task: a piece tells what it costs between any two
states, the pieces' costs are folded backward to the costs to go after each, every piece walks from
each of the four states, and the states at which pieces start follow from where the walks end.

Tables have ``conv_id, turn, role, text``. Rows stand by turn, null first; rows of one turn by role,
then text. Null roles and texts count as one space. Rows with a null id are one conversation. Empty
tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.folds import joined_sha256
from parley.session import ship, written

#: Costs of the edits; an undeleted truncated turn costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after ua. What a role's initial leads to.
FITS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role of user and assistant that fits in each state, and the state after it.
GIVEN, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: After the last turn: cost to go by state, and the edits that end there.
END, LAST = (0, 4, 2, 0), ("", "II", "I", "")
#: A piece is at most so many consecutive rows: two to this power.
PIECE_BITS = 12
SPACES = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by ``crc32(conv_id:turn) % 20`` (a null: one space).

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats the row, 4 makes its
    role user. All rows of one conversation and turn get the same fault.
    """
    space = F.lit(" ")
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(said.cast("binary")) % 20).alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows, written in order: ``at`` numbers them so that each conversation's rise by turn.

    Partitions are ranges of conversation and turn, so a long conversation is spread. ``same`` is a
    digest of conversation, role and text, and ``state`` the role's initial with ``b`` for a blank
    text, ``t`` for a truncated one, else ``-``.
    """
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    rows = rows.repartitionByRange("conv_id", turn).sortWithinPartitions("conv_id", turn, "role", "text")
    shown = F.rtrim("text", F.lit(SPACES))
    fault = F.when(shown == "", "b").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    said = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\0"), F.octet_length("role").cast("string"), F.lit("\0"), F.col("role"), F.col("text"))
    return written(rows.select("*", F.monotonically_increasing_id().alias("at"), F.unhex(F.sha2(said, 256)).alias("same"), F.concat(F.rpad(F.substring("role", 1, 1), 1, "\0"), fault).alias("state")), "turns")


def faulty(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, at, state`` of ordered rows, where ``d`` in ``state`` marks duplicates.

    A row is one if its role and text were seen earlier and it is not blank. Only the first rows of
    repeated texts are joined back; no conversation or text has to be in one task.
    """
    slim = rows.select("conv_id", "turn", "at", "same", "state")
    firsts = slim.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    later = (F.col("at") > F.col("first")) & ~F.col("state").endswith("b")
    return slim.join(firsts, "same", "left").select("conv_id", "turn", "at", F.when(later, F.concat(F.substring("state", 1, 1), F.lit("d"))).otherwise(F.col("state")).alias("state"))


@cache
def step(state: str, ahead: tuple) -> tuple[tuple, tuple]:
    """One turn: costs to go before it, by grammar state, and what the walk does in each.

    ``ahead``: costs to go after it. What the walk does: the edits up to the turn's own, and the
    state after. Costs to go differ by little, so few different calls are made.
    """
    initial, fault = state[0], state[1]
    more = TRUNCATED if fault == "t" else 0

    def own(g: int) -> list[tuple[float, str, int]]:
        found = [(DELETE + ahead[g], "D", g)]
        if fault not in "bd":
            found.append((REROLE + more + ahead[AFTER[g]], "R", AFTER[g]))
            if initial in FITS[g]:
                found.append((more + ahead[FITS[g][initial]], "K", FITS[g][initial]))
        return found

    cost = [min(own(g))[0] for g in range(4)]
    for _ in range(3):
        cost = [min(cost[g], INSERT + cost[AFTER[g]]) for g in range(4)]

    def walk(g: int) -> tuple[str, int]:
        edits = ""
        while cost[g] < math.inf:
            tight = [(e, to) for c, e, to in own(g) if c == cost[g]] + [("I", -1)] * (INSERT + cost[AFTER[g]] == cost[g])
            edit, to = min(tight)
            edits += edit
            if edit != "I":
                return edits, to
            g = AFTER[g]
        return edits, -1

    return tuple(cost), tuple(walk(g) for g in range(4))


def _level(costs: Iterable[float]) -> tuple[tuple, float]:
    """Costs less their least, which is given too."""
    own = list(costs)
    least = min(own)
    return tuple(c - least for c in own), least


def backward(states: list[str], ahead: tuple) -> tuple[list[float], list[tuple]]:
    """Costs to go before a piece, and what its walk does at each turn."""
    (costs, total), moves = _level(ahead), []
    for state in reversed(states):
        costs, move = step(state, costs)
        costs, least = _level(costs)
        total += least
        moves.append(move)
    return [c + total for c in costs], moves[::-1]


def between(states: list[str]) -> list[int]:
    """What a piece costs from each state (4) to each state (4); -1: no way."""
    ends = [tuple(0 if g == end else math.inf for g in range(4)) for end in range(4)]
    to = [backward(states, end)[0] for end in ends]
    return [-1 if to[end][g] == math.inf else int(to[end][g]) for g in range(4) for end in range(4)]


def forward(states: list[str], ahead: tuple, last: bool) -> list[tuple[str, int]]:
    """For each state at which a piece may start, its edits and the state after."""
    moves, out = backward(states, ahead)[1], []
    for g in range(4):
        edits = []
        for move in moves:
            edit, g = move[g]
            edits.append(edit)
        out.append(("".join(edits) + (LAST[g] if last else ""), g))
    return out


def applied(states: list[str], edits: str, g: int) -> Iterator[tuple[int, str, str | None]]:
    """(turn, edit, role) of each edit of a piece that starts in state ``g``; a kept or deleted turn has
    no role of its own here, and inserted ones belong to the turn that follows them."""
    turn = 0
    for edit in edits:
        yield turn, edit, GIVEN[g] if edit in "IR" else None
        if edit != "D":
            g = FITS[g][states[turn][0]] if edit == "K" else AFTER[g]
        turn += edit != "I"


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _mapped(table: DataFrame, schema: str, kinds: list[pa.DataType], one) -> DataFrame:
    """``one`` gets the columns of a row and gives the rows that come of it; the first column stays as it is."""
    own = table.schema[0]
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                made = [(i, out) for i, row in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)) for out in one(*row)]
                first = part.column(0).take(pa.array([i for i, _ in made], pa.int64()))
                rest = _rows(names, kinds, [out for _, out in made])
                yield pa.RecordBatch.from_arrays([first, *rest.columns], [own.name, *names])

    kind = own.dataType.simpleString()
    named = table.mapInArrow(run, f"`{own.name}` {kind}, " + ", ".join(f"c{i} {t.strip().split(' ', 1)[1]}" for i, t in enumerate(schema.split(","))))
    return named.toDF(own.name, *[t.strip().split(" ", 1)[0] for t in schema.split(",")])


_INTS, _LONGS = pa.list_(pa.int64()), pa.int64()


def pieces(faults: DataFrame) -> DataFrame:
    """``conv_id, piece, places, states``: consecutive rows of a conversation, at most two to ``PIECE_BITS``."""
    block = F.shiftright("at", PIECE_BITS)
    own = faults.groupBy("conv_id", block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("at", "state"))).alias("_rows"))
    return own.select("conv_id", F.col("_rows")[0]["at"].alias("piece"), F.transform("_rows", lambda r: r["at"]).alias("places"), F.transform("_rows", lambda r: r["state"]).alias("states"))


def plan(faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of each conversation (``conv_id, illegal, cost, audit``), and of each piece
    (``conv_id, piece, places, states, edits, start``). Per conversation a task holds a few numbers of each piece,
    and the audit as a whole, which is one text of the result."""
    ship(faults.sparkSession)
    own = written(pieces(faults), "pieces")

    def told(states: list[str]) -> Iterator[tuple]:
        initials = [s[0] for s in states]
        yield between(states), initials[0], initials[-1], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))

    costs = _mapped(own.select(F.struct("conv_id", "piece").alias("of"), "states"), "costs array<bigint>, first string, last string, illegal bigint", [_INTS, pa.string(), pa.string(), _LONGS], told)
    grouped = costs.groupBy("of.conv_id").agg(F.array_sort(F.collect_list(F.struct("of.piece", "costs", "first", "last", "illegal"))).alias("own"))

    def back(own: list[dict]) -> Iterator[tuple]:
        illegal = sum(p["illegal"] for p in own) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
        ahead, out = list(END), []
        for i, p in reversed(list(enumerate(own))):
            out.append((p["piece"], ahead, i + 1 == len(own)))
            ahead = [min((p["costs"][4 * g + e] + ahead[e] for e in range(4) if p["costs"][4 * g + e] >= 0), default=0) for g in range(4)]
        for piece, costs, last in out:
            yield piece, costs, last, illegal, int(ahead[0])

    ahead = _mapped(grouped, "piece bigint, ahead array<bigint>, last boolean, illegal bigint, cost bigint", [_LONGS, _INTS, pa.bool_(), _LONGS, _LONGS], back)
    joined = own.select("piece", "states").join(ahead, "piece")

    def walks(states: list[str], costs: list[int], last: bool) -> Iterator[tuple]:
        found = forward(states, tuple(costs), last)
        yield [g for _, g in found], [e for e, _ in found]

    walked = _mapped(joined.select(F.struct("conv_id", "piece", "illegal", "cost").alias("of"), "states", "ahead", "last"), "ends array<bigint>, walks array<string>", [_INTS, pa.list_(pa.string())], walks)
    walked = written(walked, "walks")
    grouped = walked.groupBy("of.conv_id").agg(F.array_sort(F.collect_list(F.struct("of.piece", "ends"))).alias("own"))

    def starts(own: list[dict]) -> Iterator[tuple]:
        g = 0
        for p in own:
            yield p["piece"], g
            g = p["ends"][g]

    started = _mapped(grouped, "piece bigint, start bigint", [_LONGS, _LONGS], starts).drop("conv_id")
    chosen = written(walked.select("of.*", "walks").join(started, "piece").select("conv_id", "piece", "illegal", "cost", "start", F.element_at("walks", F.col("start").cast("int") + 1).alias("edits")), "edits")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda p: p["edits"]), "")
    whole = chosen.groupBy("conv_id").agg(F.first("illegal").alias("illegal"), F.first("cost").alias("cost"), audit.alias("audit"))
    return whole, chosen.select("conv_id", "piece", "edits", "start").join(own.select("piece", "places", "states"), "piece").select("conv_id", "piece", "places", "states", "edits", "start")


def repaired(rows: DataFrame, by_piece: DataFrame) -> DataFrame:
    """``conv_id, at, nth, edit, role, text``: the turns that stand after the edits, in the order of ``at``
    and ``nth``; deleted turns are left out, inserted ones have an empty text."""

    def out(places: list[int], states: list[str], edits: str, start: int) -> Iterator[tuple]:
        for nth, (turn, edit, role) in enumerate(applied(states, edits, start)):
            yield places[min(turn, len(places) - 1)], nth, edit, role

    made = _mapped(by_piece.select("conv_id", "places", "states", "edits", "start"), "at bigint, nth bigint, edit string, given string", [_LONGS, _LONGS, pa.string(), pa.string()], out).where("edit <> 'D'")
    new = made.where("edit = 'I'").select("conv_id", "at", "nth", "edit", F.col("given").alias("role"), F.lit("").alias("text"))
    old = made.where("edit <> 'I'").drop("conv_id").join(rows.select("conv_id", "at", "role", "text"), "at")
    return old.select("conv_id", "at", "nth", "edit", F.coalesce("given", "role").alias("role"), "text").unionByName(new)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report per conversation (``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``)
    and the repaired turns (see ``repaired``). ``gaps`` counts the missing turn numbers."""
    rows = ordered(conversations)
    faults = written(faulty(rows), "faults")
    many = lambda mark: F.count_if(F.col("state").endswith(mark))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).cast("long"), F.lit(0).cast("long"))
    counts = faults.groupBy("conv_id").agg(gaps.alias("gaps"), many("b").alias("blank"), many("d").alias("duplicate"), many("t").alias("truncated"))
    whole, by_piece = plan(faults)
    report = counts.alias("a").join(whole.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "b.illegal", "b.cost", "b.audit")
    return report, repaired(rows, by_piece)


def digests(conversations: DataFrame, report: DataFrame, turns: DataFrame) -> DataFrame:
    """The report for every ``conv_id`` of ``conversations`` (zeros and empty where it has no rows), with
    ``repaired_sha256``: digest of ``role:text`` of the repaired turns, joined by newlines."""
    lines = joined_sha256(turns, F.col("conv_id"), [F.col("at"), F.col("nth")], F.concat("role", F.lit(":"), "text"), "\n")
    ids = conversations.select("conv_id").distinct().alias("i")
    found = ids.join(report.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(lines.alias("l"), F.col("i.conv_id").eqNullSafe(F.col("l.key")), "left")

    def or_else(name: str, other: object) -> Column:
        return F.coalesce(F.col(name), F.lit(other)).alias(name.split(".")[1])

    counts = [or_else(f"r.{c}", 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("i.conv_id", *[c.cast("long") for c in counts], or_else("r.audit", ""), F.coalesce("l.sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
