"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation's rows, by turn (nulls first), then role, text, are turned into a legal one, whose role initials read
``(s?(ua)+)?``, by the cheapest edits:

* Keep (0; 5 more for a truncated row), Rerole to user or assistant (1; 5 more likewise), Delete (2), Insert an
  empty user or assistant turn anywhere (5);
* blank rows and rows whose role and text were seen earlier have to be deleted.

Of edits that cost the same those whose initials, read in order, come first in ASCII are taken; they fix the result.

The search keeps one survivor per state of the grammar. Survivors are leaves of a tree of backpointers; a node's
children are its references, and a node nobody refers to any more is released. As soon as all survivors share an
ancestor the edits up to it are final: they are emitted and their rows forgotten, so memory holds the unresolved
part of the tree only. Ties are decided by the complete unresolved edits: as survivors stand at the same row, no one's edits
begin another's, so their order after a row follows from their order before it and the edits of the row,
and is carried along. A survivor that another one beats by more than it costs to take over its future is released early.

A conversation may hold any share of the rows. Equal rows are counted first; rows are cut into ranges by
(conversation, turn, role, beginning of the text), and what a conversation has in one range is a block. A block of a cut
conversation is solved once for each state it may be entered in (costs and order of the exits: 16 numbers);
blocks, at most as many as ranges, are chained; then each is solved again for the one pair of states on the
best path. Only the digest of the repaired text, which is defined on the whole, reads a cut conversation in one stream.

Null ids are one conversation; a null role or text counts as one space; an empty role fits nowhere and is
reroled or deleted; other columns are not read. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

WORDLIKE = r"[^\x20\x09-\x0D]"
#: States: nothing put out yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after a turn of each initial.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Insertions that end a conversation legally.
CLOSING = ("", "II", "I", "")
#: What it costs at most that state p takes over the future of state q (by deleting a system turn, or insertions).
TAKEOVER = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
NEVER = 1 << 60
#: Beginning of a text by which rows of the same turn and role may be dealt to different ranges.
RANGE_CHARS = 200
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _moves(initial: str, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """Per state before the row: (state after it, cost, edits) of the best way to each state."""
    out = []
    for state in STATES:
        best = {state: (DELETE, "D")}  # an insertion before a deletion may as well come after it
        at, spent = state, 0
        for inserted in ("", "I", "II"):
            keep = AFTER[at].get(initial)
            rerole = AFTER[at].get("a" if at == USER else "u")
            for to, cost, name in ((keep, KEEP, "K"), (rerole, REROLE, "R")):
                if to is not None:
                    way = (spent + cost + TRUNCATED * truncated, inserted + name)
                    best[to] = min(way, best.get(to, way))
            at, spent = _inserted(at), spent + INSERT
        out.append([(to, *way) for to, way in best.items()])
    return out


MOVES = {(initial, truncated): _moves(initial, truncated) for initial in ("s", "u", "a", "") for truncated in (False, True)}
FORCED = [[(state, DELETE, "D")] for state in STATES]


class Node:
    """One row's edits on a path; ``children`` are the references to it."""

    __slots__ = ("parent", "edits", "row", "children")

    def __init__(self, parent, edits: str, row):
        self.parent, self.edits, self.row, self.children = parent, edits, row, []
        if parent is not None:
            parent.children.append(self)


def _release(node: Node) -> None:
    while node.parent is not None and not node.children:
        parent = node.parent
        parent.children.remove(node)
        node = parent


class Search:
    """Viterbi over rows. ``step`` takes a row and yields (edits, row) that became final."""

    def __init__(self, entry: int = START):
        self.root = Node(None, "", None)
        self.live: dict[int, tuple[int, int, Node]] = {entry: (0, 0, self.root)}  # cost, place in the order of ties, leaf

    def step(self, row, moves) -> Iterator[tuple[str, object]]:
        best: dict[int, tuple] = {}
        for state, (cost, place, node) in self.live.items():
            for to, more, edits in moves[state]:
                way = (cost + more, place, edits)
                if to not in best or way < best[to][:3]:
                    best[to] = (*way, node)
        old = [node for _, _, node in self.live.values()]
        kept = {to: way for to, way in best.items() if not any(other[0] + TAKEOVER[p][to] < way[0] for p, other in best.items())}
        order = sorted(kept, key=lambda to: kept[to][1:3])
        self.live = {to: (kept[to][0], place, Node(kept[to][3], kept[to][2], row)) for place, to in enumerate(order)}
        for node in old:
            if node is not self.root:
                _release(node)
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root.edits, self.root.row
            self.root.row = None

    def exits(self) -> tuple[list[int], list[int]]:
        """Cost and place in the order of ties by exit state."""
        return ([self.live[s][0] if s in self.live else NEVER for s in STATES],
                [self.live[s][1] if s in self.live else NEVER for s in STATES])

    def finish(self, state: int) -> Iterator[tuple[str, object]]:
        path, node = [], self.live[state][2]
        while node is not self.root:
            path.append((node.edits, node.row))
            node = node.parent
        return reversed(path)


def closed(costs: list[int], places: list[int]) -> int:
    """The state in which a conversation ends best."""
    return min(STATES, key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), places[s]))


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int
    fault: str  # blank, duplicate, truncated or empty
    initial: str


def moves_of(row: Row):
    if row.fault in ("blank", "duplicate"):
        return FORCED
    return MOVES[row.initial if row.initial in ("s", "u", "a") else "", row.fault == "truncated"]


def searched(search: Search, rows: Iterator[Row]) -> Iterator[tuple[str, Row]]:
    """Final edits of rows; all copies of a row but the first are duplicates."""
    for row in rows:
        yield from search.step(row, moves_of(row))
        if row.copies > 1:
            yield from search.step(row, [[(s, DELETE * (row.copies - 1), "D" * (row.copies - 1))] for s in STATES])


class Writer:
    """Turns of the repaired conversation from final edits."""

    def __init__(self, entry: int = START):
        self.state = entry

    def turns(self, edits: str, row: Row | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each edit; of a deletion the row's own."""
        for edit in edits:
            if edit == "D":
                yield edit, row.role, row.text
                continue
            role = {"u": "user", "a": "assistant"}["a" if self.state == USER else "u"]
            if edit == "K":
                yield edit, row.role, row.text
                self.state = AFTER[self.state][row.initial]
            else:
                yield edit, role, row.text if edit == "R" else ""
                self.state = _inserted(self.state)


class Counts:
    """Counts over a block's rows that add up over blocks."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "low", "high", "distinct", "last_turn", "first_turn", "first", "last")

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, row: Row) -> None:
        if not row.copies:
            return
        if row.fault == "blank":
            self.blank += row.copies
        else:
            if row.fault:
                setattr(self, row.fault, getattr(self, row.fault) + 1)
            self.duplicate += row.copies - 1
        pairs = self._pair(self.last, row.initial) + (row.copies - 1) * self._pair(row.initial, row.initial)
        self.join(row.copies, pairs, row.turn, row.turn, int(row.turn is not None), row.turn, row.turn, row.initial, row.initial)

    @staticmethod
    def _pair(a: str | None, b: str | None) -> int:
        return int(a is not None and b is not None and a + b not in ("su", "ua", "au"))

    def merge(self, other: "Counts") -> None:
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.join(other.rows, other.illegal + self._pair(self.last, other.first), other.low, other.high, other.distinct, other.first_turn,
                  other.last_turn, other.first, other.last)

    def join(self, rows, illegal, low, high, distinct, first_turn, last_turn, first, last) -> None:
        self.rows += rows
        self.illegal += illegal
        if low is not None:
            self.distinct += distinct - (self.last_turn == first_turn and self.last_turn is not None)
            self.low = low if self.low is None else min(low, self.low)
            self.high = high if self.high is None else max(high, self.high)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        if first is not None:
            self.first = first if self.first is None else self.first
            self.last = last

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
PLACED = "conv_id bigint, part bigint, cut boolean, pos bigint, turn bigint, role string, text string, copies bigint, fault string, initial string"


def placed(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Rows in order, stored: equal rows counted, faults found, cut into ranges; ``cut`` marks conversations that
    reach over several ranges. ``copies`` says how often a row stands (0: it only names its conversation)."""
    spark = rows.sparkSession
    copies = F.lit(1) if copies is None else copies
    there = copies > 0
    base = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.when(there, F.col("turn").cast("bigint")).alias("turn"),
                       F.when(there, F.coalesce(F.col("role").cast("string"), F.lit(" "))).otherwise("").alias("role"),
                       F.when(there, F.coalesce(F.col("text").cast("string"), F.lit(" "))).otherwise("").alias("text"),
                       copies.cast("bigint").alias("copies"))
    counted = base.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    blank = ~F.col("text").rlike(WORDLIKE)
    when = F.struct(F.col("turn").isNotNull(), "turn")
    counted = counted.withColumn("seen", F.unhex(F.sha2(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"),
        "text").cast("binary"), 256)))
    # role and text of several turns, with the first of them; AQE broadcasts them if few or splits a hot one
    again = (counted.where(~blank & (F.col("copies") > 0)).groupBy("seen").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("m"))
             .where("m > 1").select("seen", "first"))
    fault = (F.when(blank, "blank").when(F.col("first").isNotNull() & (when > F.col("first")), "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise(""))
    faulty = counted.join(again, "seen", "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"),
                                                        F.substring("role", 1, 1).alias("initial"))
    ordered = (faulty.repartitionByRange(partitions(spark), "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))
               .sortWithinPartitions("conv_id", "turn", "role", "text")
               .withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id().cast("bigint")))
    table = stored(ordered, "conversations-placed")
    # a border between ranges cuts at most one conversation: fewer rows than ranges
    cut = (table.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
           .select(F.col("conv_id").alias("c"), F.lit(True).alias("is_cut")))
    return (table.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .withColumn("cut", F.coalesce("is_cut", F.lit(False)))
            .withColumn("part", F.when(F.col("cut"), F.col("part")).otherwise(F.lit(-1).cast("bigint")))
            .select("conv_id", "part", "cut", "pos", "turn", "role", "text", "copies", "fault", "initial"))


def _dealt(table: DataFrame) -> DataFrame:
    return table.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in the first ``width`` columns, streamed."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    it = rows()
    ahead = next(it, None)
    while ahead is not None:
        key = ahead[:width]

        def run():
            nonlocal ahead
            while ahead is not None and ahead[:width] == key:
                now, ahead = ahead, next(it, None)
                yield now
        group = run()
        yield key, group
        for _ in group:
            pass


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size=lambda row: 200) -> Iterator[pa.RecordBatch]:
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += size(row)
        if len(held) >= BATCH_ROWS or bytes_held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, bytes_held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _rows(group: Iterator[tuple], counts: Counts | None = None) -> Iterator[Row]:
    for r in group:
        row = Row(*r[4:10])
        if counts is not None:
            counts.add(row)
        if row.copies:
            yield row


def _whole(group: Iterator[tuple]) -> tuple:
    """Report of a conversation that lies in one block."""
    counts, search, writer = Counts(), Search(), Writer()
    audit, text = [], Text()

    def take(final):
        for edits, row in final:
            audit.append(edits)
            for edit, role, said in writer.turns(edits, row):
                if edit != "D":
                    text.add(role, said)

    take(searched(search, _rows(group, counts)))
    costs, places = search.exits()
    state = closed(costs, places)
    take(search.finish(state))
    take([(CLOSING[state], None)])
    return (counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, costs[state] + INSERT * len(CLOSING[state]),
            "".join(audit), text.hash.hexdigest())


class Text:
    """Digest of ``role:text`` lines."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.hash.update(b"\n" * self.any + f"{role}:{text}".encode())
        self.any = True


def _block(group: Iterator[tuple]) -> tuple[list[int], list[int], str]:
    """Costs and places of the exits by entry (4 x 4 each), counts."""
    counts, searches = Counts(), [Search(s) for s in STATES]
    for row in _rows(group, counts):
        for search in searches:
            for _ in searched(search, iter([row])):
                pass
    exits = [s.exits() for s in searches]
    return [x for e in exits for x in e[0]], [x for e in exits for x in e[1]], [getattr(counts, f) for f in Counts.FIELDS]


def _chain(blocks: list[tuple]) -> tuple[list[tuple[int, int]], Counts, int]:
    """Entry and exit state of every block on the best path, counts, cost. blocks: (costs, places, counts) in order."""
    live, taken, total = {START: (0, 0)}, [], Counts()
    for costs, places, fields in blocks:
        best = {}
        for p, (cost, place) in live.items():
            for q in STATES:
                if costs[4 * p + q] < NEVER:
                    way = (cost + costs[4 * p + q], place, places[4 * p + q], p)
                    best[q] = min(way, best.get(q, way))
        order = sorted(best, key=lambda q: best[q][1:3])
        live = {q: (best[q][0], place) for place, q in enumerate(order)}
        taken.append({q: way[3] for q, way in best.items()})
        part = Counts()
        for name, value in zip(Counts.FIELDS, fields):
            setattr(part, name, value)
        total.merge(part)
    costs, places = ([live[s][i] if s in live else NEVER for s in STATES] for i in (0, 1))
    state = closed(costs, places)
    cost, path = costs[state] + INSERT * len(CLOSING[state]), []
    for entries in reversed(taken):
        path.append((entries[state], state))
        state = entries[state]
    return path[::-1], total, cost


def _states(table: DataFrame) -> DataFrame:
    """c, p (block), entry, closing (the last block's exit state, else null), exit, and the conversation's report, for blocks of cut
    conversations; at most two rows a range."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, part), group in _groups(batches, 2):
                costs, places, c = _block(group)
                yield conv, part, costs, places, c[:10], c[10:]
        yield from _batched(rows(), ["conv_id", "part", "costs", "places", "numbers", "initials"],
                            [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())])

    def fold(key, frame):
        import pandas as pd
        frame = frame.sort_values("part")
        blocks = [(list(c), list(p), [None if x is None or x != x else int(x) for x in n] + list(i))
                  for c, p, n, i in zip(frame["costs"], frame["places"], frame["numbers"], frame["initials"])]
        path, counts, cost = _chain(blocks)
        last = len(path) - 1
        out = pd.DataFrame([(p, a, b, b if i == last else None, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost)
                            for i, (p, (a, b)) in enumerate(zip(frame["part"], path))],
                           columns=["p", "entry", "exit", "closing", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])
        out.insert(0, "c", pd.array([key[0]] * len(out), dtype="Int64"))
        return out.astype({"closing": "Int64"})

    blocks = (_dealt(table.where("cut"))
              .mapInArrow(solve, "conv_id bigint, part bigint, costs array<bigint>, places array<bigint>, numbers array<bigint>, initials array<string>"))
    return stored(stored(blocks, "conversations-blocks").groupBy("conv_id")
                  .applyInPandas(fold, f"c bigint, p bigint, entry bigint, exit bigint, closing bigint, {REPORT}"), "conversations-states")


def _edits(table: DataFrame, states: DataFrame, deleted: bool) -> DataFrame:
    """conv_id, part, seq, edit, turn, role, text of every edit, blocks solved between their known states."""
    known = table.join(F.broadcast(states.select("c", "p", "entry", "exit", "closing")),
                       F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, part), group in _groups(batches, 2):
                first = next(group)
                entry, exit, closing = first[12:15]
                search, writer, seq = Search(entry or START), Writer(entry or START), 0

                def final():
                    yield from searched(search, _rows(iter([first])))
                    yield from searched(search, _rows(group))
                    state = closed(*search.exits()) if exit is None else exit
                    yield from search.finish(state)
                    if exit is None or closing is not None:
                        yield CLOSING[state], None

                for edits, row in final():
                    for edit, role, text in writer.turns(edits, row):
                        if deleted or edit != "D":
                            yield conv, part, seq, edit, row.turn if row and edit != "I" else None, role, text
                        else:
                            yield conv, part, seq, edit, row.turn, None, None
                        seq += 1
        yield from _batched(rows(), ["conv_id", "part", "seq", "edit", "turn", "role", "text"],
                            [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()],
                            lambda r: 60 + 4 * len(r[6] or ""))

    return _dealt(known).mapInArrow(run, "conv_id bigint, part bigint, seq bigint, edit string, turn bigint, role string, text string")


def edits(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Every edit in order: conv_id, part, seq (order within a conversation by part, seq), edit (Keep, Rerole, Delete or Insert by
    initial), turn, role and text after it. The repaired conversations are the rows that are not deleted."""
    table = placed(rows, copies)
    return _edits(table, _states(table), deleted=True)


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    table = placed(rows, copies)
    names = ["conv_id", *(x.split()[0] for x in REPORT.split(", ")), "audit", "repaired_sha256"]
    schema = f"conv_id bigint, {REPORT}, audit string, repaired_sha256 string"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((conv, *_whole(group)) for (conv, _), group in _groups(batches, 2)), names,
                            [pa.int64()] * 7 + [pa.string()] * 2, lambda r: 200 + len(r[7]))

    whole = _dealt(table.where("not cut")).mapInArrow(report, schema)
    states = _states(table)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), group in _groups(batches, 1):
                audit, text = [], Text()
                for _, _, _, edit, role, said in group:
                    audit.append(edit)
                    if edit != "D":
                        text.add(role, said)
                yield conv, "".join(audit), text.hash.hexdigest()
        yield from _batched(rows(), ["conv_id", "audit", "repaired_sha256"], [pa.int64(), pa.string(), pa.string()], lambda r: 200 + len(r[1]))

    parts = stored(_edits(table.where("cut"), states, deleted=False).drop("turn"), "conversations-edits")
    streams = (parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
               .mapInArrow(told, "conv_id bigint, audit string, repaired_sha256 string"))
    # one row a cut conversation, fewer than ranges
    totals = states.where("closing is not null").select("c", *names[1:7])
    reports = totals.join(streams, F.col("conv_id").eqNullSafe(F.col("c"))).select(*names)
    return whole.unionByName(reports)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The conversations with faults put in by the row's key (see the contract of the query), and how often each
    row stands. Nulls count as one space, in the key as well."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(known("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("__stands"))
    return rows, F.col("__stands")
