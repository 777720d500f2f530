"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's edits are a shortest path in a lattice of integer costs whose
nodes are (rows dealt with, what the last role left means).  The auction
algorithm (Bertsekas, 1991) keeps a price for every node and a path from the
origin: the path's end is extended along an arc whose cost its price matches, or
its price is raised to the least cost plus price and the path contracts.  Prices
start at what every row must cost at least.  When the path arrives, they are an
optimal dual solution, so the cheapest edits are exactly the paths of tight
arcs; the least of them by ASCII is traced depth first, in label order.

Rows are sorted by range, so a conversation of any length is spread over tasks.
One of up to WINDOW rows is solved in one piece.  A longer one is cut into
blocks, solved apart for every pair of states at their ends; their costs then
stream once backward and once forward through its task, which holds four numbers.
Texts are only ever streamed: the repaired text's hash needs them in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tables import cut

#: What does not count as a character of a text; what a whole text ends with.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of the edits, and of leaving a truncated row.
DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
#: log2 of the rows that are gathered at most; rows of a block.
WINDOW_BITS, BLOCK = 10, 64
#: Characters of role and text that decide the order of rows of one turn before their digest does.
LEADING = 64

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Begun; after the system's turn; after the user's; after the assistant's.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGUN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": {BEGUN: SYSTEM}, "u": {BEGUN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Cheapest inserts that end a conversation in each state.
ENDING = {BEGUN: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END_COST = [INSERT * len(ENDING[s]) for s in range(4)]
INFINITE = float("inf")


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state, the arcs (label, cost, difference of node numbers) of a row, by label."""
    left, late = fault not in (BLANK, DUPLICATE), CUT_SHORT * (fault == TRUNCATED)
    out = []
    for state in range(4):
        arcs = [("D", DELETE, 4), ("I", INSERT, NEXT[state] - state)]
        if left and state in KEEP.get(initial, {}):
            arcs.append(("K", late, 4 + KEEP[initial][state] - state))
        if left:
            arcs.append(("R", REROLE + late, 4 + NEXT[state] - state))
        out.append(arcs)
    return out


ARCS = {(initial, fault): _arcs(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}
#: Behind the last row: inserts, then the goal, the first node of the next four.
LAST = [[("", 0, 4)], [("I", INSERT, 1)], [("I", INSERT, 1)], [("", 0, 1)]]
Row = tuple[str, int]


def auction(steps: list, prices: list[float], origin: int, goal: int) -> int:
    """Raises ``prices`` until the path from ``origin`` arrives at ``goal``; the cost of the shortest one. There must be one."""
    path = [origin]
    while (node := path[-1]) != goal:
        least, to = INFINITE, -1
        for _, cost, by in steps[node >> 2][node & 3]:
            if cost + prices[node + by] < least:
                least, to = cost + prices[node + by], node + by
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return int(prices[origin] - prices[goal])


def trace(steps: list, prices: list[float], origin: int, goal: int) -> str:
    """Labels of the least path of tight arcs, depth first; a node that leads nowhere is left once."""
    path, dead = [(origin, 0, "")], set()
    while path[-1][0] != goal:
        node, k, label = path.pop()
        arcs = steps[node >> 2][node & 3]
        while k < len(arcs) and (node + arcs[k][2] in dead or arcs[k][1] + prices[node + arcs[k][2]] != prices[node]):
            k += 1
        if k == len(arcs):
            dead.add(node)
        else:
            path += [(node, k + 1, label), (node + arcs[k][2], 0, arcs[k][0])]
    return "".join(label for _, _, label in path)


def _floor(rows: list[Row]) -> list[float]:
    """For every node, what the rows behind it cost at least."""
    out = [0.0] * (4 * len(rows) + 4)
    for i in range(len(rows) - 1, -1, -1):
        out[4 * i : 4 * i + 4] = [out[4 * i + 4] + (DELETE if rows[i][1] else 0)] * 4
    return out


def solve_whole(rows: list[Row]) -> tuple[int, str]:
    """Cost and labels of the cheapest edits of rows (initial, fault), by one auction."""
    steps = [ARCS[r] for r in rows] + [LAST]
    prices = [*_floor(rows), 0.0]
    goal = 4 * len(rows) + 4
    return auction(steps, prices, BEGUN, goal), trace(steps, prices, BEGUN, goal)


def solve_block(rows: list[Row]) -> list[list[tuple[int, str] | None]]:
    """Cost and labels from each state before the rows to each state after them; None where there is no way.

    Inserts before a row belong to its block, those behind the last row to the
    next block, so no two ways from a state are such that one begins the other.
    """
    steps = [ARCS[r] for r in rows] + [[[], [], [], []]]
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for after in range(4):
        prices = _floor(rows)
        open_ = False
        for i in range(len(rows), -1, -1):
            open_ |= i < len(rows) and rows[i][0] == "s" and rows[i][1] in (FINE, TRUNCATED)
            for state in range(4):
                ways = state == after or after == SYSTEM and state == BEGUN and open_ or after in (USER, ASSISTANT)
                if not ways or i == len(rows) and state != after:
                    prices[4 * i + state] = INFINITE
        goal = 4 * len(rows) + after
        costs = {before: auction(steps, prices, before, goal) for before in range(4) if prices[before] < INFINITE}
        for before, cost in costs.items():
            out[before][after] = cost, trace(steps, prices, before, goal)
    return out


def backward(block: list, togo: list[float]) -> list[float]:
    """Cost to the end from each state before a block, given those after it."""
    return [min((way[0] + togo[after] for after, way in enumerate(ways) if way), default=INFINITE) for ways in block]


def forward(block: list, state: int, togo: list[float]) -> tuple[int, int, str]:
    """The state after a block on the cheapest way, its cost in the block, and its labels, the least of such."""
    ways = [(way[0] + togo[after], way[1], after, way[0]) for after, way in enumerate(block[state]) if way]
    _, labels, after, cost = min(ways)
    return after, cost, labels


def solve(rows: list[Row]) -> tuple[int, str]:
    """As ``solve_whole``; rows beyond a block are solved in blocks, in time linear in their number."""
    if len(rows) <= BLOCK:
        return solve_whole(rows)
    blocks = [solve_block(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
    togo = [[float(c) for c in END_COST]]
    for block in blocks[::-1]:
        togo.append(backward(block, togo[-1]))
    state, total, out = BEGUN, 0, []
    for block, after in zip(blocks, togo[-2::-1], strict=True):
        state, cost, labels = forward(block, state, after)
        total += cost
        out.append(labels)
    return total + END_COST[state], "".join(out) + ENDING[state]


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) with faults put in by ``crc32(conv_id:turn) % 20``; nulls of role and text, and in that key, are one space.

    0 loses the row (it stays as a row that is ``lost``), 1 empties the text, 2
    removes its stops, 3 repeats the row, 4 makes the role ``user``.
    """
    name = F.concat(*(x for c, sep in (("conv_id", ":"), ("turn", "")) for x in (F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")), F.lit(sep))))
    kind = F.crc32(name) % 20
    text = F.coalesce("text", F.lit(" "))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("lost"), F.explode(copies).alias("_copy"))
        .drop("_copy")
    )


def _placed(turns: DataFrame) -> DataFrame:
    """The rows with their order ``pos``, written once; a row's ``same`` tells its conversation, role and text."""
    spark = turns.sparkSession
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        lost.alias("lost"),
    )
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = rows.withColumns({"same": F.unhex(F.sha2(told, 256)), "last": last, "source": F.monotonically_increasing_id()})
    order: list[Column] = [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(LEADING)), F.left("text", F.lit(LEADING)), F.col("same"), F.col("source")]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return cut(sorted_.drop("source").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, initial, fault) of the turns that are there."""
    there = rows.where("not lost")
    first = there.groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("last") == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~F.contains(F.lit(STOPS), F.col("last")), TRUNCATED).otherwise(FINE)
    known = F.when(initial.isin(*KEEP), initial).otherwise("")
    return there.join(first, "same", "left").select("conv_id", "pos", known.alias("initial"), fault.alias("fault"))


_PIECE = "conv_id long, pos long, piece string, blank long, duplicate long, truncated long, cost long"
_BLOCK = "conv_id long, pos long, costs array<int>, labels array<string>, blank long, duplicate long, truncated long"


def _counted(rows: list[Row]) -> tuple[int, int, int]:
    faults = [f for _, f in rows]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_NUMBERS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
_PIECE_ARROW = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("piece", pa.string()), *_NUMBERS, ("cost", pa.int64())])
_BLOCK_ARROW = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("costs", pa.list_(pa.int32())), ("labels", pa.list_(pa.string())), *_NUMBERS])
_TOGO_ARROW = pa.schema([*_BLOCK_ARROW, ("togo", pa.list_(pa.float64())), ("last", pa.bool_())])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv_id"], row["rows"][0]["pos"], [(r["initial"], r["fault"]) for r in row["rows"]], [r["pos"] for r in row["rows"]]


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved():
        for conv, pos, rows, _ in _runs(batches):
            cost, labels = solve(rows)
            yield conv, pos, labels, *_counted(rows), cost

    yield from _batches(solved(), _PIECE_ARROW)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved():
        for conv, _, rows, places in _runs(batches):
            for i in range(0, len(rows), BLOCK):
                part = rows[i : i + BLOCK]
                ways = [way for ways in solve_block(part) for way in ways]
                yield conv, places[i], [w[0] if w else -1 for w in ways], [w[1] if w else "" for w in ways], *_counted(part)

    yield from _batches(solved(), _BLOCK_ARROW)


def _ways(row: dict) -> list:
    flat = [(c, s) if c >= 0 else None for c, s in zip(row["costs"], row["labels"], strict=True)]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _togo(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from each conversation's last to its first, with the cost to the end behind each."""

    def told():
        conv, togo = object(), []
        for batch in batches:
            for row in batch.to_pylist():
                last = row["conv_id"] != conv
                if last:
                    conv, togo = row["conv_id"], [float(c) for c in END_COST]
                yield *row.values(), togo, last
                togo = backward(_ways(row), togo)

    yield from _batches(told(), _TOGO_ARROW, 100)


def _chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's labels, from the first to the last."""

    def pieces():
        conv, state = object(), BEGUN
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state = row["conv_id"], BEGUN
                state, cost, labels = forward(_ways(row), state, row["togo"])
                if row["last"]:
                    cost, labels = cost + END_COST[state], labels + ENDING[state]
                yield conv, row["pos"], labels, row["blank"], row["duplicate"], row["truncated"], cost

    yield from _batches(pieces(), _PIECE_ARROW)


def _edits(rows: DataFrame) -> DataFrame:
    """Labels of all edits in pieces, each at the ``pos`` of its first row."""
    turn = F.struct("pos", "initial", "fault")
    windows = cut(_faults(rows).groupBy("conv_id", F.shiftright("pos", WINDOW_BITS).alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("rows")), "windows")
    long_ = windows.groupBy(F.col("conv_id").alias("long_id")).count().where("count > 1").select("long_id", F.lit(True).alias("long"))
    marked = windows.join(long_, F.col("conv_id").eqNullSafe(F.col("long_id")), "left").select("conv_id", "rows", "long")
    whole = marked.where("long is null").select("conv_id", "rows").mapInArrow(_whole, _PIECE)
    blocks = marked.where("long").select("conv_id", "rows").mapInArrow(_blocks, _BLOCK)
    togo = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos")).mapInArrow(_togo, f"{_BLOCK}, togo array<double>, last boolean")
    return whole.union(togo.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chosen, _PIECE))


def _ordered(turns: DataFrame) -> DataFrame:
    """Pieces of edits and rows, by conversation and place; a piece stands before its first row."""
    rows = _placed(turns)
    pieces = _edits(rows).select("conv_id", "pos", F.lit(0).alias("kind"), "piece", "blank", "duplicate", "truncated", "cost")
    both = pieces.unionByName(rows.select("conv_id", "pos", F.lit(1).alias("kind"), "turn", "role", "text", "lost"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, dict | None, list[tuple]]]:
    """(conversation, whether it begins, row, what comes out there); a row of None ends the conversation and brings the inserts behind its last row."""
    conv: object = None
    begun, first = False, True
    state, labels = BEGUN, deque()

    def insert() -> tuple:
        nonlocal state
        state = NEXT[state]
        return "I", ROLE[state], "", None

    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != conv:
                if begun:
                    yield conv, False, None, [insert() for _ in labels]
                conv, begun, first, state = row["conv_id"], True, True, BEGUN
                labels.clear()
            out = []
            if not row["kind"]:
                labels.extend(row["piece"])
            elif not row["lost"]:
                while (label := labels.popleft()) == "I":
                    out.append(insert())
                if label == "K":
                    state = KEEP[row["role"][:1]][state]
                    out.append((label, row["role"], row["text"], row["turn"]))
                elif label == "R":
                    state = NEXT[state]
                    out.append((label, ROLE[state], row["text"], row["turn"]))
            yield conv, first, row, out
            first = False
    if begun:
        yield conv, False, None, [insert() for _ in labels]


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _reported(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def reports():
        for conv, first, row, out in _walk(batches):
            if first:
                counts, audit, text, illegal = [0, 0, 0, 0], [], hashlib.sha256(), 0
                before = low = high = turn = None
                turns = written = 0
            for _, role, said, _ in out:
                text.update(f"{chr(10) if written else ''}{role}:{said}".encode())
                written += 1
            if row is None:
                gaps = high - low + 1 - turns if turns else 0
                yield conv, gaps, *counts[:3], illegal, counts[3], "".join(audit), text.hexdigest()
            elif not row["kind"]:
                audit.append(row["piece"])
                counts = [a + row[c] for a, c in zip(counts, ("blank", "duplicate", "truncated", "cost"), strict=True)]
            elif not row["lost"]:
                illegal += before is not None and before + row["role"][:1] not in ("su", "ua", "au")
                before = row["role"][:1]
                if row["turn"] is not None:
                    low, turns, turn, high = (row["turn"] if low is None else low), turns + (row["turn"] != turn), row["turn"], row["turn"]

    yield from _batches(reports(), _REPORT_ARROW)


def repair_report(turns: DataFrame) -> DataFrame:
    """One row (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) a conversation.

    ``turns`` has conv_id, turn, role, text, and may have ``lost``: such a row
    only says that its conversation is to be reported.  A null ``conv_id`` is a
    conversation of its own; a null ``turn`` comes first; null roles and texts
    are one space.  Rows of one turn follow each other by the first 64
    characters of role, then of text, then by a digest; rows that repeat a row
    are duplicates.  A role of another initial than s, u or a, or an empty one,
    fits no place and has to be changed or deleted.  Roles and texts are the
    same if a SHA-256 of both is.  A conversation whose rows are all lost has
    zeros, an empty audit and the hash of the empty string; an empty table gives
    no row.  Other columns are ignored.
    """
    return _ordered(turns).mapInArrow(_reported, _REPORT)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, place from 0, role, text, edit, turn); inserted ones have no turn and an empty text. Input as for ``repair_report``."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("turn", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            place = 0
            for conv, first, _, out in _walk(batches):
                place = 0 if first else place
                for edit, role, text, turn in out:
                    yield conv, place, role, text, edit, turn
                    place += 1

        yield from _batches(rows(), schema, 200)

    return _ordered(turns).mapInArrow(run, "conv_id long, place long, role string, text string, edit string, turn long")
