"""Conversation structure repair by bidirectional Dijkstra over the lattice of edits.

A node of the lattice is a number of rows dealt with and the place in the pattern of roles
``(s?(ua)+)?`` that the output has reached. Edits lead from node to node at a cost. A forward and a
reverse heap meet; all crossings of equal cost are finished, and of the cheapest paths the one whose
concatenated audit (the edits' initials) is least is taken. At one node two audits of equal cost never
begin with each other, so least parts make a least whole; that also lets a conversation of any length
be searched in blocks, between every place at a block's start and at its end, whose tables then join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from hashlib import sha256
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.ranking import numbered_rows
from tideline.session import cut_lineage, sized_side

#: Rows of a conversation that are searched at once; a longer one is searched in blocks.
BLOCK_ROWS = 2_000
#: Bytes of text of a conversation that a task holds at once; a larger one takes the way of the longer ones.
HELD_BYTES = 32 << 20
#: Tables of neighbouring blocks that are joined in one step.
JOINED = 16

# Costs of the edits, what a cut-off row costs besides, characters of faults.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ENDINGS = ".!?"
SPACES = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))

# Places in the pattern: before anything, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
#: The one place that a user or assistant leads to, for rows with a new role and for new rows.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where rows that keep their role lead to, by initial; others lead nowhere.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)

Label = tuple[int, str]
#: Cheapest cost and least audit from each place to each place, None where there is no way.
Table = list[list[Label | None]]


# --- the lattice ---------------------------------------------------------------------------------


def symbol(initial: str, fault: str) -> str:
    """One character for a row: x if it has to go, else its initial (o for others), capital if it is cut off."""
    if fault in ("blank", "duplicate"):
        return "x"
    known = initial if initial in ("s", "u", "a") else "o"
    return known.upper() if fault == "truncated" else known


def _ahead(symbols: str, i: int, place: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits from a node: row, place, cost and initial."""
    yield i, NEXT[place], INSERT, "I"
    if i < len(symbols):
        yield i + 1, place, DELETE, "D"
        s = symbols[i]
        if s != "x":
            more = TRUNCATED * s.isupper()
            yield i + 1, NEXT[place], REROLE + more, "R"
            kept = KEPT[place].get(s.lower())
            if kept is not None:
                yield i + 1, kept, KEEP + more, "K"


def _behind(symbols: str, i: int, place: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits that lead to a node: row, place, cost and initial."""
    for p in PLACES:
        if NEXT[p] == place:
            yield i, p, INSERT, "I"
    if i:
        yield i - 1, place, DELETE, "D"
        s = symbols[i - 1]
        if s != "x":
            more = TRUNCATED * s.isupper()
            for p in PLACES:
                if NEXT[p] == place:
                    yield i - 1, p, REROLE + more, "R"
                if KEPT[p].get(s.lower()) == place:
                    yield i - 1, p, KEEP + more, "K"


class _Side:
    """One of the two searches. Of equal costs the node nearer to its source is settled first.

    An edit without cost always moves one row on, so when a node is settled all edits that could give
    it a smaller audit at its cost have been seen.
    """

    def __init__(self, sources: Iterable[tuple[int, int]], forward: bool):
        self.forward = forward
        self.labels: dict[tuple[int, int], Label] = {node: (0, "") for node in sources}
        self.settled: set[tuple[int, int]] = set()
        self.heap = [(0, i if forward else -i, place) for i, place in self.labels]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap:
            cost, i, place = self.heap[0]
            node = (abs(i), place)
            if node in self.settled or cost > self.labels[node][0]:
                heapq.heappop(self.heap)
            else:
                return cost
        return float("inf")

    def settle(self, symbols: str) -> Iterator[tuple[tuple[int, int], int]]:
        """Settle the top node; its edits' other ends, with the cost through the edit."""
        _, i, place = heapq.heappop(self.heap)
        node = (abs(i), place)
        self.settled.add(node)
        cost, audit = self.labels[node]
        for row, other, price, letter in (_ahead if self.forward else _behind)(symbols, *node):
            end = (row, other)
            yield end, cost + price
            if end in self.settled:
                continue
            label = (cost + price, audit + letter if self.forward else letter + audit)
            known = self.labels.get(end)
            if known is None or label < known:
                self.labels[end] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(self.heap, (label[0], row if self.forward else -row, other))


def search(symbols: str, start: int, ends: Sequence[int]) -> Label | None:
    """Cost and least audit of the cheapest edits from a place before all rows to one of ``ends`` after them."""
    n = len(symbols)
    there, back = _Side([(0, start)], True), _Side([(n, e) for e in ends], False)
    best = min((0 for node in there.labels if node in back.labels), default=float("inf"))
    while True:
        a, b = there.top(), back.top()
        # Beyond the sum, an equally cheap path would have an edit whose ends are both settled.
        if a + b > best or (a == b == float("inf")):
            break
        side, other = (there, back) if a <= b else (back, there)
        for end, cost in side.settle(symbols):
            if end in other.labels:
                best = min(best, cost + other.labels[end][0])
    audits = []
    known = back.settled | {(n, e) for e in ends}
    for node in there.settled:
        cost, audit = there.labels[node]
        if node in known and cost + back.labels[node][0] == best:
            audits.append(audit + back.labels[node][1])
        for row, place, price, letter in _ahead(symbols, *node):
            if (row, place) in known and cost + price + back.labels[row, place][0] == best:
                audits.append(audit + letter + back.labels[row, place][1])
    return (int(best), min(audits)) if audits else None


@lru_cache(100_000)
def _short_repair(symbols: str) -> Label:
    return search(symbols, START, ENDS)


def repair(symbols: str) -> Label:
    """Cost and audit of a whole conversation."""
    return _short_repair(symbols) if len(symbols) <= 64 else search(symbols, START, ENDS)


def block_table(symbols: str) -> Table:
    return [[search(symbols, p, (q,)) for q in PLACES] for p in PLACES]


def joined_tables(first: Table, second: Table) -> Table:
    """The table of two neighbouring blocks."""

    def through(p: int, r: int) -> Label | None:
        ways = [(first[p][q], second[q][r]) for q in PLACES]
        found = [(a[0] + b[0], a[1] + b[1]) for a, b in ways if a and b]
        return min(found, default=None)

    return [[through(p, r) for r in PLACES] for p in PLACES]


def edited(audit: str) -> Iterator[tuple[int | None, str | None]]:
    """The output's rows in order: the number of the row they come from (None: new), and the new role (None: its own).

    An output of odd length starts with a kept system row, so the audit alone says every new role.
    """
    out = sum(c != "D" for c in audit) % 2
    row = 0
    for c in audit:
        if c != "D":
            yield (None if c == "I" else row), (None if c == "K" else ROLES["ua"[out % 2]])
            out += 1
        row += c != "I"


# --- faults --------------------------------------------------------------------------------------


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none (empty)."""
    ending = text.rstrip(SPACES)
    if not ending:
        return "blank"
    if seen:
        return "duplicate"
    return "" if ending[-1] in ENDINGS else "truncated"


def illegal_pairs(initials: Iterable[str]) -> int:
    """Neighbours whose initials do not follow each other."""
    held = list(initials)
    return sum(a + b not in LEGAL for a, b in zip(held, held[1:]))


# --- rows ----------------------------------------------------------------------------------------


def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after reproducible damage, by the checksum of conversation and turn.

    Nulls become one space, also in the checksum's text. ``present`` is false for rows that are lost;
    they stay so that every conversation is still named. A repeated row stands twice with one turn.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a key that is never null; rows without ``present`` and ``copy`` are all there, once."""
    more = {"present": F.lit(True), "copy": F.lit(0)}
    return rows.select(
        F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        *[F.col(c) if c in rows.columns else value.alias(c) for c, value in more.items()],
    )


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of conversations that a task can hold; if there are others, their rows and their keys."""
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), size.alias("bytes"), F.first("conv_id").alias("conv_id"))
    long = cut_lineage(sizes.where((F.col("rows") > BLOCK_ROWS) | (F.col("bytes") > HELD_BYTES)).select("key", "conv_id"))
    if long.isEmpty():
        return rows, None, None
    names = sized_side(long.select("key"))
    held = cut_lineage(rows.join(names, "key", "semi").where("present"))
    return rows.join(names, "key", "anti"), held, long


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and id of each conversation, with its present rows, one conversation at a time."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "present", "turn", "role", "text")))
    )
    for key, group in groupby(rows, lambda r: r[:2]):
        yield key, [r[3:] for r in group if r[2]]


def _together(rows: DataFrame) -> DataFrame:
    """Conversations whole in one partition each, rows in order."""
    return rows.repartition("key").sortWithinPartitions("key", *_order())


def _faults(rows: list[tuple]) -> list[str]:
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    return faults


def _gaps(turns: Iterable[int | None]) -> int:
    held = {t for t in turns if t is not None}
    return max(held) - min(held) + 1 - len(held) if held else 0


def _messages(rows: list[tuple], audit: str) -> list[tuple[str, str]]:
    """Role and text of the repaired rows."""
    return [
        (role if role is not None else rows[row][1], "" if row is None else rows[row][2]) for row, role in edited(audit)
    ]


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_NO_TEXT = sha256(b"").hexdigest()


def _report_schema(conv_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("conv_id", conv_id),
            *[T.StructField(c, T.LongType()) for c in _NUMBERS],
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
        ]
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- long conversations --------------------------------------------------------------------------


def _streamed(df: DataFrame, group: list[str], order: str, fold, schema: str) -> DataFrame:
    """``fold`` on the rows of every group in order; a task holds one row of a group at a time."""
    columns = df.columns
    width = len(group)
    arrow = _arrow(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        yield from _batched((fold(key, held) for key, held in groupby(rows, lambda r: r[:width])), arrow)

    return df.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, schema)


_TABLE = (
    "key string, block bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, costs array<bigint>, audits array<string>"
)


def _as_table(costs: list, audits: list) -> Table:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [cells[4 * p : 4 * p + 4] for p in PLACES]


def _as_lists(table: Table) -> tuple[list, list]:
    cells = [cell or (None, None) for row in table for cell in row]
    return [c for c, _ in cells], [a for _, a in cells]


def _long_edits(numbered: DataFrame) -> DataFrame:
    """Per key the counts of faults, cost and audit, from blocks that are searched in parallel."""
    firsts = numbered.groupBy("key", "role", F.sha2("text", 256).alias("_d")).agg(F.min("pos").alias("pos"))
    ending = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = numbered.join(firsts.select("key", "pos", F.lit(True).alias("_first")), ["key", "pos"], "left").select(
        "key",
        "pos",
        F.floor((F.col("pos") - 1) / BLOCK_ROWS).alias("block"),
        F.when(F.col("role") == "", "-").otherwise(F.substring("role", 1, 1)).alias("initial"),
        F.when(ending == "", "blank")
        .when(F.col("_first").isNull(), "duplicate")
        .when(~F.right(ending, F.lit(1)).isin(*ENDINGS), "truncated")
        .otherwise("")
        .alias("fault"),
    )

    def counted(fault: str):
        return F.sum((F.col("fault") == fault).cast("bigint")).alias(fault)

    blocks = marks.groupBy("key", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("rows"),
        *[counted(f) for f in ("blank", "duplicate", "truncated")],
    )
    arrow = _arrow(numbered.sparkSession.createDataFrame([], _TABLE).schema)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                initials = [x["initial"] for x in r["rows"]]
                table = block_table("".join(symbol(x["initial"], x["fault"]) for x in r["rows"]))
                counts = (r["blank"], r["duplicate"], r["truncated"], illegal_pairs(initials))
                out.append((r["key"], r["block"], initials[0], initials[-1], *counts, *_as_lists(table)))
            yield from _batched(iter(out), arrow, 16)

    held = cut_lineage(blocks.mapInArrow(tables, _TABLE))

    def fold(key: tuple, rows: Iterator[tuple]) -> tuple:
        def join(a: tuple, b: tuple) -> tuple:
            counts = [x + y for x, y in zip(a[4], b[4])]
            counts[3] += a[3] + b[2] not in LEGAL
            return a[0], a[1], a[2], b[3], counts, joined_tables(a[5], b[5])

        parts = ((r[0], r[1], r[3], r[4], list(r[5:9]), _as_table(r[9], r[10])) for r in rows)
        name, up, first, last, counts, table = reduce(join, parts)
        return name, up, first, last, *counts, *_as_lists(table)

    most = held.agg(F.max("block")).first()[0] or 0
    while most:
        up = held.select("key", F.floor(F.col("block") / JOINED).alias("up"), *held.columns[1:])
        held = cut_lineage(_streamed(up, ["key", "up"], "block", fold, _TABLE))
        most //= JOINED
    # From the start to a place where the pattern may end.
    ways = F.array(*[F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit")) for q in ENDS])
    ends = F.array_min(F.filter(ways, lambda w: w["cost"].isNotNull()))
    return held.select("key", "blank", "duplicate", "truncated", "illegal", ends["cost"].alias("cost"), ends["audit"].alias("audit"))


def _long_messages(numbered: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired rows of long conversations: key, place, role, text."""
    schema = "key string, place bigint, pos bigint, new_role string"
    arrow = _arrow(edits.sparkSession.createDataFrame([], schema).schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, audit in zip(batch.column("key").to_pylist(), batch.column("audit").to_pylist()):
                lines = (
                    (key, place, None if row is None else row + 1, role) for place, (row, role) in enumerate(edited(audit))
                )
                yield from _batched(lines, arrow, 10_000)

    lines = edits.select("key", "audit").mapInArrow(spread, schema)
    return lines.join(numbered.select("key", "pos", "role", "text"), ["key", "pos"], "left").select(
        "key", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def _numbered(held: DataFrame) -> DataFrame:
    return cut_lineage(numbered_rows(held.select("key", "turn", "role", "text", "copy"), ["key"], _order(), "pos"))


def _long_report(held: DataFrame, long: DataFrame) -> DataFrame:
    numbered = _numbered(held)
    edits = cut_lineage(_long_edits(numbered))

    def digest(key: tuple, rows: Iterator[tuple]) -> tuple:
        state = sha256()
        for _, place, role, text in rows:
            state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        return *key, state.hexdigest()

    digests = _streamed(_long_messages(numbered, edits), ["key"], "place", digest, "key string, repaired_sha256 string")
    turns = held.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
    )
    joined = long.join(turns, "key", "left").join(edits, "key", "left").join(digests, "key", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in _NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_NO_TEXT)).alias("repaired_sha256"),
    )


# --- the operator --------------------------------------------------------------------------------


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults of every conversation, the cheapest edits that repair it and a digest of the result.

    Rows (``conv_id``, ``turn``, ``role``, ``text``) stand in the order of turns, null turns first;
    rows with one turn by role and text. Null roles and texts are one space, so null texts are blank
    and null roles no role; a null id is a conversation of its own. Rows with a false ``present`` only
    name their conversation; one without rows has zeros, an empty audit and the digest of nothing.
    Repeated rows are duplicates. Other columns are not looked at. Conversations of more than
    ``BLOCK_ROWS`` rows or ``HELD_BYTES`` are searched in blocks, with the same result.
    """
    keyed = _keyed(rows)
    short, held, long = _split(keyed)
    schema = _report_schema(keyed.schema["conv_id"].dataType)
    arrow = _arrow(schema)

    def report(key: tuple, rows: list[tuple]) -> tuple:
        faults = _faults(rows)
        initials = [role[:1] for _, role, _ in rows]
        cost, audit = repair("".join(map(symbol, initials, faults)))
        text = "\n".join(f"{role}:{text}" for role, text in _messages(rows, audit))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = _gaps(turn for turn, _, _ in rows)
        return key[1], gaps, *counts, illegal_pairs(initials), cost, audit, sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((report(*c) for c in _conversations(batches)), arrow)

    found = _together(short).mapInArrow(run, schema)
    return found if held is None else found.unionByName(_long_report(held, long))


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` from 0, ``role`` and ``text``. See ``repair_report``."""
    keyed = _keyed(rows)
    short, held, long = _split(keyed)
    schema = T.StructType(
        [
            T.StructField("conv_id", keyed.schema["conv_id"].dataType),
            T.StructField("place", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    arrow = _arrow(schema)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in _conversations(batches):
            _, audit = repair("".join(map(symbol, [role[:1] for _, role, _ in rows], _faults(rows))))
            for place, message in enumerate(_messages(rows, audit)):
                yield key[1], place, *message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(messages(batches), arrow)

    found = _together(short).mapInArrow(run, schema)
    if held is None:
        return found
    numbered = _numbered(held)
    whole = _long_messages(numbered, _long_edits(numbered)).join(long, "key")
    return found.unionByName(whole.select("conv_id", "place", "role", "text"))
