"""Conversations brought back to the role order `(s?(ua)+)?` by the cheapest edits, found by iterative-deepening A*.

A row becomes one letter: the initial of its role (s, u, a, x for any other), upper case if the row is truncated, `-` if it has
to go. `search` looks through the edits of such letters depth first, in the ASCII order of their initials (D, I, K, R), under a
cost bound that rises to the least estimate that went beyond it; a table of states remembers with how much cost left each has
failed. So the first accepting path is the cheapest one and, of equally cheap ones, the ASCII-least. The estimate counts what no
edit avoids: 3 for a row that must go, 1 for a truncated one, 1 for each pair of neighbours that may not stand together (an
edit costs 2 or more and mends two pairs at most).

Longer conversations are cut into blocks of `BLOCK` rows. The search gives each block's cost from every role state to every
other; summed from the end these give the exact price of leaving a block in a state, and with those prices as its goal the
same search finds the block's part of the path. A conversation of more than `long_rows` rows or `long_chars` characters
is never gathered: its rows are sorted over many tasks, its blocks are searched as rows of a table, and only their prices and at
last its texts (for a digest of the whole that has to see them one after the other) stream past in order.

Defined cases: a null role or text is one space, and so is a null conv_id or turn in the damage rule; rows without conv_id are
one conversation; rows of one turn stand by role, by the first 40 characters of their text and by its SHA-256, those without
turn first; repeated rows are duplicates; a role is judged by its first character, an empty one fits nowhere; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, cut

#: Rows that one search looks through; a power of two.
BLOCK = 16
NEVER = 1 << 40
#: Role states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The state that the expected role leads to:
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
END = (0, NEVER, NEVER, 0)
MUST_GO = "-"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def step(state: int, letter: str) -> int | None:
    """The state after a row that is kept; None where it may not stand."""
    if letter == "s":
        return 1 if state == 0 else None
    after = {"u": 2, "a": 3}.get(letter)
    return after if after == NEXT[state] else None


@lru_cache(1 << 16)
def search(rows: str, entry: int, prices: tuple[int, int, int, int], tail: bool) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the cheapest edits from a state; prices: what ending in each state costs on top.

    tail: no row follows, so that rows may be inserted at the end too."""
    n = len(rows)
    estimate = _estimates(rows, prices)
    bound, failed, path = estimate[0][entry], {}, []
    if bound >= NEVER:
        return NEVER, "", entry
    found_state = beyond = 0

    def deeper(i: int, state: int, spent: int) -> bool:
        nonlocal beyond, found_state
        least = spent + max(estimate[i][state], failed.get((i, state), -1) + 1)
        if least > bound:
            beyond = min(beyond, least)
            return False
        if i == n:
            if spent + prices[state] <= bound:
                found_state = state
                return True
            beyond = min(beyond, spent + prices[state])
        moves = []
        if i < n:
            moves.append(("D", i + 1, state, 3))
        if i < n or tail:
            moves.append(("I", i, NEXT[state], 2))
        if i < n and rows[i] != MUST_GO:
            late = int(rows[i].isupper())
            kept = step(state, rows[i].lower())
            moves.append(("R", i + 1, NEXT[state], 2 + late) if kept is None else ("K", i + 1, kept, late))
        for letter, j, after, cost in moves:
            path.append(letter)
            if deeper(j, after, spent + cost):
                return True
            path.pop()
        failed[i, state] = bound - spent
        return False

    while True:
        beyond = NEVER
        if deeper(0, entry, 0):
            return bound, "".join(path), found_state
        bound = beyond


def _estimates(rows: str, prices: tuple[int, ...]) -> list[list[int]]:
    """By row and state: a cost that no edits of the rest stay below."""
    ends = [min(p + (q != state) for q, p in enumerate(prices)) for state in range(4)]
    out, forced = [ends], 0
    for c in reversed(rows):
        before = out[-1]
        if c == MUST_GO:
            now = [x + 3 for x in before]
        else:
            letter = c.lower()
            after = {"s": 1, "u": 2, "a": 3}.get(letter)
            forced = int(c.isupper())
            if after is None:  # fits nowhere: the pairs on both of its sides
                now = [forced + 1 + min(before)] * 4
            else:
                now = [forced + (step(state, letter) is None) + before[after] for state in range(4)]
        out.append(now)
    return out[::-1]


def reachable(rows: str, entry: int, leave: int) -> bool:
    return leave > 1 or leave == entry or (entry == 0 and leave == 1 and "s" in rows.lower())


def block_costs(rows: str) -> list[int]:
    """The cheapest costs of a block that others follow, from each state (four at a time) to each."""
    goal = lambda leave: tuple(0 if q == leave else NEVER for q in range(4))
    return [search(rows, a, goal(b), False)[0] if reachable(rows, a, b) else NEVER for a in range(4) for b in range(4)]


def prices_before(costs: list[int], prices: tuple[int, ...]) -> tuple[int, ...]:
    """What entering a block in each state costs, given the prices of leaving it."""
    return tuple(min(NEVER, min(costs[4 * a + b] + prices[b] for b in range(4))) for a in range(4))


def priced_search(rows: str, entry: int, prices: tuple[int, ...], tail: bool) -> tuple[int, str, int]:
    """search() with prices brought down to their least, so that alike blocks are searched once; the block's own cost."""
    least = min(prices)
    cost, audit, leave = search(rows, entry, tuple(min(NEVER, p - least) for p in prices), tail)
    return cost - (prices[leave] - least), audit, leave


def repair(rows: str) -> tuple[int, str]:
    """(cost, audit) of a conversation that fits a task."""
    blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)] or [""]
    prices = [END]
    for b in reversed(blocks[1:]):
        # the last block may insert at its end: its prices come from searches with that freedom
        prices.append(tuple(min(NEVER, search(b, q, END, True)[0]) for q in range(4)) if len(prices) == 1 else prices_before(block_costs(b), prices[-1]))
    total, audit, state = 0, [], 0
    for k, b in enumerate(blocks):
        cost, part, state = priced_search(b, state, prices[len(blocks) - 1 - k], k == len(blocks) - 1)
        total += cost
        audit.append(part)
    return total, "".join(audit)


class Digest:
    """What is counted and hashed while the rows of one conversation pass in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.state = 0
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]

    def out(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def edits(self, audit: str, rows: Iterable[tuple[str, str]]) -> None:
        """Write the repaired rows; rows: role and text, one for each edit that isn't an insertion."""
        rows = iter(rows)
        for e in audit:
            if e == "I":
                self.state = NEXT[self.state]
                self.out(ROLE[self.state], "")
                continue
            role, text = next(rows)
            if e == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                self.out(role, text)
            elif e == "R":
                self.state = NEXT[self.state]
                self.out(ROLE[self.state], text)
        self.audit.append(audit)

    def result(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def fault_of(text: str, seen: bool) -> str:
    bare = text.strip(BLANKS)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""


def letter_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return MUST_GO
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return c.upper() if fault == "truncated" else c


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)


def _batches(results: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for r in results:
        some.append(r)
        if len(some) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and copies: how often the row stands there, 0 for a dropped one (which keeps no text)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("_d")
    )
    return d.select(
        "conv_id",
        F.when(F.col("_d") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("_d") == 0, "").when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") <= 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).alias("copies"),
    )


def _order() -> list[Column]:
    """The order of a conversation's rows, by keys of bounded size."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 40), F.sha2(F.col("text").cast("binary"), 256)]


def repair_conversations(conversations: DataFrame, long_rows: int = 256, long_chars: int = 1 << 23, damage: bool = True) -> DataFrame:
    """One row for every conv_id, as RESULT has it. damage=False takes the rows as they are."""
    d = damaged(conversations) if damage else conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))
    sizes = d.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    long = cut(sizes.filter((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("_long")))
    if long.isEmpty():
        return _short(d)
    met = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _short(d.join(long, met, "left_anti")).unionByName(_long(d.join(long, met, "left_semi")))


def _short(d: DataFrame) -> DataFrame:
    schema = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(map(one, groupby(_rows(batches), lambda r: r[0])), schema)

    def one(group: tuple) -> tuple:
        conv_id, found = group
        out, seen, rows, letters = Digest(), set(), [], []
        for _, turn, role, text, copies in found:
            for _ in range(copies):
                fault = fault_of(text, (role, text) in seen)
                seen.add((role, text))
                out.row(turn, role, fault)
                rows.append((role, text))
                letters.append(letter_of(role, fault))
        out.cost, audit = repair("".join(letters))
        out.edits(audit, rows)
        return out.result(conv_id)

    return d.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(run, RESULT)


def _long(d: DataFrame) -> DataFrame:
    """The same for conversations that no task gathers."""
    bits = BLOCK.bit_length() - 1
    # dropped rows only say that their conversation is there
    keys = [F.col("conv_id"), *_order()]
    rows = d.withColumn("_c", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, F.col("_m")).sortWithinPartitions(*keys, F.col("_m"))
    rows = cut(rows.select("conv_id", "turn", "role", "text", "copies", F.monotonically_increasing_id().alias("pos")))
    bare = F.btrim("text", F.lit(BLANKS))
    marks = rows.filter("copies > 0").select(
        "conv_id", "pos", F.substring("role", 1, 1).alias("c"), (bare == "").alias("blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("whole"), F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"), 256).alias("h")
    )
    marks = cut(marks.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    first = cut(marks.filter("not blank").groupBy("conv", "h").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    marks = marks.join(first, ["conv", "h"], "left").withColumn("seen", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) & ~F.col("blank"))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(~F.col("whole"), "truncated").otherwise("")
    c = F.when(F.col("c").isin("s", "u", "a"), F.col("c")).otherwise("x")
    letter = F.when(F.col("blank") | F.col("seen"), MUST_GO).when(~F.col("whole"), F.upper(c)).otherwise(c)
    marks = marks.select("conv_id", "pos", F.shiftright("pos", bits).alias("block"), fault.alias("fault"), letter.alias("letter"))
    blocks = marks.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "letter", "fault"))).alias("r"))
    blocks = cut(blocks.select("conv_id", "block", F.array_join("r.letter", "").alias("letters"), F.col("r.fault").alias("faults")))
    after = _prices(blocks)
    paths = after.join(blocks.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), ["conv", "block"]).select("conv_id", "block", "faults", "letters", "prices", "tail")
    return _read_through(rows, paths)


def _prices(blocks: DataFrame) -> DataFrame:
    """conv, block, prices of leaving the block in each state, and whether it is the last: a stream of sums, from the end."""
    priced, summed = "conv string, block long, costs array<long>, ends array<long>", "conv string, block long, prices array<long>, tail boolean"
    priced_schema, summed_schema = _schema(priced), _schema(summed)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((c, b, block_costs(x), [search(x, q, END, True)[0] for q in range(4)]) for c, b, x in _rows(batches)), priced_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(sums(batches), summed_schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, group in groupby(_rows(batches), lambda r: r[0]):
            prices = None
            for _, block, c, ends in group:
                yield conv, block, list(prices or END), prices is None
                prices = tuple(ends) if prices is None else prices_before(c, prices)

    by_block = blocks.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "block", "letters").mapInArrow(costs, priced)
    return by_block.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(add, summed)


def _read_through(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Texts and the searched paths of their blocks, in order, into counts and digests."""
    bits = BLOCK.bit_length() - 1
    looked = "conv_id long, block long, faults array<string>, paths array<struct<cost:long,audit:string,leave:int>>"
    looked_schema, schema = _schema(looked), _schema(RESULT)
    found = "conv_id long, block long, kind int, pos long, turn long, role string, text string, copies int, faults array<string>, paths array<struct<cost:long,audit:string,leave:int>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("cost", "audit", "leave")
        return _batches(((c, b, f, [dict(zip(keys, priced_search(x, q, tuple(p), tail), strict=True)) for q in range(4)]) for c, b, f, x, p, tail in _rows(batches)), looked_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(map(one, groupby(_rows(batches), lambda r: r[0])), schema)

    def one(group: tuple) -> tuple:
        conv_id, parts = group
        out, path, faults, state, waiting = Digest(), "", iter(()), 0, []
        for _, _, kind, _, turn, role, text, copies, f, p in parts:
            if kind == 0:
                out.edits(path, waiting)
                waiting, faults, took = [], iter(f), p[state]
                out.cost, path, state = out.cost + took["cost"], took["audit"], took["leave"]
            elif copies:
                out.row(turn, role, next(faults))
                waiting.append((role, text))
        out.edits(path, waiting)
        return out.result(conv_id)

    paths = paths.mapInArrow(look, looked)
    texts = rows.withColumns({"block": F.shiftright("pos", bits), "kind": F.lit(1)})
    both = texts.unionByName(paths.withColumn("kind", F.lit(0)), allowMissingColumns=True).select(*T.StructType.fromDDL(found).names)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", "pos").mapInArrow(run, RESULT)
