"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A legal order is ``(s?(ua)+)?`` over the initials of the roles. Items are deduced as in a weighted hypergraph:
``edit(i, x)`` says that row i yields the symbol x (or none), ``rest(i, q)`` that the rows from i on lead from the
automaton's state q to an accepted end. A deduction joins ``edit(i, x)`` or an insertion with ``rest(i + 1, r)`` to
``rest(i, q)``; its value is the sum of costs and of rows, and the audits one after the other. It is monotone and
never below a premise in the order (cost, rows, audit), so Knuth's agenda pops items in order of their final
values until the goal ``rest(0, start)`` is popped.

Conversations lie in one global order, cut into ranges and there into blocks of bounded size. A conversation inside
one block is solved there. Of others each block gives its lightest derivation between any two states; as two audits
of equal cost over the same rows are never prefixes of each other, these compose, and only states and audits meet in
a group. So a conversation of any length is spread over all tasks; only what a single result row holds grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written

#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARACTERS = 256, 1 << 18
START, STATES, ACCEPTED = 0, 4, (0, 3)
#: state -> symbol -> state: nothing yet; after the system's, the user's, the assistant's turn
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3

REPORT = "cost long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long"


def edits(initial: str, fault: str | None) -> Iterator[tuple[str, int, str]]:
    """(symbol or '', cost, letter) of every edit of one row."""
    yield "", DELETE, "D"
    if fault not in ("blank", "duplicate"):
        more = CUT_SHORT if fault == "truncated" else 0
        if initial in ("s", "u", "a"):
            yield initial, more, "K"
        yield from ((x, REROLE + more, "R") for x in ROLE)


def lightest(rows: list[tuple[str, str | None]], ends: Iterable[int], goals: Iterable[int]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest ``rest(0, q)`` for each goal q that can reach one of ``ends``.

    ``rows``: (initial, fault) of each row in order.
    """
    n, goals, found = len(rows), set(goals), {}
    agenda = [(0, 0, "", n, q, "") for q in ends]  # cost, rows, audit, row, state (-1: an edit item), symbol
    agenda += [(c, 1, a, i, -1, x) for i, row in enumerate(rows) for x, c, a in edits(*row)]
    heapify(agenda)
    rest: list[dict] = [{} for _ in range(n + 1)]
    edit: list[dict] = [{} for _ in range(n)]

    def join(i, x, change, r, after):
        """The deductions of rest(i, q) from a change that yields x, and rest(., r)."""
        for q in range(STATES) if x else (r,):
            if (not x or NEXT[q].get(x) == r) and q not in rest[i]:
                heappush(agenda, (change[0] + after[0], change[1] + after[1], change[2] + after[2], i, q, ""))

    while agenda and goals:
        cost, size, audit, i, q, x = heappop(agenda)
        value = cost, size, audit
        if q < 0:
            if x not in edit[i]:
                edit[i][x] = value
                for r, after in rest[i + 1].items():
                    join(i, x, value, r, after)
        elif q not in rest[i]:
            rest[i][q] = value
            if i == 0 and q in goals:
                found[q] = cost, audit
                goals.discard(q)
            for symbol in ROLE:
                join(i, symbol, (INSERT, 0, "I"), q, value)
            if i:
                for symbol, change in edit[i - 1].items():
                    join(i - 1, symbol, change, q, value)
    return found


def replay(roles: list[str], texts: list[str], audit: str, state: int) -> list[tuple[str, str]]:
    """The turns that the edits of ``audit`` leave, from ``state`` on; the automaton says which role is due."""
    out, rows = [], zip(roles, texts)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        symbol = role[0] if letter == "K" else next(x for x in ROLE if x in NEXT[state])
        out.append((role if letter == "K" else ROLE[symbol], text))
        state = NEXT[state][symbol]
    return out


@dataclass
class Block:
    """Some consecutive rows of one conversation."""

    conv: int | None
    number: int
    at_start: bool  # no row of the conversation stands before it
    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    faults: list = field(default_factory=list)
    size: int = 0

    def add(self, turn, role, text, again):
        last = text.rstrip(SPACE)[-1:]
        self.faults.append("blank" if not last else "duplicate" if again else None if last in ".!?" else "truncated")
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)

    def row(self, part: int, whole: bool) -> dict:
        initials, known = [r[:1] for r in self.roles], [t for t in self.turns if t is not None]
        out = {"conv_id": self.conv, "part": part, "block": self.number, "whole": whole}
        out |= {k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")}
        out |= {"illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1]}
        out |= {"low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known))}
        rows = list(zip(initials, self.faults))
        if whole:
            out["cost"], out["audit"] = lightest(rows, ACCEPTED, [START])[START]
            kept = replay(self.roles, self.texts, out["audit"], START)
            return out | {"roles": [r for r, _ in kept], "texts": [t for _, t in kept]}
        spans = [{"enter": q, "leave": r, "cost": c, "audit": a} for r in range(STATES) for q, (c, a) in lightest(rows, [r], range(STATES)).items()]
        return out | {"spans": spans, "roles": self.roles, "texts": self.texts}


BLOCKS = (
    "conv_id long, part long, block long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, cost long, audit string, spans array<struct<enter:int,leave:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
)


def _blocks(schema: pa.Schema, max_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, block, number = TaskContext.get().partitionId(), [], None, 0

        def finished(last: bool, cut: bool) -> dict:
            # the first and the last conversation of a range may go on in the next one
            return block.row(part, block.at_start and not cut and not last)

        for batch in batches:
            for conv, turn, role, text, again, copies in zip(*(c.to_pylist() for c in batch.columns)):
                for copy in range(copies):
                    new = block is None or block.conv != conv
                    if new or len(block.turns) >= max_rows or block.size >= BLOCK_CHARACTERS:
                        if block is not None:
                            made.append(finished(False, not new))
                        block = Block(conv, number, new and number > 0)
                        number += 1
                        if len(made) >= 64:
                            yield pa.RecordBatch.from_pylist(made, schema=schema)
                            made = []
                    block.add(turn, role, text, again or copy > 0)
        if block is not None:
            made.append(finished(True, False))
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def _less(a: tuple, b: tuple) -> bool:
    """Whether audit a stands before b; both are chains (string, chain that follows or None)."""
    x, y, i, j = a, b, 0, 0
    while x is not y or i != j:
        while x and i == len(x[0]):
            x, i = x[1], 0
        while y and j == len(y[0]):
            y, j = y[1], 0
        if not x or not y:
            return not x and bool(y)
        n = min(len(x[0]) - i, len(y[0]) - j)
        s, t = x[0][i : i + n], y[0][j : j + n]
        if s != t:
            return s < t
        i, j = i + n, j + n
    return False


def compose(rows: list[dict]) -> list[tuple[int, int, str]]:
    """(cost from here to the end, entry state, audit) of each block of one conversation, given all its spans in order."""
    best: list[dict] = [{q: (0, None, None, "") for q in ACCEPTED}]  # state -> cost, audit chain, state after, own audit
    for row in reversed(rows):
        here: dict = {}
        for span in row["spans"]:
            after = best[-1].get(span["leave"])
            if after is None:
                continue
            cost, chain_ = span["cost"] + after[0], (span["audit"], after[1])
            old = here.get(span["enter"])
            if old is None or cost < old[0] or (cost == old[0] and _less(chain_, old[1])):
                here[span["enter"]] = cost, chain_, span["leave"], span["audit"]
        best.append(here)
    state, out = START, []
    for here in reversed(best[1:]):
        cost, _, after, audit = here[state]
        out.append((cost, state, audit))
        state = after
    return out


def _report(rows: list[dict]) -> dict:
    out = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL_PAIRS for a, b in zip(rows, rows[1:]))
    known = [r for r in rows if r["low"] is not None]
    distinct = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    return out | {"gaps": known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0}


PIECES = f"conv_id long, part long, block long, state int, piece string, at_start boolean, {REPORT}"


def _composed(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        steps = compose(rows)
        out = [{k: row[k] for k in ("conv_id", "part", "block")} | {"state": state, "piece": piece, "at_start": False} for row, (_, state, piece) in zip(rows, steps)]
        out[0] |= _report(rows) | {"at_start": True, "cost": steps[0][0], "audit": "".join(p for _, _, p in steps)}
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _arrow(kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def _replayed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                made = []
                for row in batch.slice(lo, 64).to_pylist():
                    kept = replay(row["roles"], row["texts"], row["piece"], row["state"])
                    made.append({k: row[k] for k in ("conv_id", "part", "block")} | {"whole": False, "roles": [r for r, _ in kept], "texts": [t for _, t in kept]})
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


KEPT = "conv_id long, part long, block long, whole boolean, roles array<string>, texts array<string>"


def repair(rows: DataFrame, max_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of all conversations in ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Reports: (``conv_id``, ``cost``, ``audit``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``), one
    row per conversation. Turns: (``conv_id``, ``part``, ``block``, ``whole``, ``roles``, ``texts``), in the order of
    part and block; ``whole`` rows hold all turns of their conversation.

    Rows stand in the order of turn (null first), role, text. Null roles and texts are one space. Rows without
    conv_id are one conversation. Rows that repeat another one in full are duplicates of it, however many they are
    (equal rows travel as one with a count). No rows give empty tables; other columns are not read.
    """
    blank = F.lit(" ")
    rows = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"], blank).alias("role"), F.coalesce(rows["text"], blank).alias("text"),
    )
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    said = [F.col("conv_id"), F.col("role"), F.unhex(F.sha2("text", 256)).alias("h")]
    # the first place of each role and text; met again by all its columns, so a phrase said often is no hot key
    first = rows.groupBy(*said).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("h_"), F.col("t.turn").alias("t"))
    rows = rows.withColumn("h", said[2])
    met = rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["h"] == first["h_"]) & rows["turn"].eqNullSafe(first["t"])
    flagged = rows.join(first, met, "left").select("conv_id", "turn", "role", "text", F.col("r").isNull().alias("again"), "copies")
    flagged = written(flagged, "flagged")  # ranges are sampled from it

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(ordered.mapInArrow(_blocks(_arrow(BLOCKS), max_rows), BLOCKS), "blocks")

    names = [c.split()[0] for c in REPORT.split(", ")]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole, cut = blocks.where("whole"), blocks.where("NOT whole")
    composed = written(cut.drop("roles", "texts", "cost", "audit").groupBy("conv_id").applyInArrow(_composed(_arrow(PIECES)), PIECES), "composed")
    reports = whole.withColumn("gaps", gaps).select("conv_id", *names).unionByName(composed.where("at_start").select("conv_id", *names))
    pieces = composed.select("part", "block", "state", "piece")
    replayed = cut.select("conv_id", "part", "block", "roles", "texts").join(pieces, ["part", "block"]).mapInArrow(_replayed(_arrow(KEPT)), KEPT)
    return reports, whole.select("conv_id", "part", "block", "whole", "roles", "texts").unionByName(replayed)


def _hashed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, any_line = None, None, False
        for batch in batches:
            for c, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or c != conv:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)
                    conv, digest, any_line = c, hashlib.sha256(), False
                if line is not None:
                    digest.update((("\n" if any_line else "") + line).encode())
                    any_line = True
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return run


def digests(turns: DataFrame) -> DataFrame:
    """(``conv_id``, ``repaired_sha256``): SHA-256 of the lines ``role:text`` of each conversation.

    The blocks of a long conversation go through one task in order, a batch of lines at a time: a SHA-256 of one
    conversation cannot be taken in parts.
    """
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    kind = "conv_id long, repaired_sha256 string"
    whole = turns.where("whole").select("conv_id", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    cut = turns.where("NOT whole").select("conv_id", "part", "block", F.posexplode_outer(lines).alias("place", "line"))
    order = ["conv_id", "part", "block", "place"]
    return whole.unionByName(cut.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hashed(_arrow(kind)), kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32(``conv_id:turn``) % 20: dropped, emptied, without stops, repeated, role user."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(conversations[c].cast("string"), blank) for c in ("conv_id", "turn")))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], blank).alias("role"), F.coalesce(conversations["text"], blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The report and digest of every conversation of ``conversations``, also of those with no row left in ``rows``."""
    reports, turns = repair(rows)
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    r, d = reports.withColumnRenamed("conv_id", "rc"), digests(turns).withColumnRenamed("conv_id", "dc")
    out = ids.join(r, ids["conv_id"].eqNullSafe(r["rc"]), "left").join(d, ids["conv_id"].eqNullSafe(d["dc"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
