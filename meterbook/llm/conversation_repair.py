"""Conversation structure repair by a lightest-derivation agenda.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?`` and no row is blank or repeated.  Edits go through the rows in
order: Keep (0), Rerole to user or assistant (2), Delete (3, the only one
for blank and duplicate rows), Insert an empty user or assistant row (2); a
truncated row that is not deleted adds 1.

The cheapest edits are a lightest derivation in a weighted hypergraph.  An
item ``(i, state)`` says that the first ``i`` steps can be edited into rows
that leave the grammar in ``state``; its weight is ``(cost, audit)``, the
audit being the initials of the edits.  A deduction takes an item and the next
step, adds the costs and appends the audit.  Neither can get smaller by that
(the function is *superior*), and of two derivations of one item the lighter
stays lighter (it is *monotone*): equal costs over equal steps rule out that
one audit is the beginning of the other.  So the agenda may pop items in
ascending order, each is final when popped, and the first goal popped is the
answer, ties included.

Long conversations are cut into *pieces* of bounded size, at any place.  A
piece is summed up by its lightest derivation from every state to every state
(16 at most); pieces are then the steps of another agenda, in rounds of
``FAN_IN``.  No task holds the rows of a whole conversation: rows are sorted
by range, and repaired rows stream past a running digest.  What stays one
value is the audit, one letter per edit, as it is one value of the result.

Defined results: null roles and texts are read as one space; null turns come
first and count for no gap; rows of one turn are ordered by role and text; a
null id is a conversation like any other; repeated rows are duplicates; other
columns are not read, whatever their names; a table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from meterbook.llm.common import map_batches, written

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
#: What a kept row does to a state, by its initial; a rerolled or inserted row goes to NEXT.
KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (START, ASSISTANT)
#: Rows of a piece; pieces that one task of a round puts together.
PIECE_ROWS = 256
FAN_IN = 64

Rules = dict[int, list[tuple[int, int, str]]]
_SUMMARY = (
    "rows bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, low_turn bigint, turns bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, paths array<struct<p:int,q:int,cost:bigint,audit:string>>"
)


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated."""
    kept = text.strip(SPACE)
    if not kept:
        return "blank"
    if seen:
        return "duplicate"
    return None if kept[-1] in ENDS else "truncated"


def row_rules(initial: str, found: str | None) -> Rules:
    """What the edits of one row do in each state: (state after, cost, audit)."""
    rules: Rules = {state: [(state, DELETE, "D")] for state in NEXT}
    if found in ("blank", "duplicate"):
        return rules
    extra = TRUNCATED if found else 0
    for state, edits in rules.items():
        if initial in KEPT[state]:
            edits.append((KEPT[state][initial], extra, "K"))
        edits.append((NEXT[state], REROLE + extra, "R"))
    return rules


def lightest(steps: list[Rules], start: int, goals: Iterable[int], first_only: bool) -> dict[int, tuple[int, str]]:
    """Weight (cost, audit) of the goal states after all steps: the first that finalises, or all that can be reached."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    goals = set(goals)
    while agenda and len(found) < len(goals):
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(steps):
            if state in goals:
                found[state] = (cost, audit)
                if first_only:
                    break
        else:
            for after, more, edit in steps[i].get(state, ()):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + edit, i + 1, after))
        if (i, NEXT[state]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[state]))
    return found


def edit_rows(audit: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows that an audit makes of rows (role, text)."""
    own = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(own)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state][role[:1]]
        else:
            state = NEXT[state]
            role = NAMES[state]
        yield edit, role, text


def _summary(turns: list, roles: list[str], faults: list[str | None], whole: bool) -> dict:
    """What the next level needs of a piece; a whole conversation needs its goal only."""
    steps = [row_rules(r[:1], f) for r, f in zip(roles, faults, strict=True)]
    if whole:
        paths = [(START, q, *w) for q, w in lightest(steps, START, GOALS, True).items()]
    else:
        paths = [(p, q, *w) for p in NEXT for q, w in lightest(steps, p, NEXT, False).items()]
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {
        "rows": len(roles), "first_initial": initials[0], "last_initial": initials[-1], "first_turn": turns[0], "last_turn": turns[-1],
        "low_turn": known[0] if known else None, "turns": len(set(known)),
        **{kind: faults.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "paths": [dict(zip(("p", "q", "cost", "audit"), path, strict=True)) for path in paths],
    }


def _merged(parts: list[dict]) -> dict:
    """One summary of consecutive pieces."""
    out = dict(parts[0])
    for part in parts[1:]:
        out["illegal"] += part["illegal"] + (out["last_initial"] + part["first_initial"] not in LEGAL)
        out["turns"] += part["turns"] - (part["first_turn"] is not None and out["last_turn"] == part["first_turn"])
        for name in ("rows", "blank", "duplicate", "truncated"):
            out[name] += part[name]
        if out["low_turn"] is None:
            out["low_turn"] = part["low_turn"]
        out["last_initial"], out["last_turn"] = part["last_initial"], part["last_turn"]
    steps: list[Rules] = []
    for part in parts:
        rules: Rules = {}
        for path in part["paths"]:
            rules.setdefault(path["p"], []).append((path["q"], path["cost"], path["audit"]))
        steps.append(rules)
    out["paths"] = [{"p": p, "q": q, "cost": c, "audit": a} for p in NEXT for q, (c, a) in lightest(steps, p, NEXT, False).items()]
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that a checksum of id and turn deals out; nulls are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *named)) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.withColumn("__copy", F.explode(copies)).where(kind != 0)
        .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"))
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Written rows with a number of their own and whether the conversation had role and text before."""
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    own = written(rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), *filled, F.monotonically_increasing_id().alias("row")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    # repeated rows are counted before they travel; only what occurs more than once is joined back
    several = own.groupBy("conv", "role", "text").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    several = several.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("first.row").alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    return own.join(several, same, "left").select("conv", "turn", "role", "text", "row", (F.col("first").isNotNull() & (F.col("first") != F.col("row"))).alias("seen"))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Written pieces (conv, at, summary, roles, texts); ``at`` orders the pieces of a conversation."""
    numbered = _numbered(rows)
    kind = numbered.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row"]
    # a long conversation lies in several ranges, as turn, role, text and row are part of the order
    dealt = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"conv {kind}, at bigint, {_SUMMARY}, roles array<string>, texts array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, number, part, fields = [], [], 0, 0, None

        def close(conv: object, whole: bool) -> None:
            nonlocal number
            turns, roles, texts, seen = map(list, zip(*held, strict=True))
            faults = [fault(t, s) for t, s in zip(texts, seen, strict=True)]
            out.append({"conv": conv, "at": (part << 33) + number, **_summary(turns, roles, faults, whole), "roles": roles, "texts": texts})
            number += 1
            held.clear()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, fields)
            out.clear()
            return done

        current, inside = None, False  # inside: rows of the conversation may lie in front
        for batch in batches:
            if fields is None:
                fields = _piece_fields(batch.schema.field(0).type)
                current, inside = (batch.column(0)[0].as_py() if batch.num_rows else None), True
            convs, turns, roles, texts, _, seen, parts = (c.to_pylist() for c in batch.columns)
            part = parts[0] if parts else part
            for conv, *row in zip(convs, turns, roles, texts, seen, strict=True):
                if conv != current:
                    if held:
                        close(current, not inside)
                    current, inside = conv, False
                elif len(held) >= piece_rows:
                    close(current, False)
                    inside = True
                held.append(row)
            if len(out) >= 256:
                yield flush()
        if held:
            close(current, False)  # the next range may go on with it
        if out:
            yield flush()

    return written(map_batches(dealt, work, schema), "pieces")


def _piece_fields(conv: pa.DataType) -> pa.Schema:
    path = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    whole = {name: pa.int64() for name in ("rows", "first_turn", "last_turn", "low_turn", "turns", "blank", "duplicate", "truncated", "illegal")}
    kinds = whole | {"first_initial": pa.string(), "last_initial": pa.string(), "paths": pa.list_(path)}
    names = [part.split()[0] for part in _SUMMARY.split(", ")]
    return pa.schema([("conv", conv), ("at", pa.int64()), *((n, kinds[n]) for n in names), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _goal() -> Column:
    """The lightest path of a summary from the start to a goal, as a struct of cost and audit."""
    ends = F.filter("paths", lambda x: (x["p"] == START) & x["q"].isin(*GOALS))
    return F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))


def solve(cut: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One summary per conversation with its cheapest edits, from its pieces."""
    names = [part.split()[0] for part in _SUMMARY.split(", ")]
    level = cut.select("conv", "at", *names)
    kind = cut.schema["conv"].dataType.simpleString()

    def merge(group: pa.Table) -> pa.Table:
        parts = group.sort_by("at").to_pylist()
        fields = pa.schema([group.schema.field(n) for n in ("conv", "at", *names)])
        return pa.Table.from_pylist([{"conv": parts[0]["conv"], "at": parts[0]["at"]} | _merged(parts)], fields)

    done, round_ = [], 0
    while True:
        counted = level.groupBy("conv").agg(F.count("*").alias("n"))
        named = counted.select(F.col("conv").alias("c"), "n")
        level = level.join(named, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
        done.append(level.where("n = 1").drop("n"))
        open_ = level.where("n > 1")
        if open_.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("conv").orderBy("at")) - 1
        places = open_.select(F.col("conv").alias("c"), F.col("at").alias("a"), F.floor(place / fan_in).alias("batch"))
        dealt = open_.drop("n").join(places, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))).drop("c", "a")
        level = dealt.groupBy("conv", "batch").applyInArrow(merge, f"conv {kind}, at bigint, {_SUMMARY}")
        level = written(level, f"merged-{round_}")
        round_ += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("goal", _goal()).select("conv", *names[:-1], F.col("goal.cost").alias("cost"), F.col("goal.audit").alias("audit"))


def _streamed(cut: DataFrame, solved: DataFrame) -> DataFrame:
    """The audit of each conversation followed by its pieces, a conversation in one task, in order."""
    kind = cut.schema["conv"].dataType.simpleString()
    none = F.lit(None).cast("array<string>")
    heads = solved.select("conv", F.lit(-1).cast("bigint").alias("at"), "audit", none.alias("roles"), none.alias("texts"))
    rows = cut.select("conv", "at", F.lit(None).cast("string").alias("audit"), "roles", "texts")
    both = heads.unionByName(rows).withColumn("conv", F.col("conv").cast(kind))
    return both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at")


class _Walk:
    """Applies the audit of a conversation to its pieces as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def piece(self, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """The repaired rows up to the last of these rows; inserts behind it come with the next piece or the end."""
        to, left = self.at, len(rows)
        while left:
            left -= self.audit[to] != "I"
            to += 1
        yield from self._go(to, rows)

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._go(len(self.audit), [])

    def _go(self, to: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        edits, self.at = self.audit[self.at : to], to
        for edit, role, text in edit_rows(edits, rows, self.state):
            self.state = KEPT[self.state][role[:1]]
            yield edit, role, text


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]] | None]]:
    """(conversation, repaired rows) piece by piece; None ends a conversation."""
    conv, walk = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if walk is not None:
                    yield conv, walk.end()
                    yield conv, None
                conv, walk = row["conv"], _Walk(row["audit"])
            else:
                yield conv, walk.piece(list(zip(row["roles"], row["texts"], strict=True)))
    if walk is not None:
        yield conv, walk.end()
        yield conv, None


def repaired_rows(cut: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows (conv_id, place, edit, role, text) of the repaired conversations."""
    kind, typed = cut.schema["conv"].dataType.simpleString(), to_arrow_type(cut.schema["conv"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for conv, rows in _walks(batches):
            if rows is None:
                place = 0
                continue
            out = [(conv, place + i, *row) for i, row in enumerate(rows)]
            place += len(out)
            if out:
                kinds = (typed, pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "edit", "role", "text"])

    return map_batches(_streamed(cut, solved), work, f"conv_id {kind}, place bigint, edit string, role string, text string")


def repaired_digests(cut: DataFrame, solved: DataFrame) -> DataFrame:
    """SHA-256 of the repaired ``role:text`` lines of each conversation; a digest takes its bytes in order, so one task streams them."""
    kind, typed = cut.schema["conv"].dataType.simpleString(), to_arrow_type(cut.schema["conv"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, lead, ids, found = hashlib.sha256(), b"", [], []
        for conv, rows in _walks(batches):
            if rows is None:
                ids.append(conv)
                found.append(digest.hexdigest())
                digest, lead = hashlib.sha256(), b""
                continue
            for _, role, text in rows:
                digest.update(lead + role.encode() + b":" + text.encode())
                lead = b"\n"
        if ids:
            yield pa.RecordBatch.from_pydict({"conv": pa.array(ids, typed), "repaired_sha256": pa.array(found)})

    return map_batches(_streamed(cut, solved), work, f"conv {kind}, repaired_sha256 string")


def audits(damaged: DataFrame, original: DataFrame, piece_rows: int = PIECE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each conversation of ``original``: faults, cost, audit and digest of the repair of its rows in ``damaged``."""
    cut = pieces(damaged, piece_rows)
    solved = written(solve(cut, fan_in), "solved")
    digests = repaired_digests(cut, solved).select(F.col("conv").alias("d"), "repaired_sha256")
    every = original.select(F.col("conv_id").alias("id")).distinct()
    found = solved.join(digests, F.col("conv").eqNullSafe(F.col("d")))
    gaps = F.coalesce(F.col("last_turn") - F.col("low_turn") + 1 - F.col("turns"), F.lit(0))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias("conv_id"), gaps.alias("gaps"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
