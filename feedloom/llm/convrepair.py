"""Repair of conversations: the cheapest edits that make their roles alternate, found by A* on the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import join_small, join_split, small_batches, stored

#: Rows and characters of a conversation that are solved at once; a longer one is cut and its cuts are joined.
PIECE_ROWS, PIECE_CHARS = 1024, 4 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States by what the edits have given last: nothing yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")

WHITE = r"\x20\x09-\x0D"


def _after(state: int, initial: str) -> int | None:
    """The state after a row of this initial, if it may follow."""
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == START else None


def _due(state: int) -> str:
    return "assistant" if state == USER else "user"


def solve(initials: list[str], faults: list[str], enter: int, leave: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits from ``enter`` to each state they can end in, or to the first of ``leave``.

    A* over (rows done, state): the heuristic is what the rows left surely cost,
    3 for each that must go and 1 for each that is truncated.  It never falls by
    more than an edit costs, so the first time a node is taken its cost is least;
    the heap is keyed (cost plus heuristic, audit), and no audit is the
    beginning of another at the same node and cost, so its audit is least too.
    """
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in ("blank", "duplicate") else TRUNCATED if faults[i] == "truncated" else 0)
    heap, done, found = [(rest[0], "", 0, enter, 0)], set(), {}
    while heap:
        _, audit, i, state, cost = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if leave is None or state in leave:
                found[state] = (cost, audit)
                if leave is not None or len(found) == 4:
                    break
        due = _after(state, _due(state)[0])
        steps = [("I", i, due, INSERT)]
        if i < n:
            steps.append(("D", i + 1, state, DELETE))
            if faults[i] not in ("blank", "duplicate"):
                more = TRUNCATED if faults[i] == "truncated" else 0
                steps.append(("R", i + 1, due, REROLE + more))
                kept = _after(state, initials[i])
                if kept is not None:
                    steps.append(("K", i + 1, kept, KEEP + more))
        for edit, j, to, price in steps:
            if (j, to) not in done:
                heappush(heap, (cost + price + rest[j], audit + edit, j, to, cost + price))
    return found


def edited(rows: list[tuple[str, str]], audit: str, enter: int) -> list[dict]:
    """The rows that the edits give: edit, role, text."""
    out, left, state = [], iter(rows), enter
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = _due(state)
        state = _after(state, role[:1])
        out.append({"edit": edit, "role": role, "text": text})
    return out


_FACTS = "lo bigint, hi bigint, turns_seen bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string"
_PATHS = "paths array<struct<enter:int, leave:int, cost:bigint, audit:string>>"
_TURNS = "turns array<struct<edit:string, role:string, text:string>>"
_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _facts(rows: list[dict]) -> dict:
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    count = lambda f: sum(r["fault"] == f for r in rows)
    return {
        "lo": min(turns, default=None), "hi": max(turns, default=None), "turns_seen": len(set(turns)), "blank": count("blank"), "duplicate": count("duplicate"), "truncated": count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
    }


def _joined(a: dict, b: dict) -> dict:
    """Facts of two pieces of a conversation, one after the other."""
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")}
    if a["hi"] is None or b["lo"] is None:
        some = b if a["hi"] is None else a
        out |= {c: some[c] for c in ("lo", "hi", "turns_seen")}
    else:
        out |= {"lo": a["lo"], "hi": b["hi"], "turns_seen": a["turns_seen"] + b["turns_seen"] - (a["hi"] == b["lo"])}
    met = a["last_initial"] is not None and b["first_initial"] is not None
    out["illegal"] = a["illegal"] + b["illegal"] + (met and a["last_initial"] + b["first_initial"] not in LEGAL)
    out["first_initial"] = b["first_initial"] if a["first_initial"] is None else a["first_initial"]
    out["last_initial"] = a["last_initial"] if b["last_initial"] is None else b["last_initial"]
    return out


def _summary(facts: dict, cost: int, audit: str) -> dict:
    gaps = 0 if facts["lo"] is None else facts["hi"] - facts["lo"] + 1 - facts["turns_seen"]
    return {"gaps": gaps, **{c: facts[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def _flagged(rows: DataFrame) -> DataFrame:
    """Each row's first fault: blank, duplicate (an earlier row of the conversation has its role and text) or truncated."""
    known = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("key").isNull().cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    keyed = rows.withColumn("digest", F.sha2(known, 256))
    first = keyed.where("not absent").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("turn", "uid"))["uid"].alias("first")).where("n > 1").drop("n")
    fault = (
        F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank").when(F.col("first") != F.col("uid"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), "truncated")
    )
    return join_small(keyed, first, "digest").withColumn("fault", fault).drop("first")


def _pieces(rows: DataFrame, kind: str, most_rows: int, most_chars: int) -> DataFrame:
    """Conversations, or pieces of those that are cut, with facts and edits.

    Rows are dealt by ranges of (key, turn, role, text, number), so a conversation that holds much of
    the table is spread over tasks.  A task reads its range in order and holds
    one piece.  Only a piece at an end of a range or at a cut may be a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, chars, opened, ready = TaskContext.get().partitionId(), 0, [], 0, True, []

        def close(partial: bool) -> None:
            nonlocal nth, held, chars
            key, own = held[0]["key"], [r for r in held if not r["absent"]]
            initials, faults, body = [r["role"][:1] for r in own], [r["fault"] for r in own], [(r["role"], r["text"]) for r in own]
            facts = _facts(own)
            row = {"key": key, "part": part, "nth": nth, "whole": not partial, **facts}
            if partial:
                paths = [{"enter": enter, "leave": leave, "cost": c, "audit": audit} for enter in range(4) for leave, (c, audit) in solve(initials, faults, enter).items()]
                ready.append(row | {"paths": paths, "gaps": None, "cost": None, "audit": None, "turns": [{"edit": None, "role": r, "text": t} for r, t in body]})
            else:
                ((cost, audit),) = solve(initials, faults, START, ENDS).values()
                ready.append(row | {"paths": None, **_summary(facts, cost, audit), "turns": edited(body, audit, START)})
            nth, held, chars = nth + 1, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["key"] != r["key"]:
                    close(partial=opened)
                    opened = False
                elif len(held) >= most_rows or chars >= most_chars:
                    close(partial=True)
                    opened = True
                held.append(r)
                chars += len(r["text"])
                if len(ready) >= 256:
                    yield from flush()
            yield from flush()
        if held:
            close(partial=True)
        yield from flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"key {kind}, part int, nth int, whole boolean, {_FACTS}, {_PATHS}, gaps bigint, cost bigint, audit string, {_TURNS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    order = ["key", "turn", "role", "digest", "uid"]
    return small_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(run, ddl)


def _chosen(pieces: DataFrame, kind: str) -> DataFrame:
    """The way through the pieces of each cut conversation: where each is entered and left; the last has the conversation's summary.

    Costs of pieces add up along the four states between them.  Pieces come in order, and of a
    conversation four costs and audits are held, and where each piece was entered from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, back, facts = None, {}, [], None

        def close() -> pa.RecordBatch:
            leave = min((s for s in ENDS if s in best), key=lambda s: best[s])
            summary, rows = _summary(facts, *best[leave]), []
            for part, nth, came in reversed(back):
                rows.append({"part": part, "nth": nth, "enter": came[leave], "leave": leave, "pieces": len(back)} | (summary if not rows else dict.fromkeys(summary)))
                leave = came[leave]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if not back or r["key"] != key:
                    if back:
                        yield close()
                    key, best, back, facts = r["key"], {START: (0, "")}, [], None
                ways: dict[int, tuple[int, str, int]] = {}
                for p in r["paths"]:
                    if p["enter"] in best:
                        cost, audit = best[p["enter"]]
                        way = (cost + p["cost"], audit + p["audit"], p["enter"])
                        ways[p["leave"]] = min(way, ways.get(p["leave"], way))
                best = {s: w[:2] for s, w in ways.items()}
                back.append((r["part"], r["nth"], {s: w[2] for s, w in ways.items()}))
                facts = r if facts is None else _joined(facts, r)
        if back:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"part int, nth int, enter int, leave int, pieces int, {_SUMMARY}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    thin = pieces.drop("turns", "gaps", "cost", "audit", "whole")
    return thin.repartition("key").sortWithinPartitions("key", "part", "nth").mapInArrow(run, ddl)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None, piece: tuple[int, int] = (PIECE_ROWS, PIECE_CHARS)) -> DataFrame:
    """Every conversation with its faults, the cheapest edits and the rows they give.

    Rows of a conversation are taken by turn (nulls first), ties by role and a
    digest of the text.  A row's first fault counts: blank, duplicate, truncated.
    Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate
    rows must go), Insert of an empty user or assistant row 2, and a truncated row that stays 1 more; roles
    must come out as ``(s?(ua)+)?`` by their first letters.  Of edits that
    cost the same the audit (K, R, D, I in order) that is ASCII-least is taken.

    Returns a row a conversation: ``key``, ``part``, ``nth``, ``pieces`` (1), ``gaps`` (turns
    missing between the least and the largest), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (adjacent initials other than su, ua, au), ``cost``, ``audit`` and
    ``turns`` (edit, role, text of each repaired row).  A conversation that was cut has ``pieces`` rows, in
    order of ``part`` and ``nth``; the last has the counts, cost and audit, null in the others.

    A null key is a conversation of its own; a row without a role can't be kept as it is; null roles and texts count as
    empty; texts are read whole; rows that repeat all values are duplicates of
    the first; rows for which the column ``absent`` is true only name their
    conversation, and one without other rows has zeros and no turns; an empty
    table gives an empty table; other columns of ``rows`` don't matter.
    """
    kind = dict(rows.dtypes)[key]
    gone = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = stored(rows.select(F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"), empty(role).alias("role"), empty(text).alias("text"), gone.alias("absent"), F.monotonically_increasing_id().alias("uid")), "conversations")
    pieces = stored(_pieces(_flagged(base), kind, *piece), "pieces")
    columns = ["key", "part", "nth", "pieces", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
    whole = pieces.where("whole").withColumn("pieces", F.lit(1)).select(columns)
    split = pieces.where("not whole")
    chosen = _chosen(split, kind)
    body = split.select("key", F.struct("part", "nth").alias("at"), "paths", F.col("turns").alias("rows"))
    met = join_split(body.withColumn("at", F.concat_ws(":", "at.part", "at.nth")), chosen.withColumn("at", F.concat_ws(":", "part", "nth")), "at", "inner")
    own = F.filter("paths", lambda p: (p["enter"] == F.col("enter")) & (p["leave"] == F.col("leave")))[0]["audit"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for k, r in enumerate(batch.select(["rows", "own", "enter"]).to_pylist()):
                turns = edited([(x["role"], x["text"]) for x in r["rows"]], r["own"], r["enter"])
                one = batch.slice(k, 1).drop_columns(["rows", "own", "enter"])
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([turns], kind)], [*one.schema.names, "turns"])

    done = met.select("key", "part", "nth", "pieces", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "rows", own.alias("own"), "enter")
    return whole.unionByName(done.mapInArrow(apply, f"key {kind}, part int, nth int, pieces int, {_SUMMARY}, {_TURNS}").select(columns)).withColumnRenamed("key", key)


def digested(repaired: DataFrame, key: str = "conv_id", name: str = "repaired_sha256") -> DataFrame:
    """One row a conversation: counts, cost, audit and the SHA-256 of its repaired ``role:text``, newline-joined.

    Pieces of a cut conversation come in order and go through one running hash.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    kept = [key, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = repaired.where("pieces = 1").select(*kept, F.sha2(F.array_join(line, "\n"), 256).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            lines, costs = batch.column("lines"), batch.column("cost")
            for k in range(batch.num_rows):
                for text in lines[k].as_py():
                    digest.update(("\n" + text if begun else text).encode())
                    begun = True
                if costs[k].is_valid:  # the last piece
                    one = batch.slice(k, 1).select(kept)
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([digest.hexdigest()])], [*kept, name])
                    digest, begun = hashlib.sha256(), False

    split = repaired.where("pieces > 1").select(*kept, "part", "nth", line.alias("lines")).repartition(key).sortWithinPartitions(key, "part", "nth")
    return whole.union(split.mapInArrow(run, f"{key} {dict(repaired.dtypes)[key]}, {_SUMMARY}, {name} string"))
