"""Operator 13: repair of damaged conversations by cost layers over a small grammar.

A conversation's role initials have to spell (s?(ua)+)?. Its rows may be kept (0), given the role user or assistant (1),
deleted (2; blank and duplicate rows have to be), and empty turns may be inserted anywhere (5); a truncated row that stays adds 5.
Layer c holds, for each turn, the bit set of the grammar's states from which the rest can be finished at a cost of at most c.
Layers are made for c = 0, 1, 2, ... until the first one accepts the start; a walk through the bits from there, taking the
ASCII-least edit that the layers allow, gives the cheapest edits, least in order.

Rows are dealt by ranges of (conv_id, turn, start of the role) and sorted, so that a conversation of any length lies in
several partitions; their places are written with them. What the layers read is a byte a row, gathered in segments of at
most 2 ** SEGMENT_BITS rows. A conversation of one segment is solved at once. For one of more, a segment tells the least cost between
any two states (layers of 16 bits), a fold over these 16 numbers a segment gives the costs still to come after each segment,
each segment walks from all four states, and a second fold tells which walk counts. Within a segment, layers are made for
BLOCK rows at a time, so that the work grows with the rows and not with rows times cost. At last the rows and their edits
stream through one task a conversation, sorted, for the hash, which takes its bytes in order; that task holds the audit alone.

Order of rows: by turn (nulls first), then role and text. Nulls: a role or text is one space, a turn or conv_id in the key of
the damage too; rows with a null conv_id are a conversation. Ties and repeated rows: equal rows of a turn stand side by side
and all but the first are duplicates. Empty texts and roles: an empty text is blank; a role counts by its first character.
Very long texts and conversations are taken whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACES, ship, width, write_table

#: States of the grammar: nothing yet, after s, after u, after a. The first and the last accept.
STATES, ACCEPT = 4, (0, None, None, 0)
#: Costs of a new role, a deletion, an inserted turn, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a segment (a power of two), rows of a block of layers, different segments a worker remembers.
SEGMENT_BITS, BLOCK, MEMO = 16, 128, 20_000
#: A row's byte: the role's number (s, u, a, other) and FAULTS times 4.
ROLES, FAULTS = "sua", {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
NEVER = 1 << 40


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of each row after the damage; a dropped row stays as gone, without role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone, times = F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return out.drop("copy")


# ---- layers. A set of states is a nibble; four nibbles side by side are the sets for four ways to end.


def _before(letter: str, after: int) -> int:
    """The states from which a row with that initial leads into one of the states of a nibble."""
    steps = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}[letter]
    return sum({1 << a for a, b in steps if after >> b & 1})


@lru_cache(maxsize=1)
def _tables() -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Of 16 bits: the states before them by a row s, u, a, by any other (none), and by a row that may be u or a."""
    nibbles = [[_before(x, n) for n in range(16)] for x in ROLES]
    wide = lambda t: [t[x & 15] | t[x >> 4 & 15] << 4 | t[x >> 8 & 15] << 8 | t[x >> 12] << 12 for x in range(1 << 16)]
    s, u, a = map(wide, nibbles)
    return s, u, a, [0] * (1 << 16), [x | y for x, y in zip(u, a, strict=True)]


def layers(codes: bytes, ends: list[tuple], until: int | None = None) -> list[list[int]]:
    """For c = 0, 1, ...: of each place before, between and after the rows, the states from which they can be finished at c.

    ends has, for each nibble, the cost still to come after the last row by state (None: no way). Layers end with the first
    one that has all bits of `until` at its start; without it, when no more can be reached.
    """
    *keeps, moves = _tables()
    n, out, quiet = len(codes), [], 0
    last = max((e for end in ends for e in end if e is not None), default=0)
    empty = [0] * (n + 1)
    back = lambda c: out[c] if c >= 0 else empty
    while True:
        c = len(out)
        deleted, inserted = back(c - DELETE), back(c - INSERT)
        here = sum(1 << (4 * k + s) for k, end in enumerate(ends) for s, e in enumerate(end) if e is not None and e <= c)
        now = [0] * n + [here | moves[inserted[n]]]
        kept, moved, kept_cut, moved_cut = now, back(c - REROLE), back(c - TRUNCATED), back(c - REROLE - TRUNCATED)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            found = deleted[i + 1] | moves[inserted[i]]
            if code < 4:
                found |= keeps[code][kept[i + 1]] | moves[moved[i + 1]]
            elif code < 8:
                found |= keeps[code - 4][kept_cut[i + 1]] | moves[moved_cut[i + 1]]
            now[i] = found
        out.append(now)
        if until is not None:
            if now[0] & until == until:
                return out
        else:
            quiet = quiet + 1 if c and c > last and now == out[c - 1] else 0
            if quiet > REROLE + TRUNCATED:
                return out


def _firsts(made: list[list[int]]) -> list[list]:
    """Per nibble, the least cost at the start by state."""
    out: list[list] = [[None] * STATES for _ in range(STATES)]
    for c, layer in enumerate(made):
        for k in range(STATES):
            for s in range(STATES):
                if out[k][s] is None and layer[0] >> (4 * k + s) & 1:
                    out[k][s] = c
    return out


def _lowered(end: tuple) -> tuple[int, tuple]:
    least = min(e for e in end if e is not None)
    return least, tuple(None if e is None else e - least for e in end)


@lru_cache(maxsize=MEMO)
def _back(codes: bytes, end: tuple) -> tuple:
    """Costs to the end before the rows, by state."""
    return tuple(_firsts(layers(codes, [end]))[0])


def backward(codes: bytes, end: tuple) -> list[tuple]:
    """Costs still to come, by state, before the first block of rows, between blocks and after the last."""
    out = [end]
    for at in range((len(codes) - 1) // BLOCK * BLOCK if codes else -1, -1, -BLOCK):
        least, low = _lowered(out[-1])
        out.append(tuple(None if e is None else e + least for e in _back(codes[at : at + BLOCK], low)))
    return out[::-1]


@lru_cache(maxsize=MEMO)
def transfer(codes: bytes) -> tuple:
    """The least cost from state s before the rows to state k after them, at 4 * k + s; NEVER where there is no way."""
    total = [0 if k == s else NEVER for k in range(STATES) for s in range(STATES)]
    for at in range(0, len(codes), BLOCK):
        ends = [tuple(0 if s == k else None for s in range(STATES)) for k in range(STATES)]
        step = [NEVER if e is None else e for row in _firsts(layers(codes[at : at + BLOCK], ends)) for e in row]
        total = [min(NEVER, *(total[4 * mid + s] + step[4 * k + mid] for mid in range(STATES))) for k in range(STATES) for s in range(STATES)]
    return tuple(total)


@lru_cache(maxsize=MEMO)
def _walk_block(codes: bytes, end: tuple, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of each row of a block, and the state after it.

    K keeps, D deletes, u and a give that role, U and A are inserted turns before the row's own letter; those after the last
    row are its own only at the end of a conversation, where no cost is still to come.
    """
    made = layers(codes, [end], 1 << state)
    *keeps, moves = _tables()
    left, plans, i, held = len(made) - 1, [], 0, ""
    reaches = lambda table, at, c: c >= 0 and table[made[c][at] & 15] >> state & 1
    target = {0: 2, 1: 2, 2: 3, 3: 2}
    while True:
        if i == len(codes):
            if end[state] is not None and end[state] <= left:
                break
        elif left >= DELETE and made[left - DELETE][i + 1] >> state & 1:
            plans.append(held + "D")
            held, i, left = "", i + 1, left - DELETE
            continue
        if reaches(moves, i, left - INSERT):
            state, left = target[state], left - INSERT
            held += "UA"[state - 2]
            continue
        role, extra = codes[i] % 4, TRUNCATED if codes[i] >= 4 else 0
        if reaches(keeps[role], i + 1, left - extra):
            plans.append(held + "K")
            state, left = (1, 2, 3)[role], left - extra
        else:
            state, left = target[state], left - extra - REROLE
            plans.append(held + "ua"[state - 2])
        held, i = "", i + 1
    if held and plans:
        plans[-1] += held
    return tuple(plans), state


def walk(codes: bytes, end: tuple, state: int) -> tuple[list[str], int]:
    """The cheapest, ASCII-least edits of each row from that state on, and the state after them."""
    to_come, plans = backward(codes[BLOCK:], end), []
    for b, at in enumerate(range(0, len(codes), BLOCK)):
        found, state = _walk_block(codes[at : at + BLOCK], _lowered(to_come[b])[1], state)
        plans += found
    return plans, state


# ---- Spark


def _segments(rows: DataFrame) -> DataFrame:
    """conv_id, segment (numbers rise along a conversation), first place and codes; only rows that are left."""
    here = rows.filter("NOT gone").select("conv_id", "same", "place", "code")
    again = here.filter(F.col("code") < 4 * FAULTS["blank"]).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1").select(F.col("same").alias("_same"), "first")
    code = F.when((F.col("code") < 4 * FAULTS["blank"]) & (F.col("place") > F.col("first")), F.col("code") % 4 + 4 * FAULTS["duplicate"]).otherwise(F.col("code"))
    coded = here.join(again, F.col("same") == F.col("_same"), "left").select("conv_id", "place", code.alias("code"))
    each = F.array_sort(F.collect_list(F.struct("place", "code")))
    grouped = coded.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(each.alias("each"))
    return write_table(grouped.select("conv_id", "segment", F.col("each.place").alias("places"), F.col("each.code").alias("codes"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("segments")), "segments")


def _mapped(make, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                yield _batch([out for row in b.slice(at, 64).to_pylist() for out in make(row)], names, b)

    return run


def _batch(rows: list[dict], names: list[str], like: pa.RecordBatch) -> pa.RecordBatch:
    types = {"conv_id": like.schema.field("conv_id").type, "segment": pa.int64(), "state": pa.int32(), "after": pa.int32(), "costs": pa.list_(pa.int64()), "end": pa.list_(pa.int64()), "places": pa.list_(pa.int64()), "codes": pa.list_(pa.int32()), "plans": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)


def _grouped(make, names: list[str]):
    def run(found: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(make(found.to_pylist()), names, found)])

    return run


def _solved(row: dict):
    yield {**row, "plans": walk(bytes(row["codes"]), ACCEPT, 0)[0]}


def _ways(row: dict):
    yield {**row, "costs": transfer(bytes(row["codes"]))}


def _ends(rows: list[dict]) -> list[dict]:
    """The costs still to come after each segment, by state, less the least of them; a row a segment."""
    end, out = [NEVER if e is None else e for e in ACCEPT], []
    for r in sorted(rows, key=lambda r: r["segment"], reverse=True):
        out.append({**r, "end": end})
        before = [min(r["costs"][4 * k + s] + end[k] for k in range(STATES)) for s in range(STATES)]
        end = [NEVER if e >= NEVER else e - min(before) for e in before]
    return out


def _walks(row: dict):
    end = tuple(None if e >= NEVER else e for e in row["end"])
    possible = backward(bytes(row["codes"]), end)[0]
    for state in range(STATES):
        if possible[state] is not None:
            plans, after = walk(bytes(row["codes"]), end, state)
            yield {**row, "state": state, "after": after, "plans": plans}


def _chain(rows: list[dict]) -> list[dict]:
    """Which of the walks of each segment counts."""
    by, state, out = {(r["segment"], r["state"]): r["after"] for r in rows}, 0, []
    for segment in sorted({r["segment"] for r in rows}):
        out.append({"conv_id": rows[0]["conv_id"], "segment": segment, "state": state})
        state = by[segment, state]
    return out


def plans_of(segments: DataFrame) -> DataFrame:
    """conv_id, place, fault and plan of each row that is left: the letters of _walk_block."""
    conv = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}"
    one = segments.filter("segments = 1").select("conv_id", "places", "codes").mapInArrow(_mapped(_solved, ["conv_id", "places", "codes", "plans"]), f"{conv}, places array<long>, codes array<int>, plans array<string>")
    many = segments.filter("segments > 1")
    ways = many.select("conv_id", "segment", "codes").mapInArrow(_mapped(_ways, ["conv_id", "segment", "costs"]), f"{conv}, segment long, costs array<long>")
    ends = ways.groupBy("conv_id").applyInArrow(_grouped(_ends, ["conv_id", "segment", "end"]), f"{conv}, segment long, end array<long>")
    # a segment number belongs to at most a few conversations, so it and conv_id meet in a join of single rows
    joined = many.select("conv_id", "segment", "places", "codes").alias("l").join(ends.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.segment") == F.col("r.segment"))).select("l.conv_id", "l.segment", "places", "codes", "end")
    walks = write_table(joined.mapInArrow(_mapped(_walks, ["conv_id", "segment", "places", "codes", "state", "after", "plans"]), f"{conv}, segment long, places array<long>, codes array<int>, state int, after int, plans array<string>"), "walks")
    chosen = walks.select("conv_id", "segment", "state", "after").groupBy("conv_id").applyInArrow(_grouped(_chain, ["conv_id", "segment", "state"]), f"{conv}, segment long, state int")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.segment") == F.col("r.segment")) & (F.col("l.state") == F.col("r.state"))
    rest = walks.alias("l").join(chosen.alias("r"), same).select("l.conv_id", "places", "codes", "plans")
    each = one.union(rest).select("conv_id", F.explode(F.arrays_zip("places", "codes", "plans")).alias("z"))
    return each.select("conv_id", F.col("z.places").alias("place"), F.floor(F.col("z.codes") / 4).cast("int").alias("fault"), F.col("z.plans").alias("plan"))


class _Conversation:
    """What a conversation's rows, in order, add up to."""

    def __init__(self):
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.counts, self.illegal, self.cost = [0] * 4, 0, 0
        self.audit, self.before, self.hash, self.some = [], None, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "replace"))
        self.some = True

    def add(self, turn, role: str, text: str, fault: int, plan: str) -> None:
        if turn is not None and (self.low is None or turn != self.turn):
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        for x in plan:
            if x in "UA":
                self.line("user" if x == "U" else "assistant", "")
                self.cost += INSERT
            elif x == "D":
                self.cost += DELETE
            else:
                self.line(role if x == "K" else "user" if x == "u" else "assistant", text)
                self.cost += (x != "K") * REROLE + (fault == FAULTS["truncated"]) * TRUNCATED
            self.audit.append("I" if x in "UA" else "R" if x in "ua" else x)

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.counts[FAULTS["blank"]], self.counts[FAULTS["duplicate"]], self.counts[FAULTS["truncated"]], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and plans, sorted by conversation and place with a row's plan before it, to a line a conversation."""
    now, key, plan, done = None, None, "", []

    def flush(like: pa.DataType) -> pa.RecordBatch:
        names = ["conv_id", *_COLUMNS]
        out = [pa.array([d[i] for d in done], like if i == 0 else pa.string() if i > 6 else pa.int64()) for i in range(len(names))]
        done.clear()
        return pa.RecordBatch.from_arrays(out, names)

    for b in batches:
        for at in range(0, len(b), 1_000):
            rows = b.slice(at, 1_000).to_pylist()
            for r in rows:
                if now is None or r["conv_id"] != key:
                    if now is not None:
                        done.append((key, *now.values()))
                    now, key = _Conversation(), r["conv_id"]
                if r["plan"] is not None:
                    plan = (r["plan"], r["fault"])
                elif not r["gone"]:
                    now.add(r["turn"], r["role"], r["text"], plan[1], plan[0])
            if done:
                yield flush(b.schema.field("conv_id").type)
    if now is not None:
        done.append((key, *now.values()))
        yield flush(b.schema.field("conv_id").type)


def repair(turns: DataFrame) -> DataFrame:
    """Of each conversation: gaps, faults by kind, illegal neighbours, cost, audit and repaired_sha256. turns may be damage()'s rows."""
    spark = turns.sparkSession
    ship(spark)
    rows = turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))
    left = lambda c: F.when(~F.col("gone"), F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c)
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), left("role"), left("text"), "gone").repartitionByRange(width(spark), "conv_id", "turn", F.substring("role", 1, 8)).sortWithinPartitions("conv_id", "turn", "role", "text")
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(seen == "", FAULTS["blank"]).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), FAULTS["truncated"]).otherwise(FAULTS[""])
    number = F.coalesce(*(F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate(ROLES)), F.lit(3))
    same = F.sha2(F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"))), 256)
    placed = write_table(dealt.select("conv_id", "turn", "role", "text", "gone", (number + 4 * fault).alias("code"), F.when(~F.col("gone"), F.unhex(same)).alias("same"), F.monotonically_increasing_id().alias("place")), "turns")
    segments = _segments(placed)
    plans = plans_of(segments)
    none = lambda t: F.lit(None).cast(t)
    texts = placed.select("conv_id", "place", "turn", "role", "text", "gone", none("string").alias("plan"), none("int").alias("fault"))
    edits = plans.select("conv_id", "place", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), F.lit(False).alias("gone"), "plan", "fault")
    stream = texts.unionByName(edits).repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", "place", F.col("plan").asc_nulls_last())
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} {'string' if i > 5 else 'long'}" for i, c in enumerate(_COLUMNS))
    return stream.mapInArrow(_told, schema)


def repair_damaged(turns: DataFrame) -> DataFrame:
    return repair(damage(turns))


def _sql() -> str:
    """DuckDB SQL of the query: a plain least-cost walk with one best (cost, edits, text) a state, turn by turn."""
    add = lambda t, cost, letter, line: f"CASE WHEN {t} IS NOT NULL THEN {{'c': {t}.c + {cost}, 'a': {t}.a || {letter}, 'r': {t}.r || {line}}} END"
    user, assistant = (f"chr(10) || '{role}:'" for role in ("user", "assistant"))
    inserted = {2: [add(f"t{k}", INSERT, "'I'", user) for k in (0, 1, 3)], 3: [add("t2", INSERT, "'I'", assistant), *(add(f"t{k}", 2 * INSERT, "'II'", f"{user} || {assistant}") for k in (0, 1))]}
    closed = lambda k: f"least(t{k}, {', '.join(inserted[k])})" if k in inserted else f"t{k}"
    stay = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    own = "chr(10) || role || ':' || text"
    kept = {1: [("s", ["n0"])], 2: [("u", ["n0", "n1", "n3"])], 3: [("a", ["n2"])], 0: []}
    into = lambda k: [f"CASE WHEN may_stay AND initial = '{x}' THEN {add(t, stay, chr(39) + 'K' + chr(39), own)} END" for x, froms in kept[k] for t in froms] + [f"CASE WHEN may_stay THEN {add(t, f'1 + {stay}', chr(39) + 'R' + chr(39), f'{user if k == 2 else assistant} || text')} END" for x, froms in kept[k] if x != "s" for t in froms]
    step = ", ".join(f"least({', '.join([add(f'n{k}', DELETE, chr(39) + 'D' + chr(39), chr(39) * 2), *into(k), 'NULL'])}) AS t{k}" for k in range(STATES))
    nothing = "{'c': 0::BIGINT, 'a': '', 'r': ''}"
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), struck AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END))) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM struck
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS seq FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN rtrim(text, {blank}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) > 1 THEN 'duplicate' WHEN right(rtrim(text, {blank}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY seq) || left(role, 1) AS pair FROM numbered
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(seq) AS n FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {nothing} AS t0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS t1, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS t2, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS t3 FROM told
  UNION ALL
  SELECT conv_id, i, {step} FROM (
    SELECT w.conv_id, j.seq AS i, role, text, fault, initial, fault NOT IN ('blank', 'duplicate') AS may_stay, {', '.join(f'{closed(k)} AS n{k}' for k in range(STATES))}
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.seq = w.i + 1)
), best AS (SELECT conv_id, least(t0, {closed(3)}) AS t FROM walk JOIN told USING (conv_id) WHERE i = n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(t.c, 0) AS cost, coalesce(t.a, '') AS audit, sha256(coalesce(t.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN told USING (conv_id) LEFT JOIN best USING (conv_id)
"""


SQL = _sql()
