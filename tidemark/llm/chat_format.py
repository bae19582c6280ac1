"""Operator 6: chat formatting in budgeted windows. Native: only DataFrame functions.

Prefix sums of turn tokens choose turn-aligned spans: a window goes on while the prefix sum at a turn's end, less that at
the window's start, fits the room that the budget leaves. Later windows retain the system turn and repeat history as far
as its own budget and the room beside their first turn allow; repeated turns are masked, so each assistant text is a target
once. A turn is written as `[INST] role [/INST]text</s>`, a window starts with `<s>`; those strings inside a text or role
are escaped with a backslash and a digit, and a backslash as well, so every text comes back as it was.

A turn's tokens are the pre-tokens of what is written: runs of up to six letters, up to three digits, single other signs;
give a column of token counts to use another tokenizer. A window is within the budget by this count unless its own first
turn, with the system turn, is above it.

The spans are chosen on sums alone, then joined with the turns: a turn goes to the window that it is fresh in and to those
that repeat it, found by buckets of the prefix sum. So a row holds a window's turns, not its conversation's.

Nulls and empties: null texts and roles are empty; a null conv_id is a conversation of its own; turns with equal numbers
are ordered by role and text and repeated rows stay; a turn longer than the budget has a window of its own (never cut);
an empty table gives no window. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import write_table

START, TURN, SAID, END = "<s>", "[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
BUDGET, HISTORY = 1024, 128
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(f"\\{x[0]}")), enumerate(CONTROL, 1), F.replace(text, F.lit("\\"), F.lit("\\0")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, x: F.replace(c, F.lit(f"\\{x[0]}"), F.lit(x[1])), enumerate(CONTROL, 1), text), F.lit("\\0"), F.lit("\\"))


def pre_tokens(text: Column) -> Column:
    """Tokens of a text: up to six letters, three digits or one other sign each."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, window, first (place of its first fresh turn), begun (sum before it), room (for history) and retains.

    turns has conv_id, pos from 0, size, upto and is_system. One array of sums per conversation, no texts.
    """
    sums = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "size", "upto"))).alias("sums"), F.max(F.when((F.col("pos") == 0) & F.col("is_system"), F.col("size")).otherwise(0)).alias("system"))

    def step(state: Column, t: Column) -> Column:
        later = F.size(state["starts"]) > 1
        room = F.lit(budget) - F.when(later, F.col("system") + history).otherwise(F.lit(0))
        opens = (t["upto"] - state["base"] > room) & (t["pos"] > F.element_at(state["starts"], -1))
        return F.struct(F.when(opens, t["upto"] - t["size"]).otherwise(state["base"]).alias("base"), F.when(opens, F.concat(state["starts"], F.array(t["pos"]))).otherwise(state["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("base"), F.array(F.lit(0)).alias("starts"))
    found = sums.withColumn("starts", F.aggregate("sums", zero, step, lambda s: s["starts"]))
    spans = F.transform("starts", lambda first, w: F.struct(w.alias("window"), first.alias("first"), (F.get("sums", first)["upto"] - F.get("sums", first)["size"]).alias("begun"), (F.get("sums", F.coalesce(F.get("starts", w + 1), F.size("sums")) - 1)["upto"]).alias("upto")))
    out = found.select("conv_id", "system", F.explode(spans).alias("s")).select("conv_id", "system", "s.*")
    left = F.lit(budget) - F.col("system") - (F.col("upto") - F.col("begun"))
    return out.select("conv_id", "window", "first", "begun", F.least(F.lit(history), left).alias("room"), ((F.col("window") > 0) & (F.col("system") > 0)).alias("retains"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """conv_id, window, n_repeated (leading turns that repeat), n_tokens, formatted, loss_spans (start from 0 and length in
    code points)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    given = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else F.lit(None).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), given.alias("given"))
    rows = rows.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAID)), "body": escape(F.col("text"))})
    rows = rows.withColumn("size", F.greatest(F.lit(1).cast("long"), F.coalesce("given", pre_tokens(F.concat("head", "body", F.lit(END))))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "size")
    placed = rows.withColumns({"pos": F.row_number().over(order) - 1, "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = write_table(placed.select("conv_id", "pos", "role", "head", "body", "size", "upto", (F.col("role") == SYSTEM_ROLE).alias("is_system")), "chat-turns")
    spans = write_table(_spans(placed.select("conv_id", "pos", "size", "upto", "is_system"), budget, history), "chat-spans")
    written = ["pos", "head", "body", "size", "role"]
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    before = F.col("upto") - F.col("size")
    # fresh: the window whose first turn is the last one at or before the turn
    starts = spans.select(F.col("conv_id").alias("_c"), F.col("first").alias("_p"), "window")
    numbered = placed.join(starts, same("_c") & (F.col("pos") == F.col("_p")), "left")
    fresh = numbered.withColumn("window", F.last("window", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("pos"))).select("conv_id", "window", F.lit(True).alias("fresh"), *written)
    # repeated: turns whose start is at most `room` before the window's; both meet in buckets of the history's size
    step = max(1, history)
    cell = lambda c: F.floor(c / step).cast("long")
    asks = spans.filter("window > 0").select(F.col("conv_id").alias("_c"), "window", "first", "begun", "room", "retains", F.explode(F.sequence(cell(F.col("begun") - step), cell(F.col("begun")))).alias("_b"))
    near = placed.withColumn("_at", cell(before)).join(asks, same("_c") & (F.col("_at") == F.col("_b")))
    repeated = near.filter((F.col("pos") < F.col("first")) & (F.col("begun") - before <= F.col("room")) & ~(F.col("retains") & (F.col("pos") == 0)))
    systems = placed.filter("pos = 0 AND is_system").join(spans.filter("retains").select(F.col("conv_id").alias("_c"), "window"), same("_c"))
    again = repeated.select("conv_id", "window", F.lit(False).alias("fresh"), *written).unionByName(systems.select("conv_id", "window", F.lit(False).alias("fresh"), *written))
    turn = F.struct("pos", "fresh", "head", "body", "size", ((F.col("role") == TARGET_ROLE) & F.col("fresh")).alias("target"))
    grouped = fresh.unionByName(again).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("written"))

    def target(state: Column, t: Column) -> Column:
        spot = F.struct((state["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).alias("length"))
        return F.struct((state["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)).alias("at"), F.when(t["target"], F.concat(state["spans"], F.array(spot))).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return grouped.select(
        "conv_id",
        "window",
        F.size(F.filter("written", lambda t: ~t["fresh"])).alias("n_repeated"),
        F.aggregate("written", F.lit(0).cast("long"), lambda s, t: s + t["size"]).alias("n_tokens"),
        F.concat(F.lit(START), F.array_join(F.transform("written", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")).alias("formatted"),
        F.aggregate("written", none, target, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of those that don't repeat), target (all text under the loss mask), chars."""
    written = F.split(F.substring("formatted", len(START) + 1, 2**31 - 1), END)
    fresh = F.slice(written, F.col("n_repeated") + 1, F.size(written) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        at = F.position(F.lit(SAID.strip()), x)
        return F.struct(unescape(F.substr(x, F.lit(len(TURN) + 1), at - len(TURN) - 2)).alias("role"), unescape(F.substr(x, at + len(SAID) - 1)).alias("text"))

    said = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), F.array_join(said, "").alias("target"), F.char_length("formatted").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = read_windows(windows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.sort_array(F.collect_list(F.struct("window", told.alias("told"), "target")))
    out = read.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n_turns"), parts.alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("parts.target", "")
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("parts.told", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
