"""A video's log as text for a reader with little room: its identities, counts by type, and the first rows of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_EVENTS = 700
EVENT_COLUMNS = ("id", "type", "start", "end", "subject", "zone", "other", "details", "confidence")
IDENTITY_COLUMNS = ("gid", "kind", "first_seen", "last_seen")


def _cell(c: Column, kind: str) -> Column:
    """A field of comma-separated text: numbers with two decimals, text quoted where it has to be, nothing for null."""
    if kind in ("double", "float"):
        text = F.format_string("%.2f", c.cast("double"))
        return F.when(c.isNull(), "").otherwise(text)
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _lines(df: DataFrame, columns: tuple[str, ...], order: list[Column], most: int | None, name: str) -> DataFrame:
    """video_id, the lines of its first rows in order as one text, and how many rows it has.

    The rank is cut to `most` before rows are gathered, so a video of any length brings at most that many to one place.
    """
    kinds = dict(df.dtypes)
    line = F.concat_ws(",", *(_cell(F.col(c), kinds[c]) for c in columns))
    ranked = df.select("video_id", line.alias("_line"), F.row_number().over(Window.partitionBy("video_id").orderBy(*order)).alias("_n"))
    first = ranked.filter(F.col("_n") <= most) if most else ranked
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    head = F.lit(",".join(columns))
    return first.groupBy("video_id").agg(F.concat(head, F.lit("\n"), text).alias(name))


def context(log: DataFrame, identities: DataFrame, most: int = MOST_EVENTS, most_identities: int = 200) -> DataFrame:
    """video_id and context: what is known of each video of the log, its first `most` events in the log's order."""
    counts = log.groupBy("video_id", "type").agg(F.count(F.lit(1)).alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "type", "n"))), lambda x: F.concat(x["type"], F.lit(": "), x["n"].cast("string")))
    totals = counts.groupBy("video_id").agg(F.array_join(told, ", ").alias("_counts"), F.sum("n").alias("_all"))
    events = _lines(log, EVENT_COLUMNS, [F.col("start"), F.col("id")], most, "_events")
    people = _lines(identities, IDENTITY_COLUMNS, [F.col("first_seen"), F.col("gid")], most_identities, "_people")
    head = F.when(F.col("_all") > most, F.concat(F.lit(f"## Events (first {most} of "), F.col("_all").cast("string"), F.lit(")\n"))).otherwise("## Events\n")
    text = F.concat(F.lit("## Identities\n"), F.coalesce("_people", F.lit("none")), F.lit("\n## Event counts\n"), "_counts", F.lit("\n"), head, "_events")
    return totals.join(events, "video_id").join(people, "video_id", "left").select("video_id", text.alias("context"))
