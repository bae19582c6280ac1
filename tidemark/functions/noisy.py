"""JSON and code in text that has other things around it, as column expressions.

A text is cut at brackets, quotes and backslashes; from each opening bracket a fold over these few pieces finds where it
closes, quotes and escapes minded. What lies between is JSON exactly if Spark's parser takes it, as JSON that begins at a
bracket can end nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = r'(?<=[{}\[\]"\\])|(?=[{}\[\]"\\])'


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: within a lambda Spark computes an expression anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _closed(pieces: Column, at: Column) -> Column:
    """The text from piece number at, an opening bracket, to where it closes; null if it doesn't."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        quote = (piece == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        escaped = s["quoted"] & (piece == "\\") & ~s["escaped"]
        new = F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), escaped.alias("escaped"), (depth == 0).alias("done"))
        return F.when(s["done"], s).otherwise(new)

    def within(most: Column) -> Column:
        found = F.aggregate(F.slice(pieces, at + 1, most), start, step)
        return _bound(found, lambda s: F.when(s["done"], F.array_join(F.slice(pieces, at + 1, s["n"]), "")))

    # most brackets close soon, and a fold can't stop early: few pieces are asked before all that follow
    rest = F.size(pieces) - at
    return F.coalesce(within(F.least(rest, F.lit(64))), F.when(rest > 64, within(F.least(rest, F.lit(2048)))), F.when(rest > 2048, within(rest)))


def _first_in(chunk: Column) -> Column:
    """The first object of a chunk, else its first array."""
    def first(pieces: Column, opener: str) -> Column:
        places = F.filter(F.transform(pieces, lambda p, i: F.when(p == opener, i)), lambda i: i.isNotNull())
        whole = lambda i: _bound(_closed(pieces, i), lambda c: F.when(F.try_parse_json(c).isNotNull(), c))
        # what has been found stays, and no later bracket is asked
        return F.aggregate(places, F.lit(None).cast("string"), lambda found, i: F.when(found.isNotNull(), found).otherwise(whole(i)))

    return _bound(F.split(chunk, _PIECES), lambda pieces: F.coalesce(first(pieces, "{"), first(pieces, "[")))


def first_json(text: Column) -> Column:
    """The first JSON object of the text, else its first array; blocks marked as json are asked before the whole text."""
    marked = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1)), _first_in), lambda c: c.isNotNull())
    return F.coalesce(F.get(marked, F.lit(0)), _first_in(text))


def code_block(text: Column, function: str = "def answer") -> Column:
    """The last block marked as python that has the function, else the last one, with one line end; null without a block."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)\s*\n(.*?)```"), F.lit(1))
    of = lambda found: F.when(F.size(found) > 0, F.element_at(found, -1))
    chosen = F.coalesce(of(F.filter(blocks, lambda b: F.contains(b, F.lit(function)))), of(blocks))
    return F.concat(F.regexp_replace(chosen, r"^\s+|\s+$", ""), F.lit("\n"))
