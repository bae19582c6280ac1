"""Operator 7: SimHash fingerprints. Native: only DataFrame functions.

Every word votes with its weight on the bits of its hash; 32-bit lanes in one long count two bits at once, so a document
is one sum over its words. Words of up to four letters, mostly function words that all texts share, weigh 1, longer ones
the square of their length less two, up to 64. Equal bags of words have equal fingerprints.

Fingerprints within a Hamming radius are found exactly by permuted block tables: of B blocks, at least B - radius are equal,
so each choice of B - radius blocks is the key of one table. Equal fingerprints are one class before that, so a group of
copies is one row.

Nulls and empties: a null or empty text has no votes and the fingerprint of zeros; null doc_ids come last; rows with equal
doc_ids are ordered by text; a table of one row has itself as its next; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACE_CLASS, whole_text, width, write_table

#: Bits of a fingerprint: a multiple of 64.
BITS = 128
LANES = (1 << 32) + 1
#: Ranges of doc_id for each shuffle partition, for even partitions.
RANGES = 4


def _term_weight(word: Column) -> Column:
    n = F.char_length(word)
    return F.when(word.isNull() | (n == 0), 0).when(n <= 4, 1).otherwise(F.pow(F.least(n - 2, F.lit(8)), F.lit(2))).cast("long")


def votes(rows: DataFrame, keys: list[str], text: str, bits: int = BITS) -> DataFrame:
    """keys and the fingerprint's words _f0, _f1, ... (longs) of each group of equal keys."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(text), f"{SPACE_CLASS}+")).alias("_word"))
    hashed = words.select(*keys, _term_weight(F.col("_word")).alias("_w"), *(F.xxhash64(F.lit(k), "_word").alias(f"_h{k}") for k in range(bits // 64)))
    sums = [F.sum(F.col("_w") * F.shiftrightunsigned(f"_h{k}", i).bitwiseAND(F.lit(LANES))).alias(f"_s{k}_{i}") for k in range(bits // 64) for i in range(32)]
    counted = hashed.groupBy(*keys).agg(F.sum("_w").alias("_all"), *sums)

    def word(k: int) -> Column:
        bit = lambda v, i: F.shiftleft((2 * v > F.col("_all")).cast("long"), i)
        halves = [bit(F.col(f"_s{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i).bitwiseOR(bit(F.shiftrightunsigned(f"_s{k}_{i}", 32), i + 32)) for i in range(32)]
        return reduce(lambda a, b: a.bitwiseOR(b), halves)

    return counted.select(*keys, *(word(k).alias(f"_f{k}") for k in range(bits // 64)))


def as_hex(words: list[Column]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in words)))


def words_of(fingerprint: Column, bits: int = BITS) -> list[Column]:
    """The longs of a hexadecimal fingerprint, in two halves each as conv() is unsigned."""
    half = lambda i: F.conv(F.substr(fingerprint, F.lit(i * 8 + 1), F.lit(8)), 16, 10).cast("long")
    return [F.shiftleft(half(2 * k), 32).bitwiseOR(half(2 * k + 1)) for k in range(bits // 64)]


def distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)))


def _cuts(docs: DataFrame, ranges: int) -> list[int]:
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * ranges))).alias("c")).first() if shares else None
    return sorted(set(found.c or [])) if found else []


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at most doc_id, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    array = F.array(*(F.lit(c).cast("long") for c in cuts))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= doc_id, at + s).otherwise(at))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """range, pos, guest, doc_id, text and next_text: the text of the next row by falling doc_id, after the last the first's.

    Rows are dealt by ranges of doc_id; the first row of each range is a guest at the end of the range before it. The ranges'
    ends, two numbers each, are all that reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = _cuts(ids, ranges or RANGES * width(docs.sparkSession))
    tops = sorted(ids.groupBy(_range_of(F.col("doc_id"), cuts).alias("r")).agg(F.max("doc_id").alias("top")).collect(), reverse=True)
    # falling: the first row of one range follows the last of the range above it
    host = {r.r: tops[i - 1].r for i, r in enumerate(tops)}
    top = {r.r: r.top for r in tops}
    slots = range(len(cuts) + 1)
    hosts = F.array(*(F.lit(host.get(r)).cast("int") for r in slots))
    ends = F.array(*(F.lit(top.get(r)).cast("long") for r in slots))
    placed = rows.withColumn("range", _range_of(F.col("doc_id"), cuts).cast("int"))
    seat = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    is_first = F.get(ends, F.col("range")).eqNullSafe(F.col("doc_id"))
    seats = F.when(is_first, F.array(seat(F.col("range"), False), seat(F.get(hosts, F.col("range")), True))).otherwise(F.array(seat(F.col("range"), False)))
    dealt = placed.withColumn("seat", F.explode(seats)).select("seat.range", "seat.guest", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.select("range", F.row_number().over(order).alias("pos"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprint_edits(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, of its edited text (its last half replaced by the next text's start), and their likeness."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), F.char_length("text") - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    base = with_next(docs).withColumn("edited", edited)
    keys, words = ["range", "pos", "_edit"], [f"_f{k}" for k in range(bits // 64)]
    both = base.select("range", "pos", F.posexplode(F.when(F.col("guest"), F.array("text")).otherwise(F.array("text", "edited"))).alias("_edit", "_text"))
    found = votes(both, keys, "_text", bits).groupBy("range", "pos").agg(*(F.max(F.when(F.col("_edit") == e, F.col(w))).alias(f"{w}_{e}") for w in words for e in (0, 1)))
    after = Window.partitionBy("range").orderBy("pos")
    found = found.withColumns({f"{w}_2": F.lead(f"{w}_0").over(after) for w in words})
    about = base.filter(~F.col("guest")).select("range", "pos", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    part = lambda e: [F.col(f"{w}_{e}") for w in words]
    likeness = lambda e: 1 - distance(part(0), part(e)) / F.lit(float(bits))
    return about.join(found, ["range", "pos"]).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(part(0)).alias("fingerprint"), as_hex(part(1)).alias("edited_fingerprint"), likeness(1).alias("near_edited"), likeness(2).alias("near_next")
    )


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint of each row."""
    rows = docs.select(F.col("doc_id"), whole_text().alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    found = votes(rows, ["_row", "doc_id"], "_text", bits)
    return found.select("doc_id", as_hex([F.col(f"_f{k}") for k in range(bits // 64)]).alias("fingerprint"))


def _tables(radius: int, blocks: int, bits: int) -> list[tuple[int, ...]]:
    if blocks <= radius or blocks % (bits // 64):
        raise ValueError("blocks must exceed the radius and divide evenly over the fingerprint's longs")
    return list(combinations(range(blocks), blocks - radius))


def _block(words: list[Column], b: int, each: int) -> Column:
    """Block b of a fingerprint's words, `each` blocks a word."""
    edges = [64 * i // each for i in range(each + 1)]
    return F.shiftrightunsigned(words[b // each], edges[b % each]).bitwiseAND(F.lit((1 << edges[b % each + 1] - edges[b % each]) - 1 if each > 1 else -1))


def _keys(words: list[Column], radius: int, blocks: int, bits: int) -> Column:
    each = blocks // (bits // 64)
    return F.array(*(F.xxhash64(F.lit(t), *(_block(words, b, each) for b in chosen)) for t, chosen in enumerate(_tables(radius, blocks, bits))))


def near_classes(rows: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """All pairs a < b of different fingerprints within the radius, each once, with their distance.

    rows: doc_id and fingerprint. A document belongs to the class of its fingerprint; copies aren't expanded into pairs.
    """
    classes = rows.select("fingerprint").distinct()
    return _matches(classes, classes, radius, blocks, bits).filter(F.col("_q") < F.col("fingerprint")).select(F.col("_q").alias("a"), F.col("fingerprint").alias("b"), "distance")


def _matches(queries: DataFrame, rows: DataFrame, radius: int, blocks: int, bits: int) -> DataFrame:
    """Pairs (_q, fingerprint, distance) of a fingerprint that is asked about and one of rows within the radius, each once.

    A pair meets in every table whose blocks are equal in both, but counts in the first of them alone, which its own bits
    tell; so nothing has to be made distinct. queries and rows have the column fingerprint, each once.
    """
    tables, each = _tables(radius, blocks, bits), blocks // (bits // 64)
    words = bits // 64
    keyed = lambda df, p: df.select(F.col("fingerprint").alias(p), *(w.alias(f"{p}{i}") for i, w in enumerate(words_of(F.col("fingerprint"), bits)))).select(p, *(f"{p}{i}" for i in range(words)), F.posexplode(_keys([F.col(f"{p}{i}") for i in range(words)], radius, blocks, bits)).alias("_t", "_key"))
    asked, held = keyed(queries, "_q"), keyed(rows, "_h").withColumnsRenamed({"_t": "_ht", "_key": "_hkey"})
    a, b = [F.col(f"_q{i}") for i in range(words)], [F.col(f"_h{i}") for i in range(words)]
    equal = reduce(lambda x, y: x + y, (F.when(_block([x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)], i, each) == 0, 1 << i).otherwise(0) for i in range(blocks)))
    first = {}
    for m in range(1 << blocks):
        same = tuple(i for i in range(blocks) if m >> i & 1)
        first[m] = tables.index(same[: blocks - radius]) if len(same) >= blocks - radius else -1
    firsts = F.array(*(F.lit(first[m]) for m in range(1 << blocks)))
    met = asked.join(held, (F.col("_key") == F.col("_hkey")) & (F.col("_t") == F.col("_ht")))
    return met.withColumn("distance", distance(a, b)).filter((F.col("distance") <= radius) & (F.get(firsts, equal) == F.col("_t"))).select("_q", F.col("_h").alias("fingerprint"), "distance")


def search(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """Fingerprints of rows within the radius of each query's: doc_id of the query, fingerprint, distance."""
    found = _matches(queries.select("fingerprint").distinct(), rows.select("fingerprint").distinct(), radius, blocks, bits)
    return queries.select("doc_id", F.col("fingerprint").alias("_asked")).distinct().join(found, F.col("_asked") == F.col("_q")).select("doc_id", "fingerprint", "distance")


def count_near(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """fingerprint and n_near of each fingerprint of queries: how many other fingerprints of rows lie within the radius.

    Copies are one fingerprint; a key that very many share is dealt by the join, as only counts leave it.
    """
    asked = queries.select("fingerprint").distinct()
    found = _matches(asked, rows.select("fingerprint").distinct(), radius, blocks, bits).filter(F.col("_q") != F.col("fingerprint"))
    counts = found.groupBy("_q").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, F.col("fingerprint") == F.col("_q"), "left").select("fingerprint", F.coalesce("n", F.lit(0).cast("long")).alias("n_near"))


def fingerprint_search(docs: DataFrame, every: int = 50, radius: int = 3, bits: int = BITS) -> DataFrame:
    """fingerprint_edits, and for the documents whose id `every` divides n_near: the other fingerprints of all documents
    within the radius of theirs, found by the block tables; null for the others."""
    found = write_table(fingerprint_edits(docs, bits), "fingerprints")
    asks = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    near = write_table(count_near(found.filter(asks), found, radius, bits=bits), "near").select(F.col("fingerprint").alias("_q"), "n_near")
    return found.join(near, (F.col("fingerprint") == F.col("_q")) & asks, "left").drop("_q")
