"""Operator 10: quality rules, a base rule and a learned decision list. Native: only DataFrame functions.

Sequential covering learns the list from statistics of labelled documents: it grows a conjunction of thresholds by
information gain on two thirds of a bounded sample, prunes it on the other third, keeps it if it is precise enough there,
takes away what it covers and goes on. The list becomes one ordered CASE WHEN over the statistics.

Nulls and empties: a null or empty text has no words and fails the base rule; rows are judged one by one, so null and
repeated doc_ids and further columns don't matter; without labels, or with labels of one kind, the list is empty and only
the base rule decides; an empty table gives an empty result. Ties: a value equal to a threshold is below it, of labels that
are split a document counts as bad if its mean is under one half, and of conditions with equal gain the first counts. Very
long texts are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, SPACES, as_rows, whole_text

#: Labelled rows that the list is learned from, at most; those with the least hash of doc_id are taken.
SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
UPPER = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
WINDOW_WORDS = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word", "distinct_share")


def _without(text: str, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(F.col(text), characters, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics under names with the prefix _q_; no shuffle, no Python."""
    n, h = F.col("_q_n_words"), F.col("_q_hashes")

    def pairs(column: str, step: int) -> Column:
        size = F.size(column) - step
        return F.zip_with(F.slice(column, 1, size), F.slice(column, step + 1, size), lambda a, b: F.xxhash64(a, b))

    out = (
        docs.withColumn("_q_text", whole_text(text))
        .withColumn("_q_trimmed", F.btrim("_q_text", F.lit(SPACES)))
        .withColumn("_q_hashes", F.when(F.col("_q_trimmed") == "", F.array().cast("array<long>")).otherwise(F.transform(F.split("_q_trimmed", f"{SPACE_CLASS}+"), lambda w: F.xxhash64(w))))
        .withColumn("_q_n_words", F.size("_q_hashes").cast("long"))
        .withColumn("_q_distinct", F.size(F.array_distinct("_q_hashes")))
        .withColumn("_q_2", F.when(n >= WINDOW_WORDS, pairs("_q_hashes", 1)))
        .withColumn("_q_4", F.when(n >= WINDOW_WORDS, pairs("_q_2", 2)))
        .withColumn("_q_8", F.when(n >= WINDOW_WORDS, pairs("_q_4", 4)))
        # only texts in which some window comes twice need the places of windows
        .withColumn("_q_twice", F.coalesce(F.size(F.array_distinct("_q_8")) < F.size("_q_8"), F.lit(False)))
        .withColumn("_q_sorted", F.when(F.col("_q_twice"), F.sort_array(F.transform("_q_8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn("_q_places", F.when(F.col("_q_twice"), F.sort_array(F.filter(F.transform("_q_sorted", lambda x, i: F.when((F.get("_q_sorted", i - 1)["h"] == x["h"]) | (F.get("_q_sorted", i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))))
        .withColumn("_q_n_repeat_words", F.when(F.col("_q_twice"), F.aggregate(F.transform("_q_places", lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("_q_places", i + 1) - p, F.lit(WINDOW_WORDS)))), F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long")))
        .withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("_q_n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
        .withColumn("_q_word_chars", F.char_length(F.translate("_q_text", SPACES, "")).cast("long"))
        .withColumn("_q_n_symbols", _without("_q_text", SYMBOLS).cast("long"))
        .withColumn("_q_n_upper", _without("_q_text", UPPER))
        .withColumn("_q_n_marks", _without("_q_text", "!?"))
    )
    words = F.greatest(n, F.lit(1))
    shares = {
        "mean_word_chars": F.col("_q_word_chars") / words,
        "symbols_per_word": F.col("_q_n_symbols") / words,
        "dup_line_share": F.col("_q_n_dup_lines") / F.greatest(F.size("_q_lines"), F.lit(1)),
        "repeat_share": F.col("_q_n_repeat_words") / words,
        "upper_share": F.col("_q_n_upper") / F.greatest(F.col("_q_word_chars"), F.lit(1)),
        "marks_per_word": F.col("_q_n_marks") / words,
        "distinct_share": F.col("_q_distinct") / words,
    }
    made = {**{c: F.col(f"_q_{c}") for c in BASE}, **shares}
    # a generator of one row: what filters on the statistics stays above it, else the optimizer would copy them all below
    row = F.explode(F.array(F.struct(*(v.alias(k) for k, v in made.items()))))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, row.alias("_q")).select(*kept, *(F.col(f"_q.{k}").alias(f"_q_{k}") for k in made))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        c = F.col(f"_q_{self.feature}").cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, columns: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(columns) for c in rule), np.ones(len(next(iter(columns.values()))), bool))


def _best_condition(columns: dict[str, np.ndarray], bad: np.ndarray, thresholds: int) -> tuple[float, Condition | None]:
    """The condition with the greatest information gain on the rows given."""
    p0, n0, best, found = bad.sum(), (~bad).sum(), 1e-9, None
    before = np.log2(p0 / (p0 + n0))
    for name, x in columns.items():
        cuts = np.unique(np.quantile(x, np.linspace(0, 1, thresholds)))
        cuts = (cuts[1:] + cuts[:-1]) / 2
        order = np.argsort(x, kind="stable")
        below = np.searchsorted(x[order], cuts, "right")
        bads = np.concatenate([[0], np.cumsum(bad[order])])
        for above in (False, True):
            p = (p0 - bads[below]) if above else bads[below]
            n = (len(x) - below - p) if above else below - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            if len(gain) and gain.max() > best:
                best, found = float(gain.max()), Condition(name, above, float(cuts[int(gain.argmax())]))
    return best, found


def learn_decision_list(columns: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, thresholds: int = 128, min_precision: float = 0.97, min_covered: int = 3) -> list[Rule]:
    """Sequential covering: conjunctions that single out bad rows, most useful first."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    prune = np.arange(len(bad)) % 3 == 2
    take = lambda keep: ({k: v[keep] for k, v in columns.items()}, bad[keep])
    (grow_x, grow_bad), (prune_x, prune_bad) = take(~prune), take(prune)
    while len(rules) < max_rules and grow_bad.any():
        rule: Rule = ()
        x, y = grow_x, grow_bad
        while len(rule) < max_conditions and not y.all():
            _, condition = _best_condition(x, y, thresholds)
            if condition is None:
                break
            rule = (*(c for c in rule if (c.feature, c.above) != (condition.feature, condition.above)), condition)
            inside = condition.holds(x)
            x, y = {k: v[inside] for k, v in x.items()}, y[inside]
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            got = _covered(r, prune_x)
            p, n = int(prune_bad[got].sum()), int((~prune_bad[got]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=worth)
        p_n, p = worth(rule)
        if (p_n + 1) / 2 < min_precision or p < min_covered:
            break
        rules.append(rule)
        grow_keep, prune_keep = ~_covered(rule, grow_x), ~_covered(rule, prune_x)
        grow_x, grow_bad = {k: v[grow_keep] for k, v in grow_x.items()}, grow_bad[grow_keep]
        prune_x, prune_bad = {k: v[prune_keep] for k, v in prune_x.items()}, prune_bad[prune_keep]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A list learned from at most sample_rows labelled documents; only their statistics reach the driver."""
    votes = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("_quality"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(chosen), F.col("_doc") == F.col("doc_id"))
    rows = with_statistics(sample.select("_doc", "text", "_quality")).select(F.xxhash64(F.lit(7919), "_doc").alias("_place"), "_quality", *(F.col(f"_q_{f}").cast("double").alias(f) for f in FEATURES)).collect()
    rows.sort(key=tuple)  # in a seeded order, so that the part that prunes is a fair sample
    columns = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_decision_list(columns, np.array([r["_quality"] < 0.5 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, from 1, else 0: an ordered conditional expression."""
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        condition = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, statistics, base_failed, rule (the one that fired, else 0) and kept of each row."""
    return (
        with_statistics(docs.select("doc_id", "text"))
        .select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in BASE), base_failed().alias("base_failed"), verdict(rules).alias("rule"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    rules = fit(docs, labels)
    rows = as_rows(docs).withColumn("text", F.col("_row.text"))
    return with_statistics(rows).filter(~base_failed() & (verdict(rules) == 0)).select("_row.*")
