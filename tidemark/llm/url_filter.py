"""Operator 5: URL filter, longest-match rules and gradient-boosted trees on lexical features.

Trees are boosted with logistic loss over histogram bins of a bounded sample of labelled URLs and become one arithmetic
expression of CASE WHENs over features that Spark computes itself: lengths, depth, digit ratio, entropy of the host's
characters, parameter counts, and how often the host's suffix, of one label and of two, and its worst word were bad among the
labelled URLs. Those are counted over all of them and joined, once a distinct host, from a table with one row a suffix or word.
A labelled URL never sees itself or its host in these counts: hosts fall into FOLDS folds, and training takes the counts of
the other folds. Each tree sees a seeded part of the features, so that no single one can carry the model.

Nulls and empties: a null URL or one without `://` has an empty host and path, fits no rule and gets the model's verdict;
page_ids may be null or repeated, rows are judged one by one, and equal URLs alike; without labels of both kinds the model
allows everything; an empty table gives an empty result. Ties: of rules of one length the one last by name wins, equal
labelled URLs count as one for the trees, bad if at least half of them are; a margin equal to the cut is allowed. A very long
URL is read whole. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

#: Labelled URLs that trees are fitted on, at most; those with the least hash are taken.
SAMPLE_ROWS = 20_000
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "host_digit_share", "hyphens", "host_entropy", "n_parameters", "longest_label", "vowel_share", "suffix_bad", "domain_bad", "word_bad")
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Folds of hosts for statistics out of sample, least letters of a word, and the share of the features that a tree sees.
FOLDS, WORD_LETTERS, COLUMN_SHARE = 5, 3, 0.6
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-."


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    after = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": lower_ascii(host), "path": path})


def rule_columns(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest comes last and so is asked first
        host, _, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{rest}" if _ else ""))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """The last label of a host and its last two, as an array; one that has no more is its own."""
    return F.array(F.concat(F.lit("."), F.substring_index(host, ".", -1)), F.substring_index(host, ".", -2))


def names_of(host: Column) -> Column:
    """What statistics a host shares, as structs of the feature's number and a name: both suffixes, and its words once each."""
    words = F.array_distinct(F.filter(F.split(host, r"[.\-]"), lambda w: F.char_length(w) >= WORD_LETTERS))
    one = lambda i, name: F.struct(F.lit(i).alias("i"), name.alias("name"))
    found = suffixes(host)
    return F.concat(F.array(one(0, found[0]), one(1, found[1])), F.transform(words, lambda w: one(2, F.concat(F.lit("word "), w))))


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def _shares(df: DataFrame, suffix_bad: DataFrame) -> DataFrame:
    """_host and the array _known of its shares by feature, the worst word's last; null where nothing is known.

    Asked once a distinct host, so a host with many pages is one row here. suffix_bad may have _fold: then a host takes the
    shares that leave its own fold out.
    """
    asked = df.select(F.col("host").alias("_host")).distinct().select("_host", fold_of(F.col("_host")).alias("_own"), F.explode(names_of(F.col("_host"))).alias("_n"))
    same = F.col("_n.name") == F.col("_suffix")
    if "_fold" in suffix_bad.columns:
        same &= F.col("_own") == F.col("_fold")
    found = asked.join(suffix_bad, same, "left").groupBy("_host")
    return found.agg(F.array(*(F.max(F.when(F.col("_n.i") == i, F.col("_share"))) for i in range(3))).alias("_known"))


def with_features(df: DataFrame, url: str = "url", suffix_bad: DataFrame | None = None, prior: float = 0.5) -> DataFrame:
    """Adds the features under names with the prefix _u_; needs host and path. suffix_bad is (_suffix, _share), or with _fold."""
    u, host = F.coalesce(F.col(url), F.lit("")), F.col("host")
    n, h = F.char_length(u), F.char_length("host")
    count = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    shares = [per(count(host, ch), h) for ch in ALPHABET]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares[1:]), F.when(shares[0] > 0, -shares[0] * F.log2(shares[0])).otherwise(0.0))
    query = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"\?([^#]*)", 1)).otherwise("")
    known = [F.lit(prior)] * 3
    if suffix_bad is not None:
        df = df.join(_shares(df, suffix_bad), F.col("host") == F.col("_host"), "left")
        known = [F.coalesce(F.get("_known", F.lit(i)), F.lit(prior)) for i in range(3)]
    made = {
        "url_chars": n,
        "host_chars": h,
        "path_chars": F.char_length("path"),
        "depth": count(F.col("path"), "/"),
        "labels": count(host, ".") + 1,
        "digit_share": per(count(u, "0123456789"), n),
        "host_digit_share": per(count(host, "0123456789"), h),
        "hyphens": count(host, "-"),
        "host_entropy": entropy,
        "n_parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))),
        "vowel_share": per(count(host, "aeiou"), h),
        "suffix_bad": known[0],
        "domain_bad": known[1],
        "word_bad": known[2],
    }
    return df.withColumns({f"_u_{k}": v.cast("double") for k, v in made.items()}).drop("_host", "_known")


@dataclass
class Tree:
    """A split with two branches, or a leaf if feature is None."""

    value: float
    feature: str | None = None
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(f"_u_{self.feature}") <= F.lit(self.threshold), self.low.column()).otherwise(self.high.column())

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] <= self.threshold, self.low.predict(x), self.high.predict(x))


@dataclass
class Model:
    start: float = -20.0
    trees: list[Tree] = field(default_factory=list)
    suffix_bad: DataFrame | None = None
    prior: float = 0.5

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(self.start))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return self.start + sum(t.predict(x) for t in self.trees)


def _grow(bins: dict[str, np.ndarray], cuts: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float, least: int) -> Tree:
    leaf = Tree(-rate * g.sum() / (h.sum() + ridge))
    if not depth or len(g) < 2 * least:
        return leaf
    best, choice, whole = 1e-6, None, g.sum() ** 2 / (h.sum() + ridge)
    for name, b in bins.items():
        k = len(cuts[name])
        if not k:
            continue
        gs, hs, ns = (np.cumsum(np.bincount(b, w, k + 1))[:-1] for w in (g, h, None))
        gain = np.where((ns >= least) & (len(g) - ns >= least), gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole, -1.0)
        if gain.max() > best:
            best, choice = float(gain.max()), (name, int(gain.argmax()))
    if choice is None:
        return leaf
    name, at = choice
    low = bins[name] <= at
    side = lambda m: _grow({k: v[m] for k, v in bins.items()}, cuts, g[m], h[m], depth - 1, rate, ridge, least)
    return Tree(leaf.value, name, float(cuts[name][at]), side(low), side(~low))


def boost(x: dict[str, np.ndarray], bad: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, n_bins: int = 64, ridge: float = 1.0, least: int = 5, column_share: float = COLUMN_SHARE, seed: int = 5) -> Model:
    """Gradient boosting with logistic loss over histogram bins; each tree sees a seeded part of the features."""
    if not len(bad) or bad.all() or not bad.any():
        return Model()
    cuts = {k: (lambda q: (q[1:] + q[:-1]) / 2)(np.unique(np.quantile(v, np.linspace(0, 1, n_bins)))) for k, v in x.items()}
    bins = {k: np.searchsorted(cuts[k], v, "left") for k, v in x.items()}
    share = bad.mean()
    model = Model(float(np.log(share / (1 - share))))
    margin, rng = np.full(len(bad), model.start), np.random.default_rng(seed)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        seen = sorted(rng.choice(len(x), max(1, round(column_share * len(x))), replace=False).tolist())
        tree = _grow({k: bins[k] for i, k in enumerate(x) if i in seen}, cuts, p - bad, p * (1 - p), depth, rate, ridge, least)
        if tree.feature is None:
            continue
        model.trees.append(tree)
        margin += tree.predict(x)
    return model


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled URLs (url, bad): features of at most sample_rows reach the driver; suffix counts stay a table.

    The sample is first cut at the hash below which a little more than sample_rows are expected, so no task gathers more.
    """
    rows = labelled.filter("bad IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("b"))
    rows = write_table(with_parts(rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("url"), 1))), "labelled")
    named = rows.select("n", "b", fold_of(F.col("host")).alias("_fold"), F.explode(names_of(F.col("host"))).alias("_n"))
    by_fold = write_table(named.groupBy(F.col("_n.name").alias("_suffix"), "_fold").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "suffixes")
    whole = rows.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("urls")).first()
    prior = ((whole.b or 0) + 1) / ((whole.n or 0) + 2)
    share = lambda b, n: ((b + 10 * prior) / (n + 10)).alias("_share")
    totals = write_table(by_fold.groupBy("_suffix").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b")), "suffix-totals")
    table = totals.select("_suffix", share(F.col("all_b"), F.col("all_n")))
    others = by_fold.join(totals, "_suffix").select("_suffix", "_fold", share(F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n")))
    expected = sample_rows + 10 * int(sample_rows**0.5) + 100
    near = rows.filter(F.col("_hash") <= int((1 << 63) * min(1.0, expected / max(whole.urls, 1))) - 1)
    chosen = near.orderBy("_hash", "url").limit(sample_rows)
    got = with_features(chosen, "url", others, prior).select("n", "b", *(f"_u_{f}" for f in FEATURES)).collect()
    model = boost({f: np.array([r[f"_u_{f}"] for r in got], float) for f in FEATURES}, np.array([2 * r.b >= r.n for r in got], bool))
    model.suffix_bad, model.prior = table, prior
    return model


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = RULES, cut: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's margin (log-odds of bad) of each row."""
    rule, said = rule_columns(rules)
    rows = with_features(with_parts(pages.select("page_id", "url")), "url", model.suffix_bad, model.prior).withColumn("margin", model.margin())
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("margin") > cut, "block").otherwise("allow")).alias("verdict"), "margin")


#: Words that mark a host as bad when they stand between dots or hyphens; they label URLs for training.
BAD_WORDS = ("ads", "spam", "bets", "casino", "pills", "porn", "xxx", "sex", "adult", "warez", "torrent", "viagra", "loan", "loans", "replica")


def label_by_words(pages: DataFrame, words: tuple[str, ...] = BAD_WORDS, variants: bool = True) -> DataFrame:
    """url and bad of each page: bad if a part of its host is one of the words.

    With variants, each URL stands beside ones whose longest label is cut in two, has its parts in reverse or only one of them,
    in its own place and in two shorter and longer hosts, labelled by the same words. So the look of a host (a hyphen, its length) tells nothing that its words don't, whatever the
    bad hosts of the pages happen to look like.
    """
    bad = lambda host: F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words))).cast("int")
    rows = with_parts(pages.select("url")).filter("url IS NOT NULL")
    told = rows.select("url", bad(F.col("host")).alias("bad"))
    if not variants:
        return told
    label = F.element_at(F.array_sort(F.transform(F.split("host", r"\."), lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), 1)["x"]
    half = F.floor(F.char_length("_label") / 2).cast("int")
    split = F.concat_ws("-", F.substr(F.col("_label"), F.lit(1), half), F.substr(F.col("_label"), half + 1))
    parts = F.split("_label", "-")
    made = F.when(F.size(parts) > 1, F.concat(parts, F.array(F.concat_ws("-", F.reverse(parts))))).when(half > 2, F.array(split)).otherwise(F.array().cast("array<string>"))
    hosts = rows.withColumn("_label", label).select("path", "host", "_label", F.explode(F.concat(F.array("_label"), made)).alias("_made")).filter("_made <> ''")
    places = F.array(F.replace("host", "_label", "_made"), F.concat_ws(".", "_made", F.substring_index("host", ".", -1)), F.concat_ws(".", F.lit("www"), "_made", F.substring_index("host", ".", -2)))
    other = hosts.select("path", "host", F.explode(places).alias("_host")).filter("_host <> host").select("path", F.col("_host").alias("host"))
    return told.unionByName(other.select(F.concat(F.lit("http://"), "host", "path").alias("url"), bad(F.col("host")).alias("bad")))


def auc(margins: np.ndarray, bad: np.ndarray) -> float:
    """The share of pairs of a bad and a good row that the margins put in order; ties count half."""
    order = np.argsort(margins, kind="stable")
    values, at, n = np.unique(margins[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    b = bad[order]
    return float((ranks[b].sum() - b.sum() * (b.sum() + 1) / 2) / (b.sum() * (~b).sum()))
