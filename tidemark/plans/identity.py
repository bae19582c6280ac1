"""Tracks to identities: track summaries, filters, hand-over candidates and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as g
from tidemark.functions import vectors as v
from tidemark.functions.text import kind_of, prefix_of
from tidemark.operators import folds
from tidemark.sources.tables import cut

BOX = ("x1", "y1", "x2", "y2")


def summarise(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, track, cls (mode, least on ties), kind, start, end, n, conf, first_box and last_box of each track."""
    box, every = F.struct(*BOX), [*keys, "track"]
    by_class = hits.groupBy(*every, "cls").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("start"), F.max("t").alias("end"), F.sum("conf").alias("conf"), F.count("conf").alias("told"), F.min_by(box, "t").alias("first_box"), F.max_by(box, "t").alias("last_box"))
    mode = F.min(F.struct((-F.col("c")).alias("o"), "cls"))["cls"].alias("cls")
    out = by_class.groupBy(*every).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("c").alias("n"), F.try_divide(F.sum("conf"), F.sum("told")).alias("conf"), F.min_by("first_box", "start").alias("first_box"), F.max_by("last_box", "end").alias("last_box"), mode)
    return out.select(*every, "start", "end", "n", "conf", "first_box", "last_box", "cls", kind_of(F.col("cls")).alias("kind"))


def keep_solid(tracks: DataFrame, least_seconds: float = 0.6, least_hits: int = 4) -> DataFrame:
    """Without flicker, and without what is both short and weak."""
    long = F.col("end") - F.col("start")
    # a mean's last digits follow the order of its rows; rounded, a track at the very limit isn't weak in any order
    return tracks.filter(~((long < least_seconds) & (F.col("n") < least_hits)) & ~((long < 3.0) & (F.round("conf", 9) < 0.40)))


def solid_hits(hits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Track summaries and their hits without flicker, short weak tracks, duplicates and ghosts.

    Hits are summed up and compared where they lie: hits that are dealt by keys are not shuffled, tracks and who lies in whom
    are. Each step is a written table, which keeps the plans of what follows small.
    """
    tracks = cut(keep_solid(summarise(hits, keys)), "tracks")
    mine = tracks.select(*keys, "track", "kind", "n", "conf", (F.col("end") - F.col("start")).alias("long"))
    others = tracks.select(*keys, F.col("track").alias("other"), F.col("kind").alias("other_kind"))
    inside = folds.nested(hits, keys, "t", 0.5).join(mine, [*keys, "track"]).join(others, [*keys, "other"])
    inside = cut(inside.filter(_covers() | _hides()), "inside")
    gone = cut(folds.covered_tracks(inside.filter(_covers()), keys, "t", 0.6), "duplicates")
    tracks, inside = (x.join(gone, [*keys, "track"], "left_anti") for x in (tracks, inside))
    hidden = ghosts(inside.join(gone.withColumnRenamed("track", "other"), [*keys, "other"], "left_anti"), keys)
    tracks = tracks.join(cut(hidden, "ghosts"), [*keys, "track"], "left_anti")
    return tracks, hits.join(tracks.select(*keys, "track"), [*keys, "track"], "left_semi")


def _covers() -> Column:
    """A short track lies in one of its kind."""
    return (F.col("long") <= 4.0) & (F.col("kind") == F.col("other_kind")) & (F.col("share") > 0.6)


def _hides() -> Column:
    """A weak person lies in a vehicle, or a static thing in a person."""
    person, static = F.col("kind") == "person", F.col("track") >= 100000
    in_car = person & ((F.col("conf") < 0.45) | static) & (F.col("other_kind") == "vehicle") & (F.col("share") > 0.8)
    return in_car | (static & (F.col("other_kind") == "person") & (F.col("share") > 0.5))


def ghosts(inside: DataFrame, keys: list[str]) -> DataFrame:
    """keys and track of weak people inside vehicles and of static things inside people, most of the time.

    inside: keys, t, track, other and share of boxes within others, and of the track kind, n, mean conf and other_kind."""
    hidden = inside.filter(_hides()).groupBy(*keys, "track").agg(F.countDistinct("t").alias("hidden"), F.first("n").alias("n"))
    return hidden.filter(F.col("hidden") >= F.when(F.col("track") >= 100000, 0.5).otherwise(0.6) * F.col("n")).select(*keys, "track")


def candidates(tracks: DataFrame, looks: DataFrame, keys: list[str], width: float, height: float, most_gap: float = 180.0) -> DataFrame:
    """keys, a, b, score and gap of possible hand-overs of one kind; time buckets of most_gap make it an equi-join."""
    rows = tracks.join(looks, [*keys, "track"], "left")
    side = lambda p: [F.col(c).alias(f"{c}_{p}") for c in ("track", "start", "end", "first_box", "last_box", "hsv", "cnn")]
    cell = lambda c: F.floor(F.col(c) / (most_gap + 1)).cast("long")
    a = rows.select(*keys, "kind", *side("a"), F.explode(F.array(cell("end") - 1, cell("end"), cell("end") + 1)).alias("_cell"))
    b = rows.select(*keys, "kind", *side("b"), cell("start").alias("_cell"))
    diagonal = (width * width + height * height) ** 0.5
    ca, cb = (g.centre(*(F.col(f"{n}.{c}") for c in BOX)) for n in ("last_box_a", "first_box_b"))
    gap, far = F.col("start_b") - F.col("end_a"), g.distance(*ca, *cb) / diagonal
    pairs = a.join(b, [*keys, "kind", "_cell"]).withColumns({"gap": gap, "far": far}).filter("start_b > start_a").filter(((F.col("gap") >= -0.15) | ((F.col("gap") >= -1.0) & (F.col("far") < 0.12))) & (F.col("gap") <= most_gap))
    edge = lambda n: g.near_edge(*(F.col(f"{n}.{c}") for c in BOX), F.lit(width), F.lit(height))
    look = v.appearance(v.rescaled_cosine(F.col("cnn_a"), F.col("cnn_b")), v.histogram_overlap(F.col("hsv_a"), F.col("hsv_b")))
    out_edge, in_edge = edge("last_box_a"), edge("first_box_b")
    score = v.handover_score(look, F.col("gap"), F.col("far"), out_edge & in_edge, ~out_edge & (F.col("far") < 0.08))
    return pairs.select(*keys, "kind", F.col("track_a").alias("a"), F.col("track_b").alias("b"), score.alias("score"), "gap")


def identities(tracks: DataFrame, pairs: DataFrame, keys: list[str], verdicts: DataFrame | None = None) -> DataFrame:
    """keys, track, gid, chain and score: chains named by kind in the order of their first start.

    verdicts: keys, kind, a, b, same and sure of pairs that someone has looked at; see assign_chains.
    """
    chains = cut(folds.assign_chains(pairs, tracks, [*keys, "kind"], verdicts=verdicts), "chains")
    starts = tracks.select(*keys, "track", "start")
    heads = chains.filter("track = chain").join(starts, [*keys, "track"]).withColumn("prefix", prefix_of(F.col("kind")))
    number = F.row_number().over(Window.partitionBy(*keys, "prefix").orderBy("start", "track"))
    named = heads.select(*keys, F.col("track").alias("chain"), F.concat("prefix", number.cast("string")).alias("gid"))
    return chains.join(named, [*keys, "chain"]).join(starts, [*keys, "track"])


def identity_table(named: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identity: gid, kind, cls, first_seen, last_seen, tracklets, reid_links, reid_score and thumb_track.

    named: from identities; tracks: from summarise. cls is the most common one of its tracks, the least on ties.
    """
    rows = named.select(*keys, "track", "gid", "score").join(tracks, [*keys, "track"])
    counts = rows.groupBy(*keys, "gid", "cls").agg(F.count(F.lit(1)).alias("c"))
    mode = counts.groupBy(*keys, "gid").agg(F.min(F.struct((-F.col("c")).alias("o"), "cls")).alias("m"))
    found = rows.groupBy(*keys, "gid").agg(
        F.first("kind").alias("kind"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"),
        F.transform(F.sort_array(F.collect_list(F.struct("start", "track"))), lambda t: t["track"]).alias("tracklets"),
        F.count("score").alias("reid_links"), F.round(F.coalesce(F.min(F.round("score", 3)), F.lit(1.0)), 3).alias("reid_score"),
        F.max_by("track", F.struct(F.col("n") * F.col("conf"), -F.col("track"))).alias("thumb_track"),
    )
    return found.join(mode, [*keys, "gid"]).withColumn("cls", F.col("m.cls")).drop("m")


def link_table(named: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_track, to_track, score, gap and gid of each link that was made."""
    order = Window.partitionBy(*keys, "chain").orderBy("start", "track")
    after = named.withColumn("_from", F.lag("track").over(order)).filter("score IS NOT NULL AND _from IS NOT NULL")
    gaps = pairs.select(*keys, F.col("a").alias("_from"), F.col("b").alias("track"), "gap")
    return after.join(gaps, [*keys, "_from", "track"], "left").select(*keys, F.col("_from").alias("from_track"), F.col("track").alias("to_track"), F.round("score", 3).alias("score"), F.round("gap", 2).alias("gap"), "gid")
