"""The event log: typed intervals from tracks, series and sound, per video."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as g
from tidemark.functions.text import span_text
from tidemark.operators import asof, folds, intervals, rhythm, runs, selection, signal
from tidemark.sources.tables import cut


@dataclass(frozen=True)
class Zone:
    name: str
    points: tuple[tuple[float, float], ...]
    kind: str = "area"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the log; seconds and shares of the frame."""

    segment_gap: float = 1.0
    zone_min_dwell: float = 0.5
    zone_merge: float = 3.0
    stay_min: float = 8.0
    stay_tolerance: float = 0.25
    stop_min: float = 1.5
    touch_margin: float = 0.25
    touch_share: float = 0.15
    touch_gap: float = 1.0
    touch_min: float = 0.8
    zones: tuple[Zone, ...] = field(default=())


# Rank of the types at one start; the others come after.
RANKS = {"unexpected_stop": 0, "object_left": 0, "enter_view": 0, "reappear": 1, "zone_enter": 2, "in_zone": 3, "interaction": 4, "stationary": 5, "untouched": 6, "activity_stop": 7, "activity_start": 8, "sudden_change": 9, "sound": 9, "zone_exit": 10, "occluded": 11, "exit_view": 12, "caption": 13}
COLUMNS = {"video_id": "string", "type": "string", "start": "double", "end": "double", "subject": "string", "kind": "string", "cls": "string", "zone": "string", "other": "string", "details": "string", "confidence": "double", "gap_s": "double"}
KEYS, ORDER = ["video_id", "gid"], ["t"]
CAMERA = ("a", "b", "tx", "c", "d", "ty")


def _event(df: DataFrame, type_: str | Column, start: str, end: str | None = None, **columns: Column) -> DataFrame:
    given = {"type": F.lit(type_) if isinstance(type_, str) else type_, "start": F.col(start), "end": F.col(end or start), **columns}
    return df.select(*(given.get(c, F.col(c) if c in df.columns and c in ("video_id", "kind", "cls") else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def _box(suffix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))


def with_camera(tracks: DataFrame, series: DataFrame) -> DataFrame:
    """tracks with cam, the camera's affine map (a, b, tx, c, d, ty) at the first sample at or after their time, else the last.

    Each coefficient is the median of seven samples, the ends repeated. series: video_id, t and cam_a .. cam_ty.
    """
    smooth = series.select("video_id", "t", F.struct(*(signal.rolling_median(f"cam_{c}", ["video_id"], ["t"]).alias(c) for c in CAMERA)).alias("cam"))
    found = asof.asof(tracks, smooth, ["video_id"], "t", ["cam"], forward=True, clamp=True)
    return found.withColumnRenamed("found_cam", "cam").drop("at")


def _in_scene(x: Column, y: Column, tracks: DataFrame) -> tuple[Column, Column]:
    """Pixels of a frame as pixels of the frame that zones were drawn in, where the tracks have a camera."""
    if "cam" not in tracks.columns:
        return x, y
    m = tuple(F.coalesce(F.col(f"cam.{c}"), F.lit(1.0 if c in ("a", "d") else 0.0)) for c in CAMERA)
    rx, ry = g.to_reference(x / F.col("width"), y / F.col("height"), m)
    return rx * F.col("width"), ry * F.col("height")


def visibility(tracks: DataFrame, rules: Rules) -> DataFrame:
    """enter_view, reappear, occluded and exit_view. tracks has width, height, duration and step of its video."""
    marked = runs.with_segment(tracks, KEYS, ORDER, "t", rules.segment_gap)
    w = Window.partitionBy(*KEYS).orderBy("t")
    edge = g.near_edge(*_box(), F.col("width"), F.col("height"))
    rows = marked.withColumns({"edge": edge, "_before": F.lag("seg").over(w), "_after": F.lead("seg").over(w), "_last_t": F.lag("t").over(w)})
    gap, first, last = F.col("t") - F.col("_last_t"), F.col("_before").isNull(), F.col("_after").isNull()
    opens = first | (F.col("_before") != F.col("seg"))
    closes = F.when(last, F.col("t") < F.col("duration") - 2 * F.col("step") - 0.5).otherwise(F.col("_after") != F.col("seg"))
    entering = F.struct(
        F.when(first, "enter_view").otherwise("reappear").alias("type"),
        F.when(first, F.col("conf")).otherwise(F.least("conf", F.coalesce("reid_score", F.lit(1.0)))).alias("confidence"),
        F.when(first & F.col("edge"), "enters from frame edge").when(first, "first seen inside the frame").otherwise(F.format_string("seen again after %.1fs unseen", gap)).alias("details"),
        gap.alias("gap_s"),
    )
    leaving = F.struct(
        F.when(~last & ~F.col("edge"), "occluded").otherwise("exit_view").alias("type"),
        F.col("conf").alias("confidence"),
        F.when(last, F.when(F.col("edge"), "leaves the frame").otherwise("disappears mid-frame")).when(F.col("edge"), "leaves the frame (comes back later)").otherwise("lost mid-frame").alias("details"),
        F.lit(None).cast("double").alias("gap_s"),
    )
    # both ends of a segment from one pass over the rows
    ends = rows.withColumn("_e", F.explode(F.array_compact(F.array(F.when(opens, entering), F.when(closes, leaving)))))
    return _event(ends, F.col("_e.type"), "t", subject=F.col("gid"), confidence=F.col("_e.confidence"), details=F.col("_e.details"), gap_s=F.col("_e.gap_s"))


def zone_visits(tracks: DataFrame, rules: Rules) -> DataFrame:
    """video_id, gid, kind, cls, zone, start, end and confidence of each visit to an area zone."""
    ax, ay = g.anchor(F.col("kind"), *_box(), F.col("width"), F.col("height"))
    sx, sy = _in_scene(ax * F.col("width"), ay * F.col("height"), tracks)
    if "cam" in tracks.columns:
        ax, ay = sx / F.col("width"), sy / F.col("height")
    marked = runs.with_segment(tracks, KEYS, ORDER, "t", rules.segment_gap).withColumns({"ax": ax, "ay": ay})
    areas = [z for z in rules.zones if z.kind == "area"]
    who = [*KEYS, "kind", "cls"]
    # the runs of all zones are numbered in the one order of the samples, which are sorted once; what follows sees runs only
    marked = marked.withColumns({f"_in{i}": g.in_polygon(F.col("ax"), F.col("ay"), list(z.points)) for i, z in enumerate(areas)})
    marked = marked.withColumn("mean_conf", F.avg("conf").over(Window.partitionBy(*KEYS)))
    for i in range(len(areas)):
        marked = runs.with_run(marked.withColumn("_both", F.struct("seg", f"_in{i}")), KEYS, ORDER, "_both", f"_run{i}").drop("_both")
    tests = F.array(*(F.struct(F.lit(z.name).alias("zone"), F.col(f"_in{i}").alias("inside"), F.col(f"_run{i}").alias("_run")) for i, z in enumerate(areas)))
    keys = [*KEYS, "zone", "seg"]
    flat = marked.select(*who, "mean_conf", "seg", "t", "step", F.explode(tests).alias("z")).select(*who, "mean_conf", "seg", "t", "step", "z.*")
    parts = flat.groupBy(*keys, "_run", "inside", "kind", "cls").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("step").alias("step"), F.max("mean_conf").alias("confidence"))
    whole = parts.groupBy(*keys, "_run", "inside").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("step").alias("step"), F.first("kind").alias("kind"), F.first("cls").alias("cls"), F.max("confidence").alias("confidence"))
    calm = runs.flip_short_spans(whole, keys, "start", "end", "inside", rules.zone_min_dwell, F.col("step"))
    spans = runs.with_run(calm, keys, ["start"], "inside").filter("inside").groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind"), F.first("cls").alias("cls"), F.max("confidence").alias("confidence"))
    return intervals.merge(spans, [*KEYS, "zone"], max_gap=rules.zone_merge, carry=("kind", "cls", "confidence"))


def zone_events(visits: DataFrame) -> DataFrame:
    """zone_enter, in_zone and zone_exit; visits may have the duration of their video."""
    said = lambda verb: F.concat_ws(" ", "gid", F.lit(verb), "zone")
    spent = F.concat(said("inside"), F.format_string(" for %.1fs", F.col("end") - F.col("start")))
    one = lambda type_, start, end, details: F.struct(F.lit(type_).alias("type"), F.col(start).alias("start"), F.col(end).alias("end"), details.alias("details"))
    three = F.array(one("zone_enter", "start", "start", said("enters")), one("in_zone", "start", "end", spent), one("zone_exit", "end", "end", said("leaves")))
    rows = visits.withColumn("_e", F.explode(three)).withColumns({"_start": F.col("_e.start"), "_end": F.col("_e.end")})
    return _event(rows, F.col("_e.type"), "_start", "_end", subject=F.col("gid"), zone=F.col("zone"), confidence=F.col("confidence"), details=F.col("_e.details"))


def stays(tracks: DataFrame, rules: Rules) -> DataFrame:
    """stationary: a fold per subject and segment, in scene coordinates; the tolerance is a share of the height ahead."""
    marked = runs.with_segment(tracks, KEYS, ORDER, "t", rules.segment_gap)
    sx, sy = _in_scene((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, tracks)
    placed = marked.withColumns({"_x": sx, "_y": sy, "_tall": F.col("y2") - F.col("y1")})
    found = folds.anchored_stays(placed, KEYS, "t", "_x", "_y", rules.stay_tolerance, rules.stay_min, "_tall", part="seg")
    about = tracks.groupBy(*KEYS).agg(F.first("kind").alias("kind"), F.first("cls").alias("cls"), F.avg("conf").alias("confidence"))
    rows = found.join(about.hint("merge"), KEYS)
    return _event(rows, "stationary", "t0", "t1", subject=F.col("gid"), confidence=F.col("confidence"), details=F.format_string("%s does not move for %.1fs", F.col("gid"), F.col("t1") - F.col("t0")))


def _with_people(samples: DataFrame, which: Column) -> DataFrame:
    """The rows of which, once for each person at the same sample of the video, with person and its box x1_p .. y2_p.

    A window rather than a join: samples that are dealt by video needn't be dealt anew, are read once, and never sent to the
    driver, whatever Spark expects of their size. It holds the people of one sample.
    """
    person = F.when(F.col("kind") == "person", F.struct(F.col("gid").alias("person"), *(F.col(c).alias(f"{c}_p") for c in ("x1", "y1", "x2", "y2"))))
    there = F.collect_list(person).over(Window.partitionBy("video_id", "_sample"))
    met = samples.filter("video_id IS NOT NULL AND _sample IS NOT NULL").withColumn("_people", there).filter(which)
    return met.withColumn("_p", F.explode("_people")).select(*samples.columns, "_p.*")


def interactions(tracks: DataFrame, rules: Rules) -> DataFrame:
    """A person's box over a thing's grown box at the same sample, for long enough; they meet in a window a video and sample."""
    sample = tracks.withColumn("_sample", F.rint(F.col("t") / F.col("step")).cast("long"))
    things = _with_people(sample, F.col("kind") != "person")
    touching = things.filter(g.touch_share(_box(), _box("_p"), rules.touch_margin) >= rules.touch_share)
    keys = ["video_id", "gid", "person"]
    marked = runs.with_segment(touching, keys, ["t"], "t", rules.touch_gap)
    marked = marked.withColumn("_sure", F.avg("conf").over(Window.partitionBy(*keys)))
    spans = marked.groupBy(*keys, "seg").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.first("_sure").alias("confidence"), F.first("cls").alias("thing"), F.first("kind").alias("thing_kind")).filter(F.col("end") - F.col("start") >= rules.touch_min)
    verb = F.when(F.col("thing_kind") == "vehicle", "next to").otherwise("touches / is next to")
    told = F.format_string("%s %s %s (%s) for %.1fs", F.col("person"), verb, F.col("gid"), F.col("thing"), F.col("end") - F.col("start"))
    return _event(spans, "interaction", "start", "end", subject=F.col("person"), kind=F.lit("person"), cls=F.lit("person"), other=F.col("gid"), confidence=F.col("confidence"), details=told)


def untouched(stationary: DataFrame, touched: DataFrame, rules: Rules) -> DataFrame:
    """Pieces of things' stays that no interaction covers. The stays, a fold's result that is asked thrice, are written once."""
    still = cut(stationary.filter("kind <> 'person'"), "stays")
    outer = still.select("video_id", F.col("subject").alias("gid"), "start", "end")
    inner = touched.select("video_id", F.col("other").alias("gid"), "start", "end").join(outer.select("video_id", "gid").distinct(), ["video_id", "gid"])
    about = still.groupBy("video_id", F.col("subject").alias("gid")).agg(F.first("kind").alias("kind"), F.first("cls").alias("cls"), F.max("confidence").alias("confidence"))
    free = intervals.subtract(outer, inner, ["video_id", "gid"], least=rules.stay_min).join(about, ["video_id", "gid"])
    return _event(free, "untouched", "start", "end", subject=F.col("gid"), confidence=F.col("confidence"), details=F.format_string("%s (%s) untouched for %.1fs", F.col("gid"), F.col("cls"), F.col("end") - F.col("start")))


def left_objects(tracks: DataFrame, log: DataFrame, reach: float = 0.35) -> DataFrame:
    """A bag that first shows inside the frame, keeps still, isn't held, and the nearest person around that time."""
    first = log.filter("type = 'enter_view' AND subject LIKE 'B%' AND details LIKE '%inside the frame%'").select("video_id", F.col("subject").alias("gid"), F.col("start").alias("at0"), "kind", "cls")
    # samples are many more than Spark expects of the events that they come from; no side may be sent to the driver
    bags = tracks.drop("kind", "cls").join(first.hint("merge"), KEYS)
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    at = bags.withColumns({"cx": cx, "cy": cy}).withColumns({"cx0": F.first("cx").over(w), "cy0": F.first("cy").over(w), "tall": F.first(F.col("y2") - F.col("y1")).over(w)})
    early = F.col("t") <= F.col("at0") + 3.0
    at = at.withColumns(dict(zip(("sx", "sy"), _in_scene(F.col("cx"), F.col("cy"), tracks), strict=True))).withColumns({"sx0": F.first("sx").over(w), "sy0": F.first("sy").over(w)})
    off = g.distance(F.col("sx"), F.col("sy"), F.col("sx0"), F.col("sy0"))
    still = at.groupBy(*KEYS, "at0", "kind", "cls", "cx0", "cy0", "tall", "width", "height").agg(F.count(F.when(early, 1)).alias("n"), F.max(F.when(early, off)).alias("drift"), F.countDistinct("t").alias("samples"))
    still = still.filter((F.col("n") >= 5) & (F.col("drift") <= 0.3 * F.greatest("tall", F.lit(8.0))))
    sample = lambda df: df.withColumn("_sample", F.rint(F.col("t") / F.col("step")).cast("long"))
    people = tracks.filter("kind = 'person'")
    inside = (F.col("cx") > F.col("x1_p")) & (F.col("cx") < F.col("x2_p")) & (F.col("cy") > F.col("y1_p")) & (F.col("cy") < F.col("y2_p"))
    centred = sample(tracks).withColumns({"cx": cx, "cy": cy}).select("video_id", "_sample", "gid", "kind", "t", "cx", "cy", "x1", "y1", "x2", "y2")
    held = _with_people(centred, F.col("gid").startswith("B")).filter(inside).groupBy(*KEYS).agg(F.countDistinct("t").alias("held"))
    free = still.join(held.hint("merge"), KEYS, "left").filter(F.coalesce("held", F.lit(0)) < 0.5 * F.col("samples"))
    feet = people.select("video_id", F.col("gid").alias("person"), F.col("t"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), F.col("y2").alias("py"))
    near = asof.band(free.withColumn("t", F.col("at0")), feet.hint("merge"), ["video_id"], "t", 4, 1, ["person", "px", "py"]).withColumnsRenamed({"at": "tp", "found_person": "person", "found_px": "px", "found_py": "py"})
    far = g.distance(F.col("px"), F.col("py"), F.col("cx0"), F.col("cy0")) / F.greatest("width", "height")
    best = near.withColumn("far", far).groupBy(*KEYS, "at0", "kind", "cls").agg(F.min(F.struct("far", "tp", "person")).alias("b")).filter(F.col("b.far") < reach)
    return _event(best, "object_left", "at0", subject=F.col("gid"), other=F.col("b.person"), confidence=F.least(F.lit(0.95), 1 - F.col("b.far")), details=F.format_string("%s (%s) left by %s", F.col("gid"), F.col("cls"), F.col("b.person")))


def activity(energy: DataFrame, rules: Rules, least_spread: float = 0.6) -> DataFrame:
    """activity_stop, activity_start and unexpected_stop from energy (video_id, zone, t, energy, step)."""
    keys = ["video_id", "zone"]
    rows = signal.percentile_threshold(energy, keys, "energy", ["t"]).filter(F.col("spread") >= least_spread)
    rows = rows.withColumn("on", F.col("energy") > F.col("threshold"))
    calm = runs.denoise(rows, keys, ["t"], "on", "t", rules.stop_min, 0.5)
    spans = runs.with_run(calm, keys, ["t"], "on").groupBy(*keys, "run", "on").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.first("spread").alias("spread"), F.first("threshold").alias("threshold"))
    w = Window.partitionBy(*keys).orderBy("run")
    stops = spans.withColumn("_next", F.lead("t0").over(w)).filter("NOT on AND run > 0").withColumn("end", F.coalesce("_next", "t1"))
    high = F.col("threshold") + 0.65 * F.col("spread")
    sure = 0.6 + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("spread") / (high + 1e-6)))
    learned = rhythm.learn(stops.withColumn("length", F.round(F.col("end") - F.col("t0"), 2)), keys, "t0", "length").select(*keys, "run", "reason", "period", "usual")
    judged = stops.join(learned, [*keys, "run"], "left")
    label = F.when(F.col("reason").isNotNull(), F.concat(F.lit(" · UNEXPECTED: "), "reason")).when(F.col("period").isNotNull(), " · on schedule").otherwise("")
    stop = _event(judged, "activity_stop", "t0", "end", zone=F.col("zone"), confidence=sure, details=F.concat(F.format_string("motion in %s stops for %.1fs", F.col("zone"), F.col("end") - F.col("t0")), label))
    resumed = _event(stops.filter("_next IS NOT NULL"), "activity_start", "end", zone=F.col("zone"), confidence=sure, details=F.concat_ws(" ", F.lit("motion in"), "zone", F.lit("resumes")))
    odd = _event(judged.filter("reason IS NOT NULL"), "unexpected_stop", "t0", "end", zone=F.col("zone"), confidence=sure, details=F.format_string("unexpected stop in %s: %s (normal: every %.0fs for %.0fs)", F.col("zone"), F.col("reason"), F.col("period"), F.col("usual")))
    return stop.unionByName(resumed).unionByName(odd)


# Robust z and absolute change that a sudden change has to pass, and what it is called.
CHANGES = {"motion": (8.0, 2.5), "_flash": (8.0, 6.0), "redness": (6.0, 4.0)}
CHANGE_LABELS = {"motion": "sudden burst of motion", "_flash": "sudden brightness change", "redness": "red light / flashing"}


def sudden_changes(series: DataFrame, merge_gap: float = 1.5, limits: dict[str, tuple[float, float]] = CHANGES) -> DataFrame:
    """sudden_change from series (video_id, t, motion, brightness, redness, camera_speed).

    All channels go through one chain, keyed by video and channel; their medians are selected, not windowed, so a video's
    series needn't fit a task.
    """
    key, keys = ["video_id"], ["video_id", "channel"]
    moving = series.withColumn("_moves", F.coalesce(F.col("camera_speed") > 0.004, F.lit(False)))
    rows = moving.withColumns({"_moving": runs.dilate("_moves", key, ["t"]), "_flash": F.abs(signal.difference("brightness", key, ["t"]))})
    rows = rows.join(series.groupBy("video_id").agg(F.max("t").alias("_end")), "video_id")
    channels = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in limits))
    long = cut(rows.select("video_id", "t", "_moving", "_end", F.explode(channels).alias("c")).select("video_id", "t", "_moving", "_end", "c.*"), "channels")
    level = selection.with_percentiles(long, keys, F.when(F.col("channel") != "_flash", F.col("value")), [0.5], "_p")
    centred = cut(level.withColumn("_d", F.col("value") - F.coalesce(F.col("_p")[0], F.lit(0.0))).drop("_p"), "centred")
    med = cut(selection.with_percentiles(centred, keys, "_d", [0.5], "_m"), "medians")
    mad = selection.with_percentiles(med, keys, F.abs(F.col("_d") - F.col("_m")[0]), [0.5], "_mad")
    z = mad.withColumn("_z", 0.6745 * (F.col("_d") - F.col("_m")[0]) / (F.col("_mad")[0] + 1e-6))
    of = lambda i: F.coalesce(*(F.when(F.col("channel") == c, F.lit(v[i])) for c, v in limits.items()))
    inner = ~F.col("_moving") & (F.col("t") > 1.5) & (F.col("t") < F.col("_end") - 1.5)
    flag = (F.col("_z") > of(0)) & (F.abs("_d") > of(1)) & ((F.col("channel") == "redness") | inner)
    spans = runs.with_run(z.withColumn("_on", flag), keys, ["t"], "_on").filter("_on").groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("_z").alias("z"))
    label = F.coalesce(*(F.when(F.col("channel") == c, F.lit(CHANGE_LABELS[c])) for c in limits))
    found = spans.select("video_id", label.alias("details"), "start", "end", "z")
    order = Window.partitionBy("video_id", "details").orderBy("start")
    island = found.withColumn("_new", F.when(F.col("start") - F.lag("end").over(order) <= merge_gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    whole = island.groupBy("video_id", "details", "_island").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.min_by("z", "start").alias("z"))
    return _event(whole, "sudden_change", "start", "end", zone=F.lit("whole frame"), details=F.col("details"), confidence=F.least(F.lit(1.0), 0.5 + F.col("z") / 40))


def sounds(audio: DataFrame, window: float = 0.1, rise: float = 12.0) -> DataFrame:
    """sound from audio (video_id, t, db, tonality): loud runs that bridge single quiet windows."""
    key = ["video_id"]
    base = cut(selection.with_percentiles(cut(audio, "audio"), key, "db", [0.5], "_b").withColumn("_base", F.col("_b")[0]).drop("_b"), "levels")
    mad = selection.with_percentiles(base, key, F.abs(F.col("db") - F.col("_base")), [0.5], "_b").withColumn("_mad", F.col("_b")[0] + 1e-6).drop("_b")
    loud = mad.withColumn("_limit", F.col("_base") + F.greatest(F.lit(rise), 4 * F.col("_mad"))).withColumn("_loud", F.col("db") > F.col("_limit"))
    joined = loud.withColumn("_on", runs.bridge_one_gap("_loud", key, ["t"]))
    spans = runs.with_run(joined, key, ["t"], "_on").filter("_on").groupBy("video_id", "run").agg(F.min("t").alias("start"), (F.max("t") + window).alias("end"), F.percentile("tonality", F.lit(0.5)).alias("tonal"), F.max("db").alias("peak"), F.first("_base").alias("base"), F.first("_limit").alias("limit"))
    heard = spans.filter(F.col("end") - F.col("start") >= 0.2)
    label = F.when(F.col("tonal") > 0.35, "alarm-like tone / siren / beeper").otherwise("loud sound (bang / crash / shout)")
    return _event(heard, "sound", "start", "end", zone=F.lit("audio"), confidence=F.least(F.lit(1.0), 0.55 + (F.col("peak") - F.col("limit")) / 30), details=F.concat(label, F.format_string(", %+.0f dB above background", F.col("peak") - F.col("base"))))


def captions(frames: DataFrame) -> DataFrame:
    """caption from given texts (video_id, t, text)."""
    return _event(frames, "caption", "t", zone=F.lit("whole frame"), details=F.col("text"), confidence=F.lit(0.6))


def numbered(log: DataFrame) -> DataFrame:
    """The log in its one order, with id, duration and when; numbers are rounded last."""
    rank = F.lit(99)
    for name, r in RANKS.items():
        rank = F.when(F.col("type") == name, r).otherwise(rank)
    rounded = log.withColumns({"start": F.round("start", 2), "end": F.round("end", 2), "duration": F.round(F.col("end") - F.col("start"), 2), "confidence": F.round("confidence", 2), "_rank": rank})
    w = Window.partitionBy("video_id").orderBy("start", "_rank", "subject", "type", "end", "zone", "other", "details")
    n = F.row_number().over(w).cast("string")
    return rounded.withColumn("id", F.concat(F.lit("E"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))).withColumn("when", span_text(F.col("start"), F.col("end"))).drop("_rank")


def build(tracks: DataFrame, meta: DataFrame, rules: Rules, series: DataFrame | None = None, energy: DataFrame | None = None, audio: DataFrame | None = None, texts: DataFrame | None = None, limits: dict[str, tuple[float, float]] = CHANGES, window: float = 0.1, rise: float = 12.0) -> DataFrame:
    """The whole log. meta: video_id, width, height, duration, step. A series with cam_a .. cam_ty corrects for the camera.

    The tracks in their scene, and the families that others are made of, are written once and read from there.
    """
    rows = tracks.join(meta, "video_id")
    if series is not None and "cam_a" in series.columns:
        rows = with_camera(rows, series)
    rows = cut(rows, "scene")
    seen, still, touched = (cut(df, name) for df, name in ((visibility(rows, rules), "seen"), (stays(rows, rules), "still"), (interactions(rows, rules), "touched")))
    log = seen.unionByName(still).unionByName(touched)
    if any(z.kind == "area" for z in rules.zones):
        log = log.unionByName(zone_events(zone_visits(rows, rules)))
    log = log.unionByName(untouched(still, touched, rules)).unionByName(left_objects(rows, seen))
    for part, made in ((energy, lambda x: activity(x, rules)), (series, lambda x: sudden_changes(x, limits=limits)), (audio, lambda x: sounds(x, window, rise)), (texts, captions)):
        if part is not None:
            log = log.unionByName(made(part))
    return numbered(log)
