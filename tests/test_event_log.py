"""A loading bay end to end: a courier, a guard, a van and a backpack; expectations follow from the rules alone."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import eventlog, identity, questions, usersql
from tidemark.sources.tables import cut

FPS, WIDE, HIGH, LASTS = 5, 640.0, 360.0, 90.0
STEP = 1 / FPS
BAY = eventlog.Zone("Bay", ((0.25, 0.5), (0.5, 0.5), (0.5, 1.0), (0.25, 1.0)))


def stretch(track, cls, begin, end, x, y, w, h, conf=0.8, every=1):
    """Samples of a box whose centre goes in straight lines over x and y, given as (from, to)."""
    n = round((end - begin) * FPS)
    for i in range(0, n + 1, every):
        cx, cy = (a + (b - a) * i / max(n, 1) for a, b in (x, y))
        yield ("dock", round(begin + i * STEP, 3), i, track, cls, conf, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


#: The courier walks through the bay, leaves on the right, and comes back after 14 s to stand outside the bay.
COURIER = [*stretch(11, "person", 4, 16, (8, 632), (260, 260), 30, 90), *stretch(12, "person", 30, 36, (632, 420), (260, 260), 30, 90), *stretch(12, "person", 36.2, 52, (420, 420), (260, 260), 30, 90)]
#: The guard stands still on the left; the van parks beyond; the backpack appears at the courier's feet and is visited once.
GUARD = [*stretch(21, "person", 2, 80, (70, 70), (170, 170), 30, 90)]
VAN = [*stretch(31, "truck", 10, 14, (620, 540), (70, 70), 120, 60), *stretch(31, "truck", 14.2, 70, (540, 540), (70, 70), 120, 60)]
PACK = [*stretch(41, "backpack", 46, 85, (436, 436), (290, 290), 20, 20)]
FLICKER = [*stretch(51, "person", 60, 60.4, (300, 300), (300, 300), 30, 90)]
COLUMNS = "video_id string, t double, frame long, track long, cls string, conf double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def scene(spark):
    hits = spark.createDataFrame([*COURIER, *GUARD, *VAN, *PACK, *FLICKER], COLUMNS).cache()
    solid, kept = (cut(x, "solid") for x in identity.solid_hits(hits, ["video_id"]))
    colours = {11: [1.2, 0.8, 0, 0], 12: [1.1, 0.9, 0, 0], 21: [0, 0, 1, 1], 31: [0.5] * 4, 41: [0.5] * 4}
    looks = spark.createDataFrame([("dock", t, [float(v) for v in h]) for t, h in colours.items()], "video_id string, track long, hsv array<double>").withColumn("cnn", F.lit(None).cast("array<double>"))
    pairs = cut(identity.candidates(solid, looks, ["video_id"], WIDE, HIGH), "pairs")
    named = cut(identity.identities(solid, pairs, ["video_id"]), "named")
    about = cut(identity.identity_table(named, solid, ["video_id"]), "identities")
    rows = kept.join(named.select("video_id", "track", "gid", "kind"), ["video_id", "track"]).join(about.select("video_id", "gid", "reid_score"), ["video_id", "gid"])
    meta = spark.createDataFrame([("dock", WIDE, HIGH, LASTS, STEP)], "video_id string, width double, height double, duration double, step double")
    log = cut(eventlog.build(cut(rows, "rows"), meta, eventlog.Rules(zones=(BAY,))), "log")
    return named, about, log, identity.link_table(named, pairs, ["video_id"]), meta


def of(log, type_, **equal):
    rows = log.filter(F.col("type") == type_)
    for k, v in equal.items():
        rows = rows.filter(F.col(k) == v)
    return rows.orderBy("start").collect()


def test_identities(scene):
    named, about, _, links, _ = scene
    gid = {r.track: r.gid for r in named.collect()}
    assert gid == {11: gid[12], 12: gid[11], 21: "P1", 31: "V1", 41: "B1"} and gid[11] == "P2"
    courier = next(r for r in about.collect() if r.gid == "P2")
    assert (courier.first_seen, courier.last_seen, courier.tracklets, courier.reid_links, courier.kind) == (4.0, 52.0, [11, 12], 1, "person")
    (link,) = links.collect()
    assert (link.from_track, link.to_track, link.gid, link.gap) == (11, 12, "P2", 14.0) and courier.reid_score == link.score >= 0.62


def test_visibility(scene):
    log = scene[2]
    assert [(r.start, r.gap_s) for r in of(log, "reappear")] == [(30.0, 14.0)]
    assert [r.start for r in of(log, "exit_view", subject="P2")] == [16.0, 52.0]
    assert {r.subject: r.details for r in of(log, "enter_view")} == {"P1": "first seen inside the frame", "P2": "enters from frame edge", "V1": "enters from frame edge", "B1": "first seen inside the frame"}


def test_zone_visit_follows_the_feet(scene):
    # feet at y = 305 of 360; x is in [160, 320) between the samples on the way from 8 to 632 at 52 a second
    inside = [r[1] for r in COURIER if r[3] == 11 and 160 <= (r[6] + r[8]) / 2 < 320]
    (visit,) = of(scene[2], "in_zone")
    assert (visit.subject, visit.start, visit.end) == ("P2", round(min(inside), 2), round(max(inside), 2))


def test_stays_touch_and_what_nobody_touches(scene):
    log = scene[2]
    stays = {r.subject: (r.start, r.end) for r in of(log, "stationary")}
    assert stays["P1"] == (2.0, 80.0) and stays["B1"] == (46.0, 85.0) and stays["V1"][1] == 70.0
    assert 35 < stays["P2"][0] <= 36.2 and stays["P2"][1] == 52.0
    (touch,) = of(log, "interaction")
    assert (touch.subject, touch.other, touch.start, touch.end) == ("P2", "B1", 46.0, 52.0)
    assert [(r.start, r.end) for r in of(log, "untouched", subject="B1")] == [(52.0, 85.0)]
    assert [(r.subject, r.other, r.start) for r in of(log, "object_left")] == [("B1", "P2", 46.0)]


def test_ids_follow_the_order(scene):
    rows = scene[2].orderBy("id").collect()
    assert [r.id for r in rows] == [f"E{i:03d}" for i in range(1, len(rows) + 1)]
    assert [r.start for r in rows] == sorted(r.start for r in rows)


def test_answers_are_records(scene):
    _, about, log, _, meta = scene
    ask = lambda q: questions.answer(log, q, ["Bay"], about).first()
    people = ask("How many different people appear?")
    assert (people.status, people.value_num, people.subjects) == ("answered", 2.0, ["P1", "P2"]) and people.timestamps == [2.0, 4.0]
    assert ask("How many different people came with an umbrella?").status == "not_observed"
    assert ask("Was there a truck or a bird?").status == "not_observed"
    back = ask("Did anyone come back?")
    assert (back.value_str, back.subjects, back.timestamps) == ("yes", ["P2"], [30.0])
    first = ask("How long did the first person spend in the bay?")
    assert first.status == "not_observed" and first.value_num is None
    second = ask("How long did the second person spend in the bay?")
    assert second.status == "answered" and second.value_num == round(of(log, "in_zone")[0].duration, 1) and second.confidence <= about.filter("gid = 'P2'").first().reid_score
    assert ask("Who left the bag?").subjects == ["P2", "B1"]
    assert ask("When did the truck arrive?").value_num == [r for r in of(log, "stationary", subject="V1")][0].duration
    assert ask("Which object sat untouched for more than half a minute? 0.5 minutes").subjects == ["V1", "B1"]
    assert questions.answer(log, "What is love?", ["Bay"]) is None
    tiles = questions.tiles(log, about, meta).first()
    assert (tiles.people, tiles.others, tiles.links, tiles.events, tiles.samples_per_second) == (2, 2, 1, log.count(), 5.0)
    assert usersql.select({"events": log}, "SELECT count(*) AS n FROM events WHERE type = 'in_zone'").first().n == 1


def test_a_finished_answer_cites_what_exists(spark, scene):
    log = scene[2]
    ids = [f"E{i:03d}" for i in range(200, 0, -1)]
    raw = spark.createDataFrame([("dock", True, 1.0, None, [1.234, None, *map(float, range(20))], [*ids, *ids], ["P2", None, "P2", *(f"P{i}" for i in range(30))])], "video_id string, found boolean, value_num double, value_str string, timestamps array<double>, event_ids array<string>, subjects array<string>")
    got = questions.finish(raw, log).first()
    known = {r.id for r in log.select("id").collect()}
    assert got.event_ids == [x for x in ids if x in known][:30] and [e.id for e in got.evidence] == got.event_ids
    assert got.timestamps == [1.23, *map(float, range(11))] and got.subjects == ["P2", "P0", "P1", *(f"P{i}" for i in range(3, 20))]


def test_a_moving_camera_moves_neither_zones_nor_stays(spark):
    rng = random.Random(7)
    still, shaken, series = [], [], []
    for i in range(200):
        t, shift = round(i * STEP, 3), 0.0 if i < 20 else 0.1
        series.append(("dock", t, 1.0, 0.0, -shift, 0.0, 1.0, 0.0))
        x = 256.0 + rng.random()
        still.append(("dock", t, i, "P1", "person", "person", 0.8, x - 15, 200.0, x + 15, 290.0))
        shaken.append((*still[-1][:7], x - 15 + shift * WIDE, 200.0, x + 15 + shift * WIDE, 290.0))
    schema = "video_id string, t double, frame long, gid string, kind string, cls string, conf double, x1 double, y1 double, x2 double, y2 double"
    meta = spark.createDataFrame([("dock", WIDE, HIGH, 40.0, STEP)], "video_id string, width double, height double, duration double, step double")
    cam = spark.createDataFrame(series, "video_id string, t double, cam_a double, cam_b double, cam_tx double, cam_c double, cam_d double, cam_ty double")
    rules = eventlog.Rules(zones=(BAY,))
    plain = spark.createDataFrame(still, schema).join(meta, "video_id")
    moved = eventlog.with_camera(spark.createDataFrame(shaken, schema).join(meta, "video_id"), cam)
    told = lambda rows: [(r.start, r.end) for r in eventlog.zone_visits(rows, rules).orderBy("start").collect()] + [(r.start, r.end) for r in eventlog.stays(rows, rules).orderBy("start").collect()]
    assert told(moved) == told(plain) and told(plain)[1] == (0.0, 39.8)
    assert told(spark.createDataFrame(shaken, schema).join(meta, "video_id")) != told(plain)


def test_activity_sound_and_change(spark):
    halts = ((9, 13), (33, 36), (58, 59))
    energy = [("dock", "Belt", i / 4, 0.2 if any(a <= i / 4 < b for a, b in halts) else 5.0, 0.25) for i in range(320)]
    stops = eventlog.activity(spark.createDataFrame(energy, "video_id string, zone string, t double, energy double, step double"), eventlog.Rules())
    # the last halt is shorter than 1.5 s
    assert [(r.start, r.end) for r in stops.filter("type = 'activity_stop'").orderBy("start").collect()] == [(9.0, 13.0), (33.0, 36.0)]
    audio = [("dock", i / 10, -25.0 if 120 <= i < 150 or i in (400, 402) else -50.0 - i % 2, 0.7 if i < 200 else 0.05) for i in range(600)]
    heard = eventlog.sounds(spark.createDataFrame(audio, "video_id string, t double, db double, tonality double")).orderBy("start").collect()
    assert [(r.start, round(r.end, 1), r.details.split()[0]) for r in heard] == [(12.0, 15.0, "alarm-like"), (40.0, 40.3, "loud")]
    series = [("dock", i / 5, 2.0 + i % 3 * 0.1, 80.0 + i % 2, 12.0 + i % 2 if 200 <= i < 240 else i % 4 * 0.1, 0.0) for i in range(400)]
    seen = eventlog.sudden_changes(spark.createDataFrame(series, "video_id string, t double, motion double, brightness double, redness double, camera_speed double")).collect()
    assert [(r.details.split()[0], r.start, r.end) for r in seen] == [("red", 40.0, 47.8)]
