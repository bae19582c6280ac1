"""The event log over scenes made of the driver's events, one query per family, with DuckDB twins.

Three users are a video: a person, a car and a suitcase. Each event of a user is a few seconds of samples, two a second, at
a place and with a motion that follow from the event's id and type; time is compressed by 600. All numbers are halves, so
both engines see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import eventlog, identity
from tidemark.plans.eventlog import Rules, Zone
from tidemark.sources.tables import cut, dealt, observations

QUERIES, ORACLES = {}, {}
RULES = Rules(zone_min_dwell=1.25, zones=(Zone("Yard", ((0.4, 0.3), (0.6, 0.3), (0.6, 0.8), (0.4, 0.8))),))
DURATION = 4345.0
#: Events that a task makes samples of, about; an event is 24 samples on average.
EVENTS_A_TASK = 40_000

TRACKS = """e0 AS (SELECT user_id AS u, event_id, event_type AS et, epoch_us(ts) // 600000000 - 2840112 AS s0, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
e1 AS (SELECT u, event_id, et, 2 * s0 + i AS tick, i FROM (SELECT *, unnest(range(4 + k % 40)) AS i FROM e0) QUALIFY row_number() OVER (PARTITION BY u, 2 * s0 + i ORDER BY event_id) = 1),
e2 AS (SELECT CAST(u // 3 AS VARCHAR) AS video_id, CASE u % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'V' ELSE 'B' END || CAST(u AS VARCHAR) AS gid, CASE u % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' ELSE 'suitcase' END AS kind, CASE u % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'suitcase' END AS cls,
tick, tick / 2e0 AS t, CASE u % 3 WHEN 0 THEN 50e0 WHEN 1 THEN 160e0 ELSE 40e0 END AS w, CASE u % 3 WHEN 0 THEN 120e0 WHEN 1 THEN 90e0 ELSE 40e0 END + 2 * (event_id % 7) AS h, (30 + event_id % 60) / 100e0 AS conf,
CASE WHEN et IN ('view', 'signup') THEN 480e0 + event_id % 5 * 10 WHEN et = 'click' THEN 20e0 + event_id * 37 % 900 + 3 * i WHEN et = 'purchase' THEN event_id * 53 % 1000 + 9e0 * i - 100 ELSE 500e0 + i % 2 * 80 END AS cx, CASE WHEN et IN ('view', 'signup') THEN 250e0 + event_id % 3 * 10 ELSE 40e0 + event_id * 29 % 420 END AS cy FROM e1),
tracks AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM e2),
seg AS (SELECT *, sum(o) OVER (PARTITION BY gid ORDER BY tick ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY gid ORDER BY tick) > 2 THEN 1 ELSE 0 END AS o FROM tracks))"""
SEEN = f"""{TRACKS}, ed AS (SELECT *, x1 < 0.04e0 * 1000 OR y1 < 0.04e0 * 500 OR x2 > (1 - 0.04e0) * 1000 OR y2 > (1 - 0.04e0) * 500 AS edge, lag(seg) OVER w AS b, lead(seg) OVER w AS a, lag(t) OVER w AS lt FROM seg WINDOW w AS (PARTITION BY gid ORDER BY tick)),
seen AS (SELECT video_id, CASE WHEN b IS NULL THEN 'enter_view' ELSE 'reappear' END AS type, t AS "start", gid AS subject, kind, cls, conf AS confidence, CASE WHEN b IS NULL THEN CASE WHEN edge THEN 'enters from frame edge' ELSE 'first seen inside the frame' END END AS details, t - lt AS gap_s FROM ed WHERE b IS NULL OR b <> seg
UNION ALL SELECT video_id, CASE WHEN a IS NOT NULL AND NOT edge THEN 'occluded' ELSE 'exit_view' END, t, gid, kind, cls, conf, CASE WHEN a IS NULL THEN CASE WHEN edge THEN 'leaves the frame' ELSE 'disappears mid-frame' END WHEN edge THEN 'leaves the frame (comes back later)' ELSE 'lost mid-frame' END, NULL FROM ed WHERE (a IS NULL AND t < {DURATION} - 1.5e0) OR a <> seg)"""
STAYS = f"""{TRACKS}, nn AS (SELECT video_id, gid, kind, cls, seg, t, cx, cy, row_number() OVER (PARTITION BY gid, seg ORDER BY tick) AS i, 0.25e0 * greatest(quantile_cont(h, 0.5) OVER (PARTITION BY gid, seg ORDER BY tick ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING), 8e0) AS tol FROM seg),
st AS (SELECT gid, seg, t, i, i AS a, cx AS ax, cy AS ay, tol AS atol FROM nn WHERE i = 1 UNION ALL SELECT n.gid, n.seg, n.t, n.i, CASE WHEN far THEN n.i ELSE a END, CASE WHEN far THEN n.cx ELSE ax END, CASE WHEN far THEN n.cy ELSE ay END, CASE WHEN far THEN n.tol ELSE atol END
FROM (SELECT n.*, s.a, s.ax, s.ay, s.atol, sqrt((n.cx - s.ax) * (n.cx - s.ax) + (n.cy - s.ay) * (n.cy - s.ay)) > s.atol AS far FROM st s JOIN nn n ON n.gid = s.gid AND n.seg = s.seg AND n.i = s.i + 1) n),
stay AS (SELECT st.gid, min(t) AS "start", max(t) AS "end" FROM st GROUP BY st.gid, seg, a HAVING max(t) - min(t) >= 8),
who AS (SELECT gid, any_value(video_id) AS video_id, any_value(kind) AS kind, any_value(cls) AS cls, avg(conf) AS confidence FROM tracks GROUP BY gid)"""
TOUCHED = """pp AS (SELECT video_id, tick, gid AS person, x1 AS px1, y1 AS py1, x2 AS px2, y2 AS py2 FROM tracks WHERE kind = 'person'),
tc AS (SELECT o.video_id, o.gid, person, o.cls, o.kind, o.tick, o.t, o.conf FROM tracks o JOIN pp USING (video_id, tick) WHERE o.kind <> 'person' AND greatest(0e0, least(o.x2 + (o.x2 - o.x1) * 0.25e0, px2) - greatest(o.x1 - (o.x2 - o.x1) * 0.25e0, px1)) * greatest(0e0, least(o.y2 + (o.y2 - o.y1) * 0.25e0, py2) - greatest(o.y1 - (o.y2 - o.y1) * 0.25e0, py1)) / greatest((o.x2 - o.x1) * (o.y2 - o.y1), 1e-6) >= 0.15e0),
ts AS (SELECT *, sum(o) OVER (PARTITION BY gid, person ORDER BY tick ROWS UNBOUNDED PRECEDING) AS s, avg(conf) OVER (PARTITION BY gid, person) AS sure FROM (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY gid, person ORDER BY tick) > 2 THEN 1 ELSE 0 END AS o FROM tc)),
touched AS (SELECT video_id, person, gid, any_value(cls) AS cls, any_value(kind) AS kind, min(t) AS "start", max(t) AS "end", any_value(sure) AS confidence FROM ts GROUP BY video_id, person, gid, s HAVING max(t) - min(t) >= 0.8e0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their identities, as the log takes them, and the frame of their video."""
    obs, e = observations(spark, sf_dir).withColumn("video_id", F.floor(F.col("gid") / 3).cast("string")), F.col("event_id")
    # events are dealt by video before they become samples, and all that follows keeps to videos, so no sample is shuffled
    obs = dealt(obs.select("video_id", F.col("gid").alias("u"), "cls", "event_id", "us", "k"), ["video_id"], EVENTS_A_TASK)
    moves = F.when(F.col("cls").isin("view", "signup"), 0).when(F.col("cls") == "click", 1).when(F.col("cls") == "purchase", 2).otherwise(3)
    rows = obs.select("video_id", "u", "event_id", moves.alias("m"), (F.floor(F.col("us") / 600_000_000) - 2_840_112).cast("long").alias("s0"), F.posexplode(F.sequence(F.lit(0), 3 + F.col("k") % 40)).alias("i", "_"))
    # event, place within it and motion as one number that keeps the order of events
    packed = F.col("event_id") * 256 + F.col("i") * 4 + F.col("m")
    rows = rows.groupBy("video_id", "u", (2 * F.col("s0") + F.col("i")).alias("tick")).agg(F.min(packed).alias("r"))
    rows = rows.select("video_id", "u", "tick", F.shiftright("r", 8).alias("event_id"), F.shiftright("r", 2).bitwiseAND(63).cast("int").alias("i"), F.col("r").bitwiseAND(3).alias("m"))
    which = lambda *v: F.when(F.col("u") % 3 == 0, v[0]).when(F.col("u") % 3 == 1, v[1]).otherwise(v[2])
    still = F.col("m") == 0
    cx = F.when(still, 480.0 + e % 5 * 10).when(F.col("m") == 1, 20.0 + e * 37 % 900 + 3 * F.col("i")).when(F.col("m") == 2, e * 53 % 1000 + 9.0 * F.col("i") - 100).otherwise(500.0 + F.col("i") % 2 * 80)
    cy = F.when(still, 250.0 + e % 3 * 10).otherwise(40.0 + e * 29 % 420)
    out = rows.select(
        "video_id", F.concat(which("P", "V", "B"), F.col("u").cast("string")).alias("gid"), which("person", "vehicle", "suitcase").alias("kind"), which("person", "car", "suitcase").alias("cls"),
        (F.col("tick") / 2.0).alias("t"), ((30 + e % 60) / 100.0).alias("conf"), cx.alias("cx"), cy.alias("cy"), which(50.0, 160.0, 40.0).alias("w"), (which(120.0, 90.0, 40.0) + 2 * (e % 7)).alias("h"),
    )
    half = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    out = out.withColumns({"x1": half("cx", "w", -1), "y1": half("cy", "h", -1), "x2": half("cx", "w", 1), "y2": half("cy", "h", 1)}).drop("cx", "cy", "w", "h")
    return out.withColumns({"reid_score": F.lit(None).cast("double"), "width": F.lit(1000.0), "height": F.lit(500.0), "duration": F.lit(DURATION), "step": F.lit(0.5)})


@query(f"WITH {SEEN} SELECT * REPLACE (round(confidence, 9) AS confidence), coalesce(details, 'seen again') AS told FROM seen")
def log_visibility(spark, sf_dir):
    """Who is first seen, comes back, is hidden and leaves."""
    seen = eventlog.visibility(tracks(spark, sf_dir), RULES)
    told = F.when(F.col("type") == "reappear", None).otherwise(F.col("details"))
    return seen.select("video_id", "type", "start", "subject", "kind", "cls", F.round("confidence", 9).alias("confidence"), told.alias("details"), "gap_s", F.coalesce(told, F.lit("seen again")).alias("told"))


@query(f"""WITH {TRACKS}, fl AS (SELECT *, cx / 1000 >= 0.4e0 AND cx / 1000 < 0.6e0 AND CASE WHEN kind = 'person' THEN y2 ELSE cy END / 500 >= 0.3e0 AND CASE WHEN kind = 'person' THEN y2 ELSE cy END / 500 < 0.8e0 AS f FROM seg),
r1 AS (SELECT *, sum(c) OVER (PARTITION BY gid, seg ORDER BY tick ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY gid, seg ORDER BY tick) THEN 0 ELSE 1 END AS c FROM fl)),
r2 AS (SELECT *, max(t) OVER (PARTITION BY gid, seg, r) - min(t) OVER (PARTITION BY gid, seg, r) + 0.5e0 AS len, max(r) OVER (PARTITION BY gid, seg) AS hi FROM r1), r3 AS (SELECT *, CASE WHEN r > 1 AND r < hi AND len < 1.25e0 THEN NOT f ELSE f END AS g FROM r2),
r5 AS (SELECT *, sum(c2) OVER (PARTITION BY gid, seg ORDER BY tick ROWS UNBOUNDED PRECEDING) AS rr FROM (SELECT *, CASE WHEN g = lag(g) OVER (PARTITION BY gid, seg ORDER BY tick) THEN 0 ELSE 1 END AS c2 FROM r3)),
sp AS (SELECT gid, min(t) AS s, max(t) AS e FROM r5 WHERE g GROUP BY gid, seg, rr), m1 AS (SELECT *, sum(o) OVER (PARTITION BY gid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY gid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS o FROM sp)),
v AS (SELECT gid, min(s) AS s, max(e) AS e FROM m1 GROUP BY gid, i), who AS (SELECT gid, any_value(video_id) AS video_id, any_value(kind) AS kind, avg(conf) AS confidence FROM tracks GROUP BY gid),
ev AS (SELECT gid, 'zone_enter' AS type, s AS "start", s AS "end" FROM v UNION ALL SELECT gid, 'in_zone', s, e FROM v UNION ALL SELECT gid, 'zone_exit', e, e FROM v)
SELECT video_id, type, "start", "end", gid AS subject, kind, 'Yard' AS zone, round(confidence, 9) AS confidence FROM ev JOIN who USING (gid)""")
def log_zones(spark, sf_dir):
    """E5: visits to an area."""
    made = eventlog.zone_events(eventlog.zone_visits(tracks(spark, sf_dir), RULES))
    return made.select("video_id", "type", "start", "end", "subject", "kind", "zone", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH RECURSIVE {STAYS} SELECT video_id, gid AS subject, kind, cls, "start", "end", round(confidence, 9) AS confidence FROM stay JOIN who USING (gid)""")
def log_stays(spark, sf_dir):
    """Who does not move; the tolerance follows the height at each anchor."""
    return eventlog.stays(tracks(spark, sf_dir), RULES).select("video_id", "subject", "kind", "cls", "start", "end", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {TRACKS}, {TOUCHED} SELECT video_id, person AS subject, gid AS other, "start", "end", round(confidence, 9) AS confidence, person || CASE WHEN kind = 'vehicle' THEN ' next to ' ELSE ' touches / is next to ' END || gid || ' (' || cls || ') for ' || printf('%.1f', "end" - "start") || 's' AS details FROM touched""")
def log_interactions(spark, sf_dir):
    """People at things."""
    return eventlog.interactions(tracks(spark, sf_dir), RULES).select("video_id", "subject", "other", "start", "end", F.round("confidence", 9).alias("confidence"), "details")


@query(f"""WITH RECURSIVE {STAYS}, {TOUCHED}, ou AS (SELECT gid, "start" AS s, "end" AS e FROM stay WHERE gid NOT LIKE 'P%'), inn AS (SELECT gid, "start" AS s, "end" AS e FROM touched WHERE gid IN (SELECT gid FROM ou)),
pts AS (SELECT gid, s AS pt FROM ou UNION SELECT gid, e FROM ou UNION SELECT gid, s FROM inn UNION SELECT gid, e FROM inn), el AS (SELECT gid, pt AS a, lead(pt) OVER (PARTITION BY gid ORDER BY pt) AS b FROM pts),
fr AS (SELECT * FROM el WHERE b > a AND EXISTS (SELECT 1 FROM ou WHERE ou.gid = el.gid AND ou.s <= a AND ou.e >= b) AND NOT EXISTS (SELECT 1 FROM inn WHERE inn.gid = el.gid AND inn.s <= a AND inn.e >= b)),
k2 AS (SELECT *, sum(o) OVER (PARTITION BY gid ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY gid ORDER BY a) THEN 0 ELSE 1 END AS o FROM fr)),
k3 AS (SELECT gid, min(a) AS "start", max(b) AS "end" FROM k2 GROUP BY gid, i) SELECT video_id, gid AS subject, cls, "start", "end" FROM k3 JOIN who USING (gid) WHERE "end" - "start" >= 8""")
def log_untouched(spark, sf_dir):
    """Things that stay and that nobody touches."""
    rows = tracks(spark, sf_dir)
    # people's stays, which are never left untouched, aren't folded
    return eventlog.untouched(eventlog.stays(rows.filter("kind <> 'person'"), RULES), eventlog.interactions(rows, RULES), RULES).select("video_id", "subject", "cls", "start", "end")


@query(f"""WITH {SEEN}, fi AS (SELECT subject AS gid, "start" AS at0 FROM seen WHERE type = 'enter_view' AND subject LIKE 'B%' AND details LIKE '%inside the frame%'),
bag AS (SELECT t.*, at0, first_value(cx) OVER w AS cx0, first_value(cy) OVER w AS cy0, first_value(h) OVER w AS h0 FROM tracks t JOIN fi USING (gid) WINDOW w AS (PARTITION BY gid ORDER BY tick)),
sti AS (SELECT gid, any_value(video_id) AS video_id, any_value(at0) AS at0, any_value(cx0) AS cx0, any_value(cy0) AS cy0, count(DISTINCT tick) AS samples FROM bag GROUP BY gid HAVING count(*) FILTER (t <= at0 + 3) >= 5 AND max(sqrt((cx - cx0) * (cx - cx0) + (cy - cy0) * (cy - cy0))) FILTER (t <= at0 + 3) <= 0.3e0 * greatest(any_value(h0), 8e0)),
pe AS (SELECT * FROM tracks WHERE kind = 'person'), held AS (SELECT b.gid, count(DISTINCT b.tick) AS held FROM bag b JOIN pe USING (video_id, tick) WHERE b.cx > pe.x1 AND b.cx < pe.x2 AND b.cy > pe.y1 AND b.cy < pe.y2 GROUP BY b.gid),
nr AS (SELECT s.*, pe.gid AS person, sqrt((pe.cx - cx0) * (pe.cx - cx0) + (pe.y2 - cy0) * (pe.y2 - cy0)) / 1000 AS far, pe.t AS tp FROM sti s LEFT JOIN held USING (gid) JOIN pe ON pe.video_id = s.video_id AND pe.t >= at0 - 4 AND pe.t <= at0 + 1 WHERE coalesce(held, 0) < 0.5e0 * samples QUALIFY row_number() OVER (PARTITION BY s.gid ORDER BY far, tp, person) = 1)
SELECT video_id, gid AS subject, person AS other, at0 AS "start", round(least(0.95e0, 1 - far), 9) AS confidence FROM nr WHERE far < 0.35e0""")
def log_left_objects(spark, sf_dir):
    """Bags that someone left."""
    rows = tracks(spark, sf_dir)
    return eventlog.left_objects(rows, eventlog.visibility(rows, RULES)).select("video_id", "subject", "other", "start", F.round("confidence", 9).alias("confidence"))


HOURS = "hs AS (SELECT event_type AS zone, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, sum(event_id % 97) AS m FROM events GROUP BY ALL)"
STOPS = f"""{HOURS}, en AS (SELECT zone, CAST(hour AS DOUBLE) AS t, CAST(n AS DOUBLE) AS energy, row_number() OVER (PARTITION BY zone ORDER BY hour) AS i FROM hs), cu AS (SELECT zone, quantile_cont(energy, 0.05) AS lo, quantile_cont(energy, 0.95) AS hi FROM en WHERE i > 1 GROUP BY zone),
f0 AS (SELECT en.*, lo, hi, energy > lo + 0.35e0 * (hi - lo) AS f FROM en JOIN cu USING (zone) WHERE hi - lo >= 0.6e0), f1 AS (SELECT * REPLACE (CASE WHEN i = 1 THEN coalesce(lead(f) OVER (PARTITION BY zone ORDER BY t), f) ELSE f END AS f) FROM f0),
a1 AS (SELECT *, sum(c) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY zone ORDER BY t) THEN 0 ELSE 1 END AS c FROM f1)), a2 AS (SELECT *, max(t) OVER (PARTITION BY zone, r) - min(t) OVER (PARTITION BY zone, r) AS len, max(r) OVER (PARTITION BY zone) AS top FROM a1), a3 AS (SELECT zone, t, lo, hi, CASE WHEN NOT f AND r > 1 AND r < top AND len < 1.5e0 THEN true ELSE f END AS f FROM a2),
b1 AS (SELECT *, sum(c) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY zone ORDER BY t) THEN 0 ELSE 1 END AS c FROM a3)), b2 AS (SELECT *, max(t) OVER (PARTITION BY zone, r) - min(t) OVER (PARTITION BY zone, r) AS len, max(r) OVER (PARTITION BY zone) AS top FROM b1), b3 AS (SELECT zone, t, lo, hi, CASE WHEN f AND r > 1 AND r < top AND len < 0.5e0 THEN false ELSE f END AS f FROM b2),
ru AS (SELECT zone, r, any_value(f) AS f, min(t) AS t0, max(t) AS t1, any_value(lo) AS lo, any_value(hi) AS hi FROM (SELECT *, sum(c) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY zone ORDER BY t) THEN 0 ELSE 1 END AS c FROM b3)) GROUP BY zone, r),
sp AS (SELECT zone, t0, coalesce(nx, t1) AS "end", nx IS NOT NULL AS resumed, 0.6e0 + 0.4e0 * greatest(0e0, least(1e0, (hi - lo) / (lo + 0.35e0 * (hi - lo) + 0.65e0 * (hi - lo) + 1e-6))) AS sure FROM (SELECT *, lead(t0) OVER (PARTITION BY zone ORDER BY r) AS nx FROM ru) WHERE NOT f AND r > 1)"""


def _energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = observations(spark, sf_dir).groupBy(F.col("cls").alias("zone"), F.floor(F.col("us") / 3_600_000_000).cast("double").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("energy"), F.sum(F.col("event_id") % 97).cast("double").alias("mass"))
    return hours.withColumns({"video_id": F.lit("plant"), "step": F.lit(0.0)})


@query(f"""WITH {STOPS}, a AS (SELECT *, round("end" - t0, 2) AS length, t0 - lag(t0) OVER (PARTITION BY zone ORDER BY t0) AS gap FROM sp), b AS (SELECT *, count(*) OVER (PARTITION BY zone) AS c, median(gap) OVER (PARTITION BY zone) AS p, median(length) OVER (PARTITION BY zone) AS u, min(t0) OVER (PARTITION BY zone) AS ph FROM a),
c1 AS (SELECT *, median(t0 - round_even((t0 - ph) / p, 0) * p) OVER (PARTITION BY zone) AS p1 FROM b WHERE c >= 4 AND p > 0), c2 AS (SELECT *, median(t0 - round_even((t0 - p1) / p, 0) * p) OVER (PARTITION BY zone) AS p2 FROM c1), c3 AS (SELECT *, median(t0 - round_even((t0 - p2) / p, 0) * p) OVER (PARTITION BY zone) AS p3 FROM c2),
d AS (SELECT *, t0 - (p3 + round_even((t0 - p3) / p, 0) * p) AS dev FROM c3), v AS (SELECT *, concat_ws(' and ', CASE WHEN dev < -greatest(0.2e0 * p, 3e0) THEN 'early' WHEN dev > greatest(0.2e0 * p, 3e0) THEN 'late' END, CASE WHEN length > 1.8e0 * u THEN 'long' WHEN length < 0.4e0 * u THEN 'short' END) AS reason FROM d)
SELECT zone, 'activity_stop' AS type, t0 AS "start", "end", round(sure, 6) AS confidence FROM sp UNION ALL SELECT zone, 'activity_start', "end", "end", round(sure, 6) FROM sp WHERE resumed UNION ALL SELECT zone, 'unexpected_stop', t0, "end", round(sure, 6) FROM v WHERE reason <> ''""")
def log_activity(spark, sf_dir):
    """Stops of an activity, and those that break its rhythm."""
    return eventlog.activity(_energy(spark, sf_dir), RULES).select("zone", "type", "start", "end", F.round("confidence", 6).alias("confidence"))


def _change(column: str, z: float, least: float, label: str, inner: bool) -> str:
    """One label's sudden changes: med and mad of d over all samples, runs of high z, merged within 1.5."""
    d = {"flash": "abs(mass - coalesce(lag(mass) OVER (PARTITION BY zone ORDER BY t), mass))"}.get(column, f"{column} - median({column}) OVER (PARTITION BY zone)")
    return f"""(WITH d0 AS (SELECT zone, t, {d} AS d FROM sr), d1 AS (SELECT *, median(d) OVER (PARTITION BY zone) AS m FROM d0), d2 AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY zone) AS mad, max(t) OVER (PARTITION BY zone) AS last FROM d1), d3 AS (SELECT *, 0.6745e0 * (d - m) / (mad + 1e-6) AS z FROM d2),
d4 AS (SELECT *, z > {z}e0 AND abs(d) > {least}e0{" AND t > 1.5e0 AND t < last - 1.5e0" if inner else ""} AS f FROM d3), d5 AS (SELECT *, sum(c) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY zone ORDER BY t) THEN 0 ELSE 1 END AS c FROM d4)),
d6 AS (SELECT zone, min(t) AS s, max(t) AS e, max(z) AS z FROM d5 WHERE f GROUP BY zone, r), d7 AS (SELECT *, sum(o) OVER (PARTITION BY zone ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY zone ORDER BY s) <= 1.5e0 THEN 0 ELSE 1 END AS o FROM d6))
SELECT zone AS video_id, '{label}' AS details, min(s) AS "start", arg_max(e, s) AS "end", round(least(1e0, 0.5e0 + arg_min(z, s) / 40), 6) AS confidence FROM d7 GROUP BY zone, i)"""


@query(f"""WITH {HOURS}, sr AS (SELECT zone, CAST(hour AS DOUBLE) AS t, n * 1e0 AS motion, m * 1e0 AS mass, (m % 13) * 1e0 AS redness FROM hs) {_change("motion", 2.0, 2.5, "sudden burst of motion", True)} UNION ALL {_change("flash", 2.0, 1.5, "sudden brightness change", True)} UNION ALL {_change("redness", 1.5, 4.0, "red light / flashing", False)}""")
def log_sudden_changes(spark, sf_dir):
    """Bursts, flashes and red light, with thresholds that such even series reach."""
    series = _energy(spark, sf_dir).select(F.col("zone").alias("video_id"), "t", F.col("energy").alias("motion"), F.col("mass").alias("brightness"), (F.col("mass") % 13).alias("redness"), F.lit(0.0).alias("camera_speed"))
    found = eventlog.sudden_changes(series, limits={"motion": (2.0, 2.5), "_flash": (2.0, 1.5), "redness": (1.5, 4.0)})
    return found.select("video_id", "details", "start", "end", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {HOURS}, au AS (SELECT zone, CAST(hour AS DOUBLE) AS t, n * 1e0 AS db, (m % 10) / 10e0 AS tonality FROM hs), b0 AS (SELECT *, median(db) OVER (PARTITION BY zone) AS base FROM au), b1 AS (SELECT *, median(abs(db - base)) OVER (PARTITION BY zone) + 1e-6 AS mad FROM b0), b2 AS (SELECT *, base + greatest(1e0, 4 * mad) AS lim FROM b1), b3 AS (SELECT *, db > lim AS l FROM b2),
b4 AS (SELECT *, l OR (coalesce(lag(l) OVER w, false) AND coalesce(lead(l) OVER w, false)) AS f FROM b3 WINDOW w AS (PARTITION BY zone ORDER BY t)), b5 AS (SELECT *, sum(c) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY zone ORDER BY t) THEN 0 ELSE 1 END AS c FROM b4)),
b6 AS (SELECT zone, min(t) AS "start", max(t) + 1e0 AS "end", median(tonality) AS tonal, max(db) AS peak, any_value(lim) AS lim FROM b5 WHERE f GROUP BY zone, r)
SELECT zone AS video_id, "start", "end", CASE WHEN tonal > 0.35e0 THEN 'alarm-like' ELSE 'loud' END AS label, round(least(1e0, 0.55e0 + (peak - lim) / 30), 6) AS confidence FROM b6 WHERE "end" - "start" >= 0.2e0""")
def log_sounds(spark, sf_dir):
    """Loud runs of an audio series."""
    audio = _energy(spark, sf_dir).select(F.col("zone").alias("video_id"), "t", F.col("energy").alias("db"), (F.col("mass") % 10 / 10).alias("tonality"))
    return eventlog.sounds(audio, window=1.0, rise=1.0).select("video_id", "start", "end", F.split("details", " ")[0].alias("label"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {TRACKS}, {TOUCHED}, {SEEN.removeprefix(TRACKS + ", ")}, al AS (SELECT video_id, type, "start", "start" AS "end", subject, CASE type WHEN 'enter_view' THEN 0 WHEN 'reappear' THEN 1 WHEN 'occluded' THEN 11 ELSE 12 END AS o, '' AS oth FROM seen UNION ALL SELECT video_id, 'interaction', "start", "end", person, 4, gid FROM touched UNION ALL SELECT video_id, 'caption', t, t, NULL, 13, '' FROM tracks WHERE tick % 64 = 0 AND kind = 'person'),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", o, subject NULLS FIRST, type, "end", oth) AS r FROM al) SELECT video_id, type, "start", "end", round("end" - "start", 2) AS duration, subject, 'E' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id FROM n""")
def log_order(spark, sf_dir):
    """E14 and the log's one order with its ids, over visibility, interactions and captions."""
    rows = tracks(spark, sf_dir)
    notes = rows.filter((F.col("t") * 2 % 64 == 0) & (F.col("kind") == "person")).select("video_id", "t", F.lit("a still picture").alias("text"))
    log = eventlog.numbered(eventlog.visibility(rows, RULES).unionByName(eventlog.interactions(rows, RULES)).unionByName(eventlog.captions(notes)))
    return log.select("video_id", "type", "start", "end", "duration", "subject", "id")


@query(f"""WITH {TRACKS}, w AS (SELECT *, CAST(tick // 240 AS BIGINT) AS cell FROM tracks), sm AS (SELECT video_id, gid, kind, cell, min(t) AS s, max(t) AS e, count(*) AS n, avg(conf) AS conf FROM w GROUP BY ALL)
SELECT video_id, gid, cell, s AS "start", e AS "end", n FROM sm WHERE NOT (e - s < 0.6e0 AND n < 4) AND NOT (e - s < 3 AND round(conf, 9) < 0.4e0)""")
def solid_tracks(spark, sf_dir):
    """tracks of two minutes each, without flicker and short weak ones."""
    return identity.keep_solid(_tracklets(spark, sf_dir)).select("video_id", F.substring_index("name", "|", 1).alias("gid"), F.substring_index("name", "|", -1).cast("long").alias("cell"), "start", "end", "n")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).withColumn("cell", F.floor(F.col("t") / 120).cast("long"))
    return rows.select("video_id", F.concat_ws("|", "gid", "cell").alias("name"), (F.regexp_extract("gid", r"(\d+)", 1).cast("long") * 100 + F.col("cell")).alias("track"), "t", "cls", "conf", "x1", "y1", "x2", "y2")


def _tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return identity.summarise(hits, ["video_id"]).join(hits.select("video_id", "track", "name").distinct(), ["video_id", "track"])


@query()
def identities(spark, sf_dir):
    """Pieces of two minutes handed over to identities; held against a plain loop in the tests."""
    solid, _ = identity.solid_hits(_hits(spark, sf_dir), ["video_id"])
    solid = cut(solid, "solid")
    # a colour that follows from the track's user, as a histogram of four bins that sums to two
    shade = F.floor(F.col("track") / 100) % 5 / 8
    looks = solid.select("video_id", "track", F.array(shade, 1 - shade, F.lit(0.5), F.lit(0.5)).alias("hsv"), F.lit(None).cast("array<double>").alias("cnn"))
    named = identity.identities(solid, identity.candidates(solid, looks, ["video_id"], 1000, 500), ["video_id"])
    return identity.identity_table(named, solid, ["video_id"]).select("video_id", "gid", "kind", "cls", "first_seen", "last_seen", "tracklets", "reid_links", "reid_score", "thumb_track")


CAMERA = "cm AS (SELECT video_id, tick, t, 1e0 AS a, 0e0 AS b, (tick % 9) / 64e0 AS tx FROM tracks WHERE kind = 'person')"


@query(f"""WITH {TRACKS}, {CAMERA}, sm AS (SELECT video_id, t, list_sort([tx, coalesce(lag(tx, 1) OVER w, f), coalesce(lag(tx, 2) OVER w, f), coalesce(lag(tx, 3) OVER w, f), coalesce(lead(tx, 1) OVER w, l), coalesce(lead(tx, 2) OVER w, l), coalesce(lead(tx, 3) OVER w, l)])[4] AS tx FROM (SELECT *, first_value(tx) OVER (PARTITION BY video_id ORDER BY t) AS f, last_value(tx) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM cm) WINDOW w AS (PARTITION BY video_id ORDER BY t)),
la AS (SELECT video_id, arg_max(tx, t) AS tx FROM sm GROUP BY video_id), j AS (SELECT k.video_id, k.gid, k.t, s.tx FROM tracks k ASOF JOIN sm s ON k.video_id = s.video_id AND k.t <= s.t)
SELECT k.video_id, k.gid, k.t, coalesce(j.tx, la.tx) AS tx FROM tracks k JOIN la ON la.video_id = k.video_id LEFT JOIN j ON j.gid = k.gid AND j.t = k.t""")
def camera_shift(spark, sf_dir):
    """The camera's smoothed shift at each sample of a track."""
    rows = tracks(spark, sf_dir)
    series = rows.filter("kind = 'person'").select("video_id", "t", F.lit(1.0).alias("cam_a"), F.lit(0.0).alias("cam_b"), (F.col("t") * 2 % 9 / 64).alias("cam_tx"), F.lit(0.0).alias("cam_c"), F.lit(1.0).alias("cam_d"), F.lit(0.0).alias("cam_ty"))
    moved = eventlog.with_camera(rows.join(series.select("video_id").distinct(), "video_id"), series)
    return moved.select("video_id", "gid", "t", F.col("cam.tx").alias("tx"))


LIMITS = {"motion": (2.0, 2.5), "_flash": (2.0, 1.5), "redness": (1.5, 4.0)}
_RANK = "CASE type " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in eventlog.RANKS.items()) + " END"
#: Each family's twin as rows of one log: type, start, end, subject, zone, other and, where rows differ in nothing else, details.
_FAMILIES = (
    ("log_visibility", 'type, "start", "start", subject, NULL, NULL, NULL'), ("log_zones", 'type, "start", "end", subject, zone, NULL, NULL'), ("log_stays", "'stationary', \"start\", \"end\", subject, NULL, NULL, NULL"),
    ("log_interactions", "'interaction', \"start\", \"end\", subject, NULL, other, NULL"), ("log_untouched", "'untouched', \"start\", \"end\", subject, NULL, NULL, NULL"), ("log_left_objects", "'object_left', \"start\", \"start\", subject, NULL, other, NULL"),
    ("log_sudden_changes", "'sudden_change', \"start\", \"end\", NULL, 'whole frame', NULL, details"), ("log_sounds", "'sound', \"start\", \"end\", NULL, 'audio', NULL, NULL"),
)
_WHOLE = " UNION ALL ".join(
    [f"SELECT video_id, {columns} FROM ({ORACLES[name]})" for name, columns in _FAMILIES]
    + [f"SELECT 'plant', type, \"start\", \"end\", NULL, zone, NULL, NULL FROM ({ORACLES['log_activity']})", f"SELECT video_id, 'caption', t, t, NULL, 'whole frame', NULL, NULL FROM (WITH {TRACKS} SELECT * FROM tracks WHERE tick % 64 = 0 AND kind = 'person')"]
)


@query(f"""WITH al(video_id, type, s, e, subject, zone, other, details) AS ({_WHOLE}), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, {_RANK}, subject NULLS FIRST, type, e, zone NULLS FIRST, other NULLS FIRST, details NULLS FIRST) AS r FROM al)
SELECT video_id, 'E' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id, type, s AS "start", e AS "end", round(e - s, 2) AS duration, subject, zone, other FROM n""")
def log_all(spark, sf_dir):
    """The whole log in its one order: all families of tracks, energy, series, sound and captions through build()."""
    rows = tracks(spark, sf_dir)
    frame = ("width", "height", "duration", "step")
    energy = _energy(spark, sf_dir)
    series = energy.select(F.col("zone").alias("video_id"), "t", F.col("energy").alias("motion"), F.col("mass").alias("brightness"), (F.col("mass") % 13).alias("redness"), F.lit(0.0).alias("camera_speed"))
    audio = energy.select(F.col("zone").alias("video_id"), "t", F.col("energy").alias("db"), (F.col("mass") % 10 / 10).alias("tonality"))
    texts = rows.filter((F.col("t") * 2 % 64 == 0) & (F.col("kind") == "person")).select("video_id", "t", F.lit("a still picture").alias("text"))
    log = eventlog.build(rows.drop(*frame), rows.select("video_id", *frame).distinct(), RULES, series, energy, audio, texts, LIMITS, 1.0, 1.0)
    return log.select("video_id", "id", "type", "start", "end", "duration", "subject", "zone", "other")
