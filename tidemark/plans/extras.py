"""Queries over grids, caches, noisy text, registration and context, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geometry as g
from tidemark.functions import noisy
from tidemark.operators import registration, resample
from tidemark.plans import context
from tidemark.sources import cache
from tidemark.sources.tables import fresh_path, observations, spread, table

QUERIES, ORACLES = {}, {}
HOUR = 3_600_000_000
#: Samples that a task fits, about.
SAMPLES_A_TASK = 20_000
OBS = "obs AS (SELECT user_id AS gid, epoch_us(ts) AS us, event_type AS cls, value AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id, value / 500 AS x, CAST(json_extract(props, '$.k') AS INTEGER) / 100e0 AS y FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- key points on a grid


#: Hours since 2024-01-01, in 64ths, so that both engines see the same numbers; a key point a subject and 64th.
POINTS = f"{OBS}, kp AS (SELECT gid, (us - 1704067200000000) // 56250000 AS t, max(struct_pack(x := round(x * 64) / 64, y := round(y * 64) / 64)) AS p FROM obs GROUP BY ALL), pr AS (SELECT gid, t, p, lead(t) OVER w AS t1, lead(p) OVER w AS p1 FROM kp WINDOW w AS (PARTITION BY gid ORDER BY t))"
GRID = f"{POINTS}, tk AS (SELECT *, unnest(range((t + 63) // 64, CASE WHEN t1 IS NULL THEN t // 64 + 1 ELSE (t1 + 63) // 64 END)) AS i FROM pr), gr AS (SELECT gid, i * 64 AS t, p.x + coalesce(p1.x - p.x, 0) * CASE WHEN t1 IS NULL THEN 0 ELSE (i * 64 - t) / CAST(t1 - t AS DOUBLE) END AS x, p.y + coalesce(p1.y - p.y, 0) * CASE WHEN t1 IS NULL THEN 0 ELSE (i * 64 - t) / CAST(t1 - t AS DOUBLE) END AS y FROM tk)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor((F.col("us") - 1704067200000000) / F.lit(56_250_000)).cast("long")
    points = observations(spark, sf_dir).select("gid", at.alias("t"), (F.round(F.col("x") * 64) / 64).alias("x"), (F.round(F.col("y") * 64) / 64).alias("y"))
    return resample.on_grid(points, ["gid"], "t", ["x", "y"], 64)


@query(f"WITH {GRID} SELECT gid, t, x, y FROM gr")
def key_point_grid(spark, sf_dir):
    """The path of each subject between its key points, once an hour."""
    return _grid(spark, sf_dir)


@query(f"""WITH {GRID}, fl AS (SELECT gid, t, round(x, 9) >= 0.02 AND round(x, 9) < 0.25 AND round(y, 9) >= 0.2 AND round(y, 9) < 0.8 AS f FROM gr), ch AS (SELECT *, lag(f, 1, false) OVER (PARTITION BY gid ORDER BY t) AS b FROM fl)
SELECT gid, CASE WHEN f THEN 'enter' ELSE 'exit' END AS mark, t FROM ch WHERE f <> b UNION ALL SELECT gid, 'first', min(t) FROM gr GROUP BY gid UNION ALL SELECT gid, 'last', max(t) FROM gr GROUP BY gid""")
def scripted_truth(spark, sf_dir):
    """When the scripted paths enter and leave a zone, and when they are first and last there."""
    rows = _grid(spark, sf_dir)
    inside = g.in_polygon(F.round("x", 9), F.round("y", 9), [(0.02, 0.2), (0.25, 0.2), (0.25, 0.8), (0.02, 0.8)])
    crossed = resample.changes(rows, ["gid"], "t", inside).select("gid", F.when(F.col("on"), "enter").otherwise("exit").alias("mark"), "t")
    seen = rows.groupBy("gid").agg(F.min("t").alias("first"), F.max("t").alias("last")).unpivot("gid", ["first", "last"], "mark", "t")
    return crossed.unionByName(seen)


# ---- a derived table that is renewed in part


@query(f"WITH {OBS}, n AS (SELECT gid % 10 AS grp, gid, us, CASE WHEN gid % 10 = 3 THEN v + 1 ELSE v END AS v FROM obs) SELECT grp, gid, count(*) AS n, round(sum(v), 4) AS total, max(us) - min(us) AS span, grp IN (3) AS again FROM n GROUP BY grp, gid")
def renewed_in_part(spark, sf_dir):
    """A table derived by video and then again after one video has changed: which videos were made again, and all rows."""
    obs = observations(spark, sf_dir).select((F.col("gid") % 10).alias("grp"), "gid", "us", "v")
    make = lambda rows: rows.groupBy("grp", "gid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"), (F.max("us") - F.min("us")).alias("span"))
    path = fresh_path(spark, "derived")
    cache.refresh(path, obs, "grp", make)
    table_, again = cache.refresh(path, obs.withColumn("v", F.when(F.col("grp") == 3, F.col("v") + 1).otherwise(F.col("v"))), "grp", make)
    return table_.join(again.withColumn("again", F.lit(True)), "grp", "left").select("grp", "gid", "n", "total", "span", F.coalesce("again", F.lit(False)).alias("again"))


# ---- JSON and code in noisy text


@query("SELECT doc_id, doc_id AS told_id, n_chars AS told_chars, lang AS told_lang, CASE WHEN doc_id % 3 = 0 THEN 'def answer(): return ' || doc_id || chr(10) WHEN doc_id % 3 = 1 THEN 'x = ' || doc_id || chr(10) END AS code FROM documents")
def json_in_text(spark, sf_dir):
    """A record and code hidden in the noise of each whole document, with brackets and quotes that mislead."""
    docs = table(spark, sf_dir, "documents")
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars"), F.col("lang"), F.lit('a "b" } [ \\ ] {').alias("trap"), F.array(F.struct(F.lit(1).alias("x"))).alias("rest")))
    block = lambda body: F.concat(F.lit("\n```python\n"), body, F.lit("\n```\n"))
    number = F.col("doc_id").cast("string")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(block(F.concat(F.lit("def answer(): return "), number)), block(F.lit("y = 0")))).when(F.col("doc_id") % 3 == 1, F.concat(block(F.lit("y = 0")), block(F.concat(F.lit("x = "), number)))).otherwise("")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"other": 1} ```json\n'), record, F.lit("\n``` and [2]"))).otherwise(F.concat(F.lit('{draft, "quote} [1 '), record))
    noisy_text = F.concat(F.coalesce("text", F.lit("")), F.lit(" } ] "), marked, F.lit(" ] tail } "), code, F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", noisy.first_json(noisy_text).alias("json"), noisy.code_block(noisy_text).alias("code"))
    read = F.from_json("json", "id long, chars long, lang string")
    return found.select("doc_id", read["id"].alias("told_id"), read["chars"].alias("told_chars"), read["lang"].alias("told_lang"), "code")


@query()
def json_in_pages(spark, sf_dir):
    """X7 over the html of all pages; tests hold it against a plain loop."""
    return table(spark, sf_dir, "pages").select("page_id", noisy.first_json(F.col("html")).alias("json"))


# ---- transforms from matched points (P27 with W22)


FITS = f"""{OBS}, sm AS (SELECT gid % 10 AS video_id, event_id AS t, 1 + (event_id % 11 - 5) / 50e0 AS s, (k % 9 - 4) / 100e0 AS w, (event_id % 13 - 6) / 40e0 AS tx, (event_id % 5 - 2) / 40e0 AS ty, event_id % 7 <> 0 AND event_id % 6 <> 0 AS good FROM obs),
ft AS (SELECT *, CASE WHEN good THEN struct_pack(a := s * cos(w), b := -s * sin(w), tx := tx, ty := ty) END AS f FROM sm)"""


@query(f"""WITH {FITS}, lg AS (SELECT video_id, t, good, last_value(f IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM ft)
SELECT video_id, t, good, round(f.a, 6) + 0e0 AS a, round(f.b, 6) + 0e0 AS b, round(f.tx, 6) + 0e0 AS tx, round(f.ty, 6) + 0e0 AS ty FROM lg""")
def registered_samples(spark, sf_dir):
    """Forty matched points a sample, ten of them wrong; every sixth sample has too few, every seventh an impossible scale."""
    k, e = F.col("k"), F.col("event_id")
    scale = F.when(e % 7 == 0, 2.0).otherwise(1 + (e % 11 - 5) / 50.0)
    rows = observations(spark, sf_dir).select((F.col("gid") % 10).alias("video_id"), e.alias("t"), scale.alias("s"), ((k % 9 - 4) / 100.0).alias("w"), ((e % 13 - 6) / 40.0).alias("tx"), ((e % 5 - 2) / 40.0).alias("ty"))

    # fitting is the work, not reading: samples are dealt out before they have points, as a fit needs no other sample
    rows = spread(rows, SAMPLES_A_TASK)

    def point(i):
        sx, sy = (i * 37 + F.col("t")) % 101 / 101.0, (i * 53 + F.col("t") * 7) % 97 / 97.0
        c, d = F.col("s") * F.cos("w"), F.col("s") * F.sin("w")
        wrong = i % 4 == 0
        off = lambda n: F.when(wrong, 0.2 + (i * i * n + F.col("t") * 5) % 83 / 83.0).otherwise(0.0)
        dx, dy = c * sx - d * sy + F.col("tx") + off(17), d * sx + c * sy + F.col("ty") + off(29)
        return F.struct(sx.alias("sx"), sy.alias("sy"), dx.alias("dx"), dy.alias("dy"))

    many = F.transform(F.sequence(F.lit(0), F.when(F.col("t") % 6 == 0, 11).otherwise(39)), point)
    found = registration.fit(rows.select("video_id", "t", many.alias("points")), ["video_id"], "t")
    return found.select("video_id", "t", "good", *((F.round(c, 6) + 0.0).alias(c) for c in ("a", "b", "tx", "ty")))


# ---- a log as text


CONTEXT = f"""{OBS}, lg AS (SELECT CAST(gid % 10 AS VARCHAR) AS video_id, cls AS type, (us - 1704067200000000) // 1000000 / 4e0 AS st, CAST(gid AS VARCHAR) AS subject, CASE WHEN k % 4 = 0 THEN 'say "' || k || '", twice' WHEN k % 4 = 1 THEN NULL ELSE 'k' || k END AS details, (k % 4) / 4e0 AS confidence, 'E' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS id FROM obs),
ln AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY st, id) AS n, id || ',' || type || ',' || printf('%.2f', st) || ',' || printf('%.2f', st) || ',' || subject || ',,,' || CASE WHEN details LIKE '%,%' THEN '"' || replace(details, '"', '""') || '"' ELSE coalesce(details, '') END || ',' || printf('%.2f', confidence) AS line FROM lg),
ev AS (SELECT video_id, string_agg(line, chr(10) ORDER BY n) AS events FROM ln WHERE n <= 40 GROUP BY video_id), ct AS (SELECT video_id, sum(n) AS total, string_agg(type || ': ' || n, ', ' ORDER BY n DESC, type) AS counts FROM (SELECT video_id, type, count(*) AS n FROM lg GROUP BY ALL) GROUP BY video_id),
pl AS (SELECT video_id, subject, min(st) AS f, max(st) AS l FROM lg GROUP BY ALL), pn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f, subject) AS n FROM pl), pt AS (SELECT video_id, string_agg(subject || ',person,' || printf('%.2f', f) || ',' || printf('%.2f', l), chr(10) ORDER BY n) AS people FROM pn WHERE n <= 5 GROUP BY video_id)"""


@query(f"""WITH {CONTEXT} SELECT video_id, '## Identities' || chr(10) || 'gid,kind,first_seen,last_seen' || chr(10) || people || chr(10) || '## Event counts' || chr(10) || counts || chr(10) || CASE WHEN total > 40 THEN '## Events (first 40 of ' || total || ')' ELSE '## Events' END || chr(10) || 'id,type,start,end,subject,zone,other,details,confidence' || chr(10) || events AS context FROM ct JOIN ev USING (video_id) JOIN pt USING (video_id)""")
def log_context(spark, sf_dir):
    """Forty events and five identities a video as text; times and confidences are quarters."""
    k = F.col("k")
    start = F.floor((F.col("us") - 1704067200000000) / 1_000_000) / 4.0
    details = F.when(k % 4 == 0, F.concat(F.lit('say "'), k.cast("string"), F.lit('", twice'))).when(k % 4 == 1, None).otherwise(F.concat(F.lit("k"), k.cast("string")))
    log = observations(spark, sf_dir).select(
        (F.col("gid") % 10).cast("string").alias("video_id"), F.col("cls").alias("type"), start.alias("start"), start.alias("end"), F.col("gid").cast("string").alias("subject"), F.lit("").alias("zone"), F.lit(None).cast("string").alias("other"),
        details.alias("details"), (k % 4 / 4.0).alias("confidence"), F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("id"),
    )
    people = log.groupBy("video_id", F.col("subject").alias("gid")).agg(F.lit("person").alias("kind"), F.min("start").alias("first_seen"), F.max("start").alias("last_seen"))
    return context.context(log, people, 40, 5)


# ---- live rows (F9) and durations in text


@query(f"WITH {OBS}, q AS (SELECT gid % 10 AS grp, us AS at FROM obs WHERE event_id % 10 = 0), s AS (SELECT gid % 10 AS grp, event_id, us AS t FROM obs) SELECT q.grp, q.at, s.event_id FROM q JOIN s ON s.grp = q.grp AND s.t <= q.at AND q.at <= s.t + {2 * HOUR} QUALIFY row_number() OVER (PARTITION BY q.grp, q.at ORDER BY s.t DESC, s.event_id DESC) <= 3")
def live_at(spark, sf_dir):
    """at each asked time, the last three rows that began up to two hours before it.

    A row is live in two buckets. In the order of a bucket the last row at or before a time, and the two before that row, are
    all that can be told of it: a union and windows, with no pair of a time and a row that is too old or not among the last.
    """
    obs = observations(spark, sf_dir).withColumn("grp", F.col("gid") % 10)
    reach = 2 * HOUR
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    asked = obs.filter("event_id % 10 = 0").select("grp", F.col("us").alias("at"), cell("us").alias("cell")).distinct()
    rows = obs.select("grp", "event_id", F.col("us").alias("t"), F.explode(F.array(cell("us"), cell("us") + 1)).alias("cell"))
    order = Window.partitionBy("grp", "cell").orderBy("t", "event_id")
    row = F.struct("t", "event_id")
    last = rows.withColumn("three", F.array(row, *(F.lag(row, i).over(order) for i in (1, 2))))
    at = Window.partitionBy("grp", "cell").orderBy("t", "_asks", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = last.withColumn("_asks", F.lit(0)).unionByName(asked.select("grp", "cell", F.col("at").alias("t"), F.lit(1).alias("_asks")), allowMissingColumns=True)
    live = both.withColumn("three", F.last("three", ignorenulls=True).over(at)).filter("_asks = 1").select("grp", F.col("t").alias("at"), F.explode(F.array_compact("three")).alias("r"))
    return live.filter(F.col("at") <= F.col("r.t") + reach).select("grp", "at", "r.event_id")


@query("""WITH q AS (SELECT conv_id, turn, coalesce(text, '') || ' wait ' || (conv_id % 90) || CASE turn % 4 WHEN 0 THEN '.5 minutes' WHEN 1 THEN ' s' WHEN 2 THEN 'm' ELSE ' hours' END || ' please' AS t FROM conversations),
p AS (SELECT *, regexp_extract(lower(t), '(\\d+(?:\\.\\d+)?)\\s*(minutes?|mins?|m\\b|seconds?|secs?|s\\b)', ['n', 'u']) AS m FROM q) SELECT conv_id, turn, CASE WHEN m.n <> '' THEN TRY_CAST(m.n AS DOUBLE) * CASE WHEN m.u LIKE 'm%' THEN 60 ELSE 1 END END AS seconds FROM p""")
def durations_in_turns(spark, sf_dir):
    """The first duration of each whole turn of the conversations, with one said at its end."""
    from tidemark.functions.text import duration_seconds

    turn = F.col("turn") % 4
    unit = F.when(turn == 0, ".5 minutes").when(turn == 1, " s").when(turn == 2, "m").otherwise(" hours")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" wait "), (F.col("conv_id") % 90).cast("string"), unit, F.lit(" please"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", duration_seconds(said).alias("seconds"))


# ---- functions over whole tables, a row each


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, CASE turn % 4 WHEN 0 THEN '  YES, ' WHEN 1 THEN 'no. ' WHEN 2 THEN 'True ' ELSE 'nothing ' END || conv_id || '.5 & <b>"q"</b> ' || coalesce(text, '') AS said FROM conversations)
SELECT conv_id, turn, TRY_CAST(regexp_extract(said, '(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS number, CASE WHEN regexp_matches(lower(trim(said)), '^(yes|true)\b') THEN 'yes' WHEN regexp_matches(lower(trim(said)), '^(no|false)\b') THEN 'no' END AS verdict,
sha256(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, sha256(regexp_replace(said, '[^A-Za-z0-9._-]+', '_', 'g')) AS file, sha256(conv_id || chr(0) || t || chr(0))[:16] AS key FROM c""")
def told_in_turns(spark, sf_dir):
    """Numbers, verdicts, escaped text, file names and keys of whole turns."""
    from tidemark.functions import text as x

    turn = F.col("turn") % 4
    head = F.when(turn == 0, "  YES, ").when(turn == 1, "no. ").when(turn == 2, "True ").otherwise("nothing ")
    whole = F.coalesce("text", F.lit(""))
    said = F.concat(head, F.col("conv_id").cast("string"), F.lit('.5 & <b>"q"</b> '), whole)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", x.first_number(said).alias("number"), x.yes_or_no(said).alias("verdict"), F.sha2(x.escape_html(said), 256).alias("escaped"), F.sha2(x.file_name(said), 256).alias("file"), x.digest(F.col("conv_id"), whole).alias("key"))


@query(f"""WITH {OBS} SELECT event_id, CASE WHEN k % 4 > 1 THEN v END AS clean, k - (k % 7 + k % 11) / 2e0 AS redness, CASE WHEN v * 10 <= 300 THEN 10 WHEN v * 10 <= 900 THEN 6 WHEN v * 10 <= 1800 THEN 4 ELSE 2 END AS rate, strftime(make_timestamp(us), '%Y-%m-%d %H:%M') AS clock,
round(20 * log10(sqrt(((k / 64e0) * (k / 64e0) + (k / 32e0) * (k / 32e0)) / 2 + 1e-12) + 1e-9), 6) AS db FROM obs""")
def signal_values(spark, sf_dir):
    """Finite values, clock times, redness, loudness and sample rates."""
    from tidemark.functions import text as x
    from tidemark.operators import signal
    from tidemark.sources.tables import sample_rate

    k, v = F.col("k"), F.col("v")
    odd = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("-inf")).otherwise(v)
    return observations(spark, sf_dir).select(
        "event_id", x.finite(odd).alias("clean"), signal.redness(k, k % 7, k % 11).alias("redness"), sample_rate(v * 10).alias("rate"),
        x.clock(F.timestamp_micros("us")).alias("clock"), F.round(signal.decibel(F.array(k / 64.0, k / 32.0)), 6).alias("db"),
    )


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(greatest(0e0, least(1e0, (list_cosine_similarity(e, m) - 0.80e0) / 0.18e0)), 6) AS likeness FROM v JOIN c USING (label)""")
def likeness_to_centre(spark, sf_dir):
    """How like each vector is its label's centre, on the scale of appearances."""
    from tidemark.functions import vectors as vec

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    parts = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return e.join(centre, "label").select("vec_id", F.round(vec.rescaled_cosine(F.col("e"), F.col("m")), 6).alias("likeness"))


# ---- sinks and sources read back (S1, S2, S7, S8, S9), zones as they are drawn


@query(f"WITH {OBS} SELECT gid, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(v), 4) AS total, count(DISTINCT cls) AS types, 3 + gid % 4 AS stop_min FROM obs GROUP BY gid")
def sinks_read_back(spark, sf_dir):
    """Observations as CSV and as a log by video, a config as JSON; read back and joined."""
    from tidemark.sources.tables import read_config, read_csv, write_csv, write_log

    obs = observations(spark, sf_dir)
    csv, log, config = (fresh_path(spark, n) for n in ("csv", "log", "config"))
    write_csv(obs.select("event_id", "gid", "k", F.concat(F.lit('a "'), "cls", F.lit('", b')).alias("cls")), csv)
    write_log(obs.select((F.col("gid") % 10).alias("video_id"), "event_id", "v"), log)
    obs.select("gid").distinct().select("gid", F.struct((3 + F.col("gid") % 4).alias("stop_min")).alias("rules")).write.json(config)
    rows = read_csv(spark, csv, "event_id long, gid long, k int, cls string").join(spark.read.schema("event_id long, v double, video_id long").parquet(log), "event_id")
    told = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.round(F.sum("v"), 4).alias("total"), F.countDistinct(F.regexp_extract("cls", 'a "(.*)", b', 1)).alias("types"))
    rules = read_config(spark, config, "gid long, rules struct<stop_min: long>", lines=True)
    return told.join(rules, "gid").select("gid", "n", "k", "total", "types", "rules.stop_min")


@query(f"""WITH {OBS}, lg AS (SELECT gid % 10 AS video_id, us // 1000000 AS st, event_id, cls, k FROM obs), ht AS (SELECT video_id, k % 7 AS question, arg_max('answer <' || event_id || '>', event_id) AS a FROM lg GROUP BY ALL),
ln AS (SELECT video_id, '<tr><td>' || CAST(k % 3 AS VARCHAR) || '</td><td>' || event_id || '</td><td>' || cls || ' &amp; more</td></tr>' AS v FROM lg WHERE cls = 'error' UNION ALL SELECT video_id, '<tr><td>q' || question || '?</td><td>' || replace(replace(a, '<', '&lt;'), '>', '&gt;') || '</td></tr>' FROM ht
UNION ALL SELECT video_id, '<tr><td>E' || event_id || '</td><td>at ' || st || '</td><td>' || cls || '</td><td>k ' || k || '</td></tr>' FROM lg)
SELECT video_id, count(*) + 4 AS lines, CAST(sum(strlen(v)) AS BIGINT) AS row_bytes, min(v) AS least, max(v) AS greatest FROM ln GROUP BY video_id""")
def report_pages(spark, sf_dir):
    """A page a video with findings, the questions' last answers and the whole log, written by the executors and read back."""
    from tidemark.sources.tables import report_lines, write_report

    obs = observations(spark, sf_dir).withColumn("video_id", F.col("gid") % 10)
    e = F.col("event_id").cast("string")
    log = obs.select("video_id", F.floor(F.col("us") / 1_000_000).alias("start"), F.concat(F.lit("E"), e).alias("id"), F.concat(F.lit("at "), F.floor(F.col("us") / 1_000_000).cast("string")).alias("when"), F.col("cls").alias("type"), F.concat(F.lit("k "), F.col("k").cast("string")).alias("details"))
    findings = obs.filter("cls = 'error'").select("video_id", (F.col("k") % 3).alias("section"), F.col("event_id").alias("start"), F.concat("cls", F.lit(" & more")).alias("details"))
    history = obs.select("video_id", F.col("event_id").alias("asked"), F.concat(F.lit("q"), (F.col("k") % 7).cast("string"), F.lit("?")).alias("question"), F.concat(F.lit("answer <"), e, F.lit(">")).alias("answer"))
    path = fresh_path(spark, "report")
    write_report(path, report_lines(log, findings, history))
    row = F.col("value").startswith("<tr>")
    read = spark.read.schema("value string, video_id long").text(path)
    return read.groupBy("video_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.when(row, F.octet_length("value"))).cast("long").alias("row_bytes"), F.min(F.when(row, F.col("value"))).alias("least"), F.max(F.when(row, F.col("value"))).alias("greatest"))


@query(f"""WITH {OBS}, p AS (SELECT gid, list({{'x': (k * 13 % 101) / 97e0 - 0.02e0, 'y': (event_id % 89) / 83e0 - 0.03e0}} ORDER BY us, event_id) AS p FROM obs GROUP BY gid), t AS (SELECT gid, p, list_filter(p, lambda q, i: (i - 1) % greatest(1, len(p) // 5) = 0) AS thin FROM p)
SELECT gid, round(list_min(list_transform(p, lambda q: q.x)), 9) AS x1, round(list_max(list_transform(p, lambda q: q.y)), 9) AS y2, len(thin) AS n, round(list_sum(list_transform(thin, lambda q: round(greatest(0e0, least(1e0, q.x)), 4))), 4) AS sum_x, round(list_sum(list_transform(thin, lambda q: round(greatest(0e0, least(1e0, q.y)), 4))), 4) AS sum_y FROM t""")
def drawn_zones(spark, sf_dir):
    """Bounding boxes of drawn points, and the points clamped, rounded and thinned."""
    point = F.struct("us", "event_id", (F.col("k") * 13 % 101 / 97.0 - 0.02).alias("x"), (F.col("event_id") % 89 / 83.0 - 0.03).alias("y"))
    drawn = observations(spark, sf_dir).groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("p"))
    box, tidy = g.bounding_box(F.col("p")), g.tidy_polygon(F.col("p"), 5)
    total = lambda axis: F.round(F.aggregate(F.transform(tidy, lambda q: q[axis]), F.lit(0.0), lambda s, q: s + q), 4)
    return drawn.select("gid", F.round(box["x1"], 9).alias("x1"), F.round(box["y2"], 9).alias("y2"), F.size(tidy).cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))
