"""JSON and code in noisy text against plain loops; registration against outliers; a log as text."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import noisy
from tidemark.operators import registration
from tidemark.plans import context, extras

SF = "/root/testdata/sf0.001"


def plain_json(text):
    """The text of the first object, else array, that the library decodes; marked blocks first."""
    decoder = json.JSONDecoder(parse_constant=lambda x: 1 / 0)
    for chunk in [*re.findall(r"```json\s*(.*?)```", text, re.S), text]:
        for opener in "{[":
            for at in (m.start() for m in re.finditer(re.escape(opener), chunk)):
                try:
                    return chunk[at : at + decoder.raw_decode(chunk[at:])[1]]
                except (json.JSONDecodeError, ZeroDivisionError):
                    pass
    return None


def test_json_equals_a_plain_loop(spark):
    rng = random.Random(7)
    parts = ["{", "}", "[", "]", '"', "\\", '"a"', ":", ",", "1", "null", "word ", '{"a": 1}', "[1, 2]", '{"b": "x } \\" ]"}', "```json\n", "```", "\n", '{"k": [', "]}", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1_500)]
    df = spark.createDataFrame(list(enumerate([*texts, "", "x" * 100_000 + '{"end": true}'])), "i int, t string").repartition(4)
    got = {r.i: r.j for r in df.select("i", noisy.first_json(F.col("t")).alias("j")).collect()}
    want = {i: plain_json(t) for i, t in enumerate([*texts, "", "x" * 100_000 + '{"end": true}'])}
    assert got == want and sum(v is not None for v in want.values()) > 300
    assert spark.range(1).select(noisy.first_json(F.lit(None).cast("string"))).first()[0] is None


def test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.json for r in extras.json_in_pages(spark, SF).collect()}
    assert got == {r.page_id: plain_json(r.html or "") for r in rows}


def test_code_blocks(spark):
    block = lambda body, mark="python": f"```{mark}\n{body}\n```"
    cases = [(block("a = 1"), "a = 1\n"), (block("def answer(): 1") + block("b"), "def answer(): 1\n"), (block("a", "py") + " x " + block("  b\n\n"), "b\n"), (block("a", "sql"), None), ("none", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").orderBy("i").select(noisy.code_block(F.col("t"))).collect()]
    assert got == [w for _, w in cases]


def test_registration_stands_outliers():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.4, 0.6):
        p = rng.random(80) + 1j * rng.random(80)
        m, t = 1.1 * np.exp(0.05j), 0.1 - 0.2j
        q = m * p + t + 0.0005 * (rng.standard_normal(80) + 1j * rng.standard_normal(80))
        wrong = np.arange(80) < share * 80
        q[wrong] = rng.random(wrong.sum()) + 1j * rng.random(wrong.sum())
        found = registration.similarity(p, q, 5)
        assert found and abs(found[0] - m) < 0.005 and abs(found[1] - t) < 0.005
        assert registration.similarity(p, q, 5) == found
    noise = rng.random(80) + 1j * rng.random(80)
    assert registration.similarity(noise, noise[::-1] ** 2, 5) is None and registration.similarity(noise[:19], noise[:19], 5) is None
    assert registration.similarity(np.full(30, 1 + 1j), np.full(30, 2 + 0j), 5) is None


def test_samples_without_a_fit_take_the_last_good_one(spark):
    good = [{"sx": i / 30, "sy": (i * 7 % 30) / 30, "dx": i / 30 + 0.1, "dy": (i * 7 % 30) / 30} for i in range(30)]
    far = [{**x, "dx": x["dx"] + 0.8} for x in good]
    rows = [("v", 0, []), ("v", 1, good), ("v", 2, None), ("v", 3, far), ("w", 2, None)]
    df = spark.createDataFrame(rows, "video string, t int, points array<struct<sx:double,sy:double,dx:double,dy:double>>")
    got = {(r.video, r.t): (r.good, None if r.tx is None else round(r.tx, 6)) for r in registration.fit(df, ["video"], "t").collect()}
    assert got == {("v", 0): (False, None), ("v", 1): (True, 0.1), ("v", 2): (False, 0.1), ("v", 3): (False, 0.1), ("w", 2): (False, None)}


def test_context_keeps_the_first_rows(spark):
    log = spark.createDataFrame([("v", f"E{i:03}", "sound" if i % 2 else "enter_view", float(i), float(i), None, "", "", 'a "b",\nc' if i == 0 else None, 0.5) for i in range(9)], "video_id string, id string, type string, start double, end double, subject string, zone string, other string, details string, confidence double")
    none = spark.createDataFrame([], "video_id string, gid string, kind string, first_seen double, last_seen double")
    text = context.context(log, none, 3).first().context
    assert text == '## Identities\nnone\n## Event counts\nenter_view: 5, sound: 4\n## Events (first 3 of 9)\nid,type,start,end,subject,zone,other,details,confidence\nE000,enter_view,0.00,0.00,,,,"a ""b"",\nc",0.50\nE001,sound,1.00,1.00,,,,,0.50\nE002,enter_view,2.00,2.00,,,,,0.50'
    assert context.context(log, none, 9).first().context.count("## Events\n") == 1
