"""A user's SELECT: what is refused, and that what is allowed means what it says."""

import pytest

from tidemark.plans import usersql
from tidemark.plans.usersql import Refused, select

REFUSED = [
    "DROP TABLE events", "CREATE TABLE x AS SELECT * FROM events", "CREATE TEMPORARY VIEW v AS SELECT 1", "INSERT INTO events SELECT * FROM events", "SET spark.sql.shuffle.partitions = 1", "SHOW TABLES", "DESCRIBE events", "EXPLAIN SELECT 1",
    "ADD JAR '/tmp/x.jar'", "CACHE TABLE events", "USE default", "REFRESH 'x'", "CALL x.y()", "BEGIN SELECT 1; END", "DECLARE v INT", "EXECUTE IMMEDIATE 'DROP TABLE events'", "MERGE INTO events USING ids ON true WHEN MATCHED THEN DELETE",
    "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`", "SELECT * FROM csv.`/tmp`", "SELECT * FROM `text`.`/etc/passwd`", "SELECT * FROM other", "SELECT * FROM default.events", "SELECT * FROM global_temp.events",
    "SELECT * FROM events JOIN text.`/etc/passwd` ON true", "WITH a AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM a", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "SELECT * FROM events WHERE type IN (SELECT value FROM text.`/etc/passwd`)",
    "SELECT * FROM events WHERE EXISTS (SELECT 1 FROM other)", "SELECT * FROM events, LATERAL (SELECT * FROM other)", "SELECT * FROM IDENTIFIER('text.`/etc/passwd`')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'PATH')",
    "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT java_method('java.lang.Runtime', 'getRuntime')", "SELECT try_reflect('java.lang.System', 'getenv', 'PATH')", "SELECT system.builtin.reflect('java.lang.System', 'exit', 0)", "SELECT `reflect`('java.lang.System', 'getenv')",
    "SELECT count(*) FILTER (WHERE reflect('a', 'b') = '1') FROM events", "SELECT transform(array(1), x -> reflect('a', 'b')) FROM events", "SELECT max(type) OVER (ORDER BY java_method('a', 'b')) FROM events", "SELECT * FROM events ORDER BY reflect('a', 'b')",
    "SELECT * FROM events LATERAL VIEW stack(2, 1, 2) t AS x", "SELECT * FROM range(10)", "SELECT * FROM read_files('/tmp')", "SELECT input_file_name() FROM events", "SELECT current_user() FROM events", "SELECT current_user FROM events", "SELECT session_user FROM events", "SELECT version()", "SELECT secret_udf(type) FROM events",
    "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE events", "SELECT 1) UNION ALL (SELECT 2", "SELECT 1 FROM events) a, (SELECT * FROM text.`/etc/passwd`", "", "  ", "SELECT", "SELECT TRANSFORM(type) USING 'cat' AS x FROM events", "FROM events |> WHERE true |> SELECT reflect('a', 'b')",
    "SELECT * FROM events TABLESAMPLE (10 PERCENT)", "TABLE other", "SELECT ai_query('x') FROM events", "SELECT :x", "SELECT ?",
]


@pytest.fixture(scope="module")
def tables(spark):
    log = spark.createDataFrame([("v", "in_zone", "P1", 61.25, "x"), ("v", "in_zone", "P2", 3700.0, "from events"), ("v", "sound", None, None, "SELECT; drop")], "video_id string, type string, subject string, start double, details string")
    spark.udf.register("secret_udf", lambda x: x)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW other AS SELECT 1 AS x")
    return {"events": log, "ids": log.select("video_id", "subject").distinct()}


@pytest.mark.parametrize("text", REFUSED)
def test_refused(tables, text):
    with pytest.raises((Refused)):
        select(tables, text)


def test_what_is_allowed(spark, tables):
    before = {t.name for t in spark.catalog.listTables()}
    one = lambda text: [tuple(r) for r in select(tables, text).collect()]
    assert one("SELECT details FROM events WHERE details = 'from events'") == [("from events",)]
    assert one("SELECT 'from events; DROP TABLE ids' AS x, '{events}' AS y;") == [("from events; DROP TABLE ids", "{events}")]
    assert one("SELECT fmt(start) AS x FROM EVENTS ORDER BY start NULLS FIRST -- done") == [("—",), ("1:01.3",), ("1:01:40.0",)]
    assert one("WITH events AS (SELECT 7 AS n) SELECT n FROM events") == [(7,)]
    assert one("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT max(n) FROM r") == [(3,)]
    assert one("SELECT e.subject FROM events e LEFT JOIN ids i USING (video_id, subject) LATERAL VIEW explode(array(1, 2)) t AS q WHERE q = 2 AND i.subject IS NOT NULL ORDER BY 1 DESC LIMIT 1") == [("P2",)]
    assert one("SELECT * FROM (VALUES (1), (2)) AS t(x) EXCEPT SELECT 2") == [(1,)]
    assert one("SELECT type, count(*) FROM events GROUP BY type HAVING count(*) > 1 UNION ALL SELECT 'z', (SELECT count(*) FROM ids)") == [("in_zone", 2), ("z", 3)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_code_behind_an_allowed_name_is_refused(tables, monkeypatch):
    monkeypatch.setattr(usersql, "FUNCTIONS", usersql.FUNCTIONS | {"secret_udf", "reflect"})
    for text in ("SELECT secret_udf(type) FROM events", "SELECT 1 FROM events WHERE reflect('java.lang.Math', 'abs', 1) = '1'"):
        with pytest.raises(Refused, match="not allowed"):
            select(tables, text)
