"""Operator 13 against its SQL twin, and its layers against a plain search of all edits."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tidemark.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def twin(turns, sql=repair.SQL):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(t) for t in turns])
    return con.execute(sql)


def test_query_equals_its_sql(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got, want = queries.op13_conversation_repair(spark, SF), twin(turns, queries.ORACLES["op13_conversation_repair"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain(codes):
    """Cost and audit: all edits by a best-first order of (cost, audit) a state, in full."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {0: (0, "")}

    def insert(best):
        out = dict(best)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                for x in "ua":
                    if (x, q) in step:
                        new = (c + 5, a + "I")
                        out[step[x, q]] = min(out.get(step[x, q], new), new)
        return out

    for code in codes:
        role, fault = "sua?"[code % 4], code // 4
        after = {}
        for q, (c, a) in insert(best).items():
            ways = [(q, c + 2, "D")]
            if fault < 2:
                ways += [(step[role, q], c + 5 * fault, "K")] if (role, q) in step else []
                ways += [(step[x, q], c + 5 * fault + 1, "R") for x in "ua" if (x, q) in step]
            for to, cost, letter in ways:
                after[to] = min(after.get(to, (cost, a + letter)), (cost, a + letter))
        best = after
    best = insert(best)
    return min(best[q] for q in (0, 3) if q in best)


def edits(plans):
    return "".join({"U": "I", "A": "I", "u": "R", "a": "R"}.get(x, x) for p in plans for x in p)


@pytest.mark.parametrize("block", [128, 3])
def test_layers_give_the_least_edits(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    repair.transfer.cache_clear()
    rng = random.Random(block)
    for _ in range(600):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 8, 13]) for _ in range(rng.randint(0, 12)))
        cost, audit = plain(codes)
        assert edits(repair.walk(codes, repair.ACCEPT, 0)[0]) == audit
        ways = repair.transfer(codes)
        assert min(ways[0], ways[12]) == cost
    repair.transfer.cache_clear()


def awkward():
    rng, said = random.Random(8), ["Yes.", "No", "Well?", "", " \t", "Yes.", "Of course!", "x" * 70_000, "日本。"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "User"]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 9))]
    turns += [(100, t, ("user", "assistant")[t % 2], f"Line {t // 7}." if t % 5 else "cut") for t in range(2_500)]
    turns += [(101, None, "user", "Hi."), (101, 3, None, None), (101, 3, "assistant", "A."), (101, 9, "assistant", "A."), (102, 4, "", "x."), (103, None, None, None)]
    return turns + turns[:20]


@pytest.mark.parametrize("bits", [16, 4])
def test_awkward_conversations(spark, monkeypatch, bits):
    """With small segments the folds over many of them are what gives the result."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    turns = awkward()
    df = spark.createDataFrame([(*t, "c", 1) for t in turns], "conv_id long, turn long, role string, text string, code string, place int").repartition(3)
    got = sorted(map(tuple, repair.repair_damaged(df).collect()))
    assert got == sorted(twin(turns).fetchall())


def test_null_ids_and_empty_tables(spark):
    rows = [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    kept = [r for r in rows if zlib.crc32(f" :{r[1]}".encode()) % 20 > 4]
    got = repair.repair_damaged(df).collect()
    assert len(kept) == 2 and len(got) == 1 and got[0].conv_id is None and got[0].audit == "KK"
    assert got[0].repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()
    assert repair.repair_damaged(df.limit(0)).collect() == []
