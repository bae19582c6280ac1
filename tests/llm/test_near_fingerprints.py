"""Operator 7's block tables against a plain loop over all fingerprints."""

import random

from tidemark.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def far(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_query_counts_what_is_near(spark):
    rows = queries.op7_simhash(spark, SF).collect()
    different = {r.fingerprint for r in rows}
    asked = [r for r in rows if r.doc_id % 50 == 0]
    assert asked and all(r.n_near == sum(0 < far(r.fingerprint, f) <= 3 for f in different) for r in asked)
    assert all(r.n_near is None for r in rows if r.doc_id % 50)


def test_a_key_that_many_share(spark):
    """Two thousand fingerprints with equal upper halves, so that all share a key of one table, and copies of one."""
    rng = random.Random(12)
    base = rng.getrandbits(128)
    prints = [base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for _ in range(2_000)] + [base] * 500 + [rng.getrandbits(128) for _ in range(50)]
    rows = [(i, f"{p % (1 << 128):032x}") for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    different, asked = {f for _, f in rows}, {f for i, f in rows if i % 50 == 0}
    got = {r.fingerprint: r.n_near for r in simhash.count_near(df.filter("doc_id % 50 = 0"), df).collect()}
    assert got == {f: sum(0 < far(f, x) <= 3 for x in different) for f in asked} and max(got.values()) > 20
    assert simhash.count_near(df.limit(0), df).collect() == [] and {r.n_near for r in simhash.count_near(df, df.limit(0)).collect()} == {0}
