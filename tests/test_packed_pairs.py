"""Lists of members sent as bytes: every number comes back, and the pairs are those of plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import gram as G
from affinity.operators import llr as L
from affinity.operators import packed_pairs as P


def test_numbers_come_back():
    x = np.array([0, 1, -1, 63, 64, 127, 128, 2**31, -2**31, 2**62, -2**63, 2**63 - 1], np.int64)
    data, at = P.written(P.folded(x))
    assert (P.unfolded(P.read(data)) == x).all() and at[-1] == len(data)
    assert at[1] == 1  # a byte for a small number


def _brute(rows):
    members, want = defaultdict(list), Counter()
    for u, i, r in rows:
        members[i].append((u, r))
    for own in members.values():
        for a, x in own:
            for b, y in own:
                want[a, b] += x * y
    return want


@pytest.mark.parametrize("rating", [lambda r: 1.0, lambda r: float(r.randint(1, 5)), lambda r: r.choice([0.5, -2.25, 4.0])])
def test_sums_of_ratings(spark, monkeypatch, rating):
    """Far apart, negative and the largest users; ratings that are all 1, whole or not; repeated rows; hot users."""
    rnd = random.Random(3)
    users = [-2**63, 2**63 - 1, -5, 0, 7, *(rnd.randrange(10**12) for _ in range(40))]
    rows = [(u, i, rating(rnd)) for i in range(30) for u in rnd.sample(users, 6)]
    rows += rows[:10] + [(7, i, 2.0) for i in range(30)]
    want = _brute(rows)
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    monkeypatch.setattr(P, "PAIRS_HELD", 16)
    for hot, block in ((1000, 1000), (3, 1000), (1000, 3)):
        monkeypatch.setattr(L, "HOT_USERS", hot)
        half = L.half_pairs(df, ["rating"], F.sum(F.col("rating_a") * F.col("rating_b")).alias("g"), block, product="g")
        assert "list" in half._jdf.queryExecution().analyzed().toString()
        found = {(r.a, r.b): r.g for r in half.collect()}
        assert found.keys() == {k for k in want if k[0] <= k[1]}
        assert all(abs(found[k] - want[k]) < 1e-9 for k in found)
    assert {(r.a, r.b) for r in G.gram_similarity(df).collect()} == set(want)


def test_lists_take_a_few_bytes_an_entry(spark):
    """The shuffled rows hold bytes, not arrays of users, counts and totals."""
    rows = spark.range(3000).selectExpr("id AS user", "explode(sequence(0L, 9L)) AS k").selectExpr("user", "pmod(xxhash64(user, k), 1000) AS item")
    weighted = L.weighted_interactions(rows).withColumn("n", F.lit(10).cast("long"))
    half = L.cooccurrence(weighted, with_totals=True, half=True)
    plan = half._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [a#" in plan and "arrays_zip" not in plan
    assert half.agg(F.sum("k11")).first()[0] == sum(
        r.s for r in weighted.groupBy("item").agg(F.expr("(sum(cnt) * sum(cnt) + sum(cnt * cnt)) div 2").alias("s")).collect())


def test_null_measures_and_users_of_other_types(spark):
    rows = [("x", 1, 2.0), ("y", 1, None), ("x", 2, 1.0), ("z", 2, 3.0)]
    found = {(r.a, r.b): r.g for r in G.gram_similarity(spark.createDataFrame(rows, "user string, item long, rating double")).collect()}
    assert found[("x", "x")] == 5.0 and found[("x", "z")] == 3.0 and found[("x", "y")] is None
    rows = [(1, 1, 2.0), (2, 1, None), (1, 2, 1.0), (3, 2, 3.0)]
    found = {(r.a, r.b): r.g for r in G.gram_similarity(spark.createDataFrame(rows, "user int, item long, rating double")).collect()}
    assert found[(1, 1)] == 5.0 and found[(1, 3)] == 3.0 and found[(1, 2)] is None
