"""Prediction with a test user that holds a third of all test rows."""

import random

from pyspark.sql import functions as F

from affinity.operators import predict as P
from affinity.operators.skew import SALT, split_hot


def test_hot_keys_are_split_and_nothing_else(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 1002)] + [(None, 1)], "user long, item long")
    other = spark.createDataFrame([(u, n) for u in (1, 2, None) for n in range(3)], "user long, nbr long")
    left, right = split_hot(rows, "user", "item", other, hot_keys=50)
    assert left.columns == ["user", "item", SALT] and left.count() == 1501
    salts = left.filter("user = 1").groupBy(SALT).count().collect()
    assert len(salts) >= 12 and max(r["count"] for r in salts) < 100
    assert left.filter(f"user > 1 AND {SALT} <> 0").count() == 0
    joined = left.join(right, ["user", SALT])
    assert joined.count() == 500 * 3 + 3 == joined.distinct().count()
    assert sorted(left.join(right, ["user", SALT]).select("user", "item", "nbr").collect()) == sorted(rows.join(other, "user").select("user", "item", "nbr").collect())


def test_predictions_of_a_hot_user(spark):
    rnd = random.Random(4)
    train = {(u, i): float(rnd.randint(1, 5)) for u in range(30) for i in range(40) if rnd.random() < 0.4}
    test = {(0, i): 3.0 for i in range(40)} | {(u, rnd.randrange(40)): 2.0 for u in range(1, 30)}
    near = {(u, n): round(rnd.random(), 3) for u in range(30) for n in rnd.sample(range(30), 6) if n != u}
    df = lambda d, names: spark.createDataFrame([(*k, v) for k, v in d.items()], names)
    te, tr = df(test, "user long, item long, rating double"), df(train, "user long, item long, rating double")
    nb = df(near, "id long, nbr long, dist double").withColumn("rnk", F.lit(1).cast("long"))
    items, users = {i for _, i in train}, {u for u, _ in near}
    want = {}
    for u, i in test:
        if u in users and i in items:
            found = [(w, train[n, i]) for (v, n), w in near.items() if v == u and (n, i) in train]
            want[u, i] = round(sum(w * r for w, r in found) / sum(w for w, _ in found), 6) if found else 0.0
    got = {(r.user, r.item): r.predicted for r in P.predict(te, tr, nb).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 for k in want)
    by_k = {(r.user, r.item): r.predicted for r in P.predict_by_k(te, tr, nb, [5]).collect()}
    assert by_k.keys() == want.keys() and all(abs(by_k[k] - want[k]) <= 1e-6 for k in want)
