"""Tiles of the masked Gram product: what is sent, and items of more raters than a tile takes."""

from affinity.operators import gram as G


def test_raters_of_a_hot_item_in_several_tiles(spark, monkeypatch):
    rows = [(u, 0, 1.0 + u % 5) for u in range(40)] + [(u, 1 + u % 6, 2.0 + u % 3) for u in range(40)]
    train = spark.createDataFrame(rows, "user long, item long, rating double")
    test = spark.createDataFrame([(u, i, 1.0) for u in range(0, 40, 5) for i in (0, 2, 9)], "user long, item long, rating double")
    answer = lambda: sorted(map(tuple, G.ranked_raters(test, train, 7, 3).collect()))
    whole = answer()
    monkeypatch.setattr(G, "RATERS", 6)
    monkeypatch.setattr(G, "MATCHES", 10)
    assert whole and answer() == whole


def test_a_user_goes_to_one_tile_however_many_raters_there_are(spark):
    """The rows sent for a block of users don't grow with the number of all users."""
    train = spark.createDataFrame([(u, u // 2, 3.0) for u in range(400)], "user long, item long, rating double")
    test = spark.createDataFrame([(u, u // 2, 1.0) for u in range(400)], "user long, item long, rating double")
    plan = G.ranked_raters(test, train, 5, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "[0,1,2" not in plan.replace(" ", "")
