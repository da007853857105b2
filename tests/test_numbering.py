"""Dense numbers over ranges: order, ties, start, empty input, more ranges than rows."""

import random

from pyspark.sql import functions as F

from affinity.operators.graph import node_index
from affinity.operators.numbering import number_rows


def test_numbers_follow_the_order(spark):
    values = [random.Random(1).randint(0, 500) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(5)
    got = number_rows(df, F.col("v").desc(), "i", start=1, ranges=7).orderBy("number").collect()
    assert [(r.v, r.i, r.number) for r in got] == [
        (-v, i, n) for n, (v, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)]


def test_ties_and_few_rows(spark):
    df = spark.createDataFrame([(1,)] * 40, "v long").repartition(4)
    assert sorted(r.number for r in number_rows(df, "v", ranges=9).collect()) == list(range(40))
    assert number_rows(df.filter("v > 1"), "v").count() == 0
    assert number_rows(df, "v", name="id").columns == ["v", "id"]


def test_node_index(spark):
    edges = spark.createDataFrame([("b", "a", 1.0), ("c", "a", 1.0), (None, "b", 1.0)], "src string, dst string, weight double")
    assert sorted((r.name or "", r.id) for r in node_index(edges).collect()) == [("", 0), ("a", 1), ("b", 2), ("c", 3)]
