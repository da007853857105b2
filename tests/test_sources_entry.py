"""Text sources/sinks round trips and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

from affinity.sources import sinks as Z
from affinity.sources import text as X


def _write(path, lines):
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_interactions_regex_separator_and_orientation(spark, scratch):
    p = os.path.join(scratch, "ints.txt")
    _write(p, ["u1::a", "u2::b", "broken"])
    users = X.read_interactions(spark, p, sep="::").collect()
    assert [(r.user, r.item) for r in users] == [("u1", "a"), ("u2", "b")]
    items = X.read_interactions(spark, p, sep="::", mode="item").collect()
    assert [(r.user, r.item) for r in items] == [("a", "u1"), ("b", "u2")]


def test_triplets_weights_and_malformed_rows(spark, scratch):
    p = os.path.join(scratch, "trip.txt")
    _write(p, ["(1,2,0.5)", "(3,4)", "(5,x,1.0)", "(6,7,oops)"])
    rows = [tuple(r) for r in X.parse_triplets(X.read_lines(spark, p)).collect()]
    assert rows == [(1, 2, 0.5), (3, 4, 1.0), (6, 7, 1.0)]
    unweighted = [r.weight for r in X.parse_triplets(X.read_lines(spark, p), weighted=False).collect()]
    assert unweighted == [1.0, 1.0, 1.0]
    lab = [tuple(r) for r in X.parse_labelled_edges(X.read_lines(spark, p)).collect()]
    assert ("5", "x", 1.0) in lab


def test_embeddings_header_and_ratings(spark, scratch):
    p = os.path.join(scratch, "emb.txt")
    _write(p, ["id a b", "1 0.5 1.5", "2 1 2"])
    rows = {r.id: r.vec for r in X.parse_embeddings(X.read_lines(spark, p), header=True).collect()}
    assert rows == {1: [0.5, 1.5], 2: [1.0, 2.0]}
    r = os.path.join(scratch, "rat.txt")
    _write(r, ["1,10,4", "", "2,11,3.5"])
    assert X.parse_ratings(X.read_lines(spark, r)).count() == 2
    q = os.path.join(scratch, "pred.txt")
    _write(q, ["(1,10,4.0,3.5)", " ", "(2,11,3.0,2.0)"])
    assert X.parse_predictions(X.read_lines(spark, q)).count() == 2


def test_sinks_round_trip(spark, scratch):
    walks = spark.createDataFrame([(0, 1, [1, 2, 3])], "walk int, start long, path array<long>")
    out = os.path.join(scratch, "walks")
    Z.write_text(Z.format_walks(walks), out, single_file=True)
    corpus = X.parse_walks(X.read_lines(spark, out)).collect()
    assert [list(r.tokens) for r in corpus] == [["1", "2", "3"]]
    nodes = spark.createDataFrame([("c1", 0), ("c2", 1)], "name string, id long")
    lines = nodes.select(F.concat_ws(" ", "name", F.col("id").cast("string")).alias("value"))
    assert sorted(tuple(r) for r in X.parse_node_index(lines).collect()) == [("c1", 0), ("c2", 1)]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert set(df.columns) == {"a", "b", "similarity"} and df.count() > 0
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    assert {q for q in set(qs) - set(sql) if q.startswith("q_")} == {"q_w2v_vectors", "q_end_to_end"}


@pytest.mark.parametrize("name", ["q_interactions", "q_cap", "q_knn_reference", "q_rmse"])
def test_catalogue_queries_against_duckdb(spark, name):
    import duckdb
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row)
                             for row in df[cols].itertuples(index=False))
    assert norm(got) == norm(want)


def test_entry_without_tokenizer_package():
    """The catalogue is there where what the corpus operators import isn't."""
    import subprocess
    import sys
    from pathlib import Path

    code = ("import sys, warnings; warnings.simplefilter('ignore'); sys.modules['public_tokenizers'] = None; sys.path.insert(0, sys.argv[1])\n"
            "import __spark_entry__ as e; assert 'q_llr_user' in e.queries() and not any(n.startswith('op') for n in e.queries())")
    subprocess.run([sys.executable, "-c", code, str(Path(__file__).parents[1])], check=True, cwd="/")


def test_lines_are_split_once(spark):
    """Checks of the parsed fields don't repeat the parsing, and drop the same lines."""
    from affinity.operators import graph as H
    from affinity.sources import text as X
    lines = spark.createDataFrame([("(1,2,0.5)",), ("(3, 4 )",), ("(x,2,1)",), ("7",), ("",), (None,), ("(,5,1)",), ("5,5,bad",)], "value string")
    for parse in (X.parse_triplets, X.parse_labelled_edges):
        assert parse(lines)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, X.parse_triplets(lines).collect())) == [(1, 2, 0.5), (3, 4, 1.0), (5, 5, 1.0)]
    assert sorted(map(tuple, X.parse_labelled_edges(lines).collect())) == [("1", "2", 0.5), ("3", "4", 1.0), ("5", "5", 1.0), ("x", "2", 1.0)]
    enc, _ = H.index_graph(X.parse_labelled_edges(lines))
    assert sorted((r.src_name, r.dst_name) for r in H.both_ways(enc).collect()) == [
        ("1", "2"), ("2", "1"), ("2", "x"), ("3", "4"), ("4", "3"), ("5", "5"), ("x", "2")]
    assert "SortMergeJoin" not in enc._jdf.queryExecution().executedPlan().toString()
