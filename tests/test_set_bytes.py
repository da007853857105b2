"""Nearest sets by lists of members that are sent as bytes."""

from affinity.operators import set_lists as S


def test_lists_are_sent_as_bytes(spark):
    """Ids far apart, negative and the largest; a null id keeps the arrays."""
    ids = [-2**63, -9, 0, 5, 10**12, 2**63 - 1]
    rows = [(x, [1, 2, 3][: 1 + i % 3] + [10 + i]) for i, x in enumerate(ids)]
    pts = spark.createDataFrame(rows, "id long, vec array<int>")
    best = S.set_candidates(pts, pts, 5, "hamming", [], 40, True, None)
    assert ", list#" in best._jdf.queryExecution().optimizedPlan().toString()
    want = {(x, y): len(set(v) ^ set(w)) for x, v in rows for y, w in rows if x != y}
    assert {(r.id, r.nbr): r.dist for r in best.collect()} == want
    pts, want = pts.filter(f"id > {-2**63 + 1}"), {k: d for k, d in want.items() if min(k) > -2**63}  # null takes the number below
    odd = pts.unionByName(spark.createDataFrame([(None, [1, 2])], pts.schema))
    best = S.set_candidates(odd, odd, 9, "hamming", [], 40, True, None)
    assert ", list#" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.nbr): r.dist for r in best.collect() if r.id is not None and r.nbr is not None} == want
