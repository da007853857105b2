"""Independent DuckDB SQL for the driver's correctness gate.

Written from the operator definitions, not from the Spark code: bindings are
CTEs over the pre-registered parquet views, and scalar maths is spelled out
with CASE guards so no engine-specific NaN/inf/NULL rule is relied on.
"""

from __future__ import annotations

# ---------------------------------------------------------------- bindings
B_INT = ("SELECT DISTINCT o.o_custkey AS user, l.l_partkey AS item "
         "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
B_SUP = ("SELECT o.o_custkey AS user, l.l_suppkey AS item "
         "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
B_EVT = ("SELECT user_id AS user, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS item "
         "FROM events")
B_RAT = ("SELECT o.o_custkey AS user, l.l_partkey AS item, "
         "CAST(max(1 + (CAST(l.l_quantity AS INTEGER) % 5)) AS DOUBLE) AS rating "
         "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2")
B_TRAIN = f"SELECT * FROM ({B_RAT}) r WHERE (r.user * 31 + r.item) % 5 <> 0"
B_TEST = f"SELECT * FROM ({B_RAT}) r WHERE (r.user * 31 + r.item) % 5 = 0"
B_EMB = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
B_SET = (f"SELECT user AS id, list_sort(list(CAST(item AS INTEGER))) AS idx "
         f"FROM ({B_INT}) s GROUP BY user")


def uniform_sql(*parts: str) -> str:
    """u = (first 32 bits of md5('-'-joined parts) + 0.5) / 2^32."""
    key = "concat_ws('-', " + ", ".join(parts) + ")"
    return f"((('0x' || substr(md5({key}), 1, 8))::UBIGINT + 0.5) / 4294967296.0)"


# ---------------------------------------------------------------- LLR
def _xlogx(e: str) -> str:
    return f"(CASE WHEN ({e}) <= 0 THEN 0.0 ELSE CAST({e} AS DOUBLE) * ln(CAST({e} AS DOUBLE)) END)"


def _ent2(a: str, b: str) -> str:
    return f"({_xlogx(f'({a}) + ({b})')} - {_xlogx(a)} - {_xlogx(b)})"


def _ent4(a: str, b: str, c: str, d: str) -> str:
    tot = f"({a}) + ({b}) + ({c}) + ({d})"
    return f"({_xlogx(tot)} - ({_xlogx(a)} + {_xlogx(b)} + {_xlogx(c)} + {_xlogx(d)}))"


def llr_ctes(source: str, mode: str = "user", cap: int | None = None, dedupe: bool = False,
             include_self: bool = True) -> str:
    """CTE chain ending in ``scored(a, b, k11, k12, k21, k22, llr, sim_default,
    sim_max, sim_continuous)``."""
    u, i = ("user", "item") if mode == "user" else ("item", "user")
    sel = "DISTINCT " if dedupe else ""
    capped = ("SELECT user, item FROM ints WHERE user IN (SELECT user FROM ints GROUP BY user "
              f"HAVING count(*) <= {cap}) AND item IN (SELECT item FROM ints GROUP BY item "
              f"HAVING count(*) <= {cap})") if cap is not None else "SELECT user, item FROM ints"
    self_filter = "" if include_self else "WHERE x.user <> y.user"
    return f"""
src AS ({source}),
ints AS (SELECT {sel}{u} AS user, {i} AS item FROM src),
capped AS ({capped}),
w AS (SELECT user, item, count(*) AS cnt FROM capped GROUP BY user, item),
tot AS (SELECT user, CAST(sum(cnt) AS BIGINT) AS n FROM w GROUP BY user),
nn AS (SELECT count(DISTINCT item) AS n FROM w),
pairs AS (SELECT x.user AS a, y.user AS b, CAST(sum(x.cnt * y.cnt) AS BIGINT) AS k11
          FROM w x JOIN w y ON x.item = y.item {self_filter} GROUP BY 1, 2),
cells AS (SELECT p.a, p.b, p.k11, ta.n - p.k11 AS k12, tb.n - p.k11 AS k21,
                 nn.n - ta.n - tb.n + p.k11 AS k22
          FROM pairs p JOIN tot ta ON ta.user = p.a JOIN tot tb ON tb.user = p.b, nn),
ent AS (SELECT *, {_ent2('k11 + k12', 'k21 + k22')} AS rh, {_ent2('k11 + k21', 'k12 + k22')} AS ch,
               {_ent4('k11', 'k12', 'k21', 'k22')} AS mh,
               (k12 < 0 OR k21 < 0 OR k22 < 0) AS bad FROM cells),
lr AS (SELECT *, CASE WHEN bad THEN NULL WHEN rh + ch < mh THEN 0.0 ELSE 2.0 * (rh + ch - mh) END AS llr
       FROM ent),
sim AS (SELECT *, 1.0 - 1.0 / (1.0 + llr) AS sim_default FROM lr),
scored AS (SELECT a, b, k11, k12, k21, k22, llr, sim_default,
                  CASE WHEN greatest(rh, ch) = 0 THEN NULL ELSE sim_default / (2.0 * greatest(rh, ch)) END
                    AS sim_max,
                  sim_default / (1.0 + sim_default) AS sim_continuous FROM sim)"""


def llr_sql(source: str, variant: str = "default", mode: str = "user", threshold: float = 0.6,
            cap: int | None = None, dedupe: bool = False) -> str:
    where = f"WHERE sim_default > {threshold}" if variant == "default" else ""
    return (f"WITH {llr_ctes(source, mode, cap, dedupe)}\n"
            f"SELECT a, b, round(sim_{variant}, 9) AS similarity FROM scored {where}")


# ---------------------------------------------------------------- vectors
def cos_sql(a: str, b: str) -> str:
    return (f"(1.0 - abs(list_dot_product({a}, {b})) / "
            f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))")


def euclid_sql(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda t: (t[1] - t[2]) * (t[1] - t[2]))))")


def manhattan_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))"


def _set_sizes(a: str, b: str) -> tuple[str, str]:
    inter = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {inter})"
    return inter, union


def hamming_sql(a: str, b: str) -> str:
    inter, union = _set_sizes(a, b)
    return f"CAST({union} - {inter} AS DOUBLE)"


def jaccard_sql(a: str, b: str) -> str:
    inter, union = _set_sizes(a, b)
    return f"(CASE WHEN {union} = 0 THEN NULL ELSE 1.0 - {inter} / CAST({union} AS DOUBLE) END)"


DIST_SQL = {"cosine": cos_sql, "euclidean": euclid_sql, "manhattan": manhattan_sql,
            "hamming": hamming_sql, "jaccard": jaccard_sql}


def knn_ctes(points: str, query_ids: str | None, k: int, order: str = "nearest",
             measure: str = "cosine", name: str = "nb") -> str:
    """CTEs ``<name>_p``, ``<name>_q``, ``<name>`` (id, nbr, dist, rnk)."""
    q = (f"SELECT * FROM {name}_p" if query_ids is None
         else f"SELECT * FROM {name}_p WHERE id IN ({query_ids})")
    direction = "ASC" if order == "nearest" else "DESC"
    dist = DIST_SQL[measure]("x.vec", "y.vec")
    return f"""
{name}_p AS ({points}),
{name}_q AS ({q}),
{name}_d AS (SELECT x.id, y.id AS nbr, round({dist}, 6) AS dist
             FROM {name}_q x JOIN {name}_p y ON x.id <> y.id),
{name} AS (SELECT id, nbr, dist, rnk FROM (
             SELECT id, nbr, dist, CAST(row_number() OVER (PARTITION BY id
                    ORDER BY dist {direction} NULLS LAST, nbr ASC) AS BIGINT) AS rnk FROM {name}_d) z
           WHERE rnk <= {k})"""


# ---------------------------------------------------------------- prediction
def predict_ctes(nb: str = "nb", weight: str = "distance", name: str = "preds") -> str:
    """Needs CTEs ``train``, ``test`` and the neighbour CTE ``nb``."""
    w = "n.dist" if weight == "distance" else "(1.0 - n.dist)"
    return f"""
{name}_cov AS (SELECT t.user, t.item, t.rating FROM test t
               WHERE t.user IN (SELECT id FROM {nb}) AND t.item IN (SELECT item FROM train)),
{name}_tr AS (SELECT user, item, max(rating) AS r FROM train GROUP BY 1, 2),
{name}_j AS (SELECT c.user, c.item, c.rating, {w} AS w, tr.r FROM {name}_cov c
             JOIN {nb} n ON n.id = c.user
             LEFT JOIN {name}_tr tr ON tr.user = n.nbr AND tr.item = c.item),
{name}_a AS (SELECT user, item, rating, sum(CASE WHEN r IS NOT NULL THEN w * r END) AS num,
                    sum(CASE WHEN r IS NOT NULL THEN w END) AS den, count(r) AS n_rated
             FROM {name}_j GROUP BY 1, 2, 3),
{name} AS (SELECT user, item, rating,
                  round(CASE WHEN n_rated = 0 THEN 0.0 WHEN den = 0 THEN NULL ELSE num / den END, 6)
                    AS predicted FROM {name}_a)"""


PRED_BASE = f"""train AS ({B_TRAIN}),
test AS ({B_TEST}),""" + knn_ctes(B_EMB, "SELECT user FROM test", 100) + "," + predict_ctes()


def metrics_ctes(preds: str = "preds", k: int = 10, relevant: float = 3.0) -> str:
    """CTEs ``topn``, ``ap``, ``m_rmse``, ``m_map``, ``m_recall`` over ``preds``."""
    return f"""
topn AS (SELECT * FROM (SELECT user, item, rating, predicted,
                CAST(row_number() OVER (PARTITION BY user ORDER BY predicted DESC NULLS LAST, item ASC) AS BIGINT)
                  AS rnk FROM {preds}) z WHERE rnk <= {k}),
rel AS (SELECT user, count(*) AS n_rel FROM {preds} WHERE rating > {relevant} GROUP BY user),
hits AS (SELECT user, rnk, CASE WHEN rating > {relevant} THEN 1 ELSE 0 END AS hit,
                sum(CASE WHEN rating > {relevant} THEN 1 ELSE 0 END) OVER (PARTITION BY user ORDER BY rnk
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM topn),
ap AS (SELECT h.user, coalesce(sum(CASE WHEN hit = 1 THEN cum / rnk END), 0.0) / least(r.n_rel, {k}) AS ap
       FROM hits h JOIN rel r ON r.user = h.user GROUP BY h.user, r.n_rel),
m_rmse AS (SELECT 'rmse' AS metric, sqrt(avg(pow(rating - predicted, 2))) AS value FROM {preds}),
m_map AS (SELECT 'map' AS metric, avg(ap) AS value FROM ap),
m_recall AS (SELECT 'recall' AS metric, avg(coalesce(hh.hits, 0) / r.n_rel) AS value FROM rel r
             LEFT JOIN (SELECT user, count(*) AS hits FROM topn WHERE rating > {relevant} GROUP BY user) hh
             ON hh.user = r.user)"""


# ---------------------------------------------------------------- LSH
def _num(x: float) -> str:
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def _dlist(xs) -> str:
    return "[" + ", ".join(_num(x) for x in xs) + "]"


def _ilist(xs) -> str:
    return "[" + ", ".join(str(int(x)) for x in xs) + "]"


def lsh_signature_sql(lsh, t: int, vec: str = "vec", dim_sql: str | None = None) -> str:
    p, s = lsh.params, lsh.signature
    dim = dim_sql or str(lsh.dim)
    if lsh.measure in ("cosine", "euclidean", "manhattan"):
        planes = "[" + ", ".join(_dlist(row) for row in p["planes"][t]) + "]::DOUBLE[][]"
        if lsh.measure == "cosine":
            return (f"list_filter(range(0, {s}), lambda i: "
                    f"list_dot_product(({planes})[i + 1], {vec}) > 0)")
        offs = _dlist(p["offsets"][t]) + "::DOUBLE[]"
        return (f"list_transform(range(0, {s}), lambda i: CAST(floor((list_dot_product(({planes})[i + 1], "
                f"{vec}) + ({offs})[i + 1]) / {_num(lsh.bucket_width)}) AS INTEGER))")
    if lsh.measure == "hamming":
        us = _dlist(p["sample_u"][t]) + "::DOUBLE[]"
        return (f"list_sort(list_intersect({vec}, list_transform({us}, "
                f"lambda u: CAST(floor(u * {dim}) AS INTEGER))))")
    comps = []
    for j in range(s):
        a, b = int(p["a"][t][j]), int(p["b"][t][j])
        comps.append(f"list_min(list_transform({vec}, lambda x: CAST((((({a}::BIGINT * x + ({b})) % {lsh.prime})"
                     f" + {lsh.prime}) % {lsh.prime}) % {dim} AS INTEGER)))")
    return "[" + ", ".join(comps) + "]"


def lsh_entries_sql(lsh, points: str, dim_sql: str | None = None) -> str:
    """SELECT id, vec, tbl, band, key over the points query."""
    where = "WHERE len(vec) > 0" if lsh.measure == "jaccard" else ""
    if dim_sql:  # subqueries may not appear inside lambdas: bind the scalar to a column
        points = f"SELECT *, {dim_sql} AS _dim FROM ({points}) zz"
    dim_ref = "_dim" if dim_sql else None
    sigs = " UNION ALL ".join(
        f"SELECT id, vec, {t} AS tbl, {lsh_signature_sql(lsh, t, dim_sql=dim_ref)} AS sig "
        f"FROM ({points}) z {where}"
        for t in range(lsh.tables))
    if lsh.measure != "jaccard":
        return f"SELECT id, vec, tbl, 0 AS band, sig AS key FROM ({sigs}) s"
    w = lsh.signature // lsh.bands
    bands = " UNION ALL ".join(
        f"SELECT id, vec, tbl, {b} AS band, list_slice(sig, {b * w + 1}, {(b + 1) * w}) AS key FROM ({sigs}) s"
        for b in range(lsh.bands))
    return bands


def lsh_neighbors_sql(lsh, points: str, k: int, queries: str | None = None,
                      dim_sql: str | None = None) -> str:
    dist = DIST_SQL[lsh.measure]("x.vec", "y.vec")
    if queries is None:
        pairs = ("SELECT DISTINCT a.id, b.id AS nbr FROM ent a JOIN ent b ON a.tbl = b.tbl AND a.band = b.band "
                 "AND a.key = b.key AND a.id <> b.id")
        qsrc, extra = "pts", ""
    else:
        pairs = ("SELECT DISTINCT a.id, b.id AS nbr FROM qent a JOIN ent b ON a.tbl = b.tbl AND a.band = b.band "
                 "AND a.key = b.key")
        qsrc, extra = "qpts", f"qpts AS ({queries}),\nqent AS ({lsh_entries_sql(lsh, 'SELECT * FROM qpts', dim_sql)}),\n"
    return f"""WITH pts AS ({points}),
ent AS ({lsh_entries_sql(lsh, 'SELECT * FROM pts', dim_sql)}),
{extra}pairs AS ({pairs}),
d AS (SELECT p.id, p.nbr, round({dist}, 6) AS dist FROM pairs p
      JOIN {qsrc} x ON x.id = p.id JOIN pts y ON y.id = p.nbr)
SELECT id, nbr, dist, rnk FROM (SELECT id, nbr, dist, CAST(row_number() OVER (PARTITION BY id
       ORDER BY dist ASC NULLS LAST, nbr ASC) AS BIGINT) AS rnk FROM d) z WHERE rnk <= {k}"""
