"""Exact k-nearest neighbours without all-pairs rows.

Plan: queries and points are hashed into blocks, as few as let every task have a
tile and keep a side of a tile under ``TILE_BYTES``, of the two sides those numbers that send the fewest bytes of
vectors and neighbours (with many neighbours one block of points, where these fit). Every (query block, point block) pair becomes one co-group (each side is
replicated once per block of the other side); the group
finds its nearest cells in a single-precision tile (a matrix product; sums by dimension for Manhattan)
with a bound of its error, computes exact distances of those only, and emits its
top-k per query. A final ``row_number() <= k`` (planned as a partial
WindowGroupLimit before the shuffle) merges the per-tile candidates.

Memory per task is sides of ``TILE_BYTES`` and ``POINT_BYTES``, ``ROUGH_CELLS`` rough distances and ``RESULT_BYTES`` of neighbours
(with many neighbours a tile has fewer queries); no task ever sees a whole table, and no row per (query, point) pair is materialised in Spark.

Sets that share few elements meet by lists of the elements' members instead (``set_lists``), so
that pairs without a common element aren't looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_code
from . import set_lists

#: Bytes of vectors on a side of a tile, of the neighbours a tile gives; distances held at once.
TILE_BYTES, RESULT_BYTES, TILE_CELLS = 16 << 20, 96 << 20, 1 << 21
#: Rough distances (single precision) held at once.
ROUGH_CELLS = 1 << 23
#: Bytes of vectors on the side of the points: every block of points gives each query k neighbours.
POINT_BYTES = 64 << 20
#: Pairs whose exact distance is computed at once.
EXACT_PAIRS = 1 << 14
#: Queries and points that meet at once in sums by dimension (these stay in a core's cache).
SUM_ROWS, SUM_COLUMNS = 16, 2048

ORDERS = ("nearest", "reference")
DENSE_MEASURES = ("cosine", "euclidean", "manhattan")
SET_MEASURES = ("hamming", "jaccard")


def distance_tile(q: np.ndarray, p: np.ndarray, measure: str) -> np.ndarray:
    """Distance matrix between query rows and point rows."""
    if measure == "cosine":
        qn = np.sqrt((q * q).sum(axis=1))
        pn = np.sqrt((p * p).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - np.abs(q @ p.T) / (qn[:, None] * pn[None, :])
    if measure in ("euclidean", "manhattan"):
        out = np.empty((len(q), len(p)))
        step = max(1, (1 << 22) // max(1, p.size))  # bound the broadcast temporary to ~32 MB
        for s in range(0, len(q), step):
            diff = q[s:s + step, None, :] - p[None, :, :]
            out[s:s + step] = (np.sqrt((diff * diff).sum(axis=2)) if measure == "euclidean"
                               else np.abs(diff).sum(axis=2))
        return out
    raise ValueError(f"dense measure must be one of {DENSE_MEASURES}")


def set_distance_tile(q: list, p: list, measure: str) -> np.ndarray:
    """Hamming / Jaccard distances between index sets (sorted, distinct).

    Intersections come from an inverted index over the point sets: each
    query element looks up the rows holding it (binary search), and one
    bincount per query row totals the shared elements."""
    qa = [np.asarray(a, dtype=np.int64) for a in q]
    pa = [np.asarray(b, dtype=np.int64) for b in p]
    p_sizes = np.array([len(b) for b in pa], dtype=np.int64)
    q_sizes = np.array([len(a) for a in qa], dtype=np.int64)
    elems = np.concatenate(pa) if len(pa) and p_sizes.sum() else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(pa)), p_sizes)
    order = np.argsort(elems, kind="stable")
    elems, rows = elems[order], rows[order]
    inter = np.zeros((len(qa), len(pa)))
    for i, a in enumerate(qa):
        if len(a) == 0 or len(elems) == 0:
            continue
        lo = np.searchsorted(elems, a, "left")
        hi = np.searchsorted(elems, a, "right")
        span = hi - lo
        if span.sum() == 0:
            continue
        starts = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span)
        hits = rows[starts + np.arange(span.sum())]
        inter[i] = np.bincount(hits, minlength=len(pa))
    union = q_sizes[:, None] + p_sizes[None, :] - inter
    if measure == "hamming":
        return union - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union == 0, np.nan, 1.0 - inter / union)


def pair_distances(q: np.ndarray, p: np.ndarray, rows: np.ndarray, cols: np.ndarray, measure: str) -> np.ndarray:
    """Distances of query rows and point rows, pair by pair."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), EXACT_PAIRS):
        x, y = q[rows[i:i + EXACT_PAIRS]], p[cols[i:i + EXACT_PAIRS]]
        if measure == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i:i + len(x)] = 1.0 - np.abs(np.einsum("ij,ij->i", x, y)) / (
                    np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        else:
            diff = x - y
            out[i:i + len(x)] = np.sqrt((diff * diff).sum(axis=1)) if measure == "euclidean" else np.abs(diff).sum(axis=1)
    return out


class RoughTile:
    """Single-precision distances of queries to the points of a tile, and how far they can be from the
    exact ones: cosine without its 1, squares for Euclid. ``usable`` is false where values are
    so large or small that the bounds don't hold."""

    def __init__(self, p: np.ndarray, measure: str):
        self.measure, dim = measure, p.shape[1]
        self.unit = (dim + 16) * 2.0 ** -22
        self.usable = self._fits(p)
        if not self.usable:
            return
        if measure == "cosine":
            self.points = self._directions(p).T
        else:
            self.centre = np.nan_to_num(np.nanmean(p, axis=0) if not np.isnan(p).all() else np.zeros(dim))
            moved = p - self.centre
            self.points = np.ascontiguousarray(moved.astype(np.float32).T)
            size = (moved * moved).sum(axis=1) if measure == "euclidean" else np.abs(moved).sum(axis=1)
            self.sizes, self.largest = size.astype(np.float32), np.nanmax(size, initial=0.0)

    def _fits(self, v: np.ndarray) -> bool:
        size = np.abs(v).max(axis=1, initial=0.0)
        size = size[~np.isnan(size)]
        if self.measure == "cosine":
            size = size[size > 0]
            return not len(size) or (size.min() > 1e-100 and size.max() < 1e100)
        return not len(size) or size.max() < 1e15

    @staticmethod
    def _directions(v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32)

    def keys(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(rough distances, largest error for each query), or none if they can't be had."""
        if not self.usable or not self._fits(q):
            return None
        if self.measure == "cosine":
            d = self._directions(q) @ self.points
            np.abs(d, out=d)
            return np.negative(d, out=d), np.full(len(q), self.unit)
        moved = q - self.centre
        own = moved.astype(np.float32)
        if self.measure == "euclidean":
            size = (moved * moved).sum(axis=1)
            d = (-2 * own) @ self.points
            d += self.sizes
            d += size.astype(np.float32)[:, None]
            return d, self.unit * 2 * (size + self.largest)
        d = np.empty((len(q), self.points.shape[1]), np.float32)
        part, sums = np.empty((2, SUM_ROWS * SUM_COLUMNS), np.float32)
        for j in range(0, d.shape[1], SUM_COLUMNS):
            column = self.points[:, j:j + SUM_COLUMNS]
            for i in range(0, len(q), SUM_ROWS):
                x = own[i:i + SUM_ROWS]
                shape = len(x), column.shape[1]
                one, total = (a[:shape[0] * shape[1]].reshape(shape) for a in (part, sums))
                total[:] = 0
                for k in range(len(column)):
                    np.subtract(x[:, k:k + 1], column[k], out=one)
                    np.abs(one, out=one)
                    np.add(total, one, out=total)
                d[i:i + SUM_ROWS, j:j + SUM_COLUMNS] = total
        return d, self.unit * (np.abs(moved).sum(axis=1) + self.largest)

    def limit(self, kth: np.ndarray, error: np.ndarray, tie: float) -> np.ndarray:
        """The rough distance up to which a cell can be among the best of its query, from the rough
        distance of its last; exact distances that differ by ``tie`` may round to the same.
        Distances are negated where the farthest are asked for."""
        kth = np.where(np.isnan(kth), np.inf, kth.astype(np.float64))
        if self.measure != "euclidean":
            return kth + 2 * error + tie
        far = np.signbit(kth) & (kth < 0)
        size = np.sqrt(np.maximum(np.abs(kth) + np.where(far, -error, error), 0))
        near = (size + tie) ** 2 + error
        return np.where(far, np.where(size > tie, error - (size - tie) ** 2, np.inf), near)


def set_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the true cells, of which there are few: eight at a time are looked at."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.nonzero(mask)
    words = np.flatnonzero(flat.view(np.uint64))
    at, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + bit, mask.shape[1])


def best_of(key: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``take`` smallest finite keys of each row, ties to the lower column."""
    kth = np.partition(key, take - 1, axis=1)[:, take - 1:take]
    rows, cols = np.nonzero((key <= kth) & np.isfinite(key))
    kept = best_cells(rows, cols, key[rows, cols], take)
    return rows[kept], cols[kept]


def best_cells(rows: np.ndarray, cols: np.ndarray, key: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` smallest keys of each row among cells, in order, ties to the lower column."""
    order = np.lexsort((cols, key, rows))
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return order[rank < take]


def nearest_cells(rough: RoughTile, q: np.ndarray, p: np.ndarray, own: tuple[np.ndarray, np.ndarray], take: int,
                  order: str, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows, columns, distances) of the best ``take`` points of every query without the cells ``own``."""
    found = rough.keys(q)
    if found is None:
        return None
    d, error = found
    sign = -1.0 if order == "reference" else 1.0
    if order == "reference":
        np.negative(d, out=d)
    d[own] = np.nan
    tie = 0.0 if digits is None else 10.0 ** -digits
    if order == "reference" and rough.measure == "euclidean":
        np.minimum(d, -0.0, out=d)  # squares
    elif rough.measure == "euclidean":
        np.maximum(d, 0.0, out=d)
    limit = rough.limit(np.partition(d, take - 1, axis=1)[:, take - 1], error, tie)
    # up, so that single precision takes nothing away
    rows, cols = set_cells(d <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])
    exact = pair_distances(q, p, rows, cols, rough.measure)
    key = sign * (np.round(exact, digits) if digits is not None else exact)
    there = np.isfinite(key)
    rows, cols, key, exact = rows[there], cols[there], key[there], exact[there]
    kept = best_cells(rows, cols, key, take)
    return rows[kept], cols[kept], exact[kept]


def own_cells(qids: np.ndarray, pids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pairs of equal ids; ``pids`` are in order, null (nan) equals nothing."""
    lo = np.searchsorted(pids, qids, "left")
    many = np.where(qids == qids, np.searchsorted(pids, qids, "right") - lo, 0)
    rows = np.repeat(np.arange(len(qids)), many)
    return rows, np.arange(len(rows)) + np.repeat(lo - (np.cumsum(many) - many), many)


def tile_top_k(qids, qvecs, pids, pvecs, k: int, measure: str, order: str,
               digits: int | None, exclude_self: bool) -> pd.DataFrame:
    """Top-k per query inside one tile; ties broken by neighbour id. Distances are held
    for as many queries at a time as make ``ROUGH_CELLS`` (sets: ``TILE_CELLS``) cells."""
    out = [pd.DataFrame({"id": np.zeros(0, np.int64), "nbr": np.zeros(0, np.int64), "dist": np.zeros(0)})]
    if len(qids) == 0 or len(pids) == 0:
        return out[0]
    porder = np.argsort(pids, kind="stable")
    pids = pids[porder]
    sets = measure in SET_MEASURES
    p = [pvecs[i] for i in porder] if sets else np.asarray(pvecs if isinstance(pvecs, np.ndarray) else np.stack(pvecs), np.float64)[porder]
    rough = None if sets else RoughTile(p, measure)
    step = max(1, (ROUGH_CELLS if rough is not None and rough.usable else TILE_CELLS) // len(pids))
    step = step // 8 * 8 or step
    take = min(k + (1 if exclude_self else 0), len(pids))
    for i in range(0, len(qids), step):
        own, own_ids = qvecs[i:i + step], qids[i:i + step]
        if not sets:
            own = np.asarray(own if isinstance(own, np.ndarray) else np.stack(own), np.float64)
        same = own_cells(own_ids, pids) if exclude_self else (np.zeros(0, np.int64),) * 2
        best = None if sets else nearest_cells(rough, own, p, same, take, order, digits)
        if best is None:
            d = set_distance_tile(own, p, measure) if sets else distance_tile(own, p, measure)
            key = np.round(d, digits) if digits is not None else d.copy()
            if order == "reference":
                key = -key
            key = np.where(np.isnan(key), np.inf, key)
            key[same] = np.inf
            rows, cols = best_of(key, take)
            best = rows, cols, d[rows, cols]
        rows, cols, dist = best
        out.append(pd.DataFrame({"id": own_ids[rows], "nbr": pids[cols], "dist": dist}))
    return pd.concat(out[1:], ignore_index=True)


def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray | list]:
    """(ids, vectors) of a side of a tile: rows of a matrix where all are of one length."""
    ids, vecs = table["id"].to_numpy(), table["vec"].combine_chunks()
    if table.num_rows and pa.types.is_floating(vecs.type.value_type) and not vecs.null_count:
        lengths = np.asarray(vecs.value_lengths())
        if lengths[0] and (lengths == lengths[0]).all():
            return ids, vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths[0])
    return ids, list(vecs.to_pandas())


def arrow_tile(qtable: pa.Table, ptable: pa.Table, k: int, measure: str, order: str, digits: int | None,
               exclude_self: bool) -> pa.Table:
    """``tile_top_k`` of a co-group's two tables."""
    best = tile_top_k(*side(qtable), *side(ptable), k, measure, order, digits, exclude_self)
    return pa.table({c: pa.array(best[c], t, from_pandas=True) for c, t in
                     (("id", pa.int64()), ("nbr", pa.int64()), ("dist", pa.float64()))})


def _blocks(n: int, block_rows: int, tasks: int) -> int:
    """Blocks of at most ``block_rows`` rows, and enough that the tiles of two such sides
    are ``tasks`` or more (where there are rows for it)."""
    return max(1, math.ceil(n / block_rows), min(n // 64, math.ceil(math.sqrt(tasks))))


def _sides(n_q: int, n_p: int, asked: int, points: int, tasks: int, vector: int, k: int) -> tuple[int, int]:
    """(blocks of queries, of points) of at most ``asked`` and ``points`` rows, with tiles for ``tasks`` tasks where
    there are rows for it: those that send the fewest bytes. A vector, of ``vector`` bytes, goes to all blocks of
    the other side, and each block of points gives every query ``k`` neighbours."""
    def sides(pb):
        return _blocks(n_q, asked, (tasks / pb) ** 2), pb  # its root: the other side has pb

    def sent(both):
        qb, pb = both
        return vector * (n_p * qb + n_q * pb) + 24 * min(k, n_p) * n_q * pb
    widest = sides(max(1, math.ceil(n_p / points)))
    return min([widest, *(sides(pb) for pb in range(widest[1] + 1, _blocks(n_p, points, tasks) + 1))], key=sent)


def tile_rows(pts: DataFrame) -> int:
    """Rows of a tile's side, from the length of a vector: ``TILE_BYTES`` of doubles."""
    widest = pts.agg(F.max(F.size("vec"))).first()[0] or 1
    return max(1, TILE_BYTES // (8 * max(1, widest)))


def exact_neighbors(points: DataFrame, queries: DataFrame | None = None, k: int = 100,
                    measure: str = "cosine", order: str = "nearest",
                    both_directions: bool = False, block_rows: int | None = None,
                    digits: int | None = 6) -> DataFrame:
    """(id, nbr, dist, rnk) for every query id (default: every point).

    ``order='nearest'`` ranks ascending distance; ``order='reference'`` ranks
    descending (the k farthest), both tie-broken by neighbour id. Self pairs
    are excluded. With ``both_directions`` every point that is not a query
    also receives a (partial) list built from the query side, as when the
    computed pairs are emitted in both directions."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    if measure not in DENSE_MEASURES + SET_MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    vtype = "array<int>" if measure in SET_MEASURES else "array<double>"
    pts = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(vtype).alias("vec"))
    if measure in SET_MEASURES:
        pts = cut_lineage(pts)  # read for the sizes, the lists and the nearest of other sets
    qry = pts if queries is None else cut_lineage(pts.join(
        queries.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"))
    cand = block_candidates(qry, pts, k, measure, order, block_rows, digits)
    if both_directions and queries is not None:
        others = pts.join(qry.select("id"), "id", "left_anti")
        cand = cand.unionByName(block_candidates(others, qry, k, measure, order, block_rows, digits))
    return rank_neighbors(cand, k, order)


def block_candidates(qry: DataFrame, pts: DataFrame, k: int, measure: str = "cosine",
                     order: str = "nearest", block_rows: int | None = None,
                     digits: int | None = 6) -> DataFrame:
    """Per-tile top-k candidates (id, nbr, dist) of every query row among the
    point rows; the global top-k of a query is contained in their union."""
    ship_code()
    n_q, n_p = qry.count(), pts.count()
    if measure in SET_MEASURES and order == "nearest" and block_rows is None and set_lists.unique_ids(pts) and set_lists.unique_ids(qry):
        pairs = set_lists.common_pairs(qry, pts, [])
        if n_q * n_p > set_lists.CELLS_A_PAIR * pairs:
            return set_lists.set_candidates(qry, pts, k, measure, [], pairs, True, digits)
    rows, tasks = block_rows or tile_rows(pts), pts.sparkSession.sparkContext.defaultParallelism
    asked = rows if block_rows else max(1, min(rows, RESULT_BYTES // (24 * (k + 1))))  # id, nbr, dist
    points = rows if block_rows or measure in SET_MEASURES else max(1, rows * POINT_BYTES // TILE_BYTES)
    if block_rows or measure in SET_MEASURES:
        qb, pb = _blocks(n_q, asked, tasks), _blocks(n_p, points, tasks)
    else:
        qb, pb = _sides(n_q, n_p, asked, points, tasks, TILE_BYTES // rows, k)
    # fresh attribute ids on both sides: queries are often a subset of the points
    qry = qry.select(F.col("id").alias("id"), F.col("vec").alias("vec"))
    pts = pts.select(F.col("id").alias("id"), F.col("vec").alias("vec"))
    qside = (qry.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(qb)))
             .withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(pb - 1)).cast("array<long>"))))
    pside = (pts.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(pb)))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<long>"))))

    def tile(qtable: pa.Table, ptable: pa.Table) -> pa.Table:
        return arrow_tile(qtable, ptable, k, measure, order, digits, exclude_self=True)

    cand = (qside.groupBy("qb", "pb")
            .cogroup(pside.groupBy("qb", "pb"))
            .applyInArrow(tile, schema="id long, nbr long, dist double"))
    if digits is not None:
        cand = cand.withColumn("dist", F.round("dist", digits))
    return cand


def rank_neighbors(cand: DataFrame, k: int, order: str = "nearest") -> DataFrame:
    """Keep the k best (id, nbr) per id; ties by neighbour id."""
    dist = F.col("dist").asc_nulls_last() if order == "nearest" else F.col("dist").desc_nulls_last()
    w = Window.partitionBy("id").orderBy(dist, F.col("nbr").asc())
    return (cand.withColumn("rnk", F.row_number().over(w))
            .filter(F.col("rnk") <= k)
            .withColumn("rnk", F.col("rnk").cast("long")))
