"""Co-occurrence sums of all pairs of users, in tiles, for interactions where users share much.

Users are numbered in order and dealt into blocks of neighbours in that order; a block is a
row of arrays. Every pair of blocks is one co-group that gets both rows, once each, and gives
the pairs of its users that share an item, summed up. So what is shuffled is rows x blocks, not the
pairs, and a task holds two blocks and the pairs of one tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .numbering import number_rows

#: Users of a block at most; rows of a block beyond which tiles are not for this table.
TILE_USERS, TILE_ROWS = 2048, 1 << 21
#: Items of a dense part of a tile's matrices; a match costs about as much as so many dense cells.
DENSE_ITEMS, MATCH_CELLS = 1024, 32
#: Matches that a tile expands at once.
MATCHES = 1 << 21


def _expanded(x: tuple, y: tuple, k: np.ndarray, by: tuple) -> None:
    """Add the products of matching entries, match by match, in whole numbers."""
    order = np.argsort(y[1], kind="stable")
    place, code, value = y[0][order], y[1][order], by[1][order]
    lo = np.searchsorted(code, x[1], "left")
    count = np.searchsorted(code, x[1], "right") - lo
    ends, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MATCHES, "right")))
        entry = np.repeat(np.arange(i, j), count[i:j])
        at = np.arange(len(entry)) + np.repeat(lo[i:j] - (np.cumsum(count[i:j]) - count[i:j]), count[i:j])
        np.add.at(k, (x[0][entry], place[at]), by[0][entry] * value[at])
        i = j


def _sums(x: tuple, y: tuple, rows: int, columns: int, by: tuple) -> np.ndarray:
    """Sum of the products of ``by`` over what each user of x (place, code) shares with each of y."""
    k = np.zeros((rows, columns), np.int64)
    codes, n = np.intersect1d(x[1], y[1]), max(len(x[1]), len(y[1]), 1)
    if not len(codes):
        return k
    matches = float(np.dot(*(np.bincount(np.searchsorted(codes, s[1][np.isin(s[1], codes)]), minlength=len(codes)).astype(float) for s in (x, y))))
    exact = all(len(v) and float(np.abs(v).max()) * n < 2**26 for v in by)  # so sums stay below 2^53
    if not exact or matches * MATCH_CELLS < float(rows) * columns * len(codes):
        _expanded(x, y, k, by)
        return k
    for first in range(0, len(codes), DENSE_ITEMS):
        here, sides = codes[first:first + DENSE_ITEMS], []
        for (place, code), value, users in zip((x, y), by, (rows, columns), strict=True):
            mine = np.flatnonzero(np.isin(code, here))
            side = np.zeros((users, len(here)))
            np.add.at(side, (place[mine], np.searchsorted(here, code[mine])), value[mine])
            sides.append(side)
        k += (sides[0] @ sides[1].T).astype(np.int64)
    return k


def _tile(totals: bool):
    """(row of a block, row of the same or a later block) -> sums of the pairs of their users."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        right = right.rename_columns([c.removesuffix("_b") for c in right.column_names])
        part = lambda t, c: t[c].chunk(0).flatten()
        (x, cx), (y, cy) = (((np.asarray(part(t, "place")), np.asarray(part(t, "code"))), np.asarray(part(t, "cnt"))) for t in (left, right))
        a, b = part(left, "users"), part(right, "users")
        k = _sums(x, y, len(a), len(b), (cx, cy))
        shared = k > 0
        if min(cx.min(), cy.min()) <= 0:
            shared = _sums(x, y, len(a), len(b), (np.ones_like(cx), np.ones_like(cy))) > 0
        if key[0].as_py() == key[1].as_py():
            shared = np.triu(shared)
        i, j = (pa.array(p) for p in np.nonzero(shared))
        out = {"a": a.take(i), "b": b.take(j)}
        if totals:
            out |= {"n_a": part(left, "ns").take(i), "n_b": part(right, "ns").take(j)}
        return pa.table(out | {"k11": k[shared]})
    return run


def block_users(users: int, rows: int, tasks: int) -> int:
    """Users of a block: tiles for ``tasks`` tasks at least, an eighth of ``TILE_ROWS`` rows on average at most."""
    wanted = max(1, int(np.ceil(np.sqrt(2 * tasks))))
    return max(1, min(TILE_USERS, -(-users // wanted), int(TILE_ROWS / 8 * users / max(rows, 1))))


def tiled_pairs(members: DataFrame, width: int, totals: bool) -> DataFrame | None:
    """(a, b, [n_a, n_b,] k11) of every pair of users that share an item, once (a <= b, null first), from
    (user, item, cnt[, n]) in blocks of ``width`` users; None if a block has over ``TILE_ROWS`` rows."""
    ship_package(members.sparkSession)
    kept = members.filter("item IS NOT NULL")
    named = number_rows(kept.select("user").distinct(), "user", name="at").withColumnRenamed("user", "_user")
    coded = number_rows(kept.select("item").distinct(), "item", name="code")
    placed = cut_lineage(kept.join(coded, "item").join(named, F.col("user").eqNullSafe(F.col("_user")))
                         .select("user", F.floor(F.col("at") / width).alias("block"), (F.col("at") % width).cast("int").alias("place"),
                                 "code", "cnt", *(["n"] if totals else [])))
    most, last = placed.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows"), F.max("block")).first()
    if (most or 0) > TILE_ROWS:
        return None
    own = placed.groupBy("block", "place").agg(F.first("user").alias("user"), (F.first("n") if totals else F.lit(0)).cast("long").alias("n"))
    own = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "user", "n"))).alias("u"))
    cells = placed.groupBy("block").agg(F.collect_list(F.struct("place", "code", F.col("cnt").cast("long").alias("cnt"))).alias("c"))
    packed = cut_lineage(own.join(cells, "block").select("block", F.col("u.user").alias("users"), F.col("u.n").alias("ns"),
                                                         "c.place", "c.code", "c.cnt"))
    left = packed.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.lit(last or 0))))
    # columns of their own: those of the same DataFrame would be pruned from one side
    right = packed.select(*[F.col(c).alias(f"{c}_b") for c in packed.columns]).withColumn("j", F.col("block_b")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block_b"))))
    tiles = ((last or 0) + 1) * ((last or 0) + 2) // 2
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, min(tiles, 4096))
    kind = members.schema["user"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, {'n_a long, n_b long, ' if totals else ''}k11 long"
    return (left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(right.repartition(tasks, "i", "j").groupBy("i", "j"))
            .applyInArrow(_tile(totals), schema))
