"""Gram-matrix (uncentred co-rating) neighbourhood baseline.

g(a, b) = sum over shared items of r_a * r_b, self pairs included. The user x
item matrix is never materialised densely: the long (user, item, rating) form
is the sparse matrix, and the product is ``llr.half_pairs`` (lists of an item's raters
to tasks by user; each unordered pair once, then mirrored) with a sum per
(a, b). A test pair without a rater of its item, or whose raters share nothing
with the user, is predicted 0.0, so every test pair counts in every error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import packed_pairs, steps
from .llr import half_pairs, mirror_pairs
from .numbering import number_rows

#: Matches of ratings that a tile expands at once; raters of an item in a tile.
MATCHES, RATERS = 1 << 21, 1 << 16


def gram_similarity(ratings: DataFrame, include_self: bool = True) -> DataFrame:
    """(a, b, g) for every pair of users sharing an item."""
    rated = cut_lineage(ratings.select("user", "item", "rating").filter("user IS NOT NULL"))  # counted, then met
    half = half_pairs(rated, ["rating"], F.sum(F.col("rating_a") * F.col("rating_b")).alias("g"), product="g")
    return mirror_pairs(half if include_self else half.filter("a < b"), "g")


def _spans(item: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of each item in the sorted ``items``."""
    lo = np.searchsorted(items, item, "left")
    return lo, np.searchsorted(items, item, "right") - lo


def _expanded(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, places) of all matches."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) + np.repeat(lo - (np.cumsum(count) - count), count)


def _runs(load: np.ndarray):
    """Runs of users (from, to) with a bounded number of matches, or of a single user."""
    ends, i = np.cumsum(load), 0
    while i < len(load):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MATCHES, "right")))
        yield i, j
        i = j


def _written(batches):
    """Raters of items (of, column, nbrs, given) with their lists as bytes (of, column, first, form, list)."""
    for batch in batches:
        offsets, user = steps.flat(batch.column(2))
        rating = steps.flat(batch.column(3))[1].astype(np.float64)
        order = np.lexsort((user, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))))
        user, rating = user[order], rating[order]
        form = packed_pairs.form_of(rating)
        data, at = packed_pairs.entries(offsets, user, rating, None, form)
        text, bounds = data.tobytes(), at[offsets]
        # a list's first step is one byte, 0: it isn't sent
        lists = [text[i + 1:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(user[offsets[:-1]]), pa.array(np.full(len(lists), form, np.int32)), pa.array(lists, pa.binary())],
            ["of", "column", "first", "form", "list"])


def _best_raters(most: int):
    """A tile: (ratings and questions of one block of users, lists of the raters of their items)
    -> the ``most`` raters of each question with the largest g, and their rank. Only cells of users and raters that
    share an item are held, for ``MATCHES`` matches at a time."""
    def run(own: pa.Table, raters: pa.Table) -> pa.Table:
        own, raters = own.combine_chunks(), raters.combine_chunks()
        users, a = np.unique(np.asarray(own["user"]), return_inverse=True)
        by_user = np.argsort(a, kind="stable")
        a, item, asked, mine = a[by_user], *(np.asarray(own[c])[by_user] for c in ("item", "asked", "r"))
        rater, rating, items = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if raters.num_rows:
            row, rater, rating, _ = packed_pairs._listed(raters.to_batches()[0], False, True)
            items = np.asarray(raters["of"])[row]
        order = np.argsort(items, kind="stable")
        items, rating = items[order], rating[order]
        nbrs, b = np.unique(rater[order], return_inverse=True)
        lo, count = _spans(item, items)
        out = {"user": [], "item": [], "nbr": [], "g": [], "r": [], "rnk": []}
        for first, last in _runs(np.bincount(a, count, len(users)).astype(np.int64)):
            here = np.arange(*np.searchsorted(a, [first, last]))
            has, asks = here[~asked[here]], here[asked[here]]
            rows, places = _expanded(lo[has], count[has])
            cells, of = np.unique((a[has][rows] - first) * len(nbrs) + b[places], return_inverse=True)
            g = np.bincount(of, mine[has][rows] * rating[places], len(cells))
            rows, places = _expanded(lo[asks], count[asks])
            cell = (a[asks][rows] - first) * len(nbrs) + b[places]
            at = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
            found = np.flatnonzero(cells[at] == cell) if len(cells) else np.zeros(0, np.int64)
            rows, places, value = rows[found], places[found], g[at[found]] if len(found) else np.zeros(0)
            best = np.lexsort((b[places], -value, rows))
            rows, places, value = rows[best], places[best], value[best]
            start = np.flatnonzero(np.diff(rows, prepend=-1))
            rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
            rows, places, value, rank = (x[rank < most] for x in (rows, places, value, rank))
            for name, values in zip(out, (users[a[asks][rows]], item[asks][rows], nbrs[b[places]], value, rating[places], rank + 1), strict=True):
                out[name].append(values)
        kinds = (np.int64, np.int64, np.int64, np.float64, np.float64, np.int64)
        return pa.table({name: np.concatenate([np.zeros(0, kind), *parts]) for (name, parts), kind in zip(out.items(), kinds, strict=True)})
    return run


def ranked_raters(test: DataFrame, train: DataFrame, most: int, block_users: int = 1024) -> DataFrame:
    """For each test (user, item), the item's ``most`` best raters that share an
    item with the user, by g descending, rater id ascending: (user, item, nbr, g, r, rnk).

    A masked sparse product: only test users are rows, in blocks of ``block_users``, and a block
    gets the raters of the items that its users have rated or ask for, as lists, once each; so
    what is sent grows with the matches of ratings, not with users x users. Only an item
    of more than ``RATERS`` raters has them dealt over several tiles of each block, whose ranks are made anew. The
    lists are written once as bytes (``packed_pairs``). No row stands
    for a test pair and a rater before the tile's ranking; a tile gives ``most`` rows for a test pair at most."""
    ship_package(train.sparkSession)
    asked = test.select(F.col("user").cast("long"), F.col("item").cast("long")).distinct()
    rated = train.select(F.col("user").cast("long"), F.col("item").cast("long"), F.col("rating").cast("double").alias("r"))
    users = asked.select("user").distinct()
    # the number of test users and of raters of the most rated item set the number of tiles
    rows = max(1, -(-users.count() // block_users))
    hottest = rated.filter("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    columns = max(1, -(-hottest // RATERS))
    own = (rated.join(users, "user", "left_semi").withColumn("asked", F.lit(False))
           .unionByName(asked.withColumn("r", F.lit(0.0)).withColumn("asked", F.lit(True)))
           .withColumn("i", F.pmod(F.xxhash64("user"), F.lit(rows))))
    left = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<long>")))
    lists = (rated.filter("user IS NOT NULL").withColumn("column", F.pmod(F.xxhash64("user"), F.lit(columns))).groupBy("item", "column")
             .agg(F.collect_list(F.struct("user", "r")).alias("by"))
             .select(F.col("item").alias("of"), "column", F.col("by.user").alias("nbrs"), F.col("by.r").alias("given"))
             .mapInArrow(_written, "of long, column long, first long, form int, list binary"))
    right = (lists.join(own.select(F.col("item").alias("of"), F.col("i").alias("row")).distinct(), "of")
             .select("of", "first", "form", "list", "row", "column"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("row", "column")).applyInArrow(
        _best_raters(most), "user long, item long, nbr long, g double, r double, rnk long")
    if columns == 1:
        return found
    w = Window.partitionBy("user", "item").orderBy(F.col("g").desc(), F.col("nbr").asc())
    return found.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= most)


def gram_predict(test: DataFrame, train: DataFrame, n: int = 10, digits: int | None = 6) -> DataFrame:
    """Weighted rating over the top-n raters: sum(g r) / sum(g), 0.0 where there are none."""
    return gram_predict_by_k(test, train, [n], digits).drop("k")


def gram_predict_by_k(test: DataFrame, train: DataFrame, ks: list[int], digits: int | None = 6) -> DataFrame:
    """A22 helper: rank once, then predictions for every neighbourhood size k
    (the k list is a literal array exploded per test row, after the join;
    each k has as many predictions as there are test rows)."""
    ranked = ranked_raters(test, train, max(ks))
    # a row for each question with the sums of all sizes, and so many joins, whatever their number
    sums = [F.when(F.count(F.when(F.col("rnk") <= k, 1)) > 0, F.sum(F.when(F.col("rnk") <= k, F.col("g") * F.col("r")))
                   / F.sum(F.when(F.col("rnk") <= k, F.col("g")))) for k in map(int, ks)]
    agg = ranked.groupBy("user", "item").agg(F.array(*sums).alias("p"))
    found = test.select("user", "item", "rating").join(agg, ["user", "item"], "left")
    sizes = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(i).alias("i")) for i, k in enumerate(ks)]))
    pred = F.coalesce(F.get("p", F.col("s.i")), F.lit(0.0))
    if digits is not None:
        pred = F.round(pred, digits)
    return found.withColumn("s", sizes).select("s.k", "user", "item", "rating", pred.alias("predicted"))


def dense_rows(ratings: DataFrame, item_block: int = 4096) -> DataFrame:
    """The whole user x item matrix, 0-filled, in dense rows: (user, block, ratings
    ARRAY<DOUBLE>), item number n at place n mod ``item_block`` + 1 of block n div
    ``item_block``. Items are numbered in id order (``item_numbers``); the last block may be
    shorter. Of repeated ratings the highest counts. The output is users x items by
    definition; an array has ``item_block`` entries at most, and no column list is collected."""
    numbers = item_numbers(ratings)
    items = numbers.count()
    placed = (ratings.groupBy("user", "item").agg(F.max("rating").cast("double").alias("rating")).join(numbers, "item")
              .withColumn("block", F.floor(F.col("number") / item_block)).withColumn("at", (F.col("number") % item_block).cast("int")))
    cells = placed.groupBy("user", "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "rating"))).alias("cells"))
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(max(items - 1, 0) // item_block).cast("long"))
    every = ratings.select("user").distinct().select("user", F.explode(blocks).alias("block"))
    width = F.least(F.lit(item_block).cast("long"), F.lit(items) - F.col("block") * item_block).cast("int")
    filled = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return every.join(cells, ["user", "block"], "left").select("user", "block", filled.alias("ratings"))


def item_numbers(ratings: DataFrame) -> DataFrame:
    """(item, number): dense numbers from 0 in id order."""
    return number_rows(ratings.select("item").distinct(), "item")
