"""Exact nearest sets by lists of members, for tables whose sets share few elements.

Sets that share an element meet through the list of its members: each query gets, for each of its
elements, the points that hold it, and the number of times a point comes up is the size of the
intersection. Points that share nothing with a query are at a distance known from the sizes
alone (Jaccard 1, Hamming the sum of sizes), so the first k + 1 of them by size and id stand for all.
No pair of sets without a common element is made; lists are shuffled, pairs are not: tasks are by
query (a query with very many pairs by parts of its lists) and make about ``PAIRS_A_TASK`` pairs each. Lists go as
bytes (``packed_pairs``) unless points have null ids.
An element with more than ``BLOCK_ROWS`` members is dealt into blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .packed_pairs import _listed, entries, form_of
from .steps import flat

#: Tiles are taken unless they have so many times more cells than there are pairs by a common element.
CELLS_A_PAIR = 16
#: Members of an element that meet as one list; pairs that a task makes, about.
BLOCK_ROWS, PAIRS_A_TASK = 1000, 1_000_000


def unique_ids(df: DataFrame) -> bool:
    """Whether no id comes twice (null counts as one)."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("ids"), F.count_distinct("id").alias("different")).first()
    return n["ids"] == n["different"] and n["rows"] - n["ids"] <= 1


def _members(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "id", F.coalesce(F.size("vec"), F.lit(0)).alias("n"), "vec").select(*keys, "id", "n", F.explode("vec").alias("item"))


def common_pairs(qry: DataFrame, pts: DataFrame, keys: list[str]) -> int:
    """Pairs of a query and a point that ``set_candidates`` makes, counted for each common element."""
    sizes = _sizes(_members(qry, keys), _members(pts, keys), keys)
    return int(sizes.agg(F.coalesce(F.sum(F.col("nq").cast("double") * F.col("np")), F.lit(0.0))).first()[0])


def _sizes(q: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "item"]
    return (q.groupBy(*by).agg(F.count(F.lit(1)).alias("nq"))
            .join(p.groupBy(*by).agg(F.count(F.lit(1)).alias("np")), by))


def _lists(members: DataFrame, heavy: DataFrame, by: list[str], own: str, other: str, name: str) -> DataFrame:
    """Members of an element (of a block of it), once for each block of the other side."""
    own_block, other_block = f"_{own}", f"_{other}"
    dealt = (members.join(heavy, by, "left")
             .withColumn("_own", F.pmod(F.xxhash64("id"), F.coalesce(F.col(f"blocks_{own}"), F.lit(1))).cast("int"))
             .withColumn("_others", F.coalesce(F.col(f"blocks_{other}"), F.lit(1))))
    lists = dealt.groupBy(*by, "_own", "_others").agg(F.collect_list(F.struct("id", "n")).alias(name))
    return lists.select(*by, F.col("_own").alias(own_block), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias(other_block), name)


def set_candidates(qry: DataFrame, pts: DataFrame, k: int, measure: str, keys: list[str], pairs: int,
                   exclude_self: bool, digits: int | None) -> DataFrame:
    """(id, nbr, dist): the k nearest points of every query among those with equal ``keys``, ties by id.

    ``qry`` and ``pts`` have ``keys``, ``id`` (unique among rows of equal keys) and ``vec``, a set;
    ``pairs`` is what ``common_pairs`` counts. Two empty sets have no Jaccard distance."""
    ship_code()
    spark, by = pts.sparkSession, [*keys, "item"]
    q, p = _members(qry, keys), _members(pts, keys)
    heavy = (_sizes(q, p, keys).filter(F.greatest("nq", "np") > BLOCK_ROWS)
             .select(*by, F.ceil(F.col("nq") / BLOCK_ROWS).cast("int").alias("blocks_q"),
                     F.ceil(F.col("np") / BLOCK_ROWS).cast("int").alias("blocks_p")))
    met = _lists(q, heavy, by, "q", "p", "m").join(_lists(p, heavy, by, "p", "q", "others"), [*by, "_q", "_p"])
    shared = met.select(*keys, F.explode("m").alias("x"), "others").select(
        *keys, F.col("x.id").alias("id"), F.col("x.n").alias("n"), "others", F.lit(1).alias("c"))

    # points that share nothing with a query
    sized = pts.select(*keys, "id", F.coalesce(F.size("vec"), F.lit(0)).alias("n"))
    smallest = Window.partitionBy(*keys, F.col("n") == 0).orderBy(*(["n"] if measure == "hamming" else []), F.col("id").asc())
    first = (sized.withColumn("_place", F.row_number().over(smallest)).filter(F.col("_place") <= k + 1)
             .groupBy(*keys).agg(F.collect_list(F.struct("id", "n")).alias("others")))
    queries = qry.select(*keys, "id", F.coalesce(F.size("vec"), F.lit(0)).alias("n"))
    apart = queries.join(first, keys) if keys else queries.crossJoin(F.broadcast(first))
    lists = shared.unionByName(apart.withColumn("c", F.lit(0)))

    # a query with more pairs than a task makes is dealt over parts of its lists
    made = q.join(p.groupBy(*by).agg(F.count(F.lit(1)).alias("np")), by).groupBy(F.col("id").alias("_hot")).agg(F.sum("np").alias("_pairs"))
    hot = F.broadcast(made.filter(F.col("_pairs") > PAIRS_A_TASK).select("_hot", F.ceil(F.col("_pairs") / PAIRS_A_TASK).cast("int").alias("_salts")))
    lists = (lists.join(hot, F.col("id").eqNullSafe(F.col("_hot")), "left")
             .withColumn("_salts", F.coalesce("_salts", F.lit(1)))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))))
    lists = lists.withColumn("others", F.when(F.col("_salts") == 1, F.col("others")).otherwise(
        F.filter("others", lambda o: F.pmod(F.xxhash64(o["id"]), F.col("_salts")) == F.col("_salt"))))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))
    bucket = F.to_json(F.struct(*keys)) if keys else F.lit("")
    lists = lists.select(F.pmod(F.xxhash64("id", "_salt"), F.lit(tasks)).alias("task"), bucket.alias("bucket"), "id", "n", "c",
                         F.col("others.id").cast("array<long>").alias("nbr"), F.col("others.n").alias("m"))
    if not pts.filter("id IS NULL").limit(1).count():
        kind = qry.schema["id"].dataType.simpleString()
        lists = lists.mapInArrow(_written, f"task long, bucket string, id {kind}, n int, c int, first long, form int, list binary")
    lists = lists.repartition(tasks, "task")
    best = lists.groupBy("task").applyInArrow(lambda table: best_sets(table, k, measure, exclude_self, digits), "id long, nbr long, dist double")
    return best if digits is None else best.withColumn("dist", F.round("dist", digits))


def _written(batches):
    """Lists (..., nbr, m) as bytes (..., first, form, list)."""
    for batch in batches:
        offsets, nbr = flat(batch.column(5))
        kept = np.flatnonzero(np.diff(offsets))  # a list without points makes no pairs
        batch, offsets, m = batch.take(pa.array(kept)), np.append(offsets[kept], offsets[-1]), flat(batch.column(6))[1].astype(np.int64)
        order = np.lexsort((nbr, np.repeat(np.arange(len(kept)), np.diff(offsets))))
        nbr, m = nbr[order], m[order]
        form = form_of(m)
        data, at = entries(offsets, nbr, m, None, form)
        text, bounds = data.tobytes(), at[offsets]
        # a list's first step is one byte, 0: it isn't sent
        lists = [text[i + 1:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(nbr[offsets[:-1]], pa.int64()), pa.array(np.full(len(lists), form, np.int32)),
                                          pa.array(lists, pa.binary())], [*batch.schema.names[:5], "first", "form", "list"])


def best_sets(table: pa.Table, k: int, measure: str, exclude_self: bool, digits: int | None) -> pa.Table:
    """(id, nbr, dist) of the k nearest points of each query of a task, from its lists."""
    table = table.combine_chunks()
    if "list" in table.column_names:
        row, nbr, m, _ = _listed(table.to_batches()[0], False, False) if table.num_rows else (np.zeros(0, np.int64),) * 4
    else:
        offsets, nbr = _flat(table["nbr"])
        m = _flat(table["m"])[1].astype(np.int64)
        row = np.repeat(np.arange(table.num_rows), np.diff(offsets))
    ids = table["id"].combine_chunks()
    own, other, null = _numbers(ids.take(pa.array(row)), nbr)
    bucket = np.asarray(table["bucket"].combine_chunks().dictionary_encode().indices)[row]
    n, c = (np.asarray(table[x], np.int64)[row] for x in ("n", "c"))
    if exclude_self:
        kept = np.flatnonzero((own != other) | (own == null))
        own, other, bucket, n, m, c = (x[kept] for x in (own, other, bucket, n, m, c))
    order = np.lexsort((other, own, bucket))
    own, other, bucket, n, m, c = (x[order] for x in (own, other, bucket, n, m, c))
    new = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(other) != 0) | (np.diff(bucket) != 0)][:len(own)])
    both = np.add.reduceat(c, new) if len(new) else c
    own, other, bucket, n, m = (x[new] for x in (own, other, bucket, n, m))
    union = n + m - both
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = (union - both).astype(np.float64) if measure == "hamming" else 1.0 - both / union
    key = dist
    if digits is not None and measure == "jaccard":  # rounded half up, as Spark and SQL do
        key = (2 * (union - both) * 10 ** digits + union) // (2 * np.maximum(union, 1))
    there = np.flatnonzero(~np.isnan(dist))
    there = there[np.lexsort((other[there], key[there], own[there], bucket[there]))]
    first = np.flatnonzero(np.r_[True, (np.diff(own[there]) != 0) | (np.diff(bucket[there]) != 0)][:len(there)])
    rank = np.arange(len(there)) - np.repeat(first, np.diff(np.append(first, len(there))))
    best = there[rank < k]
    ids = (pa.array(x[best], mask=x[best] == null if null is not None else None) for x in (own, other))
    return pa.table([*ids, pa.array(dist[best])], names=["id", "nbr", "dist"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array | np.ndarray]:
    """(offsets, entries) of a list column; entries with nulls stay an Arrow array."""
    lists = column.combine_chunks()
    entries = lists.flatten()
    return np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))].astype(np.int64), entries if entries.null_count else np.asarray(entries)


def _numbers(own: pa.Array, other: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Ids as numbers, and the number below all others that stands for null, if there are any."""
    other = pa.array(other) if isinstance(other, np.ndarray) else other
    if not own.null_count and not other.null_count:
        return np.asarray(own), np.asarray(other), None
    known = [x for x in (pc.min(own).as_py(), pc.min(other).as_py()) if x is not None]
    null = min(known, default=0) - 1
    return np.asarray(own.fill_null(null)), np.asarray(other.fill_null(null)), null
