"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

The incidence matrix has a row for each distinct shingle set and a column for
each n-gram. Its columns are dealt over the tasks (Spark's partitions by n-gram
are the blocks); within a column the rows that share it meet, overlap counts of a
pair add up over the blocks, and bounds that follow from the set sizes discard
pairs early:

* Only the first ``n - ceil(t n) + 1`` columns of a row of ``n`` n-grams are
  multiplied, rare columns first. Two sets with resemblance ``t`` share one.
* Sizes must be within a factor ``t``; the place of a shared column in both rows
  bounds the overlap from above.

Pairs that are left get their whole overlap from their texts.

Groups don't cost all their pairs. Equal sets are one row from the start. In each
of a few rounds every row meets only the first row of each of its columns (an
order by a hash; after the first round one of its own for each column, so that a
row meets many members of its group), and rows found linked share a component;
columns that lie in one component are finished. What is left, pairs of
different components that share a column, is then looked at in full, so every
link that could join two components is checked: the components are exact.

Edge cases: null and empty texts, and texts without words, have empty sets and
are linked with nothing (their own component); fewer than ``n`` words make one
shingle; equal ids in several rows keep a row each, and the smallest id names the
component; null ids take part, link others and come back with their component (null
if no row in it has an id); extra columns are not read. A set's text is that of one
of its rows, found by a 128-bit hash of id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import let_go
from .common import (KeyFilter, LocalCounts, WordHasher, bounded_batches, buffers, components, cut, enough_shared,
                     frequent, row_order, row_ranges, shingle_sets, tidy, without_ids)

#: Rounds in which rows meet only the first row of each column.
PIVOT_ROUNDS = 2
#: Shingles of verified sets that a task keeps from one slice of pairs to the next.
HELD_SHINGLES = 1 << 21


def signature(grams: np.ndarray) -> bytes | None:
    """A 128-bit name of a set; the empty set has none."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _sets(batch_it, n):
    """(batch part, sets of its rows) for the Arrow batches."""
    hasher = WordHasher()
    for batch in batch_it:
        at, data = buffers(batch.column("text"))
        for lo, hi in row_ranges(at):
            h, row, _, _ = hasher(data, at[lo:hi + 1])
            yield batch.slice(lo, hi - lo), shingle_sets(h, row, hi - lo, n)


def _describe(n, id_type):
    """Rows (id, k1, k2, sig, size) of documents and (h, count) of frequent n-grams."""
    def run(it):
        counts = LocalCounts()

        def told(found):
            h, c, size = found
            none = pa.nulls(len(h) + 1, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "id": pa.nulls(len(h) + 1, id_type), "k1": none, "k2": none, "sig": pa.nulls(len(h) + 1, pa.binary()),
                "size": pa.nulls(len(h) + 1, pa.int64()), "kind": pa.array([1] * (len(h) + 1), pa.int32()),
                "h": pa.array([*h.view(np.int64).tolist(), None], pa.int64()),
                "n": pa.array([*c.tolist(), size], pa.int64())})

        for part, sets in _sets(it, n):
            k = len(sets)
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "k1": part.column("k1"), "k2": part.column("k2"), "sig": pa.array([signature(s) for s in sets], pa.binary()),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "kind": pa.array([0] * k, pa.int32()), "h": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64())})
            if sets and (found := counts.add(np.concatenate(sets))):
                yield from told(found)
        if found := counts.flush():
            yield from told(found)
    return run


def _entries(n, num, den, shared):
    """Rows (h, sig, size, place): the first columns of each distinct set, rare
    ones first. Equal sets of a part give them once."""
    def run(it):
        common = shared.value
        for _, sets in _sets(it, n):
            seen: dict[bytes, np.ndarray] = {}
            for s in sets:
                if len(s):
                    seen.setdefault(signature(s), s)
            if not seen:
                continue
            every = list(seen.values())
            size = np.array([len(s) for s in every])
            flat = np.concatenate(every)
            row = np.repeat(np.arange(len(every)), size)
            order = row_order(row, flat, common.count(flat))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            first = size - -(-num * size // den) + 1
            take = place < first[row]
            names = np.array(list(seen), dtype="S16")
            raw = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(16), int(take.sum()), [None, pa.py_buffer(names.view(np.uint8).reshape(-1, 16)[row[take]].tobytes())])
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(flat[order][take].view(np.int64)), "sig": raw.cast(pa.binary()),
                "size": pa.array(size[row[take]], pa.int32()), "place": pa.array(place[take], pa.int32())})
    return run


def _fits(num: int, den: int):
    """Bounds by size and by the places of a shared column (SQL over x_, y_)."""
    need = f"(x_size + y_size) * {num}L"  # overlap * (num + den) >= this
    most = "(least(x_place, y_place) + 1 + least(x_size - x_place, y_size - y_place) - 1)"
    return (f"least(x_size, y_size) * {den}L >= greatest(x_size, y_size) * {num}L "
            f"AND {most} * {num + den}L >= {need}")


def _verify(n, num, den):
    """Keeps the pairs of texts whose sets are alike enough."""
    def run(it):
        hasher = WordHasher()
        known: dict[bytes, np.ndarray] = {}

        def sets_of(names, texts):
            new = {}
            for s, t in zip(names, texts, strict=True):
                if s not in known and s not in new:
                    new[s] = t
            if new:
                at, data = buffers(pa.array(list(new.values()), pa.large_string()))
                for lo, hi in row_ranges(at):
                    h, row, _, _ = hasher(data, at[lo:hi + 1])
                    known.update(zip(list(new)[lo:hi], shingle_sets(h, row, hi - lo, n), strict=True))

        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = part.column("x").to_pylist(), part.column("y").to_pylist()
                if sum(map(len, known.values())) > HELD_SHINGLES:  # all go but those of this slice
                    known = {s: known[s] for s in {*x, *y} & known.keys()}
                sets_of(x, part.column("x_text").to_pylist())
                sets_of(y, part.column("y_text").to_pylist())
                good = []
                for a, b in zip(x, y, strict=True):
                    p, q = known[a], known[b]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(den * both >= num * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_pydict({"x": part.column("x"), "y": part.column("y"),
                                                  "linked": pa.array(good, pa.bool_())})
    return run


def _one_of_alike(now: DataFrame) -> DataFrame:
    """Of columns that hold the very same rows (by 120 bits of sums of their hashes) the
    one with the smallest ``h``, with the number of them in ``columns``: rows that meet in
    one meet in all, and the bounds hold for similar rows in whichever is taken."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "sig"), 24)).alias(f"rows{k}") for k in range(3)]
    of_column = now.groupBy("h").agg(F.count("*").alias("n"), *sums)
    taken = of_column.groupBy("n", "rows0", "rows1", "rows2").agg(F.min("h").alias("h"), F.count("*").alias("columns"))
    return now.join(taken.select("h", "columns"), "h")


def _linked(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(x, y, linked) of the pairs of signatures (x, y)."""
    xs = texts.select(F.col("sig").alias("x"), F.col("text").alias("x_text"))
    ys = texts.select(F.col("sig").alias("y"), F.col("text").alias("y_text"))
    return (pairs.join(xs, "x").join(ys, "y").select("x", "y", "x_text", "y_text")
            .mapInArrow(tidy(_verify(n, num, den)), "x binary, y binary, linked boolean"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       num: int = 4, den: int = 5, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(id, n_shingles, component_id) of every row; two documents are linked when
    ``den * |A & B| >= num * |A | B|`` over their sets of ``n``-word shingles."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "id", "text")})
    id_type = src.schema["id"].dataType
    told = cut(src.mapInArrow(tidy(_describe(n, _arrow(id_type))),
                              f"id {id_type.simpleString()}, k1 long, k2 long, sig binary, size long, kind int, h long, n long"))
    rows = told.filter("kind = 0").select("id", "k1", "k2", "sig", "size")
    common = sc.broadcast(frequent(told.filter("kind = 1").select("h", "n")))
    classes = cut(rows.filter("sig IS NOT NULL").groupBy("sig")
                  .agg(F.min("id").alias("rep"), F.min(F.struct("k1", "k2")).alias("row")))

    # columns in which at least two rows meet
    entries = (src.select("text").mapInArrow(tidy(_entries(n, num, den, common)),
                                             "h long, sig binary, size int, place int"))
    column = Window.partitionBy("h")
    order = Window.partitionBy("h").orderBy("turn", "sig", "place")
    met = (entries.withColumn("turn", F.xxhash64("sig"))
           .withColumn("first", F.first(F.struct("sig", "size", "place")).over(order))
           .withColumn("next", F.lead("sig").over(order))
           # only the first row of a column has nothing before it; it counts if another follows
           .filter("sig <> first.sig OR next IS NOT NULL")
           .select("h", "sig", "size", "place", "first"))
    met = cut(met)
    del entries
    let_go(docs.sparkSession)

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(sig, text) of the sets that are in pairs: one text for each set."""
        names = pairs.select(F.explode(F.array("x", "y")).alias("sig")).distinct()
        wanted = cut(names.join(classes, "sig").select("sig", "row.k1", "row.k2"))
        keys = KeyFilter(wanted.select(F.col("k1").alias("k")))
        return (src.filter(keys.passes(F.col("k1"))).join(wanted, ["k1", "k2"])
                .select("sig", "text").dropDuplicates(["sig"]))

    pair = ["sig AS x", "size AS x_size", "place AS x_place",
            "first.sig AS y", "first.size AS y_size", "first.place AS y_place"]
    tried = None
    links = None
    label = None
    for turn in range(rounds + 1):
        if turn:
            # rows with their components; finished columns go
            now = met.select("h", "sig", "size", "place").join(label, "sig", "left").withColumn(
                "label", F.coalesce("label", "sig"))
            now = (now.withColumn("low", F.min("label").over(column)).withColumn("high", F.max("label").over(column))
                   .filter("low <> high"))
        if turn == 0:
            pairs = met.selectExpr(*pair).filter("x <> y")
        elif turn < rounds:
            other = Window.partitionBy("h").orderBy(F.xxhash64("sig", "h", F.lit(turn)), "sig", "place")
            pairs = (now.withColumn("first", F.first(F.struct("sig", "size", "place", "label")).over(other))
                     .filter("label <> first.label").selectExpr(*pair))
        else:
            now = _one_of_alike(now).select("h", "sig", "size", "place", "label", "columns")
            x = now.select("h", "columns", *(F.col(c).alias(f"x_{c}") for c in ("size", "place", "label")), F.col("sig").alias("x"))
            y = now.select("h", *(F.col(c).alias(f"y_{c}") for c in ("size", "place", "label")), F.col("sig").alias("y"))
            pairs = x.join(y, "h").filter("x_label < y_label")
        pairs = pairs.filter(_fits(num, den))
        if turn == rounds:  # every column that both rows have has been met: overlaps add up
            pairs = (pairs.groupBy("x", "y", "x_size", "y_size").agg(F.sum("columns").alias("overlap"))
                     .filter(enough_shared("overlap", num, den)))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = cut(pairs)
        now = x = y = None
        let_go(docs.sparkSession)
        found = cut(_linked(pairs, texts_of(pairs), n, num, den))
        let_go(docs.sparkSession)
        tried = found.select("x", "y") if tried is None else tried.unionByName(found.select("x", "y"))
        own = found.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = own if links is None else links.unionByName(own)
        label = components(links).select(F.col("node").alias("sig"), "label")
    named = (classes.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = named.join(lowest, "label").select("sig", "component_id")
    full = rows.filter("sig IS NOT NULL").join(of_set, "sig").select("id", "size", "component_id")
    bare = rows.filter("sig IS NULL").select("id", "size", F.col("id").alias("component_id"))
    return full.unionByName(bare).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                num: int = 4, den: int = 5) -> DataFrame:
    """The documents without those of which a linked one with a smaller id stays.
    Of rows with equal ids, which count as one document, the one with the smallest
    text (nulls last) stays; rows without an id stay."""
    found = jaccard_components(docs, id_col, text_col, n, num, den).select(
        F.col(id_col).alias("id"), "component_id").filter("id IS NOT NULL")
    per_id = cut(found.groupBy("id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")))
    again = per_id.filter("n > 1 AND id = c").select("id")
    kept = without_ids(docs, id_col, per_id.filter("n > 1 OR id <> c").select("id"))
    if again.isEmpty():
        return kept
    order = Window.partitionBy(id_col).orderBy(F.asc_nulls_last(text_col))
    first = (docs.join(again.toDF("__id"), F.col(id_col) == F.col("__id"), "left_semi")
             .withColumn("__turn", F.row_number().over(order)).filter("__turn = 1").drop("__turn"))
    return kept.unionByName(first)


def _arrow(spark_type):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(spark_type)
