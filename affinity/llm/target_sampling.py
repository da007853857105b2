"""Importance resampling towards a target distribution over hashed word n-grams.

Features of a text are its runs of one to three consecutive words, joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. A bucket's
gain says how much more frequent it is in the target than in the corpus, a document's
weight is the sum over its features, and adding Gumbel noise drawn from its id
makes the highest scores a sample without replacement, in proportion to the weights.

Tasks work on blocks of words of a batch. Equal features of a block become one by
exact ids of their words (no hashing); the distinct ones are grouped by their length
in bytes into two-dimensional uint8 arrays, the CRCs of all features of one length
are updated column by column, and the buckets are scattered back to the features.

Two passes read the texts: one counts features by bucket (a task gives ``BUCKETS``
numbers), one sums gains. Only bucket counts come to the driver and only gains go
out, ``BUCKETS`` numbers each, however large the corpus. The draw ranks scores by
ranges (``operators.numbering``), not in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import NOT_ALNUM, bounded_batches, buffers, cut, lower_table, ragged, row_ranges, tidy, word_class

BUCKETS, LONGEST_RUN = 10_000, 3
#: Words of a block; its features are held at once.
BLOCK_WORDS = 1 << 18
#: Features longer than this in bytes are rare and share no length; each has its CRC by itself.
LONG_FEATURE = 256

# The reversed CRC-32 polynomial, and the steps of its byte table.
POLYNOMIAL = np.uint32(0xEDB88320)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ POLYNOMIAL, table >> np.uint32(1))
    return table


TABLE = crc_table()
INSIDE, LOWER = word_class(NOT_ALNUM), lower_table()


def crc_matrix(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of equally long byte strings; ``columns[j]`` has byte j of each."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def by_length(lengths: np.ndarray):
    """(length, places) of each length."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(lengths[places[0]]), places


def crcs(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of ``text``, by matrices of equal length."""
    out = np.zeros(len(start), np.uint32)
    for n, places in by_length(length):
        if n > LONG_FEATURE:
            for i in places:
                out[i] = zlib.crc32(text[start[i]:start[i] + n])
        else:
            out[places] = crc_matrix(text[start[places][None, :] + np.arange(n)[:, None]])
    return out


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of each key, place of the first key of each id)."""
    _, first, ids = np.unique(keys, return_index=True, return_inverse=True)
    return ids.astype(np.int64), first


def word_ids(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Equal words have equal ids, others different ones; compared byte by byte."""
    out, known = np.zeros(len(start), np.int64), 0
    for n, places in by_length(length):
        if n > 64:
            names: dict[bytes, int] = {}
            ids = np.array([names.setdefault(text[i:i + n].tobytes(), len(names)) for i in start[places]], np.int64)
        else:
            wide = -(-n // 8) * 8
            rows = np.zeros((len(places), wide), np.uint8)
            rows[:, :n] = text[start[places][:, None] + np.arange(n)]
            packed = rows.view(np.uint64)
            ids, _ = dense(packed[:, 0])
            for j in range(1, packed.shape[1]):
                more, firsts = dense(packed[:, j])
                ids, _ = dense(ids * len(firsts) + more)
        out[places] = ids + known
        known += int(ids.max()) + 1
    return out


def word_runs(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of the words of the rows; positions in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = INSIDE[data[lo:hi]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0] - lo
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first) + lo, np.flatnonzero(last) + 1 + lo
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, fresh: int):
    """(rows, buckets) of the features that end in word ``fresh`` or later."""
    length = end - start
    begin = np.cumsum(length + 1) - length - 1
    text = np.full(int((length + 1).sum()), 0x20, np.uint8)
    text[ragged(begin, length)] = LOWER[data[ragged(start, length)]]
    words = word_ids(text, begin, length)
    kinds = int(words.max()) + 1
    rows, ids, starts, lengths, known = [], [], [], [], 0
    run = words
    for n in range(1, LONGEST_RUN + 1):
        if len(words) < n:
            break
        if n > 1:
            run = run[:len(words) - n + 1] * kinds + words[n - 1:]
        run, firsts = dense(run)
        last = firsts + n - 1
        own = row[:len(run)] == row[n - 1:]
        own[:max(fresh - n + 1, 0)] = False
        used = np.flatnonzero(own)
        rows.append(row[used])
        ids.append(run[used] + known)
        starts.append(begin[firsts])
        lengths.append(begin[last] + length[last] - begin[firsts])
        known += len(firsts)
    rows, ids, starts, lengths = (np.concatenate(x) for x in (rows, ids, starts, lengths))
    named = np.zeros(known, bool)  # runs over the end of a text are no features
    named[ids] = True
    bucket = np.zeros(known, np.int64)
    bucket[named] = crcs(text, starts[named], lengths[named]) % np.uint32(BUCKETS)
    return rows, bucket[ids]


def feature_blocks(column):
    """(first row, rows, words of each row, feature rows, feature buckets) of the
    texts of an Arrow column; a text longer than a block is in several."""
    offsets, data = buffers(column)
    for i, j in row_ranges(offsets):
        at = offsets[i:j + 1]
        start, end, row = word_runs(data, at) if at[-1] > at[0] else [np.zeros(0, np.int64)] * 3
        per_row = np.bincount(row, minlength=j - i)
        parts = []
        for a in range(0, len(start), BLOCK_WORDS):
            carried = min(a, LONGEST_RUN - 1)
            here = slice(a - carried, a + BLOCK_WORDS)
            parts.append(features(data, start[here], end[here], row[here], carried))
        yield i, j - i, per_row, parts


def bucket_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, parts in feature_blocks(batch.column(0)):
                for _, buckets in parts:
                    total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    given = texts.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    return given.mapInArrow(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> np.ndarray:
    """Bucket counts as an array; at most ``BUCKETS`` rows."""
    found, out = counts.toArrow(), np.zeros(BUCKETS, np.int64)
    out[np.asarray(found["bucket"])] = np.asarray(found["n"])
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down, from the feature counts of
    corpus and target; one is added to each count."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            words, counts, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, n, per_row, parts in feature_blocks(batch.column(1)):
                words[i:i + n] = per_row
                for rows, buckets in parts:
                    counts[i:i + n] += np.bincount(rows, minlength=n)
                    order = np.argsort(rows, kind="stable")
                    sums = np.concatenate([[0], np.cumsum(shared.value[buckets[order]])])
                    edges = np.searchsorted(rows[order], np.arange(n + 1))
                    weights[i:i + n] += sums[edges[1:]] - sums[edges[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(counts), pa.array(weights)], ["id", "n_words", "n_features", "weight"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(tidy(run), f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id alone (null: as empty)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20,
                        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows with ``least_words`` or more, the floor(N * share) highest scores are
    drawn, ties to the smaller id (null ids last, repeated rows each by themselves);
    ``rank`` is 1, 2, ... in that order and null for the others. A null or wordless text
    has no features and weight 0. An empty target gives every bucket the gain of no
    occurrence; an empty table gives no rows. Other columns aren't looked at."""
    bounded_batches(docs.sparkSession)
    gain = gains(collected(bucket_counts(docs, text_col)), collected(bucket_counts(target, target_col)))
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = cut(scored.withColumn("__row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * share[0] // share[1]
    ranked = number_rows(scored.filter(able), F.col("score").desc(), F.col("id").asc_nulls_last(), "__row", name="rank", start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return (ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("__row")
            .withColumnRenamed("id", id_col))
