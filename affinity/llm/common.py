"""Helpers shared by the corpus operators.

Text work inside tasks is done on whole Arrow batches with NumPy: words and
their hashes are found for a few megabytes of concatenated text at a time, so a
task's memory does not follow the size of its partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package, table_path

#: Bytes of text that a task hashes at once.
CHUNK_BYTES = 1 << 20

# The multipliers and shifts of the splitmix64 finaliser.
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MIX_SHIFTS = (30, 27, 31)

#: Odd multipliers of the polynomial hashes of bytes and of words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


#: Bytes of an Arrow batch between the JVM and Python, unless the session sets its own.
ARROW_BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Balance Arrow batches by bytes, so that their memory doesn't follow the
    length of texts; a setting that the session has is left alone. Workers get the
    package, as every operator comes through here or ``tidy``."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BATCH))
    return spark


def tidy(run):
    """An Arrow function that gives freed memory back when its task ends: workers
    are kept for later tasks, beside which their old heap would count."""
    ship_package(SparkSession.active())

    def wrapped(it):
        yield from run(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(table_path(sf_dir, name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


# --- Arrow and byte buffers -------------------------------------------------

def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, whole


def row_ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)


# --- hashing ----------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (bijective)."""
    a, b, c = (np.uint64(s) for s in MIX_SHIFTS)
    h = (h ^ (h >> a)) * np.uint64(MIX_A)
    h = (h ^ (h >> b)) * np.uint64(MIX_B)
    return h ^ (h >> c)


def word_class(separators: bytes) -> np.ndarray:
    """Which bytes belong to words (all but the separators)."""
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    return inside


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Words of the resemblance operators: anything but ASCII white space.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words of the contamination rule: ASCII letters and digits and everything beyond ASCII.
NOT_ALNUM = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))


class WordHasher:
    """Finds the words of concatenated texts and hashes them, A-Z lowered."""

    def __init__(self, separators: bytes = SPACES):
        self.inside = word_class(separators)
        self.value = mix(lower_table().astype(np.uint64) + np.uint64(1))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            for name, base in (("power", BYTE_BASE), ("inverse", pow(BYTE_BASE, -1, 1 << 64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, row, start, end) of every word of the rows; starts and ends
        are positions in ``data``."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        part = data[lo:hi]
        if not len(part):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none
        self._grow(len(part))
        inside = self.inside[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0] - lo
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.value[part] * self.power[:len(part)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        h = mix(h + (end - start).astype(np.uint64) * np.uint64(MIX_A))
        row = np.searchsorted(offsets, start + lo, side="right") - 1
        return h, row, start + lo, end + lo


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (rows are not looked at)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count].copy()
    for j in range(1, n):
        h = h * np.uint64(WORD_BASE) + words[j:j + count]
    return mix(h + np.uint64(n))


def shingle_sets(words: np.ndarray, row: np.ndarray, rows: int, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row. A row with fewer than
    ``n`` words has its whole word sequence as its one shingle; without words
    the set is empty."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    grams = ngram_hashes(words, n)
    out = []
    for i in range(rows):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= n:
            out.append(np.unique(grams[lo:hi - n + 1]))
        elif hi > lo:
            out.append(ngram_hashes(words[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def row_order(row: np.ndarray, h: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The order by (row, first, h); ``first`` are counts, compared on a log scale.
    One sort of packed keys; only if two hashes agree in all packed bits, by the
    whole hashes."""
    if not len(row):
        return np.zeros(0, np.int64)
    bits = 64 - int(row.max()).bit_length()
    key = h >> np.uint64(64 - bits) if bits < 64 else h.copy()
    scale = None
    if first is not None:
        scale = np.minimum(np.log2(1 + first) * 16, 1023).astype(np.uint64)
        key = (scale << np.uint64(bits - 10)) | (key >> np.uint64(10))
    if bits < 64:
        key |= row.astype(np.uint64) << np.uint64(bits)
    order = np.argsort(key)
    k, own = key[order], h[order]
    if ((k[1:] == k[:-1]) & (own[1:] != own[:-1])).any():
        return np.lexsort((h, row) if scale is None else (h, scale, row))
    return order


def enough_shared(shared: str, num: int, den: int) -> str:
    """SQL: whether two sets (x_size, y_size) that share ``shared`` tokens of their
    prefixes can have a resemblance of num/den. Whichever prefix ends first in the
    common order, all shared tokens of that prefix are in the other one too, so
    the overlap is at most ``shared`` and what stands behind that prefix."""
    rest = " , ".join(f"(({s}_size * {num}L + {den - 1}) div {den} - 1)" for s in "xy")
    return f"({shared} + greatest({rest})) * {num + den}L >= (x_size + y_size) * {num}L"


# --- counts and filters of proven size ---------------------------------------

#: Most entries of a table of frequent hashes: 8 MB of hashes, 8 MB of counts.
FREQUENT_ENTRIES = 1 << 20
#: Hashes that a task counts at a time.
COUNTED_AT_ONCE = 4 << 20
#: Bits of a key filter (8 MB).
FILTER_BITS = 1 << 26


class LocalCounts:
    """Counts hashes in a task; gives out those that are frequent among a few
    million at a time. A hash that makes up a millionth of all is among them
    wherever it is spread evenly, and what is left out only costs speed: the
    counts set an order, and every order gives the same result."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray):
        self.held.append(hashes)
        self.size += len(hashes)
        return self.flush() if self.size >= COUNTED_AT_ONCE else None

    def flush(self):
        """(hashes, counts, number counted) or None."""
        if not self.size:
            return None
        h, size = np.concatenate(self.held), self.size
        self.held, self.size = [], 0
        h.sort()
        # the first of each run of equal hashes that is long enough, then its length
        least = max(2, size // FREQUENT_ENTRIES)
        long = h[least - 1:] == h[:len(h) - least + 1]
        long[1:] &= h[1:len(long)] != h[:len(long) - 1]
        first = np.flatnonzero(long)
        return h[first], np.searchsorted(h, h[first], side="right") - first, size


class Frequent:
    """The frequent hashes and their counts, at most ``FREQUENT_ENTRIES``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def count(self, h: np.ndarray) -> np.ndarray:
        """Count of each hash, 0 if it isn't frequent."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


def frequent(counts: DataFrame) -> Frequent:
    """From rows (h long, n long); the row with a null h has the number counted.
    Kept are hashes with at least a ``FREQUENT_ENTRIES``-th of all occurrences,
    of which there can be no more than that many."""
    total = counts.filter("h IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(32, -(-int(total) // FREQUENT_ENTRIES))
    found = (counts.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= least).toArrow())
    return Frequent(np.asarray(found["h"]).view(np.uint64), np.asarray(found["n"]))


class KeyFilter:
    """A one-hash Bloom filter of fixed size over 64-bit keys: no false
    negatives. It spares the shuffle of texts that no candidate names; beyond
    some ten million keys it lets ever more through, which only costs time."""

    def __init__(self, keys: DataFrame):
        low = keys.select(F.pmod(F.col("k"), F.lit(FILTER_BITS)).alias("k"))
        words = (low.groupBy(F.shiftright("k", 6).cast("int").alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, CAST(k & 63 AS INT))")).alias("b")).toArrow())
        bits = np.zeros(FILTER_BITS >> 6, np.uint64)
        bits[np.asarray(words["w"])] = np.asarray(words["b"]).view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def passes(self, key: Column) -> Column:
        shared = self.shared

        def look(k: pd.Series) -> pd.Series:
            at = k.to_numpy(np.int64) & (FILTER_BITS - 1)
            return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

        return F.pandas_udf(look, "boolean")(key)


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id isn't among those of ``gone`` (one column); rows
    with a null id stay. Only rows that a key filter can't tell apart from the
    ones that go are shuffled."""
    gone = gone.toDF("__gone").filter("__gone IS NOT NULL")
    maybe = KeyFilter(gone.select(F.xxhash64("__gone").alias("k"))).passes(F.xxhash64(F.col(f"`{id_col}`")))
    marked = df.withColumn("__maybe", maybe)
    near = marked.filter("__maybe").join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    return marked.filter("NOT __maybe").unionByName(near).drop("__maybe")


# --- components --------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of the links (a, b) with the smallest node that
    it is connected to. Alternates large-star and small-star steps, each a
    partial minimum and a join, until no link changes; the number of steps grows
    with the logarithm of the longest path. Lineage is cut at every step."""
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("u")).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        links = cut(small)
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == state:
            break
        state = now
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back; lost executors
    cost no recomputation of what came before."""
    return cut_lineage(df)
