"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` smallest distinct hashes of a text's word shingles
(five words by default) and whether that is all of them. Fingerprints merge: the
sketch of a union is the bottom k of the sketches' union, so parts of a document
or of a corpus are sketched apart. From them come estimates of resemblance
(Jaccard), containment and the number of distinct shingles.

Format: base64 of a byte (1: the sketch is the whole set) and ``HASH_BYTES`` big-
endian bytes for each hash, ascending.

Edge cases: null counts as empty; a text without words has an empty sketch;
two empty sketches have resemblance 1, an empty and a non-empty one 0; a text
with fewer than ``n`` words has its word sequence as its one shingle; ties and
repeated rows are sketched each; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, buffers, row_ranges, shingle_sets, shuffle_partitions

HASH_BYTES = 6
K = 192
SHINGLE = 5


class Sketch:
    """The bottom-k sketch of a set of hashes."""

    def __init__(self, hashes: np.ndarray, k: int = K, whole: bool | None = None):
        self.k = k
        self.whole = len(hashes) <= k if whole is None else whole and len(hashes) <= k
        self.hashes = hashes[:k]

    @classmethod
    def of_set(cls, grams: np.ndarray, k: int = K) -> "Sketch":
        """From the sorted distinct 64-bit hashes of a set."""
        return cls(np.unique(grams >> np.uint64(64 - 8 * HASH_BYTES)), k)

    @classmethod
    def parse(cls, text: str, k: int = K) -> "Sketch":
        raw = base64.b64decode(text)
        cells = np.frombuffer(raw[1:], np.uint8).reshape(-1, HASH_BYTES)
        wide = np.zeros((len(cells), 8), np.uint8)
        wide[:, 8 - HASH_BYTES:] = cells
        return cls(wide.view(">u8").ravel().astype(np.uint64), k, raw[:1] == b"\1")

    def __str__(self) -> str:
        cells = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:]
        return base64.b64encode((b"\1" if self.whole else b"\0") + cells.tobytes()).decode()

    def merge(self, other: "Sketch") -> "Sketch":
        """The sketch of the union of both sets."""
        k = min(self.k, other.k)
        return Sketch(np.union1d(self.hashes, other.hashes), k, self.whole and other.whole)

    def _shared(self, other: "Sketch") -> tuple[int, int]:
        """(hashes of the union's sketch that both sets have, size of that sketch)."""
        both = self.merge(other)
        common = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        size = len(both.hashes)
        return (int((common <= both.hashes[-1]).sum()) if size else 0), size

    def resemblance(self, other: "Sketch") -> float:
        if not len(self.hashes) and not len(other.hashes):
            return 1.0
        same, size = self._shared(other)
        return same / size

    def distinct(self) -> float:
        """Estimated number of distinct shingles (exact if the sketch is whole)."""
        if self.whole:
            return float(len(self.hashes))
        return (self.k - 1) / ((float(self.hashes[self.k - 1]) + 1.0) / 2.0 ** (8 * HASH_BYTES))

    def containment(self, other: "Sketch") -> float:
        """Estimated share of this set that the other one holds."""
        if not len(self.hashes):
            return 1.0
        overlap = self.resemblance(other) * self.merge(other).distinct()
        return min(1.0, overlap / self.distinct())


def sketches(texts: pa.Array, hasher: WordHasher, n: int = SHINGLE, k: int = K) -> list[Sketch]:
    """The sketch of every text."""
    at, data = buffers(texts)
    out = []
    for lo, hi in row_ranges(at):
        h, row, _, _ = hasher(data, at[lo:hi + 1])
        out += [Sketch.of_set(s, k) for s in shingle_sets(h, row, hi - lo, n)]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE, k: int = K) -> DataFrame:
    """(id, fingerprint, n_distinct) of every row; one narrow stage."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(it):
        hasher = WordHasher()
        for batch in it:
            made = sketches(batch.column("text"), hasher, n, k)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "fingerprint": pa.array([str(s) for s in made], pa.string()),
                "n_distinct": pa.array([s.distinct() for s in made], pa.float64())})

    return (src.mapInArrow(run, f"id {id_type}, fingerprint string, n_distinct double")
            .withColumnRenamed("id", id_col))


def followed_by(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, id, text, last) such that within a bucket, in the order
    (last, id descending with nulls at the end, text descending), each row with
    ``last`` = 0 is followed by its successor in the whole table's order; the
    last row of all is followed by the first.

    Buckets are ranges of ids between quantiles found over all rows. Each bucket
    also gets a copy of the following bucket's first row (``last`` = 1), so texts
    are shuffled once and no task sees the whole order."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    cuts = src.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    # bucket 0 has the largest ids; null ids come after all others
    bucket = F.lit(len(cuts)) - sum((F.col("id") >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    src = src.withColumn("bucket", F.coalesce(bucket, F.lit(len(cuts) + 1)).cast("int"))
    # the first row of each bucket: at most one id for each of the cuts
    found = src.groupBy("bucket").agg(F.max("id").alias("top")).orderBy("bucket").collect()
    heads = [r["bucket"] for r in found]
    tops = spark.createDataFrame([tuple(r) for r in found], f"bucket int, top {src.schema['id'].dataType.simpleString()}")
    first = (src.join(F.broadcast(tops.withColumnRenamed("bucket", "b")),
                      (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("top")))
             .groupBy("bucket", "id").agg(F.max("text").alias("text")))
    before = dict(zip(heads[1:] + heads[:1], heads, strict=True))
    pairs = [(int(b), int(a)) for b, a in before.items()]
    to = spark.createDataFrame(pairs or [(0, 0)], "bucket int, target int")
    copies = (first.join(F.broadcast(to), "bucket")
              .select("id", "text", F.col("target").alias("bucket"), F.lit(1).alias("last")))
    return (src.withColumn("last", F.lit(0)).unionByName(copies)
            .repartition(max(1, parts), "bucket")
            .sortWithinPartitions("bucket", "last", F.desc_nulls_last("id"), F.desc("text")))


def likeness_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      n: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half of its
    code points replaced by as many first ones of the next document, in
    descending id order), and the likeness of the fingerprint to the edited
    text's and to the next document's."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ordered = followed_by(docs, id_col, text_col).select("bucket", "last", "id", "text")

    def run(it):
        hasher = WordHasher()
        held = None  # (bucket, id, text, sketch) that waits for its successor
        for batch in it:
            at, _ = buffers(batch.column("text"))
            for lo, hi in row_ranges(at):
                part = batch.slice(lo, hi - lo)
                made = sketches(part.column("text"), hasher, n, k)
                done = []
                for b, last, i, text, sketch in zip(*(part.column(c).to_pylist() for c in
                                                      ("bucket", "last", "id", "text")), made, strict=True):
                    if held and held[0] == b:
                        done.append((held, text, sketch))
                    held = None if last else (b, i, text, sketch)
                if not done:
                    continue
                edited = []
                for (_, _, text, _), after, _ in done:
                    half = len(text) // 2
                    edited.append(text[:len(text) - half] + after[:half])
                other = sketches(pa.array(edited, pa.string()), hasher, n, k)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([d[0][1] for d in done], part.schema.field("id").type),
                    "n_chars": pa.array([len(d[0][2]) for d in done], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                    "fingerprint": [str(d[0][3]) for d in done],
                    "edited_fingerprint": [str(s) for s in other],
                    "near_edited": pa.array([d[0][3].resemblance(s) for d, s in zip(done, other, strict=True)],
                                            pa.float64()),
                    "near_next": pa.array([d[0][3].resemblance(d[2]) for d in done], pa.float64())})

    return (ordered.mapInArrow(run, f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")
            .withColumnRenamed("id", id_col))
