"""Benchmark decontamination by winnowing.

A window of an item is ``span`` consecutive words (13 by default); an item of
fewer words is one window. Of every run of ``span - gram + 1`` word k-grams the
one with the smallest hash is kept as a fingerprint, on both sides. Any shared
span of ``span`` words holds the same run of k-grams, hence the same kept
fingerprint, so no shared span is missed.

Both tables are winnowed in tasks. A fingerprint carries its context, the hashes
of the words that a window around it can reach. A filter of fixed size over the
items' fingerprints spares the shuffle of others of the documents; what passes is
joined on the fingerprint, and each hit is extended to both sides as long as the
contexts agree: it counts if the stretch holds a window. Every word of a window
that occurs is within the stretch of the window's own fingerprint, so short
contexts lose nothing. Items too short for a window are looked up by the hash of
their whole word sequence, for each length that occurs. Fingerprints that very
many documents share are dealt over salts. No texts are shuffled or sent to the
driver; what goes through it are the filter and the lengths of short items.

Edge cases: null or empty texts have no words and no hits; items without words
have no windows; items with equal texts are reported each, equal item ids once;
null item ids hit but are not listed; null and repeated document ids are judged
row by row (rows equal in all columns meet under one key); extra columns are kept
out of the way by positional names. Documents without words aren't contaminated.
Words are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import SALT, split_hot
from .common import (FILTER_BITS, NOT_ALNUM, KeyFilter, WordHasher, bounded_batches, buffers, cut, ngram_hashes,
                     row_ranges, tidy)

SPAN = 13
GRAM = 5
#: Fingerprints in an Arrow batch that a task gives out.
PRINTS_AT_ONCE = 1 << 14
#: What stands in contexts for words beyond the text's borders, in documents and in items.
NO_WORD, NO_ITEM_WORD = 0, 1


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the rightmost of equals) of every run of ``width``."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    reach = 1
    while reach < width:  # doubling: best of [i, i + reach)
        step = min(reach, width - reach)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(grams[b] <= grams[a], b, a)
        reach += step
    keep = np.zeros(n, bool)
    keep[best] = True
    return np.flatnonzero(keep)


def _kept(grams: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Winnowed positions. Grams at borders between documents take part with the
    largest hash, so that they don't displace a document's own minimum."""
    g = len(row) - len(grams)
    own = np.where(row[:len(grams)] == row[g:], grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    keep = np.zeros(len(grams), bool)
    keep[window_minima(own, width)] = True
    return keep


class Prints:
    """The fingerprints of some texts, with their contexts."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, span: int, gram: int):
        self.words, self.row, self.span, self.gram = words, row, span, gram
        self.size = np.bincount(row, minlength=rows)
        self.first = np.cumsum(self.size) - self.size
        self.grams = ngram_hashes(words, gram)
        kept = _kept(self.grams, row, span - gram + 1) if len(self.grams) else np.zeros(0, bool)
        at = np.flatnonzero(kept)
        # minima of runs across borders only add fingerprints; those that span a border are none
        self.at = at[(row[at] == row[at + gram - 1]) & (self.size[row[at]] >= span)]

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, position) of all runs of ``length`` words. Complements, so that
        they don't meet fingerprints of as many words."""
        h = ngram_hashes(self.words, length)
        at = np.flatnonzero(self.row[:len(h)] == self.row[length - 1:])
        return ~h[at], at

    def contexts(self, at: np.ndarray, beyond: int) -> pa.Array:
        """The hashes of the words from the first to the last that a window around
        the fingerprints at ``at`` can hold."""
        place = at[:, None] + np.arange(self.gram - self.span, self.span)
        row = self.row[at][:, None]
        inside = (place >= self.first[row]) & (place < self.first[row] + self.size[row])
        words = np.where(inside, self.words[np.where(inside, place, 0)], np.uint64(beyond))
        ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(8 * place.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())])


def _texts(it, span, gram):
    hasher = WordHasher(NOT_ALNUM)
    for batch in it:
        at, data = buffers(batch.column("text"))
        for lo, hi in row_ranges(at):
            words, row, _, _ = hasher(data, at[lo:hi + 1])
            yield batch.slice(lo, hi - lo), Prints(words, row, hi - lo, span, gram)


def _item_prints(span, gram):
    """(h, item, length, item_context) of fingerprints and, without context, of whole short items."""
    def run(it):
        for part, found in _texts(it, span, gram):
            for lo in range(0, len(found.at), PRINTS_AT_ONCE):
                at = found.at[lo:lo + PRINTS_AT_ONCE]
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(found.grams[at].view(np.int64)), "item": part.column("id").take(pa.array(found.row[at])),
                    "length": pa.array(np.full(len(at), span, np.int32)),
                    "item_context": found.contexts(at, NO_ITEM_WORD)})
            for length in np.unique(found.size[(found.size > 0) & (found.size < span)]).tolist():
                h, at = found.sequences(length)
                on = found.size[found.row[at]] == length
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h[on].view(np.int64)), "item": part.column("id").take(pa.array(found.row[at[on]])),
                    "length": pa.array(np.full(int(on.sum()), length, np.int32)),
                    "item_context": pa.nulls(int(on.sum()), pa.binary())})
    return run


def _doc_prints(passing, lengths, span, gram, schema):
    """A row (…, n_words, candidates) for each document, and a row (…, h, start,
    context) for each of its fingerprints and short sequences that pass the filter."""
    def rows(part, take, **columns):
        own = {f.name: part.column(f.name).take(take) for f in part.schema if f.name != "text"}
        none = {f.name: pa.nulls(len(take), f.type) for f in schema if f.name not in own}
        return pa.RecordBatch.from_pydict({**own, **none, **columns}, schema=pa.schema(
            [*(part.schema.field(x) for x in own), *(f for f in schema if f.name not in own)]))

    def run(it):
        bits = passing.value

        def among(h):
            return (bits[(h & np.uint64(FILTER_BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1

        for part, found in _texts(it, span, gram):
            h = found.grams[found.at]
            on = among(h)
            groups = [(h[on], found.at[on], True)]
            for length in lengths:
                h, at = found.sequences(length)
                on = among(h)
                groups.append((h[on], at[on], False))
            candidates = sum(np.bincount(found.row[at], minlength=part.num_rows) for _, at, _ in groups)
            yield rows(part, pa.array(np.arange(part.num_rows)), n_words=pa.array(found.size, pa.int64()),
                       candidates=pa.array(candidates, pa.int64()))
            for h, at, long in groups:
                for lo in range(0, len(at), PRINTS_AT_ONCE):
                    own = at[lo:lo + PRINTS_AT_ONCE]
                    yield rows(part, pa.array(found.row[own]), h=pa.array(h[lo:lo + PRINTS_AT_ONCE].view(np.int64)),
                               start=pa.array(own - found.first[found.row[own]], pa.int64()),
                               context=found.contexts(own, NO_WORD) if long else pa.nulls(len(own), pa.binary()))
    return run


def _extended(span, gram):
    """(k1, k2, start, end, item) of the pairs whose agreeing stretch holds a window."""
    before = span - gram

    def run(it):
        for batch in it:
            start = np.asarray(batch.column("start"))
            left, right = np.zeros(len(start), np.int64), np.asarray(batch.column("length")).astype(np.int64)
            short = np.asarray(batch.column("context").is_null())
            good = short == np.asarray(batch.column("item_context").is_null())
            both = np.flatnonzero(good & ~short)
            if len(both):
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(both)).to_pylist()), np.uint64)
                        .reshape(len(both), -1) for c in ("context", "item_context"))
                same = (x == y).astype(np.int64)
                left[both] = np.cumprod(same[:, before - 1::-1], axis=1).sum(axis=1) if before else 0
                right[both] = np.cumprod(same[:, before:], axis=1).sum(axis=1)
                good[both] = (left[both] + right[both] >= span) & (right[both] >= gram)
            yield pa.RecordBatch.from_pydict({
                "k1": batch.column("k1"), "k2": batch.column("k2"), "start": pa.array(start - left),
                "end": pa.array(start + right), "item": batch.column("item")}).filter(pa.array(good))
    return run


def _merged(it):
    """Overlapping and adjacent stretches of each document as one."""
    for batch in it:
        out = []
        for spans in batch.column("spans").to_pylist():
            hits = []
            for a, b in sorted((r["start"], r["end"]) for r in spans):
                if hits and a <= hits[-1][1]:
                    hits[-1][1] = max(b, hits[-1][1])
                else:
                    hits.append([a, b])
            out.append([{"start": a, "end": b} for a, b in hits])
        hits = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), hits, batch.column("item_ids")],
                                         names=["k1", "k2", "hits", "item_ids"])


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """With a 128-bit key (k1, k2) of all columns that have a hash (maps have none)."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()
            and f.dataType.simpleString() != "variant" and f.name != text_col]
    cols.append(F.col(f"`{text_col}`").cast("string"))
    return docs.withColumn("__k1", F.xxhash64(*cols)).withColumn("__k2", F.xxhash64(F.lit(1), *cols))


def _met(src: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, span: int,
         gram: int) -> tuple[DataFrame, DataFrame]:
    """From rows with text, k1 and k2: (the rows without text, with n_words and
    candidates; (k1, k2, hits, item_ids) of those that have hits)."""
    bounded_batches(src.sparkSession)
    prints = cut(items.select(F.col(f"`{item_id_col}`").cast("string").alias("id"),
                              F.col(f"`{item_text_col}`").cast("string").alias("text"))
                 .mapInArrow(tidy(_item_prints(span, gram)), "h long, item string, length int, item_context binary"))
    lengths = sorted(r[0] for r in prints.filter("item_context IS NULL").select("length").distinct().collect())
    passing = KeyFilter(prints.select(F.col("h").alias("k"))).shared
    schema = pa.schema([("n_words", pa.int64()), ("candidates", pa.int64()), ("h", pa.int64()), ("start", pa.int64()),
                        ("context", pa.binary())])
    out = src.drop("text").schema
    for name, kind in (("n_words", "long"), ("candidates", "long"), ("h", "long"), ("start", "long"), ("context", "binary")):
        out = out.add(name, kind)
    rows = cut(src.mapInArrow(tidy(_doc_prints(passing, lengths, span, gram, schema)), out))
    hits = rows.filter("start IS NOT NULL").select("k1", "k2", "h", "start", "context")
    hits, prints = split_hot(hits, "h", "k1", prints)
    pairs = hits.join(prints, ["h", SALT]).select("k1", "k2", "start", "context", "item", "length", "item_context")
    found = (pairs.mapInArrow(tidy(_extended(span, gram)), "k1 long, k2 long, start long, end long, item string")
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"),
                                      F.array_sort(F.collect_set("item")).alias("item_ids")))
    found = cut(found.mapInArrow(tidy(_merged), "k1 long, k2 long, hits array<struct<start:long,end:long>>, "
                                                "item_ids array<string>"))
    return rows.filter("start IS NULL").drop("h", "start", "context"), found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN,
                  gram: int = GRAM) -> DataFrame:
    """Per document: id, n_words, hits (array of struct(start, end): word
    ranges that are hit), item_ids (sorted, distinct)."""
    src = _keyed(docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").cast("string").alias("text")), "text")
    rows, found = _met(src.withColumnsRenamed({"__k1": "k1", "__k2": "k2"}), items, item_id_col, item_text_col, span, gram)
    near = rows.filter("candidates > 0").join(found, ["k1", "k2"], "left").select("c0", "n_words", "hits", "item_ids")
    far = rows.filter("candidates = 0").selectExpr("c0", "n_words", "NULL AS hits", "NULL AS item_ids")
    return near.unionByName(far).select(
        F.col("c0").alias(id_col), "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:long,end:long>>")).alias("hits"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents that aren't contaminated, with their own columns. Only rows
    that a filter can't tell apart from contaminated ones are shuffled."""
    keyed = _keyed(docs, text_col)
    src = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, found = _met(src, items, item_id_col, item_text_col, span, gram)
    size = rows.filter("candidates > 0").groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    gone = cut(found.join(size, ["k1", "k2"]).filter(is_contaminated(F.col("hits"), F.col("n_words")))
               .select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")))
    maybe = KeyFilter(gone.select(F.col("__k1").alias("k"))).passes(F.col("__k1"))
    marked = keyed.withColumn("__maybe", maybe)
    near = marked.filter("__maybe").join(gone, ["__k1", "__k2"], "left_anti").select(marked.columns)
    return marked.filter("NOT __maybe").unionByName(near).drop("__k1", "__k2", "__maybe")


def n_hit(hits: Column) -> Column:
    """Number of hit words."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def is_contaminated(hits: Column, n_words: Column) -> Column:
    """At least one hit word, and at least one of twenty words hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= n_words)


def items_digest(item_ids: Column) -> Column:
    return F.sha2(F.array_join(item_ids, ","), 256)
