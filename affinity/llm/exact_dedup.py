"""Exact copies of texts: two passes with a Bloom filter, DataFrame functions only.

Texts are equal when they are identical without the characters of
``[\\x20\\x09-\\x0D]``; a null text counts as empty, and all empty texts are copies of
each other. Of equal texts the row with the most code points in the original text
stays, then the smallest id (null ids last), then, of rows that tie in both, one.

* Pass one deals the 256-bit digests to the positions of a Bloom filter and keeps
  the positions that were hit twice or more (a counting filter of one hash, held as
  64-bit words of a DataFrame; partial counts before the shuffle of positions).
* Pass two looks every row up in those words. A row whose position was hit once
  can have no copy and passes straight through, without a shuffle. The others,
  the repeats and a few false positives, are grouped by their whole digest.

The words are broadcast. Their number has a bound that doesn't depend on the
data: ``MAX_FILTER_BITS / 64``. With more than some 10^8 texts the filter fills, and
ever more rows take the way of the candidates; results are the same.

A group of copies may hold any share of the rows: groups are aggregated before
their shuffle, and the representatives of large groups, at most ``1 / HOT_SHARE`` of
them, come to their rows by a broadcast, so no task gets all rows of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Filter bits for each row (about 6 % of single texts pass by chance), and most bits at all.
BITS_PER_ROW, MAX_FILTER_BITS = 16, 1 << 27
#: Groups with this share of the candidates, and so many rows, are looked up by a broadcast.
HOT_SHARE, HOT_LEAST = 1e-4, 1000

# The characters that don't count, U+0020 and U+0009 to U+000D.
IGNORED = " \t\n\x0b\f\r"


def bare(text: Column) -> Column:
    """The text without the ignored characters; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def filter_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < min(rows * BITS_PER_ROW, MAX_FILTER_BITS):
        bits <<= 1
    return bits


def repeated_words(keys: DataFrame, bits: int) -> DataFrame:
    """(__word, __bits): the filter words of all positions (column __at) hit by two rows or more."""
    twice = keys.groupBy("__at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (twice.groupBy(F.shiftright("__at", 6).alias("__word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(__at & 63 AS INT))")).alias("__bits")))


def position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))


def marked(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (with __at) and __maybe: whether the filter has their position."""
    found = rows.withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word", "left")
    hit = F.getbit(F.coalesce("__bits", F.lit(0).cast("long")), F.expr("CAST(__at & 63 AS INT)")) == 1
    return found.withColumn("__maybe", hit).drop("__word", "__bits", "__at")


def _best(id_col: str) -> Column:
    """The row that stays, as a struct whose smallest value it is."""
    i = F.col(id_col)
    return F.min(F.struct((-F.col("__chars")).alias("less"), i.isNull().alias("no_id"), i.alias("id"),
                          F.col("__row").alias("row")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Rows with equal ids or null ids count as rows of their own, so of a repeated row
    exactly one is kept; keep_id is null where the row that stays has a null id.
    An empty table gives no rows; other columns aren't looked at."""
    text = F.col(f"`{text_col}`")
    digests = cut(docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("__chars"),
        F.unhex(F.sha2(bare(text), 256)).alias("__sha"), F.monotonically_increasing_id().alias("__row")))
    bits = filter_bits(digests.count())
    rows = digests.withColumn("__at", position(F.col("__sha"), bits))
    rows = marked(rows, repeated_words(rows, bits))

    alone = rows.filter("NOT __maybe").select("__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__n"),
                                              F.lit(True).alias("__kept"), "__sha")
    maybe = rows.filter("__maybe").drop("__maybe")
    groups = cut(maybe.groupBy("__sha").agg(F.count(F.lit(1)).alias("__n"), _best("__id").alias("__best")))
    many = max(HOT_LEAST, int((groups.agg(F.sum("__n")).first()[0] or 0) * HOT_SHARE))
    hot = groups.filter(F.col("__n") >= many)
    near = maybe.join(F.broadcast(hot), "__sha", "left")
    of_hot = near.filter("__n IS NOT NULL")
    others = near.filter("__n IS NULL").drop("__n", "__best").join(groups.filter(F.col("__n") < many), "__sha")
    grouped = of_hot.unionByName(others).select(
        "__id", F.col("__best.id").alias("__keep"), "__n", (F.col("__row") == F.col("__best.row")).alias("__kept"), "__sha")
    return alone.unionByName(grouped).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
        F.col("__kept").alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all
    their columns. Rows that the filter lets pass aren't shuffled; the candidates are
    written once, and only their digests are grouped."""
    text = F.col(f"`{text_col}`")
    seen = docs.withColumn("__sha", F.unhex(F.sha2(bare(text), 256)))
    bits = filter_bits(docs.count())
    at = position(F.col("__sha"), bits)
    rows = marked(seen.withColumn("__at", at), cut(repeated_words(seen.select(at.alias("__at")), bits)))
    maybe = cut(rows.filter("__maybe").drop("__maybe").withColumn("__row", F.monotonically_increasing_id()))
    chars = maybe.withColumn("__chars", F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long"))
    stay = (chars.select("__sha", "__chars", "__row", F.col(f"`{id_col}`").alias("__id")).groupBy("__sha")
            .agg(_best("__id").alias("__best")).select(F.col("__best.row").alias("__row")))
    kept = maybe.join(stay, "__row", "left_semi")
    return rows.filter("NOT __maybe").drop("__maybe", "__sha").unionByName(kept.drop("__row", "__sha")).select(
        *[f"`{c}`" for c in docs.columns])


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``mark_copies``."""
    return f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM {table}),
g AS (SELECT doc_id, sha, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY sha) AS group_size
      FROM t WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM g"""
