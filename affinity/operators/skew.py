"""Splitting of hot join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a so-manieth of all rows is hot; there can't be more hot keys than that.
HOT_KEYS = 1000
SALT = "_salt"


def split_hot(rows: DataFrame, key: str, by: str, other: DataFrame, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows, other) with a column ``_salt`` that belongs into their join on ``key``.

    Rows of a hot key are dealt over salts by a hash of ``by``, about 1 / ``hot_keys`` of
    all rows each, and the rows of ``other`` with that key are repeated for each
    salt; other keys have salt 0. The list of hot keys is broadcast: its length has
    the bound ``hot_keys`` whatever the data. Null keys aren't split (they join nothing)."""
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    hot = (sizes.filter(F.col("_rows") * hot_keys > total)
           .select(F.col(key).alias("_hot"), F.ceil(F.col("_rows") * hot_keys / max(total, 1)).cast("int").alias("_salts")))
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = (rows.join(hot, F.col(key) == F.col("_hot"), "left")
             .withColumn(SALT, F.pmod(F.xxhash64(by), salts).cast("int")).drop("_hot", "_salts"))
    repeated = (other.join(hot, F.col(key) == F.col("_hot"), "left")
                .withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts"))
    return dealt, repeated
