"""Deterministic random draws and weighted picks as Column expressions.

Every draw is a pure function of its coordinates (seed, walk, start, step),
so a recomputed partition after executor loss draws exactly the same values,
independent of partitioning or task order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a draw is the first 32 bits of md5 over the '-'-joined
# coordinates, centred in its bucket: u = (h + 0.5) / 2^32, u in (0, 1).
TWO_POW_32 = 4294967296.0


def uniform(*parts) -> Column:
    """u in (0, 1) from md5 of the '-'-joined coordinates."""
    key = F.concat_ws("-", *[F.col(p) if isinstance(p, str) else p for p in parts])
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO_POW_32)


def weighted_pick(cum: Column, total: Column, u: Column) -> Column:
    """Inverse-CDF pick: the first entry whose running sum reaches u * total."""
    target = u * total
    hit = F.filter(cum, lambda e: e["hi"] >= target)
    return F.coalesce(F.element_at(hit, 1)["nxt"], F.element_at(cum, -1)["nxt"])


def running_sums(entries: Column, value: str) -> Column:
    """The entries (nxt, ...) as (nxt, value, hi): running sums in their order."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))

    def add(state, e):
        hi = state["sum"] + e[value]
        return F.struct(hi.alias("sum"), F.concat(state["sums"], F.array(hi)).alias("sums"))

    sums = F.aggregate(entries, start, add, lambda state: state["sums"])
    return F.zip_with(entries, sums, lambda e, hi: F.struct(
        e["nxt"].alias("nxt"), e[value].alias(value), hi.alias("hi")))
