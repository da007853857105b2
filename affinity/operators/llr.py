"""Interaction caps, co-occurrence counts and log-likelihood-ratio similarity.

Plan shape (user mode): scan -> [cap: two partial/final count aggregates joined
back] -> pre-aggregate duplicate (user, item) rows -> attach per-user totals ->
members of an item as lists -> each user's lists in one task, as bytes (``half_pairs``) ->
sum per (a, b) -> native LLR expression ->
threshold. Counts of keys are never collected: they are joined (AQE turns the join into
a broadcast only when the measured count table is under the adaptive broadcast
threshold) and the distinct-item total N is a scalar subquery. Three sums (rows, users,
pairs) set the number of tasks.

Scale notes: the operator makes every (a, b) pair that shares an item;
that pair set *is* the operator's output domain. Lists of members are shuffled, the pairs
themselves are not. Nothing is dropped unless a cap
is asked for (``max_interactions``). The members of an item with more than
``BLOCK_ROWS`` of them are dealt into blocks, and each pair of blocks is a join
key of its own, so a hot item is spread over many tasks. Duplicate rows are
folded into a count before the join so repeated interactions do not multiply the
join input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.draws import uniform
from ..session import cut_lineage, let_go, ship_package
from . import packed_pairs, pair_tiles

#: Members of an item that meet as one join key.
BLOCK_ROWS = 1000
#: Pairs that a task makes and sums up, about.
PAIRS_A_TASK = 1_000_000
#: Tiles are used where they shuffle a so-manieth of the rows of the other ways at most.
TILE_GAIN = 8
#: A user with more than a so-manieth of all rows is hot; there can't be more hot users than that.
HOT_USERS = 1000
VARIANTS = ("default", "max", "continuous")
MODES = ("user", "item")


def orient(interactions: DataFrame, mode: str = "user", user: str = "user",
           item: str = "item") -> DataFrame:
    """``mode='item'`` swaps the two columns (item-item similarity)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    a, b = (user, item) if mode == "user" else (item, user)
    return interactions.select(F.col(a).alias("user"), F.col(b).alias("item"))


def interaction_counts(interactions: DataFrame, key: str) -> DataFrame:
    """A1: interactions per key (duplicates count), partial + final aggregate."""
    return interactions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def cap_interactions(interactions: DataFrame, max_interactions: int,
                     user: str = "user", item: str = "item") -> DataFrame:
    """drop every interaction of a user or item with more than
    ``max_interactions`` interactions (the deterministic reading of the
    integer-rate down-sampler)."""
    per_user = interaction_counts(interactions, user).filter(F.col("n") <= max_interactions)
    per_item = interaction_counts(interactions, item).filter(F.col("n") <= max_interactions)
    return (interactions.join(per_user.select(user), user, "left_semi")
            .join(per_item.select(item), item, "left_semi"))


def downsample(interactions: DataFrame, max_interactions: int, mode: str = "cap",
               seed: int = 12345, user: str = "user", item: str = "item") -> DataFrame:
    """F3/F4. ``mode='cap'`` = hard cap (reference behaviour). ``mode='sample'``
    keeps each interaction with probability min(rate_user, rate_item), where
    rate = min(max, n) / n, using a draw keyed by (seed, user, item, copy) so
    the result does not depend on partitioning."""
    if mode == "cap":
        return cap_interactions(interactions, max_interactions, user, item)
    if mode != "sample":
        raise ValueError("mode must be 'cap' or 'sample'")
    nu = interaction_counts(interactions, user).withColumnRenamed("n", "_nu")
    ni = interaction_counts(interactions, item).withColumnRenamed("n", "_ni")
    folded = interactions.groupBy(user, item).agg(F.count(F.lit(1)).alias("_cnt"))
    rate = F.least(F.least(F.lit(max_interactions), F.col("_nu")) / F.col("_nu"),
                   F.least(F.lit(max_interactions), F.col("_ni")) / F.col("_ni"))
    kept = F.aggregate(
        F.sequence(F.lit(0), F.col("_cnt") - 1), F.lit(0),
        lambda acc, j: acc + F.when(
            uniform(F.lit(seed), F.col(user), F.col(item), j) <= F.col("_rate"), 1).otherwise(0))
    return (folded.join(nu, user).join(ni, item)
            .withColumn("_rate", rate)
            .withColumn("_kept", kept)
            .filter(F.col("_kept") > 0)
            .select(user, item, F.explode(F.sequence(F.lit(1), F.col("_kept"))).alias("_copy"))
            .select(user, item))


def weighted_interactions(interactions: DataFrame) -> DataFrame:
    """Fold repeated (user, item) rows into a multiplicity ``cnt`` (map-side combine)."""
    return interactions.groupBy("user", "item").agg(F.count(F.lit(1)).alias("cnt"))


def item_blocks(members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of items with ``_blocks`` (blocks of the item) and ``_block`` (the
    member's own); items up to ``block_rows`` members are one block."""
    heavy = (members.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
             .select("item", F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")))
    out = members.join(heavy, "item", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    return out.withColumn("_block", F.pmod(F.xxhash64("user"), F.col("_blocks")).cast("int"))


def block_sides(blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self-join, keyed by (item, _i, _j): each member stands in
    its own block on one side and with all blocks of its item on the other."""
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = blocked.withColumn("_i", F.col("_block")).withColumn("_j", F.explode(every))
    right = blocked.withColumn("_j", F.col("_block")).withColumn("_i", F.explode(every))
    return left.drop("_block", "_blocks"), right.drop("_block", "_blocks")


WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


def _packable(members: DataFrame, values: list[str], product: str | None) -> bool:
    """Whether pairs can go as bytes: users are whole numbers, and what is summed is the product of the
    first value, a number, of which ``n`` is the only other one."""
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    return (product is not None and kinds["user"] in WHOLE_TYPES and values[1:] in ([], ["n"])
            and kinds[values[0]] in (*WHOLE_TYPES, "float", "double") and kinds.get("n", "bigint") in WHOLE_TYPES)


def _packed_pairs(met: DataFrame, values: list[str], kinds: dict, hot: dict[int, int], tasks: int, product: str) -> DataFrame:
    """``half_pairs`` of users that aren't null, from their items' members ``met``."""
    ship_package(met.sparkSession)
    kind = "double" if kinds[values[0]] in ("float", "double") else "bigint"
    typed = {"user": "bigint", values[0]: kind, "n": "bigint"}
    sides = [("m", "m")] + [("o", "others")] * ("others" in met.columns)
    flat = met.select(*[F.col(f"{c}.{v}").cast(f"array<{typed[v]}>").alias(f"{s}_{v}") for s, c in sides for v in ("user", *values)])
    own = ", ".join(f"{v}_a {typed[v]}" for v in values)
    rows = flat.mapInArrow(packed_pairs._packed(values, hot), f"a bigint, _salt int, {own}, first bigint, form int, list binary")
    totals = "n_a bigint, n_b bigint, " if "n" in values else ""
    out = (rows.repartition(tasks, "a", "_salt").sortWithinPartitions("a", "_salt")
           .mapInArrow(packed_pairs._summed(values, kind == "double", product), f"a bigint, b bigint, {totals}{product} {kind}"))
    return out.withColumns({c: F.col(c).cast(kinds["user"]) for c in "ab"}) if kinds["user"] != "bigint" else out


def _met(blocked: DataFrame, values: list[str]) -> DataFrame:
    """(m, others): the members of a block and those of a block of the same item, for every pair
    of blocks. Items of a single block meet themselves without a join."""
    lists = (blocked.filter(F.col("item").isNotNull()).groupBy("item", "_blocks", "_block")
             .agg(F.collect_list(F.struct("user", *values)).alias("m")))
    alone = lists.filter("_blocks = 1").select("m", F.col("m").alias("others"))
    first, second = block_sides(lists.filter("_blocks > 1"))
    return alone.unionByName(first.join(second.withColumnRenamed("m", "others"), ["item", "_i", "_j"]).select("m", "others"))


def half_pairs(members: DataFrame, values: list[str], total: Column, block_rows: int = BLOCK_ROWS,
               counts: bool = False, product: str | None = None) -> DataFrame:
    """(a, b, each value with _a and _b, total) of every pair of users that share an item, once (a <= b,
    null first): ``members`` (user, item, values) of an item meet, and ``total``, an aggregate
    of value_a and value_b columns, is taken over what a pair shares; other values must be the
    user's own (they are grouped by) and are named in ``members`` as ``n``.

    What is shuffled is for each member the list of those that come after it, to tasks
    by user (hot users by parts of the lists); the pairs are only made there, about ``PAIRS_A_TASK``
    in a task however large the table. With ``product``, which says that ``total`` has that name and is the sum
    of the products of the first value, the lists go as bytes (``packed_pairs``) where users are whole numbers. Where few users share very much, pairs are made and
    summed up before the shuffle instead. With ``counts``, which says that ``total`` is k11, the sum of
    cnt_a * cnt_b, and where very many users share much, blocks of users meet in tiles (``pair_tiles``)."""
    sizes = members.filter("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = sizes.agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n + 1) / 2")).alias("pairs"), F.max("n").alias("most")).first()
    users = members.agg(F.approx_count_distinct("user")).first()[0]
    pairs, rows, spark = found["pairs"] or 0, found["rows"] or 0, members.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = users * (users + 1) / 2 * shuffles
    if counts and users:
        width = pair_tiles.block_users(users, int(rows), spark.sparkContext.defaultParallelism)
        if rows * math.ceil(users / width) * TILE_GAIN <= min(pairs, summed):
            tiled = pair_tiles.tiled_pairs(members, width, "n" in values)
            if tiled is not None:
                return tiled
    if summed > pairs and _packable(members, values, product):
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))
        return _half_packed(members, values, total, block_rows, product, rows, found["most"] or 0, tasks)
    met = _met(item_blocks(members, block_rows), values)
    a = met.select(F.explode("m").alias("x"), "others").select(
        F.col("x.user").alias("a"), *[F.col(f"x.{v}").alias(f"{v}_a") for v in values], "others")
    after = F.when(F.col("a").isNull(), F.col("others")).otherwise(F.filter("others", lambda o: o["user"] >= F.col("a")))
    keys = ["a"]
    if summed <= pairs:
        lists = a.withColumn("others", after)
    else:
        hot = F.broadcast(members.groupBy(F.col("user").alias("_hot")).agg(F.count(F.lit(1)).alias("_rows"))
                          .filter(F.col("_rows") * HOT_USERS > rows)
                          .select("_hot", F.ceil(F.col("_rows") * HOT_USERS / max(rows, 1)).cast("int").alias("_salts")))
        dealt = (a.join(hot, F.col("a").eqNullSafe(F.col("_hot")), "left")
                 .withColumn("_salts", F.coalesce("_salts", F.lit(1)))
                 .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))))
        dealt = dealt.withColumn("others", F.when(F.col("_salts") == 1, F.col("others")).otherwise(
            F.filter("others", lambda o: F.pmod(F.xxhash64(o["user"]), F.col("_salts")) == F.col("_salt"))))
        lists = dealt.withColumn("others", after)
        keys.append("_salt")
    lists = lists.select(*keys, *[f"{v}_a" for v in values], F.col("others.user").alias("b"),
                         *[F.col(f"others.{v}").alias(f"{v}_b") for v in values])
    if len(keys) > 1:
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))
        lists = lists.repartition(tasks, *keys)
    pair = lists.select(*keys, *[f"{v}_a" for v in values], F.explode(F.arrays_zip("b", *[f"{v}_b" for v in values])).alias("o"))
    pair = pair.select(*keys, *[f"{v}_a" for v in values], "o.*")
    totals = ["n_a", "n_b"] if "n" in values else []
    return pair.groupBy(*keys, "b", *totals).agg(total).drop("_salt")


def _half_packed(members: DataFrame, values: list[str], total: Column, block_rows: int, product: str,
                 rows: float, most: float, tasks: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    # null measures add nothing to a sum but make it null where there is no other: such pairs, and those of null users, are made by Spark
    odd = F.col("user").isNull()
    for v in values:
        odd = odd | F.col(v).isNull()
    kept, strange = members.filter("item IS NOT NULL").filter(~odd), members.filter("item IS NOT NULL").filter(odd)
    strangers = strange.agg(F.count(F.lit(1)).alias("n"), F.count("user").alias("named")).first()
    if strangers["named"]:
        return half_pairs(members, values, total, block_rows)
    hot = {r["user"]: r["salts"] for r in kept.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_USERS > rows).select(
        "user", F.ceil(F.col("n") * HOT_USERS / max(rows, 1)).cast("int").alias("salts")).collect()}  # fewer than HOT_USERS
    let_go(members.sparkSession)  # what ``members`` were made from
    if most > block_rows:
        met = _met(item_blocks(kept, block_rows), values)
    else:
        met = kept.groupBy("item").agg(F.collect_list(F.struct("user", *values)).alias("m")).select("m")
    pairs = _packed_pairs(met, values, kinds, hot, tasks, product)
    if not strangers["n"]:
        return pairs
    sides = [members.filter("item IS NOT NULL").select("item", F.col("user").alias(u), *[F.col(v).alias(f"{v}_{u}") for v in values]) for u in "ab"]
    totals = ["n_a", "n_b"] if "n" in values else []
    nulls = sides[0].filter("a IS NULL").join(sides[1], "item").groupBy("a", "b", *totals).agg(total)
    return pairs.unionByName(nulls)


def mirror_pairs(half: DataFrame, *value_cols: str) -> DataFrame:
    """Both orientations of pairs listed once; a user with itself stays one row."""
    there = F.struct("a", "b")
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(there)).otherwise(F.array(there, back))
    return half.select(F.explode(both).alias("_p"), *value_cols).select("_p.a", "_p.b", *value_cols)


def cooccurrence(weighted: DataFrame, with_totals: bool = False, half: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k11(a, b) = sum over shared items of cnt_a * cnt_b (both
    directions and self pairs). With ``with_totals`` the per-user totals n of both
    ride along (n_a, n_b) so no later join on the pair table is needed.
    With ``half`` one orientation per unordered pair (a <= b, no null); the caller mirrors."""
    if half:
        weighted = weighted.filter("user IS NOT NULL")
    values = ["cnt", "n"] if with_totals else ["cnt"]
    pairs = half_pairs(weighted.select("user", "item", *values), values, F.sum(F.col("cnt_a") * F.col("cnt_b")).alias("k11"), block_rows, counts=True,
                       product="k11")
    if half:
        return pairs
    if not with_totals:
        return mirror_pairs(pairs, "k11")
    swapped = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))
    both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(F.struct("a", "b", "n_a", "n_b"))).otherwise(
        F.array(F.struct("a", "b", "n_a", "n_b"), swapped))
    return pairs.select(F.explode(both).alias("_p"), "k11").select("_p.*", "k11")


def llr_half_cells(interactions: DataFrame, max_interactions: int | None = None,
                   cap_mode: str = "cap", seed: int = 12345, dedupe: bool = False,
                   include_self: bool = True) -> DataFrame:
    """(a, b, k11, k12, k21, k22) for each unordered pair once (a <= b)."""
    ints = interactions.select("user", "item")
    if dedupe:
        ints = ints.distinct()
    if max_interactions is not None:
        ints = downsample(ints, max_interactions, cap_mode, seed)
    weighted = weighted_interactions(ints)
    totals = weighted.groupBy("user").agg(F.sum("cnt").alias("n"))
    # The folded table feeds both join sides, the totals and N: materialise it
    # once (reliable checkpoint) instead of re-running scan/cap/fold per branch.
    folded = cut_lineage(weighted.join(totals, "user"))
    n_items = folded.select(F.count_distinct("item")).scalar()
    pairs = cooccurrence(folded, with_totals=True, half=True)
    if not include_self:
        pairs = pairs.filter(F.col("a") != F.col("b"))
    k12, k21, k22 = S.contingency("k11", "n_a", "n_b", n_items)
    cells = pairs.select("a", "b", "k11", k12.alias("k12"), k21.alias("k21"), k22.alias("k22"))
    return cells


def mirror(cells: DataFrame, *value_cols: str) -> DataFrame:
    """Both orientations of half-pair rows (a <= b): (b, a) swaps k12 and k21;
    the scores are symmetric in that swap and are copied."""
    fwd = F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("k12").alias("p"), F.col("k21").alias("r"))
    rev = F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.col("k21").alias("p"), F.col("k12").alias("r"))
    both = F.when(F.col("a") == F.col("b"), F.array(fwd)).otherwise(F.array(fwd, rev))
    out = cells.select(F.explode(both).alias("_o"), "k11", "k22", *value_cols)
    return out.select(F.col("_o.x").alias("a"), F.col("_o.y").alias("b"), "k11",
                      F.col("_o.p").alias("k12"), F.col("_o.r").alias("k21"), "k22", *value_cols)


def llr_cells(interactions: DataFrame, max_interactions: int | None = None,
              cap_mode: str = "cap", seed: int = 12345, dedupe: bool = False,
              include_self: bool = True) -> DataFrame:
    """(a, b, k11, k12, k21, k22) in both directions, self pairs included."""
    return mirror(llr_half_cells(interactions, max_interactions, cap_mode, seed, dedupe, include_self))


def score_cells(cells: DataFrame) -> DataFrame:
    """X1-X6 over (k11, k12, k21, k22): llr, default, max and continuous.

    The nine distinct x*ln(x) terms are computed once per row and the
    entropies are assembled from them (row = xlogx(N) - xlogx(k11+k12) -
    xlogx(k21+k22), and so on), so each row evaluates ln nine times.
    A negative cell (possible when interactions repeat) has no defined
    entropy; all scores are NULL for it so no threshold keeps the row."""
    k11, k12, k21, k22 = (F.col(c) for c in ("k11", "k12", "k21", "k22"))
    x = S.xlogx
    terms = cells.select(
        "*",
        x(k11 + k12 + k21 + k22).alias("_xn"),
        x(k11 + k12).alias("_xr1"), x(k21 + k22).alias("_xr2"),
        x(k11 + k21).alias("_xc1"), x(k12 + k22).alias("_xc2"),
        x(k11).alias("_x11"), x(k12).alias("_x12"), x(k21).alias("_x21"), x(k22).alias("_x22"))
    ent = terms.select(
        *cells.columns,
        (F.col("_xn") - F.col("_xr1") - F.col("_xr2")).alias("_rh"),
        (F.col("_xn") - F.col("_xc1") - F.col("_xc2")).alias("_ch"),
        (F.col("_xn") - (F.col("_x11") + F.col("_x12") + F.col("_x21") + F.col("_x22"))).alias("_mh"),
        ((k12 < 0) | (k21 < 0) | (k22 < 0)).alias("_bad"))
    r, c, m = F.col("_rh"), F.col("_ch"), F.col("_mh")
    llr = (F.when(F.col("_bad"), F.lit(None).cast("double"))
           .when(r + c < m, F.lit(0.0)).otherwise(F.lit(2.0) * (r + c - m)))
    scored = ent.select(*cells.columns, "_rh", "_ch", llr.alias("llr"))
    scored = scored.select(*cells.columns, "_rh", "_ch", "llr", S.llr_similarity("llr").alias("sim_default"))
    return scored.select(*cells.columns, "llr", "sim_default",
                         S.max_variant("sim_default", "_rh", "_ch").alias("sim_max"),
                         S.continuous_variant("sim_default").alias("sim_continuous"))


def llr_similarity(interactions: DataFrame, variant: str = "default", mode: str = "user",
                   threshold: float = 0.6, max_interactions: int | None = None,
                   include_self: bool = True, dedupe: bool = False, cap_mode: str = "cap",
                   seed: int = 12345, user: str = "user", item: str = "item",
                   digits: int | None = 9, half: bool = False) -> DataFrame:
    """(a, b, similarity) for one output variant.

    ``default`` keeps similarity > threshold (strict); ``max`` and
    ``continuous`` are unfiltered. Similarities are rounded to ``digits``
    decimals so (a, b) and (b, a) agree exactly. With ``half`` each unordered pair
    is there once (a <= b)."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}, got {variant!r}")
    cells = llr_half_cells(orient(interactions, mode, user, item), max_interactions, cap_mode,
                           seed, dedupe, include_self)
    if variant == "default":
        # filter the raw cells (small predicate) before scoring the survivors
        cells = cells.filter(S.llr_exceeds("k11", "k12", "k21", "k22", threshold))
    scored = score_cells(cells)
    sim = F.col(f"sim_{variant}")
    if digits is not None:
        sim = F.round(sim, digits)
    once = scored.select("a", "b", sim.alias("similarity"))
    return once if half else mirror_pairs(once, "similarity")
