"""Locality-sensitive hashing: signatures, collision keys, neighbour search.

Hash functions are drawn from a seeded NumPy generator (tables x signature x dim
numbers, bounded by the parameters, never by the data). Signatures of dense vectors are
one matrix product for an Arrow batch, whose task draws the planes again; those of
sets are native expressions.

Candidate search never emits one Spark row per colliding pair. Each bucket
(table[, band], key) is split into sub-blocks of at most ``block_rows``
members; every (bucket, query sub-block, point sub-block) tile is one
co-group that computes its distances with NumPy and emits only its top-k per
member. A bucket that holds a third of all points is therefore spread over
many bounded tasks instead of one task enumerating all of its pairs, and no
candidate is dropped: the exact top-k over all colliding points is the top-k
of the union of the tile top-k's.

Average selectivity counts distinct colliding ordered pairs exactly: by
inclusion-exclusion over a few hash units, or in tiles at the first unit in which a
pair agrees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_code, ship_package
from . import set_lists, steps
from .knn import DENSE_MEASURES, arrow_tile, rank_neighbors
from .numbering import number_rows

LSH_MEASURES = ("hamming", "cosine", "euclidean", "manhattan", "jaccard")
#: Up to so many units selectivity goes by combined keys (2^units - 1 rows for a point).
COMBINED_UNITS = 6
#: Members of a bucket that meet as a block, where ``block_rows`` isn't given: sets, codes; bytes of dense vectors.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Pairs of a tile that selectivity looks at at once.
PAIRS_AT_ONCE = 1 << 20


def _dlit(x: float) -> Column:
    return F.lit(float(x))


def draw(measure: str, seed: int, tables: int, signature: int, dim: int, bucket_width: float) -> dict:
    """The hash functions of a family, the same for equal arguments."""
    rng = np.random.default_rng(seed)
    shape = (tables, signature)
    if measure in ("cosine", "euclidean"):
        out = {"planes": rng.standard_normal((*shape, dim))}
    elif measure == "manhattan":
        out = {"planes": rng.standard_cauchy((*shape, dim))}
    else:
        out = {"planes": None}
    if measure in ("euclidean", "manhattan"):
        out["offsets"] = rng.random(shape) * bucket_width
    if measure == "hamming":
        # sampled dimension j = floor(u_j * dim), u_j uniform in [0, 1)
        out["sample_u"] = rng.random(shape)
    if measure == "jaccard":
        a = rng.integers(-2**31, 2**31, size=shape, dtype=np.int64)
        a[a == 0] = 1
        out["a"] = a
        out["b"] = rng.integers(-2**31, 2**31, size=shape, dtype=np.int64)
    return out


@dataclass
class LSH:
    """H1/H2: an LSH family for one distance measure.

    ``tables`` independent hash functions of ``signature`` components each;
    ``bucket_width`` for euclidean/manhattan; ``prime`` and ``bands`` for
    jaccard (MinHash with banding). ``seed`` is always explicit."""

    measure: str
    dim: int | Column
    tables: int = 1
    signature: int = 16
    bucket_width: float = 0.0
    prime: int = 0
    bands: int = 0
    seed: int = 0
    block_rows: int | None = None
    params: dict = field(init=False, repr=False)

    def __post_init__(self):
        m = self.measure.lower()
        if m not in LSH_MEASURES:
            raise ValueError(f"measure={self.measure!r} is not one of {LSH_MEASURES}")
        self.measure = m
        if isinstance(self.dim, Column):
            if m not in ("hamming", "jaccard"):
                raise ValueError("a column-valued dim is only supported for set measures")
        elif self.dim <= 0:
            raise ValueError("dim must be positive")
        if self.tables <= 0 or self.signature <= 0:
            raise ValueError("tables and signature must be positive")
        if m in ("euclidean", "manhattan") and not self.bucket_width > 0:
            raise ValueError(f"bucket_width={self.bucket_width}: {m} projections need a positive width")
        if m == "jaccard":
            if not self.prime > 0:
                raise ValueError(f"prime={self.prime}: MinHash needs a positive modulus")
            if not self.bands > 0:
                raise ValueError(f"bands={self.bands}: MinHash needs at least one band")
            if self.signature % self.bands != 0:
                raise ValueError(f"bands={self.bands} leaves a remainder of signature={self.signature}")
        self.params = self._draw()

    # ------------------------------------------------------------ parameters
    def _draw(self) -> dict:
        dim = self.dim if isinstance(self.dim, int) else 0
        return draw(self.measure, self.seed, self.tables, self.signature, dim, self.bucket_width)

    @property
    def units(self) -> int:
        """Independent collision units: tables (x bands for jaccard)."""
        return self.tables * (self.bands if self.measure == "jaccard" else 1)

    # ------------------------------------------------------------ signatures
    def _projected(self, points: DataFrame) -> DataFrame:
        """H3-H6: (id, vec, tbl, sig) by one matrix product for a batch of vectors; tasks draw the
        planes from the seed again, so that none are in the plan. Shorter vectors count as
        padded by zeros, entries beyond ``dim`` don't count; null is a zero vector."""
        ship_package(points.sparkSession)
        measure, seed, tables, size, dim, width = self.measure, self.seed, self.tables, self.signature, self.dim, self.bucket_width

        def run(batches):
            drawn = draw(measure, seed, tables, size, dim, width)
            planes = drawn["planes"].reshape(-1, dim).T
            for batch in batches:
                offsets, flat = steps.flat(batch.column(1))
                n = len(offsets) - 1
                row = np.repeat(np.arange(n), np.diff(offsets))
                place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
                vec = np.zeros((n, dim))
                vec[row[place < dim], place[place < dim]] = np.nan_to_num(np.asarray(flat, np.float64)[place < dim])
                projected = (vec @ planes).reshape(n * tables, size)
                if measure == "cosine":
                    on = projected > 0
                    counts, values = on.sum(axis=1), np.nonzero(on)[1].astype(np.int32)
                else:
                    moved = projected + np.tile(drawn["offsets"], (n, 1)).reshape(n * tables, size)
                    counts, values = np.full(n * tables, size), np.floor(moved / width).astype(np.int32).ravel()
                sig = steps.lists(np.concatenate([[0], np.cumsum(counts)]), values)
                again = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again),
                                                  pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), sig], ["id", "vec", "tbl", "sig"])

        return points.select("id", "vec").mapInArrow(run, "id long, vec array<double>, tbl int, sig array<int>")

    def _table_signature(self, t: int, vec: Column, dimc: Column | None = None) -> Column:
        """H7/H8 of set vectors, as a native expression."""
        p, s = self.params, self.signature
        if dimc is None:
            dimc = F.lit(int(self.dim))
        if self.measure == "hamming":
            us = F.array(*[_dlit(x) for x in p["sample_u"][t]])
            sampled = F.transform(us, lambda u: F.floor(u * dimc).cast("int"))
            return F.array_sort(F.array_intersect(vec, sampled))
        # jaccard: minhash over active indices
        def permute(a: int, b: int):
            prime = F.lit(self.prime).cast("long")
            return lambda x: (F.pmod(F.lit(a).cast("long") * x.cast("long") + F.lit(b).cast("long"),
                                     prime) % dimc).cast("int")

        comps = [F.array_min(F.transform(vec, permute(int(p["a"][t][j]), int(p["b"][t][j]))))
                 for j in range(s)]
        return F.array(*comps)

    def signatures(self, points: DataFrame) -> DataFrame:
        """H3-H8: one row per (point, table): (id, vec, tbl, sig ARRAY<INT>).
        Empty sets have no MinHash and get no entries."""
        if self.measure in DENSE_MEASURES:
            return self._projected(points)
        pts = points
        if self.measure == "jaccard":
            pts = pts.filter(F.size("vec") > 0)
        dimc = None
        if isinstance(self.dim, Column):
            # subqueries may not appear inside lambdas: bind the scalar to a column first
            pts = pts.withColumn("_dim", self.dim)
            dimc = F.col("_dim")
        sigs = F.array(*[self._table_signature(t, F.col("vec"), dimc) for t in range(self.tables)])
        return pts.select("id", "vec", F.posexplode(sigs).alias("tbl", "sig"))

    def bucket_keys(self, sigs: DataFrame) -> DataFrame:
        """(id, tbl, band, key). Simple strategy: band 0, key = whole
        signature. Banding: the signature cut into ``bands`` equal slices."""
        if self.measure != "jaccard":
            return sigs.select("id", "vec", "tbl", F.lit(0).alias("band"), F.col("sig").alias("key"))
        width = self.signature // self.bands
        bands = F.array(*[F.slice("sig", b * width + 1, width) for b in range(self.bands)])
        return sigs.select("id", "vec", "tbl", F.posexplode(bands).alias("band", "key"))

    def entries(self, points: DataFrame) -> DataFrame:
        return self.bucket_keys(self.signatures(points))

    # ------------------------------------------------------------ search
    def _tiles(self, qent: DataFrame, pent: DataFrame, k: int,
               exclude_self: bool, digits: int | None) -> DataFrame:
        ship_code()
        bucket = ["tbl", "band", "key"]
        block = self.block_rows or (max(BLOCK_ROWS, BLOCK_BYTES // (8 * self.dim)) if self.measure in DENSE_MEASURES else BLOCK_ROWS)
        cols = ["id", "vec"] + bucket
        qent = qent.select(*[F.col(c).alias(c) for c in cols])
        pent = pent.select(*[F.col(c).alias(c) for c in cols])
        qn = qent.groupBy(*bucket).agg(F.count(F.lit(1)).alias("nq"))
        pn = pent.groupBy(*bucket).agg(F.count(F.lit(1)).alias("np"))
        if self.measure not in DENSE_MEASURES:
            found = qn.join(pn, bucket).agg(F.sum(F.col("nq").cast("double") * F.col("np")).alias("cells"),
                                            F.max(F.greatest("nq", "np")).alias("largest")).first()
            # buckets of more than a tile: sets that share few elements meet by lists of members
            if (found["largest"] or 0) > block and all(map(set_lists.unique_ids, self._units(qent, pent))):
                pairs = set_lists.common_pairs(qent, pent, bucket)
                if found["cells"] > set_lists.CELLS_A_PAIR * pairs:
                    cand = set_lists.set_candidates(qent, pent, k, self.measure, bucket, pairs, exclude_self, digits)
                    return cand.groupBy("id", "nbr").agg(F.min("dist").alias("dist"))
        sizes = (qn.join(pn, bucket)
                 .withColumn("bq", F.ceil(F.col("nq") / block).cast("long"))
                 .withColumn("bp", F.ceil(F.col("np") / block).cast("long"))
                 .select(*bucket, "bq", "bp"))
        if exclude_self:
            sizes = sizes.join(qn.filter(F.col("nq") > 1).select(*bucket), bucket, "left_semi")
        q = (qent.join(sizes, bucket)
             .withColumn("sq", F.pmod(F.xxhash64("id"), F.col("bq")))
             .withColumn("sp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bp") - 1)))
             .select(*bucket, "sq", "sp", "id", "vec"))
        p = (pent.join(sizes, bucket)
             .withColumn("sp", F.pmod(F.xxhash64("id"), F.col("bp")))
             .withColumn("sq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bq") - 1)))
             .select(*bucket, "sq", "sp", "id", "vec"))
        measure = self.measure

        def tile(qtable: pa.Table, ptable: pa.Table) -> pa.Table:
            return arrow_tile(qtable, ptable, k, measure, "nearest", digits, exclude_self)

        keys = bucket + ["sq", "sp"]
        cand = (q.groupBy(*keys).cogroup(p.groupBy(*keys))
                .applyInArrow(tile, schema="id long, nbr long, dist double"))
        if digits is not None:
            cand = cand.withColumn("dist", F.round("dist", digits))
        # A pair colliding in several tables/bands counts once.
        return cand.groupBy("id", "nbr").agg(F.min("dist").alias("dist"))

    @staticmethod
    def _units(*entries: DataFrame) -> list[DataFrame]:
        """The ids of a hash unit: every point has an entry in each."""
        return [e.filter("tbl = 0 AND band = 0") for e in {id(e): e for e in entries}.values()]

    def neighbors(self, points: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
        """(id, nbr, dist, rnk), the k nearest colliding points of every point."""
        pts = self._vectors(points)
        # entries (points x hash units) feed the bucket sizes and both tile sides
        ent = cut_lineage(self.entries(pts))
        cand = self._tiles(ent, ent, k, exclude_self=True, digits=digits)
        return rank_neighbors(cand, k, "nearest")

    def query(self, points: DataFrame, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
        """Nearest model points for new query points (same id may match itself)."""
        pts, qry = self._vectors(points), self._vectors(queries)
        cand = self._tiles(cut_lineage(self.entries(qry)), cut_lineage(self.entries(pts)), k,
                           exclude_self=False, digits=digits)
        return rank_neighbors(cand, k, "nearest")

    def candidate_pairs(self, points: DataFrame) -> DataFrame:
        """Distinct colliding pairs (id1 < id2) with their distance — the plain
        bucket self-join, for small inputs and tests (it emits every pair)."""
        pts = self._vectors(points)
        ent = self.entries(pts)
        a = ent.select(F.col("id").alias("id1"), "tbl", "band", "key")
        b = ent.select(F.col("id").alias("id2"), "tbl", "band", "key")
        pairs = a.join(b, ["tbl", "band", "key"]).filter(F.col("id1") < F.col("id2")) \
            .select("id1", "id2").distinct()
        va = pts.select(F.col("id").alias("id1"), F.col("vec").alias("v1"))
        vb = pts.select(F.col("id").alias("id2"), F.col("vec").alias("v2"))
        from ..functions.vectors import distance
        return pairs.join(va, "id1").join(vb, "id2").select(
            "id1", "id2", distance("v1", "v2", self.measure).alias("dist"))

    def avg_selectivity(self, points: DataFrame) -> DataFrame:
        """(distinct colliding ordered pairs incl. self) / n^2, exact for any number of units.

        A few units: inclusion-exclusion (sums of squared group sizes of every combined key).
        More: pairs are counted in tiles of the buckets, each in the first unit in which
        its keys agree. A point without a key (an empty set) is in no pair."""
        pts = self._vectors(points)
        ent = self.entries(pts).withColumn("unit", F.col("tbl") * F.lit(max(1, self.bands)) + F.col("band"))
        pairs = self._combined_keys(ent) if self.units <= COMBINED_UNITS else self._first_collisions(ent)
        n = pts.select(F.count(F.lit(1))).scalar()
        return pairs.select(F.lit("avg_selectivity").alias("metric"), (F.col("pairs") / n / n).alias("value"))

    def _combined_keys(self, ent: DataFrame) -> DataFrame:
        per_point = ent.groupBy("id").agg(
            F.array_sort(F.collect_list(F.struct("unit", "key"))).alias("keys"))
        masks = F.array(*[F.lit(m) for m in range(1, 2 ** self.units)])
        combos = (per_point.select("id", "keys", F.explode(masks).alias("mask"))
                  .select("mask", F.transform(
                      F.filter("keys", lambda e: F.floor(F.col("mask") / F.pow(F.lit(2.0), e["unit"])) % 2 == 1),
                      lambda e: e["key"]).alias("combo")))
        groups = combos.groupBy("mask", "combo").agg(F.count(F.lit(1)).alias("c"))
        sign = F.when(F.bit_count("mask") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
        return groups.agg(F.coalesce(F.sum(sign * F.col("c") * F.col("c")), F.lit(0).cast("long")).alias("pairs"))

    def _first_collisions(self, ent: DataFrame) -> DataFrame:
        ship_package(ent.sparkSession)
        codes = number_rows(ent.select("unit", "key").distinct(), "unit", "key", name="code")
        points = cut_lineage(ent.select("id", "unit", "key").join(codes, ["unit", "key"]).groupBy("id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("unit", "code"))), lambda e: e["code"]).alias("codes")))
        placed = points.select("id", "codes", F.posexplode("codes").alias("unit", "code"))
        sizes = placed.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        block = self.block_rows or BLOCK_ROWS
        # small buckets share groups; a large one is cut into blocks and gets a group for each pair of blocks
        groups = max(1, -(-placed.count() // (4 * block)))
        met = placed.join(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "code")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        met = met.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = F.when(F.col("blocks") > 1, F.col("code") + groups).otherwise(F.pmod("code", F.lit(groups)))
        met = met.select(group.alias("group"), F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"),
                         F.col("s").alias("own"), "unit", "code", "codes")
        units = self.units

        def count(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            code, unit, own = (np.asarray(table[c]) for c in ("code", "unit", "own"))
            every = np.asarray(pa.concat_arrays(table["codes"].chunks).flatten()).reshape(-1, units)
            order = np.argsort(code, kind="stable")
            code, unit, own, every = code[order], unit[order], own[order], every[order]
            across = table["lo"][0].as_py() != table["hi"][0].as_py()
            left = np.flatnonzero(own == table["lo"][0].as_py())
            right = np.flatnonzero(own == table["hi"][0].as_py())
            first = np.searchsorted(code[right], code[left], "left")
            many = np.searchsorted(code[right], code[left], "right") - first
            ends, i, total = np.cumsum(many), 0, 0
            while i < len(left):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
                m = many[i:j]
                a = np.repeat(left[i:j], m)
                b = right[np.arange(len(a)) + np.repeat(first[i:j] - (np.cumsum(m) - m), m)]
                new = a != b
                for earlier in range(units):
                    new &= (every[a, earlier] != every[b, earlier]) | (unit[a] <= earlier)
                total += int(new.sum()) * (2 if across else 1)
                i = j
            return pa.table({"pairs": np.array([total], np.int64)})

        found = met.groupBy("group", "lo", "hi").applyInArrow(count, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p"))
        alone = points.agg(F.count(F.lit(1)).alias("own"))  # each with itself
        return found.select((F.col("p") + F.lit(alone.first()[0])).alias("pairs"))

    def _vectors(self, df: DataFrame) -> DataFrame:
        if self.measure in ("hamming", "jaccard"):
            return df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<int>").alias("vec"))
        return df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
