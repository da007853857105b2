"""Exact copies, target resampling and whitening against brute force, with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.llm import exact_dedup, target_sampling, whitening

from .test_operators import ROWS, SCHEMA, docs, none, odd  # noqa: F401


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# --- exact copies --------------------------------------------------------------

def bare(t):
    return re.sub("[\x20\x09-\x0D]", "", t or "")


def brute_copies(rows):
    """rows of (id, text); of rows that tie in all, one is kept."""
    groups, out = {}, []
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


def got_copies(df):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.mark_copies(df).collect()]


def test_copies_against_brute_force(docs, none, odd):  # noqa: F811
    same(got_copies(docs), brute_copies([r[:2] for r in ROWS]))
    same(got_copies(odd), brute_copies([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert got_copies(none) == []


@pytest.mark.parametrize("hot", [1, 1000])
def test_large_groups(spark, monkeypatch, hot):
    """A third of all rows are copies; ties by id, null ids last, white space of all kinds."""
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", hot)
    rnd = random.Random(5)
    rows = [(None if k % 9 == 0 else k, "a  b" if k % 3 else "\ta\nb\x0b\x0c\r "[:2 + k % 7] + "b") for k in range(400)]
    rows += [(1000 + k, "é " + "x" * rnd.randint(0, 300)) for k in range(800)] + [(7, None), (8, ""), (7, " "), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(got_copies(df), brute_copies(rows))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    same([bare(r["text"]) for r in kept.collect()], list({bare(t) for _, t in rows}))
    same([r["doc_id"] for r in kept.collect()], [i for i, _, _, k, _ in brute_copies(rows) if k])


def test_full_filter(docs, monkeypatch):  # noqa: F811
    """With every position hit all rows are candidates; results are the same."""
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 2)
    same(got_copies(docs), brute_copies([r[:2] for r in ROWS]))
    kept = exact_dedup.drop_copies(docs)
    same([r["doc_id"] for r in kept.collect()], [i for i, _, _, k, _ in brute_copies([r[:2] for r in ROWS]) if k])
    assert kept.columns == docs.columns


def test_only_candidates_shuffle(docs):  # noqa: F811
    """The filter leaves rows without a copy out of the candidates."""
    rows = docs.select(F.col("text").alias("k")).withColumn("__at", exact_dedup.position(F.coalesce("k", F.lit("")), 1 << 16))
    marked = exact_dedup.marked(rows, exact_dedup.repeated_words(rows, 1 << 16))
    texts = [r[1] or "" for r in ROWS]
    assert marked.filter("__maybe").count() == sum(texts.count(t) > 1 for t in texts)


def test_copies_sql(docs):  # noqa: F811
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    same(con.sql(exact_dedup.oracle()).fetchall(), got_copies(docs))


# --- target resampling -----------------------------------------------------------

def tokens(t):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(
        rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]


def buckets(t):
    w = tokens(t)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_sample(rows, target, least=20, share=(5, 100)):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in rows:
        np.add.at(s, buckets(text), 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        found = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(tokens(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[:len(able) * share[0] // share[1]], 1):
        r[5] = n
    return [tuple(r) for r in out]


def got_sample(df, target, **how):
    out = target_sampling.importance_resample(df, target, **how)
    return [tuple(r) for r in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]


TARGET = [None, "", "One two THREE", *[r[1] for r in ROWS[::6]]]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(t, "k") for t in TARGET], "text string, bucket string")


def test_sample_against_brute_force(docs, target, none, odd):  # noqa: F811
    rows = [r[:2] for r in ROWS]
    same(got_sample(docs, target, share=(30, 100)), brute_sample(rows, TARGET, share=(30, 100)))
    same(got_sample(docs, none), brute_sample(rows, []))
    same(got_sample(odd, target, least_words=0, share=(1, 1)),
         brute_sample([(r["doc_id"], r["text"]) for r in odd.collect()], TARGET, 0, (1, 1)))
    assert got_sample(none, target) == []


def test_blocks_of_words(docs, target, monkeypatch):  # noqa: F811
    """Runs over the ends of blocks are counted once; runs over ends of texts never."""
    want = brute_sample([r[:2] for r in ROWS], TARGET)
    for size in (1, 2, 7):
        monkeypatch.setattr(target_sampling, "BLOCK_WORDS", size)
        import pyarrow as pa
        for i, text in [r[:2] for r in ROWS]:
            parts = [p for *_, found in target_sampling.feature_blocks(pa.array(["x y", text, None])) for p in found]
            got = [int(b) for rows, found in parts for r, b in zip(rows, found, strict=True) if r == 1]
            assert sorted(got) == sorted(buckets(text)), (size, i)
    monkeypatch.undo()
    same(got_sample(docs, target), want)


def test_long_words_and_texts(spark):
    rnd = random.Random(2)
    texts = ["Q" * 30000 + " " + "q" * 30000 + " z", " ".join(rnd.choice(["aé", "b", "c" * 9, "d" * 70, "e" * 17]) for _ in range(30000)),
             "日本語" * 4000, "\x00a\x7fb"]
    import pyarrow as pa
    for t in texts:
        (_, _, words, parts), = target_sampling.feature_blocks(pa.array([t]))
        assert sorted(int(b) for _, found in parts for b in found) == sorted(buckets(t)) and words[0] == len(tokens(t))


def test_crc_by_columns():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 31):
        rows = rnd.integers(0, 256, (50, n)).astype(np.uint8)
        assert target_sampling.crc_matrix(rows.T).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


# --- whitening -------------------------------------------------------------------

def brute_whitening(rows):
    x = [np.array([math.floor(256 * float(c)) for c in v]) for _, v in rows]
    fit = np.unique(np.array(x), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    keep = [k for k in np.argsort(-e)[:4] if e[k] > 1e-9 * e.max()]
    return [(i, n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)), (row - s / n) @ u[:, keep] / np.sqrt(e[keep]),
             e[keep] / e.sum()) for (i, _), row in zip(rows, x, strict=True)]


def check_whitening(df, rows):
    got, want = {}, brute_whitening(rows)
    for r in whitening.whiten(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    k = len(want[0][3])
    sign = np.ones(k)
    pivot = [max(range(len(want)), key=lambda i, c=c: abs(want[i][3][c])) for c in range(k)]
    for c in range(k):
        one = next(r for r in got[want[pivot[c]][0]] if r["component"] == c + 1)
        sign[c] = np.sign(one["whitened"] * want[pivot[c]][3][c])
    assert sum(map(len, got.values())) == k * len(rows)
    for i, n, deviation, white, explained in want:
        for c in range(k):
            own = [r for r in got[i] if r["component"] == c + 1]
            assert own and all((r["n"], r["deviation"]) == (n, deviation) for r in own)
            assert all(abs(r["whitened"] * sign[c] - white[c]) < 1e-8 for r in own)
            assert all(r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9 for r in own)


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.standard_normal(12) * np.arange(1, 13)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)]  # copies count once in the fit
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] * 12), (2004, []),
           (2005, [1e300] * 12), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows + bad], "vec_id long, embedding array<double>, __y string, n int, x double")
    check_whitening(df.repartition(5), rows)
    floats = df.filter("vec_id < 2000").withColumn("embedding", F.col("embedding").cast("array<float>"))
    check_whitening(floats, [(i, np.float32(v)) for i, v in rows])


def test_whitening_of_few_directions(spark):
    line = [(i, [float(i % 7), 2.0 * (i % 7), 0.0]) for i in range(30)]
    df = spark.createDataFrame(line, "vec_id long, embedding array<double>")
    check_whitening(df, line)
    assert whitening.whiten(df.filter("vec_id % 7 = 1")).count() == 0  # one distinct vector
    assert whitening.whiten(df.filter("vec_id < 0")).count() == 0
    null_ids = df.withColumn("vec_id", F.lit(None).cast("long"))
    assert whitening.whiten(null_ids).count() == 30


def test_large_entries_stay_exact(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [-(2.0 ** 40), 2.0]), (2, [0.0, 0.25])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: None, 1: None, 2: (3 * 64 - 832) ** 2}


def planted(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 4], [5] * 6, [3, 3, 3, 1, 1, 1], [4, 3, 2, 1 + 1e-12, 1, 0.5], [1, 1e-3, 1e-6, 1e-9, 0, 0],
                                    [2, 2 - 1e-9, 2 - 2e-9, 1, 1, 1], [1], [0, 0]])
def test_contour_integration(values):
    """Separated, equal, nearly equal, tiny and zero eigenvalues; counts above any point."""
    for seed in range(3):
        v = planted(np.array(values, float), seed)
        true = np.linalg.eigvalsh(v)[::-1]
        e, u = whitening.leading(v, 4)
        assert len(e) == min(4, sum(x > 1e-13 for x in values))
        assert np.allclose(e, true[:len(e)], rtol=1e-7, atol=1e-14) and np.allclose(v @ u, u * e, atol=1e-13 * max(values[0], 1))
        assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
        for s in (0.123, 1.5, 2.7, -1.0, 10.0):
            assert whitening.above(v, s) == sum(x > s for x in values)
