"""What finished steps leave on disk, and what counting holds in memory."""

import time
import tracemalloc
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from affinity.llm import common, line_dedup, ngram_join
from affinity.llm.common import cut


def _shuffled(spark) -> int:
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for folder in folders for p in Path(folder).rglob("shuffle_*.data"))


def _settled(spark, most: int) -> bool:
    """Whether shuffle files come down to ``most`` bytes; Spark removes them in a thread of its own."""
    from affinity.session import let_go

    for _ in range(20):
        let_go(spark)
        time.sleep(0.5)
        if _shuffled(spark) <= most:
            return True
    return False


def test_files_of_finished_steps_go(spark):
    start = _shuffled(spark)
    done = cut(spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).count())
    assert _shuffled(spark) > start + 1_000_000
    assert _settled(spark, start + 100_000)
    assert done.count() == 200_000


def test_steps_let_go_of_their_files(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(line_dedup, "let_go", lambda s: calls.append(s))
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3}\nx y z {i}") for i in range(20)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 20
    assert len(calls) >= 4


def test_columns_of_the_same_rows_are_one(spark):
    held = {1: "ab", 2: "ab", 3: "abc", 4: "ab", 5: "cd", 6: "ccdd"}
    now = spark.createDataFrame([(h, s.encode(), 10, h) for h, rows in held.items() for s in rows],
                                "h long, sig binary, size int, place int")
    got = {(r.h, bytes(r.sig).decode(), r.columns) for r in ngram_join._one_of_alike(now).collect()}
    assert got == {(1, "a", 3), (1, "b", 3), (3, "a", 1), (3, "b", 1), (3, "c", 1), (5, "c", 1), (5, "d", 1),
                   (6, "c", 1), (6, "d", 1)}


def test_counting_takes_little_more_than_its_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    for n, entries in ((1, 1 << 20), (5, 2), (4000, 100), (300_000, 1 << 10)):
        monkeypatch.setattr(common, "FREQUENT_ENTRIES", entries)
        hashes = rng.integers(0, max(2, n // 8), n).astype(np.uint64)
        h, c = np.unique(hashes, return_counts=True)
        often = c >= max(2, n // entries)
        counts = common.LocalCounts()
        counts.add(hashes[: n // 2])
        counts.add(hashes[n // 2:])
        tracemalloc.start()
        got_h, got_c, size = counts.flush()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert size == n and np.array_equal(got_h, h[often]) and np.array_equal(got_c, c[often])
        if n > 100_000:
            assert peak < 2 * hashes.nbytes
