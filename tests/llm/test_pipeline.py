"""The pipeline, stage by stage against brute force on each stage's own input, as a
whole, over an empty table, and resumed after a failure."""

import hashlib
import os
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402

from .test_operators import ROWS, SCHEMA, brute_lines, lower, shingles  # noqa: E402
from .test_operators import words as space_words  # noqa: E402

WHOLE = next(r[1] for r in ROWS if r[1] and len(space_words(r[1])) > 100)
PLAIN = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def rows():
    rnd = random.Random(3)
    say = lambda n: " ".join(f"u{rnd.randrange(400)}" for _ in range(n))
    rest = tuple(ROWS[1][2:])
    toxic = [(1000 + i, f"{say(9)} {'grimbolt' if i % 4 else 'gr1mb0lt'} {say(9)}", *rest) for i in range(60)]
    clean = [(2000 + i, say(25), *rest) for i in range(60)]
    t = say(60).split()  # texts that are alike while no line of them is
    broken = [(3000 + n, "\n".join(" ".join(t[k:k + n]) for k in range(0, 60, n)) + f" end{n}", *rest) for n in (7, 11, 60)]
    return toxic, clean, [*broken, (None, "of no id " + say(30), *rest), (None, None, *rest)]


def tables(spark, folder, empty=False):
    toxic, clean, odd = rows()
    docs = spark.createDataFrame([] if empty else [*ROWS, *toxic, *clean, *odd], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] < 2000)) for r in toxic + clean] + [(None, 1, 1), (5, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WHOLE.split()[:60])), (2, None), (None, "x y z")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def without_toxic(got):
    return [r for r in got if "grimbolt" not in (r["text"] or "") and "gr1mb0lt" not in (r["text"] or "")]


def with_lines(got):
    ordered = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    kept = iter(brute_lines([(k, r["text"] or "") for k, r in enumerate(ordered)]).values())
    texts = [None if r["text"] is None else t for r, t in zip(ordered, kept, strict=True)]
    return [{**r.asDict(), "text": t, "n_chars": None if t is None else len(t)} for r, t in zip(ordered, texts, strict=True)]


def one_each(got):
    have = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    sets, root = [shingles(r["text"], 5) for r in have], list(range(len(have)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [r for i, r in enumerate(have) if find(i) == i] + [r for r in got if r["doc_id"] is None]


def uncontaminated(got):
    split = lambda t: lower(t).translate(PLAIN).split()
    items = [split(" ".join(WHOLE.split()[:60])), ["x", "y", "z"]]
    windows = {tuple(v[k:k + 13]) for v in items for k in range(max(1, len(v) - 12))}
    out = []
    for r in got:
        v = split(r["text"])
        hit = {p for n in {len(x) for x in windows} for k in range(len(v) - n + 1) if tuple(v[k:k + n]) in windows
               for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(v):
            out.append(r)
    return out


STAGE_TESTS = {"toxicity": without_toxic, "line_dedup": with_lines, "ngram_jaccard_join": one_each,
               "benchmark_decontamination": uncontaminated}


def test_stages_and_resuming(spark, tmp_path, monkeypatch):
    folder = tables(spark, str(tmp_path))
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == [*STAGE_TESTS, "bpe_encoding_decoding"]
    calls, coder = [], tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    stop = [True]

    def watched(name, stage):
        def call(session, own, sf_dir):
            calls.append(name)
            if name == "benchmark_decontamination" and stop[0]:
                raise RuntimeError("stopped")
            before = own.collect()
            out = stage(session, own, sf_dir)
            if name in STAGE_TESTS:
                assert out.columns == docs.columns
                want = STAGE_TESTS[name](before)
                want = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in want]
                assert sorted(map(str, want)) == as_set(out), name
                assert name == "line_dedup" or len(want) < len(before), name
            else:
                texts = {str((r["doc_id"], r["text"])): r["text"] or "" for r in before}
                ids = [coder.encode(t, add_special_tokens=False).ids for t in texts.values()]
                assert sorted(r["ids_sha256"] for r in out.collect()) == sorted(
                    hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids)
            return out
        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    run_id = os.path.basename(str(tmp_path))
    with pytest.raises(RuntimeError, match="stopped"):
        corpus_pipeline.run(spark, folder, run_id)
    stop[0] = False
    out = corpus_pipeline.run(spark, folder, run_id)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 60
    assert calls == [*names[:4], *names[3:]]


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, str(tmp_path), empty=True)).count() == 0
