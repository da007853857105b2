"""A corpus pipeline over the documents table: toxicity, line dedup, near
duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; the last returns a row for
each document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import decontaminate, line_dedup, ngram_join, toxicity
from affinity.llm.bpe import encode_decode
from affinity.llm.common import read_table
from affinity.session import checkpoint_dir, scratch_path

VOCABULARY = os.environ.get("AFFINITY_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(F.col("text"), model, spark) < toxicity.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier line go; every document stays."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingle resemblance of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, num=4, den=5)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside 13-word windows of benchmark items go."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts, as digests."""
    return encode_decode(docs, VOCABULARY, digests=True)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("bpe_encoding_decoding", encode),
]

#: The classifier, the set joins on whole texts and the merges have no SQL form here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``. Each stage's result is written below
    the shared checkpoint folder and read again; a result goes as soon as the
    next one is written. The last stage is not yet worked out in what comes back:
    its input stays until the caller has no more use for it.

    With a ``run_id`` of the caller's, a run that failed goes on after its last
    finished stage when called again with that id and the same tables. Without
    one, what a failed run has written goes."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/affinity-run-{run_id}" if run_id else scratch_path(spark, "stages")
    paths = [f"{base}/{name}" for name, _ in STAGES[:-1]]
    last = max((i for i, path in enumerate(paths) if _files(spark, path, "_SUCCESS").exists()), default=-1)
    docs = spark.read.parquet(paths[last]) if last >= 0 else read_table(spark, sf_dir, "documents")
    for i in range(last + 1, len(paths)):
        try:
            STAGES[i][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[i])
        except Exception:
            if not run_id:
                _files(spark, base).delete()
            raise
        docs = spark.read.parquet(paths[i])
        if i:
            _files(spark, paths[i - 1]).delete()
    return STAGES[-1][1](spark, docs, sf_dir)


class _files:
    """A file or folder, whatever file system it is on."""

    def __init__(self, spark: SparkSession, *parts: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def delete(self) -> None:
        self.system.delete(self.path, True)
