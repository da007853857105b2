"""The registered queries of this subpackage and their SQL.

Each query applies an operator with production parameters to its whole table and
derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, fingerprints, html_extract, license_scan, line_dedup, ngram_join, suffix_dedup,
               target_sampling, toxicity, whitening)
from .bpe import encode_decode
from .common import read_table
from .token_counts import count_tokens

#: The vocabulary file; another one may be named in the environment.
VOCABULARY = os.environ.get("AFFINITY_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array_dedup(spark, sf):
    """Bytes of every document that earlier documents have in 50-byte strings."""
    return suffix_dedup.dedup_substrings(read_table(spark, sf, "documents"), digests=True)


def op2_license_scans(spark, sf):
    """doc_id, path, own_licence, cosine, licence, origin of every document."""
    return license_scan.scan_licences(license_scan.document_paths(read_table(spark, sf, "documents")), keep=("doc_id",))


def op3_document_fingerprints(spark, sf):
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.likeness_of_edits(read_table(spark, sf, "documents"))


def op4_ngram_jaccard_join(spark, sf):
    """Components of documents with 4-word shingle resemblance of 0.85 or more."""
    return ngram_join.jaccard_components(read_table(spark, sf, "documents"), n=4, num=85, den=100)


def op5_benchmark_decontamination(spark, sf):
    """Words of every document inside 13-word windows of benchmark items."""
    found = decontaminate.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    hits, n = F.col("hits"), F.col("n_words")
    return found.select("doc_id", "n_words", decontaminate.n_hit(hits).alias("n_hit"),
                        F.size("item_ids").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"),
                        decontaminate.is_contaminated(hits, n).alias("contaminated"))


def op6_token_counts(spark, sf):
    """Token counts of every whole text."""
    return count_tokens(read_table(spark, sf, "documents"), VOCABULARY)


def op7_line_dedup(spark, sf):
    """Lines of every document, how many go, and what is left."""
    out = line_dedup.dedup_lines(read_table(spark, sf, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_html_extraction(spark, sf):
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf, "pages"))


def op9_bpe_encoding_decoding(spark, sf):
    """Ids and decoded text of every document, as digests."""
    return encode_decode(read_table(spark, sf, "documents"), VOCABULARY, digests=True)


def op10_toxicity(spark, sf):
    """Toxicity score of every document."""
    docs = read_table(spark, sf, "documents")
    model = toxicity.train(docs, read_table(spark, sf, "labels"))
    scored = docs.select("doc_id", toxicity.score_of(F.col("text"), model, spark).alias("score"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_exact_dedup(spark, sf):
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.mark_copies(read_table(spark, sf, "documents"))


def op12_target_resampling(spark, sf):
    """Scores of every document for a draw that resembles the benchmark texts."""
    out = target_sampling.importance_resample(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_whitening(spark, sf):
    """Whitened values of every embedding along its first four components."""
    return whitening.whiten(read_table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_license_scans, op3_document_fingerprints, op4_ngram_jaccard_join, op5_benchmark_decontamination,
    op6_token_counts, op7_line_dedup, op8_html_extraction, op9_bpe_encoding_decoding, op10_toxicity, op11_exact_dedup,
    op12_target_resampling, op13_embedding_whitening)}

ORACLES = {"op2_license_scans": license_scan.oracle(), "op11_exact_dedup": exact_dedup.oracle()}
