"""Token counts of whole texts with a public tokenizer library.

Batches are balanced by bytes, long texts are split at safe boundaries (see
``pieces``), each distinct piece of a batch is encoded once by the library's
batch encoder, and only lengths leave the Arrow function. One narrow stage.

The split is used for byte-level BPE files, where it cannot change a token. Other
kinds (``.model`` files, tokenizers with a normalizer or another pre-tokenizer)
get whole texts.

Edge cases: null counts as empty (0 tokens); special strings inside a text are
handled as the library does by default; repeated rows are counted each; extra
columns are not read. Truncation and padding in the file are switched off.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (bounded_batches, buffers, row_ranges, tidy)
from .pieces import distinct_pieces

#: Bytes of text in a batch for the library.
BATCH_BYTES = 2 << 20
#: Distinct pieces whose lengths are kept between batches; beyond that a task starts anew.
CACHE_PIECES = 150_000


class Counter:
    """Token counts by the library that the vocabulary file is for."""

    def __init__(self, vocab_path: str):
        self.known: dict[str, int] = {}
        if vocab_path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=vocab_path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.cuts = False
            return
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        coder = Tokenizer.from_file(vocab_path)
        coder.no_truncation()
        coder.no_padding()
        self.lengths = lambda texts: [len(x) for x in
                                      coder.encode_batch_fast(texts, add_special_tokens=False)]
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.cuts = (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space")
                     and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                                 for t in added))

    def _encoded(self, texts: list[str]) -> np.ndarray:
        """Lengths, encoded in batches of about equal bytes."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(size)))
        out = []
        for lo, hi in row_ranges(at, 1 << 18):
            out += self.lengths(texts[lo:hi])
        return np.array(out, np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.cuts:
            return self._encoded(["" if x is None else x for x in texts.to_pylist()])
        pieces, which, per_text = distinct_pieces(texts)
        count = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(count < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            count[new] = self._encoded(fresh)
            if len(self.known) > CACHE_PIECES:
                self.known = {}
            self.known.update(zip(fresh, count[new].tolist(), strict=True))
        ends = np.concatenate(([0], np.cumsum(count[which])))
        return np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(it):
        counter = None
        for batch in it:
            at, _ = buffers(batch.column("text"))
            for lo, hi in row_ranges(at, BATCH_BYTES):
                counter = counter or Counter(vocab_path)
                part = batch.slice(lo, hi - lo)
                n = counter(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "n_bytes": pa.array(np.diff(at[lo:hi + 1])),
                    "n_tokens": pa.array(n), "over_limit": pc.greater(pa.array(n), limit)})

    return (src.mapInArrow(tidy(run), f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
