"""BPE encoding and decoding with a contiguous rank array.

Texts are cut into words by the pre-tokenizer's pattern. A word is held as its
part boundaries (here: the ids of its parts) and the ranks of adjacent parts,
both contiguous; the smallest rank is found by a scan, the boundary between its
two parts is deleted, and the two neighbouring ranks are refreshed, until no
adjacent pair has a merge. Words of equal length are worked on together, one
row of a matrix each, so the scans are NumPy reductions. Only the distinct words
of a batch are encoded; a bounded cache carries the common ones along.

A word longer than ``SHORT_WORD`` bytes (rare: no white space for that long)
takes a linked list with a heap of ranks instead, which gives the same merges
without a quadratic number of scans.

Edge cases: a null or empty text has no tokens; a null id is passed through;
repeated rows are encoded each; extra columns are not read. The vocabulary is
read on the executors from ``vocab_path``, a file of an installed package that
every worker has.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (bounded_batches, buffers, ragged, row_ranges, tidy)
from .pieces import distinct_pieces

#: Words of up to this many bytes are scanned; longer ones use a heap.
SHORT_WORD = 64
#: Words of one length that are scanned at a time.
SCAN_ROWS = 1 << 14
#: Distinct pieces whose ids are kept between batches; beyond that a task starts anew.
CACHE_PIECES = 150_000
#: Bytes of text encoded at a time.
BATCH_BYTES = 2 << 20
NO_MERGE = np.int64(1) << 40

# Fixed value: the split pattern of the byte-level pre-tokenizer, with the
# Unicode property that its white space class stands for.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def printable_bytes() -> dict[str, int]:
    """Vocabulary files write every byte as a visible character: printable
    Latin-1 characters stand for themselves, the rest for 256, 257, …"""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, vocab_path: str):
        import regex
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        pieces = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()
                  if all(c in to_byte for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        size = max(pieces) + 1
        self.piece_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(pieces.get(i, b"")) for i in range(size)], out=self.piece_at[1:])
        self.piece_bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, into = (np.array(x, np.int64) for x in zip(
            *((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.size = size
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_into = key[order], order.astype(np.int64), into[order]
        self.by_rank = into
        self.words_of = regex.compile(PATTERN).findall
        self.split_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ).split if self.special else None
        # distinct pieces met so far: their place in a pool of ids
        self.known: dict[str, int] = {}
        self.pool, self.pool_size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool_at = np.zeros(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each adjacent pair, NO_MERGE if it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_MERGE)

    def scan_words(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge a matrix of equally long words; (ids, how many of each row)."""
        n, width = parts.shape
        parts = parts.copy()
        count = np.full(n, width)
        if width < 2:
            return parts, count
        rank = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        while len(live):
            held = rank[live]
            at = held.argmin(1)
            low = held[np.arange(len(live)), at]
            going = low < NO_MERGE
            live, at, low = live[going], at[going], low[going]
            if not len(live):
                break
            # delete the boundary between parts `at` and `at + 1`
            cols = np.arange(width - 1)
            shift = cols[None, :] + (cols[None, :] > at[:, None])
            own = parts[live]
            own[:, :-1] = np.take_along_axis(own, shift, 1)
            own[np.arange(len(live)), at] = self.by_rank[low]
            near = rank[live]
            if width > 2:
                moved = cols[None, :-1] + (cols[None, :-1] >= at[:, None])
                near[:, :-1] = np.take_along_axis(near, moved, 1)
            near[:, -1] = NO_MERGE
            count[live] -= 1
            rows = np.arange(len(live))
            # refresh the ranks on both sides of the merged part
            for side in (at - 1, at):
                ok = (side >= 0) & (side + 1 < count[live])
                r, s = rows[ok], side[ok]
                near[r, s] = self.ranks(own[r, s], own[r, s + 1])
            off = (at >= count[live] - 1)
            near[rows[off], at[off]] = NO_MERGE
            parts[live], rank[live] = own, near
        return parts, count

    def heap_word(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of ranks."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:]).tolist()
        part, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(rank) if r < NO_MERGE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            pair = (part[i], part[j])
            if pair not in known:
                known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < NO_MERGE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = int(self.by_rank[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p in part if p >= 0], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(length, kind="stable")
        widths, first = np.unique(length[order], return_index=True)
        ids, counts = [], []
        for width, lo, hi in zip(widths.tolist(), first.tolist(), [*first[1:].tolist(), len(raw)], strict=True):
            who = order[lo:hi].tolist()
            if width > SHORT_WORD:
                for i in who:
                    ids.append(self.heap_word(raw[i]))
                    counts.append([len(ids[-1])])
                continue
            flat = self.byte_id[np.frombuffer(b"".join([raw[i] for i in who]), np.uint8)].reshape(-1, width)
            for part in range(0, len(who), SCAN_ROWS):
                block, count = self.scan_words(flat[part:part + SCAN_ROWS])
                ids.append(block[np.arange(width) < count[:, None]])
                counts.append(count)
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, count = np.concatenate(ids), np.concatenate(counts)
        back = np.empty(len(raw), np.int64)
        back[order] = np.arange(len(raw))
        start = np.cumsum(count) - count
        return ids[ragged(start[back], count[back])], count[back]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each). Pieces start and end at
        word boundaries of the text that they come from."""
        words, special = [], {}
        for piece in pieces:
            if "<|" in piece and self.split_special:
                parts = self.split_special(piece)
                found = []
                for i, part in enumerate(parts):
                    found += [part] if i % 2 else self.words_of(part)
                    if i % 2:
                        special[len(words), len(found) - 1] = self.special[part]
                words.append(found)
            else:
                words.append(self.words_of(piece))
        per = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
        ids, count = self.encode_words(coded.dictionary.to_pylist())
        which = np.asarray(coded.indices).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(per)))
        if special:  # a special token takes one id of its own
            ids = np.concatenate((ids, list(special.values())))
            count = np.concatenate((count, np.ones(len(special), np.int64)))
            for k, (piece, word) in enumerate(special):
                which[at[piece] + word] = len(count) - len(special) + k
        start = np.cumsum(count) - count
        ends = np.concatenate(([0], np.cumsum(count[which])))
        return ids[ragged(start[which], count[which])], np.diff(ends[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        pieces, which, per_text = distinct_pieces(texts)
        slot = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        if (slot < 0).any() and len(self.known) > CACHE_PIECES:
            self.known, self.pool, self.pool_size = {}, np.zeros(0, np.int32), np.zeros(0, np.int32)
            slot[:] = -1
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            ids, size = self.encode_pieces(fresh)
            slot[new] = len(self.pool_size) + np.arange(len(new))
            self.known.update(zip(fresh, slot[new].tolist(), strict=True))
            self.pool = np.concatenate((self.pool, ids.astype(np.int32)))
            self.pool_size = np.concatenate((self.pool_size, size.astype(np.int32)))
            self.pool_at = np.cumsum(self.pool_size, dtype=np.int64) - self.pool_size
        use = slot[which]
        size = self.pool_size[use]
        flat = self.pool[ragged(self.pool_at[use], size)]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        return flat, np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each id sequence; what isn't UTF-8 becomes U+FFFD."""
        length = np.diff(self.piece_at)[ids]
        data = self.piece_bytes[ragged(self.piece_at[ids], length)].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            piece = data[a:b]
            try:
                piece.decode()
            except UnicodeDecodeError:
                piece = piece.decode(errors="replace").encode()
            out.append(piece)
        return out


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        at, _ = buffers(batch.column("text"))
        for lo, hi in row_ranges(at, BATCH_BYTES):
            yield batch.slice(lo, hi - lo)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                  digests: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded string) of every text, or, with
    ``digests``, (id, n_tokens, ids_sha256, decoded_sha256) without shipping
    the sequences out of the tasks. One narrow stage, no shuffle."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(it):
        coder = None
        for batch in _batches(it):
            coder = coder or BytePairs(vocab_path)
            ids, counts = coder.encode(batch.column("text"))
            back = coder.decode(ids, counts)
            ends = np.concatenate(([0], np.cumsum(counts)))
            head = {"id": batch.column("id")}
            if digests:
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict(head | {
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": [hashlib.sha256(raw[a:b].tobytes()).hexdigest()
                                   for a, b in zip(ends[:-1], ends[1:], strict=True)],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]})
            else:
                yield pa.RecordBatch.from_pydict(head | {
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    "decoded": pa.array([x.decode() for x in back], pa.string())})

    tail = ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
            else "ids array<int>, decoded string")
    return src.mapInArrow(tidy(run), f"id {id_type}, {tail}").withColumnRenamed("id", id_col)
