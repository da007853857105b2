"""Safe boundaries of byte-level BPE texts.

A space before a character that isn't white space always begins a new word of
the pre-tokenizer, whatever stands around it: its pattern lets such a space only
lead the following letters, digits or symbols. Texts cut there have the tokens
of their pieces, so each distinct piece has to be encoded once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that another white space character or the end follows is no boundary.
BOUNDARY = re.compile(r" (?=\S)")
NO_BOUNDARY = r" (?:[\s\x{1c}-\x{1f}\x{85}\p{Z}]|$)"


def cut(text: str) -> list[str]:
    """The pieces of one text, each but the first with its leading space."""
    first, *rest = BOUNDARY.split(text)
    return [first, *(" " + p for p in rest)]


def distinct_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, piece number of each piece in text order, pieces per text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # Cut at every space; the few texts with a space that is no boundary are cut one by one.
    odd = np.asarray(pc.match_substring_regex(texts, NO_BOUNDARY).to_numpy(zero_copy_only=False), bool)
    odd_rows = np.flatnonzero(odd)
    plain = pc.if_else(pa.array(odd), "", texts) if len(odd_rows) else texts
    lists = pc.split_pattern(plain, " ")
    at = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.dictionary_encode()
    which = np.asarray(coded.indices).astype(np.int64)
    words = coded.dictionary.to_pylist()
    count = np.diff(at)
    head = at[:-1][count > 0]
    lead = np.ones(len(which), bool)
    lead[head] = False
    pieces = [" " + w for w in words]
    heads, head_no = np.unique(which[head], return_inverse=True)
    which[head] = len(pieces) + head_no
    pieces += [words[i] for i in heads.tolist()]
    per = count
    if len(odd_rows):
        number = {}
        extra, extra_per = [], {}
        for i in odd_rows.tolist():
            own = cut(texts[i].as_py())
            extra_per[i] = len(own)
            extra.append(np.array([number.setdefault(p, len(pieces) + len(number)) for p in own], np.int64))
        pieces += list(number)
        parts, done, k = [], 0, 0
        for i in odd_rows.tolist():
            parts += [which[at[done]:at[i]], extra[k]]
            done, k = i + 1, k + 1
        parts.append(which[at[done]:at[-1]])
        which = np.concatenate(parts)
        per = count.copy()
        for i, n in extra_per.items():
            per[i] = n
    return pieces, which, per
