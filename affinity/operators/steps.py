"""Weighted picks over neighbour lists, for a whole Arrow batch of walkers at a time.

Lists are ragged: one flat array of entries and the offsets of each row's part.
Running sums are added in the order of the entries, as SQL's window sums are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a padded matrix of running sums (32 MB).
CELLS = 1 << 22


def flat(column, child: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, entries) of a list column of a record batch; null lists are empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    entries = column.flatten()
    if child is not None:
        entries = entries.field(child)
    return np.concatenate([[0], np.cumsum(lengths)]), np.asarray(entries)


def take(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places of the entries) of the given rows, one after the other."""
    start, lengths = offsets[rows], offsets[rows + 1] - offsets[rows]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return out, np.arange(out[-1]) + np.repeat(start - out[:-1], lengths)


def contained(offsets: np.ndarray, entries: np.ndarray, in_offsets: np.ndarray, in_entries: np.ndarray) -> np.ndarray:
    """For each entry whether the other list of its row has it."""
    ids, places = np.unique(in_entries, return_inverse=True)
    if not len(ids):
        return np.zeros(len(entries), bool)
    there = np.repeat(np.arange(len(in_offsets) - 1), np.diff(in_offsets)) * len(ids) + places
    at = np.minimum(np.searchsorted(ids, entries), len(ids) - 1)
    asked = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * len(ids) + at
    return (ids[at] == entries) & np.isin(asked, there)


def bias(offsets: np.ndarray, nxt: np.ndarray, weight: np.ndarray, prev: np.ndarray, known: np.ndarray,
         p: float, q: float) -> np.ndarray:
    """The node2vec bias of each entry: back to prev w / p, a neighbour of prev w, else w / q."""
    back = nxt == np.repeat(prev, np.diff(offsets))
    return np.where(back, weight / p, np.where(known, weight, weight / q))


def row_parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose padded matrix has about ``CELLS`` cells at most."""
    lengths, i, n = np.diff(offsets), 0, len(offsets) - 1
    while i < n:
        widest = np.maximum.accumulate(lengths[i:])
        fits = np.searchsorted(widest * np.arange(1, n - i + 1), CELLS, side="right")
        j = i + max(1, int(fits))
        yield i, j
        i = j


def running_sums(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum up to and with each entry of its row, total of each row)."""
    sums, totals = np.zeros(len(values)), np.zeros(len(offsets) - 1)
    for i, j in row_parts(offsets):
        lengths = np.diff(offsets[i:j + 1])
        width = int(lengths.max(initial=0))
        if not width:
            continue
        inside = np.arange(width) < lengths[:, None]
        padded = np.zeros(inside.shape)
        padded[inside] = values[offsets[i]:offsets[j]]
        padded = np.cumsum(padded, axis=1)
        sums[offsets[i]:offsets[j]] = padded[inside]
        totals[i:j] = padded[:, -1]
    return sums, totals


def pick(offsets: np.ndarray, values: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Place of the first entry of each row whose running sum reaches u * total (the
    last one if rounding leaves none); -1 for an empty row."""
    sums, totals = running_sums(offsets, values)
    lengths = np.diff(offsets)
    short = sums < np.repeat(u * totals, lengths)  # a prefix of each row: sums don't fall
    before = np.concatenate([[0], np.cumsum(short)])
    place = offsets[:-1] + np.minimum(before[offsets[1:]] - before[offsets[:-1]], np.maximum(lengths - 1, 0))
    return np.where(lengths > 0, place, -1)


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


class Neighbours:
    """The whole adjacency of a graph of proven size, in a task's memory."""

    def __init__(self, src: np.ndarray, offsets: np.ndarray, nxt: np.ndarray, weight: np.ndarray):
        order = np.argsort(src)
        self.src = src[order]
        self.offsets, places = take(offsets, order)
        self.nxt, self.weight = nxt[places], weight[places]
        self.ids = np.unique(np.concatenate([self.src, self.nxt]))
        own = np.repeat(np.searchsorted(self.ids, self.src), np.diff(self.offsets))
        self.edges = np.sort(own * len(self.ids) + np.searchsorted(self.ids, self.nxt))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, places) of the neighbours of each node; none for an unknown one."""
        if not len(self.src):
            return np.zeros(len(nodes) + 1, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.src, nodes), len(self.src) - 1)
        known = self.src[at] == nodes
        lengths = np.where(known, self.offsets[at + 1] - self.offsets[at], 0)
        out = np.concatenate([[0], np.cumsum(lengths)])
        return out, np.arange(out[-1]) + np.repeat(self.offsets[at] - out[:-1], lengths)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether there is an edge from a to b, for nodes of the graph."""
        key = np.searchsorted(self.ids, a) * len(self.ids) + np.searchsorted(self.ids, b)
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return self.edges[at] == key

    def advance(self, prev: np.ndarray, cur: np.ndarray, alive: np.ndarray, draws: np.ndarray, p: float, q: float):
        """Walk as many steps as ``draws`` has columns: (prev, cur, alive, nodes visited, whether each was)."""
        prev, cur, alive = prev.copy(), cur.copy(), alive.copy()
        seen, moved = np.zeros(draws.shape, np.int64), np.zeros(draws.shape, bool)
        for step in range(draws.shape[1]):
            rows = np.flatnonzero(alive)
            offsets, places = self.of(cur[rows])
            nxt = self.nxt[places]
            known = self.linked(np.repeat(prev[rows], np.diff(offsets)), nxt) if len(nxt) else np.zeros(0, bool)
            place = pick(offsets, bias(offsets, nxt, self.weight[places], prev[rows], known, p, q), draws[rows, step])
            gone = rows[place >= 0]
            alive[rows[place < 0]] = False
            seen[gone, step], moved[gone, step] = nxt[place[place >= 0]], True
            prev[gone], cur[gone] = cur[gone], seen[gone, step]
        return prev, cur, alive, seen, moved
