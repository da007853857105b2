"""Pairs of users that share an item, from lists sent as bytes: the wire form of ``llr.half_pairs``.

The members of an item are sorted and written once as variable-length numbers: the step from the
user before, the user's measure (its count or rating, left out where all are 1) and its total.
What is sent to a user's task is the end of that text behind the user itself, so an entry takes a
few bytes. A task gets its lists in the order of their users, and sums up the pairs of
about ``PAIRS_HELD`` entries at a time, with all lists of a user in one go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import steps

#: Entries of lists that a task reads at once; rows of a batch given to Spark.
PAIRS_HELD, ROWS_GIVEN = 1 << 20, 1 << 17
#: Forms of a measure: all are 1, whole numbers, bits of doubles.
ONES, WHOLE, BITS = 0, 1, 2


def folded(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned numbers, small ones to small ones."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unfolded(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def written(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): seven bits a byte, the lowest first, the top bit set in all but the last byte."""
    size, rest = np.ones(len(x), np.int64), x >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest = rest >> np.uint64(7)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > i)
        part = (x[here] >> np.uint64(7 * i)) & np.uint64(127)
        out[offsets[here] + i] = part | np.where(size[here] > i + 1, 128, 0).astype(np.uint64)
    return out, offsets


def read(data: np.ndarray) -> np.ndarray:
    """The numbers of ``written`` bytes."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    size, out = last - first + 1, np.zeros(len(last), np.uint64)
    for i in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > i)
        out[here] |= (data[first[here] + i] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
    return out


def form_of(measure: np.ndarray) -> int:
    if not len(measure) or (measure == 1).all():
        return ONES
    if measure.dtype.kind == "i" or bool((np.isfinite(measure) & (measure == np.floor(measure)) & (np.abs(measure) < 2**53)
                                          & ~((measure == 0) & np.signbit(measure))).all()):
        return WHOLE
    return BITS


def entries(offsets: np.ndarray, user: np.ndarray, measure: np.ndarray, n: np.ndarray | None, form: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offset of each entry) of sorted lists; the step of a list's first entry is 0."""
    step = np.diff(user, prepend=user[:1])
    step[offsets[:-1][np.diff(offsets) > 0]] = 0
    fields = [step.view(np.uint64)]  # of a whole range of numbers a step may be beyond the signed ones
    if form != ONES:
        fields.append(folded(measure.astype(np.int64)) if form == WHOLE else measure.astype(np.float64).view(np.uint64))
    if n is not None:
        fields.append(folded(n))
    data, at = written(np.stack(fields, axis=1).reshape(-1))
    return data, at[::len(fields)]


def _packed(names: list[str], hot: dict[int, int]):
    """(m, others: users and their values of items) -> a row for each member with those of ``others`` not before it:
    (a, salt, own values, first, form, list)."""
    measure, totals = names[0], len(names) > 1
    hot_users = np.array(sorted(hot), np.int64)
    parts = np.array([hot[u] for u in hot_users.tolist()], np.int64)

    def salted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(hot_users):
            return np.zeros(len(a), np.int64)
        at = np.minimum(np.searchsorted(hot_users, a), len(hot_users) - 1)
        n = np.where(hot_users[at] == a, parts[at], 1)
        mixed = (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % n.astype(np.uint64)).astype(np.int64)

    def rows(a, salt, own, first, form, lists):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(salt.astype(np.int32)), *(pa.array(v) for v in own), pa.array(first),
                                           pa.array(np.full(len(a), form, np.int32)), pa.array(lists, pa.binary())],
                                          ["a", "_salt", *(f"{v}_a" for v in names), "first", "form", "list"])

    def run(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sides = []
            for s in "mo":
                if f"{s}_user" not in column:
                    sides.append(sides[0])
                    continue
                offsets, user = steps.flat(column[f"{s}_user"])
                values = [steps.flat(column[f"{s}_{v}"])[1] for v in names]
                order = np.lexsort((user, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))))
                sides.append((offsets, user[order], [v[order] for v in values]))
            (offsets, user, own), (ends, others, theirs) = sides
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            there = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            codes = np.unique(np.concatenate([user, others]))
            wide = len(codes) + 1
            start = np.searchsorted(there * wide + np.searchsorted(codes, others), row * wide + np.searchsorted(codes, user))
            end = ends[row + 1]
            kept = np.flatnonzero(start < end)
            row, user, own, start, end = row[kept], user[kept], [v[kept] for v in own], start[kept], end[kept]
            form = max(form_of(own[0]), form_of(theirs[0]))
            cold = np.ones(len(user), bool) if not len(hot_users) else ~np.isin(user, hot_users)
            # the end of an item's text from behind the first entry, of which what stands before its values is known
            data, at = entries(ends, others, theirs[0], theirs[1] if totals else None, form)
            text, here = data.tobytes(), np.flatnonzero(cold)
            skipped = at[start[here]] + step_bytes(ends, others)[start[here]]
            lists = [text[i:j] for i, j in zip(skipped.tolist(), at[end[here]].tolist(), strict=True)]
            for i in range(0, len(here), ROWS_GIVEN):
                some = here[i:i + ROWS_GIVEN]
                yield rows(user[some], np.zeros(len(some), np.int64), [v[some] for v in own], others[start[some]], form, lists[i:i + ROWS_GIVEN])
            here = np.flatnonzero(~cold)
            taken = np.cumsum((end - start)[here])
            i = 0
            while i < len(here):  # hot users: each part of a list for itself
                j = max(i + 1, int(np.searchsorted(taken, (taken[i - 1] if i else 0) + PAIRS_HELD, "right")))
                some = here[i:j]
                i = j
                which = np.repeat(np.arange(len(some)), (end - start)[some])
                place = np.arange(len(which)) + np.repeat(start[some] - (np.cumsum((end - start)[some]) - (end - start)[some]), (end - start)[some])
                salt = salted(user[some][which], others[place])
                by = np.lexsort((others[place], salt, which))
                which, place, salt = which[by], place[by], salt[by]
                first = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(salt, prepend=-1) != 0))
                bounds = np.append(first, len(which))
                data, at = entries(bounds, others[place], theirs[0][place], theirs[1][place] if totals else None, form)
                text, skipped = data.tobytes(), at[first] + 1
                lists = [text[x:y] for x, y in zip(skipped.tolist(), at[bounds[1:]].tolist(), strict=True)]
                for k in range(0, len(first), ROWS_GIVEN):
                    s = first[k:k + ROWS_GIVEN]
                    yield rows(user[some][which[s]], salt[s], [v[some][which[s]] for v in own], others[place[s]], form, lists[k:k + ROWS_GIVEN])
    return run


def step_bytes(offsets: np.ndarray, user: np.ndarray) -> np.ndarray:
    """Bytes of the step of each entry of ``entries``."""
    step = np.diff(user, prepend=user[:1])
    step[offsets[:-1][np.diff(offsets) > 0]] = 0
    size, rest = np.ones(len(step), np.int64), step.view(np.uint64) >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest = rest >> np.uint64(7)
    return size


def _listed(batch: pa.RecordBatch, totals: bool, real: bool):
    """(row, b, measure, total) of every entry of the rows' lists."""
    forms, firsts = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("form", "first"))
    lists, out = batch.column(batch.schema.get_field_index("list")), []
    for form in np.unique(forms).tolist():
        here = np.flatnonzero(forms == form)
        some = lists.take(pa.array(here))
        _, at, data = some.buffers()
        at = np.frombuffer(at, np.int32)[some.offset:some.offset + len(some) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        fields, after = 1 + (form != ONES) + totals, np.concatenate([[0], np.cumsum(data < 128)])[at]
        # a list has all fields of its entries but the first step
        size = (np.diff(after) + 1) // fields
        bounds = np.concatenate([[0], np.cumsum(size)])
        numbers = np.zeros(bounds[-1] * fields, np.uint64)
        given = np.ones(len(numbers), bool)
        given[bounds[:-1] * fields] = False
        numbers[given] = read(data)
        numbers = numbers.reshape(-1, fields)
        step, start = numbers[:, 0].view(np.int64), bounds[:-1]
        total = np.cumsum(step)  # wraps around, and back
        b = total - np.repeat(total[start] - firsts[here], size)
        if form == ONES:
            measure = np.ones(len(b), np.float64 if real else np.int64)
        elif form == WHOLE:
            measure = unfolded(numbers[:, 1]).astype(np.float64 if real else np.int64)
        else:
            measure = np.ascontiguousarray(numbers[:, 1]).view(np.float64)
        out.append((np.repeat(here, size), b, measure, unfolded(np.ascontiguousarray(numbers[:, -1])) if totals else None))
    if len(out) == 1:
        return out[0]
    return tuple(None if out[0][i] is None else np.concatenate([o[i] for o in out]) for i in range(4))


def _summed(names: list[str], real: bool, product: str):
    """Rows of ``_packed`` in the order of (a, salt) -> (a, b, [n_a, n_b,] sum of the products of their measures)."""
    totals = len(names) > 1

    def pairs(batch):
        row, b, measure, n = _listed(batch, totals, real)
        a, own = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("a", f"{names[0]}_a"))
        value, salt = own[row] * measure, np.asarray(batch.column(batch.schema.get_field_index("_salt")))[row]
        keys = [b, salt, a[row]]
        if totals:
            mine = np.asarray(batch.column(batch.schema.get_field_index("n_a")))[row]
            keys = [n, mine, *keys]
        by = np.lexsort(keys)
        keys = [k[by] for k in keys]
        new = np.zeros(len(by), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(value[by], first) if len(first) else value[:0]
        cells = {"a": keys[-1][first], "b": keys[-3][first]}
        if totals:
            cells |= {"n_a": keys[1][first], "n_b": keys[0][first]}
        whole = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (cells | {product: sums}).items()})
        yield from (whole.slice(i, ROWS_GIVEN) for i in range(0, whole.num_rows, ROWS_GIVEN))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("list")).nbytes
            if size >= PAIRS_HELD * 4:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                a = np.asarray(whole.column(0))
                salt = np.asarray(whole.column(1))
                # all but the last user (and part of it), of which more may come
                done = int(np.flatnonzero((a != a[-1]) | (salt != salt[-1]))[-1]) + 1 if ((a != a[-1]) | (salt != salt[-1])).any() else 0
                yield from parted(whole.slice(0, done))
                held, size = [whole.slice(done)], whole.slice(done).column(whole.schema.get_field_index("list")).nbytes
        if held:
            yield from parted(pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0])

    def parted(rows):
        """Runs of whole users with about ``PAIRS_HELD`` bytes of lists each."""
        if not rows.num_rows:
            return
        a, salt = np.asarray(rows.column(0)), np.asarray(rows.column(1))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])]))
        lists = rows.column(rows.schema.get_field_index("list"))
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)
        taken, i, bounds = at[starts] - at[0], 0, np.append(starts, len(a))
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(taken, taken[i] + PAIRS_HELD * 4, "left")))
            yield from pairs(rows.slice(int(bounds[i]), int(bounds[j] - bounds[i])))
            i = j
    return run
