"""Line ranges of patches, for many patches at a time, with numpy and Arrow.

A patch comes as one character per line, ``@`` where a hunk begins, and the first lines of its hunks.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HUNK, INSERTED, REMOVED, CONTEXT = (ord(c) for c in "@+- ")


def ranges_of(keys, kinds):
    """For ``mapInArrow``: rows (*keys, olds, news, kinds), all of a key beside each other, to rows (*keys, kind, ranges).

    Rows of a key are one version, whose ranges join where one continues another.  The last key of a
    batch waits for the next one, which may have more of it.
    """

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks()
            if not table.num_rows:
                continue
            group = _groups(table, keys)
            last = int(np.searchsorted(group, group[-1]))
            waiting = table.slice(last)
            if last:
                yield from _solved(table.slice(0, last), group[:last], keys, kinds)
        if waiting is not None:
            yield from _solved(waiting, np.zeros(waiting.num_rows, np.int64), keys, kinds)

    return run


def _groups(table, keys):
    """A number for each row that grows where the key differs from the row before; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        one, two = column.slice(1), column.slice(0, len(column) - 1)
        nulls = pc.xor(one.is_null(), two.is_null())
        new[1:] |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False) | nulls.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _lists(column):
    """Values (0 for null), whether they are there, and where each row's begin and end."""
    column = column.combine_chunks()
    values, offsets = column.values, column.offsets.to_numpy()
    return pc.fill_null(values, 0).to_numpy(), values.is_valid().to_numpy(zero_copy_only=False), offsets


def _bytes(column):
    """All bytes of a text column and where each row's begin and end."""
    column = pc.cast(column.combine_chunks(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    chars = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return chars[offsets[0] : offsets[-1]], offsets - offsets[0]


def _solved(table, group, keys, kinds):
    chars, ends = _bytes(table.column("kinds"))
    if not len(chars):
        return
    # Runs of equal characters.  Every text begins with a hunk, so none goes on from text to text but that of hunks.
    first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    length, kind = np.diff(np.append(first, len(chars))), chars[first]
    kept = (kind == INSERTED) | (kind == REMOVED) | (kind == CONTEXT)
    first, length, kind = first[kept], length[kept], kind[kept]
    hunks = np.cumsum(chars == HUNK)
    row = np.searchsorted(ends, first, side="right") - 1
    before = np.concatenate(([0], hunks))[ends[:-1]]
    nth = hunks[first] - 1 - before[row]

    own = group[row]
    if group[-1] - group[0] + 1 < len(group):
        # Rows of one key are read side by side: run by run of the same hunk.
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (nth[1:] != nth[:-1])))
        at = np.arange(len(row))
        run = at - np.maximum.accumulate(np.where(fresh, at, 0))
        order = np.lexsort((run, nth, own))
        length, kind, row, nth, own = (x[order] for x in (length, kind, row, nth, own))
    fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (nth[1:] != nth[:-1])))[: len(own)]
    begins = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))

    def passed(skipped):
        sums = np.concatenate(([0], np.cumsum(np.where(kind == skipped, 0, length))))[: len(own)]
        return sums - sums[begins]

    def placed(column, step):
        values, there, offsets = _lists(table.column(column))
        at = offsets[row] + nth
        known = at < offsets[row + 1]
        at = np.where(known, at, 0)
        if not len(values):
            return step, known
        return values[at] + step, known & there[at]

    old, old_known = placed("olds", passed(INSERTED))
    new, new_known = placed("news", passed(REMOVED))
    added = kind == INSERTED
    begin, known = np.where(added, new, old), np.where(added, new_known, old_known)
    changed = kind != CONTEXT
    begin, known, length, kind, row, own = (x[changed] for x in (begin, known, length, kind, row, own))
    if not len(begin):
        return
    begin = np.where(known, begin, 0)
    end = begin + length - 1
    order = np.lexsort((end, begin, known, kind, own))
    begin, end, known, kind, row, own = (x[order] for x in (begin, end, known, kind, row, own))
    goes_on = (own[1:] == own[:-1]) & (kind[1:] == kind[:-1]) & known[1:] & known[:-1] & (begin[1:] == end[:-1] + 1)
    start = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    stop = np.append(start[1:], len(begin)) - 1
    absent = ~known[start]
    begin, end, kind, row, own = begin[start], end[stop], kind[start], row[start], own[start]
    # A list for each kind of a change.
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]))))
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64(), mask=absent) for x in (begin, end)], ["begin", "end"])
    columns = [table.column(k).combine_chunks().take(pa.array(row[head])) for k in keys]
    columns.append(pa.array(np.where(kind[head] == INSERTED, *kinds).astype(object), pa.string()))
    columns.append(pa.ListArray.from_arrays(pa.array(np.append(head, len(begin)), pa.int32()), each))
    yield from pa.table(columns, names=[*keys, "kind", "ranges"]).to_batches()
