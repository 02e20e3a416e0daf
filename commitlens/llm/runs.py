"""Periodic runs of words by a sparse dynamic programme over diagonals.

A run is a stretch of words with smallest period q, of at least ``max(LEAST, TIMES * q)`` words,
that neither neighbour extends.  On the diagonal of lag q it is an unbroken stretch of matches:
word i equals word i - q.  Each word's earlier occurrences lengthen the match of their lags by
one; a diagonal that ends with sufficient length is a run.

So that a hot word costs no square of its count, lags are taken in tiers [h, 2h), h a power of two,
and a tier's words are blocks of h words.  A run of the tier matches along at least (TIMES - 1) * h
words and so along two or more blocks that begin at multiples of h.  Only these look up their earlier
occurrences, at most h of them each, so a tier costs at most one step a word, and a text of n
words n log n in all, whatever repeats.  A match of blocks that ends is carried to its exact ends
by halves, quarters and so on of a block, whose names the lower tiers know.  Names of blocks are exact
(numbers of pairs of halves, no hashes).  Texts none of whose blocks repeats leave the higher tiers.

A stretch found at several multiples of its period is reported once, with the smallest.

Null and empty texts have no words and no runs.  Texts are read whole; memory follows ``words.CHUNK`` bytes
of text or the longest text, times the number of tiers.  Repeated rows give repeated results, an empty
table an empty one.  A null id stays null.  Other columns are left behind, so their names can't clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W

#: Fewest words of a run, and fewest periods.
LEAST = 6
TIMES = 4


def find_runs(codes, counts):
    """(start, length, period) of every run, by start and period, in texts of ``counts`` words that are
    laid end to end as word numbers; starts count from the first text's first word."""
    codes = np.asarray(codes, np.int64)
    counts = np.asarray(counts, np.int64)
    first = np.cumsum(counts) - counts
    begin, stop = np.repeat(first, counts), np.repeat(first + counts, counts)
    names, found, h = [codes], [], 1
    active = np.flatnonzero(np.repeat(counts >= max(LEAST, TIMES), counts))
    while len(active):
        if h > 1:
            active = active[active + h <= stop[active]]
            name = np.full(len(codes), -1, np.int64)
            half = names[-1]
            pairs = half[active] * (len(codes) + 1) + half[active + h // 2]
            name[active] = np.unique(pairs, return_inverse=True)[1]
            names.append(name)
        name = names[-1]
        order = active[np.argsort(name[active], kind="stable")]
        again = (name[order[1:]] == name[order[:-1]]) & (begin[order[1:]] == begin[order[:-1]])
        found.append(_tier(names, order, h, begin, stop))
        repeats = np.zeros(len(codes) + 1, bool)
        repeats[begin[order[1:][again]]] = True
        h *= 2
        active = active[repeats[begin[active]] & (stop[active] - begin[active] >= TIMES * h)]
    start, length, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _tier(names, order, h, begin, stop):
    """Runs of lags h to 2h - 1; ``order`` has the positions of blocks by name and place."""
    name, n = names[-1], len(begin) + 1
    key = name[order] * n + order
    at = order[(order - begin[order]) % h == 0]
    here = name[at] * n
    low = np.searchsorted(key, here + np.maximum(at - 2 * h + 1, begin[at]))
    high = np.searchsorted(key, here + np.maximum(at - h + 1, begin[at]))
    seen = np.maximum(high - low, 0)
    at, from_ = np.repeat(at, seen), np.repeat(low - (np.cumsum(seen) - seen), seen)
    lag = at - order[from_ + np.arange(len(at))]
    along = np.lexsort((at, lag))
    at, lag = at[along], lag[along]
    # Blocks that follow one another on a diagonal make its match longer; one that doesn't begins another.
    fresh = np.ones(len(at), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + h)
    heads = np.flatnonzero(fresh)
    blocks = np.diff(np.append(heads, len(at)))
    heads, blocks = heads[blocks > 1], blocks[blocks > 1]
    lag, left = lag[heads], at[heads]
    right = left + blocks * h
    home, end = begin[left], stop[left]
    for k in range(len(names) - 2, -1, -1):
        step, part = 1 << k, names[k]
        to = left - step
        more = np.flatnonzero(to - lag >= home)
        more = more[part[to[more]] == part[to[more] - lag[more]]]
        left[more] -= step
        more = np.flatnonzero(right + step <= end)
        more = more[part[right[more]] == part[right[more] - lag[more]]]
        right[more] += step
    start, length = left - lag, right - left + lag
    long = length >= np.maximum(LEAST, TIMES * lag)
    return start[long], length[long], lag[long]


def runs(docs: DataFrame, rewrite=None, carry=()) -> DataFrame:
    """(doc_id, carried columns, n_words, runs, collapsed) of every text.

    ``runs`` are structs (start, length, period) by start and period; ``collapsed`` is the text's words, but
    those that stand in a run after its first period, joined by one space.  ``rewrite(doc_id, n)`` may
    give the numbers of the words that are to be read instead of 0..n-1, or None.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def measure(part):
        ids = part["doc_id"].to_pylist()
        texts = [t.split() for t in W._binary(part["text"]).to_pylist()]
        if rewrite:
            for k, (i, words) in enumerate(zip(ids, texts)):
                places = rewrite(i, len(words))
                if places is not None:
                    texts[k] = [words[p] for p in places.tolist()]
        counts = np.array([len(t) for t in texts], np.int64)
        flat = pa.array([x for t in texts for x in t], pa.binary())
        start, length, period = find_runs(flat.dictionary_encode().indices.to_numpy(), counts)
        first = np.append(0, np.cumsum(counts))
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.cumsum(change)[:-1] == 0
        whole = np.logical_and.reduceat(np.append(kept, True), np.minimum(first[:-1], len(kept))) | (counts == 0) if len(counts) else []
        joined = [
            b" ".join(t if w else [x for x, k in zip(t, kept[a : a + len(t)].tolist()) if k]) for t, w, a in zip(texts, whole, first.tolist())
        ]
        own = np.searchsorted(first[1:], start, side="right")
        ends = np.searchsorted(start, first)
        structs = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[own], length, period)], names=["start", "length", "period"])
        return {
            **part, "n_words": counts,
            "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs).cast(run_type),
            "collapsed": pa.array(joined, pa.binary()).cast(pa.string()),
        }

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    made = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return W.map_texts(docs, docs.columns, "text", W.schema(made, docs.drop("text").schema), measure)
