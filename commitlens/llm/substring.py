"""Removal of passages that also start in an earlier document, by FM-indexes over shards.

A window is ``WINDOW`` consecutive words.  Comparing every document with every shard would
grow with the square of the corpus, so text is dealt to shards by content: the least
``GRAM``-word hash of a window is its anchor, consecutive windows with one anchor form a
segment, and all segments of an anchor go to one shard.  Equal windows have equal anchors
and so meet.

1. Every task sends (anchor, segment hash, doc_id) to the anchor's shard.
2. A shard drops anchors of one document only and groups equal segments into classes; the
   earliest document of a class is asked for the class's words.
3. A shard builds a compressed FM-index (suffix order to 16 words, Burrows-Wheeler
   transform in a wavelet matrix of packed bits) over its classes and streams them through it:
   backward search gives every window's interval, and the least doc_id in it.
4. Documents get back which windows of their segments start earlier, and lose those words.

Hot grams, those in over ``HOT_SHARE`` of a bounded sample of documents, are taken as
anchors only where a window has no other, so varied texts around a common line don't meet
in one shard.  Windows of hot grams alone are their own segments, sent once per task and
not once per document: a shard names their earliest document, and all others lose them.
The sample decides how text is dealt, never what is found.

A null or empty text has no words.  A document with a null id keeps all its words and is no
document's predecessor.  Rows with the same id (ties, repeated rows) never remove words from one another.  An empty
table gives an empty one.  Only ids and texts are read, and ``cleaned`` returns all columns, so other columns' names can't clash.  Text is
compared by 64-bit hashes of words.  Tasks are bounded by the number of shards
(``SHARDS`` per shuffle partition) and by one document.
"""

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from commitlens.llm import words as W
from commitlens.session import cut

WINDOW = 13
GRAM = 5
SHARDS = 2
HOT_SHARE = 0.0025
HOT_SAMPLE = 20_000
FLUSH = 1_000_000
FIRST = 1 << 15

_U = np.uint64


def _pack(*arrays):
    return pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5)


def _unpack(blobs):
    """Blobs of equally many arrays, joined array by array."""
    return [np.concatenate(x) for x in zip(*[pickle.loads(b) for b in blobs])]


def _grams(w, hashes):
    at, g = w.windows(hashes, GRAM)
    every = np.full(len(w.starts), ~_U(0))
    every[at] = g
    return every


def segments(w, hashes, hot):
    """(first window, last window, anchor, segment hash, whether hot) of every segment of a ``Words``."""
    n = len(w.starts)
    at = np.flatnonzero(w.doc[: n - WINDOW + 1] == w.doc[WINDOW - 1 :]) if n >= WINDOW else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    gram = _grams(w, hashes)
    is_hot = np.zeros(n, dtype=bool)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
    order = (gram >> _U(1)) | (is_hot.astype(np.uint64) << _U(63))
    span = WINDOW - GRAM + 1
    least = order[at].copy()
    for k in range(1, span):
        np.minimum(least, order[at + k], out=least)
    place = np.zeros(len(at), dtype=np.int64)
    for k in range(span - 1, -1, -1):
        place[order[at + k] == least] = k
    place += at
    hot_window = is_hot[place]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | hot_window[1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    s, e = at[first], at[last]
    with np.errstate(over="ignore"):
        c, inverse = W.prefix_hashes(hashes, W.WORD_BASE)
        seg = W.mix((c[e + WINDOW] - c[s]) * inverse[s] + (e - s).astype(np.uint64))
    return s, e, gram[place[first]], seg, hot_window[first]


def _split(keys, parts, *arrays):
    """(part, arrays of the part) for rows dealt by key."""
    where = (W.mix(keys) % _U(parts)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[p] : bounds[p + 1]]
        yield int(p), [a[rows] for a in arrays]


def _slices_of(batches, *columns):
    for batch in batches:
        for start, stop in W.slices(batch.column("text")):
            yield [batch.column(c).slice(start, stop - start) for c in ("text", *columns)]


def hot_grams(docs: DataFrame, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Sorted hashes of grams in over HOT_SHARE of a sample of ``sample`` documents; at most
    the mean number of grams in a document over HOT_SHARE."""
    total = docs.count()

    def count(batches):
        kept, docs_seen = [], 0
        for (text,) in _slices_of(batches):
            w = W.Words(text)
            at, g = w.windows(w.hashes(), GRAM)
            _, once = np.unique(g ^ W.mix(w.doc[at].astype(np.uint64) + _U(1)), return_index=True)
            u, c = np.unique(g[once], return_counts=True)
            docs_seen += len(text)
            kept.append((u[c > 1], c[c > 1]))
        if kept:
            g, inverse = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([x for _, x in kept]), minlength=len(g)).astype(np.int64)
            few = n > HOT_SHARE / 2 * docs_seen
            yield pa.RecordBatch.from_arrays([pa.array(g[few].view(np.int64)), pa.array(n[few])], names=["gram", "n"])

    chosen = docs.select("text").sample(min(1.0, sample / max(total, 1)), seed=11)
    found = (
        chosen.mapInArrow(count, "gram bigint, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_SHARE * min(total, sample))
    )
    return np.sort(np.array([r.gram for r in found.collect()], dtype=np.int64).view(np.uint64))


def _entries(docs, shards, hot):
    """(shard, blob) of anchor, segment, doc_id and hot flag."""

    def run(batches):
        held, size = [], 0

        def flush():
            anchor, seg, doc, is_hot = [np.concatenate(x) for x in zip(*held)]
            # Of hot windows the earliest document of this task is enough.
            order = np.lexsort((doc, seg, anchor))
            anchor, seg, doc, is_hot = anchor[order], seg[order], doc[order], is_hot[order]
            same = np.zeros(len(seg), dtype=bool)
            same[1:] = (seg[1:] == seg[:-1]) & (anchor[1:] == anchor[:-1]) & (is_hot[1:] | (doc[1:] == doc[:-1]))
            keep = ~same
            for p, part in _split(anchor[keep], shards, anchor[keep], seg[keep], doc[keep], is_hot[keep]):
                yield p, _pack((part[0] >> _U(32)).astype(np.uint32), *part[1:])

        def batch(rows):
            p, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(b, pa.binary())], names=["shard", "blob"])

        for text, ids in _slices_of(batches, "doc_id"):
            w = W.Words(text)
            s, _, anchor, seg, is_hot = segments(w, w.hashes(), hot)
            known = np.asarray(ids.is_valid())[w.doc[s]]
            doc = np.asarray(ids.fill_null(0))[w.doc[s]]
            held.append((anchor[known], seg[known], doc[known], is_hot[known]))
            size += int(known.sum())
            if size >= FLUSH:
                yield batch(list(flush()))
                held, size = [], 0
        if size:
            yield batch(list(flush()))

    return docs.mapInArrow(run, "shard int, blob binary")


def _classes(shards):
    """A shard's entries to its classes (kind 0) and to requests for their words (kind 1, by document)."""

    def run(table):
        anchor, seg, doc, is_hot = _unpack(table.column("blob").to_pylist())
        order = np.lexsort((doc, seg, anchor))
        anchor, seg, doc, is_hot = anchor[order], seg[order], doc[order], is_hot[order]
        a = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        wanted = (np.minimum.reduceat(doc, a) != np.maximum.reduceat(doc, a)) | np.maximum.reduceat(is_hot, a)
        keep = np.repeat(wanted, np.diff(np.append(a, len(anchor))))
        anchor, seg, doc, is_hot = anchor[keep], seg[keep], doc[keep], is_hot[keep]
        rows = []
        shard = int(table.column("shard")[0].as_py())
        if len(seg):
            new = np.append(True, (seg[1:] != seg[:-1]) | (anchor[1:] != anchor[:-1]))
            c = np.flatnonzero(new)
            count = np.diff(np.append(c, len(seg)))
            hot_class = is_hot[c]
            member = ~np.repeat(hot_class, count)
            rows.append((0, shard, _pack(seg[c], np.where(hot_class, 0, count).astype(np.uint32), doc[c], doc[member])))
            for p, (d, s) in _split(doc[c].view(np.uint64), shards, doc[c], seg[c]):
                rows.append((1, p, _pack(d, s, np.full(len(d), shard, dtype=np.uint32))))
        return pa.table(
            {n: pa.array(x, t) for n, x, t in zip(("kind", "place", "blob"), zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int32(), pa.binary()))}
        )

    return run


def _by_document(table):
    """Blobs (doc_id, ...) of one place to one row per document."""
    arrays = _unpack(table.column("blob").to_pylist())
    order = np.argsort(arrays[0], kind="stable")
    arrays = [a[order] for a in arrays]
    first = np.flatnonzero(np.append(True, arrays[0][1:] != arrays[0][:-1])) if len(order) else order
    ends = np.append(first[1:], len(order))
    blobs = [_pack(*[x[i:j] for x in arrays[1:]]) for i, j in zip(first, ends)]
    return pa.table({"id": pa.array(arrays[0][first]), "blob": pa.array(blobs, pa.binary())})


def _match(w_doc, seg, asked_doc, asked):
    """For each asked (document, hash) pair: a segment with it, or -1."""
    key = seg ^ W.mix(w_doc.astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    want = asked ^ W.mix(asked_doc.astype(np.uint64) + _U(1))
    at = np.minimum(np.searchsorted(key[order], want), max(len(key) - 1, 0))
    return np.where(key[order][at] == want, order[at], -1) if len(key) else np.full(len(want), -1)


def _asked(blobs):
    """Per-document blobs to (row number, arrays)."""
    rows, parts = [], []
    for i, b in enumerate(blobs.to_pylist()):
        if b is not None:
            arrays = pickle.loads(b)
            rows.append(np.full(len(arrays[0]), i))
            parts.append(arrays)
    return [np.concatenate(rows), *[np.concatenate(x) for x in zip(*parts)]] if rows else None


def _words_of_classes(joined, hot):
    """Requested segments as (shard, blob) of segment hash, length and word hashes."""

    def run(batches):
        held, size = [], 0

        def flush():
            shard, seg, length, word = [np.concatenate(x) for x in zip(*held)]
            start = np.cumsum(length) - length
            p, b = [], []
            order = np.argsort(shard, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                at = np.repeat(start[rows], length[rows]) + _ramp(length[rows])
                p.append(int(shard[rows[0]]))
                b.append(_pack(seg[rows], length[rows], word[at]))
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(b, pa.binary())], names=["shard", "blob"])

        for text, blobs in _slices_of(batches, "blob"):
            asked = _asked(blobs)
            if asked is None:
                continue
            w = W.Words(text)
            hashes = w.hashes()
            s, e, _, seg, _ = segments(w, hashes, hot)
            row, want, shard = asked
            found = _match(w.doc[s], seg, row, want)
            want, shard, found = want[found >= 0], shard[found >= 0], found[found >= 0]
            length = (e[found] - s[found] + WINDOW).astype(np.int64)
            at = np.repeat(s[found], length) + _ramp(length)
            held.append((shard, want, length, hashes[at]))
            size += int(length.sum())
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return joined.mapInArrow(run, "shard int, blob binary")


def _ramp(lengths):
    """0..n-1 for every n of ``lengths``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class FMIndex:
    """Backward search over texts of integer symbols from 1, each text ended by a 0.

    Suffixes are ordered by their first 16 symbols, enough for patterns up to 16.  The
    transform is a wavelet matrix: one packed bit vector per bit of a symbol with counts
    per 64 bits.  ``seed`` symbols are looked up by their rank, the rest is searched.
    """

    SEED = 8

    def __init__(self, text):
        n = len(text)
        rank, depth = text.astype(np.int64), 1
        while depth < 16:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - depth] = rank[depth:]
            key = rank * (int(rank.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            depth *= 2
            if depth == self.SEED:
                self.seed_rank = rank
        self.text, self.order = text, order
        self.seed_from = np.concatenate([[0], np.cumsum(np.bincount(self.seed_rank))])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        symbols = len(self.before) - 1
        self.levels = []
        x = text[order - 1]
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (x >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, counts, n - int(ones.sum())))
            x = np.concatenate([x[~ones], x[ones]])
        every = np.arange(symbols)
        self.begin = np.zeros(symbols, dtype=np.int64)
        self.begin = self._down(every, self.begin)

    def _down(self, symbol, i):
        for bit, packed, counts, zeros in self.levels:
            word = i >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1)))
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def search(self, at, k):
        """Intervals of the suffix order that start with the ``k`` symbols from each place of the text.

        A place whose interval has shrunk to itself is not searched on.
        """
        seed = self.seed_rank[at + k - self.SEED]
        low, high = self.seed_from[seed], self.seed_from[seed + 1]
        for step in range(k - self.SEED - 1, -1, -1):
            live = np.flatnonzero(high - low > 1)
            symbol = self.text[at[live] + step]
            shift = self.before[symbol] - self.begin[symbol]
            low[live] = self._down(symbol, low[live]) + shift
            high[live] = self._down(symbol, high[live]) + shift
        return low, high


def earliest(words, lengths, docs):
    """For texts of word hashes with one doc_id each: the least doc_id over all texts that
    hold a window, for every window of every text in order."""
    _, ids = np.unique(words, return_inverse=True)
    start = np.cumsum(lengths) - lengths
    text = np.zeros(len(words) + len(lengths), dtype=np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = ids + 1
    begin = start + np.arange(len(lengths))
    count = lengths - WINDOW + 1
    at = np.repeat(begin, count) + _ramp(count)
    own = np.repeat(docs, count)
    index = FMIndex(text)
    low, high = index.search(at, WINDOW)
    doc_of = np.repeat(docs, lengths + 1)[index.order]
    shared = np.flatnonzero(high - low > 1)
    u, first, back = np.unique(low[shared], return_index=True, return_inverse=True)
    out = own.copy()
    if len(u):
        edges = np.stack([u, high[shared][first]], axis=1).ravel()
        out[shared] = np.minimum.reduceat(np.append(doc_of, doc_of[-1]), edges)[::2][back]
    return out


def _found(shards):
    """A shard's classes and their words to (place, blob) of doc_id, segment hash and the windows that start earlier."""

    def run(table):
        kinds = np.asarray(table.column("kind"))
        blobs = table.column("blob").to_pylist()
        given = [b for k, b in zip(kinds, blobs) if k == 2]
        rows = []
        if given:
            seg, count, least, member = _unpack([b for k, b in zip(kinds, blobs) if k == 0])
            name, length, word = _unpack(given)
            # One text per class, in the order of the classes.
            place = {x: i for i, x in enumerate(name.tolist())}
            pick = np.array([place[x] for x in seg.tolist()], dtype=np.int64)
            start = np.cumsum(length) - length
            length = length[pick]
            word = word[np.repeat(start[pick], length) + _ramp(length)]
            first = earliest(word, length, least)
            windows = length - WINDOW + 1
            upto = np.cumsum(windows) - windows
            # Members of a class: window j of theirs starts earlier if its least document is less.
            owner = np.repeat(np.arange(len(seg)), count)
            each = windows[owner]
            j = _ramp(each)
            bit = (first[np.repeat(upto[owner], each) + j] < np.repeat(member, each)).astype(np.int64) << j
            total = np.concatenate([[0], np.cumsum(bit)])
            ends = np.cumsum(each)
            mask = (total[ends] - total[ends - each]).astype(np.uint16)
            hot = np.flatnonzero(count == 0)
            doc = np.concatenate([member[mask > 0], first[upto[hot]]])
            names = np.concatenate([seg[owner][mask > 0], seg[hot]])
            mask = np.concatenate([mask[mask > 0], np.full(len(hot), FIRST, dtype=np.uint16)])
            for p, part in _split(doc.view(np.uint64), shards, doc, names, mask):
                rows.append((p, _pack(*part)))
        return pa.table(
            {n: pa.array(x, t) for n, x, t in zip(("place", "blob"), zip(*rows) if rows else ((), ()), (pa.int32(), pa.binary()))}
        )

    return run


def _removal(hot, carried):
    def measure(part):
        w = W.Words(part["text"])
        s, e, _, seg, is_hot = segments(w, w.hashes(), hot)
        known = np.asarray(part["doc_id"].is_valid())[w.doc[s]] if len(s) else np.zeros(0, bool)
        mask = np.zeros(len(s), dtype=np.int64)
        asked = _asked(part["blob"])
        if asked is not None:
            row, names, masks = asked
            # A hash may stand at several places of a document: look segments up in the answers.
            found = _match(row, names, w.doc[s], seg)
            mask[found >= 0] = masks[found[found >= 0]]
        mask[is_hot] = np.where(mask[is_hot] == FIRST, 0, 1)
        mask[~known] = 0
        hit = np.zeros(len(w.starts) + 1, dtype=bool)
        for j in range(WINDOW - GRAM + 1):
            hit[s[(mask >> j & 1) > 0] + j] = True
        gone = W.covered(len(w.starts), np.flatnonzero(hit), WINDOW)
        removed = np.bincount(w.doc[gone], minlength=len(w.counts))
        kept, digests = [], []
        data = w.data.tobytes()
        for d, (i, j) in enumerate(zip(w.first[:-1], w.first[1:])):
            if removed[d]:
                rest = np.flatnonzero(~gone[i:j]) + i
                text = b" ".join([data[a:b] for a, b in zip(w.starts[rest], w.ends[rest])])
            else:
                text = b" ".join(data[w.begin[d] : w.begin[d + 1]].split())
            kept.append(text)
            digests.append(hashlib.sha256(text).hexdigest())
        return {
            **{c: part[c] for c in carried},
            "doc_id": part["doc_id"],
            "n_words": w.counts,
            "n_removed": removed,
            "kept_sha256": digests,
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return measure


def _removals(docs: DataFrame, carried, fields) -> DataFrame:
    spark = docs.sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bare = docs.select("doc_id", "text")
    hot = hot_grams(bare)
    plan = cut(
        _entries(bare, shards, hot).groupBy("shard").applyInArrow(_classes(shards), "kind int, place int, blob binary"),
        "classes",
    )
    requests = plan.filter("kind = 1").select("place", "blob").groupBy("place").applyInArrow(_by_document, "id bigint, blob binary")
    # The text is shuffled by doc_id once: as both joins keep all documents, they read the same exchange.
    asked = bare.join(requests, F.col("doc_id") == F.col("id"), "left").select("text", "blob")
    texts = _words_of_classes(asked, hot).select("shard", F.lit(2).alias("kind"), "blob")
    members = plan.filter("kind = 0").select(F.col("place").alias("shard"), "kind", "blob")
    answers = (
        members.union(texts)
        .groupBy("shard").applyInArrow(_found(shards), "place int, blob binary")
        .groupBy("place").applyInArrow(_by_document, "id bigint, blob binary")
    )
    joined = docs.join(answers, F.col("doc_id") == F.col("id"), "left")
    return W.map_texts(joined, ["doc_id", "text", *carried, "blob"], "text", fields, _removal(hot, ["text", *carried]))


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document: ``kept`` are the
    words that no window of an earlier document covers, joined by one space."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _removals(docs, [], W.schema(RESULT))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the repeated words; a changed text is its
    kept words joined by one space with ``n_chars``, if there, to match, and documents of which
    nothing is left go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = ["_rest"] if rest else []
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([F.struct(*rest).alias("_rest")] if rest else []))
    fields = StructType([*W.schema(RESULT).fields, packed.schema["text"], *([packed.schema["_rest"]] if rest else [])])
    done = _removals(packed, carried, fields).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    changed = F.col("n_removed") > 0
    columns = {c: F.col(f"_rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(changed, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[columns[c].alias(c) for c in docs.columns])
