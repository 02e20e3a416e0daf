"""Words, lines and windows of whole texts as numpy arrays, for use inside tasks.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``.  Hashes are polynomials over
2**64 with prefix sums, so that the hash of any word or window costs a constant.
Memory is bounded by ``CHUNK`` bytes of text, or by one document if that is longer.
"""

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def mix(x):
    """Spread the bits of unsigned 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
        return x


def prefix_hashes(values, base):
    """``h(i, j) = (c[j] - c[i]) * inverse[i]`` hashes values i..j-1 whatever stands around them."""
    n = len(values)
    c = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), out=c[1:])
    return c, _powers(pow(base, -1, 1 << 64), n + 1)


def _powers(base, n):
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
        np.cumprod(p, out=p)
    return p


BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def slices(texts, limit=CHUNK):
    """Row ranges of an Arrow text column with at most ``limit`` bytes, or one row."""
    if not len(texts):
        return
    ends = np.cumsum(np.maximum(_lengths(texts), 1))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def _binary(texts):
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    return texts.cast(pa.large_binary()).fill_null(b"")


def _lengths(texts):
    texts = _binary(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.diff(offsets)


class Words:
    """``data`` bytes; ``begin`` byte offset per document; ``starts, ends`` per word;
    ``first`` word number per document; ``doc`` document number per word."""

    def __init__(self, texts):
        texts = _binary(texts)
        n = len(texts)
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        whole = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.begin = offsets - offsets[0]
        blank = np.zeros(256, dtype=bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        inside = np.concatenate([~blank[self.data], [False]])
        edge = np.zeros(len(inside), dtype=bool)
        edge[self.begin] = True
        before = np.concatenate([[False], inside[:-1]])
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero(before & (~inside | edge))
        self.first = np.searchsorted(self.starts, self.begin)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def hashes(self):
        """A 64-bit hash per word."""
        with np.errstate(over="ignore"):
            table = mix(np.arange(1, 257, dtype=np.uint64))
            c, inverse = prefix_hashes(table[self.data], BYTE_BASE)
            return mix((c[self.ends] - c[self.starts]) * inverse[self.starts])

    def windows(self, hashes, k):
        """First words and hashes of all windows of ``k`` words of one document."""
        at = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :]) if len(self.doc) >= k else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            c, inverse = prefix_hashes(hashes, WORD_BASE)
            return at, mix((c[at + k] - c[at]) * inverse[at])

    def per_doc(self, flags):
        """Sum a value per byte over each document."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.begin[1:]] - c[self.begin[:-1]]


def covered(n, at, k):
    """Which of ``n`` words lie in a window of ``k`` words that starts at one of ``at``."""
    d = np.zeros(n + 1, dtype=np.int32)
    d[at] = 1
    d[np.asarray(at, dtype=np.int64) + k] -= 1
    return np.cumsum(d)[:n] > 0


def repeated(keys):
    """Which keys occur twice or more; and which are not the first of their value."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    later = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def map_texts(df, columns, text, schema, measure):
    """Apply ``measure(columns) -> columns`` to row slices of bounded size.

    ``df``'s other columns are left behind before any work, so their names can't clash.
    """
    kinds = {f.name: _ARROW.get(f.dataType.simpleString()) for f in schema}

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column(columns.index(text))):
                part = {c: batch.column(i).slice(start, stop - start) for i, c in enumerate(columns)}
                got = measure(part)
                made = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=t) for n, t in kinds.items()]
                yield pa.RecordBatch.from_arrays(made, names=list(kinds))

    return df.select(*columns).mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def schema(ddl, before=None):
    """The schema that ``ddl`` names, behind the fields of ``before``."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*(before.fields if before else []), *_parse_datatype_string(ddl).fields])


def unused(df, name):
    """``name``, with underscores before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
