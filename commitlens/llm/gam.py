"""A quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins at quantiles.  Cyclic boosting visits one feature after the
other, fits a shallow tree (a few cuts of the binned feature, Newton steps of the log
loss) and adds it to the feature's lookup table; the pairs that best explain what is
left get two-dimensional tables the same way.  A score is a sum of table entries, so
scoring is one addition per feature and pair over whole batches.

The model is fitted on at most ``SAMPLE`` labelled rows (a documented bound: a uniform
sample by hash where there are more); features, bins and scores are computed for every
document.  Null and empty texts have features of zero and get a score like any other.
Repeated rows get equal scores; rows without a label are scored, not learned from; of ties in id the least
text is learned from.  An empty table gives an empty one; only ids and texts are read, and ``accepted`` returns
all columns as they are, so other columns' names can't clash.  With no labelled rows, or labels of one kind, the model is the mean label (0.5 without any).
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from commitlens.llm import words as W

SAMPLE = 20_000
BINS = 64
ROUNDS = 150
RATE = 0.1
LEAVES = 4
PAIRS = 6
PAIR_BINS = 16
THRESHOLD = 0.3

FEATURES = (
    "words", "chars_per_word", "symbols_per_word", "upper", "marks_per_word", "digits", "pipes_per_word",
    "repeated_next", "distinct", "repeated_windows", "repeated_lines", "line_words", "punctuation_end", "long_words",
)


def _flags(characters):
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


def features(texts):
    """One row of FEATURES per text."""
    w = W.Words(texts)
    data, docs, n = w.data, len(w.counts), len(w.starts)
    count = np.maximum(w.counts, 1)
    size = np.maximum(np.diff(w.begin), 1)
    hashes = w.hashes()
    own = W.mix(w.doc.astype(np.uint64) + np.uint64(1))

    def words_where(flag):
        return np.bincount(w.doc[flag], minlength=docs)

    again, later = W.repeated(hashes ^ own)
    at, keys = w.windows(hashes, 4)
    twice, _ = W.repeated(keys ^ own[at])
    same = np.zeros(n, dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    begin = np.unique(np.concatenate([w.begin[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    stops = np.append(begin, len(data))[1:]
    stops = stops - (data[stops - 1] == 10)
    full = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begin)
    begin, stops = begin[full], stops[full]
    line_doc = np.searchsorted(w.begin, begin, side="right") - 1
    with np.errstate(over="ignore"):
        c, inverse = W.prefix_hashes(W.mix(np.arange(1, 257, dtype=np.uint64))[data], W.BYTE_BASE)
        lines = W.mix((c[stops] - c[begin]) * inverse[begin] + (stops - begin).astype(np.uint64))
    _, line_later = W.repeated(lines ^ W.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    n_lines = np.maximum(np.bincount(line_doc, minlength=docs), 1)
    length = w.ends - w.starts
    columns = [
        np.log1p(w.counts),
        w.per_doc((data & 0xC0) != 0x80) / count,
        w.per_doc(_flags(b"#*$%&<>@~^=+_\\")[data]) / count,
        w.per_doc((data >= 65) & (data <= 90)) / size,
        w.per_doc(_flags(b"!?")[data]) / count,
        w.per_doc((data >= 48) & (data <= 57)) / size,
        w.per_doc(data == 124) / count,
        words_where(same) / count,
        1 - words_where(later) / count,
        words_where(W.covered(n, at[twice], 4)) / count,
        np.bincount(line_doc[line_later], minlength=docs) / n_lines,
        np.log1p(w.counts / n_lines),
        w.per_doc(_flags(b".,;:")[data]) / count,
        words_where(length > 15) / count,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """``cuts`` per feature; ``tables`` per feature; ``pairs`` of (i, j, cuts_i, cuts_j, table)."""

    bias: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def raw(self, x):
        total = np.full(len(x), self.bias)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, i], side="right")]
        for i, j, cuts_i, cuts_j, table in self.pairs:
            total += table[np.searchsorted(cuts_i, x[:, i], side="right"), np.searchsorted(cuts_j, x[:, j], side="right")]
        return total

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(x, bins):
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(grad, hess, leaves, ridge=1.0):
    """Newton steps of the best piecewise-constant function with ``leaves`` pieces, grown greedily."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def gain(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    pieces = [(0, len(grad))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(pieces):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gains = gain(a, cut) + gain(cut, b) - gain(a, b)
            top = int(np.argmax(gains))
            if gains[top] > best[0]:
                best = (gains[top], k, int(cut[top]))
        if best[1] is None:
            break
        a, b = pieces[best[1]]
        pieces[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in pieces:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x, y, rounds=ROUNDS, rate=RATE, pairs=PAIRS):
    """Cyclic boosting of single features, then of the pairs with the largest gain."""
    y = np.asarray(y, dtype=float)
    mean = y.mean() if len(y) else 0.5
    if not len(y) or mean in (0.0, 1.0):
        return Model(bias=float(np.log((mean * len(y) + 0.5) / ((1 - mean) * len(y) + 0.5))))
    model = Model(bias=float(np.log(mean / (1 - mean))))
    model.cuts = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    total = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[i])
            step = rate * _shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size), LEAVES)
            model.tables[i] += step
            total += step[b]

    coarse = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]
    g, h = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            b = cells[i] * shape[1] + cells[j]
            gg, hh = np.bincount(b, g, shape[0] * shape[1]), np.bincount(b, h, shape[0] * shape[1])
            found.append(((gg**2 / (hh + 5)).sum(), i, j))
    chosen = [(i, j) for _, i, j in sorted(found, reverse=True)[:pairs]]
    tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(rounds // 5):
        for (i, j), table in zip(chosen, tables):
            g, h = slopes()
            b = cells[i] * table.shape[1] + cells[j]
            gg, hh = np.bincount(b, g, table.size), np.bincount(b, h, table.size)
            # A tree over the first feature whose leaves are trees over the second.
            rows = _leaves(gg.reshape(table.shape).sum(1), hh.reshape(table.shape).sum(1))
            step = np.zeros(table.shape)
            for a, z in rows:
                step[a:z] = _shallow_tree(gg.reshape(table.shape)[a:z].sum(0), hh.reshape(table.shape)[a:z].sum(0), 3, 5.0)
            table += rate * step
            total += rate * step.ravel()[b]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, tables)]
    return model


def _leaves(grad, hess):
    steps = _shallow_tree(grad, hess, 3)
    edges = np.flatnonzero(np.diff(steps)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(grad)]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of labelled documents that are not held out: all of them, or about ``sample`` by hash."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isNotNull() & F.col("_id").isNotNull()
    )
    named = named.groupBy("_id").agg(F.max("y").alias("y")).filter(~held_out("_id"))
    total = named.count()
    if total > sample:
        named = named.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # At most about ``sample`` ids of two numbers: small enough to broadcast, so no text is shuffled.
    # Rows with one id, however many, are one example: the one with the least text.
    found = texts.join(F.broadcast(named), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def quality_model(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Model:
    def measure(part):
        x = features(part["text"]).astype(np.float64)
        return {"doc_id": part["doc_id"], "y": part["y"], "x": pa.array(list(x), pa.list_(pa.float64()))}

    rows = W.map_texts(
        training_rows(docs, labels, "quality", held_out, sample), ["doc_id", "text", "y"], "text",
        W.schema("doc_id bigint, y int, x array<double>"), measure,
    ).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows.y.to_numpy(float))


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    def measure(part):
        return {**part, name: model.score(features(part["text"]))}

    return W.map_texts(docs, docs.columns, "text", StructType([*docs.schema.fields, StructField(name, DoubleType())]), measure)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    return _scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model, "score").drop("text")


def accepted(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``least`` or more."""
    name = W.unused(docs, "_score")
    return _scored(docs, model, name).filter(F.col(name) >= least).drop(name)
