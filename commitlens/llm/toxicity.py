"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from labelled documents: words that occur far more in toxic documents
than in others, in documents marked toxic, are toxic tokens.  The field has two states,
hashed features of a word and its neighbours, and a transition matrix.  Forward-backward
marginals give every word's probability; a document's score is a logistic function of
their sum and maxima, fitted on the same documents, and spans of likely words are its
offsets.

The model is fitted on about ``SAMPLE`` toxic and ``CLEAN_SAMPLE`` other labelled documents
at most (documented bounds: samples by hash where there are more); two thirds of them name
the toxic words, ``FIELD_SAMPLE`` of each label train the field, and the last third fits the
document score.  Every whole text is scored.  Null and empty
texts have no words and get the score of no evidence.  Repeated rows get equal scores; of ties in id the
least text is learned from; a null id stays null.  An empty table gives an empty one.  Only ids and texts are
read, so other columns' names can't clash.
Without labels of both kinds the score is the share of toxic labels, 0 without any.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W

SAMPLE = 1500
CLEAN_SAMPLE = 4500
FIELD_SAMPLE = 400
BUCKETS = 1 << 22
LEAST_WEIGHT = 0.2
PREFIXES = (4, 5, 6, 7)
BLOCK = 64
STEPS = 40
THRESHOLD = 0.7

_U = np.uint64


def tokens(texts):
    """A ``Words``, hashes of each word in lower case without surrounding punctuation and of its
    PREFIXES in bytes, and its feature buckets."""
    w = W.Words(texts)
    data = w.data
    n = len(w.starts)
    letter = np.zeros(256, dtype=bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    lower = np.arange(256, dtype=np.int64)
    lower[65:91] += 32
    if not n:
        return w, np.zeros((0, 1 + len(PREFIXES)), np.uint64), np.zeros((0, 4 + len(PREFIXES)), np.int32)
    inside = np.flatnonzero(letter[data])
    a = np.searchsorted(inside, w.starts)
    b = np.searchsorted(inside, w.ends)
    some = b > a
    start, end = w.starts.copy(), w.ends.copy()
    start[some] = inside[a[some]]
    end[some] = inside[b[some] - 1] + 1
    with np.errstate(over="ignore"):
        c, inverse = W.prefix_hashes(W.mix(np.arange(1, 257, dtype=np.uint64))[lower[data]], W.BYTE_BASE)
        word = W.mix((c[end] - c[start]) * inverse[start])
        edge = np.append(True, w.doc[1:] != w.doc[:-1])
        before = np.where(edge, _U(0), np.append(_U(0), word[:-1]))
        after = np.where(np.append(edge[1:], True), _U(0), np.append(word[1:], _U(0)))
        shape = np.minimum(end - start, 12) + 16 * letter[data[w.starts]] + 32 * letter[data[w.ends - 1]]
        parts = [W.mix((c[np.minimum(start + k, end)] - c[start]) * inverse[start] + _U(k)) for k in PREFIXES]
        made = [word, *parts, W.mix(before + _U(1)), W.mix(after + _U(2)), W.mix(shape.astype(np.uint64) + _U(3 << 32))]
    return w, np.stack([word, *parts], axis=1), np.stack([(x % _U(BUCKETS)).astype(np.int32) for x in made], axis=1)


def _blocks(first, counts):
    """Documents cut into blocks of BLOCK words: word numbers (-1 beyond a block's end), and each
    document's blocks."""
    per_doc = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    begin = first[:-1][doc] + nth * BLOCK
    at = begin[:, None] + np.arange(BLOCK)
    at[at >= first[1:][doc][:, None]] = -1
    return at, nth


def _run(at, nth, odds, maps, start, backward):
    """Message ratios along every document by fractional maps ``r -> (a + b r) / (c + d r)``.

    Blocks are first composed to one map each, then entered in order, then walked through.
    """
    a, b, c, d = maps
    order = range(BLOCK - 1, -1, -1) if backward else range(BLOCK)
    blocks = len(at)
    whole = [np.zeros(blocks), np.ones(blocks), np.ones(blocks), np.zeros(blocks)]
    for t in order:
        live = at[:, t] >= 0
        i = at[live, t]
        p, q, r, s = (x[live] for x in whole)
        new = [a[i] * r + b[i] * p, a[i] * s + b[i] * q, c[i] * r + d[i] * p, c[i] * s + d[i] * q]
        scale = np.maximum.reduce(new)
        for x, y in zip(whole, new):
            x[live] = y / scale
    entry = np.full(blocks, start)
    last = np.append(nth[1:] == 0, True)
    steps = nth if not backward else _from_end(nth, last)
    for k in range(1, int(steps.max()) + 1 if blocks else 0):
        here = np.flatnonzero(steps == k)
        prior = here + 1 if backward else here - 1
        e = entry[prior]
        entry[here] = (whole[0][prior] + whole[1][prior] * e) / (whole[2][prior] + whole[3][prior] * e)
    out = np.zeros(len(odds))
    ratio = entry
    for t in order:
        live = at[:, t] >= 0
        i = at[live, t]
        r = ratio[live]
        if backward:
            out[i] = r
            ratio[live] = (a[i] + b[i] * r) / (c[i] + d[i] * r)
        else:
            ratio[live] = out[i] = (a[i] + b[i] * r) / (c[i] + d[i] * r)
    return out


def _from_end(nth, last):
    ends = np.flatnonzero(last)
    return ends[np.searchsorted(ends, np.arange(len(nth)))] - np.arange(len(nth))


def marginals(first, counts, emission, transition):
    """Forward and backward ratios and the probability of the toxic state of every word.

    ``emission`` is the toxic state's advantage in log units; ``transition`` the 2 x 2
    potentials.  A document starts as if after a clean word.
    """
    odds = np.exp(np.clip(emission, -30, 30))
    (t00, t01), (t10, t11) = transition
    at, nth = _blocks(first, counts)
    one = np.ones(len(odds))
    forward = _run(at, nth, odds, (odds * t01, odds * t11, one * t00, one * t10), 0.0, False)
    backward = _run(at, nth, odds, (one * t10, odds * t11, one * t00, odds * t01), 1.0, True)
    both = forward * backward
    return forward, backward, both / (1 + both)


@dataclass
class Model:
    weights: np.ndarray = None
    transition: np.ndarray = None
    final: np.ndarray = None
    base: float = 0.0

    def __getstate__(self):
        """Weights travel to the tasks without their zeros."""
        state = dict(self.__dict__)
        if self.weights is not None:
            at = np.flatnonzero(self.weights)
            state["weights"] = (len(self.weights), at, self.weights[at])
        return state

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.weights is not None:
            size, at, values = self.weights
            self.weights = np.zeros(size, dtype=np.float32)
            self.weights[at] = values

    def emission(self, features):
        total = np.full(len(features), self.weights[-1], dtype=np.float64)
        for column in features.T:
            total += self.weights[column]
        return total

    def evidence(self, w, p):
        """Per document: expected toxic words, and log odds of the likeliest two."""
        docs = len(w.counts)
        total = np.bincount(w.doc, p, docs)
        top = np.full(docs, 1e-6)
        np.maximum.at(top, w.doc, p)
        order = np.lexsort((-p, w.doc)) if len(p) else np.zeros(0, np.int64)
        second = np.full(docs, 1e-6)
        many = w.counts > 1
        second[many] = np.maximum(p[order[w.first[:-1][many] + 1]], 1e-6)
        logit = lambda x: np.log(x / (1 - np.minimum(x, 1 - 1e-6)))
        return np.stack([np.ones(docs), np.log1p(total), logit(top) / 4, logit(second) / 4], axis=1)

    def tag(self, texts):
        w, _, features = tokens(texts)
        if self.weights is None:
            return w, np.zeros(len(w.starts)), np.full(len(w.counts), self.base)
        _, _, p = marginals(w.first, w.counts, self.emission(features), self.transition)
        return w, p, 1 / (1 + np.exp(-self.evidence(w, p) @ self.final))


def _by_slices(texts):
    """(first document, tokens) of slices of the texts: hashing a byte takes tens of bytes."""
    for start, stop in W.slices(texts, 1 << 20):
        yield start, tokens(texts.slice(start, stop - start))


def _toxic_units(texts, toxic):
    """Words and prefixes found so much more in toxic documents that chance would not
    produce one such among all (a binomial likelihood ratio with a Bonferroni bound)."""
    share = toxic.mean()
    once = [[] for _ in range(1 + len(PREFIXES))]
    for start, (w, units, _) in _by_slices(texts):
        for seen, unit in zip(once, units.T):
            _, i = np.unique(unit ^ W.mix(w.doc.astype(np.uint64) + _U(1)), return_index=True)
            seen.append((unit[i], toxic[w.doc[i] + start]))
    found = []
    for seen in once:
        names, where = np.unique(np.concatenate([u for u, _ in seen]), return_inverse=True)
        n, hits = np.bincount(where), np.bincount(where, np.concatenate([b for _, b in seen]))
        q = np.clip(hits / n, 1e-9, 1 - 1e-9)
        ratio = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
        found.append(names[(q > 0.8) & (ratio > np.log(100 * len(names)))])
    return found


class _Sequences:
    """What the field needs of many documents: word counts and, where asked, features and toxic tokens."""

    def __init__(self, texts, marked, toxic):
        counts, features, y = [], [], []
        for start, (w, units, f) in _by_slices(texts):
            hit = np.zeros(len(w.starts), dtype=bool)
            for unit, names in zip(units.T, marked):
                hit |= np.isin(unit, names)
            counts.append(w.counts)
            features.append(f)
            y.append(hit & toxic[w.doc + start])
        self.counts = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.features, self.y = np.concatenate(features), np.concatenate(y)


def _train_field(w):
    """Adam on the field's penalised log likelihood: weights with the bias last, and log transitions."""
    features, y = w.features, w.y
    weights = np.zeros(BUCKETS + 1)
    rate = y.mean()
    weights[-1] = np.log(rate / (1 - rate))
    trans = np.zeros(4)
    inner = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    seen = np.bincount(2 * y[inner] + y[inner + 1], minlength=4).astype(float)
    names, flat = np.unique(features, return_inverse=True)
    flat = flat.reshape(features.shape)
    part, bias = np.zeros(len(names)), weights[-1]
    mean, square = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    for step in range(1, STEPS + 1):
        t = np.exp(trans).reshape(2, 2)
        emission = part[flat].sum(axis=1) + bias
        forward, backward, p = marginals(w.first, w.counts, emission, t)
        f, e = forward[inner], np.exp(np.clip(emission, -30, 30))[inner + 1] * backward[inner + 1]
        pair = np.stack([np.full(len(f), t[0, 0]), t[0, 1] * e, t[1, 0] * f, t[1, 1] * f * e])
        expected = (pair / pair.sum(axis=0)).sum(axis=1)
        miss = y - p
        pull = np.bincount(flat.ravel(), np.repeat(miss, features.shape[1]), len(names)) - 0.05 * part
        grad = np.concatenate([pull, [miss.sum() / 50], (seen - expected - 0.1 * trans) / 50])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-2)
        part += move[: len(names)]
        bias += move[len(names)]
        trans += 0.3 * move[len(names) + 1 :]
    weights[names] = np.where(np.abs(part) >= LEAST_WEIGHT, part, 0)
    weights[-1] = bias
    return weights, trans


def fit(texts, toxic, share):
    """A model from texts and their labels; ``share`` of all labelled documents are toxic."""
    toxic = np.asarray(toxic, dtype=bool)
    nth = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    name, rest = nth % 3 != 0, nth % 3 == 0
    if not toxic[name].any() or toxic[name].all() or not toxic[rest].any() or toxic[rest].all():
        return Model(base=float(share))
    marked = _toxic_units(texts.filter(pa.array(name)), toxic[name])
    field = name & (nth <= 1.5 * FIELD_SAMPLE)
    w = _Sequences(texts.filter(pa.array(field)), marked, toxic[field])
    if not w.y.any():
        return Model(base=float(share))
    weights, trans = _train_field(w)
    model = Model(weights.astype(np.float32), np.exp(trans).reshape(2, 2))

    x, t = [], toxic[rest]
    for _, (w, _, features) in _by_slices(texts.filter(pa.array(rest))):
        _, _, p = marginals(w.first, w.counts, model.emission(features), model.transition)
        x.append(model.evidence(w, p))
    x = np.concatenate(x)
    # The sample has more toxic documents than the labels: weigh both kinds back.
    weight = np.where(t, share / t.mean(), (1 - share) / (1 - t.mean()))
    final = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ final))
        g = x.T @ (weight * (t - q)) - 0.1 * final
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        final += np.linalg.solve(h, g)
    model.final = final
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, clean: int = CLEAN_SAMPLE) -> Model:
    named = (
        labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_id").agg(F.max("y").alias("y")).filter(~held_out("_id"))
    )
    totals = {r.y: r["count"] for r in named.filter("y in (0, 1)").groupBy("y").count().collect()}
    every = sum(totals.values())
    share = totals.get(1, 0) / every if every else 0.0
    limit = F.lit(0)
    for y, n in totals.items():
        limit = F.when(F.col("y") == y, F.lit(int(min(1.0, (sample if y else clean) / n) * (1 << 20)))).otherwise(limit)
    chosen = named.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < limit)
    # The sample's rows are few by its bound, so their ids may be broadcast and no text is shuffled.
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        # Rows with one id, however many, are one example: the one with the least text.
        .groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
        .sort_values("doc_id", kind="stable")
    )
    return fit(pa.array(rows.text.to_list(), pa.string()), rows.y.to_numpy() == 1, share)


def tag(docs: DataFrame, model: Model, likely: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): ``spans`` are begin, end, begin, end, ... code points of runs of likely toxic words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def measure(part):
        w, p, score = model.tag(part["text"])
        hit = np.flatnonzero(p >= likely)
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (w.doc[hit[1:]] != w.doc[hit[:-1]])) if len(hit) else np.zeros(0, bool)
        runs = np.flatnonzero(new)
        ends = (np.append(runs[1:], len(hit)) - 1)[: len(runs)]
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        doc = w.doc[hit[runs]]
        pair = np.stack([points[w.starts[hit[runs]]], points[w.ends[hit[ends]]]], axis=1) - points[w.begin[doc]][:, None]
        count = np.bincount(doc, minlength=len(w.counts))
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], 2 * np.cumsum(count)]), pa.int32()), pa.array(pair.ravel().astype(np.int64))
        )
        return {"doc_id": part["doc_id"], "score": score, "spans": spans}

    return W.map_texts(docs, ["doc_id", "text"], "text", W.schema("doc_id bigint, score double, spans array<bigint>"), measure)
