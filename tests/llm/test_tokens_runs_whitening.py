"""BPE against its library, periodic runs against brute force, whitening against an eigendecomposition."""

import hashlib
import math
import random
import struct
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitlens.llm import bpe, queries, runs, whitening

# ---------------------------------------------------------------- BPE

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(FILE))


PARTS = [
    "the ", "The", "'s", "'LL", "don't", "12", "３", " ", "\n", "\x1c", "\x85", " ", "é", "é", "Σ", "ΑΣ", "İ", "ß", "ǅ", "中文", "😀",
    "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "aaa", "ab" * 40, "!!!", "...", "՘", "\U0003fc3b", "Ᲊ", "\x00", "thethe", "ing",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=8), max_size=12).map("".join), max_size=5))
def test_ids_are_the_library_s(library, encoder, texts):
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode(texts)] == wanted


def test_long_pieces_and_every_character(library, encoder):
    r = random.Random(3)
    texts = ["".join(r.choices("aabthing", k=20_000)), "a" * 5001, "ab" * 3000]
    texts += ["".join(chr(c) for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 512)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode(texts)] == wanted


def by_hand(symbols, ranks):
    """Merge the least rank, leftmost first, one pair at a time."""
    symbols = list(symbols)
    while True:
        known = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not known:
            return symbols
        _, i = min(known)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_order_of_merges(data):
    """Merges whose new pairs rank lower than themselves are applied as if each piece stood alone."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(0, 8))):
        pair = data.draw(st.tuples(st.sampled_from(tokens), st.sampled_from(tokens)))
        if pair not in merges:
            merges.append(pair)
            tokens.append("".join(pair)) if "".join(pair) not in tokens else None
    merges = data.draw(st.permutations(merges))
    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    v.tokens = tokens
    v.inner = np.zeros(256, np.int64)
    v.inner[[97, 98, 99]] = [0, 1, 2]
    v.last = v.inner
    column = lambda k: np.array([tokens.index(m[k]) for m in merges], np.int64)
    v.left, v.right = column(0), column(1)
    v.made = np.array([tokens.index("".join(m)) for m in merges], np.int64)
    pieces = data.draw(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=4))
    ids, ends = bpe.Merger(v).tokens([p.encode() for p in pieces])
    got = [[tokens[i] for i in ids[a:b]] for a, b in zip([0, *ends], ends)]
    assert got == [by_hand(p, {m: k for k, m in enumerate(merges)}) for p in pieces]


def test_encode_and_decode_tables(spark, messy, empty, library):
    rows = messy.unionByName(spark.createDataFrame([(50, "One<|endoftext|>two  Straße")], "doc_id long, text string"), allowMissingColumns=True)
    tokens = bpe.decode(bpe.encode(rows.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")), FILE, carry=["size"]), FILE)
    assert tokens.columns == ["doc_id", "size", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in tokens.collect()), key=str)
    wanted = []
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        wanted.append((r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(wanted, key=str)
    assert bpe.decode(bpe.encode(empty, FILE), FILE).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), FILE).first().decoded is None


def test_caches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    encoder = bpe.Encoder(bpe.Vocabulary(FILE))
    for k in range(20):
        text = brute.prose(k, 60)
        (got,) = encoder.encode([text])
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.packed) <= 20 + 60


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- periodic runs


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            stretch = words[start : start + length]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


pattern = st.lists(st.sampled_from("ab"), min_size=1, max_size=9)
repeats = st.tuples(pattern, st.integers(1, 9), st.integers(0, 8)).map(lambda t: t[0] * t[1] + t[0][: t[2]])
texts = st.lists(repeats | st.lists(st.sampled_from("abc"), max_size=6), max_size=6).map(lambda p: [w for x in p for w in x])


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4))
def test_runs_are_brute_force_s(docs):
    codes = np.array([ord(w) for d in docs for w in d], np.int64)
    wanted, base = [], 0
    for d in docs:
        wanted += [(base + s, n, q) for s, n, q in brute_runs(d)]
        base += len(d)
    assert list(zip(*[x.tolist() for x in runs.find_runs(codes, [len(d) for d in docs])])) == wanted


def test_hot_words_cost_no_square():
    """A text of one word, of one word a region, and of a string with repeats everywhere."""
    assert [x.tolist() for x in runs.find_runs(np.zeros(200_000, np.int64), [200_000])] == [[0], [200_000], [1]]
    regions = np.repeat(np.arange(200) % 7, 1000)
    start, length, period = runs.find_runs(regions, [len(regions)])
    assert (start.tolist(), set(length.tolist())) == (list(range(0, 200_000, 1000)) + [], {1000}) or 7000 in period
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 100_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert len(runs.find_runs(np.array(fibonacci[-1]), [len(fibonacci[-1])])[0]) == 0


def test_runs_of_tables(spark, messy, empty):
    made = runs.runs(messy.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(1)), carry=["size"])
    assert made.columns == ["doc_id", "size", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in made.collect()]
    wanted = []
    for r in messy.collect():
        w = brute.words(r.text)
        found = [(0, 30, 1)] if w == ["tie"] * 30 else [] if len(w) > 1000 else brute_runs(w)
        wanted.append((r.doc_id, len(w), found, collapsed(w, found)))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert runs.runs(empty).count() == 0


def test_runs_query(spark, tmp_path):
    rows = [(k, brute.prose(k, k % 90)) for k in range(300)] + [(1000 + k, "x y z " * 9 + brute.prose(k, 5) + " q" * 8) for k in range(20)]
    rows += [(None, "a b " * 6), (2000, None), (2001, ""), (1001, "x " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, text in rows:
        w = brute.words(text)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        wanted.append((i, len(found), *(best or (None, None, None)), best and math.floor(1000 * best[1] / best[2]), digest, hashlib.sha256(collapsed(w, found).encode()).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    assert any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


# ---------------------------------------------------------------- whitening


def expected(rows):
    """Fit list, sums, eigenvalues and vectors of plain lists."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(64 * c) + 1000000 for c in v) for _, v in usable]
    distinct = sorted(set(xs))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    a = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return [i for i, _ in usable], xs, n, sums, values[::-1], vectors[:, ::-1]


def check(spark, rows, top=16):
    ids, xs, n, sums, values, vectors = expected(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(got) == len(ids) * min(top, len(sums))
    signs = {}
    place = {}
    for i, x in zip(ids, xs):
        place.setdefault(i, x)
    for r in got:
        x, k = place[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert r.identity_error < 1e-9 and abs(r.explained - values[k] / values.sum()) <= 1e-9 * r.explained
        wanted = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors[:, k] / math.sqrt(values[k])
        if abs(wanted) > 1e-3:
            assert signs.setdefault(k, np.sign(wanted * r.whitened)) == np.sign(wanted * r.whitened)
        assert abs(abs(wanted) - abs(r.whitened)) < 1e-7
    return got


def test_whitening_matches_an_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 9, 20)).tolist()) for i in range(120)]
    rows += [(500 + k, rows[3][1]) for k in range(60)]
    rows += [(600, None), (601, []), (602, [None] * 20), (603, [math.nan] * 20), (604, [math.inf, *[0.0] * 19]), (605, [0.5, None, *[0.0] * 18]), (None, rows[5][1])]
    got = check(spark, rows)
    assert {r.vec_id for r in got} & {600, 601, 602, 603, 604, 605} == set() and any(r.vec_id is None for r in got)


def test_small_variances_beside_large_ones(spark):
    """Variances that differ by more than a covariance in doubles can hold: the last stay accurate."""
    rng = np.random.default_rng(5)
    scale = np.array([1e9, 1e5, 30.0, 1.0])
    xs = np.floor(rng.normal(size=(400, 4)) * scale)
    model_rows = [(i, (x / 64).tolist()) for i, x in enumerate(xs)]
    table = spark.createDataFrame(model_rows, "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    centred = xs - xs.mean(axis=0)
    sigma = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(model.values, sigma**2 / len(xs), rtol=1e-6) and model.identity_error < 1e-4


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(90, 3))
    rows = [(i, [*b.tolist(), float(b[0]), 0.25]) for i, b in enumerate(base)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(got) == 90 * 5 and {r.component for r in got if r.whitened is None} == {4, 5}
    assert all(r.identity_error < 1e-9 for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in whitening.whiten(one, whitening.fit(one)).orderBy("vec_id", "component").collect()] == [
        (1, 1, 1, 0, None), (1, 2, 1, 0, None), (2, 1, 1, 0, None), (2, 2, 1, 0, None),
    ]


def test_vectors_of_other_kinds(spark):
    schema = "vec_id long, embedding array<float>, component string, n string, x string"
    none = spark.createDataFrame([], schema)
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
    rows = [(k, [float(k), float(k * k % 7)], "a", "b", "c") for k in range(9)] + [(20, [1.0], "a", "b", "c"), (21, [1e30, 0.0], "a", "b", "c")]
    table = spark.createDataFrame(rows, schema)
    assert {r.vec_id for r in whitening.whiten(table, whitening.fit(table)).collect()} == set(range(9))
    wide = whitening.Whitening(2, 3, [3, 6], [])
    assert wide.scaled(np.array([[1 << 61, 2]])).tolist() == [[3 * (1 << 61) - 3, 0]]
    assert whitening._deviations(np.array([[1 << 40, 0]])).to_pylist() == [None]
    assert whitening._deviations(np.array([[1 << 31, 0]])).to_pylist() == [1 << 62]
