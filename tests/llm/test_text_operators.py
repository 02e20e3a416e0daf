"""Rules, mixing, near duplicates and passages against brute force."""

import collections

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitlens.llm import mixing, quality_rules, simhash, substring
from commitlens.llm import words as W
from commitlens.llm.components import components


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def same(got, wanted):
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(got, key=key) == sorted(wanted, key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \n\t é\x1f", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    w = W.Words(pa.array(texts, pa.string()))
    wanted = [brute.words(t) for t in texts]
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == wanted
    hashes = w.hashes()
    assert len(set(hashes.tolist())) == len({x for t in wanted for x in t})
    at, keys = w.windows(hashes, 2)
    assert len(at) == sum(max(len(t) - 1, 0) for t in wanted)
    assert len(set(keys.tolist())) == len({tuple(t[i : i + 2]) for t in wanted for i in range(len(t) - 1)})


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c"])
    assert list(W.slices(texts, 20)) == [(0, 3), (3, 4), (4, 5)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \n#", max_size=60), max_size=4))
def test_measurements(texts):
    got = quality_rules._measure({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [brute.measures(t) for t in texts]


def test_ledger(messy, empty):
    ledger = quality_rules.ledger(messy)
    got = rows_of(ledger, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(got, [(r.doc_id, *brute.measures(r.text)) for r in messy.collect()])
    policy = quality_rules.apply_policy(ledger, "base").collect()
    assert all(r.kept == (not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)) for r in policy)
    assert quality_rules.ledger(empty).count() == 0


def test_ablations(messy):
    ledger = quality_rules.ledger(messy).cache()
    rows = ledger.collect()
    mask = quality_rules.mask("v1")
    got = {r.rule: r for r in quality_rules.ablations(ledger).collect()}
    for rule in quality_rules.RULES:
        bit = 1 << rule.bit
        assert got[rule.name].failed_docs == sum(bool(r.fail_bits & bit) for r in rows)
        assert got[rule.name].failed_only_here == sum(r.fail_bits & mask == bit for r in rows)
        assert got[rule.name].kept_without == sum(not r.fail_bits & mask & ~bit for r in rows)


def test_mixing(messy, empty):
    mixed = mixing.mix(messy).collect()
    size, target = brute.targets([(r.text, r.source) for r in messy.collect()])
    taken = collections.Counter()
    for r in mixed:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] += r.taken
    assert len(mixed) == messy.count()
    for source, wanted in target.items():
        largest = max([r.size for r in mixed if r.source == source], default=0)
        assert abs(taken[source] - wanted) <= largest
    same([tuple(r) for r in mixed], [tuple(r) for r in mixing.mix(messy).collect()])
    assert mixing.mix(empty).count() == 0
    texts = mixing.mixed_documents(messy, mixing.mix(messy)).select(F.sum("taken")).first()[0]
    assert texts == sum(r.taken for r in mixed)


def test_whole_passes_come_first(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "s" if k < 3 else "t") for k in range(60)], "doc_id long, text string, source string")
    copies = collections.Counter((r.source, r.copies) for r in mixing.mix(docs).collect())
    assert copies["s", 3] == 3 and all(c in (0, 1) for s, c in copies if s == "t")


def test_weights_draw_more(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "a" if k < 2000 else "b", float(k % 2) * 9 + 1) for k in range(2400)], "doc_id long, text string, source string, q double")
    mixed = mixing.mix(docs, F.col("q")).filter("source = 'a' and copies > 0").collect()
    odd = sum(r.doc_id % 2 for r in mixed)
    assert odd > 0.6 * len(mixed)


def test_near_duplicates(messy, empty):
    given_rows = [(r.doc_id, r.text) for r in messy.collect()]
    prints = [(d, brute.simhash(t)) for d, t in given_rows]
    wanted = [(d, f, c) for (d, f), c in zip(prints, brute.components(prints))]
    found = simhash.near_duplicates(messy)
    same([(d, f % (1 << 64), c) for d, f, c in rows_of(found, "doc_id", "fp", "component_id")], wanted)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(messy)
    groups = set(brute.components([(f, f) for _, f in prints]))
    assert kept.columns == messy.columns and kept.count() == len(groups)
    clashing = messy.withColumn("_row", F.lit(1)).withColumn("_kept_row", F.lit(2))
    assert simhash.keep_one(clashing).agg(F.count("*"), F.min("_row"), F.max("_kept_row")).first() == (len(groups), 1, 2)


def test_links_of_random_fingerprints(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 30)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 2, 3, 4)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = dict(rows_of(components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))), "vertex", "root"))
    got = collections.defaultdict(set)
    for p, s in zip(prints, signed):
        got[roots.get(s, s)].add(p)
    names = brute.components([(p, p) for p in prints])
    wanted = collections.defaultdict(set)
    for p, n in zip(prints, names):
        wanted[n].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_other_radius_and_shingles(spark):
    r = np.random.default_rng(6)
    base = [int(b) for b in r.integers(0, 1 << 62, 6)]
    prints = sorted({b ^ sum(1 << int(k) for k in r.choice(63, n, replace=False)) for b in base for n in (0, 3, 4, 5, 8, 9)})
    roots = dict(rows_of(components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4)), "vertex", "root"))
    names = brute.components([(p, p) for p in prints], 4)
    assert [roots.get(p, p) for p in prints] == names
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A B C D E F G"), (3, "g f e d c b a")], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(docs, 2, 0).collect()) == [1, 3]
    with pytest.raises(ValueError):
        simhash.links(docs.selectExpr("doc_id AS fp"), 3)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    roots = dict(rows_of(components(edges), "vertex", "root"))
    assert all(roots[k] == 0 for k in range(201)) and roots[501] == 500 and len(roots) == 203


def test_repeats(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = rows_of(substring.remove_repeats(messy), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, brute.removals(rows))
    assert sum(r[2] for r in got) > 1000
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_with_hot_grams(messy, monkeypatch):
    """The same rows when common grams are dealt apart."""
    monkeypatch.setattr(substring, "HOT_SHARE", 0.05)
    assert len(substring.hot_grams(messy.select("doc_id", "text"))) > 20
    got = rows_of(substring.remove_repeats(messy), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, brute.removals([(r.doc_id, r.text) for r in messy.collect()]))


def test_cleaned_keeps_columns(messy):
    out = substring.cleaned(messy)
    assert out.schema.names == messy.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in messy.schema]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == {r.doc_id: r.text for r in messy.collect()}[1] and 3 not in texts and 4 in texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=13, max_size=20), min_size=1, max_size=8), st.randoms())
def test_index_finds_the_earliest(texts, random):
    docs = [random.randint(0, 5) for _ in texts]
    lengths = np.array([len(t) for t in texts])
    got = substring.earliest(np.array([x for t in texts for x in t], dtype=np.uint64), lengths, np.array(docs))
    least = {}
    for t, d in zip(texts, docs):
        for i in range(len(t) - 12):
            key = tuple(t[i : i + 13])
            least[key] = min(least.get(key, d), d)
    assert got.tolist() == [least[tuple(t[i : i + 13])] for t in texts for i in range(len(t) - 12)]
