"""The pipeline against plain versions of its stages, each on its own input."""

import collections
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import prose

import corpus_pipeline
from commitlens.llm import gam
from commitlens.llm.queries import held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(8)
    passage, item = prose(1, 60), prose(2, 40)
    docs, labels = [], []
    for k in range(300):
        text = prose(100 + k, r.randint(25, 90)) + "\n" + prose(900 + k, 30)
        if k % 9 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        elif k % 10 == 1:
            text = docs[k - 1][1] if docs[k - 1][1] else text
        elif k % 10 == 3:
            text += " " + passage
        elif k % 25 == 4:
            text += " " + item + " " + prose(k, 5)
        docs.append((k, text, "en", ("a", "b", "c", None)[0 if k % 2 else k % 4], len(text)))
        labels.append((k, int("%%%" not in text), 0))
    docs += [(400, passage, "en", "a", 1), (401, "", "en", "a", 0), (402, None, None, None, None), (None, prose(3, 50), "en", "b", 1), (7, docs[7][1], "en", "a", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(4, 40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    before = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing to target weights"
    ]
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder).persist()
        rows, out = before.collect(), after.collect()
        if step < 4:
            assert after.columns == before.columns
        if step == 0:
            model = gam.quality_model(before, labels, held_out(5, 0))
            scores = model.score(gam.features(pa.array([r.text for r in rows], pa.string())))
            assert sorted(map(str, out)) == sorted(str(r) for r, s in zip(rows, scores) if s >= gam.THRESHOLD)
            kept = {r.doc_id for r in out}
            wrong = [r.doc_id for r in rows if r.text and len(r.text) > 60 and ("%%%" in r.text) == (r.doc_id in kept)]
            assert len(wrong) <= 2
        if step == 1:
            prints = [(r.doc_id, brute.simhash(r.text)) for r in rows]
            groups = collections.defaultdict(list)
            for (doc, _), root in zip(prints, brute.components([(f, f) for _, f in prints])):
                groups[root].append(doc)
            wanted = [min([d for d in g if d is not None], default=None) for g in groups.values()]
            assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, wanted)) and len(out) < len(rows)
        if step == 2:
            texts = collections.defaultdict(list)
            for r, (_, n, removed, _) in zip(rows, brute.removals([(r.doc_id, r.text) for r in rows])):
                if removed < n or n == 0:
                    texts[r.doc_id].append((removed, r.text))
            assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(d) for d, x in texts.items() for _ in x)
            changed = 0
            for r in out:
                removed, text = texts[r.doc_id][0]
                if not removed:
                    assert r.text == text
                else:
                    changed += 1
                    assert len(brute.words(r.text)) == len(brute.words(text)) - removed and r.n_chars == len(r.text)
            assert changed > 10
        if step == 3:
            clean = [r.doc_id for r in rows if not (r.text and " ".join(item.split()[:20]) in " ".join(r.text.split()))]
            assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, clean))
        if step == 4:
            size, target = brute.targets([(r.text, r.source) for r in rows])
            taken = collections.Counter()
            for r in out:
                taken[r.source] += r.taken
                assert r.taken == r.copies * len(brute.words(r.text)) and 1 <= r.copies <= 3
            for source, wanted in target.items():
                largest = max((len(brute.words(r.text)) for r in rows if r.source == source), default=0)
                assert abs(taken[source] - wanted) <= largest
        before = after


def test_run(spark, folder):
    first = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_run_on_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_features_are_finite(spark):
    x = gam.features(pa.array([None, "", " ", "a", "\n\n", "!" * 1000, "%%% " * 50]))
    assert np.isfinite(x).all() and x.shape == (7, len(gam.FEATURES))


def test_clashing_names(spark, folder):
    """Columns that are called what the stages call their own come through unchanged."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = ["_score", "_row", "_kept_row", "_text", "_id", "_tie", "_source", "_copies", "_rest", "kept", "words"]
    wide = docs.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(own)])
    plain = docs
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, plain, folder), stage(spark, wide, folder)
        assert sorted(map(str, wide.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name
        assert wide.select(*own).distinct().collect() == [tuple(range(len(own)))], name
