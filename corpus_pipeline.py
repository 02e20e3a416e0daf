"""From raw documents to a training mix, one operator after the other.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of documents.  ``run`` writes each stage's rows to the shared
folder and reads them back.
"""

from commitlens.llm import decontaminate, gam, mixing, simhash, substring
from commitlens.llm.queries import held_out
from commitlens.session import cut


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    model = gam.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out(5, 0))
    return gam.accepted(docs, model)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, 3-word SimHash fingerprints linked at 2 or fewer bits: that of the least id."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def repeated_passages(spark, docs, sf_dir):
    """Documents without the words that windows of earlier documents cover."""
    return substring.cleaned(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents into which no benchmark item has leaked."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """The documents of the mix by source weights, each once, with how often it occurs in it."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mix),
]

#: The first stage's model can't be written in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
