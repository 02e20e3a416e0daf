"""Metrics of one change: churn, relative churn, hunks, keywords and tokens."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.bundle import Bundle
from commitlens.functions import text
from commitlens.operators.sieve import asked_rows
from commitlens.schemas import ADDED, CHANGE_KEY, DELETED, NO_OID
from commitlens.session import cut


def for_requests(measures: DataFrame, requests: DataFrame | None, keys=CHANGE_KEY) -> DataFrame:
    """Measures of the requested keys; every measured key when there are no requests."""
    return measures if requests is None else requests.join(measures, list(keys), "left")


def asked_only(t, requests: DataFrame | None):
    """The tables with only what the requests can need: their changes, and the contents,
    functions, comments, ranges and blame of those.  All there is without requests.  Tables that a
    metric doesn't read are not touched."""
    if requests is None:
        return t
    asked = requests.select(*CHANGE_KEY).distinct()
    changes = t.changes.join(asked, CHANGE_KEY, "left_semi")
    oids = (
        changes.select(F.col("oid_before").alias("oid")).union(changes.select("oid_after")).filter(F.col("oid") != NO_OID).distinct()
    )
    keys = dict.fromkeys(("blobs", "comments", "functions"), (oids, "oid")) | dict.fromkeys(("linechanges", "blame"), (asked, CHANGE_KEY))

    def reduced(name):
        table = getattr(t, name, None)
        return table if table is None or name not in keys else table.join(*keys[name], "left_semi")

    names = (*keys, "commits", "projects")
    return Bundle(changes=lambda: changes, **{n: partial(reduced, n) for n in names})


def churn(t, requests=None, **options) -> DataFrame:
    """Inserted, deleted and all changed lines; null for binary files."""
    both = F.col("insertions") + F.col("deletions")
    known = both.isNotNull()
    measures = t.changes.select(
        *CHANGE_KEY,
        F.when(known, F.col("insertions")).alias("insertions"),
        F.when(known, F.col("deletions")).alias("deletions"),
        both.alias("aggregate"),
    )
    return for_requests(measures, requests)


def relativechurn(t, requests=None, **options) -> DataFrame:
    """Churn divided by the size of the new version."""
    t = asked_only(t, requests)
    sizes = t.blobs.select(
        F.col("oid").alias("oid_after"), text.content_size(F.col("content")).alias("size")
    )
    known = (F.col("insertions") + F.col("deletions")).isNotNull()
    sized = t.changes.filter(~F.col("type").isin(ADDED, DELETED)).join(sizes, "oid_after", "left")
    fixed = t.changes.filter(F.col("type").isin(ADDED, DELETED)).withColumn("size", F.lit(None).cast("bigint"))

    def ratio(lines, when_added):
        return (
            F.when(~known | (F.col("type") == DELETED), None)
            .when(F.col("type") == ADDED, F.lit(when_added))
            .otherwise(F.try_divide(lines, F.col("size")))
            .cast("double")
        )

    columns = [*CHANGE_KEY, "type", "insertions", "deletions", "size"]
    measures = sized.select(*columns).unionByName(fixed.select(*columns)).select(
        *CHANGE_KEY,
        ratio(F.col("insertions"), 1.0).alias("insertions"),
        ratio(F.col("deletions"), 0.0).alias("deletions"),
        ratio(F.col("insertions") + F.col("deletions"), 1.0).alias("aggregate"),
    )
    return for_requests(measures, requests)


def _wanted_patches(t, requests):
    if requests is None:
        return t.patches
    return asked_rows(t.patches, requests, CHANGE_KEY)


def _keyword_columns():
    return [
        F.map_from_entries(text.keyword_counts(F.col("patch"), F.col("language"))).alias("keywords"),
        F.when(~text.keyword_supported(F.col("language")), F.lit("LanguageNotSupported")).alias("error"),
    ]


def _languages(t):
    return t.projects.select(F.col("id").alias("project_id"), "language")


def hunk(t, requests=None, **options) -> DataFrame:
    measures = _wanted_patches(t, requests).select(
        *CHANGE_KEY, text.count_hunks(F.col("patch")).alias("hunks")
    )
    return for_requests(measures, requests)


def keyword(t, requests=None, **options) -> DataFrame:
    """``map<keyword, count>`` of the patch by the language of its project.

    ``error`` is set where the language has no dictionary.
    """
    patches = _wanted_patches(t, requests).join(_languages(t), "project_id")
    return for_requests(patches.select(*CHANGE_KEY, *_keyword_columns()), requests)


def patch_measures(t, requests=None, names=("hunk", "keyword", "patchtokens"), **options) -> dict[str, DataFrame]:
    """The metrics of patches from one reading of their texts."""
    known = _languages(t).withColumn("known", F.lit(True))
    patches = _wanted_patches(t, requests).join(known, "project_id", "left")
    columns = {
        "hunk": [text.count_hunks(F.col("patch")).alias("hunks")],
        "keyword": ["known", *_keyword_columns()],
        "patchtokens": [text.tokenize(F.col("patch")).alias("tokens")],
    }
    read = cut(patches.select(*CHANGE_KEY, *[c for n in names for c in columns[n]]), "patches")
    out = {"hunk": ["hunks"], "keyword": ["keywords", "error"], "patchtokens": ["tokens"]}
    return {
        n: for_requests((read.filter("known") if n == "keyword" else read).select(*CHANGE_KEY, *out[n]), requests) for n in names
    }


def messagetokens(t, requests=None, **options) -> DataFrame:
    keys = ["project_id", "sha"]
    messages = t.messages
    if requests is not None:
        messages = asked_rows(messages, requests, keys)
    measures = messages.select(*keys, text.tokenize(F.col("message")).alias("tokens"))
    return for_requests(measures, requests, keys)


def patchtokens(t, requests=None, **options) -> DataFrame:
    measures = _wanted_patches(t, requests).select(
        *CHANGE_KEY, text.tokenize(F.col("patch")).alias("tokens")
    )
    return for_requests(measures, requests)
