"""The metric catalog and the jobs that run whatever it enables."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from commitlens.operators import change, graph, people, source
from commitlens.schemas import METRICS
from commitlens.session import cut

# Id, name, granularity and whether the metric is on by default.
SEED = [
    (1, "churn", "change", True),
    (2, "collaboration", "file", False),
    (3, "complexity", "function", True),
    (4, "contribution", "file", False),
    (5, "flow", "function", False),
    (6, "functionchurn", "change", True),
    (7, "hunk", "change", True),
    (8, "interactivechurn", "change", True),
    (9, "keyword", "change", True),
    (10, "loc", "file", True),
    (11, "loc", "function", True),
    (12, "messagetokens", "commit", True),
    (13, "nesting", "function", True),
    (14, "offender", "file", True),
    (15, "ownership", "developer", True),
    (16, "pastauthors", "change", True),
    (17, "pastchanges", "change", True),
    (18, "patchtokens", "change", True),
    (19, "relativechurn", "change", True),
]

# Every metric is ``fn(tables, requests=None, **options) -> DataFrame``; a new one is
# added by putting it here and giving it a catalog row.
METRIC_JOBS = {
    "churn": change.churn,
    "collaboration": graph.collaboration,
    "complexity": source.complexity,
    "contribution": graph.contribution,
    "flow": source.flow,
    "functionchurn": source.functionchurn,
    "hunk": change.hunk,
    "interactivechurn": people.interactivechurn,
    "keyword": change.keyword,
    "loc": source.loc,
    "messagetokens": change.messagetokens,
    "nesting": source.nesting,
    "offender": people.offender,
    "ownership": people.ownership,
    "pastauthors": people.pastauthors,
    "pastchanges": people.pastchanges,
    "patchtokens": change.patchtokens,
    "relativechurn": change.relativechurn,
}

# Metrics that read the same texts, by granularity: where several are asked for, one function measures them in one pass.
TOGETHER = {
    "change": (("hunk", "keyword", "patchtokens"), change.patch_measures),
    "function": (("loc", "complexity", "nesting"), source.function_measures),
}

MEASURES = "metric string, granularity string, project_id bigint, sha string, path string, name string, email string, measure string"
KEY_COLUMNS = ("project_id", "sha", "path", "name", "email", "author_name", "author_email", "entity")


def metric_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, name, granularity, name, enabled) for i, name, granularity, enabled in SEED], METRICS
    )


def metrics_seed(projects: DataFrame) -> DataFrame:
    """A catalog row per metric for each new project, on or off as by default."""
    rows = F.array(
        *[F.struct(F.lit(i).alias("metric_id"), F.lit(on).alias("enabled")) for i, _, _, on in SEED]
    )
    return projects.select(F.col("id").alias("project_id"), F.explode(rows).alias("m")).select(
        "project_id", "m.metric_id", "m.enabled"
    )


def metrics_get(metrics: DataFrame, project_metrics: DataFrame, granularity=None, project_id=None) -> DataFrame:
    """Metrics switched on per project, of one granularity and project if given."""
    wanted = metrics if granularity is None else metrics.filter(F.col("granularity") == granularity)
    on = project_metrics.filter("enabled").select("project_id", F.col("metric_id").alias("id"))
    if project_id is not None:
        on = on.filter(F.col("project_id") == project_id)
    return on.join(wanted, "id")


def _ordered(result: DataFrame, column: str):
    """A column; a map with its entries in the order of their keys."""
    if not isinstance(result.schema[column].dataType, MapType):
        return F.col(column)
    return F.map_from_entries(F.array_sort(F.map_entries(column))).alias(column)


def as_measures(name: str, granularity: str, result: DataFrame, also=()) -> DataFrame:
    """Any metric's result in the layout of the measure sink, behind the columns ``also``.

    ``measure`` is the JSON of the metric's own columns, maps in the order of their keys; null if all are null.
    """
    echoed = {*KEY_COLUMNS, "request_id", "metric", "granularity"}
    own = [c for c in result.columns if c not in echoed]

    def key(*names):
        there = [F.col(c) for c in names if c in result.columns]
        return (F.coalesce(*there) if there else F.lit(None)).cast("string")

    return result.select(
        *[F.col(c) if c in result.columns else F.lit(None).cast("bigint").alias(c) for c in also],
        F.lit(name).alias("metric"),
        F.lit(granularity).alias("granularity"),
        "project_id",
        key("sha").alias("sha"),
        (F.col("entity.path") if "entity" in result.columns else key("path")).alias("path"),
        key("name", "author_name").alias("name"),
        key("email", "author_email").alias("email"),
        F.when(
            reduce(or_, [F.col(c).isNotNull() for c in own]),
            F.to_json(F.struct(*[_ordered(result, c) for c in own]), {"ignoreNullFields": "false"}),
        ).alias("measure"),
    )


def collect_enabled(t, granularity: str, requests=None, **options) -> DataFrame:
    """Run every metric that some project has switched on for the granularity.

    One job per metric covers all projects, and one all metrics that read the same texts; rows of projects that
    have the metric off are dropped by a join with the catalog before the results are united.
    """
    # Written, so that its size is known and no measure is shuffled for a join with it.
    on = cut(
        t.project_metrics.filter("enabled").join(
            t.metrics.filter(F.col("granularity") == granularity).select(F.col("id").alias("metric_id"), "name"),
            "metric_id",
        ),
        "enabled",
    )
    # At most one name per catalog row comes to the driver.
    names = sorted(row["name"] for row in on.select("name").distinct().collect())
    results, shared = [], {}
    together, measure = TOGETHER.get(granularity, ((), None))
    if len(set(together) & set(names)) > 1:
        shared = measure(t, requests, [n for n in together if n in names], **options)
    for name in names:
        projects = on.filter(F.col("name") == name).select("project_id").distinct()
        result = shared[name] if name in shared else METRIC_JOBS[name](t, requests, granularity=granularity, **options)
        results.append(
            as_measures(name, granularity, result.join(projects, "project_id", "left_semi"))
        )
    if not results:
        return t.metrics.sparkSession.createDataFrame([], MEASURES)
    return reduce(DataFrame.unionByName, results)
