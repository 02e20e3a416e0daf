"""Streams: metric requests in, measures out, and onboarding of projects."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.plans.catalog import METRIC_JOBS, SEED, as_measures, metrics_seed
from commitlens.schemas import PROJECTS, REQUESTS
from commitlens.session import cut

# A metric of several granularities answers in its first, unless asked through the catalog.
DEFAULT_GRANULARITY = {name: granularity for _, name, granularity, _ in reversed(SEED)}


#: How long a request's id is remembered.
REMEMBERED = "7 days"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Collect requests that arrive as parquet files in a folder."""
    return spark.readStream.schema(REQUESTS).parquet(path)


def once(requests: DataFrame, within: str = REMEMBERED) -> DataFrame:
    """Each request once: an id that came before, not longer ago than ``within``, is left out.

    Time is that of arrival, so what is remembered stays bounded.
    """
    arrived = requests.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["request_id"]).drop("arrived")


def collect(requests: DataFrame, metric: str, measures: DataFrame, keys) -> DataFrame:
    """Requests for one metric, each row echoed with the measure's columns.

    Stateless: the stream side is only filtered and joined, so a batch DataFrame
    of requests gives the same rows.
    """
    return requests.filter(F.col("metric") == metric).join(measures, list(keys), "left")


def sink_collected(requests: DataFrame, t, path: str, checkpoint: str, **options):
    """Measure every arriving request by its own metric, once, and append the results.

    A micro-batch runs the job of each metric it asks for on its own requests only, one after the other, so
    what is read and planned at a time is bounded by what one metric needs.  A batch that is run again
    replaces what it wrote.  Rows have the layout of ``catalog.as_measures`` and the request's id;
    a metric's rows lie in a folder ``job=<metric>`` of the batch.
    """

    def measure(batch: DataFrame, epoch: int):
        batch = cut(batch, "batch")
        # At most one name per metric of the catalog comes to the driver.
        names = sorted(r.metric for r in batch.select("metric").distinct().collect() if r.metric in METRIC_JOBS)
        for name in names:
            asked = batch.filter(F.col("metric") == name).drop("metric")
            granularity = DEFAULT_GRANULARITY[name]
            result = METRIC_JOBS[name](t, asked, granularity=granularity, **options)
            measured = as_measures(name, granularity, result, ["request_id"])
            measured.write.mode("overwrite").parquet(f"{path}/batch={epoch}/job={name}")

    return (
        once(requests).writeStream.foreachBatch(measure)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sink_measures(measures: DataFrame, path: str, checkpoint: str):
    """Append measures as parquet; handles all requests that are there, then stops."""
    return (
        measures.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


EVENT = "repository_cloned"


def onboard_projects(spark: SparkSession, source: str, catalog: str, checkpoint: str, events: str | None = None):
    """Seed the catalog of every project that arrives and tell that its repository is there.

    ``events`` is a folder of rows (event, project_id, batch), one for each new project.  A batch writes both
    sinks; one that is run again adds no second row to either: projects that the catalog holds are seeded no
    more, and a batch's events replace those it wrote before.  If it failed between the sinks, the projects
    are in the catalog under the same batch number, and are told then.
    """

    def seed(batch: DataFrame, epoch: int):
        session = batch.sparkSession
        rows = cut(batch.dropDuplicates(["id"]), "projects")
        known = session.read.schema("project_id BIGINT, metric_id INT, batch BIGINT").parquet(catalog)
        seeded = metrics_seed(rows).withColumn("batch", F.lit(epoch).cast("bigint"))
        new = seeded.join(known.filter(F.col("batch") != epoch), ["project_id", "metric_id"], "left_anti")
        new = cut(new, "seeded")
        new.drop("batch").write.mode("overwrite").parquet(f"{catalog}/batch={epoch}")
        if events is not None:
            told = new.select(F.lit(EVENT).alias("event"), "project_id").distinct()
            told.write.mode("overwrite").parquet(f"{events}/batch={epoch}")

    # An empty first write, so that the first batch finds a table to compare with.
    nothing = metrics_seed(spark.createDataFrame([], PROJECTS))
    nothing.write.mode("overwrite").parquet(f"{catalog}/batch=-1")
    if events is not None:
        nothing.select(F.lit(EVENT).alias("event"), "project_id").write.mode("overwrite").parquet(f"{events}/batch=-1")
    return (
        spark.readStream.schema(PROJECTS).parquet(source)
        .writeStream.foreachBatch(seed)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
