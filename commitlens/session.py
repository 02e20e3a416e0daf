"""Where intermediate results go when a job must cut its lineage.

The cluster names a shared folder in ``spark.checkpoint.dir``.  Without it the tables
go beside the warehouse, if every executor reaches that as well.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a local one")
    return f"{warehouse}/_intermediate"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table one query writes and reads."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute ``df`` once: write it to the shared folder as parquet and read it back.

    Unlike a checkpoint the table has a known size, so a join with it is
    broadcast only where Spark has checked that it fits.
    """
    return _write(df, scratch(df.sparkSession, name))


def write_table(df: DataFrame, path: str) -> None:
    """Write an intermediate table; names, digests and texts take about half the space that Spark's default needs."""
    df.write.option("compression", "zstd").parquet(path)


def _write(df, path):
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop: each round's is written like a ``cut``, and the one before is deleted.

    Only for tables that nothing but the next round reads.
    """

    def __init__(self, name: str):
        self.name = name
        self.path = None

    def put(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = scratch(spark, self.name)
        table = _write(df, self.path)
        if old:
            place = spark._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return table
