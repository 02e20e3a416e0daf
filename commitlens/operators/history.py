"""Order of commits and running aggregates over history.

One project, or one path of it, may hold a large share of all rows, so no window
here is partitioned by project or path alone.  Rows are cut into buckets that
follow the order; totals per bucket are small and carry the running value from
one bucket to the next.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_BUCKET = 4096


def _before():
    return (Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys, levels, order, name) -> DataFrame:
    """Add the 1-based position of every row within ``keys`` under ``order``.

    ``levels`` are two columns, coarse then fine, that never decrease along
    ``order``: a task sorts one (keys, coarse, fine) group, never a whole key.
    """
    coarse, fine = "_coarse", "_fine"
    tagged = df.select("*", levels[0].alias(coarse), levels[1].alias(fine))
    groups = tagged.groupBy(*keys, coarse, fine).agg(F.count(F.lit(1)).alias("_n"))
    by_coarse = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(*_before())
    by_fine = Window.partitionBy(*keys, coarse).orderBy(fine).rowsBetween(*_before())
    outer = (
        groups.groupBy(*keys, coarse)
        .agg(F.sum("_n").alias("_n"))
        .select(*keys, coarse, F.coalesce(F.sum("_n").over(by_coarse), F.lit(0)).alias("_outer"))
    )
    offsets = (
        groups.withColumn("_inner", F.coalesce(F.sum("_n").over(by_fine), F.lit(0)))
        .join(outer, [*keys, coarse])
        .select(*keys, coarse, fine, (F.col("_outer") + F.col("_inner")).alias("_offset"))
    )
    within = Window.partitionBy(*keys, coarse, fine).orderBy(*order)
    return (
        tagged.join(offsets, [*keys, coarse, fine])
        .withColumn(name, F.col("_offset") + F.row_number().over(within))
        .drop(coarse, fine, "_offset")
    )


def history_order(commits: DataFrame) -> DataFrame:
    """Add ``seq``: position of a commit in its project, oldest first, ties by sha."""
    day = F.floor(F.col("ts") / 86400)
    second = F.struct(F.col("ts"), F.substring("sha", 1, 2).alias("prefix"))
    return positions(commits, ["project_id"], [day, second], ["sha"], "seq")


def running(df: DataFrame, keys, sums: dict[str, Column], order=("seq",), last: int | None = None) -> DataFrame:
    """Add running sums of ``sums`` within ``keys`` along ``seq``, current row included.

    ``order`` starts with ``seq``; a key has few rows per ``seq``, so a bucket of
    ``SEQ_BUCKET`` consecutive values bounds what one task sorts.  With ``last``, no ``seq`` being
    greater, rows that all lie in the first bucket are sorted at once and nothing is carried on.
    """
    bucket = "_bucket"
    values = {f"_v{i}": column for i, column in enumerate(sums.values())}
    if last is not None and last < SEQ_BUCKET:
        alone = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        valued = df.dropna(subset=[*keys, "seq"]).select("*", *[c.alias(n) for n, c in values.items()])
        return valued.select("*", *[F.sum(v).over(alone).alias(n) for n, v in zip(sums, values)]).drop(*values)
    tagged = df.select(
        "*", F.floor(F.col("seq") / SEQ_BUCKET).alias(bucket), *[c.alias(n) for n, c in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*_before())
    carried = (
        tagged.groupBy(*keys, bucket)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *keys,
            bucket,
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values],
        )
    )
    so_far = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    result = tagged.join(carried, [*keys, bucket])
    for name, v in zip(sums, values):
        result = result.withColumn(name, F.col(f"{v}_before") + F.sum(v).over(so_far))
    return result.drop(bucket, *values, *[f"{v}_before" for v in values])


def count_as_of(events: DataFrame, points: DataFrame, keys, name, weight=None) -> DataFrame:
    """Number of ``events`` (or sum of their ``weight``) with the same keys and ``seq`` not after the point's.

    ``points`` holds distinct (keys, seq) rows; the result adds ``name`` to them.
    """
    columns = [*keys, "seq"]
    worth = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    both = events.select(*columns, F.lit(0).alias("_point"), worth.alias("_weight")).unionByName(
        points.select(*columns, F.lit(1).alias("_point"), F.lit(0).cast("bigint").alias("_weight"))
    )
    counted = running(both, keys, {name: F.col("_weight")}, ("seq", "_point"))
    return counted.filter(F.col("_point") == 1).select(*columns, name)


def greatest_before(df: DataFrame, keys, order, value: str, name: str) -> DataFrame:
    """Add the greatest ``value`` of the rows with the same keys that come earlier; 0 if there are none.

    ``order`` starts with a position, whose buckets bound what one task sorts.
    """
    bucket = "_bucket"
    tagged = df.withColumn(bucket, F.floor(F.col(order[0]) / SEQ_BUCKET))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*_before())
    carried = (
        tagged.groupBy(*keys, bucket)
        .agg(F.max(value).alias("_most"))
        .select(*keys, bucket, F.coalesce(F.max("_most").over(earlier), F.lit(0)).alias("_carried"))
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*_before())
    return (
        tagged.join(carried, [*keys, bucket])
        .withColumn(name, F.greatest("_carried", F.coalesce(F.max(value).over(within), F.lit(0))))
        .drop(bucket, "_carried")
    )


def within_ranges(ranges: DataFrame, rows: DataFrame, keys, low: str, high: str, position: str) -> DataFrame:
    """Each range with all rows of the same keys whose position lies behind ``low`` and not behind ``high``.

    Ranges are spread over the buckets they touch, so that the rows of a hot key meet in many tasks.
    """
    bucket = "_bucket"
    touched = F.sequence(F.floor((F.col(low) + 1) / SEQ_BUCKET), F.floor(F.col(high) / SEQ_BUCKET))
    spread = ranges.withColumn(bucket, F.explode(touched))
    placed = rows.withColumn(bucket, F.floor(F.col(position) / SEQ_BUCKET))
    inside = (F.col(position) > F.col(low)) & (F.col(position) <= F.col(high))
    return spread.join(placed, [*keys, bucket]).filter(inside).drop(bucket)


def join_until(points: DataFrame, events: DataFrame, keys) -> DataFrame:
    """Each point with all events of the same keys and ``seq`` not after its ``till``.

    Points are spread over the buckets of history before them, so that the rows
    of a hot key meet in many tasks.
    """
    bucket = "_bucket"
    last = F.floor(F.col("till") / SEQ_BUCKET)
    spread = points.withColumn(bucket, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    dated = events.withColumn(bucket, F.floor(F.col("seq") / SEQ_BUCKET))
    return spread.join(dated, [*keys, bucket]).filter(F.col("seq") <= F.col("till")).drop(bucket)


def before_last(df: DataFrame, keys, nth: str, value: str, last: int | None = None) -> DataFrame:
    """Rows that have one before them, with the ``value`` of that one and of the one before it, as ``value`` with _1 and _2.

    ``nth`` numbers the rows of a key without gaps.  The last two rows of a bucket are sent to the next one as well,
    so that one sorted pass over buckets finds both.  ``last`` as in ``running``: a key that was sorted at once there is so here.
    """
    bucket = "_bucket"
    own = F.floor(F.col(nth) / SEQ_BUCKET)
    if last is not None and last < SEQ_BUCKET:
        own = F.lit(0)
        placed, groups = df.dropna(subset=[*keys]).withColumn(bucket, own), [*keys]
    else:
        spread = F.explode(F.array_distinct(F.array(own, F.floor((F.col(nth) + 2) / SEQ_BUCKET))))
        placed, groups = df.dropna(subset=[*keys]).withColumn(bucket, spread), [*keys, bucket]
    ordered = Window.partitionBy(*groups).orderBy(nth)
    earlier = [F.lag(F.struct(value), n).over(ordered).alias(f"_{n}") for n in (1, 2)]
    found = placed.select("*", *earlier).filter((F.col(bucket) == own) & F.col("_1").isNotNull())
    return found.select(*df.columns, *[F.col(f"_{n}")[value].alias(f"{value}_{n}") for n in (1, 2)])


def touches(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Change keys with their commit's position, time and author."""
    return changes.select("project_id", "sha", "path").join(
        commits.select("project_id", "sha", "seq", "ts", "author_name", "author_email"),
        ["project_id", "sha"],
    )


def all_equal(keys, prefix: str) -> Column:
    """Every key equals the column of the same name with ``prefix`` before it."""
    return reduce(and_, [F.col(k) == F.col(prefix + k) for k in keys])
