"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key, ``-ln(u) / weight`` with ``u`` from a hash of its
id, so that ascending keys are a weighted sample without replacement and reruns agree.
A source's whole passes come first; its last, fractional pass takes documents in the order
of their keys up to the budget.  The sums run over blocks of a range partitioning by
(source, key): a source with most of the rows is spread over many blocks.

A null or empty text has size 0 and is never taken; a null source is a source of its own,
last in order; a null id draws the key of null; a missing, null or non-positive weight
counts as ``LEAST_WEIGHT``; repeated rows are separate documents with equal keys (ties go by id and text).  An
empty table gives an empty mix.  Only ids, sources and texts are read, so other columns' names can't clash.  Sources
are a design parameter of a mix: steps on one row per source use one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm import words as W
from commitlens.session import cut

WORD = r"[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
LEAST_WEIGHT = 0.01


def size(text="text"):
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("bigint")


def text_weight(text="text"):
    """A document's quality weight from 1 down to LEAST_WEIGHT: less with every symbol among its characters."""
    plain = F.length(F.translate(F.col(text), "#*$%&|<>", ""))
    symbols = (F.length(F.col(text)) - plain) / F.greatest(F.length(F.col(text)), F.lit(1))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * symbols), F.lit(LEAST_WEIGHT))


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_PASSES, share=1.0) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  A target is
    ``level * weight`` but at most ``most`` times the size: the level at which all targets
    add up to ``share`` of all sizes.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("no", F.row_number().over(by_name) - 1)
    weighted = ranked.select(
        "source", "source_size", F.element_at(cycle, (F.col("no") % len(weights) + 1).cast("int")).alias("w")
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # With sources by cap / weight, those before the first that its level leaves below its cap are at theirs.
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_first())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighted.withColumn("place", F.row_number().over(by_ratio))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_w"))
        .withColumn("open", F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("place", "level")))
        .withColumn("open", F.min("open").over(everything))
    )
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(
        F.col("open.level") * F.col("w")
    )
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight=None, seed: int = 7, weights=WEIGHTS, most=MOST_PASSES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, tie) of every document; ``tie`` is a hash of the text.

    ``taken`` counts words with repeats; ``copies`` how often the document occurs in the
    mix.  The last pass takes documents in the order of their keys while they fit
    the budget, and then the one of the rest, if any, that brings the sum nearest to it.
    """
    spark = docs.sparkSession
    weight = text_weight() if weight is None else weight
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    measured = cut(
        docs.select(
            "doc_id",
            "source",
            size().alias("size"),
            F.xxhash64("text").alias("tie"),
            (-F.log(u) / F.greatest(F.coalesce(weight.cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))).alias("key"),
        ),
        "measured",
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(
        measured.repartitionByRange(tasks, F.col("source").asc_nulls_last(), "key", "doc_id", "tie").withColumn(
            "block", F.spark_partition_id()
        ),
        "blocks",
    )
    sums = blocks.groupBy("source", "block").agg(F.sum("size").alias("words"))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")
    ).join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "tie")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    placed = cut(
        blocks.withColumn("place", F.row_number().over(within))
        .withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("upto", F.col("start") + F.col("upto"))
        .withColumn("passes", passes)
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("chosen", F.col("upto") <= F.col("budget"))
        .drop("s", "b", "start"),
        "placed",
    )
    # One more document of each source may come nearer to its budget.
    gaps = placed.groupBy("source").agg(
        (F.max("budget") - F.coalesce(F.max(F.when(F.col("chosen"), F.col("upto"))), F.lit(0))).alias("gap")
    )
    left = (
        placed.filter(~F.col("chosen") & (F.col("size") > 0))
        .join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "key", "block", "place", "gap")).alias("last"))
        .filter(F.col("last.miss") < F.col("last.gap"))
        .select(F.col("source").alias("s"), F.col("last.block").alias("b"), F.col("last.place").alias("p"))
    )
    last = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("place") == F.col("p"))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("chosen") | F.col("p").isNotNull()).cast("bigint")).otherwise(0)
    return placed.join(left, last, "left").withColumn("copies", F.least(copies, F.lit(most)).cast("bigint")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "tie"
    )


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The texts of a mix with ``copies`` and ``taken``; equal (id, source, text) rows are merged and their
    copies added.  Columns of the documents with these two names are replaced."""
    columns = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    names = {n: W.unused(docs, f"_{n}") for n in ("id", "source", "tie", "text", "copies", "taken")}
    taken = (
        mixed.filter(F.col("copies") > 0)
        .groupBy(*[F.col(c).alias(names[n]) for c, n in (("doc_id", "id"), ("source", "source"), ("tie", "tie"))])
        .agg(*[F.sum(n).alias(names[n]) for n in ("copies", "taken")])
    )
    once = docs.select(*columns, F.xxhash64("text").alias(names["text"])).dropDuplicates(["doc_id", "source", names["text"]])
    same = F.col("doc_id").eqNullSafe(F.col(names["id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(names["text"]) == F.col(names["tie"]))
    return once.join(taken, same).select(*columns, *[F.col(names[n]).alias(n) for n in ("copies", "taken")])
