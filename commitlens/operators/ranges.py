"""Line ranges: collapsing, reading them off patches, overlap."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions.hunks import ranges_of
from commitlens.functions.names import packed, unpacked
from commitlens.functions.text import split_lines
from commitlens.schemas import CHANGE_KEY, INSERTED, REMOVED


def collapse_ranges(lines: DataFrame, keys, line="line") -> DataFrame:
    """Runs of consecutive line numbers per key as ``begin``/``end``.

    Keys are expected to name one file version; a repeated number starts a new range.
    """
    return merge_ranges(
        lines.select(*keys, F.col(line).alias("begin"), F.col(line).alias("end")), keys
    )


def merge_ranges(ranges: DataFrame, keys) -> DataFrame:
    """Join ranges that continue each other: ``begin`` is one past the previous ``end``."""
    ordered = Window.partitionBy(*keys).orderBy("begin", "end")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.coalesce(F.col("begin") != F.lag("end").over(ordered) + 1, F.lit(True))
    return (
        ranges.withColumn("_starts", starts.cast("int"))
        .withColumn("_run", F.sum("_starts").over(so_far))
        .groupBy(*keys, "_run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .drop("_run")
    )


# Lines end at \n only, here as where the kinds of lines are cut.
_HEADER = r"(?md)^@@+ -(\d+)(?:,(\d+))?(?: -\d+(?:,\d+)?)* \+(\d+)(?:,(\d+))? @@"
# The patch of a merge: one more @ for every further parent.
_COMBINED = r"(?md)^@@(@+) -\d"


def _line_kinds(patch: Column, parents: Column) -> Column:
    """One character per patch line, an empty line counts as context; none for lines that
    neither the first parent nor the new version has.

    With several parents a line has a column for each.  A line with a minus is in the parents that show it,
    any other is in the new version and in the parents that show no plus.
    """

    def kind(line):
        columns = F.substring(line, F.lit(1), parents)
        first = F.substring(line, 1, 1)
        return F.when(first == "@", first).when((first == "") | (first == " ") & ~columns.contains("-"), F.lit(" ")).when(
            columns.contains("-"), F.when(first == "-", first).otherwise("")
        ).otherwise(first)

    combined = F.array_join(F.transform(F.split(patch, "\n", -1), kind), "")
    # With one parent a line's kind is its first character: no array of lines is made.
    spaced = F.regexp_replace(F.concat(F.lit("\n"), patch), r"\n(?=\n|\z)", "\n ")
    return F.when(parents > 1, combined).otherwise(F.regexp_replace(spaced, r"\n([^\n])[^\n]*+", "$1"))


def patch_linechanges(patches: DataFrame) -> DataFrame:
    """Inserted (new numbering) and deleted (old numbering) ranges of every patch.

    Patches are read inside their row: a character per line and the numbers of hunks leave it, so no
    patch text is shuffled, and a change is one row until its ranges are known.  A combined patch of a merge
    (``@@@``) gives the ranges that differ from its first parent.
    """
    parents = F.length(F.regexp_extract("patch", _COMBINED, 1)) + 1
    # The part before the first header is no hunk.  An old side of zero lines
    # names the line before the hunk, hence the step by one.
    key = ["project_id", "name", "path"]
    read = patches.filter(F.col("patch").isNotNull()).select(
        "project_id", packed(F.col("sha")).alias("name"), "path", F.regexp_extract_all("patch", F.lit(_HEADER), F.lit(0)).alias("headers"),
        F.regexp_extract(_line_kinds(F.col("patch"), parents), "(?s)@.*", 0).alias("kinds"),
    )

    def starts(n):
        part = lambda h, i: F.regexp_extract(h, _HEADER, i)
        return F.transform("headers", lambda h: part(h, n).cast("bigint") + (part(h, n + 1) == "0").cast("int"))

    hunks = read.select(*key, starts(1).alias("olds"), starts(3).alias("news"), "kinds")
    # Rows of one change are one version, so they are read together.
    beside = hunks.repartition(*key).sortWithinPartitions(*key)
    path = patches.schema["path"].dataType.simpleString()
    kind = f"project_id {patches.schema['project_id'].dataType.simpleString()}, name binary, path {path}, kind string, ranges array<struct<`begin`:bigint,`end`:bigint>>"
    found = beside.mapInArrow(ranges_of(key, (INSERTED, REMOVED)), kind)
    named = found.select("project_id", unpacked(F.col("name")).alias("sha"), "path", "kind", F.posexplode("ranges").alias("nth", "range"))
    return named.select(*CHANGE_KEY, "kind", "range.begin", "range.end")


def blame_ranges(blame: DataFrame) -> DataFrame:
    """Blame (change, line, last_sha) as (change, begin, end, last_sha): what a project should keep of it."""
    return collapse_ranges(blame, [*CHANGE_KEY, "last_sha"])


def last_modifiers(linechanges: DataFrame, blame: DataFrame) -> DataFrame:
    """For the deleted ranges of each change: ranges grouped by last modifying commit.

    ``blame`` has ranges (begin, end, last_sha) or lines (line, last_sha) of the old version.  Both sets of
    ranges are cut at each other's ends in one sorted pass, so work grows with the ranges and not with
    the lines in them.  A line has one last commit; of several the greatest name counts.
    """
    found = modified_pieces(linechanges, blame)
    return found.select("project_id", unpacked(F.col("name")).alias("sha"), "path", "last_sha", "begin", "end")


PACKED_KEY = ["project_id", "name", "path"]


def modified_pieces(linechanges: DataFrame, blame: DataFrame) -> DataFrame:
    """``last_modifiers`` by PACKED_KEY, the commit's name as bytes.

    Ranges of a change are brought together once and stay where they are.
    """
    key = PACKED_KEY
    if "line" in blame.columns:
        blame = blame.select(*CHANGE_KEY, F.col("line").alias("begin"), F.col("line").alias("end"), "last_sha")

    def ranged(rows, depth, last):
        ends = [F.col(c).cast("bigint").alias(c) for c in ("begin", "end")]
        return rows.select("project_id", packed(F.col("sha")).alias("name"), "path", *ends, F.lit(depth).alias("deep"), last.alias("last"))

    deleted = ranged(linechanges.filter(F.col("kind") == "-"), 1, F.lit(None).cast("binary"))
    both = deleted.unionByName(ranged(blame, 0, packed(F.col("last_sha")))).repartition(*key)
    who = F.when(F.col("deep") == 0, F.struct("end", unpacked(F.col("last")).alias("last_sha")))
    nobody = F.lit(None).cast("struct<end:bigint,last_sha:string>")
    point = lambda at, depth, who: F.struct(at.alias("at"), depth.alias("depth"), who.alias("who"))
    points = (
        both.select(*key, F.inline(F.array(point(F.col("begin"), F.col("deep"), who), point(F.col("end") + 1, -F.col("deep"), nobody))))
        .groupBy(*key, "at")
        .agg(F.sum("depth").alias("depth"), F.max("who").alias("who"))
    )
    ordered = Window.partitionBy(*key).orderBy("at")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(
        *key, F.col("at").alias("begin"), (F.lead("at").over(ordered) - 1).alias("end"),
        F.sum("depth").over(so_far).alias("depth"), F.last("who", ignorenulls=True).over(so_far).alias("who"),
    )
    asked = pieces.filter((F.col("depth") > 0) & (F.col("who.end") >= F.col("begin")))
    return merge_ranges(asked.select(*key, "who.last_sha", "begin", "end"), [*key, "last_sha"])


def function_lines(blobs: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per function span with the lines it covers.

    Spans of one file travel to the row of its text, so a text is moved once
    however many functions it has.
    """
    spans = functions.groupBy("oid").agg(
        F.collect_list(F.struct("ord", "signature", "begin_line", "end_line")).alias("spans")
    )
    return (
        blobs.filter(F.col("content").isNotNull())
        .join(spans, "oid")
        .select("oid", split_lines(F.col("content")).alias("lines"), F.explode("spans").alias("span"))
        .select(
            "oid",
            "span.*",
            F.slice(
                "lines", F.col("span.begin_line"), F.col("span.end_line") - F.col("span.begin_line") + 1
            ).alias("lines"),
        )
    )
