"""Metrics of file contents: lines of code, function churn, complexity, nesting, flow.

Content is addressed by object id, so each version is measured once and the
small result is joined to all changes that lead to it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import paths, text
from commitlens.operators import history, ranges
from commitlens.operators.change import asked_only, for_requests
from commitlens.schemas import CHANGE_KEY, MODIFIED, NO_OID
from commitlens.session import cut


def _only_comment(line: Column, covered: Column) -> Column:
    """Nothing but blanks is left once every copy of the comment text is removed."""
    rest = F.replace(line, covered, F.lit(""))
    return ~rest.rlike(r"[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _comment_lines(lines: Column, comment: Column) -> Column:
    """Line numbers that one comment turns into comment lines."""
    begin, end = comment["begin_line"], comment["end_line"]
    first, last = F.get(lines, begin - 1), F.get(lines, end - 1)
    width = comment["end_col"] - comment["begin_col"] + 1
    none = F.array().cast("array<int>")
    single = F.when(
        _only_comment(first, F.substring(first, comment["begin_col"], width)), F.array(begin)
    ).otherwise(none)
    opening = F.when(
        _only_comment(first, F.substring(first, comment["begin_col"], F.length(first))), F.array(begin)
    ).otherwise(none)
    inside = F.when(end - begin > 1, F.sequence(begin + 1, end - 1)).otherwise(none)
    closing = F.when(
        _only_comment(last, F.substring(last, F.lit(1), comment["end_col"])), F.array(end)
    ).otherwise(none)
    return F.when(begin == end, single).otherwise(F.concat(opening, inside, closing))


# Measures of a function's body, by metric.
BODY_MEASURES = {"complexity": text.decision_count, "nesting": text.brace_depth}


def line_flags(blobs: DataFrame, comments: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Per text: the number of its lines, and the numbers of its comment lines and of its blank lines.

    An empty line inside a comment is a comment line only; a line of blanks is neither.  With ``functions``
    also ``measured``: its spans with BODY_MEASURES of their bodies, from the same reading of the text.
    """
    spans = comments.groupBy("oid").agg(
        F.collect_list(
            F.struct(*[F.col(c).cast("int").alias(c) for c in ("begin_line", "begin_col", "end_line", "end_col")])
        ).alias("spans")
    )
    there = blobs.filter(F.col("content").isNotNull()).join(spans, "oid", "left")
    measured = []
    if functions is not None:
        bodies = functions.groupBy("oid").agg(F.collect_list(F.struct("ord", "signature", "begin_line", "end_line")).alias("bodies"))
        there, measured = there.join(bodies, "oid", "left"), ["bodies"]
    lined = there.select("oid", text.split_lines(F.col("content")).alias("lines"), "spans", *measured)
    commented = F.coalesce(
        F.array_distinct(F.flatten(F.transform("spans", lambda c: _comment_lines(F.col("lines"), c)))),
        F.array().cast("array<int>"),
    )
    numbers = F.transform("lines", lambda line, i: F.when(line == "", i + 1))
    if measured:
        body = lambda s: F.array_join(F.slice("lines", s["begin_line"], s["end_line"] - s["begin_line"] + 1), "\n")
        of_body = lambda s, b: F.struct(s.alias("span"), *[m(b).alias(n) for n, m in BODY_MEASURES.items()])
        # The one-element array names the body, so that it is cut out once.
        measured = [F.flatten(F.transform("bodies", lambda s: F.transform(F.array(body(s)), lambda b: of_body(s, b)))).alias("measured")]
    return lined.select(
        "oid",
        "lines",
        commented.alias("commented"),
        *measured,
    ).select(
        "oid",
        F.size("lines").alias("aggregate"),
        "commented",
        F.array_except(F.filter(numbers, lambda n: n.isNotNull()), F.col("commented")).alias("blanks"),
        *["measured" for _ in measured],
    )


def _loc(blank: Column, comment: Column, aggregate: Column) -> list[Column]:
    return [
        blank.cast("bigint").alias("blank"),
        comment.cast("bigint").alias("comment"),
        (aggregate - blank - comment).cast("bigint").alias("source"),
        aggregate.cast("bigint").alias("aggregate"),
    ]


def blob_loc(blobs, comments) -> DataFrame:
    return line_flags(blobs, comments).select(
        "oid", *_loc(F.size("blanks"), F.size("commented"), F.col("aggregate"))
    )


def blob_function_loc(blobs, comments, functions) -> DataFrame:
    """Line counts per function span; of equal signatures the last one counts."""
    return _function_loc(line_flags(blobs, comments), functions)


def _function_loc(flags: DataFrame, functions: DataFrame) -> DataFrame:
    """Line counts of function spans, from ``line_flags``.

    Spans ask before their first line and after their last for running counts over the flagged lines of
    their file, so a file of n lines and m spans is one sorted pass over n + 2m rows at most.
    """
    length = F.col("end_line") - F.col("begin_line") + 1
    spans = functions.select("oid", "begin_line", "end_line", F.struct("ord", "signature", length.alias("lines")).alias("span"))
    nobody = F.lit(None).cast(spans.schema["span"].dataType)

    def row(line, side, known=0, blank=0, comment=0):
        values = {"side": side, "known": known, "blank": blank, "comment": comment}
        return F.struct(line.cast("bigint").alias("line"), *[F.lit(v).alias(k) for k, v in values.items()])

    flagged = F.concat(
        F.array(row(F.lit(-1), 0, known=1)),
        F.transform("commented", lambda n: row(n, 0, comment=1)),
        F.transform("blanks", lambda n: row(n, 0, blank=1)),
    )
    lines = flags.select("oid", nobody.alias("span"), F.inline(flagged))
    asks = spans.select("oid", "span", F.inline(F.array(row(F.col("begin_line") - 1, -1), row(F.col("end_line"), 1))))
    # At equal lines a flagged line comes first, so that both asks are answered after it.
    upto = Window.partitionBy("oid").orderBy("line", F.abs("side")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(upto).alias(c) for c in ("known", "blank", "comment")]
    answered = lines.unionByName(asks).select("oid", "span", "side", *sums).filter("span IS NOT NULL AND known > 0")
    inside = answered.groupBy("oid", "span").agg(*[F.sum(F.col("side") * F.col(c)).alias(c) for c in ("blank", "comment")])
    counted = inside.select("oid", "span.ord", "span.signature", *_loc(F.col("blank"), F.col("comment"), F.col("span.lines")))
    return last_wins(counted, ["blank", "comment", "source", "aggregate"])


def last_wins(rows: DataFrame, columns) -> DataFrame:
    """Keep the row of the highest ``ord`` per (oid, signature)."""
    return (
        rows.groupBy("oid", "signature")
        .agg(F.max_by(F.struct(*columns), "ord").alias("kept"))
        .select("oid", "signature", "kept.*")
    )


def version_key(oid: str, wanted: Column) -> Column:
    """Join key of a file version; one that matches nothing when there is none to read.

    Missing versions may be a large share of all rows, so they get many keys.
    """
    none = F.concat(F.lit("none-"), F.pmod(F.xxhash64("sha", "path"), F.lit(4096)).cast("string"))
    return F.when(wanted & (F.col(oid) != NO_OID), F.col(oid)).otherwise(none)


def _of_changes(t, requests, measures: DataFrame, parsed_only: bool) -> DataFrame:
    """Join measures of versions to the changes that lead to them; changes without a version to read stay out of the join."""
    wanted = paths.is_parsable(F.col("path")) if parsed_only else F.lit(True)
    readable = F.coalesce(wanted & (F.col("oid_after") != NO_OID), F.lit(False))
    measured = t.changes.filter(readable).select(*CHANGE_KEY, F.col("oid_after").alias("oid")).join(measures, "oid", "left").drop("oid")
    nothing = [F.lit(None).cast(measures.schema[c].dataType).alias(c) for c in measures.columns if c != "oid"]
    return for_requests(measured.unionByName(t.changes.filter(~readable).select(*CHANGE_KEY, *nothing)), requests)


def loc(t, requests=None, granularity="file", **options) -> DataFrame:
    """Blank, comment, source and all lines of the new version.

    ``granularity='function'`` gives ``map<signature, struct>``; any other value
    than ``function`` means ``file``.
    """
    t = asked_only(t, requests)
    if granularity != "function":
        return _of_changes(t, requests, blob_loc(t.blobs, t.comments), True)
    there = t.blobs.filter(F.col("content").isNotNull()).select("oid")
    return _loc_of_functions(t, requests, blob_function_loc(t.blobs, t.comments, t.functions), there)


def _loc_of_functions(t, requests, functions: DataFrame, there: DataFrame) -> DataFrame:
    per_blob = functions.groupBy("oid").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct("signature", F.struct("blank", "comment", "source", "aggregate").alias("loc"))
                )
            )
        ).alias("loc")
    )
    empty = F.from_json(
        F.lit("{}"), "map<string,struct<blank:bigint,comment:bigint,source:bigint,aggregate:bigint>>"
    )
    measured = there.join(per_blob, "oid", "left")
    return _of_changes(t, requests, measured.select("oid", F.coalesce("loc", empty).alias("loc")), True)


def functionchurn(t, requests=None, **options) -> DataFrame:
    """Functions inserted, deleted and modified by a change.

    A modified function is one of the new version whose signature both versions
    have and whose span meets a changed range, whichever numbering the range uses.
    """
    t = asked_only(t, requests)
    # Empty and missing contents are never parsed.
    functions = t.functions.join(t.blobs.filter(F.col("content") != "").select("oid"), "oid", "left_semi")
    names = functions.select("oid", "signature").distinct()
    number = names.groupBy("oid").agg(F.count(F.lit(1)).alias("n"))
    readable = F.coalesce(paths.is_supported(F.col("language")) & paths.is_parsable(F.col("path")), F.lit(False))
    languages = t.projects.select(F.col("id").alias("project_id"), "language")
    all_versions = t.changes.join(languages, "project_id")
    supported = paths.is_supported(F.col("language")).alias("supported")
    # Changes whose versions nobody reads stay out of the joins below.
    versions = all_versions.filter(readable).select(
        *CHANGE_KEY,
        "type",
        supported,
        version_key("oid_before", F.lit(True)).alias("oid_before"),
        version_key("oid_after", F.lit(True)).alias("oid_after"),
    )
    # Signatures are compared once for every pair of versions, however many changes lead from one to the other.
    pair = ["oid_before", "oid_after"]
    pairs = versions.select(*pair).distinct()
    kept = pairs.join(names.withColumnRenamed("oid", "oid_before"), "oid_before").join(
        names.withColumnRenamed("oid", "oid_after"), ["oid_after", "signature"]
    )
    common = kept.groupBy(*pair).agg(F.count(F.lit(1)).alias("common"))
    counted = (
        versions.join(number.select(F.col("oid").alias("oid_before"), F.col("n").alias("b")), "oid_before", "left")
        .join(number.select(F.col("oid").alias("oid_after"), F.col("n").alias("a")), "oid_after", "left")
        .join(common, pair, "left")
        .join(_modified(versions, kept, functions, t.linechanges.filter(paths.is_parsable(F.col("path")))), CHANGE_KEY, "left")
    )
    parsed = F.col("a").isNotNull() | F.col("b").isNotNull()

    def when_parsed(n):
        return F.when(parsed, n.cast("bigint"))

    shared = F.coalesce("common", F.lit(0))
    measures = counted.select(
        *CHANGE_KEY,
        "supported",
        when_parsed(F.coalesce("a", F.lit(0)) - shared).alias("insertions"),
        when_parsed(F.coalesce("b", F.lit(0)) - shared).alias("deletions"),
        when_parsed(F.coalesce("modified", F.lit(0))).alias("modifications"),
    ).withColumn("aggregate", F.col("insertions") + F.col("deletions") + F.col("modifications"))
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("insertions", "deletions", "modifications", "aggregate")]
    unread = all_versions.filter(~readable).select(*CHANGE_KEY, supported, *nothing)
    return for_requests(measures.unionByName(unread), requests)


def _met(spans: DataFrame, linechanges: DataFrame) -> DataFrame:
    """The spans (change, begin_line, end_line, ...) that a changed range of their change meets.

    A span is met if the furthest end of the ranges that begin before its end lies
    behind its begin: one sorted pass over the ranges and spans of a change.
    """
    kept = F.struct(*[c for c in spans.columns if c not in CHANGE_KEY])
    asks = spans.select(*CHANGE_KEY, kept.alias("span"), F.col("end_line").cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("end"))
    ranged = linechanges.select(
        *CHANGE_KEY, F.lit(None).cast(asks.schema["span"].dataType).alias("span"),
        F.col("begin").cast("bigint").alias("at"), F.col("end").cast("bigint").alias("end"),
    )
    # At equal places ranges come first.
    upto = Window.partitionBy(*CHANGE_KEY).orderBy("at", F.col("span").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = asks.unionByName(ranged).select(*CHANGE_KEY, "span", F.max("end").over(upto).alias("furthest"))
    return both.filter(F.col("furthest") >= F.col("span.begin_line")).select(*CHANGE_KEY, "span.*")


def _modified(versions, kept, functions, linechanges) -> DataFrame:
    """(change, modified): functions of the new version that the old one had, and that a changed range meets."""
    spans = kept.join(functions.withColumnRenamed("oid", "oid_after"), ["oid_after", "signature"])
    changed = versions.filter(F.col("type") == MODIFIED).select(*CHANGE_KEY, "oid_before", "oid_after")
    asks = changed.join(spans, ["oid_before", "oid_after"]).select(*CHANGE_KEY, "begin_line", "end_line")
    ranged = linechanges.join(asks.select(*CHANGE_KEY).distinct(), CHANGE_KEY, "left_semi")
    return _met(asks, ranged).groupBy(*CHANGE_KEY).agg(F.count(F.lit(1)).alias("modified"))


def signature_sides(t) -> DataFrame:
    """Every signature of the old or new version of a change, and on which side it is."""
    names = t.functions.select("oid", "signature").distinct()
    changes = t.changes.select(*CHANGE_KEY, "oid_before", "oid_after")

    def side(column, flag):
        version = names.withColumnRenamed("oid", column)
        return changes.filter(F.col(column) != NO_OID).join(version, column).select(*CHANGE_KEY, "signature", F.lit(True).alias(flag))

    both = side("oid_before", "b").join(side("oid_after", "a"), [*CHANGE_KEY, "signature"], "full_outer")
    return both.select(
        *CHANGE_KEY,
        "signature",
        F.coalesce("b", F.lit(False)).alias("in_before"),
        F.coalesce("a", F.lit(False)).alias("in_after"),
    )


def function_line_overlap(t) -> DataFrame:
    """Functions of the new version whose span meets a changed range."""
    there = t.changes.filter(F.col("oid_after") != NO_OID)
    spans = there.select(*CHANGE_KEY, F.col("oid_after").alias("oid")).join(t.functions, "oid").drop("oid")
    return _met(spans, t.linechanges.join(spans.select(*CHANGE_KEY).distinct(), CHANGE_KEY, "left_semi"))


def line_in_function(t) -> DataFrame:
    """(oid, ord, line) of every line of a function and whether it is blank or comment."""
    flags = line_flags(t.blobs, t.comments)
    marked = flags.select("oid", F.explode("commented").alias("line"), F.lit(True).alias("comment")).unionByName(
        flags.select("oid", F.explode("blanks").alias("line"), F.lit(False).alias("comment"))
    )
    lines = t.functions.join(flags.select("oid"), "oid").select(
        "oid", "ord", F.explode(F.sequence("begin_line", "end_line")).alias("line")
    )
    return lines.join(marked, ["oid", "line"], "left").select(
        "oid", "ord", "line",
        F.coalesce("comment", F.lit(False)).alias("is_comment"),
        F.coalesce(~F.col("comment"), F.lit(False)).alias("is_blank"),
    )


def comment_on_line(t) -> DataFrame:
    """(oid, line) of the lines that hold nothing but comment."""
    return line_flags(t.blobs, t.comments).select("oid", F.explode("commented").alias("line"))


def _per_function(t, requests, name) -> DataFrame:
    t = asked_only(t, requests)
    bodies = ranges.function_lines(t.blobs, t.functions).select(
        "oid", "ord", "signature", F.array_join("lines", "\n").alias("body")
    )
    return _map_of_functions(t, requests, name, bodies.select("oid", "ord", "signature", BODY_MEASURES[name](F.col("body")).alias(name)))


def _map_of_functions(t, requests, name, measured: DataFrame) -> DataFrame:
    per_blob = last_wins(measured, [name]).groupBy("oid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("signature", name)))).alias(name)
    )
    return _of_changes(t, requests, per_blob, False)


def complexity(t, requests=None, **options) -> DataFrame:
    """``map<signature, 1 + decision points>`` of the new version; null without functions."""
    return _per_function(t, requests, "complexity")


def nesting(t, requests=None, **options) -> DataFrame:
    """``map<signature, deepest block nesting>`` of the new version; null without functions."""
    return _per_function(t, requests, "nesting")


def function_measures(t, requests=None, names=("loc", *BODY_MEASURES), **options) -> dict[str, DataFrame]:
    """``loc`` by function, ``complexity`` and ``nesting`` from one reading of the texts.

    What is kept in between are numbers of lines and spans, no text.
    """
    t = asked_only(t, requests)
    flags = cut(line_flags(t.blobs, t.comments, t.functions), "flags")
    spans = flags.select("oid", F.explode("measured").alias("m")).select("oid", "m.span.ord", "m.span.signature", *[f"m.{n}" for n in BODY_MEASURES])
    out = {n: _map_of_functions(t, requests, n, spans.select("oid", "ord", "signature", n)) for n in BODY_MEASURES}
    out["loc"] = _loc_of_functions(t, requests, _function_loc(flags, t.functions), flags.select("oid"))
    return {n: out[n] for n in names}


# Analyser metrics that make up the flow of an entity.
FLOW_METRICS = {"CountInput": "ninput", "CountOutput": "noutput", "CountPath": "npath"}


def flow(t, requests=None, **options) -> DataFrame:
    """Entities with at least one known flow count.

    ``entity_metrics`` holds ``entity`` and a ``metrics`` map; a key that is
    absent from the map is an error, a null value is not.
    """

    def value(key):
        return F.when(F.map_contains_key("metrics", key), F.element_at("metrics", key)).otherwise(
            F.raise_error(F.lit(f"metric {key} is missing"))
        )

    rows = t.entity_metrics.select(
        "project_id",
        "entity",
        *[value(key).cast("bigint").alias(name) for key, name in FLOW_METRICS.items()],
    )
    kept = rows.filter(F.coalesce(*FLOW_METRICS.values()).isNotNull())
    if requests is None:
        return kept
    return kept.join(requests.select("project_id").distinct(), "project_id", "left_semi")
