"""Metrics of people and history: past changes and authors, ownership, offenders.

Requests may name any commit of a project, also one that does not touch the path.
"Up to the commit" means reachable through ``commit_parents`` where that table is there;
with ``merges=False`` history is taken as linear, in the order of ``seq``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.names import packed, unpacked
from commitlens.operators import dag, history, ranges
from commitlens.operators.change import asked_only, for_requests
from commitlens.schemas import AUTHOR, CHANGE_KEY
from commitlens.session import cut

PATH = ["project_id", "path"]
COMMIT = ["project_id", "sha"]


def _placed(t, requests, extra=()):
    """Distinct requested keys with position, time and author of their commit."""
    return (
        requests.select(*CHANGE_KEY, *extra)
        .distinct()
        .join(t.commits.select(*COMMIT, "seq", "ts", *AUTHOR), COMMIT)
    )


def _own_changes(t, requests):
    """All change keys stand in for requests that were not given."""
    return t.changes.select(*CHANGE_KEY) if requests is None else requests


def _till(keys: DataFrame) -> DataFrame:
    return keys.withColumnRenamed("sha", "till_sha")


def pastchanges(t, requests=None, merges=None, **options) -> DataFrame:
    """Changes of the path up to the commit, less one for the commit itself."""
    if dag.by_reach(t, merges):
        asked = dag.by_bytes(_own_changes(t, requests).select(*CHANGE_KEY)).distinct()
        reached = dag.Reached(t, asked, names_packed=True)
        counts = reached.count(dag.by_bytes(t.changes.select(*CHANGE_KEY)), _till(asked), ["path"], "n")
        measures = counts.select(
            "project_id", unpacked(F.col("till_sha")).alias("sha"), "path",
            F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("pastchanges"),
        )
        return for_requests(measures, requests)
    touches = history.touches(t.changes, t.commits).select(*CHANGE_KEY, "seq")
    if requests is None:
        counted = history.running(touches, PATH, {"n": F.lit(1)})
        return counted.select(*CHANGE_KEY, (F.col("n") - 1).cast("bigint").alias("pastchanges"))
    points = _placed(t, requests).select(*CHANGE_KEY, "seq")
    counts = history.count_as_of(touches, points, PATH, "n")
    measures = points.join(counts, [*PATH, "seq"]).select(
        *CHANGE_KEY, F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("pastchanges")
    )
    return for_requests(measures, requests)


def pastauthors(t, requests=None, merges=None, **options) -> DataFrame:
    """Distinct authors of the path up to the commit, its own author left out."""
    if dag.by_reach(t, merges):
        asked = dag.by_bytes(_own_changes(t, requests).select(*CHANGE_KEY)).distinct()
        reached = dag.Reached(t, asked, names_packed=True)
        author = [*PATH, *AUTHOR]
        commits = dag.by_bytes(t.commits.select(*COMMIT, *AUTHOR))
        touches = reached.with_position(dag.by_bytes(t.changes.select(*CHANGE_KEY)).join(commits, COMMIT))
        # Without their names touches are small when written, and they are read twice.
        touches = reached.spread(cut(touches.select(*author, "chain", "seq"), "touches"))
        firsts = cut(touches.groupBy(*author, "chain").agg(F.min("seq").alias("seq")))
        # An author whom the chains below a chain have met already adds nothing in it.
        below = firsts.select(*author, F.col("chain").alias("other"), "seq")
        met = (
            firsts.select(*author, "chain")
            .join(reached.rungs, ["project_id", "chain"])
            .join(below, [*author, "other"])
            .filter(F.col("seq") <= F.col("at"))
            .select(*author, "chain")
        )
        counts = reached.count_entered(firsts.join(met, [*author, "chain"], "left_anti"), _till(asked), ["path"], "n")
        others = counts.withColumnRenamed("till_sha", "sha")
        if requests is None:
            # The commit of a change touches its path, so its author, if known, is among those counted.
            known = F.col("author_name").isNotNull() & F.col("author_email").isNotNull()
            own = commits.groupBy(*COMMIT).agg(F.max(known.cast("int")).alias("own"))
            measures = asked.join(own, COMMIT).join(others, CHANGE_KEY, "left")
        else:
            own = (
                asked.join(commits, COMMIT)
                .join(reached.till.withColumnRenamed("till_sha", "sha"), COMMIT)
                .join(firsts, [*author, "chain"])
                .filter(F.col("seq") <= F.col("till"))
                .select(*CHANGE_KEY, F.lit(1).alias("own"))
                .distinct()
            )
            measures = asked.join(commits.select(*COMMIT), COMMIT, "left_semi").join(others.join(own, CHANGE_KEY, "left"), CHANGE_KEY, "left")
        own = F.when(F.col("path").isNotNull(), F.coalesce("own", F.lit(0))).otherwise(0)
        n = F.coalesce(F.col("n") - own, F.lit(0)).cast("bigint")
        return for_requests(measures.select("project_id", unpacked(F.col("sha")).alias("sha"), "path", n.alias("pastauthors")), requests)
    touches = history.touches(t.changes, t.commits).select(*CHANGE_KEY, "seq", *AUTHOR)
    firsts = touches.groupBy(*PATH, *AUTHOR).agg(F.min("seq").alias("first_seq"))
    if requests is None:
        starts = firsts.select(*PATH, F.col("first_seq").alias("seq"), F.lit(1).alias("is_first"))
        flagged = touches.join(starts, [*PATH, "seq"], "left")
        counted = history.running(flagged, PATH, {"n": F.coalesce(F.col("is_first"), F.lit(0))})
        return counted.select(*CHANGE_KEY, (F.col("n") - 1).cast("bigint").alias("pastauthors"))
    points = _placed(t, requests).select(*CHANGE_KEY, "seq", *AUTHOR)
    counts = history.count_as_of(firsts.withColumnRenamed("first_seq", "seq"), points, PATH, "n")
    measures = (
        points.join(counts, [*PATH, "seq"])
        .join(firsts, [*PATH, *AUTHOR], "left")
        .select(
            *CHANGE_KEY,
            (
                F.col("n")
                - F.when(F.col("first_seq") <= F.col("seq"), F.lit(1)).otherwise(F.lit(0))
            ).cast("bigint").alias("pastauthors"),
        )
    )
    return for_requests(measures, requests)


def ownership(t, requests=None, merges=None, **options) -> DataFrame:
    """Share of all commits up to the commit made by the named developer.

    Without requests: the share of each commit's own author.
    """
    developer = ["project_id", *AUTHOR]
    if dag.by_reach(t, merges):
        named = requests is not None
        asked = dag.by_bytes((
            requests.withColumnsRenamed({"name": "author_name", "email": "author_email"})
            if named else t.commits
        ).select(*COMMIT, *AUTHOR)).distinct()
        reached = dag.Reached(t, asked, names_packed=True)
        counts = reached.count(dag.by_bytes(t.commits.select(*COMMIT, *AUTHOR)), _till(asked), AUTHOR, "n")
        totals = reached.sizes("total")
        labels = ["name", "email"] if named else AUTHOR
        measures = counts.join(totals, ["project_id", "till_sha"]).select(
            "project_id", unpacked(F.col("till_sha")).alias("sha"),
            *[F.col(c).alias(label) for c, label in zip(AUTHOR, labels)],
            (F.col("n") / F.col("total")).alias("ownership"),
        )
        return for_requests(measures, requests, [*COMMIT, *labels])
    if requests is None:
        counted = history.running(t.commits, developer, {"n": F.lit(1)})
        return counted.select(*COMMIT, *AUTHOR, (F.col("n") / F.col("seq")).alias("ownership"))
    keys = [*COMMIT, "name", "email"]
    points = (
        requests.select(*keys)
        .distinct()
        .join(t.commits.select(*COMMIT, "seq"), COMMIT)
        .withColumnsRenamed({"name": "author_name", "email": "author_email"})
    )
    counts = history.count_as_of(t.commits, points.drop("sha"), developer, "n")
    measures = points.join(counts, [*developer, "seq"]).select(
        *COMMIT,
        F.col("author_name").alias("name"),
        F.col("author_email").alias("email"),
        F.try_divide(F.col("n"), F.col("seq")).alias("ownership"),
    )
    return for_requests(measures, requests, keys)


def offender(t, requests=None, **options) -> DataFrame:
    """Whether a known vulnerability names the path, or an alias, by the commit's time."""
    known = t.offenders.select(
        "project_id",
        "ts",
        F.explode(
            F.array_union(
                F.array("path"),
                F.when(F.coalesce(F.col("aliases"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
                    F.split("aliases", ",")
                ),
            )
        ).alias("path"),
    )
    since = known.groupBy(*PATH).agg(F.min("ts").alias("since"))
    if requests is None:
        keys = history.touches(t.changes, t.commits).select(*CHANGE_KEY, "ts")
    else:
        keys = _placed(t, requests).select(*CHANGE_KEY, "ts")
    measures = keys.join(since, PATH, "left").select(
        *CHANGE_KEY, F.coalesce(F.col("since") <= F.col("ts"), F.lit(False)).alias("offender")
    )
    return for_requests(measures, requests)


def interactivechurn(t, requests=None, unit="ranges", **options) -> DataFrame:
    """Share of deleted ranges (or lines) that another developer wrote last."""
    t = asked_only(t, requests)
    deleted = t.linechanges.filter(F.col("kind") == "-").select(*CHANGE_KEY, "begin", "end")
    lines = F.col("end") - F.col("begin") + 1
    size = F.count(F.lit(1)) if unit == "ranges" else F.sum(lines)
    by_last = ranges.modified_pieces(t.linechanges, t.blame)
    commits = t.commits.select("project_id", packed(F.col("sha")).alias("name"), F.struct(*AUTHOR).alias("author"))
    # The join with the change's own commit comes last: what it brings together is summed up where it is.
    taken = (
        by_last.groupBy(*ranges.PACKED_KEY, "last_sha")
        .agg(size.alias("n"))
        .withColumn("last", packed(F.col("last_sha")))
        .join(commits.select("project_id", F.col("name").alias("last"), F.col("author").alias("last_author")), ["project_id", "last"])
        .select(*ranges.PACKED_KEY, "n", "last_author")
        .join(commits, ["project_id", "name"])
        .filter(F.col("author") != F.col("last_author"))
        .groupBy(*ranges.PACKED_KEY)
        .agg(F.sum("n").alias("taken"))
    )
    name = packed(F.col("sha")).alias("name")
    totals = deleted.select("project_id", name, "path", "begin", "end").groupBy(*ranges.PACKED_KEY).agg(size.alias("total"))
    measures = (
        t.changes.select("project_id", name, "path")
        .join(totals, ranges.PACKED_KEY, "left")
        .join(taken, ranges.PACKED_KEY, "left")
        .select(
            "project_id", unpacked(F.col("name")).alias("sha"), "path",
            F.coalesce(F.try_divide(F.coalesce("taken", F.lit(0)), F.col("total")), F.lit(0.0)).alias(
                "interactivechurn"
            ),
        )
    )
    return for_requests(measures, requests)
