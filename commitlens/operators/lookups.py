"""Repository facts: commits, changes, files, developers and moves.

Single-key verbs become joins of a request table with the fact table, so any
number of keys is answered by one job.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.names import unpacked
from commitlens.functions.parsing import parse_move
from commitlens.functions.paths import module_of_path
from commitlens.operators import dag, history
from commitlens.operators.sieve import answered
from commitlens.schemas import AUTHOR, CHANGE_KEY, DELETED

class NotFound(Exception):
    """No project, or more than one, has the given owner and repository."""


COMMIT_KEY = ["project_id", "sha"]


def get_commit(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested commits; ``error`` is set where the sha is unknown."""
    found = commits.select(*COMMIT_KEY, "ts", *AUTHOR)
    return requests.join(found, COMMIT_KEY, "left").withColumn(
        "error", F.when(F.col("ts").isNull(), F.lit("CommitNotFound"))
    )


def get_commits(commits, changes=None, path_requests=None) -> DataFrame:
    """All commits, or per requested (project, path) the commits that touch it."""
    if path_requests is None:
        return commits
    touched = changes.join(path_requests.select("project_id", "path").distinct(), ["project_id", "path"])
    return touched.select(*CHANGE_KEY).join(commits, COMMIT_KEY)


def get_commits_till(t, requests, to_path=False, merges=None) -> DataFrame:
    """Commits at or before each requested (project, sha).

    That means reachable where parents are known; with ``merges=False`` not later in linear history.
    The result has a row per request and commit: ``dag.Reached(t, requests)`` is the compact
    form, places in chains and what their merges take in.
    With ``to_path`` the requests carry a path and only commits touching it are
    kept.  The request's sha is returned as ``till_sha``.
    """
    keys = CHANGE_KEY if to_path else COMMIT_KEY
    points = requests.select(*keys).distinct()
    if dag.by_reach(t, merges):
        if to_path:
            facts = dag.by_bytes(t.changes.select(*CHANGE_KEY)).join(dag.by_bytes(t.commits), COMMIT_KEY)
        else:
            facts = dag.by_bytes(t.commits)
        points = dag.by_bytes(points)
        reached = dag.Reached(t, points, names_packed=True)
        found = reached.join(facts, points.withColumnRenamed("sha", "till_sha"), ["path"]) if to_path else reached.join(facts)
        return found.withColumns({c: unpacked(F.col(c)) for c in ("sha", "till_sha")})
    facts = t.changes.select(*CHANGE_KEY).join(t.commits, COMMIT_KEY) if to_path else t.commits
    asked = points.join(
        t.commits.select(*COMMIT_KEY, F.col("seq").alias("till")), COMMIT_KEY
    ).withColumnRenamed("sha", "till_sha")
    return history.join_until(asked, facts, [k for k in keys if k != "sha"]).drop("till")


def get_change(changes: DataFrame, requests: DataFrame) -> DataFrame:
    columns = changes.select(*CHANGE_KEY, "type", "oid_before", "oid_after")
    return requests.join(columns, CHANGE_KEY, "left")


def get_changes(changes: DataFrame, requests: DataFrame) -> DataFrame:
    columns = changes.select(*CHANGE_KEY, "type", "oid_before", "oid_after")
    return requests.select(*COMMIT_KEY).distinct().join(columns, COMMIT_KEY)


def get_delta(changes: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(changes.select(*CHANGE_KEY, "insertions", "deletions"), CHANGE_KEY, "left")


def get_message(messages: DataFrame, requests: DataFrame) -> DataFrame:
    return answered(requests, messages, COMMIT_KEY)


def get_patch(patches: DataFrame, requests: DataFrame) -> DataFrame:
    return answered(requests, patches, CHANGE_KEY)


def commit_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Every commit with its changes; commits without changes give no row."""
    return commits.join(changes, COMMIT_KEY)


def get_developers(commits: DataFrame) -> DataFrame:
    return commits.select("project_id", *AUTHOR).distinct()


def get_files(t, merges=None) -> DataFrame:
    """Every path ever changed; active if the project's newest commit has it.

    That is so if, among the changes that the newest commit reaches (or all, with linear history), the latest
    didn't delete the path.  A path whose changes it doesn't reach is not active.
    """
    dated = dag.by_bytes(t.changes.select(*CHANGE_KEY, "type")).join(dag.by_bytes(t.commits.select(*COMMIT_KEY, "seq")), COMMIT_KEY)
    if dag.by_reach(t, merges):
        heads = t.commits.groupBy("project_id").agg(F.max_by("sha", "seq").alias("sha"))
        order = dated.withColumn("order", F.col("seq"))
        latest = dag.Reached(t, dag.by_bytes(heads), names_packed=True).join(order).groupBy("project_id", "path").agg(F.max_by("type", "order").alias("type"))
    else:
        latest = dated.groupBy("project_id", "path").agg(F.max_by("type", "seq").alias("type"))
    return (
        t.changes.select("project_id", "path").distinct()
        .join(latest, ["project_id", "path"], "left")
        .select("project_id", "path", F.coalesce(F.col("type") != DELETED, F.lit(False)).alias("is_active"), module_of_path(F.col("path")).alias("module"))
    )


def get_modules(changes: DataFrame) -> DataFrame:
    return changes.select("project_id", module_of_path(F.col("path")).alias("module")).distinct()


def moves(rename_lines: DataFrame, similarity: int = 100) -> DataFrame:
    """Renames of at least the given similarity, one row each."""
    parsed = rename_lines.select(*COMMIT_KEY, parse_move(F.col("line")).alias("move"))
    return (
        parsed.filter(F.col("move").isNotNull())
        .select(*COMMIT_KEY, "move.*")
        .filter(F.col("similarity") >= min(similarity, 100))
    )


def get_moves(rename_lines, commits, similarity: int = 100) -> DataFrame:
    """Moves with the commit that made them, a row each.

    One commit may move any number of files, so they are not gathered into a list.
    """
    return moves(rename_lines, similarity).join(commits.select(*COMMIT_KEY, "ts", *AUTHOR), COMMIT_KEY)


def head_version(commits: DataFrame) -> DataFrame:
    """Abbreviated sha of the newest commit per project."""
    return commits.groupBy("project_id").agg(
        F.substring(F.max_by("sha", "seq"), 1, 7).alias("version")
    )


def project_get(projects: DataFrame, owner=None, repository=None) -> DataFrame:
    """All projects, those of an owner, or exactly one by owner and repository.

    A repository without an owner is ignored.
    """
    if owner is None:
        return projects
    owned = projects.filter(F.col("owner") == owner)
    if repository is None:
        return owned
    found = owned.filter(F.col("repository") == repository)
    if found.limit(2).count() != 1:
        raise NotFound(f"{owner}/{repository} not found")
    return found
