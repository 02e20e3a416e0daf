"""Every operator as a query over a whole test-data folder.

Results are flat: structs become columns, maps become (key, value) rows, arrays
become joined strings.
"""

from functools import partial
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.bundle import Bundle
from commitlens.functions import parsing, paths, text
from commitlens.operators import change, graph, history, lookups, people, ranges, source
from commitlens.plans import catalog
from commitlens.schemas import AUTHOR, CHANGE_KEY
from commitlens.session import scratch
from commitlens.sources import dumps
from commitlens.sources.testdata import Tables
from commitlens.streaming import collect as streams

QUERIES = {}

WHITELIST_NAMES = ["f7_1.py", "makefile"]
WHITELIST_EXTENSIONS = ["C", "cpp"]
MIN_SIMILARITY = 90
SOME_OWNER = "own15"
PAIRED = "dev0"


def query(fn):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


def long_map(rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(column).alias(key, value))


def joined(array, separator=" "):
    return F.array_join(array, separator)


def change_paths(t):
    return t.changes.select("project_id", "path").distinct()


# Sources and sinks.


@query
def src_log_records(t):
    path = scratch(t.spark, "log")
    dumps.write_log_records(t.messages.select("sha", F.col("message").alias("body")), path, compression="gzip")
    read = dumps.read_log_records(t.spark, path)
    return read.select("sha", joined("lines", "\n").alias("message"))


@query
def src_commits_csv(t):
    path = scratch(t.spark, "commits")
    t.commits.select("sha", "ts", *AUTHOR).write.option("quoteAll", True).csv(path)
    return dumps.read_commits_csv(t.spark, path)


@query
def src_offenders_csv(t):
    path = scratch(t.spark, "offenders")
    rows = t.offenders.select(F.col("ts").alias("timestamp"), "path", "aliases", "reference")
    rows.write.option("header", True).csv(path)
    read = dumps.read_offenders_csv(t.spark, path)
    return read.withColumn("aliases", joined("aliases", ","))


@query
def src_projects(t):
    path = scratch(t.spark, "projects")
    t.projects.write.parquet(path)
    return dumps.read_projects(t.spark, path)


@query
def sink_project_append(t):
    path = scratch(t.spark, "projects")
    compiled = F.col("language").isin("C", "C++")
    dumps.append_projects(t.projects.filter(compiled), path)
    dumps.append_projects(t.projects.filter(~compiled), path)
    return dumps.read_projects(t.spark, path)


@query
def get_content(t):
    bad_byte = F.when(F.length("content") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    blobs = t.blobs.select(
        "oid", "is_binary", F.concat(bad_byte, F.encode("content", "UTF-8")).alias("data")
    )
    asked = t.changes.select(F.col("oid_after").alias("oid")).distinct()
    return dumps.get_content(blobs, asked)


# Parsing and text.


@query
def parse_change(t):
    return t.raw_changes.select("project_id", "sha", parsing.parse_change(F.col("line")).alias("c")).select(
        "project_id", "sha", "c.*"
    )


@query
def parse_delta(t):
    return t.numstat.select("project_id", "sha", parsing.parse_delta(F.col("line")).alias("d")).select(
        "project_id", "sha", "d.*"
    )


@query
def parse_move(t):
    moves = t.rename_lines.select("project_id", "sha", parsing.parse_move(F.col("line")).alias("m"))
    return moves.filter(F.col("m").isNotNull()).select("project_id", "sha", "m.*")


@query
def module_of_path(t):
    return change_paths(t).withColumn("module", paths.module_of_path(F.col("path")))


@query
def split_lines_loc(t):
    lines = text.split_lines(F.col("content"))
    return t.blobs.filter("content IS NOT NULL").select(
        "oid", F.size(lines).cast("bigint").alias("n_lines"), joined(lines, "\n").alias("lines")
    )


@query
def content_size(t):
    return t.blobs.select("oid", text.content_size(F.col("content")).alias("size"))


@query
def collapse_ranges(t):
    lines = t.linechanges.select(*CHANGE_KEY, "kind", F.explode(F.sequence("begin", "end")).alias("line"))
    return ranges.collapse_ranges(lines, [*CHANGE_KEY, "kind"])


@query
def tokenize(t):
    documents = t.spark.read.parquet(f"{t.folder}/documents.parquet")
    return documents.select("doc_id", joined(text.tokenize(F.col("text"))).alias("tokens"))


@query
def infer_language(t):
    return change_paths(t).select(
        "project_id", "path",
        paths.infer_language(F.col("path")).alias("language"),
        paths.is_parsable(F.col("path")).alias("is_parsable"),
    )


@query
def is_supported(t):
    return t.projects.select("id", "language", paths.is_supported(F.col("language")).alias("is_supported"))


@query
def path_whitelist(t):
    return change_paths(t).filter(
        paths.path_whitelist(F.col("path"), WHITELIST_NAMES, WHITELIST_EXTENSIONS)
    )


# Lookups.


@query
def get_commit(t):
    return lookups.get_commit(t.commits, t.requests.select("request_id", "project_id", "sha"))


@query
def get_commits_all(t):
    return lookups.get_commits(t.commits)


@query
def get_commits_path(t):
    return lookups.get_commits(t.commits, t.changes, t.requests)


@query
def get_commits_till_sha(t):
    found = lookups.get_commits_till(t, t.requests, merges=False)
    return found.select("project_id", "till_sha", "sha", "ts", *AUTHOR)


@query
def get_commits_till_sha_path(t):
    found = lookups.get_commits_till(t, t.requests, to_path=True, merges=False)
    return found.select("project_id", "path", "till_sha", "sha", "ts", *AUTHOR)


@query
def get_commits_till_sha_merges(t):
    found = lookups.get_commits_till(t, t.requests, merges=True)
    return found.select("project_id", "till_sha", "sha", "ts", *AUTHOR)


@query
def get_commits_till_sha_path_merges(t):
    found = lookups.get_commits_till(t, t.requests, to_path=True, merges=True)
    return found.select("project_id", "path", "till_sha", "sha", "ts", *AUTHOR)


def asked_change(t):
    return t.requests.select("request_id", *CHANGE_KEY)


@query
def get_change(t):
    return lookups.get_change(t.changes, asked_change(t))


@query
def get_changes(t):
    return lookups.get_changes(t.changes, t.requests)


@query
def get_delta(t):
    return lookups.get_delta(t.changes, asked_change(t))


@query
def get_message(t):
    return lookups.get_message(t.messages, t.requests.select("request_id", "project_id", "sha"))


@query
def get_patch(t):
    return lookups.get_patch(t.patches, asked_change(t))


@query
def get_linechanges(t):
    return ranges.patch_linechanges(t.patches)


@query
def get_lastmodifiers(t):
    commits = t.commits.select(
        "project_id", F.col("sha").alias("last_sha"), *[F.col(c).alias(f"last_{c}") for c in ("ts", *AUTHOR)]
    )
    found = ranges.last_modifiers(t.linechanges, t.blame)
    return found.join(commits, ["project_id", "last_sha"])


@query
def get_moves(t):
    return lookups.get_moves(t.rename_lines, t.commits, MIN_SIMILARITY)


@query
def head_version(t):
    return lookups.head_version(t.commits)


@query
def project_get(t):
    return lookups.project_get(t.projects, owner=SOME_OWNER)


# Distinct sets.


@query
def get_developers(t):
    return lookups.get_developers(t.commits)


@query
def get_files(t):
    return lookups.get_files(t)


@query
def get_files_linear(t):
    return lookups.get_files(t, merges=False)


@query
def get_modules(t):
    return lookups.get_modules(t.changes)


@query
def signature_full_outer(t):
    return source.signature_sides(t)


@query
def sig_difference(t):
    return source.signature_sides(t).filter("in_after AND NOT in_before").drop("in_before", "in_after")


@query
def sig_intersection(t):
    return source.signature_sides(t).filter("in_after AND in_before").drop("in_before", "in_after")


# Joins.


def seeded(t):
    return SimpleNamespace(
        metrics=catalog.metric_catalog(t.spark), project_metrics=catalog.metrics_seed(t.projects)
    )


@query
def metrics_seed(t):
    return catalog.metrics_seed(t.projects)


@query
def metrics_get(t):
    s = seeded(t)
    return catalog.metrics_get(s.metrics, s.project_metrics, granularity="change")


@query
def commit_changes(t):
    return lookups.commit_changes(t.commits, t.changes).drop("seq")


@query
def offender_join(t):
    return people.offender(t, asked_change(t))


@query
def function_line_overlap(t):
    return source.function_line_overlap(t)


@query
def line_in_function(t):
    return source.line_in_function(t)


@query
def comment_on_line(t):
    return source.comment_on_line(t)


@query
def memo_commit_lookup(t):
    commits = t.commits.select("project_id", F.col("sha").alias("last_sha"), "ts", *AUTHOR)
    return t.blame.join(commits, ["project_id", "last_sha"])


# Metrics.


@query
def churn(t):
    return change.churn(t)


@query
def relativechurn(t):
    result = change.relativechurn(t)
    return result.select(*CHANGE_KEY, *[F.round(c, 6).alias(c) for c in ("insertions", "deletions", "aggregate")])


def asked(t):
    return t.requests.select("request_id", *CHANGE_KEY)


def asked_columns(result, *columns):
    return result.select("request_id", *CHANGE_KEY, *columns)


@query
def relativechurn_requested(t):
    columns = [F.round(c, 6).alias(c) for c in ("insertions", "deletions", "aggregate")]
    return asked_columns(change.relativechurn(t, asked(t)), *columns)


@query
def interactivechurn_requested(t):
    return asked_columns(people.interactivechurn(t, asked(t)), F.round("interactivechurn", 6).alias("interactivechurn"))


@query
def functionchurn_requested(t):
    return source.functionchurn(t, asked(t))


@query
def loc_file_requested(t):
    return source.loc(t, asked(t))


@query
def complexity_requested(t):
    return asked_columns(long_map(source.complexity(t, asked(t)), "complexity", "signature", "n"), "signature", "n")


@query
def nesting_requested(t):
    return asked_columns(long_map(source.nesting(t, asked(t)), "nesting", "signature", "n"), "signature", "n")


@query
def hunk(t):
    return change.hunk(t)


@query
def pastchanges(t):
    return people.pastchanges(t, merges=False)


@query
def history_asof(t):
    return people.pastchanges(t, asked_change(t), merges=False)


@query
def pastauthors(t):
    return people.pastauthors(t, merges=False)


@query
def author_set_minus_self(t):
    return people.pastauthors(t, asked_change(t), merges=False)


@query
def ownership(t):
    asked = t.requests.select("request_id", "project_id", "sha", "name", "email")
    return people.ownership(t, asked, merges=False).withColumn("ownership", F.round("ownership", 6))


@query
def ownership_of_authors(t):
    return people.ownership(t, merges=False).withColumn("ownership", F.round("ownership", 6))


@query
def pastchanges_merges(t):
    return people.pastchanges(t, merges=True)


@query
def pastauthors_merges(t):
    return people.pastauthors(t, merges=True)


@query
def ownership_merges(t):
    asked = t.requests.select("request_id", "project_id", "sha", "name", "email")
    return people.ownership(t, asked, merges=True).withColumn("ownership", F.round("ownership", 6))


@query
def interactivechurn(t):
    return people.interactivechurn(t).withColumn("interactivechurn", F.round("interactivechurn", 6))


@query
def interactivechurn_lines(t):
    result = people.interactivechurn(t, unit="lines")
    return result.withColumn("interactivechurn", F.round("interactivechurn", 6))


@query
def functionchurn(t):
    return source.functionchurn(t)


@query
def loc_file(t):
    return source.loc(t)


@query
def loc_function(t):
    rows = long_map(source.loc(t, granularity="function"), "loc", "signature", "n")
    return rows.select(*CHANGE_KEY, "signature", "n.*")


@query
def last_wins(t):
    return source.blob_function_loc(t.blobs, t.comments, t.functions)


@query
def offender(t):
    return people.offender(t)


@query
def keyword(t):
    return long_map(change.keyword(t).drop("error"), "keywords", "word", "n")


@query
def messagetokens(t):
    return change.messagetokens(t).withColumn("tokens", joined("tokens"))


@query
def patchtokens(t):
    return change.patchtokens(t).withColumn("tokens", joined("tokens"))


@query
def complexity(t):
    return long_map(source.complexity(t), "complexity", "signature", "n")


@query
def nesting(t):
    return long_map(source.nesting(t), "nesting", "signature", "n")


@query
def flow(t):
    analysed = t.entity_metrics.select(
        "project_id",
        F.struct("uid", "type", "name", "path").alias("entity"),
        F.create_map(*[x for k in source.FLOW_METRICS for x in (F.lit(k), F.col(k).cast("double"))]).alias("metrics"),
    )
    found = source.flow(SimpleNamespace(entity_metrics=analysed))
    return found.select("project_id", "entity.*", *source.FLOW_METRICS.values())


# Windows and order.


@query
def history_order(t):
    return history.history_order(t.unordered_commits)


@query
def cumulative_history(t):
    """Lines inserted into each path so far."""
    # Each row of a change counts as often as the change has rows.
    same = F.count(F.lit(1)).over(Window.partitionBy(*CHANGE_KEY))
    changes = t.changes.filter(F.col("path").isNotNull()).select(*CHANGE_KEY, F.coalesce("insertions", F.lit(0)).alias("lines"))
    counted = changes.repartition("project_id", "sha").withColumn("n", same)
    rows = counted.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    sized = rows.join(t.commits.select("project_id", "sha", "seq"), ["project_id", "sha"])
    last = t.commits.agg(F.max("seq")).first()[0]
    return history.running(sized, ["project_id", "path"], {"so_far": F.col("lines")}, last=last).select(*CHANGE_KEY, "so_far")


@query
def sorted_ranges(t):
    both = t.linechanges.groupBy(*CHANGE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges")
    )
    shown = F.transform("ranges", lambda r: F.concat_ws("-", r["begin"].cast("string"), r["end"].cast("string")))
    return both.select(*CHANGE_KEY, joined(shown, ",").alias("ranges"))


@query
def first_only(t):
    """The least change of each commit."""
    first = t.changes.groupBy("project_id", "sha").agg(
        F.min(F.struct("path", "type", "oid_before", "oid_after")).alias("c")
    )
    return first.select("project_id", "sha", "c.*")


# Graphs.


def author(column):
    return F.concat_ws("|", F.col(f"{column}.author_name"), F.col(f"{column}.author_email"))


@query
def collab_edges(t):
    return graph.collab_edges(t).select(
        "graph.project_id", author("u").alias("u"), author("v").alias("v"), "size_u", "size_v", "path"
    )


def paired(t):
    """History in which one developer always works with another, who so has the same files."""
    pair = t.commits.filter(F.col("author_name") == PAIRED).withColumn("author_name", F.concat("author_name", F.lit("-pair")))
    return SimpleNamespace(changes=t.changes, commits=t.commits.unionByName(pair))


@query
def developer_classes(t):
    """Members of every class of developers with equal files."""
    return graph.developer_classes(graph.author_touches(paired(t))).select(
        "graph.project_id", author("v").alias("class"), author("author").alias("member")
    )


@query
def dev_pair_self_join(t):
    """Shared files and developer pairs per edge of the developer graph."""
    pairs = F.when(F.col("u") == F.col("v"), F.col("size_u") * (F.col("size_u") - 1) / 2).otherwise(F.col("size_u") * F.col("size_v"))
    edges = graph.collab_edges(paired(t)).groupBy("graph", "u", "v").agg(
        F.count(F.lit(1)).alias("n_files"), F.max(pairs.cast("bigint")).alias("n_pairs")
    )
    return edges.select("graph.project_id", author("u").alias("u"), author("v").alias("v"), "n_files", "n_pairs")


@query
def dev_pairs_per_file(t):
    """Pairs of developers who share a file, counted over the edges between their classes."""
    pairs = F.when(F.col("u") == F.col("v"), F.col("size_u") * (F.col("size_u") - 1) / 2).otherwise(F.col("size_u") * F.col("size_v"))
    return graph.collab_edges(paired(t)).groupBy("graph", "path").agg(F.sum(pairs.cast("bigint")).alias("n_pairs")).select(
        "graph.project_id", "path", "n_pairs"
    )


@query
def collaboration(t):
    return graph.collaboration(t).withColumn("collaboration", F.round("collaboration", 6))


def at_head(t):
    """Every file of every project, asked for at the project's last commit."""
    heads = t.commits.groupBy("project_id").agg(F.max_by("sha", "seq").alias("sha"))
    return change_paths(t).join(heads, "project_id").select(*CHANGE_KEY)


@query
def collaboration_at_commit(t):
    scores = graph.collaboration(t, at_head(t), merges=True)
    return scores.withColumn("collaboration", F.round("collaboration", 6))


@query
def contribution_at_commit(t):
    scores = graph.contribution(t, at_head(t), merges=True)
    return scores.withColumn("contribution", F.round("contribution", 6))


@query
def contrib_edges(t):
    return graph.contrib_edges(t).select("graph.project_id", "path", "author.*", "weight")


@query
def contrib_prune(t):
    kept = graph.contrib_edges(t, whitelist={"names": WHITELIST_NAMES, "extensions": WHITELIST_EXTENSIONS})
    return kept.select("graph.project_id", "path", "author.*", "weight")


@query
def contribution(t):
    return graph.contribution(t).withColumn("contribution", F.round("contribution", 6))


# Catalog and streams.


@query
def collect_enabled(t):
    s = seeded(t)
    bundle = SimpleNamespace(
        metrics=s.metrics, project_metrics=s.project_metrics, changes=t.changes, commits=t.commits,
        blobs=t.blobs, comments=t.comments, offenders=t.offenders,
    )
    return catalog.collect_enabled(bundle, "file").drop("name", "email")


def measured_fields(rows, *keys):
    """A row for every field of every measure: its JSON as ``value`` or, if it is a number, rounded as ``number``."""
    fields = F.from_json("measure", "map<string,string>", {"mode": "PERMISSIVE"})
    number = F.expr("round(try_cast(value AS DOUBLE), 6)")
    return rows.select(*keys, F.explode_outer(fields).alias("field", "value")).select(
        *keys, "field", F.when(number.isNull(), F.col("value")).alias("value"), number.alias("number")
    )


def enabled_measures(t, granularity):
    """The measures of every metric that is on for a granularity, field by field."""
    s = seeded(t)
    names = ("changes", "commits", "blobs", "comments", "functions", "offenders", "patches", "messages", "linechanges", "blame", "projects")
    bundle = Bundle(metrics=lambda: s.metrics, project_metrics=lambda: s.project_metrics, **{n: partial(getattr, t, n) for n in names})
    rows = catalog.collect_enabled(bundle, granularity, merges=False)
    return measured_fields(rows, "metric", "project_id", "sha", "path", "name", "email")


@query
def collect_enabled_change(t):
    return enabled_measures(t, "change")


@query
def collect_enabled_commit(t):
    return enabled_measures(t, "commit")


@query
def collect_enabled_function(t):
    return enabled_measures(t, "function")


@query
def collect_enabled_developer(t):
    return enabled_measures(t, "developer")


STREAMED = (
    "churn", "hunk", "functionchurn", "loc", "relativechurn", "interactivechurn", "keyword", "patchtokens", "messagetokens", "offender",
    "complexity", "nesting",
)


@query
def stream_collect_mixed(t):
    """Requests for many metrics in one stream that stops once and goes on; some requests come again."""
    folder = scratch(t.spark, "stream")
    names = F.array(*[F.lit(n) for n in STREAMED])
    metric = F.element_at(names, (F.col("request_id") % len(STREAMED) + 1).cast("int"))
    asked = t.requests.select("request_id", metric.alias("metric"), *CHANGE_KEY, "name", "email")
    for part in (F.col("request_id") % 2 == 0, (F.col("request_id") % 2 == 1) | (F.col("request_id") % 6 == 0)):
        asked.filter(part).write.mode("append").parquet(f"{folder}/requests")
        arriving = streams.read_requests(t.spark, f"{folder}/requests")
        streams.sink_collected(arriving, t, f"{folder}/measures", f"{folder}/progress").awaitTermination()
    return measured_fields(t.spark.read.parquet(f"{folder}/measures"), "request_id", "metric", *CHANGE_KEY)


@query
def stream_collect(t):
    folder = scratch(t.spark, "stream")
    asked = t.requests.withColumn("metric", F.lit("churn")).select(
        "request_id", "metric", *CHANGE_KEY, "name", "email"
    )
    asked.write.parquet(f"{folder}/requests")
    arriving = streams.read_requests(t.spark, f"{folder}/requests")
    measures = streams.collect(arriving, "churn", change.churn(t), CHANGE_KEY)
    streams.sink_measures(measures, f"{folder}/measures", f"{folder}/progress").awaitTermination()
    return t.spark.read.parquet(f"{folder}/measures")


def onboarded(t):
    """The folder of a catalog and of events after all projects have come, and come again."""
    folder = scratch(t.spark, "onboarding")
    t.projects.write.parquet(f"{folder}/projects")
    for _ in range(2):  # The second start finds nothing new.
        streams.onboard_projects(
            t.spark, f"{folder}/projects", f"{folder}/catalog", f"{folder}/progress", f"{folder}/events"
        ).awaitTermination()
    return folder


@query
def stream_project_created(t):
    return t.spark.read.parquet(f"{onboarded(t)}/catalog").drop("batch")


@query
def stream_repository_cloned(t):
    return t.spark.read.parquet(f"{onboarded(t)}/events").drop("batch")
