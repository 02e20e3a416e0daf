"""Dumps, catalog and streams."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from commitlens.plans import catalog
from commitlens.sources import dumps
from commitlens.streaming import collect as streams

PROJECTS = "id bigint, owner string, repository string, language string, repository_url string"


def test_log_records_as_git_prints_them(spark, tmp_path):
    one, two = "a" * 40, "b" * 40
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "1.txt").write_text(f"*\n{one}\n\nfirst *\n* item\n\n*\n{two}\n\nsecond\n*\n")
    (tmp_path / "dump" / "2.txt").write_text(f"*\n{'c' * 40}\n*\n")
    got = {r["sha"]: r["lines"] for r in dumps.read_log_records(spark, str(tmp_path / "dump")).collect()}
    assert got == {one: ["first *", "* item", ""], two: ["second"], "c" * 40: []}


def test_log_records_keep_star_lines(spark, tmp_path):
    shas = [c * 40 for c in "abcdef"]
    bodies = ["one\n*\ntwo", "*", "x\n*\n*\ny\n*", "", "last\n*\n*", "z"]
    (tmp_path / "1.txt").write_text("".join(f"*\n{s}\n\n{b}\n" for s, b in zip(shas, bodies)) + "*\n")
    (tmp_path / "2.txt").write_text(f"stray\n*\n{'9' * 40}\n\nbody")
    got = {r["sha"]: "\n".join(r["lines"]) for r in dumps.read_log_records(spark, str(tmp_path)).collect()}
    assert got == {**dict(zip(shas, bodies)), None: "stray", "9" * 40: "body"}


def test_star_lines_over_many_splits(spark, tmp_path):
    body = F.concat(F.lit("*\n"), F.repeat(F.lit("line\n*\n*\n"), 30), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("\n*")).otherwise(F.lit("")))
    records = spark.range(2000).select(F.sha1(F.col("id").cast("string")).alias("sha"), body.alias("body"))
    dumps.write_log_records(records.coalesce(1), str(tmp_path / "dump"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        pairs = dumps.read_log_records(spark, str(tmp_path / "dump")).select("sha", F.array_join("lines", "\n").alias("body"))
        assert pairs.exceptAll(records).isEmpty() and records.exceptAll(pairs).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_records_over_many_splits(spark, tmp_path):
    records = spark.range(3000).select(
        F.concat(F.sha1(F.col("id").cast("string"))).alias("sha"), F.repeat(F.concat(F.lit("line*\n"), F.col("id")), 20).alias("body"))
    dumps.write_log_records(records.coalesce(1), str(tmp_path / "dump"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = dumps.read_log_records(spark, str(tmp_path / "dump"))
        pairs = read.select("sha", F.array_join("lines", "\n").alias("body"))
        assert pairs.exceptAll(records).isEmpty() and records.exceptAll(pairs).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_commits_and_offenders_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('"s1","12","Ann ""A"", B","a@x"\n"s2","13","Bo","b@x","extra"\n')
    got = [tuple(r) for r in dumps.read_commits_csv(spark, str(tmp_path / "c.csv")).collect()]
    assert got == [("s1", 12, 'Ann "A", B', "a@x"), ("s2", 13, "Bo", "b@x")]
    (tmp_path / "o.csv").write_text('timestamp,path,aliases,reference\n5,f,"a.c,b.c",R1\n6,g,,R2\n')
    got = [tuple(r) for r in dumps.read_offenders_csv(spark, str(tmp_path / "o.csv")).collect()]
    assert got == [(5, "f", ["a.c", "b.c"], "R1"), (6, "g", None, "R2")]


def test_content_lookup(spark):
    blobs = spark.createDataFrame([("a", False, bytearray(b"x\xfe")), ("b", True, bytearray(b"y"))], "oid string, is_binary boolean, data binary")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "oid string")
    assert {r["oid"]: r["content"] for r in dumps.get_content(blobs, asked).collect()} == {"a": "x�", "b": None, "c": None}


def test_catalog_follows_switches(spark):
    metrics = catalog.metric_catalog(spark)
    projects = spark.createDataFrame([(7, "o", "r", "C", "u"), (8, "o", "s", "C", "u")], PROJECTS)
    seeded = catalog.metrics_seed(projects)
    assert seeded.count() == 38 and seeded.filter("NOT enabled").count() == 6
    switched = seeded.withColumn("enabled", F.when((F.col("project_id") == 8) & (F.col("metric_id") == 11), F.lit(False)).otherwise(F.col("enabled")))
    got = catalog.metrics_get(metrics, switched, "function").select("project_id", "name").collect()
    assert sorted(map(tuple, got)) == [(7, "complexity"), (7, "loc"), (7, "nesting"), (8, "complexity"), (8, "nesting")]
    one = catalog.metrics_get(metrics, switched, "file", project_id=7).select("name").collect()
    assert sorted(r["name"] for r in one) == ["loc", "offender"]


def test_enabled_metrics_run_for_their_projects_only(spark, tables):
    t = tables(
        metrics=([(1, "churn", "change", "churn", True), (17, "pastchanges", "change", "pastchanges", True)], "id int, name string, granularity string, service string, enabled boolean"),
        project_metrics=([(1, 1, True), (2, 1, False), (1, 17, True), (2, 17, True)], "project_id bigint, metric_id int, enabled boolean"),
        commits=([(p, "s", 1, "A", "a", 1) for p in (1, 2)], "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"),
        changes=([(p, "s", "f", 3, i, 2) for p, i in ((1, 1), (2, None))], "project_id bigint, sha string, path string, type int, insertions bigint, deletions bigint"),
    )
    got = {(r["metric"], r["project_id"]): r["measure"] for r in catalog.collect_enabled(t, "change").collect()}
    assert got == {
        ("churn", 1): '{"insertions":1,"deletions":2,"aggregate":3}',
        ("pastchanges", 1): '{"pastchanges":0}', ("pastchanges", 2): '{"pastchanges":0}',
    }


def test_stream_answers_requests_as_they_come(spark, tmp_path):
    requests, measures, progress = (str(tmp_path / d) for d in ("requests", "measures", "progress"))
    known = spark.createDataFrame([(1, "s", "f", 9)], "project_id bigint, sha string, path string, hunks bigint")
    schema = "request_id bigint, metric string, project_id bigint, sha string, path string, name string, email string"

    def send(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(requests)
        arriving = streams.read_requests(spark, requests)
        streams.sink_measures(streams.collect(arriving, "hunk", known, ["project_id", "sha", "path"]), measures, progress).awaitTermination()
        return sorted((r["request_id"], r["hunks"], r["name"]) for r in spark.read.parquet(measures).collect())

    assert send((1, "hunk", 1, "s", "f", "n", "e"), (2, "churn", 1, "s", "f", "n", "e")) == [(1, 9, "n")]
    assert send((3, "hunk", 1, "s", "other", "m", "e")) == [(1, 9, "n"), (3, None, "m")]


def test_a_request_is_measured_once(spark, tables, tmp_path):
    """All metrics in one stream; requests that come again, in one batch and in a later one, are left out."""
    commits = [(1, f"c{i}", i, "AB"[i % 2], "m", i + 1) for i in range(4)]
    changes = [(1, f"c{i}", p, 3, i, 1, "0" * 40, f"o{i}") for i in range(4) for p in ("f.c", "g.c")]
    nothing = {
        "blobs": "oid string, is_binary boolean, content string", "functions": "oid string, ord int, signature string, begin_line bigint, end_line bigint",
        "comments": "oid string, type int, begin_line bigint, begin_col bigint, end_line bigint, end_col bigint", "blob_sizes": "oid string, nlines bigint",
        "linechanges": "project_id bigint, sha string, path string, kind string, begin bigint, end bigint",
        "blame": "project_id bigint, sha string, path string, line bigint, last_sha string", "patches": "project_id bigint, sha string, path string, patch string",
        "messages": "project_id bigint, sha string, message string", "offenders": "project_id bigint, ts bigint, path string, aliases string, reference string",
        "entity_metrics": "project_id bigint, entity struct<uid:string,type:string,name:string,path:string>, metrics map<string,double>",
    }
    t = tables(
        commits=(commits, "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"),
        commit_parents=([(1, f"c{i}", f"c{i - 1}", 1) for i in range(1, 4)], "project_id bigint, sha string, parent_sha string, parent_no int"),
        changes=(changes, "project_id bigint, sha string, path string, type int, insertions bigint, deletions bigint, oid_before string, oid_after string"),
        projects=([(1, "o", "r", "C", "u")], PROJECTS), **{k: ([], v) for k, v in nothing.items()},
    )
    schema = "request_id bigint, metric string, project_id bigint, sha string, path string, name string, email string"
    rows = [(k, name, 1, "c3", "f.c", "A", "m") for k, name in enumerate(sorted(catalog.METRIC_JOBS))]
    requests, measures, progress = (str(tmp_path / d) for d in ("requests", "measures", "progress"))
    for sent in (rows + rows[:5], rows[3:9] + [(99, "churn", 1, "c2", "f.c", "A", "m"), (100, "unknown", 1, "c2", "f.c", "A", "m")]):
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(requests)
        streams.sink_collected(streams.read_requests(spark, requests), t, measures, progress).awaitTermination()
    got = spark.read.parquet(measures)
    found = got.groupBy("request_id", "metric").count().collect()
    assert {(r.request_id, r.metric) for r in found} == {(r[0], r[1]) for r in rows if r[1] != "flow"} | {(99, "churn")} | {
        (r[0], r[1]) for r in rows if r[1] == "flow" and (r[0], "flow") in {(x.request_id, x.metric) for x in found}
    }
    assert all(r["count"] == 1 for r in found)
    assert got.filter("metric = 'pastchanges'").first().measure == '{"pastchanges":3}'


def test_onboarding_twice_seeds_and_tells_once(spark, tmp_path):
    source, table, events = (str(tmp_path / d) for d in ("projects", "catalog", "events"))
    spark.createDataFrame([(1, "o", "r", "C", "u")], PROJECTS).write.parquet(source)
    for k, progress in enumerate(("p1", "p1", "p2")):  # p2 has lost what was done and repeats the batches.
        streams.onboard_projects(spark, source, table, str(tmp_path / progress), events).awaitTermination()
        assert spark.read.parquet(table).count() == 19 * (1 + (k > 0))
        assert sorted(r.project_id for r in spark.read.parquet(events).filter("event = 'repository_cloned'").collect()) == [1, 2][: 1 + (k > 0)]
        if k == 0:
            spark.createDataFrame([(2, "o", "s", "C", "u"), (1, "o", "r", "C", "u")], PROJECTS).write.mode("append").parquet(source)


def test_nothing_enabled_measures_nothing(spark):
    from types import SimpleNamespace

    t = SimpleNamespace(metrics=catalog.metric_catalog(spark), project_metrics=catalog.metrics_seed(spark.createDataFrame([], PROJECTS)))
    assert catalog.collect_enabled(t, "file").count() == 0


def test_request_columns_are_no_measure(spark):
    row = spark.createDataFrame([(1, "churn", "s", "p", None)], "project_id bigint, metric string, sha string, path string, n bigint")
    assert catalog.as_measures("churn", "change", row).first()["measure"] is None


def test_log_records_stay_where_they_are_read(spark, tmp_path):
    """Texts within a block are neither shuffled nor written again."""
    records = spark.range(500).select(F.sha1(F.col("id").cast("string")).alias("sha"), F.concat(F.repeat(F.lit("line\n*\n"), 50), F.col("id")).alias("body"))
    dumps.write_log_records(records.coalesce(2), str(tmp_path / "dump"), compression="gzip")
    read = dumps.read_log_records(spark, str(tmp_path / "dump"))
    pairs = read.select("sha", F.array_join("lines", "\n").alias("body"))
    assert pairs.exceptAll(records).isEmpty() and records.exceptAll(pairs).isEmpty()
    kept = max((tmp_path.parent.glob("shared*/edges-*")), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(str(kept)).count() == 4
