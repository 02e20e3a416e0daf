"""Requests read no more than they ask for."""

from pyspark.sql import functions as F

from commitlens.functions.names import packed, unpacked
from commitlens.operators import change, history, people, ranges, source
from commitlens.plans import queries
from commitlens.sources import testdata

COMMITS = "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"
CHANGES = "project_id bigint, sha string, path string, type int, insertions bigint, deletions bigint, oid_before string, oid_after string"


class Watched:
    """Tables that remember which of them were read."""

    def __init__(self, tables):
        self._tables, self.read = tables, set()

    def __getattr__(self, name):
        self.read.add(name)
        return getattr(self._tables, name)


def test_requested_sizes_read_changes_and_contents_only(spark, tables):
    t = Watched(tables(
        changes=([(1, "a", "x", 3, 2, 2, "o1", "o2"), (1, "b", "x", 3, 1, 0, "o2", "o3")], CHANGES),
        blobs=([("o2", "1\n2\n"), ("o3", "1\n")], "oid string, content string"),
        linechanges=([], "project_id bigint, sha string, path string"), blame=([], "project_id bigint, sha string, path string"),
    ))
    asked = spark.createDataFrame([(1, "a", "x")], "project_id bigint, sha string, path string")
    assert [r.aggregate for r in change.relativechurn(t, asked).collect()] == [2.0]
    assert t.read == {"changes", "blobs"}


def test_developers_measures_read_commits_only(spark, tables):
    t = Watched(tables(
        commits=([(1, "a", 1, "A", "m", 1), (1, "b", 2, "B", "m", 2)], COMMITS),
        projects=([(1, "o", "r", "C", "u")], "id bigint, owner string, repository string, language string, repository_url string"),
    ))
    t.spark = spark
    rows = queries.enabled_measures(t, "developer").collect()
    assert sorted((r.sha, r.number) for r in rows if r.field == "ownership") == [("a", 1.0), ("b", 0.5)]
    assert t.read == {"commits", "projects"}


def test_hunks_take_along_their_own_numbers_only(spark):
    """Work grows with a patch's hunks, not with their square; kinds of lines are as before."""
    body = "".join(f"@@ -{2 * i + 1} +{3 * i + 1},2 @@\n-old\n+new\n\n" for i in range(300))
    rows = spark.createDataFrame([(1, "s", "p", f"diff\n--- a\n+++ b\n{body}@ no header")], "project_id bigint, sha string, path string, patch string")
    found = ranges.patch_linechanges(rows)
    generate = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line][-1]
    assert "arrays_zip" in generate or "old_counts" not in generate
    got = sorted((r.kind, r.begin, r.end) for r in found.collect())
    assert got == sorted([("-", 2 * i + 1, 2 * i + 1) for i in range(300)] + [("+", 3 * i + 1, 3 * i + 1) for i in range(300)])


def small_folder(spark, folder):
    """Orders with merges among them, and changes that lead to blobs, to none and to binary ones."""
    day = "TIMESTAMP'2020-01-01'"
    views = {
        "supplier": "SELECT 0L AS s_suppkey, 'S#0' AS s_name, 1 AS s_nationkey",
        "part": "SELECT id AS p_partkey, concat('n', id) AS p_name, 'Brand#1' AS p_brand, 'BIG TIN' AS p_type, CAST(id AS INT) AS p_size FROM range(4)",
        "orders": f"SELECT id AS o_orderkey, id % 3 AS o_custkey, {day} + make_dt_interval(CAST(id AS INT)) AS o_orderdate FROM range(30)",
        "lineitem": f"""SELECT id DIV 2 AS l_orderkey, id % 4 AS l_partkey, CAST(id % 2 AS INT) AS l_linenumber, CAST(id % 7 AS DOUBLE) AS l_quantity,
          0.01D * (id % 9) AS l_tax, 0.01D AS l_discount, substr('ARN', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag, {day} AS l_shipdate FROM range(60)""",
        "documents": "SELECT id AS doc_id, CASE WHEN id < 50 THEN concat('one, two\\nthree. ', id, '\\n\\nfour\\nfive') END AS text FROM range(60)",
        "pages": "SELECT id AS page_id, concat('<p>', id, '</p>\\nx') AS html FROM range(5)",
    }
    for name, sql in views.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_patches_are_put_together_where_they_are_read(spark, tmp_path):
    t = testdata.Tables(spark, small_folder(spark, str(tmp_path)))
    rows = sorted(t.patches.collect())
    assert any("@@@ -" in r.patch for r in rows) and any("@@ -" in r.patch and "@@@" not in r.patch for r in rows)
    assert rows == sorted(t._sql("patches").collect())
    assert not any(key[1:] == (str(tmp_path), "patches") for key in testdata._PATHS)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_versions_nobody_reads_stay_out_of_the_joins(spark, tables):
    paths = ["a.c", "b.py", "c.c", None]
    t = tables(
        changes=([(p, "s", x, 3, 1, 1, "o1", "0" * 40 if x == "c.c" else "o2") for p in (1, 2) for x in paths], CHANGES),
        blobs=([("o1", "x\n\ny\n"), ("o2", "x\ny\n")], "oid string, content string"),
        comments=([], "oid string, type int, begin_line int, begin_col int, end_line int, end_col int"),
        functions=([("o1", 1, "f()", 1, 3), ("o2", 1, "f()", 1, 1), ("o2", 2, "g()", 2, 2)], "oid string, ord int, signature string, begin_line int, end_line int"),
        linechanges=([(1, "s", "a.c", "+", 1, 1)], "project_id bigint, sha string, path string, kind string, begin bigint, end bigint"),
        projects=([(1, "C"), (2, "Go")], "id bigint, language string"),
    )
    lines = source.loc(t)
    assert "none-" not in optimized(lines)
    assert {(r.project_id, r.path): r.aggregate for r in lines.collect()} == {(p, x): 2 if x == "a.c" else None for p in (1, 2) for x in paths}
    churned = source.functionchurn(t)
    assert optimized(churned).startswith("Union")
    got = {(r.project_id, r.path): (r.supported, r.insertions, r.deletions, r.modifications, r.aggregate) for r in churned.collect()}
    assert got == {(p, x): (p == 1, None, None, None, None) for p in (1, 2) for x in paths} | {
        (1, "a.c"): (True, 1, 0, 1, 2), (1, "c.c"): (True, 0, 1, 0, 1)}


def test_ranges_of_a_patch_are_known_in_its_row(spark):
    """One shuffle, of a row for each change; patches of one change that come twice are read together, as before."""
    one = "@@ -1,2 +1,2 @@\n-a\n+b\n c\n@@ -9,0 +9,2 @@\n+x\n+y\n@@ -20 +22 @@\n-z"
    rows = [(1, "ab12", "p", one), (1, "Name", "p", one), (None, None, None, one), (1, "none", "p", None), (1, "empty", "p", "")]
    found = ranges.patch_linechanges(spark.createDataFrame(rows, "project_id bigint, sha string, path string, patch string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1
    expected = [("+", 1, 1), ("+", 9, 10), ("-", 1, 1), ("-", 20, 20)]
    got = {}
    for r in found.collect():
        got.setdefault((r.project_id, r.sha, r.path), []).append((r.kind, r.begin, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k[:3]: expected for k in rows[:3]}
    twice = spark.createDataFrame([(1, "s", "p", "@@ -1 +5,2 @@\n+a\n-b\n+c")] * 2, "project_id bigint, sha string, path string, patch string")
    got = sorted((r.kind, r.begin, r.end) for r in ranges.patch_linechanges(twice).collect())
    assert got == [("+", 5, 8), ("-", 1, 2)]


def test_ranges_and_blame_of_a_change_meet_once(spark):
    """Deleted ranges and blame are shuffled once; names of any form come back, of two for a line the greater one counts."""
    key = "project_id bigint, sha string, path string"
    deleted = spark.createDataFrame([(1, "ab", "p", "-", 1, 4), (1, "Z z", "p", "-", 2, 2), (1, "ab", "p", "+", 9, 9)], f"{key}, kind string, begin bigint, end bigint")
    blame = spark.createDataFrame([(1, "ab", "p", 1, "0f"), (1, "ab", "p", 2, "0f"), (1, "ab", "p", 3, "Zed"), (1, "ab", "p", 3, "0e"), (1, "Z z", "p", 2, None)], f"{key}, line bigint, last_sha string")
    found = ranges.last_modifiers(deleted, blame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "ab", "p", "0f", 1, 2), (1, "ab", "p", "Zed", 3, 3), (1, "Z z", "p", None, 2, 2)], key=str)


def test_packed_names_come_back(spark):
    names = ["", "ab", "abc", "AB", "0" * 40, "né", " 0a", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", packed(F.col("n")).alias("p"))
    got = rows.select("n", unpacked(F.col("p")).alias("u"), F.length("p").alias("size")).collect()
    assert [r.u for r in got] == names and got[4].size == 21
    assert rows.select("p").distinct().count() == len(names)


def test_before_last_at_once_and_by_buckets(spark):
    rows = spark.createDataFrame([(k % 3, k // 3 + 1, f"v{k}") for k in range(15)] + [(None, 1, "n")], "k int, nth bigint, v string")
    once, wide = (history.before_last(rows, ["k"], "nth", "v", last) for last in (5, None))
    assert sorted(once.collect()) == sorted(wide.collect()) and once.count() == 12
    assert "Generate" in wide._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_what_commits_reach_take_one_pass(spark, tables):
    """Places asked for are sorted with the events, not joined with them again; nulls and names of any form count as before."""
    commits = [(1, "0a", 1, "A", "a", 1), (1, "Bee", 2, "B", "b", 2), (1, "0c", 3, "A", "a", 3), (1, "0d", 4, None, "n", 4)]
    parents = [(1, "Bee", "0a", 1), (1, "0c", "0a", 1), (1, "0d", "0c", 1), (1, "0d", "Bee", 2)]
    changes = [(1, s, p, 3, 1, 1, "x", "y") for s, p in (("0a", "f"), ("Bee", "f"), ("0c", "f"), ("0d", "f"), ("0d", "g"), ("0c", None))]
    t = tables(commits=(commits, COMMITS), commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"), changes=(changes, CHANGES))
    found = people.pastauthors(t, merges=True)
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.sha, r.path): r.pastauthors for r in found.collect()} == {
        ("0a", "f"): 0, ("Bee", "f"): 1, ("0c", "f"): 0, ("0d", "f"): 3, ("0d", "g"): 1, ("0c", None): 0
    }
    counted = people.pastchanges(t, merges=True)
    assert "LeftSemi" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.sha, r.path): r.pastchanges for r in counted.collect()} == {
        ("0a", "f"): 0, ("Bee", "f"): 1, ("0c", "f"): 1, ("0d", "f"): 3, ("0d", "g"): 0, ("0c", None): 0
    }
