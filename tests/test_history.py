"""Order, running counts and reachability against plain Python."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from commitlens.operators import dag, history, lookups, people
from commitlens.plans import queries

COMMITS = "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"


def test_order_with_ties_and_a_hot_second(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2]), f"{i:04x}", rng.choice([5, 5, 5, 86400, 90000, 10**9])) for i in range(400)]
    df = spark.createDataFrame(rows, "project_id bigint, sha string, ts bigint")
    got = {(r["project_id"], r["sha"]): r["seq"] for r in history.history_order(df).collect()}
    for project in (1, 2):
        ordered = sorted((ts, sha) for p, sha, ts in rows if p == project)
        assert [got[project, sha] for _, sha in ordered] == list(range(1, len(ordered) + 1))


def test_running_sums_cross_buckets(spark, monkeypatch):
    monkeypatch.setattr(history, "SEQ_BUCKET", 7)
    rows = [(i % 2, i, i * i % 11) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "k int, seq bigint, x bigint")
    got = {r["seq"]: (r["total"], r["n"]) for r in history.running(df, ["k"], {"total": F.col("x"), "n": F.lit(1)}).collect()}
    for k, seq, _ in rows:
        before = [x for j, s, x in rows if j == k and s <= seq]
        assert got[seq] == (sum(before), len(before))


def random_repository(seed, n=40):
    rng = random.Random(seed)
    commits, parents, changes = [], [], []
    for i in range(n):
        sha = f"{rng.randrange(16 ** 6):06x}{i:02d}"
        name = rng.choice("ABCD")
        commits.append((1, sha, i, name, name, i + 1))
        if i:
            for no, p in enumerate(rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 1, 2, 3]))), 1):
                parents.append((1, sha, commits[p][1], no))
        changes.extend((1, sha, path) for path in rng.sample(["a", "b", "c"], rng.randint(0, 2)))
    return commits, parents, changes


def reached_by(parents):
    up = {}
    for _, sha, parent, _ in parents:
        up.setdefault(sha, []).append(parent)

    def walk(sha):
        seen, todo = set(), [sha]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo.extend(up.get(c, []))
        return seen

    return walk


def test_lines_so_far_read_changes_once(spark, tables):
    """Also if a change has several rows, which count as often as there are of them."""
    changes = [(1, "a", "x", 1), (1, "b", "x", 2), (1, "b", "x", 4), (1, "c", "x", None), (1, "c", None, 9), (None, "a", "x", 9)]
    t = tables(
        commits=([(1, s, i, "A", "m", i) for i, s in enumerate("abc", 1)], COMMITS),
        changes=(changes, "project_id bigint, sha string, path string, insertions bigint"),
    )
    df = queries.cumulative_history(t)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    rows = df.collect()
    got = {}
    for r in rows:
        got.setdefault((r.sha, r.path), []).append(r.so_far)
    assert {k: (len(v), max(v)) for k, v in got.items()} == {("a", "x"): (1, 1), ("b", "x"): (4, 13), ("c", "x"): (1, 13)}


@pytest.mark.parametrize("seed", [0, 3])
def test_merges_match_walking_parents(spark, tables, monkeypatch, seed):
    monkeypatch.setattr(history, "SEQ_BUCKET", 5)
    commits, parents, changes = random_repository(seed)
    t = tables(
        commits=(commits, COMMITS),
        commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"),
        changes=(changes, "project_id bigint, sha string, path string"),
    )
    walk = reached_by(parents)
    author = {c[1]: c[3] for c in commits}
    t.commit_chains = dag.cut(dag.chains(t.commits, t.commit_parents))
    requests = t.commits.select("project_id", "sha")
    got = {}
    for r in lookups.get_commits_till(t, requests, merges=True).collect():
        got.setdefault(r["till_sha"], set()).add(r["sha"])
    assert got == {c[1]: walk(c[1]) for c in commits}
    asked = requests.crossJoin(spark.createDataFrame([("a",), ("b",)], "path string"))
    counts = {(r["sha"], r["path"]): r for r in people.pastchanges(t, asked, merges=True).collect()}
    authors = {(r["sha"], r["path"]): r for r in people.pastauthors(t, asked, merges=True).collect()}
    for sha, path in counts:
        past = [c for c in walk(sha) if (1, c, path) in changes]
        assert counts[sha, path]["pastchanges"] == max(len(past) - 1, 0)
        assert authors[sha, path]["pastauthors"] == len({author[c] for c in past} - {author[sha]})
    shares = {r["sha"]: r["ownership"] for r in people.ownership(t, merges=True).collect()}
    for sha, share in shares.items():
        reach = walk(sha)
        assert share == pytest.approx(sum(author[c] == author[sha] for c in reach) / len(reach))


def test_the_index_grows_with_merges(spark, tables):
    """A main line that merges one side branch after the other, all begun at its start."""
    n = 40
    commits = [(1, f"m{i}", i, "A", "a", i + 1) for i in range(n)] + [(1, f"s{i}", i, "B", "b", n + i + 1) for i in range(1, n)]
    parents = [(1, f"m{i}", f"m{i - 1}", 1) for i in range(1, n)] + [(1, f"m{i}", f"s{i}", 2) for i in range(2, n)]
    parents += [(1, f"s{i}", "m0" if i < n // 2 else f"m{i - 2}", 1) for i in range(1, n)]
    t = tables(commits=(commits, COMMITS), commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"))
    rungs, taken = dag.index(dag.chains(t.commits, t.commit_parents), t.commit_parents)
    assert rungs.count() == n - 1 and taken.count() == n - 2
    reached = dag.Reached(t, t.commits.filter("sha IN ('m39', 's39', 'm5')"))
    assert {r.till_sha: r.n for r in reached.sizes("n").collect()} == {"m39": 2 * n - 2, "s39": 75, "m5": 10}


def test_linear_history_agrees_with_its_parents(spark, tables):
    commits = [(1, f"c{i}", i, "AB"[i % 3 // 2], "m", i + 1) for i in range(20)]
    parents = [(1, f"c{i}", f"c{i - 1}", 1) for i in range(1, 20)]
    changes = [(1, f"c{i}", "xy"[i % 2]) for i in range(20)]
    t = tables(
        commits=(commits, COMMITS),
        commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"),
        changes=(changes, "project_id bigint, sha string, path string"),
    )
    for metric in (people.pastchanges, people.pastauthors, people.ownership):
        assert sorted(metric(t).collect()) == sorted(metric(t, merges=True).collect())


def test_past_authors_leave_out_the_own_author(spark, tables):
    names = ["A", "B", "A"]
    commits = [(1, f"c{i}", i, n, n, i + 1) for i, n in enumerate(names)]
    t = tables(commits=(commits, COMMITS), changes=([(1, f"c{i}", "p") for i in range(3)], "project_id bigint, sha string, path string"))
    assert [r["pastauthors"] for r in people.pastauthors(t).orderBy("sha").collect()] == [0, 1, 1]
    assert [r["pastchanges"] for r in people.pastchanges(t).orderBy("sha").collect()] == [0, 1, 2]
    other = spark.createDataFrame([(1, "c1", "elsewhere"), (1, "gone", "p")], "project_id bigint, sha string, path string")
    assert {r["sha"]: r["pastchanges"] for r in people.pastchanges(t, other).collect()} == {"c1": 0, "gone": None}


def test_shares_of_all_developers_add_up(spark, tables):
    commits = [(1, f"c{i}", i, "ABC"[i * i % 3], "m", i + 1) for i in range(12)]
    t = tables(commits=(commits, COMMITS))
    requests = t.commits.select("project_id", "sha").crossJoin(
        spark.createDataFrame([("A", "m"), ("B", "m"), ("C", "m")], "name string, email string"))
    totals = people.ownership(t, requests).groupBy("sha").agg(F.sum("ownership").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in totals)


def test_interactive_churn_counts_ranges(spark, tables):
    commits = [(1, "x", 1, "X", "x", 1), (1, "s0", 2, "S", "s", 2), (1, "s1", 3, "S", "s", 3)]
    t = tables(
        commits=(commits, COMMITS),
        changes=([(1, "s1", "p"), (1, "s0", "q")], "project_id bigint, sha string, path string"),
        linechanges=([(1, "s1", "p", "-", 1, 4)], "project_id bigint, sha string, path string, kind string, begin bigint, end bigint"),
        blame=([(1, "s1", "p", n, "x" if n % 2 else "s0") for n in range(1, 5)],
               "project_id bigint, sha string, path string, line bigint, last_sha string"),
    )
    assert {r["path"]: r["interactivechurn"] for r in people.interactivechurn(t).collect()} == {"p": 2.0, "q": 0.0}
    by_line = {r["path"]: r["interactivechurn"] for r in people.interactivechurn(t, unit="lines").collect()}
    assert by_line == {"p": 0.5, "q": 0.0}


def test_offender_by_path_or_alias_and_time(spark, tables):
    t = tables(
        commits=([(1, "c1", 10, "A", "a", 1), (1, "c2", 20, "A", "a", 2)], COMMITS),
        changes=([(1, "c1", "f"), (1, "c2", "f"), (1, "c2", "g"), (1, "c2", "h")], "project_id bigint, sha string, path string"),
        offenders=([(1, 15, "f", "g,old", "R1"), (1, 30, "h", "", "R2")], "project_id bigint, ts bigint, path string, aliases string, reference string"),
    )
    got = {(r["sha"], r["path"]): r["offender"] for r in people.offender(t).collect()}
    assert got == {("c1", "f"): False, ("c2", "f"): True, ("c2", "g"): True, ("c2", "h"): False}


def test_predecessors_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(history, "SEQ_BUCKET", 3)
    rows = spark.range(1, 41).select(F.explode(F.array(F.lit("p"), F.lit("q"))).alias("path"), F.concat(F.lit("s"), "id").alias("sha"), F.col("id").alias("nth"))
    got = sorted(tuple(r) for r in history.before_last(rows, ["path"], "nth", "sha").collect())
    assert got == sorted((p, f"s{n}", n, f"s{n - 1}", f"s{n - 2}" if n > 2 else None) for p in "pq" for n in range(2, 41))


def test_chains_move_numbers(spark, tables):
    """Names of chains are numbers; commits above an unknown parent or without a name have no chain."""
    names = [c * 40 for c in "abcdef"]
    commits = [(1, n, i, "A", "a", i + 1) for i, n in enumerate(names)] + [(1, None, 9, "A", "a", 9), (2, names[0], 1, "B", "b", 1)]
    parents = [(1, names[1], names[0], 1), (1, names[2], names[0], 1), (1, names[3], names[2], 1), (1, names[4], "0" * 40, 1), (1, names[5], None, 1)]
    t = tables(commits=(commits, COMMITS), commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"))
    placed = dag.chains(t.commits, t.commit_parents)
    assert dict(placed.dtypes)["chain"] == "bigint"
    got = {(r.project_id, r.sha[0]): (r.chain, r.pos) for r in placed.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "f"), (2, "a")}
    assert got[1, "c"] == (got[1, "a"][0], 2) and got[1, "d"] == (got[1, "a"][0], 3) and got[1, "b"][1] == 1
    assert len({c for c, _ in got.values()}) == 4
