"""Betweenness against enumeration of all shortest paths on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from commitlens.operators import graph

COMMITS = "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"
CHANGES = "project_id bigint, sha string, path string"


def history_of(touches):
    """Commit and change rows for a list of (project, author, path)."""
    commits, changes, last = [], [], {}
    for n, (project, author, path) in enumerate(touches):
        last[project] = last.get(project, 0) + 1
        commits.append((project, f"c{n}", n, author, author, last[project]))
        changes.append((project, f"c{n}", path))
    return dict(commits=(commits, COMMITS), changes=(changes, CHANGES))


def all_shortest(nodes, weight, s, t):
    best, found = None, []
    stack = [(0, [s])]
    while stack:
        length, path = stack.pop()
        if best is not None and length > best:
            continue
        if path[-1] == t:
            if best is None or length < best:
                best, found = length, []
            found.append(path)
            continue
        for v in nodes:
            w = weight.get((path[-1], v))
            if w and v not in path:
                stack.append((length + w, path + [v]))
    return [p for p in found if sum(weight[e] for e in zip(p, p[1:])) == best]


def brute(touches):
    authors_of, count = {}, {}
    for author, path in touches:
        authors_of.setdefault(path, set()).add(author)
        count[author, path] = count.get((author, path), 0) + 1
    pairs = {}
    for path, authors in authors_of.items():
        for a, b in itertools.combinations(sorted(authors), 2):
            pairs.setdefault((a, b), set()).add(path)
    weight = {e: 1 for a, b in pairs for e in ((a, b), (b, a))}
    nodes = sorted({a for e in pairs for a in e})
    score = dict.fromkeys(pairs, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        paths = all_shortest(nodes, weight, s, t)
        for p in paths:
            for e in zip(p, p[1:]):
                score[tuple(sorted(e))] += 1 / len(paths)
    collaboration = {p: None for p in authors_of}
    for e, paths in pairs.items():
        for p in paths:
            collaboration[p] = max(collaboration[p] or 0.0, score[e])
    weight = {}
    for (a, p), n in count.items():
        weight[("a", a), ("p", p)] = weight[("p", p), ("a", a)] = n
    nodes = sorted({v for e in weight for v in e})
    contribution = {p: 0.0 for p in authors_of}
    for s, t in itertools.combinations(nodes, 2):
        paths = all_shortest(nodes, weight, s, t)
        for p in paths:
            for kind, name in p[1:-1]:
                if kind == "p":
                    contribution[name] += 1 / len(paths)
    return collaboration, contribution


def random_touches(seed):
    rng = random.Random(seed)
    authors = [f"a{i}" for i in range(rng.randint(2, 6))]
    paths = [f"p{i}.c" for i in range(rng.randint(2, 6))]
    touches = [(rng.choice(authors), rng.choice(paths)) for _ in range(rng.randint(3, 14))]
    # Twins on both sides: drive-by developers of one file, files of one developer.
    touches += [(f"x{i}", paths[0]) for i in range(rng.randint(0, 3))]
    touches += [(authors[0], f"q{i}.c") for i in range(rng.randint(0, 2))]
    return touches


@pytest.mark.parametrize("state_rows, tile", [(graph.STATE_ROWS, graph.TILE), (300, graph.TILE), (graph.STATE_ROWS, (5, 12))])
def test_scores_match_enumeration(spark, tables, state_rows, tile):
    """Whole, with sources that take turns, and with graphs cut into many tiles that exchange messages."""
    cases = {seed: random_touches(seed) for seed in range(14)}
    t = tables(**history_of([(seed, a, p) for seed, case in cases.items() for a, p in case]))
    got = {
        name: {(r["project_id"], r["path"]): r[name] for r in getattr(graph, name)(t, state_rows=state_rows, tile=tile).collect()}
        for name in ("collaboration", "contribution")
    }
    for seed, case in cases.items():
        for name, expected in zip(got, brute(case)):
            actual = {p: v for (g, p), v in got[name].items() if g == seed}
            assert actual.keys() == expected.keys()
            for path, value in expected.items():
                assert actual[path] == (value if value is None else pytest.approx(value)), (seed, name, path)


def test_small_graphs_are_solved_from_their_touches(spark, tables, monkeypatch):
    cases = {seed: random_touches(seed) for seed in range(20, 24)}
    t = tables(**history_of([(seed, a, p) for seed, case in cases.items() for a, p in case]))
    monkeypatch.setattr(graph, "betweenness", None)
    got = {(r["project_id"], r["path"]): r["contribution"] for r in graph.contribution(t).collect()}
    expected = {(seed, p): v for seed, case in cases.items() for p, v in brute(case)[1].items()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_large_and_small_graphs_side_by_side(spark, tables):
    """The large one, and the one with a file without a name, go the way of classes."""
    cases = {seed: random_touches(seed) for seed in (30, 31)} | {1: [(f"a{i % 4}", f"p{i % 9}") for i in range(40)]}
    rows = [(seed, a, p) for seed, case in cases.items() for a, p in case]
    t = tables(**history_of([*rows, (2, "A", "f"), (2, "B", "f"), (2, "C", None)]))
    touches = graph.author_touches(t)
    _, others = graph._by_whole_graphs(touches, cells=1 << 20, links=60)
    assert {r.graph.project_id for r in others.collect()} == {1, 2}
    got = {(r["project_id"], r["path"]): r["contribution"] for r in graph.contribution(t, tile=(60, 1 << 20)).collect()}
    expected = {(seed, p): v for seed, case in cases.items() for p, v in brute(case)[1].items()} | {(2, "f"): 1.0}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_hand_written_cases(spark, tables):
    t = tables(**history_of([
        (1, "A", "f"), (1, "B", "f"), (1, "B", "g"), (1, "C", "g"), (1, "A", "alone"),
        (2, "A", "f"), (2, "B", "f"),
    ]))
    got = {(r["project_id"], r["path"]): r["collaboration"] for r in graph.collaboration(t).collect()}
    assert got == {(1, "f"): 2.0, (1, "g"): 2.0, (1, "alone"): None, (2, "f"): 1.0}
    contribution = {(r["project_id"], r["path"]): r["contribution"] for r in graph.contribution(t).collect()}
    assert contribution[2, "f"] == 1.0


def test_history_up_to_a_commit(spark, tables):
    touches = random_touches(3)
    t = tables(**history_of([(1, a, p) for a, p in touches]))
    n = len(touches) // 2
    requests = spark.createDataFrame([(1, f"c{n}", p) for p in {p for _, p in touches}], CHANGES)
    expected = brute(touches[: n + 1])[0]
    got = {r["path"]: r["collaboration"] for r in graph.collaboration(t, requests).collect()}
    for path, value in got.items():
        assert value == (pytest.approx(expected[path]) if expected.get(path) else None)


def test_history_reachable_over_merges(spark, tables):
    touches = [(1, a, p) for a, p in random_touches(4)]
    parts = history_of(touches)
    commits = [c[1] for c in parts["commits"][0]]
    # Every other commit is on a side branch that nothing merges.
    parents = [(1, commits[i], commits[i - 2], 1) for i in range(2, len(commits))]
    t = tables(commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"), **parts)
    last = len(commits) - 1
    expected = brute([(a, p) for i, (_, a, p) in enumerate(touches) if i % 2 == last % 2])
    requests = spark.createDataFrame([(1, commits[last], p) for p in {p for _, _, p in touches}], CHANGES)
    for name, values in zip(("collaboration", "contribution"), expected):
        for r in getattr(graph, name)(t, requests, merges=True).collect():
            value = values.get(r["path"])
            assert r[name] == (value if value is None else pytest.approx(value))


def test_whitelist_keeps_matching_files_only(spark, tables):
    t = tables(**history_of([(1, "A", "f.C"), (1, "B", "f.C"), (1, "A", "g.py"), (1, "B", "g.py"), (1, "A", "x/Makefile")]))
    for name in ("collaboration", "contribution"):
        rows = getattr(graph, name)(t, whitelist={"names": ["makefile"], "extensions": ["c"]}).collect()
        assert {r["path"] for r in rows} == {"f.C", "x/Makefile"}


def test_edges_count_each_developer_pair_once(spark, tables):
    case = random_touches(5)
    t = tables(**history_of([(1, a, p) for a, p in case]))
    rows = graph.collab_edges(t).select(
        "path",
        F.when(F.col("u") == F.col("v"), F.col("size_u") * (F.col("size_u") - 1) / 2)
        .otherwise(F.col("size_u") * F.col("size_v")).alias("n"),
    ).groupBy("path").agg(F.sum("n").alias("n")).collect()
    authors = {}
    for a, p in case:
        authors.setdefault(p, set()).add(a)
    assert {r["path"]: r["n"] for r in rows} == {
        p: len(a) * (len(a) - 1) / 2 for p, a in authors.items() if len(a) > 1
    }


def test_groups_of_files_are_formed_once(spark):
    rows = [((1, None), p, (a, a), 1) for p, a in [("x", "A"), ("x", "B"), ("y", "A"), ("y", "B"), ("z", "B")]]
    touches = spark.createDataFrame(rows, "graph struct<project_id:bigint,sha:string>, path string, author struct<author_name:string,author_email:string>, weight bigint")
    _, files, members = graph.collaboration_classes(touches)
    assert files._jdf.queryExecution().optimizedPlan().toString().startswith("Relation")
    assert {r.path: r.bundle for r in files.collect()} == {"x": "x", "y": "x", "z": "z"}
    assert members.count() == 3
