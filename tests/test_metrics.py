"""Metrics of changes and contents on hand-written rows."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from commitlens.operators import change, lookups, ranges, source
from commitlens.schemas import NO_OID

CHANGES = ("project_id bigint, sha string, path string, type int, insertions bigint, deletions bigint, "
           "oid_before string, oid_after string")
BLOBS = "oid string, is_binary boolean, content string"
FUNCTIONS = "oid string, ord bigint, signature string, begin_line bigint, end_line bigint"
COMMENTS = "oid string, type int, begin_line int, begin_col int, end_line int, end_col int"
RANGES = "project_id bigint, sha string, path string, kind string, begin bigint, end bigint"
PROJECTS = "id bigint, owner string, repository string, language string, repository_url string"


def project(language):
    return ([(1, "o", "r", language, "u")], PROJECTS)


def test_churn_and_relative_churn(spark, tables):
    rows = [
        (1, "s", "add", 1, 5, 0, NO_OID, "b4"), (1, "s", "del", 2, 0, 7, "b4", NO_OID), (1, "s", "mod", 3, 2, 6, "b4", "b4"),
        (1, "s", "bin", 3, None, None, "b4", "b4"), (1, "s", "empty", 3, 1, 1, "b4", "b0"), (1, "s", "gone", 3, 1, 1, "b4", "??"),
    ]
    t = tables(changes=(rows, CHANGES), blobs=([("b4", False, "a\nb\nc\nd"), ("b0", False, "")], BLOBS))
    got = {r["path"]: tuple(r)[3:] for r in change.churn(t).collect()}
    assert got["mod"] == (2, 6, 8) and got["bin"] == (None, None, None)
    got = {r["path"]: tuple(r)[3:] for r in change.relativechurn(t).collect()}
    nothing = (None, None, None)
    assert got == {"add": (1.0, 0.0, 1.0), "del": nothing, "mod": (0.5, 1.5, 2.0), "bin": nothing, "empty": nothing, "gone": nothing}


def test_collapse(spark):
    df = spark.createDataFrame([("k", n) for n in (1, 2, 3, 7, 9, 10)] + [("r", 4), ("r", 4)], "k string, line int")
    got = sorted(tuple(r) for r in ranges.collapse_ranges(df, ["k"]).collect())
    assert got == [("k", 1, 3), ("k", 7, 7), ("k", 9, 10), ("r", 4, 4), ("r", 4, 4)]


def read_patch(patch):
    """Ranges by walking the lines one by one."""
    lines, old, new, inside = {"+": [], "-": []}, 0, 0, False
    for line in patch.split("\n"):
        head = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
        if head:
            old = int(head[1]) + (head[2] == "0")
            new = int(head[3]) + (head[4] == "0")
            inside = True
        elif inside and line.startswith("+"):
            lines["+"].append(new)
            new += 1
        elif inside and line.startswith("-"):
            lines["-"].append(old)
            old += 1
        elif inside and not line.startswith("\\"):
            old, new = old + 1, new + 1
    found = set()
    for kind, numbers in lines.items():
        while numbers:
            n = 1
            while n < len(numbers) and numbers[n] == numbers[n - 1] + 1:
                n += 1
            found.add((kind, numbers[0], numbers[n - 1]))
            numbers = numbers[n:]
    return found


def test_line_ranges_of_patches(spark):
    rng = random.Random(7)
    patches = [
        "--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@ int f()\n a\n-b\n+c\n+@@ d\n e\n@@ -10 +11,0 @@\n-x\n\\ No newline at end of file",
        "--- a/f\n+++ b/f\n@@ -5,0 +6,2 @@\n+a\n+b\n@@ -9,2 +12 @@\n-a\n-b\n+c",
    ]
    for _ in range(20):
        patch, old, new = "--- a/f\n+++ b/f", 1, 1
        for _ in range(rng.randint(1, 4)):
            body = [rng.choice(" +-") for _ in range(rng.randint(1, 9))]
            patch += f"\n@@ -{old},{len(body)} +{new},{len(body)} @@"
            for kind in body:
                patch += "\n" + kind + rng.choice(["", "@@", "x", "-", "+"])
            old += 20
            new += 25
        patches.append(patch)
    df = spark.createDataFrame([(1, str(i), "f", p) for i, p in enumerate(patches)], "project_id bigint, sha string, path string, patch string")
    got = {}
    for r in ranges.patch_linechanges(df).collect():
        got.setdefault(int(r["sha"]), set()).add((r["kind"], r["begin"], r["end"]))
    for i, patch in enumerate(patches):
        assert got.get(i, set()) == read_patch(patch), patch


def reference_loc(content, comments):
    lines = re.split(r"\r\n?|\n", content)
    lines = lines[:-1] if lines[-1] == "" else lines
    commented = set()
    for b, bc, e, ec in comments:
        if b == e:
            covered = [(b, lines[b - 1][bc - 1 : ec])]
        else:
            covered = [(b, lines[b - 1][bc - 1 :]), (e, lines[e - 1][:ec])]
            commented |= set(range(b + 1, e))
        for n, part in covered:
            if not lines[n - 1].replace(part, "").strip():
                commented.add(n)
    blank = {n for n, line in enumerate(lines, 1) if not line} - commented
    return len(blank), len(commented), len(lines) - len(blank) - len(commented), len(lines)


def test_lines_of_code(spark, tables):
    cases = {
        "plain": ("code\n\n// c\n  \n", [(3, 1, 3, 4)]),
        "after code": ("x; // c\n// c // c\n", [(1, 4, 1, 7), (2, 1, 2, 4)]),
        "block": ("/* a\n\nb */\nx /* c\n*/ y\n\n", [(1, 1, 3, 4), (4, 3, 5, 2)]),
        "none": ("", []),
        "cr": ("a\rb\r\n\rc", []),
        "nbsp": (" // x\n\t　/* y */", [(1, 2, 1, 5), (2, 3, 2, 9)]),
    }
    t = tables(
        changes=([(1, name, "f.c", 3, 1, 1, NO_OID, name) for name in cases] + [(1, "plain", "f.py", 3, 1, 1, NO_OID, "plain")], CHANGES),
        blobs=([(name, False, content) for name, (content, _) in cases.items()], BLOBS),
        comments=([(name, 1, *c) for name, (_, cs) in cases.items() for c in cs], COMMENTS),
        functions=([("plain", 1, "f()", 1, 2), ("plain", 2, "f()", 2, 4), ("plain", 3, "g()", 1, 1)], FUNCTIONS),
    )
    got = {(r["sha"], r["path"]): tuple(r)[3:] for r in source.loc(t).collect()}
    for name, (content, comments) in cases.items():
        assert got[name, "f.c"] == (reference_loc(content, comments) if content else (0, 0, 0, 0)), name
    assert got["plain", "f.c"] == (1, 1, 2, 4) and got["plain", "f.py"] == (None,) * 4
    per_function = {r["sha"]: r["loc"] for r in source.loc(t, granularity="function").filter("path = 'f.c'").collect()}
    assert {s: tuple(v) for s, v in per_function["plain"].items()} == {"f()": (1, 1, 1, 3), "g()": (0, 0, 1, 1)}
    assert per_function["none"] == {}
    other = source.loc(t, granularity="class").columns
    assert "aggregate" in other


def test_function_churn(spark, tables):
    functions = [
        ("old", 1, "a()", 1, 3), ("old", 2, "b()", 4, 6), ("old", 3, "same()", 7, 9),
        ("new", 1, "same()", 1, 3), ("new", 2, "same()", 10, 12), ("new", 3, "b()", 20, 22), ("new", 4, "n()", 30, 31),
        ("blank", 1, "z()", 1, 1),
    ]
    rows = [
        (1, "mod", "f.c", 3, 1, 1, "old", "new"), (1, "add", "f.c", 1, 1, 1, NO_OID, "new"), (1, "del", "f.c", 2, 1, 1, "old", NO_OID),
        (1, "py", "f.py", 3, 1, 1, "old", "new"), (1, "type", "f.c", 8, 1, 1, "old", "new"), (1, "none", "f.c", 3, 1, 1, "blank", "unknown"),
    ]
    parts = dict(
        changes=(rows, CHANGES), functions=(functions, FUNCTIONS),
        blobs=([("old", False, "x"), ("new", False, "y"), ("blank", False, "")], BLOBS),
        linechanges=([(1, s, "f.c", kind, b, e) for s in ("mod", "type") for kind, b, e in (("+", 2, 2), ("-", 11, 19))], RANGES),
    )
    got = {r["sha"]: tuple(r)[4:] for r in source.functionchurn(tables(projects=project("C"), **parts)).collect()}
    nothing = (None,) * 4
    assert got == {"mod": (1, 1, 2, 4), "add": (3, 0, 0, 3), "del": (0, 3, 0, 3), "py": nothing, "type": (1, 1, 0, 2), "none": nothing}
    rows = source.functionchurn(tables(projects=project("Java"), **parts)).collect()
    assert all(tuple(r)[4:] == nothing and not r["supported"] for r in rows)


def test_complexity_and_nesting_per_function(spark, tables):
    content = "int f(void) {\n  if (a) { b(); }\n}\nint f(void) {\n  while (a) { if (b) { c(); } }\n}\n"
    t = tables(
        changes=([(1, "s", "f.c", 3, 1, 1, NO_OID, "o"), (1, "t", "g.c", 3, 1, 1, NO_OID, "p")], CHANGES),
        blobs=([("o", False, content), ("p", False, "x")], BLOBS),
        functions=([("o", 1, "f", 1, 3), ("o", 2, "g", 1, 3), ("o", 3, "f", 4, 6)], FUNCTIONS),
    )
    assert {r["sha"]: r["complexity"] for r in source.complexity(t).collect()} == {"s": {"f": 3, "g": 2}, "t": None}
    assert {r["sha"]: r["nesting"] for r in source.nesting(t).collect()} == {"s": {"f": 2, "g": 1}, "t": None}


def test_flow_needs_all_keys_and_one_value(spark, tables):
    entity = "project_id bigint, entity struct<uid:bigint,type:string,name:string,path:string>, metrics map<string,double>"
    keys = ("CountInput", "CountOutput", "CountPath")
    rows = [(1, (1, "Function", "f", None), dict(zip(keys, (None, 2.0, None)))), (1, (2, "Function", "g", "p"), dict.fromkeys(keys))]
    got = source.flow(tables(entity_metrics=(rows, entity))).collect()
    assert [(r["entity"]["uid"], r["ninput"], r["noutput"], r["npath"]) for r in got] == [(1, None, 2, None)]
    with pytest.raises(Exception, match="CountPath is missing"):
        source.flow(tables(entity_metrics=([(1, (1, "F", "f", None), {"CountInput": 1.0, "CountOutput": 1.0})], entity))).collect()


def test_keyword_hunk_and_tokens(spark, tables):
    schema = "project_id bigint, sha string, path string, patch string"
    patches = ([(1, "s", "p", "x\n@@ -1 +1 @@\n+if else If"), (1, "s", "q", None)], schema)
    t = tables(patches=patches, projects=project("Python"), messages=([(1, "s", "Fix it, fix IT"), (1, "e", "")], "project_id bigint, sha string, message string"))
    assert {r["path"]: (r["keywords"], r["error"]) for r in change.keyword(t).collect()} == {"p": ({"else": 1, "if": 2}, None), "q": (None, None)}
    assert {r["path"]: r["hunks"] for r in change.hunk(t).collect()} == {"p": 1, "q": None}
    assert {r["path"]: r["tokens"] for r in change.patchtokens(t).collect()} == {"p": ["else", "if"], "q": None}
    assert {r["sha"]: r["tokens"] for r in change.messagetokens(t).collect()} == {"s": ["fix", "it"], "e": []}
    t = tables(patches=patches, projects=project("Go"))
    assert {r["error"] for r in change.keyword(t).collect()} == {"LanguageNotSupported"}
    asked = spark.createDataFrame([(1, "s", "p"), (1, "s", "nowhere")], "project_id bigint, sha string, path string")
    assert {r["path"]: r["hunks"] for r in change.hunk(t, asked).collect()} == {"p": 1, "nowhere": None}


def test_projects_by_owner_and_name(spark):
    rows = [(1, "o", "r", "C", "u"), (2, "o", "s", "C", "u"), (3, "x", "r", "C", "u")]
    projects = spark.createDataFrame(rows, PROJECTS)

    def ids(**options):
        return sorted(r["id"] for r in lookups.project_get(projects, **options).collect())

    assert ids() == ids(repository="r") == [1, 2, 3] and ids(owner="o") == [1, 2] and ids(owner="o", repository="s") == [2]
    with pytest.raises(lookups.NotFound):
        lookups.project_get(projects, "x", "s")


def test_moves_above_similarity(spark):
    lines = spark.createDataFrame(
        [(1, "s", " rename a => b (80%)"), (1, "s", " rename {c => d}/e (100%)"), (1, "t", " rename f => g (60%)")],
        "project_id bigint, sha string, line string")
    assert lookups.moves(lines).count() == 1 and lookups.moves(lines, 70).count() == 2 and lookups.moves(lines, 500).count() == 1


def test_files_are_active_until_deleted(spark):
    changes = spark.createDataFrame([(1, "a", "x/f", 1), (1, "b", "x/f", 2), (1, "a", "g", 1), (1, "c", "h", 2), (1, "d", "h", 1)],
                                    "project_id bigint, sha string, path string, type int")
    commits = spark.createDataFrame([(1, s, n) for n, s in enumerate("abcd", 1)], "project_id bigint, sha string, seq bigint")
    got = {r["path"]: (r["is_active"], r["module"]) for r in lookups.get_files(SimpleNamespace(changes=changes, commits=commits)).collect()}
    assert got == {"x/f": (False, "x"), "g": (True, "(root)"), "h": (True, "(root)")}


def patch_ranges(spark, patch):
    rows = ranges.patch_linechanges(spark.createDataFrame([(1, "s", "p", patch)], "project_id bigint, sha string, path string, patch string")).collect()
    return sorted((r["kind"], r["begin"], r["end"]) for r in rows)


def test_combined_patches_give_the_first_parent_s_ranges(spark):
    assert patch_ranges(spark, "@@@ -1,2 -1,2 +1,3 @@@\n--a\n++b\n @@ x") == [("+", 1, 1), ("-", 1, 1)]
    patch = "diff --cc f\n--- a/f\n+++ b/f\n@@@ -10,4 -20,5 +30,5 @@@ int f()\n  both\n- first\n -second\n +of first\n+ of second\n++new\n  both\n\n@@@ -90,0 -91 +95 @@@\n++end"
    assert patch_ranges(spark, patch) == [("+", 32, 33), ("+", 95, 95), ("-", 11, 11)]
    assert patch_ranges(spark, "@@@@ -5,2 -6,2 -7,2 +8,2 @@@@\n -- x\n---gone\n+++new\n") == [("+", 8, 8), ("-", 5, 5)]


def test_files_on_unmerged_branches(spark, tables):
    """A path deleted on a branch that nothing merges stays active; one that only such a branch has is not."""
    commits = [(1, s, n, "A", "a", n) for n, s in enumerate("abcd", 1)]
    parents = [(1, "b", "a", 1), (1, "c", "a", 1), (1, "d", "b", 1)]
    changes = [(1, "a", "f", 1), (1, "c", "f", 2), (1, "c", "only", 1), (1, "b", "g", 1), (1, "d", "g", 2)]
    t = tables(
        commits=(commits, "project_id bigint, sha string, ts bigint, author_name string, author_email string, seq bigint"),
        commit_parents=(parents, "project_id bigint, sha string, parent_sha string, parent_no int"),
        changes=(changes, "project_id bigint, sha string, path string, type int"),
    )
    assert {r.path: r.is_active for r in lookups.get_files(t).collect()} == {"f": True, "g": False, "only": False}
    assert {r.path: r.is_active for r in lookups.get_files(t, merges=False).collect()} == {"f": False, "g": False, "only": True}


def test_bare_carriage_returns_end_no_line(spark):
    patch = "@@ -10,1 +10,2 @@\n a\r@@ -90 +90 @@\n+b\n"
    assert patch_ranges(spark, patch) == [("+", 11, 11)]


def test_scattered_lines_of_one_change(spark):
    """Work on one change grows with its lines, not with lines times ranges."""
    n = 40_000
    deleted = spark.range(n).select(F.lit(1).cast("bigint").alias("project_id"), F.lit("s").alias("sha"), F.lit("p").alias("path"), F.lit("-").alias("kind"), (2 * F.col("id") + 1).alias("begin"), (2 * F.col("id") + 1).alias("end"))
    blame = deleted.select("project_id", "sha", "path", F.col("begin").alias("line"), F.when(F.col("begin") % 3 == 0, F.lit("x")).otherwise(F.lit("y")).alias("last_sha"))
    assert ranges.last_modifiers(deleted, blame).count() == n


def test_blame_by_ranges(spark):
    """Random ranges against line by line; and a deletion of ten million lines in three ranges."""
    r = random.Random(5)
    deleted, blame, wanted = [], [], {}
    for k in range(40):
        lines, who, at = set(), {}, 1
        for _ in range(r.randint(0, 5)):
            a = r.randint(1, 60)
            b = a + r.randint(0, 9)
            lines.update(range(a, b + 1))
            deleted.append((1, f"s{k}", "p", "-", a, b))
        while at < 70:
            end, sha = at + r.randint(0, 12), r.choice("xyz")
            if r.random() < 0.8:
                blame.append((1, f"s{k}", "p", at, end, sha))
                who.update(dict.fromkeys(range(at, end + 1), sha))
            at = end + 1
        for n in sorted(lines):
            if n in who:
                wanted.setdefault((f"s{k}", who[n]), []).append(n)
    n = 10_000_000
    deleted += [(1, "big", "p", "-", 1, n // 2), (1, "big", "p", "-", n // 2 + 1, n - 5), (1, "big", "p", "-", n, n)]
    blame += [(1, "big", "p", 1, n - 3, "x"), (1, "big", "p", n - 2, n, "y")]
    key = "project_id bigint, sha string, path string"
    by_range = spark.createDataFrame(blame, f"{key}, begin bigint, end bigint, last_sha string")
    found = ranges.last_modifiers(spark.createDataFrame(deleted, RANGES), by_range).collect()
    assert sorted((x.last_sha, x.begin, x.end) for x in found if x.sha == "big") == [("x", 1, n - 5), ("y", n, n)]
    got = {}
    for x in found:
        if x.sha != "big":
            got.setdefault((x.sha, x.last_sha), []).extend(range(x.begin, x.end + 1))
    assert {k: sorted(v) for k, v in got.items()} == wanted
    by_line = [(1, sha, "p", n, who) for (sha, who), ns in wanted.items() for n in ns]
    lines = spark.createDataFrame(by_line, f"{key}, line bigint, last_sha string")
    again = ranges.last_modifiers(spark.createDataFrame(deleted, RANGES), ranges.blame_ranges(lines)).collect()
    assert sorted(map(tuple, again)) == sorted(tuple(x) for x in found if x.sha != "big")


def test_one_file_of_many_lines_and_functions(spark, tables):
    n = 20_000
    content = "\n".join("" if i % 4 == 0 else f"line {i}" for i in range(1, n + 1))
    functions = [("b", k, f"f{k}", 2 * k + 1, 2 * k + 2) for k in range(n // 2)]
    t = tables(
        blobs=([("b", False, content), ("a", False, "x\ny")], BLOBS), functions=(functions + [("a", 0, "f7", 1, 2)], FUNCTIONS), comments=([], COMMENTS),
        changes=([(1, "s", "p.c", 3, 1, 1, "a", "b")], CHANGES), linechanges=([(1, "s", "p.c", "+", 15, 15)], RANGES), projects=project("C"),
    )
    rows = source.blob_function_loc(t.blobs, t.comments, t.functions).collect()
    assert len(rows) == n // 2 + 1 and {(r["blank"], r["aggregate"]) for r in rows if r["oid"] == "b"} == {(0, 2), (1, 2)}
    assert source.line_in_function(t).filter("oid = 'b' AND is_blank").count() == n // 4 - 1  # an empty last line is none
    got = source.functionchurn(t).collect()[0]
    assert (got["insertions"], got["deletions"], got["modifications"]) == (n // 2 - 1, 0, 1)


def test_requests_restrict_what_is_measured(spark, tables):
    changes = [(1, f"s{k}", "p.c", 3, 1, 1, f"b{k}", f"b{k + 1}") for k in range(5)]
    t = tables(blobs=([(f"b{k}", False, "a\n" * k) for k in range(6)], BLOBS), comments=([], COMMENTS), changes=(changes, CHANGES), functions=([], FUNCTIONS), projects=project("C"), linechanges=([], RANGES))
    asked = spark.createDataFrame([(9, 1, "s2", "p.c"), (10, 1, "gone", "p.c")], "request_id bigint, project_id bigint, sha string, path string")
    assert sorted((r["request_id"], r["aggregate"]) for r in source.loc(t, asked).collect()) == [(9, 3), (10, None)]
    assert change.asked_only(t, asked).blobs.count() == 2
