"""Column functions on hand-written lines."""

import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from commitlens.functions import parsing, paths, text


def values(spark, strings, column):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r["v"] for r in df.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_change_lines(spark):
    got = values(spark, [
        ":100644 100644 f1 f2 M\ta/b  c.c",
        "::100644 100644 100644 f1 f2 f3 MM\tq.c",
        ":000000 100644 f1 f2 A\tnew",
        ":100644 000000 f1 f2 D\tgone",
        ":100644 120000 f1 f2 T\tlink",
        ":100644 100644 f1 f2 R098 plain path",
    ], parsing.parse_change)
    assert [tuple(r) for r in got] == [
        ("a/b  c.c", 3, "f1", "f2"), ("q.c", 3, "f1", "f3"), ("new", 1, "f1", "f2"),
        ("gone", 2, "f1", "f2"), ("link", 8, "f1", "f2"), ("plain path", 4, "f1", "f2"),
    ]


def test_short_change_lines_give_nulls(spark):
    got = values(spark, ["", ":", ":100644 100644 f1", "::1", ":100644 100644 f1 f2 X\tp"], parsing.parse_change)
    assert [r["type"] for r in got] == [None] * 5 and got[2]["oid_before"] == "f1" and got[4]["path"] == "p"


def test_delta_lines(spark):
    got = values(spark, ["3\t4\ta b.c", "-\t-\tx.png", "0\t12\ty"], parsing.parse_delta)
    assert [tuple(r) for r in got] == [(3, 4, "a b.c"), (None, None, "x.png"), (0, 12, "y")]


def test_move_lines(spark):
    got = values(spark, [
        " rename a/{ => c}/d.c (98%)",
        " rename {old => new}/f.c (100%)",
        " rename lib/{x => y.c} (51%)",
        " rename a/f.c => b/g.c (77%)",
        " rename a/{b => }/d.c (90%)",
        " mode change 100644 => 100755 x.sh",
    ], parsing.parse_move)
    assert [tuple(r) if r else None for r in got] == [
        ("a/d.c", "a/c/d.c", 98), ("old/f.c", "new/f.c", 100), ("lib/x", "lib/y.c", 51),
        ("a/f.c", "b/g.c", 77), ("a/b/d.c", "a/d.c", 90), None,
    ]


def test_module_is_the_directory(spark):
    names = ["a/b/c.c", "c.c", "/c.c", "a//c.c", "a/", "//c", "a/b//c"]
    assert values(spark, names, paths.module_of_path) == [posixpath.dirname(n) or "(root)" for n in names]


def test_language_is_case_sensitive_and_escaped(spark):
    names = ["a.c", "a.C", "a.h", "a.H", "a.c++", "a.ccc", "a.cpp", "a.CPP", "a.py", "c", "x.tcc", "dir.c/x"]
    assert values(spark, names, paths.infer_language) == [
        "C", "C++", "C", "C++", "C++", None, "C++", "C++", None, None, "C++", None]


def test_whitelist(spark):
    names = ["Makefile", "x/makefile", "xmakefile", "a.PY", "a.pyc", "py"]

    def kept(**options):
        return values(spark, names, lambda c: paths.path_whitelist(c, **options))

    assert kept() == [True] * 6
    assert kept(names=["makefile"]) == [True, True, False, False, False, False]
    assert kept(extensions=["py"]) == [False, False, False, True, False, False]
    assert kept(names=["makefile"], extensions=["pyc?"]) == [True, True, False, True, True, False]


def test_sizes_and_lines(spark):
    contents = ["", "a", "a\n", "a\n\n", "a\rb", "a\r\nb\n", "\n"]
    assert values(spark, contents, text.content_size) == [0, 1, 1, 2, 1, 2, 1]
    expected = []
    for c in contents:
        lines = re.split(r"\r\n?|\n", c)
        expected.append(lines[:-1] if lines[-1] == "" else lines)
    assert values(spark, contents, text.split_lines) == expected


def test_tokens_follow_word_rules(spark):
    samples = ["Fix the BUG, a_b x 42 é éa x-ray", "", "A b c", "ünï code_2 Ünï", "naïve²³ ½½"]
    expected = [sorted(set(re.findall(r"(?u)\b\w\w+\b", s.lower()))) for s in samples]
    assert values(spark, samples, text.tokenize) == expected
    assert values(spark, [None], text.tokenize) == [None]


def test_tokens_of_many_texts_are_those_of_the_pattern(spark):
    """Of any characters, in texts longer than a slice, with nulls and bad bytes, without an array of all hits per text."""
    rng = random.Random(5)
    plain = "aB_9é -\n.İΣσßǅ½²漢𝒜𐐀\u0301\u00a0\u2028\ufffd"
    whole = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(rng.choices(plain, k=rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(whole[i : i + 5000]) for i in range(0, len(whole), 5000)]
    texts += ["".join(rng.choices(whole, k=200)) for _ in range(200)] + ["x", "é", "  ", "", None, "ab" * 70_000, "éa b " * 900_000]
    # Each character beside a letter, and alone.
    texts += [" ".join(f"a{c} {c} {c}{c}" for c in whole[i : i + 5000]) for i in range(0, len(whole), 5000)]
    valid = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    broken = [b"ab\xffcd", b"\xf0", b"\xc3", b"ab \xe2\x82", b"\x80\x80"] * 3
    rows = valid.union(spark.createDataFrame(list(enumerate(map(bytearray, broken), len(texts))), "i int, s binary").select("i", F.col("s").cast("string")))
    rows = rows.repartition(2, "i")
    hits = F.sort_array(F.array_distinct(text.tokens(F.col("s"))))
    both = rows.select("i", "s", text.tokenize(F.col("s")).alias("found"), hits.alias("expected"))
    assert both.count() == len(texts) + len(broken)
    assert both.filter(~F.col("found").eqNullSafe(F.col("expected"))).select("i", F.hex("s")).take(3) == []
    assert "regexp_extract_all" not in rows.select(text.tokenize(F.col("s")))._jdf.queryExecution().toString()


def test_hunks_count_headers_after_a_newline(spark):
    assert values(spark, ["@@ -1 +1 @@\n+a", "x\n@@ a\n@@@ b\n", ""], text.count_hunks) == [0, 2, 0]


def test_keywords_in_dictionary_order(spark):
    def counts(language):
        return lambda c: text.keyword_counts(c, F.lit(language))

    patch = ["None if None else if False", "", None]
    got = values(spark, patch, counts("Python"))
    assert [[tuple(p) for p in g] if g is not None else None for g in got] == [[("else", 1), ("if", 2)], [], None]
    assert values(spark, patch, counts("Go")) == [None] * 3
    got = values(spark, ["while for int FOR bool"], counts("C++"))
    assert [tuple(p) for p in got[0]] == [("bool", 1), ("for", 2), ("int", 1)]


def test_blob_text(spark):
    df = spark.createDataFrame(
        [(1, bytearray(b"ok\xff!"), False), (2, bytearray(b"x"), True), (3, None, None)], "i int, data binary, b boolean")
    got = df.select(text.decode_blob(F.col("data"), F.col("b")).alias("v")).collect()
    assert [r["v"] for r in got] == [b"ok\xff!".decode(errors="replace"), None, None]


def test_decisions_and_nesting(spark):
    body = 'int f() {\n if (a && b) { for (;;) { x = "if { while"; } } // case\n /* if\n { */ return a ? b : c;\n}'
    assert values(spark, [body, "int g() {}", 'c = \'{\'; "a\\"if"; else'], text.decision_count) == [5, 1, 1]
    plain = "int f() { if (a) { for (;;) { } } { } }"
    assert values(spark, [plain, "int g() {}", "x", "} {"], text.brace_depth) == [2, 0, 0, 0]
