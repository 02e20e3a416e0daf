"""Version-control tables derived from the TPC-H-like test tables.

Every table is derived from whole input tables: a supplier is a project, an order a
commit, a line item a change, a document or web page a file version, and an event a
request.  The SQL is shared by Spark and DuckDB; ``{...}`` marks the few
expressions that the two spell differently.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions.names import packed, unpacked
from commitlens.operators import dag, history
from commitlens.operators.history import before_last
from commitlens.schemas import NO_OID
from commitlens.session import scratch, write_table

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _sha(x):
    text = f"CAST({x} AS STRING)"
    return f"concat(md5({text}), substring(md5(concat('s', {text})), 1, 8))"


def _combined(x, mode, ref, newline, how=""):
    """A patch as that of a merge with two parents: some lines are new to the second parent only, some of its lines go."""
    for pattern, by in (
        ("^@@ -([0-9]+) [+](.*) @@$", f"'@@@ -{ref}1 -{ref}1 +{ref}2 @@@'"), ("^-old$", f"concat('--old', {newline}, ' -other')"),
        ("^[+]([a-z])", f"' +{ref}1'"), ("^[+]", "'++'"),
    ):
        x = f"regexp_replace({x}, '{mode}{pattern}', {by}{how})"
    return x


_SPARK = {
    "DAY": lambda x: f"CAST(datediff(CAST({x} AS DATE), DATE'1970-01-01') AS BIGINT)",
    "SHA": _sha,
    "SERIES": lambda x: f"LATERAL explode(CASE WHEN {x} >= 1 THEN sequence(1L, {x}) ELSE array() END) AS t(l)",
    "BODY": lambda x: (
        f"array_join(transform(split({x}, '\\n', -1), (x, i) -> concat(CASE WHEN i % 3 = 0 THEN "
        "concat('@@ -', CAST(1 + 2 * (i div 3) AS STRING), ' +', CAST(1 + 4 * (i div 3) AS STRING), ',', "
        f"CAST(least(3, size(split({x}, '\\n', -1)) - i) AS STRING), ' @@\\n-old\\n') ELSE '' END, '+', x)), '\\n')"
    ),
    "COMBINED": lambda x: _combined(x, "(?md)", "$", "'\\n'"),
    "NL": lambda x: "'\\n'",
    "TAB": lambda x: "'\\t'",
}
_DUCKDB = {
    "DAY": lambda x: f"date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))",
    "SHA": _sha,
    "SERIES": lambda x: f"LATERAL (SELECT unnest(generate_series(1, {x})) AS l) t",
    "BODY": lambda x: (
        f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x, j: concat(CASE WHEN (j - 1) % 3 = 0 THEN "
        "concat('@@ -', CAST(1 + 2 * ((j - 1) // 3) AS STRING), ' +', CAST(1 + 4 * ((j - 1) // 3) AS STRING), ',', "
        f"CAST(least(3, len(string_split({x}, chr(10))) - j + 1) AS STRING), ' @@', chr(10), '-old', chr(10)) ELSE '' END, '+', x)), chr(10))"
    ),
    "COMBINED": lambda x: _combined(x, "(?m)", "\\", "chr(10)", ", 'g'"),
    "NL": lambda x: "chr(10)",
    "TAB": lambda x: "chr(9)",
}

VIEWS = {
    "projects": """
SELECT s_suppkey AS id, concat('own', CAST(s_nationkey AS STRING)) AS owner,
  lower(replace(s_name, '#', '-')) AS repository,
  CASE s_suppkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'C++' WHEN 2 THEN 'Java' WHEN 3 THEN 'Python' ELSE 'Go' END AS language,
  concat('https://example.org/', lower(replace(s_name, '#', '-'))) AS repository_url
FROM supplier""",
    "files_src": """
SELECT p_partkey, concat(CASE WHEN p_size % 7 = 0 THEN '' ELSE
    concat(lower(replace(p_brand, '#', '')), '/', lower(replace(p_type, ' ', '_')), '/') END,
    'f', CAST(p_partkey AS STRING)) AS stem,
  CASE p_size % 5 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.cpp' WHEN 3 THEN '.py' ELSE '.java' END AS ext
FROM part""",
    "unordered_commits": """
SELECT o_orderkey % (SELECT count(*) FROM supplier) AS project_id, {SHA:o_orderkey} AS sha,
  {DAY:o_orderdate} * 86400 + (o_orderkey * 7919) % 86400 AS ts,
  concat('dev', CAST(o_custkey % 15 AS STRING)) AS author_name,
  concat('dev', CAST(o_custkey % 15 AS STRING), CASE WHEN o_custkey % 30 < 15 THEN '@example.org' ELSE '@home.example.org' END) AS author_email
FROM orders""",
    "commits": """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, sha) AS seq FROM unordered_commits""",
    "commit_parents": """
SELECT c.project_id, c.sha, p.sha AS parent_sha, 1 AS parent_no
FROM commits c JOIN commits p ON p.project_id = c.project_id AND p.seq = c.seq - CASE WHEN c.seq % 10 IN (3, 4, 6) THEN 2 ELSE 1 END
UNION ALL
SELECT c.project_id, c.sha, p.sha AS parent_sha, 2 AS parent_no
FROM commits c JOIN commits p ON p.project_id = c.project_id AND p.seq = c.seq - CASE WHEN c.seq % 10 = 8 THEN 3 ELSE 6 END
WHERE c.seq % 10 IN (8, 9)""",
    "changed_items": """
SELECT l_orderkey % (SELECT count(*) FROM supplier) AS project_id, l_orderkey AS okey,
  l_partkey - l_partkey % (SELECT count(*) FROM supplier) + l_orderkey % (SELECT count(*) FROM supplier) AS pkey,
  CAST(l_quantity AS BIGINT) % 3 AS slot,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS type,
  CAST(l_quantity AS BIGINT) AS ins, CAST(l_linenumber AS BIGINT) AS del, l_tax, l_discount, {DAY:l_shipdate} * 86400 AS ship
FROM lineitem""",
    "changes": """
SELECT project_id, {SHA:okey} AS sha, path, type,
  CASE WHEN tax > 0.075 THEN NULL ELSE ins END AS insertions,
  CASE WHEN tax > 0.075 THEN NULL ELSE del END AS deletions,
  CASE WHEN type = 1 THEN '0000000000000000000000000000000000000000' ELSE
    concat('d', CAST((pkey + slot) % (SELECT count(*) FROM documents) AS STRING)) END AS oid_before,
  CASE WHEN type = 2 THEN '0000000000000000000000000000000000000000'
    WHEN okey % 5 = 0 THEN concat('p', CAST((pkey + okey) % (SELECT count(*) FROM pages) AS STRING))
    ELSE concat('d', CAST((pkey + okey) % (SELECT count(*) FROM documents) AS STRING)) END AS oid_after
FROM (SELECT x.project_id, x.okey, x.pkey, x.slot, concat(f.stem, '_', CAST(x.slot AS STRING), f.ext) AS path,
    min(x.type) AS type, CAST(sum(x.ins) AS BIGINT) AS ins, CAST(sum(x.del) AS BIGINT) AS del, max(x.l_tax) AS tax
  FROM changed_items x JOIN files_src f ON f.p_partkey = x.pkey
  GROUP BY x.project_id, x.okey, x.pkey, x.slot, f.stem, f.ext) g""",
    "blobs": """
SELECT concat('d', CAST(doc_id AS STRING)) AS oid, doc_id % 50 = 49 AS is_binary,
  CASE WHEN doc_id % 50 = 49 THEN NULL WHEN doc_id % 50 = 48 THEN ''
    ELSE replace(replace(text, ', ', ' { '), '. ', ' } ') END AS content FROM documents
UNION ALL
SELECT concat('p', CAST(page_id AS STRING)) AS oid, false AS is_binary, html AS content FROM pages""",
    "messages": """
SELECT c.project_id, c.sha, CASE d.doc_id % 4
    WHEN 0 THEN replace(d.text, '. ', concat('.', {NL:}, '*', {NL:}))
    WHEN 1 THEN concat(replace(d.text, ', ', concat(',', {NL:}, '*', {NL:}, '*', {NL:})), {NL:}, '*')
    ELSE d.text END AS message
FROM (SELECT o_orderkey % (SELECT count(*) FROM supplier) AS project_id, {SHA:o_orderkey} AS sha,
    o_orderkey % (SELECT count(*) FROM documents) AS doc_id FROM orders) c JOIN documents d ON d.doc_id = c.doc_id""",
    "patches": """
SELECT h.project_id, h.sha, h.path, concat('diff --git a/', h.path, ' b/', h.path, {NL:}, '--- a/', h.path, {NL:},
  '+++ b/', h.path, {NL:}, CASE WHEN m.sha IS NULL THEN b.body ELSE {COMBINED:b.body} END) AS patch
FROM changes h LEFT JOIN (SELECT DISTINCT project_id, sha FROM commit_parents WHERE parent_no = 2) m ON m.project_id = h.project_id AND m.sha = h.sha
JOIN (SELECT oid, {BODY:content} AS body FROM blobs WHERE content IS NOT NULL) b ON b.oid = h.oid_after""",
    "linechanges": """
SELECT project_id, sha, path, '+' AS kind, 4 * l - 3 AS "begin", least(4 * l - 1, insertions) AS "end"
FROM changes, {SERIES:CAST(floor((insertions + 3) / 4) AS BIGINT)} WHERE type = 3 AND insertions IS NOT NULL
UNION ALL
SELECT project_id, sha, path, '-' AS kind, 3 * l - 2 AS "begin", least(3 * l - 1, deletions) AS "end"
FROM changes, {SERIES:CAST(floor((deletions + 2) / 3) AS BIGINT)} WHERE type = 3 AND deletions IS NOT NULL""",
    "path_history": """
SELECT h.project_id, h.sha, h.path, row_number() OVER (PARTITION BY h.project_id, h.path ORDER BY c.seq) AS nth
FROM changes h JOIN commits c ON c.project_id = h.project_id AND c.sha = h.sha""",
    "blame": """
SELECT x.project_id, x.sha, x.path, x.line,
  CASE WHEN x.line % 2 = 0 THEN p1.sha ELSE coalesce(p2.sha, p1.sha) END AS last_sha
FROM (SELECT project_id, sha, path, "begin" + l - 1 AS line FROM linechanges, {SERIES:"end" - "begin" + 1} WHERE kind = '-') x
JOIN path_history n ON n.project_id = x.project_id AND n.sha = x.sha AND n.path = x.path
JOIN path_history p1 ON p1.project_id = n.project_id AND p1.path = n.path AND p1.nth = n.nth - 1
LEFT JOIN path_history p2 ON p2.project_id = n.project_id AND p2.path = n.path AND p2.nth = n.nth - 2""",
    "blob_sizes": """
SELECT oid, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, {NL:}, ''))
  + CASE WHEN right(content, 1) = {NL:} THEN 0 ELSE 1 END END AS nlines FROM blobs WHERE content IS NOT NULL""",
    "functions": """
SELECT oid, l AS ord, concat('int fn', CAST((l * 7 + nlines) % 5 AS STRING), '(void)') AS signature,
  3 * l - 2 AS begin_line, 3 * l AS end_line FROM blob_sizes, {SERIES:CAST(floor(nlines / 3) AS BIGINT)}""",
    "comments": """
SELECT oid, 1 AS type, 2 AS begin_line, 1 AS begin_col, 2 AS end_line, 100000 AS end_col FROM blob_sizes WHERE nlines >= 2
UNION ALL
SELECT oid, 2 AS type, 4 AS begin_line, 3 AS begin_col, 6 AS end_line, 2 AS end_col FROM blob_sizes WHERE nlines >= 6""",
    "offenders": """
SELECT x.project_id, x.ship AS ts, concat(f.stem, '_', CAST(x.slot AS STRING), f.ext) AS path,
  CASE WHEN x.okey % 3 = 0 THEN concat(f.stem, '_', CAST((x.slot + 1) % 3 AS STRING), f.ext, ',', f.stem, '.old') ELSE '' END AS aliases,
  concat('REF-', CAST(x.okey AS STRING)) AS reference
FROM changed_items x JOIN files_src f ON f.p_partkey = x.pkey WHERE x.l_discount >= 0.095""",
    "raw_changes": """
SELECT project_id, sha, CASE WHEN type = 3 AND insertions % 10 = 0
  THEN concat('::100644 100644 100644 ', oid_before, ' ffff ', oid_after, ' MM', {TAB:}, path)
  ELSE concat(':100644 100644 ', oid_before, ' ', oid_after, ' ', CASE type WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END, {TAB:}, path) END AS line FROM changes""",
    "numstat": """
SELECT project_id, sha, concat(coalesce(CAST(insertions AS STRING), '-'), {TAB:}, coalesce(CAST(deletions AS STRING), '-'), {TAB:}, path) AS line FROM changes""",
    "rename_lines": """
SELECT project_id, {SHA:okey} AS sha, CASE pkey % 4
  WHEN 0 THEN concat(' rename lib/{{old => new}}/f', CAST(pkey AS STRING), '.c (', CAST(50 + ins AS STRING), '%)')
  WHEN 1 THEN concat(' rename a/f', CAST(pkey AS STRING), '.c => b/g.c (98%)')
  WHEN 2 THEN concat(' rename lib/{{ => sub}}/f', CAST(pkey AS STRING), '.c (100%)')
  ELSE ' mode change 100644 => 100755 x.sh' END AS line FROM changed_items""",
    "entity_metrics": """
SELECT p.p_partkey % (SELECT count(*) FROM supplier) AS project_id, p.p_partkey AS uid, 'Function' AS type, p.p_name AS name,
  concat(f.stem, f.ext) AS path,
  CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END AS CountInput, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 1 END AS CountOutput,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 2 END AS CountPath FROM part p JOIN files_src f ON f.p_partkey = p.p_partkey""",
    "requests": """
SELECT e.event_id AS request_id, c.project_id, c.sha, coalesce(h.path, concat(f.stem, '_0', f.ext)) AS path,
  concat('dev', CAST(e.user_id % 15 AS STRING)) AS name, concat('dev', CAST(e.user_id % 15 AS STRING), '@example.org') AS email
FROM events e JOIN unordered_commits c ON c.sha = {SHA:e.event_id}
JOIN files_src f ON f.p_partkey = c.project_id
LEFT JOIN (SELECT project_id, sha, min(path) AS path FROM changes GROUP BY project_id, sha) h
  ON h.project_id = c.project_id AND h.sha = c.sha AND e.event_id % 2 = 0""",
}

_MARK = re.compile(r"\{(\w+):([^{}]*)\}")


def _render(sql: str, dialect: dict) -> str:
    sql = _MARK.sub(lambda m: dialect[m[1]](m[2]), sql)
    return sql.replace("{{", "{").replace("}}", "}")


def used_tables(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def duckdb_ctes(*names: str) -> str:
    """WITH-list that defines the named tables, and all they need, for DuckDB."""
    ordered: list[str] = []

    def visit(name):
        if name not in ordered:
            for dependency in used_tables(VIEWS[name], VIEWS):
                visit(dependency)
            ordered.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({_render(VIEWS[n], _DUCKDB)})" for n in ordered)


# Tables that an ingest job would have written, made once per session and folder.
STORED = set(
    "commits commit_parents commit_chains commit_ladder commit_takes changes path_history linechanges blame "
    "blobs blob_sizes functions comments messages requests".split()
)  # Patches repeat the texts of their blobs for every change, so they are put together where they are read.
_PATHS: dict[tuple, str] = {}


class Tables:
    """The derived tables of one test-data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in STORED:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._stored(name) if name in STORED else self._build(name)
        return self._built[name]

    def _stored(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _PATHS:
            path = scratch(self.spark, name)
            write_table(self._build(name), path)
            _PATHS[key] = path
        return self.spark.read.parquet(_PATHS[key])

    def _build(self, name: str) -> DataFrame:
        if name == "commits":
            return history.history_order(self.table("unordered_commits"))
        if name in ("messages", "blobs"):
            # One small file of long texts would be read, and worked on, by one task.
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            texts = self.spark.read.parquet(f"{self.folder}/documents.parquet")
            return self._sql(name, documents=texts.repartition(tasks, "doc_id"))
        if name == "commit_chains":
            return dag.chains(self.table("commits"), self.table("commit_parents"))
        if name in ("commit_ladder", "commit_takes"):
            exits = dag.links(self.table("commit_chains"), self.table("commit_parents"))
            return dag.ladder(exits) if name == "commit_ladder" else dag.takes(exits, self.table("commit_ladder"))
        if name == "path_history":
            return self._path_history()
        if name == "changes":
            return self._changes()
        if name == "blame":
            return self._blame()
        if name == "patches":
            return self._patches()
        return self._sql(name)

    def _changes(self) -> DataFrame:
        """As ``VIEWS`` says, but items are summed up by their numbers, and names are made last.

        A part that comes several times counts its items as often.
        """
        items = self.table("changed_items").groupBy("project_id", "okey", "pkey", "slot").agg(
            F.min("type").alias("type"), F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.max("l_tax").alias("tax")
        )
        files = self.table("files_src").filter("p_partkey IS NOT NULL").groupBy("p_partkey", "stem", "ext").agg(F.count(F.lit(1)).alias("n"))
        summed = items.join(files, F.col("pkey") == F.col("p_partkey")).select(
            "project_id", "okey", "pkey", "slot", F.concat("stem", F.lit("_"), F.col("slot").cast("string"), "ext").alias("path"), "type",
            (F.col("ins") * F.col("n")).alias("ins"), (F.col("del") * F.col("n")).alias("del"), "tax",
        )
        outer = VIEWS["changes"].split("FROM (SELECT x.project_id")[0]
        return self._sql("changes", sql=f"{outer}FROM summed", summed=summed)

    def _ordered_touches(self):
        """(project_id, name, path, nth) as ``path_history``, with names as bytes, and the last position in any history."""
        name = packed(F.col("sha")).alias("name")
        commits = self.table("commits")
        touches = self.table("changes").select("project_id", name, "path").join(commits.select("project_id", name, "seq"), ["project_id", "name"])
        last = commits.agg(F.max("seq")).first()[0]
        return history.running(touches, ["project_id", "path"], {"nth": F.lit(1)}, last=last).select("project_id", "name", "path", "nth"), last

    def _path_history(self) -> DataFrame:
        return self._ordered_touches()[0].select("project_id", unpacked(F.col("name")).alias("sha"), "path", "nth")

    def _blame(self) -> DataFrame:
        """As ``VIEWS`` says, but lines are spread out last, when their change's two predecessors are known."""
        placed, last = self._ordered_touches()
        removed = self.table("linechanges").filter("kind = '-' AND begin <= end").select("project_id", packed(F.col("sha")).alias("name"), "path", "begin", "end")
        found = removed.join(before_last(placed, ["project_id", "path"], "nth", "name", last), ["project_id", "name", "path"])
        named = found.select("project_id", "path", "begin", "end", *[unpacked(F.col(n)).alias(n.replace("name", "sha")) for n in ("name", "name_1", "name_2")])
        lines = named.select("project_id", "sha", "path", F.explode(F.sequence("begin", "end")).alias("line"), "sha_1", "sha_2")
        by = F.when(F.col("line") % 2 == 0, F.col("sha_1")).otherwise(F.coalesce("sha_2", "sha_1"))
        return lines.select("project_id", "sha", "path", "line", by.alias("last_sha"))

    def _patches(self) -> DataFrame:
        """As ``VIEWS`` says, but a blob's lines are written out once for all changes, and once for all merges, that lead to it.

        Changes that lead to no blob are left out before the joins, and commits' names travel as bytes.
        """
        name = F.unhex("sha").alias("name")
        merges = self.table("commit_parents").filter("parent_no = 2").select("project_id", name, F.lit(True).alias("merge")).distinct()
        changes = self.table("changes").filter(F.col("oid_after") != NO_OID).select("project_id", name, "path", F.col("oid_after").alias("oid"))
        flagged = changes.join(merges, ["project_id", "name"], "left").withColumn("merge", F.coalesce("merge", F.lit(False)))
        each = self.table("blobs").filter("content IS NOT NULL").select("oid", "content", F.explode(F.array(F.lit(False), F.lit(True))).alias("merge"))
        written = each.select("oid", "merge", F.expr(_render("{BODY:content}", _SPARK)).alias("body"))
        bodies = written.select("oid", "merge", F.expr(_render("CASE WHEN merge THEN {COMBINED:body} ELSE body END", _SPARK)).alias("body"))
        parts = ("diff --git a/", "path", " b/", "path", "\n--- a/", "path", "\n+++ b/", "path", "\n", "body")
        patch = F.concat(*[F.col(x) if x in ("path", "body") else F.lit(x) for x in parts])
        return flagged.join(bodies, ["oid", "merge"]).select("project_id", F.lower(F.hex("name")).alias("sha"), "path", patch.alias("patch"))

    def _sql(self, name: str, sql: str | None = None, **given: DataFrame) -> DataFrame:
        sql = VIEWS[name] if sql is None else sql
        for table in used_tables(sql, BASE):
            given.setdefault(table, self.spark.read.parquet(f"{self.folder}/{table}.parquet"))
        for table in used_tables(sql, VIEWS):
            given[table] = self.table(table)
        ctes = []
        for table, frame in given.items():
            view = f"commitlens_{abs(hash(self.folder))}_{table}"
            frame.createOrReplaceTempView(view)
            ctes.append(f"{table} AS (SELECT * FROM {view})")
        body = _render(sql, _SPARK).replace('"begin"', "`begin`").replace('"end"', "`end`")
        return self.spark.sql(f"WITH {', '.join(ctes)} {body}")
