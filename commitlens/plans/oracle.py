"""DuckDB SQL with the result of each registered query, from the same input tables."""

from commitlens.functions import paths, text
from commitlens.plans.catalog import SEED
from commitlens.plans.queries import MIN_SIMILARITY, PAIRED, SOME_OWNER, STREAMED, WHITELIST_EXTENSIONS, WHITELIST_NAMES
from commitlens.sources.testdata import VIEWS, duckdb_ctes, used_tables

ORACLE: dict[str, str] = {}


def add(name: str, sql: str, extra: str = "") -> None:
    """Register SQL; the derived tables it names are defined in front of it."""
    used = used_tables(sql + extra, VIEWS)
    ctes = ",\n".join(part for part in (duckdb_ctes(*used) if used else "", extra) if part)
    ORACLE[name] = f"WITH {ctes}\n{sql}" if ctes else sql


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


KEY = "project_id, sha, path"
SAME_KEY = "x.project_id = y.project_id AND x.sha = y.sha AND x.path = y.path"
C_EXT = [e for e in paths.LANGUAGES["C"]]
CPP_EXT = [e for e in paths.LANGUAGES["C++"]]

TOUCHES = """touches AS (
  SELECT h.project_id, h.sha, h.path, h.type, c.seq, c.ts, c.author_name, c.author_email
  FROM changes h JOIN commits c ON c.project_id = h.project_id AND c.sha = h.sha)"""
BLOB_LINES = r"""split_blobs AS (
  SELECT oid, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls
  FROM (SELECT oid, regexp_split_to_array(content, '\r\n?|\n') AS ls FROM blobs WHERE content IS NOT NULL)),
blob_lines AS (SELECT oid, l AS line, ls[l] AS txt FROM split_blobs, LATERAL (SELECT unnest(generate_series(1, len(ls))) AS l) t)"""
# A line of nothing but white space as Python's str.strip sees it.
BLANK = r"'^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$'"
COMMENT_LINES = rf"""comment_lines AS (
  SELECT DISTINCT oid, line FROM (
    SELECT c.oid, l.line FROM comments c JOIN blob_lines l ON l.oid = c.oid AND l.line = c.begin_line
    WHERE c.begin_line = c.end_line
      AND regexp_matches(replace(l.txt, substring(l.txt, c.begin_col, c.end_col - c.begin_col + 1), ''), {BLANK})
    UNION ALL
    SELECT c.oid, l.line FROM comments c JOIN blob_lines l ON l.oid = c.oid AND l.line = c.begin_line
    WHERE c.begin_line < c.end_line AND regexp_matches(replace(l.txt, substring(l.txt, c.begin_col), ''), {BLANK})
    UNION ALL
    SELECT c.oid, l.line FROM comments c JOIN blob_lines l ON l.oid = c.oid AND l.line > c.begin_line AND l.line < c.end_line
    UNION ALL
    SELECT c.oid, l.line FROM comments c JOIN blob_lines l ON l.oid = c.oid AND l.line = c.end_line
    WHERE c.begin_line < c.end_line AND regexp_matches(replace(l.txt, substring(l.txt, 1, c.end_col), ''), {BLANK}))),
flags AS (
  SELECT b.oid, b.line, c.line IS NOT NULL AS is_comment, b.txt = '' AND c.line IS NULL AS is_blank
  FROM blob_lines b LEFT JOIN comment_lines c ON c.oid = b.oid AND c.line = b.line)"""
FLAGS = f"{BLOB_LINES},\n{COMMENT_LINES}"
LOC = """CAST(count(*) FILTER (WHERE is_blank) AS BIGINT) AS blank, CAST(count(*) FILTER (WHERE is_comment) AS BIGINT) AS "comment",
  CAST(count(*) FILTER (WHERE NOT is_blank AND NOT is_comment) AS BIGINT) AS source, count(*) AS aggregate"""
PARSABLE = rf"(regexp_matches(path, '\.({'|'.join(C_EXT)})$') OR regexp_matches(path, '\.({'|'.join(e.replace('+', '[+]') for e in CPP_EXT)})$'))"
TOKENS = r"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}'))), ' ')"

# Sources and sinks.
add("src_log_records", "SELECT sha, message FROM messages")
add("src_commits_csv", "SELECT sha, ts, author_name, author_email FROM commits")
add("src_offenders_csv",
    """SELECT ts AS "timestamp", path, nullif(aliases, '') AS aliases, reference FROM offenders""")
add("src_projects", "SELECT * FROM projects")
add("sink_project_append", "SELECT * FROM projects")
add("get_content", """SELECT o.oid, CASE WHEN length(b.content) % 3 = 0 THEN concat(chr(65533), b.content) ELSE b.content END AS content
FROM (SELECT DISTINCT oid_after AS oid FROM changes) o LEFT JOIN blobs b ON b.oid = o.oid""")

# Parsing and text.
add("parse_change", "SELECT project_id, sha, path, type, oid_before, oid_after FROM changes")
add("parse_delta", "SELECT project_id, sha, insertions, deletions, path FROM changes")
add("parse_move", r"""SELECT project_id, sha, similarity,
  replace(CASE WHEN contains(spec, '{') THEN regexp_replace(spec, '\{(.*) => (.*)\}', '\1') ELSE split_part(spec, ' => ', 1) END, '//', '/') AS source,
  replace(CASE WHEN contains(spec, '{') THEN regexp_replace(spec, '\{(.*) => (.*)\}', '\2') ELSE split_part(spec, ' => ', 2) END, '//', '/') AS destination
FROM moved""", r"""moved AS (SELECT project_id, sha, regexp_extract(line, '^ rename (.*) \(\d+%\)$', 1) AS spec,
  CAST(regexp_extract(line, '\((\d+)%\)$', 1) AS INTEGER) AS similarity FROM rename_lines WHERE line LIKE ' rename %')""")
add("module_of_path", r"""SELECT DISTINCT project_id, path,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS module FROM changes""")
add("split_lines_loc", "SELECT oid, len(ls) AS n_lines, array_to_string(ls, chr(10)) AS lines FROM split_blobs", BLOB_LINES)
add("content_size", "SELECT b.oid, z.nlines AS size FROM blobs b LEFT JOIN blob_sizes z ON z.oid = b.oid")
add("collapse_ranges", f"""SELECT {KEY}, kind, min(line) AS "begin", max(line) AS "end" FROM (
  SELECT {KEY}, kind, line, line - row_number() OVER (PARTITION BY {KEY}, kind ORDER BY line) AS island FROM (
    SELECT {KEY}, kind, unnest(generate_series("begin", "end")) AS line FROM linechanges) a) b
GROUP BY {KEY}, kind, island""")
add("tokenize", f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
add("infer_language", rf"""SELECT project_id, path, language, language IS NOT NULL AS is_parsable FROM (
  SELECT DISTINCT project_id, path, CASE WHEN regexp_matches(path, '\.({"|".join(C_EXT)})$') THEN 'C'
    WHEN regexp_matches(path, '\.({"|".join(e.replace("+", "[+]") for e in CPP_EXT)})$') THEN 'C++' END AS language FROM changes) a""")
add("is_supported", "SELECT id, language, language IN ('C', 'C++') AS is_supported FROM projects")
WHITELISTED = (
    f"(regexp_matches(lower(path), '(^|/)({'|'.join(n.lower() for n in WHITELIST_NAMES)})$') OR "
    rf"regexp_matches(lower(path), '\.({'|'.join(e.lower() for e in WHITELIST_EXTENSIONS)})$'))"
)
add("path_whitelist", f"SELECT DISTINCT project_id, path FROM changes WHERE {WHITELISTED}")

# Lookups.
COMMIT = "ts, author_name, author_email"
add("get_commit", f"""SELECT request_id, c.project_id, c.sha, {COMMIT},
  CASE WHEN c.sha IS NULL THEN 'CommitNotFound' END AS error
FROM requests r LEFT JOIN commits c ON c.project_id = r.project_id AND c.sha = r.sha""")
add("get_commits_all", "SELECT * FROM commits")
add("get_commits_path", f"""SELECT DISTINCT h.project_id, h.sha, h.path, c.ts, c.author_name, c.author_email, c.seq
FROM requests r JOIN changes h ON h.project_id = r.project_id AND h.path = r.path
JOIN commits c ON c.project_id = h.project_id AND c.sha = h.sha""")
add("get_commits_till_sha", """SELECT DISTINCT c.project_id, s.sha AS till_sha, c.sha, c.ts, c.author_name, c.author_email
FROM requests r JOIN commits s ON s.project_id = r.project_id AND s.sha = r.sha
JOIN commits c ON c.project_id = s.project_id AND c.seq <= s.seq""")
add("get_commits_till_sha_path", """SELECT DISTINCT c.project_id, c.path, s.sha AS till_sha, c.sha, c.ts, c.author_name, c.author_email
FROM requests r JOIN commits s ON s.project_id = r.project_id AND s.sha = r.sha
JOIN touches c ON c.project_id = s.project_id AND c.path = r.path AND c.seq <= s.seq""", TOUCHES)
# Everything a commit reaches, itself included, by walking parents.
REACHED = """RECURSIVE walk AS (
  SELECT project_id, sha AS till_sha, sha FROM commits
  UNION
  SELECT w.project_id, w.till_sha, p.parent_sha AS sha FROM walk w JOIN commit_parents p ON p.project_id = w.project_id AND p.sha = w.sha)"""


def add_recursive(name: str, sql: str, *tables: str) -> None:
    ctes = duckdb_ctes("commits", "commit_parents", *tables)
    ORACLE[name] = f"WITH RECURSIVE {ctes},\n{REACHED.removeprefix('RECURSIVE ')}\n{sql}"


add_recursive("get_commits_till_sha_merges", """SELECT DISTINCT c.project_id, w.till_sha, c.sha, c.ts, c.author_name, c.author_email
FROM requests r JOIN walk w ON w.project_id = r.project_id AND w.till_sha = r.sha
JOIN commits c ON c.project_id = w.project_id AND c.sha = w.sha""", "requests")
add_recursive("get_commits_till_sha_path_merges", """SELECT DISTINCT c.project_id, h.path, w.till_sha, c.sha, c.ts, c.author_name, c.author_email
FROM requests r JOIN walk w ON w.project_id = r.project_id AND w.till_sha = r.sha
JOIN changes h ON h.project_id = w.project_id AND h.sha = w.sha AND h.path = r.path
JOIN commits c ON c.project_id = w.project_id AND c.sha = w.sha""", "requests", "changes")
add_recursive("pastchanges_merges", """SELECT x.project_id, x.sha, x.path, greatest(count(y.sha) - 1, 0) AS pastchanges
FROM changes x JOIN walk w ON w.project_id = x.project_id AND w.till_sha = x.sha
LEFT JOIN changes y ON y.project_id = w.project_id AND y.sha = w.sha AND y.path = x.path GROUP BY ALL""", "changes")
add_recursive("pastauthors_merges", """SELECT x.project_id, x.sha, x.path, count(DISTINCT CASE
    WHEN c.author_name <> o.author_name OR c.author_email <> o.author_email THEN concat(c.author_name, '|', c.author_email) END) AS pastauthors
FROM changes x JOIN commits o ON o.project_id = x.project_id AND o.sha = x.sha
JOIN walk w ON w.project_id = x.project_id AND w.till_sha = x.sha
JOIN changes y ON y.project_id = w.project_id AND y.sha = w.sha AND y.path = x.path
JOIN commits c ON c.project_id = y.project_id AND c.sha = y.sha GROUP BY ALL""", "changes")
add_recursive("ownership_merges", """SELECT r.request_id, r.project_id, r.sha, r.name, r.email,
  round(count(*) FILTER (WHERE c.author_name = r.name AND c.author_email = r.email) / count(*), 6) AS ownership
FROM requests r JOIN walk w ON w.project_id = r.project_id AND w.till_sha = r.sha
JOIN commits c ON c.project_id = w.project_id AND c.sha = w.sha GROUP BY ALL""", "requests")
REQUESTED = f"requests x LEFT JOIN changes y ON {SAME_KEY}"
add("get_change", f"SELECT request_id, x.project_id, x.sha, x.path, type, oid_before, oid_after FROM {REQUESTED}")
add("get_changes", """SELECT h.project_id, h.sha, h.path, h.type, h.oid_before, h.oid_after FROM changes h
WHERE EXISTS (SELECT 1 FROM requests r WHERE r.project_id = h.project_id AND r.sha = h.sha)""")
add("get_delta", f"SELECT request_id, x.project_id, x.sha, x.path, insertions, deletions FROM {REQUESTED}")
add("get_message", """SELECT request_id, r.project_id, r.sha, message
FROM requests r LEFT JOIN messages m ON m.project_id = r.project_id AND m.sha = r.sha""")
add("get_patch", f"SELECT request_id, x.project_id, x.sha, x.path, patch FROM requests x LEFT JOIN patches y ON {SAME_KEY}")
add("get_linechanges", f"""SELECT {KEY}, kind, CAST(min(line) AS BIGINT) AS "begin", CAST(max(line) AS BIGINT) AS "end" FROM (
  SELECT *, line - row_number() OVER (PARTITION BY {KEY}, kind ORDER BY line) AS island FROM changed WHERE kind IN ('+', '-')) c
GROUP BY {KEY}, kind, island""", rf"""patch_lines AS (
  SELECT {KEY}, pos, ls[pos] AS txt, CASE WHEN ls[pos] LIKE '@@ -%' OR ls[pos] LIKE '@@@ -%' THEN pos END AS head
  FROM (SELECT {KEY}, string_split(patch, chr(10)) AS ls FROM patches), LATERAL (SELECT unnest(generate_series(1, len(ls))) AS pos) t),
in_hunk AS (SELECT {KEY}, pos, txt, max(head) OVER (PARTITION BY {KEY} ORDER BY pos) AS hunk FROM patch_lines),
heads AS (SELECT {KEY}, pos AS hunk, CASE WHEN txt LIKE '@@@%' THEN 2 ELSE 1 END AS parents,
  CAST(regexp_extract(txt, '^@@@? -(\d+)', 1) AS BIGINT) AS old,
  CAST(regexp_extract(txt, '[+](\d+)', 1) AS BIGINT) AS new FROM patch_lines WHERE head IS NOT NULL),
kinds AS (SELECT x.project_id, x.sha, x.path, x.hunk, x.pos, y.old, y.new,
    CASE WHEN contains(left(txt, parents), '-') AND left(txt, 1) <> '-' THEN 'none' ELSE left(txt, 1) END AS kind
  FROM in_hunk x JOIN heads y ON {SAME_KEY} AND x.hunk = y.hunk WHERE x.pos > x.hunk),
changed AS (SELECT project_id, sha, path, kind,
    CASE WHEN kind = '+' THEN new + sum(CASE WHEN kind <> '-' THEN 1 ELSE 0 END) OVER w
      ELSE old + sum(CASE WHEN kind <> '+' THEN 1 ELSE 0 END) OVER w END - 1 AS line
  FROM kinds WHERE kind <> 'none'
  WINDOW w AS (PARTITION BY project_id, sha, path, hunk ORDER BY pos))""")
BY_LAST = f"""by_last AS (SELECT {KEY}, last_sha, min(line) AS "begin", max(line) AS "end" FROM (
  SELECT *, line - row_number() OVER (PARTITION BY {KEY}, last_sha ORDER BY line) AS island FROM blame) b
GROUP BY {KEY}, last_sha, island)"""
add("get_lastmodifiers", """SELECT b.*, c.ts AS last_ts, c.author_name AS last_author_name, c.author_email AS last_author_email
FROM by_last b JOIN commits c ON c.project_id = b.project_id AND c.sha = b.last_sha""", BY_LAST)
add("get_moves", f"""SELECT c.project_id, c.sha, c.ts, c.author_name, c.author_email,
  m.source, m.destination, m.similarity
FROM ({ORACLE["parse_move"]}) m JOIN commits c ON c.project_id = m.project_id AND c.sha = m.sha
WHERE m.similarity >= {MIN_SIMILARITY}""")
add("head_version", "SELECT project_id, substring(max_by(sha, seq), 1, 7) AS version FROM commits GROUP BY project_id")
add("project_get", f"SELECT * FROM projects WHERE owner = '{SOME_OWNER}'")

# Distinct sets.
add("get_developers", "SELECT DISTINCT project_id, author_name, author_email FROM commits")
add("get_files_linear", """SELECT project_id, path, is_active, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS module
FROM (SELECT project_id, path, type <> 2 AS is_active, row_number() OVER (PARTITION BY project_id, path ORDER BY seq DESC) AS n FROM touches) t
WHERE n = 1""", TOUCHES)
add("get_modules", r"""SELECT DISTINCT project_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS module
FROM changes""")
SIDES = f"""sides AS (
  SELECT {KEY}, signature, bool_or(b) AS in_before, bool_or(a) AS in_after FROM (
    SELECT h.project_id, h.sha, h.path, f.signature, true AS b, false AS a FROM changes h JOIN functions f ON f.oid = h.oid_before
    UNION ALL
    SELECT h.project_id, h.sha, h.path, f.signature, false AS b, true AS a FROM changes h JOIN functions f ON f.oid = h.oid_after) u
  GROUP BY {KEY}, signature)"""
add("signature_full_outer", "SELECT * FROM sides", SIDES)
add("sig_difference", f"SELECT {KEY}, signature FROM sides WHERE in_after AND NOT in_before", SIDES)
add("sig_intersection", f"SELECT {KEY}, signature FROM sides WHERE in_after AND in_before", SIDES)

# Joins.
METRIC_ROWS = ", ".join(f"({i}, '{name}', '{size}', {str(on).lower()})" for i, name, size, on in SEED)
METRIC = f"metric AS (SELECT * FROM (VALUES {METRIC_ROWS}) AS m(id, name, granularity, enabled))"
add("metrics_seed", "SELECT p.id AS project_id, m.id AS metric_id, m.enabled FROM projects p CROSS JOIN metric m", METRIC)
add("metrics_get", """SELECT p.id AS project_id, m.id, m.name, m.granularity, m.name AS service, m.enabled
FROM projects p CROSS JOIN metric m WHERE m.enabled AND m.granularity = 'change'""", METRIC)
add("commit_changes", """SELECT c.project_id, c.sha, c.ts, c.author_name, c.author_email,
  h.path, h.type, h.insertions, h.deletions, h.oid_before, h.oid_after
FROM commits c JOIN changes h ON h.project_id = c.project_id AND h.sha = c.sha""")
OFFENDS = """EXISTS (SELECT 1 FROM offenders o WHERE o.project_id = x.project_id AND o.ts <= x.ts
  AND (o.path = x.path OR list_contains(string_split(o.aliases, ','), x.path)))"""
add("offender_join", f"""SELECT request_id, x.project_id, x.sha, x.path, {OFFENDS} AS offender
FROM (SELECT r.request_id, r.project_id, r.sha, r.path, c.ts
  FROM requests r JOIN commits c ON c.project_id = r.project_id AND c.sha = r.sha) x""")
add("function_line_overlap", f"""SELECT x.project_id, x.sha, x.path, f.ord, f.signature, f.begin_line, f.end_line
FROM changes x JOIN functions f ON f.oid = x.oid_after
WHERE EXISTS (SELECT 1 FROM linechanges y WHERE {SAME_KEY} AND y."begin" <= f.end_line AND y."end" >= f.begin_line)""")
add("line_in_function", """SELECT f.oid, f.ord, g.line, g.is_comment, g.is_blank
FROM functions f JOIN flags g ON g.oid = f.oid AND g.line BETWEEN f.begin_line AND f.end_line""", FLAGS)
add("comment_on_line", "SELECT oid, line FROM comment_lines", FLAGS)
add("memo_commit_lookup", """SELECT b.*, c.ts, c.author_name, c.author_email
FROM blame b JOIN commits c ON c.project_id = b.project_id AND c.sha = b.last_sha""")

# Metrics.
add("churn", f"SELECT {KEY}, insertions, deletions, insertions + deletions AS aggregate FROM changes")
RELATIVE = "CASE WHEN insertions IS NULL OR type = 2 THEN NULL WHEN type = 1 THEN {1} ELSE round(({0}) / nullif(nlines, 0), 6) END"
add("relativechurn", f"""SELECT {KEY}, {RELATIVE.format("insertions", "CAST(1 AS DOUBLE)")} AS insertions,
  {RELATIVE.format("deletions", "CAST(0 AS DOUBLE)")} AS deletions,
  {RELATIVE.format("insertions + deletions", "CAST(1 AS DOUBLE)")} AS aggregate
FROM changes h LEFT JOIN blob_sizes z ON z.oid = h.oid_after""")
add("hunk", f"SELECT {KEY}, (length(patch) - length(replace(patch, concat(chr(10), '@@'), ''))) // 3 AS hunks FROM patches")
PAST = "(SELECT project_id, path, sha, seq, row_number() OVER (PARTITION BY project_id, path ORDER BY seq) - 1 AS n FROM touches) t"
add("pastchanges", f"SELECT {KEY}, n AS pastchanges FROM {PAST}", TOUCHES)
ASKED = """asked AS (SELECT r.request_id, r.project_id, r.sha, r.path, c.seq, c.author_name, c.author_email
  FROM requests r JOIN commits c ON c.project_id = r.project_id AND c.sha = r.sha)"""
add("history_asof", f"""SELECT a.request_id, a.project_id, a.sha, a.path, greatest(count(t.sha) - 1, 0) AS pastchanges
FROM asked a LEFT JOIN touches t ON t.project_id = a.project_id AND t.path = a.path AND t.seq <= a.seq GROUP BY ALL""",
    f"{TOUCHES},\n{ASKED}")
OTHERS = "count(DISTINCT CASE WHEN t.author_email <> a.author_email OR t.author_name <> a.author_name THEN concat(t.author_name, '|', t.author_email) END)"
add("pastauthors", f"""SELECT a.project_id, a.sha, a.path, {OTHERS} AS pastauthors
FROM touches a JOIN touches t ON t.project_id = a.project_id AND t.path = a.path AND t.seq <= a.seq GROUP BY ALL""", TOUCHES)
add("author_set_minus_self", f"""SELECT a.request_id, a.project_id, a.sha, a.path, {OTHERS} AS pastauthors
FROM asked a LEFT JOIN touches t ON t.project_id = a.project_id AND t.path = a.path AND t.seq <= a.seq GROUP BY ALL""",
    f"{TOUCHES},\n{ASKED}")
add("ownership", """SELECT r.request_id, r.project_id, r.sha, r.name, r.email,
  round(count(*) FILTER (WHERE c.author_name = r.name AND c.author_email = r.email) / count(*), 6) AS ownership
FROM requests r JOIN commits s ON s.project_id = r.project_id AND s.sha = r.sha
JOIN commits c ON c.project_id = s.project_id AND c.seq <= s.seq GROUP BY ALL""")
add("ownership_of_authors", """SELECT project_id, sha, author_name, author_email,
  round(row_number() OVER (PARTITION BY project_id, author_name, author_email ORDER BY seq) / seq, 6) AS ownership FROM commits""")


def interactive(size_of_range):
    return f"""SELECT h.project_id, h.sha, h.path, coalesce(round(coalesce(n.taken, 0) / d.total, 6), 0) AS interactivechurn
FROM changes h
LEFT JOIN (SELECT {KEY}, sum({size_of_range}) AS total FROM linechanges WHERE kind = '-' GROUP BY {KEY}) d
  ON d.project_id = h.project_id AND d.sha = h.sha AND d.path = h.path
LEFT JOIN (SELECT b.project_id, b.sha, b.path, sum({size_of_range}) AS taken FROM by_last b
    JOIN commits c ON c.project_id = b.project_id AND c.sha = b.sha
    JOIN commits l ON l.project_id = b.project_id AND l.sha = b.last_sha
    WHERE c.author_name <> l.author_name OR c.author_email <> l.author_email GROUP BY ALL) n
  ON n.project_id = h.project_id AND n.sha = h.sha AND n.path = h.path"""


add("interactivechurn", interactive("1"), BY_LAST)
add("interactivechurn_lines", interactive('"end" - "begin" + 1'), BY_LAST)
add("functionchurn", f"""SELECT project_id, sha, path, supported,
  CASE WHEN parsed THEN ins END AS insertions, CASE WHEN parsed THEN del END AS deletions,
  CASE WHEN parsed THEN mods END AS modifications, CASE WHEN parsed THEN ins + del + mods END AS aggregate
FROM (SELECT k.*, coalesce(s.parsed, false) AS parsed, s.ins, s.del, coalesce(m.mods, 0) AS mods
  FROM known k
  LEFT JOIN (SELECT {KEY}, true AS parsed, count(*) FILTER (WHERE in_after AND NOT in_before) AS ins,
      count(*) FILTER (WHERE in_before AND NOT in_after) AS del FROM usable GROUP BY {KEY}) s
    ON s.project_id = k.project_id AND s.sha = k.sha AND s.path = k.path
  LEFT JOIN (SELECT x.project_id, x.sha, x.path, count(*) AS mods
      FROM changes x JOIN functions f ON f.oid = x.oid_after
      JOIN usable y ON {SAME_KEY} AND y.signature = f.signature AND y.in_before AND y.in_after
      WHERE x.type = 3 AND EXISTS (SELECT 1 FROM linechanges l WHERE l.project_id = x.project_id AND l.sha = x.sha
        AND l.path = x.path AND l."begin" <= f.end_line AND l."end" >= f.begin_line) GROUP BY ALL) m
    ON m.project_id = k.project_id AND m.sha = k.sha AND m.path = k.path) z""",
    f"""{SIDES},
known AS (SELECT h.project_id, h.sha, h.path, p.language IN ('C', 'C++') AS supported FROM changes h JOIN projects p ON p.id = h.project_id),
usable AS (SELECT x.* FROM sides x JOIN known y ON {SAME_KEY} WHERE y.supported AND {PARSABLE.replace("path", "x.path")})""")
FILE_LOC = f"SELECT b.oid, {LOC.replace('count(*) AS aggregate', 'count(f.oid) AS aggregate')} FROM split_blobs b LEFT JOIN flags f ON f.oid = b.oid GROUP BY b.oid"
add("loc_file", f"""SELECT h.project_id, h.sha, h.path, z.blank, z."comment", z.source, z.aggregate
FROM changes h LEFT JOIN file_loc z ON z.oid = h.oid_after AND {PARSABLE}""", f"{FLAGS},\nfile_loc AS ({FILE_LOC})")
FUNCTION_LOC = f"""function_loc AS (SELECT oid, signature, blank, "comment", source, aggregate FROM (
  SELECT *, row_number() OVER (PARTITION BY oid, signature ORDER BY ord DESC) AS n FROM (
    SELECT f.oid, f.signature, f.ord, {LOC}
    FROM functions f JOIN flags g ON g.oid = f.oid AND g.line BETWEEN f.begin_line AND f.end_line
    GROUP BY f.oid, f.signature, f.ord) a) b WHERE n = 1)"""
add("loc_function", f"""SELECT h.project_id, h.sha, h.path, z.signature, z.blank, z."comment", z.source, z.aggregate
FROM changes h JOIN function_loc z ON z.oid = h.oid_after WHERE {PARSABLE}""", f"{FLAGS},\n{FUNCTION_LOC}")
add("last_wins", "SELECT * FROM function_loc", f"{FLAGS},\n{FUNCTION_LOC}")
add("offender", f"SELECT x.project_id, x.sha, x.path, {OFFENDS} AS offender FROM touches x", TOUCHES)
KEYWORD_ROWS = ", ".join(f"('{language}', '{word}')" for language, words in text.KEYWORDS.items() for word in words)
add("keyword", r"""SELECT w.project_id, w.sha, w.path, w.word, count(*) AS n
FROM (SELECT p.project_id, p.sha, p.path, lower(j.language) AS language,
    unnest(regexp_extract_all(lower(p.patch), '[\p{L}\p{N}_]{2,}')) AS word
  FROM patches p JOIN projects j ON j.id = p.project_id) w
JOIN dictionary d ON d.language = w.language AND d.word = w.word GROUP BY ALL""",
    f"dictionary AS (SELECT * FROM (VALUES {KEYWORD_ROWS}) AS d(language, word))")
add("messagetokens", f"SELECT project_id, sha, {TOKENS.format('message')} AS tokens FROM messages")
add("patchtokens", f"SELECT {KEY}, {TOKENS.format('patch')} AS tokens FROM patches")
BODIES = f"""{BLOB_LINES},
bodies AS (SELECT f.oid, f.ord, f.signature, array_to_string(b.ls[f.begin_line:f.end_line], chr(10)) AS body
  FROM functions f JOIN split_blobs b ON b.oid = f.oid)"""
NOT_CODE = r"""(?s)"[^"\\\n]*(?:\\.[^"\\\n]*)*"|''(?:[^''\\\n]|\\.)''|//[^\n]*|/\*.*?\*/"""
LAST = "QUALIFY row_number() OVER (PARTITION BY oid, signature ORDER BY ord DESC) = 1"
add("complexity", f"""SELECT h.project_id, h.sha, h.path, z.signature, z.n FROM changes h JOIN (
  SELECT oid, signature, 1 + len(regexp_extract_all(regexp_replace(body, '{NOT_CODE}', ' ', 'g'), '{text.DECISION}')) AS n
  FROM bodies {LAST}) z ON z.oid = h.oid_after""", BODIES)
add("nesting", f"""SELECT h.project_id, h.sha, h.path, z.signature, z.n FROM changes h JOIN (
  SELECT b.oid, b.signature, CAST(greatest(coalesce(d.deepest, 0) - 1, 0) AS BIGINT) AS n
  FROM (SELECT * FROM bodies {LAST}) b
  LEFT JOIN (SELECT oid, ord, max(depth) AS deepest FROM (
      SELECT oid, ord, sum(CASE WHEN bs[i] = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY oid, ord ORDER BY i) AS depth
      FROM (SELECT oid, ord, regexp_extract_all(body, '[{{}}]') AS bs FROM bodies), LATERAL (SELECT unnest(generate_series(1, len(bs))) AS i) t) w
    GROUP BY oid, ord) d ON d.oid = b.oid AND d.ord = b.ord) z ON z.oid = h.oid_after""", BODIES)
add("flow", """SELECT project_id, uid, type, name, path, CAST(CountInput AS BIGINT) AS ninput,
  CAST(CountOutput AS BIGINT) AS noutput, CAST(CountPath AS BIGINT) AS npath FROM entity_metrics
WHERE CountInput IS NOT NULL OR CountOutput IS NOT NULL OR CountPath IS NOT NULL""")

# Windows and order.
add("history_order", "SELECT * FROM commits")
add("cumulative_history", f"""SELECT x.project_id, x.sha, x.path,
  CAST(sum(coalesce(y.insertions, 0)) OVER (PARTITION BY x.project_id, x.path ORDER BY x.seq) AS BIGINT) AS so_far
FROM touches x JOIN changes y ON {SAME_KEY}""", TOUCHES)
add("sorted_ranges", f"""SELECT {KEY}, string_agg(concat("begin", '-', "end"), ',' ORDER BY "begin", "end") AS ranges
FROM linechanges GROUP BY {KEY}""")
add("first_only", """SELECT project_id, sha, path, type, oid_before, oid_after FROM changes
QUALIFY row_number() OVER (PARTITION BY project_id, sha ORDER BY path) = 1""")

# Graphs.  A developer's class is the set of paths the developer touched.
def developers(pair: bool) -> str:
    also = f"UNION ALL SELECT * REPLACE (concat(author_name, '-pair') AS author_name) FROM touches WHERE author_name = '{PAIRED}'"
    return f"""{TOUCHES},
everyone AS (SELECT * FROM touches {also if pair else ''}),
touched AS (SELECT project_id, path, concat(author_name, chr(9), author_email) AS author, count(*) AS weight FROM everyone GROUP BY ALL),
path_sets AS (SELECT project_id, author, string_agg(path, ' ' ORDER BY path) AS paths FROM touched GROUP BY ALL),
sized AS (SELECT project_id, author, min(author) OVER w AS name, count(*) OVER w AS size FROM path_sets
  WINDOW w AS (PARTITION BY project_id, paths)),
members AS (SELECT DISTINCT t.project_id, t.path, s.name, s.size FROM touched t
  JOIN sized s ON s.project_id = t.project_id AND s.author = t.author),
edges AS (SELECT x.project_id, replace(x.name, chr(9), '|') AS u, replace(y.name, chr(9), '|') AS v, x.size AS size_u, y.size AS size_v, x.path
  FROM members x JOIN members y ON x.project_id = y.project_id AND x.path = y.path
    AND (x.name < y.name OR x.name = y.name AND x.size > 1)),
pairs AS (SELECT x.project_id, x.path, x.author AS a, y.author AS b FROM touched x JOIN touched y
  ON x.project_id = y.project_id AND x.path = y.path AND x.author < y.author),
named_pairs AS (SELECT p.project_id, p.path, p.a, p.b, least(m.name, n.name) AS u, greatest(m.name, n.name) AS v FROM pairs p
  JOIN sized m ON m.project_id = p.project_id AND m.author = p.a JOIN sized n ON n.project_id = p.project_id AND n.author = p.b)"""


add("collab_edges", "SELECT * FROM edges", developers(False))
add("developer_classes", """SELECT project_id, replace(name, chr(9), '|') AS class, replace(author, chr(9), '|') AS member FROM sized""", developers(True))
add("dev_pair_self_join", """SELECT project_id, replace(u, chr(9), '|') AS u, replace(v, chr(9), '|') AS v,
  count(DISTINCT path) AS n_files, count(DISTINCT concat(a, '|', b)) AS n_pairs FROM named_pairs GROUP BY ALL""", developers(True))
add("dev_pairs_per_file", "SELECT project_id, path, count(*) AS n_pairs FROM pairs GROUP BY ALL", developers(True))
add("contrib_edges", """SELECT project_id, path, author_name, author_email, count(*) AS weight FROM touches GROUP BY ALL""", TOUCHES)
add("contrib_prune", f"""SELECT project_id, path, author_name, author_email, count(*) AS weight FROM touches
WHERE {WHITELISTED} GROUP BY ALL""", TOUCHES)


def betweenness(longest: int) -> str:
    """CTEs from ``e`` (g, u, v, w): ``links`` with path counts and dependencies.

    Distances are whole numbers up to ``longest``; one CTE settles each of them.
    """
    parts = ["at0 AS MATERIALIZED (SELECT DISTINCT g, u AS s, u AS v, 0 AS d, CAST(1 AS DOUBLE) AS sig FROM e)",
             "upto0 AS (SELECT * FROM at0)"]
    for d in range(1, longest + 1):
        parts.append(f"""at{d} AS MATERIALIZED (SELECT n.g, n.s, e.v, {d} AS d, sum(n.sig) AS sig
  FROM upto{d - 1} n JOIN e ON e.g = n.g AND e.u = n.v AND n.d + e.w = {d}
  WHERE NOT EXISTS (SELECT 1 FROM upto{d - 1} o WHERE o.g = n.g AND o.s = n.s AND o.v = e.v) GROUP BY ALL)""")
        parts.append(f"upto{d} AS MATERIALIZED (SELECT * FROM upto{d - 1} UNION ALL SELECT * FROM at{d})")
    parts.append(f"back{longest} AS MATERIALIZED (SELECT *, CAST(0 AS DOUBLE) AS dep FROM at{longest})")
    for d in range(longest - 1, -1, -1):
        parts.append(f"""back{d} AS MATERIALIZED (SELECT * FROM back{d + 1} UNION ALL
  SELECT n.g, n.s, n.v, n.d, n.sig, coalesce(sum(n.sig / m.sig * (1 + m.dep)), 0) AS dep
  FROM at{d} n LEFT JOIN (e JOIN back{d + 1} m ON m.g = e.g AND m.v = e.v)
    ON e.g = n.g AND e.u = n.v AND m.s = n.s AND m.d = n.d + e.w GROUP BY ALL)""")
    return ",\n".join(parts)


def complete(longest: int) -> str:
    """Fails the query if some shortest path is longer than was looked for."""
    return f"""(SELECT count(*) FROM upto{longest} n JOIN e ON e.g = n.g AND e.u = n.v
  WHERE NOT EXISTS (SELECT 1 FROM upto{longest} o WHERE o.g = n.g AND o.s = n.s AND o.v = e.v)) = 0"""


SHARING = """touched AS (SELECT DISTINCT project_id AS g, path, concat(author_name, '|', author_email) AS a FROM touches),
sharing AS MATERIALIZED (SELECT x.g, x.path, x.a AS u, y.a AS v FROM touched x JOIN touched y ON x.g = y.g AND x.path = y.path AND x.a <> y.a),
e AS MATERIALIZED (SELECT DISTINCT g, u, v, 1 AS w FROM sharing)"""
EDGE_SCORES = """one_way AS (SELECT n.g, n.v AS u, m.v AS v, sum(n.sig / m.sig * (1 + m.dep)) AS score
  FROM back0 n JOIN e ON e.g = n.g AND e.u = n.v JOIN back0 m ON m.g = e.g AND m.v = e.v AND m.s = n.s AND m.d = n.d + 1 GROUP BY ALL),
score AS (SELECT x.g, x.u, x.v, (x.score + y.score) / 2 AS score FROM one_way x JOIN one_way y ON x.g = y.g AND x.u = y.v AND x.v = y.u)"""
COLLABORATION = f"""SELECT t.g AS project_id, t.path, round(max(k.score), 6) AS collaboration
FROM (SELECT DISTINCT g, path FROM touched) t
LEFT JOIN sharing p ON p.g = t.g AND p.path = t.path
LEFT JOIN score k ON k.g = p.g AND k.u = p.u AND k.v = p.v WHERE {complete(8)} GROUP BY ALL"""
BIPARTITE = """weighted AS (SELECT project_id AS g, path, concat('a|', author_name, '|', author_email) AS a, count(*) AS w FROM touches GROUP BY ALL),
e AS MATERIALIZED (SELECT g, a AS u, concat('f|', path) AS v, w FROM weighted UNION ALL SELECT g, concat('f|', path) AS u, a AS v, w FROM weighted)"""
CONTRIBUTION = f"""SELECT t.g AS project_id, t.path, round(sum(k.dep) / 2, 6) AS contribution
FROM (SELECT DISTINCT g, path FROM weighted) t JOIN back0 k ON k.g = t.g AND k.v = concat('f|', t.path) AND k.s <> k.v
WHERE {complete(24)} GROUP BY ALL"""
add("collaboration", COLLABORATION, f"{TOUCHES},\n{SHARING},\n{betweenness(8)},\n{EDGE_SCORES}")
add("contribution", CONTRIBUTION, f"{TOUCHES},\n{BIPARTITE},\n{betweenness(24)}")
# The same over what each project's last commit reaches.
HEADS = f"""heads AS (SELECT project_id, max_by(sha, seq) AS sha FROM commits GROUP BY project_id),
below AS (SELECT project_id, sha FROM heads UNION
  SELECT p.project_id, p.parent_sha FROM below b JOIN commit_parents p ON p.project_id = b.project_id AND p.sha = b.sha),
every_touch AS ({TOUCHES.removeprefix("touches AS (").removesuffix(")")}),
touches AS (SELECT y.* FROM every_touch y JOIN below b ON b.project_id = y.project_id AND b.sha = y.sha)"""


def add_at_heads(name, measured, column, extra):
    sql = f"""SELECT r.project_id, h.sha, r.path, m.{column} FROM (SELECT DISTINCT project_id, path FROM changes) r
JOIN heads h ON h.project_id = r.project_id LEFT JOIN ({measured}) m ON m.project_id = r.project_id AND m.path = r.path"""
    add(name, sql, f"{HEADS},\n{extra}")
    ORACLE[name] = ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


add_at_heads("collaboration_at_commit", COLLABORATION, "collaboration", f"{SHARING},\n{betweenness(8)},\n{EDGE_SCORES}")
add_at_heads("contribution_at_commit", CONTRIBUTION, "contribution", f"{BIPARTITE},\n{betweenness(24)}")

add("get_files", """SELECT a.project_id, a.path, coalesce(t.is_active, false) AS is_active,
  CASE WHEN contains(a.path, '/') THEN regexp_replace(a.path, '/[^/]*$', '') ELSE '(root)' END AS module
FROM (SELECT DISTINCT project_id, path FROM changes) a
LEFT JOIN (SELECT project_id, path, type <> 2 AS is_active, row_number() OVER (PARTITION BY project_id, path ORDER BY seq DESC) AS n FROM touches) t
  ON t.project_id = a.project_id AND t.path = a.path AND t.n = 1""", HEADS)
ORACLE["get_files"] = ORACLE["get_files"].replace("WITH ", "WITH RECURSIVE ", 1)

# Metrics of requested changes only.
for _name, _how in (
    ("relativechurn", "LEFT"), ("interactivechurn", "LEFT"), ("functionchurn", "LEFT"), ("loc_file", "LEFT"), ("complexity", ""), ("nesting", "")
):
    add(f"{_name}_requested", f"""SELECT r.request_id, r.project_id, r.sha, r.path, m.* EXCLUDE (project_id, sha, path)
FROM requests r {_how} JOIN ({ORACLE[_name]}) m ON m.project_id = r.project_id AND m.sha = r.sha AND m.path = r.path""")

# Catalog and streams.
add("collect_enabled", f"""SELECT 'loc' AS metric, 'file' AS granularity, project_id, sha, path,
  CASE WHEN aggregate IS NOT NULL THEN concat('{{"blank":', blank, ',"comment":', "comment", ',"source":', source, ',"aggregate":', aggregate, '}}') END AS measure
FROM ({ORACLE["loc_file"]}) l
UNION ALL
SELECT 'offender' AS metric, 'file' AS granularity, project_id, sha, path,
  concat('{{"offender":', CASE WHEN offender THEN 'true' ELSE 'false' END, '}}') AS measure
FROM ({ORACLE["offender"]}) o""")
add("stream_collect", f"""SELECT x.request_id, 'churn' AS metric, x.project_id, x.sha, x.path, x.name, x.email,
  y.insertions, y.deletions, y.insertions + y.deletions AS aggregate FROM requests x LEFT JOIN changes y ON {SAME_KEY}""")


def fields(metric, keys, rows, numbers=(), texts=()):
    """A row for every field of a metric's measures; one row without field where all are null."""
    columns = [(c, "CAST(NULL AS VARCHAR)", f"round(CAST({e} AS DOUBLE), 6)") for c, e in numbers]
    columns += [(c, f"CAST({e} AS VARCHAR)", "CAST(NULL AS DOUBLE)") for c, e in texts]
    known = " OR ".join(f"({e}) IS NOT NULL" for _, e in (*numbers, *texts))
    each = ", ".join(f"{{'field': '{c}', 'value': {v}, 'number': {n}}}" for c, v, n in columns)
    none = "{'field': CAST(NULL AS VARCHAR), 'value': CAST(NULL AS VARCHAR), 'number': CAST(NULL AS DOUBLE)}"
    kept = ", ".join(keys)
    return f"""SELECT '{metric}' AS metric, {kept}, f.field AS field, f.value AS value, f.number AS number
FROM (SELECT {kept}, unnest(CASE WHEN {known} THEN [{each}] ELSE [{none}] END) AS f FROM ({rows}) q) u"""


def plain(*names):
    return [(n, f'"{n}"') for n in names]


def by_signature(entry):
    """(key, column) of the JSON of a map by signature."""
    return f"concat('{{', string_agg(concat(CAST(to_json(signature) AS VARCHAR), ':', {entry}), ',' ORDER BY signature), '}}')"


TOKEN_LIST = """CASE WHEN tokens IS NULL THEN NULL WHEN tokens = '' THEN '[]' ELSE concat('["', replace(tokens, ' ', '","'), '"]') END"""
LOC_ENTRY = """concat('{"blank":', blank, ',"comment":', "comment", ',"source":', source, ',"aggregate":', aggregate, '}')"""
KEYWORDS_OF = f"""SELECT p.project_id, p.sha, p.path, CASE WHEN l.language IS NULL THEN 'LanguageNotSupported' END AS error,
  CASE WHEN l.language IS NOT NULL THEN concat('{{', coalesce(k.words, ''), '}}') END AS keywords
FROM patches p JOIN projects j ON j.id = p.project_id
LEFT JOIN (SELECT DISTINCT language FROM (VALUES {KEYWORD_ROWS}) AS d(language, word)) l ON l.language = lower(j.language)
LEFT JOIN (SELECT {KEY}, string_agg(concat('"', word, '":', n), ',' ORDER BY word) AS words FROM ({ORACLE["keyword"]}) w GROUP BY ALL) k
  ON k.project_id = p.project_id AND k.sha = p.sha AND k.path = p.path"""


def of_functions(name, entry, column):
    """Maps by signature of every change."""
    return f"""SELECT h.project_id, h.sha, h.path, m.{column} FROM changes h
LEFT JOIN (SELECT {KEY}, {by_signature(entry)} AS {column} FROM ({ORACLE[name]}) f GROUP BY ALL) m
  ON m.project_id = h.project_id AND m.sha = h.sha AND m.path = h.path"""


CHURNED = ("insertions", "deletions", "aggregate")
# Metric: granularity, keys that are joined, rows, numbers and texts.
MEASURED = {
    "churn": ("change", ORACLE["churn"], plain(*CHURNED), ()),
    "functionchurn": ("change", ORACLE["functionchurn"], plain("insertions", "deletions", "modifications", "aggregate"), plain("supported")),
    "hunk": ("change", ORACLE["hunk"], plain("hunks"), ()),
    "interactivechurn": ("change", ORACLE["interactivechurn"], plain("interactivechurn"), ()),
    "keyword": ("change", KEYWORDS_OF, (), plain("keywords", "error")),
    "pastauthors": ("change", ORACLE["pastauthors"], plain("pastauthors"), ()),
    "pastchanges": ("change", ORACLE["pastchanges"], plain("pastchanges"), ()),
    "patchtokens": ("change", ORACLE["patchtokens"], (), [("tokens", TOKEN_LIST)]),
    "relativechurn": ("change", ORACLE["relativechurn"], plain(*CHURNED), ()),
    "messagetokens": ("commit", ORACLE["messagetokens"], (), [("tokens", TOKEN_LIST)]),
    "complexity": ("function", of_functions("complexity", "n", "complexity"), (), plain("complexity")),
    "nesting": ("function", of_functions("nesting", "n", "nesting"), (), plain("nesting")),
    "loc": ("function", f"""SELECT m.project_id, m.sha, m.path, CASE WHEN l.aggregate IS NOT NULL THEN coalesce(m.loc, '{{}}') END AS loc
FROM ({of_functions("loc_function", LOC_ENTRY, "loc")}) m
JOIN ({ORACLE["loc_file"]}) l ON l.project_id = m.project_id AND l.sha = m.sha AND l.path = m.path""", (), plain("loc")),
    "ownership": ("developer", ORACLE["ownership_of_authors"], plain("ownership"), ()),
}
NOBODY = "CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email"
NOWHERE = "CAST(NULL AS VARCHAR) AS path"
AS_KEYS = {
    "change": f"m.*, {NOBODY}", "function": f"m.*, {NOBODY}", "commit": f"m.*, {NOWHERE}, {NOBODY}",
    "developer": f"m.*, {NOWHERE}, m.author_name AS name, m.author_email AS email",
}
for _granularity, _columns in AS_KEYS.items():
    add(f"collect_enabled_{_granularity}", "\nUNION ALL\n".join(
        fields(metric, ("project_id", "sha", "path", "name", "email"), f"SELECT {_columns} FROM ({rows}) m", numbers, texts)
        for metric, (granularity, rows, numbers, texts) in MEASURED.items() if granularity == _granularity
    ))

OFFENDED = f"""SELECT DISTINCT x.project_id, x.sha, x.path, {OFFENDS} AS offender
FROM (SELECT r.project_id, r.sha, r.path, c.ts FROM requests r JOIN commits c ON c.project_id = r.project_id AND c.sha = r.sha) x"""
ASKED_FOR = {
    **MEASURED,
    "loc": ("file", ORACLE["loc_file"], plain("blank", "comment", "source", "aggregate"), ()),
    "offender": ("file", OFFENDED, (), plain("offender")),
}


def answers(k, metric):
    """Requests for one metric, each with its measure's fields."""
    granularity, rows, numbers, texts = ASKED_FOR[metric]
    on = "m.project_id = r.project_id AND m.sha = r.sha" + ("" if granularity == "commit" else " AND m.path = r.path")
    asked = f"""SELECT r.request_id, r.project_id, r.sha, r.path, m.* EXCLUDE ({"project_id, sha" if granularity == "commit" else KEY})
FROM requests r LEFT JOIN ({rows}) m ON {on} WHERE r.request_id % {len(STREAMED)} = {k}"""
    return fields(metric, ("request_id", "project_id", "sha", "path"), asked, numbers, texts)


add("stream_collect_mixed", "\nUNION ALL\n".join(answers(k, metric) for k, metric in enumerate(STREAMED)))
ORACLE["stream_project_created"] = ORACLE["metrics_seed"]
add("stream_repository_cloned", "SELECT 'repository_cloned' AS event, id AS project_id FROM projects")
