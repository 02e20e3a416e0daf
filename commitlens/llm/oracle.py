"""DuckDB SQL for the queries that SQL can express.

The others are tested against brute-force versions: their hashes, models, samples or
parsers have no like in SQL.
"""

from commitlens.llm import quality_rules

ORACLE: dict[str, str] = {}

WORDS = r"""words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))"""


def windows(k: int) -> str:
    """Every window of k words of a document as one string, by its first word."""
    span = f"OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    return f"""spans AS (SELECT doc_id, i, list(word) {span} AS ws FROM words),
windows AS (SELECT doc_id, i, array_to_string(ws, ' ') AS w FROM spans WHERE len(ws) = {k})"""


def within(windows_found: str, k: int) -> str:
    """(doc_id, i) of the words that the found windows cover."""
    return f"SELECT DISTINCT doc_id, i + o AS i FROM {windows_found}, (SELECT unnest(generate_series(0, {k - 1})) AS o) AS s"


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)

ORACLE["op1_quality_rules"] = rf"""WITH {WORDS},
{windows(8)},
often AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
found AS (SELECT x.doc_id, x.i FROM windows x JOIN often o ON o.doc_id = x.doc_id AND o.w = x.w),
inside AS (SELECT doc_id, count(*) AS n FROM ({within("found", 8)}) c GROUP BY ALL),
counted AS (SELECT doc_id, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS chars FROM words GROUP BY ALL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
line_counts AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
measured AS (SELECT d.doc_id, coalesce(c.n, 0) AS n_words, coalesce(c.chars, 0) AS word_chars,
    coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
    coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    coalesce(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), 0) AS n_upper,
    coalesce(length(text) - length(replace(text, '!', '')), 0) AS n_marks
  FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN line_counts l ON l.doc_id = d.doc_id
  LEFT JOIN inside r ON r.doc_id = d.doc_id),
failed AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {quality_rules.mask("base")} <> 0 AS base_failed, fail_bits & {quality_rules.mask("v1")} = 0 AS kept, fail_bits FROM failed"""

ORACLE["op7_substring"] = f"""WITH {WORDS},
{windows(13)},
firsts AS (SELECT w, min(doc_id) AS doc_id FROM windows GROUP BY ALL),
found AS (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON f.w = x.w WHERE f.doc_id < x.doc_id),
gone AS ({within("found", 13)}),
marked AS (SELECT x.doc_id, x.i, x.word, g.i IS NOT NULL AS removed FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS rest FROM marked GROUP BY ALL)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
