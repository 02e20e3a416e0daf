"""Column layouts of the input tables and the codes used in them."""

# Change type codes, keyed by the letter git prints.
CHANGE_TYPES = {"A": 1, "D": 2, "M": 3, "R": 4, "C": 5, "T": 8}
ADDED, DELETED, MODIFIED, RENAMED, COPIED, TYPECHANGE = 1, 2, 3, 4, 5, 8

# Line kinds of a diff and comment kinds.
INSERTED, REMOVED = "+", "-"
COMMENT_LINE, COMMENT_BLOCK = 1, 2

PROJECTS = "id BIGINT, owner STRING, repository STRING, language STRING, repository_url STRING"
COMMITS_CSV = "sha STRING, ts BIGINT, author_name STRING, author_email STRING"
OFFENDERS_CSV = "timestamp BIGINT, path STRING, aliases STRING, reference STRING"
METRICS = "id INT, name STRING, granularity STRING, service STRING, enabled BOOLEAN"
PROJECT_METRICS = "project_id BIGINT, metric_id INT, enabled BOOLEAN"
REQUESTS = (
    "request_id BIGINT, metric STRING, project_id BIGINT, sha STRING, path STRING, "
    "name STRING, email STRING"
)

# Fixed value: the object id git prints for a side that does not exist.
NO_OID = "0" * 40

CHANGE_KEY = ["project_id", "sha", "path"]
AUTHOR = ["author_name", "author_email"]
