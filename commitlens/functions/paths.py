"""Column functions over paths: module, language and whitelist."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions per parsable language, tried in this order.
LANGUAGES = {
    "C": ["c", "h", "i"],
    "C++": [
        "C", "c++", "cc", "cp", "cpp", "CPP", "cxx", "H", "h++", "hh", "hpp", "hxx", "ii", "tcc",
    ],
}
ROOT_MODULE = "(root)"


def module_of_path(path: Column) -> Column:
    head = F.regexp_extract(path, "(?s)^(.*/)", 1)
    directory = F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, "/+$", ""))
    return F.coalesce(F.nullif(directory, F.lit("")), F.lit(ROOT_MODULE))


def infer_language(path: Column) -> Column:
    """Language by extension, case-sensitive; null when none can be parsed."""
    result = F.lit(None).cast("string")
    for language, extensions in reversed(LANGUAGES.items()):
        pattern = r"\.(" + "|".join(re.escape(e) for e in extensions) + r")$"
        result = F.when(path.rlike(pattern), F.lit(language)).otherwise(result)
    return result


def is_parsable(path: Column) -> Column:
    return infer_language(path).isNotNull()


def is_supported(language: Column) -> Column:
    return language.isin(*LANGUAGES)


def whitelist_pattern(names=None, extensions=None):
    """Regex a whitelisted path must match, or None when everything passes.

    Entries are regular expressions themselves and case is ignored.
    """
    parts = []
    if names is not None:
        parts.append(r"(^|/)(" + "|".join(names) + ")")
    if extensions is not None:
        parts.append(r"\.(" + "|".join(extensions) + ")")
    return "(?i)(" + "|".join(parts) + ")$" if parts else None


def path_whitelist(path: Column, names=None, extensions=None) -> Column:
    pattern = whitelist_pattern(names, extensions)
    return F.lit(True) if pattern is None else path.rlike(pattern)
