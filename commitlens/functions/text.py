"""Column functions over file contents, patches and messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.functions.tokens import sorted_tokens

# Runs of two or more word characters, Unicode-aware.
WORD = r"[\p{L}\p{N}_]"
TOKEN = f"{WORD}{WORD}+"
NEWLINE = r"\r\n?|\n"

# Keyword dictionary per lower-cased language.  Text is lower-cased
# before the comparison and the dictionary is not, so False, None and True never match.
_C_WORDS = (
    "bool char const extern false float for if int long namespace new operator private "
    "protected sizeof static struct switch template throw typedef typename union unsigned "
    "virtual volatile"
).split()
KEYWORDS = {
    "c": _C_WORDS,
    "c++": _C_WORDS,
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do "
        "double else enum extends final finally float for goto if implements import instanceof "
        "int interface long native new package private protected public return short static "
        "strictfp super switch synchronized this throw throws transient try void volatile while"
    ).split(),
    "python": (
        "and as assert async await break class continue def del elif else except False finally "
        "for from global if import in is lambda None nonlocal not or pass raise return True try "
        "while with yield"
    ).split(),
}

# Our definition of a decision point, and of the text that cannot hold one.
DECISION = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"
NOT_CODE = (
    r'(?s)"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'(?:[^'\\\n]|\\.)'" r"|//[^\n]*+|/\*.*?\*/"
)


def tokens(text: Column) -> Column:
    """All tokens in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Distinct tokens in code point order; null for null, empty for empty."""
    return sorted_tokens(F.lower(text), WORD)


def keyword_counts(text: Column, language: Column) -> Column:
    """``[(word, n)]`` of the language's keywords with n > 0, in dictionary order.

    Null when the text is null or the language has no dictionary.
    """

    def counted(words):
        def per_word(hits):
            return F.transform(
                F.array_intersect(F.array(*[F.lit(w) for w in words]), hits),
                lambda w: F.struct(
                    w.alias("word"),
                    F.size(F.filter(hits, lambda t: t == w)).cast("bigint").alias("n"),
                ),
            )

        # The one-element array names the hits, so that the text is cut up once.
        hits = F.array(F.filter(tokens(text), lambda t: t.isin(words)))
        return F.element_at(F.transform(hits, per_word), 1)

    result = F.lit(None)
    for name, words in KEYWORDS.items():
        result = F.when(F.lower(language) == name, counted(words)).otherwise(result)
    return F.when(text.isNotNull(), result)


def keyword_supported(language: Column) -> Column:
    return F.lower(language).isin(*KEYWORDS)


def count_hunks(patch: Column) -> Column:
    """Hunk headers that follow a newline; ``@@@`` of combined diffs counts too."""
    header = F.lit("\n@@")
    found = F.octet_length(patch) - F.octet_length(F.replace(patch, header, F.lit("")))
    return F.floor(found / F.octet_length(header)).cast("bigint")


def content_size(content: Column) -> Column:
    """Number of newline-separated lines, a final empty one not counted."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    tail = F.when((content == "") | content.endswith("\n"), 0).otherwise(1)
    return (breaks + tail).cast("bigint")


def split_lines(content: Column) -> Column:
    """Lines cut at LF, CR or CRLF; one trailing empty line is dropped."""
    lines = F.split(content, NEWLINE, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(
        lines
    )


def decode_blob(data: Column, is_binary: Column) -> Column:
    """Text of a blob: null when binary or missing, bad bytes become U+FFFD."""
    return F.when(~is_binary, F.make_valid_utf8(data.cast("string")))


def decision_count(body: Column) -> Column:
    code = F.regexp_replace(body, NOT_CODE, " ")
    return (1 + F.regexp_count(code, F.lit(DECISION))).cast("bigint")


def brace_depth(body: Column) -> Column:
    """Deepest running count of open braces, the function's own block not counted."""
    walked = F.aggregate(
        F.regexp_extract_all(body, F.lit("[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest")),
        lambda acc, brace: F.struct(
            (acc["depth"] + F.when(brace == "{", 1).otherwise(-1)).alias("depth"),
            F.greatest(
                acc["deepest"], acc["depth"] + F.when(brace == "{", 1).otherwise(-1)
            ).alias("deepest"),
        ),
    )
    return F.greatest(walked["deepest"] - 1, F.lit(0)).cast("bigint")
