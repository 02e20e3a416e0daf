"""Column functions that read lines of git output."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.schemas import CHANGE_TYPES

# The shapes of git's rename, raw and numstat lines.
RENAME = r"^ rename (.*) \((\d+)%\)$"
BRACED = r"^([^}]*)\{([^}]*) => ([^}]*)\}(.*)$"
PLAIN = r"^(.*) => (.*)$"
DELTA = r"^(\d+|-)\s+(\d+|-)\s+(.+)"


def change_type(letter: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in CHANGE_TYPES.items() for x in pair])
    return F.try_element_at(codes, letter)


def parse_change(line: Column) -> Column:
    """Raw diff line to ``struct<path, type, oid_before, oid_after>``.

    A merge line carries one mode and one object id per parent; the first
    parent's id and status letter are taken.  The path is everything after the
    first tab, so blanks inside it survive.  What a short line lacks is null.
    """
    parents = F.length(F.regexp_extract(line, "^(:+)", 1))
    words = F.split(line, r"\s+")
    path = F.when(
        F.instr(line, "\t") > 0, F.regexp_extract(line, "(?s)^[^\t]*\t(.*)$", 1)
    ).otherwise(F.array_join(F.slice(words, 2 * parents + 4, F.size(words)), " "))
    return F.struct(
        path.alias("path"),
        change_type(F.substring(F.try_element_at(words, 2 * parents + 3), 1, 1)).alias("type"),
        F.try_element_at(words, parents + 2).alias("oid_before"),
        F.try_element_at(words, 2 * parents + 2).alias("oid_after"),
    )


def parse_delta(line: Column) -> Column:
    """Numstat line to ``struct<insertions, deletions, path>``; ``-`` (binary) is null."""

    def number(group):
        return F.regexp_extract(line, DELTA, group).try_cast("bigint")

    return F.struct(
        number(1).alias("insertions"),
        number(2).alias("deletions"),
        F.regexp_extract(line, DELTA, 3).alias("path"),
    )


def parse_move(line: Column) -> Column:
    """Rename summary line to ``struct<source, destination, similarity>``, else null."""
    spec = F.regexp_extract(line, RENAME, 1)
    braced = spec.rlike(BRACED)

    def side(in_braces, plain):
        return F.replace(
            F.when(
                braced,
                F.concat(
                    F.regexp_extract(spec, BRACED, 1),
                    F.regexp_extract(spec, BRACED, in_braces),
                    F.regexp_extract(spec, BRACED, 4),
                ),
            ).otherwise(F.regexp_extract(spec, PLAIN, plain)),
            F.lit("//"),
            F.lit("/"),
        )

    return F.when(
        line.rlike(RENAME) & (braced | spec.rlike(PLAIN)),
        F.struct(
            side(2, 1).alias("source"),
            side(3, 2).alias("destination"),
            F.regexp_extract(line, RENAME, 2).try_cast("int").alias("similarity"),
        ),
    )
