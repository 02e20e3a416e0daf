"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger holds the measurements and one
bit per failed rule; a policy is a versioned set of rules, so that applying another
policy, or asking what a policy would do without one of its rules, reads integers and
no text.

Null and empty texts measure zero everywhere; a null id stays null; repeated rows give
repeated ledger rows and ties in id stay apart; other columns are not carried, so their names can't clash.  An
empty table gives an empty ledger.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W

WINDOW = 8
LEDGER = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_upper bigint, n_marks bigint"
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds over the measurements; its bit never changes."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    # A few repeated lines are common boilerplate in short documents.
    Rule(3, "repeated_lines", "n_dup_lines > 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "upper_case", "5 * n_upper > 2 * word_chars"),
    Rule(7, "exclamations", "5 * n_marks > n_words"),
)
#: Policies by version: the names of the rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    "v2": ("few_words", "repeated_windows", "symbols", "upper_case", "exclamations"),
}


def _measure(part):
    w = W.Words(part["text"])
    data, n, docs = w.data, len(w.starts), len(w.counts)
    hashes = w.hashes()
    letters = (data & 0xC0) != 0x80
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    symbol = np.zeros(256, dtype=bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    upper = (data >= 65) & (data <= 90)

    at, keys = w.windows(hashes, WINDOW)
    own = W.mix(w.doc.astype(np.uint64) + np.uint64(1))
    twice, _ = W.repeated(keys ^ own[at])
    inside = W.covered(n, at[twice], WINDOW)

    # Lines: cut at \n and at the ends of documents; those with a word are compared.
    begin = np.unique(np.concatenate([w.begin[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    stops = np.append(begin, len(data))[1:]
    stops = stops - (data[stops - 1] == 10)
    has_word = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begin)
    begin, stops = begin[has_word], stops[has_word]
    line_doc = np.searchsorted(w.begin, begin, side="right") - 1
    with np.errstate(over="ignore"):
        c, inverse = W.prefix_hashes(W.mix(np.arange(1, 257, dtype=np.uint64))[data], W.BYTE_BASE)
        line_keys = W.mix((c[stops] - c[begin]) * inverse[begin] + (stops - begin).astype(np.uint64))
    _, later = W.repeated(line_keys ^ W.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    return {
        "doc_id": part["doc_id"],
        "n_words": w.counts,
        "word_chars": w.per_doc(letters & ~blank[data]),
        "n_symbols": w.per_doc(symbol[data]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=docs),
        "n_repeat_words": np.bincount(w.doc[inside], minlength=docs),
        "n_lines": np.bincount(line_doc, minlength=docs),
        "n_upper": w.per_doc(upper),
        "n_marks": w.per_doc(data == 33),
    }


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measurements and ``fail_bits`` of every document, each rule evaluated once."""
    measured = W.map_texts(
        docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ["doc_id", "text"], "text", W.schema(LEDGER), _measure
    )
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def mask(policy: str, rules=RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in POLICIES[policy])


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no bit of the policy is set."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str = "v1", rules=RULES) -> DataFrame:
    """What each rule of a policy does: documents and words that fail it, that fail only
    it, and that the policy would keep without it.

    Failure patterns are counted first, so every rule after that reads at most one row
    per pattern that occurs.
    """
    patterns = ledger.groupBy("fail_bits").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"), F.bit_or("fail_bits").alias("seen")
    )
    chosen = mask(policy)
    named = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules if chosen >> r.bit & 1]
    )
    failed = F.col("fail_bits").bitwiseAND(F.lit(chosen))
    hit = failed.bitwiseAND(F.col("r.bit")) != 0
    alone = failed == F.col("r.bit")
    kept = (failed == 0) | alone
    return (
        patterns.withColumn("r", F.explode(named))
        .groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("docs")).otherwise(0)).alias("failed_docs"),
            F.sum(F.when(alone, F.col("docs")).otherwise(0)).alias("failed_only_here"),
            F.sum(F.when(kept, F.col("docs")).otherwise(0)).alias("kept_without"),
            F.sum(F.when(hit, F.col("words")).otherwise(0)).alias("failed_words"),
        )
    )
