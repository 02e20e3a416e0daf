"""Near duplicates by SimHash, found by ball hashing from both sides.

Two fingerprints that differ in at most ``radius`` bits have a common variant within half the radius
of each.  Every distinct fingerprint emits all these variants (65 for a radius of 2), and those that share a
variant meet.  They are all within the radius of one another, so each is linked to the least of
them: no pair is lost and no group costs its square.

Null and empty texts have fingerprint zero, linked like any other.  Repeated rows are
returned as often as given; ties in id are told apart by text.  A null id is never a component's name; a
component of null ids only has a null name.  An empty table gives an empty one.  Only ids and texts are
read, and ``keep_one`` returns all columns as they are, so other columns' names can't clash.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm import words as W
from commitlens.llm.components import components
from commitlens.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 2


def _fingerprints(part, shingle):
    out = np.zeros(len(part["text"]), dtype=np.uint64)
    digest = xxhash.xxh64_digest
    for i, text in enumerate(W._binary(part["text"]).to_pylist()):
        words = text.lower().split()
        if not words:
            continue
        text = b" ".join(words)
        ends = np.cumsum([len(x) + 1 for x in words]).tolist()
        if len(words) <= shingle:
            hashes = digest(text, SEED)
        else:
            begins = [0, *ends]
            hashes = b"".join([digest(text[a : b - 1], SEED) for a, b in zip(begins, ends[shingle - 1 :])])
        n = len(hashes) // 8
        ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n).view(">u8")[0]
    return {**part, "fp": pa.array(out.view(np.int64))}


def row_key():
    """A hash of a row's id and text, which tells rows with one id apart."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): bit b of the unsigned fingerprint is bit b of over half the shingle hashes."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    return W.map_texts(docs, ["doc_id", "row", "text"], "text", W.schema("doc_id bigint, row bigint, fp bigint"), lambda part: _fingerprints(part, shingle))


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all within an even ``radius``."""
    if radius % 2:
        raise ValueError("balls of half the radius need an even radius")
    balls = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    flips = F.array(*[F.lit(_signed(x)).cast("bigint") for x in balls])
    variants = distinct.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.select(F.col("fp").alias("u"), least.alias("v")).filter(F.col("u") != F.col("v")).distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row, fp, component_id, root) of every document: the component's name is its least
    doc_id, its root its least fingerprint."""
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = cut(components(links(distinct.select("fp"), radius)), "roots")
    classes = distinct.join(roots, distinct.fp == roots.vertex, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "row", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, but one of each component: that of the least id (null
    last), then of the least row hash; of repeated rows one."""
    found = near_duplicates(docs, shingle, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    mine, theirs = W.unused(docs, "_row"), W.unused(docs, "_kept_row")
    kept = cut(found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias(theirs)), "kept")
    keyed = docs.withColumn(mine, row_key())
    return keyed.join(kept, F.col(mine) == F.col(theirs), "left_semi").dropDuplicates([mine]).drop(mine)
