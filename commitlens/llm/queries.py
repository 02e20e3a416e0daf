"""The numbered queries: thin views of the operators over whole tables."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from commitlens.llm import (
    bpe, chat, decontaminate, gam, license_scan, mixing, pages, quality_rules, runs, simhash, substring, toxicity, whitening,
)
from commitlens.session import cut


def _read(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def held_out(every, rest):
    """Rows whose crc32 of the id as text leaves ``rest``: never learned from."""
    return lambda column: F.crc32(F.col(column).cast("string")) % every == rest


def op1_quality_rules(spark, folder):
    ledger = quality_rules.apply_policy(quality_rules.ledger(_read(spark, folder, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )


def op2_mixing(spark, folder):
    mixed = mixing.mix(_read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark, folder):
    return license_scan.scan(_read(spark, folder, "documents"), license_scan.NOTICES)


def op4_decontamination(spark, folder):
    found = decontaminate.leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("reworded").alias("reworded")
    )


def op5_chat(spark, folder):
    known = cut(chat.transcripts(_read(spark, folder, "conversations")), "transcripts")
    parsed = chat.parse(known, chat.fit(known), ["piece", "roles_known"], "piece")
    return parsed.select(
        F.col("id").alias("conv_id"), "piece", F.size("roles").cast("bigint").alias("n_turns"), F.array_join("roles", ",").alias("roles"),
        (F.col("roles") == F.col("roles_known")).alias("as_labelled"), F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def op6_toxicity(spark, folder):
    docs, labels, out = _read(spark, folder, "documents"), _read(spark, folder, "labels"), held_out(3, 1)
    tagged = toxicity.tag(docs, toxicity.toxicity_model(docs, labels, out))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return tagged.select("doc_id", F.coalesce(out("doc_id"), F.lit(False)).alias("held_out"), "score", predicted, "spans")


def op7_substring(spark, folder):
    return substring.remove_repeats(_read(spark, folder, "documents")).drop("kept")


def op8_simhash(spark, folder):
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html(spark, folder):
    web = _read(spark, folder, "pages")
    return pages.main_text(web, pages.page_weights(web))


def op10_quality_classifier(spark, folder):
    docs, labels, out = _read(spark, folder, "documents"), _read(spark, folder, "labels"), held_out(5, 0)
    scored = gam.score(docs, gam.quality_model(docs, labels, out))
    predicted = (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(out("doc_id"), F.lit(False)).alias("held_out"), "score", predicted)


def op11_whitening(spark, folder):
    table = _read(spark, folder, "embeddings")
    return whitening.whiten(table, whitening.fit(table))


def op12_bpe(spark, folder):
    from public_tokenizers import path

    file = path("word_bpe_49k.json")
    tokens = bpe.decode(bpe.encode(_read(spark, folder, "documents"), file), file)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def looped(doc_id, n):
    """The fixed rewriting of one text in ten: from some word on, its first few words over and over."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest or not n or doc_id is None:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


def op13_periodic_runs(spark, folder):
    found = runs.runs(_read(spark, folder, "documents"), rewrite=looped)
    ranked = F.transform("runs", lambda r: F.struct((r.length / r.period).alias("exponent"), -r.start, -r.period, r.alias("run")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", F.array_max(ranked)["run"]).select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.floor(1000 * best.length / best.period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_substring": op7_substring,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_bpe": op12_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
