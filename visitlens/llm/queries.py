"""The registered queries of the corpus operators: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, hpylm, interplay, langid, licences, mixing, ngram_join, packing, quality, repair, substring, vector_dups
from .common import crc_mod, stored, table


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    learnt = langid.learn(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.identify(docs, learnt).select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", "quality")
    model = quality.learn(docs.join(labels, "doc_id"))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = divergence.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    rows = hpylm.score(table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("learns")), "learns")
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_branch_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = repair.repair(repair.damage(rows))
    found = fixed.conversations().join(fixed.digests().withColumnRenamed("conv_id", "digest_conv"), F.col("conv_id").eqNullSafe(F.col("digest_conv")), "left").drop("digest_conv")
    found = found.withColumnRenamed("conv_id", "found_conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    formatted = stored(chat.format_conversations(chat.fold_messages(chat.conversation_log(rows))), "formatted")
    back = chat.read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op13_trie_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_zstd_language": op2_zstd_language,
    "op3_subspace_vectors": op3_subspace_vectors,
    "op4_boosted_quality": op4_boosted_quality,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_divergence_rules": op6_divergence_rules,
    "op7_count_min_substrings": op7_count_min_substrings,
    "op8_licence_sentences": op8_licence_sentences,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_source_mix": op10_source_mix,
    "op11_branch_repair": op11_branch_repair,
    "op12_event_chat": op12_event_chat,
    "op13_trie_interaction": op13_trie_interaction,
}

ORACLES = {
    "op3_subspace_vectors": vector_dups.oracle_sql(),
    "op5_ngram_jaccard": ngram_join.oracle_sql(),
    "op6_divergence_rules": divergence.oracle_sql(),
    "op8_licence_sentences": licences.oracle_sql(),
    "op7_count_min_substrings": substring.oracle_sql(),
    "op10_source_mix": mixing.oracle_sql(),
    "op11_branch_repair": repair.oracle_sql(),
    "op12_event_chat": chat.oracle_sql(),
    "op13_trie_interaction": interplay.oracle_sql(),
}
