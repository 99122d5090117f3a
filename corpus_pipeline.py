"""A training-data pipeline over ``documents``: language ID, near-duplicate removal by
n-gram Jaccard join, removal of repeated passages, mixing of sources to target weights,
and packing. Each stage reads the table which the stage before has written.

Defined results: the stages' own docstrings say what they do with nulls, empty texts,
ties and repeated rows; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm import langid, mixing, ngram_join, packing, substring
from visitlens.llm.common import crc_mod, row_keys, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learnt; lang becomes the predicted one. Texts
    without a letter, or of no language in particular, go."""
    learnt = langid.learn(docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))).select("doc_id", "text", "lang"))
    found = langid.identify(docs, learnt, carry=tuple(docs.columns))
    kept = found.where("not rejected")
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest id, null last, and among rows of the
    same id the first by row key. Groups are of rows, whose keys are given here, so null
    and repeated ids lose or keep no row. A row without words is a group of its own."""
    keyed, row = row_keys(docs), F.col("row")
    ident = F.struct(row["doc_id"].isNull().alias("no_id"), row["doc_id"].alias("doc_id"), F.col("row_key").alias("key"))
    groups = ngram_join.near_duplicates(keyed.select(ident.alias("doc_id"), row["text"].alias("text")))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.key").alias("kept_key"))
    return keyed.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing
    is left go. A text that loses nothing stays as it was."""
    kept = substring.remove_repeats(docs, carry=tuple(docs.columns))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    kept = kept.where("n_words > n_removed or n_removed = 0")
    old = {c: F.col("row")[c] for c in docs.columns}
    return kept.select(*[(F.when(changed, new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target: documents as often as epochs take them, the last one
    in part."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs


ORACLE_SQL = None  # compression and tokenisation are not SQL; tests compare with a brute-force version

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
