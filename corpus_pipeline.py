"""Documents to packed sequences: language, quality, near-duplicates, packing. Each stage works on what the last kept.

Stages keep or drop rows, not ids: rows that share an id, rows without one and repeated rows are judged each for itself. All
columns of the documents pass through, whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import common, langid, packing, quality, simhash

#: A text that no learned language claims by more than this is rejected.
MIN_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or are claimed by no language; all, if no text has a language to learn."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    plain = common.positional(docs)
    found = langid.predict(plain, model, common.place(docs, "text"), keep=plain.columns)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*plain.columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the lost text reject (null and blank texts among them); what stays has its cleaned text."""
    plain, text = common.positional(docs), common.place(docs, "text")
    # a column that may not be computed twice keeps Spark from pushing the condition, and with it all rules, below the rules
    judged = quality.judge(plain, text).withColumn("row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("row") >= 0))
    new = {text: F.col("cleaned")}
    if "n_chars" in docs.columns:
        new[common.place(docs, "n_chars")] = F.length("cleaned").cast("long")
    return judged.select(*[new.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.first_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences. A null or empty text is the end id alone."""
    return packing.digest(packing.pack(docs))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("packing", packed)]

#: No stage but the second can be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``, each written before the next; the pieces of what all of them kept."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
