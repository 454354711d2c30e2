"""Corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, token ids.

Each stage takes the documents its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import bpe, decontam, langid, linededup, neardup
from hazardlens.llm.common import read_table, scratch, store, text_key

#: Least posterior probability of the predicted language; with less, no language is more likely
#: than all others together.
LEAST_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as one structure ``others``, so that none of their
    names can meet one that a stage uses."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(None).alias("none")]).alias("others"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from packed rows, in their order."""
    return rows.select(*[
        changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`")).alias(c) for c in docs.columns
    ])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; those without letters or a clear language go.

    A null or empty text has no letter. Rows that repeat are judged alike; without rows, or without
    any labelled row, nothing is recognised and the result is empty.
    """
    judged = langid.predict(_packed(docs), langid.train(
        docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~langid.held_out())
    ))
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(kept, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that stand in an earlier document; documents left without text go.

    A null or empty text stays as it is. Rows that repeat id and text are one document and come out
    alike; no rows give no rows.
    """
    cleaned = linededup.dedup_lines(_packed(docs))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("others.n_chars"))
    emptied = (F.col("removed_lines") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "")
    return _unpacked(cleaned.filter(~emptied), docs, **changed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id, null only
    if all are, then with the smallest text key; of rows that repeat its id and text, one. Texts
    without words form no groups, so null and empty ones stay; no rows give no rows."""
    found = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept")
    counted = found.groupBy("root", F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).agg(
        F.count("*").alias("times")
    )
    # The rows that op4 keeps of a group all have its smallest id.
    first = counted.filter("root is not null").groupBy("root").agg(F.min(F.struct("__key", "__id", "times")).alias("first"))
    kept = store(
        first.select("first.__id", "first.__key", "first.times").unionByName(
            counted.filter("root is null").drop("root")
        ),
        f"{scratch(spark, 'kept')}/kept",
    )
    keyed = _packed(docs).withColumn("__text_key", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    once = keyed.join(kept.filter("times = 1"), same, "left_semi")
    repeated = keyed.join(kept.filter("times > 1"), same, "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return _unpacked(once.unionByName(repeated), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    A null or empty text holds none; rows that repeat go or stay together; no rows give no rows,
    and an empty benchmark leaves every row.
    """
    found = decontam.contaminated_windows(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    left = _packed(docs).withColumn("__text_key", text_key()).join(
        leaks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_anti"
    )
    return _unpacked(left, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with digests of the ids and the decoded text.

    A null text is empty and has no ids; rows that repeat each give a row; no rows give no rows.
    """
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: The stages need hashing, tokenizers and models that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the rows of the last one."""
    folder = scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"{folder}/{number}-{name}")
    return docs
