"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

1. A document's lines are hashed after trimming; blank lines take no part and stay.
2. A gram is a line with the following ones until they hold at least ``noise`` (25) words. Of
   the grams that start within as many words, the smallest hash is selected as a fingerprint. So
   every run of lines that two places share and that holds twice ``noise`` words has a
   fingerprint in common.
3. Fingerprints are joined by hash: documents that hold one which occurs in two places go on, all
   others have nothing to delete.
4. Matches are extended both ways, line by line: a line belongs to a repeated run if the gram that
   begins at it, or the one that ends at it, also stands at an earlier place. Each step may go on
   with another earlier place, so a run that was first seen in pieces, here a part and there the
   whole, is followed to its end. That is one join of grams with their first places: a hot gram
   costs one row per occurrence, never a pair of occurrences.
5. Overlapping and adjoining grams are united to runs, and these are deleted.

What is deleted stands in a run of at least ``noise`` words that an earlier place holds as well, so
the first copy of a line always stays. Every shared run of twice ``noise`` words is found, whatever
other documents hold of it; a shorter one is found where its documents share any fingerprint.

Order is ``doc_id`` (null first), then content; within a document it is position. Defined
results: a null text stays null, an empty one empty; rows that repeat ``doc_id`` and text are
one document and all come out alike; an empty table stays empty. Documents may repeat their
own earlier lines. Very long texts, and long stretches of one line, cost in proportion to their
lines. Only ``doc_id`` and ``text`` are used; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import read_table, scratch, store, text_key

#: Words below which a shared run is left alone; runs of twice as many are always found.
NOISE = 25


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"[\x20\x09-\x0D]+")).cast("long")


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_key, pos, n, line, words, before``: the non-blank lines of distinct documents.

    ``pos`` counts all lines from 0, ``n`` the non-blank ones; ``before`` is the number of words
    ahead of the line.
    """
    lines = (
        docs.filter("text is not null")
        .select("doc_id", text_key().alias("doc_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
        .withColumn("raw", F.btrim("raw", F.lit(" \t\n\x0b\f\r")))
        .filter("raw <> ''")
        .select("doc_id", "doc_key", "pos", F.xxhash64("raw").alias("line"),
                _words(F.col("raw")).alias("words"))
        # Repeated rows are one document.
        .groupBy("doc_id", "doc_key", "pos").agg(F.first("line").alias("line"), F.first("words").alias("words"))
    )
    own = Window.partitionBy("doc_id", "doc_key").orderBy("pos")
    return lines.select(
        "*", F.row_number().over(own).cast("long").alias("n"),
        (F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"),
    )


def _document(order: str) -> Window:
    return Window.partitionBy("doc_id", "doc_key").orderBy(order)


def fingerprints(lines: DataFrame, noise: int = NOISE) -> DataFrame:
    """``print, doc_id, doc_key, n``: the selected grams."""
    near = _document("before").rangeBetween(0, noise - 1)
    grams = lines.select(
        "doc_id", "doc_key", "n", "before",
        F.xxhash64(F.collect_list("line").over(near)).alias("gram"),
        F.sum("words").over(near).alias("held"),
    ).filter(F.col("held") >= noise)
    least = F.min(F.struct("gram", "n")).over(near)
    return (
        grams.select("doc_id", "doc_key", least.alias("least"))
        .select("doc_id", "doc_key", F.col("least.gram").alias("print"), "least.n").distinct()
    )


def grams_both_ways(lines: DataFrame, noise: int = NOISE) -> DataFrame:
    """``gram, doc_id, doc_key, n, low, high``: the gram that begins at each line and the one that
    ends at it, with the places (``n``, ``pos``) of its first and last line."""
    ahead, back = _document("before").rangeBetween(0, noise - 1), _document("upto").rangeBetween(-(noise - 1), 0)
    place = F.struct("n", "pos")

    def gram(kind: int, frame: Window) -> Column:
        return F.struct(
            F.xxhash64(F.lit(kind), F.collect_list("line").over(frame)).alias("gram"), F.sum("words").over(frame).alias("held"),
            F.min(place).over(frame).alias("low"), F.max(place).over(frame).alias("high"),
        )

    both = lines.withColumn("upto", F.col("before") + F.col("words")).select(
        "doc_id", "doc_key", "n", gram(0, ahead).alias("ahead"), gram(1, back).alias("back")
    )
    return both.select("doc_id", "doc_key", "n", F.inline(F.array("ahead", "back"))).filter(F.col("held") >= noise).drop("held")


def repeated_runs(lines: DataFrame, folder: str, noise: int = NOISE) -> DataFrame:
    """``doc_id, doc_key, low, high``: maximal runs of positions in ``lines`` to delete."""
    prints = store(fingerprints(lines, noise), f"{folder}/fingerprints")
    shared = prints.groupBy("print").agg(F.count("*").alias("times")).filter("times > 1").select("print")
    matched = store(
        prints.join(shared, "print", "left_semi").select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key")).distinct(),
        f"{folder}/matched",
    )
    concerned = lines.join(
        matched.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")), "left_semi"
    )
    grams = store(grams_both_ways(concerned, noise), f"{folder}/grams")
    place = F.struct("doc_id", "doc_key", "n")
    first = grams.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = grams.join(first, "gram").filter(F.col("first") < place).select("doc_id", "doc_key", "low", "high").distinct()
    order = Window.partitionBy("doc_id", "doc_key").orderBy("low", "high")
    reached = F.max("high.n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("low.n") > reached + 1), 1).otherwise(0)
    return (
        later.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "doc_key", "run").agg(F.min("low.pos").alias("low"), F.max("high.pos").alias("high")).drop("run")
    )


def dedup_lines(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs, and ``removed_lines``, ``removed_runs``.

    Blank lines inside a deleted run go with it. Columns of these two names are replaced.
    """
    folder = scratch(docs.sparkSession, "line-dedup")
    lines = store(line_table(docs.select("doc_id", "text")), f"{folder}/lines")
    runs = store(
        repeated_runs(lines, folder, noise).groupBy("doc_id", "doc_key")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs")),
        f"{folder}/runs",
    )
    # Columns that only pass through travel in one structure, so no name of theirs can clash.
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "removed_lines", "removed_runs")]
    given = docs.select(F.struct("doc_id", "text", *[F.col(f"`{c}`") for c in others]).alias("own"))
    # How many documents lose lines has no bound, so both sides are dealt by document at any size.
    joined = given.join(
        runs.hint("merge"),
        F.col("own.doc_id").eqNullSafe(F.col("doc_id")) & (text_key("own.text") == F.col("doc_key")), "left",
    ).select("own", "runs", F.when(F.col("runs").isNotNull(), F.split("own.text", "\n", -1)).alias("lines"))
    removed = F.flatten(F.transform("runs", lambda r: F.sequence(r["low"], r["high"])))
    cut = joined.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), removed))
    is_cut = F.col("runs").isNotNull()
    text = F.when(is_cut, F.array_join(F.transform("kept", lambda at: F.get("lines", at)), "\n")).otherwise(F.col("own.text"))
    kept = [c for c in docs.columns if c.lower() not in ("removed_lines", "removed_runs")]
    return cut.select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"own.`{c}`").alias(c) for c in kept],
        F.when(is_cut, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("removed_lines"),
        F.transform(F.coalesce("runs", F.array().cast("array<struct<low:int,high:int>>")),
                    lambda r: F.concat_ws("-", r["low"], r["high"])).alias("removed_runs"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "text", "removed_lines", F.array_join("removed_runs", ",").alias("removed_runs")
    )
