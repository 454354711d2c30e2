"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task and sums the counts in Spark. The
matrix of log-probabilities (languages x buckets, both bounded by parameters) is
broadcast, and documents are scored in numpy, whole, a bounded slice at a time.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0;
without any training document every text is ``und``; a null ``doc_id`` is not held out
and not learned from; repeated rows are scored alike, equal scores go to the first
language in alphabetical order. Other columns are ignored by the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.common import bounded_batches, read_table, release_memory, scratch, store

UNKNOWN = "und"
SIZES = (1, 2, 3)
BUCKETS = 1 << 15
#: Bound of the broadcast matrix; more languages than this are an error.
MAX_LANGUAGES = 500
SMOOTHING = 0.1
#: Characters scored at once; a longer text is scored in pieces that are summed.
PIECE = 100_000

_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept for measuring accuracy: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def pieces(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a lower-cased text between two spaces, piece by piece."""
    text = f" {text.lower()} "
    longest = max(SIZES)
    for at in range(0, max(len(text), 1), PIECE):
        # The next piece starts with n-grams that begin in it, so pieces overlap by their ends.
        codes = np.frombuffer(text[at : at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        found = []
        for size in SIZES:
            begin = min(PIECE, len(codes) - size + 1)
            if begin <= 0:
                continue
            value = np.full(begin, size * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for j in range(size):
                value = (value ^ (codes[j : j + begin] * _STEP[j])) * np.uint32(0x85EBCA6B)
                value ^= value >> np.uint32(15)
            found.append(value & np.uint32(BUCKETS - 1))
        yield np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            text = text.as_py()
            if text and _LETTER.search(text):
                sums = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in pieces(text):
                    sums += np.bincount(piece, minlength=BUCKETS)
    for lang, sums in totals.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(sums[used])],
            ["lang", "bucket", "n"],
        )
    release_memory()


@dataclass
class Model:
    languages: list[str]
    #: log P(n-gram | language), buckets x languages, and log P(language).
    log_likelihood: np.ndarray
    log_prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows of ``docs`` with a language; pass only the rows to learn from."""
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull())
    counts = store(
        labelled.mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")),
        scratch(docs.sparkSession, "language-counts"),
    )
    documents = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in documents.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect()
    cells = {r["lang"]: r["cells"] for r in table}
    languages = sorted(cells)
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    for column, name in enumerate(languages):
        for bucket, n in cells[name]:
            matrix[bucket, column] += n
    priors = np.array([sizes[name] for name in languages], float)
    return Model(languages, np.log(matrix / matrix.sum(axis=0)), np.log(priors / max(priors.sum(), 1)))


def score(text: str | None, model: Model) -> tuple[str, float]:
    if not text or not model.languages or not _LETTER.search(text):
        return UNKNOWN, 0.0
    total = model.log_prior.copy()
    for piece in pieces(text):
        # A piece is a sparse row of counts; its product with the matrix is the log-likelihood.
        if len(piece) < BUCKETS:
            total += model.log_likelihood[piece].sum(axis=0)
        else:
            total += np.bincount(piece, minlength=BUCKETS) @ model.log_likelihood
    best = int(total.argmax())
    return model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of the prediction.

    Columns of ``docs`` with these two names are replaced.
    """
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t.as_py(), shared.value) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )
        release_memory()

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out, predict every document."""
    model = train(docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs, model)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
