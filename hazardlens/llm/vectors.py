"""Vectors of whole numbers: proper rows, bounded samples, centres and exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a sample are at most twice these; the sample goes to the driver.
SAMPLE = 8192
#: Sums of whole numbers below this are exact in double precision.
EXACT = 2.0**53
LONGEST = np.iinfo(np.int64).max


def whole_rows(table: DataFrame, scale: int, *kept: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` and ``kept``: ``v`` holds ``floor(scale * x)`` of every component as a long.

    Rows without id, without vector, or with a null or non-finite component are left out. A
    component beyond the range of a long counts as its limit.
    """
    v = F.col(embedding).cast("array<double>")
    proper = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), *kept).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return proper.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))


def usual_length(rows: DataFrame) -> int | None:
    """The most frequent length of ``v``, the smaller of two; None without rows."""
    found = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return None if found is None else found["size"]


def fewest_copies(rows: DataFrame, same: list[str], limit: int) -> DataFrame:
    """Of rows equal in ``same`` those with the ``limit`` smallest ids.

    Equal vectors score alike, so no query ever takes more of them. The rank filter works below
    the shuffle too: however many copies a vector has, a task sends ``limit`` of them.
    """
    order = Window.partitionBy(*same).orderBy("vec_id")
    return rows.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= limit).drop("copy")


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """About ``SAMPLE`` of ``n`` vectors, chosen by the hash of id and vector."""
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(n, 1)))
    return matrix(rows.filter(own < SAMPLE).select("v").limit(2 * SAMPLE).toArrow().column(0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows of doubles; whole numbers beyond 2**53 are rounded."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(axis=1))


def centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """``count`` centres by a few rounds of k-means, from a fixed seed."""
    random = np.random.RandomState(7)
    count = max(1, min(count, len(vectors)))
    found = vectors[random.choice(len(vectors), count, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(vectors, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        held = np.bincount(own, minlength=count)
        found[held > 0] = sums[held > 0] / held[held > 0, None]
    return found


def nearest_centre(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmin((found**2).sum(axis=1) - 2.0 * vectors @ found.T, axis=1)


class Products:
    """Exact inner products of whole vectors with one block of others."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        self.column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.vectors = matrix(self.column)
        self.norms = norms(self.vectors)

    def whole(self, rows: np.ndarray) -> list[list[int]]:
        return [self.column[int(r)].as_py() for r in rows]

    def with_(self, other: Products, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Scores of the rows ``mine`` with the rows ``theirs`` as longs.

        No partial sum exceeds the product of the two norms. Above 2**53 the sums are taken in
        Python's whole numbers; what a long cannot hold counts as its limit.
        """
        if not len(mine) or not len(theirs):
            return np.zeros((len(mine), len(theirs)), np.int64)
        if self.norms[mine].max() * other.norms[theirs].max() < EXACT / 2:
            return np.rint(self.vectors[mine] @ other.vectors[theirs].T).astype(np.int64)
        left, right = self.whole(mine), other.whole(theirs)
        return np.array([
            [max(-LONGEST - 1, min(LONGEST, sum(x * y for x, y in zip(a, b)))) for b in right] for a in left
        ], np.int64)


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    # Unlike the negative, the complement of a long always is one.
    return places[np.lexsort((ids[places], ~scores[places]))][:k]
