"""Nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

1. Vectors get one more component, which makes all of them equally long, so that the largest inner
   product is the smallest Euclidean distance. All are turned by one random rotation.
2. k-means on a sample of at most ``SAMPLE`` vectors gives about sqrt(n) lists; every vector is
   indexed in its nearest one. A query probes its nearest lists.
3. Within a probed list, distances are summed over column blocks of the rotated vectors. After
   each block a candidate is abandoned if its partial distance, scaled to all dimensions, is
   larger than the query's bound by more than a random rotation explains (the hypothesis test
   ``partial * D / d > bound * (1 + e / sqrt(d))**2``). The bound is the distance of the k-th
   nearest vector of the query's nearest lists, which are searched first, or the largest true
   distance among the k candidates that lead after the first block, so it never is too small.
4. Candidates that last are scored exactly, in double precision, on the original vectors.

Lists and the queries that probe them are cut into parts of at most ``PART`` rows, and each pair
of parts is one group, so a hot list or a common vector does not land in one task.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, neither do rows without id. Of rows that repeat an id the
smallest vector counts. Equal scores go to the smaller id. With fewer candidates than k all of
them are returned. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import bounded_batches, read_table, scratch, store

NEIGHBOURS = 20
EVERY = 20
#: Vectors of which the lists are fitted, by the order of their ids' hash.
SAMPLE = 20_000
MAX_LISTS = 4096
#: Share of the lists that a query probes, and the least number of them.
PROBE_SHARE, MIN_PROBES = 0.65, 16
#: Rows of a part of a list, and of the queries that probe it.
PART = 2048
COLUMN_BLOCKS = 4
EPSILON = 2.1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: one proper vector per id, all of the most frequent length."""
    v = F.col(embedding)
    if dict(vectors.dtypes)[embedding] != "array<float>":
        v = v.cast("array<double>")
    proper = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    return proper.groupBy("vec_id").agg(F.min("v").alias("v"))


@dataclass
class Index:
    """What every task needs; its size depends on MAX_LISTS and the dimension only."""

    rotation: np.ndarray
    centroids: np.ndarray
    longest: float
    probes: int
    #: Vectors per list, known once all of them are indexed.
    sizes: np.ndarray

    def rotate(self, vectors: np.ndarray, as_query: bool = False) -> np.ndarray:
        """Vectors with the added component, rotated; a query's added component is 0."""
        if as_query:
            more = np.zeros(len(vectors))
        else:
            more = np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0.0))
        return np.column_stack([vectors, more]) @ self.rotation

    def lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        far = (self.centroids**2).sum(axis=1) - 2.0 * rotated @ self.centroids.T
        n = min(n, far.shape[1])
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)

    def probed(self, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists that each query probes, how many, and how many of them to search first: as
        many as hold over ``k`` vectors, even if there are more of these than of usual probes."""
        near = self.lists(rotated, len(self.centroids))
        first = np.minimum((np.cumsum(self.sizes[near], axis=1) <= k).sum(axis=1) + 1, near.shape[1])
        counts = np.maximum(first, self.probes)
        return near[np.arange(near.shape[1])[None, :] < counts[:, None]], counts, first


def _fit(sample: np.ndarray, n: int, longest: float) -> Index:
    random = np.random.RandomState(7)
    dimension = sample.shape[1] + 1
    rotation = np.linalg.qr(random.normal(size=(dimension, dimension)))[0]
    index = Index(rotation, np.zeros((0, dimension)), longest, 0, np.zeros(0, np.int64))
    rotated = index.rotate(sample)
    lists = int(min(MAX_LISTS, max(1, round(n**0.5)), len(rotated)))
    index.centroids = rotated[random.choice(len(rotated), lists, replace=False)].copy()
    for _ in range(8):
        own = index.lists(rotated, 1)[:, 0]
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, rotated)
        counts = np.bincount(own, minlength=lists)
        index.centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    index.probes = min(lists, max(MIN_PROBES, int(np.ceil(PROBE_SHARE * lists))))
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _assign(shared, k: int | None = None):
    """Each vector with its list, or with the lists it probes for ``k`` neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                rotated = index.rotate(_matrix(part.column(1)), k is not None)
                if k is None:
                    near, counts, first = index.lists(rotated, 1).ravel(), np.ones(len(part), np.int64), None
                else:
                    near, counts, first = index.probed(rotated, k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(near, pa.int64()))]
                names = ["vec_id", "v", "lists"]
                if first is not None:
                    columns, names = [*columns, pa.array(first, pa.int32())], [*names, "first"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scan(
    queries: np.ndarray, candidates: np.ndarray, blocks: list[slice], k: int, bound: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, candidate)`` of rotated vectors that the adaptive scan does not abandon.

    ``bound`` is the squared distance beyond which a query needs no candidate.
    """
    dimension = queries.shape[1]

    def partial(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        far = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2.0 * q @ c.T
        return np.maximum(far, 0.0)

    first = partial(queries[:, blocks[0]], candidates[:, blocks[0]])
    if candidates.shape[0] > k:
        leaders = np.argpartition(first, k - 1, axis=1)[:, :k]
        led = ((queries[:, None, :] - candidates[leaders]) ** 2).sum(axis=2).max(axis=1)
        bound = np.minimum(bound, led)
    # Rounding must not abandon candidates that are as near as the bound.
    bound = bound * (1 + 1e-9) + 1e-12
    done = blocks[0].stop

    def limit(d: int) -> np.ndarray:
        return bound * (d / dimension) * ((1 + EPSILON / d**0.5) ** 2 if d < dimension else 1.0)

    q, c = np.nonzero(first <= limit(done)[:, None])
    total = first[q, c]
    for block in blocks[1:]:
        total = total + ((queries[q, block] - candidates[c, block]) ** 2).sum(axis=1)
        done = block.stop
        left = total <= limit(done)[q]
        q, c, total = q[left], c[left], total[left]
    return q, c


def _search(shared, k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        index: Index = shared.value
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not len(candidates) or not len(queries):
            return empty
        raw, asked = _matrix(candidates.column("v")), _matrix(queries.column("v"))
        ids, query_ids = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        rotated, turned = index.rotate(raw), index.rotate(asked, True)
        # A score is a distance, as all vectors are equally long.
        bound = (asked**2).sum(axis=1) + index.longest - 2.0 * queries.column("least").to_numpy()
        edges = np.linspace(0, rotated.shape[1], COLUMN_BLOCKS + 1).astype(int)
        blocks = [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        found = [[], [], []]
        for at in range(0, len(asked), 256):
            # One candidate more than k, as a query may meet itself.
            q, c = scan(turned[at : at + 256], rotated, blocks, k + 1, bound[at : at + 256])
            q = q + at
            other = query_ids[q] != ids[c]
            q, c = q[other], c[other]
            score = (asked[q] * raw[c]).sum(axis=1)
            order = np.lexsort((ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            begin = np.searchsorted(q, q, "left")
            best = np.arange(len(q)) - begin < k
            for part, x in zip(found, (query_ids[q[best]], ids[c[best]], score[best])):
                part.append(x)
        return pa.table({
            "query_id": pa.array(np.concatenate(found[0]), pa.int64()),
            "vec_id": pa.array(np.concatenate(found[1]), pa.int64()),
            "score": pa.array(np.concatenate(found[2]), pa.float64()),
        })

    return run


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row whose id ``every`` divides."""
    spark = bounded_batches(vectors.sparkSession)
    folder = scratch(spark, "nearest")
    proper = store(usable(vectors), f"{folder}/proper")
    size = proper.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], result)
    proper = proper.filter(F.size("v") == size["size"])
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = proper.agg(F.max(square)).first()[0]
    sample = proper.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    index = _fit(_matrix(sample.column(0)), size["n"], longest)
    shared = spark.sparkContext.broadcast(index)

    schema = f"vec_id long, v {dict(proper.dtypes)['v']}, lists array<long>"
    indexed = store(
        proper.mapInArrow(_assign(shared), schema).select("vec_id", "v", F.col("lists")[0].alias("list")),
        f"{folder}/indexed",
    )
    held = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    index.sizes = np.array([held.get(i, 0) for i in range(len(index.centroids))])
    sized = spark.sparkContext.broadcast(index)
    asked = proper.filter(F.col("vec_id") % every == 0).mapInArrow(_assign(sized, k), f"{schema}, first int")
    probes = store(asked.select("vec_id", "v", "first", F.posexplode("lists").alias("at", "list")), f"{folder}/probes")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    unbounded = probes.filter(F.col("at") < F.col("first")).withColumn("least", F.lit(float("-inf")))
    first = store(_search_lists(indexed, unbounded, shared, k, f"{folder}/parts-1"), f"{folder}/first")
    # With k neighbours known, others must score as much as the last of them.
    known = best(first).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count("*") == k, F.min("score")).alias("least")
    )
    bounded = probes.filter(F.col("at") >= F.col("first")).join(known, "vec_id", "left").withColumn(
        "least", F.coalesce("least", F.lit(float("-inf")))
    )
    further = _search_lists(indexed, bounded, shared, k, f"{folder}/parts-2")
    return best(first.unionByName(further)).select("query_id", "rank", "vec_id", "score")


def _search_lists(indexed: DataFrame, probes: DataFrame, shared, k: int, folder: str) -> DataFrame:
    """Each probe's best candidates of its list, by groups of a part of the list and of its probes."""
    def parts(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))

    # At most MAX_LISTS rows.
    counts = F.broadcast(store(parts(indexed, "n_parts").join(parts(probes, "n_chunks"), "list"), folder))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    left = indexed.join(counts, "list").select(
        "list", (own % F.col("n_parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), "vec_id", "v",
    )
    right = probes.join(counts, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"),
        (own % F.col("n_chunks")).cast("int").alias("chunk"), "vec_id", "v", "least",
    )
    group = ["list", "part", "chunk"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        _search(shared, k), "query_id long, vec_id long, score double"
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
