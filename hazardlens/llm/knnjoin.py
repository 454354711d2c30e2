"""Exact top-k search by largest inner product: a Voronoi join of queries and data.

1. Pivots are fitted on a bounded sample; every vector belongs to the cell of its nearest pivot.
2. Summaries: each cell of the data gives its radius and its ``k + 1`` vectors nearest to the
   pivot. A query's inner products with all these, a bounded table, give a score that its k-th
   result certainly reaches. A cell of queries has a radius and the least of these scores.
3. Neighbouring cells of queries are packed into groups of at most ``QUERIES``; a larger cell is
   dealt to several groups. A data vector ``s`` goes to the groups that hold a cell (centre ``c``,
   radius ``r``, least score ``t``) with ``c.s + r |s| >= t``; for other groups no query can want
   it. Whole data cells are ruled out first by the same bound on their pivot and radius.
4. Each group is cut into slices of about ``SLICE`` data vectors. A task meets one slice with the
   group's queries and returns each query's ``k + 1`` best of the slice that reach its certain
   score; the best of all slices are the result, less the query's own row.

Scores are exact: products are summed in doubles where no sum can exceed 2**53, else as Python's
whole numbers. Bounds carry a slack above their rounding error, so they only ever keep too much.
Where vectors do not cluster, the bounds rule out nothing and every block is scored.

Defined results: rows without id, without vector, or with a null or non-finite component take no
part, neither do vectors of another length than most. Zero vectors do. Rows that share an id are
rows of their own: as queries each gets its results, as candidates each counts. Equal scores go to
the smaller id. With fewer candidates than ``k`` all are returned. A component or score beyond the
range of a long counts as its limit. Only the two columns are read. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm import vectors as V
from hazardlens.llm.common import bounded_batches, read_table, scratch, store

SCALE, NEIGHBOURS, EVERY = 1024, 10, 100
MAX_PIVOTS = 256
#: Most queries of a group, and about how many data vectors meet them in one task.
QUERIES, SLICE = 4096, 16384
#: Rows of an Arrow batch handled at once, and queries scored at once.
CHUNK, BLOCK = 4096, 256
SLACK = 1e-9

RESULT = "query_id long, rank int, vec_id long, score long"


@dataclass
class Join:
    """What every task needs: pivots and summaries, at most ``MAX_PIVOTS`` of each."""

    pivots: np.ndarray
    leaders: pa.ListArray
    k: int
    #: Per cell of the queries its radius, its least certain score and its groups.
    radius: np.ndarray | None = None
    least: np.ndarray | None = None
    groups: list[list[int]] | None = None
    #: Cells of the data that a cell of queries may want.
    wanted: np.ndarray | None = None

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = V.nearest_centre(vectors, self.pivots)
        return own, V.norms(vectors - self.pivots[own])

    def destinations(self, vectors: np.ndarray, cells: np.ndarray) -> list[list[int]]:
        """The groups that each data vector has to go to."""
        size = V.norms(vectors)
        highest = vectors @ self.pivots.T
        highest += np.outer(size, self.radius)
        highest += SLACK * np.outer(size, V.norms(self.pivots) + self.radius) + 1.0
        wants = ~(highest < self.least) & self.wanted[cells]
        return [sorted({g for cell in np.flatnonzero(row) for g in self.groups[cell]}) for row in wants]


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            yield batch.slice(at, CHUNK)


def _place(shared):
    """Each data vector with its cell and its distance from the pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join: Join = shared.value
        for part in _chunks(batches):
            cells, far = join.cells(V.matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cells, pa.int32()), pa.array(far, pa.float64())], ["vec_id", "v", "cell", "far"]
            )

    return run


def _certain(shared):
    """Each query with its cell, its distance from the pivot, and a score that its k-th result reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join: Join = shared.value
        known = V.Products(join.leaders)
        every = np.arange(len(known.vectors))
        for part in _chunks(batches):
            asked = V.Products(part.column(1))
            cells, far = join.cells(asked.vectors)
            # A query may be among the leaders itself, hence one more.
            if len(every) > join.k:
                scores = asked.with_(known, np.arange(len(part)), every)
                least = np.partition(scores, len(every) - join.k - 1, axis=1)[:, len(every) - join.k - 1]
            else:
                least = np.full(len(part), -V.LONGEST - 1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cells, pa.int32()), pa.array(far, pa.float64()), pa.array(least, pa.int64())],
                [*part.schema.names, "cell", "far", "least"],
            )

    return run


def _send(shared):
    """Each data vector with the groups it goes to; those that no group wants are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join: Join = shared.value
        for part in _chunks(batches):
            groups = join.destinations(V.matrix(part.column(1)), part.column(2).to_numpy())
            sent = pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(groups, pa.int32())], ["vec_id", "v", "groups"])
            yield sent.filter(pa.array([bool(g) for g in groups], pa.bool_()))

    return run


def _solve(k: int):
    """A slice's best candidates of each query of a group."""
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if len(candidates) and len(queries):
            data, asked = V.Products(candidates.column("v")), V.Products(queries.column("v"))
            ids, query_ids = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            numbers, least = queries.column("query").to_numpy(), queries.column("least").to_numpy()
            every = np.arange(len(ids))
            for at in range(0, len(numbers), BLOCK):
                block = np.arange(at, min(at + BLOCK, len(numbers)))
                for q, scores in zip(block, asked.with_(data, block, every)):
                    places = np.flatnonzero(scores >= least[q])
                    places = places[V.leading(scores[places], ids[places], k + 1)]
                    own = (ids[places] == query_ids[q]) & (data.vectors[places] == asked.vectors[q]).all(axis=1)
                    for column, x in zip(found, (np.full(len(places), numbers[q]), ids[places], scores[places], own)):
                        column.append(x)
        kinds = {"query": np.int64, "vec_id": np.int64, "score": np.int64, "own": bool}
        return pa.table({
            name: np.concatenate([np.zeros(0, kind), *column]).astype(kind)
            for (name, kind), column in zip(kinds.items(), found)
        })

    return run


def _pack(pivots: np.ndarray, counts: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """Groups of each cell of queries, and the number of parts of each cell.

    Cells are packed in the order of their pivots along the line of largest spread, so a group's
    cells lie near each other; a cell above ``QUERIES`` becomes groups of its own.
    """
    spread = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(pivots.shape[1])
    groups: list[list[int]] = [[] for _ in counts]
    parts = np.maximum(1, -(-counts // QUERIES)).astype(int)
    number, held = 0, 0
    for cell in np.argsort(pivots @ spread, kind="stable"):
        if not counts[cell]:
            continue
        if held and held + counts[cell] > QUERIES:
            number, held = number + 1, 0
        groups[cell] = list(range(number, number + int(parts[cell])))
        held += counts[cell]
        if parts[cell] > 1:
            number, held = number + int(parts[cell]), 0
    return groups, parts


def top_k(table: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row whose id
    ``every`` divides, by the inner product of ``floor(scale * x)``."""
    spark = bounded_batches(table.sparkSession)
    folder = scratch(spark, "top-k")
    rows = store(V.whole_rows(table, scale), f"{folder}/rows")
    length = V.usual_length(rows)
    if length is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == length)
    n = rows.count()
    if length == 0:
        rows = rows.withColumn("v", F.array(F.lit(0).cast("long")))
    data = store(V.fewest_copies(rows, ["v"], k + 1), f"{folder}/data")
    fitted = V.sample(data, n)
    join = Join(V.centres(fitted, min(MAX_PIVOTS, round(len(fitted) ** 0.5))) if len(fitted) else np.zeros((1, max(length, 1))), None, k)
    pivots = spark.sparkContext.broadcast(join)
    placed = store(
        data.mapInArrow(_place(pivots), "vec_id long, v array<long>, cell int, far double"), f"{folder}/placed"
    )
    cells = len(join.pivots)
    reach = np.zeros(cells)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():
        reach[r["cell"]] = r["far"]
    near = Window.partitionBy("cell").orderBy("far", "vec_id", "v")
    leaders = placed.withColumn("at", F.row_number().over(near)).filter(F.col("at") <= k + 1).select("v").toArrow()
    join.leaders = leaders.column(0).combine_chunks()

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asked = asked.withColumn("query", F.monotonically_increasing_id())
    known = spark.sparkContext.broadcast(join)
    schema = "vec_id long, v array<long>, times long, query long, cell int, far double, least long"
    asked = store(asked.mapInArrow(_certain(known), schema), f"{folder}/queries")

    counts, join.radius, join.least = np.zeros(cells, np.int64), np.zeros(cells), np.full(cells, np.inf)
    for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("least").alias("least")).collect():
        counts[r["cell"]], join.radius[r["cell"]], join.least[r["cell"]] = r["n"], r["far"], r["least"]
    join.groups, parts = _pack(join.pivots, counts)
    length_of = V.norms(join.pivots)
    # c = centre of queries, p = pivot of data: (c + a).(p + b) <= c.p + |a||p| + |b||c| + |a||b|.
    most = join.pivots @ join.pivots.T + np.outer(length_of, join.radius) + np.outer(reach, length_of + join.radius)
    join.wanted = ~(most + SLACK * np.outer(length_of + reach, length_of + join.radius) + 1.0 < join.least)
    summed = spark.sparkContext.broadcast(join)

    slices = max(1, -(-n // SLICE))
    group_of = [g[0] if g else 0 for g in join.groups]
    n_groups = max([0, *(g for own in join.groups for g in own)]) + 1
    lookup = lambda values: F.array(*[F.lit(int(x)) for x in values])
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    left = placed.select("vec_id", "v", "cell").mapInArrow(_send(summed), "vec_id long, v array<long>, groups array<int>").select(
        F.explode("groups").alias("group"), (own % slices).cast("int").alias("slice"), "vec_id", "v",
    )
    right = asked.select(
        (F.get(lookup(group_of), F.col("cell")) + F.pmod(F.col("query"), F.get(lookup(parts), F.col("cell")))).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "vec_id", "v", "query", "least",
    )
    # Dealt by number, as the work of a block is in its pairs, not in its bytes.
    tasks = min(n_groups * slices, 20_000)
    key = ["group", "slice"]
    solved = left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(
        _solve(k), "query long, vec_id long, score long, own boolean"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    itself = F.sum(F.col("own").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        solved.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
        # Of the query's own row and its repeats one is the query itself.
        .withColumn("seen", itself).filter(~(F.col("own") & (F.col("seen") == 1)))
        .withColumn("rank", (F.col("place") - F.least(F.lit(1), F.col("seen"))).cast("int")).filter(F.col("rank") <= k)
    )
    names = asked.select("query", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op12_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))
