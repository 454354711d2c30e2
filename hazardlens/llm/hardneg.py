"""Hard negatives by shared candidate lists of anchor clusters.

1. Anchors are clustered by direction; a cluster knows its centre and the largest angle between
   the centre and a member. No cluster part has more than ``MEMBERS`` members.
2. For a candidate ``s`` at angle ``t`` from the centre of a cluster with widest angle ``w``, no
   member ``a`` scores more than ``|a| * |s| * cos(max(0, t - w))``. A cluster's candidates are
   sorted by that bound, without ``|a|``, once; all members share the list.
3. Every member walks the list from its top. It stops at the first candidate whose bound certifies
   that neither this nor any later one can score as much as the last result it already has.
4. The list is cut at a quantile of the bounds into a head and a rest. The heads are walked first;
   what they give ends most of the rest: candidates that no member of a cluster can want any more
   are not sent at all. Each part of a list is dealt to slices of about ``SLICE`` candidates,
   sorted in their task, so a list of any length and a hot cluster spread over tasks.
5. The first walk finds the positives, the best other rows of the anchor's label. They fix a
   window of negative scores each, and the second walk finds the best rows of other labels in
   every window; a member stops when its bound falls below all windows' needs.

Scores are exact whole numbers; a bound carries a slack above its rounding error. Where vectors do
not cluster, the bounds end no walk and every list is walked to its end.

Defined results: rows without id, label or vector, or with a null or non-finite component take no
part, neither do vectors of another length than most. Zero vectors do. Rows that share an id are
rows of their own: each is an anchor with its results, each counts as candidate. Equal scores go
to the smaller id. An anchor without positives, or a positive without a negative in its window,
gives no rows. A component or score beyond the range of a long counts as its limit. Only the three
columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm import vectors as V
from hazardlens.llm.common import bounded_batches, read_table, scratch, store

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative scores at least LOW and at most HIGH hundredths of its positive.
LOW, HIGH = 30, 90
MAX_CLUSTERS = 1024
#: Members that a cluster is fitted for, and the most that a part of it holds.
TYPICAL, MEMBERS = 2048, 4096
SLICE = 16384
#: Share of a list that is its head.
HEAD = 1 / 16
#: Candidates that a member takes at a time, and rows of an Arrow batch handled at once.
STEP, CHUNK = 1024, 4096
SLACK = 1e-7

RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


@dataclass
class Lists:
    """Clusters of anchors, at most ``MAX_CLUSTERS``."""

    centres: np.ndarray
    #: Widest angle and number of parts of each cluster; no parts where it has no member.
    widest: np.ndarray
    parts: np.ndarray
    #: Bound at the end of each list's head.
    edge: np.ndarray
    #: Bound that a candidate of the rest needs.
    needed: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Highest score of each vector per unit of a member's length, by cluster."""
        size = V.norms(vectors)
        between = self.angles(vectors) - self.widest[None, :]
        return size[:, None] * (np.cos(np.maximum(between, 0.0)) + SLACK)

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        size = V.norms(vectors)
        with np.errstate(divide="ignore", invalid="ignore"):
            near = (vectors @ self.centres.T) / size[:, None]
        return np.arccos(np.clip(np.nan_to_num(near), -1.0, 1.0))


def _directions(vectors: np.ndarray) -> np.ndarray:
    size = V.norms(vectors)
    return vectors / np.where(size > 0, size, 1.0)[:, None]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            yield batch.slice(at, CHUNK)


def _join_cluster(shared):
    """Each anchor with its cluster, its angle from the centre and its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: Lists = shared.value
        for part in _batches(batches):
            vectors = V.matrix(part.column("v"))
            own = np.argmax(_directions(vectors) @ lists.centres.T, axis=1)
            angle = lists.angles(vectors)[np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(own, pa.int32()), pa.array(angle, pa.float64()), pa.array(V.norms(vectors), pa.float64())],
                [*part.schema.names, "cluster", "angle", "size"],
            )

    return run


def _enlist(shared, head: bool):
    """Each candidate with the clusters in whose list it stands, in the head or in the needed rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: Lists = shared.value
        for part in _batches(batches):
            bounds = lists.bounds(V.matrix(part.column("v")))
            first = bounds >= lists.edge[None, :]
            stands = (first if head else ~first & ~(bounds < lists.needed[None, :])) & (lists.parts > 0)[None, :]
            row, cluster = np.nonzero(stands)
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cluster, pa.int32()), pa.array(bounds[row, cluster], pa.float64())],
                [*part.schema.names, "cluster", "bound"],
            )

    return run


def _walk(find):
    """Walk a slice of a list with the members of a part of its cluster.

    ``find(member)`` makes its walker, which takes the candidates of a step; ``least`` is the score
    that a candidate must reach to matter to it, ``alike`` whether it wants rows of its own label.
    """
    def run(candidates: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(candidates) and len(members):
            order = np.argsort(-candidates.column("bound").to_numpy(), kind="stable")
            candidates = candidates.take(pa.array(order))
            data, own = V.Products(candidates.column("v")), V.Products(members.column("v"))
            bound = candidates.column("bound").to_numpy()
            ids, labels = candidates.column("vec_id").to_numpy(), candidates.column("label").to_numpy()
            walkers = [find(r) for r in members.drop_columns(["v"]).to_pylist()]
            going = np.arange(len(walkers))
            for at in range(0, len(ids), STEP):
                least = np.array([float(walkers[m].least) for m in going])
                # The certificate: this candidate's bound, and so any later one's, is too low.
                going = going[~(own.norms[going] * bound[at] * (1 + 1e-9) + 1.0 < least)]
                if not len(going):
                    break
                step = np.arange(at, min(at + STEP, len(ids)))
                table = own.with_(data, going, step)
                least = np.array([walkers[m].least for m in going], np.int64)
                alike = labels[step][None, :] == np.array([walkers[m].label for m in going])[:, None]
                matters = ((table >= least[:, None]) & (alike == walkers[0].alike)).any(axis=1)
                for m, scores in zip(going[matters], table[matters]):
                    same = (ids[step] == walkers[m].vec_id) & (labels[step] == walkers[m].label)
                    itself = np.zeros(len(step), bool)
                    itself[same] = (data.vectors[step[same]] == own.vectors[m]).all(axis=1)
                    walkers[m].take(scores, ids[step], labels[step], itself)
            found = [row for walker in walkers for row in walker.rows()]
        return pa.table({
            "anchor": pa.array([r[0] for r in found], pa.int64()), "window": pa.array([r[1] for r in found], pa.int32()),
            "vec_id": pa.array([r[2] for r in found], pa.int64()), "score": pa.array([r[3] for r in found], pa.int64()),
            "own": pa.array([r[4] for r in found], pa.bool_()),
        })

    return run


class _Best:
    """The ``k`` best candidates met so far; ``least`` is what the next one must reach."""

    def __init__(self, k: int, least: int | None) -> None:
        self.k, self.floor = k, -V.LONGEST - 1 if least is None else least
        self.scores, self.ids, self.own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        places = np.flatnonzero(scores >= self.least)
        if len(places):
            scores = np.concatenate([self.scores, scores[places]])
            ids, own = np.concatenate([self.ids, ids[places]]), np.concatenate([self.own, own[places]])
            best = V.leading(scores, ids, self.k)
            self.scores, self.ids, self.own = scores[best], ids[best], own[best]

    @property
    def least(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor


class _PositiveWalker:
    """Best rows of the anchor's own label, one more than wanted as it may meet itself."""

    alike = True

    def __init__(self, member: dict, k: int) -> None:
        self.number, self.vec_id, self.label = member["anchor"], member["vec_id"], member["label"]
        self.best = _Best(k + 1, member["least"])

    @property
    def least(self) -> int:
        return self.best.least

    def take(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, itself: np.ndarray) -> None:
        same = labels == self.label
        self.best.take(scores[same], ids[same], itself[same])

    def rows(self) -> Iterator[tuple]:
        for score, vec_id, own in zip(self.best.scores, self.best.ids, self.best.own):
            yield self.number, 0, int(vec_id), int(score), bool(own)


class _NegativeWalker:
    """Best rows of other labels in the window of each positive."""

    alike = False

    def __init__(self, member: dict, k: int) -> None:
        self.number, self.vec_id, self.label = member["anchor"], member["vec_id"], member["label"]
        self.windows = [(w["window"], w["high"], _Best(k, w["least"])) for w in member["windows"]]

    @property
    def least(self) -> int:
        return min(best.least for _, _, best in self.windows)

    def take(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, itself: np.ndarray) -> None:
        other = (labels != self.label) & (scores >= self.least)
        scores, ids = scores[other], ids[other]
        for _, high, best in self.windows:
            below = scores <= high
            best.take(scores[below], ids[below], np.zeros(int(below.sum()), bool))

    def rows(self) -> Iterator[tuple]:
        for window, _, best in self.windows:
            for score, vec_id in zip(best.scores, best.ids):
                yield self.number, window, int(vec_id), int(score), False


def _fit(anchors: DataFrame, n: int, data: DataFrame, n_data: int) -> tuple[Lists, np.ndarray]:
    """Centres of the anchors, and a sample of the candidates for the heads of the lists."""
    fitted = _directions(V.sample(anchors, n))
    count = int(min(MAX_CLUSTERS, max(1, round(n / TYPICAL))))
    centres = V.centres(fitted, count) if len(fitted) else np.zeros((1, 1))
    count = len(centres)
    nothing = np.full(count, -np.inf)
    return Lists(_directions(centres), np.zeros(count), np.zeros(count, int), nothing, nothing), V.sample(data, n_data)


class _Mining:
    """The lists of one run: their clusters, candidates and members."""

    def __init__(self, spark: SparkSession, data: DataFrame, lists: Lists, n: int, folder: str) -> None:
        self.spark, self.data, self.lists, self.folder = spark, data, lists, folder
        self.slices = {True: max(1, int(np.ceil(n * HEAD / SLICE))), False: max(1, int(np.ceil(n / SLICE)))}

    def walk(self, members: DataFrame, finder, head: bool, name: str) -> DataFrame:
        """``anchor, window, vec_id, score, own``: results of one part of all lists."""
        shared = self.spark.sparkContext.broadcast(self.lists)
        slices, parts = self.slices[head], F.array(*[F.lit(int(max(1, p))) for p in self.lists.parts])
        own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
        count = F.get(parts, F.col("cluster"))
        left = self.data.mapInArrow(
            _enlist(shared, head), "vec_id long, v array<long>, label int, cluster int, bound double"
        ).select("cluster", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"),
                 (own % slices).cast("int").alias("slice"), "vec_id", "v", "label", "bound")
        right = members.select(
            "*", F.pmod(F.col("anchor"), count).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
        )
        tasks = int(min(max(1, self.lists.parts.sum()) * slices, 20_000))
        key = ["cluster", "part", "slice"]
        return store(
            left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(
                _walk(finder), "anchor long, window int, vec_id long, score long, own boolean"
            ),
            f"{self.folder}/{name}",
        )

    def both(self, members: DataFrame, finder, k: int, narrowed, name: str) -> DataFrame:
        """Walk the heads, then the rest as far as the heads' results leave it open."""
        self.lists.needed = np.full(len(self.lists.centres), -np.inf)
        head = self.walk(members, finder, True, f"{name}-head")
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
        last = (
            head.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
            .groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            .filter(F.col("n") == k)
        )
        members = store(narrowed(members, last), f"{self.folder}/{name}-members")
        # No candidate below the least need of a cluster's members can matter to any of them.
        need = F.when(F.col("size") > 0, F.col("need") / F.col("size")).when(F.col("need") <= 0, F.lit(float("-inf"))).otherwise(
            F.lit(float("inf"))
        )
        self.lists.needed = np.full(len(self.lists.centres), np.inf)
        for r in members.groupBy("cluster").agg(F.min(need).alias("need")).collect():
            finite = abs(r["need"]) < np.inf
            self.lists.needed[r["cluster"]] = r["need"] - abs(r["need"]) * 1e-9 - 1.0 if finite else r["need"]
        return head.unionByName(self.walk(members, finder, False, f"{name}-rest"))


def _other_rows(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows less the anchor's own; of its repeats one is the anchor itself."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    itself = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
        .withColumn("seen", itself).filter(~(F.col("own") & (F.col("seen") == 1)))
        .withColumn("window", (F.col("place") - F.least(F.lit(1), F.col("seen"))).cast("int"))
        .filter(F.col("window") <= k).select("anchor", "window", "vec_id", "score")
    )


def _share(score: Column, hundredths: int, up: bool) -> Column:
    """The whole number that ``100 * x`` compared with ``hundredths * score`` comes to."""
    product = score.cast("decimal(38,0)") * hundredths
    return (F.ceil(product / 100) if up else F.floor(product / 100)).cast("long")


def hard_negatives(
    table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``table`` has ``vec_id``, ``embedding`` and ``label``; rows whose id ``every`` divides are the
    anchors.
    """
    spark = bounded_batches(table.sparkSession)
    folder = scratch(spark, "hard-negatives")
    rows = store(V.whole_rows(table, scale, F.col("label").cast("int").alias("label")).filter("label is not null"), f"{folder}/rows")
    length = V.usual_length(rows)
    if not length:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == length)
    # An anchor takes no more of equal vectors of a label, itself included.
    data = store(V.fewest_copies(rows, ["v", "label"], max(positives, negatives) + 1), f"{folder}/data")
    anchors = store(
        rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v", "label").agg(F.count("*").alias("times"))
        .withColumn("anchor", F.monotonically_increasing_id()), f"{folder}/anchors",
    )
    n, n_data = anchors.count(), data.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    lists, sample = _fit(anchors, n, data, n_data)
    clustered = store(
        anchors.mapInArrow(
            _join_cluster(spark.sparkContext.broadcast(lists)),
            "vec_id long, v array<long>, label int, times long, anchor long, cluster int, angle double, size double",
        ),
        f"{folder}/clustered",
    )
    for r in clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():
        lists.widest[r["cluster"]], lists.parts[r["cluster"]] = r["angle"], -(-r["n"] // MEMBERS)
    if len(sample):
        lists.edge = np.quantile(lists.bounds(sample), 1 - HEAD, axis=0)

    mining = _Mining(spark, data, lists, n_data, folder)
    members = clustered.select("anchor", "vec_id", "v", "label", "cluster", "size", F.lit(None).cast("long").alias("least"))

    def first_need(given: DataFrame, last: DataFrame) -> DataFrame:
        return given.drop("least").join(last.select("anchor", F.col("last").alias("least")), "anchor", "left").withColumn(
            "need", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
        )

    met = mining.both(members, lambda m: _PositiveWalker(m, positives), positives + 1, first_need, "positives")
    chosen = store(_other_rows(met, positives), f"{folder}/chosen").select(
        "anchor", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    windows = chosen.select(
        "anchor", "window", _share(F.col("positive_score"), low, True).alias("least"),
        _share(F.col("positive_score"), high, False).alias("high"),
    ).filter("least <= high")
    gathered = lambda w: w.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("window", "high", "least"))).alias("windows")
    )
    seekers = store(members.drop("least").join(gathered(windows), "anchor"), f"{folder}/seekers")

    def later_need(given: DataFrame, last: DataFrame) -> DataFrame:
        raised = windows.join(last.select("anchor", "window", "last"), ["anchor", "window"], "left").select(
            "anchor", "window", "high", F.greatest("least", "last").alias("least")
        )
        return given.drop("windows").join(gathered(raised), "anchor").withColumn("need", F.array_min("windows.least").cast("double"))

    hard = mining.both(seekers, lambda m: _NegativeWalker(m, negatives), negatives, later_need, "negatives")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = clustered.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    return ranked.join(chosen, ["anchor", "window"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("label")
    table = read_table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives(table.select("vec_id", "embedding", changed.alias("label")))
