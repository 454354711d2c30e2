"""Benchmark decontamination by SimHash windows of the items' own sizes.

1. An item is its sequence of five-word shingles, weighted by how few items hold them:
   ``ln(1 + items / items with the shingle)``. Words are runs of letters and digits, A-Z
   lower-cased, so punctuation does not matter.
2. A window of a document can only be similar to an item if it holds one of its shingles.
   Each occurrence of an item's shingle therefore sets one window of the item's size, with
   the shingle where the item has it. All of every document is looked at.
3. Windows and items get 64-bit SimHash fingerprints of their weighted shingles. A
   multi-index of 8 blocks of 8 bits finds all items of the window's size within a Hamming
   radius of 23: if 64 bits differ in at most 23, some block differs in at most 2, and items
   are listed under every block value up to 2 bits away.
4. Candidates are verified by exact weighted similarity of their shingle sets, 0.75 or more.

What sets windows are the distinct entries (shingle, place in an item, words of the item). They
reach the tasks in shards of about ``SHARD`` entries, one pass over the documents each, dealt by
the whole entry, so that a shingle held by very many items is not one shard. The distinct windows
found by all passes get the weights of all shingles by a join; results do not depend on shards.

Defined results: items with fewer than five words carry no shingle and match nothing, as do
null or empty texts. An item is an id with a text: rows that repeat both are one item, texts that
share an id, or have none, are items of their own and reported under that id. Repeated rows of
documents are found alike. An empty benchmark or an empty table gives no match. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import words as W
from hazardlens.llm.common import bounded_batches, read_table, release_memory, scratch, slices, store, text_key

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS = 64, 8
RADIUS = 23
#: Entries (shingle, place in an item, words) broadcast at once: 24 bytes each.
SHARD = 1_000_000

_FILTER_BITS = 20


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, after, data, offsets in slices(batch.column(2)):
            hashes, first = W.words(data, offsets, W.NOT_ALNUM)
            found, starts = W.shingles(hashes, first, SHINGLE)
            for i in range(after - row):
                size = int(first[i + 1] - first[i])
                if size >= SHINGLE:
                    own = found[starts[i] : starts[i + 1]].view(np.int64)
                    n = len(own)
                    same = pa.array(np.full(n, row + i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(same), batch.column(1).take(same), pa.array(np.full(n, size, np.int64)), pa.array(np.arange(n)), pa.array(own),
                        ],
                        ["item_id", "item_key", "n_words", "place", "shingle"],
                    )


def simhash(shingles: np.ndarray, weights: np.ndarray) -> int:
    """Fingerprint of weighted shingles: the sign of each bit's weighted vote."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    votes = weights @ (bits * 2.0 - 1.0)
    return int(np.packbits(votes > 0).view(np.int64)[0])


def weighted_similarity(window: np.ndarray, item: np.ndarray, weights: np.ndarray, unknown: float) -> float:
    """Weighted Jaccard similarity of a window's and an item's sets of shingles.

    ``weights`` are the item's; a shingle that the item has not weighs ``unknown``.
    """
    window = np.unique(window)
    item, at = np.unique(item, return_index=True)
    weights = weights[at]
    common = np.isin(item, window, assume_unique=True)
    union = weights.sum() + unknown * (len(window) - common.sum())
    return float(weights[common].sum() / union) if union > 0 else 0.0


class _Shard:
    """A part of the items' shingles, sorted, with the places they have in items."""

    def __init__(self, shingle: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.place, self.size = shingle[order], place[order], size[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.shingle & ((1 << _FILTER_BITS) - 1)] = True

    def windows(self, shingles: np.ndarray) -> np.ndarray:
        """Rows ``(first shingle, words)`` of the windows that shingles of this shard set."""
        at = np.flatnonzero(self.seen[shingles & ((1 << _FILTER_BITS) - 1)])
        low = np.searchsorted(self.shingle, shingles[at], "left")
        high = np.searchsorted(self.shingle, shingles[at], "right")
        times = high - low
        if not times.sum():
            return np.zeros((0, 2), np.int64)
        entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        size = self.size[entry]
        last = len(shingles) - (size - SHINGLE + 1)
        start = np.maximum(np.minimum(np.repeat(at, times) - self.place[entry], last), 0)
        return np.unique(np.stack([start, size], axis=1), axis=0)


def _window_finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard = shared.value
        for batch in batches:
            rows = []
            for row, after, data, offsets in slices(batch.column(2)):
                found, starts = W.shingles(*W.words(data, offsets, W.NOT_ALNUM), SHINGLE)
                found = found.view(np.int64)
                hit = shard.seen[found & ((1 << _FILTER_BITS) - 1)]
                hits_before = np.concatenate([[0], np.cumsum(hit)])[starts]
                for i in np.flatnonzero(np.diff(hits_before)):
                    own = found[starts[i] : starts[i + 1]]
                    for start, size in shard.windows(own):
                        inside = own[start : start + size - SHINGLE + 1]
                        rows.append((row + i, int(start), int(size), inside))
            if rows:
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at),
                        pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "doc_key", "start", "n_words", "shingles"],
                )
        release_memory()

    return run


def _fingerprinter(shingles: str, weights: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (shingles, weights)]
            prints = [simhash(np.array(s, np.int64), np.array(w)) for s, w in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, name]
            )

    return run


def _verifier(unknown: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            arrays = [batch.column(at(n)).to_pylist() for n in ("shingles", "item_shingles", "item_weights")]
            found = [
                weighted_similarity(np.array(a), np.array(b), np.array(w), unknown) for a, b, w in zip(*arrays)
            ]
            names = ["doc_id", "doc_key", "item_id", "start", "n_words"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at(n)) for n in names], pa.array(found, pa.float64())], [*names, "similarity"]
            )

    return run


def _masks(bits: int, distance: int) -> list[int]:
    """All values of ``bits`` bits with at most ``distance`` of them set."""
    return [sum(1 << i for i in set_) for n in range(distance + 1) for set_ in combinations(range(bits), n)]


def _block(fingerprint: str, number) -> F.Column:
    width = BITS // BLOCKS
    return F.expr(f"cast(shiftrightunsigned({fingerprint}, cast({number} as int) * {width}) & {(1 << width) - 1} as int)")


def contaminated_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, doc_key, item_id, start, n_words, similarity``: the best window of every
    document and benchmark item that are similar enough; ``start`` counts words from 0."""
    spark = bounded_batches(docs.sparkSession)
    folder = scratch(spark, "decontamination")
    places = store(
        benchmark.select("item_id", text_key().alias("item_key"), "text").dropDuplicates(["item_id", "item_key"])
        .mapInArrow(_item_shingles, "item_id long, item_key long, n_words long, place long, shingle long"),
        f"{folder}/places",
    )
    n_items = places.filter("place = 0").count()
    default = float(np.log1p(n_items))
    holders = places.select("item_id", "item_key", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("holders"))
    weights = store(
        holders.select("shingle", F.log1p(F.lit(float(n_items)) / F.col("holders")).alias("weight")), f"{folder}/weights"
    )
    items = places.join(weights, "shingle").groupBy("item_id", "item_key", "n_words").agg(
        F.array_sort(F.collect_list(F.struct("place", "shingle", "weight"))).alias("all")
    ).select(
        F.xxhash64("item_id", "item_key").alias("item"), "item_id", "n_words",
        F.col("all.shingle").alias("item_shingles"), F.col("all.weight").alias("item_weights"),
    )
    items = store(
        items.mapInArrow(
            _fingerprinter("item_shingles", "item_weights", "item_fingerprint"),
            "item long, item_id long, n_words long, item_shingles array<long>, item_weights array<double>,"
            " item_fingerprint long",
        ),
        f"{folder}/items",
    )
    texts = docs.select("doc_id", text_key().alias("doc_key"), "text")
    entry = ["shingle", "place", "n_words"]
    entries = store(places.select(*entry).distinct(), f"{folder}/entries")
    windows = None
    shards = -(-entries.count() // SHARD)
    for number in range(shards):
        part = entries.filter(F.pmod(F.xxhash64(*entry), F.lit(shards)) == number).toPandas()
        if not len(part):
            continue
        shard = _Shard(*(part[c].to_numpy() for c in entry))
        found = texts.mapInArrow(
            _window_finder(spark.sparkContext.broadcast(shard)),
            "doc_id long, doc_key long, start long, n_words long, shingles array<long>",
        )
        windows = found if windows is None else windows.unionByName(found)
    schema = "doc_id long, doc_key long, item_id long, start long, n_words long, similarity double"
    if windows is None:
        return spark.createDataFrame([], schema)
    windows = store(windows.withColumn("content", F.xxhash64("shingles")), f"{folder}/windows")
    # Equal windows are fingerprinted once.
    shingled = windows.select("content", "shingles").distinct().select(
        "content", F.posexplode("shingles").alias("place", "shingle")
    )
    prints = shingled.join(weights, "shingle", "left").groupBy("content").agg(
        F.array_sort(F.collect_list(
            F.struct("place", "shingle", F.coalesce("weight", F.lit(default)).alias("weight"))
        )).alias("all")
    ).select("content", F.col("all.shingle").alias("shingles"), F.col("all.weight").alias("weights"))
    prints = prints.mapInArrow(
        _fingerprinter("shingles", "weights", "fingerprint"),
        "content long, shingles array<long>, weights array<double>, fingerprint long",
    ).select("content", "fingerprint")

    near = _masks(BITS // BLOCKS, RADIUS // BLOCKS)
    listed = items.select("item", "item_id", "n_words", "item_fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    listed = listed.withColumn("value", _block("item_fingerprint", "block")).withColumn(
        "value", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: m.bitwiseXOR(F.col("value"))))
    )
    asked = windows.drop("shingles").join(prints, "content").select("doc_id", "doc_key", "start", F.col("n_words").alias("size"), "fingerprint",
                           F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("at"))
    asked = asked.withColumn("asked", _block("fingerprint", "at"))
    candidates = asked.join(
        listed,
        (F.col("size") == F.col("n_words")) & (F.col("at") == F.col("block")) & (F.col("asked") == F.col("value"))
        & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS),
    ).select("doc_id", "doc_key", "start", "size", "item").distinct()
    candidates = candidates.join(items.drop("item_fingerprint"), "item")
    w, c = windows.alias("w"), candidates.alias("c")
    pairs = c.join(
        w,
        F.col("c.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("c.doc_key") == F.col("w.doc_key"))
        & (F.col("c.start") == F.col("w.start")) & (F.col("c.size") == F.col("w.n_words")),
    ).select("c.doc_id", "c.doc_key", "c.item_id", "c.start", F.col("c.size").alias("n_words"),
             "w.shingles", "c.item_shingles", "c.item_weights")
    verified = pairs.mapInArrow(_verifier(default), schema).filter(F.col("similarity") >= SIMILARITY)
    return (
        verified.groupBy("doc_id", "doc_key", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("earlier"), "n_words")).alias("best"))
        .select("doc_id", "doc_key", "item_id", (-F.col("best.earlier")).alias("start"), "best.n_words", "best.similarity")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds; clean documents have none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_windows(docs, read_table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("earlier"), "n_words")).alias("best")
    ).select(
        "doc_id", "item_id", (-F.col("best.earlier")).alias("start"), "best.n_words",
        F.round("best.similarity", 9).alias("similarity"),
    )
