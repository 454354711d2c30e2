"""Near-duplicate documents: MinHash bands for candidates, odd sketches to check them, full sets to confirm.

1. Every document becomes its set of word shingles. Equal sets form a class (exact copies
   collapse here, whatever their number); all later steps work on classes.
2. 180 MinHash samples give 36 bands of 5. The same samples are folded into an odd sketch:
   512 parity bits, one flipped per sample. Two sketches' XOR has a population count that
   estimates the number of differing samples, most precisely where few differ.
3. Classes that share a band form a bucket. The member that meets most others over all its
   buckets is the bucket's hub; the others are candidates with it, which makes at most one
   candidate per member and bucket. Candidates whose sketches differ too much are left out,
   the rest are confirmed on the full sets and united into components.
4. In buckets that still hold several components, the sketches of all members are compared
   within the tasks, and what they admit across components is joined into groups. Within a
   group, every set outside its largest component is intersected exactly with all others
   through an inverted list. So no pair that shares a bucket goes unexamined unless its ends
   are in one component already, and still a task returns links that unite something, at most
   one per member, never a group's pairs. Buckets and groups are cut into chunks, and each pair
   of chunks is a task of its own.

A pair at a similarity of exactly 0.75 shares a band with probability 1 - 6e-5 and passes
the sketch with probability 1 - 1e-5; more similar pairs are surer.

Defined results: a null or empty text, or one without words, has ``n_shingles`` 0 and is
linked with nothing. Repeated rows are documents of one class. A null ``doc_id`` never is a
component's smallest id while another member has one. An empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import words as W
from hazardlens.llm.common import bounded_batches, read_table, release_memory, scratch, slices, store, text_key
from hazardlens.llm.graph import connected_components

SHINGLE = 5
SIMILARITY = 75  # percent
BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
#: Differing sketch bits up to which a pair is compared. At a similarity of 0.75 they are
#: 76 on average with a standard deviation of 11.5; unrelated pairs have about 193.
SKETCH_DISTANCE = 125
#: Members of a bucket, and shingles of a group, that a chunk holds on average.
BUCKET_CHUNK, GROUP_CHUNK = 1024, 250_000

_random = np.random.RandomState(20240229)
_FACTOR = _random.randint(0, 2**31, SAMPLES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _random.randint(0, 2**31, SAMPLES).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slice of texts, its first row and the sorted distinct shingles of every text."""
    for row, _, data, offsets in slices(texts):
        hashes, starts = W.shingles(*W.words(data, offsets), SHINGLE)
        yield row, [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets, one row each."""
    base = np.concatenate(sets)
    base = (base >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    result = np.empty((SAMPLES, len(sets)), np.uint32)
    for k in range(SAMPLES):
        np.minimum.reduceat(base * _FACTOR[k] + _OFFSET[k], starts, out=result[k])
    return result.T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    numbered = samples.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))
    bits = (W.mix(numbered) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    rows = np.arange(len(samples))
    for k in range(SAMPLES):
        parity[rows, bits[:, k]] ^= 1
    return np.packbits(parity, axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = W.mix(keys + samples[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
    return keys.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as Arrow lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), pa.int64()))


def _class_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for row, sets in shingle_sets(batch.column(2)):
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(sets), BANDS), np.int64)
            sketch = np.zeros((len(sets), SKETCH_WORDS), np.int64)
            if filled:
                samples = min_hashes([sets[i] for i in filled])
                bands[filled], sketch[filled] = band_keys(samples), odd_sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, len(sets)), keys.slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_id(s) if len(s) else None for s in sets], pa.binary()),
                    _lists(bands), _lists(sketch),
                ],
                ["doc_id", "doc_key", "n_shingles", "class", "bands", "sketch"],
            )
    release_memory()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_key, n_shingles, class, bands, sketch`` of every document."""
    return docs.select("doc_id", text_key().alias("doc_key"), "text").mapInArrow(
        _sign,
        "doc_id long, doc_key long, n_shingles long, class binary, bands array<long>, sketch array<long>",
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0)):
            sets = [s for s in sets if len(s)]
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_class_id(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))),
                ],
                ["class", "shingles"],
            )
    release_memory()


def _sketches_admit(a: str, b: str) -> Column:
    differing = sum(
        (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)),
        F.lit(0),
    )
    small = F.least(f"{a}.n_shingles", f"{b}.n_shingles")
    large = F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (differing <= SKETCH_DISTANCE) & (100 * small >= SIMILARITY * large)


class _Uniting:
    """Numbers from 0 united into sets; tells which unions are new."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def unite(self, one: int, others: np.ndarray) -> np.ndarray:
        """Unite ``one`` with ``others``; those that belonged to another set, one of each."""
        labels = self.label[others]
        new, at = np.unique(labels, return_index=True)
        fresh = new != self.label[one]
        self.label[np.isin(self.label, new)] = self.label[one]
        return others[at[fresh]]


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.dictionary_encode().indices.to_numpy()


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({
        "a": pa.array([min(p) for p in pairs], pa.binary()), "b": pa.array([max(p) for p in pairs], pa.binary()),
    })


def _admitted(key: tuple, members: pa.Table) -> pa.Table:
    """Pairs of two chunks of a bucket that sketches and sizes admit, as far as they unite something."""
    sketch = np.array(members.column("sketch").to_pylist(), np.int64).view(np.uint64)
    size = members.column("n_shingles").to_numpy()
    names, root = members.column("class").to_pylist(), _codes(members.column("root"))
    chunk = members.column("chunk").to_numpy()
    first, second = (k.as_py() for k in key[-2:])
    right = np.flatnonzero(chunk == second)
    united, found = _Uniting(len(names)), []
    for i in np.flatnonzero(chunk == first):
        differing = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
        near = (differing <= SKETCH_DISTANCE) & (root[right] != root[i])
        near &= 100 * np.minimum(size[right], size[i]) >= SIMILARITY * np.maximum(size[right], size[i])
        found += [(names[i], names[j]) for j in united.unite(i, right[near])]
    return _edges(found)


def _similar(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of both tables' sets that are similar enough, as far as they unite components."""
    if not len(left) or not len(right):
        return _edges([])
    asked = [np.array(x, np.int64) for x in left.column("shingles").to_pylist()]
    sets = [np.array(x, np.int64) for x in right.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root = _codes(pa.chunked_array([*left.column("root").chunks, *right.column("root").chunks], pa.binary()))
    left_root, right_root = root[: len(asked)], root[len(asked) :]
    left_names, right_names = left.column("class").to_pylist(), right.column("class").to_pylist()
    united, found = _Uniting(len(root)), []
    for i, own in enumerate(asked):
        common = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 2000):
            low = np.searchsorted(values, own[at : at + 2000], "left")
            times = np.searchsorted(values, own[at : at + 2000], "right") - low
            places = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            common += np.bincount(owner[places], minlength=len(sets))
        linked = 100 * common >= SIMILARITY * (len(own) + size - common)
        linked = np.flatnonzero(linked & (right_root != left_root[i]))
        roots, at = np.unique(right_root[linked], return_index=True)
        new = set(united.unite(left_root[i], roots).tolist())
        found += [(left_names[i], right_names[linked[k]]) for r, k in zip(roots, at) if r in new]
    return _edges(found)


def _sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """``class, shingles`` of the classes in ``wanted (class)``, from their documents' texts."""
    places = wanted.join(reps, "class").select("rep_id", "rep_key").distinct()
    texts = docs.select("doc_id", text_key().alias("doc_key"), "text").join(
        places, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("doc_key") == F.col("rep_key")), "left_semi"
    )
    sets = texts.select("text").mapInArrow(_sets, "class binary, shingles array<long>")
    return store(sets, folder).dropDuplicates(["class"])


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _sets_of(docs, reps, ends, f"{folder}/sets-1")
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("shingles_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("shingles_b"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return store(
        pairs.join(left, "a").join(right, "b").filter(100 * common >= SIMILARITY * union).select("a", "b"),
        f"{folder}/links-1",
    )


def _open_pairs(members: DataFrame, sketches: DataFrame, folder: str) -> DataFrame:
    """Edges of the groups that sketches form across components in buckets with several of them."""
    split = (
        members.groupBy("band", "key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        .filter("low <> high").select("band", "key", F.ceil(F.col("n") / BUCKET_CHUNK).cast("int").alias("chunks"))
    )
    rows = members.join(split, ["band", "key"]).join(sketches, "class")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "band", "key", "class", "root", "sketch", "n_shingles", "chunk",
        F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"),
    )
    pairs = rows.groupBy("band", "key", "first", "second").applyInArrow(_admitted, "a binary, b binary")
    return store(pairs.distinct(), f"{folder}/open-pairs")


def _links_across(
    docs: DataFrame, classes: DataFrame, roots: DataFrame, pairs: DataFrame, folder: str,
) -> DataFrame:
    """Links between different components within the groups that ``pairs`` form."""
    groups = connected_components(pairs, f"{folder}/groups").select(F.col("node").alias("class"), F.col("root").alias("group"))
    known = roots.select(F.col("node").alias("class"), "root")
    placed = store(
        groups.join(known, "class", "left").join(classes.select("class", "n_shingles"), "class")
        .select("class", "group", "n_shingles", F.coalesce("root", "class").alias("root")),
        f"{folder}/groups-placed",
    )
    largest = (
        placed.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group")
        .agg(F.max(F.struct("n", "root")).getField("root").alias("main"))
    )
    chunks = placed.groupBy("group").agg(F.ceil(F.sum("n_shingles") / GROUP_CHUNK).cast("int").alias("chunks"))
    sets = _sets_of(docs, classes, placed.select("class"), f"{folder}/sets-2")
    rows = placed.join(largest, "group").join(chunks, "group").join(sets, "class")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = rows.filter(F.col("root") != F.col("main")).select(
        "group", F.col("chunk").alias("i"), F.col("other").alias("j"), "class", "root", "shingles"
    )
    right = rows.select(
        F.col("group").alias("group"), F.col("other").alias("i"), F.col("chunk").alias("j"),
        *[F.col(c).alias(c) for c in ("class", "root", "shingles")],
    )
    cell = ["group", "i", "j"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_similar, "a binary, b binary")
    return store(found, f"{folder}/links-2")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_key, n_shingles, component_id, kept, root`` for every row of ``docs (doc_id, text)``.

    ``root`` names the component whatever the ids are; it is null for texts without words.
    """
    folder = scratch(bounded_batches(docs.sparkSession), "near-duplicates")
    signed = store(signatures(docs), f"{folder}/signatures")
    classes = signed.filter("class is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "doc_key", "n_shingles", "bands", "sketch")).alias("rep")
    )
    classes = store(
        classes.select(
            "class", F.col("rep.doc_id").alias("rep_id"), F.col("rep.doc_key").alias("rep_key"),
            "rep.n_shingles", "rep.bands", "rep.sketch",
        ),
        f"{folder}/classes",
    )
    reps = classes.drop("bands", "sketch")
    sketches = classes.select("class", "n_shingles", "sketch")

    # A bucket's members are written only where there are at least two.
    banded = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = store(banded.join(buckets, ["band", "key"]), f"{folder}/buckets")
    met = shared.groupBy("class").agg(F.sum("members").alias("met"))
    hubs = (
        shared.join(met, "class").groupBy("band", "key")
        .agg(F.max(F.struct("met", "class")).getField("class").alias("hub"))
    )
    stars = (
        shared.join(hubs, ["band", "key"]).filter(F.col("class") != F.col("hub"))
        .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    )
    left, right = sketches.alias("l"), sketches.alias("r")
    first = store(
        stars.join(left, F.col("a") == F.col("l.class")).join(right, F.col("b") == F.col("r.class"))
        .filter(_sketches_admit("l", "r")).select("a", "b"),
        f"{folder}/pairs-1",
    )
    links = _links(docs, reps, first, folder)
    roots = connected_components(links, f"{folder}/components-1")

    members = store(
        shared.join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("band", "key", "class", F.coalesce("root", "class").alias("root")),
        f"{folder}/members",
    )
    pairs = _open_pairs(members, sketches, folder)
    if not pairs.isEmpty():
        more = _links_across(docs, reps, roots, pairs, folder)
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more), f"{folder}/components-2")

    rooted = signed.select("doc_id", "doc_key", "n_shingles", "class").join(
        roots.withColumnRenamed("node", "class"), "class", "left"
    ).select("doc_id", "doc_key", "n_shingles", F.coalesce("root", "class").alias("root"))
    rooted = store(rooted, f"{folder}/rooted")
    lowest = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return rooted.join(lowest, "root", "left").select(
        "doc_id", "doc_key", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "root",
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).drop("doc_key", "root")
