"""BPE encoding through a table of distinct words, decoding through a join of ids and pieces.

Encoding:

1. Tasks cut their texts into words (chunks that the tokenizer treats independently, see
   ``chunks``). A block of about 4 MB becomes its distinct words and, per document, the numbers
   of its words in order, frequent words first. Both are packed; the texts are not shuffled.
2. Words are dealt by hash into buckets, packed per block and bucket. A bucket holds its part of
   the distinct-word table: every distinct word of the corpus is encoded exactly once. A frequent
   word arrives once per block, so no bucket is hot.
3. The ids return to each block and are joined to the documents by position. Words and numbers of
   a block travel in one exchange that both steps read; a check sum over the words tells if a
   block was ever computed differently, which then is an error.

Decoding joins the ids with the table of pieces, which has one row per id of the vocabulary and so
a fixed size, and concatenates the pieces' bytes by position.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows and
null ids come out row by row. Special tokens written out in a text become their ids, as in the
library. An empty table gives an empty result. Only the key columns and the text are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.chunks import chunk_dictionary, chunk_encoder, gather, tokenizer_json
from hazardlens.llm.common import bounded_batches, read_table, release_memory, slices
from hazardlens.llm.words import mix

VOCABULARY = "byte_bpe_50k.json"
BLOCK_BYTES = 4_000_000
MAX_BUCKETS = 65_535

#: Words go to their bucket (kind 0), numbers of words to their block (kind 1).
_DEALT = "kind int, part long, block long, bucket int, rows array<long>, check long, packed binary"
_ANSWERS = "kind int, part long, bucket int, check long, packed binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after the other, each with its length, compressed."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(packed: bytes, *kinds: str | None) -> list:
    """The arrays of ``pack``, by their numpy types; None leaves bytes."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    parts = [raw[e - s : e] for s, e in zip(sizes, ends)]
    return [p if k is None else np.frombuffer(p, k) for p, k in zip(parts, kinds)]


def _bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, int]:
    """A bucket per word by its bytes, alike in every process, and a check sum over the words."""
    if not len(words):
        return np.zeros(0, np.int64), 0
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    # A sum over bytes, each mixed with its place in the word.
    size = np.diff(offsets)
    place = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
    spread = mix(data[offsets[0] :].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(spread)])
    value = mix(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]])
    check = mix(value + np.arange(len(value), dtype=np.uint64)).sum(dtype=np.uint64)
    return (value % np.uint64(buckets)).astype(np.int64), int(check.view(np.int64))


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """The four bytes of 32-bit numbers, each apart: the upper ones compress to almost nothing."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [raw[:, i] for i in range(4)]


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, after, data, offsets in slices(batch.column(1), BLOCK_BYTES):
                block += 1
                words, codes, first = chunk_dictionary(data, offsets)
                by_count = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                number = np.empty(len(words), np.int64)
                number[by_count] = np.arange(len(words))
                words = words.take(pa.array(by_count))
                bucket, check = _bucket(words, buckets)
                order = np.argsort(bucket, kind="stable")
                words = words.take(pa.array(order))
                counts = np.bincount(bucket, minlength=buckets)
                ends = np.cumsum(counts)
                used = np.flatnonzero(counts)
                packed = []
                for b in used:
                    part = words.slice(ends[b] - counts[b], counts[b]).to_pylist()
                    packed.append(pack(np.array([len(w) for w in part], "<i4"), b"".join(part)))
                packed.append(pack(*_planes(number[codes]), np.diff(first).astype("<i8"), bucket.astype("<u2")))
                rows = [None] * len(used) + [batch.column(0).slice(row, after - row).to_pylist()]
                n = len(used) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * len(used) + [1], pa.int32()), pa.array([*used.tolist(), block], pa.int64()),
                        pa.array([block] * n, pa.int64()), pa.array([*used.tolist(), -1], pa.int32()),
                        pa.array(rows, pa.list_(pa.int64())), pa.array([check] * n, pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["kind", "part", "block", "bucket", "rows", "check", "packed"],
                )
        release_memory()

    return run


def _encode_bucket(vocabulary):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = ["kind", "part", "bucket", "check", "packed"]
        if key[0].as_py() == 1:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())], names)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sizes, texts = [], []
        for packed in table.column("packed"):
            size, text = unpack(packed.as_py(), "<i4", None)
            sizes.append(size)
            texts.append(text)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))]
        ).dictionary_encode()
        ids = chunk_encoder(vocabulary.value).encode(words.dictionary.to_pylist())
        held = np.array([len(i) // 4 for i in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(held) - held
        codes = words.indices.to_numpy()
        packed, at = [], 0
        for size in sizes:
            own = codes[at : at + len(size)]
            at += len(size)
            packed.append(pack(held[own].astype("<u4"), gather(flat, begin[own], held[own])))
        release_memory()
        return pa.table(
            [
                pa.array([1] * len(packed), pa.int32()), table.column("block"), table.column("bucket"),
                table.column("check"), pa.array(packed, pa.binary()),
            ],
            names,
        )

    return run


def _assemble(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """The ids of a block's documents: the answers of its buckets, joined by position."""
    if key[0].as_py() == 0:
        return pa.table({"row": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    block = blocks.to_pylist()[0] if len(blocks) == 1 else None
    if block is None or any(c != block["check"] for c in answers.column("check").to_pylist()):
        raise ValueError("a block was computed twice with different words; give the texts in a stable order")
    *planes, counts, bucket = unpack(block["packed"], *["u1"] * 4, "<i8", "<u2")
    number = np.stack(planes, axis=1).copy().view("<u4").ravel().astype(np.int64)
    place = np.empty(len(bucket), np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    packed = answers.column("packed")
    parts = [unpack(packed[int(i)].as_py(), "<u4", "<u4") for i in order]
    held = np.concatenate([p[0] for p in parts] or [np.zeros(0, "<u4")]).astype(np.int64)
    flat = np.concatenate([p[1] for p in parts] or [np.zeros(0, "<u4")])
    if len(held) != len(bucket):
        raise ValueError("a block's words came back incomplete")
    begin = np.cumsum(held) - held
    code = place[number]
    sizes = held[code]
    ids = gather(flat, begin[code], sizes)
    # Ends of the documents in the ids, from the ids of their words.
    words_before = np.concatenate([[0], np.cumsum(counts)])
    ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[words_before]
    encoded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())]
    )
    return pa.table({"row": pa.array(block["rows"], pa.int64()), "ids": encoded.cast(pa.binary())})


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``row, ids``: for every row of ``docs (row long, text)`` its ids as little-endian unsigned
    32-bit integers. ``path`` is the vocabulary file."""
    spark = bounded_batches(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json(path or public_tokenizers.path(VOCABULARY)))
    buckets = min(MAX_BUCKETS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = docs.select("row", "text").mapInArrow(_cut(buckets), _DEALT).repartition("kind", "part")
    answers = dealt.groupBy("kind", "part").applyInArrow(_encode_bucket(vocabulary), _ANSWERS)
    return dealt.groupBy("kind", "part").cogroup(answers.groupBy("kind", "part")).applyInArrow(
        lambda key, blocks, found: _assemble(key, blocks, found), "row long, ids binary"
    )


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters
    for themselves, the other bytes in order for the characters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str | None = None) -> pa.Array:
    """The bytes of every id of a byte-level vocabulary, by id."""
    encoder = chunk_encoder(tokenizer_json(path or public_tokenizers.path(VOCABULARY)))
    vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
    to_byte = _bytes_of_characters()
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        known = all(c in to_byte for c in piece)
        table[number] = bytes(to_byte[c] for c in piece) if known else piece.encode("utf-8")
    return pa.array(table, pa.large_binary())


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with a column ``ids`` as of ``encode``) and the decoded ``text``.

    Bytes that are not UTF-8 become U+FFFD. The table of pieces is broadcast: its size is that of
    the vocabulary.
    """
    shared = bounded_batches(encoded.sparkSession).sparkContext.broadcast(pieces(path))
    columns = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*columns).schema.add("text", "string")
    at = columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, after, data, offsets in slices(batch.column(at), BLOCK_BYTES):
                ids = np.frombuffer(data.tobytes(), "<u4")
                joined = shared.value.take(pa.array(ids))
                _, ends, raw = joined.buffers()
                raw = raw.to_pybytes() if raw is not None else b""
                ends = np.frombuffer(ends, np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
                edges = ends[offsets // 4]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(row, after - row) for c in batch.columns], pa.array(texts, pa.string())],
                    [*batch.schema.names, "text"],
                )
        release_memory()

    return encoded.select(*columns).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` (carried as ``row``), number of ids, and digests of the ids and the decoded text."""
    coded = decode(encode(docs.select(F.col("doc_id").alias("row"), "text")))
    return coded.select(
        F.col("row").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
