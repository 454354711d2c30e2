"""Token ids in binary files by bit-plane shuffling.

A file holds the ids of a range of documents in ascending ``doc_id`` order:

    magic | compressed planes, block by block | footer | footer length (8 bytes) | magic

Ids are cut into blocks of ``BLOCK_IDS``. A block is transposed: plane b holds bit b (or byte b)
of every id, and each plane is compressed with zstandard by itself; planes above the largest id
of the block are not stored. The footer is the chunk index (first byte, number of ids and plane
sizes of every block) and the documents (id and number of ids), compressed.

Files are written by the tasks of a range-partitioned job, under names of their own per attempt;
the manifest, a table written by the same job, names the files of the attempts that counted, so
repeated or lost attempts leave nothing that is read. A prefix sum over the manifest gives each
file the number of ids before it.

Defined results: a null or empty text has only its end id. Rows without ``doc_id`` come first,
repeated ids stand together in the order of their content. An empty table gives no file and an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm.chunks import chunk_dictionary, chunk_encoder, tokenizer_json
from hazardlens.llm.common import bounded_batches, read_table, release_memory, scratch, slices, store, text_key

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
#: Text bytes encoded at once, and bytes of encoded words that a task remembers.
SLICE = 8_000_000
REMEMBERED = 128 << 20


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def planes_of(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, lowest first, up to the highest one in use."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [raw[:, b].tobytes() for b in range(-(-width // 8))]
    planes = []
    for b in range(width):
        planes.append(np.packbits((raw[:, b // 8] >> (b % 8)) & 1).tobytes())
    return planes


def ids_of(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The block that ``planes_of`` took apart."""
    raw = np.zeros((4, n), np.uint8)
    for b, plane in enumerate(planes):
        if kind == "byte":
            raw[b] = np.frombuffer(plane, np.uint8)
        else:
            raw[b // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(b % 8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


class Writer:
    """Writes one file; ids are buffered for a block at most."""

    def __init__(self, stream, kind: str = "bit") -> None:
        self.stream, self.kind = stream, kind
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes += sizes.tolist()
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for start in range(0, whole, BLOCK_IDS):
                self._block(joined[start : start + BLOCK_IDS])
            self.waiting = [joined[whole:]]
            self.held = len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.compressor.compress(p) for p in planes_of(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        for plane in planes:
            self.stream.write(plane)
            self.at += len(plane)
        self.written += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        footer = {"planes": self.kind, "blocks": self.blocks, "doc_ids": self.doc_ids, "sizes": self.sizes}
        packed = self.compressor.compress(json.dumps(footer).encode())
        self.stream.write(packed)
        self.stream.write(len(packed).to_bytes(8, "little"))
        self.stream.write(MAGIC)
        self.stream.close()


def read_footer(file) -> dict:
    size = file.size()
    file.seek(size - 8 - len(MAGIC))
    tail = file.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a file of token planes, or an incomplete one")
    length = int.from_bytes(tail[:8], "little")
    file.seek(size - 8 - len(MAGIC) - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))


def read_blocks(file, footer: dict) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for at, n, sizes in footer["blocks"]:
        file.seek(at)
        yield ids_of([unpack(file.read(s)) for s in sizes], n, footer["planes"])


class RememberingEncoder:
    """Encodes texts with the library, each word once while it is remembered.

    The least recent half of the words is forgotten when they hold too many bytes.
    """

    #: Bytes that a remembered word takes beside its own and those of its ids.
    EACH = 200

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = chunk_encoder(vocabulary)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.recent.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        unknown = []
        for i, ids in zip(missing, map(self.older.get, [words[i] for i in missing])):
            if ids is None:
                unknown.append(i)
            else:
                found[i] = ids
        for i, ids in zip(unknown, self.encoder.encode([words[i] for i in unknown])):
            found[i] = ids
        recent, held, most = self.recent, self.held, REMEMBERED // 2
        for i in missing:
            word, ids = words[i], found[i]
            size = len(word) + len(ids) + self.EACH
            if held + size > most:
                self.older, self.recent, held = recent, {}, 0
                recent = self.recent
            if size <= most:
                recent[word] = ids
                held += size
        self.held = held
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice and each text's number of ids."""
        words, codes, first = chunk_dictionary(data, offsets)
        # One array of Python bytes: a list made by Arrow itself takes several times as long.
        ids = self._ids(words.to_numpy(zero_copy_only=False).tolist())
        _, ends, flat = pa.array(ids, pa.large_binary()).take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(codes) + 1] // 4
        return np.frombuffer(flat or b"", "<u4", ends[-1]), np.diff(ends[first])


_encoders: dict[int, RememberingEncoder] = {}


def _write_files(vocabulary, folder: str, end_id: int | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
        writer = None
        encoder = _encoders.setdefault(hash(vocabulary.value), RememberingEncoder(vocabulary.value))
        for batch in batches:
            for row, after, data, offsets in slices(batch.column(1), SLICE):
                if writer is None:
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    writer = Writer(system.open_output_stream(f"{path}/{name}"), kind)
                ids, sizes = encoder.encode(data, offsets)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                    sizes = sizes + 1
                writer.add(batch.column(0).slice(row, after - row).to_pylist(), sizes, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "file": [name],
                "n_docs": pa.array([len(writer.sizes)], pa.int64()), "n_ids": pa.array([writer.written], pa.int64()),
            })
        release_memory()

    return run


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, planes: str = "bit",
) -> DataFrame:
    """Encode and write ``docs (doc_id, text)``; returns the manifest ``shard, file, n_docs, n_ids, first_id``.

    ``path`` is the vocabulary file; ``end_id`` follows every document; ``planes`` is bit or byte.
    """
    spark = bounded_batches(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json(path or public_tokenizers.path(VOCABULARY)))
    ordered = (
        docs.select("doc_id", "text", text_key().alias("key"))
        .repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
        .select("doc_id", "text")
    )
    written = store(
        ordered.mapInArrow(
            _write_files(vocabulary, f"{folder}/files", end_id, planes),
            "shard long, file string, n_docs long, n_ids long",
        ),
        f"{folder}/written",
    )
    # One row per file: the number of files is that of partitions, not of documents.
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    return store(written.withColumn("first_id", before), f"{folder}/manifest")


def _read_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(f"{folder}/files")
        for batch in batches:
            for file_row in batch.to_pylist():
                with system.open_input_file(f"{path}/{file_row['file']}") as file:
                    footer = read_footer(file)
                    sizes = np.array(footer["sizes"], np.int64)
                    ends = np.cumsum(sizes)
                    checks, check, doc, at = [], 0, 0, 0
                    for ids in read_blocks(file, footer):
                        raw, begin = ids.tobytes(), at
                        at += len(ids)
                        while doc < len(sizes) and ends[doc] <= at:
                            low = max(int(ends[doc] - sizes[doc]), begin)
                            checks.append(zlib.crc32(raw[4 * (low - begin) : 4 * (int(ends[doc]) - begin)], check))
                            check, doc = 0, doc + 1
                        if doc < len(sizes):
                            low = max(int(ends[doc] - sizes[doc]), begin)
                            check = zlib.crc32(raw[4 * (low - begin) :], check)
                    checks += [0] * (len(sizes) - len(checks))  # documents without ids at the end
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(footer["doc_ids"], pa.int64()),
                        pa.array(ends - sizes + file_row["first_id"], pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array(checks, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a manifest."""
    spread = manifest.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(_read_files(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(manifest, folder)
