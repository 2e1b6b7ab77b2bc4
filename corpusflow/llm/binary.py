"""Token ids in bit-packed files, with block offsets for random access."""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vocab
from corpusflow.operators.windows import running_sums
from corpusflow.session import broadcast_if_small, cut_lineage, scratch_path

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: Ids of one block; blocks of a file are independent of each other.
BLOCK_IDS = 65_536
#: A task starts another file when one holds so many ids.
FILE_IDS = 16_777_216
MAGIC = b"IDPACK01"


def id_bits(vocabulary_size: int) -> int:
    """Smallest width that holds every id below ``vocabulary_size``."""
    return max(1, (max(vocabulary_size, 1) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, most significant bit first, padded with zeros to a whole byte."""
    ids = np.asarray(ids, np.uint32)
    if bits in (8, 16, 32):  # whole bytes: the same layout without single bits
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, without unpacking the bits before them."""
    if not count:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low, high = first * bits, (first + count) * bits
    raw = np.unpackbits(np.frombuffer(data, np.uint8)[low // 8 : -(-high // 8)])[low % 8 :][: count * bits]
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.float64)
    return (raw.reshape(count, bits) @ weights).astype(np.uint32)


def _filesystem(uri: str):
    """File system and path of a folder: local, HDFS or object store, by the URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class Writer:
    """One file: head (magic, bits, ids per block), packed blocks, table of block offsets, tail."""

    def __init__(self, folder: str, bits: int, block_ids: int = BLOCK_IDS):
        self.fs, path = _filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        # A name of its own for every attempt: a repeated task never touches another's file.
        self.name = f"{uuid.uuid4().hex}.ids"
        self.path, self.bits, self.block_ids = f"{path}/{self.name}", bits, block_ids
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC + struct.pack("<II", bits, block_ids))
        self.at, self.offsets, self.total, self.waiting, self.held = 16, [16], 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for start in range(0, end, self.block_ids):
            data = pack_bits(ids[start : min(start + self.block_ids, end)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + struct.pack("<QQ", self.total, len(self.offsets) - 1))
        self.out.close()


class Reader:
    """Random access to one file: only the blocks that hold the wanted ids are read."""

    def __init__(self, folder: str, name: str):
        self.fs, path = _filesystem(folder)
        self.file = self.fs.open_input_file(f"{path}/{name}")
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no id file")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        size = self.file.size()
        self.total, blocks = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.offsets = np.frombuffer(self.file.read_at(8 * (blocks + 1), size - 16 - 8 * (blocks + 1)), "<u8").astype(np.int64)
        self.block: tuple[int, bytes] = (-1, b"")

    def ids(self, start: int, count: int) -> np.ndarray:
        if start < 0 or start + count > self.total:
            raise ValueError("ids outside the file")
        out = []
        while count:
            number, first = divmod(start, self.block_ids)
            if self.block[0] != number:
                low, high = int(self.offsets[number]), int(self.offsets[number + 1])
                self.block = number, self.file.read_at(high - low, low)
            n = min(count, self.block_ids - first)
            out.append(unpack_bits(self.block[1], self.bits, first, n))
            start, count = start + n, count - n
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.file.close()


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str = WORD_BPE, end_id: int = END_ID, text: str = "text",
    block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the index.

    Documents are dealt over tasks by ranges of doc_id and sorted in them (null
    doc_ids first, equal ones by text). Every task writes its own files into
    ``folder``, which all executors must reach, and the index tells for each
    document its file, the place in it and its length, and how the files follow
    each other: a file's number is its first document's number among all.
    The index is written to the shared folder before it is returned, so files of
    lost or repeated attempts are never named in it. Null or empty texts are the
    end id alone. An empty table writes nothing and gives an empty index.
    """
    bits = id_bits(max(vocab.load(vocabulary).get_vocab(with_added_tokens=True).values()) + 1)
    if end_id >= 1 << bits:
        raise ValueError("the end id is outside the vocabulary")
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    # Only the ids are read to place the ranges; equal ids stay together.
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, writer, files = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(vocab.encode_bytes(vocabulary, value.as_py(), end_id), "<u4")
                if writer is None or writer.total >= file_ids:
                    if writer is not None:
                        writer.close()
                        files += 1
                    writer = Writer(folder, bits, block_ids)
                row = (doc, writer.name, (task << 24) + files, writer.total, len(ids))
                writer.add(ids)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "file", "number", "place", "n_tokens"]
            )
        if writer is not None:
            writer.close()

    shape = "doc_id long, file string, number long, place long, n_tokens long"
    return cut_lineage(dealt.mapInArrow(write, shape), "index")


def file_starts(index: DataFrame) -> DataFrame:
    """file and before: ids in all files before it, in the order of the documents.

    One row per file enters; blocks of file numbers are summed first, so no
    task orders the files of more than one block.
    """
    sizes = index.groupBy("file", "number").agg(F.sum("n_tokens").alias("size")).withColumn("all", F.lit(0))
    summed = running_sums(sizes, ["all"], "number", {"upto": F.col("size")})
    return summed.select("file", (F.col("upto") - F.col("size")).alias("before"))


def read_ids(index: DataFrame, folder: str, starts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves."""

    def read(batches):
        import zlib

        import pyarrow as pa

        reader, name = None, None
        for batch in batches:
            crcs = []
            for file, place, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if file != name:
                    if reader is not None:
                        reader.close()
                    reader, name = Reader(folder, file), file
                crcs.append(zlib.crc32(reader.ids(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(crcs, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"]
            )
        if reader is not None:
            reader.close()

    rows = index.select("doc_id", "file", "place", "n_tokens").mapInArrow(
        read, "doc_id long, file string, place long, n_tokens long, ids_crc32 long"
    )
    return rows.join(broadcast_if_small(starts), "file").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents' ids and describe each document from the files read back.

    ``folder`` defaults to a new one in the shared folder. Returns doc_id,
    start (ids of all documents before), n_tokens (with the end id), ids_crc32.
    """
    folder = folder or scratch_path(docs.sparkSession, "ids")
    index = write_ids(docs, folder, vocabulary, end_id)
    return read_ids(index, folder, cut_lineage(file_starts(index), "starts"))
