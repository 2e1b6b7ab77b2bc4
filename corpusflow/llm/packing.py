"""Best-fit packing of documents into token sequences, with certified bin counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vocab
from corpusflow.session import cut_lineage

CAPACITY = 1024
END_ID = 2
BYTE_BPE = "byte_bpe_50k.json"
#: Pieces that one task packs; partitions that meet in an exchange never bring more than this together.
ITEMS = 20_000
FAN_IN = 4

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = BYTE_BPE, end_id: int = END_ID, text: str = "text"
) -> DataFrame:
    """Ids of every document with the end id, cut into pieces of at most ``capacity``.

    A longer document is cut so that all pieces but the first are full. Returns
    doc_id, piece, start, length, ids_crc32. A null or empty text is the end id
    alone; every input row is a document of its own, also with a repeated or
    null doc_id.
    """

    def encode(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(vocab.encode_bytes(vocabulary, text.as_py(), end_id))
                total = len(ids) // 4
                at = 0
                for piece in range(-(-total // capacity)):
                    length = (total - 1) % capacity + 1 if piece == 0 else capacity
                    for column, value in zip(
                        out, (doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True
                    ):
                        column.append(value)
                    at += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(encode, PIECE)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs; ``counts[l]`` is the number of pieces of length l.

    The largest of the volume bound and of two families of dual feasible
    functions: for each e, lengths above capacity - e count as a whole bin,
    lengths below e as nothing, others by volume; for each k, (k + 1) * length
    / capacity rounded down counts in k-ths, exact multiples by volume. All in
    integers.
    """
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.arange(len(counts), dtype=np.int64)
    best = -(-int(counts @ lengths) // capacity)
    for e in range(1, capacity // 2 + 1):
        value = np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths))
        best = max(best, -(-int(counts @ value) // capacity))
    for k in range(1, 21):
        steps = (k + 1) * lengths
        # In units of 1 / (k * capacity) of a bin.
        value = np.where(steps % capacity == 0, lengths * k, steps // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the free space of each bin.

    Bins wait in one stack per free space; a bit mask of the stacks that are
    not empty finds the fullest bin that still takes a piece. Equal lengths are
    taken in input order.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            place = stacks[space].pop()
            if not stacks[space]:
                mask &= ~(1 << space)
        else:
            space, place = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = place, capacity - space
        free[place] = space - length
        stacks[space - length].append(place)
        mask |= 1 << (space - length)
    return bins, offsets, np.array(free, np.int64)


def released(bins: np.ndarray, free: np.ndarray, certified: bool, capacity: int, most: int) -> np.ndarray:
    """Which bins a partition gives back for the exchange, emptiest first.

    A certified partition holds as few bins as its pieces allow, so only its
    emptiest bin can be of use elsewhere; another gives back every bin with a
    gap, as long as no more than ``most`` pieces leave.
    """
    order = np.argsort(-free, kind="stable")
    order = order[free[order] > 0]
    if certified:
        order = order[:1]
    sizes = np.bincount(bins, minlength=len(free))[order]
    return order[np.cumsum(sizes) <= most]


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """Give every piece a sequence and an offset in it, in as few sequences as it can.

    Full pieces are sequences of their own. The others are dealt over partitions
    of about ``items`` pieces and packed best-fit decreasing. A dual-feasible
    lower bound certifies a partition's bin count. Bins with gaps are opened
    again: partitions exchange their pieces (FAN_IN meet in one) and pack them anew,
    until one partition is left. Each exchange brings at most ``items`` pieces
    together.

    Adds sequence_id, offset, round, certified (the piece's partition reached
    its bound). Rows with a null length or a length outside 1..capacity raise an
    error in the task: they cannot be packed. An empty table gives an empty one.
    """
    rows = cut_lineage(
        pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces"
    )  # the written copy holds the ids
    full = rows.filter(F.col("length") == capacity).select(
        "*",
        (-1 - F.col("__id")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(0).alias("round"),
        F.lit(True).alias("certified"),
    )
    waiting = rows.filter(F.col("length").isNull() | (F.col("length") != capacity)).select("__id", "length")
    parts = max(1, -(-waiting.count() // items))
    waiting = waiting.withColumn("part", F.pmod(F.xxhash64("__id"), F.lit(parts)))

    def packed(key, frame):
        frame = frame.sort_values("__id", kind="stable")
        lengths = frame["length"].to_numpy(np.int64)
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, offsets, free = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        give = np.zeros(len(free), bool)
        give[released(bins, free, len(free) == bound, capacity, items // FAN_IN)] = True
        return frame.assign(bin=bins, offset=offsets, open=give[bins], certified=len(free) == bound)[
            ["__id", "length", "part", "bin", "offset", "open", "certified"]
        ]

    shape = "__id long, length long, part long, bin long, offset long, open boolean, certified boolean"
    done = []
    for number in range(1, 100):
        result = cut_lineage(waiting.groupBy("part").applyInPandas(packed, shape), "packed")
        last = parts == 1
        closed = result if last else result.filter(~F.col("open"))
        done.append(
            closed.select(
                "__id",
                (F.lit(number << 56) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id"),
                "offset",
                F.lit(number).alias("round"),
                "certified",
            )
        )
        if last:
            break
        parts = -(-parts // FAN_IN)
        waiting = result.filter("open").select("__id", "length", F.floor(F.col("part") / FAN_IN).alias("part"))
    placed = reduce(DataFrame.unionByName, done)
    others = rows.join(placed, "__id").select(*full.columns)
    return full.unionByName(others).drop("__id")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Documents to packed pieces: ``token_pieces`` and ``pack`` in one."""
    return pack(token_pieces(docs, capacity, vocabulary), capacity)
