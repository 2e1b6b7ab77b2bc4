"""Exact and near duplicates.

Near duplicates are 64-bit signatures within a Hamming distance ``d``. Equal
signatures are merged first, so a signature shared by many rows counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, LongType, StructField, StructType

from corpusflow.functions.batches import steps_of, words_of
from corpusflow.functions.hashing import BITS, hamming
from corpusflow.functions.text import spaced
from corpusflow.operators.components import TASK_EDGES, components
from corpusflow.session import cut_lineage, is_small

# A bucket of candidate signatures larger than this is divided by further bits.
BUCKET_ROWS = 1000
# More masks than this copy each signature too often; blocks of signatures are compared instead.
MAX_MASKS = 128
BLOCK_ROWS = 4096
# A key with more rows than this is joined by broadcast, apart from the others.
HOT_ROWS = 1_000_000
# Directories per mask of a stored band index.
BAND_SHARES = 4
# Words counted, and words told apart, together in a task; words remembered by a worker, and the longest of them.
STEP_WORDS = 50_000
DICTIONARY_WORDS = 200_000
KNOWN_WORDS = 200_000
WORD_CHARS = 64
# Rows whose words a task holds together.
STEP_ROWS = 4096


def first_per_hash(files: DataFrame, key: str, file_hash: str = "file_hash") -> DataFrame:
    """One row per hash with the smallest key; copies are merged before the shuffle."""
    return files.groupBy(file_hash).agg(F.min(key).alias(key))


def new_files(files: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """file_hash and key of files that are neither registered nor copies within the batch."""
    return first_per_hash(files, key).join(registry.select("file_hash"), "file_hash", "left_anti")


class _Digests(dict):
    """First 8 bytes of a word's MD5; short words are remembered, up to a bound in entries and so in bytes."""

    def __missing__(self, word: str) -> bytes:
        value = hashlib.md5(word.encode()).digest()[:8]
        if len(word) <= WORD_CHARS:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


_DIGESTS = _Digests()


def _bit_counts(tokens) -> tuple[np.ndarray, np.ndarray]:
    """Per row of an Arrow list array, the number of words whose hash has bit i set (rows by 64), and the number of words."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _counts_of(tokens.flatten(), lengths), lengths


def _counts_of(words, lengths: np.ndarray) -> np.ndarray:
    """``_bit_counts`` of rows whose words follow each other in an Arrow array."""
    counts = np.zeros((len(lengths), BITS), np.int64)
    ends = np.cumsum(lengths)
    for begin in range(0, len(words), DICTIONARY_WORDS):
        part = words.slice(begin, DICTIONARY_WORDS).dictionary_encode()
        known = b"".join(map(_DIGESTS.__getitem__, part.dictionary.to_numpy(zero_copy_only=False)))
        bits = np.unpackbits(np.frombuffer(known, np.uint8).reshape(-1, 8), axis=1)[:, ::-1]
        # Four counts of 16 bits share a number; STEP_WORDS words fit in them.
        lanes = np.ascontiguousarray(bits, np.uint16).view(np.uint64)
        places = part.indices.to_numpy()
        for at in range(0, len(places), STEP_WORDS):
            step = lanes[places[at : at + STEP_WORDS]]
            lo = begin + at
            # Rows with words in the step; the first and the last may have more outside.
            rows = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, lo + len(step)) + 1)
            rows = rows[lengths[rows] > 0]
            counts[rows] += np.add.reduceat(step, np.maximum(ends[rows] - lengths[rows] - lo, 0), axis=0).view(np.uint16)
    return counts


def _signatures(counts: np.ndarray):
    """Signatures as an Arrow array: the bits whose component exceeds the mean of all."""
    import pyarrow as pa

    bits = (counts * BITS > counts.sum(axis=1, keepdims=True)).astype(np.uint8)
    return pa.array(np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel(), pa.int64())


def _vectors(counts: np.ndarray, lengths: np.ndarray):
    """Per row and bit, the share of words with the bit set less the share without, as an Arrow array of lists."""
    import pyarrow as pa

    shares = 2.0 * counts / np.maximum(lengths, 1)[:, None] - 1.0
    shares[lengths == 0] = 0.0
    return pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, BITS), pa.int32()), pa.array(shares.ravel()))


def _from_words(rows: DataFrame, keep: list[str], text: str, fields: list[tuple[str, DataType]], make: Callable) -> DataFrame:
    """The columns ``keep`` and the ``fields`` that ``make`` (bit counts, numbers of words) gives; a task holds the words of a few rows."""
    n = len(keep)

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for start, size in steps_of(batch.column(n), STEP_ROWS):
                part = batch.slice(start, size)
                words, lengths = words_of(part.column(n))
                columns = make(_counts_of(words, lengths), lengths)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns], [*keep, *(name for name, _ in fields)])

    used = rows.select(*keep, spaced(F.lower(F.col(text))).alias("__words"))
    return used.mapInArrow(made, StructType([*used.schema.fields[:n], *(StructField(*field) for field in fields)]))


def projected_signature(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, signature from word counts: a text embedder that needs no model.

    The vector has one component per bit of a 64-bit word hash: the number of
    words with the bit set minus the number without. As for any vector, a bit of
    the signature is set when its component exceeds the mean. A text without
    words has signature 0. Each text is one row of a batch; no word is shuffled.
    """
    return _from_words(docs, [key], text, [("signature", LongType())], lambda counts, _: [_signatures(counts)])


def with_signature(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs``, ``signature`` as ``projected_signature`` gives it and ``word_bits``.

    ``word_bits`` holds the word counts behind it for ``projected_vector``: the
    number of words, then the number with each bit set, as unsigned 32-bit integers.
    """

    def columns(counts: np.ndarray, lengths: np.ndarray) -> list:
        import pyarrow as pa

        held = np.concatenate([lengths[:, None], counts], axis=1).astype("<u4")
        ends = np.arange(len(lengths) + 1, dtype=np.int32) * np.int32(4 * (BITS + 1))
        return [_signatures(counts), pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(held)])]

    return _from_words(docs, docs.columns, text, [("signature", LongType()), ("word_bits", BinaryType())], columns)


def projected_vector(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, embedding: the vector behind ``projected_signature``, per word, as an embedder that needs no model.

    Component i is the share of words whose hash has bit i set, less the share
    without. A text without words is the zero vector. Rows from ``with_signature``
    have their words counted already.
    """
    kind = ArrayType(DoubleType())
    if "word_bits" not in chunks.columns:
        return _from_words(chunks, [key], text, [("embedding", kind)], lambda counts, lengths: [_vectors(counts, lengths)])

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                held = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, BITS + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), _vectors(held[:, 1:], held[:, 0])], [key, "embedding"])

    used = chunks.select(key, "word_bits")
    return used.mapInArrow(counted, StructType([used.schema[0], StructField("embedding", kind)]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _groups(bits: list[int], n: int) -> list[int]:
    """Bit positions divided into n runs, each as a mask."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def start_masks(n_rows: int, d: int) -> list[int]:
    """Bit masks such that two signatures within distance d agree on at least one of them.

    With the bits in m blocks, d differing bits leave m - d blocks untouched, so
    every choice of m - d blocks is one mask. More blocks give wider masks; the
    smallest m is taken whose masks have a part for each of that many rows.
    Signatures of texts are far from evenly spread, so fewer parts would leave
    many rows, and the square of them in pairs, to a part.
    """
    for m in range(d + 1, d + 5):
        if (m - d) * BITS / m >= min(n_rows, 1 << 40).bit_length():
            break
    blocks = _groups(list(range(BITS)), m)
    return [sum(chosen) for chosen in combinations(blocks, m - d)]


def finer_masks(mask: int, d: int) -> list[int]:
    """Masks for rows that agree on ``mask``: one of d + 1 groups of the other bits agrees as well.

    None when the groups would be narrower than 4 bits: dividing then copies
    more than it separates, and the few free bits bound the bucket by
    themselves (15 bits, hence 32,768 signatures, for d = 3).
    """
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | g for g in _groups(free, d + 1)] if len(free) >= 4 * (d + 1) else []


def _masked(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.withColumn("mask", F.explode(masks)).withColumn("part", F.col("signature").bitwiseAND(F.col("mask")))


def candidate_buckets(signatures: DataFrame, d: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """Rows of ``signatures`` with (mask, part) buckets in which all close pairs meet.

    Buckets above ``limit`` rows are divided by more bits until they are small
    enough or hold close signatures only.
    """
    masks = start_masks(signatures.count(), d)
    rows = _masked(signatures, F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    done = []
    while True:
        finer = {m: finer_masks(m, d) for m in masks}
        finer = {m: f for m, f in finer.items() if f}
        divisible = F.col("mask").isin([_signed(m) for m in finer])
        sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("n"))
        hot = cut_lineage(sizes.filter((F.col("n") > limit) & divisible).drop("n"), "hot-buckets")
        hot_masks = {r["mask"] for r in hot.select("mask").distinct().collect()}
        finer = {m: f for m, f in finer.items() if _signed(m) in hot_masks}
        if not finer:
            done.append(rows)
            break
        done.append(rows.join(hot, ["mask", "part"], "left_anti"))
        table = F.create_map(
            *[x for m, f in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(v)).cast("long") for v in f]))]
        )
        split = rows.join(hot, ["mask", "part"], "left_semi").withColumn("finer", table[F.col("mask")])
        rows = _masked(split.drop("mask", "part"), F.col("finer")).drop("finer")
        masks = sorted({v for f in finer.values() for v in f})
    if len(done) == 1:
        return done[0]
    # Written out, so that no later step relies on how the union is partitioned.
    union = done[0]
    for more in done[1:]:
        union = union.unionByName(more)
    return cut_lineage(union, "buckets")


def _block_pairs(signatures: DataFrame, d: int, block: int = BLOCK_ROWS) -> DataFrame:
    """sig_a < sig_b of all signatures within d, each block of rows compared with each block.

    For distances at which bit masks separate nothing. The work is quadratic,
    in bit operations on blocks of about ``block`` signatures; only pairs within
    d leave a task.
    """
    n = max(1, -(-signatures.count() // block))
    own = F.pmod(F.xxhash64("signature"), F.lit(n))
    dealt = signatures.select("signature", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("met"))
    dealt = dealt.select("signature", "own", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.sort(frame.loc[frame["own"] == k, "signature"].to_numpy()) for k in key)
        found = []
        for start in range(0, len(low), 256):
            part = low[start : start + 256]
            near = np.bitwise_count((part[:, None] ^ high).view(np.uint64)) <= d
            i, j = np.nonzero(near)
            pairs = np.stack([part[i], high[j]], 1)
            found.append(pairs[pairs[:, 0] < pairs[:, 1]] if key[0] == key[1] else np.sort(pairs, 1))
        return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["sig_a", "sig_b"])

    return dealt.groupBy("low", "high").applyInPandas(compare, "sig_a long, sig_b long")


def close_pairs(signatures: DataFrame, d: int, limit: int = BUCKET_ROWS, max_masks: int = MAX_MASKS) -> DataFrame:
    """first, second, distance of distinct signatures within d, first < second by ``ord``.

    ``signatures``: ord, signature (both unique). For d = 3 a signature has at
    most 43,744 others within reach, which bounds the pairs per row. Where more
    than ``max_masks`` bit masks would be needed (from d = 6 on), all blocks of
    signatures are compared instead.
    """
    if comb(d + 4, d) > max_masks:
        pairs = _block_pairs(signatures, d)
    else:
        # Only signatures are copied into buckets; the few pairs found get their rows afterwards.
        buckets = candidate_buckets(signatures.select("signature"), d, limit)
        a, b = (buckets.select("mask", "part", F.col("signature").alias(f"sig_{x}")) for x in "ab")
        close = (F.col("sig_a") < F.col("sig_b")) & (hamming(F.col("sig_a"), F.col("sig_b")) <= d)
        # The planner sees the size before the copies; a side is never small enough to broadcast because of that.
        met = a.join(b.hint("merge"), ["mask", "part"])
        pairs = cut_lineage(met.filter(close).select("sig_a", "sig_b").distinct(), "pairs")
    a, b = (signatures.select(F.col("ord").alias(f"ord_{x}"), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    rows = pairs.join(a, "sig_a").join(b, "sig_b")
    distance = hamming(F.col("sig_a"), F.col("sig_b"))
    return rows.select(
        F.least("ord_a", "ord_b").alias("first"), F.greatest("ord_a", "ord_b").alias("second"), distance.alias("distance")
    )


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between numbers that are ordered like the rows, and the row of each number."""
    nodes = edges.select(F.col("first").alias("ord")).unionByName(edges.select(F.col("second").alias("ord"))).distinct()
    # Partitions of a sorted table follow each other, and so do the numbers.
    names = cut_lineage(nodes.orderBy("ord").withColumn("id", F.monotonically_increasing_id()), "numbers")
    by_end = [names.select(F.col("ord").alias(end), F.col("id").alias(f"{end}_id")) for end in ("first", "second")]
    pairs = edges.select("first", "second").join(by_end[0], "first").join(by_end[1], "second")
    return cut_lineage(pairs.select(F.col("first_id").alias("first"), F.col("second_id").alias("second")), "edges"), names


def _settled(edges: DataFrame, parts: int) -> DataFrame:
    """id of the rows dropped, whole components per task: edges in order, the later end goes if the earlier one stays."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", "second"])
        gone: set[int] = set()
        for first, second in zip(frame["first"].tolist(), frame["second"].tolist()):
            if first not in gone:
                gone.add(second)
        return pd.DataFrame({"id": pd.Series(sorted(gone), dtype="int64")})

    dealt = edges.withColumn("part", F.pmod(F.xxhash64("comp"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(settle, "id long")


def _settled_in_rounds(edges: DataFrame) -> list[DataFrame]:
    """id of the rows dropped, as one table a round; for a component that no task can hold.

    Each round settles the rows without an earlier open neighbour: they stay,
    and their later neighbours go. Rounds end when no edge between open rows is
    left. Rounds work on edges only and are written to the shared folder.
    """
    open_edges = cut_lineage(edges.select("first", "second"), "edges")
    dropped: list[DataFrame] = []
    while not open_edges.isEmpty():
        heads = open_edges.select(F.col("first").alias("id")).distinct().join(
            open_edges.select(F.col("second").alias("id")).distinct(), "id", "left_anti"
        )
        gone = cut_lineage(
            open_edges.join(heads.withColumnRenamed("id", "first"), "first", "left_semi").select(F.col("second").alias("id")).distinct(),
            "dropped",
        )
        dropped.append(gone)
        rest = open_edges.join(gone.withColumnRenamed("id", "first"), "first", "left_anti")
        open_edges = cut_lineage(rest.join(gone.withColumnRenamed("id", "second"), "second", "left_anti"), "edges")
    return dropped


def greedy_dropped(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """ord of the rows dropped when, in order, a row stays iff no earlier row that stays is close.

    Components of the edges are independent. Those of up to ``task_edges`` edges
    are settled inside one task each, many of them together, whatever the length
    of their chains; only a larger component is settled in rounds.
    """
    edges = cut_lineage(edges.select("first", "second"), "close-edges")
    n = edges.count()
    if n == 0:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("first").alias("ord")).schema)
    numbered, names = _numbered(edges)
    if n <= task_edges:
        gone = [_settled(numbered.withColumn("comp", F.lit(0)), 1)]
    else:
        labels = components(numbered, task_edges).select(F.col("node").alias("first"), "comp")
        placed = cut_lineage(numbered.join(labels, "first"), "placed")
        large = placed.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > task_edges).select("comp")
        large = cut_lineage(large, "large")
        side = F.broadcast(large) if is_small(large) else large
        gone = [cut_lineage(_settled(placed.join(side, "comp", "left_anti"), -(-n // task_edges)), "settled")]
        gone += _settled_in_rounds(placed.join(side, "comp", "left_semi"))
    result = gone[0]
    for more in gone[1:]:
        result = result.unionByName(more)
    return cut_lineage(cut_lineage(result, "dropped").join(names, "id").select("ord"), "dropped")


def join_hot(rows: DataFrame, unique: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on a key that is unique in ``unique``, where a few keys may hold most rows.

    Keys with many rows are few; they are broadcast, so their rows stay where
    they are. The other keys are joined by shuffle.
    """
    hot = unique.filter(F.col(n) > hot_rows)
    if hot.isEmpty() or not is_small(hot):
        return rows.join(unique, key)
    hot = F.broadcast(hot)
    cold_rows = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(unique.filter(F.col(n) <= hot_rows), key))


def near_duplicates(
    rows: DataFrame, d: int, seen: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    limit: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """ord, signature, duplicate_of, known. A row stays when duplicate_of is NULL and known is false.

    ``rows``: ord (unique), signature. duplicate_of is the earliest row that
    stays and is within d. ``seen`` holds signatures that stayed in earlier
    runs, or finds the ord of the rows close to one of them; known marks these.
    """
    merged = cut_lineage(
        rows.groupBy("signature").agg(F.min("ord").alias("ord"), F.count("*").alias("n")), "signatures"
    )
    fresh = merged.select("ord", "signature")
    known = fresh.limit(0).select("ord")
    if seen is not None:
        found = seen(fresh) if callable(seen) else close_to_seen(fresh, seen.select("signature").distinct(), d, limit)
        known = cut_lineage(found, "known")
        fresh = fresh.join(known, "ord", "left_anti")
    edges = cut_lineage(close_pairs(fresh, d, limit), "close-pairs")
    dropped = greedy_dropped(edges)
    kept_edges = edges.join(dropped.withColumnRenamed("ord", "first"), "first", "left_anti")
    keeper = kept_edges.groupBy(F.col("second").alias("ord")).agg(F.min("first").alias("keeper"))
    verdict = (
        merged.join(keeper, "ord", "left")
        .join(known.withColumn("known", F.lit(True)), "ord", "left")
        .select("signature", "n", F.col("ord").alias("rep"), "keeper", F.coalesce("known", F.lit(False)).alias("known"))
    )
    joined = join_hot(rows.select("ord", "signature"), cut_lineage(verdict, "verdicts"), "signature", "n", hot_rows)
    copy = F.when((F.col("ord") != F.col("rep")) & ~F.col("known"), F.col("rep"))
    return joined.select("ord", "signature", F.coalesce("keeper", copy).alias("duplicate_of"), "known")


def close_to_seen(fresh: DataFrame, seen: DataFrame, d: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """ord of the rows within d of a signature in ``seen``.

    A small batch is broadcast in its buckets and the stored signatures are
    only scanned; otherwise both sides meet in buckets of limited size.
    """
    masks = start_masks(seen.count(), d)
    as_array = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    new = _masked(fresh, as_array)
    if is_small(new):
        new, old = F.broadcast(new), _masked(seen.select("signature"), as_array)
    else:
        nobody = F.lit(None).cast(fresh.schema["ord"].dataType).alias("ord")
        both = fresh.select("ord", "signature").unionByName(seen.select(nobody, "signature"))
        buckets = cut_lineage(candidate_buckets(cut_lineage(both, "both-sides"), d, limit), "buckets")
        new, old = buckets.filter(F.col("ord").isNotNull()), buckets.filter(F.col("ord").isNull())
    new = new.select("mask", "part", "ord", F.col("signature").alias("sig_a"))
    close = old.select("mask", "part", F.col("signature").alias("sig_b")).join(new, ["mask", "part"])
    return close.filter(hamming(F.col("sig_a"), F.col("sig_b")) <= d).select("ord").distinct()


def band_masks(d: int) -> list[int]:
    """Masks of a stored band index, the same at every size: two of d + 2 blocks of bits.

    Signatures within d agree on at least one of them. None when they would be
    too many and too narrow (from d = 15 on).
    """
    return [sum(pair) for pair in combinations(_groups(list(range(BITS)), d + 2), 2)] if comb(d + 2, 2) <= MAX_MASKS else []


def band_rows(signatures: DataFrame, d: int) -> DataFrame:
    """The columns of ``signatures`` with band and part, one row per mask; a band is a mask and a share of its parts."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in band_masks(d)])
    rows = signatures.select("*", F.posexplode(masks).alias("number", "mask"))
    rows = rows.withColumn("part", F.col("signature").bitwiseAND(F.col("mask")))
    share = F.pmod(F.xxhash64("part"), F.lit(BAND_SHARES)).cast("int")
    return rows.withColumn("band", F.col("number") * BAND_SHARES + share).drop("number", "mask")


def close_to_bands(fresh: DataFrame, bands: DataFrame, d: int) -> DataFrame:
    """ord of the rows of ``fresh`` (ord, signature) within d of a signature in a stored band index.

    ``bands`` (band, part, signature) is divided by band. Only the bands that the
    rows fall into are read, and stored signatures are neither masked nor copied.
    """
    asked = cut_lineage(band_rows(fresh.select("ord", "signature"), d), "asked")
    touched = [r.band for r in asked.select("band").distinct().collect()]  # at most masks times shares
    stored = bands.filter(F.col("band").isin(touched)).select("band", "part", F.col("signature").alias("seen"))
    side = F.broadcast(asked) if is_small(asked) else asked
    met = stored.join(side, ["band", "part"])
    return met.filter(hamming(F.col("signature"), F.col("seen")) <= d).select("ord").distinct()


def chunk_ordinal(doc_id: Column, chunk_idx: Column) -> Column:
    """Order of a chunk among all chunks: by document, then by place in it. Any numbers fit."""
    return F.struct(doc_id.alias("doc_id"), chunk_idx.alias("chunk_idx"))


def chunk_key(doc_id: Column, chunk_idx: Column) -> Column:
    """64-bit key of a chunk."""
    return F.xxhash64(doc_id, chunk_idx)
