"""Removal of repeated word sequences by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.minhash import _WORDS, _mix
from corpusflow.llm.remembered import use
from corpusflow.session import broadcast_if_small, cut_lineage

#: Words of a window, and of the parts whose smallest hash is a window's minimiser.
WINDOW = 50
PART = 12
#: Windows of one minimiser that a task sorts at once; larger buckets are dealt out by window.
BUCKET_WINDOWS = 20_000

_BASE = 0x5851F42D4C957F2D


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: runs between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def super_kmers(words: list[bytes], window: int = WINDOW, part: int = PART) -> list[tuple[int, int, int, int]]:
    """(minimiser, hash of the run's words, first window, windows) of the runs of windows with one minimiser.

    The minimiser is a value: the smallest hash of the window's ``part``-word
    parts. Runs follow each other and cover every window once.
    """
    n = len(words) - window + 1
    if n <= 0:
        return []
    size = 1 << len(words).bit_length()
    up, down = _powers(size)
    h = np.fromiter(map(use(_WORDS).__getitem__, words), np.uint64, len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    low = _mix((sums[part:] - sums[:-part]) * down[: len(h) - part + 1])
    # Sliding minimum over window - part + 1 parts by doubling.
    have, need = 1, window - part + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.append(starts[1:], n)
    run = _mix((sums[ends + window - 1] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    columns = (low[starts].view(np.int64), run.view(np.int64), starts, ends - starts)
    return list(zip(*(c.tolist() for c in columns)))


def _batch(columns: list[list], fields: list[tuple[str, object]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def occurrences(docs: DataFrame, window: int, part: int) -> DataFrame:
    """One row per super-k-mer, without its words: where it stands, its minimiser and the hash of its words."""

    def cut(batches):
        import pyarrow as pa

        fields = [(n, pa.int64()) for n in ("doc_id", "row", "minimiser", "run")] + [(n, pa.int32()) for n in ("first", "windows")]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = super_kmers(words_of(text.as_py()), window, part)
                for column, values in zip(out[2:], zip(*found)):
                    column.extend(values)
                out[0].extend([doc] * len(found))
                out[1].extend([row] * len(found))
            yield _batch(out, fields)

    return docs.mapInArrow(cut, "doc_id long, row long, minimiser long, run long, first int, windows int")


def packed_strings(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted super-k-mers (minimiser, run, lo, doc_id, row, first, windows) as one string each."""
    lists = wanted.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("minimiser", "run", "lo", "first", "windows", "large")).alias("items")
    )  # at most the document's own super-k-mers

    def cut(batches):
        import pyarrow as pa

        fields = [("minimiser", pa.int64()), ("run", pa.int64()), ("lo", pa.int64()), ("large", pa.bool_()), ("packed", pa.binary())]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text, items in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                for x in items.as_py():
                    packed = b" ".join(words[x["first"] : x["first"] + x["windows"] + window - 1])
                    for column, value in zip(out, (x["minimiser"], x["run"], x["lo"], x["large"], packed), strict=True):
                        column.append(value)
            yield _batch(out, fields)

    return docs.join(lists, ["doc_id", "row"]).select("text", "items").mapInArrow(
        cut, "minimiser long, run long, lo long, large boolean, packed binary"
    )


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, each a slice of it."""
    at = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts = [0, *(at + 1).tolist()]
    ends = [*at.tolist(), len(packed)]
    return [packed[a:b] for a, b in zip(starts, ends[window - 1 :])]


def _compared(strings: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, list[int], list[int]]]:
    """(run, ends, smallest doc_ids) of each string's windows, by sorting all windows of a bucket.

    Neighbouring windows with one smallest doc_id are one entry that ends before the given window.
    """
    entries = [(w, lo, s, i) for s, (_, lo, packed) in enumerate(strings) for i, w in enumerate(windows_of(packed, window))]
    entries.sort()
    least: list[dict[int, int]] = [{} for _ in strings]
    before, lo = None, 0
    for w, doc, s, i in entries:
        if w != before:
            before, lo = w, doc
        least[s][i] = lo
    return [(run, *_runs([found[i] for i in range(len(found))])) for (run, _, _), found in zip(strings, least)]


def _runs(values: list[int]) -> tuple[list[int], list[int]]:
    ends: list[int] = []
    kept: list[int] = []
    for end, v in enumerate(values, 1):
        if kept and kept[-1] == v:
            ends[-1] = end
        else:
            kept.append(v)
            ends.append(end)
    return ends, kept


LEAST = "minimiser long, run long, starts array<int>, ends array<int>, least array<long>"


def sorted_buckets(strings: DataFrame, window: int) -> DataFrame:
    """Smallest doc_id of every window, bucket by bucket, for buckets that one task can sort."""

    def compare(batches):
        import pyarrow as pa

        fields = [("minimiser", pa.int64()), ("run", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("least", pa.list_(pa.int64()))]
        at, group = None, []

        def flush(out):
            for run, ends, least in _compared(group, window):
                for column, value in zip(out, (at, run, [0, *ends[:-1]], ends, least), strict=True):
                    column.append(value)

        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for minimiser, run, lo, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if minimiser != at:
                    flush(out)
                    at, group = minimiser, []
                group.append((run, lo, packed))
            yield _batch(out, fields)
        out = [[] for _ in fields]
        flush(out)
        yield _batch(out, fields)

    rows = strings.filter("not large").select("minimiser", "run", "lo", "packed")
    return rows.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(compare, LEAST)


def dealt_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same for large buckets: their windows are grouped as rows, so no task holds a bucket."""

    def explode(batches):
        import pyarrow as pa

        fields = [("minimiser", pa.int64()), ("run", pa.int64()), ("lo", pa.int64()), ("number", pa.int32()), ("words", pa.binary())]
        for batch in batches:
            for minimiser, run, lo, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = windows_of(packed, window)
                for s in range(0, len(found), 10_000):
                    part = found[s : s + 10_000]
                    n = len(part)
                    yield _batch([[minimiser] * n, [run] * n, [lo] * n, list(range(s, s + n)), part], fields)

    rows = strings.filter("large").select("minimiser", "run", "lo", "packed")
    rows = cut_lineage(
        rows.mapInArrow(explode, "minimiser long, run long, lo long, number int, words binary"), "windows"
    )
    least = cut_lineage(rows.groupBy("words").agg(F.min("lo").alias("least")), "least")
    pairs = rows.join(least, "words").select("minimiser", "run", "number", "least")
    lists = pairs.groupBy("minimiser", "run").agg(F.array_sort(F.collect_list(F.struct("number", "least"))).alias("w"))
    return lists.select(
        "minimiser", "run", F.col("w.number").alias("starts"),
        F.transform("w", lambda x: x["number"] + 1).alias("ends"), F.col("w.least").alias("least"),
    )


def covered(docs: DataFrame, window: int = WINDOW, part: int = PART, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Word ranges of each document (doc_id, row, ranges) that a window of a document with a smaller doc_id covers.

    1. Documents are cut into super-k-mers; one row each, with hashes only.
    2. A minimiser that stands in one document only cannot hold a repeated
       window of another; its rows end here.
    3. Equal super-k-mers (same minimiser, same words) are one row with their
       smallest doc_id, so copies cost nothing more. If a minimiser has one such
       row, that doc_id holds for all its windows.
    4. Of the others, one packed string per distinct super-k-mer travels to its
       minimiser's bucket, where its windows are sorted. Buckets above
       ``bucket_windows`` are dealt out by window instead, with the same result.
    """
    found = cut_lineage(occurrences(docs.filter("doc_id is not null"), window, part), "kmers")
    several = found.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    several = cut_lineage(several.filter("lo < hi").select("minimiser"), "several")
    found = cut_lineage(found.join(several, "minimiser", "left_semi"), "shared")
    distinct = found.groupBy("minimiser", "run").agg(F.min(F.struct("doc_id", "row", "first", "windows")).alias("m"))
    distinct = cut_lineage(distinct.select("minimiser", "run", F.col("m.doc_id").alias("lo"), "m.*"), "distinct")
    bucket = distinct.groupBy("minimiser").agg(F.count("*").alias("strings"), F.sum("windows").alias("all"))
    bucket = cut_lineage(bucket.filter("strings > 1").select("minimiser", (F.col("all") > bucket_windows).alias("large")), "mixed")
    wanted = distinct.join(bucket, "minimiser")
    strings = cut_lineage(packed_strings(docs, wanted, window), "strings")
    single = distinct.join(bucket, "minimiser", "left_anti").select(
        "minimiser", "run", F.array(F.lit(0)).alias("starts"), F.array("windows").alias("ends"), F.array("lo").alias("least")
    )
    least = cut_lineage(sorted_buckets(strings, window), "sorted")
    dealt = cut_lineage(dealt_windows(strings, window), "dealt")
    least = cut_lineage(single.unionByName(least).unionByName(dealt), "least")
    spans = F.transform(
        F.arrays_zip("starts", "ends", "least"),
        lambda x: F.struct(
            (F.col("first") + x["starts"]).alias("start"),
            (F.col("first") + x["ends"] + window - 1).alias("end"),
            x["least"].alias("least"),
        ),
    )
    hits = found.join(least, ["minimiser", "run"])
    hits = hits.select("doc_id", "row", F.filter(spans, lambda x: x["least"] < F.col("doc_id")).alias("spans"))
    hits = hits.filter(F.size("spans") > 0).select(
        "doc_id", "row", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans")
    )
    return hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("ranges"))


def _once(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, row, text) with one of each (doc_id, row); only texts of repeated ones are shuffled."""
    twice = rows.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id", "row")
    twice = cut_lineage(twice, "twice")
    if twice.isEmpty():
        return rows
    side = broadcast_if_small(twice)
    merged = rows.join(side, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.min("text").alias("text"))
    return rows.join(side, ["doc_id", "row"], "left_anti").unionByName(cut_lineage(merged, "merged"))


def without_repeats(docs: DataFrame, window: int = WINDOW, part: int = PART, text: str = "text", **options) -> DataFrame:
    """Documents without the words that a window of a document with a smaller doc_id covers.

    A window is ``window`` consecutive words; a word goes if it lies in a window
    whose words also start somewhere in a document with a smaller doc_id,
    judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 and
    kept (the kept words joined by one space), one row per input row. Null or
    empty texts and texts shorter than a window lose nothing; rows with a null
    doc_id lose nothing and remove nothing; repeated rows are treated alike and
    searched once, a row never loses words to rows of the same doc_id. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text")).select("doc_id", "row", "text")
    ranges = cut_lineage(covered(_once(rows), window, part, **options), "ranges")

    def keep(batches):
        import hashlib

        import pyarrow as pa

        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words, spans = words_of(text.as_py()), spans.as_py()
                kept = words
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in spans], 1)
                    np.add.at(change, [s["end"] for s in spans], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                joined = b" ".join(kept)
                row = (doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass"))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield _batch(out, fields)

    joined = rows.join(ranges, ["doc_id", "row"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
