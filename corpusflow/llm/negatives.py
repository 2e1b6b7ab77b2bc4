"""Hard negatives by lists that the anchors of a cluster share, walked until no later candidate can matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import broadcast_if_small, cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative must reach and may not exceed.
LOW, HIGH = 50, 95
#: Clusters of anchors, fitted on at most so many anchors.
CLUSTERS = 8
SAMPLE = 2_048
#: Anchors of a cell (a part of a cluster) and candidates of a block; a task joins one with one.
CELL = 1_024
BLOCK = 2_048
#: Candidates multiplied at once while a list is walked.
STRIDE = 256


def prepared(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v = floor(scale * x) of the rows that take part.

    Rows with a null vec_id, label or vector, or with a null, NaN or infinite
    component are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(finite)
    return whole.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
    )


def _directions(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def centres(sample: list[list[float]], clusters: int) -> dict[int, np.ndarray]:
    """Unit cluster centres by vector length, from a bounded sample of anchors (spherical k-means, ten rounds)."""
    found = {}
    for size in {len(v) for v in sample if len(v)}:
        units = _directions(np.array([v for v in sample if len(v) == size], np.float64))
        held = units[:: max(1, len(units) // clusters)][:clusters].copy()
        for _ in range(10):
            own = (units @ held.T).argmax(axis=1)
            for i in range(len(held)):
                if (own == i).any():
                    held[i] = units[own == i].sum(axis=0)
            held = _directions(held)
        found[size] = held
    return found


def _numbers(matrix: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers as bytes of the narrowest type that holds it."""
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def _products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whole inner products: doubles while every sum is exact, Python integers beyond."""
    if np.abs(rows).max(initial=0) * np.abs(others).max(initial=0) * max(rows.shape[1], 1) < 2**53:
        return rows @ others.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(rows) @ whole(others).T


def _bounds(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What a candidate's product with any anchor of the cell, divided by the anchor's length, cannot exceed.

    The angle to an anchor is at least the angle to the cell's centre less the
    cell's widest angle. Margins cover the rounding of angles.
    """
    units = _directions(anchors)
    centre = units.sum(axis=0)
    size = np.linalg.norm(centre)
    norms = np.linalg.norm(vectors, axis=1)
    if not size:
        return norms * (1 + 1e-9)
    centre /= size
    angle = lambda m: np.arccos(np.clip(m @ centre, -1, 1))
    widest = angle(units).max() if (np.linalg.norm(anchors, axis=1) > 0).all() else np.pi
    nearest = np.clip(angle(_directions(vectors)) - widest - 1e-6, 0, np.pi)
    return norms * (np.cos(nearest) + 1e-9)


def _best(held: tuple, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of the held and the new entries of each anchor; ties go to the smaller id."""
    a, i, s = (np.concatenate(x) for x in zip(held, (anchor, ids, score)))
    order = np.lexsort((i, -s, a)) if len(a) else np.zeros(0, np.int64)
    a, i, s = a[order], i[order], s[order]
    first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[first], i[first], s[first]


def walked(anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool,
           vectors: np.ndarray, ids: np.ndarray, marks: np.ndarray, k: int) -> tuple[list[tuple], int]:
    """Entries (anchor row, vec_id, score) of each target, and the number of products that were made.

    ``low`` and ``high`` hold a score range per anchor and target (NaN: no such
    target). The candidates are sorted once by their bound. An anchor walks down
    until the next bound cannot reach any of its targets: below the range, or
    below the k entries it has.
    """
    bound = _bounds(anchors, vectors)
    order = np.argsort(-bound, kind="stable")
    bound, vectors, ids, marks = bound[order], vectors[order], ids[order], marks[order]
    lengths, targets = np.linalg.norm(anchors, axis=1), low.shape[1]
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    held = [empty] * targets
    open_low = np.where(np.isnan(low.astype(np.float64)), np.inf, low.astype(np.float64))
    needed, made = open_low.copy(), 0
    for start in range(0, len(ids), STRIDE):
        most = lengths * bound[start] * (1 + 1e-9) + 1e-6
        going = np.flatnonzero(most >= needed.min(axis=1)) if targets else []
        if not len(going):
            break
        part = slice(start, start + STRIDE)
        score = _products(anchors[going], vectors[part])
        made += score.size
        fits = (labels[going, None] == marks[None, part]) == same
        fits &= own[going, None] != ids[None, part]
        for t in range(targets):
            inside = fits & (score >= needed[going, t][:, None])
            inside &= score <= np.where(np.isnan(high[going, t].astype(np.float64)), -np.inf, high[going, t])[:, None]
            r, c = np.nonzero(inside)
            if not len(r):
                continue
            held[t] = _best(held[t], going[r], ids[part][c], score[r, c], k)
            rows, s = held[t][0], held[t][2]
            last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))
            full = last[last - np.searchsorted(rows, rows[last], side="left") == k - 1]
            needed[rows[full], t] = np.maximum(open_low[rows[full], t], s[full].astype(np.float64))
    return held, made


def _long(values: np.ndarray) -> list[int]:
    return [min(max(int(x), -(2**63)), 2**63 - 1) for x in values]


def _joined(anchors: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, target, vec_id, score: each cell's shared walk over each block of candidates."""

    def walk(frame):
        import pandas as pd

        out = []
        for row in frame.itertuples(index=False):
            size, kind = row.size, row.kind
            vectors = np.frombuffer(row.matrix, kind).reshape(-1, size).astype(np.float64)
            mine = np.frombuffer(row.cell_matrix, row.cell_kind).reshape(-1, size).astype(np.float64)
            ids, marks, own, labels = (np.frombuffer(x, "<i8") for x in (row.ids, row.labels, row.own, row.own_labels))
            low, high = (np.frombuffer(x, "<f8").reshape(len(own), -1) for x in (row.low, row.high))
            found, _ = walked(mine, own, labels, low, high, same, vectors, ids, marks, k)
            for t, (r, i, s) in enumerate(found):
                out.append(pd.DataFrame({"anchor_id": own[r], "target": np.full(len(r), t + 1), "vec_id": i, "score": _long(s)}))
        names = ["anchor_id", "target", "vec_id", "score"]
        return pd.concat(out)[names] if out else pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})

    cells = anchors.select("cell", "size")
    pairs = candidates.join(broadcast_if_small(cells), "size")
    pairs = pairs.join(broadcast_if_small(anchors.drop("size")), "cell")
    return pairs.groupBy("block", "cell").applyInPandas(walk, "anchor_id long, target int, vec_id long, score long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Candidates packed where they lie: block, size, kind, ids, labels, matrix of at most BLOCK vectors of one length."""

    def pack(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(i).to_numpy() for i in range(2))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for begin in range(0, len(at), BLOCK):
                    part = at[begin : begin + BLOCK]
                    kind, packed = _numbers(flat[starts[part][:, None] + np.arange(size)])
                    out.append((uuid.uuid4().hex, int(size), kind, ids[part].astype("<i8").tobytes(), labels[part].astype("<i8").tobytes(), packed))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("block", "size", "kind", "ids", "labels", "matrix"), o)) for o in out],
                pa.schema([("block", pa.string()), ("size", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                           ("labels", pa.binary()), ("matrix", pa.binary())]),
            )

    packed = rows.select("vec_id", "label", "v").mapInArrow(
        pack, "block string, size int, kind string, ids binary, labels binary, matrix binary"
    )
    return cut_lineage(packed.filter("size > 0"), "blocks")


def _packed_cells(rows: DataFrame, targets: int) -> DataFrame:
    """Anchors packed by cell: ids, labels, vectors, and a score range per target (NaN: none)."""

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("vec_id")
        kind, packed = _numbers(np.stack(frame["v"].to_numpy()))
        ranges = [np.array([list(x) + [np.nan] * (targets - len(x)) for x in frame[c]], "<f8").tobytes() for c in ("low", "high")]
        return pd.DataFrame([{
            "cell": frame["cell"].iloc[0], "size": len(frame["v"].iloc[0]), "cell_kind": kind, "cell_matrix": packed,
            "own": frame["vec_id"].to_numpy("<i8").tobytes(), "own_labels": frame["label"].to_numpy("<i8").tobytes(),
            "low": ranges[0], "high": ranges[1],
        }])

    packed = rows.groupBy("cell").applyInPandas(
        pack, "cell string, size int, cell_kind string, cell_matrix binary, own binary, own_labels binary, low binary, high binary"
    )
    return cut_lineage(packed, "cells")


def _celled(anchors: DataFrame, clusters: int, cell: int) -> DataFrame:
    """Anchors with their cell: the nearest cluster centre, and a part of it of about ``cell`` anchors."""
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    held = centres([list(r.v) for r in sample], clusters)

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            names = []
            for v in batch.column(2):
                x = np.array(v.as_py(), np.float64)
                near = int((held[len(x)] @ x).argmax()) if len(x) in held else 0
                names.append(f"{len(x)}:{near}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], ["vec_id", "label", "v", "cluster"])

    near = cut_lineage(anchors.select("vec_id", "label", "v").mapInArrow(nearest, "vec_id long, label long, v array<double>, cluster string"), "near")
    parts = near.groupBy("cluster").agg(F.ceil(F.count("*") / cell).alias("parts"))
    dealt = near.join(broadcast_if_small(parts), "cluster")
    name = F.concat_ws(":", "cluster", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("string"))
    return cut_lineage(dealt.select("vec_id", "label", "v", name.alias("cell")), "celled")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, clusters: int = CLUSTERS, cell: int = CELL,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, v (see ``prepared``). A score is the inner product
    with the anchor; ties go to the smaller vec_id. An anchor's positives are its
    ``positives`` best other rows of its label; for each, the first
    ``negatives`` rows of another label follow whose score is between ``low``
    and ``high`` percent of the positive's. Both bounds are whole-number
    comparisons, so a positive with a negative score has no negatives.

    Anchors of a cluster (cells of about ``cell``) share a list: the candidates
    of a block sorted by their angular bound. Each anchor walks it until the
    bound certifies that nothing later counts; all blocks are read, none is
    collected. The number of (cell, block) pairs grows with anchors times rows,
    as any exact search; candidates travel packed, once per cell.

    Rows that share the anchor's vec_id count as its own. A repeated vec_id is a
    candidate as often as it stands there, and one anchor (of its smallest label
    and vector). Vectors of another length, and empty ones, meet nothing. Scores
    beyond a long are held at its ends; those beyond 2^53 are added up exactly
    and compared as doubles. Empty tables give no rows.
    """
    rows = cut_lineage(rows.select("vec_id", "label", "v"), "vectors")
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = cut_lineage(anchors.select("vec_id", "a.label", "a.v").filter(F.size("v") > 0), "anchors")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], shape)
    anchors = _celled(anchors, clusters, cell)
    blocks = _blocks(rows)
    every = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    found = _joined(_packed_cells(every, 1), blocks, positives, same=True)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("target", F.row_number().over(best)).filter(F.col("target") <= positives)
    first = cut_lineage(first.select("anchor_id", "target", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers n with low * p <= 100 * n <= high * p.
    p = F.col("positive_score").cast("decimal(38,0)")
    reach = F.struct("target", F.ceil(p * low / 100).cast("double").alias("low"), F.floor(p * high / 100).cast("double").alias("high"))
    ranges = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(reach)).alias("r"))
    asked = anchors.join(ranges, "vec_id").select(
        "vec_id", "label", "v", "cell",
        F.transform("r", lambda x: x["low"]).alias("low"), F.transform("r", lambda x: x["high"]).alias("high"),
    )
    found = _joined(_packed_cells(asked, positives), blocks, negatives, same=False)
    best = Window.partitionBy("anchor_id", "target").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.join(first, ["anchor_id", "target"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
