"""Exact best inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

SCALE = 256
K = 5
#: Components are dealt over so many lists; each list scores its own part of the inner product.
LISTS = 4
#: Queries and vectors of a block.
BATCH = 1_024
BLOCK = 2_048
#: Blocks of each kind, on average, in a cell of the grid in which they meet; a task holds one cell.
QUERY_BLOCKS, VECTOR_BLOCKS = 8, 4


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of vectors without null or non-finite components.

    Null vectors, null ids and vectors that hold a null, NaN or infinity are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
    )


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (rows by queries): doubles while every sum is exact, Python integers beyond."""
    if not queries.size or not rows.size:
        return np.zeros((len(rows), len(queries)))
    if abs(queries).max() * abs(rows).max() * rows.shape[1] < 2**53:
        return rows @ queries.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(rows) @ whole(queries).T


def _parts(size: int, lists: int) -> list[slice]:
    cuts = [size * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _long(values: np.ndarray) -> list[int]:
    return [min(max(int(x), -(2**63)), 2**63 - 1) for x in values]


def _numbers(matrix: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers as bytes of the narrowest type that holds it."""
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def _packed(rows: DataFrame, names: tuple[str, ...], most: int, label: str) -> DataFrame:
    """Vectors packed where they lie, written out: at most ``most`` of one length in each block.

    ``names``: block, size, kind, ids, matrix.
    """

    def pack(batches):
        import uuid

        import pyarrow as pa

        schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()))))
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for begin in range(0, len(at), most):
                    part = at[begin : begin + most]
                    kind, matrix = _numbers(flat[starts[part][:, None] + np.arange(size)])
                    row = (uuid.uuid4().hex, int(size), kind, ids[part].astype("<i8").tobytes(), matrix)
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

    kinds = ("string", "int", "string", "binary", "binary")
    shape = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return cut_lineage(rows.select("vec_id", "v").mapInArrow(pack, shape), label)


def local_entries(queries: np.ndarray, rows: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 in a block: (row, query) of the ``k`` best entries of every score list.

    Each list is looked at alone; what an entry has in the others is not added up.
    """
    found = []
    for part in _parts(rows.shape[1], lists) or [slice(0, 0)]:
        local = _exact(queries[:, part], rows[:, part])
        if local.dtype == object or len(local) <= k:
            top = np.argsort(-local, axis=0, kind="stable")[:k]
        else:
            top = np.argpartition(-local, k - 1, axis=0)[:k]
        found.append(top + len(rows) * np.arange(len(queries)))
    keys = np.unique(np.concatenate(found))
    return keys % max(len(rows), 1), keys // max(len(rows), 1)


def sufficient_entries(queries: np.ndarray, rows: np.ndarray, cutoff: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2 in a block: (row, query) of the entries that reach the uniform share of the cutoff in some list.

    A score of at least t over m lists has a local score of at least t / m in
    one of them, so nothing below that share in all lists can be missing.
    """
    parts = _parts(rows.shape[1], lists) or [slice(0, 0)]
    passing = np.zeros((len(rows), len(queries)), bool)
    for part in parts:
        passing |= _exact(queries[:, part], rows[:, part]) * len(parts) >= cutoff
    return np.nonzero(passing)


def resolved(queries: np.ndarray, rows: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole scores of the given entries only."""
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1) < 2**53:
        step = max(1, (1 << 22) // max(rows.shape[1], 1))
        cuts = range(0, len(r), step)
        return np.concatenate([np.einsum("ij,ij->i", rows[r[s : s + step]], queries[c[s : s + step]]) for s in cuts] or [np.zeros(0)])
    whole = [sum(int(x) * int(y) for x, y in zip(rows[i], queries[j])) for i, j in zip(r, c)]
    return np.array(whole, object)


def _first(c: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -score, c)) if len(c) else np.zeros(0, np.int64)
    kept = np.arange(len(c)) - np.searchsorted(c[order], c[order], side="left") < k
    return order[kept]


def _met(queries: DataFrame, blocks: DataFrame, k: int, lists: int, whole: bool) -> DataFrame:
    """query_id, vec_id, score from every query block beside every block of vectors of that length.

    Blocks meet in the cells of a grid, a few of each kind in a cell: a block of
    vectors goes to one cell per QUERY_BLOCKS query blocks. Without ``whole``:
    phase 1, the local lists' entries. With it: phases 2 and 3 above each
    query's cutoff, which travels in the query block.
    """
    names = ("query_id", "vec_id", "score")

    def meet(left, right):
        import pandas as pd

        out = []
        for q in right.itertuples(index=False):
            own = np.frombuffer(q.query_ids, "<i8")
            asked = np.frombuffer(q.query_matrix, q.query_kind).reshape(len(own), q.size).astype(np.float64)
            found = []
            for x in left.itertuples(index=False):
                ids = np.frombuffer(x.ids, "<i8")
                rows = np.frombuffer(x.matrix, x.kind).reshape(len(ids), x.size).astype(np.float64)
                if whole:
                    r, c = sufficient_entries(asked, rows, np.frombuffer(q.cutoffs, "<i8"), lists)
                else:
                    r, c = local_entries(asked, rows, k + 1, lists)  # one more, for the query's own row
                other = ids[r] != own[c]
                r, c = r[other], c[other]
                score = resolved(asked, rows, r, c)
                best = _first(c, ids[r], score, k)
                found.append((c[best], ids[r[best]], score[best]))
            if found:
                c, ids, score = (np.concatenate(f) for f in zip(*found))
                best = _first(c, ids, score, k)
                out.append(pd.DataFrame(dict(zip(names, (own[c[best]], ids[best], _long(score[best]))))))
        return pd.concat(out) if out else pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})

    down, across = (max(1, -(-f.count() // most)) for f, most in ((blocks, VECTOR_BLOCKS), (queries, QUERY_BLOCKS)))

    def dealt(frame: DataFrame, name: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        rows = frame.withColumn(own, F.pmod(F.xxhash64(name), F.lit(parts)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("size", "down", "across")

    left = dealt(blocks, "block", "down", down, "across", across)
    right = dealt(queries, "query_block", "across", across, "down", down)
    return left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score long")


def _with_cutoffs(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th best score known of each query: a bound that its k-th best score cannot be below."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", "score")

    def names(batches):
        import pyarrow as pa

        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own)), pa.array(own), pa.array(np.arange(len(own)))], ["query_block", "query_id", "place"])

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("place")
        cutoffs = np.array([-(2**63) if pd.isna(x) else int(x) for x in frame["cutoff"]], "<i8")
        return pd.DataFrame([{"query_block": frame["query_block"].iloc[0], "cutoffs": cutoffs.tobytes()}])

    listed = queries.select("query_block", "query_ids").mapInArrow(names, "query_block string, query_id long, place long")
    # As text: a long column with nulls would pass through doubles.
    known = listed.join(kth, "query_id", "left").select("query_block", "place", F.col("score").cast("string").alias("cutoff"))
    return cut_lineage(queries.join(known.groupBy("query_block").applyInPandas(pack, "query_block string, cutoffs binary"), "query_block"), "cutoffs")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, lists: int = LISTS, batch: int = BATCH) -> DataFrame:
    """The ``k`` highest inner products of each query with every other row, exactly.

    ``vectors`` holds vec_id and v (see ``quantised``). Vectors and queries are
    packed into blocks; every query block (at most ``batch``) meets every block
    of vectors, twice. Components are dealt over ``lists`` score lists. Phase 1:
    the best local entries of each list, and the whole scores of these entries
    alone; the k-th best score among a query's entries is a safe cutoff. Phase
    2: the cutoffs travel with the query blocks, and every entry with at least
    the uniform share of its cutoff in one list is collected. Phase 3: the
    remaining scores of those entries are resolved exactly. Nothing passes
    through the driver.

    Returns query_id, rank from 1, vec_id, score; ties go to the smaller
    vec_id; fewer than k rows if there are fewer candidates. Rows that share the
    query's vec_id count as its own. A vec_id that is repeated is a candidate as
    often as it stands there, and one query (of its smallest vector). Vectors of
    another length than the query's take no part. Scores beyond a long are held
    at its ends. Empty tables give no rows.
    """
    vectors = cut_lineage(vectors.select("vec_id", "v"), "vectors")
    asked = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = _packed(vectors, ("block", "size", "kind", "ids", "matrix"), BLOCK, "blocks")
    queries = _packed(asked, ("query_block", "size", "query_kind", "query_ids", "query_matrix"), batch, "queries")
    # An entry once, however many lists and blocks of the same rows give it: fewer entries only lower the cutoff.
    entries = _met(queries, blocks, k, lists, whole=False).distinct()
    found = _met(_with_cutoffs(queries, entries, k), blocks, k, lists, whole=True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
