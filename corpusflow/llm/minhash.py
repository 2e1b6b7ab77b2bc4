"""Near duplicates by min-max hashing, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import graph
from corpusflow.llm.remembered import use
from corpusflow.session import broadcast_if_small, cut_lineage

#: 120 permutations give 240 values; 40 bands of 3 permutations (6 values) miss a pair at
#: similarity 0.8 with probability (1 - 0.8^6)^40 < 6e-6.
PERMUTATIONS = 120
BAND_PERMUTATIONS = 3
SHINGLE = 2
PERCENT = 80
#: Longer words (in bytes) are not remembered by a worker, so that its memory is bounded in bytes.
REMEMBERED_LENGTH = 64
#: Components from this size on are compared in blocks of so many asking documents and members.
LARGE = 32
ASK_BLOCK = 128
MEMBER_BLOCK = 256

_ODD = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[2]
    x = (x ^ (x >> np.uint64(27))) * _ODD[3]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a whole text.

    A-Z become lower case; words are runs between ASCII white space. Fewer words
    than ``size`` make one shingle of all of them, no words make an empty set.
    """
    words = _words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(_shingles(np.fromiter(map(use(_WORDS).__getitem__, words), np.uint64, n), min(n, size)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, of which there is at least one."""
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : len(out) + i] * _ODD[0] + _ODD[1])
    return out


def shingle_sets(texts: Iterable[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_set`` of many texts at once: all hashes, set after set, and the size of each set."""
    words = [_words(text) for text in texts]
    lengths = [len(w) for w in words]
    h = np.fromiter(map(use(_WORDS).__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
    runs = _shingles(h, size) if len(h) >= size else h[:0]
    sets, end = [], 0
    for n in lengths:
        start, end = end, end + n
        found = np.sort(runs[start : end - size + 1] if n >= size else _shingles(h[start:end], n) if n else h[:0])
        if len(found) > 1:
            first = np.empty(len(found), bool)
            first[0] = True
            np.not_equal(found[1:], found[:-1], out=first[1:])
            found = found[first]
        sets.append(found)
    return np.concatenate([h[:0], *sets]), np.array([len(s) for s in sets], np.int64)


@lru_cache
def _family(permutations: int, per_band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_250_101)
    a = rng.integers(0, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)
    m = rng.integers(0, 1 << 63, (permutations // per_band, 2 * per_band), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, b, m


def minmax(shingles: np.ndarray, permutations: int = PERMUTATIONS, per_band: int = BAND_PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, as a (2, permutations) array."""
    a, b, _ = _family(permutations, per_band)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for start in range(0, len(x), 4096):  # bounded memory for very long texts
        values = x[start : start + 4096, None] * a + b
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.stack([low, high])


def band_keys(signature: np.ndarray, per_band: int = BAND_PERMUTATIONS) -> np.ndarray:
    """One 64-bit key per band: its permutations' minima and maxima together."""
    permutations = signature.shape[1]
    _, _, m = _family(permutations, per_band)
    values = signature.T.reshape(permutations // per_band, 2 * per_band).astype(np.uint64)
    number = np.arange(len(values), dtype=np.uint64)
    return _mix((values * m).sum(axis=1, dtype=np.uint64) ^ _mix(number + _ODD[1])).view(np.int64)


def signatures(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2) and the band keys."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), size)
                n.append(len(s))
                f1.append(int(_mix(s ^ _ODD[0]).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(_mix(s + _ODD[1]).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(band_keys(minmax(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(
        sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    )


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""
    pairs = cut_lineage(pairs.select("a", "b"), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(broadcast_if_small(cut_lineage(named, "named")), "doc_id", "left_semi")
    rows = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def check(batches):
        import pyarrow as pa

        known: tuple[str | None, np.ndarray] = (None, shingle_set(None))
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(0), batch.column(1)):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != known[0]:
                    known = (ta, shingle_set(ta, size))
                x, y = known[1], shingle_set(tb, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(rows.select("ta", "tb", "a", "b").mapInArrow(check, "a long, b long"), "confirmed")


def _linked(left, right, percent: int, size: int) -> list[tuple[int, int]]:
    """Pairs of (doc_id, text) rows of two blocks that meet the similarity, by counting common shingles."""
    members = [(d, shingle_set(t, size)) for d, t in right]
    members = [(d, x) for d, x in members if len(x)]
    if not members:
        return []
    known, codes = np.unique(np.concatenate([x for _, x in members]), return_inverse=True)
    sizes = np.array([len(x) for _, x in members])
    starts = np.cumsum(sizes) - sizes
    out, has = [], np.zeros(len(known), np.int64)
    for doc, text in left:
        asked = shingle_set(text, size)
        at = np.searchsorted(known, asked)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == asked)]
        has[at] = 1
        common = np.add.reduceat(has[codes], starts)
        has[at] = 0
        hit = len(asked) and np.flatnonzero(100 * common >= percent * (len(asked) + sizes - common))
        out += [(doc, members[i][0]) for i in (hit.tolist() if len(asked) else [])]
    return out


def compared(asks: DataFrame, members: DataFrame, docs: DataFrame, percent: int, text: str, size: int) -> DataFrame:
    """Links (a, b) between asking documents and all members of the groups they ask (doc_id, crowd).

    Both sides are dealt into blocks of bounded size, and each task compares one
    block with one block; only links leave it.
    """
    rows = asks.groupBy("crowd").agg(F.count("*").alias("asking")).join(
        members.groupBy("crowd").agg(F.count("*").alias("size")), "crowd"
    )
    plan = cut_lineage(
        rows.select("crowd", F.ceil(F.col("asking") / ASK_BLOCK).alias("asks"), F.ceil(F.col("size") / MEMBER_BLOCK).alias("parts")), "plan"
    )
    left, right = (side.join(broadcast_if_small(plan), "crowd") for side in (asks, members))
    named = cut_lineage(members.select("doc_id").union(asks.select("doc_id")).distinct(), "named")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = cut_lineage(texts.join(broadcast_if_small(named), "doc_id", "left_semi"), "texts")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """One copy of each row for every block of the other side."""
        return side.join(texts, "doc_id").select(
            # Aliases keep the columns of the two sides apart.
            *[F.col(c).alias(c) for c in ("doc_id", "text", "crowd")],
            F.pmod(F.xxhash64("doc_id"), F.col(own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        )

    def link(left, right):
        import pandas as pd

        found = _linked(list(zip(left["doc_id"], left["text"])), list(zip(right["doc_id"], right["text"])), percent, size)
        return pd.DataFrame([(min(p), max(p)) for p in found if p[0] != p[1]], columns=["a", "b"])

    blocks = ["crowd", "asks", "parts"]
    pairs = dealt(left, "asks", "parts").groupBy(*blocks).cogroup(dealt(right, "parts", "asks").groupBy(*blocks))
    return cut_lineage(pairs.applyInPandas(link, "a long, b long"), "compared")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, text: str = "text", size: int = SHINGLE, large_size: int = LARGE
) -> DataFrame:
    """Component of every document under "shingle sets at least ``percent`` similar".

    1. Documents with equal sets meet in one representative (their smallest
       doc_id), so exact copies cost one row however many there are.
    2. Representatives that share a band key form a bucket. Each is compared
       with the bucket's smallest id; confirmed links are joined to components.
    3. Inside a bucket only documents of different components are left to
       compare. Documents in buckets of small components are compared in pairs.
       A document that shares a bucket with a component of ``large_size`` or more
       members asks that component once, whatever the buckets, and is compared,
       block by block, with all its members and all others that ask it
       (``compared``); a bucket that holds so many small components is treated
       likewise. After this, each pair that shares a band is linked by a path or
       is confirmed not to be a link, and no group has made a row per pair.
    4. Components of all confirmed links.

    Sizes that cannot reach the similarity are dropped before texts are joined;
    this is exact. A link is missed only if no band agrees (below 6e-6 at 0.8).

    Returns doc_id, n_shingles, component_id, kept, one row per input row. Empty
    or null text: no shingles, own component. Equal sets share a component, also
    when rows are repeated; documents are expected to have one text per doc_id.
    A null doc_id takes no part: component_id null, kept true. An empty table
    gives no rows.
    """
    signed = cut_lineage(signatures(docs, text, size), "signatures")
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(
        real.groupBy("f1", "f2", F.col("n_shingles").alias("n"))
        .agg(F.min(F.struct("doc_id", "bands")).alias("m"))
        .select("f1", "f2", "n", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")),
        "representatives",
    )
    banded = reps.select("rep", "n", F.explode("bands").alias("key"))
    pivots = cut_lineage(
        banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.max("rep").alias("last"))
        .filter("p.rep <> last").select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn")),
        "pivots",
    )
    shared = cut_lineage(banded.join(pivots, "key"), "buckets")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    first = shared.filter("rep <> pivot").filter(near(F.col("n"), F.col("pn")))
    first = cut_lineage(first.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "first")
    links = confirmed(first, docs, percent, text, size)

    labels = graph.components(links)
    member = shared.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    member = cut_lineage(member.select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "members")
    groups = member.select("key", "comp").distinct()
    mixed = cut_lineage(groups.groupBy("key").agg(F.count("*").alias("parts")).filter("parts > 1").select("key"), "mixed")
    inside = member.join(mixed, "key")
    large = labels.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") >= large_size)
    large = cut_lineage(large, "large")
    inside = inside.join(broadcast_if_small(large), "comp", "left").select("key", "rep", "n", "comp", F.coalesce("size", F.lit(0)).alias("size"))
    inside = cut_lineage(inside, "inside")
    others = inside.filter("size > 0").select("key", F.col("comp").alias("other"), F.col("size").alias("osize")).distinct()
    # Members of the smaller component ask, equal sizes by number; all small members of such a bucket do.
    asks = inside.join(others, "key").filter("comp <> other and (size < osize or size = osize and comp < other)")
    asks = asks.select(F.col("rep").alias("doc_id"), F.concat(F.lit("component "), F.col("other")).alias("crowd"))
    small = inside.filter("size = 0").join(others.select("key").distinct(), "key", "left_anti")
    small = cut_lineage(small.select("key", "rep", "n", "comp"), "small")
    crowded = cut_lineage(small.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") >= large_size).select("key"), "crowded")
    gathered = small.join(crowded, "key", "left_semi")
    gathered = gathered.select(F.col("rep").alias("doc_id"), F.concat(F.lit("bucket "), F.col("key")).alias("crowd"))
    asks = cut_lineage(asks.union(gathered).distinct(), "asks")
    joined = labels.select(F.col("node").alias("doc_id"), F.concat(F.lit("component "), F.col("comp")).alias("crowd"))
    joined = joined.join(asks.select("crowd").distinct(), "crowd", "left_semi").select("doc_id", "crowd")
    more = compared(asks, cut_lineage(joined.union(asks), "crowds"), docs, percent, text, size)
    small = small.join(crowded, "key", "left_anti").select("key", "rep", "n", "comp")
    second = small.join(small.toDF("key", "r", "m", "c"), "key").filter("rep < r and comp <> c").filter(near(F.col("n"), F.col("m")))
    second = cut_lineage(second.select(F.col("rep").alias("a"), F.col("r").alias("b")).distinct(), "second")
    more = more.union(confirmed(second.join(first, ["a", "b"], "left_anti"), docs, percent, text, size))
    if not more.isEmpty():
        labels = graph.components(links.union(more))

    classes = reps.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    classes = cut_lineage(classes.select("f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("comp")), "classes")
    placed = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "doc_id"))
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
