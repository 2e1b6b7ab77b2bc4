"""Exact Jaccard join of shingle sets that skips by the relations between sets.

Index lists are skipped block by block: all entries of a list with one set size
and one position are a block, and two blocks meet only if sets of these sizes
that first agree at these positions can be similar. Answers are derived: a set
that resembles a leader is held as its difference from it, and all answers
inside the leader's group follow from the differences alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm import graph
from corpusflow.llm.minhash import shingle_set, shingle_sets
from corpusflow.operators.dedup import join_hot
from corpusflow.session import broadcast_if_small, cut_lineage, empty_copy, is_small, scratch_path

SIZE = 3
PERCENT = 90
#: A set joins the group of a leader from this similarity on.
GROUP_PERCENT = 50
#: Rounds in which leaders are chosen; sets without one are their own group.
ROUNDS = 3
#: Members of a group that a task compares with so many others.
BLOCK = 256
#: Shingles with a hash below this are counted and come first in the order, the rarest in front.
POOL = 1 << 63
#: Low bits of their hashes that do not travel: shingles that then look alike share a list, which adds entries and loses none.
UNUSED_BITS = 16
#: One set of so many is looked at for shingles that very many sets hold, and from so many sets on a shingle is counted apart.
SAMPLE = 64
HOT_SETS = 100_000
#: Texts whose sets a task makes together.
SLICE = 512
#: Copies (numbers of 8 bytes) that are left out of the sets by a broadcast; more are left out by a shuffle.
MAX_COPIES = 2_000_000
_SALT = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same whatever its order."""
    with np.errstate(over="ignore"):
        return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in _marks(s))


def _marks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for every shingle, whose sums are the fingerprint."""
    a = (s ^ _SALT[0]) * _SALT[1]
    a ^= a >> np.uint64(29)
    b = (s + _SALT[1]) * _SALT[0]
    b ^= b >> np.uint64(31)
    return a * a * _SALT[0] + a, b * b * _SALT[0] + b


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring runs of ``values``, modulo 2^64."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ends] - total[ends - sizes]


def _prefix(n: int, percent: int) -> int:
    """Shingles of a set of n of which a similar set has at least one."""
    return n - -(-percent * n // 100) + 1


def signed(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the fingerprint f1, f2 of every document's set, its pool and its tail.

    The pool is the shingles below POOL; the tail is those of the others that the
    prefix needs when the pool is too small. The sets of a text are made here and
    not again. Pooled hashes are without their UNUSED_BITS.
    """

    def sign(batches):
        import pyarrow as pa

        def lists(values, kept, sizes):
            ends = np.concatenate([[0], np.cumsum(_sums(kept.astype(np.uint64), sizes).astype(np.int64))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept].view(np.int64)))

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                values, sizes = shingle_sets(part.column(1).to_pylist(), size)
                f1, f2 = (_sums(x, sizes).view(np.int64) for x in _marks(values))
                pool = values < np.uint64(POOL)
                place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                tail = ~pool & (place < np.repeat(_prefix(sizes, percent), sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (sizes, f1, f2)), lists(values >> np.uint64(UNUSED_BITS), pool, sizes), lists(values, tail, sizes)],
                    ["doc_id", "n_shingles", "f1", "f2", "pool", "tail"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, pool array<long>, tail array<long>")


def _pools(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """cid, n, pool and tail of a table cid, text."""
    sets = signed(texts.select(F.col("cid").alias("doc_id"), "text"), "text", size, percent)
    return sets.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), "pool", "tail")


def _shared(pooled: DataFrame) -> DataFrame:
    """cid, e, df: the rows of ``pooled`` (cid, e) whose shingle has other rows, with their number.

    Rows are shuffled once, by shingle, and counted where they meet. Shingles
    that a sample shows in very many sets are counted apart, by partial sums, so
    their rows stay where they are.
    """
    sample = pooled.filter(F.pmod(F.xxhash64("cid"), F.lit(SAMPLE)) == 0)
    hot = cut_lineage(sample.groupBy("e").count().filter(F.col("count") * SAMPLE >= HOT_SETS).select("e"), "hot")
    by_shingle = Window.partitionBy("e")
    if hot.isEmpty() or not is_small(hot):
        return pooled.withColumn("df", F.count("*").over(by_shingle)).filter("df > 1")
    counts = pooled.join(F.broadcast(hot), "e").groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    counts = F.broadcast(cut_lineage(counts, "counts"))
    cold = pooled.join(F.broadcast(hot), "e", "left_anti").withColumn("df", F.count("*").over(by_shingle)).filter("df > 1")
    return pooled.join(counts, "e").select("cid", "e", "df").unionByName(cold)


def entries(sets: DataFrame, percent: int) -> DataFrame:
    """cid, n, e, pos: the prefix of every set in the common order, where a list has another entry.

    Order: counted shingles by the number of sets that hold them, then the
    others. Shingles that one set alone holds come first and are only counted
    there, so a set with enough of its own has no entry at all.
    """
    common = _shared(sets.select("cid", F.explode("pool").alias("e")))
    held = common.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("common"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = sets.select("cid", "n", F.size("pool").cast("long").alias("pool"), "tail").join(held, "cid", "left")
    rows = rows.withColumn("common", F.coalesce("common", F.array().cast("array<struct<df:long,e:long>>")))
    own = F.col("pool") - F.size("common")
    rows = rows.withColumn("own", own).withColumn("length", length).filter("length > own")
    first = F.slice("common", F.lit(1), F.greatest(F.col("length") - F.col("own"), F.lit(0)).cast("int"))
    late = F.slice("tail", F.lit(1), F.greatest(F.col("length") - F.col("pool"), F.lit(0)).cast("int"))
    listed = F.concat(
        F.transform(first, lambda x, i: F.struct(x["e"].alias("e"), (F.col("own") + i).alias("pos"))),
        F.transform(late, lambda x, i: F.struct(x.alias("e"), (F.col("pool") + i).alias("pos"))),
    )
    listed = cut_lineage(rows.select("cid", "n", F.inline(listed)), "prefixes")
    shared = listed.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    return cut_lineage(join_hot(listed, cut_lineage(shared, "lists"), "e", "df").drop("df"), "entries")


def _stars(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """lead, cid, n, n_lead, common, gone (hashes only the lead has) and own (only the set): each text read once a block."""
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = cut_lineage(sizes, "stars")
    members = pairs.join(broadcast_if_small(sizes), "lead")
    members = members.select("lead", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), "cid")
    heads = sizes.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("cid"))
    rows = cut_lineage(members.unionByName(heads), "star-rows")
    named = cut_lineage(rows.select("cid").distinct(), "named")
    wanted = texts.join(broadcast_if_small(named), "cid", "left_semi").select("cid", "text")
    rows = rows.join(wanted, "cid")

    def compare(frame):
        import pandas as pd

        lead = int(frame["lead"].iloc[0])
        sets = {int(c): shingle_set(t, size) for c, t in zip(frame["cid"], frame["text"])}
        head = sets[lead]
        out = []
        for cid, s in sets.items():
            if cid != lead:
                gone, own = np.setdiff1d(head, s, assume_unique=True), np.setdiff1d(s, head, assume_unique=True)
                out.append((lead, cid, len(s), len(head), len(s) - len(own), gone.view(np.int64), own.view(np.int64)))
        return pd.DataFrame(out, columns=["lead", "cid", "n", "n_lead", "common", "gone", "own"])

    return rows.groupBy("lead", "block").applyInPandas(
        compare, "lead long, cid long, n long, n_lead long, common long, gone array<long>, own array<long>"
    )


def _similar(percent: int, a: str = "n", b: str = "n_lead", both: str = "common"):
    return 100 * F.col(both) >= percent * (F.col(a) + F.col(b) - F.col(both))


def groups(listed: DataFrame, texts: DataFrame, size: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """lead, cid, n, n_lead, common, gone, own: sets with the leader that they resemble.

    A set's offer is the smallest id in its lists. Sets whose own offer is
    themselves lead; the others join their offer if it leads and is similar
    enough. What is left over tries again among itself.
    """
    found, open_ = [], listed.select("cid", "e")
    for _ in range(rounds):
        heads = open_.groupBy("e").agg(F.min("cid").alias("head"), F.max("cid").alias("last")).filter("head < last").select("e", "head")
        offers = open_.join(heads, "e").groupBy("cid").agg(F.min("head").alias("lead"))
        offers = cut_lineage(offers, "offers")
        leads = offers.filter("lead = cid").select("lead")
        pairs = cut_lineage(offers.filter("lead < cid").join(leads, "lead", "left_semi"), "pairs")
        if pairs.isEmpty():
            break
        star = cut_lineage(_stars(pairs, texts, size), "differences")
        # Links below the group's bound are met again as ordinary pairs.
        joined = star.filter(_similar(min(GROUP_PERCENT, percent)))
        found.append(joined)
        settled = joined.select("cid").union(joined.select("lead")).distinct()
        open_ = cut_lineage(open_.join(broadcast_if_small(cut_lineage(settled, "settled")), "cid", "left_anti"), "open")
    if not found:
        shape = "lead long, cid long, n long, n_lead long, common long, gone array<long>, own array<long>"
        return listed.sparkSession.createDataFrame([], shape)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return cut_lineage(result, "groups")


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that join two parts not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def derived(members: DataFrame, weights: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """kind, a, b: answers inside the groups from the members' differences.

    kind "link": an edge of a spanning forest of the links a task found.
    kind "count": set a has b linked documents among those a task compared.
    Two members share the leader's set less what either lacks, plus what both
    have beside it. Blocks of ``block`` members meet block by block.
    """
    sizes = cut_lineage(members.groupBy("lead").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("k")).filter("k > 1"), "crowds")
    rows = members.join(broadcast_if_small(sizes), "lead").join(weights, "cid")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    rows = rows.select(
        "lead", "cid", "n", "n_lead", "weight", "gone", "own", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("met"),
    )
    rows = rows.withColumn("low", F.least("mine", "met")).withColumn("high", F.greatest("mine", "met"))

    def answer(frame):
        import pandas as pd

        frame = frame.sort_values("cid")
        one = frame["low"].iloc[0] == frame["high"].iloc[0]
        left = frame if one else frame[frame["mine"] == frame["low"]]
        right = frame if one else frame[frame["mine"] == frame["high"]]
        tally: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            delta = [np.concatenate([g, o]).astype(np.int64) for g, o in zip(right["gone"], right["own"])]
            known, codes = np.unique(np.concatenate(delta), return_inverse=True)
            lens = np.array([len(d) for d in delta])
            owner = np.repeat(np.arange(len(delta)), lens)
            lost, n, ids, weight = (right[c].map(len).to_numpy() if c == "gone" else right[c].to_numpy() for c in ("gone", "n", "cid", "weight"))
            has = np.zeros(len(known) + 1, np.int64)
            for cid, m, base, w, gone, own in zip(left["cid"], left["n"], left["n_lead"], left["weight"], left["gone"], left["own"]):
                asked = np.concatenate([gone, own]).astype(np.int64)
                at = np.searchsorted(known, asked)
                at = at[known[np.minimum(at, len(known) - 1)] == asked] if len(known) else at[:0]
                has[at] = 1
                both = np.bincount(owner, weights=has[codes], minlength=len(delta)).astype(np.int64)
                has[at] = 0
                common = base - len(gone) - lost + both
                near = 100 * common >= percent * (m + n - common)
                near &= ids > cid if one else ids != cid
                hit = np.flatnonzero(near)
                if len(hit):
                    tally[int(cid)] = tally.get(int(cid), 0) + int(weight[hit].sum())
                    for h in hit.tolist():
                        tally[int(ids[h])] = tally.get(int(ids[h]), 0) + int(w)
                    edges += [(int(cid), int(ids[h])) for h in hit.tolist()]
                    if len(edges) > 100_000:
                        edges = _forest(edges)
        out = [("link", a, b) for a, b in _forest(edges)] + [("count", a, b) for a, b in tally.items()]
        return pd.DataFrame(out, columns=["kind", "a", "b"])

    return rows.groupBy("lead", "low", "high").applyInPandas(answer, "kind string, a long, b long")


def crossing(listed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets of different groups that no skipped block rules out.

    Blocks (list, size, position) of a list meet first, as rows of their own;
    only blocks that pass are opened. Sizes fall into steps of the similarity,
    and only equal and neighbouring steps meet.
    """
    lead = members.select("cid", "lead")
    rows = listed.join(lead, "cid", "left").select("cid", "n", "e", "pos", F.coalesce("lead", "cid").alias("lead"))
    step = F.floor(F.log("n") / float(np.log(100 / percent + 1e-4))).cast("int")
    rows = cut_lineage(rows.withColumn("step", step), "positions")
    blocks = rows.groupBy("e", "step", "n", "pos").agg(F.min("lead").alias("least"), F.max("lead").alias("most"))
    # A list that one group alone has is answered already.
    mixed = blocks.groupBy("e").agg(F.min("least").alias("x"), F.max("most").alias("y")).filter("x < y").select("e")
    blocks = cut_lineage(blocks.join(mixed, "e", "left_semi"), "blocks")
    small = blocks.select("e", F.explode(F.array("step", F.col("step") + 1)).alias("step"), *[F.col(c).alias(f"{c}_a") for c in ("n", "pos", "least", "most")])
    met = small.join(blocks, ["e", "step"]).filter(f"n_a <= n and 100 * n_a >= {percent} * n")
    bound = f"{percent} * (n_a + n)"
    met = met.filter(f"{100 + percent} * (n_a - pos_a) >= {bound} and {100 + percent} * (n - pos) >= {bound}")
    met = met.filter("not (least_a = most_a and least = most and least = least_a)").select("e", "n_a", "pos_a", "n", "pos")
    met = cut_lineage(met, "met")
    a = rows.select("e", F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("cid").alias("a"), F.col("lead").alias("lead_a"))
    b = rows.select("e", "n", "pos", F.col("cid").alias("b"), "lead")
    pairs = met.join(a, ["e", "n_a", "pos_a"]).join(b, ["e", "n", "pos"]).filter("lead_a <> lead and a <> b")
    return cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crossing")


def jaccard_join(docs: DataFrame, percent: int = PERCENT, text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document; sets are linked from ``percent`` similarity on.

    1. Equal sets become one; copies are counted and travel no further.
    2. Prefixes of the sets in order of rarity are the index (``entries``).
    3. Sets join leaders that they resemble (``groups``); all links inside a
       group are derived from the differences to the leader (``derived``).
    4. Links between groups: blocks of the lists by size and position are
       skipped (``crossing``), the pairs left are confirmed on the full sets.
    5. Components of all links.

    The result is exact up to 64-bit hashes of shingles (two of 10^6 shingles of
    a pair collide with a probability below 10^-7; 128 bits tell equal sets).
    n_links counts the other documents linked with one, copies included. No
    links are written out inside a group: tasks leave counts and the edges of a
    spanning forest.

    Empty or null text: no shingles, own component, no links. A null doc_id takes
    no part (component_id null, n_links 0). Rows that repeat a doc_id with the
    same text count as copies; a doc_id with several texts has several rows, each
    with the component of its text. An empty table gives no rows.
    """
    path = scratch_path(docs.sparkSession, "signed")
    whole = cut_lineage(signed(docs, text, size, percent).withColumn("cid", F.monotonically_increasing_id()), path=path)
    base = cut_lineage(whole.drop("pool", "tail"), "signatures")
    held = "n_shingles > 0 and doc_id is not null"
    real = base.filter(held)
    # The number of any of its rows stands for a set.
    classes = real.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("rep"), F.min("cid").alias("cid"), F.count("*").alias("weight")
    )
    classes = cut_lineage(classes, "classes")
    sets = whole.filter(held).select("cid", F.col("n_shingles").alias("n"), "pool", "tail")
    copies = cut_lineage(real.select("cid").join(classes.select("cid"), "cid", "left_anti"), "copies")
    if is_small(copies, MAX_COPIES):
        sets = sets.join(F.broadcast(copies), "cid", "left_anti")
    else:
        pools = scratch_path(docs.sparkSession, "pools")
        sets = cut_lineage(sets.join(classes.select("cid"), "cid", "left_semi"), path=pools)
        empty_copy(whole, path)
        whole, path = sets, pools
    listed = entries(sets, percent)
    empty_copy(whole, path)
    # Only sets with an entry in some list can have a link, and only their texts are read again.
    named = cut_lineage(classes.join(listed.select("cid").distinct(), "cid", "left_semi").select("rep", "cid", "n", "f1", "f2"), "listed")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).alias("text")).join(broadcast_if_small(named), "rep")
    twice = real.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("rep"))
    twice = cut_lineage(twice, "twice")
    if not twice.isEmpty():
        # Rows that share a doc_id: one row for each of its sets.
        many = texts.join(broadcast_if_small(twice), "rep", "left_semi")

        def own(batches):
            import pyarrow as pa

            for batch in batches:
                held = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())
                yield batch.filter(pa.array([_fingerprint(shingle_set(t.as_py(), size)) == (a, b) for t, a, b in held], pa.bool_()))

        many = many.select("cid", "n", "text", "f1", "f2").mapInArrow(own, "cid long, n long, text string, f1 long, f2 long")
        many = many.groupBy("cid", "n").agg(F.min("text").alias("text"))
        texts = texts.join(broadcast_if_small(twice), "rep", "left_anti").select("cid", "n", "text").unionByName(many)
    texts = cut_lineage(texts.select("cid", "n", "text"), "texts")
    members = groups(listed, texts, size, percent)
    weights = classes.select("cid", "weight")
    inside = cut_lineage(derived(members, weights, percent), "derived")
    met = crossing(listed, members, percent)
    star = _stars(met.select(F.col("a").alias("lead"), F.col("b").alias("cid")), texts, size)
    linked = cut_lineage(star.filter(_similar(percent)).select(F.col("lead").alias("a"), F.col("cid").alias("b")), "crossed")
    linked = linked.unionByName(members.filter(_similar(percent)).select(F.col("lead").alias("a"), F.col("cid").alias("b")))
    labels = graph.components(linked.unionByName(inside.filter("kind = 'link'").select("a", "b")))
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tally = both.join(weights.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), "weight")
    tally = tally.unionByName(inside.filter("kind = 'count'").select(F.col("a").alias("cid"), F.col("b").alias("weight")))
    tally = cut_lineage(tally.groupBy("cid").agg(F.sum("weight").alias("links")), "tally")
    placed = classes.join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left").join(tally, "cid", "left")
    placed = cut_lineage(placed.withColumn("comp", F.coalesce("comp", "cid")), "placed")
    names = placed.groupBy("comp").agg(F.min("rep").alias("component"))
    placed = placed.join(names, "comp").select(
        "f1", "f2", F.col("n").alias("n_shingles"), "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    rows = base.join(cut_lineage(placed, "answers"), ["f1", "f2", "n_shingles"], "left")
    known = F.col("doc_id").isNotNull()
    alone = F.col("n_shingles") == 0
    return rows.select(
        "doc_id", "n_shingles",
        F.when(known, F.when(alone, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"),
        F.when(known & ~alone, F.col("links")).otherwise(0).cast("long").alias("n_links"),
    )
