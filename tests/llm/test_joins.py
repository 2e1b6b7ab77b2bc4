"""The Jaccard join, conversation repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import session
from corpusflow.llm import jaccard, minhash, negatives, repair


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text, size=3):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_join(rows, percent):
    """(doc_id, n, component, links) of every row with an id, from all pairs of texts."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    near = [[j for j, (_, y) in enumerate(sets) if j != i and x and 100 * len(x & y) >= percent * len(x | y)] for i, (_, x) in enumerate(sets)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, others in enumerate(near):
        for j in others:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(x), least[find(i)] if x else d, len(near[i])) for i, (d, x) in enumerate(sets))


def near_copies(seed, n, length=120):
    """Groups of near copies by small edits, a shared passage, chains and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(length)]
        for _ in range(n // 6):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(length)] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randrange(8))]
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(2, 40))]) for _ in range(n // 6)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 15))) for _ in range(n - len(texts) - 4)]
    texts += [texts[0], texts[0].upper(), texts[5], "a b"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [90, 75])
def test_jaccard_join_equals_brute_force(spark, documents, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks per group
    rows = near_copies(percent, 180)
    got = jaccard.jaccard_join(documents(rows), percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_join(rows, percent)


def test_jaccard_groups_answer_most_links(spark, documents):
    """A crowd of near copies leaves no row per pair: forests and counts only."""
    rows = near_copies(5, 200)
    docs = documents(rows).select(F.col("doc_id").alias("cid"), "text")
    n = F.udf(lambda t: len(jaccard.shingle_set(t, 3)), "long")
    texts = docs.withColumn("n", n("text"))
    listed = jaccard.entries(jaccard._pools(texts, 3, 90), 90)
    members = jaccard.groups(listed, texts, 3, 90)
    inside = jaccard.derived(members, texts.select("cid", F.lit(1).cast("long").alias("weight")), 90, block=8)
    k = members.count()
    assert k > 50
    blocks = -(-k // 8)
    assert inside.filter("kind = 'link'").count() <= k * blocks
    crossing = {frozenset((r.a, r.b)) for r in jaccard.crossing(listed, members, 90).collect()}
    lead = {r.cid: r.lead for r in members.collect()}
    assert all(lead.get(a, a) != lead.get(b, b) for a, b in map(tuple, crossing))


def test_jaccard_odd_rows(spark, odd, odd_rows):
    got = jaccard.jaccard_join(odd).collect()
    assert len(got) == len(odd_rows)
    named = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id is not None)
    assert named == brute_join([(d, t) for d, t in odd_rows], 90)
    assert [(r.component_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]


def test_jaccard_one_id_with_several_texts(spark, documents):
    rows = [(1, "a b c d e"), (1, "f g h i j"), (1, "f g h i j"), (2, "F g h i j"), (3, "a b c d e")]
    got = sorted(tuple(r) for r in jaccard.jaccard_join(documents(rows)).collect())
    assert got == [(1, 3, 1, 1), (1, 3, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2), (3, 3, 1, 1)]


def test_jaccard_nothing(spark, nothing):
    assert jaccard.jaccard_join(nothing).collect() == []


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def brute_repair(rows, inserts=3):
    """Least (cost, audit, text) over all edits with at most ``inserts`` insertions; for a few rows only."""
    marks, best = faults(rows), None
    for edits in itertools.product("KuaD", repeat=len(rows)):
        cost, lines, bad = 0, [], False
        for (_, _, role, text), fault, edit in zip(rows, marks, edits):
            if edit == "D":
                cost += 2
                continue
            bad |= fault in ("blank", "duplicate")
            cost += (edit != "K") + 5 * (fault == "truncated")
            lines.append(("R" if edit != "K" else "K", {"u": "user", "a": "assistant"}.get(edit, role), text))
        if bad or (best and cost > best[0]):
            continue
        places = [i for i, e in enumerate(edits)]
        for k in range(inserts + 1):
            if best and cost + 5 * k > best[0]:
                break
            for where in itertools.combinations_with_replacement(range(len(places) + 1), k):
                for who in itertools.product(("user", "assistant"), repeat=k):
                    audit, roles, text_lines, at = "", "", [], 0
                    for i in range(len(edits) + 1):
                        for w, name in zip(where, who):
                            if w == i:
                                audit, roles = audit + "I", roles + name[0]
                                text_lines.append(f"{name}:")
                        if i < len(edits):
                            if edits[i] == "D":
                                audit += "D"
                            else:
                                letter, role, text = lines[at]
                                at += 1
                                audit, roles = audit + letter, roles + (role[:1] if len(role) else "-")
                                text_lines.append(f"{role}:{text}")
                    if legal(roles):
                        offer = (cost + 5 * k, audit, "\n".join(text_lines))
                        best = min(best or offer, offer)
    return best


def expected(rows):
    """conv_id -> all columns, rows in the order of the contract."""
    held = {conv: [] for conv, *_ in rows}
    for row in brute_damage(rows):
        held[row[0]].append(row)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(own)
        turns = {t for _, t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = brute_repair(own)
        out[conv] = (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, block long, cost string, symbols int"


def conversation_rows(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Yes.", "No", "What?\n", " ", "", None, "a!b", "été.", "日本 \x0c"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_brute_force(spark, seed):
    rows = conversation_rows(seed)
    frame = spark.createDataFrame([(*r, "k", 1, "c", 2) for r in rows], CONVERSATIONS)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repairs(frame, repair.damaged(frame)).collect()}
    assert got == expected(rows)


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    """Segments and blocks change nothing; texts are hashed across them."""
    rng = random.Random(3)
    rows = [(1, t // 2 if t % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", "Three!", ""]) + str(rng.randrange(40)) + ".") for t in range(400)]
    rows += [(2, 5, "user", "Same.")] * 30 + [(3, 10**6 * t, "user", f"{t}.") for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: tuple(r) for r in repair.repairs(frame, repair.damaged(frame)).collect()}
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(repair, "BLOCK_TURNS", 16)
    cut = {r.conv_id: tuple(r) for r in repair.repairs(frame, repair.damaged(frame)).collect()}
    assert whole == cut
    held = sorted((r for r in brute_damage(rows) if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert [whole[1][2 + i] for i in range(3)] == [faults(held).count(m) for m in ("blank", "duplicate", "truncated")]


def test_suffixes_are_shared(spark):
    automaton = repair.Automaton()
    signatures = sorted((a + "uaua" * 50 for a in ("s", "u", "uu", "d", "sA")), key=lambda s: s[::-1])
    costs = [automaton.solve(s)[0] for s in signatures]
    assert automaton.made < 200 + 1 + 10
    assert costs == [repair.Automaton().solve(s)[0] for s in signatures]


def test_repairs_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repairs(empty, repair.damaged(empty)).collect() == []


VECTORS = "vec_id long, label int, embedding array<float>, v string, score int, cell string"


def brute_negatives(rows, positives=5, negatives_=3):
    held = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = []
    anchors = {}
    for i, label, v in held:
        if i % 50 == 0 and v:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for i, (label, v) in anchors.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in held if j != i and len(w) == len(v))
        first = [(-s, j) for s, j, m in scores if m == label][:positives]
        for p, pid in first:
            fit = [(-s, j) for s, j, m in scores if m != label and 50 * p <= -100 * s <= 95 * p][:negatives_]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=700, dims=12):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dims))
    rows = [(i, int(rng.integers(4)), [float(np.float32(x)) for x in heads[rng.integers(6)] + rng.normal(size=dims) * 0.3]) for i in range(n)]
    rows += [(n + i, 1, [0.5] * dims) for i in range(40)] + [(n + 50 + i, 2, [0.0] * dims) for i in range(5)]
    rows += [(50, 0, [0.25] * dims), (50, 3, [0.1] * dims), (n, None, [0.1] * dims), (n, 1, None), (None, 1, [0.1] * dims)]
    return rows + [(n + 100, 1, [None] + [0.1] * (dims - 1)), (n + 150, 1, [float("nan")] * dims), (2000, 1, [0.1, 0.2]), (2001, 2, [0.1, 0.1]), (2003, 1, [0.3, 0.2]), (2050, 1, [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rows = vectors(seed)
    frame = spark.createDataFrame([(i, m, v, "v", 1, "c") for i, m, v in rows], VECTORS)
    got = negatives.hard_negatives(negatives.prepared(frame), F.col("vec_id") % 50 == 0, clusters=3, cell=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_walks_end_early():
    """Anchors in one direction need few of the candidates, and get the same entries as a full scan."""
    rng = np.random.default_rng(4)
    heads = np.array([[1.0, 0, 0, 0], [-1.0, 0, 0, 0]]) * 200
    anchors = np.round(heads[0] + rng.normal(size=(20, 4)) * 5)
    rows = np.round(np.concatenate([heads[i % 2] + rng.normal(size=(1, 4)) * 30 for i in range(4000)]))
    ids, marks = np.arange(4000), np.zeros(4000, np.int64)
    low, high = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    (found,), made = negatives.walked(anchors, np.arange(20) - 100, np.zeros(20, np.int64), low, high, True, rows, ids, marks, 5)
    assert made < 20 * 4000 / 2
    scores = anchors @ rows.T
    for a in range(20):
        best = sorted((-scores[a, i], i) for i in range(4000))[:5]
        assert [(-s, i) for s, i in best] == list(zip(found[2][found[0] == a], found[1][found[0] == a]))


def test_large_components_stay_exact(spark):
    big = 2.0**21
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big * 0.9, 0.0])]
    frame = spark.createDataFrame([(i, m, v) for i, m, v in rows], "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(negatives.prepared(frame), F.col("vec_id") == 0).collect()
    scores = {i: int(256 * big) ** 2 + 256 * 256 * i for i in (3, 2)}
    assert sorted((r.positive_id, r.negative_id, r.positive_score) for r in got) == [(1, 3, scores[3]), (2, 3, scores[2])]


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.prepared(empty), F.col("vec_id") % 50 == 0).collect() == []


def test_shingle_sets_equal_single_ones():
    texts = [None, "", "one", "a b", "A b c", "a b c d a b c", " ".join(f"w{i % 50}" for i in range(400)), "x"]
    for size in (1, 2, 3, 5):
        values, sizes = minhash.shingle_sets(texts, size)
        assert np.split(values, np.cumsum(sizes)[:-1])[3].tolist() == minhash.shingle_set("a b", size).tolist()
        assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == [minhash.shingle_set(t, size).tolist() for t in texts]


def test_jaccard_copies_left_out_by_a_shuffle(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_COPIES", 1)
    rows = near_copies(11, 60)
    got = jaccard.jaccard_join(documents(rows), 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_join(rows, 90)


def test_jaccard_shuffles_pooled_shingles_once(spark, documents, monkeypatch):
    """Shingles are counted where they meet; there is no shuffle for counts and another for rows."""
    plans, cut = [], jaccard.cut_lineage

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *args, **kwargs)

    monkeypatch.setattr(jaccard, "cut_lineage", seen)
    sets = cut(jaccard._pools(documents(near_copies(3, 60)).select(F.col("doc_id").alias("cid"), "text"), 3, 90), "sets")
    jaccard.entries(sets, 90)
    whole = [p for p in plans if "explode(pool" in p and "pmod(xxhash64" not in p]
    assert sum(p.count("explode(pool") for p in whole) == 1


def test_jaccard_hot_shingles_and_short_hashes(spark, documents, monkeypatch):
    """Shingles counted apart, and hashes so short that most of them look alike, change no result."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "HOT_SETS", 8)
    monkeypatch.setattr(jaccard, "UNUSED_BITS", 58)
    rows = near_copies(21, 90)
    got = jaccard.jaccard_join(documents(rows), 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_join(rows, 90)


@pytest.mark.parametrize("copies", [1, 1000])
def test_jaccard_gives_back_the_space_of_its_sets(spark, documents, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_COPIES", copies)
    written, path_of = [], session.scratch_path

    def named(spark, label):
        written.append(path_of(spark, label))
        return written[-1]

    monkeypatch.setattr(session, "scratch_path", named)
    monkeypatch.setattr(jaccard, "scratch_path", named, raising=False)
    got = jaccard.jaccard_join(documents(near_copies(4, 60)), 90)
    pools = [t for t in map(spark.read.parquet, written) if "pool" in t.columns]
    assert pools and all(t.isEmpty() for t in pools)
    assert got.count() == 60
