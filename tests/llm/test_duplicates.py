"""Near duplicates and repeated passages against brute force."""

import hashlib
import random

import numpy as np

from corpusflow.llm import graph, minhash, substrings


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())


def components_by_force(rows, linked):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if linked(x, y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i, _ in rows}


def similar(x, y):
    a, b = shingles(x), shingles(y)
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def made_documents(n=140):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = f"w{rng.randrange(90)}"
        else:
            words = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 60))]
        rows.append((i * 3, " ".join(words)))
    return rows


def test_components_equal_brute_force(documents):
    rows = made_documents()
    want = components_by_force(rows, similar)
    for large in (32, 2):  # pairs only, and components compared in blocks
        got = minhash.near_duplicates(documents(rows), large_size=large).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)


def test_links_of_blocks_equal_brute_force():
    rows = made_documents(60)
    got = minhash._linked(rows[:25], rows[25:], 80, 2)
    want = [(a, b) for a, x in rows[:25] for b, y in rows[25:] if similar(x, y)]
    assert sorted(got) == sorted(want) and len(want) > 5
    assert minhash._linked(rows[:3], [(1, ""), (2, None)], 80, 2) == []


def test_boundary_of_80_percent(documents):
    # 9 of 10 shared words in order: 8 of 10 shingles in common is 80 of 100 of the union.
    base = [f"a{i}" for i in range(9)]
    rows = [(1, " ".join([*base, "x"])), (2, " ".join(base)), (3, " ".join(base[:6]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == components_by_force(rows, similar)


def test_odd_documents(odd, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True)
    assert found[5][1:] == (4, False) and found[4][1:] == (4, True)
    assert found[6] == (1, 6, True) and found[7] == (1, 6, False)
    assert found[10][1:] == (9, False)
    assert found[None] == (2, None, True)


def test_no_documents(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    x, y = minhash.minmax(a), minhash.minmax(b)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - truth) < 0.12


def test_components_of_a_long_chain(spark):
    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (None, 3), (900, 901)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}
    assert graph.components(edges.limit(0)).collect() == []


def repeats_by_force(rows, window):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(documents):
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(0, 5)):
            part = list(rng.choice(passages))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = f"e{rng.randrange(50)}"
            words += part + [f"u{rng.randrange(20)}" for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(60), "  ".join(words)))
    rows += [(70, "same " * 200), (71, "same " * 90), (72, "other " + "same " * 30)]
    want = repeats_by_force(rows, 8)
    docs = documents(rows)
    for limit in (20_000, 40):  # sorted in buckets, and dealt out by window
        got = substrings.without_repeats(docs, window=8, part=3, bucket_windows=limit).drop("kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_repeats_of_odd_documents(odd, odd_rows):
    got = substrings.without_repeats(odd).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats_by_force(odd_rows, 50)


def test_repeats_of_nothing(nothing):
    assert substrings.without_repeats(nothing).collect() == []


def test_super_kmers_cover_all_windows():
    rng = random.Random(9)
    words = [b"w%d" % rng.randrange(5) for _ in range(300)]
    runs = substrings.super_kmers(words, 20, 6)
    assert runs[0][2] == 0 and sum(r[3] for r in runs) == 281
    assert all(a[2] + a[3] == b[2] and a[0] != b[0] for a, b in zip(runs, runs[1:]))
    assert substrings.super_kmers(words[:19], 20, 6) == []
