import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import dedup


def brute(rows, d, seen=()):
    kept, out = [], {}
    for ord_, sig in sorted(rows):
        if any(bin((sig ^ s) & (2**64 - 1)).count("1") <= d for s in seen):
            out[ord_] = ("known", None)
            continue
        near = [o for o, s in kept if bin((sig ^ s) & (2**64 - 1)).count("1") <= d]
        out[ord_] = ("dup", near[0]) if near else ("kept", None)
        if not near:
            kept.append((ord_, sig))
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def clustered(n, seed, clusters=8):
    """Signatures near a few centres, a third of them one value."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    rows = []
    for i in range(n):
        sig = centres[0] if i % 3 == 0 else rng.choice(centres)
        for _ in range(0 if i % 3 == 0 else rng.randrange(7)):
            sig ^= 1 << rng.randrange(64)
        rows.append((i, signed(sig)))
    return rows


def verdicts(df):
    return {
        r.ord: ("known", None) if r.known else (("dup", r.duplicate_of) if r.duplicate_of is not None else ("kept", None))
        for r in df.collect()
    }


@pytest.mark.parametrize("limit, hot", [(2000, 1_000_000), (8, 20)])
def test_near_duplicates_equal_sequential_scan(spark, limit, hot):
    """Small limits force bucket division and the broadcast of hot keys."""
    rows = clustered(300, 3)
    df = spark.createDataFrame(rows, "ord long, signature long")
    assert verdicts(dedup.near_duplicates(df, 3, limit=limit, hot_rows=hot)) == brute(rows, 3)


@pytest.mark.parametrize("small", [True, False])
def test_against_seen(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(dedup, "is_small", lambda *a, **k: False)
    rows, old = clustered(150, 4), [s for _, s in clustered(20, 4, clusters=3)]
    df = spark.createDataFrame(rows, "ord long, signature long")
    seen = spark.createDataFrame([(s,) for s in old], "signature long")
    assert verdicts(dedup.near_duplicates(df, 3, seen=seen)) == brute(rows, 3, old)


def test_chain_keeps_both_ends(spark):
    rows = [(0, 0), (1, 0b111), (2, 0b111111)]
    df = spark.createDataFrame(rows, "ord long, signature long")
    assert verdicts(dedup.near_duplicates(df, 3)) == {0: ("kept", None), 1: ("dup", 0), 2: ("kept", None)}


def test_pairs_equal_brute_force(spark):
    rows = list({s: (o, s) for o, s in clustered(200, 9)}.values())
    df = spark.createDataFrame(rows, "ord long, signature long")
    want = {
        (min(a, b), max(a, b)) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= 3
    }
    for limit in (2000, 5):
        assert {(r.first, r.second) for r in dedup.close_pairs(df, 3, limit).collect()} == want


@pytest.mark.parametrize("n, d", [(100, 3), (10**6, 3), (10**9, 3), (100, 1), (100, 0)])
def test_masks_cover_every_close_pair(n, d):
    masks = dedup.start_masks(n, d)
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), d))
        assert any(flips & m == 0 for m in masks)
        agreed = next(m for m in masks if flips & m == 0)
        finer = dedup.finer_masks(agreed, d)
        assert not finer or any(flips & f == 0 for f in finer)


def test_new_files(spark):
    files = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "c")], "doc_id long, file_hash string")
    registry = spark.createDataFrame([("b",)], "file_hash string")
    got = sorted((r.file_hash, r.doc_id) for r in dedup.new_files(files, registry, "doc_id").collect())
    assert got == [("a", 1), ("c", 4)]


def test_chunk_ordinal(spark):
    """Any document number fits, negative ones and those that agree in their low 41 bits included."""
    rows = [(-5, 1), (-5, 0), (7, 2**30), (7, 3), (7 + 2**41, 0), (2**62, 9)]
    df = spark.createDataFrame(rows, "d long, c int")
    number = F.col("d"), F.col("c")
    got = df.select(dedup.chunk_ordinal(*number).alias("o"), dedup.chunk_key(*number).alias("k")).orderBy("o").collect()
    assert [tuple(r.o) for r in got] == sorted(rows)
    assert len({r.k for r in got}) == len(rows)


def test_near_duplicates_in_order_of_chunks(spark):
    rows = [(-1, 0, 65_535), (3, 0, 65_535), (3, 1, 1 << 40), (2, 9, (1 << 40) + 1)]
    df = spark.createDataFrame(rows, "d long, c int, signature long")
    df = df.select(dedup.chunk_ordinal(F.col("d"), F.col("c")).alias("ord"), "signature")
    got = {tuple(r.ord): r.duplicate_of and tuple(r.duplicate_of) for r in dedup.near_duplicates(df, 3).collect()}
    assert got == {(-1, 0): None, (3, 0): (-1, 0), (2, 9): None, (3, 1): (2, 9)}


def test_bit_counts_equal_a_count_by_hand(monkeypatch):
    """Rows of any length, longer ones in pieces; a slice of an array counts its own rows only."""
    import hashlib

    import pyarrow as pa

    monkeypatch.setattr(dedup, "STEP_WORDS", 7)
    rows = [["a", "b", "a"], None, [], ["w"] * 40, ["x", "y"], [f"v{i}" for i in range(23)], ["z"]]
    counts, lengths = dedup._bit_counts(pa.array([["skipped"], *rows]).slice(1))
    assert lengths.tolist() == [len(r or []) for r in rows]
    for row, got in zip(rows, counts.tolist()):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in row or []]
        assert got == [sum(h >> i & 1 for h in hashes) for i in range(64)]


def test_words_cut_out_by_bytes_are_the_words_of_the_pattern(spark):
    """Texts of any script, blank ones, neighbours that end and begin with words, and slices of an array."""
    from corpusflow.functions import batches, text

    rows = [None, "", "a", "b c", "_x-9 y", " Straße ÉTÉ—Ünïcode x", "漢字kanji 漢", "KK İx", "٣ ½ áb", "!?", "tail", "\U0001f600z\U00020000"]
    frame = spark.createDataFrame(list(enumerate(rows)), "k long, text string").coalesce(1)
    lowered = F.lower(F.col("text"))
    pairs = [(text.words(F.col("text")), text.spaced(lowered)), (text.index_tokens(F.col("text")), text.spaced_index_tokens(F.col("text")))]
    for listed, joined in pairs:
        got = frame.select(listed.alias("a"), joined.alias("b")).toArrow()
        want = [x or [] for x in got.column(0).to_pylist()]
        whole = got.column(1).combine_chunks()
        for part, rest in ((whole, want), (whole.slice(2, 7), want[2:9]), (whole.slice(0, 0), [])):
            words, lengths = batches.words_of(part)
            assert lengths.tolist() == [len(x) for x in rest]
            assert words.to_pylist() == [w for x in rest for w in x]


def test_vectors_from_counts_made_with_the_signatures(spark):
    rows = [(1, "a b c a", 7), (2, "", 8), (3, "x " * 300, 9), (4, None, 1)]
    frame = spark.createDataFrame(rows, "k long, text string, more long")
    once = dedup.with_signature(frame)
    assert once.columns == ["k", "text", "more", "signature", "word_bits"]
    assert {(r.k, r.more, r.signature) for r in once.collect()} == {
        (r.k, r.more, r.signature) for r in dedup.projected_signature(frame, "k").join(frame, "k").collect()
    }
    # Without the text nothing can be counted again.
    got = {r.k: r.embedding for r in dedup.projected_vector(once.drop("text"), "k").collect()}
    assert got == {r.k: r.embedding for r in dedup.projected_vector(frame, "k").collect()}


@pytest.mark.parametrize("n", [400_000, 24_000_000])
def test_masks_tell_all_rows_apart(n):
    """Fewer parts than rows leave a number of pairs a row that grows with the table."""
    assert all(bin(m).count("1") >= n.bit_length() for m in dedup.start_masks(n, 3))
