"""The stored corpus: vectors, band index, log, removal, compaction."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.hashing import file_hash, hamming
from corpusflow.functions.text import clean_text
from corpusflow.operators import dedup, sparse
from corpusflow.plans import retrieval
from corpusflow.plans.ingest import SCHEMAS, Corpus, ingest


def texts(lo, hi):
    rng = random.Random(lo)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    return [(i, f"src{i % 3}", " ".join(word() for _ in range(60))) for i in range(lo, hi)]


@pytest.fixture(scope="module")
def rows():
    base = texts(0, 30)
    # An exact copy of a file, and a copy with another word order (the same words, so the same signature).
    return [*base, (30, "src0", base[3][2]), (31, "src1", " ".join(reversed(base[4][2].split())))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def corpus(spark, frame, tmp_path_factory):
    corpus = Corpus(spark, str(tmp_path_factory.mktemp("corpus")))
    for batch in range(3):
        ingest(corpus, frame.filter(F.floor(F.col("doc_id") / 12) == batch), batch)
    return corpus


def documents_of(corpus):
    return sorted(r.doc_id for r in corpus.read("chunks").select("doc_id").distinct().collect())


def test_copies_across_batches_are_left_out(corpus):
    assert documents_of(corpus) == list(range(30))


def test_every_chunk_has_its_rows(corpus):
    n = corpus.read("chunks").count()
    keys = corpus.read("chunks").select("chunk_key")
    for name in ("vectors", "postings", "signatures"):
        assert corpus.read(name).count() == n
        assert corpus.read(name).join(keys, "chunk_key", "left_anti").isEmpty()
    assert corpus.read("bands").count() == n * len(dedup.band_masks(3))


def test_stored_search_equals_search_over_the_chunks(corpus, frame):
    queries = frame.filter("doc_id in (2, 17, 25)").select(F.col("doc_id").alias("query_id"), F.substring("text", 20, 120).alias("text"))
    chunks = corpus.read("chunks").withColumn("section", F.lit(None).cast("string"))
    vectors = dedup.projected_vector(chunks, "chunk_key")
    asked = queries.join(dedup.projected_vector(queries, "query_id"), "query_id")
    want = retrieval.hybrid_search(sparse.build_index(chunks), vectors, chunks, asked)
    columns = ["query_id", "chunk_key", "rank", "source", "method"]
    got = corpus.search(queries).select(columns).collect()
    assert sorted(got) == sorted(want.select(columns).collect())
    found = {r.query_id: r.chunk_key for r in got if r.rank == 1}
    key = {r.doc_id: r.chunk_key for r in corpus.read("chunks").collect()}
    assert found == {q: key[q] for q in (2, 17, 25)}


def test_any_embedder(spark, frame, tmp_path):
    def lengths(rows, key):
        return rows.select(key, F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"))

    corpus = Corpus(spark, str(tmp_path / "c"), embed=lengths)
    ingest(corpus, frame.filter("doc_id < 5"), 0)
    assert {len(r.embedding) for r in corpus.read("vectors").collect()} == {2}


def test_bands_hold_every_close_pair(spark):
    rng = random.Random(9)
    old = [rng.getrandbits(63) for _ in range(200)]
    new = [(i, s ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 6)))) for i, s in enumerate(old[:100])]
    new += [(1000 + i, rng.getrandbits(63)) for i in range(50)]
    fresh = spark.createDataFrame(new, "ord long, signature long")
    stored = spark.createDataFrame([(s,) for s in old], "signature long")
    bands = dedup.band_rows(stored, 3)
    got = {r.ord for r in dedup.close_to_bands(fresh, bands, 3).collect()}
    assert got == {i for i, s in new if any((s ^ o).bit_count() <= 3 for o in old)}
    pairs = fresh.crossJoin(stored.withColumnRenamed("signature", "o")).filter(hamming(F.col("signature"), F.col("o")) <= 3)
    assert got == {r.ord for r in pairs.collect()}


def test_a_batch_reads_only_the_bands_it_falls_into(spark, corpus, monkeypatch):
    one = spark.createDataFrame([(1, 12345)], "ord long, signature long")
    stored = corpus.read("bands")
    touched = {r.band for r in dedup.band_rows(one, 3).collect()}
    assert len(touched) == 10 and {r.band for r in stored.select("band").distinct().collect()} > touched
    read = []
    real = type(stored).filter
    monkeypatch.setattr(type(stored), "filter", lambda self, c: read.append(real(self, c)) or read[-1])
    dedup.close_to_bands(one, stored, 3).count()
    files = read[0].select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("band=")[1].split("/")[0]) for r in files} <= touched


def test_half_a_batch_is_not_seen(spark, frame, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path / "c"))
    ingest(corpus, frame.filter("doc_id < 6"), 0)
    before = {n: corpus.read(n).count() for n in SCHEMAS}
    real = Corpus.write

    def fails(self, name, rows, batch):
        if name == "registry":
            raise RuntimeError("lost")
        real(self, name, rows, batch)

    with monkeypatch.context() as patch:
        patch.setattr(Corpus, "write", fails)
        with pytest.raises(RuntimeError):
            ingest(corpus, frame.filter("doc_id between 6 and 9"), 1)
    assert {n: corpus.read(n).count() for n in SCHEMAS} == before
    ingest(corpus, frame.filter("doc_id between 6 and 9"), 1)
    assert documents_of(corpus) == list(range(10))


def test_removed_files_are_gone_and_may_come_again(spark, frame, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    for batch in range(2):
        ingest(corpus, frame.filter(F.floor(F.col("doc_id") / 5) == batch), batch)
    hashed = frame.select("doc_id", file_hash(clean_text(F.col("text"))).alias("file_hash"))
    corpus.remove(hashed.filter("doc_id in (3, 7)").select("file_hash"))
    assert documents_of(corpus) == [0, 1, 2, 4, 5, 6, 8, 9]
    assert corpus.read("registry").count() == 8 and corpus.read("vectors").count() == corpus.read("chunks").count()
    asked = frame.filter("doc_id = 3").select(F.col("doc_id").alias("query_id"), "text")
    gone = dedup.chunk_key(F.lit(3).cast("long"), F.lit(0))
    assert corpus.search(asked).filter(F.col("chunk_key") == gone).isEmpty()
    # The word-order copy of document 4 stays out, removed documents come in again.
    ingest(corpus, frame.filter("doc_id in (3, 7, 31)"), 2)
    assert documents_of(corpus) == list(range(10))
    assert not corpus.search(asked).filter(F.col("chunk_key") == gone).isEmpty()
    tables = {n: sorted(map(str, corpus.read(n).drop("batch").collect())) for n in SCHEMAS}
    corpus.compact()
    assert len(corpus.visible()) == 1
    assert {n: sorted(map(str, corpus.read(n).drop("batch").collect())) for n in SCHEMAS} == tables
    ingest(corpus, frame.filter("doc_id in (3, 4, 11)"), 3)
    assert documents_of(corpus) == [*range(10), 11]
    corpus.clear()
    assert all(corpus.read(n).isEmpty() for n in SCHEMAS)
    ingest(corpus, frame.filter("doc_id < 2"), 4)
    assert documents_of(corpus) == [0, 1]


def test_projections_of_any_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(230_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, long), (5, "a b"), (6, long)]
    frame = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    got = {r.k: r.embedding for r in dedup.projected_vector(frame, "k").collect()}
    assert got[1] == got[2] == [0.0] * 64
    assert set(got[3]) == {1.0, -1.0} and got[4] == got[6]
    counts = [0] * 64
    times = {f"w{j}": len(range(j, 230_000, 977)) for j in range(977)}
    for word, n in times.items():
        value = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
        for b in range(64):
            counts[b] += n * (value >> b & 1)
    assert got[4] == pytest.approx([2 * c / 230_000 - 1 for c in counts])
    signature = {r.k: r.signature for r in dedup.projected_signature(frame, "k").collect()}
    want = sum(1 << b for b in range(64) if counts[b] * 64 > sum(counts))
    assert signature[4] % 2**64 == want and signature[1] == signature[2] == 0
