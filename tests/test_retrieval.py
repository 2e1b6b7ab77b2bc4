import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import context, dense, fusion, rerank, sparse
from corpusflow.plans import retrieval
from corpusflow.sources.stores import IndexStore

TEXTS = [
    "the cat sat on the mat", "a dog and a cat", "the dog barks", "birds fly over the sea", "cat cat cat", "",
    "sea birds and fish", "fish swim", "   ", "dog dog barks at the cat",
]


def brute_bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: np.log(n - f + 0.5) - np.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else eps * mean for t, v in idf.items()}
    return [
        sum(idf.get(q, 0) * d.count(q) * (k1 + 1) / (d.count(q) + k1 * (1 - b + b * len(d) / avg)) for q in query.split())
        for d in docs
    ]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_key long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "cat dog dog"), (1, "fish sea"), (2, "unknown")], "query_id long, text string")


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_key, round(r.score, 9)) for r in df.collect())


def expected():
    kept = [(i, t) for i, t in enumerate(TEXTS) if t.strip()]
    out = []
    for q, text in [(0, "cat dog dog"), (1, "fish sea")]:
        scores = brute_bm25([t for _, t in kept], text)
        order = sorted(zip(scores, kept), key=lambda x: (-round(x[0], 9), x[1][0]))[:4]
        out += [(q, r, doc[0], round(s, 9)) for r, (s, doc) in enumerate(order, 1) if s > 0]
    return sorted(out)


def test_bm25_equals_brute_force(chunks, queries):
    assert found(sparse.search(sparse.build_index(chunks), queries, 4)) == expected()


def test_query_batches_and_document_blocks_give_the_same(chunks, queries, monkeypatch):
    monkeypatch.setattr(sparse, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(sparse, "BATCH_QUERIES", 1)
    monkeypatch.setattr(sparse, "BLOCK_DOCS", 2)
    assert found(sparse.search(sparse.build_index(chunks), queries, 4)) == expected()


def test_no_shuffle_of_query_document_pairs(chunks, queries):
    plan = sparse.scored_documents(sparse.build_index(chunks), queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_search_of_nothing(chunks, queries):
    assert sparse.search(sparse.build_index(chunks.limit(0)), queries, 4).collect() == []
    assert sparse.search(sparse.build_index(chunks), queries.limit(0), 4).collect() == []


def test_append_equals_rebuild(chunks, queries):
    first = sparse.build_index(chunks.filter("chunk_key < 4"))
    grown = sparse.append(first, chunks.filter("chunk_key >= 4"), "chunk_key", "text")
    assert found(sparse.search(grown, queries, 4)) == expected()


def test_stored_index(spark, chunks, queries, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    name = "demo `1`; --"
    store.save(name, sparse.build_documents(chunks.limit(3), "chunk_key", "text"))
    store.save(name, sparse.build_documents(chunks, "chunk_key", "text"))
    assert found(sparse.search(store.load(name), queries, 4)) == expected()
    assert store.collections() == [name]
    files = [f for f in (tmp_path / "index" / name.encode().hex()).rglob("*.parquet")]
    assert sum(spark.read.parquet(str(f)).count() for f in files if f.parent.name == "documents") == 8
    store.clear()
    assert store.collections() == []
    with pytest.raises(KeyError):
        store.load(name)
    assert all(spark.read.parquet(str(f)).count() == 0 for f in (tmp_path / "index" / name.encode().hex()).rglob("*.parquet"))


def test_top_k_is_limited_before_the_shuffle(chunks, queries):
    plan = sparse.search(sparse.build_index(chunks), queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 8)).astype("float32")
    data[100:250] = data[99]  # a third of all rows are the same vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "chunk_key long, embedding array<float>").repartition(3)


def brute_nearest(data, queries, k):
    out = []
    for q in queries:
        dist = np.round(((data.astype(float) - data[q].astype(float)) ** 2).sum(1), 9)
        out += [(q, r, int(i)) for r, i in enumerate(np.lexsort((np.arange(len(data)), dist))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "cell_bytes"), [(4096, dense.CELL_BYTES), (5, dense.CELL_BYTES), (2, 4096)])
def test_nearest_equals_brute_force(spark, vectors, limit, cell_bytes):
    """With a low limit queries and vectors meet in a grid: two cells, then four by several."""
    data, corpus = vectors
    ids = [0, 7, 99, 120, 300, 301, 399]
    queries = corpus.filter(F.col("chunk_key").isin(ids)).withColumnRenamed("chunk_key", "query_id")
    near = dense.nearest(corpus, queries, 6, limit, cell_bytes)
    assert sorted((r.query_id, r["rank"], r.chunk_key) for r in near.collect()) == brute_nearest(data, ids, 6)


@pytest.mark.parametrize("limit", [4096, 3])
def test_nearest_in_doubles_without_nulls(spark, limit):
    """Distances far below the precision of a float, and rows that have no vector."""
    rows = [(i, [1.0 + i * 1e-9, 2.0]) for i in range(8)]
    frame = spark.createDataFrame([*rows, (90, None), (91, [1.0, None])], "chunk_key long, embedding array<double>")
    near = dense.nearest(frame, frame.withColumnRenamed("chunk_key", "query_id"), 2, max_queries=limit).collect()
    assert {r.query_id for r in near} == set(range(8)) and {r.chunk_key for r in near} <= set(range(8))
    far = dense.nearest(frame.limit(0), frame.withColumnRenamed("chunk_key", "query_id"), 2, max_queries=limit)
    assert far.collect() == []
    assert dense.nearest(frame, frame.limit(0).withColumnRenamed("chunk_key", "query_id"), 2).collect() == []


def test_grid_deals_repeated_rows(spark):
    """One key and vector in most rows, queries without a corpus, and no driver loop over queries."""
    rows = [(7, [1.0, 0.0])] * 60 + [(i, [float(i), 1.0]) for i in range(20, 40)]
    frame = spark.createDataFrame(rows, "chunk_key long, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "query_id long, embedding array<double>")
    grid = dense.nearest(frame, asked, 3, 2, 160)
    plain = dense.nearest(frame, asked, 3)
    order = lambda df: sorted((r.query_id, r["rank"], r.chunk_key, r.distance) for r in df.collect())
    assert order(grid) == order(plain) and len(order(grid)) == 27
    assert dense.nearest(frame.limit(0), asked, 3, 2, 160).collect() == []


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_key string, rank int, score double")


def test_rrf(spark):
    a = ranked(spark, [(1, "d1", 1, 9.0), (1, "d2", 2, 8.0)])
    b = ranked(spark, [(1, "d2", 1, 5.0), (1, "d3", 2, 4.0)])
    got = {r.chunk_key: r for r in fusion.reciprocal_rank([a, b], 5, [0.5, 0.5]).collect()}
    assert got["d2"].rrf_score == pytest.approx(0.5 / 62 + 0.5 / 61)
    assert got["d1"].rrf_score == pytest.approx(0.5 / 61) and got["d3"].rrf_score == pytest.approx(0.5 / 62)
    assert got["d2"].ranks == {0: 2, 1: 1} and got["d2"].original_scores == {0: 8.0, 1: 5.0}
    assert [got[k]["rank"] for k in ("d2", "d1", "d3")] == [1, 2, 3]


def test_repeated_key_in_one_list(spark):
    a = ranked(spark, [(1, "d", 1, 9.0), (1, "d", 3, 7.0)])
    row = fusion.reciprocal_rank([a], 5).first()
    assert row.rrf_score == pytest.approx(1 / 61 + 1 / 63)
    assert row.ranks == {0: 3} and row.original_scores == {0: 7.0}


def test_flat_list_scores_zero(spark):
    got = fusion.score_level([ranked(spark, [(1, "a", 1, 3.0), (1, "b", 2, 3.0)])], 5)
    assert [r.fused_score for r in got.collect()] == [0.0, 0.0]


def test_min_treats_zero_as_unset(spark):
    a = ranked(spark, [(1, "x", 1, 2.0), (1, "d", 2, 1.0)])
    b = ranked(spark, [(1, "d", 1, 4.0), (1, "y", 2, 2.0), (1, "z", 3, 0.0)])
    got = {r.chunk_key: r.fused_score for r in fusion.fuse("min", [a, b], 5).collect()}
    assert got["d"] == pytest.approx(0.5) and got["y"] == pytest.approx(0.25)


def test_unknown_method_is_rrf(spark):
    assert "rrf_score" in fusion.fuse("other", [ranked(spark, [(1, "a", 1, 3.0)])]).columns


def test_rerank_without_model(spark):
    rows = [(1, "a", 1, 3.0), (1, "b", 2, 3.0), (1, "c", 3, 1.0)]
    got = [r.rerank_score for r in rerank.rerank_without_model(ranked(spark, rows), 3).orderBy("rank").collect()]
    assert got == pytest.approx([1.0, 0.9, 0.8])


def test_pack(spark):
    parts = [(1, i, "x" * n) for i, n in enumerate([3000, 900, 200, 50], 1)] + [(2, 1, "y" * 5000)]
    df = spark.createDataFrame(parts, "query_id long, rank int, part string")
    got = {r.query_id: r for r in context.packed_context(df, 4000).collect()}
    assert got[1].n_parts == 2 and got[1].context == "x" * 3000 + "\n---\n" + "x" * 900
    assert got[2].n_parts == 0 and got[2].context == ""


def test_part_formats(spark):
    df = spark.createDataFrame([("s", "h", 0.5, "t")], "source string, section string, d double, text string")
    s, h, d, t = (F.col(c) for c in ("source", "section", "d", "text"))
    row = df.select(context.distance_part(s, d, t), context.vector_part(s, h, d, t), context.vector_part(s, F.lit(""), d, t)).first()
    assert list(row) == ["[来源: s, 相关度: 0.50]\nt\n", "[来源: s | 章节: h | 相关度: 0.75]\nt\n", "[来源: s | 相关度: 0.75]\nt\n"]


def test_web_and_document_formats(spark):
    df = spark.createDataFrame([(1, 1, "T", "u", "s", "doc"), (1, 2, "U", "", "r", "more")], "query_id int, rank int, title string, url string, snippet string, text string")
    assert context.web_context(df).first().context == "[网页 1: T]\n链接: u\ns\n\n---\n\n[网页 2: U]\nr"
    assert context.web_listing(df).first().context.startswith("【网页搜索结果】\n\n1. T\n   链接: u\n   摘要: s\n\n2. U")
    assert context.numbered_documents(df).first().context == "[文档1] doc\n\n[文档2] more"
    both = context.combined_context(context.numbered_documents(df), context.web_context(df)).first().context
    assert both.index("知识库") < both.index("网络")


def test_without_sparse_index_the_result_is_tagged(spark, vectors, chunks):
    data, corpus = vectors
    docs = spark.createDataFrame([(i, "s", "", f"text {i}") for i in range(400)], "chunk_key long, source string, section string, text string")
    queries = corpus.filter("chunk_key < 2").select(F.col("chunk_key").alias("query_id"), F.lit("text 1").alias("text"), "embedding")
    rows = retrieval.hybrid_search(None, corpus, docs, queries).collect()
    assert {r.method for r in rows} == {"vector_only"} and len(rows) == 10
