from corpusflow.sources import files
from corpusflow.sources.stores import Registry


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" x \n\n y ", encoding="utf-8")
    (tmp_path / "b.MD").write_text("# T\n\ntext", encoding="utf-8")
    (tmp_path / "c.xyz").write_text("no", encoding="utf-8")
    rows = {r.source: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "x\ny", "b.MD": "# T\ntext"}
    rejected = files.rejected_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in rejected] == [("c.xyz", "unsupported file type: xyz")]


def test_document_keys_are_full_hashes(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(f"text {i}", encoding="utf-8")
    keys = [r.doc_id for r in files.read_documents(spark, str(tmp_path)).collect()]
    assert len(set(keys)) == 40 and min(keys) < 0 and max(abs(k) for k in keys) >= 2**60


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"two\nlines, and ""quotes"""\n2, spaced \n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_csv(spark, str(path)).collect()]
    assert rows == [("1", 'two\nlines, and "quotes"'), ("2", " spaced ")]
    files.write_csv(files.read_csv(spark, str(path)), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == rows


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n,\n1,NA\n2,x\n,\n", encoding="utf-8")
    rows = [tuple(r) for r in files.read_csv(spark, str(path)).collect()]
    assert rows == [("1", None), ("2", "x"), (None, None)]
    assert files.read_csv(spark, str(path), nrows=2).count() == 1


def test_csv_first_row_with_values_stays(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a.b,c\n1,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("1", None)]


def test_write_cleaned(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_cleaned(df, df.select("a"), df.select("b"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out" / "cleaned")).collect()[0].b == "x"


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert registry.table().count() == 0
    rows = spark.createDataFrame([("h1", ["a"]), ("h2", ["b", "c"])], "file_hash string, chunk_ids array<string>")
    registry.register(rows)
    registry.register(spark.createDataFrame([("h1", ["z"])], rows.schema))
    assert registry.chunk_ids("h1").first().chunk_ids == ["z"]
    registry.remove(spark.createDataFrame([("h2",)], "file_hash string"))
    assert {r.file_hash for r in registry.table().collect()} == {"h1"}
    registry.clear()
    assert registry.table().count() == 0


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    """One large file is read by several tasks, unless a field holds a line break."""
    plain, broken = str(tmp_path / "plain.csv"), str(tmp_path / "broken.csv")
    with open(plain, "w") as out:
        out.write("a,b\n,\n" + "".join(f'{i},"x ""{i}"" , y"\n' for i in range(60_000)))
    with open(broken, "w") as out:
        out.write('a,b\n1,"two\nlines"\n2,plain\n')
    assert not files.has_open_quotes(spark, plain) and files.has_open_quotes(spark, broken)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = files.read_csv(spark, plain)
        assert rows.rdd.getNumPartitions() > 3
        assert rows.count() == 60_000 and rows.filter("a = '7'").first().b == 'x "7" , y'
        assert rows.select("a").distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in files.read_csv(spark, broken).collect()] == [("1", "two\nlines"), ("2", "plain")]
