import random

from pyspark.sql import functions as F

from corpusflow.functions.text import clean_text
from corpusflow.operators import chunking


def split(text, size, overlap):
    return [text[a:b] for a, b in chunking.text_spans(text, size, overlap)]


def test_short_text_is_one_chunk():
    assert split("one two", 20, 5) == ["one two"]


def test_words_are_joined_with_overlap():
    assert split("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


def test_long_word_is_cut_by_characters():
    assert split("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]


def test_coarse_separator_first():
    assert split("aaa bbb\nccc ddd\neee", 9, 0) == ["aaa bbb", "ccc ddd", "eee"]


def test_invariants():
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "word ", "数据"]) for _ in range(rng.randrange(1, 400)))
        text = "\n".join(line.strip() for line in text.split("\n") if line.strip())
        spans = chunking.text_spans(text, 40, 10)
        covered = set()
        for (a, b), nxt in zip(spans, spans[1:] + [(len(text), len(text))]):
            assert 0 < b - a <= 40 and text[a:b] == text[a:b].strip()
            assert a < nxt[0] or nxt[0] == len(text)
            covered.update(range(a, b))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_chunk_documents(spark):
    texts = [(1, "s", "alpha beta " * 100), (2, "t", "短文本"), (3, "u", "")]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string").withColumn("text", clean_text(F.col("text")))
    rows = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_idx").collect()
    full = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == {1, 2}
    assert all(len(r.text) <= 512 and full[r.doc_id][r.start_index:].startswith(r.text) for r in rows)
    assert rows[0].chunk_id == "s_0" and rows[-1].text == "短文本"


MARKDOWN = """intro text before any heading
# Title
first part of the body text
#### level four stays text
## Sub
too short
## Sub
after the same heading again
### Deep
```
# not a heading inside code
```
# Second
{long}"""


def test_markdown_sections(spark):
    text = MARKDOWN.format(long="word " * 205 + "end")
    docs = spark.createDataFrame([(1, "a.md", text)], "doc_id long, source string, text string")
    rows = chunking.markdown_sections(docs).orderBy("section_idx").collect()
    assert [(r.header1, r.header2, r.header3) for r in rows] == [
        (None, None, None), ("Title", None, None), ("Title", "Sub", None), ("Title", "Sub", "Deep"), ("Second", None, None),
    ]
    assert rows[1].text == "first part of the body text\n#### level four stays text"
    assert rows[2].text == "too short  \nafter the same heading again"
    assert rows[3].text == "```\n# not a heading inside code\n```"
    chunks = chunking.markdown_chunks(docs).orderBy("section_idx", "sub_idx").collect()
    assert [c.chunk_id for c in chunks][:4] == ["a.md_0", "a.md_1", "a.md_2", "a.md_3"]
    cut = [c for c in chunks if c.section_idx == 4]
    assert len(cut) > 1 and [c.chunk_id for c in cut][:2] == ["a.md_4_0", "a.md_4_1"]
    assert {c.section for c in cut} == {"Second"} and chunks[1].section is None


def test_short_section_leaves_a_gap(spark):
    text = "# A\nlong enough section text\n# B\nshort\n# C\nanother long enough section"
    docs = spark.createDataFrame([(1, "a.md", text)], "doc_id long, source string, text string")
    assert sorted(c.chunk_id for c in chunking.markdown_chunks(docs).collect()) == ["a.md_0", "a.md_2"]


def test_results_of_a_batch_leave_in_parts(spark, monkeypatch):
    """A task holds the results of a few texts, whatever the number of rows in a batch."""
    from corpusflow.functions import batches

    monkeypatch.setattr(batches, "BATCH_ROWS", 4)
    rows = [(i, f"s{i}", None if i == 3 else "a b c " * i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)
    got = batches.exploded(df, ["doc_id"], "text", lambda t: enumerate(t.split()), [("n", "int"), ("word", "string")]).collect()
    assert [tuple(r) for r in got] == [(i, n, w) for i, _, t in rows if t for n, w in enumerate(t.split())]


def test_windows_by_search_equal_windows_piece_by_piece():
    def by_piece(cuts, size, overlap):
        pieces, out, first = list(zip(cuts, cuts[1:])), [], 0
        for i, (a, b) in enumerate(pieces):
            if i > first and b - pieces[first][0] > size:
                out.append((pieces[first][0], a))
                while first < i and (a - pieces[first][0] > overlap or b - pieces[first][0] > size):
                    first += 1
        return [*out, (pieces[first][0], pieces[-1][1])] if pieces else out

    rng = random.Random(3)
    for _ in range(2000):
        size, overlap = rng.randrange(2, 30), rng.randrange(0, 30)
        cuts = [0]
        for _ in range(rng.randrange(0, 40)):
            cuts.append(cuts[-1] + rng.randrange(1, size))
        assert chunking._windows(cuts, size, overlap) == by_piece(cuts, size, overlap)
