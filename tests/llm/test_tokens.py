"""Token counts, packing and id files against the tokenizers library."""

import random
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm import binary, counting, packing, vocab

ODD = [
    "", " ", "  ", "a  b", "a   b ", " \n", "a\n \nb", "x \x1c y", "\x85 a  ", "it's 'tis don't I'LL", "naïve ½²³ Ⅷ a1b2",
    "<|endoftext|>", " <|endoftext|> a<|startoftext|>b  <|endoftext|>", "日本語 テキスト", "é ́x", "İstanbul ΑΣ ς", "a\tb\t c",
    "　x   y", "🙂🙂 ok", "A\r\nB", "tail  ", "tail \n", "   x", "a​b", "x" * 3000, "\x00 a",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    tokenizer = vocab.load(name)
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", "'s", "a", "Bc", "é", "1", "…", "!!", " the", " ", "\x1d"]
    texts = ODD + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    for text in texts:
        got = np.frombuffer(vocab.encode_bytes(name, text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_a_text_are_merged_in_one_call(name, monkeypatch):
    """New words of whole texts cost no call each; ids stay those of the library."""
    tokenizer, pieces = vocab.load(name), vocab.piece_ids(name)
    monkeypatch.setattr(pieces, "merge", None)
    calls = []
    merged = pieces.words.packed
    monkeypatch.setattr(pieces.words, "packed", lambda text: calls.append(text) or merged(text))
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéß日"
    marks = [
        "", ".", ",", "'s", "'ll", "'", "1's", "12", ".'s", "…'s", "\n", "\x00", "\u3000", "\x85", "\x1c", "_", "J\u030c", "I\u0307",
        " \u0301", "Σ", "½", "\r\n'", "\t", " ", "  ", "\u212a", "🙂",
    ]
    for _ in range(1500):
        text = " ".join("".join(rng.choices(letters, k=rng.randrange(9))) + "".join(rng.choices(marks, k=2)) for _ in range(32))
        got = np.frombuffer(vocab.encode_bytes(name, text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert calls.pop() == text and not calls


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_long_runs(name):
    tokenizer = vocab.load(name)
    for text in (f"a{' ' * 3000}b", "\n" * 100_000 + "é", "a" + "\u3000\t" * 2000, " " * 499 + "x  y", "'" * 5000 + "s", "1" * 5000):
        got = np.frombuffer(vocab.encode_bytes(name, text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded_in_bytes(monkeypatch):
    name, rng = "word_bpe_49k.json", random.Random(8)
    tokenizer, words = vocab.load(name), vocab.Pieces(name, vocab._packed).words
    monkeypatch.setattr(vocab, "REMEMBERED_BYTES", 20_000)
    for n in range(50):
        text = " ".join(f"wörd{rng.randrange(5_000)} plain{n} " + "é" * rng.choice([1, 3_000]) for _ in range(40))
        assert words.packed(text) == vocab._packed(tokenizer.encode(text, add_special_tokens=False).ids)
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in words.items()) <= words.held <= 20_000


def test_whole_tokens_are_proven():
    tokenizer = vocab.load("byte_bpe_50k.json")
    table = vocab.whole_tokens(tokenizer)
    assert len(table) > 40_000 and "<|endoftext|>" not in table
    for token in random.Random(3).sample(sorted(table), 300):
        assert tokenizer.encode(token, add_special_tokens=False).ids == [table[token]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(odd, odd_rows, name):
    got = sorted(counting.token_counts(odd, name, limit=3).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocab.vocabulary_path(name))
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = vocab.load(name)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in got] == [(i, len((t or "").encode()), count(t or ""), count(t or "") > 3) for i, t in want]


def test_counts_of_nothing(nothing):
    assert counting.token_counts(nothing).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memory_of_pieces_is_bounded_in_bytes(name, monkeypatch):
    rng = random.Random(3)
    tokenizer = vocab.load(name)
    pieces = vocab.Pieces(name, vocab._packed)
    spaceless = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4_000)) for _ in range(40)]
    for text in spaceless:
        got = b"".join(pieces.of(text))
        assert got == vocab._packed(tokenizer.encode(text, add_special_tokens=False).ids)
    assert not pieces and pieces.held == 0
    monkeypatch.setattr(vocab, "REMEMBERED_BYTES", 20_000)
    for n in range(50):
        text = " ".join(f"word{rng.randrange(5_000)} {chr(0x4E00 + n)}" for _ in range(40))
        got = b"".join(pieces.of(text))
        assert got == vocab._packed(tokenizer.encode(text, add_special_tokens=False).ids)
        assert pieces.held <= 20_000
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in pieces.items()) <= pieces.held


def check_packing(rows, capacity=1024):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packed_documents(odd, odd_rows):
    rows = packing.packed_documents(odd).collect()
    check_packing(rows)
    tokenizer = vocab.load("byte_bpe_50k.json")
    want = Counter()
    for doc, text in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing_of_nothing(nothing):
    assert packing.packed_documents(nothing).collect() == []


def brute_bins(lengths, capacity):
    """Fewest bins by search over all assignments."""
    best = [len(lengths)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for f in sorted(set(free)):
            if f >= lengths[i]:
                k = free.index(f)
                place(i + 1, free[:k] + [f - lengths[i]] + free[k + 1 :])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_and_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        bound, fewest = packing.lower_bound(counts, 20), brute_bins(lengths, 20)
        bins, offsets, free = packing.best_fit(np.array(lengths), 20)
        assert -(-sum(lengths) // 20) <= bound <= fewest <= len(free)
        assert free.min() >= 0 and int((20 - free).sum()) == sum(lengths)
    assert packing.lower_bound(np.bincount([513] * 7, minlength=1025)) == 7


def test_partitions_exchange(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randint(1, 1024), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    got = packing.pack(pieces, items=800).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=1025))
    assert check_packing(got) <= bound * 1.02 + 1
    assert {r.round for r in got} > {1}


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint32)
    data = binary.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    for first, count in ((0, 1001), (5, 0), (3, 17), (1000, 1)):
        assert (binary.unpack_bits(data, bits, first, count) == ids[first : first + count]).all()


def test_reader_reads_any_place(tmp_path):
    ids = np.arange(1000, dtype=np.uint32) % 509
    writer = binary.Writer(str(tmp_path), 9, block_ids=64)
    for part in np.array_split(ids, 7):
        writer.add(part)
    writer.close()
    reader = binary.Reader(str(tmp_path), writer.name)
    assert reader.total == 1000
    for start, count in ((0, 1000), (63, 2), (999, 1), (128, 64), (500, 0)):
        assert (reader.ids(start, count) == ids[start : start + count]).all()
    with pytest.raises(ValueError):
        reader.ids(999, 2)


def test_token_files(odd, odd_rows):
    got = binary.token_files(odd).orderBy("start").collect()
    tokenizer = vocab.load("word_bpe_49k.json")
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (doc, text) in zip(got, order, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_many_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i} again") for i in range(50)], "doc_id long, text string")
    index = binary.write_ids(docs, str(tmp_path), file_ids=20, block_ids=8)
    assert index.select("file").distinct().count() > 5
    got = binary.read_ids(index, str(tmp_path), binary.file_starts(index)).orderBy("start").collect()
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.doc_id for r in got] == list(range(50)) and [r.start for r in got] == ends[:-1]


def test_files_of_nothing(nothing):
    assert binary.token_files(nothing).collect() == []


def test_one_table_is_remembered_at_a_time():
    """A worker that serves several stages holds the table of the last one only."""
    from corpusflow.llm import minhash, quality

    quality.features("Some words here")
    assert quality._SHAPES
    minhash.shingle_set("some words here")
    assert minhash._WORDS and not quality._SHAPES
    assert vocab.encode_bytes("byte_bpe_50k.json", "some words here")
    pieces = vocab.piece_ids("byte_bpe_50k.json")
    assert pieces and not minhash._WORDS
    minhash.shingle_set("other words")
    assert not pieces and pieces.held == 0
