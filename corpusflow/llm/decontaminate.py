"""Benchmark passages in documents, found with a bounded number of edits."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per 20 characters of a normalised item.
CHARS_PER_EDIT = 20
#: Shorter items may be common phrases: they are found at word boundaries only.
MIN_CHARS = 40
#: Characters of items searched in one pass over the documents; more items take more passes.
PASS_CHARS = 4_000_000

_SPACE = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their places.

    An occurrence with at most ``edits`` edits leaves one piece untouched.
    """
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern: str, window: str, edits: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``pattern`` to a substring of ``window`` and that substring's end.

    Myers' bit-parallel columns: one step per character on integers of
    len(pattern) bits. None if the distance exceeds ``edits``; the first end wins ties.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best: tuple[int, int] | None = None
    for at, c in enumerate(window):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score <= edits and (best is None or score < best[0]):
            best = score, at + 1
    return best


def _in_word(c: str) -> bool:
    """Letters and digits of scripts that put spaces between words (Thai to Burmese, Khmer and Chinese to Japanese do not)."""
    return c.isalnum() and not ("\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\ua4cf" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000")


def boundary(text: str, at: int) -> bool:
    """True if no word goes on across place ``at`` of the text."""
    return not 0 < at < len(text) or not (_in_word(text[at - 1]) and _in_word(text[at]))


def distance(a: str, b: str) -> int:
    """Edit distance of two short strings."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def best_words(pattern: str, text: str, low: int, high: int, edits: int) -> tuple[int, int] | None:
    """``best_match`` of a short item in text[low:high], for substrings that begin and end at word boundaries; ends count from 0."""
    best: tuple[int, int] | None = None
    m = len(pattern)
    for start in range(low, high):
        if not boundary(text, start):
            continue
        for end in range(max(start + 1, start + m - edits), min(high, start + m + edits) + 1):
            if boundary(text, end):
                hit = distance(pattern, text[start:end]), end
                if hit[0] <= edits and (best is None or hit < best):
                    best = hit
    return best


class Searcher:
    """Exact piece hits of many items in one scan, verified around each hit."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, min_chars: int):
        import ahocorasick

        self.min_chars = min_chars

        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end in the normalised text): the best occurrence of each item found."""
        if self.empty:
            return
        # An item's hits on nearly the same diagonal are checked in one window.
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, at in where:
                _, pattern, edits = self.items[k]
                start = end - length + 1 - at
                if not edits and len(pattern) < self.min_chars and not (boundary(text, start) and boundary(text, end + 1)):
                    continue
                low, high = max(0, start - edits), min(len(text), start + len(pattern) + edits)
                known = windows.setdefault(k, [])
                if known and low <= known[-1][1] - len(pattern) + edits + 1 and high >= known[-1][0]:
                    known[-1][0] = min(known[-1][0], low)
                    known[-1][1] = max(known[-1][1], high)
                else:
                    known.append([low, high])
        for k, spans in sorted(windows.items()):
            item, pattern, edits = self.items[k]
            found: tuple[int, int] | None = None
            for low, high in spans:
                if len(pattern) < self.min_chars:
                    hit = best_words(pattern, text, low, high, edits)
                else:
                    hit = best_match(pattern, text[low:high], edits)
                    hit = hit and (hit[0], hit[1] + low)
                if hit and (found is None or hit < found):
                    found = hit
            if found:
                yield item, found[0], found[1]


def benchmark_parts(items: DataFrame, text: str, pass_chars: int, named: bool = True) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in lists of bounded length, read one partition at a time; ``named`` leaves out those without an id."""
    part, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col(text).alias("text")).distinct()
    rows = rows.filter("item_id is not null") if named else rows
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        value = normalised(row.text)
        if not value:
            continue
        if part and size + len(value) > pass_chars:
            yield part
            part, size = [], 0
        part.append((row.item_id, value))
        size += len(value)
    if part:
        yield part


def contaminations(
    docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS,
    text: str = "text", pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """Documents that contain a benchmark item with at most one edit per ``chars_per_edit`` characters.

    Returns doc_id, item_id, distance, end_char (in the normalised text): the
    best occurrence, one row per document row and item. Items and texts are
    compared in lower case with single spaces. Null or empty texts hold nothing;
    items under ``min_chars`` are found at word boundaries only; null or empty
    items and, as there is no name for them, those without an id are not
    searched; repeated items give one row; repeated document rows one row each; empty tables none.
    Whole texts are scanned once for every ``pass_chars`` characters of items,
    so what a task holds is bounded however many items there are.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    shape = "doc_id long, item_id long, distance int, end_char long"
    found = [
        rows.mapInArrow(_search(items, chars_per_edit, min_chars), shape)
        for items in benchmark_parts(benchmark, "text", pass_chars)
    ]
    out = found[0] if found else docs.sparkSession.createDataFrame([], shape)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(items: list[tuple[int, str]], chars_per_edit: int, min_chars: int):
    unique = sorted(set(items))

    def search(batches):
        import pyarrow as pa

        searcher = Searcher(unique, chars_per_edit, min_chars)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                best: dict[int, tuple[int, int]] = {}
                for item, distance, end in searcher.matches(normalised(text.as_py())):
                    best[item] = min(best.get(item, (distance, end)), (distance, end))
                for item, (distance, end) in best.items():
                    for column, value in zip(out, (doc, item, distance, end), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "item_id", "distance", "end_char"]
            )

    return search


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents without a benchmark item, decided row by row in one scan per pass.

    Same columns; a row with a null text stays. Items without an id count as well.
    """
    kept, column = docs, docs.columns.index(text)
    per_edit, min_chars = options.get("chars_per_edit", CHARS_PER_EDIT), options.get("min_chars", MIN_CHARS)
    for items in benchmark_parts(benchmark, "text", options.get("pass_chars", PASS_CHARS), named=False):
        kept = kept.mapInArrow(_keep(items, per_edit, min_chars, column), docs.schema)
    return kept


def _keep(items: list[tuple[int | None, str]], chars_per_edit: int, min_chars: int, column: int):
    def keep(batches):
        import pyarrow as pa

        searcher = Searcher(items, chars_per_edit, min_chars)
        for batch in batches:
            clean = [next(searcher.matches(normalised(t.as_py())), None) is None for t in batch.column(column)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep
