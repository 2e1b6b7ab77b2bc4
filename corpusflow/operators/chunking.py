"""Chunkers: recursive character windows and Markdown sections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.batches import exploded
from corpusflow.functions.text import strip
from corpusflow.options import DEFAULTS, Options

# Separators tried in turn; the empty one means single characters.
SEPARATORS = ["\n\n", "\n", " ", ""]

# White space at the ends of a line, characters dropped from it, code fences and headings.
EDGES = regex.compile(r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\Z")
UNPRINTED = regex.compile(r"(?! )[\p{C}\p{Z}]")
FENCE = regex.compile(r"```(?!.*```)|~~~")
HEADING = regex.compile(r"(#{1,3})(?: |\Z)")
HEADERS = ("header1", "header2", "header3")


def _cuts(text: str, codes: np.ndarray, lo: int, hi: int, separator: str) -> np.ndarray:
    """Ends of the spans that each begin at a separator (the first one may not), from lo to hi."""
    if not separator:
        return np.arange(lo, hi + 1)
    if len(separator) == 1:
        found = np.flatnonzero(codes[lo:hi] == ord(separator)) + lo
    else:
        found = np.array([m.start() for m in re.compile(re.escape(separator)).finditer(text, lo, hi)], np.int64)
    return np.concatenate([[lo], found[found > lo], [hi]])


def _windows(cuts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Adjacent pieces, each shorter than ``size``, joined up to it; a new window starts with up to ``overlap`` of the last."""
    out, first, last = [], 0, len(cuts) - 1
    while first < last:
        over = bisect_right(cuts, cuts[first] + size, first)
        if over > last:
            out.append((cuts[first], cuts[last]))
            break
        end = over - 1
        out.append((cuts[first], cuts[end]))
        # Move the start until the kept tail is short enough and leaves room for the next piece.
        first = min(end, max(bisect_left(cuts, cuts[end] - overlap, first), bisect_left(cuts, cuts[over] - size, first)))
    return out


def text_spans(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Stripped chunk spans of a text: coarse separators first, finer ones only inside long pieces."""
    out: list[tuple[int, int]] = []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def divide(lo: int, hi: int, level: int) -> None:
        while separators[level] and text.find(separators[level], lo, hi) < 0 and level + 1 < len(separators):
            level += 1
        cuts = _cuts(text, codes, lo, hi, separators[level])
        held, begin = cuts.tolist(), 0
        for at in np.flatnonzero(np.diff(cuts) >= size).tolist():
            out.extend(_windows(held[begin : at + 1], size, overlap))
            if level + 1 < len(separators):
                divide(held[at], held[at + 1], level + 1)
            else:
                out.append((held[at], held[at + 1]))
            begin = at + 1
        out.extend(_windows(held[begin:], size, overlap))

    divide(0, len(text), 0)
    spans = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))
    return spans


def split_rows(df: DataFrame, keep: list[str], index: str, options: Options = DEFAULTS) -> DataFrame:
    """Rows of ``df`` cut into chunks: keep columns, ``index`` (from 0), start_index, text.

    Linear in the length of a text; a task holds the chunks of a few texts at a time.
    """
    size, overlap = options.chunk_size, options.chunk_overlap

    def cut(text: str) -> Iterator[tuple[int, int, str]]:
        return ((i, a, text[a:b]) for i, (a, b) in enumerate(text_spans(text, size, overlap)))

    return exploded(df, keep, "text", cut, [(index, "int"), ("start_index", "int"), ("text", "string")])


def chunk_documents(docs: DataFrame, options: Options = DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, chunk_idx, chunk_id, start_index, text and the columns in ``keep``.

    ``docs``: doc_id, source, text (cleaned), and those columns.
    """
    more = keep or []
    chunks = split_rows(docs, ["doc_id", "source", *more], "chunk_idx", options)
    name = F.concat_ws("_", "source", F.col("chunk_idx").cast("string"))
    return chunks.select("doc_id", "source", "chunk_idx", name.alias("chunk_id"), "start_index", "text", *more)


def section_list(text: str | None) -> list[dict]:
    """Sections of one text: runs of lines under the same headings, headings left out."""
    out: list[dict] = []
    heads: list[str | None] = [None, None, None]
    fenced, last = False, -1
    for at, raw in enumerate((text or "").split("\n")):
        line = UNPRINTED.sub("", EDGES.sub("", raw))
        if not line:
            continue
        fenced ^= FENCE.match(line) is not None
        heading = None if fenced else HEADING.match(line)
        if heading:
            level = len(heading.group(1))
            heads = [*heads[: level - 1], EDGES.sub("", line[level:]), *[None] * (3 - level)]
            continue
        if out and heads == [out[-1][h] for h in HEADERS]:
            out[-1]["text"] += ("  \n" if at - last > 1 else "\n") + line
        else:
            out.append({"section_idx": len(out), **dict(zip(HEADERS, heads)), "text": line})
        last = at
    return out


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, source, section_idx, header1..3, text: one row per run of lines under the same headings.

    Headings of levels 1 to 3 outside fenced code end a section and are not
    part of its text. Numbering counts every section, short ones included. Each
    text is read once in its own row; no line is shuffled.
    """

    fields = [("section_idx", "long"), *((h, "string") for h in HEADERS), ("text", "string")]
    names = [name for name, _ in fields]
    return exploded(docs, ["doc_id", "source"], "text", lambda t: [tuple(s[n] for n in names) for s in section_list(t)], fields)


def markdown_chunks(docs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Sections of at least 20 characters; those over twice the chunk size are cut again.

    ``section`` is filled for chunks that were cut again only; every such chunk has its own chunk_id.
    """
    sections = markdown_sections(docs).withColumn("text", strip(F.col("text")))
    sections = sections.filter(F.length("text") >= options.min_section_chars)
    keep = ["doc_id", "source", "section_idx", "header1", "header2", "header3"]
    is_long = F.length("text") > 2 * options.chunk_size
    name = F.concat_ws("_", "source", F.col("section_idx").cast("string"))
    whole = sections.filter(~is_long).select(
        *keep, F.lit(None).cast("int").alias("sub_idx"), name.alias("chunk_id"),
        F.lit(None).cast("string").alias("section"), "text",
    )
    named = F.coalesce(F.nullif("header1", F.lit("")), F.col("header2"), F.lit(""))
    cut = split_rows(sections.filter(is_long), keep, "sub_idx", options).select(
        *keep, "sub_idx", F.concat_ws("_", name, F.col("sub_idx").cast("string")).alias("chunk_id"),
        named.alias("section"), "text",
    )
    return whole.unionByName(cut)
