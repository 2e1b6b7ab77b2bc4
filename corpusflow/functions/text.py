"""Column functions over text. Everything here runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
HAN = r"[\p{IsHan}]"
# One token per run of Han characters or per run of other word characters.
HAN_OR_WORD = r"[\p{IsHan}]+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"
EDGE_SPACE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def clean_text(text: Column) -> Column:
    """Strip each line, drop the empty ones, join the rest with newlines."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def words(text: Column) -> Column:
    """Lower-cased word tokens, used for deduplication."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def spaced(text: Column) -> Column:
    """Text whose words can be told apart by single bytes (``batches.words_of``).

    ASCII stays as it is; in other texts each run of characters outside of words becomes a space.
    """
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, text).otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def _bigrams(token: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2))
    )


def index_tokens(text: Column) -> Column:
    """Index tokens: case kept; runs of Han characters become overlapping bigrams."""
    plain = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(text.rlike(HAN), _mixed_tokens(text)).otherwise(plain)


def spaced_index_tokens(text: Column) -> Column:
    """``index_tokens`` as one text for ``batches.words_of``."""
    is_han = (F.octet_length(text) > F.length(text)) & text.rlike(HAN)
    return F.when(is_han, F.array_join(_mixed_tokens(text), " ")).otherwise(spaced(text))


def _mixed_tokens(text: Column) -> Column:
    return F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(HAN_OR_WORD), F.lit(0)),
            lambda t: F.when(t.rlike(HAN) & (F.length(t) > 1), _bigrams(t)).otherwise(F.array(t)),
        )
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, counted inside the row.

    Sorting brings equal tokens together, so the starts of runs give the
    counts; no shuffle is needed to obtain term frequencies.
    """

    def count_runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)),
        )
        return bind(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n)),
                lambda at, end: F.struct(F.get(ordered, at).alias("term"), (end - at).alias("tf")),
            ),
        )

    return F.when(F.size(tokens) > 0, bind(F.sort_array(tokens), count_runs))


def clean_subqueries(text: Column) -> Column:
    """Remove list numbers at line starts, then everything but words, spaces and commas."""
    unnumbered = F.regexp_replace(text, r"(?m)^\d+[.、]?\s*", "")
    return F.regexp_replace(unnumbered, r"[^\p{L}\p{N}_\s,，]", "")


def extract_path(text: Column) -> Column:
    """Windows-style file path named in free text; empty when there is none.

    A path without suffix gets ``.csv``, since the readers here accept nothing else.
    """
    # Fixed value: drive, folders, name, ended by a request word or the end of the line.
    pattern = r"([a-zA-Z]:\\(?:[^<>\n]+?\\)*[^<>\n]+?)(?=\s*(?:对|请|帮|为|分析|处理|$))"
    path = F.trim(F.regexp_extract(text, pattern, 1))
    has_suffix = path.rlike(r"\.[A-Za-z0-9]+$")
    return F.when((path != "") & ~has_suffix, F.concat(path, F.lit(".csv"))).otherwise(path)


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def ordered_join(order: Column, part: Column, separator: str) -> Column:
    """Aggregate: parts of one group joined by ``separator`` in the order of ``order``.

    Use it only where the group is bounded by a preceding top-k or budget.
    """
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), part.alias("p"))))
    return F.array_join(F.transform(pairs, lambda x: x["p"]), separator)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """True when any of the literal keywords occurs in the text."""
    hit = F.lit(False)
    for kw in dict.fromkeys(keywords):
        hit = hit | F.contains(text, F.lit(kw))
    return hit


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def token_overlap(a: Column, b: Column) -> Column:
    """Cosine of two distinct-token sets; the default pair scorer for reranking."""
    sets = F.struct(F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b"))

    def cosine(s: Column) -> Column:
        norm = F.sqrt(F.size(s["a"]).cast("double") * F.size(s["b"]))
        return F.when(norm > 0, F.size(F.array_intersect(s["a"], s["b"])) / norm).otherwise(F.lit(0.0))

    return bind(sets, cosine)
