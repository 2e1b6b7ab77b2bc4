"""Token ids of whole texts inside Spark tasks, for the public tokenizer files.

A text is cut at single spaces into pieces that the tokenizer treats
independently, and the ids of a piece are remembered, so that a repeated word
costs one dictionary look-up. Where ids and not only their number are wanted, the
words of a whole text are merged in one call instead (see ``Words`` and
``Spans``), which costs less than the look-ups. Why the cut is safe:

* word-end BPE (white space dropped): no pre-token contains white space, so
  every space separates.
* byte-level BPE: a space starts a new pre-token when it is followed by a
  non-space; the only other case is a run of white space in which a space has
  white space on both sides or ends the text. Such texts are cut only at spaces
  between two non-space characters.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Callable, Iterable

from corpusflow.llm.remembered import use

#: Bytes of pieces and values remembered by one Python worker; the memory is emptied when it is full.
REMEMBERED_BYTES = 96 << 20
#: Longer pieces (texts without spaces) hardly ever come back and are not remembered.
REMEMBERED_LENGTH = 64
#: Place of one entry in a table, beside its key and value.
_ENTRY = 100

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the pre-token pattern of the word-end vocabulary.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The pre-tokens of lower-cased ASCII text that are no runs of letters, and its white space: they begin with one
#: character of a class, so that a search skips letters and spaces without trying anything else there.
_ASCII_MARKS = re.compile(
    r"[^a-z ](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<=[^\t-\r0-9])[^\t-\r a-z0-9]*|)", re.ASCII
)
#: Stands for a piece beyond ASCII while the pieces around it are taken apart; texts that hold it go another way.
_PLACE = "\x00"
#: A call costs more than the look-ups of a text with fewer characters.
_SHORT_TEXT = 32
#: So much white space in a row is left to the way by pieces: the pattern of pre-tokens tries it again and again.
_LONG_SPACE = re.compile(r"\s{500}")
_AMBIGUOUS = re.compile(r"\s (?:\s|\Z)")
_CLEAR_SPACE = re.compile(r"(?<=\S)(?= \S)")


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file: a path as it is, or a file name of the public set."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer of a .json file, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def keeps_spaces(tokenizer) -> bool:
    """True for byte-level vocabularies, in which a leading space belongs to the token."""
    return tokenizer.encode(" a", add_special_tokens=False).ids != tokenizer.encode("a", add_special_tokens=False).ids


def whole_tokens(tokenizer) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and encode alone as one token, with their ids.

    Every string is encoded once, so the property is proven for the given file
    and not assumed from the merge order. Special strings are left out.
    """
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = sorted(set(tokenizer.get_vocab(with_added_tokens=True).values()))
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    proven = {}
    for start in range(0, len(ids), 10_000):
        part = strings[start : start + 10_000]
        for i, s, e in zip(ids[start : start + 10_000], part, tokenizer.encode_batch(part, add_special_tokens=False)):
            if s and e.ids == [i] and s not in added:
                proven[s] = i
    return proven


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies -> the byte.

    Printable bytes stand for themselves, the others are numbered on from 256.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def rank_table(tokenizer) -> tuple[dict[bytes, int], bytes] | None:
    """Ranks by the bytes of a token, and the closing byte of a word, if ranks merge as the tokenizer's file says.

    Where the merges of the file make tokens in ascending order of their ids
    (checked here), a rank table says the same as the list of merges. A
    word-end suffix becomes a closing space, which no pre-token of a word-end
    vocabulary holds; without a suffix nothing closes a word. Any other file has
    no such table.
    """
    import json

    model = json.loads(tokenizer.to_str())["model"]
    suffix, vocabulary = model.get("end_of_word_suffix") or "", model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    # The suffix ends the right side of a pair.
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    alphabet = byte_alphabet()
    closing = b" " if suffix else b""
    ranks: dict[bytes, int] = {}
    spaced = False
    for token, number in vocabulary.items():
        body = token[: len(token) - len(suffix)] if suffix and token.endswith(suffix) else token
        if body and all(c in alphabet for c in body):
            raw = bytes(alphabet[c] for c in body)
            spaced = spaced or (len(raw) > 1 and b" " in raw)
            ranks[raw + (closing if body != token else b"")] = number
    singles = [bytes([b]) for b in range(256)] + ([bytes([b]) + closing for b in range(256)] if suffix else [])
    plain = (
        all(x < y for x, y in zip(made, made[1:]))
        and all(s in ranks and ranks[s] < made[0] for s in singles)
        and not (suffix and spaced)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    )
    return (ranks, closing) if plain else None


def merger(tokenizer, table: tuple[dict[bytes, int], bytes] | None) -> Callable[[str], list[int]]:
    """Ids of one normalised pre-token, merged as the tokenizer's file says.

    With its rank table a byte-pair encoder for such tables is used: it has less
    overhead per word. Any other file is left to the tokenizer itself.
    """
    import tiktoken

    if table is None:
        return lambda token: tokenizer.encode(token, add_special_tokens=False).ids
    ranks, closing = table
    encoder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda token: encoder._encode_single_piece(token.encode("utf-8") + closing)


class Remembered(dict):
    """Values by piece of text, bounded in bytes: emptied when full."""

    held = 0

    def keep(self, key: str, value) -> None:
        if len(key) <= REMEMBERED_LENGTH:
            size = sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY
            if self.held + size > REMEMBERED_BYTES:
                self.clear()
            self[key] = value
            self.held += size

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Spans:
    """Ids of whole texts for byte-level vocabularies: a text's pre-tokens are found and merged in one call."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        # The special string is never found: none is asked for.
        special = {"<|none|>": max(ranks.values()) + 1}
        self.encoder = tiktoken.Encoding("spans", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def takes(self, text: str) -> bool:
        return len(text) >= _SHORT_TEXT and not _LONG_SPACE.search(text)

    def packed(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return self.encoder.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False).tobytes()

    def clear(self) -> None:
        """Nothing is remembered."""


class Words(Remembered):
    """Ids of whole texts for word-end vocabularies: a text's pre-tokens, a space after each, are merged in one call.

    White space separates pre-tokens and is dropped, so the texts between two
    spaces are taken apart on their own: those of ASCII together, the others one
    by one by the tokenizer's normaliser, which are remembered (piece -> its
    pre-tokens, joined by spaces).
    """

    def __init__(self, tokenizer, ranks: dict[bytes, int]):
        super().__init__()
        import regex
        import tiktoken

        self.normalise = tokenizer.normalizer.normalize_str
        self.split = regex.compile(WORD_END_PATTERN).findall
        # Words are merged with the space behind them; the special string never comes up, for none is asked for.
        self.encoder = tiktoken.Encoding(
            "words", pat_str=r"[^\t-\r ]+ ", mergeable_ranks=ranks, special_tokens={"  ": max(ranks.values()) + 1}
        )

    def __missing__(self, piece: str) -> str:
        value = " ".join(self.split(self.normalise(piece)))
        self.keep(piece, value)
        return value

    def takes(self, text: str) -> bool:
        return True

    def spaced(self, text: str) -> str:
        """The pre-tokens of a text with spaces (or other ASCII white space of the text) between them."""
        if text.isascii():
            return _ASCII_MARKS.sub(r" \g<0> ", text.lower())
        pieces = text.split(" ")
        if _PLACE in text:
            return " ".join(map(self.__getitem__, pieces))
        # ASCII pieces are taken apart with a mark in each place of another, which then goes between them.
        odd = [p for p in pieces if not p.isascii()]
        marked = " ".join([p if p.isascii() else _PLACE for p in pieces])
        out = [""] * (2 * len(odd) + 1)
        out[::2] = self.spaced(marked).split(_PLACE)
        out[1::2] = map(self.__getitem__, odd)
        return "".join(out)

    def packed(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        ids = self.encoder.encode_to_numpy(self.spaced(text) + " ", allowed_special=set(), disallowed_special=())
        return ids.astype("<u4", copy=False).tobytes()


class Pieces(Remembered):
    """Piece of text -> value of its ids, filled on demand by ``make(ids)``.

    Pre-tokens that are whole tokens are answered from the proven table; only
    the rest is merged.
    """

    def __init__(self, name: str, make: Callable[[list[int]], object]):
        super().__init__()
        import regex

        self.tokenizer, self.make = load(name), make
        self.spaced = keeps_spaces(self.tokenizer)
        table = rank_table(self.tokenizer)
        self.merge = merger(self.tokenizer, table)
        self.whole = whole_tokens(self.tokenizer) if self.spaced else {}
        self.split = regex.compile(BYTE_LEVEL_PATTERN if self.spaced else WORD_END_PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: Words | Spans | None = None
        if table and self.spaced and not table[1]:
            self.words = Spans(table[0])
        elif table and table[1] and not self.spaced:
            self.words = Words(self.tokenizer, table[0])

    def ids(self, piece: str) -> list[int]:
        for special in self.special:
            if special in piece:
                return self.tokenizer.encode(piece, add_special_tokens=False).ids
        if not self.spaced:
            piece = piece.lower() if piece.isascii() else self.tokenizer.normalizer.normalize_str(piece)
        word = piece[1:] if self.spaced and piece[:1] == " " else piece
        last = word[-1:]
        if word.isalpha():
            tokens = [piece]  # a run of letters, with its space, is one pre-token
        elif word[:-1].isalpha() and not last.isalnum() and not last.isspace():
            tokens = [piece[:-1], last]  # letters and a mark
        else:
            tokens = self.split(piece)
        out: list[int] = []
        for token in tokens:
            known = self.whole.get(token)
            if known is None:
                out += self.merge(token)
            else:
                out.append(known)
        return out

    def __missing__(self, key: str):
        """Keys leave out the space in front of a piece; a piece without one has a space in its key instead."""
        if not self.spaced:
            piece = key
        else:
            piece = key[1:] if key[:1] == " " else " " + key
        value = self.make(self.ids(piece))
        self.keep(key, value)
        return value

    def clear(self) -> None:
        super().clear()
        if self.words is not None:
            self.words.clear()

    def of(self, text: str) -> Iterable:
        """Values of the pieces of a whole text, in order."""
        if not text:
            return ()
        if not self.spaced:
            return map(self.__getitem__, text.split(" "))
        if _AMBIGUOUS.search(text):
            first, *rest = _CLEAR_SPACE.split(text)
            keys = [p[1:] for p in rest]
        else:
            first, *keys = text.split(" ")
        if first:
            keys.insert(0, " " + first)
        return map(self.__getitem__, keys)


_LOADED: dict[tuple[str, Callable], Pieces] = {}


def _loaded(name: str, make: Callable[[list[int]], object]) -> Pieces:
    if (name, make) not in _LOADED:
        use({})  # room for the vocabulary
        _LOADED[name, make] = Pieces(name, make)
    return use(_LOADED[name, make])


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def piece_counts(name: str) -> Pieces:
    """Token counts by piece, one table per Python worker."""
    return _loaded(name, len)


def piece_ids(name: str) -> Pieces:
    """Little-endian unsigned 32-bit ids by piece, one table per Python worker."""
    return _loaded(name, _packed)


def encode_bytes(name: str, text: str | None, end_id: int | None = None) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers, ``end_id`` last."""
    pieces = piece_ids(name)
    words = pieces.words
    if text and words is not None and words.takes(text) and not any(special in text for special in pieces.special):
        body = words.packed(text)
    else:
        body = b"".join(pieces.of(text or ""))
    return body if end_id is None else body + _packed([end_id])
