"""Content hashes and 64-bit signatures. Unsigned 64-bit values are held in signed BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import words

BITS = 64
LONG_MAX = 2**63 - 1


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def vector_mean(vector: Column) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x) / F.size(vector)


def vector_signature(vector: Column) -> Column:
    """Bit i is set when component i exceeds the mean of all components (first 64 used)."""
    mean = vector_mean(vector)
    bits = F.transform(
        F.slice(vector, 1, BITS),
        lambda x, i: F.when(x.cast("double") > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
            F.lit(0).cast("long")
        ),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def token_md5(token: Column) -> Column:
    """First 64 bits of the token's MD5 as BIGINT."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("long")


def token_signature(text: Column) -> Column:
    """Signature from tokens alone: XOR of token hashes, every second one complemented.

    Pairs of complements cancel, so the value is the XOR of all hashes, plus
    one (mod 2^64) when an odd number of tokens was complemented.
    """
    tokens = words(text)
    mixed = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(token_md5(t)))
    odd = F.floor(F.size(tokens) / 2) % 2 == 1
    wrapped = F.when(mixed == LONG_MAX, F.lit(-LONG_MAX - 1)).otherwise(
        F.when(mixed < LONG_MAX, mixed).otherwise(F.lit(0)) + 1
    )
    return F.when(odd, wrapped).otherwise(mixed)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def max_hamming(similarity_threshold: float, bits: int = BITS) -> int:
    """Largest distance that still counts as a copy: 0.95 gives 3."""
    return int((1 - similarity_threshold) * bits)
