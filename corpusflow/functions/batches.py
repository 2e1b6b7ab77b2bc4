"""Python functions over a text column, in Arrow batches whose size in memory is bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: A batch of results ends with the row that brings its texts to so many characters, or its rows to so many.
BATCH_CHARS = 1 << 21
BATCH_ROWS = 8192
#: Texts whose words are cut out together have so many bytes, or are one text.
STEP_BYTES = 1 << 21
#: Bytes of words in a ``text.spaced`` text: ASCII letters, digits, the underscore and all bytes beyond ASCII.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == ord("_") for b in range(256)])
_TYPES = {"int": IntegerType(), "long": LongType(), "string": StringType()}


def exploded(
    df: DataFrame, keep: list[str], text: str, make: Callable[[str], Iterable[tuple]], fields: list[tuple[str, str]]
) -> DataFrame:
    """The columns ``keep`` and ``fields`` for every tuple that ``make`` gives for a row's text; a null text gives none.

    ``fields``: name and kind (int, long, string) of the values. A task holds the
    results of a few texts at a time, whatever the number of rows in a batch.
    """

    def rows(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        names = [*keep, *(name for name, _ in fields)]

        def flushed(batch, at, out):
            at = pa.array(at, pa.int32())
            made = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(out, fields)]
            return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *made], names)

        for batch in batches:
            at, out, held = [], [[] for _ in fields], 0
            for row, value in enumerate(batch.column(len(keep))):
                value = value.as_py()
                if value is None:
                    continue
                for made in make(value):
                    at.append(row)
                    for column, x in zip(out, made):
                        column.append(x)
                held += len(value)
                if held >= BATCH_CHARS or len(at) >= BATCH_ROWS:
                    yield flushed(batch, at, out)
                    at, out, held = [], [[] for _ in fields], 0
            if at:
                yield flushed(batch, at, out)

    used = df.select(*keep, F.col(text).alias("__text"))
    shape = StructType([*used.schema.fields[: len(keep)], *(StructField(name, _TYPES[kind]) for name, kind in fields)])
    return used.mapInArrow(rows, shape)


def steps_of(texts, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, length) of up to ``rows`` rows and about STEP_BYTES bytes of an Arrow string array."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        limit = STEP_BYTES + (int(ends[row - 1]) if row else 0)
        stop = max(row + 1, min(row + rows, int(np.searchsorted(ends, limit, side="right"))))
        yield row, stop - row
        row = stop


def words_of(texts) -> tuple:
    """Words of an Arrow array of ``text.spaced`` texts, one after the other, and the number of words in each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = _IN_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text's first and last bytes do not touch those of its neighbours.
    full = edges[1:] > edges[:-1]
    starts[edges[:-1][full]] = inside[edges[:-1][full]]
    ends[edges[1:][full] - 1] = inside[edges[1:][full] - 1]
    first = np.flatnonzero(starts)
    cuts = np.zeros(len(first) + 1, np.int32)
    np.cumsum(np.flatnonzero(ends) - first + 1, out=cuts[1:])
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(first, edges))
