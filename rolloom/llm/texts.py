"""Words and per-text helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed pattern: a word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters for str.strip().
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly the characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Codes(dict):
    """Numbers words in the order they appear; ``numbers`` gives a list of words as an array."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` codes a number; two windows have the same one only if equal.

    Windows of 2, 4, 8 ... codes are numbered from the halves, then joined to the width asked for,
    so nothing is hashed. ``codes`` are below 2^31.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    powers, size = [codes], 1
    while size * 2 <= width:
        last = powers[-1]
        powers.append(_pair(last[: len(last) - size], last[size:]))
        size *= 2
    out, have = None, 0
    for level in range(len(powers) - 1, -1, -1):
        size = 1 << level
        if width & size:
            part = powers[level][have : have + n]
            out = part if out is None else _pair(out[:n], part)
            have += size
    return out[:n]


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Which of ``length`` positions lie in a window that starts where ``starts`` is true."""
    edges = np.zeros(length + 1, np.int64)
    edges[: len(starts)] += starts
    edges[width : width + len(starts)] -= starts
    return np.cumsum(edges)[:length] > 0


def with_text_columns(
    df: DataFrame, text: str, fields: list[tuple[str, str]], function: Callable[[str | None], tuple], keep: list[str]
) -> DataFrame:
    """``keep`` of ``df`` and the values that ``function`` gives for each text, in Arrow batches."""
    df = df.select(*[c for c in keep if c != text], text)
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c != text or text in keep]
    schema = T.StructType([df.schema.fields[i] for i in kept])
    for name, kind in fields:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            rows = [function(t) for t in batch.column(at).to_pylist()]
            made = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)
