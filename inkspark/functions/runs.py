"""Words of folded texts in Arrow batches: what :func:`inkspark.functions.text.words` finds, from bytes instead of by a match a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_HELD: list[np.ndarray] = []


def word_characters(spark: SparkSession) -> np.ndarray:
    """One bit a code point: whether it is a letter, digit or underscore to the expressions of Spark; asked once a process."""
    if not _HELD:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)  # a local relation, so the driver answers without a task
        held = spark.createDataFrame(pa.table({"text": [every]})).select(F.regexp_replace("text", r"[^\p{L}\p{N}_]+", "")).collect()
        table = np.zeros(0x110000, bool)
        table[np.frombuffer(held[0][0].encode("utf-32-le"), np.uint32)] = True
        _HELD.append(np.packbits(table))
    return _HELD[0]


def runs(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all of them in order; ``table`` has one truth value a code point. Texts are not null."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    word = np.r_[table[:128], np.zeros(128, bool)][data]
    # longer characters: their code points from the bytes that follow the first one
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code, whole = data[lead].astype(np.int64) & (0x3F >> more), lead + more < len(data)
    for j in (1, 2, 3):
        at = np.flatnonzero(more >= j)
        b = data[np.minimum(lead[at] + j, len(data) - 1)]
        whole[at] &= (b & 0xC0) == 0x80
        code[at] = code[at] << 6 | (b & 0x3F)
    whole &= table[np.minimum(code, len(table) - 1)]
    for j in (0, 1, 2, 3):
        word[lead[whole & (more >= j)] + j] = True
    before, after = np.r_[False, word[:-1]][: len(data)], np.r_[word[1:], False][: len(data)]
    first = bounds[:-1][bounds[:-1] < len(data)]
    before[first] = False
    after[first[first > 0] - 1] = False
    begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    ends = np.r_[0, np.cumsum(end - begin)].astype(np.int32)
    return np.diff(np.searchsorted(begin, bounds)), pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[word]))
