"""Byte-level BPE with the ranks of a public vocabulary.

A piece is merged with a segment tree over its byte positions: a leaf holds the rank of the pair that starts there, an
inner node the least rank below it. The root gives the least rank, the walk down to the left its leftmost place; a merge
is at most three point updates, of logarithmic cost, at the live neighbours. So a piece of n bytes takes O(n log n) however
long it is, where rescanning the pairs takes O(n²).

Whole texts are cut into *segments* (white space and the word after it). No piece of the pattern has white space after
something else, so segments can be encoded alone, and a worker keeps what it has encoded: a corpus has few distinct ones.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("INKSPARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

# The pattern that splits text before the merges, with white space as Unicode defines it (Python adds 1C-1F).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+""")

_SEGMENTS = re.compile(r"\s*\S+|\s+").findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search
_NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Single bytes must all be in the vocabulary, as in any byte-level one."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    get = ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], _NONE)
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (least := tree[1]) != _NONE:
        i = 1
        while i < width:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= width
        j = end[i]
        stop = end[i] = end[j]
        if j < n - 1:
            put(j, _NONE)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]], _NONE))
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            put(h, get(piece[h:stop], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """An encoder; ids come as the bytes of native 32-bit integers, so that those of a text are one join."""

    #: Entries a worker keeps at most; beyond, it starts anew. Bounds memory, changes no result.
    KEEP = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces: dict[str, bytes] = {}
        outer = self

        class Kept(dict):
            def __missing__(self, segment: str) -> bytes:
                ids = outer._pieces(segment)
                if len(segment) <= 64:
                    if len(self) >= outer.KEEP:
                        self.clear()
                    self[segment] = ids
                return ids

        self.segments = Kept()
        self._get = self.segments.__getitem__

    def _pieces(self, text: str) -> bytes:
        out = []
        for piece in PATTERN.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array(merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks), np.int32).tobytes()
                if len(piece) <= 64:
                    if len(self.pieces) >= self.KEEP:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text without special tokens; none for a null or empty one."""
        if not text:
            return b""
        if _SEPARATORS(text):
            return self._pieces(text)
        return b"".join(map(self._get, _SEGMENTS(text)))


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The encoder of this worker process: loaded once, kept for the later batches and tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; a null or an empty text gets an empty array.

    One pass without a shuffle. Repeated rows are encoded as often as they come; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in sliced(batches):
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) >> 2 for x in ids], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", path: str = BYTE_BPE_50K, chars: str = "chars", tokens: str = "tokens") -> DataFrame:
    """The columns ``keep`` with exact counts of each row's text: code points and tokens; null and 0 where the text is null.

    The text itself doesn't leave the worker, so what follows shuffles a few numbers a document.
    """
    names = [*keep, chars, tokens]
    if len(set(names)) < len(names):
        raise ValueError(f"clashing column names: {names}")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{chars}` bigint", f"`{tokens}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in sliced(batches):
            texts = batch.column(len(keep)).to_pylist()
            n_chars = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            n_tokens = pa.array([len(encode(t)) >> 2 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n_chars, n_tokens], names=names)

    return df.select(*keep, F.col(text_col)).mapInArrow(run, schema)
