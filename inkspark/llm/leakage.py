"""Passages of held-out items in a corpus, by greedy string tiling.

Documents are streamed once past an index of the items' words: runs of four shared words are seeds, and where an item has a
seed, longest common word runs are marked again and again with running Karp-Rabin hashes until none is left (the tiles). Items
whose tiles cover enough of them are checked exactly for a passage in the order of the item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.cleaning import bare, prepare, words_in

# Digits that scanned text puts for letters, within a word that has letters too.
_CONFUSED = str.maketrans({"0": "o", "1": "l", "5": "s"})
COVERAGE = 0.8  # share of an item's words in tiles from which it counts as covered, in whatever order
MOST_CHARS = 16 << 20  # characters of the items that go to the workers at once
TILE = 3  # words of a tile that counts for coverage


def seed_words(words: int, per: int) -> int:
    """How many words in a row are unaltered in every passage of ``words`` or more with one edit in ``per`` at most.

    n words with e altered leave n - e in e + 1 runs, so one of (n - e) / (e + 1) or more; past the next multiple of ``per``
    that bound only rises.
    """
    return max(1, min(-(-(n - n // per) // (n // per + 1)) for n in range(words, words + per + 1)))


def fold(word: str) -> str:
    """The form in which words are compared: bare, and in a word of letters and digits the digits as the letters they stand for."""
    word = bare(word)
    return word if word.isalpha() or word.isdigit() else word.translate(_CONFUSED)


def folded(chunk: str) -> list[str]:
    return [f for w in words_in(chunk) if (f := fold(w))]


def tiles(a: list[int], b: list[int], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of non-overlapping common runs, none shorter than ``least``.

    For a search length, substrings of unmarked words are matched by their running Karp-Rabin hashes and extended; matches are
    marked longest first. The search length is halved until ``least``, so longest runs are marked first.
    """
    base, mod = 1_000_003, (1 << 61) - 1

    def prefix(x: list[int]) -> list[int]:
        h = [0]
        for v in x:
            h.append((h[-1] * base + v + 1) % mod)
        return h

    ha, hb = prefix(a), prefix(b)
    na, nb = len(a), len(b)
    marked_a, marked_b = bytearray(na), bytearray(nb)
    out = []

    def free(marked: bytearray, n: int) -> list[int]:
        f = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            f[i] = 0 if marked[i] else f[i + 1] + 1
        return f

    size = max(least, min(8, na, nb))
    while True:
        power = pow(base, size, mod)
        fa, fb = free(marked_a, na), free(marked_b, nb)
        at = defaultdict(list)
        for i in range(na - size + 1):
            if fa[i] >= size:
                at[(ha[i + size] - ha[i] * power) % mod].append(i)
        found, longest = [], 0
        for j in range(nb - size + 1):
            if fb[j] >= size:
                for i in at.get((hb[j + size] - hb[j] * power) % mod, ()):
                    if i and j and a[i - 1] == b[j - 1] and not marked_a[i - 1] and not marked_b[j - 1]:
                        continue  # not the start of this run
                    most = min(fa[i], fb[j])
                    k = 0
                    while k < most and a[i + k] == b[j + k]:
                        k += 1
                    if k >= size:
                        found.append((-k, i, j))
        again = False
        for k, i, j in sorted(found):
            if any(marked_a[i : i - k]) or any(marked_b[j : j - k]):
                again = True
                continue
            marked_a[i : i - k] = marked_b[j : j - k] = b"\1" * -k
            out.append((i, j, -k))
            longest = max(longest, -k)
        if again and longest:
            continue  # what is left of an overlapped run may still be long enough
        if size <= least:
            return out
        size = max(least, size // 2)


def holds_passage(item: np.ndarray, text: np.ndarray, words: int = 12, per: int = 6) -> bool:
    """Whether a stretch of ``text`` is a passage of at least ``words`` successive words of ``item`` with at most one edit in ``per``.

    Edits are words altered, missing or added. A passage starts and ends with words that the text holds, since words missing
    at an end only make a quotation shorter. All starts are aligned at once, a row of edits against every end in the text.
    """
    m, w = len(item), len(text)
    if m < words or not w:
        return False
    far = np.int16(10_000)
    differ = (item[:, None] != text[None, :]).astype(np.int16)
    d = np.full((m - words + 1, w + 1), far, np.int16)
    d[:, 1:][differ[: m - words + 1] == 0] = 0  # the first word is held
    steps = np.arange(w + 1, dtype=np.int16)
    d = np.minimum.accumulate(d - steps, axis=1) + steps
    for n in range(2, m + 1):
        d = d[: min(len(d), m - n + 1)]
        other = differ[n - 1 : n - 1 + len(d)]
        if n >= words and (d[:, :-1] + other * far).min() <= n // per:
            return True
        new = np.empty_like(d)
        new[:, 0] = far
        np.minimum(d[:, :-1] + other, d[:, 1:] + 1, out=new[:, 1:])
        d = np.minimum.accumulate(new - steps, axis=1) + steps
        if d.min() > m // per:
            return False
    return False


@dataclass
class Items:
    """An index of items (id, texts) for the screening of a stream of documents.

    A number in a document that stands in no item is taken as layout, the number of a page or line, and left out.
    """

    rows: list[tuple[str, list[str]]]
    words: int = 12
    per: int = 6

    def __post_init__(self):
        self.ids: dict[str, int] = {}
        self.sides: list[np.ndarray] = []
        item = []
        for k, (_, texts) in enumerate(self.rows):
            for t in dict.fromkeys(t for t in texts if t):
                side = [self.ids.setdefault(f, len(self.ids) + 1) for x in prepare(t).split() for f in folded(x)]
                if len(side) >= self.words:
                    item.append(k)
                    self.sides.append(np.array(side, np.int64))
        self.item = np.array(item, np.int64)
        self.v = len(self.ids) + 1
        self.seed = seed_words(self.words, self.per)
        self.length = np.array([len(s) for s in self.sides], np.int64)
        # seeds in the order of their hash, with the side and the place that each has
        hashes = [self._keys(s) for s in self.sides] or [np.empty(0, np.int64)]
        side = np.repeat(np.arange(len(self.sides)), [len(h) for h in hashes]) if self.sides else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.keys, first = np.unique(np.concatenate(hashes)[order], return_index=True)
        self.seed_at = np.append(first, len(order))
        self.seed_side, self.seed_place = side[order], place[order]
        self.own = np.unique(np.concatenate([np.unique(s) + k * self.v for k, s in enumerate(self.sides)])) if self.sides else np.empty(0, np.int64)
        self.own_table = None
        if len(self.sides) * self.v <= 1 << 26:
            self.own_table = np.zeros(len(self.sides) * self.v, bool)
            self.own_table[self.own] = True
        self.pair_list = np.unique(np.concatenate([s[:-1] * self.v + s[1:] for s in self.sides])) if self.sides else np.empty(0, np.int64)
        self.pairs = None
        if self.v <= 8192:
            self.pairs = np.zeros(self.v * self.v, bool)
            self.pairs[self.pair_list] = True
        outer = self

        class Known(dict):
            """The ids of a part of text between white space, as bytes; 0 for a word of no item."""

            def __missing__(self, chunk: str) -> bytes:
                ids = np.array([outer.ids.get(f, 0) for f in folded(chunk) if f in outer.ids or not f.isdigit()], np.int64).tobytes()
                if len(chunk) <= 40:
                    if len(self) >= 400_000:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.known = Known()

    def _keys(self, x: np.ndarray) -> np.ndarray:
        """Hash of the words of a seed from each place on."""
        x = x.astype(np.uint64)
        n = max(0, len(x) - self.seed + 1)
        h = np.zeros(n, np.uint64)
        for k in range(self.seed):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        return h.view(np.int64)

    def _holds(self, side: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether each word is one of the side."""
        key = side * self.v + words
        if self.own_table is not None:
            return self.own_table[key]
        return self.own[np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)] == key

    def windows(self, texts: list[str | None], least: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, side, words) of each part of a text that shares a seed with a side and, within the side's length and edits around
        the seed, holds ``least`` of its words or more; overlapping parts are one. Many items with one seed cost numbers, no loop."""
        if not self.sides:
            return
        get, gap = self.known.__getitem__, bytes(8)
        parts = [b"".join(map(get, prepare(t).split())) + gap if t else gap for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) >> 3 for x in parts])]).astype(np.int64)
        ids = np.frombuffer(b"".join(parts), np.int64)
        if len(ids) < self.seed:
            return
        run = ids[: len(ids) - self.seed + 1] > 0
        if self.seed > 1:
            pair = ids[:-1] * self.v + ids[1:]
            if self.pairs is not None:
                known = self.pairs[pair]
            else:
                known = self.pair_list[np.minimum(np.searchsorted(self.pair_list, pair), len(self.pair_list) - 1)] == pair
            for k in range(self.seed - 1):
                run = run & known[k : k + len(run)]
        places = np.flatnonzero(run)
        keys = self._keys(ids)[places]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        fine = self.keys[at] == keys
        places, at = places[fine], at[fine]
        texts_of = np.searchsorted(starts, places, side="right") - 1
        hits = self.seed_at[at + 1] - self.seed_at[at]
        ends = np.cumsum(hits)
        lo = 0
        while lo < len(places):  # some two million seeds at a time, all of a text together
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, side="right"))
            hi = int(np.searchsorted(texts_of, texts_of[min(max(hi, lo + 1), len(places)) - 1], side="right"))
            yield from self._of_seeds(ids, starts, places[lo:hi], at[lo:hi], texts_of[lo:hi], hits[lo:hi], least)
            lo = hi

    def _of_seeds(self, ids, starts, places, at, texts_of, hits, least) -> Iterator[tuple[int, int, np.ndarray]]:
        total = int(hits.sum())
        row = np.repeat(np.arange(len(places)), hits)
        seed = np.arange(total) - np.repeat(np.cumsum(hits) - hits, hits) + self.seed_at[at][row]
        text, side, q, p = texts_of[row], self.seed_side[seed], places[row], self.seed_place[seed]
        after = self.length[side] - p
        first = np.maximum(q - (p + p // self.per + 3), starts[text])
        last = np.minimum(q + after + after // self.per + 3, starts[text + 1] - 1)
        order = np.lexsort((first, side, text))
        text, side, first, last = text[order], side[order], first[order], last[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (side[1:] != side[:-1])]
        # the end so far within a text and side: later ones are lifted above earlier
        lift = (np.cumsum(new) - 1) * (len(ids) + 1)
        reach = np.maximum.accumulate(last + lift) - lift
        new[1:] |= first[1:] > reach[:-1]
        begin = np.flatnonzero(new)
        text, side, first, last = text[begin], side[begin], first[begin], reach[np.r_[begin[1:], len(reach)] - 1]
        size = last - first
        step = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 4_000_000, 4_000_000)[1:], side="right")
        for a, b in zip([0, *step[:-1]], step, strict=True):
            b = max(b, a + 1)
            n = size[a:b]
            if not len(n):
                continue
            flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)
            held = np.r_[0, np.cumsum(self._holds(np.repeat(side[a:b], n), ids[flat]))]
            end = np.cumsum(n)
            count = held[end] - held[end - n]
            for k in np.flatnonzero(count >= least[side[a:b]]) + a:
                yield int(text[k]), int(side[k]), ids[first[k] : last[k]]

    def screen(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, item, words in tiles) of each text that holds a passage of an item."""
        kept = self.words - self.words // self.per
        out: dict[tuple[int, int], int] = {}
        for d, s, x in self.windows(texts, np.full(len(self.sides), kept)):
            k = int(self.item[s])
            if (d, k) in out:
                continue
            side = self.sides[s]
            # down to single words, tiles cover all that can be matched, in whatever order: at least what a passage keeps
            covered = sum(t[2] for t in tiles(side.tolist(), x.tolist(), 1))
            if covered >= kept and holds_passage(side, x, self.words, self.per):
                out[d, k] = covered
        return [(d, k, c) for (d, k), c in out.items()]

    def cover(self, texts: list[str | None], share: float) -> list[tuple[int, int, float, bool]]:
        """(text, item, coverage, in_order): items of which tiles of TILE words or more cover ``share`` or more in one part of a text, by
        their best covered text; ``in_order`` is whether the tiles come in the order of the item."""
        least = np.ceil(self.length * share - 1e-9).astype(np.int64)
        out: dict[tuple[int, int], tuple[float, bool]] = {}
        for d, s, x in self.windows(texts, least):
            side = self.sides[s]
            found = sorted(tiles(side.tolist(), x.tolist(), TILE), key=lambda t: t[1])
            covered = sum(t[2] for t in found) / len(side)
            if covered >= share - 1e-9:
                k = int(self.item[s])
                order = all(a[0] < b[0] for a, b in zip(found, found[1:], strict=False))
                out[d, k] = max(out.get((d, k), (0.0, False)), (covered, order))
        return [(d, k, c, o) for (d, k), (c, o) in out.items()]


_INDEX: dict[tuple, Items] = {}


def _index(rows: tuple, words: int, per: int) -> Items:
    key = hash((rows, words, per))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Items([(i, list(t)) for i, t in rows], words, per)
    return _INDEX[key]


def leaked(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "pair_identifier", text_cols: tuple[str, ...] = ("good", "bad"), words: int = 12, per: int = 6, block: int = 20_000) -> DataFrame:
    """(document, item, tile_words) for each document that holds a passage of ``words`` or more words of an item.

    Up to one word in ``per`` may be altered, missing or added. The items are the query set: they go to the workers in blocks
    of about ``block`` items and 16 million characters at most, and every document is read once a block, without a shuffle.
    Null and empty texts hold nothing, items with a null id are left out, items below ``words`` words can't leak; an item id that
    comes twice has all its texts.
    """
    find = lambda index, texts: [(d, k, (c,)) for d, k, c in index.screen(texts)]
    return _streamed(documents, items, doc_col, text_col, item_col, text_cols, words, per, block, find, [("tile_words", "int", pa.int32())])


def covered(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "pair_identifier", text_cols: tuple[str, ...] = ("good", "bad"), share: float = COVERAGE, words: int = 12, per: int = 6, block: int = 20_000) -> DataFrame:
    """(document, item, coverage, in_order) for each document of which tiles of three words or more cover ``share`` of an item's words,
    in whatever order: reordered passages too. Items are streamed past as in :func:`leaked`."""
    find = lambda index, texts: [(d, k, (c, o)) for d, k, c, o in index.cover(texts, share)]
    return _streamed(documents, items, doc_col, text_col, item_col, text_cols, words, per, block, find, [("coverage", "double", pa.float64()), ("in_order", "boolean", pa.bool_())])


def _streamed(documents: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, text_cols: tuple[str, ...], words: int, per: int, block: int, find: Callable, extra: list[tuple]) -> DataFrame:
    kind = documents.schema[doc_col].dataType.simpleString()
    texts = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.array(*[F.col(c) for c in text_cols]).alias("t")).groupBy("i").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("t")))).alias("t"))
    n, chars = texts.agg(F.count("*"), F.sum(F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.char_length(x), F.lit(0))))).first()
    blocks = max(1, -(-n // block), -(-(chars or 0) // MOST_CHARS))
    source = documents.select(doc_col, text_col)
    out = None
    for k in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        rows = tuple(sorted((r["i"], tuple(x for x in r["t"] if x is not None)) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], rows: tuple = rows) -> Iterator[pa.RecordBatch]:
            index = _index(rows, words, per)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    found = find(index, piece.column(1).to_pylist())
                    ids = piece.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                    more = [pa.array([x[j] for _, _, x in found], t) for j, (_, _, t) in enumerate(extra)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([rows[k][0] for _, k, _ in found], pa.string()), *more], names=[doc_col, item_col, *[c for c, _, _ in extra]])

        one = source.mapInArrow(run, ", ".join([f"`{doc_col}` {kind}", f"`{item_col}` string", *[f"{c} {t}" for c, t, _ in extra]]))
        out = one if out is None else out.unionByName(one)
    return out
