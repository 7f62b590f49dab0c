"""Languages of documents and of their stretches, by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability in a language is the sum over
all ways to cut it into pieces (forward algorithm), and the piece probabilities are fitted to labelled samples by the same
sum (expectation maximisation over a few thousand distinct words, on the driver). A text's words then carry a vector of log
probabilities each, and a Viterbi path with a fixed cost of changing language cuts it into stretches.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.bytebpe import TOKENIZERS
from inkspark.llm.cleaning import bare, prepare, words_in

PIECES_32K = os.path.join(TOKENIZERS, "piece_bpe_32k.model")
# The words of one letter of the six languages; what may stand around one.
ONE_LETTER = set("aàyeèoóiu")
EDGES = ".,;:!?¡¿()[]\"“”„«»*_`-—–…>|"


def public_pieces(path: str) -> list[str]:
    """Lower-case letter pieces of a public vocabulary, with the mark of a word's start; in any case, once each."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        if p != "▁" and p.replace("▁", "", 1).isalpha():
            out[p] = None
    for c in [chr(c) for c in range(ord("a"), ord("z") + 1)] + [c for p in list(out) for c in p if c != "▁"]:
        out[c] = None
        out["▁" + c] = None
    return list(out)


@dataclass
class Model:
    """Piece log probabilities, a row per language; ``floor`` is a letter that is no piece."""

    languages: list[str]
    pieces: list[str]
    logp: np.ndarray
    floor: float = -14.0
    index: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)

    def cuts(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end of a marked word the (start, piece) of the pieces that end there."""
        n, get = len(word), self.index.get
        out: list[list[tuple[int, int]]] = [[]]
        for e in range(1, n + 1):
            here = []
            for b in range(max(0, e - self.longest), e):
                if (i := get(word[b:e])) is not None:
                    here.append((b, i))
            if not here or (e == 2 and word[0] == "▁" and not any(b == 0 for b, _ in here)):
                here.append((max(0, e - 2) if e == 2 and word[0] == "▁" else e - 1, -1))
            out.append(here)
        return out

    def score(self, word: str) -> np.ndarray:
        """Log probability of a word in each language: the forward sum over all its segmentations."""
        word = "▁" + word.lower()
        alpha = np.full((len(word) + 1, len(self.languages)), -np.inf)
        alpha[0] = 0
        for e, here in enumerate(self.cuts(word)):
            if here:
                terms = np.array([alpha[b] + (self.logp[:, i] if i >= 0 else self.floor) for b, i in here])
                top = terms.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    alpha[e] = np.where(np.isfinite(top), safe + np.log(np.exp(terms - safe).sum(axis=0)), -np.inf)
        return np.where(np.isfinite(alpha[-1]), alpha[-1], self.floor * len(word))


def fit(samples: list[tuple[str, str]], languages: list[str], pieces: list[str], rounds: int = 6, smooth: float = 0.02) -> Model:
    """Piece probabilities per language by expectation maximisation over the words of the samples.

    Words count as written and, at half weight, without marks, since texts lose them. Each language starts from the same
    uniform probabilities; ``smooth`` of the mass is spread evenly over all pieces, so an unseen word keeps a probability.
    """
    counts: list[Counter] = []
    for lang in languages:
        c: Counter = Counter()
        for label, text in samples:
            if label == lang and text:
                for w in (x.lower() for chunk in prepare(text).split() for x in words_in(chunk) if x.isalpha()):
                    c[w] += 1.0
                    if (b := bare(w)) != w:
                        c[b] += 0.5
        counts.append(c)
    n, k = len(languages), len(pieces)
    model = Model(languages, pieces, np.full((n, k), -np.log(k)))
    cuts = {w: model.cuts("▁" + w) for c in counts for w in c}
    for _ in range(rounds):
        logp = np.empty((n, k))
        for l, c in enumerate(counts):
            expected = np.zeros(k)
            own = model.logp[l]
            for w, x in c.items():
                here = cuts[w]
                a = [0.0] + [0.0] * (len(here) - 1)
                a[0] = 1.0
                prob = [[(b, i, np.exp(own[i]) if i >= 0 else np.exp(model.floor)) for b, i in h] for h in here]
                for e in range(1, len(here)):
                    a[e] = sum(a[b] * p for b, _, p in prob[e])
                beta = [0.0] * len(here)
                beta[-1] = 1.0
                for e in range(len(here) - 1, 0, -1):
                    for b, _, p in prob[e]:
                        beta[b] += beta[e] * p
                if a[-1] > 0:
                    for e in range(1, len(here)):
                        for b, i, p in prob[e]:
                            if i >= 0:
                                expected[i] += x * a[b] * p * beta[e] / a[-1]
            total = expected.sum()
            share = expected / total if total else np.full(k, 1 / k)
            logp[l] = np.log((1 - smooth) * share + smooth / k)
        model = Model(languages, pieces, logp)
    return model


@dataclass
class Reader:
    """Reads languages off texts with a fitted model; keeps the evidence of the words it has met."""

    model: Model
    change: float = 9.0  # cost of changing the language, in nats
    clip: float = 5.0  # most evidence of a word
    least_words: int = 12
    least_evidence: float = 0.35  # nats a word over the median of the languages, below which it is no language
    least_distinct: int = 5  # words of a stretch that differ

    def __post_init__(self):
        n = len(self.model.languages)
        self.table = np.zeros((1 << 12, n), np.float32)
        self.size = 1  # row 0 stands for a number: it says nothing of the language
        outer = self

        class Known(dict):
            """Rows of the words of a part of text between white space, as bytes."""

            def __missing__(self, chunk: str) -> bytes:
                found = words_in(chunk)
                if len(found) == 1 and found[0].isdigit() and chunk.strip(EDGES) == found[0]:
                    return self.setdefault(chunk, bytes(4)) if len(chunk) <= 40 else bytes(4)
                words = [w for w in found if w.isalpha()]
                if len(words) > 1 or chunk.strip(EDGES) not in words:
                    words = [w for w in words if len(w) > 1]  # the letter of a formula, a list or a name
                rows = np.array([outer._row(w) for w in words if len(w) > 1 or w.lower() in ONE_LETTER], np.int32).tobytes()
                if len(chunk) <= 40:
                    self[chunk] = rows
                return rows

        self.known = Known()
        self.rows: dict[str, int] = {}

    def _row(self, word: str) -> int:
        word = word.lower()
        row = self.rows.get(word)
        if row is None:
            if self.size == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            row = self.rows[word] = self.size
            self.size += 1
            s = self.model.score(word)
            self.table[row] = np.clip(s - (s.max() + s.mean()) / 2, -self.clip, self.clip)
        return row

    def paths(self, evidence: list[np.ndarray]) -> list[np.ndarray]:
        """Best language of each word of each text: Viterbi with one cost for every change, over all the texts at once."""
        order = sorted(range(len(evidence)), key=lambda i: -len(evidence[i]))
        if not order or not len(evidence[order[0]]):
            return [np.empty(0, np.int64) for _ in evidence]
        n = evidence[0].shape[1]
        lengths = np.array([len(evidence[i]) for i in order])
        most = lengths[0]
        active = (lengths[None, :] > np.arange(most)[:, None]).sum(axis=1)
        flat = np.concatenate([evidence[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        back = np.empty((len(flat), n), np.int8)
        score = flat[starts[: active[0]]].astype(np.float64)
        final = [0] * len(order)
        same = np.arange(n, dtype=np.int8)
        for t in range(1, most):
            k = active[t]
            for j in range(k, len(score)):
                final[j] = int(score[j].argmax())
            score = score[:k]
            best = score.argmax(axis=1)
            jump = score[np.arange(k), best] - self.change
            stay = score >= jump[:, None]
            at = starts[:k] + t
            back[at] = np.where(stay, same[None, :], best[:, None])
            score = np.where(stay, score, jump[:, None]) + flat[at]
        for j in range(len(score)):
            final[j] = int(score[j].argmax())
        # back through all texts at once, each from its last word
        path = np.empty(len(flat), np.int8)
        state = np.array(final, np.int8)
        for t in range(most - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            path[at] = state[:k]
            if t:
                state[:k] = back[at, state[:k]]
        out: list = [None] * len(evidence)
        for j, i in enumerate(order):
            out[i] = path[starts[j] : starts[j] + lengths[j]]
        return out

    def read(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text its stretches (language, first word, words, confidence) in order, stretches of no language left out.

        A stretch has at least ``least_words`` words, a number between two words being one, and enough evidence a word. Its confidence is the posterior of its language
        over that stretch against the other languages, all alike before.
        """
        get = self.known.__getitem__
        if len(self.known) > 400_000:
            self.known.clear()
        if self.size > 300_000:
            self.known.clear()
            self.rows.clear()
            self.size = 1
        parts = [b"".join(map(get, prepare(t).split())) if t else b"" for t in texts]
        lengths = np.array([len(x) >> 2 for x in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), np.int32)
        ev = self.table[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sums = np.concatenate([np.zeros((1, ev.shape[1])), np.cumsum(ev, axis=0, dtype=np.float64)])
        number = ids == 0
        alone = np.zeros(len(ids) + 1, bool)
        alone[1:-2] = number[1:-1] & ~number[:-2] & ~number[2:]
        count = np.concatenate([[0], np.cumsum(~number)])
        between = np.concatenate([[0], np.cumsum(alone[: len(ids)])])
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        todo = np.flatnonzero(lengths >= self.least_words)
        paths = dict(zip(todo.tolist(), self.paths([ev[starts[i] : ends[i]] for i in todo]), strict=True))
        for i in range(len(texts)):
            n = int(lengths[i])
            if n < self.least_words:
                continue
            p = paths[i]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [n]])
            for lang, a, b in ((int(p[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)):
                x, y = starts[i] + a, starts[i] + b
                words = int(count[y] - count[x])
                inside = words + (int(between[y - 1] - between[x + 1]) if b - a > 2 else 0)
                if inside < self.least_words:
                    continue
                e = sums[y] - sums[x]
                v = sorted(e.tolist())
                if (e[lang] - (v[len(v) // 2] + v[(len(v) - 1) // 2]) / 2) / words < self.least_evidence:
                    continue
                kinds = ids[x:y]  # mostly its first ones hold enough kinds
                if len(set(kinds[:200].tolist()) - {0}) < self.least_distinct and len(set(kinds.tolist()) - {0}) < self.least_distinct:
                    continue
                out[i].append((lang, a, inside, 1.0 / sum(math.exp(max(-700.0, min(700.0, x - e[lang]))) for x in v)))
        return out


_READERS: dict[str, Reader] = {}


def languages_of(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", languages: tuple[str, ...] = ("en", "de", "fr", "es", "it", "nl"), label_col: str | None = None, path: str = PIECES_32K, most_samples: int = 20_000, least_words: int = 12) -> DataFrame:
    """(id, label, segment, lang, confidence, first_word, words): the stretches of each text in one language each, in order.

    ``label`` is the label as delivered, if ``label_col`` names one, else null. A text without ``least_words`` successive words of running text in a language (null, empty, tables, code) has one row of null
    language. The classifier is fitted on the driver on at most ``most_samples`` labelled samples (those of the least ids by
    hash, if there are more); the texts are read in one pass without a shuffle, whole, however long.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = samples.where(F.col("lang").isin(*languages) & F.col("text").isNotNull()).select("lang", "text").orderBy(F.xxhash64("lang", "text")).limit(most_samples).collect()
    model = fit([(r[0], r[1]) for r in rows], list(languages), public_pieces(path))
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((model.languages, model.pieces, model.logp.astype(np.float32)))
    key = str(hash((tuple((r[0], r[1]) for r in rows), path, least_words)))
    label = F.col(label_col) if label_col else F.lit(None)
    names = [id_col, "label", "segment", "lang", "confidence", "first_word", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READERS:
            _READERS.clear()
            langs, pieces, logp = shared.value
            _READERS[key] = Reader(Model(langs, pieces, logp.astype(np.float64)), least_words=least_words)
        reader = _READERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                rows = []
                for i, stretches in enumerate(reader.read(piece.column(2).to_pylist())):
                    rows += [(i, k, languages[s[0]], s[3], s[1], s[2]) for k, s in enumerate(stretches)] or [(i, 0, None, 0.0, None, None)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(arrays[0]), piece.column(1).take(arrays[0]), *arrays[1:]], names=names)

    return documents.select(id_col, label.cast("string").alias("label"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, label string, segment int, lang string, confidence double, first_word int, words int")
