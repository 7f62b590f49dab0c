"""Lexical, dense and hybrid retrieval as joins and aggregations, and what is done with the results.

Many queries at once is the natural form: queries are rows. The words of an index are a table, so it is built once and reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from inkspark.functions.runs import runs, word_characters
from inkspark.operators.joins import small
from inkspark.plans.lineage import cut

# Saturation and length weight of BM25, and the rank offset of reciprocal rank fusion.
K1, B, RANK_OFFSET = 1.2, 0.75, 60


def top(df: DataFrame, k: int, by: str, score: str, tie: str) -> DataFrame:
    """The k best rows of each ``by`` with ``rank`` from 1, by falling score, then rising tie."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class LexicalIndex:
    """``packed`` (held, ...), a table of blocks of chunks, the distinct terms of each and how often it has them, in Arrow's own form;
    ``terms`` (term, df), and ``size`` (n, avg_len) of one row. A chunk's length is the number of its distinct terms."""

    packed: DataFrame
    terms: DataFrame
    size: DataFrame
    chunk_type: str

    @property
    def chunks(self) -> DataFrame:
        """(chunk, terms, tf) of all chunks."""
        return self.where(lambda ids: np.ones(len(ids), bool))

    def where(self, wanted: Callable[[pa.Array], np.ndarray]) -> DataFrame:
        """(chunk, terms, tf) of the chunks whose ids are wanted; the others are not unpacked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _unpacked(batches):
                part = block.filter(pa.array(wanted(block.column(0))))
                terms, tf = part.column(1), part.column(2)
                lists = [pa.ListArray.from_arrays(terms.offsets, terms.values.dictionary_decode()), pa.ListArray.from_arrays(tf.offsets, tf.values.cast(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["chunk", "terms", "tf"])

        return self.packed.select("held").mapInArrow(run, f"chunk {self.chunk_type}, terms array<string>, tf array<int>")


def _packed(block: pa.RecordBatch) -> pa.Array:
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, block.schema) as stream:
            stream.write_batch(block)
        return pa.array([out.getvalue().to_pybytes()], pa.binary())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column(0):
            yield from pa.ipc.open_stream(held.as_buffer())


def lexical_index(chunks: DataFrame, id_col: str, words: Column) -> LexicalIndex:
    """The terms of each chunk and the counts of all, from one pass over the chunks, written once as tables. ``words`` is the list of a
    chunk's words, or its folded text, whose words are runs of letters, digits and underscores. Chunks without a term count in n and
    with length 0; null ids are left out; ids are unique. Terms go to the table as places in a list of each block's terms, so that no
    row of Spark holds a word of a text."""
    c = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk"), words.alias("w"))
    texts = isinstance(c.schema["w"].dataType, StringType)
    c = c.withColumn("w", F.coalesce("w", F.lit("") if texts else F.array().cast("array<string>")))
    bits, arrow = word_characters(chunks.sparkSession) if texts else None, to_arrow_type(c.schema["chunk"].dataType)
    counted_type = pa.list_(pa.struct([("term", pa.string()), ("df", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, table = ["held", "n", "counted"], [], None if bits is None else np.unpackbits(bits).astype(bool)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            w = batch.column(1)
            n, w = runs(w, table) if texts else (w.value_lengths().to_numpy(), w.flatten())
            w = w.dictionary_encode(null_encoding="encode")
            size = max(1, len(w.dictionary))
            kind = np.int32 if len(n) * size < 2**31 else np.int64  # the smaller is sorted faster
            key, tf = np.unique(np.repeat(np.arange(len(n), dtype=kind), n) * kind(size) + w.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, kind(size))
            ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            term = pa.DictionaryArray.from_arrays(pa.array(code, pa.uint16() if size < 2**16 else pa.int32()), w.dictionary)
            tf = pa.array(tf, pa.uint8() if tf.max(initial=0) < 2**8 else pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (term, tf)]
            block = pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), *lists], names=["chunk", "terms", "tf"])
            yield pa.RecordBatch.from_arrays([_packed(block), pa.array([len(n)], pa.int64()), pa.nulls(1, counted_type)], names=names)
            seen.append((w.dictionary, np.bincount(code, minlength=len(w.dictionary))))
            if len(seen) >= 32:
                seen = [_summed(seen)]
        if seen:
            terms, df = _summed(seen)
            for a in range(0, len(terms), 10_000):
                part = pa.StructArray.from_arrays([terms[a : a + 10_000], pa.array(df[a : a + 10_000], pa.int64())], ["term", "df"])
                counted = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), counted], names=names)

    t = cut(c.mapInArrow(run, "held binary, n bigint, counted array<struct<term: string, df: bigint>>"))
    terms = cut(t.where("counted is not null").select(F.inline("counted")).groupBy("term").agg(F.sum("df").alias("df")))
    n, lengths = t.agg(F.sum("n")).first()[0] or 0, terms.agg(F.sum("df")).first()[0]
    size = chunks.sparkSession.createDataFrame([(n, (lengths or 0) / n if n else None)], "n bigint, avg_len double")
    return LexicalIndex(t.where("held is not null").select("held"), terms, size, c.schema["chunk"].dataType.simpleString())


def _summed(seen: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms and the sums of their numbers."""
    every = pa.concat_arrays([t for t, _ in seen]).dictionary_encode(null_encoding="encode")
    n = np.bincount(every.indices.to_numpy(), np.concatenate([n for _, n in seen]), len(every.dictionary))
    return every.dictionary, n.astype(np.int64)


class _Terms:
    """A block of queries, which lie in groups of similar ones: for each group a matrix of the terms that many queries and chunks hold, and for
    each group and term the list of its queries. ``groups`` are the bounds of the groups."""

    def __init__(self, query: np.ndarray, term: np.ndarray, idf: np.ndarray, common: np.ndarray, n: int, groups: np.ndarray):
        self.n, self.idf, self.groups = n, idf, groups
        self.place = np.full(len(idf), -1)
        self.place[common] = np.arange(len(common))
        self.common, matrix = len(common), np.zeros((len(common), n), np.float32)
        shared = self.place[term] >= 0
        matrix[self.place[term[shared]], query[shared]] = idf[term[shared]]
        self.parts = [matrix[:, a:b].copy() for a, b in zip(groups[:-1], groups[1:], strict=True)]  # rows of a slice would be taken from a copy of it, each time
        self.centres = _lengthless(np.add.reduceat(matrix, groups[:-1], axis=1).T)
        group = np.searchsorted(groups, query, "right") - 1
        key = group * len(idf) + term
        order = np.argsort(key, kind="stable")
        self.query, self.term, key = (query - groups[group])[order].astype(np.int32), term[order], key[order]
        self.first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.other = np.bincount(query, idf[term] * ~shared, n)
        self.key, self.size = key[self.first], np.diff(np.r_[self.first, len(key)])
        self.part = np.searchsorted(key, np.arange(len(groups)) * len(idf))
        # each of a query's terms adds one rounding error at most to a sum of positive numbers, beside those of its factors; taken twice
        self.slack = 1 - (np.bincount(query, minlength=n) + 8) * 2.0**-22

    def lists(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, place in ``used``): where the list of the group's queries with that term begins, and its length."""
        key = np.arange(len(self.groups) - 1)[:, None] * len(self.idf) + used
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.first[at], np.where(self.key[at] == key, self.size[at], 0)


def _lengthless(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-30)[:, None]


def _alike(rows: np.ndarray, most: int = 12, least: int = 512) -> np.ndarray:
    """A group for each row, by what it shares with the groups' means; groups only save work, whatever lies in them."""
    n = min(most, len(rows) // least)
    if n < 2:
        return np.zeros(len(rows), np.int64)
    u = _lengthless(rows)
    centres = u[np.arange(n) * len(rows) // n]
    for _ in range(8):
        of = np.argmax(u @ centres.T, axis=1)
        centres = _lengthless((of == np.arange(n)[:, None]).astype(np.float32) @ u)
    return np.argmax(u @ centres.T, axis=1)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class _Best:
    """The k best chunks of each query among those added so far."""

    def __init__(self, terms: _Terms, k: int):
        self.terms, self.k = terms, k
        self.top = np.zeros((terms.n, k), np.float32)  # the best rough scores
        self.kept: list[tuple] = []

    def floor(self, top: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The rough scores below which a chunk can't be among the k best, rounding to 6 places included; they have to be above 0."""
        return np.maximum(top.min(axis=1) * self.terms.slack[queries] - 2e-6, 1e-30).astype(np.float32)

    def add(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Postings of the chunks ``ids``, in order of their rows."""
        start = np.searchsorted(row, np.arange(len(ids) + 1))
        step = int(min(5000, max(256, 8_000_000 // max(1, self.terms.common))))
        for a in range(0, len(ids), step):
            b = min(a + step, len(ids))
            part = slice(start[a], start[b])
            self._add(ids[a:b], row[part] - a, term[part], weight[part])

    def _add(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        t = self.terms
        used = np.flatnonzero(np.bincount(term, minlength=len(t.idf)))
        local = np.full(len(t.idf), -1, np.int32)
        local[used] = np.arange(len(used))
        first, size = t.lists(used)
        # chunks lie in tiles by the group that they share most with
        at = t.place[term]
        x = np.zeros((t.common, len(ids)), np.float32)
        x[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        like = np.argmax(t.centres @ x, axis=0)
        order, n = np.argsort(like, kind="stable"), np.bincount(row, minlength=len(ids))
        at = _ranges((np.cumsum(n) - n)[order], n[order])
        ids, like, x, n = ids[order], like[order], np.take(x, order, axis=1), n[order]
        code, weight, row = local[term[at]], weight[at], np.repeat(np.arange(len(ids)), n)
        start, place, value = np.r_[0, np.cumsum(n)], t.place[used], weight * t.idf[used][code]
        bounds = np.unique(np.r_[np.flatnonzero(np.r_[True, like[1:] != like[:-1]]), np.arange(0, len(ids), 512), len(ids)])
        tiles = [(a, b, np.bincount(code[start[a] : start[b]], minlength=len(used))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [np.ascontiguousarray(x[:, a:b]) for a, b, _ in tiles]
        near = (t.centres @ t.centres.T)[:, like[bounds[:-1]]]
        # what a tile can give a query at most: the highest weights of its terms, and for terms out of the matrix the product of lengths
        most = np.maximum.reduceat(x, bounds[:-1], axis=1)
        other = np.maximum.reduceat(np.bincount(row, value * weight * (place[code] < 0), len(ids)), bounds[:-1])
        for g, (qa, qb) in enumerate(zip(t.groups[:-1], t.groups[1:], strict=True)):
            found, m, every = [], t.parts[g], np.arange(qa, qb)
            highest = m.T @ most + np.sqrt(t.other[qa:qb, None] * other)
            for h in np.argsort(-near[g], kind="stable"):  # similar ones first, since they raise the floor
                fine = np.flatnonzero(highest[:, h] >= self.floor(self.top[qa:qb], every))
                if not len(fine):
                    continue
                if len(fine) * 4 > (qb - qa) * 3:  # the product takes less time than parting them from the others
                    fine = np.arange(qb - qa)
                (a, b, df), queries = tiles[h], qa + fine
                both = size[g] * df
                # a product of matrices is faster for a term that one in 600 of all pairs of a query and a chunk share
                dense = (both * 600 > (qb - qa) * (b - a)) & (place >= 0)
                left = np.take(m, place[dense], axis=0)
                s = (left if len(fine) == qb - qa else np.take(left, fine, axis=1)).T @ np.take(columns[h], place[dense], axis=0)
                at = np.flatnonzero(((both > 0) & ~dense)[code[start[a] : start[b]]]) + start[a]
                c, lengths = code[at], size[g][code[at]]
                index = np.full(qb - qa, -1)
                index[fine] = np.arange(len(fine))
                q = index[t.query[_ranges(first[g][c], lengths)]]
                of = np.repeat(np.arange(len(at), dtype=np.int32), lengths)
                if len(fine) < qb - qa:
                    q, of = q[q >= 0], of[q >= 0]
                np.add.at(s.reshape(-1), q * (b - a) + (row[at] - a)[of], value[at].astype(np.float32)[of])
                top = self.top[queries]
                hit = np.flatnonzero(s >= self.floor(top, queries)[:, None])
                if len(hit) > 4 * self.k * len(fine) and b - a > self.k:  # the floor is raised first
                    raised = np.partition(s, b - a - self.k, axis=1)[:, b - a - self.k :]
                    hit = np.flatnonzero(s >= self.floor(np.maximum(raised, top.min(axis=1)[:, None]), queries)[:, None])
                if len(hit):
                    q, of = np.divmod(hit, b - a)
                    rough = s.reshape(-1)[hit]
                    found.append((fine[q], of + a, rough))
                    self.top[queries] = _raised(top, q, rough)
            if found:
                q, of, rough = (np.concatenate(x) for x in zip(*found, strict=True))
                fine = np.flatnonzero(rough >= self.floor(self.top[qa:qb], every)[q])
                q, of = q[fine], of[fine]
                part = slice(t.part[g], t.part[g + 1])
                holds = np.zeros((qb - qa, len(used) + 1), bool)
                holds[t.query[part], local[t.term[part]]] = True  # what is not used goes to the last column
                score, matched = _exact(holds, q, start[of], n[of], code, value)
                self.kept.append((q + qa, ids[of], score, matched))
        if self.kept:
            self.kept = [self.best()]

    def best(self) -> tuple[np.ndarray, ...]:
        query, ids, score, matched = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        at = _best(query, ids, score, self.k)
        return query[at], ids[at], score[at], matched[at]


def _raised(top: np.ndarray, row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The highest scores of each row of ``top`` and of those added to it."""
    k, order = top.shape[1], np.lexsort((-score, row))
    row, score = row[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    added = np.zeros_like(top)
    added[row[rank < k], rank[rank < k]] = score[rank < k]
    return np.partition(np.concatenate([top, added], axis=1), k, axis=1)[:, k:]


def _exact(holds: np.ndarray, query: np.ndarray, start: np.ndarray, n: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and the numbers of terms in common, of pairs of a query and a chunk, whose postings are n from start on."""
    score, matched = np.zeros(len(query)), np.zeros(len(query), np.int64)
    cuts = np.unique(np.r_[np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 2_000_000)), len(query)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at, pair = _ranges(start[a:b], n[a:b]), np.repeat(np.arange(b - a), n[a:b])
        found = holds[query[a:b][pair], code[at]]
        at, pair = at[found], pair[found]
        score[a:b] = np.bincount(pair, value[at], b - a)
        matched[a:b] = np.bincount(pair, minlength=b - a)
    return np.round(score, 6), matched


def _lists(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a batch of (chunk, terms, tf): ids, lengths, and of the terms that are in the vocabulary the rows, places there, and tf."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    ids = ids.astype(str) if ids.dtype == object else ids
    length, w = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten()
    w = w if isinstance(w, pa.DictionaryArray) else w.dictionary_encode(null_encoding="encode")
    known = pc.fill_null(pc.index_in(w.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)[w.indices.to_numpy()]
    fine = known >= 0
    return ids, length, np.repeat(np.arange(len(ids)), length)[fine], known[fine], batch.column(2).flatten().to_numpy()[fine].astype(np.int64)


def _joined(parts: Iterator[tuple[np.ndarray, ...]], least: int = 5000) -> Iterator[tuple[np.ndarray, ...]]:
    """What :func:`_lists` gives, of some 5,000 rows at once."""
    held, n = [], 0
    for ids, length, at, *rest in parts:
        held.append((ids, length, at + n, *rest))
        n += len(ids)
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def bm25(index: LexicalIndex, queries: DataFrame, query_col: str, words: Column, k: int = 5, sources: DataFrame | None = None, block: int = 4_000_000, most_queries: int = 20_000) -> DataFrame:
    """(query, rank, chunk, score, matched): the k best chunks of each query, ties by chunk, as a table.

    A query is its set of terms. ``sources`` (chunk) restricts the candidates, while n, df and lengths stay those of the whole index.
    The queries' terms go to the chunks in blocks of about ``block`` terms and ``most_queries`` queries, a proven bound. All chunks are
    scored: terms that many queries and chunks share by products of matrices in single precision, the others along lists. What may,
    within the proven error of that, be among the k best is scored anew in double precision, so the result is exact; only the k best
    of each task and query are shuffled. Scores are rounded to 6 places before ranking, so that the order of addition can't part
    equal ones.
    """
    q = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(words)).alias("term")).distinct()
    n, avg_len = index.size.first()
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = cut(q.join(index.terms.select("term", "df", idf.alias("idf")), "term"))
    rows, of = q.agg(F.count("*"), F.count_distinct(F.struct("query"))).first()
    blocks = max(1, -(-rows // block), -(-of // most_queries))
    some = sources is not None
    chunks = index.chunks.join(small(sources.select("chunk").distinct()), "chunk", "left_semi").select("chunk", "terms", "tf") if some else index.packed
    kinds = f"query {q.schema['query'].dataType.simpleString()}, chunk {index.chunk_type}, score double, matched bigint"
    arrow = [to_arrow_type(f.dataType) for f in StructType.fromDDL(kinds)[:2]]

    def scored(part: DataFrame) -> DataFrame:
        t = part.select("query", "term", "df", "idf").toArrow().combine_chunks()
        name, term = (t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query", "term"))
        names, vocabulary = name.dictionary, term.dictionary
        query, term = name.indices.to_numpy(), term.indices.to_numpy()
        first = np.zeros(len(vocabulary), np.int64)
        first[term] = np.arange(len(term))
        df, idf = (t.column(c).to_numpy()[first] for c in ("df", "idf"))
        # terms that one in 2,000 of all pairs of a query and a chunk share; the matrix has 64 MB at most
        shared = df / max(n, 1) * np.bincount(term, minlength=len(df))
        common = np.argsort(-shared, kind="stable")[: 16_000_000 // max(1, len(names))]
        common = common[shared[common] * 2000 > len(names)]
        rows = np.zeros((len(names), len(common)), np.float32)
        place = np.full(len(df), -1)
        place[common] = np.arange(len(common))
        at = place[term]
        rows[query[at >= 0], at[at >= 0]] = idf[term[at >= 0]]
        group = _alike(rows)
        order = np.argsort(group, kind="stable")
        names, query = names.take(pa.array(order)), np.argsort(order)[query]
        groups = np.unique(np.r_[np.searchsorted(group[order], np.arange(group.max(initial=-1) + 1)), len(order)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for ids, length, at, known, tf in _joined(_lists(b, vocabulary) for b in (batches if some else _unpacked(batches))):
                if not len(names):
                    continue
                best = best or _Best(_Terms(query, term, idf, common, len(names), groups), k)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (avg_len or 1.0))[at])
                best.add(ids, at, known, weight)
            if best and best.kept:
                of, ids, score, matched = best.best()
                cols = [names.take(pa.array(of)).cast(arrow[0]), pa.array(ids).cast(arrow[1]), pa.array(score, pa.float64()), pa.array(matched, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["query", "chunk", "score", "matched"])

        # a task's first chunks cost most, as its floors are low, and each task sends its k best
        return chunks.coalesce(3 * chunks.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, kinds)

    parts = [q] if blocks == 1 else [q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) for b in range(blocks)]
    return cut(top(reduce(DataFrame.unionByName, map(scored, parts)), k, "query", "score", "chunk").select("query", "rank", "chunk", "score", "matched"))


def unit(v: Column) -> Column:
    """A vector of length 1; null for a null, empty or zero one."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by falling score, then rising id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def nearest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k rows of ``vectors`` with the highest cosine to each of ``queries``, all of length 1."""
    scores = np.round(vectors @ queries.T, 6) + 0.0
    if len(scores) > k:
        at = np.nonzero(scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    else:
        at = np.nonzero(np.ones(scores.shape, bool))
    row, query = at
    keep = _best(query, ids[row], scores[at], k)
    return query[keep], ids[row[keep]], scores[at][keep]


def dense(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_col: str, k: int = 5, most_queries: int = 5000) -> DataFrame:
    """(query, rank, chunk, score): the k nearest vectors of each query by exact cosine, ties by chunk; no floor on the score.

    The query set is stated: it goes to the vectors in blocks of ``most_queries``, each block one pass of matrix products over the
    vectors without a shuffle of them; only the k best of each task and query go on. Null and zero vectors, vectors with a null,
    and such of another dimension than the query's match nothing; null ids are left out.
    """
    q = cut(queries.select(F.col(query_col).alias("query"), unit(F.col(vector_col)).alias("u")).where("u is not null and query is not null"))
    v = vectors.select(F.col(id_col).alias("chunk"), F.col(vector_col).cast("array<double>").alias("v")).where("chunk is not null and v is not null")
    blocks = max(1, -(-q.count() // most_queries))
    arrow = [to_arrow_type(df.schema[c].dataType) for df, c in ((q, "query"), (v, "chunk"))]
    kinds = [f"query {q.schema['query'].dataType.simpleString()}", f"chunk {v.schema['chunk'].dataType.simpleString()}", "score double"]

    def scored(part: DataFrame) -> DataFrame:
        rows = sorted(((r["query"], r["u"]) for r in part.collect() if None not in r["u"]), key=lambda r: (len(r[1]), r[0]))
        by_dim = {n: [r for r in rows if len(r[1]) == n] for n in {len(r[1]) for r in rows}}

        blocks_of = [([r[0] for r in by_dim[n]], np.array([r[1] for r in by_dim[n]])) for n in sorted(by_dim)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[list[tuple]] = [[] for _ in blocks_of]
            for batch in batches:
                lengths = np.array(batch.column(1).value_lengths())
                for j, (_, u) in enumerate(blocks_of):
                    part = batch.take(pa.array(np.flatnonzero(lengths == u.shape[1])))
                    x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, u.shape[1])
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    ids = ids.astype(str) if ids.dtype == object else ids
                    norm = np.sqrt((x * x).sum(axis=1))
                    fine = norm > 0  # false for a null within
                    x, ids = x[fine] / norm[fine][:, None], ids[fine]
                    step = max(1, 4_000_000 // len(u))
                    for at in range(0, len(x), step):
                        kept[j].append(nearest(x[at : at + step], ids[at : at + step], u, k))
                        if len(kept[j]) > 16:
                            kept[j] = [_merged(kept[j], k)]
            for (names, _), found in zip(blocks_of, kept, strict=True):
                if found:
                    query, ids, score = _merged(found, k)
                    cols = [pa.array([names[i] for i in query], arrow[0]), pa.array(ids).cast(arrow[1]), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["query", "chunk", "score"])

        return v.mapInArrow(run, ", ".join(kinds))

    parts = [q] if blocks == 1 else [q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) for b in range(blocks)]
    return top(reduce(DataFrame.unionByName, map(scored, parts)), k, "query", "score", "chunk").select("query", "rank", "chunk", "score")


def _merged(kept: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, ids, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    at = _best(query, ids, score, k)
    return query[at], ids[at], score[at]


def fuse(lexical: DataFrame, dense_: DataFrame, k: int = 5, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(query, rank, chunk, score, lexical_rank, dense_rank): reciprocal rank fusion of two rankings, ties by chunk."""
    a = lexical.select("query", "chunk", F.col("rank").alias("lexical_rank"))
    b = dense_.select("query", "chunk", F.col("rank").alias("dense_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (RANK_OFFSET + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query", "chunk"], "full_outer").withColumn("score", F.round(part("lexical_rank", weights[0]) + part("dense_rank", weights[1]), 12))
    return top(both, k, "query", "score", "chunk").select("query", "rank", "chunk", "score", "lexical_rank", "dense_rank")


def sufficient(queries: DataFrame, index: LexicalIndex, results: DataFrame, query_col: str, words: Column, stop: list[str], most_share: float = 0.25) -> DataFrame:
    """(query, discriminating, covered, sufficient): whether a retrieved chunk holds a term of the query that is no stop word and
    stands in 1 to ``most_share`` of the chunks."""
    q = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(words)).alias("term")).where(~F.col("term").isin(stop))
    n = index.size.first()[0]
    telling = q.join(index.terms.where(F.col("df") <= n * most_share), "term").select("query", "term")
    held = index.chunks.join(small(results.select("chunk").distinct()), "chunk", "left_semi").select("chunk", F.explode("terms").alias("term"))
    found = telling.join(results.select("query", "chunk"), "query").join(held, ["chunk", "term"], "left_semi").groupBy("query").agg(F.count_distinct("term").alias("covered"))
    size = telling.groupBy("query").agg(F.count("*").alias("discriminating"))
    every = queries.select(F.col(query_col).alias("query"))
    return every.join(size, "query", "left").join(found, "query", "left").fillna(0, ["discriminating", "covered"]).withColumn("sufficient", F.col("covered") > 0)


def resolve_citations(cited: DataFrame, packed: DataFrame, answer_col: str = "answer", ref_col: str = "ref") -> DataFrame:
    """(answer, ref, status): malformed if the identifier has no valid form, else resolved or unknown by whether the answer's pack holds it."""
    c = cited.select(F.col(answer_col).alias("answer"), F.col(ref_col).alias("ref"))
    p = packed.select(F.col(answer_col).alias("answer"), F.col(ref_col).alias("ref"), F.lit(True).alias("held")).distinct()
    valid = F.col("ref").rlike("^(src|chk)_[0-9a-f]{16}$")
    return c.join(p, ["answer", "ref"], "left").select("answer", "ref", F.when(~valid, "malformed").when(F.col("held"), "resolved").otherwise("unknown").alias("status"))


def validate_citations(claims: DataFrame, packed: DataFrame, expected: DataFrame) -> DataFrame:
    """(claim, chunk, status) of claims (claim, chunk): unknown if not packed, irrelevant if packed but not expected, else valid."""
    p = packed.select("chunk").distinct().withColumn("held", F.lit(True))
    e = expected.select("claim", "chunk").distinct().withColumn("meant", F.lit(True))
    x = claims.join(p, "chunk", "left").join(e, ["claim", "chunk"], "left")
    return x.select("claim", "chunk", F.when(F.col("held").isNull(), "unknown").when(F.col("meant").isNull(), "irrelevant").otherwise("valid").alias("status"))


def citation_metrics(validated: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts, precision and recall; a ratio without a denominator is 1."""
    n = validated.agg(F.count("*").alias("citations"), *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "unknown", "irrelevant")])
    m = expected.select("claim", "chunk").distinct().agg(F.count("*").alias("expected"))
    one = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(1.0)), 6)
    return n.join(m, F.lit(True)).select("*", one("valid", "citations").alias("precision"), one("valid", "expected").alias("recall"))


def case_metrics(results: DataFrame, gold: DataFrame, forbidden: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """The metrics of :func:`judged_metrics` where gold and forbidden chunks are lists of (query, chunk)."""
    g = gold.select("query", "chunk").distinct().withColumn("good", F.lit(True))
    f = forbidden.select("query", "chunk").distinct().withColumn("bad", F.lit(True))
    r = results.where(F.col("rank") <= k).join(g, ["query", "chunk"], "left").join(f, ["query", "chunk"], "left")
    size = g.groupBy("query").agg(F.count("*").alias("gold_size"))
    return judged_metrics(r, cases.select("query").join(size, "query", "left"), k)


def judged_metrics(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """(query, gold_size, recall, precision, reciprocal_rank, hit, forbidden_hits, retrieved) of each case (query, gold_size).

    Results carry their judgement (``good``, ``bad``), so gold need not be listed where it follows from the chunk. Recall without
    gold is 0, and precision divides by what was retrieved.
    """
    per = results.where(F.col("rank") <= k).groupBy("query").agg(F.count("*").alias("retrieved"), F.count_if("good").alias("hits"), F.count_if("bad").alias("forbidden_hits"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    x = cases.select("query", "gold_size").join(per, "query", "left").fillna(0, ["retrieved", "hits", "forbidden_hits", "gold_size"])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return x.select("query", "gold_size", ratio("hits", "gold_size").alias("recall"), ratio("hits", "retrieved").alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), (F.col("hits") > 0).alias("hit"), "forbidden_hits", "retrieved")


def run_metrics(cases: DataFrame) -> DataFrame:
    """Means over the cases that have gold; forbidden hits over all, and retrievals for cases without gold apart."""
    has = F.col("gold_size") > 0
    mean = lambda c: F.round(F.avg(F.when(has, F.col(c).cast("double"))), 6)
    return cases.agg(F.count("*").alias("cases"), F.count_if(has).alias("scored"), mean("recall").alias("recall"), mean("precision").alias("precision"), mean("reciprocal_rank").alias("mrr"), mean("hit").alias("hit_rate"), F.sum("forbidden_hits").alias("forbidden_hits"), F.count_if(~has & (F.col("retrieved") > 0)).alias("false_retrievals"))


def hashed(grams: Column) -> Column:
    """128 bits of each gram: what is shuffled in place of its words."""
    return F.transform(grams, lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(1), g).alias("b")))


def overlap(training: DataFrame, held_out: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """(id, windows, shared, ratio): how many of a held-out unit's distinct windows occur in training; ratio null without windows."""
    seen = training.select(F.explode(hashed(grams)).alias("g")).select("g.*").distinct().withColumn("seen", F.lit(1))
    h = held_out.select(F.col(id_col).alias("id"), F.explode(hashed(F.array_distinct(grams))).alias("g")).select("id", "g.*")
    per = h.join(seen, ["a", "b"], "left").groupBy("id").agg(F.count("*").alias("windows"), F.count("seen").alias("shared")).withColumnRenamed("id", id_col)
    return held_out.select(id_col).join(per, id_col, "left").fillna(0, ["windows", "shared"]).withColumn("ratio", F.round(F.try_divide(F.col("shared"), F.col("windows")), 6))


def contaminated(items: DataFrame, item_col: str, item_grams: Column, corpus: DataFrame, corpus_grams: Column) -> DataFrame:
    """(item) of the items that share a gram with the corpus. The items' grams go to the corpus if they are few (counted first), so
    that of the corpus only shared grams are moved."""
    g = items.select(F.col(item_col), F.explode(hashed(item_grams)).alias("g")).select(item_col, "g.*")
    found = corpus.select(F.explode(hashed(corpus_grams)).alias("g")).select("g.*").join(small(g.select("a", "b").distinct()), ["a", "b"], "left_semi").distinct()
    return g.join(found, ["a", "b"], "left_semi").select(item_col).distinct()
