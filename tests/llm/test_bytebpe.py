import pytest

from inkspark.llm import bytebpe as B

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", "a", "Hello world", "don't  'S x \n b\t\tc \u0085　z", "é" * 50, "👨‍👩‍👧 ﷺ ١٢ ½²", "a" * 5000, "ab" * 3000, " \x1c\x1d a\x1c b!\x1f\x1f c", "<|endoftext|> hi", "\t\n  \n x ", " \n b", "naïve café\r\n\r\n  code(x_1)  #3"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{B.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_merge_is_that_of_rescanning():
    ranks = B.tokenizer(B.BYTE_BPE_50K).ranks

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    for w in (b"", b"a", b"ab", b"the", b" straightforwardness", b"aaaaaaaaaaaaaaaaa", "überraschung".encode(), bytes(range(200, 256)), b"mississippi" * 9):
        assert B.merge_piece(w, ranks) == plain(w)


def test_encoding_of_all_kinds_of_text(spark, reference):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(99, None, 2), (0, "", 3)], "doc_id bigint, text string, ids int")
    rows = B.encode_corpus(df).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r["doc_id"]: list(r["ids"]) for r in rows}
    assert got.pop(99) == []
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)


def test_round_trip_through_the_other_library(reference):
    tiktoken = pytest.importorskip("tiktoken")
    e = B.tokenizer(B.BYTE_BPE_50K)
    enc = tiktoken.Encoding("own", pat_str=B.PATTERN.pattern, mergeable_ranks=e.ranks, special_tokens={})
    import numpy as np

    for t in TEXTS:
        assert enc.decode(np.frombuffer(e.encode(t), np.int32).tolist()) == t


def test_empty_table_and_counts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert B.encode_corpus(empty).collect() == []
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    rows = {r[0]: (r[1], r[2]) for r in B.count_tokens(df, ["doc_id"]).collect()}
    assert rows == {1: (11, 2), 2: (None, 0), 3: (0, 0)}
    with pytest.raises(ValueError):
        B.count_tokens(df.withColumnRenamed("doc_id", "chars"), ["chars"])


def test_kept_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(B.ByteBpe, "KEEP", 10)
    e = B.ByteBpe(B.BYTE_BPE_50K)
    whole = B.tokenizer(B.BYTE_BPE_50K)
    text = " ".join(f"word{i} Überzahl{i}" for i in range(100))
    assert e.encode(text) == whole.encode(text)
    assert len(e.segments) <= 10
