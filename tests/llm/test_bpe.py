"""Byte-level BPE against tiktoken, and as an exact round trip."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tallyweave.llm import bpe, queries


@pytest.fixture(scope="module")
def whole():
    path, pattern = bpe.vocabulary_files()
    return tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}).encode_ordinary


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def odd_texts():
    draw = random.Random(11)
    texts = ["", " ", "  a  b \n\n c ", " a", "a ", "x <|endoftext|> y", "don't I'LL we've 's 'S", "\x1c\x85　 a b c", "中文字符 🎉🎉"]
    texts += ["a" * 3000, "ab" * 2001, "".join(draw.choice("ACGT") for _ in range(4000)), "=" * 500, "\n" * 300 + "x"]
    texts += ["".join(draw.choice(" \n\t'aAé中1!-_ s ") for _ in range(120)) for _ in range(200)]
    return texts


def test_coder_against_tiktoken(whole, monkeypatch):
    path, pattern = bpe.vocabulary_files()
    coder, texts = bpe.Coder(bpe.read_ranks(path), pattern), odd_texts()
    assert [ids(x) for x in coder.encode(texts)] == [whole(t) for t in texts]
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]
    # Small bounds: texts, words and lists of ids go through in parts, and no more words are kept.
    for name, value in {"HELD_CHARS": 50, "SLICE_CHARS": 20, "SLICE_IDS": 7, "KEPT_WORDS": 3, "SHORT": 5}.items():
        monkeypatch.setattr(bpe, name, value)
    few = [*texts[:12], *texts[-20:]]
    coder = bpe.Coder(bpe.read_ranks(path), pattern)
    assert [ids(x) for x in coder.encode(few)] == [whole(t) for t in few]
    assert coder.decode(coder.encode(few)) == [t.encode() for t in few]


def test_vocabularies_with_other_orders_of_merges():
    """Short alphabets in random order, where a merge may use a token of a higher rank: one pair a time and all at once agree."""
    draw = random.Random(4)
    for _ in range(6):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = {"".join(draw.choice("ab") for _ in range(draw.randint(2, 5))).encode() for _ in range(14)}
        ranks |= {t: 256 + i for i, t in enumerate(draw.sample(sorted(tokens), len(tokens)))}
        whole = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(draw.choice("abb") for _ in range(n)) for n in (3, 9, 30, 41, 60, 90)]
        coder = bpe.Coder(ranks, r"\S+|\s+")
        assert [ids(x) for x in coder.encode(texts)] == [whole.encode_ordinary(t) for t in texts]


def test_errors():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Coder({b"a": 0}, r"\S+")
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.coder(*bpe.vocabulary_files()).decode([np.array([5, 10**6], "<u4").tobytes()])


def test_query_against_tiktoken(spark, data_dir, whole):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    found = queries.QUERIES["op13_byte_bpe"](spark, data_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = whole(texts[row["doc_id"]])
        assert row["n_tokens"] == len(expected)
        assert row["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, odd, empty, whole):
    """Nulls, empty and long texts, repeated rows and clashing names; encode and decode apart and together."""
    named = odd.withColumnsRenamed({"token": "ids", "size": "decoded"})
    apart = bpe.decode(bpe.encode(named).drop("decoded"))
    assert set(apart.columns) == {*named.columns, "decoded"} - {"text", "ids"}
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in apart.collect()) == texts
    both = sorted((r["doc_id"] or 0, ids(r["ids"]), bytes(r["decoded"]).decode()) for r in bpe.recode(named).collect())
    assert both == sorted((i, whole(t), t) for i, t in texts)
    assert bpe.recode(empty).count() == bpe.decode(bpe.encode(empty)).count() == 0
