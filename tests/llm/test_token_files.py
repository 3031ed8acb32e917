"""Token files: the coder, its checkpoints and checksums, ids equal to the library's, whole round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusward.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, end_id=2):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((name, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=3000), min_size=1, max_size=4), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(blocks, power):
    ids = [np.repeat(np.array(b, np.uint32) ** (power + 1), 7) for b in blocks]
    table = tokenfiles.Frequencies.of(np.bincount(np.concatenate(ids)))
    assert table.scaled.sum() == 1 << table.bits
    coded = [(len(x), *c) for x, c in zip(ids, tokenfiles.encode_blocks(ids, table), strict=True)]
    for x, y in zip(ids, tokenfiles.decode_blocks(coded, table), strict=True):
        assert x.tolist() == y.tolist()


def test_decoding_starts_at_any_checkpoint_and_size_is_near_the_entropy():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.4, tokenfiles.BLOCK) % 20_000).astype(np.uint32)
    counts = np.bincount(ids)
    table = tokenfiles.Frequencies.of(counts)
    [(words, marks)] = tokenfiles.encode_blocks([ids], table)
    step = tokenfiles.LANES * tokenfiles.STEPS
    for first in range(-(-len(ids) // step)):
        assert (tokenfiles.decode_blocks([(len(ids), words, marks)], table, first)[0] == ids[first * step :]).all()
    share = counts[counts > 0] / len(ids)
    assert 8 * (len(words) + len(marks)) / len(ids) < 1.03 * -(share * np.log2(share)).sum() + 0.3


@pytest.mark.parametrize("counts", [[5], [0, 0, 3], [1] * 70_000, [10**15, 1, 1, 0, 2]])
def test_scaled_frequencies(counts):
    table = tokenfiles.Frequencies.of(np.array(counts))
    assert table.scaled.sum() == 1 << table.bits and ((table.scaled > 0) == (np.array(counts) > 0)).all()


@given(st.binary(max_size=40), st.binary(max_size=3000))
def test_joined_checksums(a, b):
    assert tokenfiles.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_ids_equal_the_library_on_the_code_points_of_two_planes_and_some_of_the_others():
    texts = ["T" + c + "b " + c + " a" + c + ", " + c + "." for c in map(chr, [*range(1, 0x20000), *range(0x20000, 0x110000, 97)]) if not "\ud800" <= c <= "\udfff"]
    coder = tokenfiles._Cached(PATH)
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        for t, x, e in zip(part, coder.encode(part), coder.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert x.tolist() == e.ids, t


_PARTS = [*"aTsé'İΣ<|>.,!\t\n\r \u0308\u0301\u00a0\u3000\x1c1½ßŉ", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "word"]


@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=40).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library_on_random_texts(texts):
    coder = tokenfiles._cached(PATH)
    assert [x.tolist() for x in coder.encode(texts)] == [e.ids for e in coder.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_cache_that_overflows_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenfiles._Cached, "MOST", 3)
    coder = tokenfiles._Cached(PATH)
    for text in ["one two three four five", "six one " + "x" * 100, "", "six. six, six"]:
        assert next(coder.encode([text])).tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_round_trip_over_blocks(spark, tmp_path, monkeypatch):
    rows = [(i * 7 % 101, f"Document {i}, of some words; it's the {i}th. " * (i % 9)) for i in range(101)]
    rows += [(500, "a very long text " * 60_000), (501, None), (502, "")]  # several blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("part", F.lit("x")).withColumn("ids", F.lit(1))
    got = tokenfiles.round_trip(docs, PATH, 2, f"{tmp_path}/tokens")
    assert sorted(map(tuple, got.collect())) == expected(rows)
    pieces = tokenfiles.read(spark, f"{tmp_path}/tokens").orderBy("start").collect()
    whole = [i for p in pieces for i in p.ids]
    assert len(whole) == sum(r[2] for r in expected(rows)) and max(p.length for p in pieces) <= tokenfiles.BLOCK
    # some blocks alone
    blocks = spark.read.parquet(f"{tmp_path}/tokens/blocks")
    some = tokenfiles.read(spark, f"{tmp_path}/tokens", blocks=blocks.where("array_contains(doc_ids, 500)"))
    assert {p.number for p in some.where("doc_id = 500").collect()} == {p.number for p in pieces if p.doc_id == 500}


def test_null_and_repeated_ids_and_other_types(spark, tmp_path):
    rows = [(None, "no id"), (None, "no id"), (3, "three"), (3, "three"), (3, "tree")]
    got = sorted(tokenfiles.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2, f"{tmp_path}/a").select("doc_id", "start", "n_tokens").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    names = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    assert [r.doc_id for r in tokenfiles.round_trip(names, PATH, 2, f"{tmp_path}/b").orderBy("start").collect()] == ["a", "b"]


def test_empty_table(spark, tmp_path):
    assert tokenfiles.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, 2, f"{tmp_path}/t").collect() == []


def test_a_damaged_block_is_refused(spark, tmp_path):
    tokenfiles.round_trip(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), PATH, 2, f"{tmp_path}/t")
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks").withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read(spark, f"{tmp_path}/t", blocks=blocks).collect()
