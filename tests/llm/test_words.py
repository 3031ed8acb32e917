"""Words of many texts at once."""

import random

import numpy as np
import pyarrow as pa

from corpusward.llm import words as W


def test_blocks_of_a_column_are_bounded_and_those_of_its_texts():
    rng = random.Random(5)
    texts = [rng.choice([None, "", "a" * rng.randrange(60), "é€" * rng.randrange(9)]) for _ in range(300)]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["x", *texts], pa.string()).slice(1), pa.array([], pa.string())):
        for most in (1, 50, 10_000):
            got, want = list(W.text_blocks(column, most)), [b for _, b in W.blocks(column.to_pylist())]
            assert [t for _, b in got for t in b] == [t for b in want for t in b]
            assert [s for s, _ in got] == np.cumsum([0, *(len(b) for _, b in got)])[: len(got)].tolist()
            assert all(len(b) == 1 or sum(map(len, b)) <= most for _, b in got)


def test_powers_are_held_once():
    W.rolling(np.ones(10, np.uint64), np.array([0]), np.array([10]))
    W.rolling(np.ones(5_000, np.uint64), np.array([0]), np.array([10]))
    short, long = W._powers(4, 0x9E3779B97F4A7C15 | 1), W._powers(12, 0x9E3779B97F4A7C15 | 1)
    assert short[0] is long[0] and short[1] is long[1]
