"""The pipeline against a brute-force version, and each stage's columns."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusward.llm import quality
from test_small_operators import brute_components, brute_repeats


def base_failed(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def corpus():
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(3000)]
    passage = [f"passage{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = rng.choice(words, int(rng.integers(60, 300))).tolist()
        rows.append((i, " ".join(own[:30] + passage * (i % 4 == 0) + own[30:])))
    rows += [(100 + i, rows[i][1] + " and more") for i in range(10)] + [(200, None), (201, ""), (202, "one two three"), (203, "a b c d e " * 20)]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows if not base_failed(r[1])]
    groups = brute_components([(r[0], r[1], "") for r in kept], 5, 80)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    left = brute_repeats([(r[0], r[1], "") for r in kept], 50)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r[0]: len(tokens.encode(left[r[0]][2] if left[r[0]][1] else r[1], add_special_tokens=False).ids) + 1 for r in kept}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want
    lengths = Counter()
    for r in out:
        lengths[r.doc_id] += r.length
    assert lengths == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "packing"]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # Soft rules reject on bad hosts only.
    assert quality.keep_good(docs).count() == sum(not base_failed(r[1]) for r in corpus())
