"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusward.llm import bytepairs, chat, licenses, maxent, neardup, packing, quality, substrings, topk, urlfilter
from corpusward.llm.words import split

DOCS = "doc_id long, text string, source string, starts int, signature string, h long, length long, _q int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4) for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- top-k


def vectors(spark, rows):
    return topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, q long"))


def test_top_k_ties_own_id_and_bad_vectors(spark):
    v = vectors(spark, [(0, [1.0, 0.0], 1, 0), (5, [0.5, 0.0], 1, 0), (3, [0.5, 0.9], 1, 0), (4, [0.5, -1.0], 1, 0), (7, [None, 1.0], 1, 0), (8, [float("nan"), 1.0], 1, 0), (9, None, 1, 0), (10, [1.0], 1, 0), (5, [0.5, 0.0], 1, 0)])
    got = topk.top_k(v, v.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 3, 32768), (2, 4, 32768), (3, 5, 32768)]
    assert topk.top_k(v, v.where("vec_id = 10"), 3).count() == 0


def test_top_k_equals_brute_force_in_several_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[50:120] = x[50]  # a large group of equal vectors
    v = vectors(spark, [(i, r.tolist(), 0, 0) for i, r in enumerate(x)])
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5, block_numbers=20).collect()}
    m = np.floor(256 * x).astype(np.int64)
    for q in range(0, 300, 50):
        s = m @ m[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) for i in best]


def test_top_k_of_many_queries(spark):
    """Ranges end inside a bin for some of these queries in every pass."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    v = vectors(spark, [(i, r.tolist(), 0, 0) for i, r in enumerate(x)])
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 5 = 0"), 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    m = np.floor(256 * x).astype(np.int64)
    for q in range(0, 1500, 5):
        s = m @ m[q]
        order = np.lexsort((np.arange(1500), -s))
        best = [int(i) for i in order if i != q][:7]
        assert [got[q][k + 1] for k in range(7)] == [(i, s[i]) for i in best]


def test_top_k_empty(spark):
    v = vectors(spark, [])
    assert topk.top_k(v, v, 5).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(v, v, 5).count() == 0


# ---------------------------------------------------------------- language model


def test_lm_scores_are_probabilities_and_beat_the_base(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "eins zwei drei", "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "neverseen", "s"), (1, "alpha beta gamma", "s")]
    out = maxent.score_texts(docs(spark, rows), F.col("doc_id") >= 100).collect()
    assert len(out) == 64
    by = {r.doc_id: r for r in out}
    assert by[100].n_tokens == 1 and by[100].n_known == 1 and by[102].n_known == 1 and by[102].n_tokens == 2
    assert by[1].score > by[1].base_score
    assert all(r.score < 0 for r in out)
    assert maxent.score_texts(docs(spark, []), F.lit(False)).count() == 0
    assert maxent.score_texts(docs(spark, [(1, "a b", "s")]), F.lit(True)).first().n_known == 0


def test_lm_one_step_distribution_sums_to_one(spark):
    rows = [(i, "a b c d e f"[: 1 + 2 * (i % 6)], "s") for i in range(40)]
    one = [(200 + k, w, "s") for k, w in enumerate(["a", "b", "c", "d", "e", "f", "zz"])]
    got = {r.doc_id: r.score for r in maxent.score_texts(docs(spark, rows + one), F.col("doc_id") >= 200).collect()}
    # The probability of one-word texts is part of the mass of all texts.
    assert 0 < sum(10**got[200 + k] for k in range(7)) < 1


def test_lm_without_sent_counts(spark, monkeypatch):
    """Words whose counts are joined are scored as those whose counts are sent."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.2, 500) % 20_000), "s") for i in range(40)]
    score = lambda: {r.doc_id: tuple(round(float(x), 6) for x in r) for r in maxent.score_texts(docs(spark, rows), F.col("doc_id") % 5 == 1).collect()}
    sent = score()
    monkeypatch.setattr(maxent, "SENT", 0)
    assert score() == sent
    monkeypatch.setattr(maxent, "SENT", 2000)
    assert score() == sent


def test_lm_base_equals_brute_force(spark):
    rows = [(i, "Some words  are\x0bmore common. " + "The word " * (i % 7) + f"own{i} É\u00a0x {'y' * i}", "s") for i in range(50)]
    rows += [(50, None, "s"), (51, "", "s"), (52, " \n\t", "s"), (7, rows[7][1], "s"), (None, "no id at all", "s"), (53, "long text of words " * 30_000, "s"), (54, "a" * 100_000, "s")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {t: [*(w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")) if w), None] for _, t, _ in rows}
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens[t])
    total, types = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(tokens[t]), sum(counts[w] > 0 for w in tokens[t]), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens[t]), 4)) for i, t, _ in rows)
    out = maxent.score_texts(docs(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_lm_remembers_what_follows_contexts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "MEMORY", 1)
    same = "the quick brown fox jumps over the lazy dog and runs home"
    rows = [(1, same, "s"), (2, same, "s"), (3, "nothing of this stands anywhere else at all", "s"), (4, same, "s"), (5, "one two", "s"), (6, "nothing of this", "s")]
    out = {r.doc_id: r for r in maxent.score_texts(docs(spark, rows), F.col("doc_id") >= 4).collect()}
    assert [(out[i].n_contexts, out[i].n_again) for i in range(1, 7)] == [(10, 10), (10, 10), (6, 0), (10, 10), (0, 0), (1, 0)]
    assert out[4].score > out[4].base_score and out[4].score / 13 > out[3].score / 9


def test_lm_passages_hold_every_word(spark):
    """From the fourth word on, every token of every text is in one passage, at most LONGEST long."""
    rng = np.random.default_rng(21)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (0, 1, 3, 4, 40, 200, 900)] + ["a " * 500]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, batch int, text string")
    stats = maxent.Statistics(maxent._word_counts(rows))
    for r in maxent._encode(rows, stats).collect():
        n = r.n_tokens
        assert r.places[:1] == ([3] if n > 3 else []) and len(r.places) == len(r.contexts)
        assert all(0 < b - a <= maxent.LONGEST for a, b in zip(r.places, [*r.places, n][1:], strict=True))


def test_lm_every_repeated_text_is_remembered(spark):
    """Short texts that occur twice are seen again, whatever their words hash to."""
    texts = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(100)]
    rows = [(k, t, "s") for k, t in enumerate(texts + texts[:50])]
    out = {r.doc_id: r for r in maxent.score_texts(docs(spark, rows), F.lit(False)).collect()}
    assert all((out[k].n_again == out[k].n_contexts > 0) if k % 100 < 50 else out[k].n_again == 0 for k in out)


def test_lm_memory_keeps_a_distribution(spark):
    """Over all words, the probabilities after a context add up to one."""
    p = np.array([0.5, 0.25, 0.125])  # of three output words; the rest is other words'
    counted = [(0, 1, 0, 0.5)] * 3 + [(0, 1, 1, 0.25)] * 2
    asked = [(10 + w, -1, w, float(p[w])) for w in range(3)] + [(13, -1, -1, 0.01)]
    rows = spark.createDataFrame([(row, batch, [(77, word, 1, q)]) for row, batch, word, q in counted + asked], f"row long, batch int, memory {maxent._MEMORY}")
    got = {r.row: r.memory_score for r in maxent._remembered(rows).collect()}
    assert sum(p[w] * 10 ** got[10 + w] for w in range(3)) + 0.125 * 10 ** got[13] == pytest.approx(1)


def test_lm_tables_do_not_depend_on_partitions(spark):
    rows = [(np.array([i % 7, 1024 + i % 5, 3], "<u2").tobytes(),) for i in range(200)]
    encoded = spark.createDataFrame(rows, "symbols binary")
    few, many = (maxent._tables(encoded.repartition(n), None)[0] for n in (2, 96))
    assert all((a == b).all() for a, b in zip(few, many, strict=True)) and few[0].sum() == 4 * 600 and few[1].sum() == 400


# ---------------------------------------------------------------- licenses


def test_license_labels_places_and_edges(spark):
    text = "x " * 40 + "Licensed under CC BY-NC 4.0.\nApache License, apache license. GNU General\nPublic License"
    rows = [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "gnu general license mit", "s"), (1, text, "s"), (None, "the MIT licensed license", "s"), (5, "ÉMIT LICENSE mit  license", "s")]
    got = licenses.license_report(docs(spark, rows)).collect()
    assert len(got) == 7
    r = [x for x in got if x.doc_id == 1][0]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (4, 42, 51, "apache,cc-by,gpl", "apache,cc-by,cc-by-nc,gpl", 1.0)
    r = [x for x in got if x.doc_id == 4][0]
    assert (r.n_words, r.n_base, r.first_word, r.base_labels, r.score) == (4, 0, None, "", 0.0)
    r = [x for x in got if x.doc_id == 5][0]
    assert (r.n_words, r.n_base, r.first_word) == (4, 1, 2)
    assert licenses.license_report(docs(spark, [])).count() == 0


def test_templates_of_one_name_are_told_apart(spark):
    words = " ".join(f"alpha{i}" for i in range(12)), " ".join(f"beta{i}" for i in range(12))
    templates = [("same", "A1", words[0]), ("same", "B1", words[1])]
    out = licenses.license_report(docs(spark, [(1, " ".join(words), "s"), (2, words[1], "s")]), templates, {}).collect()
    assert {r.doc_id: r.labels for r in out} == {1: "A1,B1", 2: "B1"}


def test_license_templates_of_any_length_at_any_place(spark):
    long = [(f"t{n}", f"l{n}", " ".join(f"w{n}x{i}" for i in range(n))) for n in (32, 33, 64, 65, 700, 5000)]
    rows = [(1000 * n + shift, "pad " * shift + notice, "s") for (_, _, notice), n in zip(long, (32, 33, 64, 65, 700, 5000)) for shift in (0, 1, 31, 33, 63, 700)]
    rows.append((7, " ".join(long[4][2].split()[:600]), "s"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(docs(spark, rows), long, {}).collect()}
    assert got.pop(7) == ("", 0.0)
    assert got == {i: (f"l{i // 1000}", 1.0) for i in got} and len(got) == len(rows) - 1


# ---------------------------------------------------------------- near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in (t or "").split()]
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets[i] = s
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        for k in range(6):
            own = list(base)
            for _ in range(k):
                own[rng.integers(120)] = "new%d" % rng.integers(1000)
            rows.append((100 * g + k, " ".join(own), "s"))
    rows += [(5000, "one two", "s"), (5001, "One  TWO\n", "s"), (5002, "one", "s"), (5003, "", "s"), (5004, None, "s"), (5005, "", "s"), (5006, rows[0][1], "s")]
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), size, percent).collect()}
        assert got == brute_components(rows, size, percent)


def test_near_duplicates_chain_through_other_than_the_centre(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(10 - k, " ".join([f"z{j}" for j in range(3 * k)] + base[3 * k :]), "s") for k in range(10)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    same, other = np.zeros(neardup.SYMBOLS, "<u2").tobytes(), np.ones(neardup.SYMBOLS, "<u2").tobytes()
    rows = [(1, i, i, same, [1, 2, 3, 4]) for i in range(21)] + [(1, 50, 50, other, [1, 2, 3, 4]), (2, 60, 60, same, [7]), (2, 61, 61, same, [8])]
    rows = spark.createDataFrame(rows, "centre long, node long, component long, signature binary, shingles array<long>").withColumn("n", F.lit(22)).withColumn("tiles", F.lit(6))
    near = neardup._with_near_partner(rows.select("centre", "n", "node", "component", "signature"), 3)
    assert {r.node for r in near.collect()} == {*range(21), 60, 61}
    links = neardup._links_in_tiles(rows.drop("n").select("centre", "tiles", "node", "component", "signature", "shingles"), 3, 85)
    assert {r.component for r in neardup.components(links).collect()} == {0}


def _pair_that_signatures_miss():
    """Forty words, and 32 of them, whose signatures differ in two symbols of every chunk of the index."""
    pool = [f"w{i}" for i in range(100_000)]
    found = split([w.encode() for w in pool])
    x = neardup.W.mix(neardup.W.rolling(found.hashes(), np.arange(len(pool)), np.arange(len(pool)) + 1) + np.uint64(1))
    values = {k: x * neardup._FACTORS[k] + neardup._TERMS[k] for k in range(neardup.INDEXED) if k % neardup.CHUNK < 2}
    low = np.uint64((1 << 64) // 50)
    gone = [int(np.flatnonzero((values[c] < low) & (values[c + 1] < low))[0]) for c in range(0, neardup.INDEXED, neardup.CHUNK)]
    kept = [i for i in np.flatnonzero(np.all([v >= low for v in values.values()], axis=0)) if i not in gone][:32]
    return " ".join(pool[i] for i in gone + kept), " ".join(pool[i] for i in kept)


@pytest.mark.parametrize("common", [True, False])
def test_links_that_signatures_miss_are_found(spark, common, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 2)
    if not common:
        monkeypatch.setattr(neardup, "SAMPLE", 0.001)
    whole, part = _pair_that_signatures_miss()
    marks = neardup.signatures(spark.createDataFrame([(1, whole), (2, part)], "doc_id long, text string"), 1).withColumnRenamed("doc_id", "node")
    assert neardup.index_keys(marks).groupBy("key").count().where("count > 1").isEmpty()
    rows = [(7, whole, "s"), (3, part, "s"), (9, part, "s"), (5, whole.rsplit(" ", 20)[0], "s")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 1, 80).collect()}
    assert got == {3: 3, 7: 3, 9: 3, 5: 5}


def test_prefixes_alone_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "index_keys", lambda nodes: nodes.where("false").select(F.col("node").alias("key"), "node"))
    rng = np.random.default_rng(5)
    base = rng.choice(300, (4, 60))
    rows = [(i, " ".join(f"w{w}" for w in np.where(rng.random(60) < rng.choice([0.01, 0.03, 0.06]), rng.integers(300, 900, 60), base[i % 4])[: rng.integers(50, 61)]), "s") for i in range(60)]
    for size, percent in ((2, 85), (1, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), size, percent).collect()}
        assert got == brute_components(rows, size, percent)
        assert 4 < len({c for _, c in got.values()}) < 60


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    out = neardup.near_duplicates(docs(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s")])).collect()
    assert [r.kept for r in out] == [True] * 3
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs(spark, []), 3, 50)


# ---------------------------------------------------------------- URLs


def test_url_rules(spark):
    rules = spark.createDataFrame([("example.com", "/a", "block"), ("example.com", "/ab", "allow"), ("com", "", "block"), ("com", "", "block"), (None, "/any", "allow"), ("sub.x.org", "/p", "block"), ("x.org", "/p", "allow")], "host string, path string, verdict string")
    urls = ["http://EXAMPLE.com/abc", "https://www.example.com/a?x#y", "ftp://badexample.com/", "nourl", None, "http://a.org/any", "http://sub.x.org/p", "http://ex.net", "x://h.com?://q/", "http://example.com/abc"]
    pages = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, host string, k int, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_verdicts(pages, rules).collect()}
    assert got == {
        0: ("example.com", "/abc", "example.com/ab", "allow"), 1: ("www.example.com", "/a", "example.com/a", "block"), 2: ("badexample.com", "/", "com", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("a.org", "/any", "/any", "allow"), 6: ("sub.x.org", "/p", "sub.x.org/p", "block"), 7: ("ex.net", "", None, "allow"), 8: ("h.com", "", "com", "block"), 9: ("example.com", "/abc", "example.com/ab", "allow"),
    }
    assert urlfilter.url_verdicts(pages.limit(0), rules).count() == 0
    assert urlfilter.url_verdicts(pages, rules.limit(0)).where("verdict = 'allow'").count() == 10


# ---------------------------------------------------------------- byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", "don't 'S it's  x\t\ny  ", "''s 'll'll", " 's", "a" * 5000 + " " * 3000, "日本語 ٣४½ 😀!?\u3000\u200d x\x1c", "\r\n\r\n a", "<|endoftext|>", "'", "x'r", "é'ré 've"]


def test_bpe_equals_the_library(spark):
    v = bytepairs.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    pool = list("ab 's'tre'llvemd  \t\n\r1२²éß日!?._-\u00a0\u2003")
    texts = HARD + ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(2000)]
    out = bytepairs.encode(docs(spark, list(zip(range(len(texts)), texts, ["s"] * len(texts), strict=True))), RANKS)
    for r in bytepairs.decode(out, RANKS).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert len(r.starts) == len(r.ids) and r.starts == sorted(r.starts)


def test_bpe_equals_the_library_on_the_code_points_of_two_planes_and_some_of_the_others():
    v = bytepairs.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    points = [chr(i) for i in [*range(0x20000), *range(0x20000, 0x110000, 97)] if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}b {c} 1{c}{c}\n{c}'s" for c in points]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for (ids, _, _), text in zip(bytepairs.coded_texts(part, RANKS), part, strict=True):
            assert ids.tolist() == library.encode_ordinary(text), text


def test_bpe_null_and_empty_table(spark):
    out = bytepairs.encode(docs(spark, [(1, None, None), (None, "x", None)]), RANKS).collect()
    assert {r.doc_id: len(r.ids) for r in out} == {1: 0, None: 1}
    assert bytepairs.encode(docs(spark, []), RANKS).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_counts_and_host_verdicts(spark):
    good = "the quick brown fox jumps over the lazy dog today again"
    symbols = "a1 # b2 # c3 # d4 # e5 # f6 # g7 # h8 #"
    rows = [(i, good, "good") for i in range(20)] + [(20, symbols, "good")] + [(30 + i, symbols, "bad") for i in range(20)] + [(50, good, "bad"), (60, None, None), (61, "", None), (62, "a b c d e a b c d e", "good"), (63, "x y z w v u\nx y z w v u\n \n q", "good")]
    got = {r.doc_id: r for r in quality.quality_report(docs(spark, rows)).collect()}
    assert got[0].kept and got[20].kept and got[50].kept and not got[30].kept
    assert not got[60].kept and got[60].n_words == 0
    assert (got[62].n_repeat_words, got[62].word_chars, got[62].base_failed) == (10, 10, True)
    assert (got[63].n_dup_lines, got[63].n_repeat_words, got[20].n_symbols) == (1, 12, 8)
    assert quality.quality_report(docs(spark, [])).count() == 0
    kept = quality.keep_good(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert {(r.doc_id, r["_q"]) for r in kept.collect()} == {(k, 4) for k, r in got.items() if r.kept}


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize(
    ("histogram", "sequences"),
    [
        ({100: 1000}, 50),  # twenty in each
        ({600: 3000}, 1000),
        ({1000: 1, 10: 1000}, 6),
        ({1: 1_000_000}, 489),
        ({2048: 5, 3: 1}, 6),
        ({1500: 10, 548: 10}, 10),
        ({900: 4, 500: 2, 300: 4}, 4),
        ({n: 2048 // n for n in range(1, 2049)}, None),
        ({}, 0),
    ],
)
def test_patterns_place_every_length_once_with_little_padding(histogram, sequences):
    found = packing.patterns(histogram, 2048)
    placed = {}
    for pattern, n in found:
        assert n > 0 and 0 < sum(length * times for length, times in pattern) <= 2048
        assert [length for length, _ in pattern] == sorted((length for length, _ in pattern), reverse=True)
        for length, times in pattern:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    total = sum(n for _, n in found)
    assert total == sequences if sequences is not None else total * 2048 < 1.02 * sum(k * n for k, n in histogram.items())


def _one_place_each(out, max_tokens):
    """The places of packed pieces follow each other from 0 in numbered sequences, of which all but one are full."""
    seen = {}
    for sequence_id, offset, length in sorted(out):
        assert offset == seen.get(sequence_id, 0)
        seen[sequence_id] = offset + length
    assert max(seen.values()) <= max_tokens and sorted(seen) == list(range(len(seen)))
    assert sum(max_tokens - n for n in seen.values()) < max_tokens
    return len(seen)


def _places(out):
    return [(r.sequence_id, r.offset, r.length) for r in out]


def test_pieces_hold_the_ids_of_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t, "s") for i, t in enumerate([*HARD, "long text " * 20_000, "a  <|endoftext|><|endoftext|> b<|endoftext", "<|endoftext|>"])] + [(1000 + i, "word " * (7 * i % 90), "s") for i in range(80)] + [(None, "no id", "s"), (2000, None, "s")]
    ids = {doc_id: np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for doc_id, text, _ in rows}
    extra = docs(spark, rows).withColumn("row", F.lit("r")).withColumn("skip", F.lit("s")).withColumn("_part", F.lit(1))
    out = packing.packed_documents(extra, path, 32, 1).collect()
    _one_place_each(_places(out), 32)
    at = Counter()
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in ids.items()}


def test_pieces_of_repeated_rows_and_of_string_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([("a", "word " * 20), ("a", "word " * 20), ("b", None)], "doc_id string, text string")
    out = packing.packed_documents(frame, path, 8, 1).collect()
    _one_place_each(_places(out), 8)
    n = {r.doc_id: r.doc_tokens for r in out}
    assert sum(r.length for r in out if r.doc_id == "a") == 2 * n["a"] and n["b"] == 1
    assert packing.packed_documents(frame.limit(0), path, 8, 1).count() == 0


@pytest.mark.parametrize("lengths", [{1025: 1000}, {700: 999}, {2047: 1500}, {1030: 400, 1200: 600}, {1025: 700, 1000: 5, 2048: 3}, {1: 3}, {700: 10, 1025: 10, 2047: 10}, {2048: 4}])
def test_one_length_and_mixes_leave_less_than_a_sequence_of_padding(spark, lengths):
    rows = spark.createDataFrame([(i, n) for n, times in lengths.items() for i in range(times)], "doc_id long, length long").repartition(5)
    out = packing.pack(rows, 2048).collect()
    total = sum(n * times for n, times in lengths.items())
    assert _one_place_each([(r.sequence_id, r.offset, r.taken) for r in out], 2048) == -(-total // 2048)
    parts = {}
    for r in sorted(out, key=lambda r: r.skip):
        assert r.skip == parts.get((r.doc_id, r.length), 0)
        parts[r.doc_id, r.length] = r.skip + r.taken
    assert len(parts) == sum(lengths.values()) and all(length == n for (_, length), n in parts.items())


def test_equal_pieces_are_packed_together(spark):
    rows = spark.range(5000, numPartitions=7).selectExpr("id as doc_id", "case when id % 5 = 0 then 600L else 7L end as length", "0L as sequence", "'x' as first")
    out = packing.pack(rows, 2048)
    assert out.columns == ["doc_id", "length", "sequence", "first", "sequence_id", "offset", "skip", "taken"]
    assert _one_place_each([(r.sequence_id, r.offset, r.taken) for r in out.collect()], 2048) == 307 and out.select("doc_id").distinct().count() == 5000
    assert packing.pack(rows.limit(0), 2048).count() == 0


# ---------------------------------------------------------------- chat


def test_template_language():
    run = chat.compile_template("{% if 'a' == 'a' %}x{{ 1 + 2 }}{% else %}{{ m.no }}{% endif %}{% for m in messages %}{% if not loop.first and m.role != 'b' %}-{% elif m.role == 'b' %}+{% endif %}{% generation %}{{ m.text | upper }}{% endgeneration %}{% endfor %}")
    assert list(run([{"role": "a", "text": "t"}, {"role": "b", "text": "u"}])) == [("x3", False), ("T", True), ("+", False), ("U", True)]
    assert chat.fold(chat.parse("{% if false %}a{% endif %}b{{ 'c' | upper }}")) == ("block", [("emit", ("const", "bC"))])
    for bad in ("{% for m in range %}{% endfor %}", "{{ x | open }}", "{% if x %}", "{{ ''.__class__() }}", "{% include 'x' %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for unknown in ("{{ x }}", "{% for m in messages %}{{ m.name }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            list(chat.compile_template(unknown)([{"role": "a", "text": "t"}]))


@pytest.mark.parametrize("text", ["", "\\", "<\\/s>", "</s>[INST] ok [/INST]", "<", "[INST", "</s", "a\\\\b[ROLE]", "\n \n"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "[/ROLE]x"])
def test_formatted_text_reads_back(text, role):
    turns = [{"role": role, "text": text}, {"role": "user", "text": text + "<"}, {"role": role, "text": text}]
    pieces = list(chat.compile_template(chat.TEMPLATE)(turns))
    assert list(chat.read_back(pieces)) == [(t["role"], t["text"]) for t in turns]
    assert list(chat.read_back([("".join(p for p, _ in pieces), False)])) == [(t["role"], t["text"]) for t in turns]
    loss = "".join(chat.unescape(p) for p, m in pieces if m)
    assert loss == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, None, None, None, 0), (None, 0, "user", "x", 0), (1, 1, "assistant", "b", 0)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.format_digests(c).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[None].n_turns) == (3, 2, 1, 1)
    pieces = chat.formatted(c).where("conv_id = 1").orderBy("piece").collect()
    assert "".join(p.text for p in pieces) == "<s>[INST] a [/INST][BOT] b</s>[BOT] b</s>"
    assert len("".join(p.text for p in pieces)) == got[1].formatted_chars
    assert chat.format_digests(c.limit(0)).count() == 0


def test_long_conversations_are_dealt_over_tasks(spark):
    long_ = "y" * 40
    rows = [(1, i, ["user", "assistant", "tool", long_][i % 4], f"t{i} </s>\\" + "x" * (i % 90) + "\u00e9") for i in range(600)]
    rows += [(None, None, None, None), (None, None, "user", long_ + "b"), (None, 3, long_ + "a", "z"), (None, 3, long_, "a"), (None, 3, long_[:32], "b")]
    rows += [(k, t, "assistant", f"{k} {t}") for k in range(2, 60) for t in range(k % 4)] + [(70, 1, "user", "same")] * 5
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    at_once = chat.TEMPLATE.replace("{% for m in messages %}", "{% for m in messages %}{% if loop.first %}{% endif %}")
    assert chat._message_wise(at_once) is None and chat._message_wise("{{ '[INST]' }}{% for m in messages %}{% endfor %}") is None
    wanted = sorted(map(str, chat.format_digests(c, at_once).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it puts small partitions together
    try:
        for whole in (1 << 20, 50):
            assert sorted(map(str, chat.format_digests(c, whole=whole).collect())) == wanted
        assert chat._dealt_turns(c).where("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_join_hot_equals_a_join(spark):
    from corpusward.llm.skew import join_hot

    rows = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 11).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k <> 3")
    got = join_hot(rows, facts, ["k"], [F.col("id")], 40).select("k", "id", "n", "least")
    wanted = rows.join(facts, "k").select("k", "id", "n", "least")
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_frequent_windows_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}", "s") for i in range(40)] + [(50, "x " * 90, "s"), (51, "x " * 60, "s")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_repeats(rows, 50)


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, window):
    first = {}
    for i, t, _ in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t, _ in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(60):
        own = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(0, 150))]
        k = int(rng.integers(0, len(own) + 1))
        rows.append((i, "\n ".join(own[:k] + passage[: rng.integers(0, 71)] * (i % 3) + own[k:]), "s"))
    rows += [(70, rows[4][1], "s"), (71, rows[4][1] + " tail", "s"), (72, None, "s"), (73, "", "s"), (74, "x " * 60, "s"), (75, "x " * 49, "s"), (76, "x " * 70, "s")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs(spark, rows)).collect()}
    assert got == brute_repeats(rows, 50)


def test_repeats_edges(spark):
    long_ = " ".join(f"a{i}" for i in range(60))
    rows = [(1, long_, "s"), (1, long_, "s"), (None, long_, "s"), (2, long_ + "  b\n", "s"), (3, " keep  space\n", "s"), (2, "short", "s")]
    out = substrings.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 60), (3, 0)]
    clean = {(r.doc_id, r.text) for r in substrings.without_repeats(docs(spark, rows)).collect()}
    assert (2, "b") in clean and (3, " keep  space\n") in clean and (2, "short") in clean
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- very long texts, links near the threshold


def test_very_long_texts_are_whole(spark):
    rng = np.random.default_rng(9)
    long = [f"w{k}" for k in rng.integers(0, 5000, 120_000)]
    passage = [f"p{i}" for i in range(55)]
    tail = "mit license"
    rows = [(1, " ".join([*long, *passage, tail]), "s"), (2, " ".join([*long, *passage, tail, "more"]), "s"), (3, " ".join(passage), "s"), (4, "a " * 200_000, "s"), (5, "x" * 1_000_000, "s")]
    base = {r.doc_id: r for r in licenses.license_report(docs(spark, rows)).collect()}
    assert (base[1].n_words, base[1].n_base, base[1].first_word, base[1].base_labels) == (120_057, 1, 120_055, "mit") and base[4].n_base == 0
    near = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows), size=3, percent=85).collect()}
    assert [near[i].component_id for i in range(1, 6)] == [1, 1, 3, 4, 5] and near[5].n_shingles == 1 and near[4].n_shingles == 1
    measured = {r.doc_id: r for r in quality.quality_report(docs(spark, rows)).collect()}
    assert measured[1].n_words == 120_057 and measured[5].word_chars == 1_000_000 and measured[4].n_repeat_words == 200_000
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs(spark, rows)).collect()}
    assert removed == {1: 0, 2: 120_057, 3: 55, 4: 0, 5: 0}


@pytest.mark.parametrize(("size", "percent", "changes"), [(3, 85, (0.02, 0.04)), (5, 80, (0.012, 0.03))])
def test_links_near_the_threshold_are_found(spark, size, percent, changes):
    """Pairs whose likeness lies around the threshold: every one at or above it is linked and no other."""
    rng = np.random.default_rng(12)
    rows, linked = [], {}
    for i in range(400):
        n = int(rng.integers(60, 400))
        words = [f"v{k}" for k in rng.integers(0, 100_000, n)]
        twin = list(words)
        for at in rng.choice(n, max(1, int(n * rng.uniform(*changes))), replace=False):
            twin[at] = f"u{i}-{at}"
        a, b = ({tuple(w[j : j + size]) for j in range(n - size + 1)} for w in (words, twin))
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(twin), "s")]
        linked[2 * i + 1] = 2 * i if 100 * len(a & b) >= percent * len(a | b) else 2 * i + 1
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), size=size, percent=percent).collect()}
    assert {i: got[i] for i in linked} == linked and 50 < sum(v % 2 == 0 for v in linked.values()) < 350


def test_urls_without_an_address_and_null_ids(spark):
    pages = spark.createDataFrame([(i, "no address" if i % 2 else None) for i in range(50)] + [(None, "http://a.com/en/x"), (60, "http://" + "a." * 5000 + "com/en/"), (61, "://")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("", "", "allow")], "host string, path string, verdict string")
    out = urlfilter.url_verdicts(pages, rules, default="block").collect()
    assert len(out) == 53 and {(r.rule, r.verdict) for r in out if r.host == ""} == {("", "allow")}
    assert {(r.page_id, r.rule) for r in out if r.host != ""} == {(None, "com/en/"), (60, "com/en/")}
    assert {r.verdict for r in urlfilter.url_verdicts(pages, rules.where("host <> ''"), default="block").collect()} == {"block"}


def test_top_k_without_an_id_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rows = spark.createDataFrame([(i if i else None, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    v = topk.integer_vectors(rows)
    out = topk.top_k(v, v, 2).where("rank = 1").collect()
    assert len(out) == 19 and {r.vec_id for r in out if r.query_id < 19} == {19}


def test_texts_of_two_words_that_every_polynomial_takes_for_one():
    bits = [bin(i).count("1") & 1 for i in range(1024)]  # Thue-Morse
    texts = [" ".join("ab"[x ^ y] for x in bits).encode() for y in (0, 1, 0)]
    found = split(texts)
    d1, d2 = substrings._digests(found.hashes(), found.bounds)
    assert d1[0] == d1[2] != d1[1] and d2[0] == d2[2] != d2[1]
