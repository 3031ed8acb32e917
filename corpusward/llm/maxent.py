"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context).  The most frequent
words are outputs of their own, in classes by frequency; all others fall into classes
by their last two bytes, where a word has its smoothed share of the class.  Features
of a context are the three words before (n-gram and skip features) and the hashed pair
of the last two; rare words appear in them as their class.

Counts of all training texts give the first weights; then gradient updates follow.  In
each, every task sums the gradient over its documents of one batch, tables are added
up by blocks through a shuffle, and the driver applies one step to the model, whose
size is fixed by the parameters below.  Every training document is in one batch.

Besides the features there is a memory that grows with the corpus.  Texts are cut into
passages by their content: one begins at the fourth word, where the hash of the three words
before is divisible by MEMORY, and after LONGEST words.  So every word from the fourth on
is in one passage, and the memory counts the passages of all training texts by the
three words before them.  It is keyed by these and counted where a shuffle brings them
together.  A passage (of symbols) has the probability
(its count + k * the model's) / (count of the context + k), k = PRIOR * distinct passages
after the context.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.lineage import cut
from corpusward.llm import words as W

#: Output words in classes of 64, and classes of the other words.
OUTPUTS, WIDE, RARE = 1024, 64, 32
FREQUENT = OUTPUTS // WIDE
CLASSES = FREQUENT + RARE
#: Context symbols: output words, rare classes, the place before a text.
CONTEXT = OUTPUTS + RARE + 1
#: Buckets of the hashed pair feature.
PAIRS = 1 << 13
#: Rows of the class table: three positions and the pairs.
ROWS = 3 * CONTEXT + PAIRS
#: Words whose counts are sent to every task (16 bytes each); counts of others are joined.
SENT = 1 << 20
#: A passage begins after three words whose hash is divisible by this, and after so many words at most.
MEMORY, LONGEST = 16, 32
#: How many counts the model's own probability is worth, for each distinct passage after a context.
PRIOR = 2.0
#: The smallest probability of a passage that a count is divided by.
LEAST = 1e-300
#: Gradient updates; each takes its share of the training documents.
UPDATES = 2
#: Tokens that a task scores at once.
TILE = 32_768
END = W.mix(np.array([0x656E64], W.U))[0]


# ---------------------------------------------------------------- words
def _tokens(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rare classes of the words of each text, each followed by the end; and bounds."""
    found = W.split([W.lower(b) for b in block])
    data = np.frombuffer(found.data, np.uint8)
    last = data[found.ends - 1].astype(W.U)
    before = np.where(found.ends - found.starts > 1, data[found.ends - 2], 0).astype(W.U)
    rare = (W.mix(last << W.U(8) | before) % W.U(RARE)).astype(np.int64)
    at = found.bounds[1:]
    return np.insert(found.hashes(), at, END), np.insert(rare, at, 0), found.bounds + np.arange(len(found.bounds))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(h, r, c): every distinct token of ``docs``, its rare class and its count."""

    def task(batches):
        for batch in batches:
            parts = [(*np.unique(h, return_index=True, return_counts=True), r) for h, r, _ in (_tokens(b) for _, b in W.blocks(batch.column(0).to_pylist()))]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(np.concatenate([p[3][p[1]] for p in parts])), pa.array(np.concatenate([p[2] for p in parts]))], ["h", "r", "c"])

    return docs.select("text").mapInArrow(task, "h long, r long, c long").groupBy("h", "r").agg(F.sum("c").alias("c"))


class Lookup:
    """Numbers of known hashes: a direct table, and a binary search for what it cannot tell."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.shift = W.U(64 - max(8, int(4 * len(keys)).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is not known."""
        at = self.table[(h >> self.shift).astype(np.int64)]
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        other = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        place = np.minimum(np.searchsorted(self.keys, h[other]), len(self.keys) - 1)
        at[other] = np.where(self.keys[place] == h[other], place, -1)
        return np.where(at >= 0, self.order[at], -1)


class Statistics:
    """Sizes of the corpus and the counts of its most frequent words."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.tokens, self.types = int(total[0]), int(total[1])
        # The smallest count that at most SENT words reach, from the histogram of counts by size.
        size = F.floor(F.log2(F.col("c").cast("double")) * 8)
        n, self.least = 0, 1 << 62
        for r in sorted(counts.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["k"]):
            n += r["n"]
            if n > SENT:
                break
            self.least = int(r["c"])
        # The output words, whatever their counts, and SENT rows at most, as columns.
        top = counts.orderBy(F.desc("c"), "h").limit(OUTPUTS).select("h", "r", "c").toArrow()
        sent = pa.concat_tables([top, counts.where(F.col("c") >= self.least).select("h", "r", "c").toArrow()])
        h, r, c = (sent.column(i).to_numpy() for i in range(3))
        _, first = np.unique(h, return_index=True)
        h, r, c = h[first], r[first], c[first]
        order = np.lexsort((h, -c))
        rows = {"h": h[order], "r": r[order], "c": c[order]}
        self.hashes, self.counts = rows["h"].view(np.uint64), rows["c"]
        n_out = min(OUTPUTS, len(order))
        self.output_counts = np.zeros(OUTPUTS, np.int64)
        self.output_counts[:n_out] = self.counts[:n_out]
        self.rare_tokens, self.rare_types = np.zeros(RARE), np.zeros(RARE)
        for r in counts.groupBy("r").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            self.rare_tokens[r["r"]], self.rare_types[r["r"]] = r["c"], r["n"]
        own = rows["r"][:n_out]
        self.rare_tokens -= np.bincount(own, self.counts[:n_out], RARE)
        self.rare_types -= np.bincount(own, minlength=RARE)

    def base(self, c):
        """log10 of the add-half unigram probability of a word seen ``c`` times."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def within_rare(self, c, r):
        """log10 of a word's share of its rare class; all unseen words of a class are one type."""
        return np.log10((c + 0.5) / (self.rare_tokens[r] + 0.5 * (self.rare_types[r] + 1)))


def _begins(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where passages begin: at ``own`` places, and every LONGEST tokens after one while its text (``bounds``) goes on."""
    at = np.flatnonzero(own)
    text = np.searchsorted(bounds, at, "right")
    n = -(-(np.minimum(np.r_[at[1:], len(own)], bounds[text]) - at) // LONGEST)
    return np.repeat(at, n) + LONGEST * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _encode(docs: DataFrame, stats: Statistics) -> DataFrame:
    """Each text as symbols (outputs, then rare classes), with sums over words whose counts were sent.

    ``tail`` holds the other words: hash, rare class and how often the text has them;
    ``places`` where its passages begin, and ``contexts`` the three words before each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((stats.hashes, stats.counts))

    def task(batches):
        hashes, counts = shared.value
        look = Lookup(hashes)
        for batch in batches:
            for first, block in W.blocks(batch.column(2).to_pylist()):
                h, r, bounds = _tokens(block)
                at = look(h)
                known = at >= 0
                c = np.where(known, counts[at] if len(counts) else 0, 0)
                symbols = np.where((at >= 0) & (at < OUTPUTS), at, OUTPUTS + r).astype("<u2")
                rare = known & (at >= OUTPUTS)
                base, share = np.where(known, stats.base(c), 0), np.where(rare, stats.within_rare(c, r), 0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, share, known.astype(np.int64))]
                tails = []
                for i in range(len(block)):
                    a, b = bounds[i], bounds[i + 1]
                    unknown = np.flatnonzero(~known[a:b]) + a
                    x, k, m = np.unique(h[unknown], return_index=True, return_counts=True)
                    tails.append((x.view(np.int64), r[unknown][k], m))
                sizes = np.cumsum([0, *(len(t[0]) for t in tails)]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(np.concatenate([t[k] for t in tails]), pa.int64()) for k in range(3)], ["h", "r", "m"]))
                context = np.zeros(len(h), W.U)
                context[3:] = W.mix(W.mix(W.mix(h[:-3]) + h[1:-2]) + h[2:-1])
                place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
                chosen = _begins((context % W.U(MEMORY) == 0) & (place > 3) | (place == 3), bounds)
                edges = pa.array(np.searchsorted(chosen, bounds).astype(np.int32))
                memory = [pa.ListArray.from_arrays(edges, pa.array(context[chosen].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(place[chosen].astype(np.int32)))]
                own = [batch.column(i).slice(first, len(block)) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(bounds)), *map(pa.array, sums), pa.array([symbols[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(block))], pa.binary()), tail, *memory],
                    ["doc_id", "batch", "n_tokens", "base", "share", "known", "symbols", "tail", "contexts", "places"],
                )

    return docs.select("doc_id", "batch", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, batch int, n_tokens long, base double, share double, known long, symbols binary, tail array<struct<h:long,r:long,m:long>>, contexts array<long>, places array<int>")


# ---------------------------------------------------------------- model
class Model:
    """Weights of the class table (features by classes) and the word table (last symbol by outputs)."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, stats: Statistics):
        classes = np.concatenate([stats.output_counts.reshape(FREQUENT, WIDE).sum(1), stats.rare_tokens])
        p = (classes + 0.5) / (classes.sum() + 0.5 * CLASSES)
        self.bias = np.log(p).astype(np.float32)
        q = stats.output_counts.reshape(FREQUENT, WIDE)
        q = np.where(q > 0, q, 1e-9 * (q.sum(1, keepdims=True) + 1))
        q = q / q.sum(1, keepdims=True)
        self.word_bias = np.log(q).astype(np.float32)
        # Log ratios of smoothed conditional shares; damped, since the features overlap.
        k = 20.0
        n = rows.sum(1, keepdims=True)
        self.rows = (0.4 * np.log((rows + k * p) / ((n + k) * p))).astype(np.float32)
        w = words.reshape(CONTEXT, FREQUENT, WIDE)
        n = w.sum(2, keepdims=True)
        self.words = np.log((w + k * q) / ((n + k) * q)).astype(np.float32)

    def step(self, seen: list[np.ndarray], expected: list[np.ndarray], rate: float) -> None:
        """One update: the gradient (seen less expected counts) scaled by the expected counts."""
        for weights, n, e, share in ((self.rows, seen[0], expected[0], rate), (self.words.reshape(CONTEXT, OUTPUTS), seen[1], expected[1], 2 * rate)):
            weights += np.clip(share * (n - e) / (e + 10.0), -0.5, 0.5).astype(np.float32)


def _features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For tiles of tokens: symbols, the four rows of each token's features, and the text of each."""
    sizes = np.array([len(t) // 2 for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    padded = np.full(sizes.sum() + 3 * len(texts), OUTPUTS + RARE, np.int64)
    at = np.arange(len(text)) + 3 * (text + 1)
    padded[at] = np.frombuffer(b"".join(texts), "<u2")
    for i in range(0, len(at), TILE):
        own = at[i : i + TILE]
        one, two, three = padded[own - 1], padded[own - 2], padded[own - 3]
        pair = (W.mix((one << 16 | two).astype(W.U)) % W.U(PAIRS)).astype(np.int64) + 3 * CONTEXT
        yield padded[own], np.stack([one, two + CONTEXT, three + 2 * CONTEXT, pair]), text[i : i + TILE]


def _classes(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < OUTPUTS, symbols // WIDE, symbols - OUTPUTS + FREQUENT)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _forward(model: Model, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities; the tokens that are outputs, their classes, and word probabilities in them."""
    z = model.rows[rows[0]]
    for k in (1, 2, 3):
        z += model.rows[rows[k]]
    z += model.bias
    out = np.flatnonzero(symbols < OUTPUTS)
    c = symbols[out] // WIDE
    return _softmax(z), out, c, _softmax(model.words[rows[0][out], c] + model.word_bias[c])


def _add_by(total: np.ndarray, key: np.ndarray, values: np.ndarray) -> None:
    """total[key] += values, for repeated keys too."""
    order = np.argsort(key.astype(np.uint16 if len(total) <= 1 << 16 else np.int64), kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total[key[edge]] += np.add.reduceat(values[order], edge)


def _tables(encoded: DataFrame, model: Model | None) -> list[list[np.ndarray]]:
    """Seen counts, and those the model expects, of both tables over all tokens of ``encoded``.

    Tasks send one table each, cut into blocks; blocks are added up where they meet.
    Returns [seen, expected], each [class table, word table]; without a model only seen.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cells = ROWS * CLASSES + CONTEXT * OUTPUTS
    step = 1 << 14
    kinds = 1 if model is None else 2
    # Many tasks' tables are first added up in lanes, so that no task reads a block of all of them.
    lanes = encoded.rdd.getNumPartitions() // 32

    def task(batches):
        m = shared.value
        seen = [np.zeros(ROWS * CLASSES), np.zeros(CONTEXT * OUTPUTS)]
        expected = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((CONTEXT * FREQUENT, WIDE), np.float32)]
        some, codes = False, ([], [])

        def count():  # many tiles at once: a pass over a whole table costs as much as a tile
            for k in range(2):
                if codes[k]:
                    seen[k] += np.bincount(np.concatenate(codes[k]), minlength=len(seen[k]))
                    codes[k].clear()

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 1000):
                for symbols, rows, _ in _features(texts[i : i + 1000]):
                    some = True
                    out = symbols < OUTPUTS
                    codes[0].append((rows * CLASSES + _classes(symbols)).ravel())
                    codes[1].append(rows[0][out] * OUTPUTS + symbols[out])
                    if len(codes[0]) >= 32:
                        count()
                    if m is not None:
                        p, at, own, q = _forward(m, symbols, rows)
                        for k in range(4):
                            _add_by(expected[0], rows[k], p)
                        if len(at):
                            _add_by(expected[1], rows[0][at] * FREQUENT + own, q)
        count()
        if some:
            for kind, (a, b) in enumerate((seen, expected)[:kinds]):
                flat = np.concatenate([a.ravel(), b.ravel()]).astype("<f4")
                lane = TaskContext.get().partitionId() % max(1, lanes) << 32
                yield pa.RecordBatch.from_arrays([pa.array([lane | kind << 20 | i for i in range(-(-cells // step))]), pa.array([flat[i : i + step].tobytes() for i in range(0, cells, step)], pa.binary())], ["block", "part"])

    def add(batches, keep):
        total: dict[int, np.ndarray] = {}  # blocks of one table of a fixed size
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(part, "<f4").astype(np.float64)
                block &= keep
                total[block] = total[block] + x if block in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], ["block", "part"])

    parts = encoded.select("symbols").mapInArrow(task, "block long, part binary")
    if lanes > 1:
        parts = parts.repartition("block").mapInArrow(partial(add, keep=-1), "block long, part binary")
    own = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    parts = parts.repartition(own).mapInArrow(partial(add, keep=(1 << 32) - 1), "block long, part binary").collect()
    flat = np.zeros((kinds, cells))
    for r in parts:
        kind, i = divmod(r["block"], 1 << 20)
        x = np.frombuffer(r["part"], "<f4")
        flat[kind, i * step : i * step + len(x)] = x
    return [[f[: ROWS * CLASSES].reshape(ROWS, CLASSES), f[ROWS * CLASSES :].reshape(CONTEXT, OUTPUTS)] for f in flat]


def train(encoded: DataFrame, stats: Statistics, updates: int = UPDATES, rate: float = 0.3) -> Model:
    """The model after ``updates`` steps; ``encoded`` has symbols and batch (from 0, one for each step)."""
    model = Model(*_tables(encoded, None)[0], stats)
    for k in range(updates):
        seen, expected = _tables(encoded.where(F.col("batch") == k), model)
        model.step(seen, expected, rate)
    return model


_MEMORY = "array<struct<context:long,passage:long,m:int,p:double>>"


def _scored(encoded: DataFrame, model: Model) -> DataFrame:
    """``encoded`` with ``lm``, the log10 of classes and output words, and ``memory`` in place of its texts.

    memory has each passage of the text: the context before it, the hash of its symbols, how
    often the text has both, and the model's probability of the symbols there.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rest = encoded.drop("symbols", "tail", "contexts", "places").schema
    names = list(rest.names)

    def task(batches):
        m = shared.value
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            texts, contexts, places = column("symbols").to_pylist(), column("contexts"), column("places")
            total, memory, sizes = np.zeros(len(texts)), [], []
            for i in range(0, len(texts), 1000):
                some = texts[i : i + 1000]
                each, word = [], []
                for symbols, rows, text in _features(some):
                    p, at, _, q = _forward(m, symbols, rows)
                    lm = np.log(p[np.arange(len(symbols)), _classes(symbols)])
                    lm[at] += np.log(q[np.arange(len(at)), symbols[at] % WIDE])
                    total[i : i + 1000] += np.bincount(text, lm, len(some))
                    each.append(lm)
                    word.append(symbols)
                each, word = np.concatenate(each or [np.empty(0)]), np.concatenate(word or [np.empty(0, np.int64)])
                part_c, part_p = contexts.slice(i, len(some)), places.slice(i, len(some))
                n = np.diff(part_c.offsets.to_numpy())
                text = np.repeat(np.arange(len(some)), n)
                bounds = np.cumsum([0, *(len(t) // 2 for t in some)])
                at = part_p.flatten().to_numpy() + bounds[text]
                ends = np.minimum(np.r_[at[1:], len(word)][: len(at)], bounds[text + 1])
                context = part_c.flatten().to_numpy()
                passage = (W.mix(W.rolling(W.mix(word.astype(W.U)), at, ends) + (ends - at).astype(W.U)) >> W.U(1)).view(np.int64)
                upto = np.r_[0, np.cumsum(each, dtype=np.float64)]
                order = np.lexsort((passage, context, text))
                new = np.r_[True, (np.diff(text[order]) != 0) | (np.diff(context[order]) != 0) | (np.diff(passage[order]) != 0)][: len(order)]
                run = np.cumsum(new) - 1
                times = np.empty(len(order), np.int32)
                times[order] = np.bincount(run, minlength=1)[run] if len(run) else 0
                sizes.append(n)
                memory.append((context, passage, times, np.exp(upto[ends] - upto[at])))
            edges = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            fields = [pa.array(np.concatenate([x[k] for x in memory]) if memory else [], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64()))]
            listed = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, ["context", "passage", "m", "p"]))
            yield pa.RecordBatch.from_arrays([*(column(c) for c in names), pa.array(total / np.log(10)), listed], [*names, "lm", "memory"])

    return encoded.drop("tail").mapInArrow(task, rest.add("lm", "double").add("memory", T.DataType.fromDDL(_MEMORY)))


def _remembered(scored: DataFrame) -> DataFrame:
    """For each row: passages, those of them that other training texts have after the same words too, and what the memory adds to the score.

    A context's passages meet once, by a shuffle; what they are counted in spills.  A
    passage below 0 is none that is counted.
    """
    places = scored.select("row", "batch", F.inline("memory")).repartition("context")
    counted = (F.col("batch") >= 0) & (F.col("passage") >= 0)
    places = places.withColumn("n", F.count_if(counted).over(Window.partitionBy("context", "passage")))
    after = Window.partitionBy("context")
    places = places.withColumn("all", F.count_if(counted).over(after)).withColumn("distinct", F.round(F.sum(F.when(counted, 1 / F.col("n")).otherwise(F.lit(0.0))).over(after)))
    k = PRIOR * F.col("distinct")
    factor = F.when(F.col("all") > 0, F.when(F.col("passage") >= 0, F.col("n") / F.greatest("p", F.lit(LEAST)) + k).otherwise(k) / (F.col("all") + k)).otherwise(1.0)
    again = F.col("n") - F.when(counted, F.col("m")).otherwise(0) > 0
    met = places.select("row", (again & (F.col("passage") >= 0)).alias("again"), factor.alias("factor"))
    return met.groupBy("row").agg(F.count(F.lit(1)).alias("n_contexts"), F.count_if("again").alias("n_again"), F.sum(F.log10("factor")).alias("memory_score"))


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", updates: int = UPDATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_contexts, n_again.

    The model and the unigram base learn from rows where ``held_out`` is not true; all
    rows are scored whole, very long texts too.  Words are runs outside ASCII white space,
    A-Z lower-cased; each text has one more token, its end.  Null texts are empty, repeated
    rows count and are scored each, null ids are training rows, extra columns are ignored;
    of words with equal counts those with smaller hashes become outputs first.  Without
    training rows every word is unknown.  Scores are log10 probabilities.  n_contexts is
    how many passages the text is cut into, n_again how many of them training texts hold
    elsewhere after the same three words.
    """
    batch = F.when(F.coalesce(held_out, F.lit(False)), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(max(1, updates))).cast("int"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), batch.alias("batch"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = cut(_word_counts(rows.where("batch >= 0")))
    stats = Statistics(counts)
    # Rows are numbered where they are stored, so the numbers stay.
    encoded = cut(_encode(rows, stats).withColumn("row", F.monotonically_increasing_id()))
    model = train(encoded.where("batch >= 0"), stats, updates)
    tail = encoded.select("row", F.inline("tail"))
    outputs = docs.sparkSession.createDataFrame([(int(x),) for x in stats.hashes[:OUTPUTS].view(np.int64)], "h long")
    # OUTPUTS rows.
    others = counts.where(F.col("c") < stats.least).join(F.broadcast(outputs), "h", "left_anti").select("h", "c")
    seen = tail.join(others, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    size = F.lit(float(stats.tokens + 0.5 * (stats.types + 1)))
    room = F.array(*(F.lit(float(a + 0.5 * (b + 1))) for a, b in zip(stats.rare_tokens, stats.rare_types, strict=True)))
    sums = seen.groupBy("row").agg(F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / size)).alias("_base"), F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.get(room, F.col("r").cast("int")))).alias("_share"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("_known"))
    scored = cut(_scored(encoded, model))
    out = scored.drop("memory").join(sums, "row", "left").join(_remembered(scored), "row", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        (F.col("batch") < 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + part("_known")).alias("n_known"),
        F.lit(stats.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + part("_base")).alias("base_score"),
        (F.col("lm") + F.col("share") + part("_share") + part("memory_score")).alias("score"),
        part("n_contexts").cast("long").alias("n_contexts"),
        part("n_again").cast("long").alias("n_again"),
    )
