"""Toxicity by class-conditional Kneser-Ney models.

A model of toxic text and one of ordinary text give each word a probability after its
predecessor: a discounted bigram estimate, interpolated with Kneser-Ney's lower order, which
counts how many words a word follows in the class. That order is spelled letter by letter,
each letter after the word's beginning so far. At the bottom both classes share one
distribution of continuations, by the number of words of either class. Expressions, words
and beginnings in fewer learning texts than MIN_DOCS or MIN_SHARE of them have no counts of
their own: they are smoothed through the shared counts, so a new word is judged by its stem
and a rare one says next to nothing. A text's log-likelihood ratio is normalised by
length, over the whole text and over its most toxic windows of 1 and 4 words, and logistic
regression on those three figures, of texts that the models haven't seen, gives the
probability.

Bounds: learning takes about MAX_ROWS rows of each class, sampled by a hash of the id, or
fewer, so that they have about MAX_BYTES; of near copies among them one counts. Their texts
are learned whole, and all texts are scored whole.

Defined results: a null text is empty; an empty text has the ratio 0; a very long text is
scored by its mean and its most toxic windows like any other, and teaches if it is no longer
than MAX_BYTES; a score of exactly 0.5 counts as toxic; without labelled texts of both
classes every score is 0; repeated rows get equal scores; a doc_id labelled twice counts as
toxic if any label says so; null labels and ids teach nothing; an empty table gives no rows;
extra columns are carried untouched by ``clean`` and stay outside otherwise.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import tokens as K
from tarnfall.llm.common import fold, prepare, tidy, written

MAX_ROWS = 4000
MAX_BYTES = 64 << 20
#: Learning texts that an expression must stand in, and their share of all.
MIN_DOCS, MIN_SHARE = 8, 1 / 400
#: Bytes of a word's beginning that are spelled; what follows is one step.
STEM = 8
DISCOUNT = 0.75
WINDOWS = (1, 4)


def split_words(column: pa.Array) -> Iterator[tuple[K.Words, np.ndarray]]:
    offsets, raw = K.utf8(column)
    for a, b in K.slices(offsets):
        w = K.Words(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], K.NOT_WORD)
        yield w, w.hashes()


_END = np.uint64(0x51ED270B7A4C3F25)


def spelled(w: K.Words, h: np.ndarray) -> np.ndarray:
    """Hashes of each word's beginnings of 1..STEM bytes (0 beyond its end), and of its end."""
    out = np.zeros((len(h), STEM + 1), np.uint64)
    size = w.end - w.start
    for k in range(1, STEM + 1):
        long = np.flatnonzero(size >= k)
        out[long, k - 1] = w.prefix_hashes(k, long)
    out[:, STEM] = K.mix(h ^ _END)
    return out


class Spelling:
    """Probabilities of words in both classes, spelled along their beginnings."""

    def __init__(self, steps: np.ndarray, count: np.ndarray, docs: np.ndarray, least: float):
        """steps: as from spelled, of distinct words; count: words x (toxic, ordinary)
        continuations, the words that they follow; docs: learning texts of each word. A
        beginning in fewer than ``least`` has no counts of its own.

        Level by level: the children of a beginning are its continuations by one byte and
        its end as a word. Only words whose beginning has counts of its own go on."""
        depth = (steps[:, :STEM] > 0).sum(1)
        alive, parent = np.arange(len(steps)), np.zeros(len(steps), np.int64)
        above = np.zeros((1, 2))  # log probabilities of the parents' paths
        nodes, paths, leaves = [np.zeros(0, np.uint64)], [np.zeros((0, 2))], [np.zeros((1, 2))]
        for k in range(1, STEM + 2):
            if not len(alive):
                break
            end = depth[alive] < k
            own = np.where(end, steps[alive, STEM], steps[alive, min(k, STEM) - 1])
            node, first, at = np.unique(own, return_index=True, return_inverse=True)
            n = np.stack([np.bincount(at, count[alive, c], len(node)) for c in (0, 1)], 1)
            types = np.bincount(at).astype(float)
            up, m = parent[first], len(above)
            total = np.stack([np.bincount(up, n[:, c], m) for c in (0, 1)], 1)
            shared = types / np.bincount(up, types, m)[up]
            keep = np.bincount(at, docs[alive], len(node)) >= least
            held = np.where(keep[:, None], np.maximum(n - DISCOUNT, 0), 0) / np.maximum(total[up], 1)
            back = np.maximum(1 - np.stack([np.bincount(up, held[:, c], m) for c in (0, 1)], 1), 1e-9)
            path = above[up] + np.log(held + back[up] * shared[:, None])
            # A path leaves a beginning for one without counts by the beginning's backoff; what
            # follows is shared by both classes.
            leaves[-1][:] = np.log(back)
            nodes.append(node[keep])
            paths.append(path[keep])
            leaves.append(np.zeros((int(keep.sum()), 2)))
            parent = (np.cumsum(keep) - 1)[at]
            go = keep[at] & ~end
            alive, parent, above = alive[go], parent[go], path[keep]
        self.leave_root = leaves[0][0]
        self.node = np.concatenate(nodes)
        order = np.argsort(self.node)
        self.node = self.node[order]
        self.path, self.leave = np.concatenate(paths)[order], np.concatenate(leaves[1:] or [np.zeros((0, 2))])[order]

    def log_probability(self, steps: np.ndarray) -> np.ndarray:
        """words x (toxic, ordinary); up to a term shared by both."""
        out = np.tile(self.leave_root, (len(steps), 1))
        if not len(self.node):
            return out
        for k in range(STEM + 1):
            own = steps[:, k]
            at = np.minimum(np.searchsorted(self.node, own), len(self.node) - 1)
            ok = np.flatnonzero((own > 0) & (self.node[at] == own))
            out[ok] = self.path[at[ok]] + (self.leave[at[ok]] if k < STEM else 0)
        return out


class KneserNey:
    """Log-likelihood ratios, toxic to ordinary, of words after their predecessors."""

    def __init__(self, words: list[np.ndarray], toxic: np.ndarray, spelling: dict[str, np.ndarray]):
        """words: the word hashes of each text; toxic: a boolean of each; spelling: the
        distinct words' hashes (word, sorted) and steps."""
        once = [np.unique(w) for w in words]
        side = np.repeat(toxic, [len(w) for w in once])
        vocabulary, at = np.unique(np.concatenate([*once, np.zeros(0, np.uint64)]), return_inverse=True)
        docs = np.stack([np.bincount(at[side == c], minlength=len(vocabulary)) for c in (True, False)], 1).astype(float)
        del once, at, side
        steps = spelling["steps"][np.searchsorted(spelling["word"], vocabulary)]
        least = self.least = max(MIN_DOCS, MIN_SHARE * len(words))
        # Kneser-Ney's counts of a word in the lower order: how many words it follows.
        follows = np.zeros((len(vocabulary), 2))
        for c, cls in enumerate((True, False)):
            parts = [np.zeros(0, np.int64)]
            for w, t in zip(words, toxic):
                if t == cls and len(w):
                    i = np.searchsorted(vocabulary, w)
                    parts.append(np.concatenate(([len(vocabulary)], i[:-1])) * len(vocabulary) + i)
            follows[:, c] = np.bincount(np.unique(np.concatenate(parts)) % max(len(vocabulary), 1), minlength=len(vocabulary))
        self.spelling = Spelling(steps, follows, docs.sum(1), least)
        often = docs.sum(1) >= least
        self.vocabulary = vocabulary[often]
        p = np.exp(self.spelling.log_probability(steps[often])).T
        n = self.size = len(self.vocabulary)  # n: any rarer word; n + 1: before the first
        # A text counts once for each pair of words in it.
        keys, side = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for w, t in zip(words, toxic):
            if len(w):
                i = self.ids(w)
                keys.append(np.unique(self.before(i, np.zeros(1, np.int64)) * (n + 2) + i))
                side.append(np.full(len(keys[-1]), t))
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        side = np.concatenate(side)
        count = np.stack([np.bincount(at[side == c], minlength=len(pairs)) for c in (True, False)]).astype(float)
        u, w = pairs // (n + 2), pairs % (n + 2)
        kept = (count.sum(0) >= least) & (w < n)
        after, own = [], []
        for c, p_c in zip(count, p):
            contexts = np.bincount(u, c, n + 2)
            held = np.where(kept, np.maximum(c - DISCOUNT, 0), 0) / np.maximum(contexts[u], 1)
            back = np.maximum(1 - np.bincount(u, held, n + 2), 1e-9)
            after.append(np.log(back))
            own.append(np.log(held[kept] + back[u[kept]] * p_c[w[kept]]))
        self.context = after[0] - after[1]
        self.pairs, self.own = pairs[kept], own[0] - own[1]

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), self.size - 1)
        return np.where(self.vocabulary[at] == h, at, self.size)

    def before(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(ids)
        out[1:] = ids[:-1]
        out[first] = self.size + 1
        return out

    def features(self, h: np.ndarray, first: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x (mean, best windows) of the ratio. first: as in Words; steps[at]: each
        word's spelling."""
        n = len(first) - 1
        out = np.zeros((n, 1 + len(WINDOWS)))
        size = np.diff(first)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        ids = self.ids(h)
        u = self.before(ids, first[full])
        p = self.spelling.log_probability(steps)
        ratio = self.context[u] + (p[:, 0] - p[:, 1])[at]
        if len(self.pairs):
            key = u * (self.size + 2) + ids
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ratio = np.where(self.pairs[place] == key, self.own[place], ratio)
        start = first[full]
        out[full, 0] = np.add.reduceat(ratio, start) / size[full]
        sums = np.concatenate(([0.0], np.cumsum(ratio)))
        where = np.arange(len(ratio))
        begin = np.repeat(start, size[full])
        for k, width in enumerate(WINDOWS, 1):
            # The mean of the last ``width`` words, or of as many as there are.
            low = np.maximum(where + 1 - width, begin)
            out[full, k] = np.maximum.reduceat((sums[where + 1] - sums[low]) / (where + 1 - low), start)
        return out


def distinct_steps(w: K.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words' hashes, their steps, each word's place among them)."""
    word, first, at = np.unique(h, return_index=True, return_inverse=True)
    return word, spelled(w.taken(first), word), at


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, kn: KneserNey | None, weights: np.ndarray):
        self.kn, self.weights = kn, weights

    def score(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for w, h in split_words(column):
            x = np.zeros((w.n, 0))
            if self.kn:
                _, steps, at = distinct_steps(w, h)
                x = self.kn.features(h, w.first, steps, at)
            z = x @ self.weights[:-1] + self.weights[-1]
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts)


#: Minima of word-triple hashes by which near copies among the learning texts are found.
SKETCH, SAME = 12, 5


def singles(words: list[np.ndarray]) -> np.ndarray:
    """Of texts that share SAME of SKETCH minima with an earlier one, only that counts."""
    seen: dict[tuple[int, int], list[int]] = {}
    out = np.ones(len(words), bool)
    salts = K.mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
    for k, w in enumerate(words):
        grams = K.gram_hashes(w, min(3, len(w))) if len(w) else w
        minima = [(j, int((grams * s >> np.uint64(1)).min())) for j, s in enumerate(salts)] if len(grams) else []
        hits: dict[int, int] = {}
        for m in minima:
            for other in seen.get(m, ()):
                hits[other] = hits.get(other, 0) + 1
        if max(hits.values(), default=0) >= SAME:
            out[k] = False
        else:
            for m in minima:
                seen.setdefault(m, []).append(k)
    return out


def fit(texts: pa.Array, toxic: np.ndarray, population: tuple[int, int]) -> Model:
    """Distinct texts. population: toxic and ordinary labels in all, for the scores' base rate."""
    if not toxic.any() or toxic.all() or len(texts) < 4:
        return Model(None, np.array([-30.0]))  # nothing can be told
    words, seen = [], []
    for w, h in split_words(texts):
        words += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        seen.append(distinct_steps(w, h)[:2])
    word, at = np.unique(np.concatenate([x for x, _ in seen]), return_index=True)
    spelling = {"word": word, "steps": np.concatenate([y for _, y in seen])[at]}
    del seen
    single = np.flatnonzero(singles(words))
    words, toxic = [words[k] for k in single], toxic[single]
    if not toxic.any() or toxic.all() or len(words) < 4:
        return Model(None, np.array([-30.0]))
    half = np.array([zlib.crc32(w.tobytes()) % 2 == 0 for w in words])
    x = np.zeros((len(words), 1 + len(WINDOWS)))
    for side in (half, ~half):
        kn = KneserNey([words[k] for k in np.flatnonzero(side)], toxic[side], spelling)
        for k in np.flatnonzero(~side):
            mine, place = np.unique(words[k], return_inverse=True)
            steps = spelling["steps"][np.searchsorted(word, mine)]
            x[k] = kn.features(words[k], np.array([0, len(words[k])]), steps, place)[0]
    population = population if min(population) else (int(toxic.sum()), int((~toxic).sum()))
    weight = np.where(toxic, population[0] / toxic.sum(), population[1] / (~toxic).sum())
    weight *= len(words) / weight.sum()
    return Model(KneserNey(words, toxic, spelling), logistic(x, toxic.astype(float), weight))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: doc_id and toxic (0 or 1). The sample is drawn from the labels, so it is
    small enough to be broadcast, and no text is shuffled."""
    prepare(docs.sparkSession)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    labels = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    population = counts.get(1, 0), counts.get(0, 0)
    share = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("toxic") == 1, MAX_ROWS / max(population[0], 1)).otherwise(MAX_ROWS / max(population[1], 1))
    sample = F.broadcast(labels.where(share < limit))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id")
    size = F.octet_length("text")
    rows = written(rows.where(size <= MAX_BYTES).select("text", "toxic", F.xxhash64("id", F.lit(7)).alias("h")), "toxic-sample")
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total > MAX_BYTES:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) * (total / (1 << 30)) < MAX_BYTES)
    rows = rows.select("text", "toxic")

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            table = pa.Table.from_batches(parts).group_by("text").aggregate([("toxic", "max")]).sort_by("text")
            model = fit(table["text"].combine_chunks(), table["toxic_max"].to_numpy() == 1, population)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task learns from it; the driver gets the finished model.
    found = rows.repartition(1).mapInArrow(tidy(train), "model binary").first()
    return pickle.loads(found.model) if found else Model(None, np.array([-30.0]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"{id_col} {kind}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below the limit, with all their columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) < limit))

    return docs.mapInArrow(tidy(run), docs.schema)


def train_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled documents whose fold isn't 0."""
    return learn(docs, labels.where(fold("doc_id", 5) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
