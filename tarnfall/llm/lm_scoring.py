"""Language-model scores by deleted interpolation of trigrams.

The model mixes maximum-likelihood estimates of a word after two words, after one and
alone, and a uniform one over the vocabulary and one unknown word:

    P(w | t u) = l3[b] c(t, u, w) / c(t, u) + l2[b] c(u, w) / c(u) + l1[b] c(w) / N + l0[b] / (V + 1)

b is the pair of the contexts' frequency buckets, floor(log2(c + 1)) of c(t, u) and of c(u).
The weights are learned by expectation-maximisation on held-out counts: each of the
four training folds in turn is deleted from all counts and predicted from the others. All
words are contexts, as is the start of a text. Nothing is cut off: the counts of the
FREQUENT most frequent words have a fixed bound and are broadcast, those of the others,
and of n-grams that don't meet in one task, are joined by shuffle.

Plan, for bounded memory at any size:
1. Words of the training folds are counted (pre-aggregated in each task).
2. Each task packs its texts' tokens, in chunks of at most CHUNK_TOKENS, into arrays by
   key: a hash of the middle word u, of (t, u) if u is frequent, or of (t, u, chunk) if the pair
   is, so neither a word nor a pair nor a passage that many texts share ever meets in one task.
   A key holds about KEY_TOKENS tokens of the corpus. What stands together in a key is counted
   there: all but c(w), c(u, w) of frequent u and c(t, u, w) of frequent pairs.
3. Those are joined for each key that has them, the first from the word counts, the others
   from counts of such n-grams alone, and return packed by key.
4. For each key, its trigrams give a histogram of deleted probabilities (a number of cells
   that the corpus doesn't move), on which EM runs in one task on an executor ...
5. ... and then, from the same arrays, the sums of log probabilities of each text.
6. Those return by chunk and are added up for each text.

Defined results: a null text is empty and has one token, its end; a very long text spans
chunks and keys like any other tokens, and its sums are added up; rows that repeat id and
text are counted as often as they occur and scored alike; rows that share an id with other
texts, or have none, are scored by themselves (a null id's fold is that of the empty
text); without training texts every score is 0; an empty table gives no rows; extra
columns stay outside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import tokens as K
from tarnfall.llm.common import fold, prepare, release_memory, tidy, written

FOLDS, HELD_OUT = 5, 1
TRAIN = (0, 2, 3, 4)
#: Words whose counts are broadcast, at most.
FREQUENT = 65_000
#: Context ids of the start of a text and of all rarer words; those have their hash beside it.
START, RARE = 65_534, 65_535
#: The end of a text, a token like a word.
END = np.uint64(1)
CHUNK_TOKENS = 2_000_000
CHUNK_ROWS = 60_000
KEY_TOKENS = 2_000_000
#: Chunks and keys grow with the square root of the corpus where a chunk would have fewer
#: tokens of a key than this, so the pieces of all chunks stay in proportion to the corpus.
MIN_PIECE = 25
#: A word, or a pair, with more than this share of a key's tokens is dealt over keys.
SPREAD = 0.4
#: Words of an owner, about, whose counts are asked for in one group.
OWNER_WORDS = 250_000
#: Keys are fewer than 2^KEY_BITS.
KEY_BITS = 20
#: Bits of a trigram's three codes that are sorted as one number.
CODE_BITS = 63
#: Trigrams whose probabilities are worked out at once.
AT_ONCE = 500_000
#: Frequency buckets of a context.
BUCKETS = 32
#: Cells of the EM histogram: octaves of p / uniform.
LEVELS, OFFSET = 64, 24
ROUNDS = 100
_M = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the start of a text.
START_HASH = np.uint64(2)
#: Of the hash of a rare word before u, 40 bits tell the contexts (t, u) of one u apart.
EARLY = np.uint64(0xFFFFFFFFFF000000)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(u + _M) * np.uint64(3) ^ w)


def triple_hash(t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(pair_hash(t, u) * np.uint64(5) ^ pair_hash(u, w))


def before(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens two places and one before each; starts of texts stand for missing ones."""
    u, t = np.empty_like(h), np.empty_like(h)
    u[1:] = h[:-1]
    u[first] = START_HASH
    t[1:] = u[:-1]
    t[first] = START_HASH
    return t, u


def token_arrays(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, text, whether it is a text's first) with an end token after each text."""
    w = K.Words(offsets, raw)
    h = np.insert(w.hashes(), w.first[1:], END)
    size = w.counts() + 1
    row = np.repeat(np.arange(w.n), size)
    first = np.zeros(len(h), bool)
    first[np.cumsum(size) - size] = True
    return h, row, first


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    offsets, raw = K.utf8(batch.column(1))
    for a, b in K.slices(offsets):
        yield (a, b, *token_arrays(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]))


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(h, return_inverse=True)
    return distinct, np.stack([np.bincount(at, c, len(distinct)) for c in n.T], 1).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """h and its counts n0..n3 in the training folds. rows: uid, text, part, times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            arrays = [pa.array(h.view(np.int64)), *[pa.array(c) for c in n.T]]
            return pa.RecordBatch.from_arrays(arrays, ["h", "n0", "n1", "n2", "n3"])

        for batch in batches:
            part, times = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b, h, row, _ in texts(batch):
                n = np.zeros((len(h), len(TRAIN)), np.int64)
                for k, j in enumerate(TRAIN):
                    n[:, k] = np.where(part[a:b] == j, times[a:b], 0)[row]
                held.append(summed(h, n))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    counted = rows.where(F.col("part") != HELD_OUT).mapInArrow(tidy(run), "h bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    return counted.groupBy("h").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(TRAIN))])


@dataclass
class Vocabulary:
    """Counts that are broadcast: at most FREQUENT words, with one column a training fold,
    and the pairs that are dealt over keys, at most 1 / SPREAD of the keys' number."""

    frequent: np.ndarray  # sorted hashes; the end is among them
    counts: np.ndarray
    start: np.ndarray  # texts of each fold
    total: np.ndarray  # tokens of each fold
    size: int  # V
    keys: int
    key: int  # tokens of a key
    chunk: int  # tokens
    hot: np.ndarray  # hashes of the middle words that are dealt by (t, u), sorted
    pairs: np.ndarray  # hashes of the (t, u) that are dealt by chunk, sorted
    pair_counts: np.ndarray

    @property
    def uniform(self) -> float:
        return 1.0 / (self.size + 1)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Places among the frequent words, START, or RARE for others."""
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        out = np.where(self.frequent[at] == h, at, RARE)
        out[h == START_HASH] = START
        return out

    def is_hot(self, u: np.ndarray) -> np.ndarray:
        return member(self.hot, u)[1]


def member(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


COUNTED = "h bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint"


def gram_counts(rows: DataFrame, grams, spark_value) -> DataFrame:
    """h and n0..n3 of the n-grams that grams(model, h, t, u) names as (place, hash)."""
    shared = rows.sparkSession.sparkContext.broadcast(spark_value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(c) for c in n.T]], ["h", "n0", "n1", "n2", "n3"])

        for batch in batches:
            part, times = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b, h, row, first in texts(batch):
                at, name = grams(shared.value, h, *before(h, first))
                n = np.stack([np.where(part[a:b] == j, times[a:b], 0)[row[at]] for j in TRAIN], 1)
                held.append(summed(name, n))
                size += len(held[-1][0])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counted = rows.where(F.col("part") != HELD_OUT).mapInArrow(tidy(run), COUNTED)
    return counted.groupBy("h").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(TRAIN))])


def hot_bigrams(model: Vocabulary, h: np.ndarray, t: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(model.is_hot(u))
    return at, pair_hash(u[at], h[at])


def hot_trigrams(model: Vocabulary, h: np.ndarray, t: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(model.is_hot(u))
    at = at[member(model.pairs, pair_hash(t[at], u[at]))[1]]
    return at, triple_hash(t[at], u[at], h[at])


def remote_counts(rows: DataFrame, words: DataFrame, model: Vocabulary) -> DataFrame:
    """Counts of all that a key may have to ask for; model gets its frequent pairs. As c(t) and c(u)
    are no less than c(t, u), such a pair is among the bigrams of frequent words, but for the
    start of a text, which stands twice before the first word."""
    out = words
    if len(model.hot):
        bigrams = written(gram_counts(rows, hot_bigrams, model), "bigrams")
        out = out.unionByName(bigrams)
        n = F.expr("n0 + n1 + n2 + n3")
        found = {r.h % (1 << 64): [r.n0, r.n1, r.n2, r.n3] for r in bigrams.where(n > SPREAD * model.key).collect()}
        if model.start.sum() > SPREAD * model.key:
            found[int(pair_hash(np.array([START_HASH]), np.array([START_HASH]))[0])] = model.start.tolist()
        model.pairs = np.array(sorted(found), np.uint64)
        model.pair_counts = np.array([found[int(h)] for h in model.pairs], np.int64).reshape(-1, len(TRAIN))
    if len(model.pairs):
        out = out.unionByName(written(gram_counts(rows, hot_trigrams, model), "trigrams"))
    return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: as from word_counts."""
    n = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")
    columns = [F.sum(f"n{k}") for k in range(len(TRAIN))]
    size, *total = counts.agg(F.count(F.lit(1)), *columns).first()
    total = np.array([x or 0 for x in total], np.int64)
    # The lowest count at which no more than FREQUENT words are left, by sixteenths of octaves.
    level = F.floor(F.log2(n) * 16)
    words, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if words + r["count"] > FREQUENT - 1:
            break
        words, least = words + r["count"], r.level
    top = counts.where(level >= least).collect() if least is not None else []
    ends = counts.where(F.col("h") == int(END)).first()
    table = {np.uint64(r.h % (1 << 64)): [r.n0, r.n1, r.n2, r.n3] for r in top}
    table[END] = [ends.n0, ends.n1, ends.n2, ends.n3] if ends else [0, 0, 0, 0]
    frequent = np.array(sorted(table), np.uint64)
    own = np.array([table[h] for h in frequent], np.int64).reshape(-1, len(TRAIN))
    tokens = int(total.sum()) * FOLDS // len(TRAIN)
    root = int((tokens * MIN_PIECE) ** 0.5)
    key = max(KEY_TOKENS, root, tokens >> KEY_BITS - 1)
    start = np.array(table[END], np.int64)
    hot = [h for h in frequent[own.sum(1) > SPREAD * key] if h != END] + [START_HASH] * bool(start.sum() > SPREAD * key)
    none = np.zeros(0, np.uint64), np.zeros((0, len(TRAIN)), np.int64)
    return Vocabulary(frequent, own, start, total, size, -(-tokens // key) or 1, key, max(CHUNK_TOKENS, root), np.array(sorted(hot), np.uint64), *none)


PACK = ("ids", "part", "times", "u", "run", "word", "far", "before", "early", "row")
_TYPES = dict(zip(PACK, (np.int64, np.uint8, np.uint32, np.uint64, np.uint32, np.uint16, np.uint64, np.uint16, np.uint64, np.uint16)))


_CODEC = pa.Codec("zstd", 1)


def squeezed(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays byte plane by byte plane, compressed, behind their lengths."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    data = b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *planes])
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def widened(data: bytes | memoryview, types: Sequence[type]) -> list[np.ndarray]:
    data = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = [], 8 * len(types)
    for kind, n in zip(types, np.frombuffer(data, np.int64, len(types)).tolist()):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """ids and u go up, so their differences are stored."""
    return squeezed(np.diff(arrays[k], prepend=arrays[k].dtype.type(0)) if k in ("ids", "u") else arrays[k] for k in PACK)


def unpack(data: bytes | memoryview) -> dict[str, np.ndarray]:
    """The tokens of a key and chunk: u, of ``run`` tokens each; word and before, ids of w and t, and
    the hashes of those that have none, far and early; and the place of the text in ids."""
    out = dict(zip(PACK, widened(data, [_TYPES[k] for k in PACK])))
    for k in ("ids", "u"):
        out[k] = np.cumsum(out[k], dtype=out[k].dtype)
    if not len(out["times"]):
        out["times"] = np.ones(len(out["ids"]), np.uint32)
    return out


def packed(rows: DataFrame, vocab) -> DataFrame:
    """(key, chunk, data): the tokens of each chunk of texts by key."""

    def chunk(parts: list[tuple], model: Vocabulary) -> Iterator[tuple[int, int, bytes]]:
        ids, fold_, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
        h = np.concatenate([p[3] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])[:-1]
        row = np.concatenate([(p[4] + b).astype(np.uint16) for p, b in zip(parts, base)])
        first = np.concatenate([p[5] for p in parts])
        parts.clear()  # from here on nothing is kept longer than it is used
        t, u = before(h, first)
        name = K.mix(ids[:1].view(np.uint64) + np.uint64(len(ids)))
        key = K.mix(u) % np.uint64(model.keys)
        hot = np.flatnonzero(model.is_hot(u))
        dealt = pair_hash(t[hot], u[hot])
        dealt[member(model.pairs, dealt)[1]] += name
        key[hot] = K.mix(dealt) % np.uint64(model.keys)
        word = model.ids(h).astype(np.uint16)
        early = np.full_like(word, START)
        early[2:] = word[:-2]
        early[t == START_HASH] = START
        # By key, middle word, word and text. Words that share 44 bits of their hash are told apart below.
        key <<= np.uint64(64 - KEY_BITS)
        key |= u >> np.uint64(KEY_BITS)
        distinct, place = np.unique(key, return_inverse=True)
        rank = place.astype(np.uint64) << np.uint64(32)
        rank |= word.astype(np.uint64) << np.uint64(16)
        rank |= row
        order = np.argsort(rank)
        key = (distinct >> np.uint64(64 - KEY_BITS)).astype(np.int64)[place[order]]
        del distinct, place, rank, first, hot, dealt
        h, t, u, word, early, row = h[order], t[order], u[order], word[order], early[order], row[order]
        del order
        edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            used = np.zeros(len(ids), bool)
            used[row[a:b]] = True
            local = np.cumsum(used) - 1
            start = np.flatnonzero(np.concatenate(([True], u[a + 1 : b] != u[a : b - 1])))
            data = pack({
                "ids": ids[used], "part": fold_[used],
                "times": times[used] if (times[used] != 1).any() else times[:0],
                "u": u[a:b][start], "run": np.diff(np.append(start, b - a)).astype(np.uint32),
                "word": word[a:b], "far": h[a:b][word[a:b] == RARE],
                "before": early[a:b], "early": t[a:b][early[a:b] == RARE] & EARLY,
                "row": local[row[a:b]].astype(np.uint16),
            })
            yield int(key[a]), int(name[0].view(np.int64)), data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocab.value
        parts, count, texts_ = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            found = list(chunk(parts, model))
            for k in range(0, len(found), 64):
                keys, names, data = zip(*found[k : k + 64])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["key", "chunk", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            part, times = batch.column(2).to_numpy().astype(np.uint8), batch.column(3).to_numpy().astype(np.uint32)
            for a, b, h, row, first in texts(batch):
                cut = 0
                while cut < b - a:  # a slice of empty texts may hold more rows than a chunk
                    end = min(b - a, cut + CHUNK_ROWS)
                    x, y = np.searchsorted(row, (cut, end))
                    if parts and (count + y - x > model.chunk or texts_ + end - cut > CHUNK_ROWS):
                        yield from out()
                        parts, count, texts_ = [], 0, 0
                    parts.append((ids[a + cut : a + end], part[a + cut : a + end], times[a + cut : a + end], h[x:y], row[x:y] - cut, first[x:y]))
                    count, texts_, cut = count + y - x, texts_ + end - cut, end
        if parts:
            yield from out()

    return rows.mapInArrow(tidy(run), "key bigint, chunk bigint, data binary")


class Grams:
    """One key's tokens and the counts of its n-grams, by training fold. far: the key's rows of ``asked``."""

    def __init__(self, parts: list[dict[str, np.ndarray]], model: Vocabulary, far: pa.Table):
        self.model = model
        self.sizes = [len(p["ids"]) for p in parts]
        self.ids = np.concatenate([p["ids"] for p in parts])
        base = np.cumsum([0] + self.sizes)[:-1]
        self.row = np.concatenate([p["row"].astype(np.int32) + np.int32(b) for p, b in zip(parts, base)])
        fold_, times = (np.concatenate([p[k] for p in parts]) for k in ("part", "times"))
        us, run = np.unique(np.concatenate([p["u"] for p in parts]), return_inverse=True)
        u = np.repeat(run.astype(np.int32), np.concatenate([p["run"] for p in parts]))
        words, w = self._coded(parts, "word", "far")
        befores, t = self._coded(parts, "before", "early")
        parts.clear()
        # Trigrams by bigram (u, w) and t, each token's place among them, and their bigrams and
        # contexts (t, u): one sort of all tokens where three codes fit in 63 bits.
        wide, narrow = max(len(words), 1).bit_length(), max(len(befores), 1).bit_length()
        if max(len(us), 1).bit_length() + wide + narrow <= CODE_BITS:
            code = (u.astype(np.int64) << wide | w) << narrow | t
            del u, w, t, run
            order = np.argsort(code)
            code = code[order]
            new = np.diff(code, prepend=-1) != 0
            self.trigram = np.empty(len(code), np.int32)
            self.trigram[order] = np.cumsum(new, dtype=np.int32) - 1
            code = code[new]
            del order
            early, code = code & (1 << narrow) - 1, code >> narrow
            new = np.diff(code, prepend=-1) != 0
            bigram, code = np.cumsum(new, dtype=np.int32) - 1, code[new]
            self.bigram_u, self.bigram_w = (code >> wide).astype(np.int32), (code & (1 << wide) - 1).astype(np.int32)
        else:
            code, of = self._distinct(u, w)
            self.bigram_u, self.bigram_w = (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32)
            code, self.trigram = self._distinct(of, t)
            bigram, early = (code >> 32).astype(np.int32), code & 0xFFFFFFFF
            del u, w, t, run, of
        contexts, context = self._distinct(self.bigram_u[bigram], early)
        self.of = bigram, context
        self.context_u = (contexts >> 32).astype(np.int32)
        del code, early
        # What isn't all here: bigrams of frequent u, trigrams of frequent pairs, and words.
        hot = model.is_hot(us)
        self.far_bigrams = np.flatnonzero(hot[self.bigram_u])
        some = np.flatnonzero(hot[self.context_u])
        pair, found = member(model.pairs, pair_hash(befores[contexts[some] & 0xFFFFFFFF], us[self.context_u[some]]))
        self.hot_contexts, pair = some[found], pair[found]
        frequent = np.zeros(len(contexts), bool)
        frequent[self.hot_contexts] = True
        self.far_trigrams = np.flatnonzero(frequent[self.of[1]])
        common = model.ids(words)
        self.far_words = np.flatnonzero(common == RARE)
        b = self.far_bigrams
        tri_b, tri_c = self.of[0][self.far_trigrams], self.of[1][self.far_trigrams]
        asks = (
            words[self.far_words], pair_hash(us[self.bigram_u[b]], words[self.bigram_w[b]]),
            triple_hash(befores[contexts[tri_c] & 0xFFFFFFFF], us[self.bigram_u[tri_b]], words[self.bigram_w[tri_b]]),
        )
        del befores, contexts, b, tri_b, tri_c
        self.here = np.zeros((len(self.of[0]), len(TRAIN)), np.uint32)
        for k, j in enumerate(TRAIN):
            at = np.flatnonzero(fold_[self.row] == j)
            n = np.bincount(self.trigram[at], times[self.row[at]], len(self.here))
            if n.max(initial=0) >= 1 << 32:
                self.here = self.here.astype(np.float64)
            self.here[:, k] = n
        del at, n
        replies = [self._reply(far, h) for h in asks]
        self.c1 = np.zeros((len(words), len(TRAIN)))
        known = common < START
        self.c1[known] = model.counts[common[known]]
        self.c1[self.far_words] = replies[0]
        self.replies = replies[1:]
        self.pair = pair
        at = model.ids(us[hot])
        self.hot_u = np.flatnonzero(hot)
        self.hot_u_counts = np.where((at == START)[:, None], model.start, model.counts[np.minimum(at, len(model.counts) - 1)])

    def _coded(self, parts: list[dict[str, np.ndarray]], ids: str, hashes: str) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes, each token's place among them)."""
        which = np.concatenate([p[ids] for p in parts])
        rare, at = np.unique(np.concatenate([p[hashes] for p in parts]), return_inverse=True)
        code = which.astype(np.int32)
        code[which == RARE] = (1 << 16) + at
        there = np.zeros((1 << 16) + len(rare), bool)
        there[code] = True
        seen, code = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[code]
        table = np.concatenate((self.model.frequent, np.zeros(max(0, (1 << 16) - len(self.model.frequent)), np.uint64), rare))
        table[START] = START_HASH
        return table[seen], code

    @staticmethod
    def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(high.astype(np.int64) << 32 | low, return_inverse=True)
        return found, at.astype(np.int32)

    @staticmethod
    def _reply(far: pa.Table, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(h), len(TRAIN)))
        for data in far["data"].to_pylist():
            answered, *counts = widened(data, [np.uint64] + [np.int64] * len(TRAIN))
            at, found = member(np.cumsum(answered, dtype=np.uint64), h)
            out[found] = np.stack(counts, 1)[at[found]]
        return out

    def counts(self, fold_: int | None = None) -> tuple[np.ndarray, ...]:
        """c(t, u, w), c(t, u), c(u, w) and c(u) by their places, in the corpus or in one fold."""
        pick = (lambda x: x.sum(1, dtype=np.float64)) if fold_ is None else (lambda x: x[:, fold_].astype(np.float64))
        c3 = pick(self.here)
        context = np.bincount(self.of[1], c3, len(self.context_u))
        bigram = np.bincount(self.of[0], c3, len(self.bigram_u))
        u = np.bincount(self.bigram_u, bigram)
        bigram[self.far_bigrams] = pick(self.replies[0])
        c3[self.far_trigrams] = pick(self.replies[1])
        context[self.hot_contexts] = pick(self.model.pair_counts[self.pair])
        u[self.hot_u] = pick(self.hot_u_counts)
        return c3, context, bigram, u

    def places(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some trigrams: their own, contexts', bigrams' and u's places."""
        bigram = self.of[0][at]
        return at, self.of[1][at], bigram, self.bigram_u[bigram]


def hashes_of(p: dict[str, np.ndarray], ids: str, far: str, model: Vocabulary) -> np.ndarray:
    which = p[ids].astype(np.int64)
    out = model.frequent[np.minimum(which, len(model.frequent) - 1)]
    out[which == START] = START_HASH
    out[which == RARE] = p[far]
    return out


def asks_of(p: dict[str, np.ndarray], model: Vocabulary) -> np.ndarray:
    """Hashes of the counts that a piece's tokens need and that may not stand in its key."""
    out = [p["far"], np.array([END])]  # the end is always counted, so every key has a reply
    hot = model.is_hot(p["u"])
    if hot.any():
        at = np.flatnonzero(np.repeat(hot, p["run"]))
        u = np.repeat(p["u"][hot], p["run"][hot])
        w, t = hashes_of(p, "word", "far", model)[at], hashes_of(p, "before", "early", model)[at]
        out.append(pair_hash(u, w))
        found = member(model.pairs, pair_hash(t, u))[1]
        out.append(triple_hash(t[found], u[found], w[found]))
    return np.unique(np.concatenate(out))


def asked(arrays: DataFrame, counts: DataFrame, vocab, owners: int) -> DataFrame:
    """key and data: sorted hashes of what the key's tokens ask for and their counts by fold.

    Keys send their hashes packed, by owner, a part of all hashes; owners answer each key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, parts in held.items():
                h = np.unique(np.concatenate(parts))
                owner = np.mod(h.view(np.int64), owners)
                order = np.argsort(owner, kind="stable")
                at, first = np.unique(owner[order], return_index=True)
                data = [squeezed((np.diff(x, prepend=np.uint64(0)),)) for x in np.split(h[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), key)), pa.array(data, pa.binary())], ["owner", "key", "data"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                h = asks_of(unpack(data.as_buffer()), vocab.value)
                held.setdefault(key, []).append(h)
                size += len(h)
                if size > 2_000_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    def answer(asks: pa.Table, counts: pa.Table) -> pa.Table:
        h = counts["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, n = h[order], [counts[f"n{k}"].to_numpy()[order] for k in range(len(TRAIN))]
        keys, data = [], []
        for key, blob in zip(asks["key"].to_pylist(), asks["data"].to_pylist()):
            at, found = member(h, np.cumsum(widened(blob, [np.uint64])[0], dtype=np.uint64))
            if found.any():
                at = at[found]
                keys.append(key)
                data.append(squeezed((np.diff(h[at], prepend=np.uint64(0)), *[x[at] for x in n])))
        del h, n, order
        release_memory()
        return pa.table({"key": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())})

    asks = arrays.mapInArrow(tidy(run), "owner bigint, key bigint, data binary")
    counts = counts.select(F.pmod("h", F.lit(owners)).alias("owner"), *counts.columns)
    return asks.groupBy("owner").cogroup(counts.groupBy("owner")).applyInArrow(answer, "key bigint, data binary")


def share(count: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    return np.divide(count, total, out=np.zeros(np.broadcast(count, total).shape), where=np.asarray(total) > 0)


def bucket(context: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The place of c(t, u)'s and c(u)'s buckets among the weights."""
    of = [np.minimum(np.floor(np.log2(c + 1)), BUCKETS - 1).astype(np.int64) for c in (context, one)]
    return of[0] * BUCKETS + of[1]


def deleted_cells(table: pa.Table, far: pa.Table, model: Vocabulary) -> pa.Table:
    """A histogram of the trigrams of each training fold by what the other folds predict."""
    t = Grams([unpack(d) for d in table["data"].to_pylist()], model, far)
    cells, values = [np.zeros(0, np.int64)], [np.zeros((0, 4))]
    whole, c1, total = t.counts(), t.c1.sum(1), float(model.total.sum())
    for k in range(len(TRAIN)):
        rest = [x - y for x, y in zip(whole, t.counts(k))]
        rest1 = share(c1 - t.c1[:, k], total - model.total[k])
        for a in range(0, len(t.here), AT_ONCE):
            seen = a + np.flatnonzero(t.here[a : a + AT_ONCE, k])
            w = t.here[seen, k].astype(np.float64)
            places = t.places(seen)
            c3, context, c2, u = (x[at] for x, at in zip(rest, places))
            p = [share(c3, context), share(c2, u), rest1[t.bigram_w[places[2]]]]
            cell = bucket(context, u)
            for x in p:
                level = np.floor(np.log2(np.where(x > 0, x / model.uniform, 1))) + OFFSET
                cell = cell * LEVELS + np.where(x > 0, np.clip(level, 1, LEVELS - 1), 0).astype(np.int64)
            cell, at = np.unique(cell, return_inverse=True)
            cells.append(cell)
            values.append(np.stack([np.bincount(at, x, len(cell)) for x in (w, *[w * x for x in p])], 1))
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    sums = [np.bincount(at, c, len(cell)) for c in np.concatenate(values).T]
    del t, whole
    release_memory()
    return pa.table({"cell": cell, "w": sums[0], "w3": sums[1], "w2": sums[2], "w1": sums[3]})


def interpolation_weights(cells: list, uniform: float) -> np.ndarray:
    """BUCKETS * BUCKETS x (l3, l2, l1, l0) by EM on the held-out counts of each bucket.

    cells: rows of cell, w, w3, w2 and w1 as from deleted_cells."""
    weights = np.full((BUCKETS * BUCKETS, 4), np.nan)
    cell, w_, *sums = (np.array([r[k] for r in cells], float) for k in ("cell", "w", "w3", "w2", "w1"))
    of = cell.astype(np.int64) // LEVELS**3
    order = np.argsort(of, kind="stable")
    found, first = np.unique(of[order], return_index=True)
    for b, at in zip(found, np.split(order, first[1:])):
        w = w_[at]
        p = np.stack([*[x[at] / w for x in sums], np.full(len(at), uniform)], 1)
        lam = np.full(4, 1 / 4)
        for _ in range(ROUNDS):
            part = p * lam
            part *= (w / part.sum(1))[:, None]
            lam = part.sum(0) / w.sum()
        lam = np.maximum(lam, 1e-6)
        weights[b] = lam / lam.sum()
    # A bucket without held-out tokens takes its nearest neighbour's weights.
    if not len(found):
        return np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS * BUCKETS, 1))
    b = np.arange(BUCKETS * BUCKETS)[:, None]
    far = np.abs(b // BUCKETS - found // BUCKETS) + np.abs(b % BUCKETS - found % BUCKETS)
    return weights[found[far.argmin(1)]]


def text_sums(table: pa.Table, far: pa.Table, model: Vocabulary) -> pa.Table:
    """For each chunk: its texts' sums over this key's tokens."""
    # A key without replies means that nothing was learned.
    weights = np.frombuffer(far["weights"][0].as_py(), np.float64).reshape(-1, 4) if far.num_rows else interpolation_weights([], 1.0)
    t = Grams([unpack(d) for d in table["data"].to_pylist()], model, far)
    total, c1 = float(model.total.sum()), t.c1.sum(1)
    counts, one = t.counts(), share(c1, total)
    p = np.zeros(len(t.here))
    for a in range(0, len(p), AT_ONCE):
        places = t.places(np.arange(a, min(a + AT_ONCE, len(p))))
        c3, context, c2, u = (x[at] for x, at in zip(counts, places))
        lam = weights[bucket(context, u)]
        p[a : a + AT_ONCE] = lam[:, 0] * share(c3, context) + lam[:, 1] * share(c2, u) + lam[:, 3] * model.uniform
        p[a : a + AT_ONCE] += lam[:, 2] * one[t.bigram_w[places[2]]]
    np.log10(p, out=p)
    base = np.log10((c1 + 0.5) / (total + 0.5 * (model.size + 1)))
    n, word = len(t.ids), t.bigram_w[t.of[0]]
    sums = np.stack([np.bincount(t.row, minlength=n), *[np.bincount(t.row, x[t.trigram], n) for x in ((c1 > 0)[word], base[word], p)]])
    out, at = [], 0
    for chunk, size in zip(table["chunk"].to_pylist(), t.sizes):
        part = sums[:, at : at + size]
        ids = np.diff(t.ids[at : at + size], prepend=0)
        out.append((chunk, squeezed((ids, *part[:2].astype(np.uint32), *part[2:]))))
        at += size
    del t, sums, p, counts
    release_memory()
    chunks, data = zip(*out)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "data": pa.array(data, pa.binary())})


def learned(arrays: DataFrame, far: DataFrame, vocab) -> DataFrame:
    """One row: the mixture weights as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [interpolation_weights(rows, vocab.value.uniform).tobytes() for rows in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["weights"])

    cells = arrays.groupBy("key").cogroup(far.groupBy("key")).applyInArrow(lambda t, f: deleted_cells(t, f, vocab.value), "cell bigint, w double, w3 double, w2 double, w1 double")
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("w", "w3", "w2", "w1")])
    # A bounded number of cells, whatever the corpus.
    return cells.agg(F.sort_array(F.collect_list(F.struct("cell", "w", "w3", "w2", "w1"))).alias("cells")).mapInArrow(run, "weights binary")


def added_up(table: pa.Table) -> pa.Table:
    ids, counts, sums = [], [], []
    for d in table["data"].to_pylist():
        of, *found = widened(d, [np.int64, np.uint32, np.uint32, np.float64, np.float64])
        ids.append(np.cumsum(of))
        counts.append(np.stack(found[:2]))
        sums.append(np.stack(found[2:]))
    distinct, at = np.unique(np.concatenate(ids), return_inverse=True)
    whole = [np.bincount(at, c, len(distinct)).astype(np.int64) for c in np.concatenate(counts, 1)]
    real = [np.bincount(at, c, len(distinct)) for c in np.concatenate(sums, 1)]
    names = ["uid", "n_tokens", "n_known", "base_score", "score"]
    return pa.table(dict(zip(names, [distinct, *whole, *real])))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), fold(id_col, FOLDS).cast("int").alias("part"))
    all_, with_id, ids = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    unique = all_ == with_id == ids
    if unique:
        units = rows.select(F.col("id").cast("bigint").alias("uid"), "text", "part", F.lit(1).alias("times"))
    else:
        rows = rows.withColumn("uid", F.xxhash64(F.coalesce(F.col("id"), F.lit(0)), F.col("id").isNull(), "text"))
        units = rows.groupBy("uid").agg(F.first("text").alias("text"), F.first("part").alias("part"), F.count(F.lit(1)).cast("int").alias("times"))
    counts = written(word_counts(units), "words")
    model = vocabulary(counts)
    counts = remote_counts(units, counts, model)
    shared = spark.sparkContext.broadcast(model)
    # One plan: the weights are a subquery over the same two exchanges, which are made once.
    arrays = packed(units, shared).repartition("key")
    far = asked(arrays, counts, shared, -(-model.size // OWNER_WORDS) or 1).repartition("key")
    weighted = far.withColumn("weights", learned(arrays, far, shared).scalar())
    sums = arrays.groupBy("key").cogroup(weighted.groupBy("key")).applyInArrow(lambda t, f: text_sums(t, f, shared.value), "chunk bigint, data binary")
    out = sums.groupBy("chunk").applyInArrow(added_up, "uid bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    # A text of two chunks, or of a chunk that was made again from other rows, comes in parts.
    out = out.groupBy("uid").agg(*[F.sum(c).alias(c) for c in out.columns[1:]])
    if unique:
        out = out.withColumnRenamed("uid", id_col)
    else:
        out = rows.select(F.col("id").alias(id_col), "uid").join(out, "uid").drop("uid")
    return out.withColumn("train_tokens", F.lit(int(model.total.sum())).cast("bigint"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
