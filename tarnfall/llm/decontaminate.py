"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

The seeds of a benchmark item are its pairs of neighbouring words. In a text a pair may
stand together or with one word between. An alignment with MIN_SHARE of an item's full
score can lose only so many pairs: a word left out at an end costs MATCH and one pair, a
changed or dropped word inside MATCH + 1 and two, a gap of two added words 2 and one. So
it keeps at least ``need`` of them, about a third, within a bounded run of words. Places with
so many seeds are aligned; no others can reach MIN_SHARE. The results are those of
aligning every item with every whole text.

One pass over the corpus counts in how many texts each seed stands, as common pairs make
most of the work: of an item, up to need - 1 of them are left out and need falls with each,
so one of the others is in every copy, however common the copies are. In a second
pass the seeds find places in the texts, those whose words and pairs cannot add up to MIN_SHARE
are dropped, and the words around the others are aligned with the item, with scores
for equal words and costs for changed, added and dropped ones.

The benchmark is the stated query set: it is sent to the executors in blocks of at most
BLOCK_BYTES, one pass over the corpus for each block, and no text is shuffled.

Defined results: null texts and items are empty and never match; a very long text is
searched whole; of alignments with one score that which ends first is told; items with fewer than
LEAST words are their own seed, and must occur as they are; repeated items count once;
repeated rows get equal results; an empty benchmark or corpus gives no rows; extra
columns stay outside, or are carried untouched by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import tokens as K
from tarnfall.llm.common import prepare, tidy

#: Items of fewer words must occur as they are.
LEAST = 4
BLOCK_BYTES = 8 << 20
#: A seed is common if it stands in more texts than this ...
COMMON = 16
#: ... and in more than this share of all texts.
COMMON_SHARE = 1e-4
MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment counts from this share of the item's full score.
MIN_SHARE = 0.5


def words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return K.Words(np.array([0, len(raw)]), raw, K.NOT_WORD).hashes()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment: a row of the matrix at a time; the gap
    inside a row is a running maximum."""
    slope = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def pairs(h: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each value of h and the one ``apart`` places after it."""
    return K.gram_hashes(np.stack([h[:-apart], h[apart:]], 1).ravel(), 2)[::2] if len(h) > apart else h[:0]


class Block:
    """Items of one block with their seeds; common seeds can be switched off."""

    def __init__(self, items: Iterable[tuple[object, str | None]]):
        seen = {}
        for item_id, text in items:
            w = words(text)
            if len(w):
                seen.setdefault((item_id, w.tobytes()), (item_id, w))
        self.items = list(seen.values())
        self.short = sorted({len(w) for _, w in self.items if len(w) < LEAST})
        size = np.array([len(w) for _, w in self.items], np.int64)
        #: Score that an item's alignment must reach, and what it may cost.
        self.least = np.where(size < LEAST, MATCH * size, np.ceil(MIN_SHARE * MATCH * size).astype(np.int64))
        self.slack = MATCH * size - self.least
        #: Seeds that such an alignment holds: three of the slack take two pairs at most.
        self.need = np.where(size < LEAST, 1, np.maximum(1, size - 1 - 2 * self.slack // 3))
        self.size = size
        seeds = [K.gram_hashes(w, len(w)) if len(w) < LEAST else pairs(w, 1) for _, w in self.items]
        self.seeds, self.inverse = np.unique(np.concatenate([*seeds, np.zeros(0, np.uint64)]), return_inverse=True)
        self.where = np.array([(k, at) for k, g in enumerate(seeds) for at in range(len(g))], np.int64).reshape(-1, 2)
        self.use(np.ones(len(self.where), bool))

    def use(self, on: np.ndarray) -> None:
        """on: the (item, word) places that act as seeds. The places of seed s are
        ``places[first[s]:first[s + 1]]``."""
        at = np.flatnonzero(on)
        at = at[np.argsort(self.inverse[at], kind="stable")]
        self.places = self.where[at]
        self.first = np.searchsorted(self.inverse[at], np.arange(len(self.seeds) + 1))
        self.on = np.diff(self.first) > 0

    def hits(self, w: K.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, word) of every place of a seed in the texts."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        grams = [(n - 1, K.gram_hashes(h, n)) for n in self.short]
        if len(self.items) and self.size.max() >= LEAST:
            grams += [(apart, pairs(h, apart)) for apart in (1, 2)]
        for apart, g in grams:
            at = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
            word = np.flatnonzero((self.seeds[at] == g) & self.on[at] & (w.row[: len(g)] == w.row[apart:]))
            found.append((at[word], word))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def switch_off(self, df: np.ndarray, texts: int) -> None:
        """df: texts of each seed. Of each item, need - 1 common seeds go off at most."""
        df = df[self.inverse]
        # An item's places from the most common.
        order = np.lexsort((-df, self.where[:, 0]))
        item = self.where[order, 0]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        off = order[(df[order] > max(COMMON, COMMON_SHARE * texts)) & (rank < self.need[item] - 1)]
        on = np.ones(len(self.where), bool)
        on[off] = False
        self.need = self.need - np.bincount(self.where[off, 0], minlength=len(self.items))
        self.use(on)

    def expected(self, w: K.Words, h: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """For (row, item) where a run of words holds enough seeds, the places in the texts at
        which the item would start by the first of them."""
        seed, word = self.hits(w, h)
        n = self.first[seed + 1] - self.first[seed]
        hit = np.repeat(np.arange(len(seed)), n)
        item, pos = self.places[np.arange(len(hit)) + np.repeat(self.first[seed] - (np.cumsum(n) - n), n)].T
        at = word[hit]
        row = w.row[at]
        order = np.lexsort((at, item, row))
        item, pos, at, row = item[order], pos[order], at[order], row[order]
        last = np.arange(len(at)) + self.need[item] - 1
        there = np.minimum(last, len(at) - 1)
        ok = (last < len(at)) & (item[there] == item) & (row[there] == row) & (at[there] - at < self.size[item] + self.slack[item])
        out: dict[tuple[int, int], set[int]] = {}
        for r, k, s in zip(row[ok].tolist(), item[ok].tolist(), (at - pos)[ok].tolist()):
            out.setdefault((r, k), set()).add(s)
        return out

    def reachable(self, k: int, h: np.ndarray) -> bool:
        """Whether item k may align with h: of M equal words in R runs the score is
        2 M - (R - 1) at most, that is M, the M - R pairs inside the runs, and 1."""
        item = self.items[k][1]
        if len(item) < LEAST:
            return True
        return np.isin(item, h).sum() + np.isin(pairs(item, 1), pairs(h, 1)).sum() + 1 >= self.least[k]

    def matches(self, w: K.Words, h: np.ndarray) -> Iterator[tuple[int, object, float, int, int]]:
        """(row, item, share, first word, end) of the best alignment of each item."""
        for (r, k), starts in sorted(self.expected(w, h).items()):
            item_id, item = self.items[k]
            pad = int(self.slack[k])
            low, high = int(w.first[r]), int(w.first[r + 1])
            best = (0, 0, 0)
            ranges: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(low, s - pad), min(high, s + len(item) + pad)
                if ranges and a <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                if not self.reachable(k, h[a:b]):
                    continue
                score, end = align(item, h[a:b])
                if score > best[0]:
                    best = (score, a, end)
            score, a, end = best
            if score >= self.least[k]:
                # The same alignment from its end backwards tells where it starts.
                _, back = align(item[::-1], h[a : a + end][::-1])
                yield r, item_id, score / (MATCH * len(item)), a + end - back - low, a + end - low

    def scan(self, column: pa.Array) -> Iterator[tuple[int, object, float, int, int]]:
        offsets, raw = K.utf8(column)
        for a, b in K.slices(offsets):
            w = K.Words(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], K.NOT_WORD)
            for r, *rest in self.matches(w, w.hashes()):
                yield (a + r, *rest)


def prepared(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text: str) -> Iterator[Block]:
    """The benchmark's blocks, with the common seeds switched off."""
    prepare(docs.sparkSession)
    items = items.select(item_col, item_text)
    size = items.agg(F.sum(F.octet_length(item_text)), F.count(F.lit(1))).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    for k in range(blocks if size[1] else 0):
        part = items.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k)
        block = Block(tuple(r) for r in part.collect())
        if not block.items:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            df, texts = np.zeros(len(block.seeds), np.int64), 0
            for b in batches:
                offsets, raw = K.utf8(b.column(0))
                for x, y in K.slices(offsets):
                    w = K.Words(offsets[x : y + 1] - offsets[x], raw[offsets[x] : offsets[y]], K.NOT_WORD)
                    seed, word = block.hits(w, w.hashes())
                    pair = np.unique(w.row[word] * len(block.seeds) + seed)
                    df += np.bincount(pair % len(block.seeds), minlength=len(block.seeds))
                texts += b.num_rows
            hit = np.flatnonzero(df)
            rows = np.concatenate((hit, [-1])), np.concatenate((df[hit], [texts]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], ["seed", "n"])

        counted = docs.select(text_col).mapInArrow(tidy(count), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
        df, texts = np.zeros(len(block.seeds), np.int64), 0
        for r in counted.collect():  # at most one row a seed of the block
            if r.seed < 0:
                texts = r.n
            else:
                df[r.seed] = r.n
        shared.destroy()
        block.switch_off(df, texts)
        yield block


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row for each text and item that it holds a copy of: share of the item's full
    alignment score, and the words [start_word, end_word) of the text."""
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, share double, start_word bigint, end_word bigint"
    item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    out = None
    for block in prepared(docs, items, text_col, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(zip(*shared.value.scan(b.column(1)))) or [()] * 5
                arrays = [b.column(0).take(pa.array(found[0], pa.int64())), pa.array(found[1], item_type)]
                arrays += [pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "share", "start_word", "end_word"])

        part = docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no copy of any item, with all their columns."""
    at = docs.columns.index(text_col)
    for block in prepared(docs, items, text_col, item_col, item_text):  # seeds are counted in the docs as given
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in shared.value.scan(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
