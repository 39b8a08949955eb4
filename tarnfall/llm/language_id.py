"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily
into the longest pieces that occur in the language's text; each piece costs log2 of
that text's length in bits, and the language with the fewest bits a byte wins.

Learning: about SAMPLE_ROWS rows of each language, sampled by a hash of the id, give a piece
of at most ROW_CHARS characters each, from a place that the hash tells, so a language's text
has about SAMPLE_ROWS * ROW_CHARS characters whatever the number of languages and rows. Each
language is learned in a task of its own; its table, about 1 MB, goes to the driver and
is broadcast. Beyond PASS_LANGUAGES languages the texts are parsed in several passes.

Parsing: an automaton is stored by row displacement, three small arrays in which a step
is two look-ups, and a step that is missing restarts at the root: a new piece. Texts are cut into
segments that are parsed side by side in numpy. Each segment's parse starts afresh, and its
last piece goes on into the next segment until it starts a piece where that one does, too; from
there both parses are the same. Following those places from the first segment on gives
the parse of the whole text.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing
could be learned; a tie goes to the first language in order; very long texts are parsed
whole, in memory in proportion to the text; repeated rows get equal results; an empty
table gives no rows; extra columns stay outside.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.llm import tokens as K
from tarnfall.llm.automaton import Automaton
from tarnfall.llm.common import MAX_BROADCAST_IDS, fold, prepare, tidy, written

#: Rows of each language that are sampled, about, and the characters that each gives.
SAMPLE_ROWS, ROW_CHARS = 200, 150
#: Languages whose tables a worker holds at once.
PASS_LANGUAGES = 256
SEGMENT = 512
#: Bytes times languages that are parsed at once.
GROUP_BYTES = 8 << 20
#: Bits a byte to confidence.
SHARPNESS = 6.0

#: Letters and non-ASCII bytes as they are (A-Z in lower case), all else a blank.
LETTERS = K.byte_table(frozenset([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Language:
    """One language's automaton by row displacement: the step of a state by a byte class is in
    the slot base[state] + class, if ``check`` names the state there, else there is none."""

    def __init__(self, name: str, text: bytes):
        data = LETTERS[np.frombuffer(text, np.uint8)]
        self.name, self.size = name, len(data)
        seen = np.unique(data)
        self.classes = np.zeros(256, np.uint8)  # 0: a byte that the language lacks
        self.classes[seen] = np.arange(1, len(seen) + 1)
        step = Automaton([self.classes[data].tolist()]).step
        step.append({})  # the state after a byte that the language lacks: a piece of its own
        width = len(seen) + 1
        base = np.zeros(len(step), np.int32)
        used: set[int] = set()
        check: dict[int, int] = {}
        # States with many steps first, each in the next place where all of them are free; those
        # with fewer steps start over and fill what is left.
        size, at = 0, 0
        for state in sorted(range(len(step)), key=lambda s: -len(step[s])):
            steps = list(step[state])
            if not steps:
                break
            if len(steps) != size:
                size, at = len(steps), 0
            while any(at + c in used for c in steps):
                at += 1
            base[state] = at
            for c in steps:
                used.add(at + c)
                check[at + c] = state
        slots = int(base.max()) + width + 1
        self.base, self.check, self.next = base, np.full(slots, -1, np.int32), np.zeros(slots, np.int32)
        for slot, state in check.items():
            self.check[slot] = state
            self.next[slot] = step[state][slot - int(base[state])]
        self.restart = np.full(256, len(step) - 1, np.int32)
        for c, to in step[0].items():
            self.restart[c] = to


class Model:
    def __init__(self, languages: Iterable[Language]):
        languages = sorted(languages, key=lambda x: x.name)
        self.languages = [x.name for x in languages]
        none = [np.zeros(0, np.int32)]
        states = np.cumsum([0] + [len(x.base) for x in languages])
        slots = np.cumsum([0] + [len(x.check) for x in languages])
        self.base = np.concatenate([x.base + np.int32(s) for x, s in zip(languages, slots)] or none)
        self.check = np.concatenate([np.where(x.check < 0, -1, x.check + np.int32(s)) for x, s in zip(languages, states)] or none)
        self.next = np.concatenate([x.next + np.int32(s) for x, s in zip(languages, states)] or none)
        self.restart = np.concatenate([x.restart + np.int32(s) for x, s in zip(languages, states)] or none)
        self.classes = np.array([x.classes for x in languages], np.uint8).reshape(-1, 256)
        self.cost = np.array([np.log2(x.size + 2) for x in languages])

    def pieces(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Pieces of each text under each language: rows x languages."""
        most = max(1, GROUP_BYTES // max(len(raw), 1))
        groups = [range(k, min(k + most, len(self.languages))) for k in range(0, len(self.languages), most)]
        return np.concatenate([self._pieces(offsets, raw, g) for g in groups] or [np.zeros((len(offsets) - 1, 0))], 1)

    def _pieces(self, offsets: np.ndarray, raw: np.ndarray, group: range) -> np.ndarray:
        size = np.diff(offsets)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), parts)
        first = np.cumsum(parts) - parts
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        stop = offsets[1:][owner]
        length = np.minimum(begin + SEGMENT, stop) - begin
        classes = self.classes[group.start : group.stop][:, LETTERS[raw]]
        restart = (np.arange(group.start, group.stop, dtype=np.int64) * 256)[:, None]
        # Where each segment's own parse starts a piece.
        starts = np.zeros((len(group), len(raw)), bool)
        order = np.argsort(-length, kind="stable")  # short segments last: they drop out early
        sorted_begin = begin[order]
        alive = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")  # segments longer than k
        state = np.zeros((len(group), len(owner)), np.int32)
        for k in range(SEGMENT):
            n = int(alive[k])
            if not n:
                break
            p = sorted_begin[:n] + k
            c = classes[:, p]
            again = self.restart.take(restart + c)
            if k == 0:
                starts[:, p] = True
                state[:, :n] = again
                continue
            slot = self.base.take(state[:, :n]) + c
            ok = self.check.take(slot) == state[:, :n]
            starts[:, p] = ~ok
            state[:, :n] = np.where(ok, self.next.take(slot), again)
        # The last piece of a segment goes on into the next one, until both start a piece.
        extra, meet = np.zeros((2, len(group), len(owner)), np.int64)
        on = np.flatnonzero((begin + SEGMENT < stop)[order])
        lang, lane = np.repeat(np.arange(len(group)), len(on)), np.tile(on, len(group))
        now, at = state[lang, lane], sorted_begin[lane] + SEGMENT
        lane = order[lane]
        while len(lane):
            c = classes[lang, at]
            slot = self.base.take(now) + c
            ok = self.check.take(slot) == now
            now = np.where(ok, self.next.take(slot), self.restart.take(restart[lang, 0] + c))
            met = ~ok & starts[lang, at]
            np.add.at(extra, (lang, lane), ~ok & ~met)
            at = np.where(met, at, at + 1)
            done = met | (at == stop[lane])
            meet[lang[done], lane[done]] = at[done]
            lang, lane, now, at = lang[~done], lane[~done], now[~done], at[~done]
        sums = np.zeros((len(group), len(raw) + 1), np.int32)
        np.cumsum(starts, 1, out=sums[:, 1:])
        out = (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).astype(float)
        # Texts of several segments, from one place where parses meet to the next.
        long = np.flatnonzero(parts > 1)
        out[:, long] = 0
        lang, row = np.repeat(np.arange(len(group)), len(long)), np.tile(long, len(group))
        at = offsets[row]
        while len(row):
            own = first[row] + (at - offsets[row]) // SEGMENT
            end = begin[own] + length[own]
            out[lang, row] += sums[lang, end] - sums[lang, at] + extra[lang, own]
            at = np.where(end < stop[own], meet[lang, own], end)
            on = at < stop[own]
            lang, row, at = lang[on], row[on], at[on]
        return out.T

    def bits(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(whether it has a letter, bits a byte by language) of consecutive texts."""
        offsets, raw = K.utf8(column)
        for a, b in K.slices(offsets):
            at, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
            yield has_letter(at, part), self.pieces(at, part) * self.cost / np.maximum(np.diff(at), 1)[:, None]


def has_letter(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    ascii_letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS) -> list[Language]:
    """The languages' automata, each of a bounded sample, made on the executors."""
    prepare(labelled.sparkSession)
    usable = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.lit(10)).alias("h"), F.col(text_col).alias("text")
    ).where("lang IS NOT NULL AND length(text) > 0")
    # A row a language, counted before it is broadcast, so that no text is dealt by language.
    counts = written(usable.groupBy("lang").count(), "languages-counted")
    counts = F.broadcast(counts) if counts.count() <= MAX_BROADCAST_IDS else counts
    sample = usable.join(counts, "lang").where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) * F.col("count") < rows)
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    sample = sample.select("lang", "h", F.substr("text", place, F.lit(chars)).alias("text"))

    def build(table: pa.Table) -> pa.Table:
        # A task of its own for each language; rows in one order whatever the partitions.
        parts = sorted(zip(table["h"].to_pylist(), table["text"].to_pylist()))
        name = table["lang"][0].as_py()
        data = pickle.dumps(Language(name, "\n".join(t for _, t in parts).encode()))
        return pa.table({"lang": pa.array([name]), "model": pa.array([data], pa.binary())})

    built = sample.groupBy("lang").applyInArrow(build, "lang string, model binary")
    return [pickle.loads(r.model) for r in written(built, "languages").toLocalIterator()]


def identify(docs: DataFrame, languages: list[Language], id_col: str = "doc_id", text_col: str = "text", most: int = PASS_LANGUAGES) -> DataFrame:
    """id_col, lang_pred and score of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    languages = sorted(languages, key=lambda x: x.name)
    blocks = [languages[k : k + most] for k in range(0, len(languages), most)] or [[]]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("best", "string"), ("bits", "double"), ("total", "double"))])

    def parsed(rows: DataFrame, block: list[Language], last: bool) -> DataFrame:
        """bits: the least so far; total: the sum of shares relative to it."""
        shared = docs.sparkSession.sparkContext.broadcast(Model(block))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in batches:
                at = 0
                for lettered, bits in model.bits(b.column(1)):
                    part = b.slice(at, len(lettered))
                    at += len(lettered)
                    old = np.array([np.inf if x is None else x for x in part.column(3).to_pylist()])
                    new, best = bits.min(1, initial=np.inf), bits.argmin(1) if bits.shape[1] else []
                    least = np.minimum(old, new)
                    base = np.where(np.isfinite(least), least, 0)
                    total = np.exp(-SHARPNESS * (bits - base[:, None])).sum(1)
                    total += np.array([x or 0 for x in part.column(4).to_pylist()]) * np.exp(-SHARPNESS * (old - base))
                    names = [model.languages[k] if n < o else x for n, o, k, x in zip(new, old, best, part.column(2).to_pylist())] or part.column(2).to_pylist()
                    if not last:
                        arrays = [*part.columns[:2], pa.array(names, pa.string()), pa.array(least), pa.array(total)]
                        yield pa.RecordBatch.from_arrays(arrays, b.schema.names)
                        continue
                    found = lettered & np.isfinite(least)
                    score = np.divide(1.0, total, out=np.zeros(len(total)), where=found)
                    names = [n if ok else "und" for n, ok in zip(names, found)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

        return rows.mapInArrow(tidy(run), f"{id_col} {kind}, lang_pred string, score double" if last else rows.schema)

    for block in blocks[:-1]:
        rows = written(parsed(rows, block, False), "languages-so-far")
    return parsed(rows, blocks[-1], True)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages = learn(docs.where(fold("doc_id", 3) != 1), "doc_id", "text", "lang")
    return identify(docs, languages).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
