"""License scans with a generalised suffix automaton of template words.

Words of a text stream through the automaton of all templates, which gives for
each word the longest piece of any template that ends there (matching
statistics). Long maximal pieces are chained, in order and with short gaps, into
spans of a template; a span that covers enough of it gives the template's label. A piece
is tried at every place of a template where it stands. Of spans that lie mostly on words
of a better span, as licenses share sentences, only that one counts.
Named phrases ("mit license", ...) are found wherever their words stand.

A chain is open for MAX_GAP words after its end, so the work is in proportion to the text,
however often a license is repeated in it.

Only stretches whose every three consecutive words occur in a template enter the
automaton. This loses nothing: a piece of MIN_PIECE >= 3 words lies in one stretch.

Defined results: a null text is empty and has no matches; a very long text is scanned whole;
ties between spans go to the longer, then the earlier, then the first template; repeated rows get equal results; an empty table
gives no rows; extra columns stay outside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnfall.llm import tokens as K
from tarnfall.llm.automaton import Automaton
from tarnfall.llm.common import prepare
from tarnfall.llm.license_texts import PHRASES, TEMPLATES

MIN_PIECE = 4
#: Words that may differ between two pieces of a span.
MAX_GAP = 8
#: A span has so many matched words, unless the template is shorter, and ...
MIN_WORDS = 5
#: ... this share of the template, or LONG_WORDS whatever the share.
MIN_COVER, LONG_WORDS = 0.6, 20


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return K.Words(np.array([0, len(raw)]), raw, K.NOT_WORD).hashes()


@dataclass(frozen=True)
class Span:
    label: str
    template: int
    start: int  # first word of the text
    end: int  # one past the last
    matched: int
    cover: float


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label in sorted(templates) for _ in templates[label]]
        hashed = [words_of(t) for label in sorted(templates) for t in templates[label]]
        named = {p: words_of(p) for p in phrases}
        self.vocabulary = np.unique(np.concatenate([*hashed, *named.values()]))
        sequences = [np.searchsorted(self.vocabulary, h) for h in hashed]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([s.tolist() for s in sequences], MIN_PIECE)
        v = self.base = len(self.vocabulary) + 1
        triples = [(s[:-2] * v + s[1:-1]) * v + s[2:] for s in sequences if len(s) > 2]
        self.triples = np.unique(np.concatenate([*triples, np.zeros(0, np.int64)]))
        self.phrases = [(np.searchsorted(self.vocabulary, h).tolist(), phrases[p]) for p, h in named.items()]

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, self.base - 1)

    def places(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
        """First words of each phrase's places."""
        for phrase, label in self.phrases:
            n = len(phrase)
            if len(ids) >= n:
                ok = row[: len(row) - n + 1] == row[n - 1 :]
                for k, c in enumerate(phrase):
                    ok &= ids[k : len(ids) - n + 1 + k] == c
                yield np.flatnonzero(ok), label

    def stretches(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words of one text in which every three occur in a template."""
        if len(ids) < 3 or not len(self.triples):
            return
        # Only where three known words stand together: most texts have few.
        known = ids < self.base - 1
        three = np.flatnonzero(known[:-2] & known[1:-1] & known[2:] & (row[:-2] == row[2:]))
        key = (ids[three] * self.base + ids[three + 1]) * self.base + ids[three + 2]
        at = np.minimum(np.searchsorted(self.triples, key), len(self.triples) - 1)
        three = three[self.triples[at] == key]
        if not len(three):
            return
        # A run also ends where the text does.
        cut = np.flatnonzero((np.diff(three) > 1) | (row[three[1:]] != row[three[:-1]])) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(three)]))):
            yield int(three[a]), int(three[b - 1]) + 3

    def pieces(self, ids: list[int], start: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, its word, text word, length) of long maximal pieces."""
        found = list(self.automaton.statistics(ids))
        for k, (n, state) in enumerate(found):
            if n >= MIN_PIECE and (k + 1 == len(found) or found[k + 1][0] <= n):
                for which, end in self.automaton.ends[state]:
                    yield which, end - n, start + k + 1 - n, n

    def chain(self, pieces: Iterable[tuple[int, int, int, int]]) -> list[Span]:
        """Chains of one text's pieces that cover enough of a template."""
        chains: list[tuple[int, list[int]]] = []
        by_template: dict[int, list[list[int]]] = {}  # open chains: text start, text end, template end, matched
        for which, at, text, n in sorted(pieces, key=lambda p: (p[2], p[0], p[1])):
            still = [c for c in by_template.get(which, ()) if text - c[1] <= MAX_GAP]
            best = None
            for c in still:
                # Pieces may overlap, as when a word of an edit also fits the template elsewhere.
                skip = max(0, c[1] - text, c[2] - at)
                if skip < n and text + skip - c[1] <= MAX_GAP and at + skip - c[2] <= MAX_GAP:
                    rank = c[3] + n - skip, -c[0]
                    if best is None or rank > best[0]:
                        best = rank, c, skip
            if best:
                c, skip = best[1:]
                c[1], c[2], c[3] = text + n, at + n, c[3] + n - skip
            else:
                still.append(c := [text, text + n, at + n, n])
                chains.append((which, c))
            by_template[which] = still
        out = []
        for which, (start, end, _, matched) in chains:
            size = self.sizes[which]
            if matched >= min(MIN_WORDS, size) and (matched >= MIN_COVER * size or matched >= LONG_WORDS):
                out.append(Span(self.labels[which], which, start, end, matched, min(1.0, matched / size)))
        return sorted(out, key=lambda s: (-s.matched, s.start, s.template))

    @staticmethod
    def best(spans: list[Span]) -> list[Span]:
        """Without those of which more than half lies in better ones."""
        if len(spans) < 2:
            return spans
        low = min(s.start for s in spans)
        taken = bytearray(max(s.end for s in spans) - low)
        out = []
        for s in spans:
            a, b = s.start - low, s.end - low
            if 2 * taken.count(1, a, b) <= b - a:
                taken[a:b] = b"\1" * (b - a)
                out.append(s)
        return out

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, str]], list[Span]]]:
        """(words, named places, spans) of each text."""
        offsets, raw = K.utf8(column)
        for a, b in K.slices(offsets):
            w = K.Words(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], K.NOT_WORD)
            ids = self.ids(w.hashes())
            named: dict[int, list[tuple[int, str]]] = {}
            pieces: dict[int, list[tuple[int, int, int, int]]] = {}
            for places, label in self.places(ids, w.row):
                for k in places.tolist():
                    named.setdefault(int(w.row[k]), []).append((k - int(w.first[w.row[k]]), label))
            for start, end in self.stretches(ids, w.row):
                if end - start >= MIN_PIECE:
                    r = int(w.row[start])
                    pieces.setdefault(r, []).extend(self.pieces(ids[start:end].tolist(), start - int(w.first[r])))
            for r, n in enumerate(w.counts().tolist()):
                yield n, named.get(r, []), self.best(self.chain(pieces[r])) if r in pieces else []


COLUMNS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])),
}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """A row for each text: words, named places, labels, score and template spans. The
    score is the best span's share of its template, or one half for names alone."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())  # about 1 MB
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, named, spans in shared.value.scan(b.column(1)):
                at = [k for k, _ in named]
                base = {label for _, label in named}
                labels = base | {s.label for s in spans}
                score = max([s.cover for s in spans] + [0.5] * bool(named), default=0.0)
                listed = [{"label": s.label, "start": s.start, "end": s.end, "cover": s.cover} for s in spans]
                first, last = (min(at), max(at)) if at else (None, None)
                rows.append((n, len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, listed))
            columns = zip(*rows) if rows else [()] * len(COLUMNS)
            arrays = [pa.array(c, t) for c, t in zip(columns, COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], [id_col, *COLUMNS])

    schema = (
        f"{id_col} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:bigint,`end`:bigint,cover:double>>"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
