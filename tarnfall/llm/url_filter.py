"""URL filtering with a trie over reversed host labels and path segments.

A rule is a host with a path prefix and a verdict. It fits its host and every
subdomain when the url's path starts with the rule's. The longest match wins:
more host labels first, then the longer path, and of equal rules block.

Only the url column is read, and nothing is shuffled. The rules are broadcast, checked
against MAX_RULE_BYTES, and become a trie once in each Python worker; a longer list is
applied in blocks of that size, keeping the longest match so far. A look-up takes a step
for each label and segment, and at a rule's open last segment one for each length that
occurs there, however many rules a host has.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; where no rule fits, the verdict is ``default``; a very long url is matched
whole; repeated rows and empty tables pass through; extra columns stay outside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnfall.llm.common import prepare

MAX_RULE_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    labels: dict[str, "Node"] = field(default_factory=dict)
    #: Rules at this host, by complete path segments and then the last, open one.
    paths: "Node | None" = None
    ends: dict[str, Rule] = field(default_factory=dict)
    #: Lengths of the ends, longest first.
    lengths: tuple[int, ...] = ()


class Trie:
    """match() gives the longest rule that fits, with its rank. Pickled as its rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        self._build()

    def __getstate__(self) -> tuple[Rule, ...]:
        return self.rules

    def __setstate__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self._build()

    def _build(self) -> None:
        self.root = Node()
        leaves = []
        for rule in self.rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"a verdict is allow or block, not {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.labels.setdefault(segment, Node())
            old = node.ends.get(last)
            if old is None or rule.verdict == "block":
                node.ends[last] = rule
            leaves.append(node)
        for node in leaves:
            if not node.lengths:
                node.lengths = tuple(sorted({len(end) for end in node.ends}, reverse=True))

    def match(self, host: str, path: str) -> tuple[tuple[int, int], Rule] | None:
        best, node, depth = None, self.root, 0
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            depth += 1
            if node.paths is not None and (rule := self._path(node.paths, path)) is not None:
                best = (depth, len(rule.path)), rule
        return best

    @staticmethod
    def _path(node: Node, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            cut = path.find("/", at)
            room = (len(path) if cut < 0 else cut) - at
            # Longer than what was found before, as it lies at least as deep.
            for n in node.lengths:
                if n <= room and (rule := node.ends.get(path[at : at + n])) is not None:
                    best = rule
                    break
            if cut < 0 or (node := node.labels.get(path[at:cut])) is None:
                return best
            at = cut + 1


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host's A-Z lower-cased, the path as it is."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    slash = end if slash < 0 else slash
    return rest[:slash].translate(_LOWER), rest[slash:end]


def blocks(rules: Iterable[Rule], most: int = MAX_RULE_BYTES) -> Iterator[list[Rule]]:
    block, size = [], 0
    for rule in rules:
        n = len(rule.name.encode()) + 64
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(rule)
        size += n
    if block:
        yield block


def judge(
    pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url",
    most: int = MAX_RULE_BYTES,
) -> DataFrame:
    """id_col, host, path, rule (null if none fits) and verdict of every row."""
    prepare(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    kinds = f"{id_col} {id_type}, host string, path string, rule string, verdict string, labels int, length int"
    out = None
    for block in list(blocks(rules, most)) or [[]]:
        shared = pages.sparkSession.sparkContext.broadcast(Trie(block))
        again = out is not None

        def run(batches: Iterable[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for b in batches:
                if again:
                    rows = [list(r) for r in zip(*[c.to_pylist() for c in b.columns[1:]])]
                else:
                    rows = [[*split_url(u), None, default, 0, 0] for u in b.column(1).to_pylist()]
                for row in rows:
                    found = trie.match(row[0], row[1])
                    rank = (row[4], row[5])
                    if found and (found[0] > rank or found[0] == rank and found[1].verdict == "block"):
                        row[2:] = [found[1].name, found[1].verdict, *found[0]]
                columns = [list(c) for c in zip(*rows)] or [[]] * 6
                types = [pa.string()] * 4 + [pa.int32()] * 2
                arrays = [b.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in kinds.split(", ")])

        source = out if again else pages.select(id_col, url_col)
        out = source.mapInArrow(run, kinds)
    return out.drop("labels", "length")


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP4_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^?#]*'), '') AS cut FROM a),
c AS (SELECT page_id, cut, regexp_extract(cut, '^[^/]*') AS h FROM b),
d AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(cut, length(h) + 1) AS path FROM c),
e AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM d)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM e
"""
