"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarnfall.llm import common, decontaminate, exact_dedup, language_id, license_scan, lm_scoring, minhash_dedup, mixing, registry, toxicity, url_filter, warc

LONG = "lorem ipsum dolor " * 60_000
ROWS = [
    (1, "a text of some words here", "en", "s", 5), (1, "a text of some words here", "en", "s", 5), (2, None, None, None, None),
    (3, "", "de", "s", 0), (None, "no id at all in this row", "en", None, 1), (4, LONG, "en", "t", 9), (5, LONG, "en", "t", 9),
    (None, None, None, None, None), (1, "the same id with another text", "fr", "s", 3), (-7, " \t\n", "xx", "", 3), (6, "…", "en", "s", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["row", "id", "uid", "key", "chunk", "component", "kept", "salt", "h", "size", "copies", "count", "score", "toxic", "t", "n", "__dropped"]


@pytest.fixture
def edge(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(k))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.collect()), key=lambda x: (x is not None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_near_duplicates(edge, empty):
    got = minhash_dedup.near_duplicates(edge)
    assert ids(got, "id") == ALL
    by = {(r.id, r.n_shingles): r.component for r in got.collect()}
    assert by[4, 3] == 4 and by[5, 3] == 4 and by[1, 2] == 1 and by[2, 0] == 2 and by[-7, 0] == -7 and by[None, 3] is None
    left = minhash_dedup.dedup(edge)
    assert left.columns == edge.columns and 5 not in ids(left) and {4, 2, 3, None} <= set(ids(left))
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.dedup(empty).count() == 0


def test_lm(edge, empty):
    got = lm_scoring.score(edge).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ALL
    assert {r.n_tokens for r in got if r.doc_id == 1} == {7}
    assert [r.n_tokens for r in got if r.doc_id == 4] == [180_001]
    assert [r.n_tokens for r in got if r.doc_id == 2] == [1]
    assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for i, t, *_ in ROWS if __import__("brute").fold(i, 5) != 1)}
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert lm_scoring.score(empty).count() == 0
    one = lm_scoring.score(edge.where("doc_id = 1").limit(1)).collect()
    assert len(one) == 1


def test_lm_repeated_rows_count(spark):
    from brute import base_scores

    docs = [(i, f"w{i % 3} w{i % 2}") for i in range(20)]
    got = lm_scoring.score(spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string")).collect()
    want = base_scores([*docs, docs[0]])
    assert len(got) == 21
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])


def test_warc(spark, edge, empty):
    warc.register(spark)
    for df, n in ((edge, len(ROWS)), (empty, 0)):
        path = common.new_path(spark, "edges")
        warc.with_revisits(df, "doc_id", "lang", "text", "2024-01-01T00:00:00Z").write.format("warc").mode("append").save(path)
        back = spark.read.format("warc").load(path)
        assert back.count() == n
        if n:
            types = {(r.record_id, r.record_type, r.refers_to) for r in back.collect()}
            assert ("<urn:page:4>", "revisit", "<urn:page:5>") in types
            assert ("<urn:page:null>", "revisit", "<urn:page:3>") in types


def test_exact(edge, empty):
    left = exact_dedup.dedup(edge, keep="max")
    assert left.columns == edge.columns
    assert ids(left) == [None, -7, 1, 1, 3, 5, 6]
    got = exact_dedup.content_sort(edge, "max").collect()
    assert {(r.row.doc_id, r.keep_id, r.group_size) for r in got if not r.row.text} == {(2, 3, 3), (3, 3, 3), (None, 3, 3)}
    assert exact_dedup.content_sort(empty).count() == 0


def test_toxicity(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, 1, 0), (None, 1, 1), (5, 1, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_fold(edge, labels)
    got = toxicity.scored(edge, model)
    assert ids(got) == ALL and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.clean(edge, model, limit=1.1).columns == edge.columns
    assert toxicity.clean(edge, model, limit=1.1).count() == len(ROWS)
    nothing = toxicity.train_fold(empty, labels)
    assert max(r.score for r in toxicity.scored(edge, nothing).collect()) < 1e-6
    assert toxicity.scored(empty, model).count() == 0


def test_licenses(edge, empty):
    got = license_scan.licenses(edge)
    assert ids(got) == ALL and {r.n_words for r in got.collect() if r.doc_id == 4} == {180_000}
    assert license_scan.licenses(empty).count() == 0


def test_mixing(edge, empty):
    got = mixing.mix(edge)
    assert ids(got, "id") == ALL
    assert {(r.source, r.source_size) for r in got.collect()} == {("s", 19), (None, 7), ("t", 360_000), ("", 0)}
    left = mixing.mixed(edge)
    assert left.columns == [c for c in edge.columns if c != "copies"] + ["copies"]
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_leaks(spark, edge, empty):
    items = spark.createDataFrame([(1, "a text of some words here"), (1, "a text of some words here"), (2, None)], "item_id bigint, text string")
    got = decontaminate.leaks(edge, items)
    assert sorted(map(tuple, got.select("doc_id", "item_id").collect())) == [(1, 1), (1, 1)]
    left = decontaminate.clean(edge, items)
    assert left.columns == edge.columns and left.count() == len(ROWS) - 2
    none = items.where("item_id > 5")
    assert decontaminate.leaks(edge, none).count() == 0 and decontaminate.clean(edge, none).count() == len(ROWS)
    assert decontaminate.leaks(empty, items).count() == 0


def test_leaks_in_long_texts(spark):
    """An edited copy at the end of a long text, another across it, and equal alignments."""
    item = [f"i{k}" for k in range(40)]
    edited = " ".join("x" if k % 4 == 3 else w for k, w in enumerate(item))  # a share of 0.64 is left
    rows = [(1, LONG + edited), (2, edited + " " + LONG), (3, LONG), (4, " ".join(item) + " gap" * 100 + " " + " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].start_word, got[1].end_word) == (180_000, 180_039) and got[2].start_word == 0
    assert (got[4].start_word, got[4].end_word, got[4].share) == (0, 40, 1)


def test_urls(spark, empty):
    long = "http://WWW.Example.com/en/" + "a/" * 50_000 + "?q"
    rows = [(1, long), (1, long), (2, None), (3, "no scheme"), (None, "x://b.net/es/#f"), (4, ""), (5, "http://h" + ".l" * 3000 + ".net/fr/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", *[f"'c' AS {c}" for c in ("host", "path", "rule", "verdict", "labels", "length")])
    got = sorted((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(df.repartition(2), url_filter.RULES).collect())
    assert got[1:3] == [(1, "www.example.com", 100_004, "www.example.com/en/", "allow")] * 2
    assert got[0] == (0, "b.net", 4, "net/es/", "block") and got[-1][3:] == ("net/fr/", "block")
    assert got[3] == (2, "", 0, None, "allow") and got[4][1:] == got[5][1:] == ("", 0, None, "allow")
    assert url_filter.judge(df.where("false"), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(df, [], default="block").collect()} == {"block"}


def test_languages(edge, empty):
    model = language_id.learn(edge, "doc_id", "text", "lang")
    got = language_id.identify(edge, model)
    assert ids(got) == ALL
    assert {r.lang_pred for r in got.collect() if r.doc_id in (2, 3, -7, 6)} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.learn(empty, "doc_id", "text", "lang")
    assert {(r.lang_pred, r.score) for r in language_id.identify(edge, nothing).collect()} == {("und", 0.0)}


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        d = str(tmp_path / f"t{len(rows)}")
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "nothing like it")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(r[0], r[2], r[1]) for r in rows], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
        return d

    return make


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edges", "empty"])
def test_queries(spark, folder, rows):
    d = folder(rows)
    for name, query in registry.queries().items():
        n = query(spark, d).count()
        assert n == (0 if name.startswith("op9") else len(rows)), name
    assert corpus_pipeline.run(spark, d).columns[:5] == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")


def test_pipeline(spark):
    import brute

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    tox = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train_fold(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [i for i in sorted(rows) if tox[i] < 0.5]
    seen, unique = set(), []
    for i in left:
        if rows[i].text not in seen:
            seen.add(rows[i].text)
            unique.append(i)
    comp = brute.near_components([(i, rows[i].text) for i in unique])
    near = [i for i in unique if comp[i] == i]
    hit = {r.doc_id for r in registry.queries()["op9_decontaminate"](spark, sf).collect()}
    want = {i for i in near if i not in hit}
    got = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) <= want
    sizes = {}
    for i in want:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + len(brute.words(rows[i].text))
    target, taken = brute.mix_targets(sizes), {}
    for i, c in got.items():
        taken[rows[i].source] = taken.get(rows[i].source, 0) + c * len(brute.words(rows[i].text))
    big = max(len(brute.words(rows[i].text)) for i in want)
    assert all(abs(taken.get(s, 0) - t) <= big for s, t in target.items())
