"""Operators against plain Python, round trips and held-out accuracy."""

import gzip
import pickle
import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfall.llm import common, decontaminate, exact_dedup, language_id, license_scan, lm_scoring, minhash_dedup, mixing, registry, toxicity, url_filter, warc
from tarnfall.llm import tokens as K
from tarnfall.llm.automaton import Automaton

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
TEXT = st.text(st.sampled_from(list("abAZé09 \t\n.,ßü中\x00\x0b\x1f\x85\u2028")), max_size=60)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def offsets(texts):
    return K.utf8(pa.array(texts, pa.string()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_shingles(texts):
    at, raw = offsets(texts)
    for sep, split in ((K.WHITE, brute.words), (K.NOT_WORD, brute.plain_words)):
        w = K.Words(at, raw, sep)
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
        assert got == [x for t in texts for x in split(t)]
        assert w.counts().tolist() == [len(split(t)) for t in texts]
    w = K.Words(at, raw)
    h = w.hashes()
    same = {}
    for a, b, x in zip(w.start, w.end, h.tolist()):
        assert same.setdefault(bytes(w.data[a:b]), x) == x
    assert len(set(same.values())) == len(same)
    assert [len(s) for s in K.shingles(w, 5)] == [len(brute.shingles(t)) for t in texts]


def near_corpus(seed=3):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs, i = [], 0
    for size in (3, 5, 8, 30, 60, 120, 300):
        base = make(size)
        for k in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((i * 7 % 1009, " ".join(w).upper() if k % 3 == 0 else " \n".join(w)))
            i += 1
    docs += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE\ntwo"), (2005, "one")]
    return docs


@pytest.mark.parametrize("block, wide, hot", [(256, 2048, 1000), (4, 2048, 3), (4, 4, 3)])
def test_near_duplicates(spark, monkeypatch, block, wide, hot):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "WIDE", wide)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    docs = near_corpus()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    want = brute.near_components(docs)
    assert {r.id: r.component for r in got} == want
    assert {r.id: r.n_shingles for r in got} == {i: len(brute.shingles(t)) for i, t in docs}


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = [(7, a), (3, a + " x"), (7, b), (9, b + " y"), (9, b + " y"), (None, b), (None, "alone"), (8, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    want = [(3, 3), (7, 3), (7, 7), (9, 7), (9, 7), (None, 7), (8, 8), (None, None)]
    assert sorted(((r.id, r.component) for r in got), key=str) == sorted(want, key=str)
    kept = minhash_dedup.dedup(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", a + " x"), ("7", b), ("None", b), ("None", "alone"), ("8", "")])


def blocks_of(spark, values):
    """Links of one bucket, without its hub 0, that the block stage finds."""
    sets = [(i, len(v), np.array(v, np.uint64).tobytes()) for i, v in values.items()]
    sets = spark.createDataFrame(sets, "id bigint, n bigint, s binary")
    members = [(key, i, len(v), 0, 1, len(values)) for key in (8, 9) for i, v in values.items()]
    members = spark.createDataFrame(members, "key bigint, id bigint, n bigint, hub bigint, hub_n bigint, size bigint")
    tmp = common.Scratch(spark)
    labels = spark.createDataFrame([], "id bigint, component bigint")
    return [tuple(r) for r in minhash_dedup.block_links(minhash_dedup.mixed_members(members, labels, tmp), sets, tmp).collect()]


def test_block_stage_links_what_hubs_miss(spark):
    """2 and 3 are linked with each other but not with the others of their bucket."""
    assert blocks_of(spark, {1: range(0, 100), 2: range(40, 140), 3: range(45, 145), 4: range(500, 600)}) == [(2, 3)]


def test_block_stage_compares_whole_hashes(spark):
    """Shingles of one set that share the lower half of their hashes all count."""
    low = {1: range(0, 9), 2: range(20, 29), 3: range(21, 30), 4: range(50, 59)}
    assert blocks_of(spark, {i: [k << 32 | 7 for k in v] for i, v in low.items()}) == [(2, 3)]
    # Nor do they count when only those halves are equal: 1 and 2 are no pair, 3 and 4 are.
    far = {1: [k << 32 | k for k in range(20)], 2: [k << 33 | k for k in range(1, 21)]}
    far |= {3: [k << 40 for k in range(1, 21)], 4: [k << 40 for k in range(2, 22)]}
    assert blocks_of(spark, far) == [(3, 4)]


def test_narrower_buckets_keep_every_link(spark):
    rng = random.Random(5)
    common_, own = [rng.randrange(1 << 60) for _ in range(60)], []
    sets = {}
    for i in range(80):
        own = own if i % 4 else [rng.randrange(1 << 60) for _ in range(40)]
        sets[i] = sorted({*common_, *own[: 30 + i % 4], *[rng.randrange(1 << 60) for _ in range(i % 4 and 9)]})
    rows = [(i, len(s), np.array(s, np.uint64).tobytes()) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "id bigint, n bigint, s binary")
    narrow = minhash_dedup.narrower(df.select("id"), df, common.Scratch(spark)).collect()
    keys = {}
    for r in narrow:
        keys.setdefault(r.id, set()).add(r.key)
    for a in sets:
        for b in sets:
            both = len({*sets[a]} & {*sets[b]})
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert keys[a] & keys[b]
    assert max(Counter(r.key for r in narrow).values()) < len(sets) // 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(30, 35), (35, 33), (33, 30)] + [(100, 100 + k) for k in range(1, 40)]
    got = minhash_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.id: r.component for r in got.collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 33: 30, 35: 30, **{100 + k: 100 for k in range(40)}}
    assert minhash_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_dedup_query(spark):
    docs = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in registry.queries()["op1_minhash_dedup"](spark, SF).collect()}
    want = brute.near_components(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_lm_scores(spark):
    docs = [tuple(r) for r in table(spark, "documents", SMALL).select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in registry.queries()["op2_lm_scoring"](spark, SMALL).collect()}
    want = brute.base_scores(docs)
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3]
        assert close(r.base_score, want[i][3])
        assert r.held_out == (brute.fold(i, 5) == 1)


def gram_counts(docs):
    """Counts of n-grams and their contexts, in all training folds (None) and in each."""
    out = Counter()
    for i, t in docs:
        k = brute.fold(i, 5)
        if k != 1:
            ws = ["<s>", "<s>", *brute.words(t), "</s>"]
            for t_, u, w in zip(ws, ws[1:], ws[2:]):
                for key in (k, None):
                    out.update([(key, w), (key, u, w), (key, t_, u, w), (key, "context", u), (key, "contexts", t_, u), (key, "all")])
    return out


def estimates(c, t, u, w, less=None):
    """(buckets, estimates by three, two and one words), without a fold's own counts."""
    n = lambda *g: c[(None, *g)] - (c[(less, *g)] if less is not None else 0)
    div = lambda a, b: a / b if b else 0.0
    three, two = n("contexts", t, u), n("context", u)
    return tuple(int(np.floor(np.log2(x + 1))) for x in (three, two)), (div(n(t, u, w), three), div(n(u, w), two), div(n(w), n("all")))


def mixture_weights(c, v, rounds=100):
    """Buckets -> weights by EM on each fold's trigrams, predicted from the other folds."""
    seen = {}
    for g, n in c.items():
        if g[0] is not None and len(g) == 4 and g[1] != "contexts":
            b, p = estimates(c, *g[1:], less=g[0])
            seen.setdefault(b, []).append((n, *p, 1 / (v + 1)))
    out = {}
    for b, rows in seen.items():
        rows = np.array(rows)
        n, p, lam = rows[:, 0], rows[:, 1:], np.full(4, 1 / 4)
        for _ in range(rounds):
            part = p * lam
            lam = (part * (n / part.sum(1))[:, None]).sum(0) / n.sum()
        lam = np.maximum(lam, 1e-6)
        out[b] = lam / lam.sum(), n.sum()
    return out


def watched_score(spark, monkeypatch, df):
    """(scores, model, weights by buckets, arrays) of a run."""
    seen = {}
    for name in ("learned", "vocabulary", "packed"):
        old = getattr(lm_scoring, name)
        monkeypatch.setattr(lm_scoring, name, lambda *a, name=name, old=old: seen.setdefault(name, old(*a)))
    got = {r.doc_id: r.score for r in lm_scoring.score(df).collect()}
    lam = np.frombuffer(seen["learned"].first()[0]).reshape(lm_scoring.BUCKETS, lm_scoring.BUCKETS, 4)
    return got, seen["vocabulary"], lam, seen["packed"]


@pytest.mark.parametrize("chunk, spread, bits", [(2_000_000, 0.4, 63), (500, 0.4, 63), (500, 0.05, 63), (500, 0.05, 0)])
def test_lm_model(spark, monkeypatch, chunk, spread, bits):
    """The mixture, with its counts and EM weights, in plain Python; one passage is in every text."""
    for name, value in (("CHUNK_TOKENS", chunk), ("MIN_PIECE", 1), ("KEY_TOKENS", 900), ("FREQUENT", 40), ("SPREAD", spread), ("CODE_BITS", bits), ("OWNER_WORDS", 300)):
        monkeypatch.setattr(lm_scoring, name, value)
    docs = [tuple(r) for r in table(spark, "documents", SMALL).select("doc_id", "text").collect()][:60]
    docs = [(i, " ".join((t or "").split()[:80]) + " of the" * 8) for i, t in docs] + [(9001, None), (9002, "the of the")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    got, model, lam, arrays = watched_score(spark, monkeypatch, df)
    assert model.keys > 1 and 1 < len(model.frequent) <= 40
    assert {K.word_hash(b"of"), K.word_hash(b"the")} <= {int(h) for h in model.hot}
    assert len(model.pairs) >= 1 and (spread > 0.1 or lm_scoring.START_HASH in model.hot and len(model.pairs) > 2)
    if chunk == 500:  # dealt over the keys
        keys = {r.key for r in arrays.collect() if K.word_hash(b"of") in lm_scoring.unpack(r.data)["u"].tolist()}
        assert len(keys) > 4
    c = gram_counts(docs)
    v = len({g for g in c if len(g) == 2 and g[0] is None and g[1] != "all"})
    want = mixture_weights(c, v)
    assert len(want) > 8
    for b, (weights, n) in want.items():
        if n > 400:
            assert lam[b] == pytest.approx(weights, abs=0.05)
    for i, t in docs:
        ws, s, plain = ["<s>", "<s>", *brute.words(t), "</s>"], 0.0, 0.0
        for g in zip(ws, ws[1:], ws[2:]):
            b, p = estimates(c, *g)
            s += np.log10(np.dot(lam[b], (*p, 1 / (v + 1))))
            plain += np.log10(np.dot(want[b][0] if b in want else lam[b], (*p, 1 / (v + 1))))
        assert close(got[i], s)
        assert got[i] == pytest.approx(plain, rel=0.03)
    # A distribution: over the vocabulary and one unknown word it adds up to 1.
    words = [g[1] for g in c if len(g) == 2 and g[0] is None and g[1] != "all"]
    for t, u in list({g[2:] for g in c if g[:2] == (None, "contexts")})[:200]:
        b, _ = estimates(c, t, u, "the")
        total = lam[b][3] / (v + 1) + sum(np.dot(lam[b], (*estimates(c, t, u, w)[1], 1 / (v + 1))) for w in words)
        assert total == pytest.approx(1)


def test_lm_rare_contexts(spark, monkeypatch):
    """With more words than are broadcast, each is still a context of its own."""
    docs = [(10 * k + j, " ".join(f"w{i}" for i in range(700 * k, 700 * k + 700 + j))) for k in range(100) for j in (0, 2, 3)]
    docs += [(k, f"w{k} w{k + 2} the w{k + 1} unseen{k} w{k}") for k in range(5000, 5400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "KEY_TOKENS", 50_000)
    got, model, lam, _ = watched_score(spark, monkeypatch, df)
    c = gram_counts(docs)
    v = len({g for g in c if len(g) == 2 and g[0] is None and g[1] != "all"})
    assert v > 65_536 and len(model.frequent) < v
    for i, t in docs:
        ws, s = ["<s>", "<s>", *t.split(), "</s>"], 0.0
        for g in zip(ws, ws[1:], ws[2:]):
            b, p = estimates(c, *g)
            s += np.log10(np.dot(lam[b], (*p, 1 / (v + 1))))
        assert close(got[i], s)


def test_lm_beats_the_base(spark):
    r = registry.queries()["op2_lm_scoring"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_em_prefers_the_better_estimate():
    def cell(at, w, *p):
        return {"cell": at, "w": w} | {name: w * x for name, x in zip(("w3", "w2", "w1"), p)}

    base = (3 * lm_scoring.BUCKETS + 4) * lm_scoring.LEVELS**3
    lam = lm_scoring.interpolation_weights([cell(base + 1, 90, 0.5, 0.1, 0.01), cell(base + 2, 10, 0.0, 0.0, 0.2)], 1e-4)
    at = 3 * lm_scoring.BUCKETS + 4
    assert lam[at][0] > 0.8 and lam[at].sum() == pytest.approx(1)
    assert (lam[0] == lam[at]).all()


def test_mixing_targets(spark):
    docs = table(spark, "documents")
    out = mixing.mix(docs).collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute.mix_targets(sizes)
    biggest = max(r.size for r in out)
    taken = {}
    for r in out:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes)
    again = {(r.id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.id, r.copies) for r in out}
    stage = mixing.mixed(docs).select("doc_id", "copies").collect()
    assert {tuple(r) for r in stage} == {(r.id, r.copies) for r in out if r.copies}


def test_mixing_caps(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1000, "b"), (10, None), (0, "c")])]
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == pytest.approx({"a": 30.0, "b": 960.0, "c": 0.0, None: 30.0})


def test_exact_dedup_salts_hot_texts(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(900)] + [(None, "hot"), (899, "hot"), (None, "solo"), (None, None), (-4, "")]
    rows += [(None, "nameless")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.content_sort(df, keep, hot_rows=5).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        assert len(got) == len(rows)
        for r in got:
            g = groups[r.row.text or ""]
            assert r.group_size == len(g)
            assert r.keep_id == best([i for i in g if i is not None], default=None)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.row.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.dedup(df, hot_rows=5).count() == len(groups)


def test_exact_dedup_plan(spark):
    plan = exact_dedup.content_sort(table(spark, "documents"), "max")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(head" in plan and "Python" not in plan and "Arrow" not in plan


def test_url_trie(spark):
    R = url_filter.Rule
    rules = [*url_filter.RULES, R("block", "a.com", "/x"), R("allow", "a.com", "/x/y"), R("block", "org", ""), R("allow", "b.org", "/q")]
    urls = ["http://a.com/xyz", "http://A.com/x/yz?x#y", "ftp://u.a.com/", "https://b.org", "https://b.org/q/r", "http://xcom/", "nothing", None, "http://", "a://b.net/es/", "http://b.net/es", "x://a.com?/x", "http://.com/"]

    def slow(url):
        host, path = url_filter.split_url(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
        return (host, path, best.name if best else None, best.verdict if best else "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for most in (url_filter.MAX_RULE_BYTES, 100):
        got = url_filter.judge(df, rules, most=most).collect()
        assert {r.page_id: tuple(r)[1:] for r in got} == {i: slow(u) for i, u in enumerate(urls)}
    with pytest.raises(ValueError):
        url_filter.Trie([R("maybe", "x")])


def test_url_rules_of_one_host(spark):
    """Many rules of one host, against trying each."""
    rng = random.Random(6)
    some = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(7)))
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), rng.choice(["x.org", "org", "a.x.org"]), some()) for _ in range(150)]
    trie = pickle.loads(pickle.dumps(url_filter.Trie(rules)))
    for _ in range(300):
        host, path = rng.choice(["x.org", "b.a.x.org", "y.org"]), some() + rng.choice(["", "a", "/b"])
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
        got = trie.match(host, path)
        assert (got and got[1]) == want
    many = url_filter.Trie(url_filter.Rule("block", "x.org", f"/{k}") for k in range(100_000))
    import time

    began = time.monotonic()
    for k in range(2000):
        assert many.match("x.org", f"/{k}z")[1].path == f"/{k}"
    assert time.monotonic() - began < 2


def archive(spark, path, rows):
    warc.register(spark)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    warc.with_revisits(df, "page_id", "url", "html", "2024-01-01T00:00:00Z").write.format("warc").mode("append").save(path)
    return spark.read.format("warc")


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2\r\nEvil: 1", "x"), (3, None, "WARC/1.1\r\n\r\n"), (4, "http://ü/", None), (5, "u", "é" * 300_000), (6, "v", "")]
    path = f"file://{tmp_path}/w"
    got = {r.record_id: r for r in archive(spark, path, rows).load(path).collect()}
    assert len(got) == 6
    at = lambda i: got[f"<urn:page:{i}>"]
    assert (at(2).record_type, bytes(at(2).payload), at(2).target_uri) == ("response", b"x", "http://a/2%0D%0AEvil: 1")
    assert (at(1).record_type, at(1).payload, at(1).refers_to, at(1).payload_length) == ("revisit", None, "<urn:page:2>", "1")
    assert (at(4).record_type, at(4).refers_to, at(6).record_type, bytes(at(6).payload)) == ("revisit", "<urn:page:6>", "response", b"")
    assert bytes(at(3).payload) == b"WARC/1.1\r\n\r\n" and at(3).target_uri is None
    assert bytes(at(5).payload).decode() == "é" * 300_000
    assert at(5).payload_digest == "sha1:" + warc.digest(("é" * 300_000).encode())
    names = [p.name for p in (tmp_path / "w").iterdir()]
    assert names and all(n.startswith("part_") for n in names)


def test_warc_revisits_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, f"u{i}", None if i % 3 == 0 else f"t{i % 7}", "x") for i in range(60)] + [(None, "n", "t1", "x"), (59, "again", "t3", "y"), (59, "again", "t3", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string").repartition(4)
    df = df.selectExpr("*", "'a' AS again", "1 AS keep", "2 AS same", "3 AS of")
    one, two = (sorted(map(str, warc.with_revisits(df, "page_id", "url", "html", "d", most=m).collect())) for m in (10**6, 0))
    assert one == two and len(one) == len(rows)
    assert sum("revisit" in x for x in one) == len(rows) - 10 and sum("keep" in x for x in one) == 0


def test_small_gzip_members_read_in_linear_time(tmp_path):
    import time

    one = warc.record({"WARC-Type": "response", "Content-Type": "application/http"}, warc.http_block(b"x" * 40))
    (tmp_path / "a.warc.gz").write_bytes(warc.member(one) * 20_000)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 20_000)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one * 20_000))
    for name in "abc":
        reader = warc.WarcReader({"path": f"file://{tmp_path}"})
        began = time.monotonic()
        assert sum(1 for _ in reader.records(str(tmp_path / f"{name}.warc.gz"), warc.pafs.LocalFileSystem())) == 20_000
        assert time.monotonic() - began < 5


def test_warc_pushdown_and_skipping(spark, tmp_path):
    rows = [(i, f"http://{'ab'[i % 2]}/{i}", f"text {i // 3}") for i in range(30)]
    path = f"file://{tmp_path}/w"
    read = archive(spark, path, rows)
    df = read.load(path).where(F.col("record_type").isin("revisit", "other") & F.col("target_uri").startswith("http://a/"))
    assert {r.record_id for r in df.collect()} == {f"<urn:page:{i}>" for i in range(30) if i % 2 == 0 and i % 3 != 2}
    assert read.load(path).where("record_type = 'response'").count() == 10
    bare = read.option("payload", "false").load(path).collect()
    assert len(bare) == 30 and all(r.payload is None for r in bare)
    # The reader itself filters, and passes over members without inflating them.
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20


def test_warc_plain_and_foreign_files(tmp_path):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "application/http"}
    a, b = warc.record(head, warc.http_block(b"one" * 10)), warc.record({"WARC-Type": "warcinfo"}, b"info")
    (tmp_path / "x.warc").write_bytes(a + b + a)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b + a))
    (tmp_path / "z.warc.gz").write_bytes(warc.member(a) + warc.member(b))
    (tmp_path / "skip.txt").write_text("no")
    for skip in (False, True):
        reader = warc.WarcReader({"path": f"file://{tmp_path}"})
        if skip:
            list(reader.pushFilters([warc.EqualTo(("record_type",), "response")]))
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert [r["payload"] for r in rows if r["record_type"] == "response"] == [b"one" * 10] * 5
        assert sum(r["record_type"] == "warcinfo" for r in rows) == (0 if skip else 3)
    (tmp_path / "t.warc").write_bytes(a[:-20])
    with pytest.raises(ValueError):
        list(reader.records(str(tmp_path / "t.warc"), warc.pafs.LocalFileSystem()))


def test_language_pieces():
    """Of whole texts: of several segments, with passages of the training text, unknown letters."""
    rng = random.Random(5)
    texts = {lang: "".join(rng.choice(a) for _ in range(6000)).encode() for lang, a in (("x", "abc de"), ("y", "cdefé g"), ("z", "a"))}
    model = language_id.Model(language_id.Language(lang, t) for lang, t in texts.items())
    some = lambda n, a="abcdefg é": "".join(rng.choice(a) for _ in range(n))
    docs = ["abc cab", "", "gfe dcé", "ZZ", some(400), some(512, "abc"), some(513, "abc"), some(5000), some(5000, "zq"), "a" * 3000]
    docs += [texts["x"][700:3600].decode(), some(100) + texts["x"][:5000].decode() + some(1000), some(511) + texts["y"][1000:4000].decode("utf-8", "ignore")]
    docs += [some(300) + texts["x"][k : k + 1300].decode() + some(40, "zz") for k in range(0, 4000, 500)]
    at, raw = offsets(docs)
    got = model.pieces(at, raw)
    for k, t in enumerate(docs):
        for j, lang in enumerate(model.languages):
            assert got[k, j] == brute.greedy_pieces(language_id.LETTERS[np.frombuffer(t.encode(), np.uint8)].tobytes(), texts[lang])
    assert got[10, 0] == 1
    old = language_id.GROUP_BYTES
    try:
        language_id.GROUP_BYTES = 1  # a language at a time
        assert (model.pieces(at, raw) == got).all()
    finally:
        language_id.GROUP_BYTES = old


def test_many_languages(spark):
    """Each of 250 languages is learned from as much text, and predicted, in one pass or three."""
    rng = random.Random(8)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñøк") for _ in range(5)) for _ in range(30)] for k in range(250)}
    rows = [(i, " ".join(rng.choice(words[i % 250]) for _ in range(25)), f"l{i % 250:03}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    languages = language_id.learn(df, "doc_id", "text", "lang")
    assert len(languages) == 250 and min(x.size for x in languages) > 500
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, languages).collect()}
    assert all(found[i][0] == lang for i, _, lang in rows)
    for i, (lang, score) in ((r.doc_id, (r.lang_pred, r.score)) for r in language_id.identify(df, languages, most=100).collect()):
        assert found[i] == (lang, pytest.approx(score))


def test_language_accuracy(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.1")
    got = registry.queries()["op10_language_id"](spark, "/root/testdata/sf0.1").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.queries()["op6_toxicity"](spark, sf).join(table(spark, "labels", sf), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def toxic_model(texts, toxic):
    words, seen = [], []
    for w, h in toxicity.split_words(pa.array(texts, pa.large_string())):
        words += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        seen.append(toxicity.distinct_steps(w, h)[:2])
    word, at = np.unique(np.concatenate([x for x, _ in seen]), return_index=True)
    spelling = {"word": word, "steps": np.concatenate([y for _, y in seen])[at]}
    return toxicity.KneserNey(words, np.array(toxic), spelling), spelling


def test_kneser_ney_is_a_distribution():
    """Words without a rare beginning: each class's probabilities add up to 1."""
    rng = random.Random(1)
    vocabulary = ["a", "ab", "abc", "abd", "b", "ba", "longerthanstem", "longerthanother"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(80)]
    kn, spelling = toxic_model(texts, [k % 3 == 0 for k in range(80)])
    assert kn.size == len(vocabulary)
    assert np.exp(kn.spelling.log_probability(spelling["steps"])).sum(0) == pytest.approx([1, 1])
    assert np.isfinite(kn.own).all() and np.isfinite(kn.context).all()


@pytest.mark.parametrize("least, share", [(2, 1e-9), (8, 1e-9), (2, 1 / 10)])
def test_toxicity_is_that_of_plain_kneser_ney(monkeypatch, least, share):
    """Features and scores of whole texts, with new words, stems, bytes beyond ASCII and long words."""
    monkeypatch.setattr(toxicity, "MIN_DOCS", least)
    monkeypatch.setattr(toxicity, "MIN_SHARE", share)
    rng = random.Random(4)
    stems = ["ab", "abc", "abd", "é", "longerthanstem", "longerthanother", "x"]
    word = lambda: rng.choice(stems) + rng.choice(["", "", "a", "ing", str(rng.randrange(40))])
    some = lambda bad, n=25: " ".join("grob" + word() if bad and rng.random() < 0.1 else word() for _ in range(n))
    toxic = np.array([k % 3 == 0 for k in range(150)])
    texts = [some(bad) for bad in toxic]
    kn, _ = toxic_model(texts, toxic)
    plain = brute.KneserNey(texts, toxic.tolist(), max(least, share * len(texts)))
    news = [*texts[:20], some(True, 300), some(False, 900), "", "grobnew ab", "ab", "longerthanstemx é", "unseen words"]
    want = np.array([plain.features(t) for t in news])
    got = []
    for w, h in toxicity.split_words(pa.array(news, pa.large_string())):
        _, steps, at = toxicity.distinct_steps(w, h)
        got.append(kn.features(h, w.first, steps, at))
    assert np.concatenate(got) == pytest.approx(want, abs=1e-9)
    model = toxicity.Model(kn, np.array([0.3, 0.7, 1.1, -2.0]))
    z = want @ model.weights[:3] + model.weights[3]
    assert model.score(pa.array(news, pa.large_string())) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_long_texts_teach(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    docs = [(k, " ".join(word() for _ in range(6000)) + (" grob" if k % 2 else "") + " end") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    model = toxicity.learn(df, labels)
    assert model.score(pa.array([docs[0][1], docs[1][1]])).round().tolist() == [0, 1]
    monkeypatch.setattr(toxicity, "MAX_BYTES", 300_000)
    few = toxicity.learn(df, labels)
    assert few.kn is None or few.kn.spelling is not None


def test_new_words_are_judged_by_their_stems():
    rng = random.Random(2)
    plain = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(plain(20) + ([f"grobl{rng.randrange(10**6)}"] if k % 2 else [])) for k in range(400)]
    model = toxicity.fit(pa.array(texts, pa.large_string()), np.arange(400) % 2 == 1, (200, 200))
    low, high, none = model.score(pa.array(["w1 w2 w3 w77", "w1 w2 groblnew w77", None]))
    assert low < 0.1 and high > 0.9 and none < 0.5


def test_near_copies_teach_once():
    base = [f"u{k}" for k in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(30)] + [" ".join(f"v{j}x{k}" for j in range(50)) for k in range(5)]
    words = [h for w, x in toxicity.split_words(pa.array(texts, pa.large_string())) for h in np.split(x, w.first[1:-1])]
    assert toxicity.singles(words).tolist() == [True] + [False] * 29 + [True] * 5


def license_base(text):
    w = brute.plain_words(text)
    at = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = registry.queries()["op7_license_scan"](spark, SF).collect()
    for r in got:
        assert tuple(r)[1:6] == license_base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in got) > 5


def test_license_spans():
    mit = license_scan.TEMPLATES["mit"][1]
    edited = mit.replace("free of charge", "gratis").replace("Software", "Program", 1)
    texts = ["intro words " + mit + " the end", edited, "MIT License, apache\nlicense", "the of and to the rights to use", None, "Licensed under CC BY-NC 4.0."]
    got = list(license_scan.Scanner().scan(pa.array(texts, pa.string())))
    assert got[0][2][0].label == "mit" and got[0][2][0].cover == 1 and got[0][2][0].start == 2
    assert got[1][2][0].label == "mit" and got[1][2][0].cover > 0.85
    assert sorted(got[2][1]) == [(0, "mit"), (2, "apache")] and not got[2][2]
    assert not got[3][1] and not got[3][2] and got[4] == (0, [], [])
    assert got[5][2][0].label == "cc-by-nc-4.0"


def license_spans(words, templates):
    """Spans by plain search: maximal pieces at all their places, chained without closing any chain early."""
    found = []
    for k in range(len(words)):
        for n in range(len(words) - k, license_scan.MIN_PIECE - 1, -1):
            part = words[k : k + n]
            at = [(w, i) for w, (_, t) in enumerate(templates) for i in range(len(t) - n + 1) if t[i : i + n] == part]
            if at:
                if not (k and any(words[k - 1 : k + n] == t[i : i + n + 1] for _, t in templates for i in range(len(t) - n))):
                    found += [(w, i, k, n) for w, i in at]
                break
    chains = []
    for w, at, text, n in sorted(found, key=lambda p: (p[2], p[0], p[1])):
        options = []
        for c in chains:
            skip = max(0, c[2] - text, c[3] - at)
            gaps = text + skip - c[2], at + skip - c[3], text - c[2]
            if c[0] == w and skip < n and max(gaps) <= license_scan.MAX_GAP:
                options.append((c[4] + n - skip, -c[1], c, skip))
        if options:
            _, _, c, skip = max(options, key=lambda o: o[:2])
            c[2:] = text + n, at + n, c[4] + n - skip
        else:
            chains.append([w, text, text + n, at + n, n])
    out = []
    for w, start, end, _, matched in chains:
        size = len(templates[w][1])
        if matched >= min(license_scan.MIN_WORDS, size) and (matched >= license_scan.MIN_COVER * size or matched >= license_scan.LONG_WORDS):
            out.append((-matched, start, w, end))
    taken, spans = set(), []
    for matched, start, w, end in sorted(out):
        if 2 * len(taken & {*range(start, end)}) <= end - start:
            taken |= {*range(start, end)}
            spans.append((templates[w][0], start, end, -matched))
    return spans


@pytest.mark.parametrize("seed", range(12))
def test_license_chains(seed):
    """Edited and mixed passages of templates with repeated sentences give the spans of plain search."""
    rng = random.Random(seed)
    some = lambda n: " ".join(f"w{rng.randrange(25)}" for _ in range(n))
    shared = some(9)
    templates = {"a": (f"{some(20)} {shared} {some(6)} {shared} {some(10)}",), "b": (f"{some(8)} {shared} {some(25)}", some(6)), "c": (some(40),)}
    flat = [(label, t.split()) for label in sorted(templates) for t in templates[label]]
    scanner = license_scan.Scanner(templates, {"w1 w2": "x"})
    for _ in range(12):
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(flat)[1]
            part = t[rng.randrange(3) : len(t) - rng.randrange(3)]
            words += some(rng.randrange(12)).split() + [f"x{rng.randrange(9)}" if rng.random() < 0.07 else w for w in part]
        (n, named, spans), = scanner.scan(pa.array([" ".join(words)]))
        assert n == len(words)
        assert [(s.label, s.start, s.end, s.matched) for s in spans] == license_spans(words, flat)


def test_licenses_tell_their_versions_apart():
    scanner = license_scan.Scanner()
    names = sorted(license_scan.TEMPLATES)
    texts = [license_scan.TEMPLATES[n][-1] for n in names]
    for name, text, (_, _, spans) in zip(names, texts, scanner.scan(pa.array(texts))):
        assert (spans[0].label, spans[0].cover) == (name, 1)
        assert {s.label for s in spans} <= {name, *[x for x in names if x.split("-")[0] == name.split("-")[0]]} or len(text) > 5000
    half = license_scan.TEMPLATES["bsd-3-clause"][0]
    (_, _, spans), = scanner.scan(pa.array([half[: len(half) // 2]]))
    assert spans[0].label.startswith("bsd") and spans[0].cover < 0.7


@pytest.mark.parametrize("notice", ["Released under the MIT License. ", "the GNU General Public License as published by the Free Software Foundation "])
def test_repeated_notices_take_linear_time(notice):
    import time

    began = time.monotonic()
    (n, named, spans), = license_scan.Scanner().scan(pa.array([notice * 100_000]))
    assert len(named) == 100_000
    assert time.monotonic() - began < 60


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=12), min_size=1, max_size=3))
def test_matching_statistics(text, sequences):
    auto = Automaton(sequences, 1)
    for end, (n, state) in enumerate(auto.statistics(text), 1):
        def inside(m):
            part = text[end - m : end]
            return [k for k, s in enumerate(sequences) if any(s[i : i + m] == part for i in range(len(s) - m + 1))]
        best = max(m for m in range(end + 1) if m == 0 or inside(m))
        assert n == best
        if n:
            part = text[end - n : end]
            where = [(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == part]
            assert sorted(auto.ends[state]) == where


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=14), st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_alignment(a, b):
    score, _ = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == brute.smith_waterman(a, b)


def test_leaks(spark):
    rng = random.Random(2)
    item = lambda n: " ".join(f"q{rng.randrange(5000)}" for _ in range(n))
    items = [(k, item(40)) for k in range(5)] + [(5, "two words"), (6, None), (7, "")]
    def edit(t, every):
        w = t.split()
        return " ".join("changed" if k % every == every - 1 else x for k, x in enumerate(w) if k % 13 != 5)
    docs = [
        (1, "x " * 30 + items[0][1].upper() + " y" * 20), (2, edit(items[1][1], 9)), (3, items[2][1] + " , " + items[3][1]),
        (4, item(300)), (5, None), (6, ""), (7, "some two words here"), (8, "two other words"), (9, " ".join(items[4][1].split()[:12])),
    ]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (3, 3), (7, 5)}
    assert (got[1, 0].share, got[1, 0].start_word, got[1, 0].end_word) == (1.0, 30, 70)
    assert 0.5 < got[2, 1].share < 1


def test_leaks_query(spark):
    items = {r.item_id: brute.plain_words(r.text) for r in table(spark, "benchmark").collect()}
    docs = {r.doc_id: brute.plain_words(r.text) for r in table(spark, "documents").collect()}
    got = {(r.doc_id, r.item_id): r.share for r in registry.queries()["op9_decontaminate"](spark, SF).collect()}
    def inside(a, b):
        return " " + " ".join(a) + " " in " " + " ".join(b) + " "
    whole = {(i, k) for i, d in docs.items() for k, w in items.items() if inside(w, d)}
    assert whole and whole == {p for p, s in got.items() if s == 1}
    rng = random.Random(1)
    others = [(i, k) for i in rng.sample(sorted(docs), 6) for k in rng.sample(sorted(items), 4)]
    for i, k in others:
        share = brute.smith_waterman(items[k], docs[i][:1500]) / (2 * len(items[k]))
        assert (share >= 0.5) <= ((i, k) in got)


def test_common_seeds_keep_widespread_items(spark):
    rng = random.Random(4)
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(30))
    docs = [(k, "of the and to " * 3 + (item if k % 3 == 0 else "")) for k in range(600)]
    items = [(1, item), (2, "of the and to " + " ".join(f"z{k}" for k in range(20)))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, 1) for k in range(0, 600, 3)]


def changed(rng, words, part):
    """The words with this part of them, evenly spread, replaced by words of no item."""
    return [f"new{rng.randrange(99)}" if int((k + 1) * part) > int(k * part) else w for k, w in enumerate(words)]


@pytest.mark.parametrize("part", [0.2, 0.25, 0.3])
def test_widespread_edited_copies(spark, part):
    """One edited copy in hundreds of documents, so that the seeds it keeps are the common ones."""
    rng = random.Random(6)
    item = [f"q{k}" for k in range(40)]
    copy = changed(rng, item, part)
    docs = [(k, f"start{k} " + " ".join(copy if k % 2 else item[:9]) + f" end{k}") for k in range(600)]
    items = [(1, " ".join(item))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    share = brute.smith_waterman(item, copy) / (2 * len(item))
    assert share >= 0.5
    assert sorted((r.doc_id, r.share) for r in got.collect()) == [(k, share) for k in range(1, 600, 2)]


def test_leaks_are_those_of_plain_alignment(spark, tmp_path):
    """Planted copies, one in a document and one in hundreds, in op9 and in the pipeline's stage."""
    rng = random.Random(8)
    common_words = "of the and to in a is that".split()

    def text(n):
        return [rng.choice(common_words) if rng.random() < 0.4 else f"v{rng.randrange(300)}" for _ in range(n)]

    items = {k: text(n) for k, n in enumerate((16, 24, 33, 40, 28))}
    spread = changed(rng, items[3], 0.25)
    docs = {k: text(20) + spread + text(10) if k % 2 else text(40) for k in range(400)}
    docs |= {1000 + k: text(30) + changed(rng, items[k % 5], 0.1 + 0.05 * (k // 5)) + text(30) for k in range(25)}
    docs |= {2000 + k: text(15) + [x for w in items[k] for x in (w, "added")] + text(15) for k in items}
    docs |= {3000 + k: text(15) + items[k][: len(items[k]) * 3 // 5] for k in items}
    docs[4000] = text(1600) + changed(rng, items[2], 0.2)
    shares = {(i, k): brute.smith_waterman(items[k], docs[i]) / (2 * len(items[k])) for i in docs for k in items}
    want = {p: s for p, s in shares.items() if s >= 0.5}
    sf = str(tmp_path)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.share for r in registry.queries()["op9_decontaminate"](spark, sf).collect()}
    assert len(want) > 220 and got == want
    left = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, table, sf).collect()}
    assert left == set(docs) - {i for i, _ in want}
