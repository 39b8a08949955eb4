"""Semantics of each operator, function and source on small inputs."""

import datetime as dt
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnfall import Query
from tarnfall.cli import main
from tarnfall.functions import aggregates as A
from tarnfall.functions import predicates as P
from tarnfall.functions import values as V
from tarnfall.plans.workload import Constants, workload
from tarnfall.session import shared_dir
from tarnfall.sources import sink, tables
from tarnfall.streaming import stream_convert
from tarnfall.types import format_schema, parse_schema


def rows(q):
    return [tuple(r) for r in (q.df if isinstance(q, Query) else q).collect()]


@pytest.fixture
def q(spark):
    return lambda data, schema: Query(spark.createDataFrame(data, schema).repartition(3))


def test_group_count_counts_rows(q):
    out = q([("a", 1)] * 3 + [("b", 1)] * 2 + [("c", 1)], "k string, v int").group_by(["k"], A.count())
    assert sorted(rows(out)) == [("a", 3), ("b", 2), ("c", 1)]


def test_aggregates_respect_filters(q):
    t = q([(v, v % 2) for v in range(1, 7)], "v int, keep int").filter(P.equal("keep", 1))
    out = t.global_agg(A.sum_("v", "s"), A.count_distinct("v", "d"), A.min_("v", "a"), A.max_("v", "b"))
    assert rows(out) == [(9, 3, 1, 5)]


def test_strings(q):
    data = ["", "a", "abc", "b", "é", "a.b", "a\\b", "x%y", "z" * 200, "go\nogle"]
    t = q([(s,) for s in data], "s string")
    assert rows(t.global_agg(A.str_min("s", "a"), A.str_max("s", "b"))) == [("", "é")]
    assert rows(t.filter(P.equal("s", "b"))) == [("b",)]
    assert rows(t.filter(P.equal("s", "z" * 200)).global_agg(A.count())) == [(1,)]
    assert rows(t.filter(P.like("s", "a\\b"))) == [("a\\b",)]
    assert rows(t.filter(P.like("s", "a.b"))) == [("a.b",)]
    assert rows(t.filter(P.like("s", "go%gle"))) == [("go\nogle",)]
    assert len(rows(t.filter(P.not_like("s", "%a%")))) == 6
    assert rows(t.filter(P.equal("s", "é")).select(V.col("n", V.str_len("s")))) == [(2,)]


def test_in_keeps_earlier_predicates(q):
    t = q([(1, 6), (2, 6), (1, 5), (1, -1)], "a int, b int")
    assert sorted(rows(t.filter(P.and_(P.equal("a", 1), P.in_("b", [-1, 6]))))) == [(1, -1), (1, 6)]
    assert sorted(rows(t.filter(P.equal("a", 1) & P.in_("b", [-1, 6])))) == [(1, -1), (1, 6)]


def test_stacked_filters_and_filter_above_limit(q):
    t = q([(v,) for v in range(1, 7)], "v int")
    assert sorted(rows(t.filter(P.greater("v", 2)).filter(P.less("v", 5)))) == [(3,), (4,)]
    assert rows(t.order_by("v").limit(2).filter(P.greater("v", 1))) == [(2,)]
    assert rows(t.top_k([("v", "desc")], 3).filter(P.less("v", 5))) == [(4,)]


def test_wide_sums(q):
    big = q([(2**63 - 1,), (2**63 - 3,)], "x bigint")
    assert rows(big.global_agg(A.avg_trunc("x", "a"))) == [(2**63 - 2,)]
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        rows(big.global_agg(A.sum_("x", "s")))
    low = q([(-(2**63),), (2**63 - 1,), (-5,)], "x bigint")
    assert rows(low.global_agg(A.sum_("x", "s"), A.avg_trunc("x", "a"))) == [(-6, -2)]
    neg = q([(-7,), (0,)], "x int")
    assert rows(neg.global_agg(A.sum_("x", "s"), A.avg_trunc("x", "a"), A.avg("x", "d"))) == [(-7, -3, -3.5)]
    assert rows(neg.global_agg(A.sum_(V.add("x", 4), "s"), A.sum_(V.sub("x", 1), "t"))) == [(1, -9)]


def test_empty_input(q):
    t = q([], "k string, v int")
    aggs = A.count(), A.sum_("v", "s"), A.min_("v", "m"), A.avg_trunc("v", "a"), A.count_distinct("v", "d")
    assert rows(t.global_agg(*aggs)) == [(0, None, None, None, 0)]
    assert rows(t.group_by(["k"], A.count()).having(P.greater("c", 0)).top_k(["k"], 3)) == []


def test_times_before_and_after_the_epoch(q):
    at = [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(1970, 1, 1), dt.datetime(2013, 7, 14, 10, 20, 30)]
    t = q([(x,) for x in at], "t timestamp_ntz")
    out = t.select("t", *[V.col(u, V.extract("t", u)) for u in ("hour", "minute", "second")]).order_by("t")
    assert [r[1:] for r in rows(out)] == [(23, 59, 59), (0, 0, 0), (10, 20, 30)]
    out = t.select(V.col("m", V.date_trunc("t", "minute")), V.col("h", V.date_trunc("t", "hour"))).order_by("m")
    assert rows(out)[0] == (dt.datetime(1969, 12, 31, 23, 59), dt.datetime(1969, 12, 31, 23))
    assert dict(out.df.dtypes) == {"m": "timestamp_ntz", "h": "timestamp_ntz"}
    assert rows(t.filter(P.equal("t", -1)).select(V.col("u", V.add("t", 61)))) == [(dt.datetime(1970, 1, 1, 0, 1),)]
    assert rows(t.filter(P.less("t", 0)).select(V.col("u", V.sub("t", 59)))) == [(dt.datetime(1969, 12, 31, 23, 59),)]
    with pytest.raises(ValueError):
        V.extract("t", "day")


def test_dates(q):
    t = q([(dt.date(2013, 7, k),) for k in range(1, 6)], "d date")
    day = (dt.date(2013, 7, 3) - dt.date(1970, 1, 1)).days
    assert rows(t.filter(P.equal("d", day)).select(V.col("e", V.add("d", 30)))) == [(dt.date(2013, 8, 2),)]
    assert len(rows(t.filter(P.in_("d", [day, day + 1])))) == 2
    assert rows(t.filter(P.less_equal("d", "2013-07-01"))) == [(dt.date(2013, 7, 1),)]


def test_case_regex_literals(q):
    t = q([("http://www.a.b/c", 1), ("x\n", 2), ("cost 5", 3)], "s string, n int")
    out = t.select("n", V.col("r", V.regexp_replace("s", r"^https?://(?:www\.)?([^/]+)/.*$", r"[\1$]"))).order_by("n")
    assert [r[1] for r in rows(out)] == ["[a.b$]", "x\n", "cost 5"]
    assert rows(t.filter(P.equal("n", 2)).select(V.col("r", V.regexp_replace("s", "x$", "y")))) == [("x\n",)]
    out = t.select(V.col("k", V.case_when(P.greater("n", 1), "s", V.lit("")))).df
    assert sorted(r[0] for r in out.collect()) == ["", "cost 5", "x\n"]
    one = t.select(V.col("one", V.lit(1))).df
    assert one.dtypes == [("one", "bigint")]


def test_topk_offset_and_errors(q):
    t = q([(f"k{v % 5}", v) for v in range(25)], "k string, v int")
    assert [r[1] for r in rows(t.top_k([("v", "desc")], 3, 5))] == [19, 18, 17]
    assert rows(t.top_k(["v"], 10, 30)) == []
    for bad in (lambda: t.limit(-1), lambda: t.top_k(["v"], 1, -1), lambda: t.order_by(("v", "up")), lambda: t.global_agg()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        t.global_agg(A.count(), A.sum_("v", "c"))


def test_topk_plan_and_pruning(spark):
    q = Query.scan(spark, "/root/testdata/sf0.001/lineitem.parquet")
    q = q.filter(P.equal("l_linenumber", 2)).group_by(["l_suppkey"], A.count()).top_k([("c", "desc")], 5, 2)
    plan = q.df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(l_linenumber,2)" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int>" in plan


def test_view(spark, q):
    q([(1, "a"), (2, "b")], "v int, s string").as_view("some_view")
    assert spark.sql("SELECT s FROM some_view WHERE v = 2").collect()[0][0] == "b"


SCHEMA = "a,int16\nb,int32\nc,int64\nd,string\ne,DATE\nf,TIMESTAMP"


def test_schema_file():
    schema = parse_schema(SCHEMA)
    assert [f.dataType.simpleString() for f in schema] == ["smallint", "int", "bigint", "string", "date", "timestamp_ntz"]
    assert parse_schema(format_schema(schema)) == schema
    for bad in ("a,float", "a,INT16", "a", "", "a,int16\na,int32"):
        with pytest.raises(ValueError):
            parse_schema(bad)


def test_convert_round_trip(spark, tmp_path):
    text = (
        '1,2,3,"ab""cd",2013-07-14,2013-07-14 10:20:30\n'
        '-2,4,5,"q,r",2013-07-15,1969-12-31 23:59:59\n'
        "3,4,5,,2013-07-15,2013-07-14 00:00:00\n"
        f'4,4,5,"{"l" * 20000}\nm",2013-07-15,2013-07-14 00:00:00'
    )
    data = tmp_path / "data.csv"
    data.write_text(text)
    crlf = tmp_path / "crlf.csv"
    crlf.write_bytes(b"1,a\r\n2,\r\n")
    got = tables.read_csv(spark, str(crlf), parse_schema("n,int16\ns,string")).collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "")]
    schema = parse_schema(SCHEMA)
    with pytest.raises(Exception):  # a line break needs the option
        tables.read_csv(spark, str(data), schema).collect()
    tables.convert(spark, schema, str(data), str(tmp_path / "out"), multi_line=True)
    got = {r.a: r for r in tables.scan(spark, str(tmp_path / "out")).collect()}
    assert (got[1].d, got[-2].d, got[3].d) == ('ab"cd', "q,r", "")
    assert got[4].d == "l" * 20000 + "\nm"
    assert got[1].f == dt.datetime(2013, 7, 14, 10, 20, 30)
    assert tables.scan(spark, str(tmp_path / "out"), []).count() == 4
    assert tables.scan(spark, str(tmp_path / "out"), ["b", "a"]).columns == ["b", "a"]


@pytest.mark.parametrize("line", ["x,2,3,d,2013-07-14,2013-07-14 10:20:30", "40000,2,3,d,2013-07-14,2013-07-14 10:20:30", "1,2,3", "1,2,3,d,2013-02-30,2013-07-14 10:20:30", ",2,3,d,2013-07-14,2013-07-14 10:20:30"])
def test_bad_rows_raise(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(line + "\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), parse_schema(SCHEMA)).collect()


def test_raw_and_quoted_output():
    data = [(1, "a,b", dt.date(2013, 7, 1), dt.datetime(2013, 7, 1, 2, 3, 4))]
    raw, quoted = io.StringIO(), io.StringIO()
    assert sink.write_raw(data, raw) == 1
    sink.write_raw(data, quoted, quoted=True)
    assert raw.getvalue() == "1,a,b,2013-07-01,2013-07-01 02:03:04\n"
    assert quoted.getvalue() == '1,"a,b",2013-07-01,2013-07-01 02:03:04\n'


def test_lines_are_those_of_the_writer(spark):
    data = [(1, 'a,b "c"', dt.date(2013, 7, 1), dt.datetime(2013, 7, 1, 2, 3, 4)), (None, "", None, None), (-3, "x\ny", None, None)]
    df = spark.createDataFrame(data, "n int, s string, d date, t timestamp_ntz")
    for quoted in (False, True):
        out = io.StringIO()
        sink.write_raw(data, out, quoted)
        assert "".join(r.line + "\n" for r in sink.lines(df, quoted).collect()) == out.getvalue()


def test_sums_beyond_four_billion_rows(spark):
    """Pieces of a row times 2^40 rows stay in 64 bits, and put the total together."""
    for v, kind in ((2**63 - 1, "bigint"), (-(2**63), "bigint"), (-1, "bigint"), (2**31 - 1, "int"), (-(2**31), "int"), (-7, "smallint")):
        df = spark.createDataFrame([(v,)], f"v {kind}")
        pieces = A._pieces(df["v"], df.schema[0].dataType)
        parts = df.select(*[c.cast("bigint") for c, _ in pieces]).first()
        merged = spark.createDataFrame([tuple(x * 2**40 for x in parts)], ", ".join(f"p{k} bigint" for k in range(len(parts))))
        total = merged.select(A._joined([(merged[f"p{k}"], power) for k, (_, power) in enumerate(pieces)])).first()[0]
        assert int(total) == v * 2**40


def test_average_of_large_values(q):
    big = 2**63 - 1
    t = q([(1, big)] * 5 + [(2, -big)] * 3 + [(3, 7)], "k int, v bigint")
    assert sorted(rows(t.group_by(["k"], A.avg_trunc("v", "a")))) == [(1, big), (2, -big), (3, 7)]


def test_command_line_queries_hold_the_published_constants(spark, tmp_path, capsys):
    assert main(["hits-schema"]) == 0
    schema = parse_schema(capsys.readouterr().out)
    assert len(schema) == 105 and schema["URLHash"].dataType.simpleString() == "bigint"
    sql = {k: x.sql for k, x in workload(Constants()).items()}
    assert "UserID = 435090932899640449" in sql[19] and "'%google%'" in sql[20] and "'%.google.%'" in sql[22]
    assert "> 100000" in sql[27] and "> 100000" in sql[28]
    for k in range(36, 42):
        assert "CounterID = 62 AND EventDate >= DATE '2013-07-01' AND EventDate <= DATE '2013-07-31'" in sql[k]
    assert "RefererHash = 3594120000172545465" in sql[40] and "URLHash = 2868770270353813622" in sql[41]
    assert "EventDate >= DATE '2013-07-14' AND EventDate <= DATE '2013-07-15'" in sql[42]
    assert [int(sql[k].rpartition(" ")[2]) for k in range(38, 43)] == [1000, 1000, 100, 10000, 1000]
    users = spark.createDataFrame([(435090932899640449,), (46,)], "UserID bigint")
    users.write.parquet(str(tmp_path / "users"))
    assert main(["run-query", "19", str(tmp_path / "users")]) == 0
    assert capsys.readouterr().out == "435090932899640449\n"


@pytest.mark.parametrize(
    "pattern, replacement, text, want",
    [
        (r"(?P<host_name>[^/]+)/.*$", r"<\1>", "a.b/c/d", "<a.b>"),
        (r"[[:alpha:]]+", "x", "ab12cd", "x12x"),
        (r"[^[:digit:]]", "", "a1-2", "12"),
        (r"[[:^alpha:]_]", "", "a1_b", "ab"),
        (r"(?U)a.*b", "x", "aabab", "xx"),
        (r"(?U)a.*?b", "x", "aabab", "x"),
        (r"\s", "_", "a b\x0bc", "a_b\x0bc"),
        (r"[&&b]", "x", "a&b", "axx"),
        (r"(a)", r"\10", "a", "a0"),
        (r"\Qa.b\E", "$", "a.b axb", "$ axb"),
        (r"a{2,}", "x", "aaab", "xb"),
    ],
)
def test_pattern_syntax(q, pattern, replacement, text, want):
    out = q([(text,)], "s string").select(V.col("r", V.regexp_replace("s", pattern, replacement)))
    assert rows(out) == [(want,)]


@pytest.mark.parametrize("pattern", [r"(a)\1", "a(?=b)", "a++", r"\C", "[[:nope:]]"])
def test_patterns_that_are_errors(pattern):
    with pytest.raises(ValueError):
        V.java_pattern(pattern)


def test_a_cluster_needs_a_shared_folder(spark):
    class Other:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("context", (), {"master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError):
        shared_dir(Other)
    assert shared_dir(spark).startswith("file:")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text("AdvEngineID,int16\nURL,string\n")
    (tmp_path / "d.csv").write_text("0,a\n3,b\n4,c\n")
    assert main(["convert", str(tmp_path / "s.csv"), str(tmp_path / "d.csv"), str(tmp_path / "t")]) == 0
    assert main(["run-query", "1", str(tmp_path / "t")]) == 0
    out = capsys.readouterr()
    assert out.out == "2\n" and "Time: " in out.err
    assert main(["run-query", "77", str(tmp_path / "t")]) == 2


def test_stream_convert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.csv").write_text("1,x\n2,\n")
    args = parse_schema("a,int32\nb,string"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    stream_convert(spark, *args, once=True).awaitTermination(60)
    (tmp_path / "in/two.csv").write_text("3,z\n")
    stream_convert(spark, *args, once=True).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "x"), (2, ""), (3, "z")]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    data=st.lists(st.tuples(st.integers(-3, 3), st.sampled_from(["", "a", "ab", "é"])), min_size=0, max_size=20),
    low=st.integers(-3, 3),
    word=st.sampled_from(["", "a", "ab"]),
)
def test_random_filters_and_groups(spark, data, low, word):
    t = Query(spark.createDataFrame(data, "v int, s string"))
    out = t.filter(P.greater_equal("v", low), P.not_equal("s", word)).group_by(["s"], A.count(), A.sum_("v", "t"))
    want = {}
    for v, s in data:
        if v >= low and s != word:
            c, total = want.get(s, (0, 0))
            want[s] = c + 1, total + v
    assert {r[0]: (r[1], r[2]) for r in rows(out)} == want
