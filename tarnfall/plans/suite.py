"""One query per operator and function, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tarnfall.functions import aggregates as A
from tarnfall.functions import predicates as P
from tarnfall.functions import values as V
from tarnfall.plans.query import Query


@dataclass(frozen=True)
class TableItem:
    table: str
    build: Callable[[Query], Query]
    sql: str


_DATE = V.Value(lambda df: df["o_orderdate"].cast("date"))
_SECOND = V.col("second", V.Value(lambda df: V.date_trunc("ts", "second").bind(df)))
_HOST = r"^https?://(?:www\.)?([^/]+)/.*$"

SUITE: dict[str, TableItem] = {
    "scan_project": TableItem(
        "nation", lambda q: q.select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation"
    ),
    "filter_ne_str": TableItem(
        "part",
        lambda q: q.filter(P.not_equal("p_type", "ECONOMY")).select("p_partkey", "p_brand"),
        "SELECT p_partkey, p_brand FROM part WHERE p_type <> 'ECONOMY'",
    ),
    "filter_range_date": TableItem(
        "orders",
        lambda q: q.select("o_orderkey", V.col("d", _DATE)).filter(
            P.greater_equal("d", "1997-01-01"), P.less_equal("d", "1997-03-31")
        ),
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) >= "
        "DATE '1997-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-03-31'",
    ),
    "compare_gt_lt_int": TableItem(
        "part",
        lambda q: q.filter(P.greater("p_size", 10), P.less("p_size", 20)).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20",
    ),
    "compare_ge_le_str": TableItem(
        "customer",
        lambda q: q.filter(P.greater_equal("c_mktsegment", "B"), P.less_equal("c_mktsegment", "H")).select(
            "c_custkey", "c_mktsegment"
        ),
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'B' AND c_mktsegment <= 'H'",
    ),
    "filter_stacked": TableItem(
        "lineitem",
        lambda q: q.filter(P.not_equal("l_linenumber", 1))
        .filter(P.equal("l_returnflag", "A"))
        .filter(P.in_("l_linenumber", [2, 6]))
        .select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 1 AND l_returnflag = 'A' "
        "AND l_linenumber IN (2, 6)",
    ),
    "in_after_and": TableItem(
        "lineitem",
        lambda q: q.filter(
            P.and_(P.equal("l_returnflag", "R"), P.in_("l_linenumber", [-1, 6]), P.equal("l_linestatus", "F"))
        ).global_agg(A.count()),
        "SELECT COUNT(*) AS c FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (-1, 6) "
        "AND l_linestatus = 'F'",
    ),
    "like_prefix_underscore": TableItem(
        "part",
        lambda q: q.filter(P.like("p_brand", "Brand#1_")).select("p_partkey", "p_brand"),
        "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'",
    ),
    "not_like": TableItem(
        "part",
        lambda q: q.filter(P.not_like("p_name", "%ring%")).select("p_partkey", "p_name"),
        "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%ring%'",
    ),
    "like_multiline": TableItem(
        "documents",
        lambda q: q.filter(P.like("text", "%est%")).global_agg(A.count()),
        "SELECT COUNT(*) AS c FROM documents WHERE text LIKE '%est%'",
    ),
    "global_count_filtered": TableItem(
        "lineitem",
        lambda q: q.filter(P.not_equal("l_linenumber", 1)).global_agg(A.count()),
        "SELECT COUNT(*) AS c FROM lineitem WHERE l_linenumber <> 1",
    ),
    "global_sum_filtered": TableItem(
        "lineitem",
        lambda q: q.filter(P.equal("l_returnflag", "R")).global_agg(
            A.sum_("l_linenumber", "s"), A.min_("l_linenumber", "mn"), A.max_("l_linenumber", "mx")
        ),
        "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_linenumber) AS mn, MAX(l_linenumber) AS mx "
        "FROM lineitem WHERE l_returnflag = 'R'",
    ),
    "avg_trunc": TableItem(
        "lineitem",
        lambda q: q.global_agg(A.avg_trunc("l_partkey", "a")),
        "SELECT CAST(SUM(l_partkey) // COUNT(*) AS BIGINT) AS a FROM lineitem",
    ),
    "avg_double": TableItem(
        "lineitem",
        lambda q: q.global_agg(A.avg("l_linenumber", "a")),
        "SELECT AVG(l_linenumber) AS a FROM lineitem",
    ),
    "group_count": TableItem(
        "lineitem",
        lambda q: q.group_by(["l_returnflag", "l_linestatus"], A.count()),
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "str_min_max": TableItem(
        "part",
        lambda q: q.group_by(["p_type"], A.str_min("p_name", "mn"), A.str_max("p_name", "mx")),
        "SELECT p_type, MIN(p_name) AS mn, MAX(p_name) AS mx FROM part GROUP BY p_type",
    ),
    "count_distinct_multi": TableItem(
        "lineitem",
        lambda q: q.group_by(["l_returnflag"], A.count_distinct("l_partkey", "p"), A.count_distinct("l_suppkey", "s")),
        "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS p, COUNT(DISTINCT l_suppkey) AS s FROM lineitem "
        "GROUP BY l_returnflag",
    ),
    "min_max_ts": TableItem(
        "events",
        lambda q: q.select("event_type", _SECOND).group_by(
            ["event_type"], A.min_("second", "mn"), A.max_("second", "mx")
        ),
        "SELECT event_type, MIN(date_trunc('second', ts)) AS mn, MAX(date_trunc('second', ts)) AS mx FROM events "
        "GROUP BY event_type",
    ),
    "having": TableItem(
        "lineitem",
        lambda q: q.group_by(["l_suppkey"], A.count()).having(P.greater("c", 600)),
        "SELECT l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600",
    ),
    "order_by_multi": TableItem(
        "supplier",
        lambda q: q.select("s_nationkey", "s_suppkey").order_by(("s_nationkey", "desc"), "s_suppkey"),
        "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey",
    ),
    "limit_offset": TableItem(
        "orders",
        lambda q: q.select("o_orderkey").order_by("o_orderkey").limit(7, 13),
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 13",
    ),
    "topk_offset": TableItem(
        "orders",
        lambda q: q.group_by(["o_custkey"], A.count()).top_k([("c", "desc"), "o_custkey"], 10, 5),
        "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10 OFFSET 5",
    ),
    "add_sub": TableItem(
        "orders",
        lambda q: q.select(V.col("p", V.add("o_orderkey", 5)), V.col("m", V.sub("o_orderkey", 3))),
        "SELECT o_orderkey + 5 AS p, o_orderkey - 3 AS m FROM orders",
    ),
    "date_add_days": TableItem(
        "orders",
        lambda q: q.select("o_orderkey", V.col("d", V.add(_DATE, 30))),
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS d FROM orders",
    ),
    "timestamp_add_seconds": TableItem(
        "events",
        lambda q: q.select("event_id", V.col("t", V.add("ts", 90))),
        "SELECT event_id, ts + INTERVAL 90 SECOND AS t FROM events",
    ),
    "extract_hms": TableItem(
        "events",
        lambda q: q.select(
            "event_id", *[V.col(u[0], V.extract("ts", u)) for u in ("hour", "minute", "second")]
        ),
        "SELECT event_id, CAST(EXTRACT(hour FROM ts) AS BIGINT) AS h, CAST(EXTRACT(minute FROM ts) AS BIGINT) AS m, "
        "CAST(EXTRACT(second FROM ts) AS BIGINT) AS s FROM events",
    ),
    "date_trunc_hour": TableItem(
        "events",
        lambda q: q.group_by([V.col("h", V.date_trunc("ts", "hour"))], A.count()),
        "SELECT date_trunc('hour', ts) AS h, COUNT(*) AS c FROM events GROUP BY date_trunc('hour', ts)",
    ),
    "str_len_bytes": TableItem(
        "documents",
        lambda q: q.group_by(["lang"], A.sum_(V.str_len("text"), "b")),
        "SELECT lang, CAST(SUM(STRLEN(text)) AS BIGINT) AS b FROM documents GROUP BY lang",
    ),
    "regexp_replace_host": TableItem(
        "pages",
        lambda q: q.select("page_id", V.col("host", V.regexp_replace("url", _HOST, r"\1"))),
        rf"SELECT page_id, regexp_replace(url, '{_HOST}', '\1', 'g') AS host FROM pages",
    ),
    "regexp_replace_all": TableItem(
        "part",
        lambda q: q.select("p_partkey", V.col("r", V.regexp_replace("p_name", "([aeiou])", r"<\1>"))),
        r"SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS r FROM part",
    ),
    "case_when": TableItem(
        "orders",
        lambda q: q.select(
            "o_orderkey",
            V.col(
                "k",
                V.case_when(
                    P.and_(P.equal("o_orderstatus", "F"), P.equal("o_orderpriority", "5-LOW")),
                    "o_orderpriority",
                    V.lit(""),
                ),
            ),
        ),
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN o_orderpriority "
        "ELSE '' END AS k FROM orders",
    ),
    "literal_group_key": TableItem(
        "customer",
        lambda q: q.group_by([V.col("one", V.lit(1)), "c_mktsegment"], A.count()),
        "SELECT CAST(1 AS BIGINT) AS one, c_mktsegment, COUNT(*) AS c FROM customer GROUP BY c_mktsegment",
    ),
}
