"""The 43 analytics queries over ``hits``: a builder and an SQL text for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tarnfall.functions.aggregates import avg_trunc, count, count_distinct, max_, min_, sum_
from tarnfall.functions.predicates import (
    Predicate,
    and_,
    equal,
    greater,
    greater_equal,
    in_,
    less_equal,
    like,
    not_equal,
    not_like,
)
from tarnfall.functions.values import add, case_when, col, date_trunc, extract, lit, regexp_replace, str_len, sub
from tarnfall.plans.query import Query

HOST = r"^https?://(?:www\.)?([^/]+)/.*$"


@dataclass(frozen=True)
class Constants:
    """What the queries look for. The defaults are those of the published
    workload on its own table."""

    user: int = 435090932899640449
    url: str = "%google%"
    title: str = "%Google%"
    not_url: str = "%.google.%"
    least: int = 100000
    counter: int = 62
    days: tuple[str, str] = ("2013-07-01", "2013-07-31")
    minutes: tuple[str, str] = ("2013-07-14", "2013-07-15")
    sources: tuple[int, int] = (-1, 6)
    referer_hash: int = 3594120000172545465
    url_hash: int = 2868770270353813622
    #: Rows passed over by queries 38 to 42.
    offsets: tuple[int, int, int, int, int] = (1000, 1000, 100, 10000, 1000)


#: For the ``hits`` view over the synthetic tables.
SYNTHETIC = Constants(
    user=46, url="%example.com%", title="%Page%", not_url="%.example.net%", least=100, days=("2024-01-05", "2024-01-25"),
    minutes=("2024-01-05", "2024-01-25"), referer_hash=3, url_hash=4, offsets=(10, 10, 5, 5, 100),
)


@dataclass(frozen=True)
class Item:
    build: Callable[[Query], Query]
    sql: str


def _avg(x: str) -> str:
    return f"CAST(SUM({x}) // COUNT(*) AS BIGINT)"


def _count(*keys: str, where: tuple[Predicate, ...] = (), n: int = 10, offset: int = 0, alias: str = "c"):
    """GROUP BY keys, rows per group, the largest groups; ties by key."""

    def build(q: Query) -> Query:
        order = [(alias, "desc"), *keys]
        return q.filter(*where).group_by(list(keys), count(alias=alias)).top_k(order, n, offset)

    return build


def _users(*keys: str, where: tuple[Predicate, ...] = ()):
    def build(q: Query) -> Query:
        return q.filter(*where).group_by(list(keys), count_distinct("UserID", "u")).top_k([("u", "desc"), *keys], 10)

    return build


def _clicks(*keys: str, where: tuple[Predicate, ...] = ()):
    def build(q: Query) -> Query:
        aggs = count(), sum_("IsRefresh", "r"), avg_trunc("ResolutionWidth", "w")
        return q.filter(*where).group_by(list(keys), *aggs).top_k([("c", "desc"), *keys], 10)

    return build


_PHRASE = not_equal("SearchPhrase", "")
_VISIBLE = equal("IsRefresh", 0), equal("DontCountHits", 0)
_CLICKS_SQL = f"COUNT(*) AS c, CAST(SUM(IsRefresh) AS BIGINT) AS r, {_avg('ResolutionWidth')} AS w FROM hits"
_SRC = case_when(and_(equal("SearchEngineID", 0), equal("AdvEngineID", 0)), "Referer", lit(""))


def _q18(q: Query) -> Query:
    keys = "UserID", col("m", extract("EventTime", "minute")), "SearchPhrase"
    return q.group_by(keys, count()).top_k([("c", "desc"), "UserID", "m", "SearchPhrase"], 10)


def _q35(q: Query) -> Query:
    keys = ["ClientIP", *[col(f"ip{k}", sub("ClientIP", k)) for k in (1, 2, 3)]]
    return q.group_by(keys, count()).top_k([("c", "desc"), "ClientIP"], 10)


def workload(c: Constants) -> dict[int, Item]:
    """Query number -> builder and SQL."""
    first, last = c.days
    period = and_(equal("CounterID", c.counter), greater_equal("EventDate", first), less_equal("EventDate", last))
    period_sql = f"CounterID = {c.counter} AND EventDate >= DATE '{first}' AND EventDate <= DATE '{last}'"
    minutes = and_(equal("CounterID", c.counter), greater_equal("EventDate", c.minutes[0]), less_equal("EventDate", c.minutes[1]))
    minutes_sql = f"CounterID = {c.counter} AND EventDate >= DATE '{c.minutes[0]}' AND EventDate <= DATE '{c.minutes[1]}'"

    def q22(q: Query) -> Query:
        q = q.filter(like("Title", c.title), not_like("URL", c.not_url), _PHRASE)
        aggs = min_("URL", "url"), min_("Title", "title"), count(), count_distinct("UserID", "u")
        return q.group_by(["SearchPhrase"], *aggs).top_k([("c", "desc"), "SearchPhrase"], 10)

    def q27(q: Query) -> Query:
        q = q.filter(not_equal("URL", "")).group_by(["CounterID"], avg_trunc(str_len("URL"), "l"), count())
        return q.having(greater("c", c.least)).top_k([("l", "desc"), "CounterID"], 25)

    def q28(q: Query) -> Query:
        key = col("k", regexp_replace("Referer", HOST, r"\1"))
        aggs = avg_trunc(str_len("Referer"), "l"), count(), min_("Referer", "m")
        q = q.filter(not_equal("Referer", "")).group_by([key], *aggs)
        return q.having(greater("c", c.least)).top_k([("l", "desc"), "k"], 25)

    def q39(q: Query) -> Query:
        keys = ["TraficSourceID", "SearchEngineID", "AdvEngineID", col("Src", _SRC), col("Dst", col("URL"))]
        q = q.filter(period, equal("IsRefresh", 0)).group_by(keys, count(alias="PageViews"))
        return q.top_k([("PageViews", "desc"), *[k if isinstance(k, str) else k.name for k in keys]], 10, c.offsets[1])

    def q42(q: Query) -> Query:
        q = q.filter(minutes, *_VISIBLE).group_by([col("M", date_trunc("EventTime", "minute"))], count(alias="PageViews"))
        return q.top_k(["M"], 10, c.offsets[4])

    return {
        0: Item(lambda q: q.global_agg(count()), "SELECT COUNT(*) AS c FROM hits"),
        1: Item(
            lambda q: q.filter(not_equal("AdvEngineID", 0)).global_agg(count()),
            "SELECT COUNT(*) AS c FROM hits WHERE AdvEngineID <> 0",
        ),
        2: Item(
            lambda q: q.global_agg(sum_("AdvEngineID", "s"), count(), avg_trunc("ResolutionWidth", "a")),
            f"SELECT CAST(SUM(AdvEngineID) AS BIGINT) AS s, COUNT(*) AS c, {_avg('ResolutionWidth')} AS a FROM hits",
        ),
        3: Item(lambda q: q.global_agg(avg_trunc("UserID", "a")), f"SELECT {_avg('UserID')} AS a FROM hits"),
        4: Item(lambda q: q.global_agg(count_distinct("UserID", "u")), "SELECT COUNT(DISTINCT UserID) AS u FROM hits"),
        5: Item(
            lambda q: q.global_agg(count_distinct("SearchPhrase", "u")),
            "SELECT COUNT(DISTINCT SearchPhrase) AS u FROM hits",
        ),
        6: Item(
            lambda q: q.global_agg(min_("EventDate", "mn"), max_("EventDate", "mx")),
            "SELECT MIN(EventDate) AS mn, MAX(EventDate) AS mx FROM hits",
        ),
        7: Item(
            lambda q: q.filter(not_equal("AdvEngineID", 0))
            .group_by(["AdvEngineID"], count())
            .order_by(("c", "desc"), "AdvEngineID"),
            "SELECT AdvEngineID, COUNT(*) AS c FROM hits WHERE AdvEngineID <> 0 GROUP BY AdvEngineID "
            "ORDER BY c DESC, AdvEngineID",
        ),
        8: Item(
            _users("RegionID"),
            "SELECT RegionID, COUNT(DISTINCT UserID) AS u FROM hits GROUP BY RegionID ORDER BY u DESC, RegionID LIMIT 10",
        ),
        9: Item(
            lambda q: q.group_by(
                ["RegionID"],
                sum_("AdvEngineID", "s"),
                count(),
                avg_trunc("ResolutionWidth", "a"),
                count_distinct("UserID", "u"),
            ).top_k([("c", "desc"), "RegionID"], 10),
            f"SELECT RegionID, CAST(SUM(AdvEngineID) AS BIGINT) AS s, COUNT(*) AS c, {_avg('ResolutionWidth')} AS a, "
            "COUNT(DISTINCT UserID) AS u FROM hits GROUP BY RegionID ORDER BY c DESC, RegionID LIMIT 10",
        ),
        10: Item(
            _users("MobilePhoneModel", where=(not_equal("MobilePhoneModel", ""),)),
            "SELECT MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' "
            "GROUP BY MobilePhoneModel ORDER BY u DESC, MobilePhoneModel LIMIT 10",
        ),
        11: Item(
            _users("MobilePhone", "MobilePhoneModel", where=(not_equal("MobilePhoneModel", ""),)),
            "SELECT MobilePhone, MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' "
            "GROUP BY MobilePhone, MobilePhoneModel ORDER BY u DESC, MobilePhone, MobilePhoneModel LIMIT 10",
        ),
        12: Item(
            _count("SearchPhrase", where=(_PHRASE,)),
            "SELECT SearchPhrase, COUNT(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY SearchPhrase "
            "ORDER BY c DESC, SearchPhrase LIMIT 10",
        ),
        13: Item(
            _users("SearchPhrase", where=(_PHRASE,)),
            "SELECT SearchPhrase, COUNT(DISTINCT UserID) AS u FROM hits WHERE SearchPhrase <> '' GROUP BY SearchPhrase "
            "ORDER BY u DESC, SearchPhrase LIMIT 10",
        ),
        14: Item(
            _count("SearchEngineID", "SearchPhrase", where=(_PHRASE,)),
            "SELECT SearchEngineID, SearchPhrase, COUNT(*) AS c FROM hits WHERE SearchPhrase <> '' "
            "GROUP BY SearchEngineID, SearchPhrase ORDER BY c DESC, SearchEngineID, SearchPhrase LIMIT 10",
        ),
        15: Item(
            _count("UserID"), "SELECT UserID, COUNT(*) AS c FROM hits GROUP BY UserID ORDER BY c DESC, UserID LIMIT 10"
        ),
        16: Item(
            _count("UserID", "SearchPhrase"),
            "SELECT UserID, SearchPhrase, COUNT(*) AS c FROM hits GROUP BY UserID, SearchPhrase "
            "ORDER BY c DESC, UserID, SearchPhrase LIMIT 10",
        ),
        17: Item(
            lambda q: q.group_by(["UserID", "SearchPhrase"], count()).top_k(["UserID", "SearchPhrase"], 10),
            "SELECT UserID, SearchPhrase, COUNT(*) AS c FROM hits GROUP BY UserID, SearchPhrase "
            "ORDER BY UserID, SearchPhrase LIMIT 10",
        ),
        18: Item(
            _q18,
            "SELECT UserID, CAST(EXTRACT(minute FROM EventTime) AS BIGINT) AS m, SearchPhrase, COUNT(*) AS c FROM hits "
            "GROUP BY UserID, m, SearchPhrase ORDER BY c DESC, UserID, m, SearchPhrase LIMIT 10",
        ),
        19: Item(
            lambda q: q.filter(equal("UserID", c.user)).select("UserID"), f"SELECT UserID FROM hits WHERE UserID = {c.user}"
        ),
        20: Item(
            lambda q: q.filter(like("URL", c.url)).global_agg(count()),
            f"SELECT COUNT(*) AS c FROM hits WHERE URL LIKE '{c.url}'",
        ),
        21: Item(
            lambda q: q.filter(like("URL", c.url), _PHRASE)
            .group_by(["SearchPhrase"], min_("URL", "url"), count())
            .top_k([("c", "desc"), "SearchPhrase"], 10),
            f"SELECT SearchPhrase, MIN(URL) AS url, COUNT(*) AS c FROM hits WHERE URL LIKE '{c.url}' "
            "AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10",
        ),
        22: Item(
            q22,
            "SELECT SearchPhrase, MIN(URL) AS url, MIN(Title) AS title, COUNT(*) AS c, COUNT(DISTINCT UserID) AS u "
            f"FROM hits WHERE Title LIKE '{c.title}' AND URL NOT LIKE '{c.not_url}' AND SearchPhrase <> '' "
            "GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10",
        ),
        23: Item(
            lambda q: q.filter(like("URL", c.url)).top_k(["EventTime", "WatchID"], 10),
            f"SELECT * FROM hits WHERE URL LIKE '{c.url}' ORDER BY EventTime, WatchID LIMIT 10",
        ),
        24: Item(
            lambda q: q.filter(_PHRASE).top_k(["EventTime", "WatchID"], 10).select("SearchPhrase", "EventTime"),
            "SELECT SearchPhrase, EventTime FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime, WatchID LIMIT 10",
        ),
        25: Item(
            lambda q: q.filter(_PHRASE).select("SearchPhrase").top_k(["SearchPhrase"], 10),
            "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY SearchPhrase LIMIT 10",
        ),
        26: Item(
            lambda q: q.filter(_PHRASE).select("SearchPhrase", "EventTime").top_k(["EventTime", "SearchPhrase"], 10),
            "SELECT SearchPhrase, EventTime FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime, SearchPhrase LIMIT 10",
        ),
        27: Item(
            q27,
            f"SELECT CounterID, {_avg('STRLEN(URL)')} AS l, COUNT(*) AS c FROM hits WHERE URL <> '' GROUP BY CounterID "
            f"HAVING COUNT(*) > {c.least} ORDER BY l DESC, CounterID LIMIT 25",
        ),
        28: Item(
            q28,
            rf"SELECT regexp_replace(Referer, '{HOST}', '\1', 'g') AS k, {_avg('STRLEN(Referer)')} AS l, COUNT(*) AS c, "
            f"MIN(Referer) AS m FROM hits WHERE Referer <> '' GROUP BY k HAVING COUNT(*) > {c.least} "
            "ORDER BY l DESC, k LIMIT 25",
        ),
        29: Item(
            lambda q: q.global_agg(*[sum_(add("ResolutionWidth", k), f"s{k}") for k in range(90)]),
            "SELECT "
            + ", ".join(f"CAST(SUM(CAST(ResolutionWidth AS INT) + {k}) AS BIGINT) AS s{k}" for k in range(90))
            + " FROM hits",
        ),
        30: Item(
            _clicks("SearchEngineID", "ClientIP", where=(_PHRASE,)),
            f"SELECT SearchEngineID, ClientIP, {_CLICKS_SQL} WHERE SearchPhrase <> '' GROUP BY SearchEngineID, ClientIP "
            "ORDER BY c DESC, SearchEngineID, ClientIP LIMIT 10",
        ),
        31: Item(
            _clicks("WatchID", "ClientIP", where=(_PHRASE,)),
            f"SELECT WatchID, ClientIP, {_CLICKS_SQL} WHERE SearchPhrase <> '' GROUP BY WatchID, ClientIP "
            "ORDER BY c DESC, WatchID, ClientIP LIMIT 10",
        ),
        32: Item(
            _clicks("WatchID", "ClientIP"),
            f"SELECT WatchID, ClientIP, {_CLICKS_SQL} GROUP BY WatchID, ClientIP "
            "ORDER BY c DESC, WatchID, ClientIP LIMIT 10",
        ),
        33: Item(_count("URL"), "SELECT URL, COUNT(*) AS c FROM hits GROUP BY URL ORDER BY c DESC, URL LIMIT 10"),
        34: Item(
            lambda q: q.group_by([col("one", lit(1)), "URL"], count()).top_k([("c", "desc"), "URL"], 10),
            "SELECT CAST(1 AS BIGINT) AS one, URL, COUNT(*) AS c FROM hits GROUP BY URL ORDER BY c DESC, URL LIMIT 10",
        ),
        35: Item(
            _q35,
            "SELECT ClientIP, ClientIP - 1 AS ip1, ClientIP - 2 AS ip2, ClientIP - 3 AS ip3, COUNT(*) AS c FROM hits "
            "GROUP BY ClientIP ORDER BY c DESC, ClientIP LIMIT 10",
        ),
        36: Item(
            _count("URL", where=(period, *_VISIBLE, not_equal("URL", "")), alias="PageViews"),
            f"SELECT URL, COUNT(*) AS PageViews FROM hits WHERE {period_sql} AND IsRefresh = 0 AND DontCountHits = 0 "
            "AND URL <> '' GROUP BY URL ORDER BY PageViews DESC, URL LIMIT 10",
        ),
        37: Item(
            _count("Title", where=(period, *_VISIBLE, not_equal("Title", "")), alias="PageViews"),
            f"SELECT Title, COUNT(*) AS PageViews FROM hits WHERE {period_sql} AND IsRefresh = 0 AND DontCountHits = 0 "
            "AND Title <> '' GROUP BY Title ORDER BY PageViews DESC, Title LIMIT 10",
        ),
        38: Item(
            _count(
                "URL",
                where=(period, equal("IsRefresh", 0), not_equal("IsLink", 0), equal("IsDownload", 0)),
                offset=c.offsets[0],
                alias="PageViews",
            ),
            f"SELECT URL, COUNT(*) AS PageViews FROM hits WHERE {period_sql} AND IsRefresh = 0 AND IsLink <> 0 "
            f"AND IsDownload = 0 GROUP BY URL ORDER BY PageViews DESC, URL LIMIT 10 OFFSET {c.offsets[0]}",
        ),
        39: Item(
            q39,
            "SELECT TraficSourceID, SearchEngineID, AdvEngineID, CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 "
            f"THEN Referer ELSE '' END AS Src, URL AS Dst, COUNT(*) AS PageViews FROM hits WHERE {period_sql} "
            "AND IsRefresh = 0 GROUP BY TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst "
            f"ORDER BY PageViews DESC, TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst LIMIT 10 OFFSET {c.offsets[1]}",
        ),
        40: Item(
            _count(
                "URLHash",
                "EventDate",
                where=(period, equal("IsRefresh", 0), in_("TraficSourceID", list(c.sources)), equal("RefererHash", c.referer_hash)),
                offset=c.offsets[2],
                alias="PageViews",
            ),
            f"SELECT URLHash, EventDate, COUNT(*) AS PageViews FROM hits WHERE {period_sql} AND IsRefresh = 0 "
            f"AND TraficSourceID IN {c.sources} AND RefererHash = {c.referer_hash} GROUP BY URLHash, EventDate "
            f"ORDER BY PageViews DESC, URLHash, EventDate LIMIT 10 OFFSET {c.offsets[2]}",
        ),
        41: Item(
            _count(
                "WindowClientWidth",
                "WindowClientHeight",
                where=(period, *_VISIBLE, equal("URLHash", c.url_hash)),
                offset=c.offsets[3],
                alias="PageViews",
            ),
            f"SELECT WindowClientWidth, WindowClientHeight, COUNT(*) AS PageViews FROM hits WHERE {period_sql} "
            f"AND IsRefresh = 0 AND DontCountHits = 0 AND URLHash = {c.url_hash} GROUP BY WindowClientWidth, WindowClientHeight "
            f"ORDER BY PageViews DESC, WindowClientWidth, WindowClientHeight LIMIT 10 OFFSET {c.offsets[3]}",
        ),
        42: Item(
            q42,
            f"SELECT date_trunc('minute', EventTime) AS M, COUNT(*) AS PageViews FROM hits WHERE {minutes_sql} "
            f"AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY M ORDER BY M LIMIT 10 OFFSET {c.offsets[4]}",
        ),
    }


WORKLOAD = workload(SYNTHETIC)
