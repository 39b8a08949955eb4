"""Result output as comma-separated text."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def lines(df: DataFrame, quoted: bool = False) -> DataFrame:
    """The rows as text in a column ``line``, made where they are: for results too long
    for the driver, or to be written as files."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("string")
        c = F.coalesce(c, F.lit(""))
        if quoted:
            marked = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
            c = F.when(c.rlike('[,"\r\n]'), marked).otherwise(c)
        out.append(c)
    return df.select(F.concat_ws(",", *out).alias("line"))


def rows(df: DataFrame) -> Iterator[tuple]:
    """Result rows, one partition at a time on the driver."""
    return (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))


def write_raw(result: Iterable[tuple], out: TextIO, quoted: bool = False) -> int:
    """Lines without a header; raw mode neither quotes nor escapes. Returns the row count."""
    count = 0
    writer = csv.writer(out, lineterminator="\n") if quoted else None
    for row in result:
        cells = [cell(v) for v in row]
        if writer:
            writer.writerow(cells)
        else:
            out.write(",".join(cells) + "\n")
        count += 1
    return count
