"""Value expressions.

An expression binds to a DataFrame when a query uses it, because date and
timestamp arithmetic depend on the operand's type; the result is an ordinary
Column, so Catalyst sees built-in functions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Bind = Callable[[DataFrame], Column]
INTEGERS = (T.ShortType, T.IntegerType, T.LongType)


class Value:
    """A named or anonymous expression over the columns of one table."""

    def __init__(self, bind: Bind, name: str | None = None, shift: tuple["Value", int] | None = None):
        self.bind = bind
        self.name = name
        #: (base, k) when the value is base + k; lets SUM use one pass for many k.
        self.shift = shift

    def column(self, df: DataFrame) -> Column:
        c = self.bind(df)
        return c.alias(self.name) if self.name else c

    def data_type(self, df: DataFrame) -> T.DataType:
        return df.select(self.bind(df)).schema[0].dataType


def value_of(x: "Value | str | int") -> Value:
    if isinstance(x, Value):
        return x
    return col(x) if isinstance(x, str) else lit(x)


def col(name: str, expr: Value | None = None) -> Value:
    """A column, or an expression under a name."""
    if expr is not None:
        return Value(expr.bind, name, expr.shift)
    return Value(lambda df: F.col(f"`{name}`"), name)


def lit(value: int | str) -> Value:
    """A constant; whole numbers are 64 bit wide."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"literals are integers or strings, not {value!r}")
    return Value(lambda df: F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value))


def _moved(left: Value | str, right: Value | int, sign: int) -> Value:
    left, amount = value_of(left), value_of(right)

    def bind(df: DataFrame) -> Column:
        kind, a, b = left.data_type(df), left.bind(df), amount.bind(df)
        if isinstance(kind, T.DateType):
            return F.date_add(a, (b * sign).cast("int"))
        if isinstance(kind, T.TimestampNTZType):
            return a + F.make_dt_interval(secs=(b * sign).cast("decimal(18,6)"))
        if isinstance(kind, INTEGERS) and isinstance(right, int) and abs(right) < 2**31:
            b = F.lit(right).cast("int")  # int16 and int32 widen to int32, int64 stays
        return a + b if sign > 0 else a - b

    return Value(bind, shift=(left, sign * right) if isinstance(right, int) else None)


def add(left: Value | str, right: Value | int) -> Value:
    """left + right; days for a date, seconds for a timestamp."""
    return _moved(left, right, 1)


def sub(left: Value | str, right: Value | int) -> Value:
    return _moved(left, right, -1)


_FIELDS = {"second": F.second, "minute": F.minute, "hour": F.hour}


def _field(unit: str) -> str:
    if unit not in _FIELDS:
        raise ValueError(f"unit must be one of {sorted(_FIELDS)}, not {unit!r}")
    return unit


def extract(expr: Value | str, unit: str) -> Value:
    """Second, minute or hour as bigint."""
    v, f = value_of(expr), _FIELDS[_field(unit)]
    return Value(lambda df: f(v.bind(df)).cast("bigint"))


def date_trunc(expr: Value | str, unit: str) -> Value:
    v = value_of(expr)
    _field(unit)
    return Value(lambda df: F.date_trunc(unit, v.bind(df)).cast("timestamp_ntz"))


def str_len(expr: Value | str) -> Value:
    """Length in bytes."""
    v = value_of(expr)
    return Value(lambda df: F.octet_length(v.bind(df)))


#: ASCII classes by name, as Java spells them.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}",
    "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def java_pattern(pattern: str) -> str:
    """Linear-time regex syntax as a Java pattern: '.' stops at newline only, an unescaped
    '$' outside a class means the very end of the text, groups may be named ``(?P<name>``,
    classes ``[:alpha:]``, and a leading ``(?U)`` makes quantifiers lazy by default.
    Look-around, back references, possessive quantifiers and ``\\C`` aren't part of it."""
    lazy = False
    if (m := re.match(r"\(\?([imsU]+)\)", pattern)) and "U" in m[1]:
        lazy, rest = True, m[1].replace("U", "")
        pattern = (f"(?{rest})" if rest else "") + pattern[m.end() :]
    out, in_class, names, k = [], False, 0, 0
    while k < len(pattern):
        c, rest = pattern[k], pattern[k:]
        if c == "\\":
            if rest.startswith(r"\Q"):
                end = rest.find(r"\E")
                end = len(rest) if end < 0 else end + 2
                out.append(rest[:end])
                k += end
                continue
            if rest[1:2] in "123456789C" and not in_class and rest[1:2]:
                raise ValueError(f"not supported in a pattern: {rest[:2]}")
            space = r"\t\n\f\r "
            if rest[1:2] == "s":
                out.append(space if in_class else f"[{space}]")
            elif rest[1:2] == "S" and not in_class:
                out.append(f"[^{space}]")
            else:
                out.append(rest[:2])
            k += 2
            continue
        if in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                if m[2] not in _POSIX:
                    raise ValueError(f"no such class: {m[0]}")
                name = _POSIX[m[2]]
                out.append(name.replace(r"\p", r"\P") if m[1] and "p" in name[:2] else name.upper() if m[1] else name)
                k += len(m[0])
                continue
            in_class = c != "]"
            out.append("\\" + c if c in "[&~" else c)  # no nested classes here
            k += 1
            continue
        if c == "[":
            in_class = True
            if m := re.match(r"\[\^?\]", rest):
                out.append(m[0][:-1] + "\\]")
                k += len(m[0])
            else:
                m = re.match(r"\[\^?", rest)
                out.append(m[0])
                k += len(m[0])
            continue
        if m := re.match(r"\(\?P?<(\w+)>", rest):
            names += 1
            out.append(f"(?<g{names}>")
            k += len(m[0])
            continue
        if re.match(r"\(\?(<?[=!]|>)", rest):
            raise ValueError(f"not supported in a pattern: {rest[:4]}")
        if m := re.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})([?+]?)", rest):
            if m[1] == "+":
                raise ValueError(f"not supported in a pattern: {m[0]}")
            plain = m[0][:-1] if m[1] else m[0]
            out.append(plain + ("?" if bool(m[1]) != lazy else ""))
            k += len(m[0])
            continue
        out.append(r"\z" if c == "$" else c)
        k += 1
    return "(?d)" + "".join(out)


def java_replacement(text: str) -> str:
    r"""``\1`` becomes ``$1``, ``\\`` a backslash; a literal ``$`` is escaped, as is a digit
    behind a group's number, which has one digit only."""

    def one(m: re.Match) -> str:
        if m[0] == "$":
            return r"\$"
        if m[1].isdigit():
            return "$" + m[1] + ("\\" + m[2] if m[2] else "")
        return "\\" + m[1] + m[2]

    return re.sub(r"\$|\\(.)([0-9]?)", one, text, flags=re.S)


def regexp_replace(expr: Value | str, pattern: str, replacement: str) -> Value:
    """Replaces every match."""
    v, p, r = value_of(expr), java_pattern(pattern), java_replacement(replacement)
    return Value(lambda df: F.regexp_replace(v.bind(df), F.lit(p), F.lit(r)))


def case_when(condition, then: Value | str, otherwise: Value | str) -> Value:
    """``condition`` is a predicate; a plain str is a column name."""
    a, b = value_of(then), value_of(otherwise)
    return Value(lambda df: F.when(condition.bind(df), a.bind(df)).otherwise(b.bind(df)))
