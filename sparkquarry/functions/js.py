"""Regular expressions of JavaScript as column expressions, and the same in DuckDB's SQL.

The rules of this library were written for JavaScript's expressions: there \\b, \\w and \\d know
ASCII only, \\s also knows the blanks of Unicode, and $ is the very end. Java's \\b knows Unicode,
its \\s ASCII only, and its $ also stands before a last line end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNICODE_SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JAVA_SPACE, _RE2_SPACE = r"\s" + _UNICODE_SPACE, r"\t\n\v\f\r " + _UNICODE_SPACE
_WORD = r"\w"  # ASCII in Java too, and quicker there than the same letters as ranges
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _translate(pattern: str, outside: dict[str, str], inside: dict[str, str]) -> str:
    """The pattern with its escapes, and unescaped single characters, replaced outside and inside of brackets."""
    out, at, bracket = [], 0, False
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(part)
        out.append((inside if bracket else outside).get(part, part))
        bracket = part == "[" or bracket and part != "]"
    return "".join(out)


def java(pattern: str) -> str:
    return _translate(pattern, {r"\s": f"[{_JAVA_SPACE}]", r"\b": _EDGE, "$": r"\z"}, {r"\s": _JAVA_SPACE, "[": r"\[", "&": r"\&"})


def re2(pattern: str) -> str:
    return _translate(pattern, {r"\s": f"[{_RE2_SPACE}]", r"\S": f"[^{_RE2_SPACE}]"}, {r"\s": _RE2_SPACE, r"\S": r"\x21-\x9F\x{A1}-\x{10FFFF}"})


def _col(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bound(of: Callable[..., Column]) -> Callable[..., Column]:
    """`of`, a function of columns, with these read before any `let` inside of it: in there Spark would take an alias
    of the same select for a column of that name."""

    @wraps(of)
    def call(*columns: Column) -> Column:
        return let(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(columns)]), lambda x: of(*[x[f"c{i}"] for i in range(len(columns))]))

    return call


def test(value: Column | str, pattern: str, flags: str = "i") -> Column:
    """Does the pattern match anywhere? Null is an empty text, here and below."""
    return F.regexp_like(_col(value), F.lit(_flags(flags) + java(pattern)))


def sub(value: Column | str, pattern: str, to: str, flags: str = "") -> Column:
    """Every match replaced; groups of the match are $1, $2, ..."""
    return F.regexp_replace(_col(value), _flags(flags) + java(pattern), to)


def first(value: Column | str, pattern: str, group: int = 0, flags: str = "i") -> Column:
    """The group of the first match, empty if nothing matches."""
    return F.regexp_extract(_col(value), _flags(flags) + java(pattern), group)


def every(value: Column | str, pattern: str, group: int = 0, flags: str = "i") -> Column:
    return F.regexp_extract_all(_col(value), F.lit(_flags(flags) + java(pattern)), F.lit(group))


def split(value: Column | str, pattern: str, flags: str = "") -> Column:
    return F.split(_col(value), _flags(flags) + java(pattern), -1)


def trim(value: Column | str) -> Column:
    return sub(value, r"^\s+|\s+$", "")


def clean(value: Column | str) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.btrim(sub(value, r"\s+", " "))  # no other blank is left to trim


def _flags(flags: str) -> str:
    return f"(?{flags})" if flags else ""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_test(value: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches(coalesce({value}, ''), {quoted(_flags(flags) + re2(pattern))})"


def sql_sub(value: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace(coalesce({value}, ''), {quoted(_flags(flags) + re2(pattern))}, {quoted(to)}, 'g')"


def sql_first(value: str, pattern: str, group: int = 0, flags: str = "i") -> str:
    return f"regexp_extract(coalesce({value}, ''), {quoted(_flags(flags) + re2(pattern))}, {group})"


def sql_every(value: str, pattern: str, group: int = 0, flags: str = "i") -> str:
    return f"regexp_extract_all(coalesce({value}, ''), {quoted(_flags(flags) + re2(pattern))}, {group})"


def sql_trim(value: str) -> str:
    return sql_sub(value, r"^\s+|\s+$", "")


def sql_clean(value: str) -> str:
    return sql_trim(sql_sub(value, r"\s+", " "))
