"""Regular-expression idiom shared by all functions.

The engine's rules were specified with ASCII word edges and Unicode white space, while Java's ``\\b`` follows Unicode and its
``\\s`` is ASCII. ``rx`` rewrites a pattern accordingly, so texts with accents or no-break spaces give the specified result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "A-Za-z0-9_"
EDGE = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def rewritten(pattern: str, edge: str, space: str) -> str:
    """``pattern`` with ``\\b`` as ``edge`` and ``\\s`` as the characters ``space``, in or out of brackets."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[:1] == "\\" and len(two) == 2:
            out.append(edge if two == r"\b" else (space if in_class else f"[{space}]") if two == r"\s" else two)
            i += 2
            continue
        in_class = two[:1] == "[" or (in_class and two[:1] != "]")
        out.append(two[:1])
        i += 1
    return "".join(out)


def rx(pattern: str, ignore_case: bool = True) -> str:
    """``pattern`` with ``\\b`` as an ASCII word edge and ``\\s`` as any white space, in or out of brackets."""
    return ("(?i)" if ignore_case else "") + rewritten(pattern, EDGE, SPACE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it. Keeps nested expressions linear in size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column | str) -> Column:
    """The value as a string, null as the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def sub(c: Column, pattern: str, to: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, rx(pattern, ignore_case), to)


def has(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(rx(pattern, ignore_case))


def first(c: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The group of the first match; the empty string without a match."""
    return F.regexp_extract(c, rx(pattern, ignore_case), group)


def every(c: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, ignore_case)), F.lit(group))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def words(c: Column) -> Column:
    """The parts between white space, without empty ones."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def distinct_nocase(values: Column) -> Column:
    """The array's first occurrences, case aside, in order."""
    return let(values, lambda held: F.filter(held, lambda v, i: F.array_position(F.transform(held, F.lower), F.lower(v)) == i + 1))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves upward."""
    return F.floor(c + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal; null where there is nothing to count."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10)
