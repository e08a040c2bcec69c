"""Ordered rule tables over text: first match, all matches, sums. Tables are data; each gives a Column."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, value) in order of precedence.
Table = Sequence[tuple[str, object]]


_SPECIAL = "\\.+*?()[]{}|^$"


def _needed(pattern: str) -> list[tuple[list[str], str]] | None:
    """Of each alternative the words that a match must hold, and what is to be tried then ("" if one word is all); None if it isn't plain to see."""
    # flags, and escapes that stand for letters, are left to the pattern
    if re.search(r"\(\?[a-zA-Z-]|\\(?![sdwSDW]|[^a-zA-Z0-9])", pattern):
        return None
    out, word, runs, depth, start = [], "", [], 0, 0
    for i, x in enumerate(re.sub(r"\\.", "..", pattern, flags=re.DOTALL) + "|"):  # an escape is any signs here
        if depth == 0 and x == "|":
            words = [w for w in dict.fromkeys([*runs, word]) if w]
            if not words:
                return None
            out.append((words, pattern[start:i] if runs else ""))
            word, runs, start = "", [], i + 1
            continue
        depth += (x in "([{") - (x in ")]}")
        if x in _SPECIAL or depth:
            runs.append(word[:-1] if x in "*?{" else word)
            word = ""
        else:
            word += x
    return out if depth == 0 else None


def found(c: Column, pattern: str) -> Column:
    """Whether a pattern is found: an alternative's plain words are looked for first, and it is tried only where all of them stand."""
    needed = _needed(pattern)
    if needed is None:
        return c.rlike(pattern)
    tests = [functools.reduce(Column.__and__, [F.contains(c, F.lit(w)) for w in words] + ([c.rlike(rest)] if rest else [])) for words, rest in needed]
    return functools.reduce(Column.__or__, tests)


def once(c: Column, make: Callable[[Column], Column]) -> Column:
    """make(c), with `c` evaluated once however often it stands in the result, wherever the optimizer moves it."""
    return F.transform(F.array(c), make)[0]


def first(c: Column, table: Table, default: object = None) -> Column:
    """The value of the first pattern that is found."""
    return F.coalesce(*[F.when(found(c, pattern), F.lit(value)) for pattern, value in table], F.lit(default))


def value_of(c: Column, table: dict[str, object], default: object) -> Column:
    """A value by exact key."""
    return F.coalesce(*[F.when(c == key, F.lit(value)) for key, value in table.items()], F.lit(default))


def any_of(words: Sequence[str]) -> str:
    """A pattern that finds any of the words as they stand."""
    special = "\\.+*?()[]{}|^$"
    return "|".join("".join("\\" + x if x in special else x for x in w) for w in words)


def whole_word(keyword: str) -> str:
    """A pattern for a keyword: ASCII ones need other signs beside them, others may stand anywhere."""
    return rf"(?<![a-z0-9_])(?:{any_of([keyword.lower()])})(?![a-z0-9_])" if keyword.isascii() else any_of([keyword])
