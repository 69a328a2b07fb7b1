"""Rewrite rules that mean the same in Java, RE2 and Python regular expressions.

A :class:`Chain` is an ordered list of replacements. It becomes one Spark
expression (evaluated in the JVM) or the same expression in SQL text for an
oracle engine. Only constructs with equal meaning in both engines are used:
explicit character classes, no look-around, no ``\\s``, ``\\w`` or ``\\b``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class body.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Word characters, as a class body.
W = r"\p{L}\p{N}_"
#: One narrated word.
WORD = rf"[{W}](?:[{W}'’-]*[{W}])?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Chain:
    steps: tuple[tuple[str, str], ...]

    def __add__(self, other: Chain) -> Chain:
        return Chain(self.steps + other.steps)

    def __call__(self, c: Column) -> Column:
        for pattern, new in self.steps:
            c = F.regexp_replace(c, F.lit(pattern), F.lit(new))
        return c

    def sql(self, x: str) -> str:
        for pattern, new in self.steps:
            x = f"regexp_replace({x}, {lit_sql(pattern)}, {lit_sql(re.sub(r'[$]([0-9])', r'\\\1', new))}, 'g')"
        return x


def chain(*steps: tuple[str, str]) -> Chain:
    return Chain(tuple(steps))


STRIP = chain((rf"^[{WS}]+|[{WS}]+$", ""))
SQUEEZE = chain((rf"[{WS}]+", " ")) + STRIP
