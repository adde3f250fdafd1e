"""Predicates of a request as Columns over a category's txt, tok and num."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.geo import EPSILON
from spindrift.functions.numeric import clean_number, is_number
from spindrift.functions.text import trimmed

ANY_FIELD = "anyfield"


class Op(Enum):
    ALL = "="
    ANY = "|="
    NONE = "!="
    LE = "<="
    LT = "<"
    GE = ">="
    GT = ">"


@dataclass(frozen=True)
class TextPredicate:
    """All, any or none of some keywords, in one field or any.  The empty keyword matches an empty field."""

    field: str
    op: Op
    keywords: tuple[str, ...]

    def column(self, text: list[str], number: list[str]) -> Column:
        """Terms have one space between them, so a keyword with a space on either side is looked for in the text.

        The fields are bound once: their cleaning is not evaluated again for each keyword.
        """
        zero = None
        for n in number if self.field == ANY_FIELD else [self.field] if self.field in number else []:
            z = F.col(f"num.{n}") == 0
            zero = z if zero is None else zero | z
        fields = text if self.field == ANY_FIELD else [] if self.field in number else [self.field]

        def test(joined: Column | None, empty: Column | None) -> Column:
            has = lambda k: F.lit(False) if joined is None else empty if k == "" else joined.contains(f" {k} ")
            each = [has(k) | zero if k == "" and zero is not None else has(k) for k in self.keywords]
            out = each[0]
            for c in each[1:]:
                out = out & c if self.op is Op.ALL else out | c
            return ~out if self.op is Op.NONE else out

        if not fields:
            return test(None, None)
        own = F.array(*(F.col(f"txt.{t}") for t in fields))
        bound = F.transform(F.array(own), lambda x: F.struct(F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" ")).alias("joined"), F.array_contains(x, "").alias("empty")))
        return F.exists(bound, lambda x: test(x["joined"], x["empty"]))


@dataclass(frozen=True)
class NumberPredicate:
    """A comparison with a number.  compat also tests the value as float32, as a coarse index would."""

    field: str
    op: Op
    value: float
    others: tuple[float, ...] = ()  # with Op.ANY

    def column(self, compat: bool = False) -> Column:
        c = F.col(self.field if self.field in ("lat", "lon") else f"num.{self.field}")
        exact = self._test(c, compat)
        if not compat or self.op is Op.NONE:
            return exact
        v = F.lit(self.value)
        coarse = c.cast("float").cast("double")
        return exact & (coarse == v if self.op is Op.ALL else self._test(coarse, True))

    def _test(self, c: Column, compat: bool) -> Column:
        v, real = F.lit(self.value), ~F.isnan(c)
        if self.op is Op.NONE:
            return (c != v) | F.isnan(c)
        if self.op is Op.ANY:
            if compat:
                return F.lit(False)
            out = F.abs(c - v) <= EPSILON
            for o in self.others:
                out = out | (F.abs(c - o) <= EPSILON)
            return real & out
        test = {Op.ALL: F.abs(c - v) <= EPSILON, Op.LE: c <= v, Op.LT: c < v, Op.GE: c >= v, Op.GT: c > v}[self.op]
        return real & test


@dataclass(frozen=True)
class TextRange:
    """A comparison of the whole cleaned field with a cleaned operand: as numbers if both are, else as strings."""

    field: str
    op: Op
    value: str

    def column(self) -> Column:
        v = F.lit(self.value)
        compare = {Op.LE: lambda a, b: a <= b, Op.LT: lambda a, b: a < b, Op.GE: lambda a, b: a >= b, Op.GT: lambda a, b: a > b}[self.op]
        s = F.col(f"txt.{self.field}")
        if not is_number(self.value):
            return compare(s, v)
        # Bound step by step, so that the text is cleaned once.
        n = F.transform(F.array(s), lambda x: clean_number(F.when(trimmed(x) == "", "0").otherwise(x)))
        both = F.transform(n, lambda x: F.struct(x.alias("n"), x.try_cast("double").alias("d")))
        return F.exists(both, lambda x: F.when(x["d"].isNotNull(), compare(x["d"], F.lit(float(self.value)))).otherwise(compare(x["n"], v)))


def conjunction(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out
