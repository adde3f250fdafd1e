"""Numbers and dates written as text."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import NULL, TRIM, trimmed

# How dates and numbers are written, and, below, what is taken off them.
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"
NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?$"


def date_code(c: Column) -> Column:
    """YYYY-MM-DD[ HH:MM[:SS]] to CYYMMDD; C is 2 from the year 2000 on and 1 before."""
    return F.concat(F.when(F.substring(c, 1, 4) >= "2000", "2").otherwise("1"), F.substring(c, 3, 2), F.substring(c, 6, 2), F.substring(c, 9, 2))


def clean_number(c: Column) -> Column:
    """The text of a number field: empty and _null are 0, dates are codes, other characters go."""
    s = trimmed(c)
    s = F.when(s.isNull() | (s == "") | (F.lower(s) == NULL), "0").otherwise(s)
    s = F.regexp_replace(s, "^[ +_]*0*", "")
    s = F.when((s == "") | (s.try_cast("float") == 0), "0").otherwise(s)
    s = F.when(s.rlike(DATE), date_code(s)).otherwise(s)
    return F.regexp_replace(s, r"[^0-9.\-]+", "")


def number(c: Column) -> Column:
    """The value of a number field, NaN if it has none."""
    return F.coalesce(clean_number(c).try_cast("double"), F.lit(float("nan")))


def clean_number_value(s: str) -> str:
    """clean_number of an operand."""
    s = re.sub(TRIM, "", s)
    s = "0" if s == "" or s.lower() == NULL else s
    s = re.sub("^[ +_]*0*", "", s)
    try:
        s = "0" if s == "" or float(s) == 0 else s
    except ValueError:
        pass
    if re.search(DATE, s):
        s = ("2" if s[:4] >= "2000" else "1") + s[2:4] + s[5:7] + s[8:10]
    return re.sub(r"[^0-9.\-]+", "", s)


def number_value(s: str) -> float:
    """number of an operand."""
    try:
        return float(clean_number_value(s))
    except ValueError:
        return math.nan


def is_number(s: str) -> bool:
    return re.search(NUMBER, s) is not None
