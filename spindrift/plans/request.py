"""Requests: from URL parameters to typed predicates."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from spindrift.functions import numeric, text
from spindrift.operators.predicates import ANY_FIELD, NumberPredicate, Op, TextPredicate, TextRange

#: Miles that stand for no limit.
UNLIMITED = 999_999.0
#: The numfind that asks for every matching record.
EVERY = "all"
#: Seconds that a request may take unless it says otherwise.
TIMEOUT = 15.0
#: Names of the coordinates in number predicates, in any case.
COORDINATES = {"latitude": "lat", "longitude": "lon"}
OPTIONS = {"category", "x1", "y1", "x2", "y2", "d", "numfind", "timeout", "header", "discard_proximal_duplicates", "discard_approximate_locations", "_debug", "_iostats", "_xpred"}


class BadRequest(ValueError):
    pass


@dataclass
class SearchRequest:
    category: str
    lat: float
    lon: float
    k: int | None
    radius: float | None = None
    window: tuple[float, float, float, float] | None = None  # south, west, north, east
    texts: list[TextPredicate] = field(default_factory=list)
    numbers: list[NumberPredicate] = field(default_factory=list)
    ranges: list[TextRange] = field(default_factory=list)
    proximal: float = 0.0
    discard_approximate: bool = False
    compat: bool = False
    ignored: list[str] = field(default_factory=list)
    timeout: float | None = TIMEOUT  # None: no limit
    header: bool = False
    iostats: bool = False
    explained: bool = False

    def effective_radius(self) -> float | None:
        """Miles; in compat mode a window is also cut by the circle to its north-east corner."""
        if self.window and self.compat:
            south, west, north, east = self.window
            a, b = math.radians(self.lat), math.radians(north)
            c = math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(self.lon - east))
            return math.degrees(math.acos(max(-1.0, min(1.0, c)))) * 60 * 1.1515
        return None if self.radius is None or self.radius >= UNLIMITED else self.radius

    def explain(self) -> list[str]:
        """One line for each predicate."""
        out = [f"text {p.field} {p.op.value} {' '.join(p.keywords) or text.NULL}" for p in self.texts]
        out += [f"number {p.field} {p.op.value} {p.value:g}" for p in self.numbers]
        out += [f"range {p.field} {p.op.value} {p.value}" for p in self.ranges]
        if self.window:
            out.append("window south {:g} west {:g} north {:g} east {:g}".format(*self.window))
        if (r := self.effective_radius()) is not None:
            out.append(f"radius {r:g} miles")
        return out + [f"ignored {n}" for n in self.ignored]


def keywords(values: Iterable[str]) -> tuple[str, ...]:
    """Terms of the operands together; the empty term only if one of them is _null."""
    values = list(values)
    null = any(v.lower() == text.NULL for v in values)
    return tuple(dict.fromkeys(k for v in values for k in text.clean_text_value(v).split(" ") if k or null))


def _operator(name: str, values: list[str]) -> tuple[str, Op, list[str]]:
    """Field, operator and operands: "f<=v" arrives as name "f<" and value "v", "f<v" as name "f<v" without one."""
    for sign, wide, strict in (("<", Op.LE, Op.LT), (">", Op.GE, Op.GT)):
        at = name.find(sign)
        if at > 0:
            rest = name[at + 1 :]
            if rest:
                return name[:at], strict, [rest]
            if not values or any(v == "" for v in values):
                raise BadRequest(f"{name}= has no value")
            return name[:at], wide, values
    if name.endswith("|"):
        return name[:-1], Op.ANY, values
    if name.endswith("!"):
        return name[:-1], Op.NONE, values
    return name, Op.ALL, values


def predicates(params: dict[str, list[str]], text_fields: list[str], number_fields: list[str], ignored: list[str] | None = None):
    """(text, number and range predicates) of parameters; unknown names and unusable numbers go to ignored."""
    texts, numbers, ranges = [], [], []
    ignored = ignored if ignored is not None else []
    for name, values in params.items():
        base, op, operands = _operator(name, values)
        if base in (ANY_FIELD, *text_fields):
            if op in (Op.ALL, Op.ANY, Op.NONE):
                if words := keywords(operands):
                    texts.append(TextPredicate(base, op, words))
            elif base != ANY_FIELD:
                ranges += [TextRange(base, op, text.clean_text_value(v)) for v in operands]
            else:
                ignored.append(name)
        elif base in number_fields or base.lower() in COORDINATES:
            base = base if base in number_fields else COORDINATES[base.lower()]
            found = [numeric.number_value(v) for v in operands]
            if any(v == "" for v in operands):
                raise BadRequest(f"{name} has no value")
            if any(math.isnan(v) for v in found):
                ignored.append(name)
            found = [v for v in found if not math.isnan(v)]
            if op is Op.ANY and found:
                numbers.append(NumberPredicate(base, op, found[0], tuple(found[1:])))
            else:
                numbers += [NumberPredicate(base, op, v) for v in found]
        else:
            ignored.append(name)
    texts.sort(key=lambda p: p.op is not Op.ALL)
    return texts, numbers, ranges


def parse(query: str | dict, text_fields: list[str], number_fields: list[str], compat: bool = False) -> SearchRequest:
    """A request from a URL's query string or a dict of parameters."""
    pairs = parse_qsl(query, keep_blank_values=True) if isinstance(query, str) else [(k, v) for k, vs in query.items() for v in ([vs] if isinstance(vs, str) else vs)]
    params: dict[str, list[str]] = {}
    for k, v in pairs:
        params.setdefault(k, []).append(v)
    fields = {k: v for k, v in params.items() if k not in OPTIONS}
    option = {k: v[0] for k, v in params.items() if k in OPTIONS}

    def value(name: str, default: float | None = None) -> float | None:
        if name not in option or option[name] == "":
            return default
        try:
            out = float(option[name])
        except ValueError:
            raise BadRequest(f"{name} is not a number") from None
        if math.isnan(out):
            raise BadRequest(f"{name} is not a number")
        return out

    every = option.get("numfind") == EVERY
    x, y, k = value("x1"), value("y1"), None if every else value("numfind")
    if x is None or y is None or (k is None and not every):
        raise BadRequest("x1, y1 and numfind are required")
    if k is not None and (k < 0 or k != int(k)):
        raise BadRequest("numfind is not a whole number")
    yes = lambda name: option.get(name, "").lower() in ("y", "yes", "1", "true")
    timeout = None if yes("_debug") else value("timeout", TIMEOUT)
    window, lat, lon = None, y, x
    if "x2" in option or "y2" in option:
        x2, y2 = value("x2"), value("y2")
        if x2 is None or y2 is None:
            raise BadRequest("x2 and y2 come together")
        if x2 < x or y2 < y:
            raise BadRequest("the window's corners are in the wrong order")
        window, lat, lon = (y, x, y2, x2), (y + y2) / 2, (x + x2) / 2
    ignored: list[str] = []
    texts, numbers, ranges = predicates(fields, text_fields, number_fields, ignored)
    return SearchRequest(
        option.get("category", ""), lat, lon, None if k is None else int(k), value("d"), window, texts, numbers, ranges,
        value("discard_proximal_duplicates", 0.0), option.get("discard_approximate_locations") == "1", compat, ignored,
        timeout, option.get("header") == "1", yes("_iostats"), yes("_xpred"),
    )
