"""Categories made of others: a union with predicates that always hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.predicates import conjunction
from spindrift.plans.request import predicates


@dataclass
class MetaSpec:
    members: list[str]
    parameters: dict[str, list[str]]


def parse_properties(text: str) -> MetaSpec:
    """A property file: categories=a:b and parameters=field=value:field=value."""
    values: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            k, _, v = line.partition("=")
            values[k.strip()] = v.strip()
    if not values.get("categories"):
        raise ValueError("no categories")
    params: dict[str, list[str]] = {}
    for p in filter(None, values.get("parameters", "").split(":")):
        k, _, v = p.partition("=")
        params.setdefault(k, []).append(v)
    return MetaSpec(values["categories"].split(":"), params)


def _common(categories: list[DataFrame], column: str) -> list[str]:
    names = [n for n in categories[0].schema[column].dataType.names if n != "_none"]
    return [n for n in names if all(n in c.schema[column].dataType.names for c in categories)]


def union(members: dict[str, DataFrame], parameters: dict[str, list[str]] | None = None) -> DataFrame:
    """The members' records under their common fields, with member, and the fixed predicates applied."""
    frames = list(members.values())
    shared = {c: _common(frames, c) for c in ("txt", "tok", "num")}
    each = [
        d.select(F.lit(name).alias("member"), "record_id", "raw_line", "lat", "lon", *(F.struct(*(F.col(f"{c}.{n}") for n in ns)).alias(c) for c, ns in shared.items()))
        for name, d in members.items()
    ]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    if parameters:
        texts, numbers, ranges = predicates(parameters, shared["tok"], shared["num"])
        out = out.filter(conjunction([*(p.column() for p in numbers), *(p.column(shared["tok"], shared["num"]) for p in texts), *(r.column() for r in ranges)]))
    return out
