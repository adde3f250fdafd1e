"""Schemas declared by header files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass
class SchemaSpec:
    """Fields in order; which are text and which numbers; where latitude and longitude stand."""

    fields: list[str]
    text: list[str] = field(default_factory=list)
    number: list[str] = field(default_factory=list)
    latitude: str | None = None
    longitude: str | None = None
    last_line: str = ""

    def position(self, name: str) -> int:
        return self.fields.index(name) if name in self.fields else -1

    def struct(self) -> T.StructType:
        """The columns of a category of this schema."""
        out = [("record_id", T.LongType()), ("raw_line", T.StringType()), ("lat", T.DoubleType()), ("lon", T.DoubleType())]
        one = lambda names, kind: T.StructType([T.StructField(n, kind) for n in names])
        out += [("txt", one(self.text, T.StringType())), ("tok", one(self.text, T.ArrayType(T.StringType()))), ("num", one(self.number, T.DoubleType()))]
        return T.StructType([T.StructField(*x) for x in out])


def parse_header(text: str) -> SchemaSpec:
    """Lines after FIELD DEFINITIONS up to a line of "=": FIELD-n, the name and, after T:, the type.

    A field is text unless its type is number; the names latitude and longitude, in any case, are
    coordinates.  A header without either is an error.
    """
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith("FIELD DEFINITIONS"):
            break
    else:
        raise ValueError("no FIELD DEFINITIONS in the header")
    out = SchemaSpec([])
    for line in lines:
        if line == "=":
            break
        if not line.startswith("FIELD-"):
            continue
        parts = line.split("\t")
        if len(parts) < 2:
            raise ValueError(f"no field name: {line!r}")
        name = parts[1]
        kind = next((p[2:].strip().lower() for p in parts[2:] if p.startswith("T:")), "string")
        out.fields.append(name)
        if name.lower() == "latitude":
            out.latitude = name
        elif name.lower() == "longitude":
            out.longitude = name
        elif kind == "number":
            out.number.append(name)
        else:
            out.text.append(name)
    out.last_line = next(lines, "")
    if out.latitude is None or out.longitude is None:
        raise ValueError("the header names no latitude or no longitude")
    return out
