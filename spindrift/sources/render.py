"""Results as text: lines, header and footer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.schema import SchemaSpec

# The fields that a result adds to its category's, with their descriptions.
DERIVED = ("latitude", "longitude", "distance\tDistance", "compass_direction\tCompass direction:  N S W E NW SW SE NE", "offset\t")
NAMES = ("latitude", "longitude", "distance", "compass_direction", "offset")


def lines(result: DataFrame) -> DataFrame:
    """One tab-separated line for each hit: the record, latitude, longitude, metres, compass and an empty field."""
    return result.select(F.concat_ws("\t", "raw_line", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("metres").cast("string"), "compass", F.lit("")).alias("line"))


def header(text: str) -> list[str]:
    """A result's header from its category's: what stands before the definitions, the definitions as they are, the derived fields, numbered on."""
    lines_ = text.splitlines()
    first = next((k for k, line in enumerate(lines_) if line.startswith("FIELD")), len(lines_))
    end = next((k for k, line in enumerate(lines_) if k > first and line == "="), len(lines_))
    own = lines_[first + 1 : end]
    more = [f"FIELD-{len(own) + k}\t{d}" for k, d in enumerate(DERIVED, 1)]
    names = lines_[end + 1] if end + 1 < len(lines_) else ""
    return [*lines_[:first], *own, *more, "=", "\t".join([names, *NAMES]), "=="]


def declared(spec: SchemaSpec) -> str:
    """A category's header from its schema, for those that were not loaded from files."""
    kind = lambda n: "\tT:number" if n in spec.number else "\tT:string" if n in spec.text else ""
    return "\n".join(["FIELD DEFINITIONS", *(f"FIELD-{k}\t{n}{kind(n)}" for k, n in enumerate(spec.fields, 1)), "=", "\t".join(spec.fields)])


def footer(hits: int, chars: int, seconds: float, io: dict[str, int] | None = None, predicates: list[str] | None = None) -> list[str]:
    # The marks and words around the counts.
    out = ["===", f"STATS: {hits} records, {chars} characters.", f"TIME: elapsed {seconds:.6f} seconds, includes the disk access time for record retrieval.", "===="]
    if io:
        out += ["", "*IO*:", *(f"\t{k}: {n}" for k, n in io.items())]
    if predicates is not None:
        out += ["", "*XPRED*:", *(f"\t{p}" for p in predicates)]
    return out
