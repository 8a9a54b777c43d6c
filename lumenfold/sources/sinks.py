"""Sinks: results as JSON lines, CSV, Parquet or aligned text; pages in a stable envelope."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from lumenfold.operators.query import page


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    """A distributed write; grids and curves go out as json (lines) or csv with a header."""
    out = df.write.mode(mode).partitionBy(*partition_by)
    if form == "csv":
        out.option("header", True).csv(path)
    elif form in ("json", "jsonl"):
        out.json(path)
    elif form == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown format {form}")


def render(df: DataFrame, form: str = "json", limit: int = 10_000, offset: int = 0) -> str:
    """One page of a result as text, for people and tools: json envelope, csv or aligned columns."""
    got = page(df, limit, offset)
    if form == "json":
        return json.dumps(got, default=str)
    rows = [[("" if v is None else str(v)) for v in r.values()] for r in got["rows"]]
    if form == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
        return "\n".join(",".join(map(quote, r)) for r in [df.columns, *rows]) + "\n"
    widths = [max(len(r[i]) for r in [df.columns, *rows]) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *rows])
