"""Readers: inferred and strict CSV, JDBC, JSON documents, records, report files, ledgers."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.model.schema import ModelError

INFER_ROWS = 100


def _kind(values: list[str]) -> T.DataType:
    seen = [v for v in values if v not in (None, "")]

    def all_(parse) -> bool:
        try:
            for v in seen:
                parse(v)
        except ValueError:
            return False
        return bool(seen)

    return T.LongType() if all_(int) else T.DoubleType() if all_(float) else T.StringType()


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header. Types come from the first rows: whole numbers, numbers, text; empty is null; a later value of another type is an error when it is read."""
    raw = spark.read.option("header", True).csv(path)
    head = raw.limit(INFER_ROWS).collect()
    schema = T.StructType([T.StructField(c, _kind([r[c] for r in head])) for c in raw.columns])
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def strict_csv(spark: SparkSession, path: str, columns: list[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Exactly these columns in this order; no quotes, no byte order mark."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0]["value"] if first else ""
    if head.startswith("﻿"):
        raise ModelError("MC2024", "the file begins with a byte order mark")
    if head.split(",") != columns:
        raise ModelError("MC2024", f"the header is {head!r}, not {','.join(columns)!r}")
    schema = ", ".join(f"`{c}` {(types or {}).get(c, 'string')}" for c in columns)
    lines = spark.read.text(path)
    if lines.where(F.col("value").contains('"')).limit(1).count():
        raise ModelError("MC2023", "quotes are not accepted")
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A database query. With a column and bounds it is read in so many parts at once. The driver's jar is the deployment's matter."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()
    return reader.option("query", query).load()


def flattened(df: DataFrame) -> DataFrame:
    """The four types of cells: whole number, number, text, boolean; wider types become text, objects and lists JSON."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            out.append(c.cast("double").alias(f.name))
        elif isinstance(t, (T.StringType, T.BooleanType)):
            out.append(c)
        elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


#: Rows of a local database file that may pass through the driver.
DRIVER_ROWS = 5_000_000


def sqlite(spark: SparkSession, path: str, query: str, most: int = DRIVER_ROWS) -> DataFrame:
    """A local SQLite file, through the standard library, for results of driver size: more than `most` rows are an error. Use jdbc() for others."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(query)
        names = [c[0] for c in cursor.description]
        rows = cursor.fetchmany(most + 1)
    _bounded(len(rows), most)
    kinds = []
    for i in range(len(names)):
        seen = {type(r[i]) for r in rows if r[i] is not None}
        kinds.append("bigint" if seen <= {int} and seen else "double" if seen <= {int, float} and seen else "string")
    cast = {"bigint": int, "double": float, "string": str}
    data = [tuple(None if v is None else cast[k](v) for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def _bounded(rows: int, most: int) -> None:
    if rows > most:
        raise ModelError("MC5101", f"more than {most} rows for the driver; read them by jdbc()")


def duckdb(spark: SparkSession, path: str, query: str, most: int = DRIVER_ROWS) -> DataFrame:
    """A local DuckDB file (':memory:' for queries over files), handed over as Arrow; more than `most` rows are an error."""
    import duckdb as db

    with db.connect(path, read_only=path != ":memory:") as c:
        found = c.sql(f"SELECT * FROM ({query.strip().rstrip(';')}) LIMIT {most + 1}").to_arrow_table()
    _bounded(found.num_rows, most)
    return flattened(spark.createDataFrame(found))


def navigate(document: Column, path: str) -> Column:
    """The array at a dotted path of a JSON text, as an array of JSON texts."""
    inner = F.get_json_object(document, "$" + "".join(f".{p}" for p in path.split(".") if p))
    return F.from_json(inner, "array<string>")


def _json_fields(text: str) -> list[tuple[str, str]]:
    """Fields with types of an object's schema as text: OBJECT<a: BIGINT, b: OBJECT<...>>."""
    inner = text[text.index("<") + 1 : -1] if text.startswith("OBJECT<") else ""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(inner + ","):
        quoted ^= c == "`"
        depth += 0 if quoted else (c in "<(") - (c in ">)")
        if c == "," and not depth and not quoted:
            part, start = inner[start:i].strip(), i + 1
            cut = part.index("`: ") + 1 if part.startswith("`") else part.index(": ")
            if part:
                out.append((part[:cut].strip("`").replace("``", "`"), part[cut + 2 :]))
    return out


def json_documents(spark: SparkSession, documents: DataFrame, path: str, column: str = "value") -> DataFrame:
    """Rows of the arrays at a path of JSON texts, typed by all items together, nested values as JSON. Fields that any item has are columns; those of several types are text."""
    items = documents.select(F.explode(navigate(F.col(column), path)).alias("item"))
    seen = items.agg(F.schema_of_variant_agg(F.try_parse_json("item")), F.first("item")).first()
    fields = dict(_json_fields(seen[0])) if seen[1] is not None else {}
    if not fields:
        return spark.createDataFrame([], "value string")
    order = {k: i for i, k in enumerate(json.loads(seen[1]))}  # as the first item has them, then by name
    schema = T.StructType()
    for k in sorted(fields, key=lambda k: (order.get(k, len(order)), k)):
        kind = fields[k].partition("(")[0]
        schema.add(k, T.BooleanType() if kind == "BOOLEAN" else T.LongType() if kind == "BIGINT" else T.DoubleType() if kind in ("DOUBLE", "FLOAT", "DECIMAL") else T.StringType())
    return items.select(F.from_json("item", schema).alias("r")).select("r.*")


def http_json(spark: SparkSession, url: str, path: str, timeout: float = 30.0) -> DataFrame:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        text = answer.read().decode("utf-8")
    return json_documents(spark, spark.createDataFrame([(text,)], "value string"), path)


#: Canonical field of a replay record and the names that it goes by, in order of preference.
ALIASES = {
    "id": ("bet_id", "game_pk", "id"), "ts": ("timestamp", "commence_time", "ts", "date"), "p": ("p_bet_side", "p", "prob"),
    "odds": ("decimal_odds", "odds"), "outcome": ("outcome", "won", "result"),
}


def records(spark: SparkSession, path: str) -> DataFrame:
    """Replay records from Parquet or JSON lines, by extension, with canonical columns beside their own."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    return canonical(df)


def canonical(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    found = {k: next((a for a in names if a in have), None) for k, names in ALIASES.items()}
    missing = sorted(k for k, v in found.items() if v is None)
    if missing:
        raise ModelError("MC6201", f"records have no {', '.join(missing)}")
    return df.select(*[F.col(v).alias(f"r_{k}") for k, v in found.items()], *df.columns)


def window_of(df: DataFrame, window: str, ts: str = "ts") -> DataFrame:
    """all, first:n or range:a:b; an end that is only a date takes in its whole day."""
    if window == "all":
        return df
    kind, _, rest = window.partition(":")
    if kind == "first":
        return df.orderBy(ts).limit(int(rest))
    a, b = rest.split(":", 1) if rest.count(":") == 1 else rest.split("..", 1)
    end = f"{b} 23:59:59" if len(b) == 10 else b
    return df.where(F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(end).cast("timestamp")))


CANONICAL_HEADERS = {
    "link clicks": "Clicks", "link click": "Clicks", "clicks": "Clicks", "ctr(link click-through rate)": "CTR", "ctr (link click-through rate)": "CTR", "ctr(%)": "CTR", "ctr": "CTR",
    "vcr(%)": "VCR", "vcr": "VCR", "video views": "VideoViews", "100% completion": "Completions", "25% complete": "Complete25", "50% complete": "Complete50", "75% complete": "Complete75",
    "primary conversions": "Conversions", "conversions (default)": "Conversions", "total conversions": "Conversions", "primary conversions rate": "ConversionRate", "all conversions rate": "ConversionRate", "conversion rate": "ConversionRate",
    "all conversions": "AllConversions", "post engagements": "Engagements", "post engagement": "Engagements", "total leads": "Leads", "leads": "Leads", "interactions": "Interactions", "foot traffic visits": "FootTraffic", "foot traffic": "FootTraffic",
    "reach": "Reach", "frequency": "Frequency", "spend": "Spend", "cpm": "CPM", "cpc": "CPC", "cpa": "CPA", "cpl": "CPL", "cplc": "CPLC", "cpv": "CPV",
}
FORCED_TEXT = ("postal", "zip", "code", "dma", "fips")
SPECIFICITY = ((("city",), 10), (("zip", "postal"), 9), (("metro", "campaign", "ad set", "ad group", "creative", "keyword"), 8), (("device", "tactic", "placement"), 7), (("age", "gender"), 6), (("dma", "market"), 5), (("region", "state"), 3), (("date", "week", "month"), 2))


def header_name(raw: str) -> str:
    h = raw.strip().lower()
    if h in CANONICAL_HEADERS:
        return CANONICAL_HEADERS[h]
    return "_".join(filter(None, "".join(c if c.isalnum() else " " for c in raw).split()))


def specificity(header: str) -> int:
    h = header.strip().lower()
    return next((n for words, n in SPECIFICITY if any(w in h for w in words)), 1)


def report_number(c: Column) -> Column:
    """Thousands separators and percent signs are dropped; what is no number is null."""
    return F.regexp_replace(F.trim(c), r"[,%$]", "").try_cast("double")


def report_period(c: Column) -> Column:
    """MM-YYYY to Mon_YYYY."""
    return F.when(c.rlike(r"^\d{2}-\d{4}$"), F.concat(F.date_format(F.try_to_timestamp(c, F.lit("MM-yyyy")), "MMM"), F.lit("_"), F.substring(c, 4, 4))).otherwise(c)


def report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report as long cells (category, measure, value): the most specific text column is the category; columns in which every value of the file is a number are measures."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    given = lambda c: F.nullif(F.col(f"`{c}`"), F.lit("")).isNotNull()
    counts = raw.agg(*[F.count_if(given(c)).alias(f"n{i}") for i, c in enumerate(raw.columns)], *[F.count_if(given(c) & report_number(F.col(f"`{c}`")).isNull()).alias(f"b{i}") for i, c in enumerate(raw.columns)]).first()
    at = {c: i for i, c in enumerate(raw.columns)}

    def numeric(c: str) -> bool:
        return not any(w in c.lower() for w in FORCED_TEXT) and counts[f"n{at[c]}"] > 0 and counts[f"b{at[c]}"] == 0

    measures = [c for c in raw.columns if numeric(c)]
    texts = [c for c in raw.columns if c not in measures]
    if not texts or not measures:
        return spark.createDataFrame([], "category string, measure string, value double")
    category = max(texts, key=lambda c: (specificity(c), -raw.columns.index(c)))
    wide = raw.select(report_period(F.col(f"`{category}`")).alias("category"), *[report_number(F.col(f"`{c}`")).alias(header_name(c)) for c in measures])
    return wide.unpivot("category", [header_name(c) for c in measures], "measure", "value").where("value is not null")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
