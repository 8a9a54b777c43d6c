"""The star schema as a planning cube: scenario, month and market axes over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.model.schema import Dimension, Hierarchy, Measure, Model, ReferenceData, Rule
from lumenfold.operators.cube import Cube

#: Ship months of the schema's seven years, and the quarters and years above them.
YEARS = range(1995, 2002)
SCENARIOS = ("N", "R", "A")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def months(quarters: bool = True) -> Dimension:
    names = [f"{y}-{m:02d}" for y in YEARS for m in range(1, 13)]
    edges = [(f"{y}-Q{(m - 1) // 3 + 1}", f"{y}-{m:02d}", 1.0) for y in YEARS for m in range(1, 13)]
    edges += [(f"{y}", f"{y}-Q{q}", 1.0) for y in YEARS for q in range(1, 5)]
    above = [f"{y}-Q{q}" for y in YEARS for q in range(1, 5)] + [f"{y}" for y in YEARS]
    return Dimension("Time", names + (above if quarters else []), "Standard", [Hierarchy("Time", edges)] if quarters else [])


#: Nation number to region number is fixed metadata of the schema.
def market(spark: SparkSession, sf_dir: str) -> Dimension:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").orderBy("n_nationkey").collect()
    nations, regions = [r["n_name"] for r in rows], sorted({r["r_name"] for r in rows})
    edges = [(r["r_name"], r["n_name"], 1.0) for r in rows] + [("World", r, 1.0) for r in regions]
    return Dimension("Market", nations + regions + ["World"], "Standard", [Hierarchy("Market", edges)])


def leaf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by scenario, month and nation, in whole cents and percents so that no order of adding matters.

    Lines are joined with their orders and customers by key and folded by nation number; nations' names, one row each, are joined last.
    """
    line, orders, customer, nation = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent = lambda c: F.round(F.col(c) * 100).cast("long")
    sums = line.select("l_orderkey", F.col("l_returnflag").alias("Scenario"), F.date_format("l_shipdate", "yyyy-MM").alias("Time"), cents.alias("c"), F.col("l_quantity").cast("long").alias("q"), percent("l_discount").alias("d"), percent("l_tax").alias("x"))
    joined = sums.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = joined.groupBy("Scenario", "Time", "c_nationkey").agg(F.sum("c").alias("c"), F.sum("q").alias("q"), F.sum(F.col("c") * F.col("d")).alias("cd"), F.sum(F.col("c") * F.col("x")).alias("cx"), F.count("*").alias("n"), F.max("c").alias("top"))
    named = by.join(nation.select("n_nationkey", F.col("n_name").alias("Market")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        "Scenario", "Time", "Market", (F.col("c") / 100.0).alias("Gross"), F.col("q").cast("double").alias("Qty"), (F.col("cd") / (F.col("c") * 100.0)).alias("Disc"), (F.col("cx") / (F.col("c") * 100.0)).alias("Tax"), F.col("n").cast("double").alias("Lines"), (F.col("top") / 100.0).alias("Top")
    )


RULES = {
    "Revenue": "Gross * (1 - Disc)",
    "Price": "Gross / Qty",
    "Charge": "Revenue * (1 + Tax)",
}


def sales_cube(spark: SparkSession, sf_dir: str, rules: dict[str, str] | None = None, refs: ReferenceData | None = None, anchor: str | None = "1998-06", quarters: bool = True, scopes: dict[str, str] | None = None, facts: DataFrame | None = None) -> Cube:
    rules = RULES | (rules or {})
    scenario = Dimension("Scenario", list(SCENARIOS), "Scenario", scenario_meta={"N": "Default", "R": "NonDefault", "A": "NonDefault"})
    measures = [Measure("Gross"), Measure("Qty"), Measure("Disc", aggregation="WeightedAverage", weight="Gross"), Measure("Tax", aggregation="WeightedAverage", weight="Revenue"), Measure("Lines", aggregation="Min"), Measure("Top", aggregation="Max")]
    measures += [Measure("Price", "Derived", "WeightedAverage", "Qty") if n == "Price" else Measure(n, "Derived") for n in rules]
    model = Model("sales", [scenario, months(quarters), market(spark, sf_dir), Dimension("Measure", [], "Measure")], measures, [Rule(n, b, (scopes or {}).get(n, "AllLeaves")) for n, b in rules.items()], refs or ReferenceData(), anchor)
    return Cube(model, facts if facts is not None else leaf_facts(spark, sf_dir))


#: The leaf frame as SQL; `leaf` has a row for each coordinate that has facts.
LEAF_SQL = """
leaf AS (
  SELECT l_returnflag AS scenario, strftime(l_shipdate, '%Y-%m') AS month, n_name AS market, r_name AS region,
         sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0 AS gross, sum(l_quantity::BIGINT)::DOUBLE AS qty,
         sum(round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT)::DOUBLE / (sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE * 100.0) AS disc,
         sum(round(l_extendedprice * 100)::BIGINT * round(l_tax * 100)::BIGINT)::DOUBLE / (sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE * 100.0) AS tax,
         count(*)::DOUBLE AS lines, max(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0 AS top
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
calc AS (SELECT *, gross * (1.0 - disc) AS revenue, gross / qty AS price, gross * (1.0 - disc) * (1.0 + tax) AS charge FROM leaf)
"""

#: Every series over all months: (scenario, market) pairs that occur times 84 months, t from 0.
GRID_SQL = (
    LEAF_SQL
    + """,
months AS (SELECT strftime(d, '%Y-%m') AS month, row_number() OVER (ORDER BY d) - 1 AS t
           FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d)),
grid AS (
  SELECT s.scenario, s.market, s.region, m.month, m.t, c.gross, c.qty, c.disc, c.tax, c.lines, c.top, c.revenue, c.price, c.charge
  FROM (SELECT DISTINCT scenario, market, region FROM leaf) s CROSS JOIN months m
  LEFT JOIN calc c ON c.scenario = s.scenario AND c.market = s.market AND c.month = m.month)
"""
)
