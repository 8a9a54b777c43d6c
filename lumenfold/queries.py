"""Registered queries, one or more for each row of the operator inventory, with the SQL that each must equal.

Names begin with the inventory's row ids. Sums of money are made of whole cents, and derived sums rounded to cents, so
that results don't depend on the order of adding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import formula
from lumenfold.functions.compiler import Compiler, Scope
from lumenfold.functions.report import Report, Typed, benchmark_columns
from lumenfold.model.schema import ReferenceData
from lumenfold.operators import grade as G
from lumenfold.operators import history as H
from lumenfold.operators import query as Q
from lumenfold.operators import records as Rec
from lumenfold.operators import replay as R
from lumenfold.operators import scenarios as X
from lumenfold.operators import writes as Wr
from lumenfold.operators.cube import closure_sql
from lumenfold.plans.sales import GRID_SQL, LEAF_SQL, sales_cube, table
from lumenfold.sources import ingest as I
from lumenfold.sources import readers as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ scalar language
BASE_SQL = """base AS (
  SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS a,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 11 - 5)::DOUBLE END AS b,
         (o_orderkey % 101)::DOUBLE / 100.0::DOUBLE AS p, (o_custkey % 50)::DOUBLE AS n FROM orders)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 11 - 5).cast("double")).alias("b"), ((F.col("o_orderkey") % 101).cast("double") / 100.0).alias("p"), (F.col("o_custkey") % 50).cast("double").alias("n"),
    )


REFS = ReferenceData(
    lookups={"weights": {"O": 1.5, "F": 2.5, "P": 0.5}, "pairs": {"O|3": 30.0, "F|4": 40.0, "P|5": 50.0}, "digits": {str(i): float(i * i) for i in range(40)}},
    benchmarks={"bench": {"O": 100000.0, "F": 120000.0}},
    thresholds={"bands": [50000.0, 150000.0, 300000.0, None]},
    parameters={"rate": 0.25},
    models={"lin": {"intercept": 0.5, "features": [{"name": "a", "coef": 1.5, "mean": 150000.0, "std": 80000.0}, {"name": "n", "coef": -0.1, "mean": 25.0, "std": 0.0}], "link": "logit", "bound": (0.05, 0.95)}},
    calibrations={"platt": {"platt": (-2.0, 0.5)}, "steps": {"points": [(0.1, 0.0), (0.5, 0.4), (0.9, 1.0)]}},
)


def formulas(name: str, rules: dict[str, tuple[str, str]], digits: int = 6) -> None:
    """A query that evaluates formulas over the base table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = base(spark, sf_dir)
        scope = Scope(["s"], "", {"a", "b", "p", "n"}, refs=REFS)
        for column, (text, _) in rules.items():
            frame = Compiler(frame, scope).assign(column, formula.parse(text))
        return frame.select("k", *[(F.round(c, digits) + 0.0).alias(c) for c in rules])

    columns = ",\n  ".join(f"round(({sql})::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c, (_, sql) in rules.items())
    query(name, f"WITH {BASE_SQL}\nSELECT k, {columns} FROM base")(run)


_ADD = "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + b END"
_SUB = "CASE WHEN a IS NULL THEN -b WHEN b IS NULL THEN a ELSE a - b END"
formulas("F01_F05_arithmetic", {
    "f_add": ("a + b", _ADD), "f_sub": ("a - b", _SUB), "f_mul": ("a * b", "a * b"), "f_div": ("a / b", "CASE WHEN abs(b) >= 1e-300 THEN a / b END"),
    "f_neg": ("-b", "coalesce(-b, 0)"), "f_mix": ("(a - b) * p + n", "coalesce(" + f"({_SUB}) * p, 0) + n"),
})
formulas("F06_F13_logic", {
    "f_gt": ("a > n * 5000", "CASE WHEN a > n * 5000 THEN 1.0 WHEN a <= n * 5000 THEN 0.0 END"), "f_ge": ("b >= 2", "CASE WHEN b >= 2 THEN 1 WHEN b < 2 THEN 0 END"),
    "f_eq": ("b == 3", "CASE WHEN abs(b - 3) < 1e-9 THEN 1 WHEN b IS NOT NULL THEN 0 END"), "f_ne": ("b != 3", "CASE WHEN abs(b - 3) < 1e-9 THEN 0 WHEN b IS NOT NULL THEN 1 END"),
    "f_text": ('current_element(s) == "O"', "CASE WHEN s = 'O' THEN 1 ELSE 0 END"), "f_and": ("a and b", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a <> 0 AND b <> 0)::INT END"),
    "f_or": ("p or b", "CASE WHEN p IS NOT NULL AND b IS NOT NULL THEN (p <> 0 OR b <> 0)::INT END"), "f_not": ("not b", "CASE WHEN b IS NOT NULL THEN (abs(b) < 1e-9)::INT END"),
    "f_if": ("if(b > 0, a, n)", "CASE WHEN b > 0 THEN a ELSE n END"), "f_ifs": ("ifs(b > 3, 3, b > 0, 1, 0 - 1)", "CASE WHEN b > 3 THEN 3 WHEN b > 0 THEN 1 ELSE -1 END"),
    "f_switch": ('switch(current_element(s), "O", 1, "F", 2, 9)', "CASE s WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 9 END"),
})
formulas("F14_F19_nulls", {
    "f_ifnull": ("if_null(a, 0 - 1)", "coalesce(a, -1)"), "f_coalesce": ("coalesce(a, b, n)", "coalesce(a, b, n)"), "f_min": ("min(a, b, n)", "least(a, b, n)"), "f_max": ("max(a, b, n)", "greatest(a, b, n)"),
    "f_abs": ("abs(b)", "abs(b)"), "f_safe": ("safe_div(a, b, 7)", "CASE WHEN a IS NOT NULL AND abs(b) >= 1e-300 THEN a / b ELSE 7 END"), "f_clamp": ("clamp(a, 1000, 100000 + b)", "CASE WHEN a IS NOT NULL THEN least(greatest(a, 1000), 100000 + coalesce(b, 0)) END"),
})
formulas("F20_F26_mathematics", {
    "f_exp": ("exp(b)", "exp(b)"), "f_over": ("exp(n * 40)", "CASE WHEN n * 40 < 709 THEN exp(least(n * 40, 700)) END"), "f_pow": ("pow(b, 2)", "pow(b, 2)"), "f_root": ("pow(b, 0.5)", "CASE WHEN b >= 0 THEN pow(greatest(b, 0), 0.5) END"),
    "f_sqrt": ("sqrt(b)", "CASE WHEN b >= 0 THEN sqrt(greatest(b, 0)) END"), "f_ln": ("ln(b)", "CASE WHEN b > 0 THEN ln(greatest(b, 1e-9)) END"), "f_log10": ("log10(n)", "CASE WHEN n > 0 THEN log10(greatest(n, 1e-9)) END"),
    "f_round": ("round(b / 2)", "round(b / 2)"), "f_floor": ("floor(b / 3)", "floor(b / 3)"), "f_ceil": ("ceil(b / 3)", "ceil(b / 3)"), "f_mod": ("mod(b, 0 - 3)", "((b::INT % 3) + 3) % 3"),
})
_Z = "((p * 6 - 3 - 0.5::DOUBLE) / 1.5::DOUBLE)"
_T = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({_Z})))"
_TAIL = f"(0.3989422804014327::DOUBLE * exp(-{_Z} * {_Z} / 2.0::DOUBLE) * {_T} * (0.3193815::DOUBLE + {_T} * (-0.3565638::DOUBLE + {_T} * (1.781478::DOUBLE + {_T} * (-1.8212560::DOUBLE + {_T} * 1.330274::DOUBLE)))))"
_WILSON = "(p + {z2} / (2.0::DOUBLE * n)) / (1.0::DOUBLE + {z2} / n) {sign} 1.959963984540054::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / n + {z2} / (4.0::DOUBLE * n * n)) / (1.0::DOUBLE + {z2} / n)"
_Z2 = "(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE)"
formulas("F27_F31_statistics", {
    "f_cdf": ("norm_cdf(p * 6 - 3, 0.5, 1.5)", f"CASE WHEN {_Z} > 0 THEN 1.0::DOUBLE - {_TAIL} ELSE {_TAIL} END"),
    "f_low": ("wilson_ci_lower(p, n)", f"CASE WHEN n > 0 THEN greatest(0, least(1, {_WILSON.format(z2=_Z2, sign='-')})) END"), "f_high": ("wilson_ci_upper(p, n)", f"CASE WHEN n > 0 THEN greatest(0, least(1, {_WILSON.format(z2=_Z2, sign='+')})) END"),
})
_Y = "(greatest(p, 0.001::DOUBLE) - 0.5::DOUBLE)"
_R = f"({_Y} * {_Y})"
_CENTRAL = f"{_Y} * (((-25.44106049637::DOUBLE * {_R} + 41.39119773534::DOUBLE) * {_R} + -18.61500062529::DOUBLE) * {_R} + 2.50662823884::DOUBLE) / ((((3.13082909833::DOUBLE * {_R} + -21.06224101826::DOUBLE) * {_R} + 23.08336743743::DOUBLE) * {_R} + -8.47351093090::DOUBLE) * {_R} + 1.0::DOUBLE)"
_FAR = "ln(-ln(greatest(least(p, 1.0::DOUBLE - p), 0.001::DOUBLE)))"
_SERIES = "0.0000003960315187::DOUBLE"
for _c in ("0.0000002888167364", "0.0000321767881768", "0.0003951896511919", "0.0038405729373609", "0.0276438810333863", "0.1607979714918209", "0.9761690190917186", "0.3374754822726147"):
    _SERIES = f"({_SERIES} * {_FAR} + {_c}::DOUBLE)"
formulas("F28_norm_inverse", {"f_inv": ("norm_inv(p, 2, 3)", f"CASE WHEN p > 0 AND p < 1 THEN 2 + 3 * (CASE WHEN abs(p - 0.5::DOUBLE) < 0.42 THEN {_CENTRAL} WHEN p < 0.5 THEN -{_SERIES} ELSE {_SERIES} END) END")})
formulas("F29_F30_negative_binomial", {
    "f_cdf": ("nbinom_cdf(mod(n, 4), p * 10, 0.5)", "CASE WHEN p > 0 THEN (SELECT sum(t) FROM (SELECT pow(1 / (1 + 5.0::DOUBLE * p), 2) * (i + 1) * pow(1 - 1 / (1 + 5.0::DOUBLE * p), i) AS t FROM range(0, (n::BIGINT % 4) + 1) r(i))) END"),
    "f_sf": ("nbinom_sf(mod(n, 4), p * 10, 0.5)", "CASE WHEN p > 0 THEN 1 - (SELECT sum(t) FROM (SELECT pow(1 / (1 + 5.0::DOUBLE * p), 2) * (i + 1) * pow(1 - 1 / (1 + 5.0::DOUBLE * p), i) AS t FROM range(0, (n::BIGINT % 4) + 1) r(i))) END"),
})
_LIN = "(0.5 + 1.5 * (a - 150000.0) / 80000.0 + -0.1 * n)"
formulas("F32_F36_models", {
    "f_predict": ('predict("lin", a, n)', f"CASE WHEN a IS NOT NULL THEN least(0.95, greatest(0.05, 1 / (1 + exp(-{_LIN})))) END"), "f_platt": ('calibrate(p, "platt")', "1 / (1 + exp(-2.0 * p + 0.5))"),
    "f_steps": ('calibrate(p, "steps")', "CASE WHEN p <= 0.1 THEN 0 WHEN p <= 0.5 THEN (p - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE) * 0.4::DOUBLE WHEN p <= 0.9 THEN 0.4::DOUBLE + (p - 0.5::DOUBLE) / (0.9::DOUBLE - 0.5::DOUBLE) * (1.0::DOUBLE - 0.4::DOUBLE) ELSE 1 END"),
    "f_param": ('a * param("rate")', "a * 0.25"),
})
formulas("F37_F39_elements", {"f_is": ('is_element(s, "F")', "(s = 'F')::INT"), "f_current": ('if(current_element(s) != "P", 1, 0)', "(s <> 'P')::INT"), "f_null": ("Null + a", "a"), "f_number": ("1.5e2", "150.0")})
formulas("J01_J03_reference_tables", {
    "j_lookup": ('lookup("weights", current_element(s))', "CASE s WHEN 'O' THEN 1.5 WHEN 'F' THEN 2.5 WHEN 'P' THEN 0.5 END"), "j_pair": ('lookup("pairs", current_element(s), b)', "CASE WHEN s = 'O' AND b = 3 THEN 30 WHEN s = 'F' AND b = 4 THEN 40 WHEN s = 'P' AND b = 5 THEN 50 END"),
    "j_number": ('lookup("digits", n)', "CASE WHEN n < 40 THEN n * n END"), "j_bench": ('benchmark("bench", current_element(s))', "CASE s WHEN 'O' THEN 100000 WHEN 'F' THEN 120000 END"),
    "j_bucket": ('bucket(a, "bands")', "CASE WHEN a IS NULL THEN NULL WHEN a <= 50000 THEN 0 WHEN a <= 150000 THEN 1 WHEN a <= 300000 THEN 2 ELSE 3 END"),
})


# ------------------------------------------------------------------ windows over time and dimensions
def grid_rules(name: str, rules: dict[str, tuple[str, str]], digits: int = 2, window: str = "", **options) -> None:
    """Rules over the sales cube, every series on all its months, and the SQL over the same grid."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cube = sales_cube(spark, sf_dir, {c: text for c, (text, _) in rules.items()}, quarters=False, **options)
        return cube.evaluate(list(rules), dense="time").select("Scenario", "Time", "Market", *[F.round(c, digits).alias(c) for c in rules])

    columns = ",\n  ".join(f"round(({sql})::DOUBLE, {digits}) AS {c}" for c, (_, sql) in rules.items())
    query(name, f'WITH {GRID_SQL}\nSELECT scenario AS "Scenario", month AS "Time", market AS "Market", {columns} FROM grid\nWINDOW w AS (PARTITION BY scenario, market ORDER BY t){window}')(run)


grid_rules("W01_W02_lag", {"w_prev": ("prev(Gross)", "lag(gross) OVER w"), "w_lag3": ("lag(Revenue, 3)", "lag(revenue, 3) OVER w"), "w_lead2": ("lag(Qty, 0 - 2)", "lead(qty, 2) OVER w")}, digits=4)
grid_rules("W02_varying_lag", {"w_vary": ("lag(Gross, mod(period_index(), 3))", "CASE t % 3 WHEN 0 THEN gross WHEN 1 THEN lag(gross, 1) OVER w ELSE lag(gross, 2) OVER w END")})
grid_rules("W03_cumulative", {"w_total": ("cumulative(Gross)", "sum(gross) OVER (PARTITION BY scenario, market ORDER BY t ROWS UNBOUNDED PRECEDING)")})
grid_rules("W04_rolling_avg", {"w_mean": ("rolling_avg(Gross, 3)", "avg(gross) OVER (PARTITION BY scenario, market ORDER BY t ROWS 2 PRECEDING)"), "w_none": ("rolling_avg(Gross, 0)", "NULL")}, digits=4)
grid_rules("W05_J07_last_value", {"w_last": ("extrapolate_last_value(Gross)", "last_value(gross IGNORE NULLS) OVER (PARTITION BY scenario, market ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")})
grid_rules("W06_W09_time_index", {
    "w_t": ("period_index()", "t"), "w_anchor": ("anchor_index()", "41"), "w_past": ("is_past()", "(t < 41)::INT"), "w_now": ("is_current()", "(t = 41)::INT"), "w_future": ("is_future()", "(t > 41)::INT"),
    "w_since": ("periods_since_anchor()", "t - 41"), "w_left": ("periods_to_end()", "83 - t"),
})
_STOCK = " + ".join(["gross"] + [f"{0.5**k}::DOUBLE * coalesce(lag(gross, {k}) OVER w, 0)" for k in (1, 2, 3)])
grid_rules("W10_F33_adstock", {
    "w_stock": ('predict("stock", Gross)', f"{_STOCK}"), "w_hill": ('predict("hill", Gross)', "100 * pow(gross, 1.5) / (pow(gross, 1.5) + pow(200000.0, 1.5))"), "w_log": ('predict("log", Gross)', "10 * ln(1 + gross / 1000.0)"),
}, refs=ReferenceData(models={
    "stock": {"features": [{"name": "x", "coef": 1.0, "adstock": {"rate": 0.5, "max_lookback": 3}}]}, "hill": {"features": [{"name": "x", "coef": 100.0, "saturation": {"kind": "hill", "half": 200000.0, "slope": 1.5}}]},
    "log": {"features": [{"name": "x", "coef": 10.0, "saturation": {"kind": "log", "scale": 1000.0}}]},
}), digits=5)
_ACROSS = "PARTITION BY scenario, month"
grid_rules("A06_A10_over_dimension", {
    "a_sum": ("sum_over(Gross, Market)", f"sum(gross) OVER ({_ACROSS})"), "a_avg": ("avg_over(Gross, Market)", f"avg(gross) OVER ({_ACROSS})"), "a_min": ("min_over(Gross, Market)", f"min(gross) OVER ({_ACROSS})"),
    "a_max": ("max_over(Gross, Market)", f"max(gross) OVER ({_ACROSS})"), "a_std": ("std_over(Qty, Market)", f"stddev_samp(qty) OVER ({_ACROSS})"), "a_var": ("var_over(Qty, Market)", f"var_samp(qty) OVER ({_ACROSS})"),
    "a_count": ("count_over(Gross, Market)", f"count(gross) OVER ({_ACROSS})"), "a_wavg": ("wavg_over(Price, Market, Qty)", f"sum(price * qty) OVER ({_ACROSS}) / sum(qty) OVER ({_ACROSS})"),
}, digits=6)
_SELF = "max(gross) FILTER (scenario = '{}') OVER (PARTITION BY market, month)"
grid_rules("J04_J06_scenarios", {
    "j_actual": ("actual_ref(Gross)", _SELF.format("N")), "j_fallback": ("actual_ref(Gross, Qty)", f"coalesce({_SELF.format('N')}, qty)"), "j_other": ('scenario_ref(Gross, "R")', _SELF.format("R")),
})
grid_rules("P08_rule_scopes", {"p_all": ("Gross * 2", "gross * 2"), "p_future": ("Gross * 2", "CASE WHEN t > 41 THEN gross * 2 END"), "p_past": ("Gross * 2", "CASE WHEN t < 41 THEN gross * 2 END"), "p_now": ("Gross * 2", "CASE WHEN t = 41 THEN gross * 2 END")}, scopes={"p_future": "FutureLeaves", "p_past": "PastLeaves", "p_now": "CurrentLeaf"})


# ------------------------------------------------------------------ consolidation, slices, reads
@query("A04_region_year_revenue", f"""WITH {LEAF_SQL}
SELECT region AS "Market", left(month, 4) AS "Time", round(sum(revenue), 4) AS "Revenue" FROM calc GROUP BY ALL""")  # fmt: skip
def region_year(spark, sf_dir):
    cube = sales_cube(spark, sf_dir)
    market = cube.model.dimension("Market")
    regions = [c for c, _ in market.hierarchy.children["World"]]
    years = [e for e in cube.model.time.elements if len(e) == 4]
    return cube.consolidate({"Market": regions, "Time": years}, ["Revenue"], by=()).select("Market", "Time", F.round("Revenue", 4).alias("Revenue"))


_ROLL = """round(sum(gross), 2) AS "Gross", round(sum(disc * gross) / sum(gross), 8) AS "Disc", round(sum(tax * revenue) / sum(revenue), 8) AS "Tax",
       round(sum(price * qty) / sum(qty) + 0.00000002::DOUBLE, 6) AS "Price", min(lines) AS "Lines", max(top) AS "Top" """


@query("A01_A03_consolidation", f"""WITH {LEAF_SQL}
SELECT scenario AS "Scenario", left(month, 4) || '-Q' || ((right(month, 2)::INT - 1) // 3 + 1) AS "Time", region AS "Market", {_ROLL} FROM calc GROUP BY ALL""")  # fmt: skip
def consolidation(spark, sf_dir):
    """A price of cents over pieces may lie midway between two roundings, where the order of adding decides: both sides add a little first."""
    cube = sales_cube(spark, sf_dir)
    regions = [c for c, _ in cube.model.dimension("Market").hierarchy.children["World"]]
    quarters = [e for e in cube.model.time.elements if "Q" in e]
    out = cube.consolidate({"Time": quarters, "Market": regions}, ["Gross", "Disc", "Tax", "Price", "Lines", "Top"])
    return out.select("Scenario", "Time", "Market", F.round("Gross", 2).alias("Gross"), F.round("Disc", 8).alias("Disc"), F.round("Tax", 8).alias("Tax"), F.round(F.col("Price") + 0.00000002, 6).alias("Price"), "Lines", "Top")


@query("A05_J08_all_levels", f"""WITH {LEAF_SQL},
up AS (SELECT market AS leaf, unnest([market, region, 'World']) AS m FROM (SELECT DISTINCT market, region FROM leaf)),
tt AS (SELECT month AS leaf, unnest([month, left(month, 4) || '-Q' || ((right(month, 2)::INT - 1) // 3 + 1), left(month, 4)]) AS t FROM (SELECT DISTINCT month FROM leaf))
SELECT scenario AS "Scenario", t AS "Time", m AS "Market", round(sum(revenue), 4) AS "Revenue" FROM calc JOIN up ON up.leaf = market JOIN tt ON tt.leaf = month GROUP BY ALL""")  # fmt: skip
def all_levels(spark, sf_dir):
    cube = sales_cube(spark, sf_dir)
    return cube.consolidate({"Time": None, "Market": None}, ["Revenue"]).select("Scenario", "Time", "Market", F.round("Revenue", 4).alias("Revenue"))


@query("J08_recursive_closure", """WITH RECURSIVE e AS (SELECT r_name AS p, n_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'World', r_name FROM region)
SELECT a AS ancestor, l AS leaf, 1.0::DOUBLE AS weight FROM (SELECT p AS a, c AS l FROM e WHERE p <> 'World' UNION ALL SELECT 'World', n_name FROM nation UNION ALL SELECT n_name, n_name FROM nation)""")  # fmt: skip
def recursive_closure(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = pairs.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1.0).alias("weight"))
    top = table(spark, sf_dir, "region").select(F.lit("World").alias("parent"), F.col("r_name").alias("child"), F.lit(1.0).alias("weight"))
    return closure_sql(spark, edges.unionByName(top))


@query("P01_P04_point_reads", f"""WITH {LEAF_SQL}
SELECT (SELECT round(sum(gross), 2) FROM calc WHERE scenario = 'N' AND month = '1998-03' AND market = 'NATION_8') AS leaf_input,
       (SELECT round(sum(revenue), 4) FROM calc WHERE scenario = 'R' AND left(month, 4) = '1996' AND region = 'ASIA') AS consolidated,
       (SELECT round(sum(disc * gross) / sum(gross), 8) FROM calc WHERE scenario = 'A' AND left(month, 4) = '1995') AS average""")  # fmt: skip
def point_reads(spark, sf_dir):
    cells = {
        "leaf_input": {"Scenario": "N", "Time": "1998-03", "Market": "NATION_8", "Measure": "Gross"}, "consolidated": {"Scenario": "R", "Time": "1996", "Market": "ASIA", "Measure": "Revenue"},
        "average": {"Scenario": "A", "Time": "1995", "Market": "World", "Measure": "Disc"},
    }
    out = sales_cube(spark, sf_dir).reads(cells)
    return out.select(F.round("leaf_input", 2).alias("leaf_input"), F.round("consolidated", 4).alias("consolidated"), F.round("average", 8).alias("average"))


@query("P02_slice", f"""WITH {LEAF_SQL},
markets AS (SELECT n_name AS m, n_name AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' UNION ALL SELECT 'EUROPE', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
times AS (SELECT unnest(['1997-Q1', '1997-Q2']) AS q), grid AS (SELECT s AS scenario, q, m FROM (SELECT unnest(['N', 'R', 'A']) AS s), times, (SELECT DISTINCT m FROM markets)),
val AS (SELECT scenario, left(month, 4) || '-Q' || ((right(month, 2)::INT - 1) // 3 + 1) AS q, m, sum(revenue) AS v FROM calc JOIN markets ON leaf = market GROUP BY ALL)
SELECT g.scenario AS "Scenario", g.q AS "Time", g.m AS "Market", round(v, 4) AS "Revenue" FROM grid g LEFT JOIN val USING (scenario, q, m)""")  # fmt: skip
def slice_(spark, sf_dir):
    out = sales_cube(spark, sf_dir).slice({"Time": ["1997-Q1", "1997-Q2"], "Market": ("subtree", "EUROPE")}, ["Revenue"])
    return out.select("Scenario", "Time", "Market", F.round("Revenue", 4).alias("Revenue"))


@query("S14_J09_leaf_grid", """SELECT s AS "Scenario", strftime(d, '%Y-%m') AS "Time", n_name AS "Market" FROM (SELECT unnest(['N', 'R', 'A']) AS s),
(SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d), nation""")  # fmt: skip
def leaf_grid(spark, sf_dir):
    return sales_cube(spark, sf_dir).leaf_grid()


@query("P07_derived_rules", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", revenue AS "Revenue", price AS "Price", charge AS "Charge" FROM calc""")
def derived(spark, sf_dir):
    return sales_cube(spark, sf_dir).evaluate(["Revenue", "Price", "Charge"]).select("Scenario", "Time", "Market", "Revenue", "Price", "Charge")


@query("P09_indicator", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", (market = 'NATION_8')::INT::DOUBLE AS "Is_China" FROM leaf""")
def indicator(spark, sf_dir):
    from lumenfold.model.schema import Measure

    cube = sales_cube(spark, sf_dir)
    cube.model.measures.append(Measure("Is_China", "Indicator", indicator=("Market", "NATION_8")))
    return cube.leaf("none").select("Scenario", "Time", "Market", "Is_China")


# ------------------------------------------------------------------ the query verb
@query("P03_P05_where", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", revenue AS "Revenue" FROM calc
WHERE (gross >= 300000 OR abs(gross - 300000) < 1e-9) AND NOT scenario = 'A' OR market = 'NATION_8' AND disc < 0.04""")  # fmt: skip
def where_simple(spark, sf_dir):
    out = Q.select(sales_cube(spark, sf_dir), ["Revenue"], 'Gross >= 300000 and not Scenario == "A" or Market == "NATION_8" and Disc < 0.04', limit=None, dense="none")
    return out


@query("P06_where_formula", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", price AS "Price" FROM calc
WHERE sqrt(gross) > 600 AND CASE WHEN market IN ('NATION_8', 'NATION_9') THEN 1 ELSE 0 END = 0""")  # fmt: skip
def where_formula(spark, sf_dir):
    out = Q.select(sales_cube(spark, sf_dir), ["Price"], 'sqrt(Gross) > 600 and not (is_element(Market, "NATION_8") or is_element(Market, "NATION_9"))', limit=None, dense="none")
    return out


@query("O01_page", f"""WITH {LEAF_SQL}, ord AS (SELECT *, CASE scenario WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS so FROM leaf JOIN nation ON n_name = market)
SELECT scenario AS "Scenario", month AS "Time", market AS "Market", gross AS "Gross" FROM ord ORDER BY so, month, n_nationkey LIMIT 50 OFFSET 100""")  # fmt: skip
def page(spark, sf_dir):
    return Q.select(sales_cube(spark, sf_dir), ["Gross"], limit=50, offset=100, dense="none")


@query("A11_A12_aggregate", f"""WITH {LEAF_SQL} SELECT round(avg(gross), 4) AS mean_gross, round(sum(revenue), 4) AS sum_revenue, max(top) AS max_top, count(*) FILTER (qty > 1000)::DOUBLE AS n_large,
coalesce((SELECT min(gross) FROM leaf WHERE gross > 1e15), 0.0)::DOUBLE AS none FROM calc""")  # fmt: skip
def aggregates(spark, sf_dir):
    calls = {"mean_gross": ("mean(Gross)", None), "sum_revenue": ("sum(Revenue)", None), "max_top": ("max(Top)", None), "n_large": ("count(Qty > 1000)", None), "none": ("min(Gross)", "Gross > 1000000000000000")}
    digits = {"mean_gross": 4, "sum_revenue": 4, "max_top": 2, "n_large": 0, "none": 2}
    return Q.aggregates(sales_cube(spark, sf_dir), calls).select(*[F.round(c, n).alias(c) for c, n in digits.items()])


@query("A13_group_by", f"""WITH {LEAF_SQL} SELECT market AS "Market", scenario AS "Scenario", round(sum(revenue), 4) AS value FROM calc WHERE qty > 100 GROUP BY ALL ORDER BY 1, 2 LIMIT 40 OFFSET 10""")
def group_by(spark, sf_dir):
    return Q.aggregate(sales_cube(spark, sf_dir), "sum(Revenue)", "Qty > 100", ["Market", "Scenario"], 40, 10).withColumn("value", F.round("value", 4))


@query("J10_O02_diff", f"""WITH {LEAF_SQL} SELECT x.month AS "Time", x.market AS "Market", x.gross AS left_value, y.gross AS right_value, round(y.gross - x.gross, 2) AS delta
FROM leaf x JOIN leaf y ON x.month = y.month AND x.market = y.market AND x.scenario = 'N' AND y.scenario = 'R' WHERE abs(y.gross - x.gross) > 1e-9 ORDER BY abs(y.gross - x.gross) DESC, 1, 2 LIMIT 200""")  # fmt: skip
def diff(spark, sf_dir):
    return Q.diff(sales_cube(spark, sf_dir), "Scenario", "N", "R", "Gross", 200).withColumn("delta", F.round("delta", 2))


@query("P12_J12_permissions", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", gross AS "Gross" FROM leaf WHERE region = 'ASIA' AND scenario = 'N' OR market = 'NATION_17'""")
def permissions(spark, sf_dir):
    cube = sales_cube(spark, sf_dir)
    grants = [{"principal": "ann", "capabilities": ["READ"], "scope": {"Market": ("subtree", "ASIA"), "Scenario": "N"}}, {"principal": "ann", "capabilities": ["READ"], "scope": {"Market": ["NATION_17"]}}, {"principal": "bob", "capabilities": ["READ"], "scope": {}}]
    return Q.permitted(cube, cube.leaf("none"), grants, "ann").select("Scenario", "Time", "Market", "Gross")


@query("P05_bare_names", f"""WITH {LEAF_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", qty AS "Qty" FROM calc
WHERE (gross >= 500000 OR abs(gross - 500000) < 1e-9) AND NOT qty < 100""")  # fmt: skip
def bare_names(spark, sf_dir):
    """A name that is neither a measure nor a dimension is null: equal to no element, different from all."""
    return Q.select(sales_cube(spark, sf_dir), ["Qty"], "(Market == Tampa or Gross >= 500000) AND Scenario != Q1-2026 and !(Qty < 100)", limit=None, dense="none")


@query("P13_anchor", f"""WITH {GRID_SQL} SELECT scenario AS "Scenario", month AS "Time", market AS "Market", (t - 24)::DOUBLE AS since, CASE WHEN t > 24 THEN gross * 2 END AS later FROM grid""")
def anchored(spark, sf_dir):
    cube = sales_cube(spark, sf_dir, {"since": "periods_since_anchor()", "later": "Gross * 2"}, quarters=False, scopes={"later": "FutureLeaves"}).at("1997-01")
    return cube.evaluate(["since", "later"], dense="time").select("Scenario", "Time", "Market", F.col("since").cast("double").alias("since"), "later")


@query("P10_filter_language", """SELECT event_id, event_type, user_id, value FROM events
WHERE (coalesce(event_type = 'click', false) AND coalesce(value > 20.5, false) OR coalesce(abs(user_id - 3) < 1e-9, false)) AND NOT coalesce(event_type >= 'p', false) AND NOT coalesce(value < 1, false)""")  # fmt: skip
def filter_language(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return Rec.filtered(e, "(event_type == click AND value > 20.5 or user_id = 3) and not event_type >= 'p' and NOT (value < 1 or missing == 4)")


@query("D11_outcomes", """SELECT event_id AS id, CASE WHEN abs(user_id % 5 - 2) < 1e-9 THEN 'push' WHEN event_id % 3 = 0 THEN 'win' WHEN event_id % 3 = 1 THEN 'loss' ELSE 'void' END AS derived,
CASE WHEN event_id % 3 = 2 THEN 'void' END AS canonical FROM events""")  # fmt: skip
def derived_outcomes(spark, sf_dir):
    word = F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "0").otherwise("Postponed")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), Rec.outcome_of(word, "derived-pushes", F.col("user_id") % 5, F.lit("2")).alias("derived"), Rec.outcome_of(word).alias("canonical"))


@query("S09_D10_canonical_records", """SELECT event_id AS r_id, ts AS r_ts, value AS r_p, user_id::DOUBLE AS r_odds, event_type AS r_outcome FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20 23:59:59'""")
def canonical_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("bet_id"), F.col("ts").alias("commence_time"), F.col("value").alias("prob"), F.col("user_id").cast("double").alias("decimal_odds"), F.col("event_type").alias("won"))
    return S.window_of(S.canonical(e), "range:2024-01-02:2024-01-20", "r_ts").select("r_id", "r_ts", "r_p", "r_odds", "r_outcome")


# ------------------------------------------------------------------ grading and scenarios
_BAND = "CASE WHEN qty >= 0 AND qty < 100 THEN '[0,100)' WHEN qty >= 100 AND qty < 500 THEN '[100,500)' WHEN qty >= 500 AND qty <= 5000 THEN '[500,5000]' WHEN qty IS NULL THEN '(null)' ELSE '(out-of-range)' END"
_LOWER = "(m + 3.841458820694124::DOUBLE / (2 * n)) / (1 + 3.841458820694124::DOUBLE / n) - 1.959963984540054::DOUBLE * sqrt(m * (1 - m) / n + 3.841458820694124::DOUBLE / (4.0 * n * n)) / (1 + 3.841458820694124::DOUBLE / n)"


@query("A14_A18_grade", f"""WITH {LEAF_SQL}, u AS (SELECT *, {_BAND} AS segment, (disc > 0.05)::INT::DOUBLE AS hit FROM calc),
g AS (SELECT segment, count(*) AS n, avg(gross) AS mean_gross, sum(revenue) / sum(qty) AS ratio, stddev_samp(gross) AS std_gross, avg(hit) AS m FROM u GROUP BY 1 UNION ALL
      SELECT 'TOTAL', count(*), avg(gross), sum(revenue) / sum(qty), stddev_samp(gross), avg(hit) FROM u)
SELECT segment, n, round(mean_gross, 6) AS mean_gross, round(ratio, 6) AS ratio, round(std_gross, 4) AS std_gross, round(greatest(0, {_LOWER}), 8) AS low,
  CASE WHEN segment = 'TOTAL' THEN 'ok' WHEN segment LIKE '(%' THEN 'out_of_range' WHEN n < 3 THEN 'below_min_n' ELSE 'ok' END AS status,
  (segment <> 'TOTAL' AND segment NOT LIKE '(%' AND n >= 3 AND mean_gross > 500000) AS flagged FROM g""")  # fmt: skip
def graded(spark, sf_dir):
    rows = sales_cube(spark, sf_dir).evaluate(["Revenue"]).withColumn("hit", (F.col("Disc") > 0.05).cast("double"))
    out = G.grade(rows, {"mean_gross": ("mean", "Gross"), "ratio": ("ratio", "Revenue", "Qty"), "std_gross": ("std", "Gross"), "low": ("wilson_lower", "hit")}, "Qty", [0.0, 100.0, 500.0, 5000.0], min_n=3, flag=F.col("mean_gross") > 500000)
    return out.select("segment", "n", F.round("mean_gross", 6).alias("mean_gross"), F.round("ratio", 6).alias("ratio"), F.round("std_gross", 4).alias("std_gross"), F.round("low", 8).alias("low"), "status", "flagged")


_UPPER = _LOWER.replace(" - 1.959963984540054", " + 1.959963984540054")


@query("A14_metrics", f"""WITH {LEAF_SQL}, u AS (SELECT *, (disc > 0.05)::INT::DOUBLE AS hit FROM calc), g AS (SELECT market, count(*) AS n, sum(qty) AS s, min(gross) AS lo, max(gross) AS hi, avg(tax) AS t, avg(hit) AS m FROM u GROUP BY 1)
SELECT market AS "Market", n::DOUBLE AS n, s AS total, lo AS low, hi AS high, round(sqrt(t), 8) AS rmse, round(least(1, {_UPPER}), 8) AS upper FROM g""")  # fmt: skip
def more_metrics(spark, sf_dir):
    rows = sales_cube(spark, sf_dir).evaluate(["Revenue"]).withColumn("hit", (F.col("Disc") > 0.05).cast("double"))
    out = G.evaluate_metrics(rows, {"n": ("count",), "total": ("sum", "Qty"), "low": ("min", "Gross"), "high": ("max", "Gross"), "rmse": ("rmse", "Tax"), "upper": ("wilson_upper", "hit")}, ["Market"])
    return out.withColumn("rmse", F.round("rmse", 8)).withColumn("upper", F.round("upper", 8))


@query("A22_sweep_metrics", f"""WITH {LEAF_SQL}, p AS (SELECT i::INT AS point, 0.5 + i * 0.25 AS v FROM range(0, 4) r(i)), x AS (SELECT point, gross * v::DOUBLE * (1 - disc) AS r FROM calc, p)
SELECT point, round(avg(r), 4) AS mean_, round(min(r), 4) AS least_, round(max(r), 4) AS most_ FROM x GROUP BY 1""")  # fmt: skip
def sweep_metrics(spark, sf_dir):
    cube, values = sales_cube(spark, sf_dir), X.spanned(0.5, 1.25, 0.25)
    made = [X.sweep(cube, "Gross", values, "Revenue", how, scale=True).select("point", F.round("metric", 4).alias(name)) for how, name in (("mean", "mean_"), ("min", "least_"), ("max", "most_"))]
    return made[0].join(made[1], "point").join(made[2], "point")


@query("X01_X02_whatif", f"""WITH {LEAF_SQL}, b AS (SELECT round(sum(revenue), 4) AS r, round(sum(gross), 2) AS g FROM calc WHERE scenario = 'N' AND market = 'NATION_8' AND month = '1998-03'),
a AS (SELECT round(sum(1000000 * (1 - disc)), 4) AS r FROM calc WHERE scenario = 'N' AND market = 'NATION_8' AND month = '1998-03')
SELECT 'Revenue' AS measure, b.r AS before, coalesce(a.r, 1000000.0) AS after, round(coalesce(a.r, 1000000.0) - coalesce(b.r, 0), 4) AS delta FROM b, a WHERE b.r IS NOT NULL""")  # fmt: skip
def what_if(spark, sf_dir):
    out = X.whatif(sales_cube(spark, sf_dir), [({"Scenario": "N", "Time": "1998-03", "Market": "NATION_8"}, "Gross", 1_000_000.0)], ["Revenue"])
    return out.where("before is not null").select("measure", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round("delta", 4).alias("delta"))


@query("X03_X04_sweep", f"""WITH {LEAF_SQL}, p AS (SELECT i::INT AS point, i * 0.02 AS v FROM range(0, 6) r(i))
SELECT point, round(v::DOUBLE, 6) AS value, round(sum(gross * (1 - v::DOUBLE)), 5) AS metric FROM calc, p WHERE scenario = 'N' GROUP BY ALL""")  # fmt: skip
def swept(spark, sf_dir):
    out = X.sweep(sales_cube(spark, sf_dir), "Disc", X.stepped(0.0, 0.1, 0.02), "Revenue", where=F.col("Scenario") == "N")
    return out.select("point", F.round("value", 6).alias("value"), F.round("metric", 5).alias("metric"))


_BACK = f"""WITH {LEAF_SQL}, g AS (SELECT (a * 3 + b)::INT AS grid, 0.8 + 0.2 * a AS x_Gross, 0.5 + 0.5 * b AS x_Disc FROM range(0, 2) ra(a), range(0, 3) rb(b)),
r AS (SELECT grid, x_Gross::DOUBLE AS "x_Gross", x_Disc::DOUBLE AS "x_Disc", market AS "Market", count(*) AS n, sum(gross * x_Gross::DOUBLE * (1 - disc * x_Disc::DOUBLE)) AS t FROM calc, g WHERE scenario = 'N' GROUP BY ALL)"""


@query("X05_X06_backtest", _BACK + """ SELECT grid, round("x_Gross", 4) AS "x_Gross", round("x_Disc", 4) AS "x_Disc", "Market", n, round(t, 5) AS total FROM r""")
def back_test(spark, sf_dir):
    out = X.backtest(sales_cube(spark, sf_dir), {"Gross": [0.8, 1.0], "Disc": [0.5, 1.0, 1.5]}, {"total": ("sum", "Revenue")}, "Market", where=F.col("Scenario") == "N")
    return out.select("grid", F.round("x_Gross", 4).alias("x_Gross"), F.round("x_Disc", 4).alias("x_Disc"), "Market", "n", F.round("total", 5).alias("total"))


@query("O04_best_point", _BACK + """ SELECT "Market", grid FROM (SELECT *, row_number() OVER (PARTITION BY "Market" ORDER BY t DESC, grid) AS k FROM r) WHERE k = 1""")
def best_point(spark, sf_dir):
    out = X.backtest(sales_cube(spark, sf_dir), {"Gross": [0.8, 1.0], "Disc": [0.5, 1.0, 1.5]}, {"total": ("sum", "Revenue")}, "Market", where=F.col("Scenario") == "N")
    return X.best(out, "total", "max", "Market").select("Market", "grid")


# ------------------------------------------------------------------ periods
def monthly(spark, sf_dir) -> DataFrame:
    """Whole-cent sums of orders by priority and month."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg((cents / 100.0).alias("value"))


MONTHLY_SQL = "mon AS (SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m') AS period, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS value FROM orders GROUP BY ALL)"


@query("A19_benchmark_library", f"""WITH {MONTHLY_SQL}, l AS (SELECT k, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM mon GROUP BY k)
SELECT k, v[floor(0.10::DOUBLE * (n - 1) + 0.5)::INT + 1] AS p10, v[floor(0.25 * (n - 1) + 0.5)::INT + 1] AS p25, v[floor(0.5 * (n - 1) + 0.5)::INT + 1] AS p50, v[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS p75,
v[floor(0.9::DOUBLE * (n - 1) + 0.5)::INT + 1] AS p90, round(mean, 6) AS mean, round(sd, 4) AS stddev, n FROM l""")  # fmt: skip
def library(spark, sf_dir):
    return H.benchmark_library(monthly(spark, sf_dir), ["k"]).withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 4))


@query("A20_W14_period_context", f"""WITH {MONTHLY_SQL} SELECT k, arg_max(value, period) AS current, arg_max(value, period) FILTER (period < (SELECT max(period) FROM mon m WHERE m.k = mon.k)) AS prev, arg_min(value, period) AS first, arg_max(value, period) AS last,
min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum, round(avg(value), 6) AS campaign_avg, arg_min(period, value) AS worst_period, arg_max(period, value) AS best_period, count(*) AS periods FROM mon GROUP BY k""")  # fmt: skip
def context(spark, sf_dir):
    return H.period_context(monthly(spark, sf_dir), ["k"], "period", "value").withColumn("sum", F.round("sum", 2)).withColumn("campaign_avg", F.round("campaign_avg", 6))


_TRENDS = f"""WITH {MONTHLY_SQL}, d AS (SELECT *, value - lag(value) OVER w AS d, row_number() OVER w AS t FROM mon WINDOW w AS (PARTITION BY k ORDER BY period)),
s AS (SELECT *, CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 1e-9 THEN 0 WHEN d > 0 THEN 1 ELSE -1 END AS s FROM d), e AS (SELECT *, last_value(s) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM s),
g AS (SELECT k, count(*) AS n, arg_min(value, t) AS a, arg_max(value, t) AS b, avg(value) AS m, stddev_pop(value) AS sd, max(fin) AS fin, max(t) - max(CASE WHEN s IS NULL OR s <> fin THEN t END) AS run FROM e GROUP BY k)
SELECT k, CASE WHEN abs((b - a) / a * 100) < 5 THEN 'flat' WHEN b > a THEN 'up' ELSE 'down' END AS slope, CASE WHEN sd / abs(m) < 0.15 THEN 'steady' WHEN sd / abs(m) < 0.5 THEN 'variable' ELSE 'volatile' END AS consistency,
round(sd / abs(m), 8) AS volatility, CASE WHEN fin = 0 THEN 0.0 ELSE run * fin END::DOUBLE AS streak FROM g"""


@query("W11_W13_trends", _TRENDS)
def trends(spark, sf_dir):
    return H.trends(monthly(spark, sf_dir), ["k"], "period", "value").withColumn("volatility", F.round("volatility", 8))


@query("W16_D05_consecutive_runs", f"""WITH {MONTHLY_SQL}, h AS (SELECT k, period, left(period, 4)::INT * 12 + right(period, 2)::INT - 1 AS n FROM mon WHERE value > 1000 AND right(period, 2) <> '07'),
i AS (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM h)
SELECT k, min(period) AS first_period, max(period) AS last_period, count(*) AS length FROM i GROUP BY k, i HAVING count(*) >= 3""")  # fmt: skip
def runs(spark, sf_dir):
    return H.consecutive_runs(monthly(spark, sf_dir).where("value > 1000 and right(period, 2) <> '07'"), ["k"], "period", 3)


@query("W15_ledger_history", f"""WITH {MONTHLY_SQL}, h AS (SELECT DISTINCT k, period FROM mon WHERE value > 20000 AND period < '1999-06'),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period DESC) AS r FROM h), c AS (SELECT *, left(period, 4)::INT * 12 + right(period, 2)::INT - 1 + r AS expected FROM r WHERE r <= 24)
SELECT k, count(*) AS count, min(period) AS first_period, max(period) AS last_period, count(*) FILTER (expected = 1999 * 12 + 5) AS streak FROM c GROUP BY k""")  # fmt: skip
def history(spark, sf_dir):
    return H.ledger_history(monthly(spark, sf_dir).where("value > 20000"), "1999-06", ["k"], 24)


@query("W19_budget_events", f"""WITH {MONTHLY_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY period) AS previous FROM mon)
SELECT k, period, value, previous, round(value / previous, 6) AS ratio, CASE WHEN value / previous < 0.8 THEN 'budget_cut' ELSE 'budget_increase' END AS event FROM p WHERE value / previous < 0.8 OR value / previous > 1.2""")  # fmt: skip
def budget(spark, sf_dir):
    return H.budget_events(monthly(spark, sf_dir), ["k"], "period", "value").select("k", "period", "value", "previous", F.round("ratio", 6).alias("ratio"), "event")


@query("U04_latest_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest(spark, sf_dir):
    return H.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("A21_where_statistics", """SELECT n_regionkey AS k, count(*) FILTER (n_nationkey % 2 = 0) AS count_where, coalesce(bool_or(n_nationkey % 2 = 0), false) AS any_where,
coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0), '') AS names_where, arg_min(n_name, n_nationkey) FILTER (n_nationkey % 2 = 0) AS first_where FROM nation GROUP BY 1""")  # fmt: skip
def where_statistics(spark, sf_dir):
    return H.where_stats(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "k"), F.col("n_nationkey") % 2 == 0, "n_name", "n_nationkey", ["k"])


@query("N03_N09_report_text", f"""WITH {MONTHLY_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY period) AS prev FROM mon)
SELECT k, period, round((value - prev) / prev * 100, 6) AS change, round(value / prev, 8) AS ratio, CASE WHEN value <= 10000 THEN 10 WHEN value <= 50000 THEN 25 WHEN value <= 100000 THEN 50 WHEN value <= 200000 THEN 75 WHEN value <= 400000 THEN 90 ELSE 100 END::DOUBLE AS percentile,
round((value - 100000) / 50000, 8) AS z, concat('In ', period, ': ', CASE WHEN abs(value - 1) < 1e-9 THEN 'dollar' ELSE 'dollars' END) AS text FROM p""")  # fmt: skip
def report_text(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("prev", F.lag("value").over(Window.partitionBy("k").orderBy("period")))
    v, p = F.col("value"), F.col("prev")
    points = {10: F.lit(10000.0), 25: F.lit(50000.0), 50: F.lit(100000.0), 75: F.lit(200000.0), 90: F.lit(400000.0)}
    return rows.select("k", "period", F.round(H.pct_change(v, p), 6).alias("change"), F.round(H.guarded_ratio(v, p), 8).alias("ratio"), H.percentile_of(v, points).alias("percentile"), F.round(H.z_score(v, F.lit(100000.0), F.lit(50000.0)), 8).alias("z"), H.joined_text(F.lit("In "), F.col("period"), F.lit(": "), H.plural(v, "dollar", "dollars")).alias("text"))


@query("N04_N12_templates", f"""WITH {MONTHLY_SQL} SELECT k, period, 'high' AS template_id, 'level' AS finding_id, 1 AS priority, k || ' is high in ' || period AS text FROM mon WHERE value > 150000
UNION ALL SELECT k, period, 'some', 'level', 2, k || ' has sales' FROM mon WHERE value > 0 AND NOT value > 150000""")  # fmt: skip
def templates(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    values = {"k": F.col("k"), "p": F.col("period")}
    return H.fire(rows, [{"id": "high", "finding": "level", "priority": 1, "when": F.col("value") > 150000, "text": "{k} is high in {p}", "values": values}, {"id": "some", "finding": "level", "priority": 2, "when": F.col("value") > 0, "text": "{k} has sales", "values": values}], ["k", "period"])


_LIBRARY = """l AS (SELECT CASE WHEN k = '5-LOW' THEN '' ELSE k END AS scope, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM mon WHERE k <> '1-URGENT' GROUP BY ALL),
lib AS (SELECT scope, v[floor(0.10::DOUBLE * (n - 1) + 0.5)::INT + 1] AS p10, v[floor(0.25 * (n - 1) + 0.5)::INT + 1] AS p25, v[floor(0.5 * (n - 1) + 0.5)::INT + 1] AS p50, v[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS p75, v[floor(0.9::DOUBLE * (n - 1) + 0.5)::INT + 1] AS p90, mean, sd, n FROM l),
p AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY period) AS prev FROM mon), j AS (SELECT p.*, lib.* FROM p JOIN lib ON lib.scope = CASE WHEN k IN ('1-URGENT', '5-LOW') THEN '' ELSE k END)"""


def _library(spark, sf_dir) -> DataFrame:
    """Benchmarks by priority; those of low priority stand for all that have none of their own, as the urgent ones here."""
    made = H.benchmark_library(monthly(spark, sf_dir).where("k <> '1-URGENT'"), ["k"])
    return made.select(F.lit("Sales").alias("metric"), F.when(F.col("k") == "5-LOW", "").otherwise(F.col("k")).alias("scope"), *[f"p{n}" for n in (10, 25, 50, 75, 90)], "mean", "stddev", F.col("n").alias("sample_count"))


@query("N01_N09_J14_report_language", f"""WITH {MONTHLY_SQL}, {_LIBRARY}
SELECT k, period, ((value > 100000 OR coalesce(prev > value, false)) AND value < 300000) AS logic, round(floor(value / 7 * 100 + 0.5) / 100, 4) AS zero, CASE WHEN coalesce(value > prev, false) THEN value - prev ELSE -1.0::DOUBLE END AS rise,
CASE WHEN value <= p10 THEN 10 WHEN value <= p25 THEN 25 WHEN value <= p50 THEN 50 WHEN value <= p75 THEN 75 WHEN value <= p90 THEN 90 ELSE 100 END::DOUBLE AS pct, round((value - mean) / sd, 7) AS z, (value > p50)::INT::DOUBLE AS above, p90 AS top, n::DOUBLE AS n, 0.0::DOUBLE AS nothing,
NOT (prev IS NOT NULL AND abs(prev) < 1e-9 OR value > 200000) AS negated, round(abs(value - coalesce(prev, 0)) / 3 * 2 - 4, 4) AS mixed FROM j""")  # fmt: skip
def report_language(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("prev", F.lag("value").over(Window.partitionBy("k").orderBy("period")))
    rows = benchmark_columns(rows, _library(spark, sf_dir), "k", ["Sales"])
    value = Typed("number", F.col("value"))
    report = Report({"value": value, "prev": Typed("number", F.col("prev")), "current.Sales": value}, ["Sales"])
    texts = {
        "logic": "value > 100000 OR prev > value AND value < 300000", "zero": "value / 0 + round(value / 7, 2)", "rise": "if(value > prev, value - prev, 0 - 1)", "pct": "benchmark_percentile(Sales, value)", "z": "benchmark_z_score('Sales', value)",
        "above": "benchmark_above_median(Sales)", "top": "benchmark_p90(Sales)", "n": "benchmark_sample_count(Sales)", "nothing": "benchmark_p10(Other)", "negated": "NOT (prev == 0 OR value > 200000)", "mixed": "abs(value - coalesce(prev, 0)) / 3 * 2 - 4",
    }
    digits = {"zero": 4, "z": 7, "mixed": 4}
    made = {n: report(t).column for n, t in texts.items()}
    return rows.select("k", "period", *[(F.round(c, digits[n]) if n in digits else c).alias(n) for n, c in made.items()])


@query("N02_N11_O08_fired_texts", f"""WITH {MONTHLY_SQL}, {_LIBRARY}, q AS (SELECT *, CASE WHEN value > p50 THEN 'above' ELSE 'below' END AS side, CASE WHEN abs(prev) >= 1e-15 THEN (value - prev) / prev * 100 END AS change FROM j)
SELECT k, period, CASE WHEN value > p90 THEN 'peak' ELSE 'level' END AS template_id, 'sales' AS finding_id, CASE WHEN value > p90 THEN 1 ELSE 2 END AS priority,
CASE WHEN value > p90 THEN k || ' peaks in ' || period ELSE k || ' is ' || side || ' its median, ' || CASE WHEN coalesce(change > 0, false) THEN 'up' ELSE 'not up' END || ', in ' || period END AS text FROM q WHERE value > p90 OR value > 1000""")  # fmt: skip
def fired_texts(spark, sf_dir):
    """Bindings mention each other: verdict needs direction and side, direction needs change."""
    rows = monthly(spark, sf_dir).withColumn("prev", F.lag("value").over(Window.partitionBy("k").orderBy("period")))
    bindings = {"verdict": "if(true, side, direction)", "direction": "if(change > 0, 'up', 'not up')", "change": "pct_change(value, prev)", "side": "if(value > benchmark_p50(Sales), 'above', 'below')"}
    templates = [
        {"id": "level", "finding": "sales", "priority": 2, "when": "value > 1000", "text": "{k} is {verdict} its median, {direction}, in {period}", "bindings": bindings},
        {"id": "peak", "finding": "sales", "priority": 1, "when": "value > benchmark_p90(Sales)", "text": "{k} peaks in {period}"},
    ]
    return H.fire_texts(rows, templates, ["k", "period"], _library(spark, sf_dir), "k")


@query("N12_explanations", f"""WITH {MONTHLY_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY period) AS prev FROM mon),
q AS (SELECT *, CASE WHEN prev IS NULL THEN 1 WHEN value < prev AND value < 100000 THEN 2 WHEN value < prev THEN 3 WHEN value > prev * 2 THEN 4 END AS n FROM p)
SELECT k, period, CASE WHEN n = 4 THEN 'rise' ELSE 'fall' END AS finding_id, CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'small' WHEN 3 THEN 'less' ELSE 'twice' END AS template_id,
k || CASE n WHEN 1 THEN ' begins' WHEN 2 THEN ' fell, from little' WHEN 3 THEN ' fell' ELSE ' more than doubled' END AS text,
CASE n WHEN 2 THEN 'first' WHEN 3 THEN 'first,small' ELSE '' END AS rejected, CASE n WHEN 1 THEN 'small,less' WHEN 2 THEN 'less' ELSE '' END AS skipped FROM q WHERE n IS NOT NULL""")  # fmt: skip
def explanations(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("prev", F.lag("value").over(Window.partitionBy("k").orderBy("period"))).withColumn("begins", F.col("prev").isNull())
    templates = [
        {"id": "less", "finding": "fall", "priority": 3, "when": "value < prev", "text": "{k} fell"}, {"id": "first", "finding": "fall", "priority": 1, "when": "begins", "text": "{k} begins"},
        {"id": "small", "finding": "fall", "priority": 2, "when": "value < prev AND value < 100000", "text": "{k} fell, from little"}, {"id": "twice", "finding": "rise", "priority": 1, "when": "value > prev * 2", "text": "{k} more than doubled"},
    ]
    out = H.explained(rows, templates, ["k", "period"])
    return out.withColumn("rejected", F.array_join("rejected", ",")).withColumn("skipped", F.array_join("skipped", ","))


@query("N04_number_text", """SELECT o_orderkey AS k, format('{:,}', floor(o_totalprice)::BIGINT) AS grouped, CASE WHEN o_custkey % 3 = 0 THEN '—' ELSE '+' || (o_custkey % 100)::VARCHAR || '.0%' END AS percent FROM orders""")
def number_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    percent = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 100) / 100.0)
    return o.select(F.col("o_orderkey").alias("k"), H.number_text(F.floor("o_totalprice").cast("double"), ",").alias("grouped"), H.number_text(percent, "+.1%").alias("percent"))


@query("N10_context_events", """SELECT count(*) AS n, count(*) > 0 AS has, coalesce(string_agg(event_type, '; ' ORDER BY event_type), '') AS description FROM (SELECT DISTINCT event_type FROM events)""")
def events_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct().select(F.lit("2026-01").alias("period"), F.lit("promo").alias("kind"), F.col("event_type").alias("description"))
    return H.context_events(e, "2026-01", "promo")


_TOKENS = "regexp_split_to_array(lower(text), '[^a-z]+')"


@query("J13_token_match", """WITH q AS (SELECT DISTINCT p_partkey AS query_id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS token FROM part), q2 AS (SELECT * FROM q WHERE token <> ''),
r AS (SELECT DISTINCT p_brand AS entry_id, unnest(string_split(lower(p_type), ' ')) AS token FROM part), r2 AS (SELECT * FROM r WHERE token <> ''),
n AS (SELECT count(DISTINCT entry_id) AS n FROM r2), df AS (SELECT token, count(*) AS df FROM r2 GROUP BY 1),
qi AS (SELECT q2.*, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM q2 LEFT JOIN df USING (token), n), ri AS (SELECT r2.*, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM r2 LEFT JOIN df USING (token), n),
b AS (SELECT query_id, entry_id, sum(qi.idf) AS both_ FROM qi JOIN ri USING (token) GROUP BY ALL), a AS (SELECT query_id, sum(idf) AS a FROM qi GROUP BY 1), c AS (SELECT entry_id, sum(idf) AS c FROM ri GROUP BY 1),
s AS (SELECT query_id, entry_id, 2.0 * (both_ / a) * (both_ / c) / (both_ / a + both_ / c) AS score FROM b JOIN a USING (query_id) JOIN c USING (entry_id))
SELECT query_id, round(max(score), 8) AS score FROM s GROUP BY 1""")  # fmt: skip
def match(spark, sf_dir):
    """The whole table is the registry."""
    return H.token_match(*_part_tokens(spark, sf_dir)).select("query_id", F.round("score", 8).alias("score"))


def _part_tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    q = p.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("token")).where("token <> ''")
    return q, p.select(F.col("p_brand").alias("id"), F.explode(F.split(F.lower("p_type"), " ")).alias("token")).where("token <> ''")


@query("A23_match_counts", ORACLES["J13_token_match"].replace("SELECT query_id, round(max(score), 8) AS score FROM s GROUP BY 1", """, t AS (SELECT query_id, score, lead(score) OVER w AS second, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, entry_id))
SELECT CASE WHEN score >= 0.3 AND (second IS NULL OR score - second >= 0.05 OR score >= second * 1.2) THEN 'accepted' WHEN score >= 0.2 THEN 'review' ELSE 'rejected' END AS status, count(*) AS n FROM t WHERE r = 1 GROUP BY 1"""))
def match_counts(spark, sf_dir):
    return H.match_counts(H.token_match(*_part_tokens(spark, sf_dir)))


# ------------------------------------------------------------------ writes and set operations
KEYS = ["Scenario", "Time", "Market"]


def _cells(spark, sf_dir, scenario: str) -> DataFrame:
    return sales_cube(spark, sf_dir).leaf("none").where(F.col("Scenario") == scenario).select(F.lit("N").alias("Scenario"), "Time", "Market", F.col("Gross").alias("value"))


_STORE = f"""WITH {LEAF_SQL}, store AS (SELECT 'N' AS "Scenario", month AS "Time", market AS "Market", gross AS value FROM leaf WHERE scenario = 'N'), cells AS (SELECT 'N' AS "Scenario", month AS "Time", market AS "Market", gross AS value FROM leaf WHERE scenario = 'R')"""


@query("K03_U02_J11_append", _STORE + """ SELECT * FROM store UNION ALL SELECT * FROM cells ANTI JOIN store USING ("Scenario", "Time", "Market")""")
def append(spark, sf_dir):
    return Wr.dispose(_cells(spark, sf_dir, "N"), _cells(spark, sf_dir, "R"), KEYS, "append")


@query("K03_merge", _STORE + """ SELECT * FROM cells UNION ALL SELECT * FROM store ANTI JOIN cells USING ("Scenario", "Time", "Market")""")
def merge(spark, sf_dir):
    return Wr.dispose(_cells(spark, sf_dir, "N"), _cells(spark, sf_dir, "R"), KEYS, "merge")


@query("S12_U01_last_writer", f"""WITH {LEAF_SQL}, u AS (SELECT month AS "Time", market AS "Market", gross AS value, CASE scenario WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS p FROM leaf)
SELECT "Time", "Market", arg_max(value, p) AS value FROM u GROUP BY ALL""")  # fmt: skip
def last_writer(spark, sf_dir):
    return Wr.last_writer([_cells(spark, sf_dir, s) for s in ("N", "R", "A")], ["Time", "Market"])


@query("K01_K02_write_batch", """WITH s AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS value FROM customer),
b AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'Set' WHEN o_orderkey % 4 = 1 THEN 'Clear' ELSE 'Increment' END AS intent, (o_orderkey % 10)::DOUBLE AS v FROM orders),
m AS (SELECT *, max(seq) FILTER (intent <> 'Increment') OVER (PARTITION BY k) AS base FROM b),
c AS (SELECT k, max(v) FILTER (intent = 'Set') AS set_, bool_or(intent = 'Clear') AS clear, bool_or(intent = 'Set') AS sets, sum(v) FILTER (intent = 'Increment') AS inc FROM m WHERE base IS NULL OR seq >= base GROUP BY k),
j AS (SELECT k, CASE WHEN sets IS NULL THEN value WHEN sets THEN CASE WHEN inc IS NULL THEN set_ ELSE set_ + inc END WHEN clear THEN inc ELSE CASE WHEN inc IS NULL THEN value ELSE coalesce(value, 0) + inc END END AS value FROM s FULL JOIN c USING (k))
SELECT k, value::DOUBLE AS value FROM j WHERE value IS NOT NULL""")  # fmt: skip
def write_batch(spark, sf_dir):
    """All customers are the store, all orders the batch."""
    store = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("value"))
    intent = F.when(F.col("o_orderkey") % 4 == 0, "Set").when(F.col("o_orderkey") % 4 == 1, "Clear").otherwise("Increment")
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), intent.alias("intent"), (F.col("o_orderkey") % 10).cast("double").alias("value"))
    return Wr.commit(store, cells, ["k"])


@query("P15_T29_wide_cells", """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey % 9)::VARCHAR END AS code FROM orders)
SELECT k, (price IS NULL OR code = 'x') AS row_failed, 'Price' AS "Measure", price AS value FROM b WHERE price IS NOT NULL UNION ALL SELECT k, false, 'Code', code::DOUBLE FROM b WHERE price IS NOT NULL AND code <> 'x'""")  # fmt: skip
def wide(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise((F.col("o_orderkey") % 9).cast("string")).alias("code"))
    return I.wide_cells(o, ["k"], {"price": "Price", "code": "Code"})


@query("P14_transform", """SELECT o_orderkey AS id, o_totalprice * 0.01::DOUBLE AS hundred, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, 'none') AS status FROM orders""")
def transform(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("st", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    return I.mapped(o, {"id": {"from": "o_orderkey"}, "hundred": {"from": "o_totalprice", "scale": 0.01}, "status": {"from": "st", "default": "none"}, "gone": {"skip": True}})


@query("P16_P17_long_cells", """SELECT event_id AS id, event_type AS "Measure", value, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_measure' END AS reason FROM events WHERE value IS NOT NULL""")
def long_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").withColumnRenamed("event_id", "id")
    return I.long_cells(e, ["id"], "event_type", "value", ["click", "view"])


@query("D01_D06_dates", """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day,
epoch(date_trunc('day', o_orderdate))::DOUBLE AS seconds, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS sort_key FROM orders""")  # fmt: skip
def dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", F.date_format("o_orderdate", "dd/MM/yyyy"))
    ts = I.parsed_time(F.col("t"), "%d/%m/%Y")
    return o.select(F.col("o_orderkey").alias("k"), *[I.period_name(ts, g).alias(g) for g in ("year", "quarter", "month", "day")], I.instant(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("seconds"), I.report_sort_key(F.date_format(ts, "MMM_yyyy")).alias("sort_key"))


@query("D07_header_names", """SELECT DISTINCT p_type AS t, trim(regexp_replace(lower(regexp_replace(p_type || ' (x)  B', '\\([^)]*\\)', ' ', 'g')), '\\s+', ' ', 'g')) AS h FROM part""")
def headers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("t")).distinct().select("t", H.header_tokens(F.concat("t", F.lit(" (x)  B"))).alias("h"))


@query("D08_S07_json", """SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("D09_R02_watermark", """SELECT event_id, ts FROM events WHERE event_id > 500""")
def watermark(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("_lumenfold_events")
    return spark.sql(I.watermarked("SELECT event_id, ts FROM _lumenfold_events ORDER BY event_id", "event_id", "500"))


@query("P10_D10_D11_records", """SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'win' WHEN event_type = 'view' THEN 'loss' WHEN event_type = 'cart' THEN 'push' END AS outcome FROM events WHERE value > 20""")
def outcomes(spark, sf_dir):
    word = F.when(F.col("event_type") == "click", "Won").when(F.col("event_type") == "view", "0").when(F.col("event_type") == "cart", "tie")
    return table(spark, sf_dir, "events").where("value > 20").select(F.col("event_id").alias("id"), R.normalized_outcome(word).alias("outcome"))


# ------------------------------------------------------------------ replay
def _records(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    outcome = F.when(F.col("event_id") % 17 == 0, "void").when(F.col("event_id") % 11 == 0, "push").when(F.col("event_id") % 2 == 0, "win").otherwise("loss")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 16).cast("string")).alias("path"), F.col("event_id").alias("id"), F.date_trunc("hour", "ts").alias("ts"), F.lit(0.55).alias("p"), F.lit(2.0).alias("odds"), outcome.alias("outcome"), F.lit(None).cast("double").alias("hint"))


_FLAT = """WITH e AS (SELECT 'u' || (user_id % 16) AS path, event_id AS id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 17 = 0 THEN 'void' WHEN event_id % 11 = 0 THEN 'push' WHEN event_id % 2 = 0 THEN 'win' ELSE 'loss' END AS outcome FROM events WHERE value IS NOT NULL),
b AS (SELECT *, CASE outcome WHEN 'win' THEN 1.0 WHEN 'loss' THEN -1.0 ELSE 0.0 END AS pnl FROM e WHERE outcome <> 'void'),"""


@query("W17_W18_X07_X08_flat_replay", _FLAT + """ c AS (SELECT *, 100000.0 + sum(pnl) OVER (PARTITION BY path ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS bank FROM b),
d AS (SELECT *, greatest(100000.0, max(bank) OVER (PARTITION BY path ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
SELECT path, count(*) AS n_bets, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'push') AS pushes, (100000.0 + sum(pnl))::DOUBLE AS final_bank, count(*)::DOUBLE AS total_staked, sum(pnl)::DOUBLE AS total_pnl,
round(max((peak - bank) / peak), 8) AS max_drawdown FROM d GROUP BY path""")  # fmt: skip
def flat_replay(spark, sf_dir):
    curve = R.replay(_records(spark, sf_dir), R.parse_sizing("flat:pct=0.00001"), 100_000.0, batch=False)
    m = R.metrics(curve, 100_000.0)
    return m.select("path", "n_bets", "wins", "losses", "pushes", F.round("final_bank", 6).alias("final_bank"), F.round("total_staked", 6).alias("total_staked"), F.round("total_pnl", 6).alias("total_pnl"), F.round("max_drawdown", 8).alias("max_drawdown"))


_KELLY = _FLAT + """ g AS (SELECT path, ts, count(*) AS n, sum(pnl)::DOUBLE AS net FROM b GROUP BY ALL),
h AS (SELECT *, least(0.02::DOUBLE, 1.0::DOUBLE / n) AS share, 1000.0::DOUBLE * coalesce(product(1.0::DOUBLE + least(0.02::DOUBLE, 1.0::DOUBLE / n) * net) OVER (PARTITION BY path ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS basis FROM g),
c AS (SELECT b.*, share * basis AS stake, basis * (1.0::DOUBLE + share * net) AS bank, row_number() OVER (PARTITION BY b.path ORDER BY b.ts, b.id) AS seq FROM b JOIN h USING (path, ts)),
d AS (SELECT *, greatest(1000.0::DOUBLE, max(bank) OVER (PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM c), f AS (SELECT *, (peak - bank) / peak AS drawdown FROM d),
t AS (SELECT path, seq AS low, peak AS before FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY drawdown DESC, seq) AS r FROM f) WHERE r = 1),
k AS (SELECT path, min(seq) AS regained FROM f JOIN t USING (path) WHERE seq >= low AND bank >= before GROUP BY 1),
m AS (SELECT path, count(*) AS n_bets, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'push') AS pushes, arg_max(bank, seq) AS final_bank, sum(stake) AS total_staked, sum(stake * pnl::DOUBLE) AS total_pnl, max(drawdown) AS deepest, avg(pnl::DOUBLE) AS mean_, stddev_samp(pnl::DOUBLE) AS sd FROM f GROUP BY 1)
SELECT path, n_bets, wins, losses, pushes, round(final_bank, 6) AS final_bank, round(total_staked, 5) AS total_staked, round(total_pnl, 5) AS total_pnl, round((final_bank - 1000) / 1000, 8) AS roi, round(total_pnl / total_staked, 8) AS roi_per_bet,
round(wins / (wins + losses), 8) AS win_rate, round(deepest, 8) AS max_drawdown, (CASE WHEN regained IS NOT NULL THEN regained - low END)::DOUBLE AS recovery_bets, CASE WHEN regained IS NOT NULL THEN 'recovered' ELSE 'unrecovered' END AS recovery,
round(mean_ / sd * sqrt(n_bets), 8) AS sharpe FROM m JOIN t USING (path) LEFT JOIN k USING (path)"""


@query("W18_kelly_batches", _KELLY)
def kelly_replay(spark, sf_dir):
    """A quarter of Kelly's fraction is 0.025 at these odds, so the cap of 0.02 holds: a batch of n multiplies the bankroll by 1 + min(0.02, 1 / n) * net wins, and all its records carry the bankroll after it."""
    m = R.metrics(R.replay(_records(spark, sf_dir), R.parse_sizing("quarter_kelly:cap=0.02"), 1000.0, batch=True), 1000.0)
    m = m.withColumn("recovery_bets", F.col("recovery_bets").cast("double"))
    digits = {"final_bank": 6, "total_staked": 5, "total_pnl": 5, "roi": 8, "roi_per_bet": 8, "win_rate": 8, "max_drawdown": 8, "sharpe": 8}
    return m.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in m.columns])


@query("X10_fixed_odds_replay", _FLAT + """ c AS (SELECT *, CASE outcome WHEN 'win' THEN 2.0 ELSE pnl END AS won FROM b)
SELECT path, count(*) AS n_bets, (100000.0 + sum(won))::DOUBLE AS final_bank, sum(won)::DOUBLE AS total_pnl FROM c GROUP BY path""")  # fmt: skip
def fixed_odds(spark, sf_dir):
    records = Rec.with_odds(Rec.with_odds(_records(spark, sf_dir), "record"), "fixed:3.0")
    m = R.metrics(R.replay(records, R.parse_sizing("flat:pct=0.00001"), 100_000.0, batch=False), 100_000.0)
    return m.select("path", "n_bets", F.round("final_bank", 6).alias("final_bank"), F.round("total_pnl", 6).alias("total_pnl"))


@query("X10_column_odds", """SELECT o_orderkey AS id, CASE WHEN o_totalprice / 100000.0 > 1 THEN 'placed' ELSE 'unusable_odds' END AS state FROM orders""")
def column_odds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000.0).alias("price"))
    records = Rec.with_odds(o, "column:price").select(F.pmod("id", F.lit(64)).cast("string").alias("path"), "id", F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit(0.5).alias("p"), "odds", F.lit("push").alias("outcome"), F.lit(None).cast("double").alias("hint"))
    curve = R.replay(records, R.parse_sizing("flat:pct=0.001"), 1000.0, batch=False)
    return curve.select("id", F.when(F.col("skipped") == "", "placed").otherwise(F.col("skipped")).alias("state"))


@query("X09_bootstrap")
def bootstrap(spark, sf_dir):
    """The pool is every record of the table that is no void, in order of time and id."""
    pool = _records(spark, sf_dir).where("outcome <> 'void'").select("ts", "id", "p", "odds", "outcome", "hint")
    return R.bands(R.bootstrap(spark, pool, R.parse_sizing("flat:pct=0.01"), 200, 1000.0, seed=7), 1000.0)


@query("X11_trace", f"""WITH {LEAF_SQL}, c AS (SELECT * FROM calc WHERE scenario = 'N' AND market = 'NATION_8' AND month = (SELECT min(month) FROM calc WHERE scenario = 'N' AND market = 'NATION_8'))
SELECT unnest([0, 1, 2, 3, 4])::INT AS step, unnest([0, 1, 2, 2, 1])::INT AS depth, unnest(['Charge', 'Revenue', 'Disc', 'Gross', 'Tax']) AS measure, unnest(['Rule', 'Rule', 'Input', 'Input', 'Input']) AS provenance, round(unnest([charge, revenue, disc, gross, tax]), 4) AS value FROM c""")  # fmt: skip
def traced(spark, sf_dir):
    cube = sales_cube(spark, sf_dir)
    rows = cube.evaluate(["Charge"]).where("Scenario = 'N' and Market = 'NATION_8'").orderBy("Time").limit(1)
    rules = {r.target: formula.names(formula.parse(r.body)) for r in cube.model.rules}
    return Wr.trace(rows, rules, {"Scenario": "N", "Market": "NATION_8"}, "Charge").withColumn("value", F.round("value", 4))


@query("K10_S13_ledger_ids", f"""WITH {MONTHLY_SQL} SELECT k, period, left(sha256('sales|' || period || '|high|' || k), 16) AS ledger_entry_id FROM mon WHERE value > 150000""")
def ledger_ids(spark, sf_dir):
    found = monthly(spark, sf_dir).where("value > 150000").withColumn("template_id", F.lit("high")).withColumn("text", F.col("k"))
    return Wr.ledger_entries(found, "sales", F.col("period")).select("k", "period", "ledger_entry_id")


@query("S09_O06_windowed_records", """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20 23:59:59'""")
def windowed_records(spark, sf_dir):
    return S.window_of(table(spark, sf_dir, "events"), "range:2024-01-02:2024-01-20").select("event_id")


@query("EXT_tumbling_events", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
