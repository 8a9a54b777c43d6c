"""The record filter, the holdout guard, odds, outcomes, replays and bootstraps against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.model.schema import ModelError
from lumenfold.operators import records as Rec
from lumenfold.operators import replay as R

COLUMNS = "id long, n double, s string, odds double"
ROWS = [(1, 5.0, "a-b", 2.0), (2, None, "5", 1.0), (3, -1.5, None, None), (4, 5.0 + 1e-10, "z", 3.0)]


def ids(spark, text):
    return sorted(r["id"] for r in Rec.filtered(spark.createDataFrame(ROWS, COLUMNS), text).select("id").collect())


@pytest.mark.parametrize(("text", "found"), [
    ("n == 5", [1, 4]), ("n = '5'", [1, 4]), ("n != 5", [3]), ("n == five", []), ("not n == five", [1, 2, 3, 4]), ("s == a-b", [1]), ("s = 5", [2]), ("s == '5'", [2]), ("s >= b", [4]), ("gone == 1", []), ("NOT gone == 1 And n < 0", [3]),
    ("n > 0 or s == z and id < 2", [1, 4]), ("(n > 0 or s == z) and id < 2", [1]), ("n >= -1.5", [1, 3, 4]), ("not (n > 0)", [2, 3]), ("s != q", [1, 2, 4]),
])
def test_filter(spark, text, found):
    assert ids(spark, text) == found


@pytest.mark.parametrize("text", ["", "n", "n ==", "n == 5 5", "(n == 5", "5 == n", "n ~ 5", "and", "n == (5)"])
def test_filters_that_are_refused(spark, text):
    with pytest.raises(ModelError):
        ids(spark, text)


def test_holdout_guard():
    for text in ("Line == 9.0", "Time == '2025' and not Line != 9", "(Line = 3)"):
        with pytest.raises(ModelError, match="MC6013"):
            Rec.guarded_holdout(text, {"Line"}, {"Time"})
    for text in ("Line >= 8.99 and Line <= 9.01", "Time == '2025'", "Time == 2025", "Line == 'x'"):
        Rec.guarded_holdout(text, {"Line"}, {"Time"})


def test_odds(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    assert [r["odds"] for r in Rec.with_odds(rows, "column:n").orderBy("id").collect()] == [5.0, None, -1.5, 5.0 + 1e-10]
    assert {r["odds"] for r in Rec.with_odds(rows, "fixed: 1.9").collect()} == {1.9} and Rec.with_odds(rows) is rows
    for bad in ("fixed:1", "fixed:x", "column:", "column:gone", "other"):
        with pytest.raises(ModelError):
            Rec.with_odds(rows, bad)


def test_outcomes(spark):
    words = ["Won", " w ", "lost", "tie", "V", "1", "0", "2", None, "postponed"]
    rows = spark.createDataFrame([(i, w, 3.0 if i == 0 else 1.0) for i, w in enumerate(words)], "i int, w string, a double").orderBy("i")
    got = lambda mode: [r[0] for r in rows.select(Rec.outcome_of(F.col("w"), mode, F.col("a"), F.lit(3.0))).collect()]
    assert got("canonical") == ["win", "win", "loss", "push", "void", None, None, None, None, "void"]
    assert got("legacy-binary") == ["win", "win", "loss", "push", "void", "win", "loss", None, None, "void"]
    assert got("derived-pushes")[0] == "push" and got("derived-pushes")[1:] == got("legacy-binary")[1:]


def plain_replay(rows, sizing, start, most=None):
    """Batches by timestamp, written anew: stakes on the bankroll before the batch, scaled down to it; records carry the bankroll after it."""
    bank, curve = start, []
    for ts in sorted({r[1] for r in rows}):
        basis, stakes = bank, []
        for r in sorted((r for r in rows if r[1] == ts), key=lambda r: r[0]):
            if r[4] == "void" or r[3] is None or r[3] <= 1:
                continue
            stake, why = R.stake_of(sizing, r[2], r[3], r[5], start, basis)
            if not why:
                stakes.append((r, stake if most is None else min(stake, most)))
        total = sum(s for _, s in stakes)
        for r, stake in stakes:
            stake = stake * basis / total if total > basis else stake
            bank += stake * (r[3] - 1) if r[4] == "win" else -stake if r[4] == "loss" else 0
            curve.append([r[0], stake, None])
        for c in curve:
            c[2] = bank if c[2] is None else c[2]
        if bank <= 1e-12:
            break
    return curve


@pytest.mark.parametrize("sizing", ["quarter_kelly:cap=0.1", "flat_current:pct=0.3", "flat:pct=0.05,min_odds=1.5", "from_column:hint", "kelly:fraction=0.5,shrink=0.02,floor=0.01"])
def test_batches_equal_a_plain_replay(spark, sizing):
    from datetime import datetime, timedelta

    rng = random.Random(sizing)
    rows = [(i, datetime(2026, 1, 1) + timedelta(hours=rng.randrange(30)), rng.uniform(0.3, 0.7), rng.choice([None, 0.9, 1.4, 2.0, 3.5]), rng.choice(["win", "loss", "push", "void"]), rng.choice([None, 0.0, 20.0, 90.0])) for i in range(120)]
    frame = spark.createDataFrame([("p", *r) for r in rows], "path string, id long, ts timestamp, p double, odds double, outcome string, hint double")
    got = [(r["id"], r["stake"], r["bank"]) for r in R.replay(frame, R.parse_sizing(sizing), 1000.0, batch=True, most=150.0).where("skipped = ''").orderBy("seq").collect()]
    want = plain_replay(rows, R.parse_sizing(sizing), 1000.0, 150.0)
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) > 10
    assert all(abs(g[1] - w[1]) < 1e-6 and abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_bootstrap_equals_a_plain_loop(spark):
    import pandas as pd

    rng = random.Random(5)
    pool = pd.DataFrame({"p": [0.55] * 50, "odds": [rng.choice([1.5, 2.0, 3.0]) for _ in range(50)], "outcome": [rng.choice(["win", "loss"]) for _ in range(50)], "hint": [None] * 50})
    got = {r["run"]: r for r in R.bootstrap(spark, pool, R.parse_sizing("flat_current:pct=0.02"), 9, 1000.0, seed=3).collect()}
    stream, banks = R.SplitMix64(3), []
    for k in range(9):
        bank = 1000.0
        for _ in range(50):
            i = stream.next() % 50
            stake = bank * 0.02
            bank += stake * (pool["odds"][i] - 1) if pool["outcome"][i] == "win" else -stake
        banks.append(float(bank))
        assert abs(got[k]["final_bank"] - bank) < 1e-6
    bands = R.bands(spark.createDataFrame([(k, b, b / 1000 - 1, 0.1) for k, b in enumerate(banks)], "run long, final_bank double, roi double, max_drawdown double")).first()
    assert bands["final_bank_p5"] == min(banks) and bands["final_bank_p50"] == sorted(banks)[4] and bands["final_bank_p95"] == max(banks)
    assert bands["p_underwater"] == sum(b < 1000 for b in banks) / 9
    with pytest.raises(ValueError, match="more than 10"):
        R.bounded_pool(spark.range(11), 10)
