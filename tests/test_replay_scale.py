"""Bootstraps and replays whose records are held by no process whole."""

import random
import tracemalloc
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from lumenfold.operators import replay as R
from lumenfold.queries import QUERIES
from tests.test_records import plain_replay


def plain_bootstrap(pool, sizing, runs, start, block, seed, most=None):
    """One stream for all runs, written anew; pool: (p, odds, outcome, hint)."""
    rng, out = R.SplitMix64(seed), []
    for _ in range(runs):
        bank = peak = start
        deepest, over = 0.0, False
        for i in R.resampled(len(pool), rng, block) if pool else []:
            p, odds, outcome, hint = pool[i]
            if over or odds is None or odds <= 1:
                continue
            stake, why = R.stake_of(sizing, p, odds, hint, start, bank)
            if why:
                continue
            stake = min(stake, bank, *([] if most is None else [most]))
            bank += stake * (odds - 1) if outcome == "win" else -stake if outcome == "loss" else 0.0
            peak = max(peak, bank)
            deepest = max(deepest, (peak - bank) / peak)
            if bank <= 1e-12:
                bank, over = max(bank, 0.0), True
        out.append((bank, (bank - start) / start, deepest if deepest >= 1e-12 else 0.0))
    return out


def test_bootstrap_query_keeps_its_pool_off_the_driver(spark, sf_dir, duck, monkeypatch):
    def refuse(*_):
        raise AssertionError("the pool passes through the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toPandas", refuse)
        got = QUERIES["X09_bootstrap"](spark, sf_dir).collect()[0]
    sql = "SELECT CASE WHEN event_id % 11 = 0 THEN 'push' WHEN event_id % 2 = 0 THEN 'win' ELSE 'loss' END FROM events WHERE value IS NOT NULL AND event_id % 17 <> 0 ORDER BY date_trunc('hour', ts), event_id"
    pool = [(0.55, 2.0, o, None) for (o,) in duck.sql(sql).fetchall()]
    want = plain_bootstrap(pool, R.parse_sizing("flat:pct=0.01"), 200, 1000.0, None, 7)
    for k, name in enumerate(("final_bank", "roi", "max_drawdown")):
        ordered = sorted(w[k] for w in want)
        assert [got[f"{name}_p{q}"] for q in (5, 25, 50, 75, 95)] == [ordered[-(-q * 200 // 100) - 1] for q in (5, 25, 50, 75, 95)]
    assert got["p_underwater"] == sum(w[0] < 1000 for w in want) / 200


@pytest.mark.parametrize("sizing", ["quarter_kelly:cap=0.05", "from_column:hint", "flat:pct=0.2,min_odds=1.5", "flat_current:pct=0.03"])
@pytest.mark.parametrize("block", [None, 7, 5000])
def test_bootstrap_of_a_table_equals_a_plain_loop(spark, sizing, block):
    rng = random.Random(sizing)
    pool = [(rng.uniform(0.4, 0.7), rng.choice([None, 0.9, 1.6, 2.0, 3.5]), rng.choice(["win", "loss", "loss", "push", None]), rng.choice([None, 0.0, 5.0, 20.0])) for _ in range(1500)]
    rows = [(i, *r) for i, r in enumerate(pool)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, p double, odds double, outcome string, hint double").repartition(7)
    got = {r["run"]: (r["final_bank"], r["roi"], r["max_drawdown"]) for r in R.bootstrap(spark, frame, R.parse_sizing(sizing), 5, 1000.0, block, seed=11, most=100.0, order=("id",)).collect()}
    assert [got[k] for k in range(5)] == plain_bootstrap(pool, R.parse_sizing(sizing), 5, 1000.0, block, 11, 100.0)


def test_bootstrap_of_an_empty_pool(spark):
    pool = pd.DataFrame({"p": [], "odds": [], "outcome": [], "hint": []})
    got = R.bootstrap(spark, pool, R.parse_sizing("flat:pct=0.1"), 3, 50.0).collect()
    assert sorted(tuple(r) for r in got) == [(k, 50.0, 0.0, 0.0) for k in range(3)]


RECORDS = "path string, id long, ts timestamp, p double, odds double, outcome string, hint double"


@pytest.mark.parametrize("name", ["W18_kelly_batches", "W17_W18_X07_X08_flat_replay", "X10_fixed_odds_replay", "X10_column_odds"])
def test_replay_queries_hand_python_no_whole_path(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsIn" not in plan


@pytest.mark.parametrize("batch", [True, False])
def test_a_replay_keeps_no_path_in_memory(batch):
    def peak(n):
        rows = (("a", i, 7 if i < n // 2 else i, 0.55, 2.0, ("win", "loss")[i % 2], None) for i in range(n))
        tracemalloc.start()
        count = sum(1 for _ in R._curve(rows, R.parse_sizing("quarter_kelly:cap=0.02"), 1000.0, batch, None, 500))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n
        return most

    assert peak(40_000) < 1.5 * peak(4_000)


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_batches_in_files_are_the_same(held):
    rng = random.Random(held)
    rows = [("p", i, i // 40, rng.uniform(0.4, 0.7), rng.choice([0.9, 1.5, 2.5]), rng.choice(["win", "loss", "push", "void"]), None) for i in range(400)]
    got = [(r[1], r[5], r[7]) for r in R._curve(iter(rows), R.parse_sizing("flat_current:pct=0.2"), 1000.0, True, None, held) if not r[9]]
    want = plain_replay([r[1:] for r in rows], R.parse_sizing("flat_current:pct=0.2"), 1000.0)
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) > 10
    assert all(g[1:] == pytest.approx(tuple(w[1:])) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("sizing", ["quarter_kelly:cap=0.1", "flat:pct=0.4"])
def test_paths_in_small_pieces_equal_a_plain_replay(spark, sizing):
    rng = random.Random(sizing)
    paths = {path: [(i, datetime(2026, 1, 1) + timedelta(hours=rng.randrange(20)), rng.uniform(0.4, 0.7), rng.choice([None, 1.4, 2.0]), rng.choice(["win", "loss", "push", "void"]), None) for i in range(90)] for path in ("a", "b", None)}
    rows = [(path, *r) for path, own in paths.items() for r in own]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        curve = R.replay(spark.createDataFrame(rows, RECORDS), R.parse_sizing(sizing), 1000.0).orderBy("path", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path, own in paths.items():
        mine = [r for r in curve if r["path"] == path]
        assert [r["seq"] for r in mine] == list(range(90)) and {(r["id"], r["ts"]) for r in mine} == {r[:2] for r in own}
        want = plain_replay(own, R.parse_sizing(sizing), 1000.0)
        got = [(r["id"], r["stake"], r["bank"]) for r in mine if r["skipped"] == ""]
        assert [g[0] for g in got] == [w[0] for w in want] and all(g[1:] == pytest.approx(tuple(w[1:]), abs=1e-9) for g, w in zip(got, want, strict=True))


def step_of(spark, sf_dir, name, monkeypatch):
    """What a query's replay runs in Python."""
    kind, found = type(spark.range(1)), []
    plain = kind.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, f, *a, **k: found.append(f) or plain(self, f, *a, **k))
        QUERIES[name](spark, sf_dir)
    assert len(found) == 1
    return found[0]


def pieces(n, ids=lambda i: i):
    """Orders of one path, as Spark hands them to Python."""
    for at in range(0, n, 500):
        k = [ids(i) for i in range(at, at + 500)]
        yield pa.RecordBatch.from_pydict(
            {"path": ["7"] * 500, "id": k, "ts": [0] * 500, "p": [0.5] * 500, "odds": [None if i % 5 == 0 else 0.9 if i % 3 == 0 else 2.0 for i in range(at, at + 500)], "outcome": ["push"] * 500, "hint": [None] * 500},
            pa.schema([("path", pa.string()), ("id", pa.int64()), ("ts", pa.int64()), ("p", pa.float64()), ("odds", pa.float64()), ("outcome", pa.string()), ("hint", pa.float64())]),
        )


def test_column_odds_hold_no_path_in_python(spark, sf_dir, monkeypatch):
    run = step_of(spark, sf_dir, "X10_column_odds", monkeypatch)

    def peak(n):
        rows = held = 0
        tracemalloc.start()
        for b in run(pieces(n)):
            rows, held = rows + b.num_rows, max(held, pa.total_allocated_bytes())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most, held

    peak(20_000)  # what is set up once
    (small, arrow), (large, more) = peak(20_000), peak(200_000)
    assert large < 1.3 * small and more < 1.3 * arrow + 1_000_000


def test_column_odds_of_large_and_missing_ids(spark, sf_dir, monkeypatch):
    run = step_of(spark, sf_dir, "X10_column_odds", monkeypatch)
    far = 2**53 + 1  # no double holds it
    got = [r for b in run(pieces(12_000, lambda i: None if i % 1000 == 999 else far + 2 * i)) for r in b.to_pylist()]
    assert [r["id"] for r in got] == [None if i % 1000 == 999 else far + 2 * i for i in range(12_000)]
    assert [r["skipped"] for r in got] == ["unusable_odds" if i % 5 == 0 or i % 3 == 0 else "" for i in range(12_000)]
    assert [r["seq"] for r in got] == [r["batch"] for r in got] == list(range(12_000)) and {r["bank"] for r in got} == {1000.0}
    assert list(run(iter([]))) == []


@pytest.mark.parametrize("sizing", ["flat:pct=0.4", "flat_current:pct=0.9,min_odds=1.5", "from_column:hint,cap=0.5"])
@pytest.mark.parametrize("batch", [True, False])
def test_records_without_a_time_are_batches_of_their_own(sizing, batch):
    rng = random.Random(f"{sizing} {batch}")
    rows = [(path, i, rng.choice([None, i // 9]), 0.5, rng.choice([None, 1.4, 2.5]), rng.choice(["win", "loss", "push", "void", None]), rng.choice([None, 3.0, 900.0])) for path in ("a", None, "b") for i in range(200)]
    rows = [(path, i, ts, p, odds or float("nan"), o, hint) for path, i, ts, p, odds, o, hint in rows]
    got, s = list(R._curve(iter(rows), R.parse_sizing(sizing), 100.0, batch, 70.0, 4)), R.parse_sizing(sizing)
    want, at = [], 0
    while at < len(rows):
        path, _, ts, *_ = rows[at]
        if at == 0 or path != rows[at - 1][0]:
            bank, number, seq, ruined = 100.0, 0, 0, False
        end = at + 1
        while batch and ts is not None and end < len(rows) and rows[end][0] == path and rows[end][2] == ts:
            end += 1
        own, at = rows[at:end], end
        if ruined:
            want += [(path, r[1], r[2], seq + k, number, 0.0, 0.0, max(bank, 0.0), r[5], "ruin_skipped") for k, r in enumerate(own)]
            seq += len(own)
            continue
        sized = [(r, *((0.0, "void") if r[5] == "void" else R.stake_of(s, r[3], r[4], r[6], 100.0, bank) if r[4] > 1 else (0.0, "unusable_odds"))) for r in own]
        for r, _, why in [x for x in sized if x[2]]:
            want.append((path, r[1], r[2], seq, number, 0.0, 0.0, bank, r[5], why))
            seq += 1
        bets = [(r, min(stake, 70.0)) for r, stake, why in sized if not why]
        total = sum(stake for _, stake in bets)
        bets = [(r, stake * (bank / total if total > bank else 1.0)) for r, stake in bets]
        won = [stake * (r[4] - 1) if r[5] == "win" else -stake if r[5] == "loss" else 0.0 for r, stake in bets]
        for w in won:
            bank += w
        for (r, stake), w in zip(bets, won, strict=True):
            want.append((path, r[1], r[2], seq, number, stake, w, bank, r[5], ""))
            seq += 1
        number, ruined = number + 1, bank <= 1e-12
    assert got == want and {"", "void", "unusable_odds"} <= {r[9] for r in got}


def test_a_record_that_is_its_own_batch_waits_for_nothing(monkeypatch):
    monkeypatch.setattr(R, "_Placed", None)
    read = []
    rows = (read.append(i) or ("a", i, 5, 0.5, 2.0, ("win", "loss")[i % 2], None) for i in range(20))
    for k, row in enumerate(R._curve(rows, R.parse_sizing("flat:pct=0.01"), 1000.0, False, None)):
        assert row[1] == k and read == list(range(k + 1))
    assert len(read) == 20
