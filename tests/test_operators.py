"""Grading, replay, histories, sources, ingestion and streaming by hand-made cases."""

import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import grade as G
from lumenfold.operators import history as H
from lumenfold.operators import replay as R
from lumenfold.operators import scenarios as X
from lumenfold.sources import ingest as I
from lumenfold.sources import readers as S
from lumenfold.streaming import incremental


def test_bands_and_labels(spark):
    rows = spark.createDataFrame([(0.0,), (0.03,), (1.0,), (1.5,), (None,)], "v double")
    got = G.grade(rows, {"m": ("mean", "v")}, "v", [0.0, 0.03, 1.0]).collect()
    assert [(r["segment"], r["n"], r["status"]) for r in got] == [("[0,0.03)", 1, "ok"), ("[0.03,1]", 2, "ok"), ("(out-of-range)", 1, "out_of_range"), ("(null)", 1, "out_of_range"), ("TOTAL", 5, "ok")]


def test_ranges():
    assert X.stepped(0, 0.3, 0.1) == pytest.approx([0, 0.1, 0.2, 0.3])
    assert X.spanned(1, 0, 0.4) == pytest.approx([1, 0.6, 0.2, 0])


def records(spark, rows):
    return spark.createDataFrame([("p", i, datetime(2026, 1, d), 0.6, odds, o, None) for i, (d, odds, o) in enumerate(rows)], "path string, id bigint, ts timestamp, p double, odds double, outcome string, hint double")


def test_batches_are_sized_together(spark):
    rows = records(spark, [(1, 2.0, "win"), (1, 2.0, "loss"), (2, 2.0, "win"), (2, 0.5, "win"), (3, 2.0, "void")])
    curve = R.replay(rows, R.parse_sizing("flat_current:pct=0.6"), 100.0).orderBy("seq").collect()
    placed = [(r["stake"], r["bank"]) for r in curve if r["skipped"] == ""]
    assert placed == [(50.0, 100.0), (50.0, 100.0), (60.0, 160.0)]
    assert sorted(r["skipped"] for r in curve if r["skipped"]) == ["unusable_odds", "void"]


def test_ruin_and_metrics(spark):
    rows = records(spark, [(1, 2.0, "win"), (2, 2.0, "loss"), (3, 2.0, "win")])
    curve = R.replay(rows, R.parse_sizing("flat_current:pct=1"), 100.0, batch=False)
    m = R.metrics(curve, 100.0).first()
    assert (m["n_bets"], m["final_bank"], m["max_drawdown"], m["recovery"]) == (2, 0.0, 1.0, "unrecovered")
    assert curve.where("skipped = 'ruin_skipped'").count() == 1


def test_bootstrap_stream_is_one(spark):
    pool = pd.DataFrame({"p": [0.6] * 5, "odds": [2.0] * 5, "outcome": ["win", "loss", "loss", "win", "push"], "hint": [None] * 5})
    for block in (None, 2):
        got = {r["run"]: r["final_bank"] for r in R.bootstrap(spark, pool, R.parse_sizing("flat:pct=0.1"), 6, 100.0, block, seed=3).collect()}
        rng = R.SplitMix64(3)
        for run in range(6):
            bank = 100.0
            for i in R.resampled(5, rng, block):
                bank += {"win": 10.0, "loss": -10.0}.get(pool["outcome"][i], 0.0)
            assert got[run] == pytest.approx(bank)
    assert R.SplitMix64(0).next() == 0xE220A8397B1DCDAF


def test_number_text(spark):
    f = lambda x, spec: spark.range(1).select(H.number_text(F.lit(x).cast("double"), spec).alias("t")).first()["t"]
    assert [f(1234.5, ",.1"), f(0.256, "+.1%"), f(-3.0, ""), f(None, ".2"), f(1234.0, "")] == ["1,234.5", "+25.6%", "-3", "—", "1234"]


def test_streak(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 1.0, 2.0, 3.0])] + [("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, 1.0)], "k string, p int, v double")
    assert {r["k"]: r["streak"] for r in H.trends(rows, ["k"], "p", "v").collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score,name\n1,2.5,x\n2,,y\n")
    df = S.csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "name": "string"} and df.where("score is null").count() == 1
    assert S.strict_csv(spark, str(tmp_path / "a.csv"), ["id", "score", "name"]).count() == 2
    with pytest.raises(ValueError):
        S.strict_csv(spark, str(tmp_path / "a.csv"), ["id", "name", "score"])
    (tmp_path / "r.csv").write_text('Date,City,Zip Code,Impressions,CTR(%)\n01-2026,Tampa,33601,"1,234",0.5\n02-2026,Miami,33101,"2,000",\n')
    cells = {(r["category"], r["measure"]): r["value"] for r in S.report_csv(spark, str(tmp_path / "r.csv")).collect()}
    assert cells == {("Tampa", "Impressions"): 1234.0, ("Tampa", "CTR"): 0.5, ("Miami", "Impressions"): 2000.0}


def test_databases_and_json(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (a integer, b real, c text)")
        db.executemany("insert into t values (?, ?, ?)", [(1, 0.5, "x"), (None, 1.5, None)])
    assert dict(S.sqlite(spark, str(tmp_path / "x.db"), "select * from t").dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert S.duckdb(spark, ":memory:", "select 1 as a, [1, 2] as b").first().asDict() == {"a": 1, "b": "[1,2]"}
    doc = spark.createDataFrame([(json.dumps({"d": {"rows": [{"a": 1, "b": {"c": 2}}, {"a": 2, "b": None}]}}),)], "value string")
    assert [r.asDict() for r in S.json_documents(spark, doc, "d.rows").collect()] == [{"a": 1, "b": '{"c":2}'}, {"a": 2, "b": None}]


def test_watermark_queries():
    assert I.watermarked("SELECT * FROM t ORDER BY a", "a", "x'y") == "SELECT * FROM t WHERE a > 'x''y' ORDER BY a"
    assert I.watermarked("SELECT * FROM t WHERE b = 1", "a", "5") == "SELECT * FROM t WHERE b = 1 AND a > '5'"
    assert I.watermarked("SELECT * FROM t WHERE a > {watermark}", "a", "5") == "SELECT * FROM t WHERE a > '5'"


def test_cron():
    assert I.next_fire("*/15 9-17 * * 1-5", datetime(2026, 1, 2, 17, 50)) == datetime(2026, 1, 5, 9, 0)
    assert I.next_fire("@monthly", datetime(2026, 1, 2)) == datetime(2026, 2, 1)
    assert I.next_fire("@every 90s", datetime(2026, 1, 2)) == datetime(2026, 1, 2, 0, 1, 30)


def test_strict_times(spark):
    rows = spark.createDataFrame([("05-Mar-2026",), ("5-Mar-2026",), ("05-Mar-2026x",), (None,)], "t string")
    got = [r[0] for r in rows.select(I.period_name(I.parsed_time(F.col("t"), "%d-%b-%Y"), "quarter")).collect()]
    assert got == ["2026-Q1", None, None, None]


def test_stream_upserts_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate([[("a", 1.0), ("b", 2.0)], [("a", 5.0), ("c", 3.0)]]):
        spark.createDataFrame(rows, "k string, value double").coalesce(1).write.mode("append").parquet(source)
        assert i >= 0
    stream = incremental.events_stream(spark, source, "k string, value double")
    incremental.upsert_stream(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination(60)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    assert {r["k"] for r in spark.read.parquet(str(last)).collect()} == {"a", "b", "c"}


def test_event_time_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    batch = incremental.windowed(events, "ts", "1 day", "2 days", ["event_type"], "value")
    assert batch.agg(F.sum("n")).first()[0] == events.where("ts is not null").count()
    assert incremental.sessions(events, "ts", "30 minutes", "1 hour", ["event_type"], "value").agg(F.sum("n")).first()[0] == events.count()
