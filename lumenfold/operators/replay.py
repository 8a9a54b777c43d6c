"""Replay of records in order: path-dependent bankrolls, metrics and bootstraps."""

from __future__ import annotations

import mmap
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from itertools import batched, chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


@dataclass(frozen=True)
class Sizing:
    """flat, flat_current, kelly or from_column, with cap, floor, shrink of the probability and least odds."""

    kind: str = "flat"
    param: float = 0.01
    column: str | None = None
    cap: float | None = None
    floor: float | None = None
    shrink: float = 0.0
    min_odds: float | None = None


def parse_sizing(text: str) -> Sizing:
    """flat:pct=0.02,cap=0.05 and the like; quarter_kelly and half_kelly are kelly with that fraction."""
    head, _, rest = text.partition(":")
    given = {}
    bare = None
    for part in filter(None, (p.strip() for p in rest.split(","))):
        k, eq, v = part.partition("=")
        if eq:
            given[k.strip()] = float(v)
        else:
            bare = part
    fractions = {"quarter_kelly": 0.25, "half_kelly": 0.5}
    kind = "kelly" if head in fractions else head
    if kind not in ("flat", "flat_current", "kelly", "from_column"):
        raise ValueError(f"unknown sizing {head}")
    param = fractions.get(head, given.get("fraction" if kind == "kelly" else "pct", 1.0 if kind == "kelly" else 0.01))
    return Sizing(kind, param, bare, given.get("cap"), given.get("floor"), given.get("shrink", 0.0), given.get("min_odds"))


def stake_of(s: Sizing, p: float, odds: float, hint: float | None, start: float, basis: float) -> tuple[float, str]:
    """(stake, reason it is skipped or '')."""
    if s.min_odds is not None and odds < s.min_odds:
        return 0.0, "below_min_odds"
    if s.kind == "flat":
        pct = s.param * start / max(basis, EPS)
    elif s.kind == "flat_current":
        pct = s.param
    elif s.kind == "kelly":
        b = odds - 1.0
        f = 0.0 if abs(b) < EPS else max(0.0, (b * (p - s.shrink) - (1.0 - (p - s.shrink))) / b)
        if abs(f) < EPS:
            return 0.0, "negative_kelly"
        pct = s.param * f
    else:
        if hint is None or not hint > 0:
            return 0.0, "below_floor"
        pct = hint / max(basis, EPS)
    if s.cap is not None:
        pct = min(pct, s.cap)
    if s.floor is not None and pct < s.floor:
        return 0.0, "below_floor"
    if pct <= 0:
        return 0.0, "negative_kelly"
    return min(pct * basis, basis), ""


def scratch_file():
    """A file without a name on a disk that Spark has for this task."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class _Placed:
    """What an open batch has placed, in order; every `most` rows go to a file."""

    def __init__(self, most: int):
        self.rows, self.file, self.most = [], None, most

    def append(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            self.file = self.file or scratch_file()
            pickle.dump(self.rows, self.file)
            self.rows = []

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            end = self.file.seek(0, os.SEEK_END)
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows


def _pnl(outcome: str | None, stake: float, odds: float) -> float:
    return stake * (odds - 1.0) if outcome == "win" else -stake if outcome == "loss" else 0.0


def _curve(rows: Iterable[tuple], s: Sizing, start: float, batch: bool, most: float | None, held: int = 50_000) -> Iterator[tuple]:
    """(path, id, ts, seq, batch, stake, pnl, bank, outcome, skipped) of records (path, id, ts, p, odds, outcome, hint) in order of path, ts and id.

    Of a batch the placed records come last, since they carry the bankroll after it: they alone wait for its end, and
    beyond `held` of them in a file. A record without a time is a batch of its own.
    """
    none, now = object(), object()
    then, bank, total, number, seq, ruined, placed = None, start, 0.0, 0, 0, False, None  # placed: of the open batch
    for path, k, ts, p, odds, outcome, hint in chain(rows, [(none, *[None] * 6)]):
        alone = not batch or ts is None
        if placed is not None and (alone or ts != then or path != now):
            scale = bank / total if total > bank and total > EPS else 1.0
            for _, _, stake, price, o in placed:
                bank += _pnl(o, stake * scale, price)
            for i, at, stake, price, o in placed:
                yield now, i, at, seq, number, stake * scale, _pnl(o, stake * scale, price), bank, o, ""
                seq += 1
            number, ruined, placed = number + 1, bank <= EPS, None
        if path != now:
            if path is none:
                return
            now, bank, number, seq, ruined = path, start, 0, 0, False
        if ruined:
            yield now, k, ts, seq, number, 0.0, 0.0, max(bank, 0.0), outcome, "ruin_skipped"
            seq += 1
            continue
        if not alone and placed is None:
            then, total, placed = ts, 0.0, _Placed(held)
        if outcome == "void":
            why = "void"
        elif not odds > 1.0:
            why = "unusable_odds"
        else:
            stake, why = stake_of(s, p, odds, hint, start, bank)
        if why:
            yield now, k, ts, seq, number, 0.0, 0.0, bank, outcome, why
            seq += 1
        else:
            stake = min(stake, most) if most is not None else stake
            if alone:
                stake *= bank / stake if stake > bank and stake > EPS else 1.0
                won = _pnl(outcome, stake, odds)
                bank += won
                yield now, k, ts, seq, number, stake, won, bank, outcome, ""
                seq += 1
            else:
                total += stake
                placed.append((k, ts, stake, odds, outcome))
        if alone:
            number, ruined = number + 1, bank <= EPS


def normalized_outcome(c: Column) -> Column:
    """win, loss, push or void from the usual words and digits."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("win", "won", "w", "1", "1.0", "true"), "win").when(t.isin("loss", "lost", "lose", "l", "0", "0.0", "false"), "loss").when(t.isin("push", "tie", "draw", "p"), "push").when(t.isin("void", "cancelled", "canceled", "no_action"), "void")


def replay(records: DataFrame, sizing: Sizing, start: float = 1000.0, batch: bool = True, most: float | None = None, path: str = "path") -> DataFrame:
    """The curve of each path: records (path, id, ts, p, odds, outcome, hint), in order of ts and id, with stake, pnl and bankroll after.

    A stake depends on all earlier outcomes, so a path is one task's work and paths run side by side. Its records are
    sorted by Spark and pass through Python in pieces: memory doesn't grow with a path. In batch mode records of one
    timestamp are sized on the bankroll before them, and scaled down if they exceed it.
    """
    fields = [("path", pa.string()), ("id", pa.int64()), ("ts", pa.int64()), ("seq", pa.int32()), ("batch", pa.int32()), ("stake", pa.float64()), ("pnl", pa.float64()), ("bank", pa.float64()), ("outcome", pa.string()), ("skipped", pa.string())]

    def values(c: pa.Array) -> list:
        if pa.types.is_integer(c.type) and c.null_count:
            return c.to_pylist()
        return c.to_numpy(zero_copy_only=False).tolist()  # a null number is NaN

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[values(b.column(c)) for c in ("path", "id", "ts", "p", "odds", "outcome", "hint")], strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(_curve(read(batches), sizing, start, batch, most), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [c for c, _ in fields])

    numbers = [F.col(c).cast("double").alias(c) for c in ("p", "odds", "hint")]
    given = records.select(F.col(path).cast("string").alias("path"), F.col("id").cast("long").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *numbers, F.col("outcome").cast("string").alias("outcome"))
    ordered = given.repartition("path").sortWithinPartitions("path", F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    curve = ordered.mapInArrow(run, "path string, id bigint, ts bigint, seq int, batch int, stake double, pnl double, bank double, outcome string, skipped string")
    return curve.withColumn("ts", F.timestamp_micros("ts")).withColumnRenamed("path", path)


def with_drawdown(curve: DataFrame, start: float = 1000.0, path: str = "path") -> DataFrame:
    """Running peak and drawdown of placed records; the peak begins at the start bankroll."""
    w = Window.partitionBy(path).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = curve.where("skipped = ''").withColumn("peak", F.greatest(F.lit(start), F.max("bank").over(w)))
    return placed.withColumn("drawdown", F.when(F.col("peak") > EPS, (F.col("peak") - F.col("bank")) / F.col("peak")).otherwise(0.0))


def metrics(curve: DataFrame, start: float = 1000.0, path: str = "path") -> DataFrame:
    """roi, roi per bet, win rate, deepest drawdown, records until its peak is regained, Sharpe ratio; null where undefined."""
    rows = with_drawdown(curve, start, path)
    r = F.when(F.col("stake") > EPS, F.col("pnl") / F.col("stake"))
    one = lambda o: F.count_if(F.col("outcome") == o)
    by = rows.groupBy(path).agg(
        F.count("*").alias("n_bets"), F.sum("stake").alias("total_staked"), F.sum("pnl").alias("total_pnl"), F.max_by("bank", "seq").alias("final_bank"), one("win").alias("wins"), one("loss").alias("losses"), one("push").alias("pushes"),
        F.max("drawdown").alias("max_drawdown"), F.max_by(F.struct("seq", "peak"), F.struct("drawdown", -F.col("seq"))).alias("trough"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.count(r).alias("_n"),
    )
    back = rows.alias("r").join(by.select(path, "trough").alias("b"), path).where((F.col("r.seq") >= F.col("b.trough.seq")) & (F.col("r.bank") >= F.col("b.trough.peak"))).groupBy(path).agg(F.min("r.seq").alias("regained"))
    between = rows.alias("r").join(by.select(path, "trough"), path).join(back, path).where("r.seq > trough.seq and r.seq <= regained").groupBy(path).agg(F.count("*").alias("_gap"))
    out = by.join(back, path, "left").join(between, path, "left")
    under = F.col("max_drawdown") >= 1e-12
    return out.select(
        path, "n_bets", "wins", "losses", "pushes", "final_bank", "total_staked", "total_pnl", F.when(F.lit(abs(start) >= EPS), (F.col("final_bank") - start) / start).alias("roi"), F.try_divide("total_pnl", F.when(F.abs("total_staked") >= EPS, F.col("total_staked"))).alias("roi_per_bet"),
        F.try_divide("wins", F.col("wins") + F.col("losses")).alias("win_rate"), F.when(under, F.col("max_drawdown")).otherwise(0.0).alias("max_drawdown"), F.when(under & F.col("regained").isNotNull(), F.coalesce("_gap", F.lit(0))).alias("recovery_bets"),
        F.when(~under, "never_underwater").when(F.col("regained").isNotNull(), "recovered").otherwise("unrecovered").alias("recovery"), F.when(F.col("_s") > EPS, F.col("_m") / F.col("_s") * F.sqrt("_n")).alias("sharpe"),
    )


class SplitMix64:
    MASK = (1 << 64) - 1

    def __init__(self, seed: int = 0):
        self.state = seed & self.MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & self.MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & self.MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & self.MASK
        return z ^ (z >> 31)

    def skip(self, steps: int) -> SplitMix64:
        """The generator some steps later: its state advances by a constant."""
        return SplitMix64(self.state + steps * 0x9E3779B97F4A7C15)

    def index(self, n: int) -> int:
        return self.next() % n


def resampled(n: int, rng: SplitMix64, block: int | None) -> list[int]:
    if block is None:
        return [rng.index(n) for _ in range(n)]
    starts = list(range(0, n - block + 1, block)) if block and n >= block else [0]
    out: list[int] = []
    while len(out) < n:
        s = starts[rng.index(len(starts))]
        out += range(s, min(s + block, n))
    return out[:n]


def draws_of(n: int, block: int | None) -> int:
    """Random numbers that one run takes: a run's stream starts where the ones before it end."""
    if block is None:
        return n
    return -(-n // block) if n >= block else 1


#: Records of a pool that the driver holds whole.
MOST_POOL = 2_000_000


def bounded_pool(records: DataFrame, most: int = MOST_POOL) -> pd.DataFrame:
    """An ordered pool for the driver; more than `most` records are an error."""
    pool = records.limit(most + 1).toPandas()
    if len(pool) > most:
        raise ValueError(f"a pool of more than {most} records")
    return pool


def places(n: int, rng: SplitMix64, block: int | None, low: int, high: int) -> np.ndarray:
    """resampled(n, rng, block)[low:high] without the rest of it: each number of the stream can be told from its place."""
    t = np.arange(low, high, dtype=np.uint64)
    if block is not None and n < block:
        return t
    z = np.uint64(rng.state) + ((t if block is None else t // np.uint64(block)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z % np.uint64(n) if block is None else z % np.uint64(n // block) * np.uint64(block) + t % np.uint64(block)


def _one_run(data: np.ndarray, s: Sizing, rng: SplitMix64, start: float, block: int | None, most: float | None) -> tuple[float, float]:
    """(final bankroll, deepest drawdown); draws are looked up as far as the run comes."""
    n, at, size = len(data), 0, 1 << 10
    bank = peak = start
    deepest = 0.0
    while at < n:
        got = data[places(n, rng, block, at, min(n, at + size))]
        p, hint = (got[c].tolist() if c in data.dtype.names else repeat(None) for c in ("p", "hint"))
        for odds, o, chance, wish in zip(got["odds"].tolist(), got["outcome"].tolist(), p, hint, strict=False):
            if not odds > 1.0:
                continue
            stake, why = stake_of(s, chance, odds, wish, start, bank)
            if why:
                continue
            stake = min(stake, bank) if most is None else min(stake, most, bank)
            bank += stake * (odds - 1.0) if o == 1 else -stake if o == 2 else 0.0
            peak = max(peak, bank)
            if peak > EPS:
                deepest = max(deepest, (peak - bank) / peak)
            if bank <= EPS:
                return max(bank, 0.0), deepest
        at += size
        size = min(2 * size, 1 << 16)
    return bank, deepest


#: Records of a pool that travel as one value.
_PACK = 128


def bootstrap(spark, pool: DataFrame | pd.DataFrame, sizing: Sizing, runs: int, start: float = 1000.0, block: int | None = None, seed: int = 0, most: float | None = None, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(run, final_bank, roi, max_drawdown) of resampled sequential replays, run by run in parallel, each from its place in one shared stream.

    pool: records of any number in the order of some columns, or a table of driver size as it is ordered. What the sizing
    reads of them is sorted and packed by the executors and goes to each task as a file of its own, mapped and not held:
    runs draw from all of it, memory doesn't grow with it, and nothing of it passes through the driver.
    """
    if block is not None and block < 1:
        raise ValueError("a block has one record at least")
    if isinstance(pool, pd.DataFrame):
        pool, order = pool[["p", "odds", "outcome", "hint"]].astype({"p": float, "odds": float, "hint": float}), ("id",)
        pool = spark.createDataFrame(pool.assign(id=np.arange(len(pool))), "p double, odds double, outcome string, hint double, id bigint")
    given, tasks = asdict(sizing), max(1, min(runs, spark.sparkContext.defaultParallelism))
    kind = [("odds", "<f8"), ("outcome", "i1"), *([("p", "<f8")] if sizing.kind == "kelly" else []), *([("hint", "<f8")] if sizing.kind == "from_column" else [])]
    code = F.when(F.col("outcome") == "win", 1).when(F.col("outcome") == "loss", 2).otherwise(0).cast("byte").alias("outcome")
    ordered = pool.orderBy(*order).select(*[code if c == "outcome" else F.col(c).cast("double").alias(c) for c, _ in kind])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, step = TaskContext.get().partitionId(), 0, _PACK * np.dtype(kind).itemsize
        for b in batches:
            got = np.empty(b.num_rows, kind)
            for c, _ in kind:
                got[c] = b.column(c).to_numpy(zero_copy_only=False)  # a null number is NaN
            raw = got.tobytes()
            data = [raw[i : i + step] for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array(range(k, k + len(data)), pa.int64()), pa.array(data, pa.binary())], ["part", "at", "data"])
            k += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, mine, rows = Sizing(**given), [], []
        with scratch_file() as file:
            for b in batches:
                mine += [k for k, x in zip(b.column("task").to_pylist(), b.column("part").to_pylist(), strict=True) if x < 0]
                for x in b.column("data"):
                    file.write(x.as_py() or b"")
            file.flush()
            n = file.tell() // np.dtype(kind).itemsize
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), kind) if n else np.empty(0, kind)
            for r in (r for k in mine for r in range(k, runs, tasks)):
                bank, deepest = _one_run(data, s, SplitMix64(seed).skip(r * draws_of(n, block)), start, block, most)
                rows.append((r, bank, (bank - start) / start if abs(start) >= EPS else 0.0, deepest if deepest >= 1e-12 else 0.0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.float64()] * 3], strict=True)], ["run", "final_bank", "roi", "max_drawdown"])

    packed = ordered.mapInArrow(pack, "part int, at bigint, data binary").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    heads = spark.range(tasks).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("data"), F.col("id").cast("int").alias("task"))  # a task has runs where the pool is empty, too
    return heads.unionByName(packed).repartitionById(tasks, F.col("task")).sortWithinPartitions("part", "at").mapInArrow(run, "run bigint, final_bank double, roi double, max_drawdown double")


def bands(runs: DataFrame, start: float = 1000.0) -> DataFrame:
    """Nearest-rank 5, 25, 50, 75 and 95 percent bands of a bootstrap, and the share of runs that end below the start. Ranks come from a sort for each measure, not from lists."""
    names, points = ("final_bank", "roi", "max_drawdown"), (5, 25, 50, 75, 95)
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    ranked = long.select("c", "v", F.row_number().over(Window.partitionBy("c").orderBy("v")).alias("r"), F.count("*").over(Window.partitionBy("c")).alias("n"))
    at = lambda c, q: F.max(F.when((F.col("c") == c) & (F.col("r") == F.greatest(F.lit(1), F.ceil(F.lit(q) / 100.0 * F.col("n")))), F.col("v"))).alias(f"{c}_p{q}")
    under = (F.count_if((F.col("c") == "final_bank") & (F.col("v") < start)) / F.count_if(F.col("c") == "final_bank")).alias("p_underwater")
    return ranked.agg(*[at(c, q) for c in names for q in points], under)
