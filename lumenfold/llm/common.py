"""Shared plumbing: durable intermediate tables, shipping code, null-safe helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir or the session's checkpoint directory.

    Where both are unset, a temporary folder serves a session whose executors are threads of the driver (local[...]). Any
    other session is refused: its executors would each write to a disk of their own, and rows would vanish.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later failures restart from files, not from lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumenfold_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_lumenfold_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hpath, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package's Python code, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenfold_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    handle, target = tempfile.mkstemp(prefix="lumenfold-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._lumenfold_shipped = True


def narrow(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Project to named columns, so that extra input columns can't clash with ours."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def hashed_sample(rows: DataFrame, key: str, most: int, count: int | None = None) -> DataFrame:
    """`most` rows at most, those with the smallest hashes of the key. About twice as many reach one task, however many partitions there are."""
    count = rows.count() if count is None else count
    h = F.pmod(F.xxhash64(key), F.lit(1 << 62))
    if count > 2 * most + 100:
        rows = rows.where(h < int((1 << 62) * ((2 * most + 100) / count)))
    return rows.orderBy(h, key).limit(most)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
