import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def canonical(rows, columns):
    """Rows as sorted tuples by column name, floats to ten digits, missing values alike."""

    def one(v):
        if v is None or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(f"{v:.10g}") + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(one(r[c]) for c in columns)) for r in rows)


def same(spark_df, relation):
    left = spark_df.toPandas()
    right = relation.df()
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)
    assert canonical(left.to_dict("records"), columns) == canonical(right.to_dict("records"), columns)
