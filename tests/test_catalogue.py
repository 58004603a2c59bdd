"""Every query of the catalogue against its SQL, and those without SQL on what must hold."""

import os

import pandas as pd
import pytest

from gridloom.operators import quantities
from gridloom.plans import catalogue


def rows_of(pdf: pd.DataFrame) -> list[str]:
    def text(x) -> str:
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return "null"
        return f"{float(x):.5f}" if hasattr(x, "__float__") and not isinstance(x, (bool, str, pd.Timestamp)) else str(x)

    return sorted(",".join(text(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf_dir, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_code_length_is_near_entropy(spark, sf_dir):
    lengths = {r[0]: r[1] for r in catalogue.huffman_code_length(spark, sf_dir).collect()}
    bits = {r["l_returnflag"]: r["bits"] for r in catalogue.entropy(spark, sf_dir).collect()}
    assert all(bits[k] <= lengths[k] + 1e-6 < bits[k] + 1 for k in bits)


def test_without_sql(spark, sf_dir):
    assert all(r["after"] < 1e-6 for r in catalogue.moment_correction(spark, sf_dir).collect())
    assert catalogue.greedy_plan(spark, sf_dir).count() > 0
    assert quantities.lloyd(spark.createDataFrame([], "v double"), "v", 3) == []
    assert all(r["ratio"] > 1 for r in catalogue.compression_ratio(spark, sf_dir).collect())
