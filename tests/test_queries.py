"""Every registered query against its SQL at the smallest scale; what SQL can't say has tests of its own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from paperlane.plans import catalog


def plain(rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted(str(sorted((k, one(v)) for k, v in r.items())) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = [r.asDict() for r in catalog.queries()[name](spark, sf_dir).collect()]
    assert got
    if sql := catalog.oracle_sql().get(name):
        assert plain(got) == plain(con.execute(sql).to_arrow_table().to_pylist())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["invoice_id", "model_name", "run_number"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = catalog.queries()["src_extraction_pending"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "Exchange" not in plan


def test_fan_out_has_no_shuffle(spark, sf_dir):
    plan = catalog.queries()["join_fanout"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
